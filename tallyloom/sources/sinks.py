"""Tables and reports written out.  Reports take small summaries; tables are written by the executors."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame


BOM = "\ufeff"


def write_parquet(df: DataFrame, path: str, *partition_by: str) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str, single: bool = False, bom: bool = False) -> None:
    """CSV with a header; ``single`` is for small summaries only.  ``bom`` puts the UTF-8 mark before each file's header, as spreadsheets want it."""
    if bom and df.columns:
        df = df.withColumnRenamed(df.columns[0], f"{BOM}{df.columns[0]}")
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).csv(path)


def _rows(df: DataFrame, most: int) -> list[dict]:
    rows = [r.asDict() for r in df.limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"a report holds at most {most} rows")
    return rows


def json_report(df: DataFrame, path: str, most: int = 10_000) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(_rows(df, most), f, ensure_ascii=False, indent=2, default=str)


def text_report(lines: list[str], path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")


def _cell(v: object) -> str:
    return "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)


def markdown_table(df: DataFrame, most: int = 1000) -> str:
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    return "\n".join([head, *("| " + " | ".join(_cell(v) for v in r.values()) + " |" for r in _rows(df, most))])


def latex_table(df: DataFrame, lower_is_better: set[str] = frozenset(), most: int = 1000) -> str:
    """A tabular with each number column's best value in bold."""
    rows = _rows(df, most)
    best = {}
    for c in df.columns:
        values = [r[c] for r in rows if isinstance(r[c], (int, float)) and not isinstance(r[c], bool)]
        if values and len(values) == len(rows):
            best[c] = min(values) if c in lower_is_better else max(values)
    lines = [" & ".join(df.columns) + r" \\ \hline"]
    for r in rows:
        lines.append(" & ".join(rf"\textbf{{{_cell(v)}}}" if c in best and v == best[c] else _cell(v) for c, v in r.items()) + r" \\")
    return "\\begin{tabular}{" + "l" * len(df.columns) + "}\n" + "\n".join(lines) + "\n\\end{tabular}"


class JsonCache:
    """A small string-to-string cache kept in a JSON file."""

    def __init__(self, path: str):
        self.path = path
        self.data: dict[str, str] = {}
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                self.data = json.load(f)

    def save(self) -> None:
        with open(self.path, "w", encoding="utf-8") as f:
            json.dump(self.data, f, ensure_ascii=False, sort_keys=True)


def output_dirs(base: str, subset: str, version: str = "") -> dict[str, str]:
    """Paths of an output tree; nothing is created and no state is kept."""
    root = os.path.join(base, *(x for x in (version, subset) if x))
    parts = ("valence", "abuse", "log_odds", "chi2", "bridge", "ca", "embedding", "classifier", "recovery", "tables", "figures")
    return {p: os.path.join(root, p) for p in parts}
