"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may occur in a document with up to e = floor(rate * m) edits.  It is split into
e + 1 pieces, of which at least one must then occur unchanged.  An Aho-Corasick automaton finds all exact piece
hits; around each, the item is verified with Myers' bit-parallel edit distance.  Case and white-space runs do
not count.

The items are a query set that is held against all rows: they go to the executors in blocks of a bounded number
of characters, one pass over the documents for each block, and the documents are never shuffled.

Defined cases: a null or empty text matches nothing; an item that is null or only white space matches nothing;
equal items are each reported; repeated rows are each reported; null ids are carried along; an empty table on
either side gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import WS_CHARS, blocks, read_table, strip_ws, text_or_empty

RATE = 0.08
#: Item characters that one broadcast block holds at most (a longer item is a block of its own).
BLOCK_CHARS = 1_000_000
_SPACES = re.compile(f"[{WS_CHARS}]+")


def normalise(text: str) -> str:
    return _SPACES.sub(" ", text.lower()).strip(" ")


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece) of errors + 1 nearly equal parts; fewer if the item is shorter than that."""
    n = min(errors + 1, len(item))
    cuts = [k * len(item) // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the best occurrence of ``pattern`` in ``text`` with at most ``most`` edits; the first of equals."""
    m = len(pattern)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, most + 1, -1
    get = peq.get
    for j, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
            if best == 0:
                break
    return (best, end) if end >= 0 else None


class Items:
    """A block of test items with the automaton of their pieces."""

    def __init__(self, items: list[tuple[object, str]], rate: float):
        self.items = [(i, t, int(rate * len(t))) for i, t in ((i, normalise(t)) for i, t in items) if t]
        at: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, errors) in enumerate(self.items):
            for offset, piece in pieces(text, errors):
                at.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in at.items():
            self.automaton.add_word(piece, (len(piece), where))
        if at:
            self.automaton.make_automaton()

    def windows(self, text: str) -> dict[int, list[list[int]]]:
        """By item: merged windows of the text in which it may occur."""
        found: dict[int, list[tuple[int, int]]] = {}
        for last, (size, where) in self.automaton.iter(text):
            start = last + 1 - size
            for n, offset in where:
                _, item, errors = self.items[n]
                found.setdefault(n, []).append((max(0, start - offset - errors), start - offset + len(item) + errors))
        out: dict[int, list[list[int]]] = {}
        for n, spans in found.items():
            merged: list[list[int]] = []
            for a, b in sorted(spans):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            out[n] = merged
        return out

    def matches(self, text: str) -> list[tuple[object, int, int, int]]:
        """(item id, distance, start, end) of each item's best occurrence in the normalised text."""
        if not self.items:
            return []
        text, out = normalise(text), []
        for n, windows in self.windows(text).items():
            ident, item, errors = self.items[n]
            best: tuple[int, int] | None = None
            for a, b in windows:
                part = text[a:b]
                hit = part.find(item)
                got = (0, hit + len(item)) if hit >= 0 else myers(item, part, errors if best is None else best[0] - 1)
                if got:
                    best = (got[0], a + got[1])
                    if got[0] == 0:
                        break
            if best:
                distance, end = best
                back = myers(item[::-1], text[max(0, end - len(item) - distance) : end][::-1], distance)
                out.append((ident, distance, end - back[1], end))
        return out


_LOADED: dict[str, Items] = {}


def _items(name: str, shared) -> Items:
    """The worker's automaton, built once for each block."""
    if name not in _LOADED:
        _LOADED.clear()
        _LOADED[name] = Items(*shared.value)
    return _LOADED[name]


def _item_blocks(items: DataFrame, item_id: str, item_text: str, block_chars: int) -> Iterator[list[tuple[object, str]]]:
    """The items in blocks of about ``block_chars`` characters; at least one block."""
    usable = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).where(strip_ws(text_or_empty("text")) != "")
    total = usable.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // block_chars) or 1
    for k in range(n):
        yield [(r[0], r[1]) for r in usable.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).collect()]


def find_leaks(docs: DataFrame, items: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, distance, start, end (of the normalised text): each item's best occurrence in each document that holds it."""
    spark = docs.sparkSession
    kinds = docs.schema[id_col].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    picked = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))

    def scan(block: list[tuple[object, str]]) -> DataFrame:
        name, shared = uuid.uuid4().hex, spark.sparkContext.broadcast((block, rate))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = _items(name, shared)
            for b in blocks(batches, 16 << 20):
                rows, found = [], []
                for i, text in enumerate(b.column(1).to_pylist()):
                    got = held.matches(text)
                    rows += [i] * len(got)
                    found += got
                if rows:
                    cols = list(zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(rows)), pa.array(cols[0]), *(pa.array(c, pa.int64()) for c in cols[1:])],
                        ["doc_id", "item_id", "distance", "start", "end"],
                    )

        return picked.mapInArrow(run, f"doc_id {kinds[0]}, item_id {kinds[1]}, distance long, start long, end long")

    return reduce(DataFrame.unionByName, map(scan, _item_blocks(items, item_id, item_text, block_chars)))


def without_leaks(docs: DataFrame, items: DataFrame, rate: float = RATE, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows whose text holds no item, with all their columns, in one pass for each block of items."""
    at = docs.columns.index(text_col)
    for block in _item_blocks(items, item_id, item_text, block_chars):
        docs = _clean_rows(docs, at, text_col, uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast((block, rate)))
    return docs


def _clean_rows(docs: DataFrame, at: int, text_col: str, name: str, shared) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _items(name, shared)
        for b in blocks(batches, 16 << 20, text_col):
            yield b.filter(pa.array([not held.matches(t or "") for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op5_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
