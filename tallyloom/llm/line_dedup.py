"""Line deduplication by site-relative frequency, with DataFrame functions only.

Pages are grouped by host.  The pages of a host that contain a line, divided by all pages of the host, is the
line's ratio; lines above the boilerplate ratio are dropped from every page of that host, if they stand on three
pages at least: on a host of fewer than 30 pages one or two would already be a tenth.  A line counts once a page, however often it stands there, and is compared without outer white space.

Lines travel as a pair of 64-bit hashes and are counted with map-side combining; a line is filtered by its
minimum page count before it meets its host's total.  At most (mean lines a page) / ratio lines of a host can
exceed the ratio, so a host's dropped lines fit into one array.  All hosts' arrays together are broadcast only
when they hold no more than ``BROADCAST_LINES`` lines; else they are joined by host, where a hot host's pages
can be split because its other side is one row.

Defined cases: a null text stays null, with no lines; a null host is a host of its own; empty lines are kept
and not counted; every row is a page of its own, so repeated rows count as often as they stand there; a page
with no dropped line keeps its exact text; an empty table gives an empty result; extra columns are passed on,
except those named like an output column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import WS_CHARS, materialize, new_name, read_table

RATIO, MIN_PAGES = 0.1, 3
#: Dropped lines of all hosts up to which they are broadcast: about 16 bytes each.
BROADCAST_LINES = 200_000


def _trim(c: Column) -> Column:
    return F.trim(c, F.lit(WS_CHARS))


def _key(line: Column) -> Column:
    """128 bits of the trimmed line."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(29), line).alias("b"))


def _host_key(host: Column) -> Column:
    """A string for each host; the empty one for null, which no other host has."""
    return F.coalesce(F.concat(F.lit("="), host.cast("string")), F.lit(""))


def boilerplate_lines(pages: DataFrame, host: Column, text: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """One row per host with dropped lines: host_key, drop (array of line keys), n."""
    p = pages.select(_host_key(host).alias("host_key"), text.alias("text"))
    totals = p.groupBy("host_key").agg(F.count(F.lit(1)).alias("pages"))
    lines = p.select("host_key", F.explode(F.array_distinct(F.transform(F.split("text", "\n"), _trim))).alias("line")).where("line != ''")
    counts = lines.select("host_key", _key(F.col("line")).alias("k")).groupBy("host_key", "k").agg(F.count(F.lit(1)).alias("on")).where(F.col("on") >= min_pages)
    dropped = counts.join(totals, "host_key").where(F.col("on") > F.lit(ratio) * F.col("pages"))
    return dropped.groupBy("host_key").agg(F.collect_list("k").alias("drop"), F.count(F.lit(1)).alias("n"))


def line_dedup(pages: DataFrame, host: Column, text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """The pages with the host's boilerplate lines taken out of ``text_col``; adds n_lines and n_dropped (long)."""
    p = pages.drop("n_lines", "n_dropped")
    key, gone, kept = (new_name(p, c) for c in ("host_key", "drop", "kept"))
    drop = materialize(boilerplate_lines(pages, host, F.col(text_col), ratio, min_pages))
    size = drop.agg(F.sum("n")).first()[0] or 0
    drop = drop.select(F.col("host_key").alias(key), F.col("drop").alias(gone))
    if size <= BROADCAST_LINES:
        drop = F.broadcast(drop)
    lines = F.split(F.col(text_col), "\n")
    rest = F.filter(lines, lambda x: ~F.array_contains(F.col(gone), _key(_trim(x))))
    out = p.withColumn(key, _host_key(host)).join(drop, key, "left").withColumn(kept, F.when(F.col(gone).isNotNull(), rest).otherwise(lines))
    count = lambda c: F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.coalesce(F.size(c), F.lit(0))).cast("long")
    n, k = count(lines), count(F.col(kept))
    return out.withColumns({text_col: F.when(n == k, F.col(text_col)).otherwise(F.array_join(kept, "\n")), "n_lines": n, "n_dropped": n - k}).drop(key, gone, kept)


def page_host(url: Column) -> Column:
    """The lower-case host of a URL; the empty string where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)", 1), F.lit("")))


def page_lines(html: Column) -> Column:
    """An HTML page as text: scripts and styles go, and every tag ends a line."""
    code = F.regexp_replace(html, r"(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>", "\n")
    return F.regexp_replace(code, "<[^>]*>", "\n")


def op7_site_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", page_host(F.col("url")).alias("host"), page_lines(F.col("html")).alias("text"))
    return line_dedup(pages, F.col("host")).select("page_id", "host", "n_lines", "n_dropped", "text")


def line_dedup_sql(source: str, key: str, host: str, text: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> str:
    """DuckDB SQL for :func:`line_dedup`'s rows: {key}, host, n_lines, n_dropped, text; ``key`` must be unique."""
    ws = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH p AS (SELECT {key}, {host} AS host, {text} AS text, string_split({text}, chr(10)) AS lines FROM {source}),
l AS (SELECT DISTINCT {key}, host, trim(u.line, {ws}) AS line FROM p, unnest(lines) AS u(line)),
c AS (SELECT host, line, count(*) AS n FROM l WHERE line <> '' GROUP BY host, line),
t AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
d AS (SELECT host, list(line) AS gone FROM c JOIN t USING (host) WHERE n >= {min_pages} AND n > {ratio} * pages GROUP BY host),
k AS (SELECT p.*, CASE WHEN gone IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(gone, trim(x, {ws}))) END AS kept
      FROM p LEFT JOIN d USING (host))
SELECT {key}, host, coalesce(len(lines), 0) AS n_lines, coalesce(len(lines) - len(kept), 0) AS n_dropped,
       CASE WHEN text IS NULL THEN NULL WHEN len(kept) = len(lines) THEN text ELSE array_to_string(kept, chr(10)) END AS text
FROM k
"""


OP7_SQL = line_dedup_sql(
    r"""(SELECT page_id, lower(coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)', 1), '')) AS site,
         regexp_replace(regexp_replace(html, '(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>', chr(10), 'g'), '<[^>]*>', chr(10), 'g') AS body
  FROM pages)""",
    "page_id", "site", "body",
)
