"""Shared helpers of the llm operators: table access, scratch tables, Arrow row blocks and text columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
WS_CHARS = " \t\n\x0b\f\r"
_DATABASE, _CLEANUP = "tallyloom.scratch.database", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables of a data folder, by any path that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_database(spark: SparkSession) -> str:
    """The session's database for scratch tables, in a folder of its own under ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    name = spark.conf.get(_DATABASE, "")
    if name and spark.catalog.databaseExists(name):
        return name
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tallyloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    name = f"tallyloom_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{root.rstrip('/')}/{name}'")
    spark.conf.set(_DATABASE, name)
    return name


def materialize(df: DataFrame, codec: str = "snappy", compact: bool = False) -> DataFrame:
    """Writes ``df`` as a Parquet table in the shared scratch folder and returns the reading of it.

    This cuts the lineage: a lost executor costs no more than the stage that runs, and a table that several
    later steps read is computed once.  ``compact`` evens out narrow tables first, so that there are as many files
    as the data fill, not as many as the tasks before.  Spark deletes the shuffle files of the write when it ends.
    """
    spark = df.sparkSession
    name = f"{scratch_database(spark)}.t{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        (df.hint("rebalance") if compact else df).write.format("parquet").option("compression", codec).saveAsTable(name)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.table(name)
    out.scratch_table = name
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes scratch tables that no later step reads."""
    for t in tables:
        t.sparkSession.sql(f"DROP TABLE IF EXISTS {t.scratch_table}")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def new_name(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores before it as make it a name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def strip_ws(col: Column) -> Column:
    """The string without ASCII white space."""
    return F.translate(col, WS_CHARS, "")


def blocks(batches: Iterator[pa.RecordBatch], max_bytes: int = 4 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that a block's ``column`` holds about ``max_bytes``; a longer value is a block of its own."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        values = batch.column(batch.schema.get_field_index(column))
        sizes = pa.compute.fill_null(pa.compute.binary_length(values), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, size in enumerate(sizes):
            if i > start and total + size > max_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(size)
        yield batch.slice(start)


def short_id(doc_id: Column, modulus: int) -> Column:
    """crc32 of the decimal id modulo ``modulus``; a null id counts as the empty string."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))
