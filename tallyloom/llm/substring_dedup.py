"""Removal of long repeated byte strings with a run-length index.

Every window of ``length`` bytes that starts at two places of the corpus is found, and the bytes that such windows
cover are removed.  A window is named by its anchor: the leftmost smallest hash among its strings of ``gram``
bytes.  Equal windows have equal anchors, so all windows of one anchor, which lie together as one segment of the
text, need only be held against the other segments of the same anchor hash:

1. Texts become anchors with their segments' bounds; anchors that have one place in the corpus are dropped.
2. Segments of the others are cut out of the distinct texts that hold them; equal ones are counted and kept once.
3. Anchors with several different segments are indexed, many to a block: of the run-compressed Burrows-Wheeler
   transform the text positions at the runs' ends are sampled, matching statistics stream from the samples along
   the text, and the strings of ``length`` bytes that they match are marked (:mod:`run_index`).
4. Marks go back to the segments' places, are merged by text, and the texts are cut.

An anchor with several segments of more than ``HOT`` bytes together is split: by where in the window the anchor stands, half by
half, each half keyed by the longer string that all its windows share.  A share of all rows thus never meets in
one index; in the end a key is the whole window, of which one copy is kept.

Texts that occur several times are removed whole, if they are long enough, and take part in the index once.
Texts are shuffled once, and only those with a repeated anchor are written.  Scratch tables go as soon as nothing
reads them, those behind the result with the session's scratch database.

Defined cases: a null text counts as empty; repeated rows (equal ids too) are documents of their own and so remove
each other if long enough; shorter texts than ``length`` keep everything; null ids pass through; an empty table
gives an empty result; extra columns are ignored; long texts are worked off piece by piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import blocks, discard, materialize, partitions, read_table, text_or_empty
from tallyloom.llm.run_index import RunIndex
from tallyloom.llm.words import mix, random_values, text_buffer

LENGTH, GRAM = 400, 160
#: Bytes of one anchor's segments beyond which it is split; bytes of segments that are indexed together.
HOT, INDEX_BYTES = 2 << 20, 3 << 19
_U = np.uint64
_PIECE = 1 << 18
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_VALUES = random_values(256, 401)
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(10, (n - 1).bit_length())
    if size not in _tables:
        _tables[size] = tuple(np.concatenate(([_U(1)], np.full(size, b))).cumprod(dtype=np.uint64) for b in (_BASE, _INVERSE))
    return _tables[size]


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """The hash of data[i:i + size] for every i."""
    up, down = _powers(len(data))
    sums = np.concatenate(([_U(0)], np.cumsum(_VALUES[data] * up[: len(data)], dtype=np.uint64)))
    return mix((sums[size:] - sums[:-size]) * down[: len(data) - size + 1])


def _window_minimum(a: np.ndarray, w: int) -> np.ndarray:
    """min(a[i:i + w]) for every i."""
    n = len(a)
    padded = np.concatenate([a, np.full(-n % w, ~_U(0))]).reshape(-1, w)
    forward = np.minimum.accumulate(padded, 1).ravel()
    backward = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(backward[: n - w + 1], forward[w - 1 : n])


def window_anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the anchor of every window of ``data``."""
    h = gram_hashes(data, gram)
    low = _window_minimum((h & ~_U(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64), length - gram + 1) & _U(0xFFFFFF)
    low = low.astype(np.int64)
    return low, h[low]


def segments(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(anchor hashes, first windows, last windows, several): all windows of a text, by anchor, in order.

    Neighbouring anchors of equal hash, as in periodic text, make one segment with ``several`` places.
    """
    if len(data) < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    names, first, last, several = [], [], [], []
    for at in range(0, len(data) - length + 1, _PIECE):
        low, name = window_anchors(data[at : at + _PIECE + length - 1], length, gram)
        cut = np.flatnonzero(np.append(True, name[1:] != name[:-1]))
        to = np.append(cut[1:], len(name)) - 1
        names.append(name[cut])
        first.append(at + cut)
        last.append(at + to)
        several.append(low[cut] != low[to])
    return tuple(map(np.concatenate, (names, first, last, several)))


def _content(data: bytes) -> bytes:
    return blake2b(data, digest_size=16).digest()


def _keyed(docs: DataFrame, text_col: str, *cols) -> DataFrame:
    """The text with 128 bits that stand for it."""
    d = docs.select(*cols, text_or_empty(text_col).alias("text"))
    return d.withColumns({"ka": F.xxhash64("text"), "kb": F.xxhash64(F.lit(31), "text")})


def _anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """ka, kb, anchor, first, last, several of every segment of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            offsets, data = text_buffer(b.column(2))
            found = [segments(data[x:y], length, gram) for x, y in zip(offsets[:-1], offsets[1:], strict=True)]
            row = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
            names, first, last, several = (np.concatenate(x) for x in zip(*found, strict=True))
            cols = [b.column(0).take(row), b.column(1).take(row), pa.array(names.view(np.int64)), pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(several)]
            yield pa.RecordBatch.from_arrays(cols, ["ka", "kb", "anchor", "first", "last", "several"])

    return docs.select("ka", "kb", "text").mapInArrow(run, "ka long, kb long, anchor long, first int, last int, several boolean")


def _cut_segments(texts: DataFrame, length: int, content: bool) -> DataFrame:
    """anchor, c (name of the segment's content), and either its bytes or its place (ka, kb, first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            ka, kb, names, cs, place, datas, several = [], [], [], [], [], [], []
            for x, y, t, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                raw = t.encode("utf-8")
                for s in found:
                    part = raw[s["first"] : s["last"] + length]
                    names.append(s["anchor"])
                    cs.append(_content(part))
                    if content:
                        datas.append(part)
                        several.append(s["several"])
                    else:
                        ka.append(x)
                        kb.append(y)
                        place.append(s["first"])
            head = [pa.array(names, pa.int64()), pa.array(cs, pa.binary())]
            if content:
                yield pa.RecordBatch.from_arrays([*head, pa.array(datas, pa.binary()), pa.array(several, pa.bool_())], ["anchor", "c", "data", "several"])
            else:
                yield pa.RecordBatch.from_arrays([*head, pa.array(ka, pa.int64()), pa.array(kb, pa.int64()), pa.array(place, pa.int32())], ["anchor", "c", "ka", "kb", "first"])

    return texts.select("ka", "kb", "text", "found").mapInArrow(run, "anchor long, c binary, " + ("data binary, several boolean" if content else "ka long, kb long, first int"))


def _index(contents: DataFrame, length: int, n: int) -> DataFrame:
    """c, start, count: the runs of windows of a content that another place of the same anchor has too."""

    def emit(held: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        c, start, count = [], [], []
        for (name, _), runs in zip(held, RunIndex([d for _, d in held]).repeated(length), strict=True):
            for a, k in runs:
                c.append(name)
                start.append(a)
                count.append(k)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()), pa.array(start, pa.int32()), pa.array(count, pa.int32())], ["c", "start", "count"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, lone, held, total = None, None, [], 0
        for b in batches:
            for a, c, d, several in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if a != anchor:
                    if total > INDEX_BYTES:
                        yield emit(held)
                        held, total = [], 0
                    anchor, lone = a, None
                    if not several:  # alone it can't repeat anything; a second segment of its anchor brings it in
                        lone = (c, d)
                        continue
                if lone:
                    held.append(lone)
                    total += len(lone[1])
                    lone = None
                held.append((c, d))
                total += len(d)
        if held:
            yield emit(held)

    dealt = contents.select("anchor", "c", "data", "several").repartition(n, "anchor").sortWithinPartitions("anchor", "c")
    return dealt.mapInArrow(run, "c binary, start int, count int")


def _split(contents: DataFrame, length: int, gram: int) -> DataFrame:
    """The halves of some contents, by where their windows have the anchor.

    parent, offset (of the half in the parent), and what a content has.  ``ra`` and ``rb`` bound the windows' starts
    relative to the anchor; a half's new anchor is the string that all windows within its bounds share.  Of equal
    halves, as periodic text has them, one brings its bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = [[] for _ in range(8)]
            told: set[bytes] = set()
            for c, data, n, ra, rb in zip(*(x.to_pylist() for x in b.columns), strict=True):
                low, _ = window_anchors(np.frombuffer(data, np.uint8), length, gram)
                at = np.arange(len(low))
                mid = (ra + rb) // 2
                side = (at - low > mid).astype(np.int64)
                cut = np.flatnonzero(np.append(True, (low[1:] != low[:-1]) | (side[1:] != side[:-1])))
                for x, y in zip(cut, np.append(cut[1:], len(low)), strict=True):
                    lo, hi = (mid + 1, rb) if side[x] else (ra, mid)
                    p = int(low[x])
                    core, half = data[p + hi : p + lo + length], data[x : y - 1 + length]
                    name = int.from_bytes(blake2b(core, digest_size=8).digest(), "little", signed=True)
                    what = _content(half)
                    for col, v in zip(rows, (c, int(x), name, what, None if what in told else half, n, lo, hi), strict=True):
                        col.append(v)
                    told.add(what)
            kinds = [pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], ["parent", "offset", "anchor", "c", "data", "n", "ra", "rb"])

    return contents.select("c", "data", "n", "ra", "rb").mapInArrow(run, "parent binary, offset int, anchor long, c binary, data binary, n long, ra int, rb int")


def _by_content(marks: DataFrame, length: int) -> DataFrame:
    """c, marks: one row for each content, with its marks, merged where the bytes that they cover meet.

    Joins with it give a row for each place and not for each place and mark.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for found in b.column(1).to_pylist():
                merged: list[dict] = []
                for a, z in sorted((m["start"], m["start"] + m["count"]) for m in found):
                    if merged and a <= merged[-1]["start"] + merged[-1]["count"] - 1 + length:
                        merged[-1]["count"] = max(z - merged[-1]["start"], merged[-1]["count"])
                    else:
                        merged.append({"start": a, "count": z - a})
                out.append(merged)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("count", pa.int32())])))], ["c", "marks"])

    each = marks.groupBy("c").agg(F.collect_set(F.struct("start", "count")).alias("marks"))
    return each.mapInArrow(run, "c binary, marks array<struct<start:int,count:int>>")


def _marks(contents: DataFrame, length: int, gram: int, hot: int, n: int) -> DataFrame:
    """c, marks (start, count): the repeated windows of all contents that have any."""
    size = F.length("data").cast("long")
    levels, links = [], []
    for _ in range(2 + (length - gram + 1).bit_length()):
        whole = contents.where("n > 1").select("c", F.lit(0).alias("start"), (F.length("data") - (length - 1)).alias("count"))
        large = materialize(contents.groupBy("anchor").agg(F.count(F.lit(1)).alias("k"), F.sum(size).alias("bytes")).where((F.col("k") > 1) & (F.col("bytes") > hot)).select("anchor"), compact=True)
        if large.isEmpty():
            levels.append(whole.unionByName(_index(contents, length, n)))
            break
        levels.append(whole.unionByName(_index(contents.join(large, "anchor", "left_anti"), length, n)))
        halves = materialize(_split(contents.join(large, "anchor", "left_semi"), length, gram))
        links.append(halves.select("parent", "offset", "c"))
        contents = materialize(
            halves.groupBy("anchor", "c").agg(F.first("data", True).alias("data"), F.sum("n").alias("n"), F.first("ra").alias("ra"), F.first("rb").alias("rb")).withColumn("several", F.lit(False))
        )
    out = _by_content(levels.pop(), length)
    while links:
        up = links.pop().join(out, "c").select(F.col("parent").alias("c"), "offset", F.inline("marks"))
        out = _by_content(levels.pop().unionByName(up.select("c", (F.col("offset") + F.col("start")).alias("start"), "count")), length)
    return out


def _cut_texts(texts: DataFrame, length: int) -> DataFrame:
    """ka, kb, spans, kept_sha256 of (ka, kb, text, runs: each segment's first byte and its marks)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            spans, names = [], []
            for t, runs in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                raw, merged = t.encode("utf-8"), []
                for a, z in sorted((r["first"] + m["start"], r["first"] + m["start"] + m["count"] - 1 + length) for r in runs for m in r["marks"]):
                    if merged and a <= merged[-1]["end"]:
                        merged[-1]["end"] = max(z, merged[-1]["end"])
                    else:
                        merged.append({"start": a, "end": z})
                digest, at = sha256(), 0
                for m in merged:
                    digest.update(raw[at : m["start"]])
                    at = m["end"]
                digest.update(raw[at:])
                spans.append(merged)
                names.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(names)], ["ka", "kb", "spans", "kept_sha256"]
            )

    return texts.select("ka", "kb", "text", "runs").mapInArrow(run, "ka long, kb long, spans array<struct<start:int,end:int>>, kept_sha256 string")


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, spans (the removed runs: array of start and end byte), kept_sha256."""
    spark, n = docs.sparkSession, partitions(docs.sparkSession)
    keyed = _keyed(docs, text_col, F.col(id_col).alias("doc_id"))
    rows = materialize(keyed.select("doc_id", "ka", "kb", F.octet_length("text").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha")))

    anchors = materialize(_anchors(keyed, length, gram))
    site = F.xxhash64("ka", "kb", "first")
    named = anchors.groupBy("anchor").agg(F.min(site).alias("low"), F.max(site).alias("high"), F.max("several").alias("several"))
    repeated = named.where("low != high or several").select("anchor")
    found = anchors.join(repeated, "anchor").groupBy("ka", "kb").agg(F.collect_set(F.struct("anchor", "first", "last", "several")).alias("found"))
    texts = materialize(keyed.select("ka", "kb", "text").dropDuplicates(["ka", "kb"]).join(found, ["ka", "kb"]))
    discard(anchors)

    cut = _cut_segments(texts, length, True).groupBy("anchor", "c")
    contents = materialize(cut.agg(F.first("data").alias("data"), F.count(F.lit(1)).alias("n"), F.max("several").alias("several")))
    stored = contents.withColumns({"ra": F.lit(gram - length), "rb": F.lit(0)})
    marks = materialize(_marks(stored, length, gram, hot, n))
    discard(contents)

    runs = _cut_segments(texts, length, False).join(marks, "c").select("ka", "kb", F.struct("first", "marks").alias("run"))
    by_text = runs.groupBy("ka", "kb").agg(F.collect_list("run").alias("runs"))
    done = materialize(_cut_texts(texts.drop("found").join(by_text, ["ka", "kb"]), length))
    discard(texts, marks)

    copies = rows.groupBy("ka", "kb").agg(F.count(F.lit(1)).alias("copies"))
    known = materialize(copies.join(done, ["ka", "kb"], "left"), compact=True)
    discard(done)
    none = F.array().cast("array<struct<start:int,end:int>>")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    everything = F.array(F.struct(F.lit(0).alias("start"), F.col("n_bytes").cast("int").alias("end")))
    return rows.join(known, ["ka", "kb"]).select(
        "doc_id",
        F.col("n_bytes").cast("long").alias("n_bytes"),
        F.when(whole, everything).otherwise(F.coalesce("spans", none)).alias("spans"),
        F.when(whole, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


def op9_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_spans(read_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + (x["end"] - x["start"]))
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
