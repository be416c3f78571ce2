"""Language-model scores with Katz backoff.

A bigram model is counted on the training rows.  Counts up to ``K`` get Good-Turing discounts (Katz's form, which
leaves counts above ``K`` alone); what a history saves is spread over its unseen words in proportion to their
lower-order probability, with the backoff weight that makes the history's probabilities sum to one exactly:

    P(w|h) = d(c(h,w)) c(h,w) / c(h)   if c(h,w) > 0,   else   alpha(h) P(w)
    P(w)   = d(c(w)) c(w) / N          if c(w) > 0,     else   the mass that the unigrams save

over the V training words and one class for all others.  A history that saves nothing counts one event more,
which is its unseen words'.  Where counts of counts give no discount in (0, 1], absolute discounting with
n1 / (n1 + 2 n2) takes its place.

Tables.  Words are 64-bit hashes.  ``unigrams`` (word, count) is a plain table.  The bigrams are a table with one
row for each of twice as many buckets as ``spark.sql.shuffle.partitions``, dealt by word, which holds the packed
words, histories, counts and the places (chunk, document) where a bigram stands; ``bigram_rows`` shows it as
rows.  The recursion runs by exchanges: dealt by word, a bigram meets its word's count; dealt by history it meets
its history's weight; dealt by chunk the tokens' log-probabilities add up to documents.

Words that hold more than a quarter of a partition's share of all tokens are hot: as words and as histories they
are split over all partitions by the bigram's other half, and their totals, at most four for each bucket, are
broadcast.  A bigram that a document repeats is one entry with a count.

A chunk gives at most one piece a bucket, and chunks grow with the buckets (``CHUNK_BUCKET`` bytes of text for each),
so that the pieces keep their size and their number follows the text.  Beyond ``CHUNK_MOST`` pieces get smaller; there
are never more than bigrams.  A bucket and a chunk are held whole by one task.

Defined cases: a null or empty text is the end token alone; repeated rows are documents of their own; a null id
counts as an empty one for ``held_out`` and is carried along; without training rows every score is 0 (one class);
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import blocks, materialize, partitions, read_table, short_id, text_or_empty
from tallyloom.llm.packing import deltas, pack, small, unpack
from tallyloom.llm.words import mix, random_values, text_buffer, word_hashes

#: Counts up to K are discounted.
K = 5
#: Bytes of text whose bigrams are counted together before they are dealt out: at least, for each bucket, at most.
CHUNK, CHUNK_BUCKET, CHUNK_MOST = 8 << 20, 2048, 64 << 20
_U = np.uint64
START, END = random_values(2, 911)
_META = -1
_PIECES = "bucket int, chunk long, payload binary"
_TABLE = "bucket int, chunk long, payload binary, hot binary, counts array<long>"


def discounts(n: list[int]) -> np.ndarray:
    """d[c] for c = 0..K+1 (d[K+1] stands for all larger counts) from n[r], the number of events counted r times."""
    d = np.ones(K + 2)
    n1, tail = n[1], (K + 1) * n[K + 1]
    spare = n1 / (n1 + 2 * n[2]) if n1 else 0.5
    common = tail / n1 if n1 else 1.0
    for r in range(1, K + 1):
        good = (r + 1) * n[r + 1] / (r * n[r]) if n[r] else 1.0
        d[r] = (good - common) / (1 - common) if common < 1 else 1.0
        if not 0 < d[r] < 1:
            d[r] = (r - spare) / r
    return d


class Unigrams:
    """N, V, the discounts and the probabilities of counts; what an unseen word gets."""

    def __init__(self, tokens: int, distinct: int, counts: list[int]):
        self.tokens, self.distinct, self.d = tokens, distinct, discounts(counts)
        saved = sum((1 - self.d[r]) * r * counts[r] for r in range(1, K + 1))
        self.whole = tokens if saved > 0 else tokens + 1
        self.unseen = (saved if saved > 0 else 1) / self.whole

    def probability(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.d[np.minimum(c, K + 1)] * c / self.whole, self.unseen)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.tokens + 0.1 * (self.distinct + 1)))


def _of(values: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
    """The position of each value among the keys, -1 if it is none."""
    if not len(sorted_keys):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(sorted_keys, values), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == values, at, -1)


def _bucket(key: np.ndarray, other: np.ndarray, hot: np.ndarray, n: int) -> np.ndarray:
    """Dealt by key; hot keys by both."""
    h = mix(key + _U(5))
    split = _of(key, hot) >= 0
    h[split] = mix(h[split] ^ (other[split] * _U(0x9E3779B97F4A7C15)))
    return ((h >> _U(32)) * _U(n) >> _U(32)).astype(np.int64)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of all given ranges, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    """All parts in one array; the list is emptied, so that its parts' memory can go."""
    out = np.concatenate(parts)
    parts.clear()
    return out


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(histories, words, number of tokens of each text); every text has an end token."""
    hashes, ends = word_hashes(*text_buffer(texts))
    return np.insert(hashes, ends[:-1], START), np.insert(hashes, ends[1:], END), np.diff(ends) + 1


def count_words(docs: DataFrame) -> DataFrame:
    """word, count over the rows' texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for b in blocks(batches):
            _, w, _ = _tokens(b.column(0))
            more, n = np.unique(w, return_counts=True)
            words, inverse = np.unique(np.concatenate([words, more]), return_inverse=True)
            counts = np.bincount(inverse, np.concatenate([counts, n])).astype(np.int64)
            if len(words) > 1_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], ["word", "count"])
                words, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], ["word", "count"])

    part = docs.select("text").mapInArrow(run, "word long, count long")
    return part.groupBy("word").agg(F.sum("count").alias("count"))


def _deal_bigrams(docs: DataFrame, hot, n: int) -> DataFrame:
    """From (doc_id, held_out, text): the chunks' bigrams by bucket, and a row for each chunk with what it holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = hot.value[0]
        chunk = TaskContext.get().partitionId() << 32
        for b in blocks(batches, min(max(CHUNK, n * CHUNK_BUCKET), CHUNK_MOST)):
            h, w, sizes = _tokens(b.column(2))
            doc = np.repeat(np.arange(len(sizes), dtype=np.uint32), sizes)
            held = np.array(b.column(1), bool)
            meta = pa.table([b.column(0), b.column(1), pa.array(sizes, pa.int64())], ["doc_id", "held_out", "n_tokens"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, meta.schema) as out:
                out.write_table(meta)
            rows = [(int(chunk % n), _META, sink.getvalue().to_pybytes())]
            bucket = _bucket(w, h, keys, n)
            order = np.argsort(bucket.astype(np.uint16 if n <= 1 << 16 else np.uint32), kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(n + 1))
            for k in range(n):
                part = order[cuts[k] : cuts[k + 1]]
                if len(part):
                    ws, hs, ds = w[part], h[part], doc[part]
                    o = np.lexsort((hs, ws))
                    ws, hs, ds = ws[o], hs[o], ds[o]
                    pair = np.append(True, (ws[1:] != ws[:-1]) | (hs[1:] != hs[:-1]))
                    entry = np.append(True, pair[1:] | (ds[1:] != ds[:-1]))
                    at = np.flatnonzero(entry)
                    first = np.flatnonzero(pair)
                    uw, of_word = np.unique(ws[first], return_counts=True)
                    uh, hi = np.unique(hs[first], return_inverse=True)
                    each = np.diff(np.append(np.flatnonzero(pair[at]), len(at)))
                    data = pack(deltas(uw), small(of_word), deltas(uh), small(hi), small(each), small(ds[at]), small(np.diff(np.append(at, len(ds)))), np.packbits(held), np.array([len(held)]))
                    rows.append((k, 0, data))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([chunk if r[1] != _META else -1 - chunk for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())],
                ["bucket", "chunk", "payload"],
            )
            chunk += 1

    return docs.mapInArrow(run, _PIECES)


def _merge_bigrams(pieces: list[tuple[int, bytes]], unigrams: Unigrams, keys: np.ndarray, totals: np.ndarray) -> tuple[bytes, bytes, list[int]]:
    """(packed bigrams, totals of hot histories, counts of counts) of one bucket.

    Packed: words, their counts, bigrams of each word, histories, history of each bigram, its training count, its
    entries, the entries' chunk, document and number, and the chunks' numbers.
    """
    ws, hs, each, docs, nums, held, chunk_at, chunks = [], [], [], [], [], [], [], []
    while pieces:
        chunk, data = pieces.pop()
        uw, of_word, uh, hi, n, ds, cs, bits, size = unpack(data)
        ws.append(np.repeat(np.cumsum(uw), of_word))
        hs.append(np.cumsum(uh)[hi])
        each.append(n.astype(np.int32))
        docs.append(ds.astype(np.uint32))
        nums.append(cs.astype(np.uint32))
        held.append(np.unpackbits(bits, count=int(size[0])).astype(bool)[ds])
        chunk_at.append(np.full(len(ds), len(chunks), np.uint32))
        chunks.append(chunk)
    w, h, n, doc, num, out_of, at = (_joined(x) for x in (ws, hs, each, docs, nums, held, chunk_at))
    trained = np.add.reduceat(np.where(out_of, 0, num).astype(np.int64), np.cumsum(n) - n)
    order = np.lexsort((h, w))
    w, h, starts, n, trained = w[order], h[order], (np.cumsum(n) - n)[order], n[order], trained[order]
    first = np.flatnonzero(np.append(True, (w[1:] != w[:-1]) | (h[1:] != h[:-1])))
    count = np.add.reduceat(trained, first)
    entries = _ranges(starts, n)
    sizes = np.add.reduceat(n.astype(np.int64), first)
    uw, begin, of_word = np.unique(w[first], return_index=True, return_counts=True)
    word_count = np.add.reduceat(count, begin)
    known = _of(uw, keys)
    word_count = np.where(known >= 0, totals[known] if len(totals) else 0, word_count)
    uh, hi = np.unique(h[first], return_inverse=True)
    data = pack(deltas(uw), small(word_count), small(of_word), deltas(uh), small(hi), small(count), small(sizes), small(at[entries]), small(doc[entries]), small(num[entries]), np.array(chunks, np.int64))
    seen = count > 0
    of_hot = _of(uh, keys)[hi]
    some = seen & (of_hot >= 0)
    low = unigrams.probability(np.repeat(word_count, of_word))
    if some.any():
        width = K + 3
        table = np.zeros((len(keys), width))
        np.add.at(table, (of_hot[some], np.minimum(count[some], K + 1)), np.where(count[some] > K, count[some], 1))
        np.add.at(table[:, K + 2], of_hot[some], low[some])
        rows = np.flatnonzero(table.any(1))
        hot = pack(rows, table[rows].ravel())
    else:
        hot = b""
    return data, hot, np.bincount(np.minimum(count, K + 2), minlength=K + 3)[: K + 2].tolist()


def bigram_table(docs: DataFrame, unigrams: Unigrams, hot, n: int) -> DataFrame:
    """The bigrams of all rows, one row per bucket; and the chunks' own rows (bucket -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list[tuple[int, bytes]]] = {}  # a partition has one bucket
        schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("payload", pa.binary()), ("hot", pa.binary()), ("counts", pa.list_(pa.int64()))])
        for b in batches:
            for bucket, chunk, payload in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if chunk < 0:
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((_META, -1 - chunk, payload, b"", []), schema.types, strict=True)], schema=schema)
                else:
                    by.setdefault(bucket, []).append((chunk, payload))
        keys, totals = hot.value
        for bucket in sorted(by):
            got = _merge_bigrams(by.pop(bucket), unigrams, keys, totals)
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((bucket, -1, *got), schema.types, strict=True)], schema=schema)

    return _by_number(_deal_bigrams(docs, hot, n), n, "bucket").mapInArrow(run, _TABLE)


def _by_number(df: DataFrame, n: int, col: str) -> DataFrame:
    """One partition for each number below n."""
    return df.repartitionById(n, F.col(col))


def bigram_rows(table: DataFrame) -> DataFrame:
    """history, word, count of all bigrams of the training rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0).to_pylist():
                uw, _, of_word, uh, hi, count, *_ = unpack(data)
                cols = [np.cumsum(uh)[hi].view(np.int64), np.repeat(np.cumsum(uw), of_word).view(np.int64), count.astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["history", "word", "count"]).filter(pa.array(count > 0))

    return table.where(F.col("bucket") >= 0).select("payload").mapInArrow(run, "history long, word long, count long")


def _deal_histories(table: DataFrame, hot, n: int) -> DataFrame:
    """The bigrams by their history's bucket: word's count, own count, entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = hot.value[0]
        for b in batches:
            for data in b.column(0).to_pylist():
                uw, cw, of_word, uh, hi, count, sizes, at, doc, num, chunks = unpack(data)
                w, cw, h = np.repeat(np.cumsum(uw), of_word), np.repeat(cw, of_word), np.cumsum(uh)[hi]
                starts = np.cumsum(sizes, dtype=np.int64) - sizes
                bucket = _bucket(h, w, keys, n)
                order = np.lexsort((h, bucket))
                cuts = np.searchsorted(bucket[order], np.arange(n + 1))
                for k in range(n):
                    part = order[cuts[k] : cuts[k + 1]]
                    if len(part):
                        names, runs = np.unique(h[part], return_counts=True)
                        e = _ranges(starts[part], sizes[part].astype(np.int64))
                        packed = pack(deltas(names), small(runs), small(cw[part]), small(count[part]), small(sizes[part]), small(at[e]), small(doc[e]), small(num[e]), chunks)
                        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([-1], pa.int64()), pa.array([packed], pa.binary())], ["bucket", "chunk", "payload"])

    return table.where(F.col("bucket") >= 0).select("payload").mapInArrow(run, _PIECES)


def _backoff(h: np.ndarray, count: np.ndarray, low: np.ndarray, d: np.ndarray, keys: np.ndarray, hot_sums: np.ndarray) -> np.ndarray:
    """log10 P of all bigrams of some histories: their training counts, and their words' lower-order probabilities."""
    names, inverse = np.unique(h, return_inverse=True)
    kept = d[np.minimum(count, K + 1)] * count
    sums = np.stack([np.bincount(inverse, x, len(names)) for x in (count, kept, np.where(count > 0, low, 0))], 1)
    known = _of(names, keys)
    sums[known >= 0] = hot_sums[known[known >= 0]]
    total, kept_sum, low_sum = sums.T
    saves = total - kept_sum > 1e-9 * np.maximum(total, 1)
    whole = np.where(saves, total, total + 1)
    alpha = np.where(total > 0, (1 - kept_sum / whole) / np.maximum(1 - low_sum, 1e-300), 1.0)
    return np.log10(np.where(count > 0, kept / whole[inverse], alpha[inverse] * low))


def _chunk_sums(head: list[tuple], score: np.ndarray, base: np.ndarray, known: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Each chunk's number and its documents' sums over one bucket's pieces, whose entries are sorted by chunk together; the list is emptied."""
    chunks = np.unique(np.concatenate([x[8] for x in head]))
    narrow = np.uint16 if len(chunks) <= 1 << 16 else np.uint32
    pair = np.repeat(np.arange(len(score), dtype=np.uint32), np.concatenate([x[4] for x in head]).astype(np.int64))
    at = np.concatenate([np.searchsorted(chunks, x[8]).astype(narrow)[x[5].astype(np.int64)] for x in head])
    doc, num = (np.concatenate([x[i] for x in head]) for i in (6, 7))
    head.clear()
    order = np.argsort(at, kind="stable")
    cuts = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(chunks)))])
    for k, chunk in enumerate(chunks):
        e = order[cuts[k] : cuts[k + 1]]
        if len(e):
            p, c, ds = pair[e], num[e].astype(np.int64), doc[e].astype(np.int64)
            yield int(chunk), [np.bincount(ds, x[p] * c) for x in (score, base, known)]


def _score_buckets(dealt: DataFrame, unigrams: Unigrams, d: np.ndarray, hot, hot_sums) -> DataFrame:
    """chunk, payload: sums over each chunk's documents for every bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list[bytes]] = {}
        for b in batches:
            for bucket, payload in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                by.setdefault(bucket, []).append(payload)
        for bucket in sorted(by):
            head = [unpack(data) for data in by.pop(bucket)]
            h = np.concatenate([np.repeat(np.cumsum(x[0]), x[1]) for x in head])
            cw = np.concatenate([x[2].astype(np.int64) for x in head])
            count = np.concatenate([x[3].astype(np.int64) for x in head])
            score = _backoff(h, count, unigrams.probability(cw), d, hot.value[0], hot_sums.value)
            base, known = unigrams.base(cw), (cw > 0).astype(np.int64)
            for chunk, (s, t, n) in _chunk_sums(head, score, base, known):
                data = pack(s, t, small(n.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([data], pa.binary())], ["chunk", "payload"])

    return dealt.mapInArrow(run, "chunk long, payload binary")


def katz_scores(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model is learnt from the rows where ``held_out`` is false; all rows are scored.
    """
    spark, n = docs.sparkSession, 2 * partitions(docs.sparkSession)  # a bucket is held by one task at once
    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col).alias("doc_id"), held_out.alias("held_out"), text_or_empty(text_col).alias("text"))

    words = materialize(count_words(picked.where(~F.col("held_out"))))
    tokens, distinct = (x or 0 for x in words.agg(F.sum("count"), F.count(F.lit(1))).first())
    of_counts = dict(words.where(F.col("count") <= K + 1).groupBy("count").agg(F.count(F.lit(1))).collect())
    unigrams = Unigrams(tokens, distinct, [of_counts.get(r, 0) for r in range(K + 2)])
    loud = words.where(F.col("count") > F.lit(tokens / (4 * n))).collect()  # at most 4 * n words
    totals = {np.int64(r[0]).view(np.uint64): r[1] for r in loud}
    if END in totals:
        totals[START] = 0  # no token; a history as frequent as the end
    keys = np.array(sorted(totals), np.uint64)
    hot = spark.sparkContext.broadcast((keys, np.array([totals[k] for k in keys], np.int64)))

    table = materialize(bigram_table(picked, unigrams, hot, n), "uncompressed")
    rows = table.where(F.col("bucket") >= 0)
    of_counts = rows.select(*(F.sum(F.get("counts", F.lit(r))).alias(f"n{r}") for r in range(K + 2))).first()
    d = discounts([x or 0 for x in of_counts])
    hot_sums = spark.sparkContext.broadcast(_hot_sums(rows, keys, d))

    dealt = _by_number(_deal_histories(table, hot, n), n, "bucket")
    sums = _score_buckets(dealt, unigrams, d, hot, hot_sums)
    metas = table.where(F.col("bucket") == _META).select("chunk", "payload", F.lit(True).alias("meta"))

    def finish(t: pa.Table) -> pa.Table:
        score = base = known = meta = None
        for payload, is_meta in zip(t.column("payload").to_pylist(), t.column("meta").to_pylist(), strict=True):
            if is_meta:
                meta = pa.ipc.open_stream(payload).read_all()
                continue
            add = [x.astype(np.float64) for x in unpack(payload)]
            if score is None:
                score, base, known = add
            else:
                size = max(len(score), len(add[0]))
                score, base, known = (np.pad(x, (0, size - len(x))) + np.pad(y, (0, size - len(y))) for x, y in zip((score, base, known), add, strict=True))
        cols = [pa.array(known.astype(np.int64)), pa.array(np.full(len(known), tokens, np.int64)), pa.array(base), pa.array(score)]
        return pa.table([*meta.columns, *cols], [*meta.column_names, "n_known", "train_tokens", "base_score", "score"])

    every = sums.withColumn("meta", F.lit(False)).unionByName(metas)
    return every.groupBy("chunk").applyInArrow(finish, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _hot_sums(rows: DataFrame, keys: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Of each hot history: all its bigrams' counts, the discounted counts, and the lower-order mass of its seen words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0).to_pylist():
                if data:
                    at, flat = unpack(data)
                    table = flat.reshape(len(at), K + 3)
                    yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(np.ascontiguousarray(c)) for c in table.T)], ["at", *(f"c{i}" for i in range(K + 3))])

    parts = rows.select("hot").mapInArrow(run, "at long, " + ", ".join(f"c{i} double" for i in range(K + 3)))
    out = np.zeros((len(keys), 3))
    for r in parts.groupBy("at").agg(*(F.sum(f"c{i}") for i in range(K + 3))).collect():  # a row for each hot word
        c = np.array(r[1:])
        ranks = np.arange(1, K + 1)
        out[r[0]] = (ranks * c[1 : K + 1]).sum() + c[K + 1], (d[1 : K + 1] * ranks * c[1 : K + 1]).sum() + c[K + 1], c[K + 2]
    return out


def op1_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_scores(read_table(spark, sf_dir, "documents"), short_id(F.col("doc_id"), 10) == 0)
