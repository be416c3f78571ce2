"""Token counts from pre-token frequencies.

A tokenizer's model works on each pre-token alone, so a document's token count is the sum over its distinct
pre-tokens of how often each occurs times how many pieces it has.  Three steps:

* Each block of documents (``BLOCK_BYTES`` of text, or one longer text) is pre-tokenised; the block becomes one row
  with its distinct pre-tokens, packed by the bucket of their hash, and each document's frequencies over them.
* All blocks' pre-tokens of a bucket meet in one task, where the model counts the pieces of each distinct one; no ids are kept.
* The piece counts go back to their blocks (never more than a block's text holds) and are summed over each
  document's frequencies.

A pre-token moves once for each block, not for each document, so a frequent one weighs no more than a rare one in a block; the buckets
grow with the shuffle partitions.  The pre-tokenisation is that of the vocabulary file: its special strings are cut out first, each a token
of its own.  For files with the plain word pattern below, texts without doubtful characters (``doubtful``) are split
by one expression instead of the library, with the same result; every other text goes through the library.

Defined cases: a null text counts as empty and has no tokens; rows are counted one by one, so repeated rows and
null ids pass through; an empty table gives an empty result; extra columns are ignored; a text of any length is one
block.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyloom.llm.bpe import byte_symbols, vocabulary_path
from tallyloom.llm.common import blocks, discard, materialize, partitions, read_table, text_or_empty
from tallyloom.llm.packing import pack, small, unpack

#: Text of one block of documents.
BLOCK_BYTES = 32 << 20
#: Documents with more tokens than this are over the limit.
TOKEN_LIMIT = 2048
#: Code points that are looked at; texts with others go through the library.
KNOWN = 0x20000
#: The word pattern that is split without the library, after lower-casing (fixed value).
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""
#: The normaliser that goes with it (fixed value).
LOWER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]


class PreTokenizer:
    """Pre-tokens as a vocabulary file's model sees them."""

    def __init__(self, spec: str, odd: str | None = None):
        data, library = json.loads(spec), Tokenizer.from_str(spec)
        self._normalise = library.normalizer.normalize_str if library.normalizer else str
        self._split = library.pre_tokenizer.pre_tokenize_str if library.pre_tokenizer else lambda t: [(t, (0, len(t)))]
        special = sorted((t["content"] for t in data["added_tokens"]), key=len, reverse=True)
        self._specials = regex.compile("|".join(map(regex.escape, special))) if special else None
        steps = (data.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        split, last = steps[0], steps[-1]
        self.plain = (data.get("normalizer") or {}).get("normalizers") == LOWER and len(steps) == 2 and split.get("pattern") == {"Regex": WORDS} and split.get("invert") and split.get("behavior") == "Removed" and last.get("type") == "ByteLevel" and not last["add_prefix_space"] and not last["use_regex"]
        self._words = regex.compile(WORDS).findall
        self._symbol = {b: c for c, b in byte_symbols().items()}
        self.odd = odd if odd is not None else self.doubtful() if self.plain else ""
        self._odd = frozenset(self.odd)
        self._beyond = re.compile(f"[^\\x00-\\U{ord(min(self.odd, default=chr(KNOWN))) - 1:08x}]").search

    def by_library(self, text: str) -> list[str]:
        return [p for p, _ in self._split(self._normalise(text)) if p]

    def by_words(self, text: str) -> list[str]:
        return self._words(text.lower())

    def symbols(self, word: str) -> str:
        """A word in the byte-level alphabet of the model."""
        return "".join(map(self._symbol.__getitem__, word.encode("utf-8")))

    def doubtful(self) -> str:
        """Known characters that the library and the word pattern treat differently, and those no table assigns."""
        odd, doubt = [], [[chr(c) for c in range(at, at + 512) if not 0xD800 <= c < 0xE000] for at in range(0, KNOWN, 512)]
        while doubt:
            part = doubt.pop()
            probe = "\n".join(f"a{c}1{c}!{c} {c}{c}x" for c in part)
            if part and [self.symbols(w) for w in self.by_words(probe)] != self.by_library(probe):
                if len(part) == 1:
                    odd += part
                else:
                    doubt += [part[: len(part) // 2], part[len(part) // 2 :]]
        return "".join(sorted({*odd, *(chr(c) for c in range(KNOWN) if unicodedata.category(chr(c)) in ("Cn", "Cs"))}))

    def _count(self, text: str) -> tuple[Counter, bool]:
        if self.plain and (text.isascii() or not self._beyond(text) or (self._odd.isdisjoint(text) and ord(max(text)) < KNOWN and unicodedata.is_normalized("NFC", text))):
            return Counter(self.by_words(text)), True
        return Counter(self.by_library(text)), False

    def counts(self, text: str) -> tuple[list[tuple[Counter, bool]], int]:
        """Pre-token counts of the parts between special strings (True: words still to be spelt in symbols), and how many special strings there are."""
        if not self._specials or not self._specials.search(text):
            return [self._count(text)], 0
        parts = self._specials.split(text)
        return [self._count(p) for p in parts if p], len(parts) - 1


_LOADED: dict[int, tuple] = {}


def _loaded(shared, kind):
    """The worker's object, built once for each broadcast."""
    key = (hash(shared.value[0]), kind)
    if _LOADED.get("key") != key:
        _LOADED.update(key=key, value=PreTokenizer(*shared.value) if kind == "split" else Tokenizer.from_str(shared.value[0]).model)
    return _LOADED["value"]


def share_tokenizer(spark: SparkSession, path: str):
    """Reads a vocabulary file on the driver and broadcasts it; its size is that of the file."""
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    return spark.sparkContext.broadcast((spec, PreTokenizer(spec).odd))


class Block:
    """Pre-token frequencies of documents that are read one by one."""

    def __init__(self, split: PreTokenizer):
        self.split, self.places, self._at, self.text = split, {}, {}, 0  # places: pre-token to number, in the order of their first use
        self.ids: list[pa.Array] = []
        self.special, self.sizes, self.n_bytes = array("q"), array("q"), array("q")
        self.where: list[np.ndarray] = []
        self.often: list[np.ndarray] = []

    def add(self, text: str) -> None:
        parts, special = self.split.counts(text)
        places, at, where, often = self.places, self._at, [], []
        for count, words in parts:
            if words:
                for w in count:
                    if w not in at:
                        at[w] = places.setdefault(self.split.symbols(w), len(places))
                where += map(at.__getitem__, count)
            else:
                where += [places.setdefault(p, len(places)) for p in count]
            often += count.values()
        places_of, times = np.array(where, np.int64), np.array(often, np.int64)
        order = np.argsort(places_of)
        self.where.append(np.diff(places_of[order], prepend=0))
        self.often.append(times[order])
        self.special.append(special)
        self.sizes.append(len(where))
        self.n_bytes.append(len(text) if text.isascii() else len(text.encode("utf-8")))
        self.text += len(text)

    def rows(self, number: int, buckets: int) -> pa.RecordBatch:
        """The block as one row; its pre-tokens packed by the bucket of their hash."""
        words = list(self.places)
        bucket = np.array([crc32(w.encode("utf-8")) % buckets for w in words], np.int64)
        order, names = np.argsort(bucket, kind="stable"), []
        starts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        for group in np.split(order, starts[1:]) if len(order) else []:
            own = [words[i] for i in group]
            names.append({"bucket": int(bucket[group[0]]), "words": pack(small(np.array(list(map(len, own)), np.int64)), np.frombuffer("".join(own).encode("utf-8"), np.uint8))})
        numbers = (self.special, self.sizes, np.concatenate(self.where), np.concatenate(self.often), bucket)
        ids = pa.chunked_array(self.ids).combine_chunks()
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([self.n_bytes], pa.list_(pa.int64())), pa.array([names], pa.list_(pa.struct([("bucket", pa.int32()), ("words", pa.binary())]))), pa.array([pack(*(small(np.asarray(x, np.int64)) for x in numbers))], pa.binary())],
            ["block", "doc_ids", "n_bytes", "pretokens", "packed"],
        )


def pretoken_frequencies(docs: DataFrame, tokenizer, buckets: int, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row a block: block, doc_ids, n_bytes, pretokens (distinct, packed by bucket) and packed frequencies by document."""
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, number = _loaded(tokenizer, "split"), TaskContext.get().partitionId() << 32
        block = Block(split)
        for b in blocks(batches, block_bytes):
            block.ids.append(b.column(0))
            for t in b.column(1).to_pylist():
                block.add(t)
            if block.text >= block_bytes:
                yield block.rows(number, buckets)
                block, number = Block(split), number + 1
        if block.ids:
            yield block.rows(number, buckets)

    picked = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return picked.mapInArrow(run, f"block long, doc_ids array<{kind.simpleString()}>, n_bytes array<long>, pretokens array<struct<bucket: int, words: binary>>, packed binary")


def piece_counts(words: DataFrame, tokenizer, buckets: int) -> DataFrame:
    """block, bucket and the packed piece counts of its pre-tokens, from rows of block, bucket and packed pre-tokens.

    All rows of a bucket meet, so the model sees each distinct pre-token once; a bucket's are forgotten at its end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenize, last, known = _loaded(tokenizer, "model").tokenize, None, {}
        for b in batches:
            out = []
            for bucket, blob in zip(b.column("bucket").to_pylist(), b.column("words"), strict=True):
                if bucket != last:
                    last, known = bucket, {}
                sizes, letters = unpack(blob.as_py())
                text, ends, pieces = letters.tobytes().decode("utf-8"), np.cumsum(sizes.astype(np.int64)).tolist(), []
                for i, j in zip([0, *ends], ends, strict=False):
                    n = known.get(w := text[i:j])
                    if n is None:
                        n = known[w] = len(tokenize(w))
                    pieces.append(n)
                out.append(pack(small(np.array(pieces, np.int64))))
            yield pa.RecordBatch.from_arrays([b.column("block"), b.column("bucket"), pa.array(out, pa.binary())], ["block", "bucket", "pieces"])

    dealt = words.select("block", "bucket", "words").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "block long, bucket int, pieces binary")


def token_counts(docs: DataFrame, tokenizer, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens."""
    kind, buckets = docs.schema[id_col].dataType.simpleString(), 2 * partitions(docs.sparkSession)
    freq = materialize(pretoken_frequencies(docs, tokenizer, buckets, id_col, text_col, block_bytes), codec="uncompressed")
    words = freq.select("block", F.explode("pretokens").alias("p")).select("block", "p.bucket", "p.words")
    of_block = piece_counts(words, tokenizer, buckets).groupBy("block").agg(F.array_sort(F.collect_list(F.struct("bucket", "pieces"))).getField("pieces").alias("pieces"))
    joined = freq.select("block", "doc_ids", "n_bytes", "packed").join(of_block, "block", "left").select("doc_ids", "n_bytes", "packed", F.coalesce("pieces", F.array().cast("array<binary>")).alias("pieces"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, n_bytes, packed, blobs in zip(*batch.columns, strict=True):
                special, sizes, where, often, bucket = (a.astype(np.int64) for a in unpack(packed.as_py()))
                pieces = np.zeros(len(bucket), np.int64)
                pieces[np.argsort(bucket, kind="stable")] = np.concatenate([np.zeros(0, np.int64), *(unpack(x)[0] for x in blobs.as_py())])
                ends = np.cumsum(sizes)
                starts = ends - sizes
                run_up = np.cumsum(where)
                places = run_up - np.repeat(np.concatenate([[0], run_up])[starts], sizes)
                sums = np.concatenate([[0], np.cumsum(pieces[places] * often)])
                yield pa.RecordBatch.from_arrays([ids.values, n_bytes.values, pa.array(sums[ends] - sums[starts] + special)], ["doc_id", "n_bytes", "n_tokens"])

    out = materialize(joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long"))
    discard(freq)
    return out


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts(read_table(spark, sf_dir, "documents"), share_tokenizer(spark, vocabulary_path("word_bpe_49k.json")))
    return counted.select("*", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))
