"""Byte-level BPE encoding and decoding with forced-boundary splitting.

A pair of neighbouring bytes that occurs inside no vocabulary token can never lie inside a token of any
encoding, so the text is certainly cut there.  The bytes between two such cuts are merged independently and
their ids concatenated.  The cuts come after the vocabulary file's own pre-tokenisation, within its pieces.

The vocabulary (a fixed file, some 2 MB) is read once by the driver and broadcast; each Arrow batch is encoded
on its own, nothing is shuffled, and a worker's cache of encoded pieces is bounded (``CACHE_PIECES``; when full
it starts again, which changes no result).

Defined cases: a null text counts as empty and has no ids; special tokens in the text become their own ids;
rows are independent, so repeated rows and null ids pass through; extra columns are dropped; a very long text
without white space is cut at its forced boundaries and else merged with a heap.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyloom.llm.common import blocks, read_table, text_or_empty

#: Pieces that a Python worker keeps with their ids.
CACHE_PIECES = 200_000
#: The pre-tokenisation of byte-level BPE vocabularies (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def inner_pairs(tokens: list[bytes]) -> bytearray:
    """A 65536-long table: 1 where a pair of bytes (first * 256 + second) occurs inside some token."""
    table = bytearray(65536)
    for t in tokens:
        for a, b in zip(t, t[1:], strict=False):
            table[a * 256 + b] = 1
    return table


def class_differences(spec: str) -> str:
    """Characters that the tokenizers library and the ``regex`` module put into different classes, as one string.

    Both follow Unicode, but not the same version of it.  Texts with such a character are pre-tokenised by the
    library itself.  Runs of code points that ``regex`` puts into one class are probed as one piece; only those of
    which the library makes several are probed one by one.
    """
    pre = Tokenizer.from_str(spec).pre_tokenizer
    every = "".join(chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Co")
    kinds = [(regex.compile(p), lead) for p, lead in ((r"\p{L}+", "a"), (r"\p{N}+", "1"), (r"[^\s\p{L}\p{N}]+", "!"))]
    runs = [(m[0], lead) for p, lead in kinds for m in p.finditer(every)]
    doubtful = list("".join(regex.findall(r"\s", every)))
    for at in range(0, len(runs), 2000):
        probe, ends = "", []
        for run, lead in runs[at : at + 2000]:
            ends.append((len(probe), len(probe) + 1 + len(run)))
            probe += lead + run + "\n"
        pieces = {span for _, span in pre.pre_tokenize_str(probe)}
        for (run, _), span in zip(runs[at : at + 2000], ends, strict=True):
            if span not in pieces:
                doubtful += run
    odd = []
    for at in range(0, len(doubtful), 50_000):
        part = doubtful[at : at + 50_000]
        ends = {j for _, (_, j) in pre.pre_tokenize_str("".join(f"a{c}1{c}! " for c in part))}
        for i, c in enumerate(part):
            k = 6 * i  # a joined to it: letter; it joined to 1: number; it joined to !: neither these nor space
            theirs = (k + 1 not in ends, k + 2 not in ends, k + 4 in ends and k + 1 in ends and k + 2 in ends)
            if theirs != tuple(bool(regex.match(p, c)) for p in (r"\p{L}", r"\p{N}", r"\s")):
                odd.append(c)
    return "".join(sorted(odd))


class ByteBpe:
    """Encoder and decoder of a byte-level BPE vocabulary in the tokenizers library's JSON form."""

    def __init__(self, spec: str, odd: str | None = None):
        data = json.loads(spec)
        model, symbols = data["model"], byte_symbols()
        as_bytes = lambda t: bytes(symbols[c] for c in t)
        vocab = {as_bytes(t): i for t, i in model["vocab"].items()}
        ranks = {bytes([b]): b for b in range(256)}
        for n, merge in enumerate(model["merges"]):
            ranks[as_bytes("".join(merge) if isinstance(merge, list) else merge.replace(" ", ""))] = 256 + n
        self.spec, self.odd = spec, class_differences(spec) if odd is None else odd
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.token_bytes = {i: t for t, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        self.inside = inner_pairs(list(vocab))
        self._merge = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self._by_rank = {r: vocab[t] for t, r in ranks.items() if t in vocab}
        self._pieces = regex.compile(PATTERN).findall
        self._odd = frozenset(self.odd)
        self._beyond = regex.compile(f"[^\\x00-\\U{ord(min(self.odd)) - 1:08x}]").search if self.odd else lambda text: None
        self._split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self._cache: dict[str, tuple[int, ...]] = {}
        self._library = None

    def fragments(self, piece: bytes) -> list[bytes]:
        """The parts of a piece between forced boundaries."""
        inside, out, start = self.inside, [], 0
        for i in range(1, len(piece)):
            if not inside[piece[i - 1] * 256 + piece[i]]:
                out.append(piece[start:i])
                start = i
        out.append(piece[start:])
        return out

    def _piece(self, piece: str) -> tuple[int, ...]:
        by_rank = self._by_rank
        return tuple(by_rank[r] for part in self.fragments(piece.encode("utf-8")) for r in self._merge(part))

    def pretokenize(self, text: str) -> list[str]:
        if not text.isascii() and self._beyond(text) and not self._odd.isdisjoint(text):
            if self._library is None:
                self._library = Tokenizer.from_str(self.spec).pre_tokenizer
            return [text[i:j] for _, (i, j) in self._library.pre_tokenize_str(text)]
        return self._pieces(text)

    def _plain(self, text: str) -> list[int]:
        pieces, cache = self.pretokenize(text), self._cache
        for p in set(pieces).difference(cache):
            if len(p) <= 64:
                if len(cache) >= CACHE_PIECES:
                    break
                cache[p] = self._piece(p)
        try:
            return list(chain.from_iterable(map(cache.__getitem__, pieces)))
        except KeyError:
            pass
        own = {p: cache.get(p) or self._piece(p) for p in set(pieces)}
        if len(cache) >= CACHE_PIECES:
            cache.clear()
        return list(chain.from_iterable(map(own.__getitem__, pieces)))

    def encode(self, text: str) -> list[int]:
        if not self._split or not any(s in text for s in self.special):
            return self._plain(text)
        out: list[int] = []
        for part in self._split(text):
            out += [self.special[part]] if part in self.special else self._plain(part)
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


_LOADED: dict[int, ByteBpe] = {}


def _codec(shared) -> ByteBpe:
    """The worker's codec, built once for each broadcast."""
    spec, odd = shared.value
    key = hash(spec)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = ByteBpe(spec, odd)
    return _LOADED[key]


def share_vocabulary(spark: SparkSession, path: str):
    """Reads a vocabulary file on the driver and broadcasts it; its size is that of the file."""
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    return spark.sparkContext.broadcast((spec, class_differences(spec)))


def bpe_encode(docs: DataFrame, vocabulary, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """doc_id, ids array<int>, and with ``decode`` also the text that the ids decode to."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary)
        for b in blocks(batches):
            ids = [codec.encode(t) for t in b.column(1).to_pylist()]
            sizes = [0]
            for x in ids:
                sizes.append(sizes[-1] + len(x))
            flat = pa.array(list(chain.from_iterable(ids)), pa.int32())
            cols, names = [b.column(0), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), flat)], ["doc_id", "ids"]
            if decode:
                cols.append(pa.array([codec.decode(x) for x in ids], pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(cols, names)

    picked = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return picked.mapInArrow(run, f"doc_id {kind}, ids array<int>" + ", decoded string" * decode)


def bpe_decode(encoded: DataFrame, vocabulary, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the text that the ids stand for; null ids count as none."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary)
        for b in batches:
            texts = [codec.decode(x or []) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "decoded"])

    return encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"doc_id {kind}, decoded string")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe_encode(read_table(spark, sf_dir, "documents"), share_vocabulary(spark, vocabulary_path()), decode=True)
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
