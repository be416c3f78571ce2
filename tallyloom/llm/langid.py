"""Language identification with a string kernel.

The blended-spectrum presence kernel of two texts counts the n-grams of 1 to ``MAX_N`` characters that both
contain, divided by the root of the product of the numbers that each contains.  Texts are seen as lower-case
letters; everything else parts words.  N-grams are identified by a 16-bit hash.  ``landmarks`` sampled texts
give the Nyström features (kernel values times the inverse root of the landmarks' kernel matrix), on which
one-versus-rest kernel ridge regression is solved in closed form.  Documents are scored by batched matrix
products: presence matrix times landmark matrix, normalised, times the weights.

Only a bounded sample of labelled rows is fitted (``PER_CLASS`` rows of each language, all of a smaller one), of which
presence vectors of 8 KB come to the driver; the model, some 25 MB at most, is broadcast; nothing else leaves the
executors and no document is shuffled.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; equal scores go to the first
language in alphabetical order; repeated rows are scored alike; null ids pass through; an empty table gives an
empty result; without any labelled row every text is ``und``; extra columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tallyloom.llm.common import blocks, read_table, short_id
from tallyloom.llm.sample import per_class

MAX_N, BITS = 4, 16
#: Labelled rows of each language that are fitted, about; landmarks among all of them; ridge parameter.
PER_CLASS, LANDMARKS, RIDGE = 300, 96, 0.05
#: Fitted rows of all languages together; each comes to the driver as a presence vector of 2 ** BITS bits, however long its text is.
MAX_ROWS = 4000
#: Documents that one matrix product scores.
ROWS = 64
_MULT = np.uint64(0x9E3779B97F4A7C15)
_letters: np.ndarray | None = None


def _lower_letters() -> np.ndarray:
    """By code point: its lower-case letter, or 0 for what is no letter."""
    global _letters
    if _letters is None:
        table = np.zeros(sys.maxunicode + 1, np.uint32)
        for c in range(sys.maxunicode + 1):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _letters = table
    return _letters


def letter_codes(text: str) -> np.ndarray:
    """The text's lower-case letters with one 0 for each gap, and 0 at both ends."""
    codes = _lower_letters()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    padded = np.concatenate(([0], codes, [0])).astype(np.uint64)
    keep = np.ones(len(padded), bool)
    keep[1:] = (padded[1:] != 0) | (padded[:-1] != 0)
    return padded[keep]


def presence(text: str, out: np.ndarray) -> bool:
    """Sets ``out`` at the hashes of the n-grams that the text contains; False if it has no letter."""
    codes = letter_codes(text)
    if len(codes) < 3:
        return False
    h = np.zeros(len(codes), np.uint64)
    for n in range(1, MAX_N + 1):
        if len(codes) < n:
            break
        h = (h[: len(codes) - n + 1] + codes[n - 1 :] + np.uint64(n)) * _MULT
        h ^= h >> np.uint64(29)
        out[(h * _MULT) >> np.uint64(64 - BITS)] = 1
    return True


def packed_presence(text: str) -> bytes | None:
    """The text's presence vector, eight n-grams a byte; None if it has no letter."""
    x = np.zeros(1 << BITS, np.float32)
    return np.packbits(x > 0).tobytes() if presence(text, x) else None


class Model:
    """landmark presence (2**BITS, m), weights (m, languages), languages."""

    def __init__(self, texts: list[str], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE):
        self._fit([packed_presence(t) for t in texts], langs, landmarks, ridge)

    @classmethod
    def of_vectors(cls, vectors: list[bytes | None], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
        """The model of rows that are packed presence vectors."""
        out = cls.__new__(cls)
        out._fit(vectors, langs, landmarks, ridge)
        return out

    def _fit(self, vectors: list[bytes | None], langs: list[str], landmarks: int, ridge: float) -> None:
        rows = [i for i, v in enumerate(vectors) if v]
        packed, y = [vectors[i] for i in rows], np.array([langs[i] for i in rows], object)
        self.langs = sorted(set(y))
        if not self.langs:
            return
        pick = self._spread(y, landmarks)
        marks = self._unpacked([packed[i] for i in pick])
        self.marks = np.ascontiguousarray(marks.T)
        k = np.vstack([self._unpacked(packed[i : i + ROWS]) @ self.marks for i in range(0, len(packed), ROWS)]).astype(np.float64)
        values, vectors = np.linalg.eigh(k[pick])
        top = values > 1e-6 * values.max()
        root = vectors[:, top] / np.sqrt(values[top])
        z = np.hstack([k @ root, np.ones((len(k), 1))])
        onehot = np.array([[1.0 if a == b else -1.0 for b in self.langs] for a in y])
        share = {b: (y == b).mean() for b in self.langs}
        w = np.array([1 / share[a] / len(self.langs) for a in y])[:, None]
        beta = np.linalg.solve(z.T @ (w * z) + ridge * len(k) / 100 * np.eye(z.shape[1]), z.T @ (w * onehot))
        self.weights, self.bias = (root @ beta[:-1]).astype(np.float32), beta[-1].astype(np.float32)

    @staticmethod
    def _unpacked(packed: list[bytes]) -> np.ndarray:
        x = np.unpackbits(np.frombuffer(b"".join(packed), np.uint8)).reshape(len(packed), 1 << BITS).astype(np.float32)
        return x / np.sqrt(x.sum(1, keepdims=True))

    @classmethod
    def _normalised(cls, texts: list[str]) -> np.ndarray:
        return cls._unpacked([packed_presence(t) for t in texts])

    @staticmethod
    def _spread(y: np.ndarray, landmarks: int) -> list[int]:
        """Rows of all languages in turn."""
        by = [list(np.flatnonzero(y == b)) for b in sorted(set(y))]
        out: list[int] = []
        depth = 0
        while len(out) < min(landmarks, len(y)):
            out += [rows[depth] for rows in by if depth < len(rows)]
            depth += 1
        return out[:max(landmarks, len(by))]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        if not self.langs:
            return names, scores
        x = np.empty((ROWS, 1 << BITS), np.float32)
        for at in range(0, len(texts), ROWS):
            part = texts[at : at + ROWS]
            x[: len(part)] = 0
            good = [i for i, t in enumerate(part) if t and presence(t, x[i])]
            if not good:
                continue
            block = x[: len(part)]
            size = np.sqrt(np.maximum(block.sum(1, keepdims=True), 1))
            f = (block @ self.marks) / size @ self.weights + self.bias
            p = np.exp(4 * (f - f.max(1, keepdims=True)))
            p /= p.sum(1, keepdims=True)
            best = f.argmax(1)
            for i in good:
                names[at + i], scores[at + i] = self.langs[best[i]], float(p[i, best[i]])
        return names, scores


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_CLASS) -> Model:
    """Fits a model to a bounded sample of the rows with a language; the rows are chosen by the hash of their id."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([packed_presence(t) for t in b.column(0).to_pylist()], pa.binary())], ["lang", "vector"])

    sample = per_class(rows, "lang", F.col("id"), per_lang, MAX_ROWS).select("text", "lang").mapInArrow(run, f"lang {rows.schema['lang'].dataType.simpleString()}, vector binary")
    picked = sorted((r.lang, bytes(r.vector)) for r in sample.where("vector is not null").toLocalIterator())
    return Model.of_vectors([v for _, v in picked], [y for y, _ in picked])


def with_language(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All rows and columns with lang_pred and score (which replace columns of these names)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score")
    at = docs.columns.index(text_col)
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, column=text_col):
            names, scores = shared.value.predict(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*b.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score."""
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return with_language(picked, model).drop("text")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = train(docs.where(short_id(F.col("doc_id"), 5) != 0))
    return identify(docs, model).withColumn("held_out", short_id(F.col("doc_id"), 5) == 0)
