"""Text columns: cleaning, tokens, sentences, speech and question/answer pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.constants import STOPWORDS

#: White space that trimming takes off.
SPACES = " \t\n\x0b\f\r"
#: What the cleaner keeps besides white space, as a character class.
HANGUL, ASCII = "가-힣0-9", "a-z0-9"


def clean(text: Column, keep: str = HANGUL) -> Column:
    """Other characters become spaces, which are collapsed and trimmed; ``ASCII`` lower-cases first."""
    if keep == ASCII:
        text = F.lower(text)
    return F.trim(F.regexp_replace(F.regexp_replace(text, rf"[^{keep}\s]", " "), r"\s+", " "))


def tokens(cleaned: Column, stopwords: list[str] | None = None) -> Column:
    """White-space tokens of more than one character that are no stop words, repeats kept."""
    stop = STOPWORDS if stopwords is None else stopwords
    keep = (lambda t: (F.length(t) > 1) & ~t.isin(stop)) if stop else (lambda t: F.length(t) > 1)
    return F.filter(F.split(cleaned, " "), keep)


def ascii_words(text: Column) -> Column:
    """``tokens(clean(text, ASCII), [])`` in one pass: the runs of two letters or digits or more of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"[{ASCII}]{{2,}}"), F.lit(0))


def trimmed(c: Column) -> Column:
    return F.trim(c, F.lit(SPACES))


def sentences(text: Column) -> Column:
    """Parts between sentence ends and double spaces, trimmed, without empty ones."""
    parts = F.flatten(F.transform(F.split(text, r"[.?!。]\s*"), lambda s: F.split(s, "  ")))
    return F.filter(F.transform(parts, trimmed), lambda s: s != "")


def speech(items: Column) -> Column:
    """The child's non-blank answers of a record's ``list`` column, trimmed, in document order."""
    segments = F.flatten(F.transform(items, lambda q: F.flatten(F.transform(q["list"], lambda i: i["audio"]))))
    said = F.filter(segments, lambda s: (s["type"] == "A") & (trimmed(s["text"]) != ""))
    return F.transform(said, lambda s: trimmed(s["text"]))


def qa_pairs(turns: DataFrame, group: list[str], order: str, kind: str, text: str, question: str = "Q", answer: str = "A", none: str = "(질문 없음)") -> DataFrame:
    """Each answer with the last question since the previous answer in its group."""
    w = Window.partitionBy(*group).orderBy(order)
    block = F.sum(F.when(F.col(kind) == answer, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = turns.withColumn("_block", F.coalesce(block, F.lit(0)))
    inner = Window.partitionBy(*group, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    asked = F.last(F.when(F.col(kind) == question, F.col(text)), ignorenulls=True).over(inner)
    return marked.withColumn("question", F.coalesce(asked, F.lit(none))).where(F.col(kind) == answer).withColumnRenamed(text, "answer").drop("_block")


#: Negating adverbs, the negating auxiliary, its mark, and the parts of speech that are kept (fixed values).
NEGATORS, NEGATING, NEGATED = ["안", "못"], "않다", "안_"
VERBAL, KEPT = ["Verb", "Adjective"], ["Noun", "Verb", "Adjective"]
#: Tagged words folded at a time, so that a long text doesn't copy its whole result with each word.
PIECE = 512


def tagged_tokens(words: Column, stop: list[str]) -> Column:
    """Tokens of an array of (lemma, tag): nouns, verbs and adjectives of two letters or more that are no stop words.

    A negating adverb before a verb or adjective takes it up (``안_x``; nothing if x itself wouldn't be kept); the negating auxiliary
    marks the token before it, once.  Null or empty arrays give an empty one; a null lemma or tag is kept by no rule.
    """
    n = F.coalesce(F.size(words), F.lit(0))
    yes = lambda c: F.coalesce(c, F.lit(False))

    def step(s: Column, x: Column) -> Column:
        lemma = x["lemma"]
        fits = yes((F.length(lemma) > 1) & ~lemma.isin(stop))
        taken = s["open"].isNotNull()
        opens = ~taken & yes(lemma.isin(NEGATORS)) & yes(x["next"].isin(VERBAL))
        marks = ~taken & ~opens & yes(lemma == NEGATING)
        new = F.when(taken & fits, F.concat(s["open"], F.lit("_"), lemma)).when(~taken & ~opens & ~marks & yes(x["tag"].isin(KEPT)) & fits, lemma)
        last = F.when(new.isNotNull(), new).when(marks & ~yes(s["last"].startswith(NEGATED)), F.concat(F.lit(NEGATED), s["last"])).otherwise(s["last"])
        done = F.when(new.isNotNull() & s["last"].isNotNull(), F.concat(s["done"], F.array(s["last"]))).otherwise(s["done"])
        return F.struct(done.alias("done"), last.alias("last"), F.when(opens, lemma).alias("open"))

    none, empty = F.lit(None).cast("string"), F.array(F.lit(None).cast("string"))
    start = lambda s: F.struct(F.slice(empty, 1, 0).alias("done"), s["last"].alias("last"), s["open"].alias("open"))
    ahead = F.transform(words, lambda w, i: F.struct(w["lemma"].alias("lemma"), w["tag"].alias("tag"), F.get(words, i + 1)["tag"].alias("next")))

    def piece(s: Column, low: Column) -> Column:
        one = F.aggregate(F.slice(ahead, low, PIECE), start(s), step)
        return F.transform(F.array(one), lambda o: F.struct(F.concat(s["parts"], F.array(o["done"])).alias("parts"), o["last"].alias("last"), o["open"].alias("open")))[0]

    zero = F.struct(F.slice(F.array(empty), 1, 0).alias("parts"), none.alias("last"), none.alias("open"))
    lows = F.when(n > 0, F.sequence(F.lit(1), n, F.lit(PIECE))).otherwise(F.array().cast("array<int>"))
    whole = F.aggregate(lows, zero, piece, lambda s: F.concat(F.flatten(s["parts"]), F.filter(F.array(s["last"]), lambda t: t.isNotNull())))
    return F.when(n > 0, whole).otherwise(F.array().cast("array<string>"))
