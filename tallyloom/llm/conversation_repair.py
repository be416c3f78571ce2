"""Conversation structure repair by a forward Viterbi pass over a four-state grammar.

A conversation is sound if its roles' initials read ``(s?(ua)+)?``.  The states are: nothing read, system read, user
read, assistant read; the first and the last may end.  Turns in order are kept (0), given the role that the state
asks for (2) or deleted (3, and nothing else for blank turns and for those whose role and text stood earlier);
empty turns may be inserted (2) after each turn's layer, at most two in a row, for more never pay.  A truncated turn
that isn't deleted costs 1 more.  Each state carries its least (cost, audit string); of equal costs the smaller
string stays.  Two strings of equal cost in one layer and state have used the same turns, so neither is the start of
the other, and the choice holds for everything that follows.

Conversations of any length: the turns are put in order by one range exchange on (conv_id, turn, role, digest of the
text, row number) and cut into segments of ``SEGMENT`` turns.  A segment gives its least (cost, audit) from every state to
every state; segments of a conversation are then combined pairwise, which is the same minimum, and the edits go
back to the turns by their place.  No task holds a conversation's texts; what is gathered for one conversation
is as long as its audit string.  Whether a text stood earlier is decided by a count with map-side combining.

Defined cases: a null role or text is one space; null turns come first, a null conv_id is a conversation of its own; turns
with the same number are ordered by role, then by the SHA-256 of their text; repeated rows are duplicates of each
other; a role whose initial is none of s, u, a can't be kept; an empty table gives empty results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import WS_CHARS, materialize, partitions, read_table

#: Turns that are read by one step of the recursion; 2 ** SEGMENT_BITS.
SEGMENT_BITS = 12
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
#: What a role's initial does to a state, and the role that each state takes when one is given or inserted.
READ = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
TAKES = {START: ("u", USER), SYSTEM: ("u", USER), USER: ("a", ASSISTANT), ASSISTANT: ("u", USER)}
ENDS = (START, ASSISTANT)
#: Codes of a turn: its initial, capital if truncated, a digit if it must go.
CODES = "suao", "SUAO", "1230"

Layer = list[tuple[int, str] | None]


def _better(layer: Layer, state: int, cost: int, audit: str) -> None:
    if layer[state] is None or (cost, audit) < layer[state]:
        layer[state] = (cost, audit)


def _closed(layer: Layer) -> Layer:
    """The layer with up to two insertions."""
    for _ in range(2):
        for state, best in enumerate(list(layer)):
            if best:
                _better(layer, TAKES[state][1], best[0] + INSERT, best[1] + "I")
    return layer


def _read(layer: Layer, code: str) -> Layer:
    """The layer after one more turn."""
    out: Layer = [None] * 4
    doomed, truncated = code.isdigit(), TRUNCATED * code.isupper()
    for state, best in enumerate(layer):
        if best:
            cost, audit = best
            _better(out, state, cost + DELETE, audit + "D")
            if not doomed:
                to = READ.get(code.lower(), {}).get(state)
                if to is not None:
                    _better(out, to, cost + KEEP + truncated, audit + "K")
                _better(out, TAKES[state][1], cost + REROLE + truncated, audit + "R")
    return _closed(out)


@lru_cache(maxsize=20_000)
def _short(codes: str) -> tuple[Layer, ...]:
    rows = []
    for start in range(4):
        layer: Layer = [None] * 4
        layer[start] = (0, "")
        layer = _closed(layer)
        for code in codes:
            layer = _read(layer, code)
        rows.append(layer)
    return tuple(rows)


def segment(codes: str) -> tuple[Layer, ...]:
    """The least (cost, audit) from every state to every state over the turns of ``codes``."""
    return _short(codes) if len(codes) <= 32 else _short.__wrapped__(codes)


def combined(a: tuple[Layer, ...], b: tuple[Layer, ...]) -> tuple[Layer, ...]:
    """The least (cost, audit) over the turns of ``a``, then of ``b``."""
    out = []
    for row in a:
        layer: Layer = [None] * 4
        for middle, first in enumerate(row):
            for state, second in enumerate(b[middle]):
                if first and second:
                    _better(layer, state, first[0] + second[0], first[1] + second[1])
        out.append(layer)
    return tuple(out)


def solve(segments: list[tuple[Layer, ...]]) -> tuple[int, str]:
    """Cost and audit of the cheapest repair."""
    while len(segments) > 1:
        segments = [combined(*segments[i : i + 2]) if i + 1 < len(segments) else segments[i] for i in range(0, len(segments), 2)]
    return min(segments[0][START][state] for state in ENDS if segments[0][START][state])


def plans(audit: str, codes: str) -> list[str]:
    """What to write for each turn: inserted roles before it (u, a), then K, U or A (given that role) or D, and after the last turn what is still inserted."""
    state, out, before, turns = START, [], "", iter(codes)
    for edit in audit:
        if edit == "I":
            role, state = TAKES[state]
            before += role
            continue
        code, act = next(turns), edit
        if edit == "K":
            state = READ[code.lower()][state]
        elif edit == "R":
            role, state = TAKES[state]
            act = role.upper()
        out.append(before + act)
        before = ""
    if before:
        out[-1] += before
    return out


def illegal_pairs(codes: str) -> int:
    """Neighbouring turns, of all, whose initials are not su, ua or au."""
    plain = codes.translate(str.maketrans("".join(CODES[1:]), CODES[0] * 2))
    return sum(pair not in ("su", "ua", "au") for pair in map("".join, zip(plain, plain[1:], strict=False)))


def ordered_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A written table of the turns with their faults and ``at``, a number that grows in the order of conversations and turns."""
    spark = rows.sparkSession
    t = rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"))
    bare = F.rtrim(F.col("text"), F.lit(WS_CHARS))
    first = F.substring("role", 1, 1)
    t = t.select(
        "*",
        F.sha2(F.col("text").cast("binary"), 256).alias("digest"),
        F.when(first.isin("s", "u", "a"), first).otherwise("o").alias("initial"),
        (bare == "").alias("blank"),
        (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("truncated"),
        F.monotonically_increasing_id().alias("_row"),
    )
    key = ["conv_id", "turn", "role", "digest", "_row"]  # repeated rows may be ordered either way
    ordered = t.repartitionByRange(partitions(spark), *key).sortWithinPartitions(*key)
    return materialize(ordered.drop("_row").withColumn("at", F.monotonically_increasing_id()))


def repair_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``ordered_turns``: (verdicts, repaired turns).

    Verdicts: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.  Repaired turns: conv_id, at and nth (their
    order), edit (K, R or I), role, text.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    marks = turns.select("conv_id", "role", "digest", "at", "initial", "blank", "truncated")
    again = marks.groupBy("conv_id", "role", "digest").agg(F.min("at").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d"), "_first")
    j = marks.join(again, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("digest") == F.col("_d")), "left")
    duplicate = ~F.col("blank") & F.coalesce(F.col("at") > F.col("_first"), F.lit(False))
    cut = ~F.col("blank") & ~duplicate & F.col("truncated")
    code = F.when(F.col("blank") | duplicate, F.translate("initial", CODES[0], CODES[2])).when(cut, F.upper("initial")).otherwise(F.col("initial"))
    coded = j.select("conv_id", "at", F.shiftright("at", SEGMENT_BITS).alias("part"), code.alias("code"), *(F.when(c, 1).otherwise(0).cast("long").alias(n) for n, c in (("blank", F.col("blank")), ("duplicate", duplicate), ("truncated", cut))))
    faults = ["blank", "duplicate", "truncated"]
    in_order = F.array_sort(F.collect_list(F.struct("at", "code")))
    parts = coded.groupBy("conv_id", "part").agg(F.min("at").alias("at"), F.array_join(in_order.getField("code"), "").alias("codes"), *(F.sum(c).alias(c) for c in faults))

    def layers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[x for row in segment(c) for x in row] for c in b.column("codes").to_pylist()]
            costs, audits = ([[x and x[i] for x in f] for f in found] for i in range(2))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(costs, pa.list_(pa.int64())), pa.array(audits, pa.list_(pa.string()))], [*b.schema.names, "costs", "audits"])

    solved = parts.mapInArrow(layers, f"conv_id {kind}, part long, at long, codes string, blank long, duplicate long, truncated long, costs array<long>, audits array<string>")
    whole = solved.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "codes", "costs", "audits"))).alias("parts"), *(F.sum(c).alias(c) for c in faults))

    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for parts in b.column("parts").to_pylist():
                tables = [tuple([None if c is None else (c, a) for c, a in zip(p["costs"][i : i + 4], p["audits"][i : i + 4], strict=True)] for i in range(0, 16, 4)) for p in parts]
                codes = "".join(p["codes"] for p in parts)
                cost, audit = solve(tables)
                todo, done, pieces = plans(audit, codes), 0, []
                for p in parts:
                    pieces.append({"at": p["at"], "todo": todo[done : done + len(p["codes"])]})
                    done += len(p["codes"])
                out.append((illegal_pairs(codes), cost, audit, pieces))
            cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("at", pa.int64()), ("todo", pa.list_(pa.string()))]))), strict=True)] if out else []
            if out:
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("conv_id", *faults)), *cols], ["conv_id", *faults, "illegal", "cost", "audit", "pieces"])

    found = materialize(whole.select("conv_id", *faults, "parts").mapInArrow(repaired, f"conv_id {kind}, blank long, duplicate long, truncated long, illegal long, cost long, audit string, pieces array<struct<at: long, todo: array<string>>>"))
    gaps = turns.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps")).withColumnRenamed("conv_id", "_c")
    verdicts = found.drop("pieces").join(gaps, F.col("conv_id").eqNullSafe(F.col("_c"))).select("conv_id", "gaps", *faults, "illegal", "cost", "audit")
    todo = found.select(F.explode("pieces").alias("p")).select(F.col("p.at").alias("_at"), F.posexplode("p.todo").alias("_pos", "_todo")).select((F.col("_at") + F.col("_pos")).alias("at"), "_todo")
    acts = turns.select("conv_id", "at", "role", "text").join(todo, "at").select("*", F.posexplode(F.split("_todo", "")).alias("nth", "act"))
    given = F.when(F.lower("act") == "u", "user").when(F.lower("act") == "a", "assistant").otherwise(F.col("role"))
    edit = F.when(F.col("act") == "K", "K").when(F.col("act").isin("U", "A"), "R").otherwise("I")
    kept = acts.where("act <> 'D' AND act <> ''")
    return verdicts, kept.select("conv_id", "at", "nth", edit.alias("edit"), given.alias("role"), F.when(edit == "I", "").otherwise(F.col("text")).alias("text"))


def running_sha256(rows: DataFrame, key: str, order: list[str], line: Column) -> DataFrame:
    """key and the SHA-256 of each key's lines, joined by newlines.

    A key's rows are streamed in order, so memory doesn't grow with them; such a digest is sequential by definition.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest, lines = None, None, False
        for b in batches:
            keys, done = b.column(0).to_pylist(), ([], [])
            for k, text in zip(keys, b.column(1), strict=True):
                if not lines or k != last:
                    if lines:
                        done[0].append(last)
                        done[1].append(digest.hexdigest())
                    last, digest, lines = k, hashlib.sha256(text.as_buffer()), True
                else:
                    digest.update(b"\n")
                    digest.update(text.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array(done[0], b.schema.field(0).type), pa.array(done[1], pa.string())], ["key", "digest"])
        if lines:
            yield pa.RecordBatch.from_arrays([pa.array([last], b.schema.field(0).type), pa.array([digest.hexdigest()])], ["key", "digest"])

    picked = rows.select(F.col(key).alias("key"), *order, line.alias("line"))
    streamed = picked.repartition(partitions(rows.sparkSession), "key").sortWithinPartitions("key", *order).select("key", "line")
    return streamed.mapInArrow(run, f"key {kind}, digest string")


def damaged(rows: DataFrame) -> DataFrame:
    """The conversations with the faults that the query plants, chosen by the CRC-32 of conversation and turn (nulls: one space)."""
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    fault = F.crc32(name.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    hit = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), fault.alias("fault")).where("fault <> 0")
    hit = hit.withColumns({
        "text": F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")),
        "role": F.when(F.col("fault") == 4, "user").otherwise(F.col("role")),
    })
    return hit.select("conv_id", "turn", "role", "text", F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations")
    turns = ordered_turns(damaged(rows))
    verdicts, repaired = repair_conversations(turns)
    digests = running_sha256(repaired, "conv_id", ["at", "nth"], F.concat("role", F.lit(":"), "text").cast("binary"))
    empty = hashlib.sha256(b"").hexdigest()
    all_ids = rows.select("conv_id").distinct()
    v, s = verdicts.withColumnRenamed("conv_id", "_v"), digests.withColumnRenamed("key", "_s")
    j = all_ids.join(v, F.col("conv_id").eqNullSafe(F.col("_v")), "left").join(s, F.col("conv_id").eqNullSafe(F.col("_s")), "left")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return j.select("conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("digest", F.lit(empty)).alias("repaired_sha256"))


def repair_sql() -> str:
    """The query in DuckDB: one recursion carries the four states along the turns, another writes the repaired turns along the audit."""
    crc = "list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: ord(c)::UBIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda i: 0::UBIGINT)), lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::UBIGINT) ELSE v // 2 END))"
    add = lambda s, cost, edit: f"{{'c': {s}.c + {cost}, 'a': {s}.a || '{edit}'}}"
    least = lambda *xs: f"list_min([{', '.join(xs)}])"
    never = "{'c': 1000000000::BIGINT, 'a': ''}"
    only = lambda test, x: f"CASE WHEN {test} THEN {x} ELSE {never} END"
    keep = lambda initial, *froms: [only(f"NOT doomed AND initial = '{initial}'", add(s, "cut", "K")) for s in froms]
    rerole = lambda *froms: [only("NOT doomed", add(s, "2 + cut", "R")) for s in froms]
    closing = f"""SELECT g, i, s0, s1, {least("q2", add("q3", 2, "I"))} AS s2, {least("q3", add("q2", 2, "I"))} AS s3
  FROM (SELECT g, i, s0, s1, {least("s2", *(add(s, 2, "I") for s in ("s0", "s1", "s3")))} AS q2, {least("s3", add("s2", 2, "I"))} AS q3 FROM"""
    return rf"""WITH RECURSIVE x AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, dense_rank() OVER (ORDER BY conv_id) AS g, xor({crc}, 4294967295::UBIGINT) % 20 AS fault FROM conversations),
y AS (SELECT g, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN fault = 3 THEN [0, 1] ELSE [0] END) AS copy FROM x WHERE fault <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM y),
p AS (SELECT *, i > min(i) OVER (PARTITION BY g, role, text) AS again, role[1] AS initial, lag(role[1]) OVER (PARTITION BY g ORDER BY i) AS before FROM o),
k AS (SELECT *, bare = '' AS blank, bare <> '' AND again AS duplicate, bare <> '' AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') AS truncated, bare = '' OR again AS doomed, CASE WHEN bare <> '' AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS cut FROM p),
t AS (SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE duplicate) AS duplicate, count(*) FILTER (WHERE truncated) AS truncated,
      count(*) FILTER (WHERE i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM k GROUP BY g),
v AS (SELECT g, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': ''}} AS s0, {never} AS s1, {{'c': 2::BIGINT, 'a': 'I'}} AS s2, {{'c': 4::BIGINT, 'a': 'II'}} AS s3 FROM t
  UNION ALL {closing}
  (SELECT v.g, k.i, {add("s0", 3, "D")} AS s0, {least(add("s1", 3, "D"), *keep("s", "s0"))} AS s1,
    {least(add("s2", 3, "D"), *keep("u", "s0", "s1", "s3"), *rerole("s0", "s1", "s3"))} AS s2, {least(add("s3", 3, "D"), *keep("a", "s2"), *rerole("s2"))} AS s3
   FROM v JOIN k ON v.g = k.g AND v.i + 1 = k.i))),
b AS (SELECT t.*, {least("s0", "s3")} AS best FROM t JOIN v ON t.g = v.g AND t.n = v.i),
w AS (SELECT g, best.a AS audit, 0::BIGINT AS done, 0::BIGINT AS i, 's0' AS state, CAST([] AS VARCHAR[]) AS lines FROM b
  UNION ALL SELECT w.g, audit, done + 1, CASE WHEN edit = 'I' THEN w.i ELSE w.i + 1 END,
    CASE WHEN edit = 'D' THEN state WHEN edit = 'K' THEN CASE k.initial WHEN 's' THEN 's1' WHEN 'u' THEN 's2' ELSE 's3' END WHEN state = 's2' THEN 's3' ELSE 's2' END,
    CASE WHEN edit = 'D' THEN lines ELSE list_append(lines, CASE WHEN edit = 'K' THEN k.role WHEN state = 's2' THEN 'assistant' ELSE 'user' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE k.text END) END
  FROM (SELECT *, audit[done + 1] AS edit FROM w WHERE done < length(audit)) AS w LEFT JOIN k ON w.g = k.g AND w.i + 1 = k.i),
e AS (SELECT g, sha256(array_to_string(lines, chr(10))) AS repaired_sha256 FROM w WHERE done = length(audit))
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, g FROM x) AS c LEFT JOIN b USING (g) LEFT JOIN e USING (g)"""


OP11_SQL = repair_sql()
