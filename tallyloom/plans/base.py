"""What the registered queries share: table access, classes and tokens of the test tables, and SQL preludes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.text import ascii_words
from tallyloom.operators import assoc, counts

#: Four balanced classes from the number of a document's source; the roles of conversation turns.
K4, ROLES, LANGS = ["k0", "k1", "k2", "k3"], ["assistant", "system", "user"], ["de", "en", "es", "fr"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(col: str = "text") -> Column:
    """The ASCII tokens of a text column."""
    return ascii_words(F.col(col))


def docs_k4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, lang, n_chars, grp (k0..k3), toks."""
    d = table(spark, sf_dir, "documents")
    number = F.substring("source", 4, 9).try_cast("int")
    return d.select("doc_id", "text", "lang", "n_chars", F.concat(F.lit("k"), (number % 4).cast("string")).alias("grp"), words_of().alias("toks"))


def counts_k4(spark: SparkSession, sf_dir: str, min_total: int = 5) -> DataFrame:
    return counts.doc_counts(docs_k4(spark, sf_dir), F.col("toks"), "grp", K4, min_total)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, role, text, toks."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", words_of().alias("toks"))


def chi2_k4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assoc.word_chi2(counts_k4(spark, sf_dir), 4)


def odds_k4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assoc.log_odds(counts_k4(spark, sf_dir), K4)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, n_chars, toks, quality, toxic and two label sets: y (from the labels) and p (by rule, from the text's length and language)."""
    d = docs_k4(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")
    return with_label_sets(d)


def with_label_sets(d: DataFrame) -> DataFrame:
    keep = lambda c, name: F.when(c, F.lit(name))
    pick = lambda *xs: F.filter(F.array(*xs), lambda x: x.isNotNull())
    y = pick(keep(F.col("quality") == 1, "good"), keep(F.col("toxic") == 1, "toxic"), keep(F.col("n_chars") > 1500, "long"), keep(F.col("lang") != "en", "foreign"))
    p = pick(keep(F.col("n_chars") % 5 > 0, "good"), keep(F.col("n_chars") % 7 == 0, "toxic"), keep(F.col("n_chars") > 1200, "long"), keep(F.col("lang").isin("de", "fr"), "foreign"))
    return d.withColumns({"y": y, "p": p})


LABELS = ["toxic", "foreign", "long", "good"]

_CLEAN = r"list_filter(string_split(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda t: length(t) > 1)"
DOCS_SQL = rf"d AS (SELECT doc_id, text, lang, n_chars, 'k' || (CAST(substr(source, 4) AS INT) % 4) AS grp, {_CLEAN} AS toks FROM documents)"
TURNS_SQL = rf"d AS (SELECT conv_id, turn, role, role AS grp, text, {_CLEAN} AS toks FROM conversations)"


def counts_sql(docs: str, key: str, classes: list[str], min_total: int, distinct: bool = True) -> str:
    """CTEs d, w, c (word, c0.., total) and t (n0.., n, v)."""
    cs = ", ".join(f"count(*) FILTER (WHERE grp = '{g}') AS c{i}" for i, g in enumerate(classes))
    ns = ", ".join(f"CAST(sum(c{i}) AS DOUBLE) AS n{i}" for i in range(len(classes)))
    once = "DISTINCT" if distinct else ""
    return f"""{docs},
w AS (SELECT {once} {key}, grp, unnest(toks) AS word FROM d),
c AS (SELECT word, {cs}, count(*) AS total FROM w WHERE grp IN ({", ".join(f"'{g}'" for g in classes)}) GROUP BY word HAVING count(*) >= {min_total}),
t AS (SELECT {ns}, CAST(sum(total) AS DOUBLE) AS n, count(*) AS v FROM c)"""


def chi2_sql(k: int) -> str:
    """CTE x: c with chi2."""
    term = lambda i: f"coalesce((c{i} - total * n{i} / n) * (c{i} - total * n{i} / n) / nullif(total * n{i} / n, 0), 0)"
    return f"x AS (SELECT c.*, {' + '.join(map(term, range(k)))} AS chi2 FROM c, t)"


def odds_sql(classes: list[str], alpha: float = 0.01) -> str:
    """CTEs l (one row a word and class) and o (word, grp, rank, cnt, log_odds, se, z)."""
    union = " UNION ALL ".join(f"SELECT word, total, '{g}' AS grp, {i} AS rank, c{i} AS cnt, n{i} AS ng, n, v FROM c, t" for i, g in enumerate(classes))
    return f"""l AS ({union}),
q AS (SELECT *, (cnt + {alpha}) / (ng + {alpha} * v) AS p1, (total - cnt + {alpha}) / (n - ng + {alpha} * v) AS p2 FROM l),
o AS (SELECT word, grp, rank, cnt, ln(p1 / (1 - p1)) - ln(p2 / (1 - p2)) AS log_odds, sqrt(1 / (cnt + {alpha}) + 1 / (total - cnt + {alpha})) AS se,
             (ln(p1 / (1 - p1)) - ln(p2 / (1 - p2))) / sqrt(1 / (cnt + {alpha}) + 1 / (total - cnt + {alpha})) AS z FROM q)"""


def top2_sql(classes: list[str], source: str = "c") -> str:
    """CTE b: source's word columns with primary, secondary, p1, p2, n1, n2, gap."""
    union = " UNION ALL ".join(f"SELECT word, total, '{g}' AS grp, {i} AS rank, c{i} AS cnt FROM {source}" for i, g in enumerate(classes))
    return f"""r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY cnt DESC, rank) AS rn FROM ({union})),
b AS (SELECT f.word, f.grp AS "primary", s.grp AS secondary, f.cnt AS n1, s.cnt AS n2, f.total AS total, f.cnt / f.total AS p1, s.cnt / s.total AS p2, f.cnt / f.total - s.cnt / s.total AS gap
      FROM r f JOIN r s USING (word) WHERE f.rn = 1 AND s.rn = 2)"""


def bridge_rule(config: tuple[float, float, float], count_min: int = 5) -> str:
    p1, p2, gap = (f"CAST({x} AS DOUBLE)" for x in config)
    return f"p1 >= {p1} AND p2 >= {p2} AND p1 - p2 <= {gap} AND n1 >= {count_min} AND n2 >= {count_min}"


def rounded(df: DataFrame, *cols: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in cols})


LABELLED_SQL = f"""{DOCS_SQL},
m AS (SELECT d.*, quality, toxic,
      list_filter([CASE WHEN quality = 1 THEN 'good' END, CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN n_chars > 1500 THEN 'long' END, CASE WHEN lang <> 'en' THEN 'foreign' END], lambda x: x IS NOT NULL) AS y,
      list_filter([CASE WHEN n_chars % 5 > 0 THEN 'good' END, CASE WHEN n_chars % 7 = 0 THEN 'toxic' END, CASE WHEN n_chars > 1200 THEN 'long' END, CASE WHEN lang IN ('de', 'fr') THEN 'foreign' END], lambda x: x IS NOT NULL) AS p
      FROM d JOIN labels USING (doc_id))"""
