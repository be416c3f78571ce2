"""TF-IDF classifiers with cross-validation, on pyspark.ml."""

from __future__ import annotations

from collections.abc import Callable
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import IDF, CountVectorizer, ElementwiseProduct, NGram, Normalizer, SQLTransformer, StringIndexer, VectorAssembler, Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from tallyloom.operators.foldterms import FoldTerms, fold_terms
from tallyloom.operators.windows import folds
from tallyloom.sources.scratch import dropped, written

#: Models that are fitted at a time; each keeps its rows until it is done.
PARALLEL = 2


def _together(spark: SparkSession, jobs: list[Callable]) -> list:
    """The results of the calls, ``PARALLEL`` of which run at a time."""
    with ThreadPool(PARALLEL) as pool:
        return pool.map(inheritable_thread_target(spark)(lambda f: f()), jobs, chunksize=1)


class TfIdf:
    """Word and bigram counts times 1 + ln((1 + n) / (1 + df)), in unit length.

    Terms of fewer than ``min_df`` rows are left out; if that leaves none, those of one row count too.
    """

    def __init__(self, tokens_col: str, min_df: int, max_features: int, bigrams: bool, out: str):
        self.tokens_col, self.min_df, self.max_features, self.bigrams, self.out = tokens_col, min_df, max_features, bigrams, out

    def _counts(self, rows: DataFrame, min_df: int) -> PipelineModel:
        terms = f"concat({self.tokens_col}, _bigrams)" if self.bigrams else self.tokens_col
        stages = [NGram(n=2, inputCol=self.tokens_col, outputCol="_bigrams")] if self.bigrams else []
        return Pipeline(stages=[*stages, SQLTransformer(statement=f"SELECT *, {terms} AS _terms FROM __THIS__"), CountVectorizer(inputCol="_terms", outputCol="_counts", minDF=float(min_df), vocabSize=self.max_features)]).fit(rows)

    def fit(self, rows: DataFrame) -> PipelineModel:
        counted = self._counts(rows, self.min_df)
        if self.min_df > 1 and not counted.stages[-1].vocabulary:
            counted = self._counts(rows, 1)
        idf = IDF(inputCol="_counts").fit(counted.transform(rows)).idf
        scale = ElementwiseProduct(scalingVec=Vectors.dense(idf.toArray() + 1.0), inputCol="_counts", outputCol="_weighted")
        return PipelineModel([*counted.stages, scale, Normalizer(p=2.0, inputCol="_weighted", outputCol=self.out)])

    def by_fold(self, dealt: DataFrame, k: int) -> FoldTerms:
        """The same of each training set of ``k`` folds (``dealt``: written, with fold), counted together; ties of frequency go by term."""
        return fold_terms(dealt, self.tokens_col, k, self.min_df, self.max_features, self.bigrams)


def tfidf(tokens_col: str = "toks", min_df: int = 2, max_features: int = 20_000, bigrams: bool = True, out: str = "features") -> TfIdf:
    return TfIdf(tokens_col, min_df, max_features, bigrams, out)


def classifier(kind: str, label: str = "label", n: int = 1000, seed: int = 42):
    """lr, rf or svm."""
    if kind == "lr":
        return LogisticRegression(labelCol=label, maxIter=50, tol=1e-4, regParam=1.0 / n, standardization=False, family="multinomial")
    if kind == "rf":
        return RandomForestClassifier(labelCol=label, numTrees=200, maxDepth=30, seed=seed)
    return OneVsRest(labelCol=label, classifier=LinearSVC(maxIter=100, regParam=1.0 / n, standardization=False))


def cross_validate(rows: DataFrame, label: str, kind: str = "lr", k: int = 5, key: str = "doc_id", tokens_col: str = "toks", seed: int = 42) -> DataFrame:
    """key, truth, pred, p (array, for lr and rf) out of fold; the vocabulary is fitted within each training fold."""
    index = StringIndexer(inputCol=label, outputCol="label", stringOrderType="alphabetAsc").fit(rows)
    dealt = written(folds(index.transform(rows.select(key, tokens_col, label)), key, label, k, seed))
    terms, parts = tfidf(tokens_col).by_fold(dealt, k), []
    dropped(dealt)
    n, names = terms.rows.count(), F.array(*map(F.lit, index.labels))
    features = [terms.features(f) for f in range(k)]
    fit = lambda f: classifier(kind, n=n, seed=seed).fit(features[f].transform(terms.rows.where(F.col("fold") != f)).select("label", "features"))
    models = _together(rows.sparkSession, [lambda f=f: fit(f) for f in range(k)])
    for f in range(k):
        got = models[f].transform(features[f].transform(terms.rows.where(F.col("fold") == f)))
        p = vector_to_array("probability") if kind != "svm" else F.lit(None).cast("array<double>")
        parts.append(got.select(key, F.col(label).alias("truth"), F.get(names, F.col("prediction").cast("int")).alias("pred"), p.alias("p"), F.lit(f).alias("fold")))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def binary_relevance(rows: DataFrame, labels: list[str], set_col: str, key: str = "doc_id", tokens_col: str = "toks", k: int = 3, seed: int = 42) -> DataFrame:
    """key and one out-of-fold probability for each label; balanced class weights; a constant label keeps its value."""
    dealt = written(folds(rows.select(key, tokens_col, set_col).withColumn("_all", F.lit("x")), key, "_all", k, seed).drop("_all"))
    terms, parts = tfidf(tokens_col).by_fold(dealt, k), []
    dropped(dealt)
    fitted, todo, tests = {}, [], []
    held = {r.fold: r for r in terms.rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.array_contains(set_col, c).cast("double")).alias(f"ones{i}") for i, c in enumerate(labels))).collect()}
    for f in range(k):
        features = terms.features(f)
        tr = features.transform(terms.rows.where(F.col("fold") != f)).select(set_col, "features")
        out = features.transform(terms.rows.where(F.col("fold") == f)).select(key, "features")
        n = sum(r.n for g, r in held.items() if g != f)
        ones = [sum(r[f"ones{i}"] or 0 for g, r in held.items() if g != f) for i in range(len(labels))]

        def fit(i: int, f: int = f, tr: DataFrame = tr, n: int = n, ones: list[float] = ones) -> None:
            y = tr.withColumn("label", F.array_contains(set_col, labels[i]).cast("double"))
            w = F.when(F.col("label") == 1, n / (2 * ones[i])).otherwise(n / (2 * (n - ones[i])))
            fitted[f, i] = LogisticRegression(labelCol="label", weightCol="w", regParam=1.0 / n, standardization=False, maxIter=30, tol=1e-4).fit(y.withColumn("w", w))

        todo += [lambda i=i, fit=fit: fit(i) for i in range(len(labels)) if n and ones[i] not in (0, n)]
        tests.append((out, ones))
    _together(rows.sparkSession, todo)
    for f, (out, ones) in enumerate(tests):
        for i, c in enumerate(labels):
            if (f, i) in fitted:
                out = fitted[f, i].transform(out).withColumn(f"p_{c}", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
            else:
                out = out.withColumn(f"p_{c}", F.lit(float(bool(ones[i]))))
        parts.append(out.drop("features"))
    got = parts[0]
    for x in parts[1:]:
        got = got.unionByName(x)
    return got


def rerank(scores: DataFrame, bridge_scores: DataFrame, key: str, labels: list[str], lam: float, tau: float, anchor: str | None = None) -> DataFrame:
    """key, pred: labels whose probability plus lam times their bridge score exceeds 0.5 + tau; the anchored label always counts."""
    b = bridge_scores.select(key, *(F.col(f"b_{c}") for c in labels))
    j = scores.join(b, key, "left")
    picked = F.filter(F.array(*(F.when(F.col(f"p_{c}") + lam * F.coalesce(f"b_{c}", F.lit(0.0)) > 0.5 + tau, F.lit(c)) for c in labels)), lambda x: x.isNotNull())
    pred = F.array_union(F.array(anchor), picked) if anchor else picked
    return j.select(key, pred.alias("pred"))


def classifier_chain(rows: DataFrame, labels: list[str], set_col: str, key: str = "doc_id", tokens_col: str = "toks", k: int = 3, seed: int = 42) -> DataFrame:
    """key and one out-of-fold probability for each label; each label's model also sees the labels before it.

    Training uses the true earlier labels, prediction the predicted ones (probability above 0.5).
    """
    dealt = written(folds(rows.withColumn("_all", F.lit("x")), key, "_all", k, seed))
    parts = []
    for f in range(k):
        train = dealt.where(F.col("fold") != f)
        features = tfidf(tokens_col).fit(train)
        tr, te = features.transform(train), features.transform(dealt.where(F.col("fold") == f)).select(key, "features")
        n = tr.count()
        for i, c in enumerate(labels):
            tr = tr.withColumn(f"_y{i}", F.array_contains(set_col, c).cast("double"))
            ones = tr.agg(F.sum(f"_y{i}")).first()[0]
            if not n or ones in (None, 0, n):
                te = te.withColumn(f"p_{c}", F.lit(float(bool(ones)))).withColumn(f"_y{i}", F.lit(float(bool(ones))))
                continue
            joined = VectorAssembler(inputCols=["features", *(f"_y{j}" for j in range(i))], outputCol="_x")
            m = LogisticRegression(labelCol=f"_y{i}", featuresCol="_x", regParam=1.0 / n, standardization=False, maxIter=30, tol=1e-4).fit(joined.transform(tr))
            te = m.transform(joined.transform(te)).withColumn(f"p_{c}", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction", "_x")
            te = te.withColumn(f"_y{i}", (F.col(f"p_{c}") > 0.5).cast("double"))
        parts.append(te.select(key, *(f"p_{c}" for c in labels)))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def soft_label_ridge(rows: DataFrame, soft: str, names: list[str], key: str = "doc_id", tokens_col: str = "toks", k: int = 3, alpha: float = 1.0, seed: int = 42) -> DataFrame:
    """key, q: out-of-fold ridge regressions of each class's soft label, clipped at 0 and normalised."""
    dealt = written(folds(rows.withColumn("_all", F.lit("x")), key, "_all", k, seed))
    parts = []
    for f in range(k):
        train = dealt.where(F.col("fold") != f)
        features = tfidf(tokens_col, bigrams=False).fit(train)
        tr, te = features.transform(train), features.transform(dealt.where(F.col("fold") == f)).select(key, "features")
        n = max(1, tr.count())
        for i in range(len(names)):
            m = LinearRegression(labelCol="_t", regParam=alpha / n, elasticNetParam=0.0, standardization=False, maxIter=50, solver="l-bfgs").fit(tr.withColumn("_t", F.col(soft)[i]))
            te = m.transform(te).withColumnRenamed("prediction", f"_q{i}")
        q = F.array(*(F.greatest(f"_q{i}", F.lit(0.0)) for i in range(len(names))))
        s = F.aggregate(q, F.lit(0.0), lambda a, x: a + x)
        parts.append(te.select(key, F.when(s > 0, F.transform(q, lambda x: x / s)).otherwise(F.transform(q, lambda x: F.lit(1.0 / len(names)))).alias("q")))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def bridge_scores(docs: DataFrame, weights: DataFrame, bridges: DataFrame, main: str, labels: list[str], key: str = "doc_id") -> DataFrame:
    """key and b_{label}: the sum of weight * p2 over the document's bridge words between its main label and that label.

    ``weights``: key, word, weight; ``bridges``: word, primary, secondary, p2.
    """
    j = docs.select(key, F.col(main).alias("_m")).join(weights, key).join(bridges.select("word", "primary", "secondary", "p2"), "word")
    partner = F.when(F.col("_m") == F.col("primary"), F.col("secondary")).when(F.col("_m") == F.col("secondary"), F.col("primary"))
    g = j.withColumn("_to", partner).where("_to is not null").groupBy(key).agg(*(F.sum(F.when(F.col("_to") == c, F.col("weight") * F.col("p2")).otherwise(0.0)).alias(f"b_{c}") for c in labels))
    return docs.select(key).join(g, key, "left").select(key, *(F.coalesce(f"b_{c}", F.lit(0.0)).alias(f"b_{c}") for c in labels))


def seed_variance(rows: DataFrame, label: str, kind: str = "lr", seeds: tuple[int, ...] = (1, 2, 3), k: int = 3, key: str = "doc_id") -> DataFrame:
    """key, variance: the mean variance of the out-of-fold probabilities over fold seeds."""
    parts = None
    for s in seeds:
        x = cross_validate(rows, label, kind, k, key, seed=s).select(key, F.posexplode("p").alias("c", "p"))
        parts = x if parts is None else parts.unionByName(x)
    return parts.groupBy(key, "c").agg(F.var_pop("p").alias("v")).groupBy(key).agg(F.avg("v").alias("variance"))


def word_vectors(docs: DataFrame, tokens_col: str = "toks", size: int = 100, window: int = 5, min_count: int = 5, iterations: int = 5, seed: int = 42) -> DataFrame:
    """word, vector by skip-gram with hierarchical softmax."""
    m = Word2Vec(vectorSize=size, windowSize=window, minCount=min_count, maxIter=iterations, seed=seed, numPartitions=1, inputCol=tokens_col, outputCol="_v").fit(docs.select(tokens_col))
    return m.getVectors().select("word", vector_to_array("vector").alias("vector"))
