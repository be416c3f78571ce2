"""Session records: nested JSON files, each with one record or a list of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from tallyloom.constants import ABUSE_ORDER
from tallyloom.functions import labels
from tallyloom.functions.arrays import by_rank, fenced
from tallyloom.functions.text import speech

_text = lambda *names: [StructField(n, StringType()) for n in names]
AUDIO = ArrayType(StructType(_text("type", "text")))
ITEMS = ArrayType(StructType([*_text("항목", "점수"), StructField("audio", AUDIO)]))
QUESTIONS = ArrayType(StructType([*_text("문항", "문항합계"), StructField("list", ITEMS)]))
INFO = StructType(_text("ID", "합계점수", "위기단계", "성별", "나이", "학년", "임상진단", "임상가 종합소견", "학대의심", "가정환경"))
#: ``info`` comes as text, for its id has several spellings that differ in case alone.
SCHEMA = StructType([StructField("info", StringType()), StructField("list", QUESTIONS), StructField("_corrupt_record", StringType())])


def scan(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """info, list, source_file of all readable records under a folder; malformed files are skipped.

    A file may hold one object or an array of them; records with neither info nor list are left out.
    """
    reader = spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    raw = reader.option("pathGlobFilter", "*.json").option("recursiveFileLookup", recursive).json(path)
    named = raw.withColumn("source_file", F.col("_metadata.file_path"))
    return parse_info(named.where(F.col("_corrupt_record").isNull() & (F.col("info").isNotNull() | F.col("list").isNotNull())).drop("_corrupt_record"))


def parse_info(raw: DataFrame) -> DataFrame:
    """The rows with ``info`` as a struct instead of JSON text; its id may be spelt ID, id or Id."""
    ident = F.coalesce(*(F.get_json_object("info", f"$.{k}") for k in ("ID", "id", "Id")))
    return raw.withColumn("info", F.when(F.col("info").isNotNull(), F.from_json("info", INFO).withField("ID", ident)))


def doc_id(info: Column, source_file: Column) -> Column:
    """The record's id, or its file's stem."""
    stem = F.regexp_extract(source_file, r"([^/]+?)(?:\.json)?$", 1)
    return F.coalesce(info["ID"], stem)


def gt_text(info: Column) -> Column:
    """The polymorphic ground-truth field as text; what isn't JSON is text already."""
    raw = info["학대의심"]
    parsed = F.try_parse_json(raw)
    return F.when(raw.rlike(r'^\s*[\[{"]') & parsed.isNotNull(), labels.flatten_variant(parsed)).otherwise(raw)


def clinical_text(info: Column) -> Column:
    return F.concat_ws(" ", info["임상진단"], info["임상가 종합소견"])


def labelled(records: DataFrame, theta: int = 6, tau: int = 4, compat: bool = True) -> DataFrame:
    """doc_id, valence, simple (valence without ground truth), gt (set), gt_main, gt_status, gt_text, crisis, clinical, keywords, scores, main, subs, tier, in_neg, in_abuse_neg, in_gt, said (the child's answers)."""
    info, items = F.col("info"), F.coalesce(F.col("list"), F.array().cast(QUESTIONS))
    r = records.withColumn("_gt", gt_text(info)).withColumn("_items", items).withColumn("_clinical", clinical_text(info))
    r = r.select(
        doc_id(F.col("info"), F.col("source_file")).alias("doc_id"), labels.gt_labels(F.col("_gt")).alias("gt"), labels.gt_main(F.col("_gt")).alias("gt_main"),
        labels.gt_status(F.col("_gt")).alias("gt_status"), labels.class_scores(F.col("_items")).alias("scores"),
        labels.record_valence(F.col("info"), F.col("_items"), labels.gt_main(F.col("_gt"))).alias("valence"), speech(F.col("_items")).alias("said"),
        labels.record_simple_valence(F.col("info"), F.col("_items")).alias("simple"), F.col("_gt").alias("gt_text"), F.col("info")["위기단계"].alias("crisis"), labels.keywords(F.col("_clinical")).alias("keywords"), F.col("_clinical").alias("clinical"),
    )
    r = fenced(r)
    r = r.withColumn("_m", labels.main_sub(F.col("gt_main"), F.col("scores"), F.col("clinical"), theta, tau, compat=compat))
    r = r.withColumns({"main": F.col("_m.main"), "subs": F.col("_m.subs"), "tier": labels.case_tier(F.col("scores")), "in_neg": F.col("valence") == "부정", "in_gt": F.size("gt") > 0})
    return fenced(r.withColumn("in_abuse_neg", F.col("in_neg") & F.col("main").isNotNull()).drop("_m"))


def label_set(main: Column, subs: Column) -> Column:
    return by_rank(F.array_compact(F.array_append(subs, main)), ABUSE_ORDER)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def canonical_paths(rows: DataFrame, col: str, suffix: str = "") -> DataFrame:
    """path: every address once, in lower case, without scheme, query, fragment and closing slashes; those with ``suffix`` only."""
    path = F.regexp_replace(F.regexp_extract(F.lower(F.col(col)), r"^(?:[a-z]+:/{1,3})?([^?#]*)", 1), "/+$", "")
    return rows.select(path.alias("path")).where((F.col("path") != "") & F.col("path").endswith(suffix)).distinct()


def utterances(rows: DataFrame, col: str, least: int = 5) -> DataFrame:
    """The rows whose text has ``least`` characters or more beside outer white space."""
    return rows.where(F.length(F.trim(F.col(col))) >= least)
