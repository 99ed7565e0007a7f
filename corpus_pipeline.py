"""A corpus of documents cleaned by five of the operators, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next one's docs.  All but the last return the columns of documents; columns
that the operators add get names that no column of documents has.  All stages take whole texts
of any length, and give empty results of empty tables.
"""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calyxa.llm import decontaminate, mixing, near_dedup, pii, quality
from calyxa.llm.scratch import Scratch, free_name

#: A document is rejected if its score is below this.
MIN_QUALITY = 0.5
#: The setting that holds the key of pseudonyms, in hexadecimal digits.
KEY_SETTING = "spark.calyxa.pii.key"


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    Each row is judged by its whole text; a null or empty text by the intercept alone.  Repeated rows are
    judged alike, rows of a null doc_id or without a label, too.  Without labels all stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    weights = quality.fit(docs, labels, Scratch(spark, "pipeline-quality"))
    name = free_name(docs, "score")
    return quality.score(docs, weights, name).where(F.col(name) >= MIN_QUALITY).drop(name)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity of 0.8 or more), that of smallest id.

    Rows are dropped by id and text: an id's other texts stay.  Of repeated rows, equal in id and
    text, one stays.  Null and blank texts and rows of a null id all stay.
    """
    return near_dedup.one_of_each(docs, near_dedup.NearDedup(), Scratch(spark, "pipeline-dedup"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs.

    Null and blank texts hold no window and stay; repeated rows go or stay together, texts of one id each by itself.
    """
    # a key that a second scan makes again, whatever the splits
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.xxhash64(F.col("text").cast("string")))
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = docs.select(key.alias("row"), "doc_id", "text")
    found = decontaminate.contamination(rows, benchmark, Scratch(spark, "pipeline-leaks"))
    name = free_name(docs, "row")
    hit = found.where(F.size("spans") > 0).select(F.col("row").alias(name)).distinct()
    return docs.withColumn(name, key).join(hit, name, "left_anti").select(*[f"`{c}`" for c in docs.columns])


def pseudonym_key(spark: SparkSession) -> bytes:
    """The key that the session's KEY_SETTING holds; where it is unset, a new secret one for this run alone."""
    told = spark.conf.get(KEY_SETTING, None) or spark.sparkContext.getConf().get(KEY_SETTING)
    return bytes.fromhex(told) if told else secrets.token_bytes(32)


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for personal data.

    Null and empty texts stay as they are; equal values get equal pseudonyms in all rows of
    the run, and in all runs with the same key.
    """
    return pii.pseudonymise(docs, pseudonym_key(spark))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sample by raked weights, each document as often as its copies, with weights and probabilities.

    Null source and language count as values, null and blank texts have no tokens; repeated rows
    and rows of one id are sampled alike.
    """
    return mixing.sampled(mixing.mix(docs, Scratch(spark, "pipeline-mix")))


STAGES = [
    ("quality classifier", keep_quality),
    ("near-duplicate removal", one_of_each_group),
    ("benchmark decontamination", decontaminated),
    ("pii pseudonyms", without_pii),
    ("source mixing", mixed),
]

#: The classifier and the components of near duplicates are not expressed in SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.table(stage(spark, docs, sf_dir), f"stage-{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
