"""A corpus pipeline over the operators in fluence.llm: each stage works on all that the stage before it kept.

All stages take null ids and texts (a null text is empty), empty and very long texts, repeated rows, further columns of any
name, and empty tables; all but the last return the columns that they got.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluence.llm import decontaminate, mixing, neardup, quality, secrets
from fluence.llm.shared import settle, shipped, small


def _recounted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text where a stage has changed it."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))) if "n_chars" in docs.columns else docs


def _unused(docs: DataFrame, name: str) -> str:
    """name, longer where docs has such a column."""
    while name in docs.columns:
        name += "_"
    return name


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose passages score below 0.5 go; a null or empty text has the score of an empty passage. Repeated rows fare
    alike. Without labels of both kinds the score is constant, and an empty table stays empty."""
    model, score = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), _unused(docs, "_score")
    return quality.scores(docs, model, name=score).filter(F.col(score) >= 0.5).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id. Of rows that repeat an id one stays: the one with the
    smallest text (null first), of equal texts the one whose columns come first as JSON. Rows without an id, and texts without
    words in rows of their own, all stay."""
    found = settle(neardup.near_duplicates(docs).select("doc_id", "kept"))
    gone = settle(found.filter("not kept").select("doc_id").distinct())
    again = settle(found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    left = docs.join(small(gone), "doc_id", "left_anti").select(docs.columns)
    if again.isEmpty():
        return left
    again = small(again)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    order = F.struct(F.col("text").isNotNull(), F.col("text"), F.to_json(row))
    # the first of a repeated id is found with partial sums, so an id with any number of rows is no burden
    one = left.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, order).alias("first")).select("first.*")
    return left.join(again, "doc_id", "left_anti").unionByName(one).select(docs.columns)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that are mostly benchmark go. Others, null and empty texts too, stay as they
    are; repeated rows fare alike; an empty benchmark changes nothing."""
    return _recounted(decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every row stays, null texts stay null, repeated rows change alike."""
    return _recounted(secrets.redact(docs, secrets.train(docs)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sample that has the target marginals, with each document's copies and calibrated probability (mix_copies and
    mix_probability, which replace columns of these names). Null sources, languages and texts count as empty ones; rows
    without words are never drawn; rows that repeat an id are drawn alike."""
    kept = [F.col(f"row.`{c}`") for c in docs.columns if c not in ("mix_copies", "mix_probability")]
    return mixing.mix(docs).filter("copies > 0").select(*kept, F.col("copies").alias("mix_copies"), F.col("probability").alias("mix_probability"))


STAGES = [
    ("quality classifier", shipped(reject_low_quality)),
    ("near duplicates", shipped(drop_near_duplicates)),
    ("benchmark decontamination", shipped(remove_benchmark)),
    ("secret scan", shipped(redact_secrets)),
    ("mixing to target weights", shipped(mix_sources)),
]
#: Stages learn models; SQL cannot express them, so tests compare each with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settle(docs)
    return docs
