"""Transcripts, silences and speaker turns from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import word_count


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn lasts its words at 2.6 a second; a pause of 2.6, 0.5 or 0.2 s follows."""
    c = read(spark, sf_dir, "conversations")
    c = c.select(F.col("conv_id").alias("media_id"), F.col("turn").alias("seq"), F.col("role").alias("speaker"), F.coalesce("text", F.lit("")).alias("text"))
    c = c.withColumn("_dur", F.floor(word_count(F.col("text")).cast("long") * 5000 / 13))
    c = c.withColumn("_pause", F.when(F.col("seq") % 3 == 0, 2600).when(F.col("seq") % 3 == 1, 500).otherwise(200).cast("long"))
    before = W.partitionBy("media_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    c = c.withColumn("start_ms", F.coalesce(F.sum(F.col("_dur") + F.col("_pause")).over(before), F.lit(0)))
    return c.select("media_id", "seq", "speaker", "text", "start_ms", (F.col("start_ms") + F.col("_dur")).alias("end_ms"))


def silences(u: DataFrame) -> DataFrame:
    w = W.partitionBy("media_id").orderBy("seq")
    s = u.select("media_id", F.col("end_ms").alias("start_ms"), F.lead("start_ms").over(w).alias("end_ms"))
    return s.where("end_ms > start_ms")


def media(u: DataFrame) -> DataFrame:
    return u.groupBy("media_id").agg(F.max("end_ms").alias("total_ms"))
