"""Levels of sampled signals, frame by frame, and the stretches that stay below a level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .intervals import merge_gap


def levels(samples: DataFrame, frame: int) -> DataFrame:
    """(media_id, frame, power, db) of samples (media_id, i, x): mean square of each frame of so many numbers i, and its level; silence is null dB.

    A frame is a group of its own, summed in each task first, so a medium is dealt out however long it is.
    Samples without a value don't count; a frame without any isn't there.
    """
    at = samples.where(F.col("x").isNotNull()).select("media_id", F.floor(F.col("i") / frame).alias("frame"), F.col("x").cast("double").alias("x"))
    power = at.groupBy("media_id", "frame").agg(F.avg(F.col("x") * F.col("x")).alias("power"))
    return power.withColumn("db", F.when(F.col("power") > 0, 10 * F.log10("power")))


def quiet(samples: DataFrame, frame: int, rate: int, below_db: float, least_ms: int, span_ms: int | None = None) -> DataFrame:
    """(media_id, start_ms, end_ms, n) of stretches of n frames, without a gap, whose root mean square is below a level.

    rate: samples a second. Neighbouring frames join; stretches under least_ms go. With span_ms a medium's frames
    are joined in ranges of time so long.
    """
    low = levels(samples, frame).where(F.col("power") < 10 ** (below_db / 10))
    ms = lambda f: F.floor(f * frame * 1000 / rate)
    found = merge_gap(low.select("media_id", ms(F.col("frame")).alias("start_ms"), ms(F.col("frame") + 1).alias("end_ms")), 0, span=span_ms)
    return found.where(F.col("end_ms") - F.col("start_ms") >= least_ms)
