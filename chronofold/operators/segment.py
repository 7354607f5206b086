"""From transcript and silences to scored clips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.bind import let
from ..functions.text import clip_score, ends_sentence
from .intervals import clip_join, complement, greedy_split, keep_ranges, meet, overlaps, total

CONFIG = {"split_ms": 2000, "cut_ms": 800, "least_ms": 2000, "most_ms": 60_000, "pad_ms": 150, "ratio": 0.35, "most_clips": 60, "pause_tolerance_ms": 600}


def boundaries(silences: DataFrame, media: DataFrame, least: int = CONFIG["split_ms"]) -> DataFrame:
    """Silences that split their medium (media_id, total_ms): long enough, and begun inside it."""
    total = media.select("media_id", F.col("total_ms").alias("_total"))
    long = silences.where((F.col("end_ms") - F.col("start_ms") >= least) & (F.col("start_ms") > 0))
    return long.join(total, "media_id").where(F.col("start_ms") < F.col("_total")).drop("_total")


def cut_points(u: DataFrame, silences: DataFrame, tolerance: int = CONFIG["pause_tolerance_ms"]) -> DataFrame:
    """Utterance ends with the first pause within tolerance and a quality: sentence end 3, pause up to 2."""
    ends = u.select("media_id", "seq", ends_sentence(F.col("text")).alias("sentence_end"), F.col("end_ms").alias("time_ms"), (F.col("end_ms") - tolerance).alias("_lo"), (F.col("end_ms") + tolerance).alias("_hi"))
    s = silences.select("media_id", F.col("start_ms").alias("s_start"), (F.col("end_ms") - F.col("start_ms")).alias("pause"))
    met = meet(ends, s, ("_lo", "_hi"), ("s_start", "s_start"), F.col("s_start").between(F.col("_lo"), F.col("_hi")), how="left", l_most=2 * tolerance, r_most=0)
    out = met.groupBy("media_id", "seq", "time_ms", "sentence_end").agg(F.coalesce(F.min_by("pause", "s_start"), F.lit(0)).alias("pause_ms"))
    quality = F.when(F.col("sentence_end"), 3000).otherwise(0) + F.least(F.lit(2000), F.col("pause_ms"))
    return out.select("media_id", "seq", "time_ms", "sentence_end", "pause_ms", quality.cast("long").alias("quality"))


def split_windows(windows: DataFrame, points: DataFrame, least: int = CONFIG["least_ms"], most: int = CONFIG["most_ms"], named: str | None = None) -> DataFrame:
    """Pieces of each window; only the cut points inside a window travel with it. named: a column for the window's own start."""
    p = points.select("media_id", "time_ms", "quality")
    met = meet(windows.select("media_id", "start_ms", "end_ms"), p, ("start_ms", "end_ms"), ("time_ms", "time_ms"), (F.col("time_ms") > F.col("start_ms")) & (F.col("time_ms") < F.col("end_ms")), how="left", r_most=0)
    point = F.when(F.col("time_ms").isNotNull(), F.struct(F.col("quality"), F.col("time_ms").alias("time")))
    met = met.groupBy("media_id", "start_ms", "end_ms").agg(F.collect_set(point).alias("_cuts"))
    pieces = F.explode(greedy_split(F.col("start_ms"), F.col("end_ms"), F.col("_cuts"), least, most)).alias("p")
    return met.select("media_id", *([F.col("start_ms").alias(named)] if named else []), pieces).select("media_id", *([named] if named else []), "p.*")


def window_text(windows: DataFrame, u: DataFrame, ratio: float = CONFIG["ratio"], w_most: int | None = None) -> DataFrame:
    """windows (media_id, clip, w_start, w_end and others) with the text of utterances that overlap by ratio of their span, which isn't 0. w_most: no window is longer."""
    t = u.where("end_ms > start_ms").select("media_id", "seq", F.col("text").alias("u_text"), F.col("start_ms").alias("u_start"), F.col("end_ms").alias("u_end"))
    part = F.least("u_end", "w_end") - F.greatest("u_start", "w_start")
    on = overlaps("u_start", "u_end", "w_start", "w_end") & (part >= ratio * (F.col("u_end") - F.col("u_start")))
    met = meet(windows, t, ("w_start", "w_end"), ("u_start", "u_end"), on, how="left", l_most=w_most)
    said = F.array_sort(F.collect_list(F.when(F.col("seq").isNotNull(), F.struct("seq", "u_text"))))
    told = met.groupBy(*windows.columns).agg(said.alias("_said"))
    return told.withColumn("text", F.trim(F.array_join(F.transform("_said", lambda x: x["u_text"]), " "))).drop("_said")


def with_cuts(windows: DataFrame, silences: DataFrame, least: int = CONFIG["cut_ms"], w_most: int | None = None) -> DataFrame:
    """windows with the ordered silences inside them as an array. w_most: no window is longer."""
    parts = clip_join(windows, silences, least, how="left", w_most=w_most)
    cut = F.when(F.col("start_ms").isNotNull(), F.struct("start_ms", "end_ms"))
    return parts.groupBy(*windows.columns).agg(F.array_sort(F.collect_list(cut)).alias("cuts"))


def kept_and_removed(start: Column, end: Column, cuts: Column, pad) -> Column:
    """struct(ranges, kept_ms, removed_ms), the ranges worked out once."""

    def told(r: Column) -> Column:
        return let(total(r), lambda k: F.struct(r.alias("ranges"), k.alias("kept_ms"), F.greatest(F.lit(0).cast("long"), end - start - k).alias("removed_ms")))

    return let(keep_ranges(start, end, cuts, pad), told)


def build_clips(u: DataFrame, silences: DataFrame, media: DataFrame, most_clips: int = CONFIG["most_clips"]) -> DataFrame:
    """media_id, clip_index, start_ms, end_ms, text, score, cuts, kept_ms, removed_ms."""
    windows = complement(boundaries(silences, media), media)
    pieces = split_windows(windows, cut_points(u, silences)).where(F.col("end_ms") - F.col("start_ms") >= CONFIG["least_ms"])
    pieces = pieces.select("media_id", F.col("start_ms").alias("clip"), F.col("start_ms").alias("w_start"), F.col("end_ms").alias("w_end"))
    most = CONFIG["most_ms"]
    clips = window_text(with_cuts(pieces, silences, w_most=most), u, w_most=most).where("text <> ''")  # texts come last, so that no join carries them
    clips = clips.withColumn("score", clip_score(F.col("text"), F.col("w_end") - F.col("w_start")))
    best = W.partitionBy("media_id").orderBy(F.desc("score"), "w_start")
    clips = clips.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= most_clips)
    clips = clips.withColumn("clip_index", F.row_number().over(W.partitionBy("media_id").orderBy("w_start")))
    clips = clips.withColumn("_k", kept_and_removed(F.col("w_start"), F.col("w_end"), F.col("cuts"), CONFIG["pad_ms"]))
    return clips.select("media_id", "clip_index", F.col("w_start").alias("start_ms"), F.col("w_end").alias("end_ms"), "text", "score", "cuts", "_k.*")
