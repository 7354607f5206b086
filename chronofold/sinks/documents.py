"""JSON documents, one for each medium, and versioned folders to write tables to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clock, script_safe
from ..functions.whole import in_units, total_ms
from .versions import read_version, write_version  # noqa: F401


def tenths(ms: Column) -> Column:
    """19.9s: seconds with one decimal, half up."""
    return F.format_string("%d.%ds", F.floor((ms + 50) / 1000), F.floor((ms + 50) / 100) % 10)


def seconds(text: Column) -> Column:
    """Seconds of 19.9s; what isn't that is 0."""
    return F.coalesce(F.rtrim(text, F.lit("s")).try_cast("double"), F.lit(0.0))


def clip_records(clips: DataFrame, rendered: DataFrame) -> DataFrame:
    """(media_id, clip_index, record) of clips with kept_ms and removed_ms; rendered: media_id, clip_id."""
    done = rendered.select("media_id", "clip_id").distinct().withColumn("_done", F.lit(True))
    c = clips.join(done, ["media_id", "clip_id"], "left")
    at = lambda ms: clock(F.col(ms) / 1000)
    record = F.struct(
        F.col("clip_id").alias("id"), F.concat("clip_id", F.lit(".mp4")).alias("filename"), F.concat("clip_id", F.lit(".srt")).alias("subtitles"), F.coalesce("_done", F.lit(False)).alias("rendered"),
        at("start_ms").alias("start"), at("end_ms").alias("end"), (F.col("start_ms") / 1000).alias("start_seconds"), (F.col("end_ms") / 1000).alias("end_seconds"),
        tenths(F.col("end_ms") - F.col("start_ms")).alias("original_duration"), tenths(F.col("removed_ms")).alias("silence_removed"), tenths(F.col("kept_ms")).alias("final_duration"), F.col("text").alias("transcription"), F.col("score").alias("importance_score"),
    )
    return c.select("media_id", "clip_index", record.alias("record"))


def metadata_documents(clips: DataFrame, u: DataFrame, media: DataFrame, rendered: DataFrame, engine: str = "local", language: str = "pt", parameters: dict[str, object] | None = None) -> DataFrame:
    """(media_id, json): header, parameters, whole text and clips of each medium."""
    lists = clip_records(clips, rendered).groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("clip_index", "record"))).alias("c"))
    told = u.groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("t"))
    met = media.join(told, "media_id", "left").join(lists, "media_id", "left")
    records = F.coalesce(F.transform("c", lambda x: x["record"]), F.array().cast(lists.select(F.transform("c", lambda x: x["record"]).alias("r")).schema["r"].dataType))
    json = F.to_json(
        F.struct(
            F.col("media_id").cast("string").alias("source"), clock(F.col("total_ms") / 1000).alias("total_duration"), F.size(F.filter(records, lambda r: r["rendered"])).alias("clips_generated"), F.size(records).alias("clips_planned"),
            F.lit(engine).alias("transcription_engine"), F.lit(language).alias("language"), F.struct(*[F.lit(v).alias(k) for k, v in (parameters or {"min_clip_duration_s": 2.0, "max_clip_duration_s": 60.0}).items()]).alias("parameters"),
            F.array_join(F.transform(F.coalesce("t", F.array().cast("array<struct<seq:bigint,text:string>>")), lambda x: x["text"]), " ").alias("full_transcription"), records.alias("clips"),
        )
    )
    return met.select("media_id", json.alias("json"))


def report_rows(clips: DataFrame, titles: DataFrame) -> DataFrame:
    """Review rows of metadata clips (media_id, pos, id and so on): the rendered ones, or all where none is, with their titles or none."""
    any_done = clips.groupBy("media_id").agg(F.bool_or("rendered").alias("_any"))
    shown = clips.join(any_done, "media_id").where(F.col("rendered") | ~F.col("_any"))
    t = titles.withColumnRenamed("clip_id", "id")
    met = shown.join(t, ["media_id", "id"], "left")
    said = lambda c: F.coalesce(c, F.lit(""))
    return met.select(
        "media_id", "pos", "id", said("titulo").alias("titulo"), said("descricao").alias("descricao"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.coalesce("estrela", F.lit(False)).alias("estrela"),
        "start", "end", F.coalesce("start_seconds", F.lit(0.0)).alias("seconds"), F.col("final_duration").alias("duration"), F.coalesce("silence_removed", F.lit("0.0s")).alias("removed"), F.coalesce("importance_score", F.lit(0.0)).alias("score"), said("transcription").alias("text"),
    )


def report_totals(rows: DataFrame) -> DataFrame:
    """(media_id, clips, minutes, removed_s) of review rows; a duration that can't be read counts 0."""
    return rows.groupBy("media_id").agg(F.count("*").alias("clips"), in_units(total_ms(seconds(F.col("duration"))), 60_000, even=True).alias("minutes"), in_units(total_ms(seconds(F.col("removed"))), 1000, even=True).alias("removed_s"))


def report_payloads(rows: DataFrame) -> DataFrame:
    """(media_id, payload): review rows as JSON that can stand in a script element."""
    item = F.struct("pos", F.struct(*[c for c in rows.columns if c not in ("media_id", "pos")]).alias("item"))
    lists = rows.groupBy("media_id").agg(F.array_sort(F.collect_list(item)).alias("x"))
    return lists.select("media_id", script_safe(F.to_json(F.transform("x", lambda e: e["item"]))).alias("payload"))


def speaker_documents(u: DataFrame, turns: DataFrame, most_samples: int = 5, least_chars: int = 25) -> DataFrame:
    """(media_id, json): number of speakers, their seconds, first longer sayings, labelled utterances and turns."""
    from pyspark.sql import Window as W

    totals = turns.groupBy("media_id", "speaker").agg(F.round(F.sum(F.col("end_ms") - F.col("start_ms")) / 1000, 1).alias("s"))
    totals = totals.groupBy("media_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("speaker", "s")))).alias("totals_s"))
    long = u.where((F.length(F.trim("text")) >= least_chars) & F.col("speaker").isNotNull())
    first = long.withColumn("k", F.row_number().over(W.partitionBy("media_id", "speaker").orderBy("seq"))).where(F.col("k") <= most_samples)
    samples = first.groupBy("media_id", "speaker").agg(F.array_sort(F.collect_list(F.struct("k", F.trim("text").alias("text")))).alias("x"))
    samples = samples.groupBy("media_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("speaker", F.transform("x", lambda e: e["text"]).alias("t"))))).alias("samples"))
    span = lambda x: F.struct((x["start_ms"] / 1000).alias("start"), (x["end_ms"] / 1000).alias("end"), x["speaker"].alias("speaker"))
    listed = lambda df, *by: df.groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct(*by, "start_ms", "end_ms", "speaker"))).alias("x"))
    said = listed(u, "seq").select("media_id", F.transform("x", span).alias("utterances"))
    turned = listed(turns).select("media_id", F.transform("x", span).alias("turns"))
    met = said.join(turned, "media_id", "left").join(totals, "media_id", "left").join(samples, "media_id", "left")
    return met.select("media_id", F.to_json(F.struct(F.size("totals_s").alias("num_speakers"), "totals_s", F.coalesce("samples", F.create_map().cast("map<string,array<string>>")).alias("samples"), "utterances", "turns")).alias("json"))


def persona_lines(report: DataFrame) -> DataFrame:
    """(media_id, clip_id, line): a persona report in columns; report: media_id, clip_id, start, end and what persona_report tells."""
    line = F.format_string("%-11s %-20s %7.1fs %6.1fs %3d%%  %s", "clip_id", F.concat("start", F.lit("-"), "end"), "persona_s", "outros_s", "outros_pct", "status")
    return report.select("media_id", "clip_id", line.alias("line"))
