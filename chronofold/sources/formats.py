"""Text formats: SRT documents, silence logs, cached transcripts, selections, adjustments, titles."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import parse_clock, parse_srt_time

WORD = "struct<start:double,end:double,text:string>"
TRANSCRIPT = f"struct<cache_version:int,language:string,model:string,engine:string,utterances:array<struct<start:double,end:double,text:string,words:array<{WORD}>>>>"


def parse_srt(docs: DataFrame) -> DataFrame:
    """media_id, n, start_ms, end_ms, text of (media_id, srt); blocks that aren't cues are skipped."""
    blocks = docs.select("media_id", F.posexplode(F.split("srt", "\\r?\\n\\s*\\r?\\n")).alias("pos", "block"))
    lines = F.split(F.trim(F.regexp_replace("block", "^\\s+|\\s+$", "")), "\\r?\\n")
    times = "^\\s*(\\d+:\\d+:\\d+[,.]\\d+)\\s*-->\\s*(\\d+:\\d+:\\d+[,.]\\d+).*$"
    cues = blocks.select("media_id", "pos", lines.alias("l")).where(F.size("l") >= 3)
    at = lambda k: parse_srt_time(F.regexp_extract(F.get("l", 1), times, k))
    cues = cues.select("media_id", "pos", at(1).alias("start_ms"), at(2).alias("end_ms"), F.trim(F.array_join(F.slice("l", 3, F.size("l")), "\n")).alias("text"))
    cues = cues.where("end_ms > start_ms and text <> ''")
    return cues.select("media_id", F.row_number().over(W.partitionBy("media_id").orderBy("pos")).alias("n"), "start_ms", "end_ms", "text")


def parse_silence_log(lines: DataFrame) -> DataFrame:
    """Intervals from (media_id, line_no, line, total_ms): a start pairs with the next end; a last open one ends at total."""
    kind = F.regexp_extract("line", "silence_(start|end):", 1)
    at = F.round(F.regexp_extract("line", "silence_(?:start|end): *(-?[0-9.]+)", 1).try_cast("double") * 1000).cast("long")
    marks = lines.select("media_id", "line_no", "total_ms", kind.alias("kind"), at.alias("t")).where("kind <> '' and t is not null")
    w = W.partitionBy("media_id").orderBy("line_no")
    marks = marks.withColumns({"next_kind": F.lead("kind").over(w), "next_t": F.lead("t").over(w)})
    opened = marks.where("kind = 'start' and (next_kind is null or next_kind = 'end')")
    out = opened.select("media_id", F.greatest(F.lit(0).cast("long"), "t").alias("start_ms"), F.least(F.coalesce("next_t", "total_ms"), "total_ms").alias("end_ms"))
    return out.where("end_ms > start_ms")


def _words(words: Column) -> Column:
    """Words trimmed; blank ones and those that don't end after their start go."""
    told = F.transform(F.coalesce(words, F.array().cast(f"array<{WORD}>")), lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), F.trim(w["text"]).alias("text")))
    return F.filter(told, lambda w: (w["text"] != "") & (w["end"] > w["start"]))


def parse_transcripts(docs: DataFrame, language: str, model: str, words: bool = False) -> DataFrame:
    """Utterances of cached transcripts (media_id, json) that match version, language and model, have any text, and words if wanted; others are misses."""
    t = docs.select("media_id", F.from_json("json", TRANSCRIPT).alias("t"))
    hit = t.where(F.col("t.cache_version").isin(1, 2) & (F.col("t.language") == language) & (F.col("t.model") == model))
    if words:
        hit = hit.where(F.exists("t.utterances", lambda u: F.size(F.coalesce(u["words"], F.array().cast(f"array<{WORD}>"))) > 0))
    u = hit.select("media_id", F.posexplode("t.utterances").alias("seq", "u"))
    return u.select("media_id", "seq", F.col("u.start").alias("start"), F.col("u.end").alias("end"), F.trim("u.text").alias("text"), F.coalesce("u.words", F.array().cast(f"array<{WORD}>")).alias("words")).where("text <> ''")


def parse_server_segments(docs: DataFrame) -> DataFrame:
    """Utterances from (media_id, json) in a transcription server's form: segments, or transcription, with offsets in ms, else seconds."""
    one = "array<struct<text:string,start:double,end:double,offsets:struct<`from`:double,`to`:double>>>"
    j = docs.select("media_id", F.from_json("json", f"struct<segments:{one},transcription:{one}>").alias("j"))
    s = j.select("media_id", F.posexplode(F.when(F.size("j.segments") > 0, F.col("j.segments")).otherwise(F.col("j.transcription"))).alias("seq", "s"))
    by_offsets, zero = F.col("s.offsets").isNotNull(), F.lit(0.0)
    a = F.when(by_offsets, F.coalesce("s.offsets.from", zero) / 1000).otherwise(F.coalesce("s.start", zero))
    b = F.when(by_offsets, F.coalesce("s.offsets.to", zero) / 1000).otherwise(F.coalesce("s.end", "s.start", zero))
    return s.select("media_id", "seq", a.alias("start"), b.alias("end"), F.trim("s.text").alias("text")).where("text <> '' and end > start")


def parse_segments(docs: DataFrame) -> DataFrame:
    """Utterances with words from (media_id, json) in a recogniser's form, {segments: [{start, end, text, words}]}; blank ones go, whatever their times."""
    kind = "struct<segments:array<struct<start:double,end:double,text:string,words:array<struct<start:double,end:double,word:string>>>>>"
    s = docs.select("media_id", F.posexplode(F.from_json("json", kind)["segments"]).alias("seq", "s"))
    words = F.transform("s.words", lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), w["word"].alias("text")))
    return s.select("media_id", "seq", "s.start", "s.end", F.trim("s.text").alias("text"), _words(words).alias("words")).where("text <> ''")


def first_engine(results: dict[str, DataFrame], order: tuple[str, ...]) -> DataFrame:
    """Of several engines' utterances (same columns, media_id among them), each medium's first engine, by order, that has any."""
    ranked = None
    for k, name in enumerate(n for n in order if n in results):
        one = results[name].withColumns({"engine": F.lit(name), "_rank": F.lit(k)})
        ranked = one if ranked is None else ranked.unionByName(one)
    if ranked is None:
        raise ValueError("no engine has a result")
    best = ranked.groupBy("media_id").agg(F.min("_rank").alias("_rank"))
    return ranked.join(best, ["media_id", "_rank"]).drop("_rank")


def parse_speakers(docs: DataFrame) -> DataFrame:
    """Turns from (media_id, json) with end after start."""
    t = docs.select("media_id", F.posexplode(F.from_json("json", "struct<turns:array<struct<start:double,end:double,speaker:string>>>")["turns"]).alias("seq", "t"))
    return t.select("media_id", "seq", "t.start", "t.end", "t.speaker").where("end > start")


def media_without(docs: DataFrame, parsed: DataFrame) -> DataFrame:
    """(media_id) of documents that a parser has no row for: what a strict reader refuses."""
    return docs.select("media_id").distinct().join(parsed.select("media_id").distinct(), "media_id", "left_anti")


def read_strictly(docs: DataFrame, parsed: DataFrame, what: str) -> DataFrame:
    """parsed, or ValueError if a document has no row in it (no turns, no clips, no titles)."""
    none = [r[0] for r in media_without(docs, parsed).limit(5).collect()]
    if none:
        raise ValueError(f"no {what} in {', '.join(map(str, none))}")
    return parsed


def parse_adjustments(docs: DataFrame) -> DataFrame:
    """Adjusted clips of (media_id, json) with the plan's lead, tail, fingerprint and snap, times in ms.

    Times are seconds or clock texts (01:30). error is bad time where one is neither; then set_start or set_end is null.
    """
    clip = "struct<start:string,end:string,remove:boolean,absorb:array<string>,note:string>"
    p = docs.select("media_id", F.from_json("json", f"struct<context_lead_s:double,context_tail_s:double,snap:boolean,source_fingerprint:string,clips:map<string,{clip}>>").alias("p"))
    each = p.select("media_id", "p", F.explode("p.clips").alias("clip_id", "c"))
    ms = lambda s: F.round(s * 1000).cast("long")
    at = lambda c: ms(parse_clock(F.col(f"c.{c}")))
    bad = lambda c: F.col(f"c.{c}").isNotNull() & parse_clock(F.col(f"c.{c}")).isNull()
    return each.select(
        "media_id", "clip_id", at("start").alias("set_start"), at("end").alias("set_end"), F.coalesce("c.remove", F.lit(False)).alias("remove"), F.coalesce("c.absorb", F.array().cast("array<string>")).alias("absorb"), F.coalesce("c.note", F.lit("")).alias("note"),
        ms(F.coalesce("p.context_lead_s", F.lit(5.0))).alias("lead_ms"), ms(F.coalesce("p.context_tail_s", F.lit(3.0))).alias("tail_ms"), F.coalesce("p.snap", F.lit(True)).alias("snap"), F.coalesce("p.source_fingerprint", F.lit("")).alias("fingerprint"),
        F.when(bad("start") | bad("end"), "bad time").alias("error"),
    )


def parse_titles(docs: DataFrame) -> DataFrame:
    """Title records of (media_id, json), {clips: {id: record}}."""
    kind = "struct<clips:map<string,struct<titulo:string,descricao:string,tags:array<string>,estrela:boolean>>>"
    t = docs.select("media_id", F.explode(F.from_json("json", kind)["clips"]).alias("clip_id", "t"))
    return t.select("media_id", "clip_id", "t.titulo", "t.descricao", F.coalesce("t.tags", F.array().cast("array<string>")).alias("tags"), F.coalesce("t.estrela", F.lit(False)).alias("estrela"))


def parse_selection(docs: DataFrame) -> DataFrame:
    """Selected clips of (media_id, json), {clips: [...]}, from position 1 on, times in ms; what isn't a number is null."""
    kind = "struct<clips:array<struct<start:string,end:string,title:string,reason:string,score:double>>>"
    s = docs.select("media_id", F.posexplode(F.from_json("json", kind)["clips"]).alias("pos", "s"))
    ms = lambda c: F.round(F.col(c).try_cast("double") * 1000).cast("long")
    said = lambda c: F.trim(F.coalesce(c, F.lit("")))
    return s.select("media_id", (F.col("pos") + 1).alias("pos"), ms("s.start").alias("set_start"), ms("s.end").alias("set_end"), said("s.title").alias("title"), said("s.reason").alias("reason"), F.coalesce("s.score", F.lit(0.0)).alias("score"))


ITEM = "struct<id:string,status:string,estrela:boolean,arquivo:string,titulo:string,descricao:string,tags:array<string>,categoryId:string,privacy:string,publish_at:string,published_at:string,video_id:string,erro:string,tiktok_status:string>"


def parse_queue(docs: DataFrame) -> DataFrame:
    """Queue items of (media_id, json), a list, with their position."""
    q = docs.select("media_id", F.posexplode(F.from_json("json", f"array<{ITEM}>")).alias("pos", "q"))
    return q.select("media_id", "pos", "q.*")


CLIP = "struct<id:string,filename:string,subtitles:string,rendered:boolean,start:string,end:string,start_seconds:double,end_seconds:double,original_duration:string,silence_removed:string,final_duration:string,transcription:string,importance_score:double>"
METADATA = f"struct<source:string,total_duration:string,clips_generated:int,clips_planned:int,transcription_engine:string,language:string,full_transcription:string,clips:array<{CLIP}>>"


def parse_metadata(docs: DataFrame) -> DataFrame:
    """Clips of metadata documents (media_id, json), with their position."""
    m = docs.select("media_id", F.posexplode(F.from_json("json", METADATA)["clips"]).alias("pos", "c"))
    return m.select("media_id", "pos", "c.*")


def find_projects(spark: SparkSession, root: str, most_depth: int = 6) -> DataFrame:
    """Projects below root, newest first: name, path, clips, minutes, modified of each metadata.json with clips, at most so deep."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "metadata.json").load(root)
    f = f.where(F.size(F.split(F.regexp_replace("path", "^.*?" + re.escape(root.rstrip("/").split(":", 1)[-1]) + "/", ""), "/")) <= most_depth)
    j = f.select("path", F.col("modificationTime").alias("modified"), F.from_json(F.col("content").cast("string"), METADATA)["clips"].alias("clips")).where(F.size("clips") > 0)
    seconds = F.aggregate("clips", F.lit(0.0), lambda acc, c: acc + F.coalesce(F.rtrim(c["final_duration"], F.lit("s")).try_cast("double"), F.lit(0.0)))
    folder = F.regexp_replace("path", "/[^/]*$", "")
    return j.select(F.element_at(F.split(folder, "/"), -1).alias("name"), folder.alias("path"), F.size("clips").alias("clips"), F.round(seconds / 60, 1).alias("minutes"), "modified").orderBy(F.desc("modified"), "path")


def find_files(spark: SparkSession, root: str, endings: tuple[str, ...], least_bytes: int = 0, most: int = 30, skip: tuple[str, ...] = ()) -> DataFrame:
    """Largest files below root with one of the endings: path, bytes, modified. skip: folders that no part of the path may be. Content isn't read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    if skip:
        f = f.where(~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(s.strip("/")) for s in skip])))
    return f.where(F.lower("path").rlike("(" + "|".join(e.replace(".", "\\.") for e in endings) + ")$") & (F.col("bytes") >= least_bytes)).orderBy(F.desc("bytes"), "path").limit(most)
