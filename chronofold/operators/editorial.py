"""Editorial steps over clips: selections checked, adjustments applied, one speaker's parts kept.

Clips are rows of media_id, clip_id, clip_index, start_ms, end_ms, text, score, cuts (array of start_ms,
end_ms) and pad_ms. Strict steps look for what can't be applied first, and raise ValueError if there
is any; the functions that find it are here too, for those who want the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import clip_score
from ..shared import Kept
from . import segment as S
from .intervals import PAIR, clip_join, longest, meet, merge_gap, nearest, overlaps

#: Milliseconds: how far a border snaps to speech, lead and tail of context, the least length.
SNAP, SELECTION_SNAP, LEAD, TAIL, LEAST = 2500, 3000, 5000, 3000, 1000


def _stop_if_any(df: DataFrame, message: str) -> None:
    found = [r[0] for r in df.limit(5).collect()]  # the first few are for the message only
    if found:
        raise ValueError(f"{message}: {', '.join(map(str, found))}")


# ---- speakers in windows ----


def speaker_totals(windows: DataFrame, turns: DataFrame) -> DataFrame:
    """(media_id, clip, speaker, ms): how long each speaker is heard in each window (media_id, clip, w_start, w_end)."""
    t = turns.select("media_id", "speaker", F.col("start_ms").alias("a"), F.col("end_ms").alias("b"))
    met = meet(windows, t, ("w_start", "w_end"), ("a", "b"), overlaps("a", "b", "w_start", "w_end"))
    return met.groupBy("media_id", "clip", "speaker").agg(F.sum(F.least("b", "w_end") - F.greatest("a", "w_start")).alias("ms"))


def persona_report(windows: DataFrame, turns: DataFrame, persona: str) -> DataFrame:
    """Each window's seconds of the persona and of others, the others' share in percent, and the verdict."""
    t = turns.select("media_id", "speaker", F.col("start_ms").alias("a"), F.col("end_ms").alias("b"))
    met = meet(windows, t, ("w_start", "w_end"), ("a", "b"), overlaps("a", "b", "w_start", "w_end"), how="left")
    ms = F.least("b", "w_end") - F.greatest("a", "w_start")
    heard = lambda who: F.coalesce(F.sum(F.when(who, ms)), F.lit(0))
    of = met.groupBy("media_id", "clip").agg(heard(F.col("speaker") == persona).alias("own"), heard(F.col("speaker") != persona).alias("others"))
    spoken = F.col("own") + F.col("others")
    share = F.col("others") / F.when(spoken > 0, spoken).otherwise(1000)
    return of.select(
        "media_id", "clip", F.round(F.col("own") / 1000, 1).alias("persona_s"), F.round(F.col("others") / 1000, 1).alias("outros_s"),
        F.bround(share * 100, 0).cast("long").alias("outros_pct"), F.when(share < 0.15, "limpo").when(share <= 0.5, "contaminado").otherwise("comprometido").alias("status"),
    )


def keep_spans(windows: DataFrame, turns: DataFrame, persona: str, gap: int = 500, trim: int = 100, least: int = 300) -> DataFrame:
    """What the persona says in each window: joined over gap, trimmed off inner edges, at least so long."""
    own = clip_join(windows.select("media_id", "clip", "w_start", "w_end"), turns.where(F.col("speaker") == persona), 1)
    spans = merge_gap(own, gap, ("media_id", "clip", "w_start", "w_end"))
    a = F.when(F.col("start_ms") > F.col("w_start"), F.col("start_ms") + trim).otherwise(F.col("start_ms"))
    b = F.when(F.col("end_ms") < F.col("w_end"), F.col("end_ms") - trim).otherwise(F.col("end_ms"))
    return spans.select("media_id", "clip", "w_start", "w_end", a.alias("start_ms"), b.alias("end_ms")).where(F.col("end_ms") - F.col("start_ms") >= least)


def cuts_between(start: Column, end: Column, keep: Column, least: int = 50) -> Column:
    """What ordered keep ranges leave of [start, end], if longer than least."""
    cut = lambda a, b: F.when(b - a > least, F.array(F.struct(a.alias("start_ms"), b.alias("end_ms")))).otherwise(F.array().cast(PAIR))
    walked = F.aggregate(
        F.concat(keep, F.array(F.struct(end.alias("start_ms"), end.alias("end_ms")))),
        F.struct(start.alias("at"), F.array().cast(PAIR).alias("cuts")),
        lambda acc, k: F.struct(F.greatest(acc["at"], k["end_ms"]).alias("at"), F.concat(acc["cuts"], cut(acc["at"], k["start_ms"])).alias("cuts")),
    )
    return walked["cuts"]


def unknown_persona(clips: DataFrame, turns: DataFrame, persona: str) -> DataFrame:
    """(media_id) of clips whose medium the persona never speaks in."""
    return clips.select("media_id").distinct().join(turns.where(F.col("speaker") == persona).select("media_id").distinct(), "media_id", "left_anti")


def apply_persona(clips: DataFrame, turns: DataFrame, persona: str, strict: bool = True) -> DataFrame:
    """clips cut down to what the persona says: the rest joins their cuts, and padding goes.

    It comes after apply_adjustments: cuts belong to the window that a clip ends up with. A clip without any word
    of the persona is cut whole, which keep_ranges reads as nothing to cut.
    """
    if strict:
        _stop_if_any(unknown_persona(clips, turns, persona), f"{persona} does not speak in")
    windows = clips.select("media_id", F.col("clip_id").alias("clip"), F.col("start_ms").alias("w_start"), F.col("end_ms").alias("w_end"))
    spans = keep_spans(windows, turns, persona).groupBy("media_id", F.col("clip").alias("clip_id")).agg(F.array_sort(F.collect_list(F.struct("start_ms", "end_ms"))).alias("_keep"))
    met = clips.join(spans, ["media_id", "clip_id"], "left").withColumn("_keep", F.coalesce("_keep", F.array().cast(PAIR)))
    cuts = F.array_sort(F.concat("cuts", cuts_between(F.col("start_ms"), F.col("end_ms"), F.col("_keep"))))
    return met.withColumns({"cuts": cuts, "pad_ms": F.lit(0).cast("long")}).select(*clips.columns)


# ---- adjustments ----


def fingerprints(clips: DataFrame) -> DataFrame:
    """(media_id, fingerprint) of each medium's clips in order: id, start and end with two decimals, digested.

    Times are whole milliseconds and round half up, where binary fractions may round a tie down.
    """
    told = lambda ms: F.format_string("%d.%02d", F.floor((ms + 5) / 1000), F.floor((ms + 5) / 10) % 100)
    line = F.concat("clip_id", F.lit(":"), told(F.col("start_ms")), F.lit(":"), told(F.col("end_ms")), F.lit(";"))
    lists = clips.groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("clip_index", line.alias("line")))).alias("c"))
    return lists.select("media_id", F.substring(F.sha2(F.array_join(F.transform("c", lambda x: x["line"]), "").cast("binary"), 256), 1, 16).alias("fingerprint"))


def stale_plans(plan: DataFrame, clips: DataFrame) -> DataFrame:
    """(media_id, fingerprint, now) of plans (media_id, fingerprint) that were made for other clips; an empty one fits all."""
    asked = plan.where("fingerprint <> ''").select("media_id", "fingerprint").distinct()
    now = fingerprints(clips).withColumnRenamed("fingerprint", "now")
    return asked.join(now, "media_id", "left").where(~F.col("fingerprint").eqNullSafe(F.col("now")))


def unknown_adjustments(plan: DataFrame, clips: DataFrame) -> DataFrame:
    """(clip_id, media_id) of adjustments for clips that aren't there."""
    return plan.select("clip_id", "media_id").join(clips.select("media_id", "clip_id"), ["media_id", "clip_id"], "left_anti").select("clip_id", "media_id")


def resolve_windows(asked: DataFrame, u: DataFrame) -> DataFrame:
    """Final windows (media_id, id, start_ms, end_ms).

    asked: media_id, id, cur_start, cur_end (now), set_start, set_end (explicit, or null), reach (the
    furthest absorbed end, or null), lead_ms, tail_ms, snap.
    """
    start = F.coalesce("set_start", F.col("cur_start") - F.col("lead_ms"))
    end = F.greatest(F.coalesce("set_end", "cur_end"), "reach") + F.when(F.col("set_end").isNull() & F.col("reach").isNull(), F.col("tail_ms")).otherwise(0)
    of = asked.select("media_id", "id", "snap", start.alias("a"), end.alias("b"))

    def snapped(df: DataFrame, name: str, mark: str) -> DataFrame:
        points = df.withColumnRenamed(name, "t")
        met = nearest(points, u.select("media_id", F.col(mark).alias("mark")), SNAP)
        return met.withColumn(name, F.when(F.col("snap"), F.col("snapped")).otherwise(F.col("t"))).drop("t", "snapped")

    met = snapped(snapped(of, "a", "start_ms"), "b", "end_ms").withColumn("start_ms", F.greatest(F.lit(0).cast("long"), "a"))
    return met.select("media_id", "id", "start_ms", F.greatest(F.col("start_ms") + LEAST, F.col("b")).alias("end_ms"))


def apply_adjustments(clips: DataFrame, plan: DataFrame, u: DataFrame, silences: DataFrame, strict: bool = True) -> DataFrame:
    """clips after a plan: removed and absorbed ones go, adjusted ones get a new window, cuts, text and score.

    plan: media_id, clip_id, set_start, set_end, remove, absorb (array of clip ids), lead_ms, tail_ms, snap and
    fingerprint. Ids and indices stay, and nothing is sorted anew. Absorbed ids that aren't there are passed over.
    """
    if strict:
        _stop_if_any(unknown_adjustments(plan, clips), "adjusted clips that are not there")
        _stop_if_any(stale_plans(plan, clips), "the plan was made for other clips of")
    parts = plan.select("media_id", F.col("clip_id").alias("by"), F.explode("absorb").alias("clip_id"))
    reach = parts.join(clips.select("media_id", "clip_id", "end_ms"), ["media_id", "clip_id"]).groupBy("media_id", F.col("by").alias("clip_id")).agg(F.max("end_ms").alias("reach"))
    gone = plan.where("remove").select("media_id", "clip_id").union(parts.select("media_id", "clip_id")).distinct()
    left = clips.join(gone, ["media_id", "clip_id"], "left_anti")
    told = plan.select("media_id", "clip_id", "set_start", "set_end", "lead_ms", "tail_ms", "snap").join(reach, ["media_id", "clip_id"], "left")
    met = left.join(told, ["media_id", "clip_id"], "left")
    as_is = met.where("snap is null").select(*clips.columns)
    asked = met.where("snap is not null")
    windows = resolve_windows(asked.select("media_id", F.struct("clip_id", "clip_index", "pad_ms").alias("id"), F.col("start_ms").alias("cur_start"), F.col("end_ms").alias("cur_end"), "set_start", "set_end", "reach", "lead_ms", "tail_ms", "snap"), u)
    windows = windows.select("media_id", F.col("id").alias("clip"), F.col("start_ms").alias("w_start"), F.col("end_ms").alias("w_end"))
    windows = Kept(u.sparkSession).keep(windows)  # measured here, then joined twice
    most = longest(windows, "w_start", "w_end")
    new = S.window_text(S.with_cuts(windows, silences, w_most=most), u, w_most=most).withColumn("score", clip_score(F.col("text"), F.col("w_end") - F.col("w_start")))
    new = new.select("media_id", "clip.clip_id", "clip.clip_index", F.col("w_start").alias("start_ms"), F.col("w_end").alias("end_ms"), "text", "score", "cuts", "clip.pad_ms")
    return as_is.unionByName(new.select(*clips.columns))


# ---- selections ----


def check_selection(selection: DataFrame, u: DataFrame, least: int = 2000, most: int = 60_000) -> DataFrame:
    """selection (media_id, pos, set_start, set_end and others) with start_ms and end_ms snapped to speech, and error.

    error is null, or the first that applies: missing, order, outside (the speech, by more than the
    tolerance), short or long (after snapping).
    """
    limit = u.groupBy("media_id").agg(F.max_by("end_ms", "seq").alias("_limit"))
    s = selection.join(limit, "media_id", "left")
    s = s.withColumn("error", F.when(F.col("set_start").isNull() | F.col("set_end").isNull(), "missing").when(F.col("set_end") <= F.col("set_start"), "order").when((F.col("set_start") < 0) | (F.col("set_end") > F.coalesce("_limit", F.lit(0)) + SELECTION_SNAP), "outside"))
    rest = [c for c in s.columns if c not in ("media_id", "error", "set_start", "set_end", "_limit")]
    held = s.select("media_id", F.struct(*rest).alias("id"), "error", "set_start", "set_end", F.col("set_start").alias("t"))
    first = nearest(held, u.select("media_id", F.col("start_ms").alias("mark")), SELECTION_SNAP).withColumnRenamed("snapped", "start_ms").withColumn("t", F.col("set_end"))
    both = nearest(first, u.select("media_id", F.col("end_ms").alias("mark")), SELECTION_SNAP).withColumnRenamed("snapped", "end_ms")
    long = F.col("end_ms") - F.col("start_ms")
    error = F.coalesce("error", F.when(long < least, "short").when(long > most, "long"))
    return both.select("media_id", "id.*", "start_ms", "end_ms", error.alias("error"))


def load_selection(selection: DataFrame, u: DataFrame, least: int = 2000, most: int = 60_000) -> DataFrame:
    """The checked selection; raises on the first entry that can't be used, or if there is none."""
    if selection.isEmpty():
        raise ValueError("a selection needs at least one clip")
    checked = check_selection(selection, u, least, most)
    _stop_if_any(checked.where("error is not null").select(F.concat_ws(" ", F.lit("#"), F.col("pos").cast("string"), "error")), "selected clips that can't be used")
    return checked.drop("error")


def overlapping_neighbours(clips: DataFrame) -> DataFrame:
    """(media_id, title, next_title) of clips (media_id, start_ms, end_ms, title) that reach into the next; a clip without title is named by its second."""
    w = W.partitionBy("media_id").orderBy("start_ms", "end_ms")
    name = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.concat(F.bround(F.col("start_ms") / 1000, 0).cast("long").cast("string"), F.lit("s")))
    named = clips.withColumn("_name", name)
    return named.select("media_id", F.col("_name").alias("title"), F.lead("_name").over(w).alias("next_title"), (F.lead("start_ms").over(w) < F.col("end_ms")).alias("hit")).where("hit").drop("hit")
