"""Queries over transcripts: interval algebra, joins, segmentation, clips."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import editorial as E
from ..operators import intervals as I
from ..operators import segment as S
from ..operators import speakers as V
from ..sources import tables
from .prelude import GRID, INSIDE, KEEP, POINTS, SPLIT, TEXTS, UTTERANCES, WINDOWS, WORDS, score


def _base(spark, d):
    u = tables.utterances(spark, d)
    return u, tables.silences(u), tables.media(u)


def grid(media: DataFrame, step: int = 15_000) -> DataFrame:
    """Even windows of each medium: media_id, clip, w_start, w_end."""
    each = media.withColumn("clip", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("total_ms") / step).cast("long"))))
    return each.select("media_id", "clip", (F.col("clip") * step).alias("w_start"), F.least((F.col("clip") + 1) * step, F.col("total_ms")).alias("w_end")).where("w_end > w_start")


def f1(spark, d):
    """Neighbouring five-second marks against utterances: strict overlap."""
    u, _, _ = _base(spark, d)
    marks = u.withColumns({"a": F.lit(5_000), "b": F.lit(10_000)})
    return marks.select("media_id", "seq", I.overlaps("start_ms", "end_ms", "a", "b").alias("overlaps"))


def f2(spark, d):
    _, s, m = _base(spark, d)
    return S.boundaries(s, m)


def f5(spark, d):
    u = _base(spark, d)[0]
    return u.select("media_id", "seq", T.ends_sentence(F.col("text")).alias("sentence_end"), T.word_count(F.col("text")).alias("n_words"), T.hook_count(F.col("text")).alias("n_hooks"))


def i1(spark, d):
    _, s, m = _base(spark, d)
    return I.clip_join(grid(m), s, 1).select("media_id", "clip", "start_ms", "end_ms")


def i2(spark, d):
    return I.shrink(_base(spark, d)[1], 150)


def i3(spark, d):
    _, s, m = _base(spark, d)
    return I.complement(S.boundaries(s, m), m, span=I.SPAN_MS)


def i4(spark, d):
    """Events of a user within two hours of each other, as islands."""
    e = tables.read(spark, d, "events")
    ms = (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long")
    return I.merge_gap(e.select(F.col("user_id").alias("media_id"), ms.alias("start_ms"), ms.alias("end_ms")), 7_200_000, span=90 * 86_400_000)


def i4_turns(spark, d):
    """Turns that follow their own speaker within 250 ms joined to the turn just before."""
    return I.merge_turns(_base(spark, d)[0], 250, span=I.SPAN_MS)


def _clips_of_grid(spark, d):
    _, s, m = _base(spark, d)
    return S.with_cuts(grid(m), s)


def i5(spark, d):
    c = _clips_of_grid(spark, d).withColumn("r", F.explode(I.keep_ranges(F.col("w_start"), F.col("w_end"), F.col("cuts"), 150)))
    return c.select("media_id", "clip", F.col("r.start_ms").alias("start_ms"), F.col("r.end_ms").alias("end_ms"))


def i11(spark, d):
    c = _clips_of_grid(spark, d).withColumn("k", I.total(I.keep_ranges(F.col("w_start"), F.col("w_end"), F.col("cuts"), 150)))
    return c.select("media_id", "clip", F.col("k").alias("final_ms"), F.greatest(F.lit(0).cast("long"), F.col("w_end") - F.col("w_start") - F.col("k")).alias("removed_ms"))


def i9(spark, d):
    """Silences of a medium and its user turns as one ordered list of cuts."""
    u, s, _ = _base(spark, d)
    both = s.select("media_id", "start_ms", "end_ms").unionByName(u.where("speaker = 'user'").select("media_id", "start_ms", "end_ms"))
    lists = both.groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("start_ms", "end_ms"))).alias("cuts"))
    return lists.select("media_id", F.size("cuts").alias("n"), F.array_join(F.transform("cuts", lambda c: F.concat(c["start_ms"].cast("string"), F.lit("-"), c["end_ms"].cast("string"))), ",").alias("cuts"))


def i10(spark, d):
    """Utterance starts in clip time of the grid clip that holds them."""
    u, s, m = _base(spark, d)
    c = S.with_cuts(grid(m), s).withColumn("ranges", I.keep_ranges(F.col("w_start"), F.col("w_end"), F.col("cuts"), 150))
    t = u.select("media_id", "seq", F.col("start_ms").alias("t"))
    met = I.meet(c, t, ("w_start", "w_end"), ("t", "t"), (F.col("t") >= F.col("w_start")) & (F.col("t") < F.col("w_end")))
    return met.select("media_id", "seq", "clip", I.remap(F.col("t"), F.col("ranges")).alias("clip_ms"))


def i13(spark, d):
    u, s, m = _base(spark, d)
    return S.split_windows(I.complement(S.boundaries(s, m), m), S.cut_points(u, s), most=20_000)


def i14(spark, d):
    """Best cut of each grid window, borders included."""
    u, s, m = _base(spark, d)
    p = S.cut_points(u, s).select("media_id", "time_ms", "quality")
    met = I.meet(grid(m), p, ("w_start", "w_end"), ("time_ms", "time_ms"), F.col("time_ms").between(F.col("w_start"), F.col("w_end")))
    return met.groupBy("media_id", "clip").agg(F.max_by("time_ms", F.struct("quality", "time_ms")).alias("time_ms"), F.max("quality").alias("quality"))


def j1(spark, d):
    u, _, m = _base(spark, d)
    return S.window_text(grid(m), u)


def j2(spark, d):
    _, s, m = _base(spark, d)
    return I.clip_join(grid(m), s, 800).select("media_id", "clip", "start_ms", "end_ms")


def c2(spark, d):
    u, s, _ = _base(spark, d)
    return S.cut_points(u, s)


def j4(spark, d):
    """Grid borders snapped to the nearest utterance start within 2.5 s."""
    u, _, m = _base(spark, d)
    points = grid(m).select("media_id", F.col("clip").alias("id"), F.col("w_start").alias("t"))
    return I.nearest(points, u.select("media_id", F.col("start_ms").alias("mark")), 2500)


def j5(spark, d):
    """Speaker of every third turn forgotten, then filled from the nearest known by start; ties to the earlier."""
    u = _base(spark, d)[0].select("media_id", "seq", "start_ms", F.when(F.col("seq") % 3 != 2, F.col("speaker")).alias("label"))
    return V.fill_gaps(u, span=I.SPAN_MS).select("media_id", "seq", "label")


def j6(spark, d):
    u, _, m = _base(spark, d)
    return E.speaker_totals(grid(m), u)


def j17(spark, d):
    """Grid windows grown by 3 s: neighbours that overlap."""
    g = grid(_base(spark, d)[2]).withColumn("w_end", F.col("w_end") + F.when(F.col("clip") % 2 == 0, 3000).otherwise(0))
    w = W.partitionBy("media_id").orderBy("w_start")
    return g.select("media_id", "clip", F.lead("clip").over(w).alias("next_clip"), (F.lead("w_start").over(w) < F.col("w_end")).alias("hit")).where("hit").drop("hit")


def _asked(g: DataFrame, start, end, snap) -> DataFrame:
    none = F.lit(None).cast("long")
    of = {"id": F.col("clip"), "cur_start": F.col("w_start"), "cur_end": F.col("w_end"), "set_start": start, "set_end": end, "reach": none, "lead_ms": F.lit(E.LEAD).cast("long"), "tail_ms": F.lit(E.TAIL).cast("long"), "snap": snap}
    return g.select("media_id", *[c.alias(n) for n, c in of.items()])


def i12(spark, d):
    """Grid windows resolved: 5 s of lead, 3 s of tail, snapped to utterance borders, 1 s at least."""
    u, _, m = _base(spark, d)
    none = F.lit(None).cast("long")
    return E.resolve_windows(_asked(grid(m), none, none, F.lit(True)), u).withColumnRenamed("id", "clip")


def i12_every(spark, d):
    """Every grid window resolved: explicit borders stand without lead or tail, and snapping can be off."""
    u, _, m = _base(spark, d)
    start, end = F.when(F.col("clip") % 3 == 1, F.col("w_start") + 400), F.when(F.col("clip") % 4 == 3, F.col("w_end") - 400)
    return E.resolve_windows(_asked(grid(m), start, end, F.col("clip") % 5 != 0), u).withColumnRenamed("id", "clip")


def m1(spark, d):
    u = _base(spark, d)[0]
    return u.select("media_id", "seq", T.clip_score(F.col("text"), F.col("end_ms") - F.col("start_ms")).alias("score"))


def c1(spark, d):
    out = S.build_clips(*_base(spark, d))
    return out.select("media_id", "clip_index", "start_ms", "end_ms", "text", "score", "kept_ms", "removed_ms")


def w1(spark, d):
    """The three best clips of each medium, in order of time."""
    return S.build_clips(*_base(spark, d), most_clips=3).select("media_id", "clip_index", "start_ms", "score")


def w2(spark, d):
    """Turns at a change of speaker: the label differs from a neighbour's, edges don't count."""
    return V.transitions(_base(spark, d)[0], V.ROWS).select("media_id", "seq", "transition")


def w4(spark, d):
    """Speakers renamed S1, S2... by first appearance."""
    u = _base(spark, d)[0].select("media_id", "seq", F.col("speaker").alias("cluster"))
    return V.cluster_names(u).withColumnRenamed("cluster", "speaker")


def a1(spark, d):
    u = _base(spark, d)[0]
    return u.groupBy("speaker").agg(F.round(F.sum(F.col("end_ms") - F.col("start_ms")) / 1000, 1).alias("seconds"), F.count("*").alias("n"))


def a3(spark, d):
    """The first five longer sayings of each speaker in each medium."""
    u = _base(spark, d)[0].where(F.length("text") >= 25)
    r = u.withColumn("k", F.row_number().over(W.partitionBy("media_id", "speaker").orderBy("seq"))).where("k <= 5")
    return r.select("media_id", "speaker", "k", "text")


def a5(spark, d):
    u = _base(spark, d)[0]
    told = u.groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("t"))
    return told.select("media_id", F.array_join(F.transform("t", lambda x: x["text"]), " ").alias("text"))


def a6(spark, d):
    """Share of a persona (user) in each grid window, and the verdict on it; a window without speech is clean."""
    u, _, m = _base(spark, d)
    return E.persona_report(grid(m), u, "user")


def a14(spark, d):
    """Fingerprint of each medium's windows in their order: id and borders with two decimals, digested."""
    g = grid(_base(spark, d)[2]).select("media_id", (F.col("clip") + 1).alias("clip_index"), F.format_string("clip_%03d", F.col("clip") + 1).alias("clip_id"), F.col("w_start").alias("start_ms"), F.col("w_end").alias("end_ms"))
    return E.fingerprints(g)


def a16(spark, d):
    return _base(spark, d)[0].groupBy("media_id").agg(F.max_by("end_ms", "seq").alias("limit_ms"))


def i7(spark, d):
    """What a persona (user) says in each grid window: joined over 500 ms, trimmed 100 ms off inner edges, 300 ms at least."""
    u, _, m = _base(spark, d)
    return E.keep_spans(grid(m), u, "user").select("media_id", "clip", "start_ms", "end_ms")


def i6(spark, d):
    """What i7 leaves of each grid window, if longer than 50 ms."""
    u, _, m = _base(spark, d)
    g = grid(m)
    keep = i7(spark, d).unionByName(g.select("media_id", "clip", F.col("w_end").alias("start_ms"), F.col("w_end").alias("end_ms")))
    w = W.partitionBy("media_id", "clip").orderBy("start_ms", "end_ms")
    met = keep.join(g, ["media_id", "clip"]).select("media_id", "clip", F.coalesce(F.lag("end_ms").over(w), F.col("w_start")).alias("a"), F.col("start_ms").alias("b"))
    return met.where("b - a > 50").select("media_id", "clip", F.col("a").alias("start_ms"), F.col("b").alias("end_ms"))


def i8(spark, d):
    """Turns of others than the persona (user): joined over 400 ms, 120 ms in at each side, 1.6 s at least."""
    u, _, m = _base(spark, d)
    foreign = I.merge_gap(I.clip_join(grid(m), u.where("speaker <> 'user'"), 1), 400, ("media_id", "clip"))
    return I.shrink(foreign, 120, 1600).select("media_id", "clip", "start_ms", "end_ms")


def k4(spark, d):
    """Briefing: [second] (mm:ss) text, line by line."""
    u = _base(spark, d)[0]
    line = F.concat(F.lit("["), F.floor(F.col("start_ms") / 1000).cast("string"), F.lit("s] ("), T.short_clock(F.col("start_ms")), F.lit(") "), F.col("text"))
    lists = u.select("media_id", F.struct("seq", line.alias("line")).alias("x")).groupBy("media_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return lists.select("media_id", F.array_join(F.transform("x", lambda e: e["line"]), "\n").alias("briefing"))


def k3(spark, d):
    """One SRT document for each medium, and read again by s14."""
    u = _base(spark, d)[0].where("text <> '' and end_ms > start_ms").withColumn("n", F.row_number().over(W.partitionBy("media_id").orderBy("seq")))
    block = F.concat(F.col("n").cast("string"), F.lit("\n"), T.srt_time(F.col("start_ms")), F.lit(" --> "), T.srt_time(F.col("end_ms")), F.lit("\n"), F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("\n"))
    lists = u.select("media_id", F.struct("n", block.alias("b")).alias("x")).groupBy("media_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return lists.select("media_id", F.array_join(F.transform("x", lambda e: e["b"]), "\n").alias("srt"))


def s14(spark, d):
    """Cues of SRT documents; malformed blocks are skipped."""
    from ..sources.formats import parse_srt

    return parse_srt(k3(spark, d))


QUERIES = {
    "f1_overlap_predicate": f1, "f2_boundary_filter": f2, "f5_x1_a13_sentence_words_hooks": f5, "i1_clip_to_window": i1, "i2_shrink": i2, "i3_complement": i3, "i4_merge_gap_events": i4, "i4_merge_gap_turns": i4_turns,
    "i5_keep_ranges": i5, "i6_complement_of_keep": i6, "i7_keep_spans": i7, "i8_foreign_turns": i8, "i9_union_of_cuts": i9, "i10_time_remap": i10, "i11_durations": i11, "i12_resolve_window": i12, "i12_resolve_every_window": i12_every, "i13_greedy_split": i13, "i14_best_cut": i14,
    "j1_window_text": j1, "j2_window_silences": j2, "c2_j3_m2_cut_points": c2, "j4_nearest_snap": j4, "j5_label_gap_fill": j5, "j6_speaker_totals": j6, "j17_neighbour_overlap": j17,
    "m1_clip_score": m1, "c1_build_clips": c1, "t1_w1_best_clips": w1, "w2_transition_zone": w2, "w4_first_appearance": w4, "a1_seconds_by_speaker": a1, "a3_first_samples": a3, "a5_ordered_text": a5, "a6_persona_report": a6, "a14_fingerprint": a14, "a16_last_end": a16,
    "k3_srt_text": k3, "k4_briefing": k4, "s14_srt_parse": s14,
}

_U = "WITH RECURSIVE" + UTTERANCES
_G = _U + "," + GRID
_GC = _G + ", cw AS (SELECT * FROM grid)," + INSIDE + "," + KEEP
_OWN = """, own AS (SELECT g.media_id, g.clip, w_start, w_end, greatest(start_ms, w_start) AS s, least(end_ms, w_end) AS e FROM grid g JOIN u ON u.media_id = g.media_id AND start_ms < w_end AND end_ms > w_start AND {who} WHERE least(end_ms, w_end) - greatest(start_ms, w_start) >= 1),
own1 AS (SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY media_id, clip ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= {gap} THEN 0 ELSE 1 END AS f FROM own),
own2 AS (SELECT *, sum(f) OVER (PARTITION BY media_id, clip ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM own1),
isl AS (SELECT media_id, clip, w_start, w_end, min(s) AS s, max(e) AS e FROM own2 GROUP BY media_id, clip, w_start, w_end, k)"""
_I7 = _G + _OWN.format(who="speaker = 'user'", gap=500) + ", keep AS (SELECT * FROM (SELECT media_id, clip, w_start, w_end, CASE WHEN s > w_start THEN s + 100 ELSE s END AS start_ms, CASE WHEN e < w_end THEN e - 100 ELSE e END AS end_ms FROM isl) WHERE end_ms - start_ms >= 300)"
_CLIPS = _U + "," + WINDOWS + "," + POINTS + "," + SPLIT + ", cw AS (SELECT media_id, start_ms AS clip, start_ms AS w_start, end_ms AS w_end FROM pieces WHERE end_ms - start_ms >= 2000)," + INSIDE + "," + KEEP + "," + TEXTS + f"""
, sc AS (SELECT media_id, clip, w_start, w_end, text, {score("text", "(w_end - w_start)")} AS score FROM cw JOIN txt USING (media_id, clip) WHERE text <> ''),
rk AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY score DESC, w_start) AS rk FROM sc),
kt AS (SELECT media_id, clip, CAST(sum(b - a) AS BIGINT) AS kept_ms FROM kept GROUP BY ALL)"""
_W2 = "coalesce(lag(speaker) OVER w <> speaker, false) OR coalesce(lead(speaker) OVER w <> speaker, false)"
_J6 = "SELECT g.media_id, clip, speaker, CAST(sum(least(end_ms, w_end) - greatest(start_ms, w_start)) AS BIGINT) AS ms FROM grid g JOIN u ON u.media_id = g.media_id AND start_ms < w_end AND end_ms > w_start GROUP BY ALL"
_SNAP = "(SELECT arg_min({m}, (abs({m} - t), {m})) FROM u WHERE u.media_id = p.media_id AND abs({m} - t) <= 2500)"
_CLOCK = "format('{{:02d}}:{{:02d}}:{{:02d}},{{:03d}}', {0} // 3600000, {0} // 60000 % 60, {0} // 1000 % 60, {0} % 1000)"
ORACLE = {
    "f1_overlap_predicate": _U + " SELECT media_id, seq, start_ms < 10000 AND end_ms > 5000 AS overlaps FROM u",
    "f2_boundary_filter": _U + "," + WINDOWS + " SELECT * FROM bnd",
    "f5_x1_a13_sentence_words_hooks": _U + rf" SELECT media_id, seq, regexp_matches(text, '[.!?…]\s*$') AS sentence_end, CAST(len({WORDS.format('text')}) AS INT) AS n_words, CAST(" + " + ".join(f"CASE WHEN contains(lower(text), '{h}') THEN 1 ELSE 0 END" for h in T.HOOKS) + " AS INT) AS n_hooks FROM u",
    "i1_clip_to_window": _G + " SELECT g.media_id, clip, greatest(start_ms, w_start) AS start_ms, least(end_ms, w_end) AS end_ms FROM grid g JOIN sil s ON s.media_id = g.media_id AND start_ms < w_end AND end_ms > w_start",
    "i2_shrink": _U + " SELECT media_id, start_ms + 150 AS start_ms, end_ms - 150 AS end_ms FROM sil WHERE end_ms - start_ms - 300 >= 50",
    "i3_complement": _U + "," + WINDOWS + " SELECT * FROM win",
    "i4_merge_gap_events": """WITH e AS (SELECT user_id AS media_id, epoch_us(ts) // 1000 AS t FROM events),
f AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY media_id ORDER BY t) <= 7200000 THEN 0 ELSE 1 END AS f FROM e),
g AS (SELECT *, sum(f) OVER (PARTITION BY media_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM f)
SELECT media_id, min(t) AS start_ms, max(t) AS end_ms, count(*) AS n FROM g GROUP BY media_id, k""",
    "i4_merge_gap_turns": _U + """, f AS (SELECT *, CASE WHEN lag(speaker) OVER w = speaker AND start_ms - lag(end_ms) OVER w <= 250 THEN 0 ELSE 1 END AS f FROM u WINDOW w AS (PARTITION BY media_id ORDER BY start_ms, seq)),
g AS (SELECT *, sum(f) OVER (PARTITION BY media_id ORDER BY start_ms, seq ROWS UNBOUNDED PRECEDING) AS k FROM f)
SELECT media_id, speaker, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n FROM g GROUP BY media_id, speaker, k""",
    "i5_keep_ranges": _GC + " SELECT media_id, clip, a AS start_ms, b AS end_ms FROM kept",
    "i6_complement_of_keep": _I7 + """, e AS (SELECT media_id, clip, w_start, start_ms, end_ms FROM keep UNION ALL SELECT media_id, clip, w_start, w_end, w_end FROM grid)
SELECT media_id, clip, a AS start_ms, b AS end_ms FROM (SELECT media_id, clip, coalesce(lag(end_ms) OVER (PARTITION BY media_id, clip ORDER BY start_ms, end_ms), w_start) AS a, start_ms AS b FROM e) WHERE b - a > 50""",
    "i7_keep_spans": _I7 + " SELECT media_id, clip, start_ms, end_ms FROM keep",
    "i8_foreign_turns": _G + _OWN.format(who="speaker <> 'user'", gap=400) + " SELECT media_id, clip, s + 120 AS start_ms, e - 120 AS end_ms FROM isl WHERE e - s - 240 >= 1600",
    "i9_union_of_cuts": _U + ", b AS (SELECT * FROM sil UNION ALL SELECT media_id, start_ms, end_ms FROM u WHERE speaker = 'user') SELECT media_id, CAST(count(*) AS INT) AS n, string_agg(start_ms || '-' || end_ms, ',' ORDER BY start_ms, end_ms) AS cuts FROM b GROUP BY media_id",
    "i10_time_remap": _GC + """, t AS (SELECT g.media_id, seq, clip, start_ms AS t FROM grid g JOIN u ON u.media_id = g.media_id AND start_ms >= w_start AND start_ms < w_end),
r AS (SELECT *, coalesce(sum(b - a) OVER (PARTITION BY media_id, clip ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM kept)
SELECT t.media_id, t.seq, t.clip, CAST((SELECT arg_min(gone + greatest(0, t.t - a), a) FROM r WHERE r.media_id = t.media_id AND r.clip = t.clip AND t.t <= b) AS BIGINT) AS clip_ms FROM t""",
    "i11_durations": _GC + " SELECT cw.media_id, cw.clip, CAST(sum(b - a) AS BIGINT) AS final_ms, CAST(greatest(0, min(w_end - w_start) - sum(b - a)) AS BIGINT) AS removed_ms FROM cw JOIN kept k ON k.media_id = cw.media_id AND k.clip = cw.clip GROUP BY ALL",
    "i12_resolve_every_window": _G + ", a AS (SELECT media_id, clip, clip % 5 <> 0 AS snap, CASE WHEN clip % 3 = 1 THEN w_start + 400 ELSE w_start - 5000 END AS t FROM grid), b AS (SELECT media_id, clip, clip % 5 <> 0 AS snap, CASE WHEN clip % 4 = 3 THEN w_end - 400 ELSE w_end + 3000 END AS t FROM grid), sa AS (SELECT media_id, clip, greatest(0, CASE WHEN snap THEN coalesce(" + _SNAP.format(m="start_ms") + ", t) ELSE t END) AS start_ms FROM a p), sb AS (SELECT media_id, clip, CASE WHEN snap THEN coalesce(" + _SNAP.format(m="end_ms") + ", t) ELSE t END AS e FROM b p) SELECT sa.media_id, sa.clip, sa.start_ms, greatest(sa.start_ms + 1000, e) AS end_ms FROM sa JOIN sb USING (media_id, clip)",
    "i12_resolve_window": _G + ", a AS (SELECT media_id, clip, w_start - 5000 AS t FROM grid), b AS (SELECT media_id, clip, w_end + 3000 AS t FROM grid), sa AS (SELECT media_id, clip, greatest(0, coalesce(" + _SNAP.format(m="start_ms") + ", t)) AS start_ms FROM a p), sb AS (SELECT media_id, clip, coalesce(" + _SNAP.format(m="end_ms") + ", t) AS e FROM b p) SELECT sa.media_id, sa.clip, sa.start_ms, greatest(sa.start_ms + 1000, e) AS end_ms FROM sa JOIN sb USING (media_id, clip)",
    "i13_greedy_split": _U + "," + WINDOWS + "," + POINTS + "," + SPLIT.replace("60000", "20000") + " SELECT * FROM pieces",
    "i14_best_cut": _G + "," + POINTS + " SELECT g.media_id, clip, arg_max(time_ms, (quality, time_ms)) AS time_ms, CAST(max(quality) AS BIGINT) AS quality FROM grid g JOIN pts p ON p.media_id = g.media_id AND time_ms BETWEEN w_start AND w_end GROUP BY ALL",
    "j1_window_text": _G + ", cw AS (SELECT * FROM grid)," + TEXTS + " SELECT cw.*, coalesce(text, '') AS text FROM cw LEFT JOIN txt USING (media_id, clip)",
    "j2_window_silences": _G + ", cw AS (SELECT * FROM grid)," + INSIDE + " SELECT * FROM inside",
    "c2_j3_m2_cut_points": _U + "," + POINTS + " SELECT * REPLACE (CAST(quality AS BIGINT) AS quality) FROM pts",
    "j4_nearest_snap": _G + ", p AS (SELECT media_id, clip AS id, w_start AS t FROM grid) SELECT media_id, id, t, coalesce(" + _SNAP.format(m="start_ms") + ", t) AS snapped FROM p",
    "j5_label_gap_fill": _U + ", k AS (SELECT * FROM u WHERE seq % 3 <> 2) SELECT media_id, seq, (SELECT arg_min(speaker, (abs(k.start_ms - u.start_ms), k.start_ms)) FROM k WHERE k.media_id = u.media_id) AS label FROM u",
    "j6_speaker_totals": _G + " " + _J6,
    "j17_neighbour_overlap": _G + ", g AS (SELECT media_id, clip, w_start, w_end + CASE WHEN clip % 2 = 0 THEN 3000 ELSE 0 END AS w_end FROM grid), n AS (SELECT *, lead(clip) OVER w AS next_clip, lead(w_start) OVER w AS ns FROM g WINDOW w AS (PARTITION BY media_id ORDER BY w_start)) SELECT media_id, clip, next_clip FROM n WHERE ns < w_end",
    "m1_clip_score": _U + f" SELECT media_id, seq, {score('text', '(end_ms - start_ms)')} AS score FROM u",
    "c1_build_clips": _CLIPS + " SELECT media_id, CAST(row_number() OVER (PARTITION BY media_id ORDER BY w_start) AS INT) AS clip_index, w_start AS start_ms, w_end AS end_ms, text, score, kept_ms, greatest(0, w_end - w_start - kept_ms) AS removed_ms FROM rk JOIN kt USING (media_id, clip) WHERE rk <= 60",
    "t1_w1_best_clips": _CLIPS + " SELECT media_id, CAST(row_number() OVER (PARTITION BY media_id ORDER BY w_start) AS INT) AS clip_index, w_start AS start_ms, score FROM rk WHERE rk <= 3",
    "w2_transition_zone": _U + f" SELECT media_id, seq, {_W2} AS transition FROM u WINDOW w AS (PARTITION BY media_id ORDER BY seq)",
    "w4_first_appearance": _U + ", f AS (SELECT media_id, speaker, min(seq) AS s FROM u GROUP BY ALL) SELECT media_id, speaker, 'S' || row_number() OVER (PARTITION BY media_id ORDER BY s, speaker) AS label FROM f",
    "a1_seconds_by_speaker": _U + " SELECT speaker, round(CAST(sum(end_ms - start_ms) AS DOUBLE) / 1000, 1) AS seconds, count(*) AS n FROM u GROUP BY speaker",
    "a3_first_samples": _U + ", r AS (SELECT media_id, speaker, CAST(row_number() OVER (PARTITION BY media_id, speaker ORDER BY seq) AS INT) AS k, text FROM u WHERE length(text) >= 25) SELECT * FROM r WHERE k <= 5",
    "a5_ordered_text": _U + " SELECT media_id, string_agg(text, ' ' ORDER BY seq) AS text FROM u GROUP BY media_id",
    "a6_persona_report": _G + f""", t AS ({_J6}), s AS (SELECT media_id, clip, coalesce(sum(ms) FILTER (speaker = 'user'), 0) AS p, coalesce(sum(ms) FILTER (speaker <> 'user'), 0) AS o FROM grid LEFT JOIN t USING (media_id, clip) GROUP BY ALL),
r AS (SELECT *, CAST(o AS DOUBLE) / CAST(CASE WHEN p + o > 0 THEN p + o ELSE 1000 END AS DOUBLE) AS x FROM s)
SELECT media_id, clip, round(CAST(p AS DOUBLE) / 1000, 1) AS persona_s, round(CAST(o AS DOUBLE) / 1000, 1) AS outros_s, CAST(round_even(x * 100, 0) AS BIGINT) AS outros_pct, CASE WHEN x < 0.15 THEN 'limpo' WHEN x <= 0.5 THEN 'contaminado' ELSE 'comprometido' END AS status FROM r""",
    "a14_fingerprint": _G + """, c AS (SELECT media_id, clip, 'clip_' || format('{:03d}', clip + 1) AS id, (w_start + 5) // 10 AS a, (w_end + 5) // 10 AS b FROM grid)
SELECT media_id, substr(sha256(string_agg(format('{}:{}.{:02d}:{}.{:02d};', id, a // 100, a % 100, b // 100, b % 100), '' ORDER BY clip)), 1, 16) AS fingerprint FROM c GROUP BY media_id""",
    "a16_last_end": _U + " SELECT media_id, arg_max(end_ms, seq) AS limit_ms FROM u GROUP BY media_id",
    "k3_srt_text": _U + ", n AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY seq) AS n FROM u WHERE text <> '' AND end_ms > start_ms) SELECT media_id, string_agg(n || chr(10) || " + _CLOCK.format("start_ms") + " || ' --> ' || " + _CLOCK.format("end_ms") + " || chr(10) || replace(text, chr(10), ' ') || chr(10), chr(10) ORDER BY n) AS srt FROM n GROUP BY media_id",
    "k4_briefing": _U + " SELECT media_id, string_agg('[' || (start_ms // 1000) || 's] (' || format('{:02d}:{:02d}', start_ms // 60000, start_ms // 1000 % 60) || ') ' || text, chr(10) ORDER BY seq) AS briefing FROM u GROUP BY media_id",
    "s14_srt_parse": _U + " SELECT media_id, CAST(row_number() OVER (PARTITION BY media_id ORDER BY seq) AS INT) AS n, start_ms, end_ms, trim(replace(text, chr(10), ' ')) AS text FROM u WHERE text <> '' AND end_ms > start_ms",
}
