"""Queries over adjusted clips, one speaker's parts, selections, and the documents that hold them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import editorial as E
from ..operators import intervals as I
from ..operators import segment as S
from ..shared import Kept
from ..sinks import documents as D
from ..sources import formats, tables
from .prelude import GRID, INSIDE, KEEP, TEXTS, UTTERANCES, score
from .segments import _base, grid


def base_clips(spark, d, base=None):
    """Grid windows as clips, with text, cuts and score. base: utterances, silences and media, if they are at hand."""
    u, s, m = base or _base(spark, d)
    c = S.with_cuts(S.window_text(grid(m), u), s).withColumn("score", S.clip_score(F.col("text"), F.col("w_end") - F.col("w_start")))
    c = c.withColumns({"clip_index": (F.col("clip") + 1).cast("int"), "clip_id": F.format_string("clip_%03d", F.col("clip") + 1), "pad_ms": F.lit(150).cast("long")})
    return c.select("media_id", "clip_id", "clip_index", F.col("w_start").alias("start_ms"), F.col("w_end").alias("end_ms"), "text", "score", "cuts", "pad_ms")


def plan_json(spark, d, base=None):
    """(media_id, json): an adjustment file for each medium, as its editor would write it.

    Of six clips in turn the first absorbs two, the fourth has a clock text as start and every second time an
    end in seconds, the fifth is removed. Every second medium's plan is frozen (no snapping).
    """
    u, _, m = base or _base(spark, d)
    g = grid(m)
    k, sec = F.col("clip") % 6, lambda ms: (ms / 1000).cast("string")
    name = lambda n: F.format_string("clip_%03d", F.col("clip") + 1 + n)
    at = F.floor(F.col("w_start") / 1000) + 1
    clock = F.format_string("%02d:%02d:%02d", F.floor(at / 3600), F.floor(at / 60) % 60, at % 60)
    entry = F.struct(F.when(k == 3, clock).alias("start"), F.when(F.col("clip") % 12 == 3, sec(F.col("w_end") - 400)).alias("end"), (k == 4).alias("remove"), F.when(k == 0, F.array(name(1), name(2))).alias("absorb"))
    lists = g.where("clip % 6 in (0, 3, 4)").groupBy("media_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name(0).alias("id"), entry.alias("e"))))).alias("clips"))
    now = E.fingerprints(g.select("media_id", "clip", name(0).alias("clip_id"), (F.col("clip") + 1).alias("clip_index"), F.col("w_start").alias("start_ms"), F.col("w_end").alias("end_ms")))
    return lists.join(now, "media_id").select("media_id", F.to_json(F.struct(F.col("fingerprint").alias("source_fingerprint"), (F.col("media_id") % 2 == 0).alias("snap"), F.lit(4.0).alias("context_lead_s"), "clips")).alias("json"))


def adjusted(spark, d):
    """Adjusted clips and utterances. Utterances, clips and plans are written once, as the checks and joins read each of them often."""
    kept = Kept(spark)
    u = kept.keep(tables.utterances(spark, d))
    base = u, tables.silences(u), tables.media(u)
    plan = kept.keep(formats.parse_adjustments(plan_json(spark, d, base)))
    return E.apply_adjustments(kept.keep(base_clips(spark, d, base)), plan, u, base[1]), u


def _told(clips):
    return clips.select("media_id", "clip_id", "clip_index", "start_ms", "end_ms", "text", "score", F.size("cuts").alias("n_cuts"), I.total(F.col("cuts")).alias("cut_ms"))


def c3(spark, d):
    """Adjustment files read and applied: windows, text, score and cuts of the clips that stay."""
    return _told(adjusted(spark, d)[0])


def c4(spark, d):
    """The user's parts of the adjusted clips: what is cut and what stays, without padding."""
    clips, u = adjusted(spark, d)
    c = E.apply_persona(Kept(spark).keep(clips), u, "user")
    k = S.kept_and_removed(F.col("start_ms"), F.col("end_ms"), F.col("cuts"), 0)
    return c.withColumn("k", k).select("media_id", "clip_id", "pad_ms", F.size("cuts").alias("n_cuts"), "k.kept_ms", "k.removed_ms")


def s10(spark, d):
    """Adjustment files read: clock texts and seconds as milliseconds."""
    a = formats.parse_adjustments(plan_json(spark, d))
    return a.select("media_id", "clip_id", "set_start", "set_end", "remove", F.array_join("absorb", " ").alias("absorb"), "lead_ms", "tail_ms", "snap", "error")


def f10(spark, d):
    """Adjustments for clips that aren't there, and plans made for other clips: those of the grid shifted by one clip."""
    clips = grid(_base(spark, d)[2]).select("media_id", F.format_string("clip_%03d", F.col("clip") + 1).alias("clip_id"), (F.col("clip") + 1).alias("clip_index"), F.col("w_start").alias("start_ms"), F.col("w_end").alias("end_ms"))
    fewer = clips.where("clip_index > 1")
    plan = formats.parse_adjustments(plan_json(spark, d))
    unknown = E.unknown_adjustments(plan, fewer).select("media_id", F.lit("unknown").alias("kind"), "clip_id")
    return unknown.union(E.stale_plans(plan, fewer).select("media_id", F.lit("stale"), F.lit("")))


def selection_json(spark, d):
    """(media_id, json): a selection for each medium, with each kind of mistake in turn."""
    g = grid(_base(spark, d)[2])
    k, a, b = F.col("clip") % 8, F.col("w_start"), F.col("w_end")
    start = F.when(k == 3, F.lit(-1000)).otherwise(a + F.when(k == 0, 1000).otherwise(0))
    end = F.when(k == 1, None).when(k == 2, start).when(k == 4, F.lit(10**9)).when(k == 5, a + 300).when(k == 6, a + 90_000).otherwise(b - F.when(k == 0, 1000).otherwise(0))
    item = F.struct((start / 1000).alias("start"), (end / 1000).alias("end"), F.concat(F.lit(" T"), F.col("clip").cast("string")).alias("title"))
    lists = g.groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("clip", item.alias("i")))).alias("x"))
    return lists.select("media_id", F.to_json(F.struct(F.transform("x", lambda e: e["i"]).alias("clips"))).alias("json"))


def f9(spark, d):
    """Selections read, snapped to speech within 3 s, and judged."""
    u, _, _ = _base(spark, d)
    return E.check_selection(formats.parse_selection(selection_json(spark, d)), u).select("media_id", "pos", "title", "start_ms", "end_ms", "error")


def t9(spark, d):
    """Usable selected clips in order of time, and which reach into the next."""
    u, _, _ = _base(spark, d)
    good = E.check_selection(formats.parse_selection(selection_json(spark, d)), u).where("error is null")
    return E.overlapping_neighbours(good.withColumn("title", F.when(F.col("pos") % 3 != 0, F.col("title"))))


def metadata(spark, d):
    """Metadata documents of grid clips, those of odd index rendered in even media."""
    u, _, m = _base(spark, d)
    c = base_clips(spark, d)
    c = c.withColumn("k", S.kept_and_removed(F.col("start_ms"), F.col("end_ms"), F.col("cuts"), 150)).select("media_id", "clip_id", "clip_index", "start_ms", "end_ms", "text", "score", "k.kept_ms", "k.removed_ms")
    return D.metadata_documents(c, u, m, c.where("clip_index % 2 = 1 and media_id % 2 = 0").select("media_id", "clip_id"))


def k2(spark, d):
    """Clips of metadata documents, written and read again."""
    return formats.parse_metadata(metadata(spark, d))


def k2_header(spark, d):
    j = metadata(spark, d).select("media_id", F.from_json("json", formats.METADATA).alias("m"))
    return j.select("media_id", "m.source", "m.total_duration", "m.clips_generated", "m.clips_planned", "m.transcription_engine", "m.language", "m.full_transcription")


def titles_json(spark, d):
    g = grid(_base(spark, d)[2]).where("clip % 3 = 0")
    record = F.struct(F.concat(F.lit("T "), F.col("clip").cast("string")).alias("titulo"), F.lit("<b>&").alias("descricao"), F.array(F.lit("a b"), F.lit("c")).alias("tags"), (F.col("clip") % 2 == 0).alias("estrela"))
    lists = g.groupBy("media_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.format_string("clip_%03d", F.col("clip") + 1), record)))).alias("clips"))
    return lists.select("media_id", F.to_json(F.struct("clips")).alias("json"))


def s12(spark, d):
    """Title files read."""
    return formats.parse_titles(titles_json(spark, d)).select("media_id", "clip_id", "titulo", "descricao", F.array_join("tags", "|").alias("tags"), "estrela")


def _report(spark, d):
    return D.report_rows(k2(spark, d), formats.parse_titles(titles_json(spark, d)))


def k8(spark, d):
    """Review rows: rendered clips, or all of a medium that has none, with their titles."""
    return _report(spark, d).withColumn("tags", F.array_join("tags", "|"))


def a9(spark, d):
    return D.report_totals(_report(spark, d))


def k8_payload(spark, d):
    """Review payloads: their size, and that nothing in them can close a script element."""
    p = D.report_payloads(_report(spark, d))
    return p.select("media_id", F.size(F.from_json("payload", "array<struct<id:string>>")).alias("n"), F.col("payload").rlike("[<>&]").alias("unsafe"))


def k12(spark, d):
    """The user's report of each grid window, printed in columns."""
    u, _, m = _base(spark, d)
    g = grid(m)
    times = g.select("media_id", "clip", F.format_string("clip_%03d", F.col("clip") + 1).alias("clip_id"), T.clock(F.col("w_start") / 1000).alias("start"), T.clock(F.col("w_end") / 1000).alias("end"))
    return D.persona_lines(E.persona_report(g, u, "user").join(times, ["media_id", "clip"]))


QUERIES = {
    "k12_persona_lines": k12, "c3_f10_f11_apply_adjustments": c3, "c4_f12_f18_apply_persona": c4, "s10_d4_adjustments_json": s10, "f10_f11_unfit_plans": f10, "f9_s11_j4_selection": f9, "t9_j17_selected_overlaps": t9, "k2_metadata_clips": k2, "k2_metadata_header": k2_header,
    "s12_titles_json": s12, "k8_f19_j12_report_rows": k8, "a9_report_totals": a9, "k8_k9_report_payload": k8_payload,
}

_G = "WITH RECURSIVE" + UTTERANCES + "," + GRID
_NAME = "'clip_' || format('{{:03d}}', {0} + 1)"
_NEAR = "coalesce((SELECT arg_min({m}, (abs({m} - {t}), {m})) FROM u WHERE u.media_id = p.media_id AND abs({m} - {t}) <= {tol}), {t})"
_ADJ = """, ab AS (SELECT a.media_id, a.clip, max(b.w_end) AS reach FROM grid a LEFT JOIN grid b ON b.media_id = a.media_id AND b.clip IN (a.clip + 1, a.clip + 2) WHERE a.clip % 6 = 0 GROUP BY ALL),
p AS (SELECT g.media_id, g.clip, media_id % 2 = 0 AS snap, CASE WHEN clip % 6 = 3 THEN (w_start // 1000 + 1) * 1000 ELSE w_start - 4000 END AS a,
  CASE WHEN clip % 12 = 3 THEN w_end - 400 WHEN reach IS NOT NULL THEN greatest(w_end, reach) ELSE w_end + 3000 END AS b FROM grid g LEFT JOIN ab USING (media_id, clip) WHERE clip % 6 IN (0, 3)),
q AS (SELECT media_id, clip, greatest(0, CASE WHEN snap THEN """ + _NEAR.format(m="start_ms", t="p.a", tol=2500) + " ELSE a END) AS w_start, CASE WHEN snap THEN " + _NEAR.format(m="end_ms", t="p.b", tol=2500) + """ ELSE b END AS b FROM p),
cw AS (SELECT media_id, clip, w_start, greatest(w_start + 1000, b) AS w_end FROM q UNION ALL SELECT media_id, clip, w_start, w_end FROM grid WHERE clip % 6 = 5)"""
_C3 = _G + _ADJ + "," + INSIDE + "," + TEXTS
_C4 = _G + _ADJ + "," + INSIDE.replace("inside AS", "inside0 AS") + """,
own AS (SELECT c.media_id, c.clip, w_start, w_end, greatest(start_ms, w_start) AS s, least(end_ms, w_end) AS e FROM cw c JOIN u ON u.media_id = c.media_id AND start_ms < w_end AND end_ms > w_start AND speaker = 'user' WHERE least(end_ms, w_end) - greatest(start_ms, w_start) >= 1),
own1 AS (SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY media_id, clip ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 500 THEN 0 ELSE 1 END AS f FROM own),
own2 AS (SELECT *, sum(f) OVER (PARTITION BY media_id, clip ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM own1),
isl AS (SELECT media_id, clip, w_start, w_end, min(s) AS s, max(e) AS e FROM own2 GROUP BY media_id, clip, w_start, w_end, k),
spans AS (SELECT * FROM (SELECT media_id, clip, w_start, CASE WHEN s > w_start THEN s + 100 ELSE s END AS s, CASE WHEN e < w_end THEN e - 100 ELSE e END AS e FROM isl) WHERE e - s >= 300),
edges AS (SELECT media_id, clip, w_start, s, e FROM spans UNION ALL SELECT media_id, clip, w_start, w_end, w_end FROM cw),
pcut AS (SELECT media_id, clip, a AS start_ms, s AS end_ms FROM (SELECT media_id, clip, coalesce(lag(e) OVER (PARTITION BY media_id, clip ORDER BY s, e), w_start) AS a, s FROM edges) WHERE s - a > 50),
inside AS (SELECT * FROM inside0 UNION ALL SELECT * FROM pcut),""" + KEEP.replace("start_ms + 150", "start_ms").replace("end_ms - 150", "end_ms").replace("end_ms - start_ms - 300", "end_ms - start_ms") + """,
kt AS (SELECT media_id, clip, sum(b - a) AS k FROM kept GROUP BY ALL), nc AS (SELECT media_id, clip, count(*) AS n FROM inside GROUP BY ALL)"""
_SEL = """, p AS (SELECT media_id, clip, CAST(CASE WHEN clip % 8 = 3 THEN -1000 WHEN clip % 8 = 0 THEN w_start + 1000 ELSE w_start END AS BIGINT) AS a, CAST(CASE clip % 8 WHEN 1 THEN NULL WHEN 2 THEN w_start WHEN 4 THEN 1000000000 WHEN 5 THEN w_start + 300 WHEN 6 THEN w_start + 90000 WHEN 0 THEN w_end - 1000 ELSE w_end END AS BIGINT) AS b FROM grid),
lim AS (SELECT media_id, arg_max(end_ms, seq) AS l FROM u GROUP BY media_id),
sn AS (SELECT media_id, clip, a, b, """ + _NEAR.format(m="start_ms", t="p.a", tol=3000) + " AS s, " + _NEAR.format(m="end_ms", t="p.b", tol=3000) + """ AS e FROM p),
sel AS (SELECT media_id, CAST(clip + 1 AS INT) AS pos, 'T' || clip AS title, s AS start_ms, e AS end_ms, CASE WHEN a IS NULL OR b IS NULL THEN 'missing' WHEN b <= a THEN 'order' WHEN a < 0 OR b > l + 3000 THEN 'outside' WHEN e - s < 2000 THEN 'short' WHEN e - s > 60000 THEN 'long' END AS error FROM sn JOIN lim USING (media_id))"""
_TENTHS = "format('{{}}.{{}}s', ({0} + 50) // 1000, ({0} + 50) // 100 % 10)"
_CLOCK = "CASE WHEN {0} >= 3600 THEN format('{{:02d}}:{{:02d}}:{{:02d}}', {0} // 3600, {0} // 60 % 60, {0} % 60) ELSE format('{{:02d}}:{{:02d}}', {0} // 60, {0} % 60) END"
_SEC = "CAST(round_even({0} / 1000, 0) AS BIGINT)"
_META = _G + ", cw AS (SELECT * FROM grid)," + INSIDE + "," + KEEP + "," + TEXTS + f""", kt AS (SELECT media_id, clip, CAST(sum(b - a) AS BIGINT) AS k FROM kept GROUP BY ALL),
mt AS (SELECT media_id, CAST(clip AS INT) AS pos, {_NAME.format('clip')} AS id, (clip + 1) % 2 = 1 AND media_id % 2 = 0 AS rendered, {_SEC.format('w_start')} AS a, {_SEC.format('w_end')} AS b, w_start, w_end, k, greatest(0, w_end - w_start - k) AS gone, coalesce(text, '') AS text
  FROM cw JOIN kt USING (media_id, clip) LEFT JOIN txt USING (media_id, clip)),
md AS (SELECT media_id, pos, id, id || '.mp4' AS filename, id || '.srt' AS subtitles, rendered, {_CLOCK.format('a')} AS start, {_CLOCK.format('b')} AS "end", w_start / 1000 AS start_seconds, w_end / 1000 AS end_seconds, {_TENTHS.format('(w_end - w_start)')} AS original_duration, {_TENTHS.format('gone')} AS silence_removed, {_TENTHS.format('k')} AS final_duration, text AS transcription, CAST({score('text', '(w_end - w_start)')} AS DOUBLE) AS importance_score FROM mt)"""
_REP = _META + """, ti AS (SELECT media_id, 'clip_' || format('{:03d}', clip + 1) AS id, 'T ' || clip AS titulo, '<b>&' AS descricao, 'a b|c' AS tags, clip % 2 = 0 AS estrela FROM grid WHERE clip % 3 = 0),
rep AS (SELECT m.media_id, pos, m.id, coalesce(titulo, '') AS titulo, coalesce(descricao, '') AS descricao, coalesce(tags, '') AS tags, coalesce(estrela, false) AS estrela, start, "end", start_seconds AS seconds, final_duration AS duration, silence_removed AS removed, importance_score AS score, transcription AS text
  FROM md m LEFT JOIN ti ON ti.media_id = m.media_id AND ti.id = m.id WHERE rendered OR NOT EXISTS (SELECT 1 FROM md x WHERE x.media_id = m.media_id AND x.rendered))"""
_SHARE = ", t AS (SELECT g.media_id, clip, speaker, sum(least(end_ms, w_end) - greatest(start_ms, w_start)) AS ms FROM grid g JOIN u ON u.media_id = g.media_id AND start_ms < w_end AND end_ms > w_start GROUP BY ALL), s AS (SELECT media_id, clip, w_start, w_end, coalesce(sum(ms) FILTER (speaker = 'user'), 0) AS p, coalesce(sum(ms) FILTER (speaker <> 'user'), 0) AS o FROM grid LEFT JOIN t USING (media_id, clip) GROUP BY ALL)"
ORACLE = {
    "k12_persona_lines": _G + _SHARE + f", r AS (SELECT *, CAST(o AS DOUBLE) / CAST(CASE WHEN p + o > 0 THEN p + o ELSE 1000 END AS DOUBLE) AS x, {_SEC.format('w_start')} AS a, {_SEC.format('w_end')} AS b, {_NAME.format('clip')} AS clip_id FROM s) SELECT media_id, clip_id, printf('%-11s %-20s %7.1fs %6.1fs %3d%%  %s', clip_id, {_CLOCK.format('a')} || '-' || {_CLOCK.format('b')}, round(CAST(p AS DOUBLE) / 1000, 1), round(CAST(o AS DOUBLE) / 1000, 1), CAST(round_even(x * 100, 0) AS BIGINT), CASE WHEN x < 0.15 THEN 'limpo' WHEN x <= 0.5 THEN 'contaminado' ELSE 'comprometido' END) AS line FROM r",
    "c3_f10_f11_apply_adjustments": _C3 + f", cc AS (SELECT media_id, clip, count(*) AS n, sum(end_ms - start_ms) AS ms FROM inside GROUP BY ALL) SELECT cw.media_id, {_NAME.format('cw.clip')} AS clip_id, CAST(cw.clip + 1 AS INT) AS clip_index, w_start AS start_ms, w_end AS end_ms, coalesce(text, '') AS text, CAST({score('coalesce(text, chr(32))', '(w_end - w_start)')} AS DOUBLE) AS score, CAST(coalesce(n, 0) AS INT) AS n_cuts, CAST(coalesce(ms, 0) AS BIGINT) AS cut_ms FROM cw LEFT JOIN txt USING (media_id, clip) LEFT JOIN cc USING (media_id, clip)",
    "c4_f12_f18_apply_persona": _C4 + f" SELECT cw.media_id, {_NAME.format('cw.clip')} AS clip_id, CAST(0 AS BIGINT) AS pad_ms, CAST(coalesce(n, 0) AS INT) AS n_cuts, CAST(k AS BIGINT) AS kept_ms, CAST(greatest(0, w_end - w_start - k) AS BIGINT) AS removed_ms FROM cw JOIN kt USING (media_id, clip) LEFT JOIN nc USING (media_id, clip)",
    "s10_d4_adjustments_json": _G + f" SELECT media_id, {_NAME.format('clip')} AS clip_id, CASE WHEN clip % 6 = 3 THEN (w_start // 1000 + 1) * 1000 END AS set_start, CASE WHEN clip % 12 = 3 THEN w_end - 400 END AS set_end, clip % 6 = 4 AS remove, CASE WHEN clip % 6 = 0 THEN {_NAME.format('(clip + 1)')} || ' ' || {_NAME.format('(clip + 2)')} ELSE '' END AS absorb, CAST(4000 AS BIGINT) AS lead_ms, CAST(3000 AS BIGINT) AS tail_ms, media_id % 2 = 0 AS snap, CAST(NULL AS VARCHAR) AS error FROM grid WHERE clip % 6 IN (0, 3, 4)",
    "f10_f11_unfit_plans": _G + " SELECT media_id, 'unknown' AS kind, 'clip_001' AS clip_id FROM med WHERE total_ms > 0 UNION ALL SELECT media_id, 'stale', '' FROM med WHERE total_ms > 0",
    "f9_s11_j4_selection": _G + _SEL + " SELECT * FROM sel",
    "t9_j17_selected_overlaps": _G + _SEL + ", n AS (SELECT media_id, start_ms, end_ms, CASE WHEN pos % 3 <> 0 THEN title ELSE CAST(round_even(start_ms / 1000, 0) AS BIGINT) || 's' END AS t FROM sel WHERE error IS NULL), l AS (SELECT media_id, t AS title, lead(t) OVER w AS next_title, lead(start_ms) OVER w < end_ms AS hit FROM n WINDOW w AS (PARTITION BY media_id ORDER BY start_ms, end_ms)) SELECT media_id, title, next_title FROM l WHERE hit",
    "k2_metadata_clips": _META + " SELECT * FROM md",
    "k2_metadata_header": _META + f", h AS (SELECT media_id, {_SEC.format('total_ms')} AS t FROM med), ft AS (SELECT media_id, string_agg(text, ' ' ORDER BY seq) AS full_transcription FROM u GROUP BY media_id) SELECT media_id, CAST(media_id AS VARCHAR) AS source, {_CLOCK.format('t')} AS total_duration, CAST(coalesce((SELECT count(*) FROM md WHERE md.media_id = h.media_id AND rendered), 0) AS INT) AS clips_generated, CAST(coalesce((SELECT count(*) FROM md WHERE md.media_id = h.media_id), 0) AS INT) AS clips_planned, 'local' AS transcription_engine, 'pt' AS language, full_transcription FROM h JOIN ft USING (media_id)",
    "s12_titles_json": _G + f" SELECT media_id, {_NAME.format('clip')} AS clip_id, 'T ' || clip AS titulo, '<b>&' AS descricao, 'a b|c' AS tags, clip % 2 = 0 AS estrela FROM grid WHERE clip % 3 = 0",
    "k8_f19_j12_report_rows": _REP + " SELECT * FROM rep",
    "a9_report_totals": _REP + " SELECT media_id, count(*) AS clips, CAST(round_even(CAST(sum(CAST(CAST(rtrim(duration, 's') AS DECIMAL(18, 3)) * 1000 AS BIGINT)) AS DOUBLE) / 60000, 0) AS BIGINT) AS minutes, CAST(round_even(CAST(sum(CAST(CAST(rtrim(removed, 's') AS DECIMAL(18, 3)) * 1000 AS BIGINT)) AS DOUBLE) / 1000, 0) AS BIGINT) AS removed_s FROM rep GROUP BY media_id",
    "k8_k9_report_payload": _REP + " SELECT media_id, CAST(count(*) AS INT) AS n, false AS unsafe FROM rep GROUP BY media_id",
}
