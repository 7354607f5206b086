"""Queries over captions and word cues; folds, checked by tests against plain Python where SQL can't say them simply."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import collapse, word_list
from ..operators import captions as C
from ..operators import intervals as I
from ..operators import segment as S
from ..sources import tables
from .prelude import GRID, INSIDE, KEEP, UTTERANCES, WORDS
from .segments import grid


def _u(spark, d):
    return tables.utterances(spark, d).withColumn("words", word_list(F.col("text")))


def _joined(lists):
    return F.transform(lists, lambda c: F.array_join(c, " "))


def x2(spark, d):
    return _u(spark, d).select("media_id", "seq", collapse(F.col("text")).alias("text"))


def x3(spark, d):
    return _u(spark, d).select("media_id", "seq", F.posexplode(_joined(C.greedy_chunks(F.col("words"), 80))).alias("pos", "chunk"))


def x4(spark, d):
    chunked = _u(spark, d).withColumn("chunks", C.greedy_chunks(F.col("words"), 80))
    return chunked.select("media_id", "seq", F.posexplode(_joined(C.push_dangling(F.col("chunks")))).alias("pos", "chunk"))


def x5(spark, d):
    words = _u(spark, d).select(F.explode("words").alias("word"))
    return words.withColumn("is_function", C.is_function_word(F.col("word"))).groupBy("word", "is_function").count()


def x6(spark, d):
    chunked = _u(spark, d).withColumn("chunks", C.push_dangling(C.greedy_chunks(F.col("words"), 80)))
    return chunked.select("media_id", "seq", F.posexplode("chunks").alias("pos", "c")).select("media_id", "seq", "pos", C.two_lines(F.col("c")).alias("lines"))


def x7(spark, d):
    u = _u(spark, d).withColumn("chunks", _joined(C.greedy_chunks(F.col("words"), 80)))
    return u.select("media_id", "seq", F.posexplode(C.time_shares(F.col("chunks"), F.col("start_ms"), F.col("end_ms"))).alias("pos", "c")).select("media_id", "seq", "pos", "c.*")


def _spread(spark, d):
    return _u(spark, d).withColumn("timed", C.spread_words(F.col("words"), F.col("start_ms"), F.col("end_ms")))


def x11(spark, d):
    return _spread(spark, d).select("media_id", "seq", F.posexplode(C.merge_short(F.col("timed"))).alias("pos", "w")).select("media_id", "seq", "pos", "w.*")


def x12(spark, d):
    g = _spread(spark, d).withColumn("merged", C.merge_short(F.col("timed")))
    g = g.select("media_id", "seq", F.posexplode(C.group_words(F.col("merged"))).alias("pos", "g"))
    return g.select("media_id", "seq", "pos", F.get("g", 0)["start_ms"].alias("start_ms"), F.element_at("g", -1)["end_ms"].alias("end_ms"), F.array_join(F.transform("g", lambda w: w["text"]), " ").alias("text"))


def _clip_ranges(spark, d):
    """Grid windows with their kept ranges, and utterances with timed words."""
    u = _spread(spark, d)
    s, m = tables.silences(u), tables.media(u)
    return S.with_cuts(grid(m), s).withColumn("ranges", I.keep_ranges(F.col("w_start"), F.col("w_end"), F.col("cuts"), 150)), u


def c6(spark, d):
    """Word cues of grid clips in clip time: in karaoke a group's words with the active one's index, in pop the one word."""
    clips, u = _clip_ranges(spark, d)
    u = u.withColumn("groups", C.group_words(C.merge_short(F.col("timed")))).select("media_id", "seq", F.col("start_ms").alias("u_start"), F.col("end_ms").alias("u_end"), "groups")
    met = I.meet(clips, u, ("w_start", "w_end"), ("u_start", "u_end"), I.overlaps("u_start", "u_end", "w_start", "w_end"))
    g = met.select("media_id", "clip", "seq", "ranges", "w_start", "w_end", F.posexplode("groups").alias("group_no", "g"))
    g = g.where((F.element_at("g", -1)["end_ms"] > F.col("w_start")) & (F.get("g", F.lit(0))["start_ms"] < F.col("w_end")))
    g = g.select("media_id", "clip", "seq", "ranges", "group_no", F.array_join(F.transform("g", lambda w: w["text"]), " ").alias("karaoke"), F.posexplode("g").alias("active", "w"), "w_start", "w_end")
    g = g.where((F.col("w.end_ms") > F.col("w_start")) & (F.col("w.start_ms") < F.col("w_end")))  # words outside have no time in the clip, so no range is searched for them
    cues = g.select("media_id", "clip", "seq", "group_no", "active", "karaoke", F.col("w.text").alias("pop"), I.remap(F.col("w.start_ms"), F.col("ranges")).alias("start_ms"), I.remap(F.col("w.end_ms"), F.col("ranges")).alias("end_ms"))
    return cues.where("end_ms > start_ms")


def i16(spark, d):
    return _spread(spark, d).select("media_id", "seq", F.posexplode(C.word_windows(F.col("timed"), F.col("start_ms"), F.col("end_ms"))).alias("pos", "w")).select("media_id", "seq", "pos", "w.*")


def c5(spark, d):
    """Subtitles of grid clips: utterances moved to clip time, packed, shared out and wrapped; one that ends after the last range goes."""
    clips, u = _clip_ranges(spark, d)
    u = u.select("media_id", "seq", "words", F.col("start_ms").alias("u_start"), F.col("end_ms").alias("u_end"))
    met = I.meet(clips, u, ("w_start", "w_end"), ("u_start", "u_end"), I.overlaps("u_start", "u_end", "w_start", "w_end"))
    met = met.withColumns({"a": I.remap(F.col("u_start"), F.col("ranges")), "b": I.remap(F.col("u_end"), F.col("ranges"))}).where("b > a")
    met = met.withColumn("chunks", _joined(C.push_dangling(C.greedy_chunks(F.col("words"), 80))))
    each = met.select("media_id", "clip", "seq", F.posexplode(C.time_shares(F.col("chunks"), F.col("a"), F.col("b"))).alias("pos", "c"))
    return each.select("media_id", "clip", "seq", "pos", "c.start_ms", "c.end_ms", C.two_lines(F.split("c.text", " ")).alias("lines"))


QUERIES = {
    "x2_collapse": x2, "x3_greedy_chunks": x3, "x4_push_dangling": x4, "x5_function_words": x5, "x6_two_lines": x6, "x7_time_shares": x7, "x11_merge_short_words": x11, "x12_word_groups": x12, "c5_subtitles": c5, "c6_word_cues": c6, "i16_word_windows": i16,
}

_W = "WITH RECURSIVE" + UTTERANCES + f", ws AS (SELECT *, {WORDS.format('text')} AS words FROM u)"
_FW = "(" + ", ".join(f"'{w}'" for w in C.FUNCTION_WORDS) + ")"
_CHUNKS = """, wk AS (SELECT media_id, seq, start_ms, end_ms, words, 1 AS i, 0 AS chunk, CAST(length(words[1]) AS BIGINT) AS size FROM ws WHERE len(words) > 0
  UNION ALL SELECT media_id, seq, start_ms, end_ms, words, i + 1, CASE WHEN size + 1 + length(words[i + 1]) <= 80 THEN chunk ELSE chunk + 1 END, CASE WHEN size + 1 + length(words[i + 1]) <= 80 THEN size + 1 + length(words[i + 1]) ELSE length(words[i + 1]) END FROM wk WHERE i < len(words)),
ch AS (SELECT media_id, seq, start_ms, end_ms, chunk AS pos, string_agg(words[i], ' ' ORDER BY i) AS chunk FROM wk GROUP BY media_id, seq, start_ms, end_ms, chunk)"""
_TIMED = """, ex AS (SELECT media_id, seq, start_ms AS us, end_ms AS ue, i, words[i] AS w FROM ws, LATERAL (SELECT unnest(range(1, len(words) + 1)) AS i)),
tm0 AS (SELECT *, sum(length(w)) OVER (PARTITION BY media_id, seq ORDER BY i ROWS UNBOUNDED PRECEDING) AS upto, sum(length(w)) OVER (PARTITION BY media_id, seq) AS total FROM ex),
tm AS (SELECT media_id, seq, i, w, us, ue, CAST(us + (ue - us) * (upto - length(w)) // total AS BIGINT) AS s, CAST(us + (ue - us) * upto // total AS BIGINT) AS e FROM tm0)"""
ORACLE = {
    "x2_collapse": "WITH" + UTTERANCES + r" SELECT media_id, seq, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM u",
    "x3_greedy_chunks": _W + _CHUNKS + " SELECT media_id, seq, pos, chunk FROM ch",
    "x5_function_words": _W + rf""" SELECT word, lower(regexp_replace(word, '^[.,;:!?…"''()]+|[.,;:!?…"''()]+$', '', 'g')) IN {_FW} AS is_function, count(*) AS count FROM (SELECT unnest(words) AS word FROM ws) GROUP BY ALL""",
    "x7_time_shares": _W + _CHUNKS + """, sh AS (SELECT *, greatest(700, (end_ms - start_ms) * length(chunk) // sum(length(chunk)) OVER (PARTITION BY media_id, seq)) AS share FROM ch),
at_ AS (SELECT *, least(end_ms, start_ms + coalesce(sum(share) OVER w, 0)) AS a, least(end_ms, start_ms + coalesce(sum(share) OVER w, 0) + share) AS b FROM sh WINDOW w AS (PARTITION BY media_id, seq ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT media_id, seq, CAST(row_number() OVER (PARTITION BY media_id, seq ORDER BY pos) - 1 AS INT) AS pos, CAST(a AS BIGINT) AS start_ms, CAST(b AS BIGINT) AS end_ms, chunk AS text FROM at_ WHERE b > a""",
    "x11_merge_short_words": _W + _TIMED + """, mk AS (SELECT media_id, seq, i, w, s, e, s AS gs, CASE WHEN e - s >= 380 THEN 1 ELSE 0 END AS full_, 0 AS g FROM tm WHERE i = 1
  UNION ALL SELECT t.media_id, t.seq, t.i, t.w, t.s, t.e, CASE WHEN m.full_ = 1 THEN t.s ELSE m.gs END, CASE WHEN t.e - CASE WHEN m.full_ = 1 THEN t.s ELSE m.gs END >= 380 THEN 1 ELSE 0 END, m.g + m.full_ FROM mk m JOIN tm t ON t.media_id = m.media_id AND t.seq = m.seq AND t.i = m.i + 1),
lg AS (SELECT media_id, seq, coalesce(max(g) FILTER (WHERE full_ = 1), 0) AS lastg FROM mk GROUP BY ALL)
SELECT m.media_id, m.seq, CAST(least(g, lastg) AS INT) AS pos, min(s) AS start_ms, max(e) AS end_ms, string_agg(w, ' ' ORDER BY i) AS text FROM mk m JOIN lg ON lg.media_id = m.media_id AND lg.seq = m.seq GROUP BY m.media_id, m.seq, least(g, lastg)""",
}
_FN = "lower(regexp_replace({0}, '^[.,;:!?…\"''()]+|[.,;:!?…\"''()]+$', '', 'g')) IN " + _FW
_PUSHED = (
    _CHUNKS
    + """, cl AS (SELECT media_id, seq, start_ms, end_ms, pos, string_split(chunk, ' ') AS l, max(pos) OVER (PARTITION BY media_id, seq) AS top FROM ch),
pk AS (SELECT media_id, seq, start_ms, end_ms, pos, top, l AS w, """
    + "{tail}".replace("{tail}", "CASE WHEN pos = top THEN 0 ELSE least(len(l) - 1, coalesce(list_position(list_reverse(list_transform(l, lambda x: " + _FN.format("x") + ")), false), len(l) + 1) - 1) END")
    + """ AS moved FROM cl WHERE pos = 0
  UNION ALL SELECT c.media_id, c.seq, c.start_ms, c.end_ms, c.pos, c.top, list_concat(p.w[len(p.w) - p.moved + 1:], c.l), CASE WHEN c.pos = c.top THEN 0 ELSE least(len(list_concat(p.w[len(p.w) - p.moved + 1:], c.l)) - 1, coalesce(list_position(list_reverse(list_transform(list_concat(p.w[len(p.w) - p.moved + 1:], c.l), lambda x: """
    + _FN.format("x")
    + """)), false), len(list_concat(p.w[len(p.w) - p.moved + 1:], c.l)) + 1) - 1) END FROM pk p JOIN cl c ON c.media_id = p.media_id AND c.seq = p.seq AND c.pos = p.pos + 1),
pu AS (SELECT media_id, seq, start_ms, end_ms, CAST(pos AS INT) AS pos, w[1:len(w) - moved] AS l FROM pk)"""
)
#: Two lines of a list of words: the break nearest the middle, the earlier of two, not after a function word; else the middle.
_LINES = (
    "CASE WHEN length(array_to_string({l}, ' ')) <= 40 OR len({l}) < 2 THEN array_to_string({l}, ' ') ELSE array_to_string({l}[1:{k}], ' ') || chr(10) || array_to_string({l}[{k} + 1:], ' ') END"
)
_BREAK = "coalesce(list_sort(list_transform(list_filter(range(1, len({l})), lambda k: NOT (" + _FN.format("{l}[k]") + ")), lambda k: {{'off': abs(k - len({l}) // 2), 'k': k}}))[1].k, len({l}) // 2)"
_GROUPS = (
    _W
    + _TIMED
    + """, mk AS (SELECT media_id, seq, i, w, s, e, s AS gs, CASE WHEN e - s >= 380 THEN 1 ELSE 0 END AS full_, 0 AS g FROM tm WHERE i = 1
  UNION ALL SELECT t.media_id, t.seq, t.i, t.w, t.s, t.e, CASE WHEN m.full_ = 1 THEN t.s ELSE m.gs END, CASE WHEN t.e - CASE WHEN m.full_ = 1 THEN t.s ELSE m.gs END >= 380 THEN 1 ELSE 0 END, m.g + m.full_ FROM mk m JOIN tm t ON t.media_id = m.media_id AND t.seq = m.seq AND t.i = m.i + 1),
lg AS (SELECT media_id, seq, coalesce(max(g) FILTER (WHERE full_ = 1), 0) AS lastg FROM mk GROUP BY ALL),
mw AS (SELECT m.media_id, m.seq, CAST(least(g, lastg) AS INT) AS pos, min(s) AS s, max(e) AS e, string_agg(w, ' ' ORDER BY i) AS t FROM mk m JOIN lg ON lg.media_id = m.media_id AND lg.seq = m.seq GROUP BY m.media_id, m.seq, least(g, lastg)),
gk AS (SELECT media_id, seq, pos, s, e, t, 1 AS n, 0 AS g FROM mw WHERE pos = 0
  UNION ALL SELECT w.media_id, w.seq, w.pos, w.s, w.e, w.t, CASE WHEN k.n >= 6 OR (k.n >= 3 AND regexp_matches(k.t, '[.!?…,]\\s*$')) THEN 1 ELSE k.n + 1 END, CASE WHEN k.n >= 6 OR (k.n >= 3 AND regexp_matches(k.t, '[.!?…,]\\s*$')) THEN k.g + 1 ELSE k.g END FROM gk k JOIN mw w ON w.media_id = k.media_id AND w.seq = k.seq AND w.pos = k.pos + 1)"""
)
_IN_CLIP = "," + GRID + ", cw AS (SELECT * FROM grid)," + INSIDE + "," + KEEP + ", rg AS (SELECT *, coalesce(sum(b - a) OVER (PARTITION BY media_id, clip ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM kept)"
_AT = "(SELECT arg_min(gone + greatest(0, {t} - a), a) FROM rg WHERE rg.media_id = {x}.media_id AND rg.clip = {x}.clip AND {t} <= b)"
ORACLE |= {
    "x4_push_dangling": _W + _PUSHED + " SELECT media_id, seq, pos, array_to_string(l, ' ') AS chunk FROM pu",
    "x6_two_lines": _W + _PUSHED + ", br AS (SELECT *, " + _BREAK.format(l="l") + " AS k FROM pu) SELECT media_id, seq, pos, " + _LINES.format(l="l", k="k") + " AS lines FROM br",
    "x12_word_groups": _GROUPS + " SELECT media_id, seq, g AS pos, min(s) AS start_ms, max(e) AS end_ms, string_agg(t, ' ' ORDER BY pos) AS text FROM gk GROUP BY media_id, seq, g",
    "c6_word_cues": _GROUPS + _IN_CLIP + """, gt AS (SELECT *, string_agg(t, ' ') OVER (PARTITION BY media_id, seq, g ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS karaoke, CAST(row_number() OVER (PARTITION BY media_id, seq, g ORDER BY pos) - 1 AS INT) AS active FROM gk),
cu AS (SELECT c.media_id, c.clip, x.seq, x.g AS group_no, active, karaoke, x.t AS pop, x.s, x.e FROM grid c JOIN u ON u.media_id = c.media_id AND u.start_ms < w_end AND u.end_ms > w_start JOIN gt x ON x.media_id = u.media_id AND x.seq = u.seq),
rm AS (SELECT media_id, clip, seq, group_no, active, karaoke, pop, CAST(""" + _AT.format(t="cu.s", x="cu") + " AS BIGINT) AS start_ms, CAST(" + _AT.format(t="cu.e", x="cu") + " AS BIGINT) AS end_ms FROM cu) SELECT * FROM rm WHERE end_ms > start_ms",
    "c5_subtitles": _W + _PUSHED + _IN_CLIP + ", cu AS (SELECT c.media_id, c.clip, u.seq, u.start_ms AS s, u.end_ms AS e FROM grid c JOIN u ON u.media_id = c.media_id AND u.start_ms < w_end AND u.end_ms > w_start), rm AS (SELECT media_id, clip, seq, " + _AT.format(t="cu.s", x="cu") + " AS a, " + _AT.format(t="cu.e", x="cu") + """ AS b FROM cu),
sh AS (SELECT r.media_id, r.clip, r.seq, pos, l, a, b, greatest(700, (b - a) * length(array_to_string(l, ' ')) // greatest(1, sum(length(array_to_string(l, ' '))) OVER (PARTITION BY r.media_id, r.clip, r.seq))) AS share FROM rm r JOIN pu ON pu.media_id = r.media_id AND pu.seq = r.seq WHERE b > a),
tt AS (SELECT *, least(b, a + coalesce(sum(share) OVER w, 0)) AS f, least(b, a + coalesce(sum(share) OVER w, 0) + share) AS t FROM sh WINDOW w AS (PARTITION BY media_id, clip, seq ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
br AS (SELECT *, """ + _BREAK.format(l="l") + " AS k FROM tt WHERE t > f) SELECT media_id, clip, seq, CAST(row_number() OVER (PARTITION BY media_id, clip, seq ORDER BY pos) - 1 AS INT) AS pos, CAST(f AS BIGINT) AS start_ms, CAST(t AS BIGINT) AS end_ms, " + _LINES.format(l="l", k="k") + " AS lines FROM br",
    "i16_word_windows": _W + _TIMED + """, wk AS (SELECT media_id, seq, i, s AS f, e, e - s >= 1200 AS done, 0 AS n FROM tm WHERE i = 1
  UNION ALL SELECT t.media_id, t.seq, t.i, CASE WHEN k.done THEN k.e ELSE k.f END, t.e, t.e - CASE WHEN k.done THEN k.e ELSE k.f END >= 1200, k.n + CASE WHEN k.done THEN 1 ELSE 0 END FROM wk k JOIN tm t ON t.media_id = k.media_id AND t.seq = k.seq AND t.i = k.i + 1),
fw AS (SELECT media_id, seq, n, f, e FROM wk WHERE done), lw AS (SELECT media_id, seq, arg_max(n, i) AS n, arg_max(f, i) AS f, max(e) AS e, arg_max(done, i) AS done FROM wk GROUP BY ALL),
ex_ AS (SELECT f.media_id, f.seq, f.n, f.f, CASE WHEN l.n = f.n + 1 AND NOT l.done AND l.e - l.f < 450 THEN l.e ELSE f.e END AS e FROM fw f JOIN lw l ON l.media_id = f.media_id AND l.seq = f.seq
  UNION ALL SELECT media_id, seq, n, f, e FROM lw WHERE NOT done AND e - f >= 450)
SELECT media_id, seq, CAST(n AS INT) AS pos, f AS start_ms, e AS end_ms FROM ex_ UNION ALL SELECT media_id, seq, 0, start_ms, end_ms FROM u WHERE NOT EXISTS (SELECT 1 FROM ex_ WHERE ex_.media_id = u.media_id AND ex_.seq = u.seq)""",
}
