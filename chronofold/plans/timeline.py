"""Queries over turns that nest, cross or have no label, borders far out, and media without a pause."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as I
from ..operators import segment as S
from ..operators import speakers as V
from .captioning import ORACLE as _CAPTIONS
from .captioning import _spread
from .prelude import GRID, POINTS, SPLIT, UTTERANCES
from .segments import _base, grid


def odd_turns(spark, d):
    """Utterances as turns of A and B: every fifth without a label, every fourth reaching far into the next ones, or ending early."""
    k = F.col("seq")
    end = F.col("end_ms") + F.when(k % 4 == 1, 8000).when(k % 4 == 2, -200).otherwise(0)
    who = F.when(k % 5 == 3, None).when((k % 3 == 0) | (k % 7 < 3), "A").otherwise("B")
    return _base(spark, d)[0].select("media_id", "seq", "start_ms", end.alias("end_ms"), who.alias("speaker"))


def turns_furthest(spark, d):
    """Turns measured from their furthest end."""
    return I.merge_turns(odd_turns(spark, d), 700, span=60_000)


def turns_latest(spark, d):
    """Turns measured from their last row's end."""
    return I.merge_turns(odd_turns(spark, d), 700, latest=True, span=60_000)


def totals(spark, d):
    """Seconds of each speaker in those turns."""
    return V.turn_totals(turns_furthest(spark, d))


def given_windows(spark, d):
    """Speakers of word windows given by number, for utterances at a change of speaker."""
    from ..operators.captions import word_windows

    w = _spread(spark, d).select("media_id", "seq", F.posexplode(word_windows(F.col("timed"), F.col("start_ms"), F.col("end_ms"))).alias("pos", "w"))
    return w.where((F.col("seq") + F.col("pos")) % 3 != 1).select("media_id", "seq", "pos", F.when((F.col("seq") + F.col("pos")) % 3 == 0, "user").otherwise("assistant").alias("speaker"))


def c8_given(spark, d):
    """Refined turns from given window speakers: those windows that have none keep their utterance's."""
    return V.refined_turns(_spread(spark, d), given_windows(spark, d))


def j2_stray(spark, d):
    """Silences in grid windows, of which every seventh never ends."""
    _, s, m = _base(spark, d)
    g = grid(m).withColumn("w_end", F.when(F.col("clip") % 7 == 3, F.lit(10**13)).otherwise(F.col("w_end")))
    return I.clip_join(g, s, 1).select("media_id", "clip", "start_ms", "end_ms")


def i13_whole(spark, d):
    """Whole media split at the best cuts, pieces of at most 20 s."""
    u, s, m = _base(spark, d)
    whole = m.select("media_id", F.lit(0).cast("long").alias("start_ms"), F.col("total_ms").alias("end_ms"))
    return S.split_windows(whole, S.cut_points(u, s), most=20_000)


QUERIES = {"i4_w5_turns_furthest": turns_furthest, "i4_w5_turns_latest": turns_latest, "a1_turn_totals": totals, "c8_given_windows": c8_given, "j2_windows_without_end": j2_stray, "i13_whole_media": i13_whole}

_G = "WITH RECURSIVE" + UTTERANCES
#: Turns by a plain loop over the rows r (media_id, rn, s, e, sp) of each medium.
_LOOP = """tl AS (SELECT media_id, rn, sp, s AS a, e AS b, 1 AS k FROM r WHERE rn = 1
  UNION ALL SELECT r.media_id, r.rn, r.sp, CASE WHEN r.sp = t.sp AND r.s - t.b <= {gap} THEN t.a ELSE r.s END, CASE WHEN r.sp = t.sp AND r.s - t.b <= {gap} THEN {end} ELSE r.e END, t.k + CASE WHEN r.sp = t.sp AND r.s - t.b <= {gap} THEN 0 ELSE 1 END
  FROM tl t JOIN r ON r.media_id = t.media_id AND r.rn = t.rn + 1),
tu AS (SELECT media_id, sp AS speaker, min(a) AS start_ms, arg_max(b, rn) AS end_ms, count(*) AS n FROM tl GROUP BY media_id, sp, k)"""
_ODD = _G + """, o AS (SELECT media_id, seq, start_ms AS s, greatest(start_ms, end_ms + CASE seq % 4 WHEN 1 THEN 8000 WHEN 2 THEN -200 ELSE 0 END) AS e, CASE WHEN seq % 5 = 3 THEN NULL WHEN seq % 3 = 0 OR seq % 7 < 3 THEN 'A' ELSE 'B' END AS sp FROM u),
r AS (SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY s, seq) AS rn, s, e, sp FROM o WHERE sp IS NOT NULL), """
_FURTHEST = _ODD + _LOOP.format(gap=700, end="greatest(t.b, r.e)")
_W2 = "coalesce(lag(speaker) OVER w <> speaker, false) OR coalesce(lead(speaker) OVER w <> speaker, false)"
ORACLE = {
    "i4_w5_turns_furthest": _FURTHEST + " SELECT * FROM tu",
    "i4_w5_turns_latest": _ODD + _LOOP.format(gap=700, end="r.e") + " SELECT * FROM tu",
    "a1_turn_totals": _FURTHEST + " SELECT media_id, speaker, round(CAST(sum(end_ms - start_ms) AS DOUBLE) / 1000, 1) AS seconds FROM tu GROUP BY ALL",
    "c8_given_windows": _G + f", ww AS ({_CAPTIONS['i16_word_windows']}), z AS (SELECT *, {_W2} AS tr FROM u WINDOW w AS (PARTITION BY media_id ORDER BY seq)), "
    + """ev AS (SELECT media_id, start_ms AS s, end_ms AS e, speaker AS sp, seq, 0 AS pos FROM z WHERE NOT tr
  UNION ALL SELECT z.media_id, ww.start_ms, ww.end_ms, CASE (z.seq + pos) % 3 WHEN 1 THEN speaker WHEN 0 THEN 'user' ELSE 'assistant' END, z.seq, pos FROM z JOIN ww ON z.media_id = ww.media_id AND z.seq = ww.seq WHERE tr),
r AS (SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY s, e, sp, seq, pos) AS rn, s, greatest(s, e) AS e, sp FROM ev), """
    + _LOOP.format(gap=250, end="greatest(t.b, r.e)") + " SELECT * FROM tu",
    "j2_windows_without_end": _G + "," + GRID + ", g AS (SELECT media_id, clip, w_start, CASE WHEN clip % 7 = 3 THEN 10000000000000 ELSE w_end END AS w_end FROM grid) SELECT g.media_id, clip, greatest(start_ms, w_start) AS start_ms, least(end_ms, w_end) AS end_ms FROM g JOIN sil s ON s.media_id = g.media_id AND start_ms < w_end AND end_ms > w_start",
    "i13_whole_media": _G + ", win AS (SELECT media_id, CAST(0 AS BIGINT) AS start_ms, total_ms AS end_ms FROM med)," + POINTS + "," + SPLIT.replace("60000", "20000") + " SELECT * FROM pieces",
}
