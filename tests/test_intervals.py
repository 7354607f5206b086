"""Joins by nested time bins, merges and scans in two levels, and splitting, against plain Python."""

import bisect
import random
import time
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronofold.operators import intervals as I
from chronofold.operators import scans
from chronofold.operators import segment as S
from chronofold.operators import speakers as V

WINDOW = "media_id string, clip int, w_start long, w_end long"
PART = "media_id string, start_ms long, end_ms long"
TURN = "media_id string, seq long, start_ms long, end_ms long, speaker string"


def spans(r, n, media, longest):
    out = []
    for _ in range(n):
        a = r.randrange(-10**7, 10**8)
        out.append((r.choice(media), a, a + int(r.random() ** 6 * longest)))
    return out


def touching(windows, parts, least):
    return Counter((m, c, max(a, p), min(b, q)) for m, c, a, b in windows for n, p, q in parts if m == n and p < b and q > a and min(b, q) - max(a, p) >= least)


@pytest.mark.parametrize("w_long,p_long", [(60_000, 60_000), (10**13, 60_000), (60_000, 10**13), (10**13, 10**13), (2**62, 2**61)])
def test_pairs_of_any_length_meet_once(spark, w_long, p_long):
    r = random.Random(w_long + p_long)
    media = ["hot", "hot", "a", "b", "c"]
    windows = [(m, k, a, b) for k, (m, a, b) in enumerate(spans(r, 120, media, w_long))] + [("hot", 900, 0, 10**13), ("none", 901, 0, 1), ("a", 902, 50, 50)]
    parts = spans(r, 150, media, p_long) + [("hot", -(10**13), 10**13), ("b", 2**50, 2**50 + 5), ("hot", 7, 7)]
    w, p = spark.createDataFrame(windows, WINDOW), spark.createDataFrame(parts, PART)
    told = lambda df: Counter((x.media_id, x.clip, x.start_ms, x.end_ms) for x in df.collect())
    assert told(I.clip_join(w, p, 1)) == touching(windows, parts, 1)
    left = I.clip_join(w, p, 1, how="left")
    assert told(left.where("start_ms is not null")) == touching(windows, parts, 1)
    assert {x.clip for x in left.select("clip").distinct().collect()} == {x[1] for x in windows}


def test_a_stray_border_costs_tens_of_rows(spark):
    one = spark.createDataFrame([("m", 1, 3, 10**13), ("m", 2, 5, 2**62)], WINDOW)
    nested = I._nested(one, ("w_start", "w_end"), I._levels(I.FAR), "at")
    assert max(r["count"] for r in nested.groupBy("clip").count().collect()) < 100
    many = spark.createDataFrame([("m", k * 1000, k * 1000 + 900) for k in range(2000)], PART)
    t = time.time()
    assert I.clip_join(one, many, 1).count() == 4000 and time.time() - t < 60
    plan = I.clip_join(one, many, 1)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_bins_are_never_broadcast(spark, tmp_path):
    spark.createDataFrame([("m", k * 1000, k * 1000 + 900) for k in range(2000)], PART).write.parquet(f"{tmp_path}/p")
    spark.createDataFrame([("m", k, k, 10**13) for k in range(5)], WINDOW).write.parquet(f"{tmp_path}/w")
    many, windows = spark.read.parquet(f"{tmp_path}/p"), spark.read.parquet(f"{tmp_path}/w")  # files tell Spark how small they are
    for joined in (I.clip_join(windows, many, 1), I.clip_join(windows, many, 1, how="left")):
        plan, above = joined._jdf.queryExecution().executedPlan().toString().splitlines(), []
        assert any("Generate explode" in line for line in plan)
        for line in plan:
            depth = len(line) - len(line.lstrip(" :+-"))
            above = [(d, x) for d, x in above if d < depth] + [(depth, line)]
            assert "Generate explode" not in line or not any("BroadcastExchange" in x for _, x in above)


def test_windows_without_end_stop_at_the_last_start_of_their_medium(spark):
    windows = spark.createDataFrame([("m", 1, 3, 10**13), ("n", 2, 0, 10**13), ("none", 3, 0, 10**13)], WINDOW)
    parts = [("m", 0, 10), ("m", 9 * I.BIN_MS, 9 * I.BIN_MS + 5), ("n", 7, 8)]
    p, c = spark.createDataFrame(parts, PART), ("w_start", "w_end")
    nested = I._nested(I._reaching(windows, p, ("start_ms", "end_ms")), c, I._levels(I.FAR), "at", "_last")
    assert sorted((x.clip, x["at"].level, x["at"].bin) for x in nested.collect()) == [(1, 0, b) for b in range(1, 8)] + [(1, 0, 8), (1, 0, 9)]
    assert I.clip_join(windows, p, 1).count() == 3


@given(st.integers(-(10**6), 10**6), st.integers(0, 10**6))
@settings(max_examples=40, deadline=None)
def test_cover_is_exact_and_small(spark, low, width):
    got = spark.range(1).select(I.cover(F.lit(low).cast("long"), F.lit(low + width).cast("long"), 7).alias("c")).first().c
    ranges = sorted((n.bin << 3 * n.level, (n.bin + 1 << 3 * n.level) - 1) for n in got)
    assert ranges[0][0] == low and ranges[-1][1] == low + width and all(a[1] + 1 == b[0] for a, b in zip(ranges, ranges[1:]))
    assert len(got) <= 14 * 7 + 8


# ---- turns and islands ----


def folded(rows, gap, latest):
    """One medium's turns by a plain loop over (start, seq, end, speaker)."""
    turns = []
    for a, _, b, who in sorted(r for r in rows if r[3] is not None):
        b = max(a, b)
        if turns and turns[-1][2] == who and a - turns[-1][1] <= gap:
            turns[-1][1] = b if latest else max(turns[-1][1], b)
            turns[-1][3] += 1
        else:
            turns.append([a, b, who, 1])
    return turns


def random_turns(r, n):
    rows, at = [], 0
    for k in range(n):
        at += r.choice([0, 0, 50, 300, 2000, 9000])
        rows.append((at, k, at + r.choice([0, 100, 900, 20_000, -5]), r.choice([None, "A", "A", "A", "B"])))
    return rows


@pytest.mark.parametrize("latest", [False, True])
@pytest.mark.parametrize("span", [None, 500, 4000, 60_000])
def test_turns_equal_a_plain_fold(spark, latest, span):
    r = random.Random(str((latest, span)))
    media = {f"m{k}": random_turns(r, r.choice([1, 5, 60])) for k in range(40)}
    media["nested"] = [(0, 0, 10_000, "A"), (1000, 1, 2000, "A"), (2500, 2, 3000, "A")]
    media["unlabelled"] = [(0, 0, 1000, "A"), (1000, 1, 1100, None), (1200, 2, 2000, "A")]
    media["crossing"] = [(0, 0, 5000, "A"), (1000, 1, 6000, "B"), (5100, 2, 7000, "A"), (6900, 3, 6950, "A")]
    df = spark.createDataFrame([(m, s, a, b, w) for m, rows in media.items() for a, s, b, w in rows], TURN)
    got = Counter((x.media_id, x.start_ms, x.end_ms, x.speaker, x.n) for x in I.merge_turns(df, 250, latest, span).collect())
    assert got == Counter((m, *t) for m, rows in media.items() for t in folded(rows, 250, latest))


def test_nested_and_unlabelled_turns(spark):
    nested = spark.createDataFrame([("m", 0, 0, 10_000, "A"), ("m", 1, 1000, 2000, "A"), ("m", 2, 2500, 3000, "A")], TURN)
    assert [(x.start_ms, x.end_ms) for x in I.merge_turns(nested, 250).collect()] == [(0, 10_000)]
    assert sorted((x.start_ms, x.end_ms) for x in I.merge_turns(nested, 250, latest=True).collect()) == [(0, 2000), (2500, 3000)]
    gap = spark.createDataFrame([("m", 0, 0, 1000, "A"), ("m", 1, 1000, 1100, None), ("m", 2, 1200, 2000, "A")], TURN)
    assert [(x.start_ms, x.end_ms, x.speaker) for x in I.merge_turns(gap, 250, latest=True).collect()] == [(0, 2000, "A")]


@pytest.mark.parametrize("span", [None, 300, 5000])
def test_islands_equal_a_plain_fold(spark, span):
    r = random.Random(9)
    rows = [(f"m{k % 7}", a, max(a, b)) for k in range(30) for a, _, b, _ in random_turns(r, 12)]
    want = Counter()
    for m in {x[0] for x in rows}:
        want += Counter((m, a, b, n) for a, b, _, n in folded([(a, i, b, "") for i, (x, a, b) in enumerate(sorted(rows)) if x == m], 400, False))
    got = Counter((x.media_id, x.start_ms, x.end_ms, x.n) for x in I.merge_gap(spark.createDataFrame(rows, PART), 400, span=span).collect())
    assert got == want


def test_a_medium_of_half_of_all_rows_is_dealt_out(spark):
    n = 40_000
    rows = spark.range(n).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("m"), (F.col("id") % 50).cast("string"))).alias("media_id"), F.col("id").alias("seq"), (F.col("id") * 700).alias("start_ms"), (F.col("id") * 700 + 500).alias("end_ms"), F.when(F.col("id") % 9 < 6, "A").otherwise("B").alias("speaker"))
    parts = rows.groupBy("media_id", F.floor(F.col("start_ms") / I.SPAN_MS)).count()
    assert parts.agg(F.max("count")).first()[0] < n / 8
    for latest in (False, True):
        two, one = (Counter(map(tuple, I.merge_turns(rows, 1000, latest, span).collect())) for span in (I.SPAN_MS, None))
        assert two == one and len(two) > 4000


@pytest.mark.parametrize("part", [None, 3, 10])
def test_carried_values_equal_one_scan(spark, part):
    r = random.Random(4)
    rows = [(m, k, None if r.random() < 0.4 else r.randrange(9)) for m in ("a", "b", None) for k in sorted(r.sample(range(60), 25))]
    df = spark.createDataFrame(rows, "media_id string, k long, v long")
    by = None if part is None else F.floor(F.col("k") / part)
    kinds = {"b": "before", "f": "after", "l": "last", "x": "next", "s": "sum"}
    got = scans.carried(df, ("media_id",), (F.col("k"),), by, **{n: (kind, F.col("v")) for n, kind in kinds.items()})
    want = Counter()
    for m in ("a", "b", None):
        vs = [(k, v) for x, k, v in rows if x == m]
        for i, (k, v) in enumerate(vs):
            last = next((y for _, y in reversed(vs[: i + 1]) if y is not None), None)
            ahead = next((y for _, y in vs[i:] if y is not None), None)
            want[m, k, v, vs[i - 1][1] if i else None, vs[i + 1][1] if i + 1 < len(vs) else None, last, ahead, sum(y or 0 for _, y in vs[:i])] += 1
    assert Counter((x.media_id, x.k, x.v, x.b, x.f, x.l, x.x, x.s) for x in got.collect()) == want


def test_scans_of_speakers_in_parts(spark):
    r = random.Random(6)
    rows = [(m, k, k * 900, k * 900 + 500, r.choice([None, "A", "B"])) for m in ("a", "b") for k in range(80)]
    u = spark.createDataFrame(rows, TURN)
    same = lambda f: Counter(map(tuple, f(True).collect())) == Counter(map(tuple, f(False).collect()))
    assert same(lambda p: V.transitions(u, 7 if p else None)) and same(lambda p: V.fill_gaps(u, "speaker", 5000 if p else None))
    s, m = spark.createDataFrame([("a", 0, 3000), ("a", 5000, 9000), ("b", 40_000, 44_000), ("b", 70_000, 75_000)], PART), spark.createDataFrame([("a", 90_000), ("b", 70_000), ("c", 10)], "media_id string, total_ms long")
    assert same(lambda p: I.complement(S.boundaries(s, m), m, 7000 if p else None))
    assert {(x.media_id, x.start_ms) for x in S.boundaries(s, m).collect()} == {("a", 5000), ("b", 40_000)}  # neither at 0 nor at the end


# ---- splitting ----


def split(start, end, cuts, least, most):
    cuts, out = sorted((t, q) for q, t in cuts), [start]
    times = [t for t, _ in cuts]
    while end - out[-1] > most:
        low, high = out[-1] + least, min(out[-1] + most, end - least)
        near = cuts[bisect.bisect_left(times, low) : bisect.bisect_right(times, high)] if high > low else []
        out.append(max((q, t) for t, q in near)[1] if near else out[-1] + most)
    return list(zip(out, [*out[1:], end]))


def pieces(spark, rows, least, most):
    df = spark.createDataFrame(rows, "k int, a long, b long, cuts array<struct<quality:bigint,time:bigint>>")
    got = df.select("k", I.greedy_split(F.col("a"), F.col("b"), F.col("cuts"), least, most).alias("p")).collect()
    return {x.k: [tuple(p) for p in x.p] for x in got}


def test_split_equals_a_plain_loop(spark):
    r = random.Random(2)
    rows = []
    for k in range(150):
        a = r.randrange(0, 50_000)
        b = a + r.choice([1000, 61_000, 200_000, 900_000])
        rows.append((k, a, b, [(r.randrange(0, 5), r.randrange(a - 5000, b + 5000)) for _ in range(r.choice([0, 1, 5, 80]))]))
    assert pieces(spark, rows, 2000, 60_000) == {k: split(a, b, c, 2000, 60_000) for k, a, b, c in rows}


def test_a_window_of_twenty_hours_is_split_in_linear_time(spark):
    r = random.Random(3)
    took = {}
    pieces(spark, [(0, 0, 100_000, [(1, 5000)])], 2000, 60_000)
    for hours in (5, 20):
        end = hours * 3_600_000
        row = (hours, 0, end, [(r.randrange(0, 5000), r.randrange(0, end)) for _ in range(hours * 1200)])
        t = time.time()
        got = pieces(spark, [row], 2000, 60_000)[hours]
        took[hours] = time.time() - t
        assert got == split(0, end, row[3], 2000, 60_000)
    assert took[20] < 30 and took[20] < 8 * took[5] + 2
