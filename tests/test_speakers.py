"""Voice groups from drawn centres, refilled clusters, and nearest centroids by tiles, against numpy."""

import math
from collections import Counter

import numpy as np
import pytest

from chronofold.operators import speakers as V
from chronofold.operators import vectors

POINT = "media_id string, seq long, v array<double>"


def planted(seed, k, each, dims=12, noise=0.05):
    r = np.random.RandomState(seed)
    c = r.normal(size=(k, dims))
    x = np.repeat(c / np.linalg.norm(c, axis=1, keepdims=True), each, axis=0) + r.normal(size=(k * each, dims)) * noise
    return x / np.linalg.norm(x, axis=1, keepdims=True), np.repeat(np.arange(k), each)


def objective(x, labels):
    return sum(((x[labels == c] - x[labels == c].mean(axis=0)) ** 2).sum() for c in set(labels))


def plain_run(x, k, seed=0):
    r = np.random.RandomState(seed)
    c = [x[r.randint(len(x))]]
    for _ in range(k - 1):
        d = np.min([((x - y) ** 2).sum(axis=1) for y in c], axis=0)
        c.append(x[r.choice(len(x), p=d / d.sum())])
    c = np.array(c)
    for _ in range(50):
        labels = ((x[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)
        c = np.array([x[labels == i].mean(axis=0) if (labels == i).any() else c[i] for i in range(k)])
    return labels


def grouped(spark, media, k, **options):
    rows = [(m, i, v.tolist()) for m, x in media.items() for i, v in enumerate(x)]
    got = V.kmeans(spark.createDataFrame(rows, POINT), k, **options).collect()
    return {m: np.array([c for _, c in sorted((r.seq, r.cluster) for r in got if r.media_id == m)]) for m in media}


def test_planted_groups_are_found(spark):
    data = {f"m{s}": planted(s, 5, 30) for s in range(6)}
    got = grouped(spark, {m: x for m, (x, _) in data.items()}, 5)
    for m, (x, truth) in data.items():
        assert len(set(got[m])) == 5
        assert objective(x, got[m]) <= 1.0001 * objective(x, plain_run(x, 5)) or len(set(zip(got[m], truth))) == 5
    assert sum(len(set(zip(got[m], truth))) == 5 for m, (_, truth) in data.items()) >= 5


def test_clusters_never_vanish(spark, monkeypatch):
    """Starts that all lie in one group leave clusters empty, which are filled again."""
    x, truth = planted(3, 3, 40, noise=0.01)
    bad = lambda points, k, seed=7: points.where("seq < 3").groupBy("media_id").agg(V.F.collect_list(V._centre(V.F.array(*[V.F.lit(9.0 + i) for i in range(12)]))).alias("centres"))
    monkeypatch.setattr(V, "seeds", bad)
    got = grouped(spark, {"m": x}, 3)["m"]
    assert len(set(got)) == 3 and len(set(zip(got, truth))) == 3


def test_few_distinct_vectors_and_stopping(spark):
    same = np.tile(np.array([[1.0, 0.0]]), (10, 1))
    two = np.array([[1.0, 0.0]] * 5 + [[0.0, 1.0]] * 5)
    got = grouped(spark, {"same": same, "two": two, "one": same[:1]}, 4)
    assert len(set(got["same"])) == 1 and len(set(got["two"])) == 2 and len(got["one"]) == 1
    again = grouped(spark, {"two": two, "same": same, "one": same[:1]}, 4)
    assert all((got[m] == again[m]).all() for m in got)


def test_turn_totals(spark):
    turns = spark.createDataFrame([("m", "A", 0, 1240), ("m", "A", 5000, 6000), ("m", "B", 0, 40)], "media_id string, speaker string, start_ms long, end_ms long")
    assert {tuple(r) for r in V.turn_totals(turns).collect()} == {("m", "A", 2.2), ("m", "B", 0.0)}


# ---- nearest centroid ----


def brute(x, c):
    s = np.round(x @ c.T, 9) + 0.0
    return s.max(axis=1), s.argmax(axis=1)


@pytest.mark.parametrize("rows", [1, 16, 256])
def test_tiles_are_exact_and_skip(rows):
    c, _ = planted(5, 40, 25, dims=16)
    x, _ = planted(5, 40, 10, dims=16, noise=0.08)
    x[3] = 0.0
    tiles = vectors.Tiles(c, rows)
    value, rank = tiles.nearest(x)
    want = brute(x, c)
    assert (rank == want[1]).all() and (value == want[0]).all()
    assert rows == 256 or tiles.products < 0.5 * len(x) * len(c)
    assert sorted(np.concatenate([i for i, _ in tiles.parts])) == list(range(len(c)))


def test_a_hundred_thousand_centroids(spark):
    r = np.random.RandomState(1)
    c = r.normal(size=(100_000, 8))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    c[500] = c[77]  # a tie
    x = np.vstack([c[[77, 99_999]], r.normal(size=(300, 8))])
    model = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(c)], "label int, centroid array<double>")
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "k int, v array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    value, rank = brute(unit, c)
    got = {r_.k: (r_.nearest, r_.cosine) for r_ in vectors.assign(df, "k", "v", model, "label").collect()}
    assert {k: n for k, (n, _) in got.items()} == dict(enumerate(rank.tolist())) and got[0][0] == 77
    assert all(math.isclose(got[k][1], v, abs_tol=6e-5) for k, v in enumerate(value))
    blocks = {r_.k: (r_.nearest, r_.cosine) for r_ in vectors.assign(df, "k", "v", model, "label", 30_000).collect()}
    assert blocks == got


def test_labels_of_any_kind_and_none(spark):
    df = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [0.0, 2.0])], "k string, v array<double>")
    model = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0])], "label string, centroid array<double>")
    assert {tuple(r) for r in vectors.assign(df, "k", "v", model, "label").collect()} == {("a", "x", 0.0), ("b", "y", 1.0)}
    assert vectors.assign(df, "k", "v", model.limit(0), "label").count() == 0
    assert Counter(vectors.assign(df, "k", "v", model, "label").columns) == Counter(["k", "nearest", "cosine"])


def test_each_vector_is_judged_once(spark):
    from chronofold.plans import panel as P
    from chronofold.plans.captioning import _spread

    d = "/root/testdata/sf0.001"
    u = _spread(spark, d)
    rows = lambda df: sorted(map(tuple, df.select("media_id", "seq", "pos", "speaker").collect()))
    each = V.assignments(P.window_voices(spark, d), V.centroids_of(u, P.voices(spark, d)))
    assert rows(P.window_speakers(spark, d, u)) == rows(each)
    for q in (P.c8, P.j16):
        plan = q(spark, d)._jdf.queryExecution().optimizedPlan().toString().splitlines()
        assert any("embedding#" in line for line in plan) and not any("embedding#" in line and "pos#" in line for line in plan)


def test_a_fold_over_words_carries_no_words(spark):
    from pyspark.sql import functions as F

    from chronofold.operators.captions import spread_words

    words = spark.range(1).select(F.array(F.lit("ab"), F.lit("c"), F.lit("def")).alias("w"), F.lit(100).cast("long").alias("a"), F.lit(700).cast("long").alias("b"))
    got = words.select(spread_words(F.col("w"), F.col("a"), F.col("b")).alias("t"))
    assert [tuple(x) for x in got.first().t] == [(100, 300, "ab"), (300, 400, "c"), (400, 700, "def")]
    for part in got._jdf.queryExecution().analyzed().toString().split("aggregate(")[1:]:
        depth = [1]
        for c in part:
            depth.append(depth[-1] + (c == "(") - (c == ")"))
        assert "text" not in part[: depth.index(0)]
