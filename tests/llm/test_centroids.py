"""Centroid clustering against plain Python whole-number arithmetic; ties, odd vectors, hot vectors, partial search."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from compare import difference

from chronofold.llm import centroids as C

SF = "/root/testdata/sf0.001"


def plainly(rows, k=16, rounds=3, dims=64, scale=64.0, seed=1):
    kept = [(i, [max(-(1 << 27), min(1 << 27, math.floor(scale * x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: ((1, "") if r[0] is None else (0, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest()), r[1]))
    centres = [v for _, v in first[:k]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((apart(v, c), i) for i, c in enumerate(centres))
    for _ in range(rounds):
        met = [(near(v)[1], v) for _, v in kept]
        groups = {c: [v for i, v in met if i == c] for c, _ in met}
        centres = [[sum(x) // len(groups[i]) for x in zip(*groups[i])] if i in groups else c for i, c in enumerate(centres)]
    out = [(i, *near(v)) for i, v in kept]
    by = Counter()
    for _, d, c in out:
        by[c] += d
    fits = lambda v: v if v < 1 << 63 else None
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return Counter((i, c, d, fits(by[c]), fits(sum(by.values())), digest[c]) for i, d, c in out)


def told(df, **options):
    return Counter(tuple(r) for r in C.assign(df, C.fit(df, **options)).collect())


def frame(spark, rows, kind="float"):
    return spark.createDataFrame([(*r, 1, "clash") for r in rows], f"vec_id long, embedding array<{kind}>, cluster int, inertia string")


def test_odd_vectors(spark):
    r = random.Random(3)
    some = [[r.randrange(-8, 8) / 4 for _ in range(64)] for _ in range(40)]
    rows = [(i, v) for i, v in enumerate(some)] + [(i, some[0]) for i in range(100, 160)] + [(7, some[9])] * 3 + [(None, some[5]), (None, some[6])]
    rows += [(200, None), (201, []), (202, [1.0] * 63), (203, [1.0] * 65), (204, [None] + [0.0] * 63), (205, [float("nan")] * 64), (206, [float("inf")] + [0.0] * 63), (207, [-1e30, 3e38] + [0.0] * 62), (208, [-0.001] * 64)]
    assert told(frame(spark, rows).repartition(5)) == plainly(rows)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few_vectors(spark, n):
    rows = [(i, [float(i % 3)] * 64) for i in range(n)]
    assert told(frame(spark, rows)) == plainly(rows)


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(i % 4), float(i // 4 % 4)]) for i in range(64)]
    options = {"k": 9, "rounds": 4, "dims": 2, "scale": 1.0, "seed": 5}
    assert told(frame(spark, rows, "double"), **options) == plainly(rows, **options)


def test_whole_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    assert told(df) == plainly([tuple(r) for r in df.collect()])
    assert not difference(C.op12(spark, SF), C.ORACLE, SF)


def test_partial_search_is_exact_and_saves_work():
    r = np.random.RandomState(1)
    x = r.randint(-50, 50, (5000, 64)) * np.where(np.arange(64) % 9 == 0, 20, 1)
    order = np.argsort(-x.var(axis=0))
    cluster, distance, work = C.nearest(x, x[:16], order)
    full = np.stack([((x - c) ** 2).sum(axis=1) for c in x[:16]], axis=1)
    assert (cluster == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()
    assert work < 0.5 * 5000 * 16 * 64 and C.nearest(x, x[:16], np.arange(64))[2] > work


def test_order_of_components(spark):
    rows = [(i, [0.0] * 60 + [i * 0.1, i * 5.0, 1.0, i * 1.0]) for i in range(30)]
    assert C.spread(frame(spark, rows).select("vec_id", "embedding"), 64, 64.0)[:3].tolist() == [61, 63, 60]
    assert C.spread(frame(spark, []).select("vec_id", "embedding"), 64, 64.0).tolist() == list(range(64))
