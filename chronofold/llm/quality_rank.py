"""Quality classifier: Bradley-Terry pairwise ranking over text statistics.

A preference pair is a good text over a bad one. The model is a linear score; the chance that one
text beats another is the logistic function of the difference of their scores, so the logistic loss
on feature differences is what is minimised. Scores are then cut at a quantile: the cut is the
quantile of the training scores that best separates the labels, and a logistic curve through it
gives the output score, 0.3 at the cut.

Labels are learned from at most ``most_rows`` rows (those of the smallest id hashes) outside the
held-out fold, in at most ``most_pairs`` pairs; every text is measured and scored.

Defined cases: a null or empty text is measured as no words and scored like any other; a very long text
is measured whole; rows that repeat are scored one by one; of quantiles that tie the middle one is
the cut; a label that repeats counts as often, up to most_rows; an empty table gives an empty result;
without labels of both classes every score is 0.5; a null doc_id is held in neither fold's training
and held_out is false for it; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import find_words, hash_words, mix, ship, table, text_slices

NAMES = ("log_words", "symbol_rate", "bar_rate", "upper_share", "mark_rate", "digit_share", "mean_word", "short_share", "wide_share", "line_rate", "comma_rate", "stop_rate", "distinct_share", "repeat_share", "line_repeat")
CLASSES = np.zeros((256, 8), np.int32)
for _k, _chars in enumerate((b"#*$%&<>|", b"|", bytes(range(65, 91)), b"!?", b"0123456789", b",", b".", b"\n")):
    CLASSES[list(_chars), _k] = 1


def measure(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of NAMES for each text of a slice."""
    rows = len(at) - 1
    start, end, row = find_words(raw, at)
    n = np.bincount(row, minlength=rows).astype(float)
    at_least = np.maximum(n, 1)
    size = (end - start).astype(float)
    chars = np.maximum(np.bincount(row, size, rows), 1)
    total = np.zeros((8, rows))
    for k in range(8):
        sums = np.concatenate([[0], np.cumsum(CLASSES[raw, k], dtype=np.int64)])
        total[k] = sums[at[1:]] - sums[at[:-1]]
    wide = np.concatenate([[0], np.cumsum(raw >= 0xC0, dtype=np.int64)])
    h = hash_words(raw, start, end)
    to = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    with np.errstate(over="ignore"):
        three = mix(h[2:] + mix(h[1:-1] + mix(h[:-2]) * np.uint64(3)) * np.uint64(5)) if len(h) > 2 else h[:0]
    distinct, repeat = np.ones(rows), np.zeros(rows)
    for r in np.flatnonzero(n > 2):
        a, b = to[r], to[r + 1]
        distinct[r] = len(np.unique(h[a:b])) / (b - a)
        repeat[r] = 1 - len(np.unique(three[a : b - 2])) / (b - a - 2)
    return np.stack(
        [np.log1p(n), total[0] / at_least, total[1] / at_least, total[2] / chars, total[3] / at_least, total[4] / chars, chars / at_least, np.bincount(row, size <= 3, rows) / at_least, (wide[at[1:]] - wide[at[:-1]]) / chars, total[7] / at_least, total[5] / at_least, total[6] / at_least, distinct, repeat, total[7] * repeat / at_least],
        1,
    )


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each text, as an array."""
    ship(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i, n, raw, at in text_slices(batch.column(1)):
                x = measure(raw, at)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1)))], ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, x array<double>")


@dataclass(frozen=True)
class Ranking:
    """Steps of each statistic, their weights, and the line from score to logit."""

    cuts: tuple[np.ndarray, ...]
    weights: np.ndarray
    slope: float
    offset: float

    def steps(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([(x[:, [k]] > c[None, :]) for k, c in enumerate(self.cuts)], 1).astype(np.float32)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.steps(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(x) + self.offset, -30, 30)))


def learn(x: np.ndarray, good: np.ndarray, cutoff: float = 0.3, most_pairs: int = 400_000, steps: int = 12, passes: int = 3) -> Ranking | None:
    """Fit weights on preference pairs, then the cut on quantiles of the training scores."""
    good = good.astype(bool)
    if not good.any() or good.all():
        return None
    cuts = tuple(np.unique(np.quantile(np.concatenate([v[good], v[~good]]), np.linspace(0, 1, steps + 1)[:-1], method="nearest").tolist() + np.quantile(v[~good], np.linspace(0, 1, steps + 1)[:-1], method="nearest").tolist()) for v in x.T)
    model = Ranking(cuts, np.zeros(sum(map(len, cuts)), np.float32), 1.0, 0.0)
    f = model.steps(x)
    rng = np.random.RandomState(5)
    up, down = np.flatnonzero(good), np.flatnonzero(~good)
    pairs = min(most_pairs, len(up) * len(down))
    w, grad2 = np.zeros(f.shape[1]), np.full(f.shape[1], 1e-6)
    for _ in range(passes):
        for _ in range(max(20, pairs // 2048)):
            d = f[rng.choice(up, 2048)] - f[rng.choice(down, 2048)]
            g = -d.T @ (1 / (1 + np.exp(np.clip(d @ w, -30, 30)))) / len(d) + 1e-4 * w
            grad2 += g * g
            w -= 0.3 * g / np.sqrt(grad2)
    s = f @ w
    tried = np.unique(np.quantile(s, np.linspace(0, 1, 401)))
    # the cut: the score quantile of best accuracy on the training labels, halfway to the next score below
    bad_to = np.searchsorted(np.sort(s[~good]), tried) / max(1, (~good).sum())
    good_to = np.searchsorted(np.sort(s[good]), tried) / max(1, good.sum())
    share = good.mean()
    worth = share * (1 - good_to) + (1 - share) * bad_to
    best = np.flatnonzero(worth >= worth.max() - 1e-12)
    cut = float(tried[best[len(best) // 2]])
    below = s[s < cut]
    cut = (cut + float(below.max())) / 2 if len(below) else cut
    a, y, z = 1.0, good.astype(float), s - cut
    b = np.log(cutoff / (1 - cutoff))
    for _ in range(100):  # the slope of a logistic curve that passes the cut at the cutoff
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        a = float(np.clip(a - ((p - y) @ z / len(z) + 1e-3 * (a - 1)) / ((p * (1 - p)) @ (z * z) / len(z) + 1e-3), 0.05, 20))
    return Ranking(cuts, w.astype(np.float32), a, float(b - a * cut))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000) -> Ranking | None:
    key = F.xxhash64(F.col("doc_id").cast("string"))
    ids = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").cast("int").alias("y"), key.alias("k"))
    ids = ids.orderBy("k", "doc_id", "y").limit(most_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(ids.select("doc_id").distinct()), "doc_id", "left_semi")
    rows = measured(texts).join(F.broadcast(ids), "doc_id").orderBy("k", "x", "y").limit(most_rows).select("x", "y").collect()
    if not rows:
        return None
    return learn(np.array([r.x for r in rows]), np.array([r.y for r in rows]) == 1)


def scored(docs: DataFrame, model: Ranking | None) -> DataFrame:
    """doc_id and score of every row of docs, measured and scored in one pass."""
    ship(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i, n, raw, at in text_slices(batch.column(1)):
                score = model.score(measure(raw, at)) if model else np.full(n, 0.5)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n).cast(pa.int64()), pa.array(score.astype(float))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scored(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
