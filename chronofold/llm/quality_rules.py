"""Quality rules: learned decision lists over per-text statistics (DataFrame functions only).

``text_statistics`` measures every whole text; ``learn_rules`` grows and prunes threshold
conjunctions by sequential covering on the statistics of labelled rows; ``verdict`` turns the
ordered list into one Spark conditional expression.

Defined cases: a null or empty text has zero for each statistic and fails the base rules; a very long text
is measured whole, in its row; repeated rows are judged one by one; of conditions that tie in gain the
first feature and threshold wins, so runs agree; a label that repeats counts as often, up to most_rows; an
empty table gives an empty result; without labels of both classes the list is empty and only the
base rules decide; other columns are kept, and a column that bears the name of a statistic is replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, blank_words, table, whole

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What the learned rules may test: each is a ratio, so that long and short texts compare.
FEATURES = ("symbol_rate", "upper_share", "mark_rate", "digit_share", "dup_line_rate", "repeat_share", "mean_word", "stop_share")
#: Very common words of the corpus' languages.
COMMON = ("the", "of", "and", "to", "in", "is", "de", "la", "que", "el", "les", "des", "et", "le", "der", "die", "und", "das", "los", "del")


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the base counts (long) and the ratios (double). All work stays within a row: no shuffle.

    A word is repeated if it lies in a three-word window that occurs twice or more in the text. The
    windows are hashed; where a hash occurs twice, hashes are sorted with their positions, equal
    neighbours kept, and the words they cover counted by a fold over ascending positions.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    w, h, s, n = F.col("_w"), F.col("_h"), F.col("_s"), F.size("_w")
    same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
    kept_chars = lambda others: F.length(F.regexp_replace(t, others, ""))
    out = docs.drop(*BASE, *FEATURES).withColumn("_w", blank_words(t))
    out = out.withColumn("_h", F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))))
    out = out.withColumn("_s", F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))))
    out = out.withColumn("_p", F.sort_array(F.transform(F.filter(s, lambda x, i: same(F.get(s, i - 1), x) | same(F.get(s, i + 1), x)), lambda x: x["p"])))
    covered = F.aggregate(
        "_p",
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"), p.alias("last")),
    )["n"]
    out = out.withColumn("_l", F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0))
    out = out.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(F.array_join(w, "")).cast("long"),
            "n_symbols": kept_chars("[^#*$%&|<>]+").cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
            "_lines": F.size("_l"),
            "_upper": kept_chars("\\P{Lu}+"),
            "_marks": kept_chars("[^!?]+"),
            "_digits": kept_chars("[^0-9]+"),
            "_stop": F.size(F.filter(w, lambda x: x.isin(*COMMON))),
        }
    )
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    ratios = {
        "symbol_rate": share("n_symbols", "n_words"), "upper_share": share("_upper", "word_chars"), "mark_rate": share("_marks", "n_words"), "digit_share": share("_digits", "word_chars"),
        "dup_line_rate": share("n_dup_lines", "_lines"), "repeat_share": share("n_repeat_words", "n_words"), "mean_word": share("word_chars", "n_words"), "stop_share": share("_stop", "n_words"),
    }
    return out.withColumns(ratios).drop("_w", "_h", "_s", "_p", "_l", "_lines", "_upper", "_marks", "_digits", "_stop")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def column(self) -> Column:
        return F.col(self.feature) > F.lit(self.threshold) if self.above else F.col(self.feature) <= F.lit(self.threshold)


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    hit = np.ones(n, bool)
    for c in rule:
        hit &= c.holds(x)
    return hit


def _grow(x, bad, inside, cuts, most_conditions: int) -> Rule:
    """Add the condition of greatest information gain until only bad rows are covered."""
    rule: Rule = ()
    while len(rule) < most_conditions:
        p, n = (inside & bad).sum(), (inside & ~bad).sum()
        if not n or not p:
            break
        best, best_gain = None, 1e-9
        before = math.log2(p / (p + n))
        for f, thresholds in cuts.items():
            v = x[f][inside]
            order = np.argsort(v, kind="stable")
            v, b = v[order], bad[inside][order]
            bad_to = np.concatenate([[0], np.cumsum(b)])
            upto = np.searchsorted(v, thresholds, "right")
            for above in (True, False):
                pp = p - bad_to[upto] if above else bad_to[upto]
                tt = len(v) - upto if above else upto
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(pp > 0, pp * (np.log2(pp / np.maximum(tt, 1)) - before), -1.0)
                k = int(np.argmax(gain))
                if gain[k] > best_gain:
                    best, best_gain = Condition(f, above, float(thresholds[k])), gain[k]
        if best is None:
            break
        rule += (best,)
        inside = inside & best.holds(x)
    return rule


def _prune(rule: Rule, x, bad, inside) -> Rule:
    """Drop final conditions while (p - n) / (p + n) on the pruning rows doesn't fall."""

    def worth(r: Rule) -> float:
        hit = inside & _covers(r, x, len(bad))
        return (2 * (hit & bad).sum() - hit.sum()) / hit.sum() if hit.any() else -1.0

    while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
        rule = rule[:-1]
    return rule


def learn_rules(rows: list, most_rules: int = 12, most_conditions: int = 3, cuts_per_feature: int = 64, least_precision: float = 0.8, least_covered: int = 3) -> list[Rule]:
    """Sequential covering over (features..., bad) rows: each rule rejects, what none covers is kept.

    Two of three rows grow a rule and the third prunes it; a rule enters the list only if, over all
    rows it newly covers, at least least_precision of them are bad.
    """
    if not rows:
        return []
    data = np.array([[float(v) for v in r] for r in rows], float)
    x, bad = {f: data[:, i] for i, f in enumerate(FEATURES)}, data[:, -1] > 0
    n = len(bad)
    if not bad.any() or bad.all():
        return []
    growing = np.arange(n) % 3 != 2
    cuts = {f: np.unique(np.quantile(v, np.linspace(0, 1, cuts_per_feature + 1), method="nearest")) for f, v in x.items()}
    left, rules = np.ones(n, bool), []
    while len(rules) < most_rules and (left & bad & growing).any():
        rule = _grow(x, bad, left & growing, cuts, most_conditions)
        if not rule:
            break
        rule = _prune(rule, x, bad, left & ~growing)
        hit = left & _covers(rule, x, n)
        if (hit & bad).sum() < least_covered or (hit & bad).sum() < least_precision * hit.sum():
            break
        rules.append(rule)
        left &= ~hit
    return rules


def labelled_statistics(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000) -> list:
    """(features..., bad) of a bounded sample of labelled rows: those of the smallest id hashes.

    most_rows bounds what is broadcast and what comes to the driver, at any size of the tables.
    """
    key = F.xxhash64(F.col("doc_id").cast("string"))
    ids = labels.where("doc_id is not null and quality is not null").select("doc_id", F.col("quality").cast("int").alias("_quality"))
    ids = ids.withColumn("_key", key).orderBy("_key", "doc_id", "_quality").limit(most_rows)
    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    found = text_statistics(found).select("_key", *FEATURES, (F.col("_quality") == 0).cast("int").alias("_bad"))
    return [tuple(r)[1:] for r in found.orderBy("_key", *FEATURES, "_bad").limit(most_rows).collect()]


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def verdict(rules: list[Rule]) -> Column:
    """The decision list as one conditional expression: first rule that holds rejects, else kept."""
    chain = F.when(base_failed(), False)
    for rule in rules:
        hit = rule[0].column()
        for c in rule[1:]:
            hit = hit & c.column()
        chain = chain.when(hit, False)
    return chain.otherwise(True)


def judge(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000) -> DataFrame:
    """docs with base counts, ratios, base_failed and kept."""
    rules = learn_rules(labelled_statistics(docs, labels, most_rows))
    return text_statistics(docs).withColumns({"base_failed": base_failed(), "kept": verdict(rules)})


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *BASE, "base_failed", "kept")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the rules reject go.

    A row travels as a struct, so columns named like a statistic stay as they are. The filter refers to
    an id that is never negative: over such a column the optimizer does not push the filter down, which
    would copy the nested statistics into it many times over.
    """
    held = docs.select("doc_id", "text", whole(docs).alias("_doc"))
    judged = judge(held, table(spark, sf_dir, "labels")).withColumn("_hold", F.monotonically_increasing_id())
    return judged.where(F.col("kept") & (F.col("_hold") >= 0)).select("_doc.*")
