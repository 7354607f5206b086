"""Mixing sources to target weights.

Each row gets a hash-random key from its id and text. Within a source, rows are dealt to key ranges;
words are summed by range, then ranges are prefix-summed, then rows within their range, so no task
holds a source. A row's place on its source's word axis is then known, and the source's budget is
cut there exactly: whole epochs, then the rest up to the cut (the row at the cut gives part).

Targets: weights repeat 1, 2, 3 over sources in code-point order (null last); each source's share of
all words stops at ``most_epochs`` times its own, and the excess is shared again by weight. Sources
in order of size by weight make that one running sum; sources are few next to rows, and only their
totals meet in one task.

Defined cases: a null or empty text has no words and takes none; a very long text is one row, cut where the
budget ends in it; a null source is a source; rows whose keys tie stand by id and size; rows that repeat
are one row with a count until the end; a source without words has target 0; an empty table gives
an empty result; other columns, whatever their names, are kept by ``mixed`` and ignored by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import blank_words, counted_out, cut, table, whole

SEED, RANGES_HEX = "mix-1", 3


def _key() -> Column:
    text = F.coalesce(F.col("text"), F.lit(""))
    return F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(text.cast("binary"))).cast("binary"))


def targets(sizes: DataFrame, most_epochs: int = 3) -> DataFrame:
    """source, source_size, target from (source, source_size): shares by weight, capped, reshared."""
    everything, by_name, by_level = W.partitionBy(F.lit(0)), W.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last()), W.partitionBy(F.lit(0)).orderBy("_level", F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    s = sizes.withColumn("_w", (F.row_number().over(by_name) - 1) % 3 + 1)
    s = s.withColumn("_level", F.col("source_size") / F.col("_w"))
    total, weights = F.sum("source_size").over(everything), F.sum("_w").over(everything)
    done, gone = F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most_epochs, F.coalesce(F.sum("_w").over(before), F.lit(0))
    s = s.withColumn("_share", (total - done).cast("double") / (weights - gone))
    s = s.withColumn("_capped", most_epochs * F.col("source_size") <= F.col("_share") * F.col("_w"))
    s = s.withColumn("_fill", F.first(F.when(~F.col("_capped"), F.col("_share")), ignorenulls=True).over(by_level.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    return s.select("source", "source_size", F.when(F.col("_capped"), (most_epochs * F.col("source_size")).cast("double")).otherwise(F.col("_fill") * F.col("_w")).alias("target"))


def mix(docs: DataFrame, most_epochs: int = 3) -> DataFrame:
    """_key, _copy, _many, doc_id, source, size, source_size, target, taken of each row of docs."""
    rows = docs.select("doc_id", "source", F.size(blank_words(F.col("text"))).cast("long").alias("size"), _key().alias("_key"))
    rows = cut(rows.groupBy("source", "_key", "doc_id", "size").agg(F.count("*").alias("_many")).withColumn("_range", F.substring("_key", 1, RANGES_HEX)))
    words = F.col("size") * F.col("_many")
    ranges = rows.groupBy("source", "_range").agg(F.sum(words).alias("_words"))
    goals = targets(ranges.groupBy("source").agg(F.sum("_words").alias("source_size")), most_epochs)
    earlier = W.partitionBy("source").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.withColumn("_from", F.coalesce(F.sum("_words").over(earlier), F.lit(0))).drop("_words")
    goals = goals.select(F.col("source").alias("_s"), "source_size", "target")
    ranges = ranges.join(goals, ranges["source"].eqNullSafe(goals["_s"])).drop("_s").withColumnsRenamed({"source": "_s", "_range": "_r"})
    within = W.partitionBy("source", "_range").orderBy("_key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("_begin", F.coalesce(F.sum(words).over(within), F.lit(0)))
    placed = placed.join(ranges, placed["source"].eqNullSafe(ranges["_s"]) & (placed["_range"] == ranges["_r"]))
    placed = counted_out(placed, F.lit(1).cast("long"), F.col("_many"), "_copy")
    begin = F.col("_from") + F.col("_begin") + (F.col("_copy") - 1) * F.col("size")
    budget = F.round("target").cast("long")
    epochs = F.coalesce(F.try_divide(budget, F.col("source_size")).cast("long"), F.lit(0))
    rest = budget - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - begin))
    return placed.select("_key", "_copy", "_many", "doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def numbered(rows: DataFrame) -> DataFrame:
    """Different rows (_doc) of each _source and _key, with the copy numbers _first to _last that they hold, from 1 on.

    Rows that are equal in every column are counted in each task first, so one that repeats without end is never gathered.
    """
    alike = rows.groupBy("_source", "_key", F.md5(F.to_json("_doc").cast("binary")).alias("_variant")).agg(F.any_value("_doc").alias("_doc"), F.count("*").alias("_n"))
    last = F.sum("_n").over(W.partitionBy("_source", "_key").orderBy("_variant"))
    return alike.select("_source", "_key", "_doc", (last - F.col("_n") + 1).alias("_first"), last.alias("_last"))


def mixed(docs: DataFrame, most_epochs: int = 3) -> DataFrame:
    """The mix itself: each row as often as its epochs, and the row at a cut with its first words only."""
    plan = mix(docs, most_epochs).where("taken > 0").select(F.col("source").alias("_s"), F.col("_key").alias("_k"), F.col("_copy").alias("_c"), "_many", F.col("size").alias("_size"), "taken")
    rows = docs.select(whole(docs).alias("_doc"), F.col("source").alias("_source"), _key().alias("_key"))
    of = (F.col("_key") == F.col("_k")) & F.col("_source").eqNullSafe(F.col("_s"))
    met = rows.join(plan.where("_many = 1"), of)
    again = cut(plan.where("_many > 1"))
    if not again.isEmpty():  # only rows that repeat are numbered
        repeated = rows.join(again.select("_k", "_s").distinct(), of, "left_semi")
        met = met.unionByName(numbered(repeated).join(again, of & F.col("_c").between(F.col("_first"), F.col("_last"))).drop("_first", "_last"))
    # at most most_epochs turns
    met = met.withColumn("_turn", F.explode(F.sequence(F.lit(0).cast("long"), F.try_divide(F.col("taken") - 1, F.col("_size")).cast("long"))))
    words = F.least(F.col("_size"), F.col("taken") - F.col("_turn") * F.col("_size"))
    cut_short = words < F.col("_size")
    text = F.when(cut_short, F.array_join(F.slice(blank_words(F.col("_doc.text")), 1, words.cast("int")), " ")).otherwise(F.col("_doc.text"))
    chars = {"n_chars": F.when(cut_short, F.length(text).cast("long")).otherwise(F.col("_doc.n_chars"))} if "n_chars" in docs.columns else {}
    new = {"text": text} | chars
    return met.select(*[new.get(c, F.col("_doc")[c]).alias(c) for c in docs.columns])


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows of the mix, repeated or cut as their source's budget says."""
    return mixed(docs)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS size,
    md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
l AS (
  SELECT *, CAST(CAST(sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER b, 0) AS BIGINT) AS DOUBLE) / CAST(sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS DOUBLE) AS share
  FROM s WINDOW b AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, 3 * source_size <= share * w AS capped FROM l),
g AS (SELECT source, source_size, CASE WHEN capped THEN CAST(3 * source_size AS DOUBLE) ELSE (SELECT arg_min(share, source_size / w) FROM c WHERE NOT capped) * w END AS target FROM c),
p AS (SELECT d.*, source_size, target, CAST(round(target) AS BIGINT) AS budget, CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begins
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(coalesce(budget // nullif(source_size, 0), 0) * size + greatest(0, least(size, budget - coalesce(budget // nullif(source_size, 0), 0) * source_size - begins)) AS BIGINT) AS taken
FROM p
"""
