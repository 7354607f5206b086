"""Benchmark decontamination: prefix-filtered set join of item windows with documents (DataFrame functions only).

A window is ``window`` consecutive words of an item (or all words of a shorter item). A document
contains a window only if it contains each of the window's tokens, so for containment the prefix
that must be joined is one token: the rarest. Rarity is the token's count over all documents.

1. Count how often each token of the items occurs in the documents.
2. Each window keeps its rarest token and that token's offset.
3. Document tokens are joined with these. The offset says where the window would begin; positional
   and length bounds drop what would stick out; the words there are compared exactly.
4. Hits are gathered by document: covered words by a fold over ascending starts, items as a set.

The item side is broadcast only while it has at most ``most_broadcast`` rows and ``most_bytes`` bytes,
both counted. Beyond that, (token, place) rows, without the text, are joined by token with one row for
each window, where adaptive execution splits skewed tokens; what passes the bounds is compared in a
join with the texts of those documents. Both ways give the same rows.

Beyond it rows are known by id and a digest of the text: rows equal in both are found once and each get the result.

Defined cases: a null or empty text has no words, so no hits; null or empty items give no windows;
equal windows of several items count for each of them; item ids that repeat count once; a null item
id's windows hit words but name no item; of tokens that tie in rarity the smallest, at its first
offset, counts, which changes no result; rows that repeat a doc_id are judged by their own texts, null
ids too; a very long text is one array of words; empty tables give no hits or no rows; other columns,
whatever their names, are kept by ``clean`` and ignored by ``hits``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, cut, table, whole, words_by

#: Fixed value: what separates words, all ASCII but digits and letters (after lower-casing).
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def _words(text: Column) -> Column:
    return words_by(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS)


def windows(items: DataFrame, window: int = 10) -> DataFrame:
    """(w, n, ids): distinct windows with their word count and the items that have them."""
    w = F.col("_w")
    of = items.select(F.col("item_id"), _words(F.col("text")).alias("_w")).where(F.size("_w") > 0)
    parts = F.when(F.size(w) < window, F.array(w)).otherwise(F.transform(F.sequence(F.lit(1), F.size(w) - (window - 1)), lambda i: F.slice(w, i, window)))
    each = of.select("item_id", F.explode(parts).alias("w"))
    return each.groupBy("w").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("ids")).withColumn("n", F.size("w"))


def digest(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _fits(df: DataFrame, size: Column, most_rows: int, most_bytes: int) -> bool:
    n, total = df.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return n <= most_rows and total <= most_bytes


def hits(docs: DataFrame, items: DataFrame, window: int = 10, most_broadcast: int = 200_000, most_bytes: int = 64 << 20) -> DataFrame:
    """Per row of docs: doc_id, h (the text's digest), n_words, n_hit, n_items, item_ids (sorted as strings)."""
    wins = cut(windows(items, window))
    offered = wins.select("w", "n", F.posexplode("w").alias("off", "token"))
    words = docs.select("doc_id", digest(F.col("text")).alias("h"), _words(F.col("text")).alias("_w"))
    tokens = cut(offered.select("token").distinct())
    each = words.select(F.explode("_w").alias("token"))
    if _fits(tokens, F.octet_length("token"), most_broadcast, most_bytes):
        common = each.join(F.broadcast(tokens), "token").groupBy("token").count()
    else:
        common = each.groupBy("token").count().join(tokens, "token")
    ranked = offered.join(common, "token", "left").fillna(0, ["count"]).groupBy("w", "n").agg(F.min_by(F.struct("token", "off"), F.struct("count", "token", "off")).alias("p"), F.min("count").alias("rarest"))
    ranked = ranked.where("rarest > 0").join(wins.select("w", "ids"), "w")  # a token that no document has rules its window out
    prefix = cut(ranked.select(F.col("p.token").alias("token"), F.col("p.off").cast("long").alias("off"), "w", "n", "ids"))
    begin = F.col("at") - F.col("off")
    inside = (begin >= 0) & (begin + F.col("n") <= F.col("n_words"))
    there = F.slice("_w", (begin + 1).cast("int"), F.col("n")) == F.col("w")
    placed = words.withColumn("n_words", F.size("_w").cast("long"))
    weight = F.octet_length(F.array_join("w", " ")) + F.octet_length(F.array_join("ids", " ")) + 64
    span = F.struct(begin.alias("b"), (begin + F.col("n")).alias("e"))
    spans, of = F.sort_array(F.collect_set("span")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("item_ids")
    if _fits(prefix, weight, most_broadcast, most_bytes):
        # one pass: each row's first word comes out in any case, so that rows without hits do
        each = placed.withColumn("_row", F.monotonically_increasing_id()).select("doc_id", "h", "_row", "_w", "n_words", F.posexplode_outer("_w").alias("at", "token"))
        met = each.join(F.broadcast(prefix), "token", "left")
        real = F.coalesce(inside & F.when(inside, there), F.lit(False))
        met = met.select("doc_id", "h", "_row", "n_words", "at", F.when(real, span).alias("span"), F.when(real, F.col("ids")).alias("ids")).where("span is not null or at is null or at = 0")
        out = met.groupBy("doc_id", "h", "_row", "n_words").agg(spans, of).drop("_row")
    else:
        met = placed.select("doc_id", "h", "n_words", F.posexplode("_w").alias("at", "token")).join(prefix, "token").where(inside)
        met = met.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "at", "off", "n", "w", "ids").distinct()
        met = words.join(met, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))).where(there)
        found = met.select("_id", "_h", span.alias("span"), "ids").groupBy("_id", "_h").agg(spans, of)
        out = placed.select("doc_id", "h", "n_words").join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left")
    zero = F.lit(0).cast("long")
    hit = F.aggregate(
        F.coalesce("spans", F.array().cast("array<struct<b:bigint,e:bigint>>")),
        F.struct(zero.alias("n"), zero.alias("to")),
        lambda acc, s: F.struct((acc["n"] + F.greatest(zero, s["e"] - F.greatest(s["b"], acc["to"]))).alias("n"), F.greatest(acc["to"], s["e"]).alias("to")),
    )["n"]
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return out.select("doc_id", "h", "n_words", hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the rows that hold a window of an item."""
    bad = hits(docs.select("doc_id", "text"), items).where("n_hit > 0").select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).distinct()
    held = docs.select(whole(docs).alias("_doc"), "doc_id", digest(F.col("text")).alias("h"))
    return held.join(bad, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left_anti").select("_doc.*")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a window of a benchmark item go."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS g
  FROM b, LATERAL (SELECT unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
occ AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM d, sizes, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i) WHERE len(w) >= n),
met AS (SELECT occ.doc_id, occ.i, occ.n, win.item_id FROM occ JOIN win USING (n, g)),
spans AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM met) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM met) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN spans USING (doc_id) LEFT JOIN found USING (doc_id)
"""
