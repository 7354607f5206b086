"""MinHash near-dedup: one-permutation hashing, optimal densification, bands, star-shaped candidates.

``labelled`` finds, for each row, the component of texts that links of the wanted similarity join.

1. ``signatures`` reads each whole text: its shingle set's size and digest, and 40 band keys. Equal sets
   form a class. A group of copies, however large, is one row from here on.
2. Classes with a key in common share a bucket. Each bucket has one hub, its member that meets others
   most often over all its buckets: of a text and its edited copies, the text. Members are paired with
   their hubs alone, so there are at most as many pairs as (class, key) rows.
3. Pairs are confirmed on full sets and linked classes joined to components.
4. What the stars leave open is settled exactly. A bucket is open if it holds two components or more;
   two similar sets of an open bucket must share one of their rarest shingles (prefix filter), far
   enough from the end to reach the similarity (positional filter). Rarest first, edits of one text
   come before what they share, so unlike edits don't meet. Shingles that one component alone has
   are dropped, and members of a shingle's largest component are not paired with each other.

No pair that shares a bucket is passed over, no step repeats until something settles but the joining of
components, and no list of a bucket's members is ever gathered. Two sets at the least similarity,
0.8, share no bucket in 1 of 10 million cases if bins are independent (small sets depart from that).

Defined cases: a null, empty or blank text has an empty set, is linked with nothing and is its own
component; a text of fewer words than a shingle is one shingle; a very long text is one set like any other, read in one
piece; rows that repeat an id are judged by their own texts; a row with a null id takes part, and its
component is the smallest id of its texts' component, null if that has none; repeated rows are copies;
of hubs that tie the class written first counts, which changes pairs but no component; an empty table gives an
empty result; other columns, whatever their names, are not touched.

Intermediate tables are written below ``spark.checkpoint.dir`` and dropped when done with, but for
those that the result reads.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BLANKS, TO_LOWER, Scratch, find_words, hash_words, mix, ship, small, table, text_slices, whole

BANDS, ROWS = 40, 5
BINS = BANDS * ROWS
SIGNED = "doc_id long, h binary, n_shingles long, d1 long, d2 long, keys array<long>"


def shingle_sets(raw: np.ndarray, at: np.ndarray, size: int):
    """Distinct shingle hashes of each row: (all hashes, sorted within rows; row offsets)."""
    raw = TO_LOWER[raw]
    start, end, row = find_words(raw, at)
    h = hash_words(raw, start, end)
    rows = len(at) - 1
    n_words = np.bincount(row, minlength=rows)
    with np.errstate(over="ignore"):
        if len(h) >= size:
            g = np.zeros(len(h) - size + 1, np.uint64)
            for k in range(size):
                g = mix(g * np.uint64(0x9FB21C651E98DF25) + h[k : len(h) - size + 1 + k] + np.uint64(1))
            whole = row[: len(g)] == row[size - 1 :]
            g, of = g[whole], row[: len(g)][whole]
        else:
            g, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((n_words > 0) & (n_words < size))
    ends = np.cumsum(n_words)
    counts = np.maximum(n_words - size + 1, 0)
    if len(short):  # the whole sequence as one shingle
        extra = np.array([int.from_bytes(hashlib.blake2b(h[ends[r] - n_words[r] : ends[r]].tobytes(), digest_size=8).digest(), "little") for r in short], np.uint64)
        g, of = np.concatenate([g, extra]), np.concatenate([of, short])
        order = np.argsort(of, kind="stable")
        g, of = g[order], of[order]
        counts[short] = 1
    to = np.concatenate([[0], np.cumsum(counts)])
    g = g.copy()
    for r in np.flatnonzero(counts > 1):
        g[to[r] : to[r + 1]].sort()
    fresh = np.ones(len(g), bool)
    fresh[1:] = (g[1:] != g[:-1]) | (of[1:] != of[:-1])
    return g[fresh], np.concatenate([[0], np.cumsum(np.bincount(of[fresh], minlength=rows))]).astype(np.int64)


def one_permutation(values: np.ndarray, to: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Signature matrix: the least hash in each bin; an empty bin copies a full one.

    Which one it copies depends on the bin and the try alone (a universal hash), so two sets that
    have the same full bins make the same copies.
    """
    rows = len(to) - 1
    row = np.repeat(np.arange(rows), np.diff(to))
    bin_of = (((values >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int64)
    first = np.ones(len(values), bool)
    first[1:] = (row[1:] != row[:-1]) | (bin_of[1:] != bin_of[:-1])
    sig, full = np.zeros((rows, bins), np.uint64), np.zeros((rows, bins), bool)
    sig[row[first], bin_of[first]] = values[first]
    full[row[first], bin_of[first]] = True
    r, k = np.nonzero(~full & full.any(1)[:, None])
    tries = 1
    with np.errstate(over="ignore"):
        while len(r):
            donor = ((mix(k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(tries)) >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
            ok = full[r, donor]
            sig[r[ok], k[ok]] = sig[r[ok], donor[ok]]
            r, k, tries = r[~ok], k[~ok], tries + 1
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One key for each band of five bins."""
    with np.errstate(over="ignore"):
        part = sig.reshape(len(sig), BANDS, ROWS)
        keys = np.zeros((len(sig), BANDS), np.uint64)
        for k in range(ROWS):
            keys = mix(keys * np.uint64(0x9FB21C651E98DF25) + part[:, :, k])
        return mix(keys + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def digest(text: Column) -> Column:
    """What tells whole texts apart: 16 bytes."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def signatures(docs: DataFrame, size: int = 2) -> DataFrame:
    """doc_id, digest of the text, size and digest of its shingle set, and band keys, of each row of docs."""
    ship(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i, n, raw, at in text_slices(batch.column(2)):
                values, to = shingle_sets(raw, at, size)
                keys = band_keys(one_permutation(values, to)).view(np.int64)
                digests = np.frombuffer(b"".join(hashlib.blake2b(values[a:b].tobytes(), digest_size=16).digest() for a, b in zip(to[:-1], to[1:], strict=True)), np.int64).reshape(n, 2)
                empty = np.diff(to) == 0
                width = np.where(empty, 0, keys.shape[1])
                arrays = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(width)]).astype(np.int32)), pa.array(keys[~empty].reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n).cast(pa.int64()), batch.column(1).slice(i, n).cast(pa.binary()), pa.array(np.diff(to)), pa.array(digests[:, 0]), pa.array(digests[:, 1]), arrays], ["doc_id", "h", "n_shingles", "d1", "d2", "keys"])

    return docs.select("doc_id", digest(F.col("text")).alias("h"), "text").mapInArrow(run, SIGNED)


def shingled(texts: DataFrame, size: int) -> DataFrame:
    """(c, s): the shingle set of each (c, text) row."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i, n, raw, at in text_slices(batch.column(1)):
                values, to = shingle_sets(raw, at, size)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), pa.ListArray.from_arrays(pa.array(to.astype(np.int32)), pa.array(values.view(np.int64)))], ["c", "s"])

    return texts.select("c", "text").mapInArrow(run, "c long, s array<long>")


def connected(edges: DataFrame, work: Scratch, most_rounds: int = 50) -> DataFrame:
    """(c, comp) of every node of the (a, b) edges: comp is the smallest node reachable.

    Large-star and small-star steps in turn; each is a grouped minimum and an equi-join. The rounds grow
    with the logarithm of a component's width; an endless run raises an error.
    """
    pairs = work.keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = None
    for _ in range(most_rounds):
        both = pairs.union(pairs.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = work.keep(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        new = work.keep(large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        work.drop(pairs, large)
        pairs = new
        now = tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    low = pairs.select(F.col("u").alias("c"), F.col("v").alias("comp"))
    out = work.keep(low.union(low.select(F.col("comp").alias("c"), "comp").distinct()))
    work.drop(pairs)
    return out


def _near(n: str, m: str, percent: int) -> Column:
    """Sizes that sets of the least similarity can have."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def bucket_rows(classes: DataFrame) -> DataFrame:
    """(key, c, n, many): classes and the keys that they share with others."""
    each = classes.select("c", "n", F.explode("keys").alias("key"))
    crowded = each.groupBy("key").agg(F.count("*").alias("many")).where("many > 1")
    return each.join(crowded, "key").select("key", "c", "n", "many")


def star_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """(a, b), a smaller: each class with the hubs of its buckets, if their sizes allow a link."""
    often = entries.groupBy("c").agg(F.sum(F.col("many") - 1).alias("met"))
    hubs = entries.join(often, "c").groupBy("key").agg(F.max(F.struct("met", (-F.col("c")).alias("c"), "n")).alias("h"))
    hubs = hubs.select("key", (-F.col("h.c")).alias("hub"), F.col("h.n").alias("hub_n"))
    met = entries.join(hubs, "key").where((F.col("c") != F.col("hub")) & _near("n", "hub_n", percent))
    return met.select(F.least("hub", "c").alias("a"), F.greatest("hub", "c").alias("b")).distinct()


def open_members(entries: DataFrame, comps: DataFrame) -> DataFrame:
    """(c, n, comp) of the classes in buckets that hold two components or more."""
    e = entries.select("key", "c", "n").join(comps, "c", "left").withColumn("comp", F.coalesce("comp", "c"))
    split = e.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    return e.join(split, "key", "left_semi").select("c", "n", "comp").distinct()


def prefix_rows(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(token, at, c, n, comp): the rarest shingles of each member that any similar set must share one of.

    Shingles stand by how many members have them, then by value; those that one member alone has come
    first and can't be shared. Of n shingles, n - ceil(n * percent / 100) + 1 make the prefix.
    """
    each = sets.join(members.select("c"), "c", "left_semi").select("c", F.explode("s").alias("token"))
    shared = each.groupBy("token").agg(F.count("*").alias("many")).where("many > 1")
    own = W.partitionBy("c")
    ranked = each.join(shared, "token").select("c", "token", (F.row_number().over(own.orderBy("many", "token")) - F.count("*").over(own)).alias("back"))
    least = F.expr(f"(n * {percent} + 99) div 100")
    return ranked.join(members, "c").withColumn("at", F.col("n") + F.col("back") - 1).where(F.col("at") <= F.col("n") - least).select("token", "at", "c", "n", "comp")


def prefix_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b), a smaller, of different components, that share a prefix shingle where enough is left to follow."""
    by_comp = rows.groupBy("token", "comp").agg(F.count("*").alias("many"))
    largest = by_comp.groupBy("token").agg(F.max(F.struct("many", "comp")).alias("x"), F.count("*").alias("comps")).where("comps > 1").select("token", F.col("x.comp").alias("largest"))
    there = rows.join(largest, "token")
    x = there.where("comp <> largest").select("token", *[F.col(k).alias(f"x_{k}") for k in ("at", "c", "n", "comp")])
    enough = F.expr(f"(n + x_n) * {percent} + {99 + percent}") / (100 + percent)
    met = x.join(there, "token").where(
        (F.col("comp") != F.col("x_comp"))
        & ((F.col("comp") == F.col("largest")) | (F.col("x_c") < F.col("c")))
        & _near("n", "x_n", percent)
        & (1 + F.least(F.col("n") - F.col("at") - 1, F.col("x_n") - F.col("x_at") - 1) >= F.floor(enough))
    )
    return met.select(F.least("x_c", "c").alias("a"), F.greatest("x_c", "c").alias("b")).distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those (a, b) whose full sets reach the similarity."""
    of = lambda k: sets.select(F.col("c").alias(k), F.col("s").alias(f"s_{k}"))
    met = pairs.join(of("b"), "b").join(of("a"), "a")
    met = met.select("a", "b", F.size(F.array_intersect("s_a", "s_b")).cast("long").alias("both"), (F.size("s_a") + F.size("s_b")).cast("long").alias("sum"))
    return met.where(100 * F.col("both") >= percent * (F.col("sum") - F.col("both"))).select("a", "b")


def labelled(docs: DataFrame, size: int = 2, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h, n_shingles, d1, d2) of each row, and (d1, d2, c, comp, id) of each class of equal, not empty sets.

    comp is the component's name; id is the class's smallest doc_id.
    """
    spark = docs.sparkSession
    work = Scratch(spark)
    docs = docs.select("doc_id", "text")
    signed = work.keep(signatures(docs, size))
    classes = signed.where("n_shingles > 0").groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "h")).alias("rep"), F.min("doc_id").alias("id"), F.any_value("n_shingles").alias("n"), F.any_value("keys").alias("keys"))
    classes = work.keep(classes.withColumn("c", F.monotonically_increasing_id()))
    entries = work.keep(bucket_rows(classes))
    reps = classes.join(entries.select("c").distinct(), "c", "left_semi").select("c", F.col("rep.doc_id").alias("_id"), F.col("rep.h").alias("_h"))
    reps = work.keep(reps)
    texts = docs.withColumn("h", digest(F.col("text"))).join(small(reps), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")))
    sets = work.keep(shingled(texts, size))
    if not sets.groupBy("c").count().where("count > 1").isEmpty():  # rows that repeat id and text
        sets = work.keep(sets.dropDuplicates(["c"]))
    tried = work.keep(star_pairs(entries, percent))
    links = work.keep(confirmed(tried, sets, percent))
    comps = connected(links, work)
    members = work.keep(open_members(entries, comps))
    more = work.keep(confirmed(prefix_pairs(work.keep(prefix_rows(members, sets, percent)), percent).join(tried, ["a", "b"], "left_anti"), sets, percent))
    if not more.isEmpty():
        comps = connected(links.union(more), work)
    named = classes.select("d1", "d2", "c", "id").join(comps, "c", "left")
    named = work.keep(named.select("d1", "d2", "c", F.coalesce("comp", "c").alias("comp"), "id"))
    rows = signed.select("doc_id", "h", "n_shingles", "d1", "d2")
    work.drop_all_but(signed, named)
    return rows, named


def components(docs: DataFrame, size: int = 2, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs."""
    rows, named = labelled(docs, size, percent)
    least = named.groupBy("comp").agg(F.min("id").alias("component_id"))
    out = rows.join(named.join(least, "comp").select("d1", "d2", "component_id"), ["d1", "d2"], "left")
    lone = F.col("n_shingles") == 0
    out = out.select("doc_id", "n_shingles", F.when(lone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component, by shingles of five words, one row stays, that of the smallest id.

    Two-word shingles are op3's own contract. Rows are told apart by id and text, so rows that share an
    id, or have none, are judged by their own texts; of rows with equal id and text one stays. Ids come
    before none; of rows that tie the smallest digest of the text. Rows without words all stay.
    """
    bare = F.btrim(F.coalesce("text", F.lit("")), F.lit(BLANKS)) == ""
    rows, named = labelled(docs.where(~bare), size=5)
    keyed = rows.where("n_shingles > 0").groupBy("doc_id", "h", "d1", "d2").agg(F.count("*").alias("many"))
    keyed = keyed.join(named.select("d1", "d2", "comp"), ["d1", "d2"]).select("doc_id", "h", "comp", "many")
    work = Scratch(spark)
    keyed = work.keep(keyed)
    first = keyed.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("x")).select("comp", F.col("x.doc_id").alias("_id"), F.col("x.h").alias("_h"))
    judged = work.keep(keyed.join(first, "comp").select("doc_id", "h", "many", (F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))).alias("stays")))
    gone, again = judged.where(~F.col("stays")), judged.where("stays and many > 1")
    held = docs.select(whole(docs).alias("doc"), F.col("doc_id").alias("_id"), F.when(~bare, digest(F.col("text"))).alias("_h"))
    same = lambda other: F.col("_id").eqNullSafe(other["doc_id"]) & (F.col("_h") == other["h"])
    gone = small(gone.select("doc_id", "h"))
    left = held.join(gone, same(gone), "left_anti")
    if not again.isEmpty():  # one of each
        again = small(again.select("doc_id", "h"))
        left = left.join(again, same(again), "left_anti").union(left.join(again, same(again), "left_semi").dropDuplicates(["_id", "_h"]))
    return left.select("doc.*")
