"""URL filters: explicit host and path rules, then link-graph propagation of trust and distrust.

``parts`` takes a url's host and path; ``rule_of`` finds the longest rule that fits. For urls that no
rule fits, personalised PageRank decides: trust flows from hosts with allowed pages along host
edges, distrust flows from hosts with blocked pages along reversed host edges. Host edges are the
pages' hyperlinks to other hosts, counted by pair, and each host's edges with its parent domain.
Both walks run in one table keyed by kind and host, an equi-join and a grouped sum an iteration, until
no further host is reached and no host's rank changes by more than ``tolerance``, as a share of it, in eight steps. The graph knows hosts without userinfo and port; output and rules have the url's own.

Defined cases: a null url or one without :// has empty host and path, fits no rule, and its verdict
is the default; a null html has no links; a host that no walk reaches gets the default (allow), and so
does one whose trust and distrust tie; a host without outgoing edges keeps its rank; of rules that fit
and tie in length the later in their list counts; very long urls and pages are read whole; rows that
repeat are judged one by one; an empty table gives an empty result; other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, forget, table

#: Fixed values: (host, path, verdict) of the explicit rules.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
URL = "(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = "(?i)(?:href|src)\\s*=\\s*[\"']?\\s*(?:https?:)?//([^/?#\"'\\s>]+)"


def parts(url: Column) -> tuple[Column, Column]:
    u = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(u, URL, 1)), F.regexp_extract(u, URL, 2)


def host_key(host: Column) -> Column:
    """The host that edges and ranks are keyed by: lower-case, without userinfo and port."""
    return ascii_lower(F.regexp_replace(host, "^.*@|:[0-9]*$", ""))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, null if none does. Rules are configuration, so one expression holds them."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): hyperlinks between different hosts, and host and parent domain both ways."""
    links = pages.select("host", F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), 1)).alias("dst"))
    links = links.select(F.col("host").alias("src"), host_key(F.col("dst")).alias("dst")).where("src <> '' and dst <> '' and src <> dst")
    links = links.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    hosts = pages.select("host").union(links.select("dst")).distinct()
    parent = F.regexp_extract("host", "^[^.]+\\.([^.]+(?:\\.[^.]+)+)$", 1)
    up = hosts.select(F.col("host").alias("src"), parent.alias("dst")).where("dst <> ''").withColumn("weight", F.lit(1.0))
    return links.union(up).union(up.select("dst", "src", "weight")).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


class Parts:
    """Keys that very many rows share, dealt to several parts each, so that no task meets all rows of one key.

    counts: the key columns and n, a key's rows. A key has a part for each least rows, or for each most-th of all
    rows where that is more: thus at most most keys have several parts, a table that is safe to broadcast.
    """

    def __init__(self, counts: DataFrame, work: Scratch, least: int = 10_000, most: int = 10_000):
        self.by = [c for c in counts.columns if c != "n"]
        size = max(least, (counts.agg(F.sum("n")).first()[0] or 0) // most)
        self.heavy = work.keep(counts.where(F.col("n") > size).select(*self.by, F.ceil(F.col("n") / size).cast("int").alias("wide")))
        self.any = not self.heavy.isEmpty()
        self.keys = self.by + (["part"] if self.any else [])

    def wide(self, df: DataFrame, at: str) -> DataFrame:
        """df with wide, the number of parts of its key; column at holds the key's last column."""
        if not self.any:
            return df.withColumn("wide", F.lit(1))
        named = self.heavy.withColumnRenamed(self.by[-1], at)
        return df.join(F.broadcast(named), [*self.by[:-1], at], "left").withColumn("wide", F.coalesce("wide", F.lit(1)))

    def dealt(self, df: DataFrame, by: Column) -> DataFrame:
        """df with each row in one part of its key, which by decides."""
        return self.wide(df, self.by[-1]).withColumn("part", F.pmod(F.xxhash64(by), F.col("wide")).cast("int")).drop("wide") if self.any else df

    def fanned(self, df: DataFrame) -> DataFrame:
        """df, which has wide, with each row in every part of its key."""
        return df.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("wide") - 1))).drop("wide") if self.any else df.drop("wide")


def propagate(edges: DataFrame, seeds: DataFrame, tolerance: float = 1e-6, damping: float = 0.85, cut_every: int = 8, least: int = 10_000) -> DataFrame:
    """(kind, host, rank): personalised PageRank of each kind of seed over that kind's edges.

    edges: kind, src, dst, weight; seeds: kind, host, weight. Steps go on until no further host is reached and
    no host's own rank has changed by more than tolerance, as a share of it, in cut_every steps.

    A step is one equi-join and one grouped sum, whose shuffle also deals the ranks for the next join; the shuffle
    of the arcs serves all cut_every steps. Arcs that leave a host with more than least of them are dealt to parts, to
    each of which the host's rank goes; a host that many arcs reach is summed before the shuffle. Ranks are
    written every cut_every steps, and superseded ranks and shuffles are deleted.
    """
    work = Scratch(edges.sparkSession)
    total = seeds.groupBy("kind").agg(F.sum("weight").alias("all"))
    out = work.keep(edges.groupBy("kind", "src").agg(F.sum("weight").alias("out"), F.count("*").alias("n")))
    parts = Parts(out.select("kind", "src", "n"), work, least)
    start = work.keep(parts.wide(seeds.join(total, "kind"), "host").select("kind", "host", "wide", (F.col("weight") / F.col("all")).alias("rank")))
    shares = parts.dealt(edges, F.col("dst")).join(parts.fanned(parts.wide(out, "src")), parts.keys)
    shares = shares.select(*parts.keys, "dst", (F.col("weight") / F.col("out")).alias("share"))
    nodes = edges.select("kind", F.col("dst").alias("src")).union(start.select("kind", "host")).distinct()
    stay = nodes.join(out, ["kind", "src"], "left_anti").select("kind", "src", *[F.lit(0).alias(c) for c in parts.keys[2:]], F.col("src").alias("dst"), F.lit(1.0).alias("share"))
    arcs = work.keep(parts.wide(shares.union(stay), "dst").select(*parts.keys, "dst", "wide", (damping * F.col("share")).alias("flow")))
    given = start.select("kind", F.col("host").alias("dst"), "wide", ((1 - damping) * F.col("rank")).alias("mass"))

    def step(rank: DataFrame) -> DataFrame:
        met = arcs.join(parts.fanned(rank.withColumnRenamed("host", "src")), parts.keys)
        met = met.select("kind", "dst", "wide", (F.col("rank") * F.col("flow")).alias("mass"))
        return met.union(given).groupBy("kind", "dst").agg(F.max("wide").alias("wide"), F.sum("mass").alias("rank")).withColumnRenamed("dst", "host")

    rank = start
    while True:
        old, new = rank, rank
        for _ in range(cut_every):
            new = step(new)
        rank = work.keep(new)
        # a host once reached keeps a rank, so a host on one side only is newly reached
        before = old.select("kind", "host", F.col("rank").alias("old"))
        change = rank.join(before, ["kind", "host"], "left").where(F.col("old").isNull() | (F.abs(F.col("rank") - F.col("old")) > tolerance * F.col("rank")))
        settled = change.isEmpty()
        if old is not start:  # every step adds the seeds
            work.drop(old)
        forget(edges.sparkSession)
        if settled:
            work.drop_all_but(rank)
            return rank.drop("wide")


def host_scores(pages: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """host, trust, distrust, score from pages with host, html and rule_verdict; score is trust's share."""
    work = Scratch(pages.sparkSession)
    edges = work.keep(host_edges(pages))
    kinds = edges.select(F.lit("trust").alias("kind"), "src", "dst", "weight").union(edges.select(F.lit("distrust"), "dst", "src", "weight"))
    seeds = pages.where("rule_verdict is not null and host <> ''").groupBy(F.when(F.col("rule_verdict") == "allow", "trust").otherwise("distrust").alias("kind"), "host").agg(F.count("*").cast("double").alias("weight"))
    rank = propagate(kinds, seeds, tolerance)
    work.drop(edges)
    both = rank.groupBy("host").agg(F.sum(F.when(F.col("kind") == "trust", F.col("rank")).otherwise(0.0)).alias("trust"), F.sum(F.when(F.col("kind") == "distrust", F.col("rank")).otherwise(0.0)).alias("distrust"))
    return both.withColumn("score", F.col("trust") / (F.col("trust") + F.col("distrust")))


def judge(pages: DataFrame, rules: tuple = RULES, threshold: float = 0.5, tolerance: float = 1e-6, least: int = 10_000) -> DataFrame:
    """page_id, host, path, rule, verdict, score (of the host, null if no walk reaches it).

    Pages of a host with more than least of them meet its score in parts.
    """
    host, path = parts(F.col("url"))
    of = pages.select("page_id", "html", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    of = of.withColumns({"rule": rule, "rule_verdict": verdict})
    of = of.withColumn("key", host_key(F.col("host")))
    scores = host_scores(of.withColumn("host", F.col("key")), tolerance).select(F.col("host").alias("key"), "score")
    of = of.drop("html")
    named = of.where("key <> ''")
    held = Parts(named.groupBy("key").agg(F.count("*").alias("n")), Scratch(pages.sparkSession), least)
    met = held.dealt(named, F.struct("page_id", "path")).join(held.fanned(held.wide(scores, "key")), held.keys, "left").drop("part").unionByName(of.where("key = ''").withColumn("score", F.lit(None).cast("double")))  # no host, no score
    by_links = F.when(F.round("score", 9) < threshold, "block").otherwise("allow")
    return met.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", by_links).alias("verdict"), "score")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).drop("score")
