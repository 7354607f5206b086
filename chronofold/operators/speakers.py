"""Speakers of utterances from given voice vectors: grouping, labels, gaps, turns, and finer turns where speakers change.

Vectors come with the tables; making them from sound is not this library's.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shared import Kept
from .captions import word_windows
from .intervals import SPAN_MS, merge_turns
from .scans import carried
from .vectors import dot, unit

ROWS = 4096  # of a medium, that one task scans where it is dealt out by number


def _draw(seed: int, *by) -> Column:
    """A number between 0 and 1 that seed and row decide."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *by), 11)
    return (bits + 0.5) / float(1 << 53)


def _spread(centres: Column, v: Column) -> Column:
    """Squared distance of v to the nearest of centres (c, n = c . c)."""
    return F.greatest(F.lit(0.0), dot(v, v) - F.array_max(F.transform(centres, lambda c: 2 * dot(c["c"], v) - c["n"])))


def _centre(v: Column) -> Column:
    return F.struct(v.alias("c"), dot(v, v).alias("n"))


def seeds(points: DataFrame, k: int, seed: int = 7) -> DataFrame:
    """(media_id, centres): k vectors of each medium, each drawn with a chance in proportion to its squared distance to those before.

    Of draws u the least -ln(u) / distance wins: one grouped minimum draws for all media. A medium with fewer
    distinct vectors has as many centres.
    """
    first = points.groupBy("media_id").agg(F.min_by("v", F.struct(_draw(seed, "media_id", "seq"), "seq")).alias("c"))
    centres = first.select("media_id", F.array(_centre(F.col("c"))).alias("centres"))
    for n in range(1, k):
        far = _spread(F.col("centres"), F.col("v"))
        race = F.when(far > 1e-12, F.struct((-F.ln(_draw(seed + n, "media_id", "seq")) / far).alias("r"), F.col("seq")))
        drawn = points.join(centres, "media_id").groupBy("media_id").agg(F.min_by("v", race).alias("c"))
        more = F.when(F.col("c").isNotNull(), F.concat("centres", F.array(_centre(F.col("c"))))).otherwise(F.col("centres"))
        centres = centres.join(drawn, "media_id").select("media_id", more.alias("centres"))
    return centres


def kmeans(points: DataFrame, k: int, most_rounds: int = 25, tolerance: float = 1e-9, seed: int = 7) -> DataFrame:
    """(media_id, seq, cluster) of vectors (media_id, seq, v), each medium grouped by itself, all media at once.

    From seeded, distance-weighted first centres on, each medium goes through rounds of nearest centre and mean until none
    of its centres moves by more than tolerance (squared); it takes no part in later rounds. A cluster that empties takes the vector farthest from its own centre, so clusters
    are as many as first centres. A round shuffles one vector sum for each task and cluster; centres are kept
    in the shared folder.
    """
    kept = Kept(points.sparkSession)
    points = kept.keep(points.select("media_id", "seq", "v"))
    left, settled = kept.keep(seeds(points, k, seed)), None
    for n in range(most_rounds):
        new = kept.keep(_moved(points, left))
        still = new.where(F.col("moved") <= tolerance) if n < most_rounds - 1 else new
        done = still.select("media_id", "centres")
        settled = done if settled is None else settled.unionByName(done)
        left = new.where(F.col("moved") > tolerance).select("media_id", "centres")
        if left.isEmpty():
            break
    return points.join(settled, "media_id").select("media_id", "seq", _nearest().alias("cluster"))


def _nearest() -> Column:
    scores = F.transform("centres", lambda c, i: F.struct(F.round(2 * dot(c["c"], F.col("v")) - c["n"], 9).alias("s"), (-i).alias("i")))
    return -F.array_max(scores)["i"]


def _moved(points: DataFrame, centres: DataFrame) -> DataFrame:
    """(media_id, centres, moved) after a round; moved is the largest squared step of a centre."""
    met = points.join(centres, "media_id").select("media_id", "seq", "v", "centres", _nearest().alias("cluster"))
    off = F.struct(_spread(F.array(F.get("centres", F.col("cluster"))), F.col("v")).alias("off"), (-F.col("seq")).alias("seq"), F.col("v").alias("v"))
    sums = met.groupBy("media_id", "cluster").agg(vector_to_array(Summarizer.mean(array_to_vector("v"))).alias("mean"), F.max(off).alias("far"))
    lists = sums.groupBy("media_id").agg(F.collect_list(F.struct("cluster", "mean", "far")).alias("l")).join(centres.select("media_id", F.col("centres").alias("old")), "media_id")
    found = F.map_from_entries(F.transform("l", lambda e: F.struct(e["cluster"], e["mean"])))
    empty = F.filter(F.sequence(F.lit(0), F.size("old") - 1), lambda i: ~F.exists("l", lambda e: e["cluster"] == i))
    farthest = F.reverse(F.array_sort(F.transform("l", lambda e: e["far"])))
    lists = lists.withColumns({"found": found, "empty": empty, "farthest": farthest})
    refill = lambda i: F.get("farthest", (F.array_position("empty", i) - 1).cast("int"))["v"]
    new = F.transform("old", lambda c, i: F.coalesce(F.try_element_at("found", i), refill(i), c["c"]))
    out = lists.select("media_id", "old", F.transform(new, lambda v: _centre(v)).alias("centres"))
    step = lambda a, b: F.greatest(F.lit(0.0), a["n"] + b["n"] - 2 * dot(a["c"], b["c"]))
    return out.select("media_id", "centres", F.array_max(F.zip_with("old", "centres", step)).alias("moved"))


def cluster_shares(clusters: DataFrame, least: float = 0.05) -> DataFrame:
    """(media_id, n, smallest, doubtful): rows, the smallest cluster's share, and whether that is too small to trust."""
    sizes = clusters.groupBy("media_id", "cluster").agg(F.count("*").alias("n"))
    return sizes.groupBy("media_id").agg(F.sum("n").alias("n"), (F.min("n") / F.sum("n")).alias("smallest")).withColumn("doubtful", F.col("smallest") < least)


def cluster_names(clusters: DataFrame) -> DataFrame:
    """(media_id, cluster, label): clusters named S1, S2... in the order in which they are first heard."""
    first = clusters.groupBy("media_id", "cluster").agg(F.min("seq").alias("seq"))
    number = F.row_number().over(W.partitionBy("media_id").orderBy("seq", "cluster"))
    return first.select("media_id", "cluster", F.concat(F.lit("S"), number.cast("string")).alias("label"))


def label_clusters(clusters: DataFrame) -> DataFrame:
    """(media_id, seq, label) of clusters (media_id, seq, cluster)."""
    return clusters.join(cluster_names(clusters), ["media_id", "cluster"]).select("media_id", "seq", "label")


def fill_gaps(u: DataFrame, known: str = "label", span: int | None = None) -> DataFrame:
    """u (media_id, seq, start_ms and others) with unknown labels filled from the known one nearest by start, ties to the earlier.

    With span, a medium's rows are dealt out by ranges of time so long.
    """
    held = F.when(F.col(known).isNotNull(), F.struct(F.col("start_ms").alias("at"), F.col(known).alias("label")))
    part = None if span is None else F.floor(F.col("start_ms") / span)
    met = carried(u, ("media_id",), (F.col("start_ms"), F.col("seq")), part, _back=("last", held), _ahead=("next", held))
    earlier = F.col("_ahead").isNull() | (F.col("start_ms") - F.col("_back.at") <= F.col("_ahead.at") - F.col("start_ms"))
    return met.withColumn(known, F.coalesce(F.when(earlier, F.col("_back.label")), F.col("_ahead.label"), F.col("_back.label"))).drop("_back", "_ahead")


def diarize(u: DataFrame, voices: DataFrame, k: int, least_ms: int = 600) -> DataFrame:
    """u (media_id, seq, start_ms, end_ms, text) with a speaker for each utterance, from voices (media_id, seq, embedding).

    Shorter utterances than least_ms don't take part in grouping; they and those without a voice get the
    nearest one's label. Media with fewer than 2 k usable voices stay without labels.
    """
    usable = u.where(F.col("end_ms") - F.col("start_ms") >= least_ms).select("media_id", "seq").join(voices, ["media_id", "seq"]).select("media_id", "seq", unit(F.col("embedding")).alias("v"))
    enough = usable.groupBy("media_id").count().where(F.col("count") >= 2 * k).select("media_id")
    labels = label_clusters(kmeans(usable.join(enough, "media_id"), k))
    return fill_gaps(u.drop("speaker", "label").join(labels, ["media_id", "seq"], "left"), span=SPAN_MS).withColumnRenamed("label", "speaker")


def transitions(u: DataFrame, rows: int | None = None) -> DataFrame:
    """u (media_id, seq, speaker) with transition: a neighbour has another speaker; edges don't count, an unknown one does.

    With rows, a medium's rows are dealt out by so many numbers of seq.
    """
    part, s = None if rows is None else F.floor(F.col("seq") / rows), F.struct("speaker")
    met = carried(u, ("media_id",), (F.col("seq"),), part, _before=("before", s), _after=("after", s))
    other = lambda x: F.col(x).isNotNull() & ~F.col("speaker").eqNullSafe(F.col(f"{x}.speaker"))
    return met.withColumn("transition", other("_before") | other("_after")).drop("_before", "_after")


def centroids_of(u: DataFrame, voices: DataFrame) -> DataFrame:
    """(media_id, label, centroid): each speaker's mean voice, of unit length."""
    v = voices.join(u.select("media_id", "seq", F.col("speaker").alias("label")), ["media_id", "seq"]).select("media_id", "label", unit(F.col("embedding")).alias("v"))
    return v.groupBy("media_id", "label").agg(vector_to_array(Summarizer.mean(array_to_vector("v"))).alias("m")).select("media_id", "label", unit(F.col("m")).alias("centroid"))


def refine(u: DataFrame, window_voices: DataFrame, centroids: DataFrame, gap: int = 250) -> DataFrame:
    """Finer turns (media_id, speaker, start_ms, end_ms, n) where speakers change.

    u: media_id, seq, start_ms, end_ms, speaker, timed (its words). Utterances in a transition are cut in windows
    of words; each window, numbered by pos in its utterance, takes the speaker whose centroid is likest to its voice in
    window_voices (media_id, seq, pos, embedding), or the utterance's own where it has none. Others
    stay as they are.
    """
    likest = assignments(window_voices, centroids)
    return refined_turns(u, likest, gap)


def refined_turns(u: DataFrame, found: DataFrame, gap: int = 250) -> DataFrame:
    """The turns of refine, from given speakers of word windows: found (media_id, seq, pos, speaker)."""
    marked = transitions(u, ROWS)
    still = marked.where(~F.col("transition")).select("media_id", "seq", F.lit(0).alias("pos"), "start_ms", "end_ms", "speaker")
    w = marked.where("transition").select("media_id", "seq", "speaker", F.posexplode(word_windows(F.col("timed"), F.col("start_ms"), F.col("end_ms"))).alias("pos", "w"))
    new = w.join(found.withColumnRenamed("speaker", "found"), ["media_id", "seq", "pos"], "left")
    new = new.select("media_id", "seq", "pos", F.col("w.start_ms").alias("start_ms"), F.col("w.end_ms").alias("end_ms"), F.coalesce("found", "speaker").alias("speaker"))
    events = still.unionByName(new).withColumn("seq", F.struct("end_ms", "speaker", "seq", "pos"))
    return merge_turns(events, gap, span=SPAN_MS)


def turn_totals(turns: DataFrame) -> DataFrame:
    """(media_id, speaker, seconds) of turns, with one decimal."""
    return turns.groupBy("media_id", "speaker").agg(F.round(F.sum(F.col("end_ms") - F.col("start_ms")) / 1000, 1).alias("seconds"))


def assignments(window_voices: DataFrame, centroids: DataFrame) -> DataFrame:
    """(media_id, seq, pos, speaker): the likest of the medium's speakers, whose centroids are one row."""
    model = centroids.groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("label", "centroid"))).alias("model"))
    v = window_voices.join(model, "media_id").withColumn("v", unit(F.col("embedding")))
    scores = F.transform("model", lambda m, i: F.struct(F.round(dot(m["centroid"], F.col("v")), 9).alias("s"), (-i).alias("i"), m["label"].alias("label")))
    return v.select("media_id", "seq", "pos", F.array_max(scores)["label"].alias("speaker"))
