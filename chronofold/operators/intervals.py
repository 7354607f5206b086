"""Interval algebra on rows of (media_id, start_ms, end_ms), all keyed by media_id.

Times are whole milliseconds, so sums and comparisons are exact.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.bind import let
from .scans import carried

PAIR = "array<struct<start_ms:bigint,end_ms:bigint>>"


def overlaps(a_start, a_end, b_start, b_end) -> Column:
    return (F.col(a_start) < F.col(b_end)) & (F.col(a_end) > F.col(b_start))


BIN_MS = 1 << 16
#: Intervals over more bins than this are long: they are cut into bins of growing width instead.
MANY = 64
#: Bins are told apart up to 2^46 ms (2,230 years) from zero; farther times share the last one.
FAR = 1 << 30
TOP = 10  # 8^10 bins of the lowest level make one of the highest


def _bin(t: str, width: int = BIN_MS) -> Column:
    return F.greatest(F.lit(-FAR), F.least(F.lit(FAR - 1), F.floor(F.col(t) / width))).cast("long")


def _last_bin(start: str, end: str, width: int = BIN_MS) -> Column:
    return F.when(F.col(end) > F.col(start), _bin(end, width)).otherwise(_bin(start, width))


def in_bins(df: DataFrame, start: str, end: str, width: int, name: str, outer: bool = False, many: int | None = None) -> DataFrame:
    """A row for each time bin that [start, end] touches; with outer, one too where a border is null.

    With many, an interval over more bins comes once, in the bin of its start.
    """
    explode = F.explode_outer if outer else F.explode
    first, last = _bin(start, width), _last_bin(start, end, width)
    last = last if many is None else F.when(last - first > many, first).otherwise(last)
    return df.withColumn(name, explode(F.sequence(first, last)))


def cover(low: Column, high: Column, levels: int) -> Column:
    """Bins low to high as the fewest nested bins: array of (level, bin), a bin of each level being 8 of the one below.

    At most 14 of a level, whatever the length, and those of the last level as they come.
    """
    kind = "array<struct<level:int,bin:bigint>>"
    none = F.array().cast(kind)
    node = lambda k: (lambda b: F.struct(F.lit(k).alias("level"), b.alias("bin")))
    run = lambda k, a, b: F.when(b >= a, F.transform(F.sequence(a, b), node(k)).cast(kind)).otherwise(none)
    first = lambda k: F.shiftright(low + ((1 << 3 * k) - 1), 3 * k)
    last = lambda k: F.shiftright(high + 1, 3 * k) - 1
    parts = []
    for k in range(levels + 1):
        a, b = first(k), last(k)
        if k < levels:
            up, down = first(k + 1), last(k + 1)
            parts.append(F.when(down >= up, F.concat(run(k, a, 8 * up - 1), run(k, 8 * down + 8, b))).otherwise(run(k, a, b)))
        else:
            parts.append(run(k, a, b))
    return F.concat(*parts)


def ancestors(bin_: Column, levels: int) -> Column:
    """The bins of all levels that hold a lowest one."""
    return F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright(bin_, 3 * k).alias("bin")) for k in range(levels + 1)])


def meet(left: DataFrame, right: DataFrame, l: tuple[str, str], r: tuple[str, str], on: Column, how: str = "inner", l_most: int | None = None, r_most: int | None = None) -> DataFrame:
    """Rows of one medium whose closed intervals touch and satisfy on, joined by (media_id, time bin).

    Each pair meets in one bin only, that of the later start, so a medium is spread over tasks however
    many rows it has. Of right, all columns but media_id come along. With how="left", left rows come once
    for each bin they touch, so group them.

    An interval over more than 64 bins stands there in the bin of its start only. The rest of it, as far as
    the other side has starts in that medium, is cut into nested bins, tens of rows for any length, and meets
    the starts of the other side in each level that holds them: again one bin for each pair. Whether there are
    such intervals is one aggregate of both sides, left out for a side that can't be longer than l_most or r_most.

    Sides are merged, never broadcast: Spark's estimate of a size leaves out that bins multiply rows.
    """
    asked = [(k, df, c) for k, df, c, most in ((0, left, l, l_most), (1, right, r, r_most)) if most is None or most >= MANY * BIN_MS]
    spans = [df.select(F.lit(k).alias("side"), (_last_bin(*c) - _bin(c[0])).alias("bins"), _bin(c[0]).alias("at")) for k, df, c in asked]
    known = {x.side: x for x in reduce(DataFrame.union, spans).groupBy("side").agg(F.max("bins").alias("bins"), F.min("at").alias("low"), F.max("at").alias("high")).collect()} if spans else {}  # three numbers a side
    a = in_bins(left, *l, BIN_MS, "_bin", outer=how == "left", many=MANY)
    b = in_bins(right, *r, BIN_MS, "_bin_", many=MANY).withColumnRenamed("media_id", "_media_")
    same = (F.col("media_id") == F.col("_media_")) & (F.col("_bin") == F.col("_bin_")) & (F.col("_bin") == _bin_of_later(l[0], r[0]))
    out = a.join(b.hint("merge"), same & on, how).drop("_bin", "_bin_", "_media_")
    within = (F.col("media_id") == F.col("_media_")) & (F.col("_at") == F.col("_at_"))
    if _has_long(known.get(0)):
        k = _levels(_most(known[0], known.get(1)))
        long = _long(left, l)
        starts = _of_media(right, long).withColumnRenamed("media_id", "_media_").withColumn("_at_", F.explode(ancestors(_bin(r[0]), k)))
        nested = _nested(_reaching(long, right, r), l, k, "_at", "_last").drop("_last")
        out = out.unionByName(nested.join(starts.hint("merge"), within & on).drop("_at", "_at_", "_media_"))
    if _has_long(known.get(1)):
        k = _levels(_most(known[1], known.get(0)))
        long = _long(right, r)
        starts = _of_media(left, long).withColumn("_at", F.explode(ancestors(_bin(l[0]), k)))
        nested = _nested(_reaching(long, left, l), r, k, "_at_", "_last").drop("_last").withColumnRenamed("media_id", "_media_")
        out = out.unionByName(starts.join(nested.hint("merge"), within & on).drop("_at", "_at_", "_media_"))
    return out


def longest(df: DataFrame, start: str, end: str) -> int:
    """The length of the longest interval, for the joins that ask how long a side can be."""
    return df.agg(F.max(F.col(end) - F.col(start))).first()[0] or 0


def _bin_of_later(a: str, b: str) -> Column:
    return F.greatest(_bin(a), _bin(b))


def _levels(bins: int) -> int:
    return min(TOP, (bins.bit_length() + 2) // 3)


def _has_long(side) -> bool:
    return side is not None and (side.bins or 0) > MANY


def _most(side, other) -> int:
    """Bins that the longest interval can share with starts of the other side, if those are known."""
    return side.bins if other is None or other.high is None else max(1, min(side.bins, other.high - side.low))


def _reaching(long: DataFrame, other: DataFrame, c: tuple[str, str]) -> DataFrame:
    """Long intervals with _last, the last bin of their medium in which an interval of other starts."""
    return long.join(other.groupBy("media_id").agg(F.max(_bin(c[0])).alias("_last")), "media_id")


def _long(df: DataFrame, c: tuple[str, str]) -> DataFrame:
    return df.where(_last_bin(*c) - _bin(c[0]) > MANY)


def _of_media(df: DataFrame, other: DataFrame) -> DataFrame:
    return df.join(other.select("media_id").distinct(), "media_id", "left_semi")


def _nested(long: DataFrame, c: tuple[str, str], levels: int, name: str, last: str | None = None) -> DataFrame:
    """Long intervals without the bin of their start and those after the bin named last, one row for each nested bin."""
    end = _last_bin(*c) if last is None else F.least(_last_bin(*c), F.col(last))
    return long.withColumn(name, F.explode(cover(_bin(c[0]) + 1, end, levels)))


#: Range of time that one task scans when a medium is dealt out: a little over an hour.
SPAN_MS = 1 << 22


def merge_gap(df: DataFrame, gap: int, keys: tuple[str, ...] = ("media_id",), span: int | None = None) -> DataFrame:
    """Union of intervals that overlap or lie at most gap apart: islands by a running maximum.

    With span, each key's rows are dealt out by ranges of time so long (see merge_turns).
    """
    return _merged(df.select(*keys, "start_ms", "end_ms"), gap, keys, ("start_ms", "end_ms"), None, False, span)


def merge_turns(df: DataFrame, gap: int, latest: bool = False, span: int | None = None) -> DataFrame:
    """Turns (media_id, speaker, start_ms, end_ms, n) of (media_id, seq, start_ms, end_ms, speaker): a row that follows its own speaker by at most gap joins the turn just before.

    Rows without speaker are passed over. A turn ends, and is measured from, where its furthest row ends, or
    with latest, where its last row does. An end before its start counts as the start.

    With span, a medium's rows are dealt out by ranges of time so long. Each range is merged by itself; one
    row of it (first and last speaker, last turn, reach) is scanned by medium; what a range's first turns
    continue then joins the turn that was open. The result is that of one scan.
    """
    spoken = df.where(F.col("speaker").isNotNull()).select("media_id", "seq", "start_ms", F.greatest("start_ms", "end_ms").alias("end_ms"), "speaker")
    return _merged(spoken, gap, ("media_id",), ("start_ms", "seq"), "speaker", latest, span)


def _merged(df: DataFrame, gap: int, keys: tuple[str, ...], order: tuple[str, ...], label: str | None, latest: bool, span: int | None) -> DataFrame:
    """Runs of rows in order, all of one label (if there is one), each at most gap after the end of those before it."""
    part = F.lit(0) if span is None else F.floor(F.col("start_ms") / span)
    rows = df.withColumn("_part", part).withColumn("_label", F.lit("") if label is None else F.col(label))
    w = W.partitionBy(*keys, "_part").orderBy(*order)
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    other = ~F.lag("_label").over(w).eqNullSafe(F.col("_label"))
    rows = rows.withColumn("_run", F.sum(other.cast("int")).over(so_far)) if label else rows.withColumn("_run", F.lit(1))
    of_run = W.partitionBy(*keys, "_part", "_run").orderBy(*order) if label else w
    reach = F.lag("end_ms").over(of_run) if latest else F.max("end_ms").over(of_run.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.coalesce(F.col("start_ms") - reach > gap, F.lit(True)).cast("int"))
    rows = rows.withColumn("_turn", F.sum("_new").over(so_far))
    last = F.struct(*order)
    ends = F.max_by("end_ms", last) if latest else F.max("end_ms")
    local = rows.groupBy(*keys, "_part", "_run", "_turn", "_label").agg(F.min("start_ms").alias("start_ms"), ends.alias("end_ms"), F.count("*").alias("n"))
    named = [] if label is None else [F.col("_label").alias(label)]
    if span is None:
        return local.select(*keys, *named, "start_ms", "end_ms", "n")

    one = F.struct("_part", "_turn")  # names a turn of one range
    parts = local.groupBy(*keys, "_part").agg(
        F.min_by("_label", "_turn").alias("first"), F.max_by("_label", "_turn").alias("last"), F.max("_run").alias("runs"), F.max("_turn").alias("turns"), F.max_by("start_ms", "_turn").alias("opens"),
        (F.max_by("end_ms", "_turn") if latest else F.max(F.struct("_run", "end_ms"))["end_ms"]).alias("reach"), F.max_by(one, "_turn").alias("name"),
    )
    w = W.partitionBy(*keys).orderBy("_part")
    parts = parts.withColumn("goes_on", F.lag("last").over(w).eqNullSafe(F.col("first")) & F.lag("_part").over(w).isNotNull())
    if latest:
        parts = parts.withColumn("carry", F.lag("reach").over(w))
    else:  # ranges that share their last run share its reach
        parts = parts.withColumn("_chain", F.sum((~(F.col("goes_on") & (F.col("runs") == 1))).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
        chained = W.partitionBy(*keys, "_chain").orderBy("_part").rowsBetween(W.unboundedPreceding, 0)
        parts = parts.withColumn("_reach", F.max("reach").over(chained)).withColumn("carry", F.lag("_reach").over(w))
    alone = (F.col("turns") == 1) if latest else (F.col("runs") == 1)
    swallowed = F.col("goes_on") & alone & (F.col("opens") - F.col("carry") <= gap)
    held = F.last(F.when(~swallowed, F.col("name")), True).over(w.rowsBetween(W.unboundedPreceding, -1))
    parts = parts.select(*[F.col(k).alias(f"_{k}_") for k in keys], F.col("_part").alias("_part_"), "goes_on", "carry", held.alias("held"))
    same = F.col("_part").eqNullSafe(F.col("_part_"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}_"))
    joins = F.col("goes_on") & (F.col("_run") == 1) & (F.col("start_ms") - F.col("carry") <= gap) & ((F.col("_turn") == 1) if latest else F.lit(True))
    whole = local.join(parts, same).withColumn("_of", F.when(joins, F.col("held")).otherwise(one))
    ends = F.max_by("end_ms", one) if latest else F.max("end_ms")
    return whole.groupBy(*keys, "_of", "_label").agg(F.min("start_ms").alias("start_ms"), ends.alias("end_ms"), F.sum("n").alias("n")).select(*keys, *named, "start_ms", "end_ms", "n")


def complement(boundaries: DataFrame, media: DataFrame, span: int | None = None) -> DataFrame:
    """Windows between sorted, disjoint boundaries of each medium (media_id, total_ms), tail included; with span, dealt by time."""
    ends = media.select("media_id", F.col("total_ms").alias("start_ms"), F.lit(None).cast("long").alias("end_ms"))
    all_ = boundaries.select("media_id", "start_ms", "end_ms").unionByName(ends)
    order = (F.col("start_ms"), F.col("end_ms").asc_nulls_last())
    before = carried(all_, ("media_id",), order, None if span is None else F.floor(F.col("start_ms") / span), a=("before", F.col("end_ms")))
    opened = before.select("media_id", F.coalesce("a", F.lit(0)).alias("a"), F.col("start_ms").alias("b"))
    return opened.where("b > a").select("media_id", F.col("a").alias("start_ms"), F.col("b").alias("end_ms"))


def clip_join(windows: DataFrame, parts: DataFrame, least: int, how: str = "inner", w_most: int | None = None) -> DataFrame:
    """Parts that overlap each window, clipped to it, at least so long. windows: media_id, clip, w_start, w_end and others.

    With how="left", group: windows come once for each bin, with null parts. w_most: no window is longer.
    """
    p = parts.select("media_id", F.col("start_ms").alias("p_start"), F.col("end_ms").alias("p_end"))
    span = F.least("p_end", "w_end") - F.greatest("p_start", "w_start")
    met = meet(windows, p, ("w_start", "w_end"), ("p_start", "p_end"), overlaps("p_start", "p_end", "w_start", "w_end") & (span >= least), how=how, l_most=w_most)
    found = F.col("p_start").isNotNull()
    return met.withColumns({"start_ms": F.when(found, F.greatest("p_start", "w_start")), "end_ms": F.when(found, F.least("p_end", "w_end"))}).drop("p_start", "p_end")


def shrink(df: DataFrame, pad: int, least: int = 50) -> DataFrame:
    return df.withColumns({"start_ms": F.col("start_ms") + pad, "end_ms": F.col("end_ms") - pad}).where(F.col("end_ms") - F.col("start_ms") >= least)


def keep_ranges(start: Column, end: Column, cuts: Column, pad: int, least: int = 50) -> Column:
    """What stays of a clip after its padded cuts; the whole clip if nothing would."""
    shrunk = F.filter(F.transform(cuts, lambda c: F.struct((c["start_ms"] + pad).alias("start_ms"), (c["end_ms"] - pad).alias("end_ms"))), lambda c: c["end_ms"] - c["start_ms"] >= least)
    ends = F.array_sort(F.concat(F.coalesce(shrunk, F.array().cast(PAIR)), F.array(F.struct(end.alias("start_ms"), end.alias("end_ms")))))
    piece = lambda a, b: F.when(b - a >= least, F.array(F.struct(a.alias("start_ms"), b.alias("end_ms")))).otherwise(F.array().cast(PAIR))
    walked = F.aggregate(
        ends,
        F.struct(start.alias("at"), F.array().cast(PAIR).alias("kept")),
        lambda acc, c: F.struct(F.greatest(acc["at"], c["end_ms"]).alias("at"), F.concat(acc["kept"], piece(acc["at"], c["start_ms"])).alias("kept")),
    )["kept"]
    return let(walked, lambda k: F.when(F.size(k) > 0, k).otherwise(F.array(F.struct(start.alias("start_ms"), end.alias("end_ms")))))


def total(ranges: Column) -> Column:
    return F.aggregate(ranges, F.lit(0).cast("long"), lambda acc, r: acc + r["end_ms"] - r["start_ms"])


def remap(t: Column, ranges: Column) -> Column:
    """Media time to clip time: before a range what has elapsed, inside it the offset too, after all null."""
    walked = F.aggregate(
        ranges,
        F.struct(F.lit(0).cast("long").alias("gone"), F.lit(None).cast("long").alias("at")),
        lambda acc, r: F.struct(
            (acc["gone"] + r["end_ms"] - r["start_ms"]).alias("gone"),
            F.coalesce(acc["at"], F.when(t <= r["end_ms"], acc["gone"] + F.greatest(F.lit(0), t - r["start_ms"]))).alias("at"),
        ),
    )
    return walked["at"]


def greedy_split(start: Column, end: Column, cuts: Column, least: int, most: int) -> Column:
    """Pieces of at most ``most``: each cut is the best of quality, then time, in reach (if there is a reach), else hard.

    cuts: array of struct(quality, time). They are sorted into slots as long as ``most`` once, so a step looks
    into the two slots that it can reach: linear in width and cuts. Steps are bounded by width / least.
    """
    kind = "array<struct<quality:bigint,time:bigint>>"
    by_time = F.array_sort(F.transform(cuts, lambda c: F.struct(c["time"].cast("long").alias("time"), c["quality"].cast("long").alias("quality"))))
    slot = lambda c: F.floor((c["time"] - start) / most).cast("long")
    return let(by_time, lambda x: let(_slots(F.filter(x, lambda c: c["time"] >= start), slot, kind), lambda s: _split(start, end, s, least, most, kind)))


def _slots(cuts: Column, slot, kind: str) -> Column:
    """Cuts in order of time as an array of slots, empty ones included."""
    none = F.array().cast(kind)

    def dense(x: Column) -> Column:
        firsts = F.filter(F.transform(x, lambda c, i: F.struct(slot(c).alias("slot"), i.alias("i"))), lambda f: (f["i"] == 0) | (slot(F.get(x, f["i"] - 1)) != f["slot"]))

        def filled(f: Column) -> Column:
            held = lambda e, j: F.transform(F.slice(x, e["i"] + 1, F.coalesce(F.get(f, j + 1)["i"], F.size(x)) - e["i"]), lambda c: F.struct(c["quality"].alias("quality"), c["time"].alias("time")))
            gap = lambda e, j: F.array_repeat(none, (e["slot"] - F.coalesce(F.get(f, j - 1)["slot"], F.lit(-1)) - 1).cast("int"))
            return F.flatten(F.transform(f, lambda e, j: F.concat(gap(e, j), F.array(held(e, j)))))

        return let(firsts, filled)

    return let(cuts, dense)


def _split(start: Column, end: Column, slots: Column, least: int, most: int, kind: str) -> Column:
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil((end - start) / F.lit(least)).cast("int")))
    none = F.array().cast(kind)

    def step(acc, _):
        a = acc["at"]
        low, high = a + least, F.least(a + most, end - least)
        at = F.floor((low - start) / most).cast("int")
        near = F.concat(F.coalesce(F.get(slots, at), none), F.coalesce(F.get(slots, at + 1), none))
        best = F.when(high > low, F.array_max(F.filter(near, lambda c: (c["time"] >= low) & (c["time"] <= high)))["time"])
        goes = end - a > most
        return F.when(goes, let(F.coalesce(best, a + most), lambda to: F.struct(to.alias("at"), F.array_append(acc["cuts"], to).alias("cuts")))).otherwise(acc)

    found = F.aggregate(steps, F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("cuts")), step)["cuts"]
    edges = F.concat(F.array(start), found, F.array(end))
    return let(edges, lambda e: F.transform(F.sequence(F.lit(1), F.size(e) - 1), lambda i: F.struct(F.get(e, i - 1).alias("start_ms"), F.get(e, i).alias("end_ms"))))


def nearest(points: DataFrame, marks: DataFrame, tolerance: int) -> DataFrame:
    """points (media_id, id, t and others) with the nearest mark (media_id, mark) within tolerance, ties to the smaller, else t."""
    p = points.withColumns({"_lo": F.col("t") - tolerance, "_hi": F.col("t") + tolerance})
    m = marks.select("media_id", "mark").distinct()
    met = meet(p, m, ("_lo", "_hi"), ("mark", "mark"), F.col("mark").between(F.col("_lo"), F.col("_hi")), how="left", l_most=2 * tolerance, r_most=0)
    best = F.min_by("mark", F.when(F.col("mark").isNotNull(), F.struct(F.abs(F.col("mark") - F.col("t")), "mark")))
    return met.groupBy(*points.columns).agg(best.alias("mark")).withColumn("snapped", F.coalesce("mark", "t")).drop("mark")
