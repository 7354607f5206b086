"""Values of the rows before and after, in order: one window by key, or two levels where a key's rows are dealt out.

With parts, rows are dealt by (keys, part): each part is scanned by itself, one row of it is scanned by
key, and what earlier (or later) parts hand on is joined to its rows. The result is that of one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

START, END = W.unboundedPreceding, W.unboundedFollowing


def _of_rows(kind: str, v: Column, w) -> Column:
    """A value of a window's rows; before and after tell a row's null (in a struct) from no row."""
    if kind == "before":
        return F.lag(F.struct(v.alias("v"))).over(w)
    if kind == "after":
        return F.lead(F.struct(v.alias("v"))).over(w)
    if kind == "last":
        return F.last(v, True).over(w.rowsBetween(START, 0))
    if kind == "next":
        return F.first(v, True).over(w.rowsBetween(0, END))
    if kind == "sum":
        return F.sum(v).over(w.rowsBetween(START, -1))
    raise ValueError(kind)


def _of_part(kind: str, v: Column, at: Column) -> Column:
    """What a part hands on."""
    if kind == "before":
        return F.max_by(F.struct(v.alias("v")), at)
    if kind == "after":
        return F.min_by(F.struct(v.alias("v")), at)
    if kind == "last":
        return F.max_by(v, F.when(v.isNotNull(), at))
    if kind == "next":
        return F.min_by(v, F.when(v.isNotNull(), at))
    return F.sum(v)


def _of_parts(kind: str, v: Column, w) -> Column:
    """What other parts hand to this one."""
    if kind == "before":
        return F.lag(v).over(w)
    if kind == "after":
        return F.lead(v).over(w)
    if kind == "last":
        return F.last(v, True).over(w.rowsBetween(START, -1))
    if kind == "next":
        return F.first(v, True).over(w.rowsBetween(1, END))
    return F.sum(v).over(w.rowsBetween(START, -1))


def carried(df: DataFrame, keys: tuple[str, ...], order: tuple[Column, ...], part: Column | None = None, **wanted: tuple[str, Column]) -> DataFrame:
    """df with each wanted name as a column: (kind, value), in the total order of each key's rows.

    before, after: the value of the row just before or after, null if there is none. last, next: the nearest value
    that isn't null, at or before, at or after the row. sum: of the rows before, 0 if there is none.
    part must rise with order; without it, each key is one window.
    """
    if part is None:
        w = W.partitionBy(*keys).orderBy(*order)
        out = df.withColumns({n: _of_rows(k, v, w) for n, (k, v) in wanted.items()})
        return out.withColumns({n: _told(k, F.col(n)) for n, (k, _) in wanted.items()})
    rows = df.withColumn("_part", part)
    w = W.partitionBy(*keys, "_part").orderBy(*order)
    here = rows.withColumns({f"_{n}": _of_rows(k, v, w) for n, (k, v) in wanted.items()})
    # a struct of the rank in the part stands for the order, whatever its directions
    placed = rows.withColumn("_at", F.row_number().over(w))
    parts = placed.groupBy(*keys, "_part").agg(*[_of_part(k, v, F.col("_at")).alias(n) for n, (k, v) in wanted.items()])
    by = W.partitionBy(*keys).orderBy("_part")
    parts = parts.select(*[F.col(k).alias(f"_{k}_") for k in keys], F.col("_part").alias("_part_"), *[_of_parts(k, F.col(n), by).alias(f"_{n}_") for n, (k, _) in wanted.items()])
    same = F.col("_part").eqNullSafe(F.col("_part_"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}_"))
    met = here.join(parts, same)
    both = lambda n, k: F.coalesce(f"_{n}", F.lit(0)) + F.coalesce(f"_{n}_", F.lit(0)) if k == "sum" else F.coalesce(f"_{n}", f"_{n}_")
    return met.select(*[F.col(f"`{c}`") for c in df.columns if c not in wanted], *[_told(k, both(n, k)).alias(n) for n, (k, _) in wanted.items()])


def _told(kind: str, v: Column) -> Column:
    return v["v"] if kind in ("before", "after") else F.coalesce(v, F.lit(0)) if kind == "sum" else v
