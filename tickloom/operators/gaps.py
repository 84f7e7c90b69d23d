"""Grouping of values by gaps, and order-dependent thinning of short lists.

Values less than a window apart lie in one group, so only the smallest and largest value of each
window-wide cell decide where groups end. Gap grouping therefore aggregates cells on the map side
and orders cells, never rows: neither a crowded group nor an ungrouped table ends in one long sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.arrays import let
from tickloom.operators.skew import join_null_safe


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def nearest_tick(c: Column) -> Column:
    """Halves go up: floor(x + 0.5)."""
    return F.floor(c + 0.5)


def gap_cells(df: DataFrame, by: list[str], value: str, window: float) -> DataFrame:
    """``by, _cell, gap_id`` of each occupied cell; ids count from 0 in the order of the values."""
    cell = F.floor(F.col(value) / window).cast("double") if window > 0 else F.col(value)
    cells = df.groupBy(*by, cell.alias("_cell")).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    order = Window.partitionBy(*by).orderBy("_cell")
    new = F.when(F.col("_lo") - F.lag("_hi").over(order) > window, 1).otherwise(0)
    return cells.withColumn("_new", new).select(*by, "_cell", F.sum("_new").over(order).cast("long").alias("gap_id"))


def gap_groups(df: DataFrame, value: str, window: float, by: list[str] | None = None, noise: float = -1.0, name: str = "gap_id") -> DataFrame:
    """Each row with the group of its value: a new group begins where the gap to the previous value exceeds ``window``.

    NULL, NaN, infinite and ``noise`` values are in group -1. Repeated values share a group; a NULL
    in ``by`` is a group of its own; an empty table stays empty.
    """
    by = by or []
    ok = finite(F.col(value)) & (F.col(value) != noise)
    cell = F.floor(F.col(value) / window).cast("double") if window > 0 else F.col(value)
    left = df.withColumn("_cell", F.when(ok, cell))
    cells = gap_cells(df.where(ok), by, value, window)
    joined = join_null_safe(left, cells.withColumnRenamed("gap_id", "_gap"), by, ["_cell"], "left")
    return joined.select(*df.columns, F.coalesce("_gap", F.lit(-1).cast("long")).alias(name))


def gap_medians(df: DataFrame, value: str, window: float, by: list[str] | None = None, rounded: bool = False, drop_zero: bool = False) -> DataFrame:
    """``by, gap_id, center, n``: the median of each group of values less than ``window`` apart.

    ``rounded`` rounds medians half to even; ``drop_zero`` drops values that round to zero before.
    Values that are not finite are dropped.
    """
    by = by or []
    ok = finite(F.col(value))
    if drop_zero:
        ok = ok & (F.rint(value) != 0)
    kept = gap_groups(df.where(ok), value, window, by, noise=float("-inf"))
    center = F.median(value)
    return kept.groupBy(*by, "gap_id").agg((F.rint(center) if rounded else center).alias("center"), F.count(F.lit(1)).alias("n"))


def thin(values: Column, separation: float) -> Column:
    """Of an array of doubles, ascending: each value that is more than ``separation`` from all kept before it."""
    return F.aggregate(
        F.array_sort(values),
        F.array().cast("array<double>"),
        lambda kept, x: F.when((F.size(kept) == 0) | (x - F.element_at(kept, -1) > separation), F.concat(kept, F.array(x))).otherwise(kept),
    )


def insert_candidate(values: Column, t0: Column, separation: float, highest: float | None = None) -> Column:
    """A sorted array with ``t0`` in it, unless a value lies within ``separation`` (included) or ``t0`` is not finite.

    With ``highest`` the new value is rounded half to even and clipped to 0..highest first.
    """
    x = F.greatest(F.lit(0.0), F.least(F.lit(float(highest)), F.rint(t0))) if highest is not None else t0
    taken = F.exists(values, lambda v: F.abs(v - x) <= separation)
    return F.when(~finite(t0) | taken, values).otherwise(F.array_sort(F.concat(values, F.array(x))))


def merge_candidates(values: Column, more: Column, separation: float, highest: float) -> Column:
    """``insert_candidate`` of each of ``more`` in their order."""
    return F.aggregate(more, values, lambda acc, x: insert_candidate(acc, x, separation, highest))


def top_peaks(curve: Column, n: int, separation: int, least: float | Column) -> Column:
    """Positions of up to ``n`` highest values of an array, none below ``least``, each further than
    ``separation - 1`` from all higher ones taken (the first of equal heights goes first)."""
    floor = F.lit(least) if not isinstance(least, Column) else least
    indexed = F.transform(curve, lambda v, i: F.struct((-v).alias("h"), i.alias("i"), v.alias("v")))
    ranked = let(floor, lambda f: F.array_sort(F.filter(indexed, lambda s: s["v"] >= f)))
    return F.aggregate(
        ranked,
        F.array().cast("array<int>"),
        lambda kept, s: F.when((F.size(kept) < n) & ~F.exists(kept, lambda k: F.abs(k - s["i"]) < separation), F.concat(kept, F.array(s["i"]))).otherwise(kept),
    )


def separated_minima(curve: Column, n: int, separation: int) -> Column:
    """Positions of up to ``n`` lowest values, separated as in ``top_peaks``."""
    return top_peaks(F.transform(curve, lambda v: -v), n, separation, float("-inf"))


def local_maxima(curve: Column) -> Column:
    """Inner positions that are no lower than the one before and higher than the one after."""
    def run(c: Column) -> Column:
        inner = F.sequence(F.lit(1), F.size(c) - 2)
        peaks = F.filter(inner, lambda i: (F.get(c, i) >= F.get(c, i - 1)) & (F.get(c, i) > F.get(c, i + 1)))
        return F.when(F.size(c) < 3, F.array().cast("array<int>")).otherwise(peaks)

    return let(curve, run)


def moving_average(curve: Column, width: int) -> Column:
    """Centred mean over ``width`` samples with zeros beyond the ends."""
    half = width // 2

    def run(c: Column) -> Column:
        n = F.size(c)

        def at(_: Column, i: Column) -> Column:
            lo = F.greatest(i - half, F.lit(0))
            return F.aggregate(F.slice(c, lo + 1, F.least(i + half, n - 1) - lo + 1), F.lit(0.0), lambda a, v: a + v) / width

        return F.transform(c, at)

    return let(curve, run)


def islands(df: DataFrame, by: list[str], index: str, max_gap: int) -> DataFrame:
    """``by, island, first, last, n``: runs of distinct integers that skip at most ``max_gap`` numbers."""
    d = df.select(*by, index).distinct()
    order = Window.partitionBy(*by).orderBy(index)
    new = F.when(F.col(index) - F.lag(index).over(order) > max_gap + 1, 1).otherwise(0)
    runs = d.withColumn("_n", new).withColumn("island", F.sum("_n").over(order).cast("long"))
    return runs.groupBy(*by, "island").agg(F.min(index).alias("first"), F.max(index).alias("last"), F.count(F.lit(1)).alias("n"))
