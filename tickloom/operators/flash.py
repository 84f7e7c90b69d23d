"""Flashes as time candidates: selection of single flashes, seeds, and bookkeeping of received candidates.

Candidates of one (event, TPC) are a sorted array of structs ``t0, received``; after thinning to
whole ticks such an array is bounded by the search range, so the order-dependent rules are folds
within a row and need no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.gaps import finite, gap_medians, thin
from tickloom.operators.geometry import Detector, flash_tick

TABLE = "array<struct<t0:double,received:boolean>>"


# ---------------------------------------------------------------- single flashes
def single_flash_strict(flashes: DataFrame, by: list[str], hits: str = "n_sum_hits") -> DataFrame:
    """Groups with exactly one flash of more than one hit, counting no others. NULL hits count as none."""
    n = flashes.groupBy(*by).agg(F.count_if(F.col(hits) > 1).alias("_n"))
    return n.where("_n = 1").select(*by)


def single_flash_enhanced(flashes: DataFrame, by: list[str], hits: str = "n_sum_hits") -> DataFrame:
    """Groups with one flash of more than one hit, or two of which one has 1 and the other 3 or more hits."""
    n = flashes.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min(hits).alias("_lo"), F.max(hits).alias("_hi"))
    return n.where("(_n = 1 AND _hi > 1) OR (_n = 2 AND _lo = 1 AND _hi >= 3)").select(*by)


def single_flash_merged(flashes: DataFrame, by: list[str], begin: str, end: str, flash_id: str, gap: float = 81.0) -> DataFrame:
    """``by, flash_id``: groups whose flashes are one once windows with start - previous end <= ``gap`` are merged; the earliest flash stands for them."""
    order = Window.partitionBy(*by).orderBy(begin, flash_id)
    upto = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col(begin) - upto > gap, 1).otherwise(0)
    return (
        flashes.withColumn("_new", new)
        .groupBy(*by)
        .agg(F.sum("_new").alias("_breaks"), F.min_by(flash_id, F.struct(begin, flash_id)).alias(flash_id))
        .where("_breaks = 0")
        .select(*by, flash_id)
    )


def flash_count_histogram(groups: DataFrame, flashes: DataFrame, by: list[str], value: str) -> DataFrame:
    """Number of groups with 0, 1, 2, .. flashes; ``groups`` lists all groups, those without flashes too."""
    n = flashes.groupBy(*by).agg(F.count(value).alias("n_flashes"))
    return groups.join(n, by, "left").groupBy(F.coalesce("n_flashes", F.lit(0)).alias("n_flashes")).agg(F.count(F.lit(1)).alias("n_groups"))


# ---------------------------------------------------------------- seeds
def merged_seeds(flashes: DataFrame, by: list[str], detector: Detector, merge_ticks: float = 5.0, least_tot: float = 0.0, range_col: str = "hit_time_range", tot: str = "tot_max") -> DataFrame:
    """``by, t0``: flash times inside the search range, those within ``merge_ticks`` of the one before merged to their median."""
    t = flash_tick(F.col(range_col), detector)
    d = flashes.where(F.coalesce(F.col(tot), F.lit(0.0)) >= least_tot).withColumn("t0", t).where(finite(F.col("t0")) & F.col("t0").between(0, detector.search))
    return gap_medians(d, "t0", merge_ticks, by).select(*by, F.col("center").alias("t0"))


def thinned_seeds(flashes: DataFrame, by: list[str], detector: Detector, separation: float = 5.0, most: int | None = None, range_col: str = "hit_time_range") -> DataFrame:
    """``by, seeds``: whole ticks (halves up, clipped to the search range), each more than ``separation`` from all kept before."""
    t = flash_tick(F.col(range_col), detector)
    tick = F.greatest(F.lit(0), F.least(F.lit(detector.search), F.floor(t + 0.5))).cast("double")
    d = flashes.where(finite(t)).select(*by, tick.alias("_t")).distinct()
    kept = d.groupBy(*by).agg(thin(F.collect_list("_t"), separation).alias("seeds"))
    return kept.withColumn("seeds", F.slice("seeds", 1, most)) if most else kept


# ---------------------------------------------------------------- candidate tables
def valid_t0(t: Column, highest: float = 800.0) -> Column:
    """Finite, not rounding to 0, within 0..highest."""
    return F.coalesce(finite(t) & (F.rint(t) != 0) & t.between(0, highest), F.lit(False))


def clean_t0(t: Column, highest: float = 800.0) -> Column:
    """Clipped to 0..highest, and whole when within 1e-6 of a whole tick."""
    c = F.greatest(F.lit(0.0), F.least(F.lit(highest), t))
    return F.when(F.abs(c - F.rint(c)) < 1e-6, F.rint(c)).otherwise(c)


def candidate_table(df: DataFrame, by: list[str], t0: str = "t0", received: str = "received", highest: float = 800.0) -> DataFrame:
    """``by, candidates``: sorted arrays of clean candidates; a NULL flag means not received; equal times are received if any is."""
    d = df.where(valid_t0(F.col(t0), highest)).groupBy(*by, clean_t0(F.col(t0), highest).alias("t0")).agg(F.coalesce(F.bool_or(received), F.lit(False)).alias("received"))
    return d.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("t0", "received"))).alias("candidates"))


def candidate_rows(table: DataFrame, by: list[str]) -> DataFrame:
    """A candidate table as rows ``by, t0, received``."""
    return table.select(*by, F.inline("candidates"))


def pad_flags(values: Column, flags: Column) -> Column:
    """Flags cut or filled up with false to the number of values; NULL flags are false."""
    return F.transform(values, lambda _, i: F.coalesce(F.get(flags, i), F.lit(False)))


def mark_assignment(candidates: Column, t0: Column, resolution: float = 5.0, prefer_existing: bool = False) -> Column:
    """The table with ``t0`` as received instead of all candidates within ``resolution`` (included).

    With ``prefer_existing`` the nearest received one of those is kept in its place.
    """
    near = F.filter(candidates, lambda c: F.abs(c["t0"] - t0) <= resolution)
    far = F.filter(candidates, lambda c: F.abs(c["t0"] - t0) > resolution)
    nearest = F.array_min(F.transform(F.filter(near, lambda c: c["received"]), lambda c: F.struct(F.abs(c["t0"] - t0).alias("d"), c["t0"].alias("t0"))))["t0"]
    at = F.coalesce(nearest, t0) if prefer_existing else t0
    new = F.array(F.struct(at.cast("double").alias("t0"), F.lit(True).alias("received")))
    return F.when(finite(t0), F.array_sort(F.concat(far, new))).otherwise(candidates)


def replay_assignments(candidates: Column, assignments: Column, resolution: float = 5.0, prefer_existing: bool = True) -> Column:
    """``mark_assignment`` for an array of structs ``energy, cluster, t0``, most energetic first (ties by cluster)."""
    order = F.array_sort(F.transform(assignments, lambda a: F.struct((-a["energy"]).alias("e"), a["cluster"].alias("c"), a["t0"].alias("t0"))))
    return F.aggregate(order, candidates.cast(TABLE), lambda acc, a: mark_assignment(acc, a["t0"], resolution, prefer_existing).cast(TABLE))


def amend_with_tracks(flashes: Column, tracks: Column, window: float = 10.0) -> Column:
    """Flash times (array) with those within ``window`` of a track's time replaced by that time.

    Tracks are structs ``energy, cluster, t0``, most energetic first; a track far from all flashes changes nothing.
    """
    order = F.array_sort(F.transform(tracks, lambda a: F.struct((-a["energy"]).alias("e"), a["cluster"].alias("c"), a["t0"].alias("t0"))))

    def step(acc: Column, a: Column) -> Column:
        near = F.exists(acc, lambda t: F.abs(t - a["t0"]) <= window)
        rest = F.filter(acc, lambda t: F.abs(t - a["t0"]) > window)
        return F.when(near, F.array_sort(F.concat(rest, F.array(a["t0"].cast("double"))))).otherwise(acc)

    return F.aggregate(order, flashes.cast("array<double>"), step)


def received_sources(table: DataFrame, by: list[str], separation: float = 5.0) -> DataFrame:
    """``by, t0``: received candidates, rounded, merged where less than ``separation`` apart."""
    rows = candidate_rows(table, by).where("received").select(*by, F.rint("t0").alias("t0")).distinct()
    return gap_medians(rows, "t0", separation, by, rounded=True, drop_zero=True).select(*by, F.col("center").alias("t0"))


def canonicalize(df: DataFrame, by: list[str], t0: str, merge_ticks: float = 5.0) -> DataFrame:
    """``by, t0``: values that round to 0 dropped, the rest merged to medians."""
    return gap_medians(df, t0, merge_ticks, by, drop_zero=True).select(*by, F.col("center").alias("t0"))


def near_pairs(left: DataFrame, right: DataFrame, by: list[str], ltime: str, rtime: str, window: float) -> DataFrame:
    """Left rows joined with right rows of their group at most ``window`` away, as an equi-join on time cells.

    Right columns other than ``by`` must not bear names of left ones.
    """
    width = max(window, 1e-9)
    l = left.withColumn("_c", F.floor(F.col(ltime) / width))
    r = right.withColumn("_c", F.explode(F.sequence(F.floor((F.col(rtime) - window) / width), F.floor((F.col(rtime) + window) / width))))
    return l.join(r, [*by, "_c"]).where(F.abs(F.col(ltime) - F.col(rtime)) <= window).drop("_c")


def associated_sources(candidates: DataFrame, hits: DataFrame, by: list[str], window: float = 5.0) -> DataFrame:
    """Distinct ``by, t0`` of candidates that have an assigned hit (``hit_t0 >= 0``) within ``window``; times rounding to 0 are dropped."""
    assigned = hits.where(finite(F.col("hit_t0")) & (F.col("hit_t0") >= 0)).select(*by, "hit_t0").distinct()
    c = candidates.where(valid_t0(F.col("t0"))).select(*by, "t0").distinct()
    return near_pairs(c, assigned, by, "t0", "hit_t0", window).select(*by, "t0").distinct()


def source_detail(candidates: DataFrame, hits: DataFrame, by: list[str], window: float = 5.0) -> DataFrame:
    """Hits, energy and labels (``label``) assigned near each candidate."""
    h = hits.where(finite(F.col("hit_t0")) & (F.col("hit_t0") >= 0)).select(*by, "hit_t0", "energy", "label")
    return (
        near_pairs(candidates.select(*by, "t0"), h, by, "t0", "hit_t0", window)
        .groupBy(*by, "t0").agg(F.count(F.lit(1)).alias("n_hits"), F.sum("energy").alias("energy"), F.sort_array(F.collect_set("label")).alias("labels"))
    )


def snap_to_charge(candidates: DataFrame, hits: DataFrame, by: list[str], window: float = 5.0, merge_ticks: float = 5.0) -> DataFrame:
    """Candidates merged, each moved to the energy-weighted median of the hits within ``window``, and merged again."""
    from tickloom.operators.metrics import weighted_quantiles

    first = canonicalize(candidates, by, "t0", merge_ticks)
    h = hits.where(finite(F.col("hit_t0")) & (F.col("hit_t0") >= 0)).select(*by, "hit_t0", "energy")
    near = near_pairs(first, h, by, "t0", "hit_t0", window)
    moved = weighted_quantiles(near, "hit_t0", "energy", {"_m": 0.5}, [*by, "t0"])
    both = first.join(moved, [*by, "t0"], "left").select(*by, F.coalesce("_m", "t0").alias("t0"))
    return canonicalize(both, by, "t0", merge_ticks)


def canonical_insert(candidates: DataFrame, by: list[str], t0: Column, merge_ticks: float = 5.0) -> DataFrame:
    """Candidates (by, t0) with those within ``merge_ticks`` of the new time, or rounding to 0, replaced by it, then merged to medians.

    ``t0`` is the new time of each row's group.
    """
    far = candidates.where((F.abs(F.col("t0") - t0) > merge_ticks) & (F.rint("t0") != 0)).select(*by, "t0")
    new = candidates.select(*by, t0.cast("double").alias("t0")).distinct()
    return canonicalize(far.unionByName(new), by, "t0", merge_ticks)
