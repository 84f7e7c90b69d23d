"""Joining reconstructed hits with simulated truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.skew import join_null_safe, ordered_rank


def best_segment(backtrack: DataFrame, key: str = "hit_row", segments: str = "segment_ids", fractions: str = "fraction") -> DataFrame:
    """``key, segment_id``: the slot with the largest fraction, the first of equal ones.

    Slots with a negative or NULL segment are empty; a NULL or NaN fraction counts as lowest. Rows
    without a slot are left out. Works inside the row: no shuffle.
    """
    slots = F.transform(
        F.col(segments),
        lambda s, i: F.struct(F.coalesce(F.nanvl(F.get(F.col(fractions), i).cast("double"), F.lit(float("-inf"))), F.lit(float("-inf"))).alias("f"), (-i).alias("p"), s.alias("s")),
    )
    best = F.array_max(F.filter(slots, lambda x: x["s"] >= 0))
    return backtrack.select(key, best["s"].alias("segment_id")).where("segment_id IS NOT NULL")


def first_segment(backtrack: DataFrame, key: str = "hit_row", segments: str = "segment_ids") -> DataFrame:
    """``key, segment_id``: the first slot that is not empty."""
    return backtrack.select(key, F.get(F.filter(F.col(segments), lambda s: s >= 0), F.lit(0)).alias("segment_id")).where("segment_id IS NOT NULL")


def truth_t0(backtrack: DataFrame, segments: DataFrame, reference_ns: Column, key: str = "hit_row") -> DataFrame:
    """``key, truth_t0`` in ticks: (t0 in us * 1000 - reference) / 16, NULL without slot, segment or finite time."""
    t = (F.col("t0") * 1000 - reference_ns) / 16
    best = backtrack.select(key).join(best_segment(backtrack, key), key, "left")
    return best.join(segments, "segment_id", "left").select(key, F.when(~F.isnan(t) & (F.abs(t) != float("inf")), t).alias("truth_t0"))


def last_row_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the last by ``order``."""
    cols = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in cols])


def first_match(refs: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """``key, value``: the first reference of each key by ``order`` wins."""
    return refs.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key).agg(F.min_by(value, order).alias(value))


def truth_of_hits(hits: DataFrame, backtrack: DataFrame, segments: DataFrame, interactions: DataFrame, reference_ns: Column, key: str = "hit_row") -> DataFrame:
    """Hits with segment, vertex, its place, absolute and relative times; NULL where truth is missing."""
    best = best_segment(backtrack, key)
    seg = segments.select("segment_id", "t0", "vertex_id")
    vertex = last_row_per_key(interactions, "vertex_id", "row_order")
    joined = hits.join(best, key, "left").join(seg, "segment_id", "left").join(vertex, "vertex_id", "left")
    ns = F.col("t0") * 1000
    return joined.withColumn("truth_t0", (ns - reference_ns) / 16)


def relative_time(df: DataFrame, time: str, by: list[str], name: str = "t_rel") -> DataFrame:
    """``time`` minus the smallest finite one of its group."""
    ok = F.when(~F.isnan(time) & (F.abs(time) != float("inf")), F.col(time))
    low = df.groupBy(*by).agg(F.min(ok).alias("_low"))
    return join_null_safe(df, low, by).withColumn(name, ok - F.col("_low")).drop("_low")


def reference_time_ns(events: DataFrame, light: DataFrame, refs: DataFrame) -> DataFrame:
    """``event_id, reference_ns``: unix seconds and microseconds, else the light event's first ms, else NULL.

    A NULL or NaN part makes a source unusable.
    """
    def ok(c: Column) -> Column:
        return F.when(~F.isnan(c), c)

    own = (ok(F.col("unix_ts")) * 1e9 + ok(F.col("unix_ts_usec")) * 1e3)
    first = F.get("utime_ms", F.lit(0))
    return (
        events.join(refs, "event_id", "left").join(light, "light_id", "left").select("event_id", F.coalesce(own, ok(first) * 1e6).alias("reference_ns"))
    )


def event_of_range(ranges: DataFrame, regions: DataFrame, cell: int = 4096) -> DataFrame:
    """``probe_id, event_row`` of the region that holds [lo, hi]: start <= lo and hi < stop.

    Of the regions that cover a cell of row numbers whole only the smallest ``event_row`` matters to
    ranges within that cell; exact checks are made in the two border cells of a region. Whole cells
    are kept as blocks of 2^level cells, a few for each region however wide it is.
    """
    at = lambda c: F.floor(c / cell)
    r = regions.where("stop > start").select("event_row", "start", "stop", F.ceil(F.col("start") / cell).alias("_a"), at(F.col("stop")).alias("_b"))
    borders = F.array_distinct(F.array(F.when(F.col("start") < F.col("_a") * cell, at(F.col("start"))), F.when(F.col("stop") > F.col("_b") * cell, F.col("_b"))))
    border = r.select("event_row", "start", "stop", F.explode(F.array_compact(borders)).alias("_c"))
    levels = r.where("_a < _b").withColumn("_l", F.explode(F.sequence(F.lit(0), F.ceil(F.log2(F.col("_b") - F.col("_a"))).cast("int"))))
    levels = levels.selectExpr("event_row", "start", "stop", "_l", "-shiftright(-_a, _l) AS _x", "shiftright(_b, _l) AS _y").where("_x < _y")
    blocks = levels.selectExpr("event_row", "start", "stop", "_l", "explode(array_compact(array(if(_x & 1 = 1, _x, NULL), if(_y & 1 = 1, _y - 1, NULL)))) AS _c")
    probes = ranges.select("probe_id", "lo", "hi", at(F.col("lo")).alias("_c"), (at(F.col("hi")) == at(F.col("lo"))).alias("_in"))

    def above(df: DataFrame) -> DataFrame:
        """Each cell under all the blocks that hold it: row numbers have 63 bits at most."""
        return df.withColumn("_l", F.explode(F.sequence(F.lit(0), F.lit(62)))).withColumn("_k", F.expr("shiftright(_c, _l)"))

    inside = probes.where("_in")
    least = blocks.groupBy("_l", F.col("_c").alias("_k")).agg(F.min("event_row").alias("event_row"))
    whole = above(inside.select("_c").distinct()).join(least, ["_l", "_k"]).groupBy("_c").agg(F.min("event_row").alias("event_row"))
    cover = border.withColumn("_l", F.lit(0)).unionByName(blocks).withColumnRenamed("_c", "_k")
    found = [
        inside.join(border, "_c").where("start <= lo AND hi < stop").select("probe_id", "event_row"),
        inside.join(whole, "_c").select("probe_id", "event_row"),
        above(probes.where("NOT _in")).join(cover, ["_l", "_k"]).where("start <= lo AND hi < stop").select("probe_id", "event_row"),
    ]
    return found[0].unionByName(found[1]).unionByName(found[2]).groupBy("probe_id").agg(F.min("event_row").alias("event_row"))


def rows_by_index(index: DataFrame, rows: DataFrame, key: str, position: str) -> DataFrame:
    """Rows at arbitrary keys in the order of ``position``; repeated keys repeat their row, missing ones give NULLs."""
    return index.join(rows, key, "left").orderBy(position)


def prompt_of_final(final: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """``final_row, prompt_row``: from the reference table, else the row's own ``id``."""
    if refs is None:
        return final.select("final_row", F.col("id").alias("prompt_row"))
    r = refs.groupBy("final_row").agg(F.min("prompt_row").alias("_p"))
    return final.join(r, "final_row", "left").select("final_row", F.coalesce("_p", "id").alias("prompt_row"))


def relabel_by_time(df: DataFrame, label: str, time: str, noise: int = -1, name: str = "group_no") -> DataFrame:
    """Labels renumbered from 0 by mean time, then label; noise stays noise."""
    mean = df.where(F.col(label) != noise).groupBy(label).agg(F.avg(time).alias("_t"))
    no = ordered_rank(mean, [], ["_t", label], name).select(label, F.col(name).cast("int").alias(name))
    return df.join(no, label, "left").withColumn(name, F.coalesce(name, F.lit(noise)))


def compact_labels(df: DataFrame, label: str, by: list[str], least: int = 1, noise: int = -1, name: str = "compact") -> DataFrame:
    """Labels renumbered 0..K-1 in each group; noise and labels of fewer than ``least`` rows become noise."""
    n = df.where(F.col(label) != noise).groupBy(*by, label).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    no = n.withColumn(name, (F.row_number().over(Window.partitionBy(*by).orderBy(label)) - 1).cast("int")).drop("_n")
    return df.join(no, [*by, label], "left").withColumn(name, F.coalesce(name, F.lit(noise)))


def light_event_of(charge: DataFrame, light: DataFrame, refs: DataFrame) -> DataFrame:
    """``event_id, light_id``: the referenced light event, else the one of the same id, else the one at the same position."""
    ref = first_match(refs, "event_id", "light_id", "ref_id").withColumnRenamed("light_id", "_by_ref")
    own = light.select(F.col("light_id").alias("event_id"), F.col("light_id").alias("_by_id")).distinct()
    at = light.groupBy("row").agg(F.min("light_id").alias("_by_row"))
    j = charge.select("event_id", "row").join(ref, "event_id", "left").join(own, "event_id", "left").join(at, "row", "left")
    return j.select("event_id", F.coalesce("_by_ref", "_by_id", "_by_row").alias("light_id")).distinct()
