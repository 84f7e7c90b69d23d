"""Which channels carry the light of a cluster: shares, runs, tiles, vetoes and their widening."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.arrays import saturated
from tickloom.operators.gaps import islands


def clipped_peak(samples):
    return F.greatest(F.coalesce(F.array_max(samples).cast("double"), F.lit(0.0)), F.lit(0.0))


def clipped_sum(samples):
    return F.aggregate(samples, F.lit(0.0), lambda s, v: s + F.greatest(F.coalesce(v.cast("double"), F.lit(0.0)), F.lit(0.0)))


def top_share(df: DataFrame, by: list[str], channel: str, light: str, share: float = 0.90, floor: float | None = None) -> DataFrame:
    """Channels of the smallest set, brightest first, that holds ``share`` of the light, and any with ``floor`` or more.

    Ties by channel. A group without light has no rows: its support is all channels.
    """
    w = Window.partitionBy(*by).orderBy(F.desc(light), channel)
    before = F.coalesce(F.sum(light).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    total = F.sum(light).over(Window.partitionBy(*by))
    keep = (F.col("_total") > 0) & (F.col("_before") < share * F.col("_total"))
    if floor is not None:
        keep = keep | ((F.col("_total") > 0) & (F.col(light) >= floor))
    return df.withColumn("_before", before).withColumn("_total", total).where(keep & (F.col(light) > 0)).drop("_before", "_total")


def side_runs(df: DataFrame, by: list[str], channel: str, light: str, side_channels: int, share: float = 0.90, max_gap: int = 2) -> DataFrame:
    """``by, side, first, last, light``: on each side the brightest run of supported channels, gaps of ``max_gap`` filled.

    The light of a run counts its filled channels too; ties go to the lower run.
    """
    sided = df.withColumn("side", F.floor(F.col(channel) / side_channels).cast("int"))
    support = top_share(sided, by, channel, light, share)
    runs = islands(support, [*by, "side"], channel, max_gap)
    inside = runs.join(sided, [*by, "side"]).where((F.col(channel) >= F.col("first")) & (F.col(channel) <= F.col("last")))
    bright = inside.groupBy(*by, "side", "island", "first", "last").agg(F.sum(light).alias("light"))
    w = Window.partitionBy(*by, "side").orderBy(F.desc("light"), "first")
    return bright.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "island")


def run_channels(runs: DataFrame) -> DataFrame:
    """The channels of runs, one per row."""
    return runs.withColumn("channel", F.explode(F.sequence("first", "last"))).drop("first", "last", "light")


def bright_tiles(df: DataFrame, by: list[str], channel: str, light: str, keep: int = 4, width: int = 6) -> DataFrame:
    """Channels in the ``keep`` brightest tiles of ``width`` channels (ties by tile)."""
    tiled = df.withColumn("_tile", F.floor(F.col(channel) / width))
    t = tiled.groupBy(*by, "_tile").agg(F.sum(light).alias("_l"))
    best = t.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("_l"), "_tile"))).where(F.col("_r") <= keep)
    return tiled.join(best.select(*by, "_tile"), [*by, "_tile"], "left_semi").drop("_tile")


def saturation_veto(light: DataFrame, samples: str = "samples", threshold: float = 60700.0, most: int = 6) -> DataFrame:
    """The rows of ``light`` whose channel is above ``threshold`` for more than ``most`` ticks."""
    return light.where(saturated(F.col(samples), threshold, most))


def saturation_summary(light: DataFrame, by: list[str], samples: str = "samples", threshold: float = 60700.0, most: int = 6) -> DataFrame:
    return light.groupBy(*by).agg(F.count(F.lit(1)).alias("n_channels"), F.count_if(saturated(F.col(samples), threshold, most)).alias("n_saturated"))


def apply_veto(support: DataFrame, veto: DataFrame, all_channels: DataFrame, by: list[str], group: list[str], channel: str = "channel") -> DataFrame:
    """Support without vetoed channels; a group left with none falls back to all its unsaturated channels.

    ``group`` are the columns of a support entry, ``by`` (a part of them) tells where channels and vetoes belong.
    """
    kept = support.join(veto.select(*by, channel).distinct(), [*by, channel], "left_anti").select(*group, channel)
    empty = support.select(*group).distinct().join(kept.select(*group).distinct(), group, "left_anti")
    free = all_channels.select(*by, channel).distinct().join(veto.select(*by, channel).distinct(), [*by, channel], "left_anti")
    return kept.unionByName(empty.join(free, by).select(*group, channel))


def eligible_clusters(images: DataFrame, cluster: list[str], tpc: str = "tpc", kinds: DataFrame | None = None, split: int = 0) -> DataFrame:
    """``cluster, n_tpcs, eligible``: clusters of one TPC; with ``kinds`` (label_type) also those of several TPCs
    that are no backbone (id >= split) or are tracks. Showers never are."""
    n = images.groupBy(*cluster).agg(F.count_distinct(tpc).alias("n_tpcs"))
    if kinds is None:
        return n.withColumn("eligible", F.col("n_tpcs") == 1)
    k = n.join(kinds, cluster, "left")
    shower = F.coalesce(F.lower("label_type").contains("shower"), F.lit(False))
    return k.withColumn("eligible", ~shower & ((F.col("n_tpcs") == 1) | (F.col(cluster[-1]) >= split) | (F.lower("label_type") == "track"))).select(*cluster, "n_tpcs", F.coalesce("eligible", F.lit(False)).alias("eligible"))


def widened(support: DataFrame, by: list[str], side_channels: int, group_size: int = 6, more: int = 1, channel: str = "channel") -> DataFrame:
    """Support widened to whole groups of ``group_size`` channels and ``more`` groups on either end of each side."""
    per_side = side_channels // group_size
    g = support.withColumn("_side", F.floor(F.col(channel) / side_channels).cast("int")).withColumn("_g", F.floor((F.col(channel) % side_channels) / group_size).cast("int"))
    ends = g.groupBy(*by, "_side").agg(F.greatest(F.min("_g") - more, F.lit(0)).alias("_a"), F.least(F.max("_g") + more, F.lit(per_side - 1)).alias("_b"))
    first = F.col("_side") * side_channels + F.col("_a") * group_size
    last = F.col("_side") * side_channels + (F.col("_b") + 1) * group_size - 1
    return ends.withColumn(channel, F.explode(F.sequence(first, last))).select(*by, channel)


def energy_order(clusters: DataFrame, by: list[str], label: str, energy: str, noise: int = -1) -> DataFrame:
    """Labels numbered from 0 by energy, largest first (ties by label), noise last."""
    w = Window.partitionBy(*by).orderBy(F.when(F.col(label) == noise, 1).otherwise(0), F.desc(energy), label)
    return clusters.withColumn("position", (F.row_number().over(w) - 1).cast("int"))


def normalized_delta(df: DataFrame, by: list[str], delta: str, energy: str, anchor: str) -> DataFrame:
    """Rows of loss changes over their largest absolute one, times sqrt(energy / anchor) clipped to 0.25..1."""
    top = F.max(F.abs(delta)).over(Window.partitionBy(*by))
    scale = F.greatest(F.lit(0.25), F.least(F.lit(1.0), F.sqrt(F.col(energy) / F.col(anchor))))
    return df.withColumn("score", F.when(top > 0, F.col(delta) / top).otherwise(F.lit(0.0)) * scale)
