"""Weighted quantiles, residual summaries, success rates, clustering quality and regression scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.skew import join_null_safe, quantile_buckets


def cumulative(df: DataFrame, by: list[str], x: str, w: str, buckets: int = 64) -> DataFrame:
    """``by, x, w, cum, total``: running weight over distinct ``x`` in ascending order.

    Each group is cut at quantiles into buckets whose weights are summed first, so that a group,
    even the only one, is ordered in many tasks.
    """
    state = df.groupBy(*by, F.col(x).alias("_x")).agg(F.sum(w).alias("_w"))
    s = quantile_buckets(state, by, "_x", buckets)
    part = s.groupBy(*by, "_b").agg(F.sum("_w").alias("_bw"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # one row a bucket
    before = group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    part = part.select(*by, "_b", F.coalesce(F.sum("_bw").over(before), F.lit(0.0)).alias("_before"), F.sum("_bw").over(group).alias("total"))
    s = join_null_safe(s, part, by, ["_b"])
    inner = Window.partitionBy(*by, "_b").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    return s.select(*by, F.col("_x").alias("x"), F.col("_w").alias("w"), (F.col("_before") + F.sum("_w").over(inner)).alias("cum"), "total")


def weighted_quantiles(df: DataFrame, x: str, w: str, quantiles: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Per group the smallest ``x`` whose share of the cumulative weight reaches each quantile; no interpolation.

    Rows whose ``x`` or weight is NULL or not finite, or whose weight is not positive, are left out.
    """
    by = by or []
    ok = F.col(x).isNotNull() & ~F.isnan(x) & F.col(w).isNotNull() & ~F.isnan(w) & (F.col(w) > 0) & (F.abs(x) != float("inf")) & (F.abs(w) != float("inf"))
    c = cumulative(df.where(ok), by, x, w)
    # a share that is short of q by rounding alone still reaches it
    aggs = [F.coalesce(F.min(F.when(F.col("cum") >= q * F.col("total") * (1 - 1e-12), F.col("x"))), F.max("x")).alias(n) for n, q in quantiles.items()]
    return c.groupBy(*by).agg(*aggs)


def valid_residual(truth: Column, reco: Column, energy: Column, assigned_only: bool = True) -> Column:
    inf = float("inf")
    ok = ~F.isnan(truth) & ~F.isnan(reco) & ~F.isnan(energy) & (F.abs(truth) != inf) & (F.abs(reco) != inf) & (F.abs(energy) != inf) & (energy > 0)
    return F.coalesce(ok & (reco >= 0) if assigned_only else ok, F.lit(False))


def residual_summary(df: DataFrame, truth: str, reco: str, energy: str, window_ns: float = 160.0, by: list[str] | None = None, assigned_only: bool = True) -> DataFrame:
    """Energy-weighted mean, std, quantiles and share within +/- ``window_ns`` of (truth - reco) * 16 ns.

    The window's edge is inside. Rows without finite values, with energy not above 0 and, unless
    ``assigned_only`` is off, with a negative reco time are left out; no rows give no row per group
    (one row of n = 0 without groups).
    """
    by = by or []
    d = df.where(valid_residual(F.col(truth), F.col(reco), F.col(energy), assigned_only)).select(*by, ((F.col(truth) - F.col(reco)) * 16).alias("d"), F.col(energy).cast("double").alias("w"))
    sums = d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("w").alias("_w"),
        F.sum(F.col("w") * F.col("d")).alias("_wd"),
        F.sum(F.col("w") * F.col("d") * F.col("d")).alias("_wdd"),
        F.sum(F.when(F.abs("d") <= window_ns, F.col("w"))).alias("_in"),
    )
    mean = F.col("_wd") / F.col("_w")
    stats = sums.select(
        *by, "n", mean.alias("mean_ns"), F.sqrt(F.greatest(F.col("_wdd") / F.col("_w") - mean * mean, F.lit(0.0))).alias("std_ns"),
        (100 * F.coalesce("_in", F.lit(0.0)) / F.col("_w")).alias("within_pct"),
    )
    q = weighted_quantiles(d, "d", "w", {"p16_ns": 0.16, "median_ns": 0.5, "p84_ns": 0.84}, by)
    return stats.join(q, by, "left") if by else stats.crossJoin(F.broadcast(q))


def energy_bins(energy: Column, edges: list[float]) -> Column:
    """Label of the half-open bin [a, b) of an energy; the last bin is open."""
    label = F.lit(None).cast("string")
    for a, b in zip(edges, [*edges[1:], None]):
        inside = (energy >= a) if b is None else (energy >= a) & (energy < b)
        label = F.when(inside, F.lit(f"{a:g}-{'inf' if b is None else f'{b:g}'}")).otherwise(label)
    return label


def success_by_bin(df: DataFrame, ok: Column, energy: str, edges: list[float]) -> DataFrame:
    """``bin, n, n_ok, share, energy_share`` by energy bin, and over all as bin 'all'."""
    b = df.select(energy_bins(F.col(energy), edges).alias("bin"), F.col(energy).cast("double").alias("_e"), ok.alias("_ok")).where("bin IS NOT NULL")
    out = b.rollup("bin").agg(F.count(F.lit(1)).alias("n"), F.count_if("_ok").alias("n_ok"), F.sum("_e").alias("_a"), F.sum(F.when(F.col("_ok"), F.col("_e")).otherwise(0.0)).alias("_b"))
    return out.select(F.coalesce("bin", F.lit("all")).alias("bin"), "n", "n_ok", (F.col("n_ok") / F.col("n")).alias("share"), (F.col("_b") / F.col("_a")).alias("energy_share"))


def group_success(df: DataFrame, by: list[str], ok: Column, energy: str) -> DataFrame:
    """Share of hits and of energy that is right, per vertex, interaction or any other group."""
    e = F.col(energy).cast("double")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_hits"), F.sum(e).alias("energy"), (F.count_if(ok) / F.count(F.lit(1))).alias("hit_share"), (F.sum(F.when(ok, e).otherwise(0.0)) / F.sum(e)).alias("energy_share")
    )


def weighted_histogram(df: DataFrame, x: str, w: str, low: float, high: float, width: float) -> DataFrame:
    """``bin, weight_share`` of fixed-width bins on [low, high]; the last bin includes ``high``."""
    n = round((high - low) / width)
    b = F.least(F.floor((F.col(x) - low) / width), F.lit(n - 1)).cast("int")
    inside = df.where((F.col(x) >= low) & (F.col(x) <= high)).groupBy(b.alias("bin")).agg(F.sum(w).alias("_w"))
    total = df.where(~F.isnan(x)).agg(F.sum(w).alias("_t"))
    return inside.crossJoin(F.broadcast(total)).select("bin", (F.col("_w") / F.col("_t")).alias("weight_share"))


def dominant_value(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """``by, mode, share``: the commonest value rounded half to even, the smallest of equally common ones.

    Only values that are finite and not negative count.
    """
    v = F.rint(value)
    ok = ~F.isnan(value) & (F.col(value) >= 0) & (F.col(value) != float("inf"))
    n = df.where(ok).groupBy(*by, v.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    return n.groupBy(*by).agg(F.max_by("_v", F.struct("_n", -F.col("_v"))).alias("mode"), (F.max("_n") / F.sum("_n")).alias("share"))


def label_summary(df: DataFrame, by: list[str], label: str, most: int = 8) -> DataFrame:
    """``by, summary``: the commonest labels as 'label:count' (ties by label)."""
    n = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("_n"))
    ranked = n.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("_n"), label))).where(F.col("_r") <= most)
    items = F.sort_array(F.collect_list(F.struct("_r", F.concat_ws(":", label, "_n").alias("s"))))
    return ranked.groupBy(*by).agg(F.array_join(F.transform(items, lambda x: x["s"]), " ").alias("summary"))


def contingency_metrics(df: DataFrame, reco: str, truth: str) -> DataFrame:
    """Purity, efficiency, split and merge rates, adjusted Rand index, noise share; rounded to 4 decimals.

    Rows with a truth label below 0 or NULL count for the noise share only; a reco label below 0 is
    noise. Without an assigned row: purity, efficiency, merge and index 0, split 1.
    """
    r, t = F.col(reco), F.col(truth)
    cells = df.where(t >= 0).groupBy(F.when(r >= 0, r).alias("r"), t.alias("t")).agg(F.count(F.lit(1)).alias("n"))
    noise = df.agg(F.avg(F.when(r < 0, 1.0).otherwise(0.0)).alias("noise"))
    assigned = cells.where("r IS NOT NULL")
    by_r = assigned.groupBy("r").agg(F.sum("n").alias("n"), F.max("n").alias("top"), F.count(F.lit(1)).alias("k"))
    by_t = cells.groupBy("t").agg(F.sum("n").alias("n"), F.max(F.when(F.col("r").isNotNull(), F.col("n"))).alias("top"), F.count("r").alias("k"), F.sum(F.when(F.col("r").isNotNull(), F.col("n"))).alias("m"))

    def pairs(c: str) -> Column:
        return F.col(c).cast("double") * (F.col(c) - 1) / 2

    a = by_r.agg(F.sum("top").alias("top"), F.sum("n").alias("n"), F.avg(F.when(F.col("k") >= 2, 1.0).otherwise(0.0)).alias("merge"), F.sum(pairs("n")).alias("pa"))
    b = by_t.agg(F.avg(F.coalesce("top", F.lit(0)) / F.col("n")).alias("eff"), F.avg(F.when(F.col("k") >= 2, 1.0).otherwise(0.0)).alias("split"), F.sum(F.coalesce(pairs("m"), F.lit(0.0))).alias("pb"))
    c = assigned.agg(F.sum(pairs("n")).alias("pc"))
    one = a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(c)).crossJoin(F.broadcast(noise))  # single rows
    expected = F.col("pa") * F.col("pb") / F.nullif(F.col("n").cast("double") * (F.col("n") - 1) / 2, F.lit(0.0))
    ari = (F.col("pc") - expected) / F.nullif((F.col("pa") + F.col("pb")) / 2 - expected, F.lit(0.0))
    some = F.coalesce(F.col("n"), F.lit(0)) > 0
    return one.select(
        F.round(F.when(some, F.col("top") / F.col("n")).otherwise(0.0), 4).alias("purity"),
        F.round(F.when(some, F.col("eff")).otherwise(0.0), 4).alias("efficiency"),
        F.round(F.when(some, F.col("split")).otherwise(1.0), 4).alias("split_rate"),
        F.round(F.when(some, F.col("merge")).otherwise(0.0), 4).alias("merge_rate"),
        F.round(F.when(some, F.coalesce(ari, F.lit(1.0))).otherwise(0.0), 4).alias("ari"),
        F.round("noise", 4).alias("noise_share"),
    )


def standardizer(df: DataFrame, by: list[str], x: Column, keep: Column) -> DataFrame:
    """Masked population mean and standard deviation per channel from one pass of partial sums."""
    v = F.when(keep, x)
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))


def regression_scores(df: DataFrame, by: list[str], want: Column, got: Column, keep: Column, floor: float = 1e-12) -> DataFrame:
    """Per channel MSE, MAE and R2 = 1 - MSE / variance (at least ``floor``) over the kept rows."""
    w, d = F.when(keep, want), F.when(keep, got - want)
    return df.groupBy(*by).agg(F.count(d).alias("n"), F.avg(d * d).alias("mse"), F.avg(F.abs(d)).alias("mae"), (1 - F.avg(d * d) / F.greatest(F.var_pop(w), F.lit(floor))).alias("r2"))


def raw_kurtosis(x: Column) -> Column:
    """m4 / m2^2 (3 for a normal distribution)."""
    return F.kurtosis(x) + 3


def gaussian_nll(df: DataFrame, by: list[str], want: Column, got: Column, logvar: Column, calibration: float) -> DataFrame:
    """Mean negative log likelihood plus ``calibration`` times the squared distance of the pull width from 1."""
    r = want - got
    nll = F.avg(0.5 * (logvar + r * r / F.exp(logvar)))
    pull = F.stddev_samp(r / F.exp(0.5 * logvar))
    return df.groupBy(*by).agg((nll + calibration * F.pow(pull - 1, 2)).alias("loss"), pull.alias("pull_width"))


def multi_vertex_events(df: DataFrame, event: str, vertex: str, least_vertices: int, least_hits: int, most: int) -> DataFrame:
    """The events with the most vertices: at least so many vertices and hits; ties by event."""
    n = df.where(F.col(vertex) >= 0).groupBy(event, vertex).agg(F.count(F.lit(1)).alias("_h"))
    e = n.groupBy(event).agg(F.count(F.lit(1)).alias("n_vertices"), F.sum("_h").alias("n_hits"))
    return e.where((F.col("n_vertices") >= least_vertices) & (F.col("n_hits") >= least_hits)).orderBy(F.desc("n_vertices"), event).limit(most)


def cluster_evaluation(hits: DataFrame, by: list[str], reco: str, truth: str, energy: str, tolerance: float) -> DataFrame:
    """Per cluster: median reco time, energy-weighted truth, energy, hits, and whether they agree within ``tolerance``."""
    t, e = F.when(~F.isnan(truth), F.col(truth)), F.col(energy).cast("double")
    got = F.median(F.when(~F.isnan(reco) & (F.col(reco) >= 0), F.col(reco)))
    want = F.sum(t * e) / F.sum(F.when(t.isNotNull(), e))
    d = hits.groupBy(*by).agg(F.count(F.lit(1)).alias("n_hits"), F.sum(e).alias("energy"), got.alias("reco"), want.alias("truth"))
    return d.withColumn("correct", F.coalesce(F.abs(F.col("reco") - F.col("truth")) <= tolerance, F.lit(False)))


def event_rollup(groups: DataFrame, event: list[str], share: str, least: float) -> DataFrame:
    """Per event: groups, the median of their shares, how many fall below ``least``."""
    return groups.groupBy(*event).agg(F.count(F.lit(1)).alias("n_groups"), F.median(share).alias("median_share"), F.count_if(F.col(share) < least).alias("n_below"))


def interaction_success(hits: DataFrame, by: list[str], truth: str, ok: Column, energy: str, rounding: float) -> DataFrame:
    """Success of the hits of one TPC whose true times round (half to even) to the same multiple of ``rounding``."""
    t = F.rint(F.col(truth) / rounding)
    return group_success(hits.where(~F.isnan(truth)).withColumn("interaction", t), [*by, "interaction"], ok, energy)


def assignment_audit(log: DataFrame, hits: DataFrame, by: list[str], cluster: str = "cluster") -> DataFrame:
    """The last log entry of each cluster (``seq``) with its hits' dominant time and share; ``position``: assigned first, then by energy, then id."""
    cols = [c for c in log.columns if c not in (*by, cluster)]
    last = log.groupBy(*by, cluster).agg(F.max_by(F.struct(*cols), "seq").alias("_l")).select(*by, cluster, "_l.*")
    j = last.join(dominant_value(hits, [*by, cluster], "t0"), [*by, cluster], "left")
    w = Window.partitionBy(*by).orderBy(F.desc("assigned"), F.desc("energy"), cluster)
    return j.withColumn("position", F.row_number().over(w))


def cluster_state(hits: DataFrame, by: list[str], t0: str, energy: str, least: int = 1, tolerance: float = 1e-3) -> DataFrame:
    """Per cluster of ``least`` hits: hits, energy, median time of the assigned ones, and whether these are all alike."""
    t = F.when(~F.isnan(t0) & (F.col(t0) >= 0), F.col(t0))
    d = hits.groupBy(*by).agg(F.count(F.lit(1)).alias("n_hits"), F.sum(energy).alias("energy"), F.median(t).alias("t0"), (F.max(t) - F.min(t) <= tolerance).alias("uniform"), F.count(t).alias("n_assigned"))
    return d.where(F.col("n_hits") >= least)
