"""Light of candidates against data: window summaries, overflow and deficit ranking, residual curves and holes.

Tables in long form have one row per (.., channel) with the arrays ``actual``, ``model`` and ``std``.
A candidate meets the channels of its own TPC only, and windows are cut out of the arrays inside the
row, so one shuffle by TPC is all that moves.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.arrays import asum
from tickloom.operators.gaps import moving_average, top_peaks
from tickloom.operators.geometry import PULSE_PEAK_TICK


@dataclass(frozen=True)
class LightRules:
    peak: int = PULSE_PEAK_TICK
    half_window: int = 18
    sigma: float = 3.0
    overflow_adc: float = 400.0
    model_adc: float = 400.0
    least_channels: int = 6
    least_deficit: float = 5000.0


def _window(a: Column, tick: Column, half: int) -> Column:
    lo = F.greatest(tick - half, F.lit(0))
    return F.slice(a, (lo + 1).cast("int"), F.greatest(F.least(tick + half, F.size(a) - 1) - lo + 1, F.lit(0)).cast("int"))


def window_summaries(light: DataFrame, candidates: DataFrame, by: list[str], rules: LightRules = LightRules()) -> DataFrame:
    """``by, t0`` with channel counts and sums of overflow and deficit in the window around the pulse peak, and at it.

    A cell overflows where model - actual exceeds max(sigma * std, overflow_adc) and the model
    exceeds model_adc. Candidates whose peak lies outside the waveform are left out.
    """
    tick = (F.rint("t0") + rules.peak).cast("int")
    c = candidates.select(*by, "t0").distinct()
    j = light.join(c, by).withColumn("_tick", tick).where((F.col("_tick") >= 0) & (F.col("_tick") < F.size("actual")))
    a, m, s = (F.col(x).cast("array<double>") for x in ("actual", "model", "std"))
    cut = F.arrays_zip(_window(a, F.col("_tick"), rules.half_window).alias("a"), _window(m, F.col("_tick"), rules.half_window).alias("m"), _window(s, F.col("_tick"), rules.half_window).alias("s"))
    cells = F.transform(
        cut,
        lambda x: F.struct(
            (x["m"] - x["a"]).alias("d"),
            F.greatest(rules.sigma * F.greatest(x["s"], F.lit(1e-6)), F.lit(rules.overflow_adc)).alias("t"),
            x["m"].alias("m"),
        ),
    )

    def over(x: Column) -> Column:
        return (x["d"] > x["t"]) & (x["m"] > rules.model_adc)

    at = F.get(F.col("_cells"), F.least(F.col("_tick"), F.lit(rules.half_window)))
    per = j.withColumn("_cells", cells).select(
        *by,
        "t0",
        F.exists("_cells", over).alias("o"),
        F.exists("_cells", lambda x: -x["d"] > x["t"]).alias("u"),
        asum(F.transform(F.filter("_cells", over), lambda x: x["d"])).alias("os"),
        asum(F.transform("_cells", lambda x: F.greatest(-x["d"], F.lit(0.0)))).alias("us"),
        asum(F.transform("_cells", lambda x: F.greatest(x["d"], F.lit(0.0)))).alias("xs"),
        F.when(over(at), at["d"]).otherwise(0.0).alias("po"),
        F.greatest(-at["d"], F.lit(0.0)).alias("pu"),
        asum(F.transform("_cells", lambda x: F.pow(x["d"] , 2))).alias("sq"),
        F.size("_cells").alias("dof"),
    )
    n = F.count_if("o")
    out = per.groupBy(*by, "t0").agg(
        n.alias("overflow_channels"), F.count_if("u").alias("deficit_channels"), F.count_if(F.col("po") > 0).alias("peak_overflow_channels"),
        F.sum("os").alias("window_overflow"), F.sum("us").alias("window_deficit"), F.sum("xs").alias("window_excess"), F.sum("po").alias("peak_overflow"), F.sum("pu").alias("peak_deficit"),
        F.sum("dof").alias("dof"),
    )
    return out.withColumn("severity", F.col("peak_overflow") / F.greatest(F.col("overflow_channels"), F.lit(1)) + 0.002 * F.col("window_overflow"))


def overflow_ranking(summaries: DataFrame, event: list[str], tpc: str = "tpc", rules: LightRules = LightRules(), most: int | None = None) -> DataFrame:
    """Summaries with enough overflow channels and their ``source_rank`` within the event: severity, window, channels, TPC, t0."""
    order = [F.desc("severity"), F.desc("window_overflow"), F.desc("overflow_channels"), F.col(tpc), F.col("t0")]
    w = (Window.partitionBy(*event) if event else Window.partitionBy(F.lit(0))).orderBy(*order)
    r = summaries.where(F.col("overflow_channels") >= rules.least_channels).withColumn("source_rank", F.row_number().over(w))
    return r.where(F.col("source_rank") <= most) if most else r


def destination_ranking(summaries: DataFrame, by: list[str], source: Column, merge_ticks: float, rules: LightRules = LightRules(), most: int = 10) -> DataFrame:
    """Candidates further than ``merge_ticks`` from the source with enough deficit, most deficit first (ties by t0)."""
    w = Window.partitionBy(*by).orderBy(F.desc("window_deficit"), "t0")
    ok = (F.abs(F.col("t0") - source) > merge_ticks) & (F.col("window_deficit") >= rules.least_deficit)
    return summaries.where(ok).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def window_ticks(candidates: DataFrame, by: list[str], ticks: int, half: int, peak: int = PULSE_PEAK_TICK) -> DataFrame:
    """``by, tick``: union of the windows around the candidates' peaks; all ticks for a group without any inside."""
    t = F.rint("t0") + peak
    c = candidates.withColumn("_t", t.cast("int"))
    hit = c.where(F.col("_t").between(0, ticks - 1))
    spans = hit.select(*by, F.explode(F.sequence(F.greatest(F.col("_t") - half, F.lit(0)), F.least(F.col("_t") + half, F.lit(ticks - 1)))).alias("tick")).distinct()
    none = c.select(*by).distinct().join(hit.select(*by).distinct(), by, "left_anti")
    return spans.unionByName(none.withColumn("tick", F.explode(F.sequence(F.lit(0), F.lit(ticks - 1)))))


def window_chi2(light: DataFrame, ticks: DataFrame, by: list[str], std_floor: float) -> DataFrame:
    """``by, chi2, dof``: sum of ((model - actual) / std)^2 over the given ticks."""
    cells = light.select(*by, F.posexplode(F.arrays_zip("actual", "model", "std")).alias("tick", "_x"))
    r = (F.col("_x.model") - F.col("_x.actual")) / F.greatest(F.col("_x.std"), F.lit(std_floor))
    return cells.join(ticks, [*by, "tick"]).groupBy(*by).agg(F.sum(r * r).alias("chi2"), F.count(F.lit(1)).alias("dof"))


def summed_curve(light: DataFrame, by: list[str], value: Column) -> DataFrame:
    """``by, curve``: an array per row summed tick by tick over the rows of a group.

    ``value`` is an array column. Ticks are summed on the map side before they are put in order.
    """
    ticks = light.select(*by, F.posexplode(value).alias("tick", "v")).groupBy(*by, "tick").agg(F.sum("v").alias("v"))
    return ticks.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("tick", "v"))), lambda s: s["v"]).alias("curve"))


def residual_curves(light: DataFrame, by: list[str], width: int = 11) -> DataFrame:
    """``by, deficit, overflow``: positive and negative residuals summed over channels, smoothed."""
    a, m = F.col("actual").cast("array<double>"), F.col("model").cast("array<double>")
    d = summed_curve(light, by, F.zip_with(a, m, lambda x, y: F.greatest(x - y, F.lit(0.0)))).withColumnRenamed("curve", "_d")
    o = summed_curve(light, by, F.zip_with(a, m, lambda x, y: F.greatest(y - x, F.lit(0.0)))).withColumnRenamed("curve", "_o")
    return d.join(o, by).select(*by, moving_average(F.col("_d"), width).alias("deficit"), moving_average(F.col("_o"), width).alias("overflow"))


def seeds_from_residual(curves: DataFrame, by: list[str], search: int, most: int = 4, separation: int = 10, peak: int = PULSE_PEAK_TICK, curve: str = "deficit") -> DataFrame:
    """``by, t0``: peaks of the deficit above max(0.3 * maximum, mean + std), as times within 0..search."""
    c = F.col(curve)
    mean = asum(c) / F.size(c)
    std = F.sqrt(F.greatest(asum(F.transform(c, lambda v: v * v)) / F.size(c) - mean * mean, F.lit(0.0)))
    floor = F.greatest(0.3 * F.array_max(c), mean + std)
    peaks = curves.where(F.array_max(c) > 0).select(*by, F.explode(top_peaks(c, most, separation, floor)).alias("_p"))
    return peaks.select(*by, (F.col("_p") - peak).cast("double").alias("t0")).where(F.col("t0").between(0, search))


def signed_peaks(curves: DataFrame, by: list[str], most: int, separation: int, share: float) -> DataFrame:
    """``by, sign, tick``: separated peaks of deficit (+1) and overflow (-1) above ``share`` of their maximum."""
    parts = []
    for sign, name in ((1, "deficit"), (-1, "overflow")):
        c = F.col(name)
        parts.append(curves.where(F.array_max(c) > 0).select(*by, F.lit(sign).alias("sign"), F.explode(top_peaks(c, most, separation, share * F.array_max(c))).alias("tick")))
    return parts[0].unionByName(parts[1])


def residual_holes(light: DataFrame, candidates: DataFrame, by: list[str], least_missing: float = 0.5, half: int = 18, peak: int = PULSE_PEAK_TICK) -> DataFrame:
    """Candidates, but for the brightest of each TPC, whose peak misses ``least_missing`` of the data's light.

    Candidates that round to 0 are left out; repeated ones count once. The brightest is that with the
    most light at its peak (the earliest of equal ones). Order: missing share, missing light, TPC.
    """
    a = summed_curve(light, by, F.col("actual").cast("array<double>")).withColumnRenamed("curve", "_a")
    m = summed_curve(light, by, F.col("model").cast("array<double>")).withColumnRenamed("curve", "_m")
    c = candidates.select(*by, F.rint("t0").alias("t0")).where("t0 <> 0").distinct()
    j = c.join(a, by).join(m, by).withColumn("peak_tick", (F.col("t0") + peak).cast("int")).where((F.col("peak_tick") >= 0) & (F.col("peak_tick") < F.size("_a")))
    j = j.withColumn("peak_actual", F.get("_a", F.col("peak_tick"))).withColumn("peak_model", F.get("_m", F.col("peak_tick")))
    top = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("peak_actual"), "t0"))
    missing = F.greatest(F.col("peak_actual") - F.col("peak_model"), F.lit(0.0))
    j = j.withColumn("_top", top).withColumn("peak_missing", missing).withColumn("peak_missing_fraction", missing / F.greatest(F.col("peak_actual"), F.lit(1e-9)))
    lack = F.zip_with(_window(F.col("_a"), F.col("peak_tick"), half), _window(F.col("_m"), F.col("peak_tick"), half), lambda x, y: F.greatest(x - y, F.lit(0.0)))
    out = j.where((F.col("_top") > 1) & (F.col("peak_missing_fraction") >= least_missing))
    return out.select(*by, "t0", "peak_tick", "peak_actual", "peak_model", "peak_missing", "peak_missing_fraction", asum(_window(F.col("_a"), F.col("peak_tick"), half)).alias("window_actual"), asum(lack).alias("window_missing"))


def suspicious_clusters(clusters: DataFrame, least_hits: int = 8, least_energy: float = 1.0, linearity: float = 0.82, transverse: float = 4.0, margin: float = 0.10, gain: float = 0.0) -> DataFrame:
    """Clusters of enough hits and energy with the reasons that make them suspicious, as an array.

    ``clusters`` has n_hits, energy, linearity, transverse_rms, assigned, normalized_score, gain_per_mev.
    """
    reasons = F.array_compact(
        F.array(
            F.when(~F.coalesce("assigned", F.lit(False)), F.lit("unassigned")),
            F.when(F.col("linearity") < linearity, F.lit("low_linearity")),
            F.when(F.col("transverse_rms") > transverse, F.lit("wide_cluster")),
            F.when(~F.isnan("normalized_score") & (F.col("normalized_score") > margin), F.lit("weak_matrix_margin")),
            F.when(F.coalesce("gain_per_mev", F.lit(0.0)) <= gain, F.lit("weak_light_improvement")),
        )
    )
    return clusters.where((F.col("n_hits") >= least_hits) & (F.col("energy") >= least_energy)).withColumn("reasons", reasons).where(F.size("reasons") > 0)


def light_gate(trials: DataFrame, channel_drop: int = 8, dchi2: float = 500.0, per_mev: float = 10.0, veto_tpcs: int = 4) -> DataFrame:
    """``accepted`` for trial moves: enough overflow channels gone, chi2 gained and gained per MeV (all inclusive),
    and the donor no track over ``veto_tpcs`` TPCs unless ``forced``."""
    gate = (F.col("channels_before") - F.col("channels_after") >= channel_drop) & (F.col("dchi2") >= dchi2) & (F.col("dchi2") / F.greatest(F.col("energy"), F.lit(1e-9)) >= per_mev)
    veto = F.coalesce(F.col("track_like") & (F.col("n_tpcs") >= veto_tpcs), F.lit(False)) & ~F.coalesce(F.col("forced"), F.lit(False))
    return trials.withColumn("accepted", F.coalesce(gate & ~veto, F.lit(False)))


def force_override(limits: dict[str, float]) -> Column:
    """True where every named column reaches its limit."""
    ok = F.lit(True)
    for name, least in limits.items():
        ok = ok & (F.col(name) >= least)
    return F.coalesce(ok, F.lit(False))


def event_peak(light: DataFrame, by: list[str], samples: str = "samples") -> DataFrame:
    """``by, tick, channel, value``: the strongest sample of a group; of equal ones the lowest channel, then the earliest tick."""
    from tickloom.functions.arrays import peak_tick

    v = F.array_max(samples).cast("double")
    best = light.where(v.isNotNull()).groupBy(*by).agg(F.max(F.struct(v.alias("value"), (-F.col("channel")).alias("c"), (-peak_tick(F.col(samples))).alias("t"))).alias("_b"))
    return best.select(*by, (-F.col("_b.t")).cast("int").alias("tick"), (-F.col("_b.c")).alias("channel"), F.col("_b.value").alias("value"))


def add_images(base: DataFrame, images: DataFrame, by: list[str], clip: float = 60780.0) -> DataFrame:
    """``base`` (by, channel, samples) plus all shifted images (by, channel, samples, t0) of a place, clipped to 0..clip."""
    from tickloom.functions.arrays import shift_clamped

    moved = images.select(*by, "channel", F.posexplode(shift_clamped(F.col("samples"), F.col("t0"))).alias("tick", "v"))
    rows = base.select(*by, "channel", F.posexplode("samples").alias("tick", "v")).unionByName(moved)
    cells = rows.groupBy(*by, "channel", "tick").agg(F.greatest(F.lit(0.0), F.least(F.lit(clip), F.sum("v"))).alias("v"))
    return cells.groupBy(*by, "channel").agg(F.transform(F.sort_array(F.collect_list(F.struct("tick", "v"))), lambda s: s["v"]).alias("samples"))


def waveform_pairs(samples: DataFrame, template, by: list[str], clip: float = 60780.0) -> DataFrame:
    """(actual, predicted) pairs: the predicted peaks of a group's channels as pulses at the tick of its strongest sample.

    ``samples``: by, channel, samples, peak (the predicted height). ``template`` is an array column.
    """
    from tickloom.functions.arrays import expand_peak

    at = event_peak(samples, by).select(*by, F.col("tick").alias("_t"))
    return samples.join(at, by).select(*by, "channel", F.col("samples").alias("actual"), expand_peak(F.col("peak"), template, F.col("_t"), clip).alias("predicted"))
