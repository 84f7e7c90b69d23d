"""Waveform algebra on array columns: baselines, shifts, templates, losses.

These are built-in higher-order functions and stay in the JVM; scans over many shifts are in
``tickloom.functions.scans``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f) -> Column:
    """``f(value)`` with ``value`` evaluated once: inside a lambda an outer expression is evaluated for every element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def asum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))


def amean(a: Column) -> Column:
    """NULL for an empty array."""
    return asum(a) / F.nullif(F.size(a), F.lit(0))


def avar(a: Column) -> Column:
    """Population variance; NULL for an empty array."""
    return let(amean(a), lambda m: F.greatest(amean(F.transform(a, lambda v: v * v)) - m * m, F.lit(0.0)))


def baseline_subtracted(samples: Column, head: int = 75) -> Column:
    """Samples less the mean of the first ``head`` (of all, when there are fewer)."""
    s = samples.cast("array<double>")
    return let(amean(F.slice(s, 1, head)), lambda b: F.transform(s, lambda v: v - b))


def noise_variance(samples: Column, dead: Column, head: int = 75, rel_sigma: float = 0.10, floor: float = 2500.0, dead_variance: float = 1e12) -> Column:
    """Per tick max(variance of the head, floor) + (rel_sigma * max(v, 0))^2; huge throughout dead channels."""
    s = samples.cast("array<double>")
    alive = let(F.greatest(avar(F.slice(s, 1, head)), F.lit(floor)), lambda base: F.transform(s, lambda v: base + F.pow(rel_sigma * F.greatest(v, F.lit(0.0)), 2)))
    return F.when(F.coalesce(dead, F.lit(False)), F.transform(s, lambda _: F.lit(dead_variance))).otherwise(alive)


def shift_interpolated(samples: Column, shift: Column, baseline: float = 0.0) -> Column:
    """Shift to later ticks by a fraction, linearly interpolated; a tick needs both its neighbours.

    So the last sample becomes the baseline even for a shift of 0.
    """
    def run(s: Column) -> Column:
        def at(_: Column, j: Column) -> Column:
            src = j - shift
            lo = F.floor(src).cast("int")
            w = src - lo
            return F.when((lo >= 0) & (lo + 1 < F.size(s)), F.get(s, lo) * (1 - w) + F.get(s, lo + 1) * w).otherwise(F.lit(baseline))

        return F.transform(s, at)

    return let(samples.cast("array<double>"), run)


def shift_clamped(samples: Column, shift: Column) -> Column:
    """Shift by a fraction with zeros outside; the last sample is kept."""
    def run(s: Column) -> Column:
        def at(_: Column, j: Column) -> Column:
            src = j - shift
            lo = F.floor(src).cast("int")
            w = src - lo
            inside = (src >= 0) & (src <= F.size(s) - 1)
            return F.when(inside, F.get(s, lo) * (1 - w) + F.coalesce(F.get(s, lo + 1), F.lit(0.0)) * w).otherwise(F.lit(0.0))

        return F.transform(s, at)

    return let(samples.cast("array<double>"), run)


def shift_whole(samples: Column, ticks: Column) -> Column:
    """Shift by whole ticks (later when positive), zeros moved in."""
    return let(
        F.struct(samples.cast("array<double>").alias("s"), ticks.cast("int").alias("k")), lambda b: F.transform(b["s"], lambda _, j: F.coalesce(F.get(b["s"], j - b["k"]), F.lit(0.0)))
    )


def pulse(amplitude: Column, template: Column) -> Column:
    """The template scaled so that its largest value is ``amplitude``."""
    return let(template, lambda t: let(amplitude / F.array_max(t), lambda k: F.transform(t, lambda v: k * v)))


def double_exponential(amplitude: Column, t0: Column, ticks: int, fast: float, slow: float) -> Column:
    """amplitude * (0.7 exp(-t/fast) + 0.3 exp(-t/slow)) from ``t0`` on, 0 before."""
    def at(j: Column) -> Column:
        t = j - t0
        return F.when(t >= 0, amplitude * (0.7 * F.exp(-t / fast) + 0.3 * F.exp(-t / slow))).otherwise(F.lit(0.0))

    return F.transform(F.sequence(F.lit(0), F.lit(ticks - 1)), at)


def default_template(ticks: int, peak_tick: int, tau: float) -> Column:
    """A linear rise over three ticks to 1 at ``peak_tick``, then exp(-(t - peak) / tau)."""
    def at(j: Column) -> Column:
        d = j - peak_tick
        return F.when(d >= 0, F.exp(-d / F.lit(tau))).when(d > -3, (d + 3) / F.lit(3.0)).otherwise(F.lit(0.0))

    return F.transform(F.sequence(F.lit(0), F.lit(ticks - 1)), at)


def expand_peak(peak: Column, template: Column, peak_tick: Column, clip: float = 60780.0) -> Column:
    """A pulse of height ``peak`` with its maximum at ``peak_tick``, clipped to 0..clip."""
    def run(t: Column) -> Column:
        top = F.array_position(t, F.array_max(t)) - 1
        return F.transform(shift_whole(pulse(peak, t), peak_tick - top), lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(clip)))

    return let(template, run)


def zip_sum(a: Column, b: Column, f) -> Column:
    return asum(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), f))


def chi2_mean(model: Column, actual: Column, error: Column) -> Column:
    """Mean of (m - a)^2 / max(error, 1e-6)."""
    r = F.zip_with(model, actual, lambda m, a: (m - a) * (m - a))
    return zip_sum(r, error, lambda d, e: d / F.greatest(e, F.lit(1e-6))) / F.size(model)


def chi2_sum(model: Column, actual: Column, variance: Column, clip: float = 60780.0) -> Column:
    """Sum of (min(m, clip) - a)^2 / max(variance, 1e-6)."""
    r = F.zip_with(model, actual, lambda m, a: F.pow(F.least(m, F.lit(clip)) - a, 2))
    return zip_sum(r, variance, lambda d, e: d / F.greatest(e, F.lit(1e-6)))


def overflow_weighted_loss(model: Column, actual: Column, error: Column, weight: float) -> Column:
    """Sum of squared residuals over error, those of the model above the data times ``weight``."""
    r = F.zip_with(model, actual, lambda m, a: F.pow(m - a, 2) * F.when(m > a, F.lit(weight)).otherwise(F.lit(1.0)))
    return zip_sum(r, error, lambda d, e: d / F.greatest(e, F.lit(1e-6)))


def matched_filter(image: Column, base: Column, actual: Column, variance: Column) -> Column:
    """Cosine between image and positive residual, both divided by the noise; 0 when either vanishes."""
    w = F.transform(variance, lambda v: 1 / F.greatest(v, F.lit(1e-6)))
    res = F.zip_with(actual, base, lambda a, b: F.greatest(a - b, F.lit(0.0)))
    ab = zip_sum(F.zip_with(image, res, lambda x, y: x * y), w, lambda x, y: x * y)
    aa = zip_sum(F.transform(image, lambda x: x * x), w, lambda x, y: x * y)
    bb = zip_sum(F.transform(res, lambda x: x * x), w, lambda x, y: x * y)
    return F.when((aa > 0) & (bb > 0), ab / F.sqrt(aa * bb)).otherwise(F.lit(0.0))


def saturated(samples: Column, threshold: float = 60700.0, most: int = 6) -> Column:
    """More than ``most`` ticks above ``threshold``. NULL samples are not saturated."""
    return F.coalesce(F.size(F.filter(samples, lambda x: x > threshold)) > most, F.lit(False))


def peak_tick(samples: Column) -> Column:
    """Position of the largest sample, the first of equal ones; NULL for an empty array."""
    return F.nullif(F.array_position(samples, F.array_max(samples)) - 1, F.lit(-1))


def peak_in(samples: Column, low: Column, high: Column) -> Column:
    """Position of the first maximum within [low, high], both ends in."""
    picked = F.filter(F.transform(samples, lambda v, i: F.struct(v.cast("double").alias("v"), (-i).alias("i"))), lambda s: (-s["i"] >= low) & (-s["i"] <= high))
    return -F.array_max(picked)["i"]


def snap_backward(signal: Column, t0: Column, back: int, peak: int) -> Column:
    """``t0`` moved back to where the signal is highest within ``back`` ticks before its expected peak."""
    want = F.floor(t0 + peak + 0.5)
    return F.coalesce(peak_in(signal, F.greatest(want - back, F.lit(0)), want) - peak, t0)


def snap_both(signal: Column, t0: Column, around: int, peak: int, highest: float) -> Column:
    """``t0`` moved to the highest signal within ``around`` ticks of its expected peak, clipped to 0..highest."""
    want = F.floor(t0 + peak + 0.5)
    return F.greatest(F.lit(0.0), F.least(F.lit(highest), F.coalesce(peak_in(signal, F.greatest(want - around, F.lit(0)), want + around) - peak, t0)))


def brightness_at(signal: Column, t0: Column, window: int, peak: int) -> Column:
    """Largest signal within ``window`` ticks of the expected peak."""
    want = F.floor(t0 + peak + 0.5)
    inside = F.filter(F.transform(signal, lambda v, i: F.when(F.abs(i - want) <= window, v)), lambda v: v.isNotNull())
    return F.array_max(inside)
