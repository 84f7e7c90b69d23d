"""Scans of a predicted waveform over time shifts: numpy kernels, and their grouped Spark forms."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shifted(p: np.ndarray, s: float) -> np.ndarray:
    """Last axis moved later by ``s`` ticks, zeros outside; fractions are interpolated."""
    k = int(np.floor(s))
    out = np.zeros(p.shape, dtype=float)
    n = p.shape[-1]
    for step, w in ((k, 1 - (s - k)), (k + 1, s - k)):
        if w == 0 or abs(step) >= n:
            continue
        if step >= 0:
            out[..., step:] += w * p[..., : n - step]
        else:
            out[..., :step] += w * p[..., -step:]
    return out


def interpolated(p: np.ndarray, s: float, baseline: float = 0.0) -> np.ndarray:
    """As ``shifted``, but ticks without both neighbours get the baseline, so the last sample is lost."""
    n = p.shape[-1]
    src = np.arange(n) - s
    lo = np.floor(src).astype(int)
    ok = (lo >= 0) & (lo + 1 < n)
    out = np.full(p.shape, baseline, dtype=float)
    w = (src - lo)[ok]
    out[..., ok] = p[..., lo[ok]] * (1 - w) + p[..., lo[ok] + 1] * w
    return out


def unit_scan(p: np.ndarray, base: np.ndarray, actual: np.ndarray, search: int) -> np.ndarray:
    """Mean squared residual for shifts 0..search without clip, by prefix sums and one FFT correlation.

    err(s) = [sum r^2 + sum over t < T - s of p_t^2 - 2 corr(s)] / (C T) with r = actual - base.
    """
    c, n = p.shape
    r = actual - base
    m = 1 << (2 * n - 1).bit_length()
    corr = np.fft.irfft((np.fft.rfft(r, m) * np.conj(np.fft.rfft(p, m))).sum(0), m)
    smax = min(search, n - 1)
    own = np.concatenate([[0.0], np.cumsum((p * p).sum(0))])
    s = np.arange(smax + 1)
    return ((r * r).sum() + own[n - s] - 2 * corr[: smax + 1]) / (c * n)


def clipped_scan(p: np.ndarray, base: np.ndarray, actual: np.ndarray, var: np.ndarray, search: int, clip: float = 60780.0, mean: bool = False) -> np.ndarray:
    """Chi2 of min(base + p shifted, clip) for shifts 0..search; the sum over all cells or their mean.

    Before a shift only the base stands, so those cells come from a prefix sum.
    """
    c, n = p.shape
    w = 1 / np.maximum(var, 1e-6)
    still = (w * (np.minimum(base, clip) - actual) ** 2).sum(0)
    before = np.concatenate([[0.0], np.cumsum(still)])
    out = np.empty(min(search, n - 1) + 1)
    for s in range(len(out)):
        d = np.minimum(base[:, s:] + p[:, : n - s], clip) - actual[:, s:]
        out[s] = before[s] + (w[:, s:] * d * d).sum()
    return out / (c * n) if mean else out


def cosine_scan(p: np.ndarray, base: np.ndarray, actual: np.ndarray, var: np.ndarray, search: int) -> np.ndarray:
    """Whitened cosine between the shifted image and the positive residual, for shifts 0..search."""
    n = p.shape[1]
    w = 1 / np.maximum(var, 1e-6)
    r = np.maximum(actual - base, 0)
    bb = (w * r * r).sum()
    m = 1 << (2 * n - 1).bit_length()
    smax = min(search, n - 1)
    ab = np.fft.irfft((np.fft.rfft(w * r, m) * np.conj(np.fft.rfft(p, m))).sum(0), m)[: smax + 1]
    aa = np.fft.irfft((np.fft.rfft(w, m) * np.conj(np.fft.rfft(p * p, m))).sum(0), m)[: smax + 1]
    good = (aa > 1e-9) & (bb > 0)
    return np.where(good, ab / np.sqrt(np.where(good, aa * bb, 1)), 0.0)


def cosine_at(p: np.ndarray, base: np.ndarray, actual: np.ndarray, var: np.ndarray, t0: float) -> float:
    w = 1 / np.maximum(var, 1e-6)
    a, r = shifted(p, t0), np.maximum(actual - base, 0)
    aa, bb = (w * a * a).sum(), (w * r * r).sum()
    return float((w * a * r).sum() / np.sqrt(aa * bb)) if aa > 0 and bb > 0 else 0.0


def chi2_at(p: np.ndarray, base: np.ndarray, actual: np.ndarray, var: np.ndarray, t0: float, clip: float = 60780.0, mean: bool = False) -> float:
    d = np.minimum(base + shifted(p, t0), clip) - actual
    v = d * d / np.maximum(var, 1e-6)
    return float(v.mean() if mean else v.sum())


def best_of(p, base, actual, var, candidates, clip: float = 60780.0, mean: bool = False) -> tuple[float, float]:
    """The candidate of smallest chi2 (the first of equal ones), and its chi2."""
    scores = [chi2_at(p, base, actual, var, t, clip, mean) for t in candidates]
    k = int(np.argmin(scores))
    return float(candidates[k]), scores[k]


def refine_subtick(p, base, actual, var, t0: float, reach: float = 0.8, step: float = 0.05, clip: float = 60780.0) -> float:
    """The best offset on a grid around ``t0``; only a strict improvement moves it."""
    best, at = chi2_at(p, base, actual, var, t0, clip), t0
    for d in np.arange(-round(reach / step), round(reach / step) + 1) * step:
        s = chi2_at(p, base, actual, var, t0 + d, clip)
        if s < best:
            best, at = s, t0 + d
    return float(at)


def snap(actual, base, t0: float, back: int, ahead: int, peak: int, highest: float) -> float:
    """``t0`` moved to the strongest summed positive residual from ``back`` before to ``ahead`` after its expected peak (the first of equal ones)."""
    curve = np.maximum(actual - base, 0).sum(0)
    want = int(np.floor(t0 + peak + 0.5))
    lo, hi = max(0, want - back), min(len(curve), want + ahead + 1)
    if hi <= lo or curve[lo:hi].max() <= 0:
        return t0
    return float(np.clip(lo + int(np.argmax(curve[lo:hi])) - peak, 0, highest))


def smooth(a: np.ndarray, width: int) -> np.ndarray:
    """Centred mean along the last axis, zeros beyond the ends."""
    k = np.ones(width) / width
    return np.apply_along_axis(lambda v: np.convolve(v, k, mode="same"), -1, a)


# ---------------------------------------------------------------- Spark forms
def matrix(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Equally long arrays of a column as the rows of a matrix, without Python objects in between."""
    a = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return a.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(a), -1)


def scan_groups(images: DataFrame, by: list[str], kernel: Callable[..., np.ndarray], search: int, lowest: bool = True) -> DataFrame:
    """``by, t0, score`` of the best shift per group of channel rows with arrays predicted, base, actual, variance.

    A group is the channels of one (cluster, TPC) or one track, bounded by the detector's channels;
    the first of equally good shifts is taken. Arrays of one group are equally long.
    """
    arrays = ["predicted", "base", "actual", "variance"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in images.select(*by).schema.fields)

    def run(t: pa.Table) -> pa.Table:
        p, b, a, v = (matrix(t[c]) for c in arrays)
        curve = kernel(p, b, a, v, search)
        k = int(curve.argmin() if lowest else curve.argmax())
        return pa.table({**{c: t[c].slice(0, 1) for c in by}, "t0": pa.array([k], pa.int32()), "score": pa.array([float(curve[k])])})

    return images.groupBy(*by).applyInArrow(run, f"{kinds}, t0 int, score double")


def scan_unit(images: DataFrame, by: list[str], search: int) -> DataFrame:
    return scan_groups(images, by, lambda p, b, a, v, s: unit_scan(p, b, a, s), search)


def scan_chi2(images: DataFrame, by: list[str], search: int, mean: bool = False) -> DataFrame:
    return scan_groups(images, by, lambda p, b, a, v, s: clipped_scan(p, b, a, v, s, mean=mean), search)


def scan_smoothed(images: DataFrame, by: list[str], search: int, width: int = 5) -> DataFrame:
    return scan_groups(images, by, lambda p, b, a, v, s: clipped_scan(smooth(p, width), smooth(b, width), smooth(a, width), v, s, mean=True), search)


def scan_cosine(images: DataFrame, by: list[str], search: int) -> DataFrame:
    return scan_groups(images, by, cosine_scan, search, lowest=False)


def loss_matrix(images: DataFrame, candidates: DataFrame, by: list[str], cluster: str, mean: bool = True, clip: float = 60780.0, support: DataFrame | None = None, channel: str = "channel") -> DataFrame:
    """``by, cluster, t0, loss``: each cluster at each candidate of its group, all channels or only supported ones.

    Candidates meet the channel rows of their own group by an equi-join; losses of channels add up.
    """
    rows = images if support is None else images.join(support.select(*by, cluster, channel).distinct(), [*by, cluster, channel], "left_semi")
    pairs = rows.join(candidates.select(*by, "t0").distinct(), by)
    kinds = {f.name: f.dataType.simpleString() for f in pairs.select(*by, cluster, "t0").schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t0 = batch.column("t0").to_pylist()
            cols = [matrix(batch.column(c)) for c in ("predicted", "base", "actual", "variance")] if t0 else []
            loss, n = [], []
            for t, *arr in zip(t0, *cols):
                p, b, a, v = (x[None] for x in arr)
                loss.append(chi2_at(p, b, a, v, float(t), clip))
                n.append(p.shape[1])
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in kinds], pa.array(loss, pa.float64()), pa.array(n, pa.int64())], names=[*kinds, "_l", "_n"])

    per = pairs.mapInArrow(run, ", ".join(f"{k} {v}" for k, v in kinds.items()) + ", _l double, _n long")
    total = F.sum("_l") / F.sum("_n") if mean else F.sum("_l")
    return per.groupBy(*by, cluster, "t0").agg(total.alias("loss"))


def best_cells(matrix: DataFrame, by: list[str], cluster: str) -> DataFrame:
    """The candidate of smallest loss of each cluster (the earliest of equal ones)."""
    return matrix.groupBy(*by, cluster).agg(F.min(F.struct("loss", "t0")).alias("_m")).select(*by, cluster, F.col("_m.t0").alias("t0"), F.col("_m.loss").alias("loss"))
