"""Light models: the interface that stages predict images through, a deterministic stub, and its Spark forms."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.scans import matrix


class LightModel(Protocol):
    channels: int
    ticks: int

    def image(self, x: np.ndarray, y: np.ndarray, z: np.ndarray, e: np.ndarray, tpc: int) -> np.ndarray:
        """Predicted waveforms (channels, ticks) of hits of one TPC that came at t0 = 0."""


def template(ticks: int, peak: int, tau: float = 12.0) -> np.ndarray:
    t = np.arange(ticks) - peak
    return np.where(t >= 0, np.exp(-np.maximum(t, 0) / tau), np.clip((t + 3) / 3, 0, None))


def postprocess(amplitude: np.ndarray, scale: float = 1.0, clip: float = 60780.0, threshold: float = 100.0) -> np.ndarray:
    """Scaled, clipped to 0..clip, values under the threshold set to 0."""
    a = np.clip(amplitude * scale, 0, clip)
    return np.where(a < threshold, 0.0, a)


class LinearLight:
    """A stub without weights: light proportional to energy, shared by channels by the distance along y and z."""

    def __init__(self, channels: int, ticks: int, peak: int, gain: float = 60.0, reach: float = 150.0, threshold: float = 0.0):
        self.channels, self.ticks, self.peak, self.gain, self.reach, self.threshold = channels, ticks, peak, gain, reach, threshold
        self.pulse = template(ticks, peak)

    def per_hit(self, x, y, z, e) -> np.ndarray:
        """Light of each hit in each channel."""
        n = self.channels
        cy = np.linspace(-60, 60, max(1, (n + 1) // 2))[np.arange(n) % max(1, (n + 1) // 2)]
        side = np.where(np.arange(n) < (n + 1) // 2, -1.0, 1.0)
        d = (y[:, None] - cy) ** 2 + (np.tanh(z / 500.0)[:, None] * 30 - side * 30) ** 2
        return np.clip(e, 0, None)[:, None] * np.exp(-d / self.reach**2)

    def image_of(self, light: np.ndarray) -> np.ndarray:
        """The image of hits by their ``per_hit``."""
        return postprocess(light.sum(0) * self.gain, threshold=self.threshold)[:, None] * self.pulse

    def image(self, x, y, z, e, tpc: int) -> np.ndarray:
        return self.image_of(self.per_hit(x, y, z, e))


class RestrictedLight:
    """A model whose light outside a cluster's widened support is set to zero; clusters without support are kept whole."""

    def __init__(self, model: LightModel, share: float = 0.9, group: int = 6):
        self.model, self.share, self.group, self.channels, self.ticks = model, share, group, model.channels, model.ticks

    def image(self, x, y, z, e, tpc: int) -> np.ndarray:
        img = self.model.image(x, y, z, e, tpc)
        light = np.clip(img, 0, None).sum(1)
        if light.sum() <= 0:
            return img
        order = np.argsort(-light, kind="stable")
        n = int(np.searchsorted(np.cumsum(light[order]), self.share * light.sum())) + 1
        groups = order[:n] // self.group
        lo, hi = (groups.min() - 1) * self.group, (groups.max() + 2) * self.group
        at = np.arange(len(img))
        return np.where(((at >= lo) & (at < hi))[:, None], img, 0.0)


def predict_images(hits: DataFrame, by: list[str], make: Callable[[], LightModel], tpc: str = "tpc") -> DataFrame:
    """``by, tpc, channel, samples`` for each cluster and TPC (``by`` holds the cluster).

    The model is made once per Python worker process and task; a group is one cluster in one TPC.
    """
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in hits.select(*by, tpc).schema.fields)

    def run(t: pa.Table) -> pa.Table:
        model = make()
        x, y, z, e = (t[c].to_numpy().astype(float) for c in ("x", "y", "z", "e"))
        img = model.image(x, y, z, e, int(t[tpc][0].as_py()))
        n = len(img)
        cols = {c: pa.array([t[c][0].as_py()] * n, t[c].type) for c in [*by, tpc]}
        return pa.table({**cols, "channel": pa.array(range(n), pa.int32()), "samples": pa.array(img.tolist(), pa.list_(pa.float64()))})

    need = list(dict.fromkeys([*by, tpc, "x", "y", "z", "e"]))
    return hits.select(*need).groupBy(*by, tpc).applyInArrow(run, f"{kinds}, channel int, samples array<double>")


def predict_batches(samples: DataFrame, column: str, make: Callable[[], Callable[[np.ndarray], np.ndarray]], out: str) -> DataFrame:
    """An array column through a batch function (a network, a variance model): row order and rows are kept, no shuffle."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in samples.schema.fields)
    names = samples.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            got = f(matrix(b.column(names.index(column)))) if b.num_rows else np.zeros((0, 0))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([list(map(float, r)) for r in got], pa.list_(pa.float64()))], names=[*names, out])

    return samples.mapInArrow(run, f"{kinds}, `{out}` array<double>")


def with_unit_variance(light: DataFrame) -> DataFrame:
    """The fallback where there is no variance model: 1 everywhere."""
    return light.withColumn("variance", F.transform("samples", lambda _: F.lit(1.0)))


def overlay_samples(samples: DataFrame, by: list[str], sources: int, ticks: int, seed: int, clip: float = 60780.0, most_shift: int = 200) -> DataFrame:
    """Multi-pulse training samples: within each group, rows in a random order are taken ``sources`` at a time, shifted and summed.

    Draws and shifts follow from the row's id and the seed alone. Each row serves once; a rest of
    fewer than two rows makes no sample.
    """
    from tickloom.functions.arrays import shift_whole
    from tickloom.operators.skew import sliced_rank

    r = samples.withColumn("_o", F.xxhash64("sample_id", F.lit(seed)))
    r = sliced_rank(r, by, ["_o", "sample_id"], name="_k").withColumn("set_no", F.floor(F.col("_k") / sources))
    r = r.withColumn("shift", F.pmod(F.xxhash64("sample_id", F.lit(seed + 1)), F.lit(most_shift)).cast("int"))
    one = r.select(*by, "set_no", "sample_id", "shift", F.posexplode(shift_whole(F.col("samples"), F.col("shift"))).alias("tick", "v"))
    curve = one.groupBy(*by, "set_no", "tick").agg(F.least(F.sum("v"), F.lit(clip)).alias("v"))
    arrays = curve.groupBy(*by, "set_no").agg(F.transform(F.sort_array(F.collect_list(F.struct("tick", "v"))), lambda s: s["v"]).alias("samples"))
    src = r.groupBy(*by, "set_no").agg(F.count(F.lit(1)).cast("smallint").alias("source_count"), F.sort_array(F.collect_list(F.struct("sample_id", "shift"))).alias("sources"))
    return arrays.join(src.where("source_count >= 2"), [*by, "set_no"])


def evenly_ranked(samples: DataFrame, value: str, key: str, n: int) -> DataFrame:
    """``n`` rows at evenly spaced ranks of ``value`` (ties by key), first and last included."""
    from tickloom.operators.metrics import cumulative

    ranked = cumulative(samples.select(F.struct(value, key).alias("_s"), F.col(value).cast("double").alias("_x"), F.lit(1.0).alias("_w")), [], "_x", "_w")
    at = samples.join(F.broadcast(ranked.agg(F.max("total").alias("_n"))), how="cross")  # one row
    before = ranked.select(F.col("x").alias("_x"), (F.col("cum") - F.col("w")).alias("_before"))
    from pyspark.sql import Window

    pos = at.withColumn("_x", F.col(value).cast("double")).join(before, "_x")
    pos = pos.withColumn("_r", F.col("_before") + F.row_number().over(Window.partitionBy("_x").orderBy(key)) - 1)
    want = samples.sparkSession.range(n).crossJoin(F.broadcast(ranked.agg(F.max("total").alias("_n")))).select(F.floor(F.col("id") * (F.col("_n") - 1) / max(n - 1, 1)).cast("double").alias("_r")).distinct()
    return pos.join(F.broadcast(want), "_r", "left_semi").select(*samples.columns)
