"""Detector geometry: TPC numbering, channel maps and orders, dead channels, voxels, ticks."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values of the two detectors.
NS_PER_TICK = 16.0
SEED_OFFSET = 5.0
ADC_CLIP = 60780.0
BASELINE_SAMPLES = 75
PULSE_PEAK_TICK = 105


@dataclass(frozen=True)
class Detector:
    name: str
    tpcs: int
    channels: int
    search: int  # the last tick of a scan
    dbscan_eps: float
    dbscan_min: int
    mean_chi2: bool


ND = Detector("nd", 70, 120, 800, 4.0, 3, True)
TWO = Detector("2x2", 8, 48, 700, 2.5, 3, False)


def charge_tpc(io_group: Column, detector: Detector, strict: bool = False) -> Column:
    """TPC of an io group: pairs from 1 in ND, one each in 2x2. Below 1 it is NULL, or an error when ``strict``."""
    tpc = F.floor((io_group - 1) / 2).cast("int") if detector.name == "nd" else (io_group - 1).cast("int")
    bad = io_group <= 0
    if strict:
        return F.when(~bad, tpc).otherwise(F.when(bad, F.raise_error(F.lit("io_group below 1")).cast("int")))
    return F.when(~bad, tpc)


def light_to_charge_tpc(tpc: Column, detector: Detector) -> Column:
    """ND numbers the two TPCs of a module the other way round for light; 2x2 has one numbering."""
    return F.when(tpc % 2 == 0, tpc + 1).otherwise(tpc - 1) if detector.name == "nd" else tpc


def truth_to_ticks(t_us: Column, scale: float = 62.5, offset: float = 0.0) -> Column:
    return t_us * scale + offset


def flash_tick(range_ns: Column, detector: Detector) -> Column:
    """Tick of a flash: ND takes the middle of its time range, 2x2 the begin; NULL for no, empty or NaN ranges."""
    a, b = F.get(range_ns, F.lit(0)), F.get(range_ns, F.lit(1))
    t = (a + F.coalesce(b, a)) / 2 if detector.name == "nd" else a
    return F.when(~F.isnan(t), t / NS_PER_TICK - SEED_OFFSET)


# ---------------------------------------------------------------- channel maps
def invert_map(df: DataFrame, keys: list[str], values: list[str], order: str) -> DataFrame:
    """A lookup table seen from its values; of entries for one place the last by ``order`` stands. NULL values are misses."""
    hit = df.where(" AND ".join(f"{v} IS NOT NULL" for v in values))
    last = hit.groupBy(*values).agg(F.max_by(F.struct(*keys), order).alias("_k"))
    return last.select(*values, *[F.col(f"_k.{k}").alias(k) for k in keys])


def channel_order(channels: DataFrame, by: str = "tpc") -> DataFrame:
    """The channels of each TPC numbered from 0: side 0 from below, then side 1 from below."""
    w = Window.partitionBy(by).orderBy("side", "y_rel", "adc", "ch")
    ok = channels.where(F.col("side").isin(0, 1) & (F.col(by) >= 0))
    return ok.withColumn("channel", (F.row_number().over(w) - 1).cast("int"))


def interleaved_order(channels: DataFrame, rows: int, by: str = "tpc") -> DataFrame:
    """The older order: from above, left and right in turn."""
    w = Window.partitionBy(by).orderBy(F.lit(rows - 1) - F.col("y_rel"), "side")
    return channels.withColumn("channel", (F.row_number().over(w) - 1).cast("int"))


def parse_dead_channels(text: str | Iterable) -> list[tuple[int, int]]:
    """Dead (adc, ch) pairs from YAML-like text, a list of pairs, a map adc -> channels, or "a,c" strings."""
    if isinstance(text, dict):
        return sorted({(int(a), int(c)) for a, cs in text.items() for c in (cs if isinstance(cs, (list, tuple)) else [cs])})
    if not isinstance(text, str):
        out = set()
        for item in text:
            pair = item.split(",") if isinstance(item, str) else item
            a, c = (int(x) for x in pair)
            out.add((a, c))
        return sorted(out)
    out, adc = set(), None
    for line in text.splitlines():
        line = line.split("#")[0]
        head = re.match(r"\s*(\d+)\s*:\s*(?:\[(.*)\])?\s*$", line)
        pair = re.search(r"(\d+)\s*,\s*(\d+)", line)
        item = re.match(r"\s*-\s*(\d+)\s*$", line)
        if head:
            adc = int(head[1])
            out |= {(adc, int(x)) for x in re.findall(r"\d+", head[2] or "")}
        elif pair:
            out.add((int(pair[1]), int(pair[2])))
        elif item and adc is not None:
            out.add((adc, int(item[1])))
    return sorted(out)


def dead_channels(spark: SparkSession, pairs: list[tuple[int, int]]) -> DataFrame:
    return spark.createDataFrame(pairs, "adc int, ch int").distinct()


def dead_mask(channels: DataFrame, dead: DataFrame) -> DataFrame:
    """Channels with ``dead``: true where the (adc, ch) is in the dead set. NULL never is."""
    marks = dead.select("adc", "ch").distinct().withColumn("dead", F.lit(True))
    return channels.join(marks, ["adc", "ch"], "left").withColumn("dead", F.coalesce("dead", F.lit(False)))


# ---------------------------------------------------------------- voxels
def voxel(c: Column, low: float, high: float, n: int) -> Column:
    """Bin of a coordinate among ``n`` equal ones, clipped to the ends; NULL for NULL and NaN."""
    return F.when(~F.isnan(c), F.least(F.greatest(F.floor((c - low) * (n / (high - low))), F.lit(0)), F.lit(n - 1)).cast("int"))


def voxelize(hits: DataFrame, by: list[str], box: dict[str, tuple[float, float, int]], energy: str = "e") -> DataFrame:
    """``by, vox, energy``: summed energy of each occupied voxel, numbered with the last axis fastest."""
    index = F.lit(0)
    for axis, (low, high, n) in box.items():
        index = index * n + voxel(F.col(axis), low, high, n)
    return hits.withColumn("vox", index).where("vox IS NOT NULL").groupBy(*by, "vox").agg(F.sum(energy).alias("energy"))


def first_seen_rank(df: DataFrame, keys: list[str], position: str, name: str = "group_no") -> DataFrame:
    """Groups numbered from 0 by the first position at which they appear."""
    first = df.groupBy(*keys).agg(F.min(position).alias("_p"))
    ranked = first.withColumn(name, (F.dense_rank().over(Window.orderBy("_p")) - 1).cast("int")).drop("_p")
    return df.join(ranked, keys)


# ---------------------------------------------------------------- light in channel order
def formatted_light(waveforms: DataFrame, channels: DataFrame, by: list[str], dead: DataFrame | None = None, head: int = BASELINE_SAMPLES) -> DataFrame:
    """``by, tpc, channel, samples``: baseline-subtracted waveforms at their place in the TPC's channel order.

    ``channels`` has adc, ch, tpc, channel; waveforms of channels without a place drop out. Dead
    channels are all zero.
    """
    from tickloom.functions.arrays import baseline_subtracted

    j = waveforms.select(*by, "adc", "ch", "samples").join(channels.select("adc", "ch", "tpc", "channel"), ["adc", "ch"])
    s = baseline_subtracted(F.col("samples"), head)
    if dead is None:
        return j.select(*by, "tpc", "channel", s.alias("samples"))
    j = dead_mask(j, dead)
    return j.select(*by, "tpc", "channel", F.when(F.col("dead"), F.transform(s, lambda _: F.lit(0.0))).otherwise(s).alias("samples"))


def fill_channels(patch: DataFrame, channels: DataFrame, by: list[str], ticks: int, baseline: float = 0.0) -> DataFrame:
    """``patch`` (by, tpc, channel, samples) for every channel of every group in it; those it lacks hold the baseline."""
    keys = list(dict.fromkeys([*by, "tpc", "channel"]))
    # the TPC belongs to the group, so a group meets the channels of its own TPC only
    every = patch.select(*dict.fromkeys([*by, "tpc"])).distinct().join(channels.select("tpc", "channel").distinct(), "tpc")
    return every.join(patch.select(*keys, "samples"), keys, "left").withColumn("samples", F.coalesce(F.col("samples").cast("array<double>"), F.array_repeat(F.lit(baseline), ticks)))
