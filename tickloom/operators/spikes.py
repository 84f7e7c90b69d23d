"""Implausible readings: spikes, stuck values and impossible values, relative to each source's normal.

One pass over the waveforms reduces each to a few numbers (range, quartiles of its steps, lowest stuck
level, height of the sharpest short excursion). Quantile sketches of the quartiles, per source and hour
of the day and merged over partitions, say how a source normally moves at that hour; hours with few
waveforms take the sketch of the whole source. A row is faulty when it leaves the expanded
interquartile fence of its source and comes back within a few ticks, or does not move at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.skew import broadcast_if_small, kept


@dataclass(frozen=True)
class SpikeRules:
    lowest: float = 0.0
    highest: float = 65535.0
    #: a run of so many ticks that differ by at most ``stuck_counts`` is stuck
    stuck_ticks: int = 16
    stuck_counts: float = 1.0
    #: an excursion of at most ``spike_ticks`` ticks is a spike beyond ``spike_noise`` times the noise
    spike_ticks: int = 3
    spike_noise: float = 15.0
    #: ticks before and after the excursion that must be alike, and how alike, in shares of its height
    shoulder: int = 3
    alike: float = 0.5
    #: quantile of the waveforms' own quartiles that stands for the source (pulses widen the other half)
    quiet_quantile: float = 0.4
    #: an hour of a source has fences of its own from so many waveforms on
    least_context: int = 50
    #: levels from this share of the rail on are readings held at the rail
    rail_share: float = 0.999
    setting_share: float = 0.01
    least_rows: int = 3
    #: a channel marked dead whose typical noise is at least this share of its normal is alive
    living_share: float = 0.25


#: steps between two readings spread by the square root of 2 more than the readings; quartiles lie 1.349 deviations apart
STEP_IQR = 1.349 * 2**0.5


def _rolling(a: np.ndarray, n: int, f) -> np.ndarray:
    """f over each window of n columns, by doubling."""
    out, have = a, 1
    while have < n:
        step = min(have, n - have)
        out, have = f(out[:, : out.shape[1] - step], out[:, step:]), have + step
    return out


def waveform_features(s: np.ndarray, rules: SpikeRules) -> tuple[np.ndarray, ...]:
    """Range, quartiles of steps (two), stuck level, spike height of equally long waveforms; NaN where there is none.

    ``s`` is rows by ticks; a tick that is no finite number is NaN. Quartiles are those of the
    tick-to-tick steps of waveforms that vary by more than the stuck counts, at least 0.3 deviations
    apart. An excursion's height is how far it leads out of the corridor of the ticks around it;
    it may swing to both sides, and is negative when it leads farther down than up.
    """
    n, ticks = s.shape
    nan = np.full(n, np.nan)
    with np.errstate(invalid="ignore", all="ignore"):
        lo, hi = np.where(np.isnan(s), np.inf, s), np.where(np.isnan(s), -np.inf, s)
        spread = hi.max(1) - lo.min(1)
        spread = np.where(np.isfinite(spread), spread, np.nan)
        low, high, stuck, spike = nan.copy(), nan.copy(), nan.copy(), nan.copy()
        if ticks >= 8:
            d = np.sort(np.diff(s, axis=1), axis=1)  # NaN last
            m = (ticks - 1) - np.isnan(d).sum(1)
            q1, q3 = d[np.arange(n), (m * 0.25).astype(int)], d[np.arange(n), np.minimum((m * 0.75).astype(int), np.maximum(m - 1, 0))]
            narrow = np.maximum(0.3 * STEP_IQR - (q3 - q1), 0) / 2
            moves = (m >= 7) & (spread > rules.stuck_counts)
            low, high = np.where(moves, q1 - narrow, np.nan), np.where(moves, q3 + narrow, np.nan)
        if ticks >= rules.stuck_ticks:
            top, bottom = _rolling(s, rules.stuck_ticks, np.maximum), _rolling(s, rules.stuck_ticks, np.minimum)
            level = np.where(top - bottom <= rules.stuck_counts, top, np.inf).min(1)
            stuck = np.where(np.isfinite(level), level, np.nan)
        best = np.zeros(n)
        k = rules.shoulder
        for w in range(1, rules.spike_ticks + 1):
            c = ticks - w - 1  # excursions begin at ticks 1..c
            if c < 1:
                break
            # shoulders: up to k ticks before and after, fewer at the ends
            pad = np.full((n, k - 1), np.nan)
            before = np.hstack([pad, s[:, :c]])
            after = np.hstack([s[:, w + 1 :], pad])
            b_hi, b_lo = _rolling(before, k, np.fmax), _rolling(before, k, np.fmin)
            a_hi, a_lo = _rolling(after, k, np.fmax), _rolling(after, k, np.fmin)
            ceiling, floor = np.maximum(b_hi, a_hi), np.minimum(b_lo, a_lo)
            # how far each tick of the excursion lies above the corridor, or below it
            ticks_in = [s[:, 1 + j : 1 + j + c] for j in range(w)]
            up = [x - ceiling for x in ticks_in]
            down = [floor - x for x in ticks_in]
            out = [np.maximum(u, v) for u, v in zip(up, down)]
            least, peak = np.minimum.reduce(out), np.maximum.reduce(out)
            ok = (least > 0) & (ceiling - floor < rules.alike * least) & (peak <= 4 * least)
            signed = np.where(np.maximum.reduce(up) >= np.maximum.reduce(down), peak, -peak)
            at = np.where(ok, peak, 0).argmax(1)
            rows = np.arange(n)
            here = np.where(ok[rows, at], signed[rows, at], 0)
            best = np.where(np.abs(here) > np.abs(best), here, best)
        spike = np.where(best != 0, best, np.nan)
    return spread, low, high, stuck, spike


FEATURES = ["spread", "low", "high", "stuck", "spike"]


def _features(batches: Iterator[pa.RecordBatch], rules: SpikeRules, keys: list[str], samples: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(samples))
        n = batch.num_rows
        lengths = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        offsets = col.offsets.to_numpy()[:-1].astype(np.int64)
        raw = col.values
        none = raw.is_null().to_numpy(zero_copy_only=False)
        values = raw.to_numpy(zero_copy_only=False).astype(np.float64)
        finite = np.isfinite(values)
        odd = ~none & ~(finite & (values >= rules.lowest) & (values <= rules.highest))
        values = np.where(finite, values, np.nan)
        sums = np.concatenate([[0], np.cumsum(odd)])
        bad = sums[offsets + lengths] > sums[offsets]
        out = [np.full(n, np.nan) for _ in FEATURES]
        for ticks in np.unique(lengths[lengths > 0]):
            rows = np.nonzero(lengths == ticks)[0]
            for part in np.array_split(rows, max(1, len(rows) * int(ticks) // 500_000)):
                got = waveform_features(values[offsets[part][:, None] + np.arange(ticks)], rules)
                for o, g in zip(out, got):
                    o[part] = g
        arrays = [batch.column(batch.schema.get_field_index(k)) for k in keys]
        arrays += [pa.array(lengths.astype(np.int32)), pa.array(bad)]
        arrays += [pa.array(o, mask=np.isnan(o)) for o in out]
        yield pa.RecordBatch.from_arrays(arrays, names=[*keys, "ticks", "bad", *FEATURES])


def features(df: DataFrame, keys: list[str], samples: str, rules: SpikeRules = SpikeRules()) -> DataFrame:
    """The keys, ``ticks``, ``bad`` and FEATURES of each waveform, without a shuffle."""
    df = df.select(*keys, F.col(samples).cast("array<double>").alias(samples))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields)
    return df.mapInArrow(
        lambda it: _features(it, rules, keys, samples),
        f"{kinds}, ticks int, bad boolean, {', '.join(f'{c} double' for c in FEATURES)}",
    )


def source_fences(f: DataFrame, source: list[str], context: str, rules: SpikeRules) -> DataFrame:
    """One row per source: ``iqr`` of its steps, its fence ``always``, and fences ``in_context`` (a map) of contexts with enough waveforms.

    Sketches of the quartiles of steps are made for each source and context, map-side, and merged
    to those of the source. A fence reaches from the lower quartile to the upper one, widened at
    both ends by so many interquartile ranges that it ends at ``spike_noise`` deviations of the noise.
    """
    moving = f.where(F.col("low").isNotNull())
    sketches = moving.groupBy(*source, context).agg(
        F.kll_sketch_agg_double("low").alias("low"), F.kll_sketch_agg_double("high").alias("high"), F.count(F.lit(1)).alias("n")
    )
    wider = rules.spike_noise / STEP_IQR - 0.5

    def fence(low: Column, high: Column) -> Column:
        q1, q3 = F.kll_sketch_get_quantile_double(low, F.lit(1 - rules.quiet_quantile)), F.kll_sketch_get_quantile_double(high, F.lit(rules.quiet_quantile))
        return F.struct((q1 - wider * (q3 - q1)).alias("low"), (q3 + wider * (q3 - q1)).alias("high"), (q3 - q1).alias("iqr"))

    own = F.when((F.col("n") >= rules.least_context) & F.col(context).isNotNull(), F.struct(F.col(context), fence(F.col("low"), F.col("high"))))
    merged = sketches.groupBy(*source).agg(
        fence(F.kll_merge_agg_double("low"), F.kll_merge_agg_double("high")).alias("always"), F.map_from_entries(F.collect_list(own)).alias("in_context")
    )
    return merged.select(*source, "always", "in_context", F.col("always.iqr").alias("iqr"))


def light_hours(light: DataFrame) -> DataFrame:
    """``light_id, hour`` (of the day, UTC) of each light event; NULL where no version of it has a time."""
    ms = F.get("utime_ms", F.lit(0))
    ms = F.when(~F.isnan(ms) & (F.abs(ms) < 1e15), ms)
    hours = light.where(F.col("light_id").isNotNull()).groupBy("light_id").agg(F.min(ms).alias("ms"))
    return hours.select("light_id", F.pmod(F.floor(F.col("ms") / 3_600_000), F.lit(24)).cast("int").alias("hour"))


def faulty_waveforms(waveforms: DataFrame, masks: DataFrame, settings: DataFrame, light: DataFrame, rules: SpikeRules = SpikeRules()) -> DataFrame:
    """``tbl, row_id, reason`` of implausible waveforms, dead marks and clip settings, each row once.

    Waveforms (unless their file marks the channel dead): ``impossible`` (a reading that is no
    finite number in range), ``stuck`` (a long run without change below the rail), ``spike`` (out of
    the fence of its channel, at the hour of its light event, and back).
    Marks, for a file and channel with three or more waveforms (empty ones counted): ``unmarked`` (nothing varies) or
    ``alive`` (marked dead, varies like a living channel). Settings: ``setting`` (not finite, or off
    the adc's median by more than 1 %).

    NULL, empty arrays and NULL elements are no readings and no fault; arrays too short for a rule
    escape that rule. A NULL mark means not marked; a NULL setting is no case. A source without a
    normal (NULL channel, no settings) has no spikes, and no rail; a waveform without light event or
    hour is judged by its channel at all hours. Repeated rows come out once; empty tables give no
    rows. Extra columns are not read.
    """
    f = features(waveforms, ["wvfm_row", "light_id", "file_id", "adc", "ch"], "samples", rules)
    # waveforms without a light event may be many: where the join shuffles they are spread
    none = F.col("light_id").isNull() | (F.col("light_id") == -1)
    f = f.withColumn("_spread", F.when(none, F.pmod(F.xxhash64("wvfm_row"), F.lit(1000)) + 1).otherwise(0))
    hours = broadcast_if_small(light_hours(light)).withColumn("_spread", F.lit(0).cast("long"))
    f = kept(f.join(hours, ["light_id", "_spread"], "left").drop("light_id", "_spread"))
    thr = F.col("saturation_clip_threshold").cast("double")
    finite = thr.isNotNull() & ~F.isnan(thr) & (F.abs(thr) != float("inf"))
    rails = settings.where(finite).groupBy("adc").agg(F.kll_sketch_agg_double(thr).alias("_s"))
    rail = broadcast_if_small(rails.select("adc", F.kll_sketch_get_quantile_double("_s", F.lit(0.5)).alias("rail")))
    channel = broadcast_if_small(source_fences(f, ["adc", "ch"], "hour", rules))

    seen = f.join(channel, ["adc", "ch"], "left").join(rail, ["adc"], "left")
    fence = F.coalesce(F.element_at("in_context", F.col("hour")), F.col("always"))
    reason = (
        F.when(F.col("bad"), "impossible")
        .when(F.col("stuck") < F.coalesce(F.col("rail") * rules.rail_share, F.lit(float("inf"))), "stuck")
        .when((F.col("spike") > fence["high"]) | (F.col("spike") < fence["low"]), "spike")
    )
    faulty = seen.withColumn("reason", reason).where("reason IS NOT NULL")
    dead = masks.where("dead").select("file_id", "adc", "ch").distinct()
    faulty = faulty.join(dead, ["file_id", "adc", "ch"], "left_anti").select(F.lit("wvfm").alias("tbl"), F.col("wvfm_row").alias("row_id"), "reason")

    channels = (
        f.groupBy("file_id", "adc", "ch")
        .agg(
            F.count_distinct("wvfm_row").alias("rows"),
            F.max("spread").alias("most"),
            F.count_if(F.col("spread") > rules.stuck_counts).alias("vary"),
            F.count("spread").alias("all"),
            F.avg(F.col("high") - F.col("low")).alias("own_iqr"),
        )
        .where(F.col("rows") >= rules.least_rows)
        .join(channel, ["adc", "ch"], "left")
    )
    marks = masks.select("mask_row", "file_id", "adc", "ch", F.coalesce("dead", F.lit(False)).alias("dead"))
    marks = marks.join(channels, ["file_id", "adc", "ch"], "inner").select(
        F.lit("channel_mask").alias("tbl"),
        F.col("mask_row").alias("row_id"),
        F.when(~F.col("dead") & (F.col("most") <= rules.stuck_counts), "unmarked")
        .when(F.col("dead") & (2 * F.col("vary") > F.col("all")) & (F.col("own_iqr") >= rules.living_share * F.coalesce("iqr", F.lit(0.0))), "alive")
        .alias("reason"),
    ).where("reason IS NOT NULL")

    off = settings.where(thr.isNotNull()).join(rail, ["adc"], "left").where(
        ~finite | (F.abs(thr - F.col("rail")) > rules.setting_share * F.abs("rail"))
    ).select(F.lit("clip_settings").alias("tbl"), F.col("set_row").alias("row_id"), F.lit("setting").alias("reason"))
    return faulty.unionByName(marks).unionByName(off).dropDuplicates(["tbl", "row_id"])
