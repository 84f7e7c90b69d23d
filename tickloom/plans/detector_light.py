"""Queries of waveforms, light, space and sinks over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import arrays as A
from tickloom.operators import components, gaps, geometry, light, metrics, spatial, support, truth
from tickloom.plans.detector import _LOADED, QUERIES, SQL, loaded, query
from tickloom.operators.skew import kept
from tickloom.session import table
from tickloom.sources import sinks, tables

__all__ = ["QUERIES", "SQL"]

TICKS = 48

# ---------------------------------------------------------------- waveforms
_W = f"(SELECT DISTINCT wvfm_row, light_id, adc, ch, samples FROM wvfm WHERE len(samples) = {TICKS} AND list_max(samples) <= 65535 AND list_min(samples) >= 0 AND light_id IS NOT NULL)"


def well_formed(spark, d) -> DataFrame:
    s = F.col("samples")
    return table(spark, d, "wvfm").where((F.size(s) == TICKS) & F.forall(s, lambda v: v.isNotNull() & v.between(0, 65535)) & F.col("light_id").isNotNull()).select("wvfm_row", "light_id", "adc", "ch", "samples")


def waveforms(spark, d) -> DataFrame:
    return well_formed(spark, d).distinct()


def channels(waveforms: DataFrame) -> DataFrame:
    """``adc, ch, channel``: the channels that occur, numbered by adc."""
    return waveforms.select("adc", "ch").distinct().withColumn("channel", (F.row_number().over(Window.partitionBy("adc").orderBy("ch")) - 1).cast("int"))


def light_table(spark, d) -> DataFrame:
    """Baseline-subtracted light in long form; the model is the same light in reverse, the error flat."""
    w = waveforms(spark, d)
    lut = channels(w)
    a = A.baseline_subtracted(F.col("samples"), 12)
    return w.join(lut, ["adc", "ch"]).select("wvfm_row", "light_id", F.col("adc").alias("tpc"), "ch", "channel", a.alias("actual")).withColumns({"model": F.reverse("actual"), "std": F.transform("actual", lambda v: F.abs(v) * 0.1 + 20)})


_LUT = f"(SELECT adc, ch, CAST(row_number() OVER (PARTITION BY adc ORDER BY ch) - 1 AS INTEGER) AS channel FROM (SELECT DISTINCT adc, ch FROM {_W}))"
_L0 = f"(SELECT wvfm_row, light_id, w.adc AS tpc, w.ch, channel, list_transform(samples, lambda x: x::DOUBLE - list_avg(list_transform(samples[1:12], lambda y: y::DOUBLE))) AS actual FROM {_W} w JOIN {_LUT} l ON l.adc = w.adc AND l.ch = w.ch)"
_L = f"(SELECT *, list_reverse(actual) AS model, list_transform(actual, lambda v: abs(v) * 0.1::DOUBLE + 20) AS std FROM {_L0})"
_TICK = f"(SELECT wvfm_row, light_id, tpc, ch, channel, i AS tick, actual[i + 1] AS a, model[i + 1] AS m, std[i + 1] AS s FROM {_L}, (SELECT unnest(range(0, {TICKS})) AS i))"


@query("channel_order", f"SELECT * FROM {_LUT}")
def channel_order(spark, d):
    c = waveforms(spark, d).select("adc", "ch").distinct().select("adc", "ch", F.col("adc").alias("tpc"), F.lit(0).alias("side"), F.col("ch").alias("y_rel"))
    return geometry.channel_order(c).select("adc", "ch", "channel")


@query("baseline_subtracted", f"SELECT wvfm_row, round(list_sum(actual), 3) + 0.0::DOUBLE AS total, round(list_max(actual), 3) + 0.0::DOUBLE AS peak FROM {_L0}")
def baseline_subtracted(spark, d):
    a = A.baseline_subtracted(F.col("samples"), 12)
    return waveforms(spark, d).withColumn("a", a).select("wvfm_row", (F.round(A.asum(F.col("a")), 3) + 0.0).alias("total"), (F.round(F.array_max("a"), 3) + 0.0).alias("peak"))


@query(
    "noise_variance",
    f"""SELECT wvfm_row, CASE WHEN dead THEN 48e12::DOUBLE ELSE round({TICKS} * greatest(list_var_pop(list_transform(samples[1:12], lambda y: y::DOUBLE)), 100) + list_sum(list_transform(samples, lambda v: (0.1::DOUBLE * greatest(v::DOUBLE, 0)) ** 2)), 2) END AS total
FROM (SELECT *, adc = 3 AND ch > 40 AS dead FROM {_W})""",
)
def noise_variance(spark, d):
    v = A.noise_variance(F.col("samples"), (F.col("adc") == 3) & (F.col("ch") > 40), head=12, floor=100.0)
    return waveforms(spark, d).select("wvfm_row", F.round(A.asum(v), 2).alias("total"))


@query(
    "dead_mask",
    "SELECT DISTINCT adc, ch, (adc, ch) IN (SELECT (adc, ch) FROM channel_mask WHERE dead AND adc IS NOT NULL AND ch IS NOT NULL) AS dead FROM wvfm WHERE adc IS NOT NULL AND ch IS NOT NULL",
)
def dead_mask(spark, d):
    return geometry.dead_mask(table(spark, d, "wvfm").where("adc IS NOT NULL AND ch IS NOT NULL").select("adc", "ch").distinct(), table(spark, d, "channel_mask").where("dead"))


@query("saturation_veto", f"SELECT light_id, adc, count(*) AS n_channels, CAST(count_if(len(list_filter(samples, lambda x: x > 4000)) > 6) AS BIGINT) AS n_saturated FROM {_W} GROUP BY 1, 2")
def saturation_veto(spark, d):
    return support.saturation_summary(waveforms(spark, d), ["light_id", "adc"], threshold=4000.0)


@query("peak_tick", f"SELECT wvfm_row, CAST(list_position(samples, list_max(samples)) - 1 AS BIGINT) AS tick FROM {_W}")
def peak_tick(spark, d):
    return waveforms(spark, d).select("wvfm_row", A.peak_tick(F.col("samples")).cast("bigint").alias("tick"))


@query("chi2_mean", f"SELECT wvfm_row, round(avg((m - a) ** 2 / greatest(s, 1e-6)), 4) AS loss FROM {_TICK} GROUP BY 1")
def chi2_mean(spark, d):
    return light_table(spark, d).select("wvfm_row", F.round(A.chi2_mean(F.col("model"), F.col("actual"), F.col("std")), 4).alias("loss"))


@query("chi2_sum", f"SELECT wvfm_row, round(sum((least(m, 500) - a) ** 2 / greatest(s, 1e-6)), 3) AS loss FROM {_TICK} GROUP BY 1")
def chi2_sum(spark, d):
    return light_table(spark, d).select("wvfm_row", F.round(A.chi2_sum(F.col("model"), F.col("actual"), F.col("std"), 500.0), 3).alias("loss"))


@query("overflow_loss", f"SELECT wvfm_row, round(sum((m - a) ** 2 * CASE WHEN m > a THEN 4 ELSE 1 END / greatest(s, 1e-6)), 3) AS loss FROM {_TICK} GROUP BY 1")
def overflow_loss(spark, d):
    return light_table(spark, d).select("wvfm_row", F.round(A.overflow_weighted_loss(F.col("model"), F.col("actual"), F.col("std"), 4.0), 3).alias("loss"))


@query(
    "matched_filter",
    f"SELECT wvfm_row, round(CASE WHEN aa > 0 AND bb > 0 THEN ab / sqrt(aa * bb) ELSE 0 END, 7) AS cosine FROM (SELECT wvfm_row, sum(m * greatest(a, 0) / s) AS ab, sum(m * m / s) AS aa, sum(greatest(a, 0) ** 2 / s) AS bb FROM {_TICK} GROUP BY 1)",
)
def matched_filter(spark, d):
    zero = F.transform("actual", lambda _: F.lit(0.0))
    return light_table(spark, d).select("wvfm_row", F.round(A.matched_filter(F.col("model"), zero, F.col("actual"), F.col("std")), 7).alias("cosine"))


@query("raw_kurtosis", f"SELECT ch, round(avg((x - mu) ** 4) / avg((x - mu) ** 2) ** 2, 5) AS kurtosis FROM (SELECT ch, a AS x, avg(a) OVER (PARTITION BY ch) AS mu FROM {_TICK}) GROUP BY 1")
def raw_kurtosis(spark, d):
    return light_table(spark, d).select("ch", F.explode("actual").alias("x")).groupBy("ch").agg(F.round(metrics.raw_kurtosis(F.col("x")), 5).alias("kurtosis"))


@query(
    "moving_average",
    f"SELECT wvfm_row, round(max(v), 4) + 0.0::DOUBLE AS top FROM (SELECT wvfm_row, sum(a) OVER (PARTITION BY wvfm_row ORDER BY tick ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) / 11 AS v FROM {_TICK}) GROUP BY 1",
)
def moving_average(spark, d):
    return light_table(spark, d).select("wvfm_row", (F.round(F.array_max(gaps.moving_average(F.col("actual"), 11)), 4) + 0.0).alias("top"))


@query(
    "local_maxima",
    f"SELECT wvfm_row, CAST(count_if(a >= p AND a > n) AS INTEGER) AS n FROM (SELECT wvfm_row, a, lag(a) OVER w AS p, lead(a) OVER w AS n FROM {_TICK} WINDOW w AS (PARTITION BY wvfm_row ORDER BY tick)) GROUP BY 1",
)
def local_maxima(spark, d):
    return light_table(spark, d).select("wvfm_row", F.size(gaps.local_maxima(F.col("actual"))).alias("n"))


@query("shift_whole", f"SELECT wvfm_row, round(sum(CASE WHEN tick >= 5 THEN a * (SELECT 1) ELSE 0 END * 0 + coalesce(b, 0) * tick), 2) AS moment FROM (SELECT wvfm_row, tick, a, lag(a, 5) OVER (PARTITION BY wvfm_row ORDER BY tick) AS b FROM {_TICK}) GROUP BY 1")
def shift_whole(spark, d):
    s = A.shift_whole(F.col("actual"), F.lit(5))
    return light_table(spark, d).select("wvfm_row", F.round(A.asum(F.transform(s, lambda v, i: v * i)), 2).alias("moment"))


_SHIFTED = f"(SELECT wvfm_row, tick, lag(a, 2) OVER w AS b2, lag(a, 3) OVER w AS b3 FROM {_TICK} WINDOW w AS (PARTITION BY wvfm_row ORDER BY tick))"


@query("shift_interpolated", f"SELECT wvfm_row, round(sum(CASE WHEN b3 IS NOT NULL THEN (b3 * 0.5 + b2 * 0.5) * tick ELSE 0 END), 2) AS moment FROM {_SHIFTED} GROUP BY 1")
def shift_interpolated(spark, d):
    s = A.shift_interpolated(F.col("actual"), F.lit(2.5))
    return light_table(spark, d).select("wvfm_row", F.round(A.asum(F.transform(s, lambda v, i: v * i)), 2).alias("moment"))


_CHLIGHT = f"(SELECT light_id, tpc, channel, round(greatest(list_max(actual), 0), 6) AS light FROM {_L0})"


def channel_light(spark, d) -> DataFrame:
    return light_table(spark, d).select("light_id", "tpc", "channel", F.round(support.clipped_peak(F.col("actual")), 6).alias("light")).groupBy("light_id", "tpc", "channel").agg(F.max("light").alias("light"))


_CHL = f"(SELECT light_id, tpc, channel, max(light) AS light FROM {_CHLIGHT} GROUP BY 1, 2, 3)"


@query(
    "support_top_share",
    f"SELECT light_id, tpc, channel, light FROM (SELECT *, coalesce(sum(light) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(light) OVER (PARTITION BY light_id, tpc) AS t FROM {_CHL} WINDOW w AS (PARTITION BY light_id, tpc ORDER BY light DESC, channel)) WHERE t > 0 AND light > 0 AND (b < 0.9 * t OR light >= 200)",
)
def support_top_share(spark, d):
    return support.top_share(channel_light(spark, d), ["light_id", "tpc"], "channel", "light", 0.9, 200.0)


@query(
    "support_tiles",
    f"SELECT c.light_id, c.tpc, c.channel FROM {_CHL} c JOIN (SELECT light_id, tpc, channel // 2 AS t, row_number() OVER (PARTITION BY light_id, tpc ORDER BY sum(light) DESC, channel // 2) AS r FROM {_CHL} GROUP BY 1, 2, 3) t ON t.light_id = c.light_id AND t.tpc = c.tpc AND t.t = c.channel // 2 WHERE r <= 2",
)
def support_tiles(spark, d):
    return support.bright_tiles(channel_light(spark, d), ["light_id", "tpc"], "channel", "light", 2, 2).select("light_id", "tpc", "channel")


def _share_sql(share: float, by: str) -> str:
    """SQL: the rows of the channel light that hold ``share`` of the light of their group."""
    src = f"(SELECT *, channel // 3 AS side FROM {_CHL})"
    return f"(SELECT * FROM (SELECT *, coalesce(sum(light) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(light) OVER (PARTITION BY {by}) AS t FROM {src} WINDOW w AS (PARTITION BY {by} ORDER BY light DESC, channel)) WHERE t > 0 AND light > 0 AND b < {share} * t)"


@query(
    "support_runs",
    f"""WITH s AS (SELECT light_id, tpc, side, min(channel) AS first, max(channel) AS last FROM (SELECT *, sum(g) OVER (PARTITION BY light_id, tpc, side ORDER BY channel) AS isl FROM
  (SELECT light_id, tpc, side, channel, CASE WHEN channel - lag(channel) OVER (PARTITION BY light_id, tpc, side ORDER BY channel) > 3 THEN 1 ELSE 0 END AS g FROM {_share_sql(0.9, 'light_id, tpc')})) GROUP BY light_id, tpc, side, isl)
SELECT light_id, tpc, side, first, last, light FROM (SELECT s.*, light, row_number() OVER (PARTITION BY s.light_id, s.tpc, s.side ORDER BY light DESC, first) AS r FROM s JOIN (SELECT s.light_id, s.tpc, s.side, s.first AS f, round(sum(c.light), 5) AS light FROM s
  JOIN {_CHL} c ON c.light_id = s.light_id AND c.tpc = s.tpc AND c.channel BETWEEN s.first AND s.last AND c.channel // 3 = s.side GROUP BY 1, 2, 3, 4) l ON l.light_id = s.light_id AND l.tpc = s.tpc AND l.side = s.side AND l.f = s.first) WHERE r = 1""",
)
def support_runs(spark, d):
    return support.side_runs(channel_light(spark, d), ["light_id", "tpc"], "channel", "light", 3).withColumn("light", F.round("light", 5))


@query(
    "support_widened",
    f"""SELECT light_id, tpc, unnest(range(side * 3 + greatest(a - 1, 0), side * 3 + least(b + 1, 2) + 1)) AS channel FROM (SELECT light_id, tpc, side, min(channel % 3) AS a, max(channel % 3) AS b FROM {_share_sql(0.5, 'light_id, tpc')} GROUP BY 1, 2, 3)""",
)
def support_widened(spark, d):
    s = support.top_share(channel_light(spark, d), ["light_id", "tpc"], "channel", "light", 0.5)
    return support.widened(s, ["light_id", "tpc"], 3, 1)


_VETO = f"(SELECT DISTINCT light_id, tpc, channel FROM {_L0} WHERE len(list_filter(actual, lambda x: x > 300)) > 6)"
_KEPT = f"(SELECT light_id, tpc, channel FROM {_share_sql(0.9, 'light_id, tpc')} s ANTI JOIN {_VETO} v ON v.light_id = s.light_id AND v.tpc = s.tpc AND v.channel = s.channel)"


@query(
    "support_after_veto",
    f"""SELECT * FROM {_KEPT} UNION ALL SELECT a.* FROM (SELECT DISTINCT light_id, tpc, channel FROM {_L0}) a ANTI JOIN {_VETO} v ON v.light_id = a.light_id AND v.tpc = a.tpc AND v.channel = a.channel
WHERE (a.light_id, a.tpc) IN (SELECT (light_id, tpc) FROM {_share_sql(0.9, 'light_id, tpc')}) AND (a.light_id, a.tpc) NOT IN (SELECT (light_id, tpc) FROM {_KEPT})""",
)
def support_after_veto(spark, d):
    l = light_table(spark, d)
    s = support.top_share(channel_light(spark, d), ["light_id", "tpc"], "channel", "light")
    veto = support.saturation_veto(l.withColumn("samples", F.col("actual")), threshold=300.0)
    return support.apply_veto(s, veto, l, ["light_id", "tpc"], ["light_id", "tpc"])


_C = "(SELECT DISTINCT light_id, tpc % 8 AS tpc, round_even(t0 % 48, 0) - 20 AS t0 FROM candidates WHERE light_id > 0 AND tpc IS NOT NULL AND t0 IS NOT NULL)"
RULES = light.LightRules(peak=20, half_window=5, sigma=1.0, overflow_adc=20.0, model_adc=20.0, least_channels=3, least_deficit=100.0)


def light_candidates(spark, d) -> DataFrame:
    return table(spark, d, "candidates").where("light_id > 0 AND tpc IS NOT NULL AND t0 IS NOT NULL").select("light_id", (F.col("tpc") % 8).alias("tpc"), (F.rint(F.col("t0") % 48) - 20).alias("t0")).distinct()


_WIN = f"""(SELECT c.light_id, c.tpc, c.t0, x.wvfm_row, x.tick, x.m - x.a AS dd, greatest(x.s, 20) AS th, x.m, c.t0 + 20 AS pk FROM {_C} c JOIN {_TICK} x ON x.light_id = c.light_id AND x.tpc = c.tpc
  WHERE c.t0 + 20 BETWEEN 0 AND {TICKS - 1} AND x.tick BETWEEN c.t0 + 15 AND c.t0 + 25)"""
_SUMMARY = f"""(SELECT light_id, tpc, t0, CAST(count_if(o) AS BIGINT) AS overflow_channels, CAST(count_if(u) AS BIGINT) AS deficit_channels, sum(os) AS window_overflow, sum(us) AS window_deficit, sum(po) AS peak_overflow
  FROM (SELECT light_id, tpc, t0, wvfm_row, bool_or(dd > th AND m > 20) AS o, bool_or(-dd > th) AS u, sum(CASE WHEN dd > th AND m > 20 THEN dd ELSE 0 END) AS os, sum(greatest(-dd, 0)) AS us, sum(CASE WHEN tick = pk AND dd > th AND m > 20 THEN dd ELSE 0 END) AS po FROM {_WIN} GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3)"""


@query("window_summaries", f"SELECT light_id, tpc, t0, overflow_channels, deficit_channels, round(window_overflow, 3) AS window_overflow, round(window_deficit, 3) AS window_deficit, round(peak_overflow, 3) AS peak_overflow FROM {_SUMMARY}")
def window_summaries(spark, d):
    s = light.window_summaries(light_table(spark, d), light_candidates(spark, d), ["light_id", "tpc"], RULES)
    return s.select("light_id", "tpc", "t0", "overflow_channels", "deficit_channels", *[F.round(c, 3).alias(c) for c in ("window_overflow", "window_deficit", "peak_overflow")])


@query(
    "overflow_ranking",
    f"SELECT light_id, tpc, t0, CAST(row_number() OVER (PARTITION BY light_id ORDER BY round(sev, 6) DESC, round(window_overflow, 6) DESC, overflow_channels DESC, tpc, t0) AS INTEGER) AS source_rank FROM (SELECT *, peak_overflow / greatest(overflow_channels, 1) + 0.002 * window_overflow AS sev FROM {_SUMMARY}) WHERE overflow_channels >= 3",
)
def overflow_ranking(spark, d):
    s = light.window_summaries(light_table(spark, d), light_candidates(spark, d), ["light_id", "tpc"], RULES).withColumn("severity", F.round("severity", 6)).withColumn("window_overflow", F.round("window_overflow", 6))
    return light.overflow_ranking(s, ["light_id"], "tpc", RULES).select("light_id", "tpc", "t0", "source_rank")


@query(
    "destination_ranking",
    f"SELECT light_id, tpc, t0, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY light_id, tpc ORDER BY window_deficit DESC, t0) AS r FROM {_SUMMARY} WHERE abs(t0) > 5 AND window_deficit >= 100) WHERE r <= 10",
)
def destination_ranking(spark, d):
    s = light.window_summaries(light_table(spark, d), light_candidates(spark, d), ["light_id", "tpc"], RULES)
    return light.destination_ranking(s, ["light_id", "tpc"], F.lit(0.0), 5.0, RULES).select("light_id", "tpc", "t0", "rank")


@query(
    "window_chi2",
    f"""SELECT x.light_id, x.tpc, round(sum(((m - a) / greatest(s, 5)) ** 2), 3) AS chi2, count(*) AS dof FROM {_TICK} x SEMI JOIN (SELECT DISTINCT c.light_id, c.tpc, g.i AS tick FROM {_C} c JOIN (SELECT unnest(range(0, {TICKS})) AS i) g ON g.i BETWEEN c.t0 + 15 AND c.t0 + 25 WHERE c.t0 + 20 BETWEEN 0 AND {TICKS - 1}) k
  ON k.light_id = x.light_id AND k.tpc = x.tpc AND k.tick = x.tick GROUP BY 1, 2""",
)
def window_chi2(spark, d):
    ticks = light.window_ticks(light_candidates(spark, d), ["light_id", "tpc"], TICKS, 5, 20)
    return light.window_chi2(light_table(spark, d), ticks, ["light_id", "tpc"], 5.0).withColumn("chi2", F.round("chi2", 3))


_DEF = f"(SELECT light_id, tpc, tick, sum(greatest(a - m, 0)) AS v FROM {_TICK} GROUP BY 1, 2, 3)"


@query(
    "residual_curves",
    f"SELECT light_id, tpc, round(max(v), 3) AS top FROM (SELECT light_id, tpc, sum(v) OVER (PARTITION BY light_id, tpc ORDER BY tick ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) / 11 AS v FROM {_DEF}) GROUP BY 1, 2",
)
def residual_curves(spark, d):
    return light.residual_curves(light_table(spark, d), ["light_id", "tpc"]).select("light_id", "tpc", F.round(F.array_max("deficit"), 3).alias("top"))


def curves(spark, d) -> DataFrame:
    """Residual curves, rounded, so that heights alike are ties in any order of summation."""
    c = light.residual_curves(light_table(spark, d), ["light_id", "tpc"])
    return c.withColumns({n: F.transform(n, lambda v: F.round(v, 6)) for n in ("deficit", "overflow")})


def _curve_sql(value: str) -> str:
    return f"""(SELECT light_id, tpc, tick, round(sum(v) OVER (PARTITION BY light_id, tpc ORDER BY tick ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) / 11, 6) AS v FROM (SELECT light_id, tpc, tick, sum(greatest({value}, 0)) AS v FROM {_TICK} GROUP BY 1, 2, 3))"""


def _peaks_sql(src: str, floor: str, n: int, separation: int) -> str:
    """SQL: ``light_id, tpc, p`` (a list) of the highest ticks from ``floor`` on, each far enough from those before."""
    return f"""(SELECT light_id, tpc, list_reduce(list_prepend([]::BIGINT[], list([tick] ORDER BY v DESC, tick)), lambda acc, x: CASE WHEN len(acc) < {n} AND len(list_filter(acc, lambda k: abs(k - x[1]) < {separation})) = 0 THEN list_concat(acc, x) ELSE acc END) AS p
  FROM (SELECT s.* FROM {src} s JOIN (SELECT light_id, tpc, max(v) AS top, {floor} AS f FROM {src} GROUP BY 1, 2) m ON m.light_id = s.light_id AND m.tpc = s.tpc WHERE m.top > 0 AND s.v >= m.f) GROUP BY 1, 2)"""


_RESIDUAL_PEAKS = _peaks_sql(_curve_sql("a - m"), "greatest(0.3::DOUBLE * max(v), avg(v) + sqrt(greatest(avg(v * v) - avg(v) ** 2, 0)))", 4, 10)


@query("residual_seeds", f"SELECT * FROM (SELECT light_id, tpc, CAST(unnest(p) - 20 AS DOUBLE) AS t0 FROM {_RESIDUAL_PEAKS}) WHERE t0 BETWEEN 0 AND {TICKS}")
def residual_seeds(spark, d):
    return light.seeds_from_residual(curves(spark, d), ["light_id", "tpc"], TICKS, peak=20)


@query(
    "residual_peaks",
    " UNION ALL ".join(f"SELECT light_id, tpc, {sign} AS sign, CAST(unnest(p) AS INTEGER) AS tick FROM {_peaks_sql(_curve_sql(v), '0.3::DOUBLE * max(v)', 3, 8)}" for sign, v in ((1, "a - m"), (-1, "m - a"))),
)
def residual_peaks(spark, d):
    return light.signed_peaks(curves(spark, d), ["light_id", "tpc"], 3, 8, 0.3)


@query(
    "residual_holes",
    f"""WITH s AS (SELECT light_id, tpc, tick, sum(a) AS a, sum(m) AS m FROM {_TICK} GROUP BY 1, 2, 3),
c AS (SELECT c.*, s.a, s.m, row_number() OVER (PARTITION BY c.light_id, c.tpc ORDER BY round(s.a, 6) DESC, c.t0) AS r FROM (SELECT * FROM {_C} WHERE t0 <> 0) c JOIN s ON s.light_id = c.light_id AND s.tpc = c.tpc AND s.tick = c.t0 + 20)
SELECT light_id, tpc, t0, round(greatest(a - m, 0), 3) AS peak_missing FROM c WHERE r > 1 AND greatest(a - m, 0) / greatest(a, 1e-9) >= 0.5""",
)
def residual_holes(spark, d):
    h = light.residual_holes(light_table(spark, d), light_candidates(spark, d), ["light_id", "tpc"], 0.5, 5, 20)
    return h.select("light_id", "tpc", "t0", F.round("peak_missing", 3).alias("peak_missing"))


# ---------------------------------------------------------------- model scores
@query("standardizer", f"SELECT channel, tpc, count(v) AS n, round(avg(v), 5) AS mean, round(stddev_pop(v), 5) AS std FROM (SELECT channel, tpc, CASE WHEN m > 0 THEN a END AS v FROM {_TICK}) GROUP BY 1, 2")
def standardizer(spark, d):
    x = light_table(spark, d).select("tpc", "channel", F.inline(F.arrays_zip("actual", "model")))
    s = metrics.standardizer(x, ["channel", "tpc"], F.col("actual"), F.col("model") > 0)
    return s.withColumn("mean", F.round("mean", 5)).withColumn("std", F.round("std", 5))


@query("r2_per_channel", f"SELECT channel, count(*) AS n, round(avg((m - a) ** 2), 3) AS mse, round(avg(abs(m - a)), 4) AS mae, round(1 - avg((m - a) ** 2) / greatest(var_pop(a), 1e-12), 7) AS r2 FROM {_TICK} GROUP BY 1")
def r2_per_channel(spark, d):
    x = light_table(spark, d).select("channel", F.inline(F.arrays_zip("actual", "model")))
    s = metrics.regression_scores(x, ["channel"], F.col("actual"), F.col("model"), F.lit(True))
    return s.select("channel", "n", F.round("mse", 3).alias("mse"), F.round("mae", 4).alias("mae"), F.round("r2", 7).alias("r2"))


@query("gaussian_nll", f"SELECT channel, round(avg(0.5 * (ln(s) + (a - m) ** 2 / s)) + 0.1 * (stddev_samp((a - m) / sqrt(s)) - 1) ** 2, 5) AS loss, round(stddev_samp((a - m) / sqrt(s)), 6) AS pull_width FROM {_TICK} GROUP BY 1")
def gaussian_nll(spark, d):
    x = light_table(spark, d).select("channel", F.inline(F.arrays_zip("actual", "model", "std")))
    s = metrics.gaussian_nll(x, ["channel"], F.col("actual"), F.col("model"), F.ln("std"), 0.1)
    return s.select("channel", F.round("loss", 5).alias("loss"), F.round("pull_width", 6).alias("pull_width"))


# ---------------------------------------------------------------- space
BOX = {"x": (-350.0, 350.0, 50), "y": (-100.0, 100.0, 20), "z": (400.0, 1000.0, 30)}


def _bin(c: str, lo: float, hi: float, n: int) -> str:
    return f"CAST(least(greatest(floor(({c} - ({lo})) * ({n} / ({hi} - ({lo})))), 0), {n - 1}) AS INTEGER)"


@query(
    "voxel_histogram",
    f"SELECT event_id, hit_tpc_id, ({_bin('x', -350, 350, 50)} * 20 + {_bin('y', -100, 100, 20)}) * 30 + {_bin('z', 400, 1000, 30)} AS vox, round(sum(e), 6) AS energy FROM {_LOADED} GROUP BY 1, 2, 3",
)
def voxel_histogram(spark, d):
    return geometry.voxelize(loaded(spark, d), ["event_id", "hit_tpc_id"], BOX).withColumn("energy", F.round("energy", 6))


_P = f"(SELECT event_id, hit_row, x, y, z, e, t_cluster_id AS cluster FROM {_LOADED})"


def points(spark, d) -> DataFrame:
    return loaded(spark, d, ("t_cluster_id",)).select("event_id", "hit_row", "x", "y", "z", "e", F.col("t_cluster_id").alias("cluster"))


_D = "sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)"
_PAIRS = f"(SELECT a.event_id, a.hit_row AS a, b.hit_row AS b, a.cluster AS ca, b.cluster AS cb, a.e AS ea, b.e AS eb, {_D} AS dist FROM {_P} a JOIN {_P} b ON a.event_id = b.event_id AND a.hit_row <> b.hit_row AND abs(a.x - b.x) <= 12 AND {_D} <= 12)"


@query("distance_pairs", f"SELECT event_id, a, b, round(dist, 6) AS dist FROM {_PAIRS} WHERE a < b")
def distance_pairs(spark, d):
    return spatial.close_pairs(points(spark, d), "hit_row", 12.0, ["event_id"]).withColumn("dist", F.round("dist", 6))


@query("cluster_adjacency", f"SELECT event_id, least(ca, cb) AS a, greatest(ca, cb) AS b, round(min(dist), 6) AS dist FROM {_PAIRS} WHERE ca <> cb AND ca <> -1 AND cb <> -1 GROUP BY 1, 2, 3")
def cluster_adjacency(spark, d):
    return spatial.cluster_adjacency(points(spark, d), 12.0, ["event_id"]).withColumn("dist", F.round("dist", 6))


@query("nearest_labelled", f"SELECT event_id, a AS hit_row, arg_min(b, (dist, b)) AS other, round(min(dist), 6) AS dist FROM {_PAIRS} WHERE ca < 5 AND cb >= 5 GROUP BY 1, 2")
def nearest_labelled(spark, d):
    p = points(spark, d)
    n = spatial.nearest_within(p.where("cluster < 5"), p.where("cluster >= 5").withColumnRenamed("hit_row", "other"), 12.0, "hit_row", "other", ["event_id"])
    return n.withColumn("dist", F.round("dist", 6))


@query("k_nearest", f"SELECT event_id, a AS hit_row, b AS neighbor, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY event_id, a ORDER BY dist, b) AS r FROM {_PAIRS}) WHERE r <= 4")
def k_nearest(spark, d):
    return spatial.k_nearest(points(spark, d), 4, 12.0, "hit_row", ["event_id"]).drop("dist")


@query(
    "neighbor_vote",
    f"""SELECT event_id, a AS hit_row, cb AS cluster FROM (SELECT *, sum(w) OVER (PARTITION BY event_id, a) AS t, row_number() OVER (PARTITION BY event_id, a ORDER BY w DESC, cb) AS r FROM
  (SELECT event_id, a, cb, sum((1 + 0.15 * ln(1 + greatest(eb, 0))) / (dist + 0.5)) AS w FROM (SELECT *, row_number() OVER (PARTITION BY event_id, a ORDER BY dist, b) AS r FROM {_PAIRS}) WHERE r <= 18 AND ca = 7 AND cb <> 7 GROUP BY 1, 2, 3)) WHERE r = 1 AND w >= 0.55 * t""",
)
def neighbor_vote(spark, d):
    return spatial.neighbor_vote(points(spark, d), "cluster", "e", "hit_row", r=12.0, by=["event_id"], noise=7)


@query(
    "local_density",
    f"""SELECT p.event_id, p.hit_row, round(coalesce(r.rho, 0), 6) AS rho FROM (SELECT DISTINCT event_id, hit_row FROM {_P}) p LEFT JOIN (SELECT event_id, a, sum((1 + 0.25 * ln(1 + greatest(eb, 0))) * exp(-dist * dist / 18)) AS rho FROM
  (SELECT *, row_number() OVER (PARTITION BY event_id, a ORDER BY dist, b) AS r FROM {_PAIRS}) WHERE r <= 16 GROUP BY 1, 2) r ON r.event_id = p.event_id AND r.a = p.hit_row""",
)
def local_density(spark, d):
    return spatial.local_density(points(spark, d), "e", "hit_row", r=12.0, by=["event_id"]).withColumn("rho", F.round("rho", 6))


@query(
    "fragment_edges",
    f"SELECT DISTINCT event_id, least(a, b) AS a, greatest(a, b) AS b FROM (SELECT *, row_number() OVER (PARTITION BY event_id, a ORDER BY dist, b) AS r FROM {_PAIRS}) WHERE r <= 16 AND dist / 6 - 0.1::DOUBLE * least(ln(1 + greatest(ea, 0)), ln(1 + greatest(eb, 0))) <= 1.25",
)
def fragment_edges(spark, d):
    return spatial.fragment_edges(points(spark, d), "e", "hit_row", r=12.0, by=["event_id"])


@query(
    "noise_neighbors",
    f"""SELECT event_id, hit_row, cluster, round(dist, 6) AS dist FROM (SELECT *, min(dist) OVER (PARTITION BY event_id, hit_row) AS low FROM (SELECT a.event_id, a.hit_row, b.cluster, min({_D}) AS dist FROM {_P} a JOIN {_P} b
  ON a.event_id = b.event_id AND a.cluster = 7 AND b.cluster <> 7 AND abs(a.x - b.x) <= 40 AND {_D} <= 40 GROUP BY 1, 2, 3)) WHERE dist <= 1.2 * low""",
)
def noise_neighbors(spark, d):
    return spatial.noise_neighbors(points(spark, d), "hit_row", "cluster", noise=7, by=["event_id"]).withColumn("dist", F.round("dist", 6))


@query(
    "radius_components",
    f"""WITH RECURSIVE e AS MATERIALIZED (SELECT event_id, a, b FROM {_PAIRS}), p AS MATERIALIZED (SELECT DISTINCT event_id, hit_row FROM {_P}),
r(event_id, node, root) AS (SELECT event_id, hit_row, hit_row FROM p UNION SELECT e.event_id, e.b, r.root FROM r JOIN e ON e.event_id = r.event_id AND e.a = r.node WHERE r.root < e.b)
SELECT event_id, node AS hit_row, min(root) AS component FROM r GROUP BY 1, 2""",
)
def radius_components(spark, d):
    return components.radius_components(points(spark, d), "hit_row", 12.0, ["event_id"], unique=True)


_DBSCAN = f"""WITH RECURSIVE n AS MATERIALIZED (SELECT event_id, a, b FROM {_PAIRS}), core AS MATERIALIZED (SELECT event_id, a AS node FROM n GROUP BY 1, 2 HAVING count(*) + 1 >= 3),
e AS MATERIALIZED (SELECT n.* FROM n SEMI JOIN core c ON c.event_id = n.event_id AND c.node = n.a SEMI JOIN core k ON k.event_id = n.event_id AND k.node = n.b),
r(event_id, node, root) AS (SELECT event_id, node, node FROM core UNION SELECT e.event_id, e.b, r.root FROM r JOIN e ON e.event_id = r.event_id AND e.a = r.node WHERE r.root < e.b),
comp AS MATERIALIZED (SELECT event_id, node, min(root) AS c FROM r GROUP BY 1, 2), border AS (SELECT n.event_id, n.a AS node, min(k.c) AS c FROM n JOIN comp k ON k.event_id = n.event_id AND k.node = n.b GROUP BY 1, 2),
l AS MATERIALIZED (SELECT p.event_id, p.hit_row, coalesce(k.c, b.c) AS cluster, p.e FROM {_P} p LEFT JOIN comp k ON k.event_id = p.event_id AND k.node = p.hit_row LEFT JOIN border b ON b.event_id = p.event_id AND b.node = p.hit_row),
no AS (SELECT event_id, cluster, CAST(row_number() OVER (PARTITION BY event_id ORDER BY round(sum(e), 6) DESC, cluster) - 1 AS INTEGER) AS label FROM l WHERE cluster IS NOT NULL GROUP BY 1, 2)
SELECT l.event_id, l.hit_row, coalesce(no.label, -1) AS label FROM l LEFT JOIN no ON no.event_id = l.event_id AND no.cluster = l.cluster"""


@query("density_clusters", _DBSCAN)
def density_clusters(spark, d):
    p = kept(points(spark, d))
    return components.labels_by_energy(components.dbscan(p, "hit_row", 12.0, 3, ["event_id"], unique=True), p, "hit_row", "e", ["event_id"])


def _cross_sql(p: str, q: str) -> str:
    return f"[{p}[2] * {q}[3] - {p}[3] * {q}[2], {p}[3] * {q}[1] - {p}[1] * {q}[3], {p}[1] * {q}[2] - {p}[2] * {q}[1]]"


#: Eigenvalues of a symmetric matrix in closed form; the main direction is at right angles to two rows of the matrix less its largest.
_AXES = f"""WITH p AS (SELECT event_id, cluster, x, y, z, greatest(coalesce(e, 0), 1e-8) AS w FROM {_P} WHERE cluster >= 0), m AS (SELECT event_id, cluster, count(*) AS n, sum(w) AS sw, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my, sum(w * z) / sum(w) AS mz FROM p GROUP BY 1, 2),
c AS (SELECT p.event_id, p.cluster, any_value(n) AS n, any_value(sw) AS sw, any_value(mx) AS mx, any_value(my) AS my, any_value(mz) AS mz, sum(w * (x - mx) ** 2) / any_value(sw) AS a, sum(w * (y - my) ** 2) / any_value(sw) AS b, sum(w * (z - mz) ** 2) / any_value(sw) AS c,
  sum(w * (x - mx) * (y - my)) / any_value(sw) AS d, sum(w * (x - mx) * (z - mz)) / any_value(sw) AS e, sum(w * (y - my) * (z - mz)) / any_value(sw) AS f FROM p JOIN m ON m.event_id = p.event_id AND m.cluster = p.cluster GROUP BY 1, 2),
s AS (SELECT *, (a + b + c) / 3 AS q, sqrt(((a - (a + b + c) / 3) ** 2 + (b - (a + b + c) / 3) ** 2 + (c - (a + b + c) / 3) ** 2 + 2 * (d * d + e * e + f * f)) / 6) AS r FROM c),
t AS (SELECT *, CASE WHEN r > 0 THEN acos(greatest(-1, least(1, ((a - q) * ((b - q) * (c - q) - f * f) - d * (d * (c - q) - f * e) + e * (d * f - (b - q) * e)) / (2 * r ** 3)))) / 3 ELSE 0 END AS phi FROM s),
l AS (SELECT *, q + 2 * r * cos(phi) AS l1, greatest(q + 2 * r * cos(phi + 2 * pi() / 3), 0) AS l3, 3 * q AS tr FROM t), rows_ AS (SELECT *, [a - l1, d, e] AS r1, [d, b - l1, f] AS r2, [e, f, c - l1] AS r3, greatest(tr - l1 - l3, 0) AS l2 FROM l),
k AS (SELECT *, list_sort(list_transform([{_cross_sql('r1', 'r2')}, {_cross_sql('r1', 'r3')}, {_cross_sql('r2', 'r3')}], lambda v: {{'n': sqrt(v[1] ** 2 + v[2] ** 2 + v[3] ** 2), 'v': v}}), 'DESC')[1] AS u FROM rows_),
g AS (SELECT p.event_id, p.cluster, max(((x - mx) * u.v[1] + (y - my) * u.v[2] + (z - mz) * u.v[3]) / greatest(u.n, 1e-300)) - min(((x - mx) * u.v[1] + (y - my) * u.v[2] + (z - mz) * u.v[3]) / greatest(u.n, 1e-300)) AS length FROM p JOIN k ON k.event_id = p.event_id AND k.cluster = p.cluster GROUP BY 1, 2)
SELECT k.event_id, k.cluster, k.n AS n_hits, round(sw, 4) AS energy, round(length, 4) AS length, round(CASE WHEN n < 3 THEN n - 1 ELSE l1 / greatest(tr, 1e-12) END, 4) AS linearity, round(CASE WHEN n < 3 THEN 0 ELSE (l1 + l2) / greatest(tr, 1e-12) END, 4) AS planarity,
  round(CASE WHEN n < 3 THEN 0 ELSE sqrt(l2 + l3) END, 4) AS transverse_rms FROM k JOIN g ON g.event_id = k.event_id AND g.cluster = k.cluster"""


@query("principal_axes", _AXES)
def principal_axes(spark, d):
    a = components.principal_axes(points(spark, d).where("cluster >= 0"), ["event_id", "cluster"], "e")
    return a.select("event_id", "cluster", "n_hits", *[F.round(c, 4).alias(c) for c in ("energy", "length", "linearity", "planarity", "transverse_rms")])


@query(
    "suspicious_clusters",
    f"""SELECT event_id, cluster, reasons FROM (SELECT event_id, cluster, n, energy, list_filter([CASE WHEN cluster % 3 = 0 THEN 'unassigned' END, CASE WHEN lin < 0.82 THEN 'low_linearity' END, CASE WHEN width > 4 THEN 'wide_cluster' END,
  CASE WHEN score > 0.10 THEN 'weak_matrix_margin' END, CASE WHEN coalesce(gain, 0) <= 0 THEN 'weak_light_improvement' END], lambda x: x IS NOT NULL) AS reasons FROM (SELECT event_id, cluster, count(*) AS n, sum(e) AS energy, count_if(y > 0) / count(*) AS lin, round(stddev_pop(z) / 60, 9) AS width,
  round(max(e) / sum(e), 9) AS score, round(avg(e) - 1.2, 9) AS gain FROM {_P} WHERE cluster >= 0 GROUP BY 1, 2)) WHERE n >= 8 AND energy >= 1 AND len(reasons) > 0""",
)
def suspicious_clusters(spark, d):
    # shares and spreads of the hits play the scores of the light
    c = points(spark, d).where("cluster >= 0").groupBy("event_id", "cluster").agg(
        F.count(F.lit(1)).alias("n_hits"), F.sum("e").alias("energy"), (F.count_if(F.col("y") > 0) / F.count(F.lit(1))).alias("linearity"), F.round(F.stddev_pop("z") / 60, 9).alias("transverse_rms"),
        F.round(F.max("e") / F.sum("e"), 9).alias("normalized_score"), F.round(F.avg("e") - 1.2, 9).alias("gain_per_mev"),
    )
    return light.suspicious_clusters(c.withColumn("assigned", F.col("cluster") % 3 > 0)).select("event_id", "cluster", "reasons")


_ENDS = f"(SELECT event_id, t_cluster_id AS cluster, sum(e) AS energy, arg_min([x, y, z], hit_row) AS p, arg_max([x, y, z], hit_row) AS q FROM {_LOADED} WHERE t_cluster_id >= 0 GROUP BY 1, 2)"
_UNIT = f"(SELECT *, [q[i] - p[i] for i in [1, 2, 3]] AS v, sqrt(list_sum([(q[i] - p[i]) ** 2 for i in [1, 2, 3]])) AS len FROM {_ENDS})"
_TPC_CENTERS = f"(SELECT event_id, t_cluster_id AS cluster, hit_tpc_id AS tpc, avg(y) AS yc, avg(z) AS zc FROM {_LOADED} WHERE t_cluster_id >= 0 AND hit_tpc_id IS NOT NULL GROUP BY 1, 2, 3)"
_SWAPS = f"""(WITH n AS (SELECT event_id, cluster, count(DISTINCT tpc) AS n FROM {_TPC_CENTERS} GROUP BY 1, 2), t AS (SELECT u.*, n.n FROM {_UNIT} u JOIN n ON n.event_id = u.event_id AND n.cluster = u.cluster),
  s AS (SELECT a.event_id, a.cluster AS a, b.cluster AS b, count(*) AS n, avg(sqrt((a.yc - b.yc) ** 2 + (a.zc - b.zc) ** 2)) AS yz FROM {_TPC_CENTERS} a JOIN {_TPC_CENTERS} b ON a.event_id = b.event_id AND a.tpc = b.tpc AND a.cluster < b.cluster GROUP BY 1, 2, 3)
  SELECT s.event_id, s.a, s.b, s.n AS shared, ta.n + tb.n - 2 * s.n AS other, least(ta.energy, tb.energy) / greatest(ta.energy, tb.energy, 1e-6) AS ratio, abs(list_sum([ta.v[i] * tb.v[i] for i in [1, 2, 3]])) / greatest(ta.len * tb.len, 1e-12) AS cosine, s.yz,
    least({", ".join(f"sqrt((ta.{i}[2] - tb.{k}[2]) ** 2 + (ta.{i}[3] - tb.{k}[3]) ** 2)" for i in "pq" for k in "pq")}) AS ends FROM s JOIN t ta ON ta.event_id = s.event_id AND ta.cluster = s.a JOIN t tb ON tb.event_id = s.event_id AND tb.cluster = s.b)"""


@query(
    "swap_candidates",
    f"SELECT event_id, a, b, round(5 * shared - 1.5 * other + 3 * ratio + 4 * cosine - 0.08 * yz - 0.04 * ends, 4) AS priority FROM {_SWAPS} WHERE ratio >= 0.5 AND shared >= 1 AND other <= 60 AND cosine >= cos(radians(60)) AND yz <= 200 AND ends <= 400",
)
def swap_candidates(spark, d):
    p = loaded(spark, d).withColumn("cluster", F.col("t_cluster_id")).where("cluster >= 0")
    # a cluster's line runs from its first hit to its last
    at = F.struct("x", "y", "z")
    t = p.groupBy("event_id", "cluster").agg(F.sum("e").alias("energy"), F.min_by(at, "hit_row").alias("p"), F.max_by(at, "hit_row").alias("q"))
    size = F.greatest(F.sqrt(sum(F.pow(F.col(f"q.{v}") - F.col(f"p.{v}"), 2) for v in "xyz")), F.lit(1e-6))
    t = t.select("event_id", "cluster", "energy", *[((F.col(f"q.{v}") - F.col(f"p.{v}")) / size).alias(f"d{v}") for v in "xyz"], *[F.col(f"{e}.{v}").alias(f"{v}{i}") for i, e in ((1, "p"), (2, "q")) for v in "yz"])
    c = p.where("hit_tpc_id IS NOT NULL").groupBy("event_id", "cluster", F.col("hit_tpc_id").alias("tpc")).agg(F.avg("y").alias("yc"), F.avg("z").alias("zc"))
    return spatial.swap_candidates(t, c, ["event_id"], angle=60.0, shared_yz=200.0, endpoint_yz=400.0, most_other=60).select("event_id", "a", "b", F.round("priority", 4).alias("priority"))


@query(
    "cluster_tpcs",
    f"SELECT event_id, t_cluster_id AS cluster, list_sort(list(DISTINCT hit_tpc_id)) AS tpcs FROM {_LOADED} WHERE t_cluster_id >= 0 AND hit_tpc_id IS NOT NULL GROUP BY 1, 2",
)
def cluster_tpcs(spark, d):
    return loaded(spark, d).where("t_cluster_id >= 0 AND hit_tpc_id IS NOT NULL").groupBy("event_id", F.col("t_cluster_id").alias("cluster")).agg(F.sort_array(F.collect_set("hit_tpc_id")).alias("tpcs"))


@query("energy_order", f"SELECT event_id, cluster, CAST(row_number() OVER (PARTITION BY event_id ORDER BY CASE WHEN cluster = -1 THEN 1 ELSE 0 END, energy DESC, cluster) - 1 AS INTEGER) AS position FROM (SELECT event_id, cluster, round(sum(e), 6) AS energy FROM {_P} WHERE cluster IS NOT NULL GROUP BY 1, 2)")
def energy_order(spark, d):
    c = points(spark, d).where("cluster IS NOT NULL").groupBy("event_id", "cluster").agg(F.round(F.sum("e"), 6).alias("energy"))
    return support.energy_order(c, ["event_id"], "cluster", "energy").drop("energy")


@query("compact_labels", f"SELECT p.event_id, p.hit_row, coalesce(k.c, -1) AS compact FROM {_P} p LEFT JOIN (SELECT event_id, cluster, CAST(row_number() OVER (PARTITION BY event_id ORDER BY cluster) - 1 AS INTEGER) AS c FROM {_P} WHERE cluster <> -1 GROUP BY 1, 2 HAVING count(*) >= 5) k ON k.event_id = p.event_id AND k.cluster = p.cluster")
def compact_labels(spark, d):
    return truth.compact_labels(points(spark, d), "cluster", ["event_id"], 5).select("event_id", "hit_row", "compact")


# ---------------------------------------------------------------- sinks
_SH = "(SELECT file_id, hit_row, arg_max({'t': t_0, 'c': t_cluster_id}, (greatest(coalesce(t_0, -1), -1), coalesce(t_cluster_id, -32768))) AS v FROM hits WHERE hit_row IS NOT NULL GROUP BY 1, 2)"


def shards(spark, d) -> DataFrame:
    h = table(spark, d, "hits").where("hit_row IS NOT NULL").groupBy("file_id", "hit_row").agg(F.max(F.struct(F.when(F.col("t_0") >= 0, F.col("t_0")).alias("t"), F.col("t_cluster_id").alias("c"))).alias("v"))
    return h.select("file_id", "hit_row", F.col("v.t").cast("double").alias("t0"), F.col("v.c").cast("int").alias("cluster_id"), F.lit(True).alias("ok"), F.lit(1).alias("shard_id"))


_SCATTER = f"(SELECT h.file_id, h.hit_row, CAST(CASE WHEN v.t >= 0 THEN v.t ELSE -1 END AS FLOAT) AS t0, CAST(coalesce(v.c, -1) AS SMALLINT) AS cluster_id FROM (SELECT DISTINCT file_id, hit_row FROM hits WHERE hit_row IS NOT NULL) h LEFT JOIN {_SH} s ON s.file_id = h.file_id AND s.hit_row = h.hit_row)"


@query("scatter", f"SELECT * FROM {_SCATTER}")
def scatter(spark, d):
    return sinks.scatter(table(spark, d, "hits").where("hit_row IS NOT NULL"), shards(spark, d), ["file_id"])


@query(
    "file_summary",
    """SELECT n.file_id, n_calib_hits, n_assigned, n_calib_hits - n_assigned AS n_unassigned, n_events FROM
(SELECT file_id, count(*) AS n_calib_hits, count(t) AS n_assigned FROM (SELECT file_id, hit_row, max(CASE WHEN t_0 >= 0 THEN t_0 END) AS t FROM hits WHERE hit_row IS NOT NULL GROUP BY 1, 2) GROUP BY 1) n
FULL JOIN (SELECT file_id, count(DISTINCT event_id) AS n_events FROM charge_events GROUP BY 1) e USING (file_id)""",
)
def file_summary(spark, d):
    status = table(spark, d, "charge_events").select("file_id", "event_id", F.lit(True).alias("ok"))
    s = sinks.file_summary(scatter(spark, d), status, ["file_id"], "1")
    return s.select("file_id", "n_calib_hits", "n_assigned", "n_unassigned", F.size("all_event_ids").cast("bigint").alias("n_events"))


@query(
    "final_from_prompt",
    f"""SELECT r.file_id, r.final_row, r.prompt_row, coalesce(s.t0, CAST(-1 AS FLOAT)) AS t0, coalesce(s.cluster_id, CAST(-1 AS SMALLINT)) AS cluster_id
FROM (SELECT DISTINCT file_id, ref_id AS final_row, hit_row AS prompt_row FROM event_hits WHERE hit_row IS NOT NULL AND file_id IS NOT NULL) r LEFT JOIN {_SCATTER} s ON s.file_id = r.file_id AND s.hit_row = r.prompt_row""",
)
def final_from_prompt(spark, d):
    fp = table(spark, d, "event_hits").where("hit_row IS NOT NULL AND file_id IS NOT NULL").select("file_id", F.col("ref_id").alias("final_row"), F.col("hit_row").alias("prompt_row")).distinct()
    return sinks.final_from_prompt(fp, scatter(spark, d), ["file_id"])


@query("overflow_counts", "SELECT l_returnflag, CAST(count_if(l_extendedprice > 32767) AS BIGINT) AS n_high, CAST(count_if(l_extendedprice < -32768) AS BIGINT) AS n_low, max(abs(l_extendedprice)) AS largest FROM lineitem GROUP BY 1")
def overflow_counts(spark, d):
    return sinks.overflow_counts(table(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag"])


_VOX = f"({_bin('x', -350, 350, 50)} * 20 + {_bin('y', -100, 100, 20)}) * 30 + {_bin('z', 400, 1000, 30)}"


@query(
    "training_samples",
    f"""WITH v AS (SELECT light_id, tpc, list(vox ORDER BY vox) AS voxels, list(energy ORDER BY vox) AS energies FROM (SELECT light_id, hit_tpc_id % 8 AS tpc, {_VOX} AS vox, round(sum(e), 6) AS energy FROM {_LOADED} GROUP BY 1, 2, 3) GROUP BY 1, 2),
w AS (SELECT DISTINCT w.wvfm_row, w.light_id, w.adc AS tpc, l.channel, w.ch, list_max(w.samples)::DOUBLE AS peak, f.file_id FROM {_W} w JOIN {_LUT} l ON l.adc = w.adc AND l.ch = w.ch JOIN (SELECT DISTINCT wvfm_row, file_id FROM wvfm) f ON f.wvfm_row = w.wvfm_row),
t AS (SELECT w.light_id, w.tpc, list(CASE WHEN m.dead THEN -10000 ELSE peak END ORDER BY channel, CASE WHEN m.dead THEN -10000 ELSE peak END) AS targets FROM w LEFT JOIN (SELECT DISTINCT file_id, adc, ch, dead FROM channel_mask WHERE dead) m ON m.file_id = w.file_id AND m.adc = w.tpc AND m.ch = w.ch GROUP BY 1, 2)
SELECT v.light_id, v.tpc, voxels, energies, targets FROM v JOIN t ON t.light_id = v.light_id AND t.tpc = v.tpc""",
)
def training_samples(spark, d):
    w = waveforms(spark, d)
    lut = w.select("adc", "ch").distinct().withColumn("channel", (F.row_number().over(Window.partitionBy("adc").orderBy("ch")) - 1).cast("int"))
    # a waveform's channel is dead where the mask of its own file says so
    w = w.join(table(spark, d, "wvfm").select("wvfm_row", "file_id").distinct(), "wvfm_row")
    h = loaded(spark, d).withColumn("tpc", F.col("hit_tpc_id") % 8)
    l = w.join(lut, ["adc", "ch"]).withColumn("tpc", F.col("adc"))
    pairs = h.select("light_id", "tpc").distinct()
    dead = table(spark, d, "channel_mask").where("dead")
    s = tables.training_samples(pairs, h, l, BOX, ["light_id", "tpc"], dead, mask_by=["file_id", "adc", "ch"])
    return s.select("light_id", "tpc", F.transform("voxels", lambda v: v["vox"]).alias("voxels"), F.transform("voxels", lambda v: F.round(v["energy"], 6)).alias("energies"), "targets")
