"""Queries of scans, models and the matching pipeline over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions import arrays as A
from tickloom.functions import scans
from tickloom.operators import components, geometry, light, metrics, spatial, truth
from tickloom.operators import flash as fl
from tickloom.operators.geometry import ND, TWO
from tickloom.operators.skew import broadcast_if_small, kept
from tickloom.plans.detector import _LOADED, QUERIES, SQL, event_flashes, loaded, query
from tickloom.plans.detector_light import _C, _D, _L, _L0, _P, _PAIRS, _TICK, _W, TICKS, channels, light_candidates, light_table, points, waveforms, well_formed
from tickloom.session import table
from tickloom.sources import sinks
from tickloom.stages import match as M
from tickloom.stages import models, pipeline

__all__ = ["QUERIES", "SQL"]

SEARCH, PEAK = 20, 20


def images(spark, d) -> DataFrame:
    zero = F.transform("actual", lambda _: F.lit(0.0))
    return light_table(spark, d).select("light_id", "tpc", "channel", F.col("model").alias("predicted"), zero.alias("base"), "actual", F.col("std").alias("variance")).dropDuplicates(["light_id", "tpc", "channel"])


_CELL = f"(SELECT light_id, tpc, channel, tick, any_value(a) AS a, any_value(m) AS m, any_value(s) AS s FROM {_TICK} GROUP BY 1, 2, 3, 4)"
_SHIFT = f"""(SELECT c.light_id, c.tpc, g.s0 AS t0, c.a, coalesce(p.m, 0) AS p, c.s FROM {_CELL} c CROSS JOIN (SELECT unnest(range(0, {SEARCH + 1})) AS s0) g
  LEFT JOIN {_CELL} p ON p.light_id = c.light_id AND p.tpc = c.tpc AND p.channel = c.channel AND p.tick = c.tick - g.s0)"""


@query("scan_unit", f"SELECT light_id, tpc, CAST(arg_min(t0, (round(v, 9), t0)) AS INTEGER) AS t0, round(sqrt(min(v)), 5) AS rms FROM (SELECT light_id, tpc, t0, avg((a - p) ** 2) AS v FROM {_SHIFT} GROUP BY 1, 2, 3) GROUP BY 1, 2")
def scan_unit(spark, d):
    return scans.scan_unit(images(spark, d), ["light_id", "tpc"], SEARCH).select("light_id", "tpc", "t0", F.round(F.sqrt("score"), 5).alias("rms"))


@query("scan_chi2", f"SELECT light_id, tpc, CAST(arg_min(t0, (round(v, 9), t0)) AS INTEGER) AS t0, round(min(v), 3) AS score FROM (SELECT light_id, tpc, t0, sum((least(p, 60780) - a) ** 2 / greatest(s, 1e-6)) AS v FROM {_SHIFT} GROUP BY 1, 2, 3) GROUP BY 1, 2")
def scan_chi2(spark, d):
    return scans.scan_chi2(images(spark, d), ["light_id", "tpc"], SEARCH).withColumn("score", F.round("score", 3))


_SMOOTH = f"(SELECT light_id, tpc, channel, tick, s, sum(a) OVER w / 5 AS a, sum(m) OVER w / 5 AS m FROM {_CELL} WINDOW w AS (PARTITION BY light_id, tpc, channel ORDER BY tick ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))"


@query(
    "scan_smoothed",
    f"""SELECT light_id, tpc, CAST(arg_min(t0, (round(v, 6), t0)) AS INTEGER) AS t0, round(min(v), 3) AS score FROM (SELECT c.light_id, c.tpc, g.s0 AS t0, avg((least(coalesce(p.m, 0), 60780) - c.a) ** 2 / greatest(c.s, 1e-6)) AS v
  FROM {_SMOOTH} c CROSS JOIN (SELECT unnest(range(0, {SEARCH + 1})) AS s0) g LEFT JOIN {_SMOOTH} p ON p.light_id = c.light_id AND p.tpc = c.tpc AND p.channel = c.channel AND p.tick = c.tick - g.s0 GROUP BY 1, 2, 3) GROUP BY 1, 2""",
)
def scan_smoothed(spark, d):
    return scans.scan_smoothed(images(spark, d), ["light_id", "tpc"], SEARCH).withColumn("score", F.round("score", 3))


@query(
    "scan_cosine",
    f"""SELECT light_id, tpc, round(max(CASE WHEN aa > 1e-9 AND bb > 0 THEN ab / sqrt(aa * bb) ELSE 0 END), 6) AS score FROM (SELECT light_id, tpc, t0, sum(p * greatest(a, 0) / s) AS ab, sum(p * p / s) AS aa, sum(greatest(a, 0) ** 2 / s) AS bb FROM {_SHIFT} GROUP BY 1, 2, 3) GROUP BY 1, 2""",
)
def scan_cosine(spark, d):
    return scans.scan_cosine(images(spark, d), ["light_id", "tpc"], SEARCH).select("light_id", "tpc", F.round("score", 6).alias("score"))


def _candidates(spark, d) -> DataFrame:
    return light_candidates(spark, d).where(f"t0 BETWEEN 0 AND {SEARCH}").select("light_id", F.col("tpc").cast("int").alias("tpc"), F.col("t0").cast("int").alias("t0")).distinct()


_MATRIX = f"(SELECT s.light_id, s.tpc, CAST(s.t0 AS INTEGER) AS t0, avg((least(p, 60780) - a) ** 2 / greatest(s.s, 1e-6)) AS loss FROM {_SHIFT} s SEMI JOIN {_C} c ON c.light_id = s.light_id AND c.tpc = s.tpc AND c.t0 = s.t0 GROUP BY 1, 2, 3)"


@query("loss_matrix", f"SELECT light_id, tpc, t0, round(loss, 5) AS loss FROM {_MATRIX}")
def loss_matrix(spark, d):
    i = images(spark, d).withColumn("cluster", F.lit(0))
    return scans.loss_matrix(i, _candidates(spark, d), ["light_id", "tpc"], "cluster").select("light_id", "tpc", "t0", F.round("loss", 5).alias("loss"))


@query("best_candidate", f"SELECT light_id, tpc, arg_min(t0, (loss, t0)) AS t0 FROM {_MATRIX} GROUP BY 1, 2")
def best_candidate(spark, d):
    i = images(spark, d).withColumn("cluster", F.lit(0))
    return scans.best_cells(scans.loss_matrix(i, _candidates(spark, d), ["light_id", "tpc"], "cluster"), ["light_id", "tpc"], "cluster").select("light_id", "tpc", "t0")


@query("overlay_samples")
def overlay_samples(spark, d):
    s = light_table(spark, d).select(F.col("wvfm_row").alias("sample_id"), "tpc", F.col("actual").alias("samples"))
    return models.overlay_samples(s, ["tpc"], 3, TICKS, 7, most_shift=20).select("tpc", "set_no", "source_count", F.round(F.array_max("samples"), 3).alias("peak"))


@query(
    "sampled_ranks",
    """WITH s AS (SELECT wvfm_row, round(list_max(actual), 4) AS peak FROM """ + _L0 + """), r AS (SELECT *, row_number() OVER (ORDER BY peak, wvfm_row) - 1 AS r, count(*) OVER () AS n FROM s)
SELECT wvfm_row, peak FROM r WHERE r IN (SELECT CAST(floor(i * (n - 1) / 199) AS BIGINT) FROM (SELECT unnest(range(0, 200)) AS i), (SELECT count(*) AS n FROM s))""",
)
def sampled_ranks(spark, d):
    s = table_ranks(spark, d)
    return models.evenly_ranked(s, "peak", "wvfm_row", 200)


def table_ranks(spark, d) -> DataFrame:
    return light_table(spark, d).select("wvfm_row", F.round(F.array_max("actual"), 4).alias("peak"))


def hits_in_tpcs(spark, d) -> DataFrame:
    return loaded(spark, d, ("hit_tpc_id",)).where("hit_tpc_id >= 0").select("event_id", "light_id", "hit_row", "x", "y", "z", "e", (F.col("hit_tpc_id") % 8).cast("int").alias("tpc"))


_CENTERS = "(SELECT unnest(range(0, 6)) AS channel)"


@query(
    "predicted_images",
    f"""SELECT event_id, t_cluster_id::INTEGER AS cluster, CAST(hit_tpc_id % 8 AS INTEGER) AS tpc, CAST(channel AS INTEGER) AS channel, round(least(sum(greatest(e, 0) * exp(-((y - (channel % 3 - 1) * 60) ** 2 + (tanh(z / 500) * 30 - CASE WHEN channel < 3 THEN -30 ELSE 30 END) ** 2) / 22500)) * 60, 60780), 4) AS peak
FROM {_LOADED}, {_CENTERS} WHERE hit_tpc_id >= 0 AND t_cluster_id >= 0 GROUP BY 1, 2, 3, 4""",
)
def predicted_images(spark, d):
    h = loaded(spark, d).where("hit_tpc_id >= 0 AND t_cluster_id >= 0").select("event_id", F.col("t_cluster_id").cast("int").alias("cluster"), (F.col("hit_tpc_id") % 8).cast("int").alias("tpc"), "x", "y", "z", "e")
    i = models.predict_images(h, ["event_id", "cluster"], lambda: models.LinearLight(6, TICKS, PEAK))
    return i.select("event_id", "cluster", "tpc", "channel", F.round(F.array_max("samples"), 4).alias("peak"))


RULES = M.rules_of("2x2", search=SEARCH, peak=PEAK, resolution=2.0, separation=1.0, half_window=4, overflow_adc=50.0, model_adc=50.0, least_channels=3, gate_channels=1)


def event_light(spark, d, hits: DataFrame) -> DataFrame:
    seeds = fl.merged_seeds(event_flashes(spark, d).where("tpc IS NOT NULL"), ["light_id", "tpc"], TWO)
    seeds = seeds.groupBy("light_id", (F.col("tpc") % 8).alias("tpc")).agg(F.sort_array(F.collect_set(F.rint(F.col("t0") % (SEARCH + 1)))).alias("seeds"))
    events = hits.select("event_id", "light_id").distinct()
    l = light_table(spark, d).join(seeds, ["light_id", "tpc"], "left").join(events, "light_id")
    return l.select("event_id", "tpc", "channel", F.col("actual").alias("samples"), F.transform("actual", lambda _: F.lit(400.0)).alias("variance"), "seeds")


@query("match_2x2")
def match_2x2(spark, d):
    o = pipeline.Options("2x2", grow=True, colocate=True, rescue=True, expand=True, iters=1200, rules=RULES, eps=30.0, reach=8.0)
    h = kept(hits_in_tpcs(spark, d))
    return pipeline.match(h, event_light(spark, d, h), o, lambda: models.LinearLight(6, TICKS, PEAK))


#: TPCs of the larger detector and channels of each.
ND_TPCS, ND_CHANNELS = 70, 120
ND_RULES = M.rules_of("nd", search=SEARCH, peak=PEAK, resolution=2.0, separation=1.0, half_window=4, overflow_adc=50.0, model_adc=50.0, least_channels=3, gate_channels=1)


def nd_hits(spark, d) -> DataFrame:
    return loaded(spark, d, ("hit_tpc_id",)).where(F.col("hit_tpc_id").between(0, ND_TPCS - 1)).select("event_id", "light_id", "hit_row", "x", "y", "z", "e", F.col("hit_tpc_id").cast("int").alias("tpc"))


def nd_light(spark, d, hits: DataFrame) -> DataFrame:
    """Waveforms of each event by adc and channel, and a row with channel -1 for the seeds of a TPC.

    Light of all TPCs that have hits, 120 channels each, is made of these few waveforms in the task
    that matches the event (``pipeline.repeated``), not before: it is some hundred times as large.
    Waveforms are shuffled once, as they are stored: what is made of them is made where their event is.
    Of several of one light event and channel the first row counts.
    """
    seeds = fl.merged_seeds(event_flashes(spark, d).where("tpc IS NOT NULL"), ["light_id", "tpc"], ND)
    seeds = seeds.groupBy("light_id", "tpc").agg(F.sort_array(F.collect_set(F.rint(F.col("t0") % (SEARCH + 1)))).alias("seeds"))
    events = hits.select("event_id", "light_id").distinct()
    w = well_formed(spark, d)
    lut = kept(channels(w).where("adc IS NOT NULL AND ch IS NOT NULL"))
    per = lut.groupBy(F.col("adc").alias("tpc")).agg((F.max("channel") + 1).alias("every"))  # one row an adc
    adcs = per.agg(F.sort_array(F.collect_list("tpc")).alias("adcs"))  # one row
    have = w.join(broadcast_if_small(lut), ["adc", "ch"]).select("light_id", F.col("adc").alias("tpc"), "channel", "wvfm_row", F.col("samples").alias("_s"))
    rows = have.unionByName(seeds.select("light_id", F.col("tpc").cast("int").alias("tpc"), F.lit(-1).alias("channel"), "seeds"), allowMissingColumns=True)
    rows = rows.join(broadcast_if_small(events), "light_id").select("event_id", "tpc", "channel", "wvfm_row", "_s", "seeds").repartition("event_id")
    once = rows.groupBy("event_id", "tpc", "channel").agg(F.min_by(F.struct("_s"), F.coalesce("wvfm_row", F.lit(0))).alias("_r"), F.first("seeds").alias("seeds"))
    laid = once.join(F.broadcast(per), "tpc", "left").crossJoin(F.broadcast(adcs))
    return laid.select("event_id", "tpc", "channel", A.baseline_subtracted(F.col("_r._s"), 12).alias("samples"), "every", "adcs", F.lit(400.0).alias("noise"), "seeds")


def matched_nd(spark, d, **options) -> DataFrame:
    o = pipeline.Options("nd", iters=800, rules=ND_RULES, eps=30.0, reach=8.0, **options)
    h = kept(nd_hits(spark, d))
    return pipeline.match(h, nd_light(spark, d, h), o, lambda: models.LinearLight(ND_CHANNELS, TICKS, PEAK))


@query("match_nd")
def match_nd(spark, d):
    return pipeline.status(matched_nd(spark, d, rescue=True, absorb=True, expand=True))


@query("family_expand_nd")
def family_expand_nd(spark, d):
    """Hits by the stage that gave their cluster its time, where families take over clusters that were left without one."""
    return by_stage(matched_nd(spark, d, expand=True))


@query("region_grow_nd")
def region_grow_nd(spark, d):
    """The same where regions grow from tracks and well-matched clusters; settled times stay."""
    return by_stage(matched_nd(spark, d, grow=True))


@query("beam_nd")
def beam_nd(spark, d):
    """The same where the small clusters of a TPC are placed together by a beam, as in older versions."""
    return by_stage(matched_nd(spark, d, beam=True))


def by_stage(result: DataFrame) -> DataFrame:
    return result.groupBy("event_id", "stage").agg(F.count(F.lit(1)).alias("n_hits"), F.count_if(F.col("t0") >= 0).alias("n_matched"), F.count_distinct("cluster_id").alias("n_clusters"))


_MOVES = f"(SELECT DISTINCT event_id, t_0 AS seq, CASE WHEN t_0 % 2 = 0 THEN 'a spatial' ELSE 'b light' END AS kind FROM {_LOADED} WHERE hit_tpc_id >= 0 AND t_0 >= 0)"


@query(
    "move_relabel",
    f"""SELECT h.event_id, h.hit_row, CAST(coalesce(t.top + m.n, h.hit_tpc_id % 8) AS INTEGER) AS cluster_id FROM {_LOADED} h JOIN (SELECT event_id, max(hit_tpc_id % 8) AS top FROM {_LOADED} WHERE hit_tpc_id >= 0 GROUP BY 1) t ON t.event_id = h.event_id
LEFT JOIN (SELECT event_id, seq, row_number() OVER (PARTITION BY event_id ORDER BY kind, seq) AS n FROM {_MOVES}) m ON m.event_id = h.event_id AND m.seq = h.t_0 WHERE h.hit_tpc_id >= 0""",
)
def move_relabel(spark, d):
    h = loaded(spark, d).where("hit_tpc_id >= 0").select("event_id", "hit_row", (F.col("hit_tpc_id") % 8).cast("int").alias("cluster_id"), "t_0")
    # all hits of one time are one move
    moves = h.where("t_0 >= 0").groupBy("event_id", F.col("t_0").alias("seq")).agg(F.sort_array(F.collect_list("hit_row")).alias("hits")).withColumn("kind", F.when(F.col("seq") % 2 == 0, F.lit("a spatial")).otherwise(F.lit("b light")))
    return sinks.move_relabel(h.drop("t_0"), moves, ["event_id"])


# ---------------------------------------------------------------- evaluation and smaller operators
@query(
    "cluster_evaluation",
    f"""SELECT event_id, cluster, n_hits, round(energy, 5) AS energy, reco, round(truth, 4) AS truth, coalesce(abs(reco - truth) <= 10, false) AS correct FROM (SELECT event_id, t_cluster_id AS cluster, count(*) AS n_hits, sum(e) AS energy,
  median(CASE WHEN t_0 >= 0 THEN t_0::DOUBLE END) AS reco, sum(x * e) / sum(e) AS truth FROM {_LOADED} GROUP BY 1, 2)""",
)
def cluster_evaluation(spark, d):
    h = loaded(spark, d).withColumn("cluster", F.col("t_cluster_id")).withColumn("t0", F.col("t_0").cast("double"))
    c = metrics.cluster_evaluation(h, ["event_id", "cluster"], "t0", "x", "e", 10.0)
    return c.withColumn("energy", F.round("energy", 5)).withColumn("truth", F.round("truth", 4))


@query(
    "interaction_success",
    f"SELECT hit_tpc_id, round_even(z / 50, 0) AS interaction, count(*) AS n_hits, round(sum(e), 5) AS energy, count_if(y > 0) / count(*) AS hit_share, round(sum(CASE WHEN y > 0 THEN e ELSE 0 END) / sum(e), 7) AS energy_share FROM {_LOADED} WHERE e > 0 GROUP BY 1, 2",
)
def interaction_success(spark, d):
    s = metrics.interaction_success(loaded(spark, d).where("e > 0"), ["hit_tpc_id"], "z", F.col("y") > 0, "e", 50.0)
    return s.withColumn("energy", F.round("energy", 5)).withColumn("energy_share", F.round("energy_share", 7))


@query(
    "event_rollup",
    f"SELECT event_id, count(*) AS n_groups, median(share) AS median_share, CAST(count_if(share < 0.4) AS BIGINT) AS n_below FROM (SELECT event_id, t_cluster_id, count_if(y > 0) / count(*) AS share FROM {_LOADED} GROUP BY 1, 2) GROUP BY 1",
)
def event_rollup(spark, d):
    g = metrics.group_success(loaded(spark, d), ["event_id", "t_cluster_id"], F.col("y") > 0, "e")
    return metrics.event_rollup(g, ["event_id"], "hit_share", 0.4)


@query(
    "cluster_state",
    f"""SELECT event_id, t_cluster_id, count(*) AS n_hits, round(sum(e), 5) AS energy, median(t) AS t0, max(t) - min(t) <= 0.001 AS uniform, count(t) AS n_assigned FROM (SELECT *, CASE WHEN t_0 >= 0 THEN t_0::DOUBLE END AS t FROM {_LOADED}) GROUP BY 1, 2 HAVING count(*) >= 3""",
)
def cluster_state(spark, d):
    s = metrics.cluster_state(loaded(spark, d).withColumn("t", F.col("t_0").cast("double")), ["event_id", "t_cluster_id"], "t", "e", 3)
    return s.withColumn("energy", F.round("energy", 5))


@query(
    "assignment_audit",
    f"""WITH l AS (SELECT event_id, t_cluster_id AS cluster, max(hit_row) AS seq, arg_max(e, hit_row) AS energy, arg_max(e > 1, hit_row) AS assigned FROM {_LOADED} WHERE t_cluster_id IS NOT NULL GROUP BY 1, 2)
SELECT event_id, cluster, seq, energy, assigned, row_number() OVER (PARTITION BY event_id ORDER BY assigned DESC, energy DESC, cluster) AS position FROM l""",
)
def assignment_audit(spark, d):
    h = loaded(spark, d).where("t_cluster_id IS NOT NULL").select("event_id", F.col("t_cluster_id").alias("cluster"), F.col("hit_row").alias("seq"), F.col("e").alias("energy"), (F.col("e") > 1).alias("assigned"), F.col("t_0").cast("double").alias("t0"))
    return metrics.assignment_audit(h.drop("t0"), h, ["event_id"]).select("event_id", "cluster", "seq", "energy", "assigned", F.col("position").cast("bigint").alias("position"))


@query(
    "mixed_time_pairs",
    f"""SELECT event_id, ta, tb, n_pairs, CAST(rank AS INTEGER) AS rank FROM (SELECT event_id, ta, tb, count(*) AS n_pairs, row_number() OVER (PARTITION BY event_id ORDER BY count(*) DESC, ta, tb) AS rank FROM
  (SELECT a.event_id, a.t AS ta, b.t AS tb FROM (SELECT *, t_0::DOUBLE AS t FROM {_LOADED} WHERE t_0 >= 0) a JOIN (SELECT *, t_0::DOUBLE AS t FROM {_LOADED} WHERE t_0 >= 0) b ON a.event_id = b.event_id AND b.t - a.t >= 1 AND abs(a.x - b.x) <= 12 AND {_D} <= 12) GROUP BY 1, 2, 3) WHERE rank <= 24""",
)
def mixed_time_pairs(spark, d):
    h = loaded(spark, d).withColumn("t", F.col("t_0").cast("double"))
    return spatial.mixed_time_pairs(h, "hit_row", "t", ["event_id"], 12.0).drop("n_hits")


_RHO = f"(SELECT p.event_id, p.hit_row, p.x, p.y, p.z, p.cluster, coalesce(round(r.rho, 9), 0) AS rho FROM {_P} p LEFT JOIN (SELECT event_id, a, sum((1 + 0.25 * ln(1 + greatest(eb, 0))) * exp(-dist * dist / 18)) AS rho FROM (SELECT *, row_number() OVER (PARTITION BY event_id, a ORDER BY dist, b) AS r FROM {_PAIRS}) WHERE r <= 16 GROUP BY 1, 2) r ON r.event_id = p.event_id AND r.a = p.hit_row)"


def density(spark, d) -> DataFrame:
    """Local densities, rounded, so that densities alike are ties in any order of summation."""
    return spatial.local_density(points(spark, d), "e", "hit_row", r=12.0, by=["event_id"]).withColumn("rho", F.round("rho", 9))


@query(
    "density_seeds",
    f"""WITH p AS MATERIALIZED (SELECT * FROM {_RHO}), h AS MATERIALIZED (SELECT p.* FROM p JOIN (SELECT event_id, quantile_cont(rho, 0.8) AS q FROM p GROUP BY 1) c ON c.event_id = p.event_id WHERE rho >= q)
SELECT event_id, hit_row, CAST(r AS INTEGER) AS rank FROM (SELECT a.*, row_number() OVER (PARTITION BY event_id ORDER BY rho DESC, hit_row) AS r FROM h a WHERE NOT EXISTS (SELECT 1 FROM h b WHERE a.event_id = b.event_id AND a.hit_row <> b.hit_row AND (b.rho > a.rho OR (b.rho = a.rho AND b.hit_row < a.hit_row)) AND {_D} <= 8)) WHERE r <= 12""",
)
def density_seeds(spark, d):
    return spatial.density_seeds(density(spark, d), points(spark, d), "hit_row", ["event_id"])


@query(
    "promoted_islands",
    f"""WITH RECURSIVE p AS MATERIALIZED (SELECT * FROM {_RHO}), e AS MATERIALIZED (SELECT event_id, a, b FROM {_PAIRS} WHERE ca = 7 AND cb = 7),
r(event_id, node, root) AS (SELECT event_id, hit_row, hit_row FROM p WHERE cluster = 7 UNION SELECT e.event_id, e.b, r.root FROM r JOIN e ON e.event_id = r.event_id AND e.a = r.node WHERE r.root < e.b),
c AS MATERIALIZED (SELECT event_id, node, min(root) AS island FROM r GROUP BY 1, 2), good AS (SELECT c.event_id, c.island FROM c JOIN p ON p.event_id = c.event_id AND p.hit_row = c.node JOIN (SELECT event_id, quantile_cont(rho, 0.45) AS q FROM p GROUP BY 1) q ON q.event_id = c.event_id
  GROUP BY 1, 2, q.q HAVING count(*) >= 2 AND round(avg(p.rho), 9) >= q.q)
SELECT c.event_id, c.node AS hit_row, c.island FROM c SEMI JOIN good g ON g.event_id = c.event_id AND g.island = c.island""",
)
def promoted_islands(spark, d):
    return components.promoted_islands(points(spark, d), density(spark, d), "hit_row", "cluster", ["event_id"], 12.0, 2, noise=7)


@query(
    "event_peak",
    f"SELECT light_id, CAST(-(m).t AS INTEGER) AS tick, CAST(-(m).c AS INTEGER) AS channel, (m).v AS value FROM (SELECT light_id, max({{'v': list_max(samples)::DOUBLE, 'c': -(adc * 100 + ch), 't': -(list_position(samples, list_max(samples)) - 1)}}) AS m FROM {_W} GROUP BY 1)",
)
def event_peak(spark, d):
    return light.event_peak(waveforms(spark, d).withColumn("channel", F.col("adc") * 100 + F.col("ch")), ["light_id"])


@query(
    "formatted_light",
    f"SELECT light_id, tpc, channel, round(CASE WHEN tpc = 3 AND ch > 40 THEN 0 ELSE list_max(actual) END, 3) + 0.0::DOUBLE AS peak FROM {_L0}",
)
def formatted_light(spark, d):
    w = waveforms(spark, d)
    c = w.select("adc", "ch").distinct().select("adc", "ch", F.col("adc").alias("tpc"), F.lit(0).alias("side"), F.col("ch").alias("y_rel"))
    dead = w.where("adc = 3 AND ch > 40").select("adc", "ch").distinct()
    f = geometry.formatted_light(w, geometry.channel_order(c), ["light_id"], dead, 12)
    return f.select("light_id", "tpc", "channel", (F.round(F.array_max("samples"), 3) + 0.0).alias("peak"))


@query(
    "filled_channels",
    f"""SELECT e.light_id, e.tpc, c.channel, coalesce(round(list_max(p.actual), 3), 0) AS peak FROM (SELECT DISTINCT light_id, tpc FROM {_L0} WHERE channel % 2 = 0) e JOIN (SELECT DISTINCT tpc, channel FROM {_L0}) c ON c.tpc = e.tpc
LEFT JOIN (SELECT light_id, tpc, channel, any_value(actual) AS actual FROM {_L0} WHERE channel % 2 = 0 GROUP BY 1, 2, 3) p ON p.light_id = e.light_id AND p.tpc = e.tpc AND p.channel = c.channel""",
)
def filled_channels(spark, d):
    l = light_table(spark, d)
    patch = l.where("channel % 2 = 0").select("light_id", "tpc", "channel", F.col("actual").alias("samples")).dropDuplicates(["light_id", "tpc", "channel"])
    f = geometry.fill_channels(patch, l, ["light_id"], TICKS)
    return f.select("light_id", "tpc", "channel", F.round(F.array_max("samples"), 3).alias("peak"))


@query(
    "added_images",
    f"""WITH l AS MATERIALIZED (SELECT light_id, tpc, channel, any_value(actual) AS a, any_value(model) AS m FROM {_L} GROUP BY 1, 2, 3), k AS (SELECT unnest(range(0, {TICKS})) AS tick)
SELECT light_id, tpc, channel, round(max(v), 3) AS peak FROM (SELECT light_id, tpc, channel, tick, greatest(0, least(60780, sum(v))) AS v FROM (SELECT light_id, tpc, channel, tick, abs(a[tick + 1]) AS v FROM l, k
  UNION ALL SELECT l.light_id, l.tpc, l.channel, k.tick, coalesce(CASE WHEN k.tick - c.t0 BETWEEN 0 AND {TICKS - 1} THEN l.m[CAST(k.tick - c.t0 AS INTEGER) + 1] END, 0) FROM l JOIN {_C} c ON c.light_id = l.light_id AND c.tpc = l.tpc, k) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3""",
)
def added_images(spark, d):
    l = light_table(spark, d).dropDuplicates(["light_id", "tpc", "channel"])
    base = l.select("light_id", "tpc", "channel", F.transform("actual", lambda v: F.abs(v)).alias("samples"))
    img = l.join(light_candidates(spark, d).withColumn("tpc", F.col("tpc").cast("int")), ["light_id", "tpc"]).select("light_id", "tpc", "channel", F.col("model").alias("samples"), "t0")
    return light.add_images(base, img, ["light_id", "tpc"]).select("light_id", "tpc", "channel", F.round(F.array_max("samples"), 3).alias("peak"))


@query(
    "waveform_pairs",
    f"""WITH l AS MATERIALIZED (SELECT light_id, tpc, channel, any_value(actual) AS a, list_max(any_value(model)) AS m FROM {_L} GROUP BY 1, 2, 3),
t AS (SELECT light_id, tpc, arg_max(list_position(a, list_max(a)) - 1, (list_max(a), -channel, -list_position(a, list_max(a)))) AS tick FROM l GROUP BY 1, 2)
SELECT l.light_id, l.tpc, l.channel, round(greatest(0, least(60780, m)), 3) AS peak, CAST(CASE WHEN m > 0 THEN t.tick ELSE 0 END AS INTEGER) AS tick FROM l JOIN t ON t.light_id = l.light_id AND t.tpc = l.tpc""",
)
def waveform_pairs(spark, d):
    l = light_table(spark, d).dropDuplicates(["light_id", "tpc", "channel"]).select("light_id", "tpc", "channel", F.col("actual").alias("samples"), F.array_max("model").alias("peak"))
    p = light.waveform_pairs(l, A.default_template(TICKS, 10, 8.0), ["light_id", "tpc"])
    return p.select("light_id", "tpc", "channel", F.round(F.array_max("predicted"), 3).alias("peak"), A.peak_tick(F.col("predicted")).cast("int").alias("tick"))


@query(
    "light_event_of",
    """SELECT DISTINCT e.event_id, coalesce(r.light_id, i.light_id, l.light_id) AS light_id FROM (SELECT DISTINCT event_id, event_id % 300 AS row FROM charge_events) e
LEFT JOIN (SELECT event_id, arg_min(light_id, ref_id) AS light_id FROM charge_light WHERE event_id IS NOT NULL AND light_id IS NOT NULL GROUP BY 1) r ON r.event_id = e.event_id
LEFT JOIN (SELECT DISTINCT light_id FROM light_events) i ON i.light_id = e.event_id LEFT JOIN (SELECT light_id % 300 AS row, min(light_id) AS light_id FROM light_events GROUP BY 1) l ON l.row = e.row""",
)
def light_event_of(spark, d):
    c = table(spark, d, "charge_events").select("event_id", (F.col("event_id") % 300).alias("row")).distinct()
    l = table(spark, d, "light_events").select("light_id", (F.col("light_id") % 300).alias("row"))
    return truth.light_event_of(c, l, table(spark, d, "charge_light"))
