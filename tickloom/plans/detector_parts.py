"""Queries of smaller operators over the test tables: pulses, snapping, candidate lists, lines, and bookkeeping, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import arrays as A
from tickloom.operators import flash as fl
from tickloom.operators import gaps, spatial, support, truth
from tickloom.operators.geometry import ND
from tickloom.plans.detector import _LOADED, _THINNED, QUERIES, SQL, _not_nan, event_flashes, loaded, query
from tickloom.plans.detector_light import _CHL, _L0, TICKS, channel_light, light_table
from tickloom.session import table
from tickloom.sources import sinks, tables

__all__ = ["QUERIES", "SQL"]

PEAK = 20

# ---------------------------------------------------------------- pulses
_RANGE = f"range(0, {TICKS})"
_TEMPLATE = f"list_transform({_RANGE}, lambda j: CASE WHEN j >= 10 THEN exp(-(j - 10) / 8.0::DOUBLE) WHEN j > 7 THEN (j - 7) / 3.0::DOUBLE ELSE 0::DOUBLE END)"
_HEIGHT = f"(SELECT wvfm_row, greatest(list_max(actual), 0) AS h, list_position(actual, list_max(actual)) - 1 AS t FROM {_L0})"


@query("pulses", f"SELECT wvfm_row, round(list_sum(list_transform({_TEMPLATE}, lambda v: v * h / list_max({_TEMPLATE}))), 4) AS total, round(h, 4) AS peak FROM {_HEIGHT}")
def pulses(spark, d):
    h = light_table(spark, d).withColumn("h", support.clipped_peak(F.col("actual")))
    p = A.pulse(F.col("h"), A.default_template(TICKS, 10, 8.0))
    return h.withColumn("p", p).select("wvfm_row", F.round(A.asum(F.col("p")), 4).alias("total"), F.round(F.array_max("p"), 4).alias("peak"))


@query(
    "double_exponentials",
    f"SELECT wvfm_row, round(list_sum(list_transform({_RANGE}, lambda j: CASE WHEN j >= t THEN h * (0.7::DOUBLE * exp(-(j - t) / 3.0::DOUBLE) + 0.3::DOUBLE * exp(-(j - t) / 20.0::DOUBLE)) ELSE 0::DOUBLE END)), 3) AS total FROM {_HEIGHT}",
)
def double_exponentials(spark, d):
    h = light_table(spark, d).withColumn("h", support.clipped_peak(F.col("actual")))
    return h.select("wvfm_row", F.round(A.asum(A.double_exponential(F.col("h"), A.peak_tick(F.col("actual")), TICKS, 3.0, 20.0)), 3).alias("total"))


@query(
    "expanded_peaks",
    f"""SELECT wvfm_row, round(list_sum(list_transform({_RANGE}, lambda j: least(greatest(CASE WHEN j - t + 10 BETWEEN 0 AND {TICKS - 1} THEN h * {_TEMPLATE}[j - t + 11] ELSE 0::DOUBLE END, 0), 60780))), 3) AS total, CASE WHEN h > 0 THEN CAST(t AS BIGINT) ELSE 0 END AS tick FROM {_HEIGHT}""",
)
def expanded_peaks(spark, d):
    h = light_table(spark, d).withColumn("h", support.clipped_peak(F.col("actual")))
    e = A.expand_peak(F.col("h"), A.default_template(TICKS, 10, 8.0), A.peak_tick(F.col("actual")))
    return h.withColumn("e", e).select("wvfm_row", F.round(A.asum(F.col("e")), 3).alias("total"), A.peak_tick(F.col("e")).cast("bigint").alias("tick"))


# ---------------------------------------------------------------- snapping
_SNAPS = f"""(SELECT wvfm_row, actual, x.t0 FROM {_L0}, (SELECT unnest([0.0::DOUBLE, 3.5, 11, 19.5, 27]) AS t0) x)"""


def snaps(spark, d):
    return light_table(spark, d).select("wvfm_row", "actual", F.explode(F.array(*[F.lit(float(x)) for x in (0.0, 3.5, 11.0, 19.5, 27.0)])).alias("t0"))


def _best_tick(low: str, high: str) -> str:
    """SQL: the first tick of the highest value within bounds, NULL where these hold no tick."""
    some = f"list_filter({_RANGE}, lambda i: i >= {low} AND i <= {high})"
    return f"list_sort(list_transform({some}, lambda i: {{'v': -actual[i + 1], 'i': i}}))[1].i"


@query("snapped_backward", f"SELECT wvfm_row, t0, CAST(coalesce({_best_tick(f'greatest(floor(t0 + {PEAK} + 0.5) - 5, 0)', f'floor(t0 + {PEAK} + 0.5)')} - {PEAK}, t0) AS DOUBLE) AS snapped FROM {_SNAPS}")
def snapped_backward(spark, d):
    return snaps(spark, d).select("wvfm_row", "t0", A.snap_backward(F.col("actual"), F.col("t0"), 5, PEAK).cast("double").alias("snapped"))


@query(
    "snapped_both",
    f"SELECT wvfm_row, t0, CAST(greatest(0, least(25, coalesce({_best_tick(f'greatest(floor(t0 + {PEAK} + 0.5) - 4, 0)', f'floor(t0 + {PEAK} + 0.5) + 4')} - {PEAK}, t0))) AS DOUBLE) AS snapped FROM {_SNAPS}",
)
def snapped_both(spark, d):
    return snaps(spark, d).select("wvfm_row", "t0", A.snap_both(F.col("actual"), F.col("t0"), 4, PEAK, 25.0).cast("double").alias("snapped"))


@query("brightness", f"SELECT wvfm_row, t0, round(list_max(list_transform(list_filter({_RANGE}, lambda i: abs(i - floor(t0 + {PEAK} + 0.5)) <= 6), lambda i: actual[i + 1])), 4) + 0.0::DOUBLE AS light FROM {_SNAPS}")
def brightness(spark, d):
    return snaps(spark, d).select("wvfm_row", "t0", (F.round(A.brightness_at(F.col("actual"), F.col("t0"), 6, PEAK), 4) + 0.0).alias("light"))


# ---------------------------------------------------------------- candidate lists
_NEW = f"(SELECT light_id, tpc, list([t0] ORDER BY cand_id, t0) FILTER (t0 IS NOT NULL AND {_not_nan('t0')}) AS a FROM (SELECT DISTINCT cand_id, light_id, tpc, t0 FROM candidates WHERE light_id IS NOT NULL AND tpc IS NOT NULL) GROUP BY 1, 2)"


def _inserted(x: str) -> str:
    return f"CASE WHEN len(list_filter(acc, lambda v: abs(v - {x}) <= 5)) > 0 THEN acc ELSE list_sort(list_append(acc, {x})) END"


@query(
    "inserted_candidates",
    f"SELECT f.light_id, f.tpc, list_reduce(list_prepend(f.seeds, coalesce(t.a, [])), lambda acc, x: {_inserted('greatest(0::DOUBLE, least(800::DOUBLE, round_even(x[1], 0)))')}) AS seeds FROM {_THINNED} f JOIN {_NEW} t ON t.light_id = f.light_id AND t.tpc = f.tpc",
)
def inserted_candidates(spark, d):
    """Candidate times put into the flash seeds of their TPC one after the other, unless one is near already."""
    f = fl.thinned_seeds(event_flashes(spark, d).where("tpc IS NOT NULL"), ["light_id", "tpc"], ND)
    c = table(spark, d, "candidates").where("light_id IS NOT NULL AND tpc IS NOT NULL").select("cand_id", "light_id", "tpc", "t0").distinct()
    a = c.groupBy("light_id", "tpc").agg(F.transform(F.sort_array(F.collect_list(F.struct("cand_id", "t0"))), lambda s: s["t0"]).alias("a"))
    return f.join(a, ["light_id", "tpc"]).select("light_id", "tpc", gaps.merge_candidates(F.col("seeds"), F.col("a"), 5.0, 800.0).alias("seeds"))


# ---------------------------------------------------------------- lines
_LINE = f"""(SELECT event_id, cluster, p, q, lead(p) OVER w AS p2, lead(q) OVER w AS q2, lead(cluster) OVER w AS other FROM (SELECT event_id, t_cluster_id AS cluster, arg_min([x, y, z], hit_row) AS p, arg_max([x, y, z], hit_row) AS q
  FROM {_LOADED} WHERE t_cluster_id >= 0 GROUP BY 1, 2 HAVING count(*) > 1) WINDOW w AS (PARTITION BY event_id ORDER BY cluster))"""


def lines(spark, d):
    """Each cluster's line, from its first hit to its last, beside that of the event's next cluster."""
    from pyspark.sql import Window

    at = F.struct("x", "y", "z")
    c = loaded(spark, d).where("t_cluster_id >= 0").groupBy("event_id", F.col("t_cluster_id").alias("cluster")).agg(F.min_by(at, "hit_row").alias("p"), F.max_by(at, "hit_row").alias("q"), F.count(F.lit(1)).alias("n")).where("n > 1")
    w = Window.partitionBy("event_id").orderBy("cluster")
    c = c.select("event_id", "cluster", "p", "q", F.lead("p").over(w).alias("p2"), F.lead("q").over(w).alias("q2"), F.lead("cluster").over(w).alias("other")).where("other IS NOT NULL")
    return c, *[spatial.vec(*[f"{e}.{v}" for v in "xyz"]) for e in ("p", "q", "p2", "q2")]


def _dot(a: str, b: str) -> str:
    return "(" + " + ".join(f"{a}[{i}] * {b}[{i}]" for i in (1, 2, 3)) + ")"


_VECTORS = f"""(SELECT *, [u[2] * v[3] - u[3] * v[2], u[3] * v[1] - u[1] * v[3], u[1] * v[2] - u[2] * v[1]] AS n FROM (SELECT *, list_transform([1, 2, 3], lambda i: q[i] - p[i]) AS u, list_transform([1, 2, 3], lambda i: q2[i] - p2[i]) AS v,
  list_transform([1, 2, 3], lambda i: p[i] - p2[i]) AS w FROM {_LINE} WHERE other IS NOT NULL))"""


@query("line_angles", f"SELECT event_id, cluster, other, round(degrees(acos(least(1::DOUBLE, abs({_dot('u', 'v')}) / sqrt({_dot('u', 'u')} * {_dot('v', 'v')})))), 4) AS angle FROM {_VECTORS} WHERE {_dot('u', 'u')} * {_dot('v', 'v')} > 0")
def line_angles(spark, d):
    c, p, q, p2, q2 = lines(spark, d)
    return c.select("event_id", "cluster", "other", F.round(spatial.angle_deg(spatial.sub(q, p), spatial.sub(q2, p2)), 4).alias("angle")).where("angle IS NOT NULL")


@query("line_distances", f"SELECT event_id, cluster, other, round(abs({_dot('w', 'n')}) / sqrt({_dot('n', 'n')}), 4) AS distance FROM {_VECTORS} WHERE {_dot('n', 'n')} > 1e-18")
def line_distances(spark, d):
    c, p, q, p2, q2 = lines(spark, d)
    n = spatial.cross(spatial.sub(q, p), spatial.sub(q2, p2))
    return c.where(spatial.dot(n, n) > 1e-18).select("event_id", "cluster", "other", F.round(spatial.line_distance(p, spatial.sub(q, p), p2, spatial.sub(q2, p2)), 4).alias("distance"))


def _end_gap(x: str, p: str, q: str) -> str:
    """SQL: the distance of a point to a segment."""
    t = f"least(greatest(coalesce({_dot(f'list_transform([1, 2, 3], lambda i: {x}[i] - {p}[i])', f'list_transform([1, 2, 3], lambda i: {q}[i] - {p}[i])')} / nullif({_dot(f'list_transform([1, 2, 3], lambda i: {q}[i] - {p}[i])', f'list_transform([1, 2, 3], lambda i: {q}[i] - {p}[i])')}, 0), 0), 0), 1)"
    return f"list_transform([{t}], lambda t: sqrt(list_sum(list_transform([1, 2, 3], lambda i: ({x}[i] - {p}[i] - t * ({q}[i] - {p}[i])) ** 2))))[1]"


@query(
    "segment_distances",
    f"""SELECT event_id, cluster, other, round(CASE WHEN den > 1e-12 AND s BETWEEN 0 AND 1 AND t BETWEEN 0 AND 1 THEN least(ends, sqrt(list_sum(list_transform([1, 2, 3], lambda i: (w[i] + s * u[i] - t * v[i]) ** 2)))) ELSE ends END, 4) AS distance FROM
(SELECT *, (b * e - c * f) / nullif(den, 0) AS s, (a * e - b * f) / nullif(den, 0) AS t FROM (SELECT *, a * c - b * b AS den FROM (SELECT *, {_dot('u', 'u')} AS a, {_dot('u', 'v')} AS b, {_dot('v', 'v')} AS c, {_dot('u', 'w')} AS f, {_dot('v', 'w')} AS e,
  least({_end_gap('p', 'p2', 'q2')}, {_end_gap('q', 'p2', 'q2')}, {_end_gap('p2', 'p', 'q')}, {_end_gap('q2', 'p', 'q')}) AS ends FROM {_VECTORS})))""",
)
def segment_distances(spark, d):
    c, p, q, p2, q2 = lines(spark, d)
    return c.select("event_id", "cluster", "other", F.round(spatial.segment_distance(p, q, p2, q2), 4).alias("distance"))


BOX = [(-400.0, 400.0), (-150.0, 150.0), (300.0, 1100.0)]
_CUT = f"""(SELECT *, greatest({', '.join(f"coalesce(least(({a} - p[{i}]) / nullif(u[{i}], 0), ({b} - p[{i}]) / nullif(u[{i}], 0)), '-inf'::DOUBLE)" for i, (a, b) in enumerate(BOX, 1))}) AS lo,
  least({', '.join(f"coalesce(greatest(({a} - p[{i}]) / nullif(u[{i}], 0), ({b} - p[{i}]) / nullif(u[{i}], 0)), 'inf'::DOUBLE)" for i, (a, b) in enumerate(BOX, 1))}) AS hi FROM {_VECTORS})"""


@query(
    "lines_in_box",
    f"SELECT event_id, cluster, {', '.join(f'round(CASE WHEN ok THEN p[{i}] + lo * u[{i}] ELSE p[{i}] END, 3) + 0.0::DOUBLE AS {v}1, round(CASE WHEN ok THEN p[{i}] + hi * u[{i}] ELSE q[{i}] END, 3) + 0.0::DOUBLE AS {v}2' for i, v in enumerate('xyz', 1))} FROM (SELECT *, lo < hi AND abs(lo) < 1e300 AND abs(hi) < 1e300 AS ok FROM {_CUT})",
)
def lines_in_box(spark, d):
    c, p, q, _, _ = lines(spark, d)
    a, b = spatial.extended_to_box(p, q, BOX)
    return c.select("event_id", "cluster", *[(F.round(x, 3) + 0.0).alias(f"{v}{i}") for i, e in ((1, a), (2, b)) for v, x in zip("xyz", e)])


# ---------------------------------------------------------------- support
@query(
    "eligible_clusters",
    f"SELECT event_id, cluster, n AS n_tpcs, NOT shower AND (n = 1 OR cluster >= 5 OR kind = 'track') AS eligible FROM (SELECT event_id, t_cluster_id AS cluster, count(DISTINCT hit_tpc_id) AS n, t_cluster_id % 3 = 2 AS shower, ['track', 'cluster', 'em_shower'][CAST(t_cluster_id % 3 AS INTEGER) + 1] AS kind FROM {_LOADED} WHERE t_cluster_id >= 0 AND hit_tpc_id IS NOT NULL GROUP BY 1, 2)",
)
def eligible_clusters(spark, d):
    i = loaded(spark, d).where("t_cluster_id >= 0 AND hit_tpc_id IS NOT NULL").select("event_id", F.col("t_cluster_id").alias("cluster"), F.col("hit_tpc_id").alias("tpc")).distinct()
    kind = F.get(F.array(F.lit("track"), F.lit("cluster"), F.lit("em_shower")), (F.col("cluster") % 3).cast("int"))
    return support.eligible_clusters(i, ["event_id", "cluster"], "tpc", i.select("event_id", "cluster", kind.alias("label_type")).distinct(), split=5)


@query(
    "normalized_deltas",
    f"SELECT light_id, tpc, channel, round(CASE WHEN top > 0 THEN (light - 50) / top ELSE 0 END * greatest(0.25::DOUBLE, least(1::DOUBLE, sqrt(light / 400))), 7) AS score FROM (SELECT *, max(abs(light - 50)) OVER (PARTITION BY light_id, tpc) AS top FROM {_CHL})",
)
def normalized_deltas(spark, d):
    c = channel_light(spark, d).withColumns({"delta": F.col("light") - 50, "anchor": F.lit(400.0)})
    return support.normalized_delta(c, ["light_id", "tpc"], "delta", "light", "anchor").select("light_id", "tpc", "channel", F.round("score", 7).alias("score"))


# ---------------------------------------------------------------- tables and sinks
@query(
    "prompt_of_final",
    "SELECT f.final_row, coalesce(r.p, f.id) AS prompt_row FROM (SELECT DISTINCT ref_id AS final_row, event_id AS id FROM event_hits) f LEFT JOIN (SELECT ref_id, min(light_id) AS p FROM charge_light GROUP BY 1) r ON r.ref_id = f.final_row",
)
def prompt_of_final(spark, d):
    final = table(spark, d, "event_hits").select(F.col("ref_id").alias("final_row"), F.col("event_id").alias("id")).distinct()
    return truth.prompt_of_final(final, table(spark, d, "charge_light").select(F.col("ref_id").alias("final_row"), F.col("light_id").alias("prompt_row")))


@query(
    "move_summary",
    f"SELECT event_id, count(*) AS n_trials, CAST(count_if(e > 1) AS BIGINT) AS n_accepted, CAST(count_if(y > 0) AS BIGINT) AS n_vetoed, round(sum(CASE WHEN e > 1 THEN e ELSE 0 END), 5) AS energy_moved FROM {_LOADED} GROUP BY 1",
)
def move_summary(spark, d):
    m = loaded(spark, d).select("event_id", F.col("e").alias("energy"), (F.col("e") > 1).alias("accepted"), (F.col("y") > 0).alias("vetoed"))
    return sinks.move_summary(m, ["event_id"]).withColumn("energy_moved", F.round("energy_moved", 5))


@query(
    "overwritten_columns",
    "SELECT o_orderkey, CAST(coalesce(l.q, o_totalprice) AS DOUBLE) AS o_totalprice, o_orderstatus FROM orders o LEFT JOIN (SELECT l_orderkey, max(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) l ON l.l_orderkey = o.o_orderkey",
)
def overwritten_columns(spark, d):
    r = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_quantity").alias("o_totalprice"))
    out, _ = sinks.overwrite_columns(table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), r, ["o_orderkey"], ["o_totalprice"])
    return out


@query("looked_up", "SELECT hit_tpc_id, io_group, n, coalesce(CASE WHEN hit_tpc_id BETWEEN 0 AND 9 AND hit_tpc_id <> 4 THEN hit_tpc_id * 0.5::DOUBLE END, -1.0::DOUBLE) AS gain FROM (SELECT hit_tpc_id, io_group, count(*) AS n FROM hits GROUP BY 1, 2)")
def looked_up(spark, d):
    lut = tables.lookup_rows(spark, [(i,) for i in range(10)], [None if i == 4 else 0.5 * i for i in range(10)], ["hit_tpc_id"], "gain")
    h = table(spark, d, "hits").groupBy("hit_tpc_id", "io_group").agg(F.count(F.lit(1)).alias("n"))
    return tables.lookup(h, lut, ["hit_tpc_id"], "gain", -1.0).select("hit_tpc_id", "io_group", "n", "gain")


@query("scaled_targets", f"SELECT wvfm_row, round(list_sum(list_transform(actual, lambda v: v * 0.001::DOUBLE)), 6) + 0.0::DOUBLE AS total FROM {_L0}")
def scaled_targets(spark, d):
    s = light_table(spark, d).select(F.concat(F.array(F.col("wvfm_row").cast("double")), F.col("actual")).alias("targets"))
    t = tables.scaled_targets(s)  # nothing but the targets is read: the row's number travels as the first of them
    v = F.slice("targets", 2, TICKS)
    return t.select(F.round(F.get("targets", F.lit(0)) * 1000).cast("bigint").alias("wvfm_row"), (F.round(A.asum(v), 6) + 0.0).alias("total"))

