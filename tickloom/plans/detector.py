"""Queries of the detector operators over the test tables, with their SQL.

Roles that the tables lack are played by others: a truth slot array is made of the line items of an
order (segment = part, fraction = discount), a segment's time is the part's price, and so on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import flash as fl
from tickloom.operators import gaps, geometry, metrics, truth
from tickloom.operators.geometry import ND, TWO
from tickloom.session import table
from tickloom.sources import sinks, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# ---------------------------------------------------------------- events and hits
@query(
    "events_with_light",
    "SELECT DISTINCT event_id FROM charge_events WHERE event_id IN (SELECT event_id FROM charge_light WHERE light_id IS NOT NULL AND light_id <> -1)",
)
def events_with_light(spark, d):
    return tables.list_events(table(spark, d, "charge_events"), table(spark, d, "charge_light"))


_CURRENT_HITS = "SELECT * FROM (SELECT DISTINCT * FROM hits) QUALIFY row_number() OVER (PARTITION BY hit_row ORDER BY ingest_ts DESC NULLS LAST, removed_ts DESC NULLS LAST) = 1"


def _not_nan(c: str) -> str:
    """SQL that DuckDB does not fold by file statistics, which know no NaN."""
    return f"CAST({c} AS VARCHAR) <> 'nan'"


_LOADED = f"""(SELECT r.event_id, l.light_id, h.* EXCLUDE (file_id) FROM (SELECT DISTINCT event_id, hit_row FROM event_hits WHERE event_id IS NOT NULL) r
  JOIN (SELECT * FROM ({_CURRENT_HITS}) WHERE removed_ts IS NULL AND x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL AND e IS NOT NULL AND {' AND '.join(_not_nan(c) for c in 'xyze')}) h ON h.hit_row = r.hit_row
  JOIN (SELECT event_id, arg_min(light_id, ref_id) AS light_id FROM charge_light WHERE light_id IS NOT NULL AND light_id <> -1 GROUP BY 1) l ON l.event_id = r.event_id)"""


def loaded(spark, d, columns: tuple[str, ...] | None = None) -> DataFrame:
    """Hits with their events; with ``columns`` only x, y, z, e and these are carried."""
    hits = table(spark, d, "hits").where("hit_row IS NOT NULL")
    if columns is not None:
        hits = hits.select("hit_row", "x", "y", "z", "e", *columns, "ingest_ts", "removed_ts")
    hits = tables.current_rows(hits, "hit_row").drop("file_id")
    return tables.load_events(hits, table(spark, d, "event_hits"), table(spark, d, "charge_light"), finite_only=True)


@query("load_events", f"SELECT event_id, light_id, count(*) AS n_hits, round(sum(e), 4) AS energy FROM {_LOADED} GROUP BY ALL")
def load_events(spark, d):
    return loaded(spark, d).groupBy("event_id", "light_id").agg(F.count(F.lit(1)).alias("n_hits"), F.round(F.sum("e"), 4).alias("energy"))


@query("missing_events", f"SELECT DISTINCT event_id FROM charge_events WHERE event_id NOT IN (SELECT event_id FROM {_LOADED})")
def missing_events(spark, d):
    return tables.missing_events(table(spark, d, "charge_events"), loaded(spark, d))


@query("hits_of_tpc", f"SELECT event_id, hit_tpc_id, count(*) AS n FROM {_LOADED} WHERE hit_tpc_id >= 0 AND io_group IN (2 * hit_tpc_id + 1, 2 * hit_tpc_id + 2) GROUP BY ALL")
def hits_of_tpc(spark, d):
    h = loaded(spark, d)
    return h.where(geometry.charge_tpc(F.col("io_group"), ND) == F.col("hit_tpc_id")).groupBy("event_id", "hit_tpc_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "charge_tpcs",
    "SELECT io_group, CASE WHEN io_group > 0 THEN CAST((io_group - 1) // 2 AS INTEGER) END AS nd, CASE WHEN io_group > 0 THEN io_group - 1 END AS two, count(*) AS n FROM hits GROUP BY ALL",
)
def charge_tpcs(spark, d):
    g = F.col("io_group")
    return table(spark, d, "hits").groupBy("io_group").agg(F.count(F.lit(1)).alias("n")).select("io_group", geometry.charge_tpc(g, ND).alias("nd"), geometry.charge_tpc(g, TWO).alias("two"), "n")


@query(
    "work_list",
    """SELECT file_id, event_id FROM (SELECT file_id, event_id, row_number() OVER (ORDER BY file_id, event_id) - 1 AS r
  FROM (SELECT DISTINCT file_id, event_id FROM charge_events WHERE file_id IS NOT NULL AND event_id IS NOT NULL)) WHERE r % 4 = 1""",
)
def work_list(spark, d):
    return sinks.work_list(table(spark, d, "charge_events"), "file_id", "event_id", 4, 1)


@query("not_done", "SELECT DISTINCT file_id, event_id FROM charge_events WHERE (file_id, event_id) NOT IN (SELECT (file_id, event_id) FROM charge_light WHERE event_id IS NOT NULL AND file_id IS NOT NULL)")
def not_done(spark, d):
    done = table(spark, d, "charge_light").select("file_id", "event_id", F.lit(True).alias("ok"))
    return sinks.not_done(table(spark, d, "charge_events").select("file_id", "event_id").distinct(), done, ["file_id", "event_id"])


@query("rows_by_index", "SELECT e.event_id AS pos, e.user_id AS c_custkey, c.c_name FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id")
def rows_by_index(spark, d):
    idx = table(spark, d, "events").select(F.col("event_id").alias("pos"), F.col("user_id").alias("c_custkey"))
    return truth.rows_by_index(idx, table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", "pos")


@query(
    "event_of_range",
    """SELECT p.hit_row AS probe_id, min(g.event_id) AS event_row FROM (SELECT DISTINCT hit_row FROM hits WHERE hit_row IS NOT NULL) p
  JOIN (SELECT event_id, min(hit_row) AS a, max(hit_row) + 1 AS b FROM event_hits WHERE hit_row > 0 AND event_id > 0 GROUP BY 1) g ON g.a <= p.hit_row AND p.hit_row < g.b GROUP BY 1""",
)
def event_of_range(spark, d):
    regions = table(spark, d, "event_hits").where("hit_row > 0 AND event_id > 0").groupBy(F.col("event_id").alias("event_row")).agg(F.min("hit_row").alias("start"), (F.max("hit_row") + 1).alias("stop"))
    probes = table(spark, d, "hits").where("hit_row IS NOT NULL").select(F.col("hit_row").alias("probe_id")).distinct().select("probe_id", F.col("probe_id").alias("lo"), F.col("probe_id").alias("hi"))
    return truth.event_of_range(probes, regions)


@query(
    "reference_time",
    f"""SELECT DISTINCT e.event_id, coalesce(CASE WHEN {_not_nan('e.unix_ts')} AND {_not_nan('e.unix_ts_usec')} THEN e.unix_ts * 1e9 + e.unix_ts_usec * 1e3 END, CASE WHEN NOT isnan(l.utime_ms[1]) THEN l.utime_ms[1] * 1e6 END) AS reference_ns
FROM charge_events e LEFT JOIN (SELECT event_id, arg_min(light_id, ref_id) AS light_id FROM charge_light WHERE event_id IS NOT NULL AND light_id IS NOT NULL GROUP BY 1) r ON r.event_id = e.event_id LEFT JOIN (SELECT light_id, min(utime_ms) AS utime_ms FROM light_events GROUP BY 1) l ON l.light_id = r.light_id""",
)
def reference_time(spark, d):
    refs = truth.first_match(table(spark, d, "charge_light"), "event_id", "light_id", "ref_id")
    lt = table(spark, d, "light_events").groupBy("light_id").agg(F.min("utime_ms").alias("utime_ms"))
    return truth.reference_time_ns(table(spark, d, "charge_events"), lt, refs).distinct()


@query("light_to_charge", "SELECT light_id, arg_min(event_id, ref_id) AS event_id FROM charge_light WHERE light_id IS NOT NULL AND event_id IS NOT NULL GROUP BY 1")
def light_to_charge(spark, d):
    return truth.first_match(table(spark, d, "charge_light"), "light_id", "event_id", "ref_id")


@query("hit_lists", "SELECT event_id, list_sort(list(DISTINCT hit_row)) AS hit_rows FROM event_hits WHERE event_id IS NOT NULL AND hit_row IS NOT NULL GROUP BY 1")
def hit_lists(spark, d):
    r = table(spark, d, "event_hits").where("event_id IS NOT NULL AND hit_row IS NOT NULL").select("event_id", "hit_row").distinct()
    return r.groupBy("event_id").agg(F.sort_array(F.collect_list("hit_row")).alias("hit_rows"))


@query(
    "shards_by_file",
    "SELECT split_part(list_last(string_split(path, '/')), '__ev', 1) AS file, count(*) AS shards, list_sort(list(path)) AS paths FROM shard_files WHERE path IS NOT NULL GROUP BY 1",
)
def shards_by_file(spark, d):
    return tables.shards_by_file(table(spark, d, "shard_files"))


# ---------------------------------------------------------------- truth
_BACKTRACK = "(SELECT l_orderkey AS hit_row, list(l_partkey ORDER BY l_linenumber) AS segment_ids, list(l_discount ORDER BY l_linenumber) AS fraction FROM lineitem GROUP BY 1)"
_BEST = """(SELECT l_orderkey AS hit_row, arg_max(l_partkey, (l_discount, -l_linenumber, -l_partkey)) AS segment_id FROM lineitem WHERE l_partkey >= 0 GROUP BY 1)"""


def backtrack(spark, d) -> DataFrame:
    slots = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_discount")))
    b = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("hit_row")).agg(slots.alias("s"))
    return b.select("hit_row", F.transform("s", lambda x: x["l_partkey"]).alias("segment_ids"), F.transform("s", lambda x: x["l_discount"]).alias("fraction"))


def segments(spark, d) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("segment_id"), F.col("p_retailprice").alias("t0"), F.col("p_size").cast("bigint").alias("vertex_id"))


@query("best_segment", f"SELECT * FROM {_BEST}")
def best_segment(spark, d):
    return truth.best_segment(backtrack(spark, d))


@query("first_segment", "SELECT l_orderkey AS hit_row, arg_min(l_partkey, (l_linenumber, l_partkey)) AS segment_id FROM lineitem WHERE l_partkey >= 0 GROUP BY 1")
def first_segment(spark, d):
    return truth.first_segment(backtrack(spark, d))


_RESIDUALS = f"""(SELECT o.o_orderkey AS hit_row, p.p_size AS vertex_id, (p.p_retailprice * 1000 - 160000.0) / 16 AS truth, (p.p_retailprice * 1000 - 160000.0) / 16 + (o.o_custkey % 41 - 20) AS reco, o.o_totalprice AS energy
  FROM orders o LEFT JOIN {_BEST} b ON b.hit_row = o.o_orderkey LEFT JOIN part p ON p.p_partkey = b.segment_id)"""


def residuals(spark, d) -> DataFrame:
    t = truth.truth_t0(backtrack(spark, d), segments(spark, d), F.lit(160000.0))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("hit_row"), "o_custkey", F.col("o_totalprice").alias("energy"))
    best = truth.best_segment(backtrack(spark, d)).join(segments(spark, d).select("segment_id", "vertex_id"), "segment_id")
    return o.join(t, "hit_row", "left").join(best.select("hit_row", "vertex_id"), "hit_row", "left").withColumnRenamed("truth_t0", "truth").withColumn("reco", F.col("truth") + (F.col("o_custkey") % 41 - 20))


_VALID = f"(SELECT *, (truth - reco) * 16 AS d FROM {_RESIDUALS} WHERE truth IS NOT NULL AND reco >= 0 AND energy > 0)"


def _quantile_sql(q: float, x: str, w: str, src: str, by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    return f"""(SELECT {by + ',' if by else ''} min(x) AS v FROM (SELECT {by + ',' if by else ''} {x} AS x, sum({w}) OVER ({part} ORDER BY {x} RANGE UNBOUNDED PRECEDING) AS cum, sum({w}) OVER ({part}) AS tot FROM {src}) WHERE cum >= {q} * tot * (1 - 1e-12) {'GROUP BY ' + by if by else ''})"""


@query(
    "truth_residual_summary",
    f"""SELECT count(*) AS n, round(sum(energy * d) / sum(energy), 4) AS mean_ns, round(sqrt(sum(energy * d * d) / sum(energy) - (sum(energy * d) / sum(energy)) ** 2), 4) AS std_ns,
  round(100 * sum(CASE WHEN abs(d) <= 160 THEN energy ELSE 0 END) / sum(energy), 6) AS within_pct,
  (SELECT v FROM {_quantile_sql(0.16, 'd', 'energy', _VALID)}) AS p16_ns, (SELECT v FROM {_quantile_sql(0.5, 'd', 'energy', _VALID)}) AS median_ns, (SELECT v FROM {_quantile_sql(0.84, 'd', 'energy', _VALID)}) AS p84_ns FROM {_VALID}""",
)
def truth_residual_summary(spark, d):
    s = metrics.residual_summary(residuals(spark, d), "truth", "reco", "energy")
    return s.select("n", F.round("mean_ns", 4).alias("mean_ns"), F.round("std_ns", 4).alias("std_ns"), F.round("within_pct", 6).alias("within_pct"), "p16_ns", "median_ns", "p84_ns")


@query(
    "weighted_quantiles",
    f"SELECT a.l_returnflag, a.v AS q10, b.v AS q50 FROM {_quantile_sql(0.1, 'l_extendedprice', 'l_quantity', 'lineitem', 'l_returnflag')} a JOIN {_quantile_sql(0.5, 'l_extendedprice', 'l_quantity', 'lineitem', 'l_returnflag')} b USING (l_returnflag)",
)
def weighted_quantiles(spark, d):
    return metrics.weighted_quantiles(table(spark, d, "lineitem"), "l_extendedprice", "l_quantity", {"q10": 0.1, "q50": 0.5}, ["l_returnflag"])


@query(
    "efficiency_by_energy_bin",
    f"""WITH r AS (SELECT abs(d) <= 160 AS ok, energy AS e, CASE WHEN energy >= 0 AND energy < 50000 THEN '0-50000' WHEN energy >= 50000 AND energy < 150000 THEN '50000-150000' WHEN energy >= 150000 AND energy < 300000 THEN '150000-300000' WHEN energy >= 300000 THEN '300000-inf' END AS bin FROM {_VALID})
SELECT coalesce(bin, 'all') AS bin, count(*) AS n, CAST(count_if(ok) AS BIGINT) AS n_ok, count_if(ok) / count(*) AS share, round(sum(CASE WHEN ok THEN e ELSE 0 END) / sum(e), 9) AS energy_share FROM r GROUP BY ROLLUP (bin)""",
)
def efficiency_by_energy_bin(spark, d):
    r = residuals(spark, d).where(metrics.valid_residual(F.col("truth"), F.col("reco"), F.col("energy")))
    out = metrics.success_by_bin(r, F.abs((F.col("truth") - F.col("reco")) * 16) <= 160, "energy", [0, 50000, 150000, 300000])
    return out.withColumn("energy_share", F.round("energy_share", 9))


@query(
    "vertex_success",
    f"SELECT vertex_id, count(*) AS n_hits, round(sum(energy), 2) AS energy, count_if(abs(d) <= 160) / count(*) AS hit_share, round(sum(CASE WHEN abs(d) <= 160 THEN energy ELSE 0 END) / sum(energy), 9) AS energy_share FROM (SELECT * REPLACE (CAST(vertex_id AS BIGINT) AS vertex_id) FROM {_VALID}) GROUP BY vertex_id",
)
def vertex_success(spark, d):
    r = residuals(spark, d).where(metrics.valid_residual(F.col("truth"), F.col("reco"), F.col("energy")))
    out = metrics.group_success(r, ["vertex_id"], F.abs((F.col("truth") - F.col("reco")) * 16) <= 160, "energy")
    return out.withColumn("energy", F.round("energy", 2)).withColumn("energy_share", F.round("energy_share", 9))


@query(
    "residual_histogram",
    f"SELECT CAST(least(floor((d + 200) / 5), 79) AS INTEGER) AS bin, round(sum(energy) / (SELECT sum(energy) FROM {_VALID}), 10) AS weight_share FROM {_VALID} WHERE d BETWEEN -200 AND 200 GROUP BY 1",
)
def residual_histogram(spark, d):
    r = residuals(spark, d).where(metrics.valid_residual(F.col("truth"), F.col("reco"), F.col("energy"))).withColumn("d", (F.col("truth") - F.col("reco")) * 16)
    return metrics.weighted_histogram(r, "d", "energy", -200, 200, 5).withColumn("weight_share", F.round("weight_share", 10))


@query(
    "relative_time",
    "SELECT event_id, user_id, round(value - min(value) OVER (PARTITION BY user_id), 6) AS t_rel FROM events",
)
def relative_time(spark, d):
    return truth.relative_time(table(spark, d, "events").select("event_id", "user_id", "value"), "value", ["user_id"]).select("event_id", "user_id", F.round("t_rel", 6).alias("t_rel"))


@query(
    "dominant_t0",
    """SELECT user_id, m AS mode, share FROM (SELECT user_id, round_even(value, 0) AS m, n / sum(n) OVER (PARTITION BY user_id) AS share, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, round_even(value, 0)) AS r
  FROM (SELECT user_id, value, n FROM (SELECT user_id, round_even(value, 0) AS value, count(*) AS n FROM events WHERE value >= 0 GROUP BY 1, 2))) WHERE r = 1""",
)
def dominant_t0(spark, d):
    return metrics.dominant_value(table(spark, d, "events"), ["user_id"], "value")


@query(
    "label_summary",
    """SELECT user_id, string_agg(event_type || ':' || n, ' ' ORDER BY r) AS summary FROM (SELECT user_id, event_type, n, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r
  FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)) WHERE r <= 3 GROUP BY 1""",
)
def label_summary(spark, d):
    return metrics.label_summary(table(spark, d, "events"), ["user_id"], "event_type", 3)


_CELLS = "SELECT CASE WHEN t_cluster_id >= 0 THEN t_cluster_id END AS r, hit_tpc_id AS t FROM hits WHERE hit_tpc_id >= 0"


@query(
    "contingency_metrics",
    f"""WITH c AS (SELECT r, t, count(*) AS n FROM ({_CELLS}) GROUP BY 1, 2), a AS (SELECT * FROM c WHERE r IS NOT NULL),
br AS (SELECT r, sum(n) AS n, max(n) AS top, count(*) AS k FROM a GROUP BY 1),
bt AS (SELECT t, sum(n) AS n, max(CASE WHEN r IS NOT NULL THEN n END) AS top, count(r) AS k, sum(CASE WHEN r IS NOT NULL THEN n END) AS m FROM c GROUP BY 1),
s AS (SELECT (SELECT sum(n) FROM a)::DOUBLE AS n, (SELECT sum(n::DOUBLE * (n - 1) / 2) FROM br) AS pa, (SELECT sum(m::DOUBLE * (m - 1) / 2) FROM bt) AS pb, (SELECT sum(n::DOUBLE * (n - 1) / 2) FROM a) AS pc)
SELECT round((SELECT sum(top) FROM br) / n, 4) AS purity, round((SELECT avg(coalesce(top, 0) / n) FROM bt), 4) AS efficiency, round((SELECT avg(CASE WHEN k >= 2 THEN 1.0::DOUBLE ELSE 0 END) FROM bt), 4) AS split_rate,
  round((SELECT avg(CASE WHEN k >= 2 THEN 1.0::DOUBLE ELSE 0 END) FROM br), 4) AS merge_rate, round((pc - pa * pb / (n * (n - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (n * (n - 1) / 2)), 4) AS ari,
  round((SELECT avg(CASE WHEN t_cluster_id < 0 THEN 1.0::DOUBLE ELSE 0 END) FROM hits), 4) AS noise_share FROM s""",
)
def contingency_metrics(spark, d):
    return metrics.contingency_metrics(table(spark, d, "hits"), "t_cluster_id", "hit_tpc_id")


@query(
    "multi_vertex_events",
    """SELECT user_id, count(*) AS n_vertices, CAST(sum(h) AS BIGINT) AS n_hits FROM (SELECT user_id, CAST(value AS INTEGER) AS v, count(*) AS h FROM (SELECT user_id, floor(value) AS value FROM events) GROUP BY 1, 2)
GROUP BY 1 HAVING count(*) >= 5 AND sum(h) >= 20 ORDER BY 2 DESC, 1 LIMIT 25""",
)
def multi_vertex_events(spark, d):
    return metrics.multi_vertex_events(table(spark, d, "events").select("user_id", F.floor("value").alias("v")), "user_id", "v", 5, 20, 25)


# ---------------------------------------------------------------- flashes
_TIME = "(hit_time_range[1] / 16 - 5)"
_GOOD = "len(hit_time_range) > 0 AND NOT isnan(hit_time_range[1])"


def flashes(spark, d) -> DataFrame:
    return table(spark, d, "flash").select("flash_id", "tpc", "hit_time_range", "tot_max", "n_sum_hits").distinct()


def event_flashes(spark, d) -> DataFrame:
    refs = table(spark, d, "light_flash").where("light_id IS NOT NULL AND light_id <> -1").select("light_id", "flash_id").distinct()
    return refs.join(flashes(spark, d), "flash_id")


_FLASHES = "(SELECT DISTINCT flash_id, tpc, hit_time_range, tot_max, n_sum_hits FROM flash)"
_EVENT_FLASHES = f"(SELECT DISTINCT r.light_id, f.* FROM light_flash r JOIN {_FLASHES} f ON f.flash_id = r.flash_id WHERE r.light_id IS NOT NULL AND r.light_id <> -1)"


@query("flash_info", f"SELECT light_id, tpc, flash_id, tot_max FROM {_EVENT_FLASHES}")
def flash_info(spark, d):
    return event_flashes(spark, d).select("light_id", "tpc", "flash_id", "tot_max")


@query(
    "flash_ticks",
    f"SELECT flash_id, {_TIME} AS two, ((hit_time_range[1] + coalesce(hit_time_range[2], hit_time_range[1])) / 2) / 16 - 5 AS nd, CASE WHEN tpc % 2 = 0 THEN tpc + 1 ELSE tpc - 1 END AS light_tpc FROM {_FLASHES} WHERE {_GOOD}",
)
def flash_ticks(spark, d):
    r = F.col("hit_time_range")
    f = flashes(spark, d).where((F.size(r) > 0) & ~F.isnan(F.get(r, F.lit(0))))
    return f.select("flash_id", geometry.flash_tick(r, TWO).alias("two"), geometry.flash_tick(r, ND).alias("nd"), geometry.light_to_charge_tpc(F.col("tpc"), ND).alias("light_tpc"))


@query("single_flash_strict", f"SELECT light_id, tpc FROM {_EVENT_FLASHES} GROUP BY 1, 2 HAVING count_if(n_sum_hits > 1) = 1")
def single_flash_strict(spark, d):
    return fl.single_flash_strict(event_flashes(spark, d), ["light_id", "tpc"])


@query(
    "single_flash_enhanced",
    f"SELECT light_id, tpc FROM {_EVENT_FLASHES} GROUP BY 1, 2 HAVING (count(*) = 1 AND max(n_sum_hits) > 1) OR (count(*) = 2 AND min(n_sum_hits) = 1 AND max(n_sum_hits) >= 3)",
)
def single_flash_enhanced(spark, d):
    return fl.single_flash_enhanced(event_flashes(spark, d), ["light_id", "tpc"])


@query(
    "single_flash_merged",
    f"""SELECT light_id, tpc, arg_min(flash_id, (a, flash_id)) AS flash_id FROM (SELECT *, CASE WHEN a - max(b) OVER (PARTITION BY light_id, tpc ORDER BY a, flash_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 81 THEN 1 ELSE 0 END AS gap
  FROM (SELECT *, hit_time_range[1] AS a, hit_time_range[2] AS b FROM {_EVENT_FLASHES} WHERE {_GOOD} AND tpc IS NOT NULL)) GROUP BY 1, 2 HAVING sum(gap) = 0""",
)
def single_flash_merged(spark, d):
    r = F.col("hit_time_range")
    f = event_flashes(spark, d).where((F.size(r) > 0) & ~F.isnan(F.get(r, F.lit(0))) & F.col("tpc").isNotNull()).withColumn("a", F.get(r, F.lit(0))).withColumn("b", F.get(r, F.lit(1)))
    return fl.single_flash_merged(f, ["light_id", "tpc"], "a", "b", "flash_id")


@query(
    "flash_count_histogram",
    f"""SELECT coalesce(n, 0) AS n_flashes, count(*) AS n_groups FROM (SELECT DISTINCT light_id FROM light_events WHERE light_id IS NOT NULL) l
LEFT JOIN (SELECT light_id, count(flash_id) AS n FROM {_EVENT_FLASHES} GROUP BY 1) f USING (light_id) GROUP BY 1""",
)
def flash_count_histogram(spark, d):
    groups = table(spark, d, "light_events").where("light_id IS NOT NULL").select("light_id").distinct()
    return fl.flash_count_histogram(groups, event_flashes(spark, d), ["light_id"], "flash_id")


def _islands_sql(src: str, by: str, x: str, gap: float) -> str:
    """SQL: rows of ``src`` with the number of the gap group of ``x``."""
    return f"""(SELECT *, CAST(sum(g) OVER (PARTITION BY {by} ORDER BY {x} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS gap_id FROM (SELECT *, CASE WHEN {x} - lag({x}) OVER (PARTITION BY {by} ORDER BY {x}) > {gap} THEN 1 ELSE 0 END AS g FROM {src}))"""


_SEEDS = f"(SELECT light_id, tpc, {_TIME} AS t FROM {_EVENT_FLASHES} WHERE {_GOOD} AND tpc IS NOT NULL AND coalesce(tot_max, 0) >= 0 AND {_TIME} BETWEEN 0 AND 700)"


@query("merged_seeds", f"SELECT light_id, tpc, median(t) AS t0 FROM {_islands_sql(_SEEDS, 'light_id, tpc', 't', 5)} GROUP BY light_id, tpc, gap_id")
def merged_seeds(spark, d):
    return fl.merged_seeds(event_flashes(spark, d).where("tpc IS NOT NULL"), ["light_id", "tpc"], TWO)


_ND_TIME = "(((hit_time_range[1] + coalesce(hit_time_range[2], hit_time_range[1])) / 2) / 16 - 5)"
_THINNED = f"""(SELECT light_id, tpc, list_reduce(list_prepend([]::DOUBLE[], list([t] ORDER BY t)), lambda acc, x: CASE WHEN len(acc) = 0 OR x[1] - acc[-1] > 5 THEN list_concat(acc, x) ELSE acc END) AS seeds
  FROM (SELECT DISTINCT light_id, tpc, greatest(0::DOUBLE, least(800::DOUBLE, floor(t + 0.5))) AS t FROM (SELECT light_id, tpc, {_ND_TIME} AS t FROM {_EVENT_FLASHES} WHERE {_GOOD} AND tpc IS NOT NULL) WHERE {_not_nan('t')}) GROUP BY 1, 2)"""


@query("thinned_seeds", f"SELECT * FROM {_THINNED}")
def thinned_seeds(spark, d):
    return fl.thinned_seeds(event_flashes(spark, d).where("tpc IS NOT NULL"), ["light_id", "tpc"], ND)


@query(
    "gap_groups",
    f"SELECT cand_id, CASE WHEN t0 IS NULL OR isnan(t0) OR t0 = -1 THEN -1 ELSE gap_id END AS gap_id FROM (SELECT cand_id, t0, gap_id FROM {_islands_sql('(SELECT DISTINCT cand_id, t0 FROM candidates WHERE t0 IS NOT NULL AND NOT isnan(t0) AND t0 <> -1)', '1', 't0', 0.05)}) UNION ALL SELECT DISTINCT cand_id, -1 FROM candidates WHERE t0 IS NULL OR isnan(t0) OR t0 = -1",
)
def gap_groups(spark, d):
    return gaps.gap_groups(table(spark, d, "candidates").select("cand_id", "t0").distinct(), "t0", 0.05).select("cand_id", "gap_id")


_CAND = "(SELECT DISTINCT cand_id, event_id, tpc, t0 FROM candidates WHERE event_id IS NOT NULL AND tpc IS NOT NULL AND t0 IS NOT NULL AND NOT isnan(t0) AND round_even(t0, 0) <> 0)"


@query("gap_medians", f"SELECT event_id, tpc, gap_id, round_even(median(t0), 0) AS center, count(*) AS n FROM {_islands_sql(_CAND, 'event_id, tpc', 't0', 5)} GROUP BY event_id, tpc, gap_id")
def gap_medians(spark, d):
    c = table(spark, d, "candidates").where("event_id IS NOT NULL AND tpc IS NOT NULL").select("cand_id", "event_id", "tpc", "t0").distinct()
    return gaps.gap_medians(c, "t0", 5, ["event_id", "tpc"], rounded=True, drop_zero=True)


_CTABLE = """(SELECT event_id, tpc, CASE WHEN abs(c - round_even(c, 0)) < 1e-6 THEN round_even(c, 0) ELSE c END AS t0, coalesce(bool_or(received), false) AS received
  FROM (SELECT *, greatest(0, least(800, t0)) AS c FROM candidates WHERE event_id IS NOT NULL AND tpc IS NOT NULL AND t0 IS NOT NULL AND NOT isnan(t0) AND round_even(t0, 0) <> 0 AND t0 BETWEEN 0 AND 800) GROUP BY 1, 2, 3)"""


def candidate_table(spark, d) -> DataFrame:
    return fl.candidate_table(table(spark, d, "candidates").where("event_id IS NOT NULL AND tpc IS NOT NULL"), ["event_id", "tpc"])


@query("candidate_rows", f"SELECT * FROM {_CTABLE}")
def candidate_rows(spark, d):
    return fl.candidate_rows(candidate_table(spark, d), ["event_id", "tpc"])


@query(
    "received_sources",
    f"SELECT event_id, tpc, round_even(median(t), 0) AS t0 FROM {_islands_sql(f'(SELECT DISTINCT event_id, tpc, round_even(t0, 0) AS t FROM {_CTABLE} WHERE received AND round_even(t0, 0) <> 0)', 'event_id, tpc', 't', 5)} GROUP BY event_id, tpc, gap_id",
)
def received_sources(spark, d):
    return fl.received_sources(candidate_table(spark, d), ["event_id", "tpc"])


@query(
    "mark_assignment",
    f"SELECT event_id, tpc, t0, received FROM {_CTABLE} WHERE abs(t0 - 300) > 50 UNION ALL SELECT DISTINCT event_id, tpc, 300.0::DOUBLE, true FROM {_CTABLE}",
)
def mark_assignment(spark, d):
    t = candidate_table(spark, d)
    return fl.candidate_rows(t.withColumn("candidates", fl.mark_assignment(F.col("candidates"), F.lit(300.0), 50.0)), ["event_id", "tpc"])


@query(
    "replay_assignments",
    f"""WITH c AS (SELECT event_id, tpc, list({{'t0': t0, 'received': received}} ORDER BY t0) AS c FROM {_CTABLE} GROUP BY 1, 2),
a AS (SELECT event_id, tpc, list([{{'t0': t0, 'received': true}}] ORDER BY -(t0 % 7), cand_id, t0) FILTER (t0 IS NOT NULL AND {_not_nan('t0')}) AS a FROM candidates WHERE received AND event_id IS NOT NULL AND tpc IS NOT NULL GROUP BY 1, 2),
r AS (SELECT c.event_id, c.tpc, list_reduce(list_prepend(c.c, coalesce(a.a, [])), lambda acc, x: list_append(list_filter(acc, lambda v: abs(v.t0 - x[1].t0) > 5), {{'t0': coalesce(list_sort(list_transform(list_filter(acc,
    lambda v: v.received AND abs(v.t0 - x[1].t0) <= 5), lambda v: {{'d': abs(v.t0 - x[1].t0), 't': v.t0}}))[1].t, x[1].t0), 'received': true}})) AS c FROM c JOIN a ON a.event_id = c.event_id AND a.tpc = c.tpc)
SELECT event_id, tpc, u.t0 AS t0, u.received AS received FROM (SELECT event_id, tpc, unnest(c) AS u FROM r)""",
)
def replay_assignments(spark, d):
    t = candidate_table(spark, d)
    a = table(spark, d, "candidates").where("received AND event_id IS NOT NULL AND tpc IS NOT NULL").groupBy("event_id", "tpc").agg(
        F.collect_list(F.struct((F.col("t0") % 7).alias("energy"), F.col("cand_id").alias("cluster"), "t0")).alias("a")
    )
    return fl.candidate_rows(t.join(a, ["event_id", "tpc"]).withColumn("candidates", fl.replay_assignments(F.col("candidates"), F.col("a"))).drop("a"), ["event_id", "tpc"])


@query(
    "amend_with_tracks",
    f"""SELECT f.light_id, f.tpc, list_reduce(list_prepend(f.seeds, coalesce(t.a, [])), lambda acc, x: CASE WHEN len(list_filter(acc, lambda v: abs(v - x[1]) <= 10)) > 0 THEN list_sort(list_concat(list_filter(acc, lambda v: abs(v - x[1]) > 10), x)) ELSE acc END) AS seeds
FROM {_THINNED} f JOIN (SELECT light_id, tpc, list([t0] ORDER BY t0 DESC, cand_id) FILTER (t0 IS NOT NULL AND {_not_nan('t0')}) AS a FROM candidates WHERE light_id IS NOT NULL AND tpc IS NOT NULL GROUP BY 1, 2) t ON t.light_id = f.light_id AND t.tpc = f.tpc""",
)
def amend_with_tracks(spark, d):
    f = fl.thinned_seeds(event_flashes(spark, d).where("tpc IS NOT NULL"), ["light_id", "tpc"], ND)
    t = table(spark, d, "candidates").where("light_id IS NOT NULL AND tpc IS NOT NULL").groupBy("light_id", "tpc").agg(F.collect_list(F.struct(F.col("t0").alias("energy"), F.col("cand_id").alias("cluster"), "t0")).alias("a"))
    return f.join(t, ["light_id", "tpc"]).select("light_id", "tpc", fl.amend_with_tracks(F.col("seeds"), F.col("a")).alias("seeds"))


_ASSIGNED = f"(SELECT DISTINCT event_id, hit_tpc_id AS tpc, CAST(t_0 AS DOUBLE) AS hit_t0 FROM {_LOADED} WHERE t_0 >= 0)"


def assigned_hits(spark, d) -> DataFrame:
    return loaded(spark, d).select("event_id", F.col("hit_tpc_id").alias("tpc"), F.col("t_0").cast("double").alias("hit_t0"), F.col("e").alias("energy"), F.col("t_cluster_id").alias("label"))


@query(
    "associated_sources",
    f"SELECT DISTINCT c.event_id, c.tpc, c.t0 FROM {_CAND} c JOIN {_ASSIGNED} h ON h.event_id = c.event_id AND h.tpc = c.tpc AND abs(h.hit_t0 - c.t0) <= 5 WHERE c.t0 BETWEEN 0 AND 800",
)
def associated_sources(spark, d):
    c = table(spark, d, "candidates").where("event_id IS NOT NULL AND tpc IS NOT NULL")
    return fl.associated_sources(c, assigned_hits(spark, d), ["event_id", "tpc"])


@query(
    "source_detail",
    f"""SELECT c.event_id, c.tpc, c.t0, count(*) AS n_hits, round(sum(h.e), 6) AS energy FROM (SELECT DISTINCT event_id, tpc, t0 FROM {_CAND}) c
JOIN {_LOADED} h ON h.event_id = c.event_id AND h.hit_tpc_id = c.tpc AND h.t_0 >= 0 AND abs(h.t_0 - c.t0) <= 5 GROUP BY 1, 2, 3""",
)
def source_detail(spark, d):
    c = table(spark, d, "candidates").where("event_id IS NOT NULL AND tpc IS NOT NULL AND rint(t0) <> 0").select("event_id", "tpc", "t0").distinct()
    return fl.source_detail(c, assigned_hits(spark, d), ["event_id", "tpc"]).drop("labels").withColumn("energy", F.round("energy", 6))


def _canonical_sql(src: str) -> str:
    """SQL: ``event_id, tpc, t0`` of ``src`` without times rounding to 0, merged to the medians of their gap groups."""
    some = f"(SELECT event_id, tpc, t0 FROM {src} WHERE t0 IS NOT NULL AND {_not_nan('t0')} AND round_even(t0, 0) <> 0)"
    return f"(SELECT event_id, tpc, median(t0) AS t0 FROM {_islands_sql(some, 'event_id, tpc', 't0', 5)} GROUP BY event_id, tpc, gap_id)"


_SNAP = _canonical_sql("(SELECT * FROM candidates WHERE event_id IS NOT NULL AND tpc IS NOT NULL)")
_NEAR_HITS = f"(SELECT f.event_id, f.tpc, f.t0, h.t_0::DOUBLE AS x, h.e FROM {_SNAP} f JOIN {_LOADED} h ON h.event_id = f.event_id AND h.hit_tpc_id = f.tpc AND h.t_0 >= 0 AND abs(h.t_0 - f.t0) <= 5 WHERE h.e > 0)"


@query(
    "snap_to_charge",
    f"""SELECT * FROM {_canonical_sql(f'(SELECT f.event_id, f.tpc, coalesce(m.v, f.t0) AS t0 FROM {_SNAP} f LEFT JOIN {_quantile_sql(0.5, "x", "e", _NEAR_HITS, "event_id, tpc, t0")} m ON m.event_id = f.event_id AND m.tpc = f.tpc AND m.t0 = f.t0)')}""",
)
def snap_to_charge(spark, d):
    c = table(spark, d, "candidates").where("event_id IS NOT NULL AND tpc IS NOT NULL")
    return fl.snap_to_charge(c, assigned_hits(spark, d), ["event_id", "tpc"])
