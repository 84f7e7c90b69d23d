"""Queries of the NumPy kernels that the stages of one event are made of, run on every event of the test tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions import numeric as N
from tickloom.operators import components
from tickloom.operators.blocks import blocks, by_block, places
from tickloom.operators.skew import kept, slices_for
from tickloom.plans.detector import _LOADED, QUERIES, SQL, loaded, query
from tickloom.plans.detector_light import _C, _D, _DBSCAN, _P, _PAIRS, _SUMMARY, _TICK, TICKS, light_candidates, light_table
from tickloom.stages import labels as L
from tickloom.stages import match as M

__all__ = ["QUERIES", "SQL"]

KINDS = ("track", "cluster", "em_shower")
_KIND = "['track', 'cluster', 'em_shower'][CAST(cluster % 3 AS INTEGER) + 1]"
#: Hits with a cluster and a TPC; the noise of the kernels is cluster 7.
_H = f"(SELECT event_id, hit_row, x, y, z, e, t_0, CAST(hit_tpc_id AS INTEGER) AS tpc, t_cluster_id AS cluster FROM {_LOADED} WHERE t_cluster_id >= 0 AND hit_tpc_id >= 0)"


def clustered(spark, d: str) -> DataFrame:
    h = loaded(spark, d, ("t_0", "hit_tpc_id", "t_cluster_id")).where("t_cluster_id >= 0 AND hit_tpc_id >= 0")
    return h.select("event_id", "hit_row", "x", "y", "z", "e", "t_0", F.col("hit_tpc_id").cast("int").alias("tpc"), F.col("t_cluster_id").cast("long").alias("cluster"))


def per_event(spark, d: str, kernel: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """The kernel on the hits of each event in the order of their rows, with their places as an array; events by hash in one call of Python."""
    h = clustered(spark, d)
    return h.groupBy(F.pmod(F.xxhash64("event_id"), F.lit(slices_for(h)))).applyInArrow(each_event(kernel, schema), f"event_id long, {schema}")


def each_event(kernel: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: str) -> Callable[[pa.Table], pa.Table]:
    """The kernel on each event of a table. Columns get the types of ``schema``, whatever pandas makes of an event without rows."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}
    fields = pa.schema([("event_id", pa.int64()), *[(n, kinds[k]) for n, k in (c.split() for c in schema.split(", "))]])

    def run(t: pa.Table) -> pa.Table:
        g = t.to_pandas().sort_values(["event_id", "hit_row"], ignore_index=True)
        ids, first = np.unique(g["event_id"].to_numpy(), return_index=True)
        found = []
        for i, a, b in zip(ids.tolist(), first, [*first[1:], len(g)]):
            one = g.iloc[a:b].reset_index(drop=True)
            out = kernel(one, one[["x", "y", "z"]].to_numpy())
            if len(out):
                out.insert(0, "event_id", i)
                found.append(out)
        return pa.Table.from_pandas(pd.concat(found, ignore_index=True), fields, preserve_index=False).combine_chunks() if found else fields.empty_table()

    return run


def kinds(g: pd.DataFrame) -> dict[int, str]:
    return {int(c): KINDS[int(c) % 3] for c in g["cluster"].unique()}


@query(
    "kernel_noise_list",
    f"""SELECT event_id, hit_row, cluster, round(dist, 6) AS dist FROM (SELECT *, min(dist) OVER (PARTITION BY event_id, hit_row) AS low FROM (SELECT a.event_id, a.hit_row, b.cluster, min({_D}) AS dist FROM {_H} a JOIN {_H} b
  ON a.event_id = b.event_id AND a.cluster = 7 AND b.cluster <> 7 GROUP BY 1, 2, 3)) WHERE low <= 40 AND dist <= 1.2 * low""",
)
def kernel_noise_list(spark, d):
    part, _ = blocks(kept(clustered(spark, d).select("event_id", "hit_row", "x", "y", "z", "cluster")), ["event_id"], 1.2 * 40 * 1.000001)

    def run(t: pa.Table, group: np.ndarray):
        c = t["cluster"].to_numpy()
        lost = (c == 7) & t["_own"].to_numpy()
        use = np.nonzero(lost | (c != 7))[0]
        at, of, dist = N.nearest_labels(places(t)[use], lost[use], c[use], 40.0, 1.2, group[use])
        at = use[at]
        return at, [t["hit_row"].to_numpy()[at], of, dist]

    return by_block(part, ["event_id"], "hit_row long, cluster long, dist double", run).withColumn("dist", F.round("dist", 6))


@query(
    "kernel_components",
    f"""WITH RECURSIVE e AS MATERIALIZED (SELECT a.event_id, a.hit_row AS a, b.hit_row AS b FROM {_H} a JOIN {_H} b ON a.event_id = b.event_id AND a.hit_row <> b.hit_row AND abs(a.x - b.x) <= 12 AND {_D} <= 12),
r(event_id, node, root) AS (SELECT event_id, hit_row, hit_row FROM {_H} UNION SELECT e.event_id, e.b, r.root FROM r JOIN e ON e.event_id = r.event_id AND e.a = r.node WHERE r.root < e.b)
SELECT event_id, node AS hit_row, min(root) AS component FROM r GROUP BY 1, 2""",
)
def kernel_components(spark, d):
    return components.radius_components(clustered(spark, d), "hit_row", 12.0, ["event_id"], unique=True)


@query("kernel_dbscan", _DBSCAN.replace(_PAIRS, f"(SELECT a.event_id, a.hit_row AS a, b.hit_row AS b FROM {_H} a JOIN {_H} b ON a.event_id = b.event_id AND a.hit_row <> b.hit_row AND abs(a.x - b.x) <= 12 AND {_D} <= 12)").replace(_P, _H).split("no AS (")[0].rstrip().rstrip(",") + " SELECT event_id, hit_row, cluster FROM l")
def kernel_dbscan(spark, d):
    """Density clusters named by their smallest core point; NULL for noise."""
    return components.dbscan(clustered(spark, d), "hit_row", 12.0, 3, ["event_id"], unique=True)


@query("kernel_cluster_links", f"SELECT DISTINCT a.event_id, a.cluster AS a, b.cluster AS b FROM {_H} a JOIN {_H} b ON a.event_id = b.event_id AND a.cluster < b.cluster AND abs(a.x - b.x) <= 12 AND {_D} <= 12")
def kernel_cluster_links(spark, d):
    part, cut = blocks(kept(clustered(spark, d).select("event_id", "x", "y", "z", "cluster")), ["event_id"], 12.0 * 1.000001)

    def run(t: pa.Table, group: np.ndarray):
        of, a, b = N.linked_labels(places(t), t["cluster"].to_numpy(), 12.0, group)
        _, first = np.unique(group, return_index=True)
        return first[of], [a, b]

    links = by_block(part, ["event_id"], "a long, b long", run)
    return links.distinct() if cut else links


@query("kernel_shower_tpcs", f"SELECT event_id, tpc FROM (SELECT event_id, tpc, count(*) AS n, sum(e) AS energy FROM {_H} WHERE cluster % 3 = 2 GROUP BY 1, 2) WHERE n >= 2 AND energy >= 2.5")
def kernel_shower_tpcs(spark, d):
    return per_event(spark, d, lambda g, p: pd.DataFrame({"tpc": L.shower_tpcs(g["cluster"].to_numpy(), kinds(g), g["tpc"].to_numpy(), g["e"].to_numpy(), 2, 2.5)}), "tpc int")


@query("kernel_long_tracks", f"SELECT h.event_id, h.hit_row FROM {_H} h SEMI JOIN (SELECT event_id, cluster FROM {_H} WHERE cluster % 3 = 0 GROUP BY 1, 2 HAVING count(DISTINCT tpc) >= 3) k ON k.event_id = h.event_id AND k.cluster = h.cluster")
def kernel_long_tracks(spark, d):
    return per_event(spark, d, lambda g, p: pd.DataFrame({"hit_row": g["hit_row"][L.long_tracks(g["cluster"].to_numpy(), kinds(g), g["tpc"].to_numpy())].to_numpy()}), "hit_row long")


@query(
    "kernel_capacity",
    f"""SELECT event_id, cluster, CAST(CASE WHEN kind = 'track' THEN 0 WHEN kind = 'shower' THEN least(50, n) WHEN energy > 50 THEN least(20, n) ELSE n END AS BIGINT) AS room
FROM (SELECT *, floor(0.2::DOUBLE * energy) AS n FROM (SELECT event_id, cluster, ['track', 'cluster', 'shower'][CAST(cluster % 3 AS INTEGER) + 1] AS kind, round(sum(e), 6) AS energy FROM {_H} GROUP BY 1, 2))""",
)
def kernel_capacity(spark, d):
    def run(g, p):
        e = g.groupby("cluster")["e"].sum().round(6)
        return pd.DataFrame({"cluster": e.index, "room": [L.capacity(KINDS[c % 3].removeprefix("em_"), x) for c, x in e.items()]})

    return per_event(spark, d, run, "cluster long, room long")


@query(
    "kernel_population",
    f"SELECT event_id, cluster, CASE WHEN tpcs > 1 OR energy > 12 THEN 'primary' WHEN energy < 1.5 THEN 'pruned' ELSE 'iterative' END AS part FROM (SELECT event_id, cluster, count(DISTINCT tpc) AS tpcs, sum(e) AS energy FROM {_H} WHERE cluster >= 3 GROUP BY 1, 2)",
)
def kernel_population(spark, d):
    def run(g, p):
        ev = M.Event(p, g["e"].to_numpy(), g["tpc"].to_numpy(), {}, {}, None, M.rules_of("nd", large_energy=12.0, least_energy=1.5), g["cluster"].to_numpy(), backbone=3)
        ev.images = {(int(c), int(t)): None for c, t in zip(ev.label, ev.tpc)}
        parts = M.population(ev)
        rows = [(c, name) for name, ids in zip(("primary", "iterative", "pruned"), parts) for c in ids]
        return pd.DataFrame({"cluster": [c for c, _ in rows], "part": [n for _, n in rows]})

    return per_event(spark, d, run, "cluster long, part string")


@query("kernel_changed_backbone", f"SELECT event_id, CAST(count_if(cluster < 5 AND t_0 >= 0 AND e > 1) AS BIGINT) AS n_changed FROM {_H} GROUP BY 1")
def kernel_changed_backbone(spark, d):
    """Hits of the backbone (clusters below 5) whose settled time another step has changed."""

    def run(g, p):
        t0 = g["t_0"].to_numpy(dtype=float, na_value=np.nan)
        ev = M.Event(p, g["e"].to_numpy(), g["tpc"].to_numpy(), {}, {}, None, M.ND_RULES, g["cluster"].to_numpy(), backbone=5, t0=np.where(t0 >= 0, t0, np.nan))
        before = M.snapshot(ev)
        ev.t0 = np.where(ev.e > 1, ev.t0 + 1, ev.t0)
        return pd.DataFrame({"n_changed": [M.changed_since(ev, before)]})

    return per_event(spark, d, run, "n_changed long")


@query(
    "kernel_donors",
    f"""WITH RECURSIVE h AS MATERIALIZED (SELECT * FROM {_H} WHERE t_0 >= 0), e AS MATERIALIZED (SELECT a.event_id, a.tpc, a.t_0, a.hit_row AS a, b.hit_row AS b FROM h a JOIN h b ON a.event_id = b.event_id AND a.tpc = b.tpc AND a.t_0 = b.t_0 AND a.hit_row <> b.hit_row AND {_D} <= 30),
r(event_id, tpc, t_0, node, root) AS (SELECT event_id, tpc, t_0, hit_row, hit_row FROM h UNION SELECT e.event_id, e.tpc, e.t_0, e.b, r.root FROM r JOIN e ON e.event_id = r.event_id AND e.a = r.node AND e.t_0 = r.t_0 AND e.tpc = r.tpc WHERE r.root < e.b),
c AS (SELECT event_id, tpc, t_0, node, min(root) AS c FROM r GROUP BY 1, 2, 3, 4), s AS (SELECT c.event_id, c.tpc, c.t_0, c.c, count(*) AS n, sum(h.e) AS energy FROM c JOIN h ON h.event_id = c.event_id AND h.hit_row = c.node GROUP BY 1, 2, 3, 4)
SELECT event_id, tpc, CAST(t_0 AS DOUBLE) AS t0, count(*) AS n_donors, CAST(sum(n) AS BIGINT) AS n_hits FROM s WHERE n >= 2 AND energy >= 0.2 GROUP BY 1, 2, 3""",
)
def kernel_donors(spark, d):
    """Groups of hits of one TPC and time that could be moved to another time together."""

    def run(g, p):
        t0 = g["t_0"].to_numpy(dtype=float, na_value=np.nan)
        rules = M.rules_of("nd", resolution=0.4, donor_radius=30.0, donor_hits=2, most_donors=10**9)
        ev = M.Event(p, g["e"].to_numpy(), g["tpc"].to_numpy(), {}, {}, None, rules, g["cluster"].to_numpy(), t0=np.where(t0 >= 0, t0, np.nan))
        rows = []
        for t, x in sorted({(int(t), float(x)) for t, x in zip(ev.tpc, ev.t0) if np.isfinite(x)}):
            groups = M.donors(ev, t, x)
            if groups:
                rows.append((t, x, len(groups), sum(map(len, groups))))
        return pd.DataFrame(rows, columns=["tpc", "t0", "n_donors", "n_hits"])

    return per_event(spark, d, run, "tpc int, t0 double, n_donors long, n_hits long")


# ---------------------------------------------------------------- light
LIGHT_RULES = M.rules_of("2x2", peak=20, half_window=5, sigma=1.0, overflow_adc=20.0, model_adc=20.0)


def per_tpc_light(spark, d: str, kernel: Callable[[M.Event, int, list[float]], list[tuple]], columns: str) -> DataFrame:
    """The kernel on the light of each (light event, TPC) and its candidates; the model is the light so far."""
    c = light_candidates(spark, d).groupBy("light_id", F.col("tpc").cast("int").alias("tpc")).agg(F.sort_array(F.collect_set("t0")).alias("times"))
    l = light_table(spark, d).select("light_id", "tpc", "channel", "wvfm_row", "actual", "model", "std").join(c, ["light_id", "tpc"])
    names = [x.split()[0] for x in columns.split(", ")]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["channel", "wvfm_row"])
        t = int(g["tpc"].iloc[0])
        a, m, s = (np.stack(g[c].to_numpy()) for c in ("actual", "model", "std"))
        ev = M.Event(np.zeros((0, 3)), np.zeros(0), np.zeros(0, int), {t: a}, {t: s**2}, None, LIGHT_RULES, np.zeros(0, int), base={t: m})
        out = pd.DataFrame(kernel(ev, t, list(g["times"].iloc[0])), columns=names)
        out.insert(0, "tpc", t)
        out.insert(0, "light_id", g["light_id"].iloc[0])
        return out

    return l.groupBy("light_id", "tpc").applyInPandas(run, f"light_id long, tpc int, {columns}")


@query(
    "kernel_overflow",
    f"SELECT light_id, tpc, t0, overflow_channels, round(peak_overflow / greatest(overflow_channels, 1) + 0.002::DOUBLE * window_overflow, 4) AS severity, round(window_overflow, 3) AS total FROM {_SUMMARY}",
)
def kernel_overflow(spark, d):
    def run(ev, t, times):
        rows = []
        for x in times:
            if 0 <= x + LIGHT_RULES.peak < ev.actual[t].shape[1]:
                n, severity, total, _ = M.overflow(ev, t, x)
                rows.append((x, n, round(severity, 4), round(total, 3)))
        return rows

    return per_tpc_light(spark, d, run, "t0 double, overflow_channels long, severity double, total double")


@query(
    "kernel_window_loss",
    f"""SELECT x.light_id, x.tpc, round(sum(((m - a) / s) ** 2), 2) AS loss FROM {_TICK} x SEMI JOIN (SELECT DISTINCT c.light_id, c.tpc, g.i AS tick FROM (SELECT *, NOT bool_or(t0 + 25 >= 0 AND t0 + 15 < {TICKS}) OVER (PARTITION BY light_id, tpc) AS blind FROM {_C}) c
  JOIN (SELECT unnest(range(0, {TICKS})) AS i) g ON g.i BETWEEN c.t0 + 15 AND c.t0 + 25 OR c.blind) k ON k.light_id = x.light_id AND k.tpc = x.tpc AND k.tick = x.tick GROUP BY 1, 2""",
)
def kernel_window_loss(spark, d):
    """Chi2 over the windows of all candidates; over all ticks where no window lies within the waveform."""
    return per_tpc_light(spark, d, lambda ev, t, times: [(round(M.window_loss(ev, t, ev.base[t], times), 2),)], "loss double")
