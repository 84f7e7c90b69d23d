"""Connected components, density clustering and principal axes."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.numeric import components, dbscan_links, grid_components
from tickloom.operators.blocks import MOST, blocks, by_block, places
from tickloom.operators.skew import broadcast_if_small, join_null_safe, kept, kept_once, ordered_rank
from tickloom.operators.spatial import XYZ, place_known
from tickloom.session import ensure_checkpoint_dir


#: Edges of a group that are solved in one task.
GROUP_EDGES = 1_000_000


def _solve(by: list[str], node: str):
    """Components of one group's edges, in memory."""

    def run(t: pa.Table) -> pa.Table:
        a, b = t["a"].to_numpy(), t["b"].to_numpy()
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = components(len(ids), at[: len(a)], at[len(a) :])
        key = {k: pa.array([t[k][0].as_py()] * len(ids), t[k].type) for k in by}
        return pa.table({**key, node: pa.array(ids), "component": pa.array(ids[root])})

    return run


def connected_components(nodes: DataFrame, edges: DataFrame, by: list[str] | None = None, node: str = "node", most_rounds: int = 50, group_edges: int = GROUP_EDGES) -> DataFrame:
    """``by, node, component``: the smallest node (an integer) reachable over ``edges`` (``a``, ``b``).

    Groups counted to have at most ``group_edges`` edges are solved in one task each. The others
    take alternating large-star and small-star rounds: each moves edges onto ever smaller nodes, so
    the number of rounds grows with the logarithm of the longest path; a node's edges are reduced by
    aggregates, never gathered, and the lineage is cut by checkpoints in the shared folder. Isolated
    nodes are their own component; edges between unknown nodes do no harm. Rounds that have not come
    to rest after ``most_rounds`` raise an error.
    """
    by = by or []
    ensure_checkpoint_dir(nodes.sparkSession)
    e = edges.select(*by, F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b")).where("a < b").distinct().checkpoint()
    sizes = e.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in e.select(*by).schema.fields) + (", " if by else "")
    some = join_null_safe(e, sizes, by) if by else e.crossJoin(F.broadcast(sizes))  # one row
    small, e = some.where(F.col("_n") <= group_edges).drop("_n"), some.where(F.col("_n") > group_edges).drop("_n")
    solved = small.groupBy(*by).applyInArrow(_solve(by, node), f"{kinds}{node} long, component long")
    e, before = e.checkpoint(), None
    for _ in range(most_rounds if e.limit(1).count() else 0):
        # large star: every larger neighbour of a node, and none else, is linked to the smallest of node and neighbours
        both = e.unionByName(e.select(*by, F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(*by, "a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, [*by, "a"]).where("b > a").select(*by, F.col("m").alias("a"), "b").where("a < b").distinct()
        # small star: the smaller neighbours of a node, and the node, are linked to the smallest of them
        low = large.groupBy(*by, "b").agg(F.min("a").alias("m"))
        small = large.join(low, [*by, "b"])
        new = small.select(*by, F.col("m").alias("a"), F.col("a").alias("b")).unionByName(low.select(*by, F.col("m").alias("a"), "b")).where("a < b").distinct()
        new = new.checkpoint()
        now = new.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*by, "a", "b"))).first()
        e = new
        if now == before:
            break
        before = now
    else:
        if before is not None:
            raise RuntimeError(f"components still change after {most_rounds} rounds")
    root = e.groupBy(*by, F.col("b").alias(node)).agg(F.min("a").alias("component")).unionByName(solved)
    return nodes.select(*by, node).distinct().join(root, [*by, node], "left").withColumn("component", F.coalesce("component", node))


def radius_components(points: DataFrame, key: str, r: float, by: list[str] | None = None, axes: tuple[str, ...] = XYZ, most: int = MOST, unique: bool = False) -> DataFrame:
    """``by, key, component``: points linked by steps of at most ``r``.

    No pairs are listed: components are found in blocks of about ``most`` points, over grid cells.
    Where a group was cut, the components of its slabs are joined over the points they share. Equal
    keys are one point; with ``unique`` the caller knows that a key comes once in a group, and only
    points near the ends of a slab are compared.
    """
    by = by or []
    p = kept_once(points.select(*by, F.col(key).cast("long").alias("_k"), *axes), points)
    part, cut = blocks(p, by, r * 1.000001, axes, most)

    def kernel(t: pa.Table, group: np.ndarray):
        k = t["_k"].to_numpy()
        # repeated keys are one point
        node = nodes_of(group, k)
        low = least_of(joined(grid_components(places(t, axes), r, group), node), k)
        rows = once(node, t["_own"].to_numpy())
        return rows, [k[rows], low[rows], *(t[c].take(pa.array(rows)) for c in ("_own", "_cut", "_shared"))]

    found = by_block(part, by, "_k long, component long, _own boolean, _cut boolean, _shared boolean", kernel)
    found = _merged(found, by, cut, unique)
    return _and_lone(found.distinct() if cut and not unique else found, p, by, axes).select(*by, F.col("_k").alias(key), F.coalesce("component", "_k").alias("component"))


def nodes_of(group: np.ndarray, k: np.ndarray) -> np.ndarray:
    """A number for each key of each group."""
    order = np.lexsort((k, group))
    new = np.ones(len(k), bool)
    new[1:] = (np.diff(group[order]) != 0) | (np.diff(k[order]) != 0)
    node = np.empty(len(k), np.int64)
    node[order] = np.cumsum(new) - 1
    return node


def once(node: np.ndarray, own: np.ndarray) -> np.ndarray:
    """One row of each node, one that the block owns if there is any."""
    order = np.lexsort((~own, node))
    return np.sort(order[np.diff(node[order], prepend=-1) != 0])


def _and_lone(found: DataFrame, p: DataFrame, by: list[str], axes: tuple[str, ...]) -> DataFrame:
    """``found`` and, with NULL, the points that ``blocks`` leaves out."""
    known = place_known(axes)
    for k in by:
        known = known & F.col(k).isNotNull()
    lone = p.where(~known).select(*by, "_k").distinct()
    if not lone.limit(1).count():
        return found
    same = [F.col(k).eqNullSafe(F.col(f"_by_{k}")) for k in [*by, "_k"]]
    lone = lone.join(found.select(*[F.col(k).alias(f"_by_{k}") for k in [*by, "_k"]]), same, "left_anti")
    return found.unionByName(lone, allowMissingColumns=True)


def joined(root: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Components where rows of one node belong together."""
    n = len(root)
    if not n or node.max() + 1 == n:
        return root
    first = np.zeros(node.max() + 1, np.int64)
    first[node] = np.arange(n)
    top = root.max() + 1
    return components(top, root, root[first[node]])[root]


def least_of(part: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The smallest key of each row's component."""
    ids, at = np.unique(part, return_inverse=True)
    low = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(low, at, k)
    return low[at]


def _merged(found: DataFrame, by: list[str], cut: bool, unique: bool = False) -> DataFrame:
    """Rows that blocks own, components of cut groups by the smallest one that shared points link them to.

    Rows with ``_border`` true link nothing. With ``unique`` only rows with ``_shared`` are compared.
    """
    if not cut:
        return found.where("_own").drop("_own", "_cut", "_shared")
    found = kept(found)
    links = "_cut AND component IS NOT NULL" + " AND _shared" * unique + (" AND NOT _border" if "_border" in found.columns else "")
    own = found.where(f"{links} AND _own").select(*by, "_k", F.col("component").alias("a"))
    near = found.where(links).select(*by, "_k", F.col("component").alias("b"))
    edges = kept(own.join(near, [*by, "_k"]).select(*by, "a", "b").where("a <> b").distinct())
    nodes = edges.select(*by, F.col("a").alias("node")).unionByName(edges.select(*by, F.col("b").alias("node")))
    root = connected_components(nodes, edges, by).select(*by, F.col("node").alias("component"), F.col("component").alias("_root"))
    mine = found.where("_own")
    whole, apart = mine.where("NOT _cut"), mine.where("_cut").join(broadcast_if_small(root), [*by, "component"], "left").withColumn("component", F.coalesce("_root", "component")).drop("_root")
    if unique and "_border" in found.columns:  # only a border point has several rows
        border = apart.where("_border").groupBy(*by, "_k").agg(F.min("component").alias("component"))
        whole, apart = whole.unionByName(apart.where("NOT _border")).select(*by, "_k", "component"), border
    return whole.unionByName(apart).drop("_own", "_cut", "_shared")


def dbscan(points: DataFrame, key: str, eps: float, least: int, by: list[str] | None = None, axes: tuple[str, ...] = XYZ, most: int = MOST, unique: bool = False) -> DataFrame:
    """``by, key, cluster``: density clusters, named by their smallest core point; NULL for noise.

    A core point has at least ``least`` points within ``eps``, itself counted. A border point joins
    the cluster with the smallest name among those of the core points within ``eps``, so the result
    does not depend on any order of visits. Blocks as in ``radius_components``; a slab reaches 2
    ``eps`` beyond its own points, so that it knows all core points within ``eps`` of these. ``unique``
    as there.
    """
    by = by or []
    p = kept_once(points.select(*by, F.col(key).cast("long").alias("_k"), *axes), points)
    part, cut = blocks(p, by, 2 * eps * 1.000001, axes, most)

    def kernel(t: pa.Table, group: np.ndarray):
        node = nodes_of(group, t["_k"].to_numpy())
        if node.max(initial=-1) + 1 < len(node):  # repeated keys are one point
            rows = once(node, t["_own"].to_numpy())
            t, group = t.take(pa.array(rows)).combine_chunks(), group[rows]
        else:
            rows = np.arange(len(node))
        of_row = rows
        k, own, parted = t["_k"].to_numpy(), t["_own"].to_numpy(), t["_cut"].to_numpy()
        shared = t["_shared"].to_numpy()
        core, comp, at, of = dbscan_links(places(t, axes), eps, least, group)
        name = np.zeros(len(k), np.int64)
        name[core] = least_of(comp[core], k[core])
        low = np.full(comp.max(initial=-1) + 1, -1)
        low[comp[core]] = name[core]
        # of a border point of a group in one block the smallest name; else all, to be compared once they are joined
        order = np.lexsort((low[of], at))
        at, of = at[order], low[of[order]]
        some = own[at] & (parted[at] | (np.diff(at, prepend=-1) != 0))
        at, of = at[some], of[some]
        alone = own & ~core
        alone[at] = False
        in_core, alone = np.nonzero(core)[0], np.nonzero(alone)[0]
        rows = np.concatenate([in_core, at, alone])
        label = pa.array(np.concatenate([name[in_core], of, np.zeros(len(alone), np.int64)]), mask=np.arange(len(rows)) >= len(in_core) + len(at))
        border = np.zeros(len(rows), bool)
        border[len(in_core) :] = True
        return of_row[rows], [k[rows], label, own[rows], parted[rows], border, shared[rows]]

    found = by_block(part, by, "_k long, component long, _own boolean, _cut boolean, _border boolean, _shared boolean", kernel)
    found = _merged(found, by, cut, unique)
    if cut and not unique:
        found = found.groupBy(*by, "_k").agg(F.min("component").alias("component"))
    found = found.select(*by, "_k", "component")
    return _and_lone(found, p, by, axes).select(*by, F.col("_k").alias(key), F.col("component").alias("cluster"))


def labels_by_energy(clusters: DataFrame, hits: DataFrame, key: str, energy: str, by: list[str], first: int = 0) -> DataFrame:
    """``by, key, label``: clusters numbered from ``first`` by summed energy, largest first; -1 for none.

    Energies alike to 6 decimals are ties, so that no order of summation changes a label; ties by cluster.
    """
    clusters = kept(clusters)
    e = clusters.join(hits.select(*by, key, energy), [*by, key]).where("cluster IS NOT NULL").groupBy(*by, "cluster").agg(F.round(F.sum(energy), 6).alias("_e"))
    if by:  # one row a cluster
        ranked = e.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("_e"), "cluster")) - 1)
    else:
        ranked = ordered_rank(e.withColumn("_less", -F.col("_e")), by, ["_less", "cluster"], "_r")
    no = ranked.select(*by, "cluster", (F.col("_r") + first).cast("int").alias("label"))
    return clusters.join(no, [*by, "cluster"], "left").select(*by, key, F.coalesce("label", F.lit(-1)).alias("label"))


def principal_axes(hits: DataFrame, by: list[str], energy: str | None = "energy") -> DataFrame:
    """Per group: hits, energy, centroid, main direction, length, linearity, planarity, transverse RMS.

    The moments are summed by Spark, on the map side first; only one row of sums a group meets
    Python, for the eigenvectors. The length is the extent along the main direction, from a second
    pass. Weights are energies of at least 1e-8 (1 without ``energy``). Fewer than three hits have
    linearity 1 (0 for one) and no width.
    """
    w = F.greatest(F.coalesce(F.col(energy).cast("double"), F.lit(0.0)), F.lit(1e-8)) if energy else F.lit(1.0)
    ok = hits.where(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull() & ~F.isnan("x") & ~F.isnan("y") & ~F.isnan("z"))
    p = ok.select(*by, w.alias("w"), *XYZ)
    # moments about a point near the group, so that large coordinates cost no digits
    mean = p.groupBy(*by).agg(*[F.avg(a).alias(f"m{a}") for a in XYZ])
    q = p.join(mean, by).withColumns({a: F.col(a) - F.col(f"m{a}") for a in XYZ})
    sums = [F.count(F.lit(1)).alias("n_hits"), F.sum("w").alias("sw"), *[F.sum(F.col("w") * F.col(a)).alias(f"s{a}") for a in XYZ]]
    sums += [F.sum(F.col("w") * F.col(a) * F.col(b)).alias(f"s{a}{b}") for i, a in enumerate(XYZ) for b in XYZ[i:]]
    s = q.groupBy(*by, *[f"m{a}" for a in XYZ]).agg(*sums)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in s.select(*by).schema.fields)

    def axes(batches):
        for d in batches:
            n = len(d)
            c = np.zeros((n, 3, 3))
            m = np.stack([d[f"s{a}"] / d["sw"] for a in XYZ], 1) if n else np.zeros((0, 3))
            for i, a in enumerate(XYZ):
                for j, b in enumerate(XYZ[i:], i):
                    c[:, i, j] = c[:, j, i] = d[f"s{a}{b}"] / d["sw"] - m[:, i] * m[:, j]
            ev, vec = np.linalg.eigh(c) if n else (np.zeros((0, 3)), np.zeros((0, 3, 3)))
            ev = np.clip(ev[:, ::-1], 0, None)
            u = vec[:, :, 2]
            # of the two signs, the one whose largest component is positive
            big = np.take_along_axis(u, np.abs(u).argmax(1)[:, None], 1) if n else u[:, :1]
            u = u * np.where(big < 0, -1, 1)
            t = np.maximum(ev.sum(1), 1e-12)
            few = d["n_hits"].to_numpy() < 3
            lin = np.where(few, (d["n_hits"].to_numpy() > 1).astype(float), ev[:, 0] / t)
            out = d[by].copy()
            out["n_hits"], out["energy"] = d["n_hits"], d["sw"]
            for i, a in enumerate(XYZ):
                out[f"c{a}"], out[f"d{a}"] = m[:, i] + d[f"m{a}"].to_numpy(), u[:, i]
            out["linearity"], out["planarity"] = lin, np.where(few, 0.0, (ev[:, 0] + ev[:, 1]) / t)
            out["transverse_rms"] = np.where(few, 0.0, np.sqrt(ev[:, 1] + ev[:, 2]))
            yield out

    a = s.mapInPandas(axes, f"{kinds}, n_hits long, energy double, cx double, dx double, cy double, dy double, cz double, dz double, linearity double, planarity double, transverse_rms double")
    along = sum(((F.col(v) - F.col(f"c{v}")) * F.col(f"d{v}") for v in XYZ), F.lit(0.0))
    span = p.join(a.select(*by, *[f"c{v}" for v in XYZ], *[f"d{v}" for v in XYZ]), by).groupBy(*by).agg((F.max(along) - F.min(along)).alias("length"))
    return a.join(span, by)


def dimensionality(points: np.ndarray) -> tuple[float, float, float]:
    """(l1 - l2) / l1, (l2 - l3) / l1, l3 / l1 of the covariance; 0, 0, 1 for fewer than three points."""
    if len(points) < 3:
        return 0.0, 0.0, 1.0
    ev = np.sort(np.clip(np.linalg.eigvalsh(np.cov(points.T, bias=True)), 0, None))[::-1]
    if ev[0] <= 0:
        return 0.0, 0.0, 1.0
    return tuple(float(v) for v in ((ev[0] - ev[1]) / ev[0], (ev[1] - ev[2]) / ev[0], ev[2] / ev[0]))


def endpoint_vertices(tracks: pd.DataFrame, eps: float, least: int, most_distance: float) -> pd.DataFrame:
    """Groups of track ends within ``eps`` that hold at least two tracks whose lines pass each other closely enough."""
    from tickloom.functions.numeric import dbscan_labels, line_line

    ends = np.concatenate([tracks[["px", "py", "pz"]].to_numpy(), tracks[["qx", "qy", "qz"]].to_numpy()])
    who = np.tile(np.arange(len(tracks)), 2)
    lab = dbscan_labels(ends, eps, least)
    out = np.full(len(tracks), -1)
    p = tracks[["px", "py", "pz"]].to_numpy()
    v = tracks[["qx", "qy", "qz"]].to_numpy() - p
    no = 0
    for c in range(lab.max() + 1 if len(lab) else 0):
        ids = np.unique(who[lab == c])
        if len(ids) < 2:
            continue
        d = [line_line(p[i], v[i], p[j], v[j]) for k, i in enumerate(ids) for j in ids[k + 1 :]]
        if np.median(d) <= most_distance:
            free = ids[out[ids] < 0]
            out[free] = no
            no += 1
    return tracks.assign(vertex=out)


def promoted_islands(points: DataFrame, density: DataFrame, key: str, label: str, by: list[str], r: float = 4.0, least: int = 6, quantile: float = 0.45, noise: int = -1) -> DataFrame:
    """``by, key, island``: connected noise points that are many and, on the mean, as dense as the group's quantile."""
    lost = points.where(F.col(label) == noise)
    part = radius_components(lost.select(*by, key, *XYZ), key, r, by)
    cut = density.groupBy(*by).agg(F.percentile("rho", quantile).alias("_q"))
    size = part.join(density.select(*by, key, "rho"), [*by, key]).groupBy(*by, "component").agg(F.count(F.lit(1)).alias("_n"), F.avg("rho").alias("_m"))
    good = size.join(cut, by).where((F.col("_n") >= least) & (F.col("_m") >= F.col("_q"))).select(*by, "component")
    return part.join(good, [*by, "component"], "left_semi").select(*by, key, F.col("component").alias("island"))
