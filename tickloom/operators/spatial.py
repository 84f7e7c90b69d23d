"""Distance joins on a grid, nearest neighbours, and the geometry of lines and segments.

Space is cut into cells of side 2 r. One side of a join is put into every cell that the ball of
radius r around a point touches (8 at most), and joined on cells: a distance join is an equi-join
with a filter, each pair meets in one cell only, and no group is ever paired with itself as a whole.
Crowded cells are split by AQE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

XYZ = ("x", "y", "z")


def _cells(df: DataFrame, r: float, axes: tuple[str, ...]) -> DataFrame:
    return df.withColumns({f"_c{a}": F.floor(F.col(a) / (2 * r)) for a in axes})


def _around(df: DataFrame, r: float, axes: tuple[str, ...]) -> DataFrame:
    out = df
    for a in axes:
        # a hair more than r, so that rounding never parts a pair at the very radius
        lo, hi = F.floor((F.col(a) - r * 1.000001) / (2 * r)), F.floor((F.col(a) + r * 1.000001) / (2 * r))
        out = out.withColumn(f"_c{a}", F.explode(F.sequence(lo, hi)))
    return out


def place_known(axes: tuple[str, ...] = XYZ) -> Column:
    ok = F.lit(True)
    for a in axes:
        ok = ok & F.col(a).isNotNull() & ~F.isnan(a) & (F.abs(a) < 1e12)
    return ok


def within(left: DataFrame, right: DataFrame, r: float, by: list[str] | None = None, axes: tuple[str, ...] = XYZ) -> DataFrame:
    """Left rows with right rows of their group at most ``r`` away: left columns as ``l_..``, right ones as ``r_..``, and ``dist``.

    Points with a NULL or NaN coordinate are near nothing. ``r`` itself is within.
    """
    by = by or []
    l = _cells(left.where(place_known(axes)), r, axes)
    p = _around(right.where(place_known(axes)), r, axes)
    keep_l, keep_r = [c for c in left.columns if c not in by], [c for c in right.columns if c not in by]
    l = l.select(*by, *[f"_c{a}" for a in axes], *[F.col(c).alias(f"l_{c}") for c in keep_l])
    p = p.select(*by, *[f"_c{a}" for a in axes], *[F.col(c).alias(f"r_{c}") for c in keep_r])
    d2 = sum((F.pow(F.col(f"l_{a}") - F.col(f"r_{a}"), 2) for a in axes), F.lit(0.0))
    j = l.join(p, [*by, *[f"_c{a}" for a in axes]]).withColumn("dist", F.sqrt(d2))
    return j.where(F.col("dist") <= r).drop(*[f"_c{a}" for a in axes])


def close_pairs(points: DataFrame, key: str, r: float, by: list[str] | None = None, axes: tuple[str, ...] = XYZ) -> DataFrame:
    """``by, a, b, dist`` with a < b for all pairs of points at most ``r`` apart. Equal keys are one point."""
    by = by or []
    p = points.select(*by, F.col(key).alias("k"), *axes)
    return within(p, p, r, by, axes).where("l_k < r_k").select(*by, F.col("l_k").alias("a"), F.col("r_k").alias("b"), "dist")


def cluster_adjacency(hits: DataFrame, r: float, by: list[str], cluster: str = "cluster", noise: int = -1, axes: tuple[str, ...] = XYZ) -> DataFrame:
    """``by, a, b, dist`` with a < b: clusters whose nearest hits are at most ``r`` apart, and how far these are."""
    p = hits.where(F.col(cluster) != noise).select(*by, F.col(cluster).alias("c"), *axes)
    j = within(p, p, r, by, axes).where("l_c < r_c")
    return j.groupBy(*by, F.col("l_c").alias("a"), F.col("r_c").alias("b")).agg(F.min("dist").alias("dist"))


def nearest_within(left: DataFrame, right: DataFrame, r: float, key: str, other: str, by: list[str] | None = None, axes: tuple[str, ...] = XYZ) -> DataFrame:
    """``by, key, other, dist``: the nearest right row within ``r`` (ties by ``other``)."""
    by = by or []
    j = within(left.select(*by, key, *axes), right.select(*by, other, *axes), r, by, axes)
    best = j.groupBy(*by, F.col(f"l_{key}").alias(key)).agg(F.min(F.struct("dist", F.col(f"r_{other}").alias("o"))).alias("_b"))
    return best.select(*by, key, F.col("_b.o").alias(other), F.col("_b.dist").alias("dist"))


def k_nearest(points: DataFrame, k: int, r: float, key: str, by: list[str] | None = None, axes: tuple[str, ...] = XYZ) -> DataFrame:
    """``by, key, neighbor, dist, rank``: up to ``k`` other points within ``r``, nearest first (ties by neighbour)."""
    by = by or []
    p = points.select(*by, F.col(key).alias("k"), *axes)
    j = within(p, p, r, by, axes).where("l_k <> r_k")
    w = Window.partitionBy(*by, "l_k").orderBy("dist", "r_k")
    return j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(*by, F.col("l_k").alias(key), F.col("r_k").alias("neighbor"), "dist", "rank")


def local_density(points: DataFrame, energy: str, key: str, k: int = 16, r: float = 10.0, sigma: float = 3.0, by: list[str] | None = None) -> DataFrame:
    """``by, key, rho``: sum over the k nearest of (1 + log1p(E) / 4) exp(-d^2 / (2 sigma^2)); points alone have 0."""
    by = by or []
    nn = k_nearest(points, k, r, key, by)
    e = points.select(*by, F.col(key).alias("neighbor"), F.col(energy).alias("_e"))
    w = (1 + 0.25 * F.log1p(F.greatest(F.col("_e"), F.lit(0.0)))) * F.exp(-F.col("dist") * F.col("dist") / (2 * sigma * sigma))
    rho = nn.join(e, [*by, "neighbor"]).groupBy(*by, key).agg(F.sum(w).alias("rho"))
    return points.select(*by, key).distinct().join(rho, [*by, key], "left").withColumn("rho", F.coalesce("rho", F.lit(0.0)))


def fragment_edges(points: DataFrame, energy: str, key: str, k: int = 16, r: float = 10.0, norm: float = 6.0, weight: float = 0.10, most: float = 1.25, by: list[str] | None = None) -> DataFrame:
    """``by, a, b`` of neighbours whose d / norm - weight * min(log1p E) is at most ``most``."""
    by = by or []
    e = points.select(*by, F.col(key).alias("_k"), F.log1p(F.greatest(F.col(energy), F.lit(0.0))).alias("_e"))
    nn = k_nearest(points, k, r, key, by)
    j = nn.join(e.withColumnRenamed("_e", "_ea").withColumnRenamed("_k", key), [*by, key]).join(e.withColumnRenamed("_e", "_eb").withColumnRenamed("_k", "neighbor"), [*by, "neighbor"])
    ok = j.where(F.col("dist") / norm - weight * F.least("_ea", "_eb") <= most)
    return ok.select(*by, F.least(key, "neighbor").alias("a"), F.greatest(key, "neighbor").alias("b")).distinct()


def neighbor_vote(points: DataFrame, label: str, energy: str, key: str, k: int = 18, r: float = 10.0, share: float = 0.55, by: list[str] | None = None, noise: int = -1) -> DataFrame:
    """``by, key, label`` for noise points whose k nearest points' votes give one label at least ``share``.

    A vote weighs (1 + 0.15 log1p E) / (d + 0.5); noise neighbours have none; ties by label.
    """
    by = by or []
    nn = k_nearest(points, k, r, key, by)
    voters = points.where(F.col(label) != noise).select(*by, F.col(key).alias("neighbor"), F.col(label).alias("_l"), F.col(energy).alias("_e"))
    w = (1 + 0.15 * F.log1p(F.greatest(F.col("_e"), F.lit(0.0)))) / (F.col("dist") + 0.5)
    lost = points.where(F.col(label) == noise).select(*by, key)
    v = nn.join(lost, [*by, key], "left_semi").join(voters, [*by, "neighbor"]).groupBy(*by, key, "_l").agg(F.sum(w).alias("_w"))
    best = v.groupBy(*by, key).agg(F.max(F.struct("_w", (-F.col("_l")).alias("n"))).alias("_b"), F.sum("_w").alias("_t"))
    return best.where(F.col("_b._w") >= share * F.col("_t")).select(*by, key, (-F.col("_b.n")).alias(label))


def noise_neighbors(hits: DataFrame, key: str, cluster: str, reach: float = 40.0, expand: float = 1.2, noise: int = -1, by: list[str] | None = None) -> DataFrame:
    """``by, key, cluster, dist``: for noise hits the nearest cluster within ``reach`` and any other within ``expand`` times that distance."""
    by = by or []
    lost = hits.where(F.col(cluster) == noise).select(*by, key, *XYZ)
    owned = hits.where(F.col(cluster) != noise).select(*by, F.col(cluster).alias("c"), *XYZ)
    d = within(lost, owned, reach, by).groupBy(*by, F.col(f"l_{key}").alias(key), F.col("r_c").alias(cluster)).agg(F.min("dist").alias("dist"))
    low = F.min("dist").over(Window.partitionBy(*by, key))
    return d.withColumn("_low", low).where(F.col("dist") <= expand * F.col("_low")).drop("_low")


# ---------------------------------------------------------------- lines and segments, as column algebra
def vec(*c: str) -> list[Column]:
    return [F.col(x).cast("double") for x in c]


def dot(a: list[Column], b: list[Column]) -> Column:
    return sum((x * y for x, y in zip(a, b)), F.lit(0.0))


def sub(a: list[Column], b: list[Column]) -> list[Column]:
    return [x - y for x, y in zip(a, b)]


def cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def angle_deg(u: list[Column], v: list[Column]) -> Column:
    """Angle between undirected lines, 0..90; NULL for a zero vector."""
    c = F.abs(dot(u, v)) / F.nullif(F.sqrt(dot(u, u) * dot(v, v)), F.lit(0.0))
    return F.degrees(F.acos(F.least(F.lit(1.0), c)))


def line_distance(p1: list[Column], v1: list[Column], p2: list[Column], v2: list[Column]) -> Column:
    """Distance of closest approach of two lines; that of a point to the line where they are parallel."""
    n = cross(v1, v2)
    nn = dot(n, n)
    d = sub(p2, p1)
    skew = F.abs(dot(d, n)) / F.sqrt(nn)
    c = cross(d, v1)
    parallel = F.sqrt(dot(c, c) / F.nullif(dot(v1, v1), F.lit(0.0)))
    return F.when(nn > 1e-18, skew).otherwise(parallel)


def _clamp(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def segment_distance(p1: list[Column], q1: list[Column], p2: list[Column], q2: list[Column]) -> Column:
    """Smallest distance between two segments: the interior optimum where it exists, else an end against the other segment."""
    def to_segment(x: list[Column], p: list[Column], q: list[Column]) -> Column:
        d = sub(q, p)
        t = _clamp(F.coalesce(dot(sub(x, p), d) / F.nullif(dot(d, d), F.lit(0.0)), F.lit(0.0)))
        r = [xi - (pi + t * di) for xi, pi, di in zip(x, p, d)]
        return dot(r, r)

    ends = F.least(to_segment(p1, p2, q2), to_segment(q1, p2, q2), to_segment(p2, p1, q1), to_segment(q2, p1, q1))
    u, v, w = sub(q1, p1), sub(q2, p2), sub(p1, p2)
    a, b, c, d, e = dot(u, u), dot(u, v), dot(v, v), dot(u, w), dot(v, w)
    den = a * c - b * b
    s, t = (b * e - c * d) / F.nullif(den, F.lit(0.0)), (a * e - b * d) / F.nullif(den, F.lit(0.0))
    r = [wi + s * ui - t * vi for wi, ui, vi in zip(w, u, v)]
    inside = (den > 1e-12) & s.between(0, 1) & t.between(0, 1)
    return F.sqrt(F.when(inside, F.least(dot(r, r), ends)).otherwise(ends))


def extended_to_box(p: list[Column], q: list[Column], box: list[tuple[float, float]]) -> tuple[list[Column], list[Column]]:
    """The segment's line cut at the faces of a box; the segment itself where the line misses the box."""
    d = sub(q, p)
    lo, hi = F.lit(float("-inf")), F.lit(float("inf"))
    for pi, di, (a, b) in zip(p, d, box):
        ta, tb = (a - pi) / F.nullif(di, F.lit(0.0)), (b - pi) / F.nullif(di, F.lit(0.0))
        lo = F.greatest(lo, F.coalesce(F.least(ta, tb), F.lit(float("-inf"))))
        hi = F.least(hi, F.coalesce(F.greatest(ta, tb), F.lit(float("inf"))))
    ok = (lo < hi) & (F.abs(lo) < 1e300) & (F.abs(hi) < 1e300)
    return [F.when(ok, pi + lo * di).otherwise(pi) for pi, di in zip(p, d)], [F.when(ok, pi + hi * di).otherwise(qi) for pi, di, qi in zip(p, d, q)]


def matched_segments(segments: DataFrame, by: list[str], dist_tol: float, angle_tol: float, endpoint_tol: float, reach: float | None = None) -> DataFrame:
    """``by, a, b, score``: segments of different TPCs that continue each other, each the best for both of its ends.

    Segments have id, tpc, px..pz, qx..qz, linearity. Pairs are sought among segments with an end in
    neighbouring grid cells (side ``reach``, twice the endpoint tolerance by default). The score is
    distance / tol + .45 endpoint distance / tol + .35 angle / tol - .15 the smaller linearity.
    """
    r = reach or 2 * endpoint_tol
    ends = segments.select(*by, "id", "tpc", F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("px").alias("x"), F.col("py").alias("y"), F.col("pz").alias("z")), F.struct(F.lit(1).alias("end"), F.col("qx").alias("x"), F.col("qy").alias("y"), F.col("qz").alias("z")))).alias("_e")).select(*by, "id", "tpc", "_e.*")
    near = within(ends, ends, r, by).where("l_id < r_id AND l_tpc <> r_tpc")
    best = near.groupBy(*by, F.col("l_id").alias("a"), F.col("r_id").alias("b")).agg(F.min(F.struct("dist", "l_end", "r_end")).alias("_n"))
    s = segments.drop("tpc")
    j = best.join(s.select(*by, *[F.col(c).alias(f"a_{c}" if c != "id" else "a") for c in s.columns if c not in by]), [*by, "a"])
    j = j.join(s.select(*by, *[F.col(c).alias(f"b_{c}" if c != "id" else "b") for c in s.columns if c not in by]), [*by, "b"])
    p1, q1, p2, q2 = (vec(*[f"{side}_{e}{axis}" for axis in "xyz"]) for side, e in (("a", "p"), ("a", "q"), ("b", "p"), ("b", "q")))
    d, angle = segment_distance(p1, q1, p2, q2), angle_deg(sub(q1, p1), sub(q2, p2))
    score = d / dist_tol + 0.45 * F.col("_n.dist") / endpoint_tol + 0.35 * angle / angle_tol - 0.15 * F.least("a_linearity", "b_linearity")
    ok = j.withColumn("_d", d).withColumn("_g", angle).withColumn("score", score).where((F.col("_d") <= dist_tol) & (F.col("_g") <= angle_tol) & (F.col("_n.dist") <= endpoint_tol))
    # each pair counts at an end of both its segments, and stays if it is the best at both
    sides = F.array(F.struct(F.col("a").alias("seg"), F.col("_n.l_end").alias("end")), F.struct(F.col("b").alias("seg"), F.col("_n.r_end").alias("end")))
    at = ok.select(*by, "a", "b", "score", F.inline(sides))
    w = Window.partitionBy(*by, "seg", "end").orderBy("score", "a", "b")
    first = at.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    return first.groupBy(*by, "a", "b").agg(F.first("score").alias("score"), F.count(F.lit(1)).alias("_k")).where("_k = 2").drop("_k")


def swap_candidates(tracks: DataFrame, centroids: DataFrame, by: list[str], energy_ratio: float = 0.5, least_shared: int = 1, most_other: int = 3, angle: float = 20.0, shared_yz: float = 35.0, endpoint_yz: float = 45.0) -> DataFrame:
    """Pairs of tracks sharing a TPC that could have swapped their times, with their priority.

    ``tracks``: by, cluster, energy, dx, dy, dz (unit), y1, z1, y2, z2 (ends). ``centroids``: by, cluster,
    tpc, yc, zc. Filters: energy ratio, shared TPCs, TPCs of one only, direction, mean distance of the
    shared TPCs' centroids, and of the nearest ends.
    """
    a, b = (centroids.select(*by, F.col("cluster").alias(s), "tpc", F.col("yc").alias(f"y{s}"), F.col("zc").alias(f"z{s}")) for s in ("a", "b"))
    shared = a.join(b, [*by, "tpc"]).where("a < b").groupBy(*by, "a", "b").agg(F.count(F.lit(1)).alias("n_shared"), F.avg(F.hypot(F.col("ya") - F.col("yb"), F.col("za") - F.col("zb"))).alias("shared_yz"))
    n = centroids.groupBy(*by, "cluster").agg(F.count_distinct("tpc").alias("_n"))
    t = tracks.join(n, [*by, "cluster"])
    cols = [c for c in t.columns if c not in (*by, "cluster")]
    ta, tb = (t.select(*by, F.col("cluster").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in cols]) for s in ("a", "b"))
    j = shared.join(ta, [*by, "a"]).join(tb, [*by, "b"])
    ratio = F.least("energy_a", "energy_b") / F.greatest(F.greatest("energy_a", "energy_b"), F.lit(1e-6))
    cos = F.abs(F.col("dx_a") * F.col("dx_b") + F.col("dy_a") * F.col("dy_b") + F.col("dz_a") * F.col("dz_b"))
    ends = F.least(*[F.hypot(F.col(f"y{i}_a") - F.col(f"y{k}_b"), F.col(f"z{i}_a") - F.col(f"z{k}_b")) for i in (1, 2) for k in (1, 2)])
    j = j.withColumns({"energy_ratio": ratio, "n_other": F.col("_n_a") + F.col("_n_b") - 2 * F.col("n_shared"), "cosine": cos, "endpoint_yz": ends})
    ok = j.where((F.col("energy_ratio") >= energy_ratio) & (F.col("n_shared") >= least_shared) & (F.col("n_other") <= most_other) & (F.col("cosine") >= F.cos(F.radians(F.lit(angle)))) & (F.col("shared_yz") <= shared_yz) & (F.col("endpoint_yz") <= endpoint_yz))
    priority = 5.0 * F.col("n_shared") - 1.5 * F.col("n_other") + 3.0 * F.col("energy_ratio") + 4.0 * F.col("cosine") - 0.08 * F.col("shared_yz") - 0.04 * F.col("endpoint_yz")
    return ok.select(*by, "a", "b", "n_shared", "n_other", "energy_ratio", "cosine", "shared_yz", "endpoint_yz", priority.alias("priority"))


def mixed_time_pairs(hits: DataFrame, key: str, t0: str, by: list[str], r: float = 4.0, most: int = 24, least_gap: float = 1.0) -> DataFrame:
    """``by, ta, tb, n_pairs, n_hits, rank``: pairs of times whose hits lie within ``r`` of each other, most pairs first.

    Times are rounded half to even; pairs of times less than ``least_gap`` apart are the same time.
    """
    p = hits.where(~F.isnan(t0) & (F.col(t0) >= 0)).select(*by, F.col(key).alias("k"), F.rint(t0).alias("t"), *XYZ)
    j = within(p, p, r, by).where(F.col("r_t") - F.col("l_t") >= least_gap)
    n = j.groupBy(*by, F.col("l_t").alias("ta"), F.col("r_t").alias("tb")).agg(F.count(F.lit(1)).alias("n_pairs"), F.count_distinct("l_k").alias("_a"), F.count_distinct("r_k").alias("_b"))
    w = Window.partitionBy(*by).orderBy(F.desc("n_pairs"), "ta", "tb")
    return n.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select(*by, "ta", "tb", "n_pairs", (F.col("_a") + F.col("_b")).alias("n_hits"), "rank")


def density_seeds(density: DataFrame, points: DataFrame, key: str, by: list[str], separation: float = 8.0, quantile: float = 0.8, most: int = 12) -> DataFrame:
    """``by, key, rank``: points of high density that no denser point lies within ``separation`` of, the densest first.

    Only points from the group's ``quantile`` of density on can be seeds. (Of equally dense
    neighbours the smaller key stands.)
    """
    cut = density.groupBy(*by).agg(F.percentile("rho", quantile).alias("_q"))
    high = density.join(cut, by).where(F.col("rho") >= F.col("_q")).select(*by, key, "rho").join(points.select(*by, key, *XYZ), [*by, key])
    p = high.withColumnRenamed(key, "k")
    beaten = within(p, p, separation, by).where("r_rho > l_rho OR (r_rho = l_rho AND r_k < l_k)").select(*by, F.col("l_k").alias(key)).distinct()
    w = Window.partitionBy(*by).orderBy(F.desc("rho"), key)
    return high.join(beaten, [*by, key], "left_anti").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select(*by, key, "rank")
