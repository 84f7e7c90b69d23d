"""Detector operators: literal edge cases, properties, and small brute-force checks."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tickloom.functions import arrays as A
from tickloom.functions import numeric as N
from tickloom.functions import scans as S
from tickloom.operators import components, flash, gaps, geometry, metrics, spatial, support, truth
from tickloom.operators.geometry import ND, TWO
from tickloom.sources import sinks, tables


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


# ---------------------------------------------------------------- literal cases
def test_backtrack_tie_and_empty(spark):
    df = spark.createDataFrame([(1, [7, 9], [0.5, 0.5]), (2, [-1, -1], [0.9, 0.1]), (3, [-1, 4, 5], [0.9, None, 0.2]), (4, None, None)], "hit_row int, segment_ids array<long>, fraction array<double>")
    assert {r.hit_row: r.segment_id for r in truth.best_segment(df).collect()} == {1: 7, 3: 5}
    assert {r.hit_row: r.segment_id for r in truth.first_segment(df).collect()} == {1: 7, 3: 4}


def test_gap_groups_literal(spark):
    df = spark.createDataFrame([(10.0,), (14.0,), (20.0,), (-1.0,), (float("nan"),), (None,)], "t0 double")
    assert [r.gap_id for r in gaps.gap_groups(df, "t0", 5).collect()].count(-1) == 3
    assert sorted(r.gap_id for r in gaps.gap_groups(df, "t0", 5).collect()) == [-1, -1, -1, 0, 0, 1]
    assert gaps.gap_groups(df.limit(0), "t0", 5).count() == 0


def test_merge_and_thinning_differ(spark):
    df = spark.createDataFrame([(0.0,), (4.0,), (8.0,), (12.0,)], "t double")
    assert [r.center for r in gaps.gap_medians(df, "t", 5).collect()] == [6.0]
    assert one(spark, gaps.thin(F.array(*[F.lit(float(x)) for x in (0, 4, 8, 12)]), 5)) == [0.0, 8.0]


def test_weighted_quantile_and_window_edge(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (3.0, 2.0), (9.0, None), (None, 1.0), (4.0, -1.0)], "x double, w double")
    assert metrics.weighted_quantiles(df, "x", "w", {"q": 0.5}).first()["q"] == 2.0
    r = spark.createDataFrame([(10.0, 0.0, 1.0), (10.0, 20.5, 1.0)], "t double, r double, e double")
    assert metrics.residual_summary(r, "t", "r", "e").first()["within_pct"] == 50.0
    assert [x.n for x in metrics.residual_summary(r.limit(0), "t", "r", "e").collect()] == [0]


def test_short_clip(spark):
    df = spark.createDataFrame([(40000.0,), (-40000.0,), (5.0,), (float("nan"),)], "v double")
    assert [r[0] for r in df.select(sinks.to_short(F.col("v"))).collect()] == [32767, -32768, 5, None]
    o = sinks.overflow_counts(df, "v", []).first()
    assert (o.n_high, o.n_low, o.largest) == (1, 1, 40000.0)


@pytest.mark.parametrize("hits,strict,enhanced", [([1], 0, 0), ([2], 1, 1), ([1, 3], 1, 1), ([1, 2], 1, 0), ([2, 2], 0, 0)])
def test_single_flash(spark, hits, strict, enhanced):
    df = spark.createDataFrame([(1, h) for h in hits], "g int, n_sum_hits int")
    assert flash.single_flash_strict(df, ["g"]).count() == strict
    assert flash.single_flash_enhanced(df, ["g"]).count() == enhanced


def test_io_groups(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (8,), (0,), (None,)], "g int")
    assert [tuple(r) for r in df.select(geometry.charge_tpc(F.col("g"), ND), geometry.charge_tpc(F.col("g"), TWO)).collect()] == [(0, 0), (0, 1), (1, 2), (3, 7), (None, None), (None, None)]
    with pytest.raises(Exception, match="io_group"):
        df.where("g = 0").select(geometry.charge_tpc(F.col("g"), ND, strict=True)).collect()


def test_zero_shift_of_the_two_kernels(spark):
    s = F.array(*[F.lit(float(v)) for v in (1, 2, 3)])
    assert one(spark, A.shift_interpolated(s, F.lit(0.0))) == [1.0, 2.0, 0.0]
    assert one(spark, A.shift_clamped(s, F.lit(0.0))) == [1.0, 2.0, 3.0]
    assert S.interpolated(np.array([[1.0, 2, 3]]), 0).tolist() == [[1, 2, 0]] and S.shifted(np.array([[1.0, 2, 3]]), 0).tolist() == [[1, 2, 3]]


def test_matched_filter_of_no_residual(spark):
    a, z = F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, A.matched_filter(a, z, z, a)) == 0.0


def test_prompt_out_of_range(spark):
    fp = spark.createDataFrame([(1, 10, -1), (1, 11, 5), (1, 12, 0)], "file_id int, final_row long, prompt_row long")
    h = spark.createDataFrame([(1, 0, 7.5, 3)], "file_id int, hit_row long, t0 float, cluster_id short")
    assert {r.final_row: (r.t0, r.cluster_id) for r in sinks.final_from_prompt(fp, h, ["file_id"]).collect()} == {10: (-1, -1), 11: (-1, -1), 12: (7.5, 3)}


def test_scatter_keeps_every_hit(spark):
    hits = spark.createDataFrame([(1, i) for i in range(5)] + [(1, 0)], "file_id int, hit_row long")
    sh = spark.createDataFrame([(1, 0, 3.0, 70000, True, 1), (1, 1, -2.0, 4, True, 1), (1, 2, float("nan"), None, True, 1), (1, 3, 9.0, 1, False, 1), (1, 9, 9.0, 1, True, 1), (1, 0, 5.0, 6, True, 2)], "file_id int, hit_row long, t0 double, cluster_id int, ok boolean, shard_id int")
    got = {r.hit_row: (r.t0, r.cluster_id) for r in sinks.scatter(hits, sh, ["file_id"]).collect()}
    assert got == {0: (5.0, 6), 1: (-1.0, 4), 2: (-1.0, -1), 3: (-1.0, -1), 4: (-1.0, -1)}


def test_dead_channel_texts():
    want = [(0, 1), (0, 2), (3, 4)]
    assert geometry.parse_dead_channels("0: [1, 2]\n3:\n  - 4\n") == want
    assert geometry.parse_dead_channels("- [0, 1]\n- 0,2 # x\n- [3, 4]") == want
    assert geometry.parse_dead_channels({0: [1, 2], 3: 4}) == geometry.parse_dead_channels(["0,1", (0, 2), [3, 4]]) == want


def test_write_mode_and_columns(spark):
    a, b = spark.createDataFrame([(1, 2)], "t_0 int, t_cluster_id int"), spark.createDataFrame([(1,)], "id int")
    assert tables.write_mode(a, a) == "A" and tables.write_mode(a, b) == "B"
    assert tables.resolve_columns(b, {"hit": ["nope", "ID"]}).columns == ["hit"]
    with pytest.raises(ValueError):
        tables.resolve_columns(b, {"x": ["y"]})


# ---------------------------------------------------------------- candidates
def test_candidate_bookkeeping(spark):
    c = F.array(*[F.struct(F.lit(float(t)).alias("t0"), F.lit(r).alias("received")) for t, r in ((10, False), (14, True), (40, False))])
    assert [tuple(x) for x in one(spark, flash.mark_assignment(c, F.lit(12.0), 5))] == [(12.0, True), (40.0, False)]
    assert [tuple(x) for x in one(spark, flash.mark_assignment(c, F.lit(12.0), 5, prefer_existing=True))] == [(14.0, True), (40.0, False)]
    v = F.array(F.lit(3.0), F.lit(9.0))
    assert one(spark, gaps.insert_candidate(v, F.lit(5.0), 2)) == [3.0, 9.0] and one(spark, gaps.insert_candidate(v, F.lit(5.5), 2)) == [3.0, 5.5, 9.0]
    assert one(spark, gaps.insert_candidate(v, F.lit(900.4), 2, 800)) == [3.0, 9.0, 800.0]
    assert one(spark, gaps.top_peaks(F.array(*[F.lit(float(x)) for x in (1, 9, 8, 2, 9, 0)]), 3, 2, 2.0)) == [1, 4]
    assert one(spark, flash.pad_flags(v, F.array(F.lit(True)))) == [True, False]


# ---------------------------------------------------------------- properties
@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 400), min_size=1, max_size=60), st.integers(1, 9))
def test_gap_groups_property(spark, values, window):
    df = spark.createDataFrame([(float(v), i) for i, v in enumerate(values)], "v double, i int")
    got = {r.i: r.gap_id for r in gaps.gap_groups(df, "v", window).collect()}
    g, prev, want = -1, None, {}
    for i in sorted(range(len(values)), key=lambda i: values[i]):
        g += prev is None or values[i] - prev > window
        want[i], prev = g, values[i]
    assert got == want


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10**6), st.integers(2, 120), st.floats(0.5, 3))
def test_pairs_components_and_density(seed, n, r):
    p = np.random.default_rng(seed).uniform(0, 6, (n, 3))
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
    a, b = N.radius_pairs(p, r)
    assert set(zip(a.tolist(), b.tolist())) == {(i, j) for i in range(n) for j in range(i + 1, n) if d[i, j] <= r}
    lab = N.dbscan_labels(p, r, 4)
    core = (d <= r).sum(1) >= 4
    assert ((lab >= 0) == [(core & (d[i] <= r)).any() for i in range(n)]).all()
    assert all(lab[i] == lab[j] for i in range(n) for j in range(n) if core[i] and core[j] and d[i, j] <= r)


def test_distance_joins_against_brute_force(spark):
    p = np.random.default_rng(2).uniform(-5, 5, (150, 3)).round(3)
    rows = [(i % 2, i, *map(float, v), i % 6) for i, v in enumerate(p)] + [(0, 900, None, 1.0, 1.0, 1), (0, 901, float("nan"), 1.0, 1.0, 1)]
    df = spark.createDataFrame(rows, "ev int, k int, x double, y double, z double, cluster int")
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
    same = (np.arange(150)[:, None] % 2) == (np.arange(150)[None] % 2)
    want = {(i, j) for i in range(150) for j in range(i + 1, 150) if same[i, j] and d[i, j] <= 1.5}
    assert {(r.a, r.b) for r in spatial.close_pairs(df, "k", 1.5, ["ev"]).collect()} == want
    cc = {r.k: r.component for r in components.radius_components(df.where("k < 900"), "k", 1.5, ["ev"]).collect()}
    root = N.components(150, *map(np.array, zip(*sorted(want))))
    assert cc == {i: int(root[i]) for i in range(150)}
    db = {r.k: r.cluster for r in components.dbscan(df.where("k < 900"), "k", 1.5, 3, ["ev"]).collect()}
    for e in (0, 1):
        ids = np.arange(e, 150, 2)
        lab = N.dbscan_labels(p[ids], 1.5, 3)
        mine = [db[int(i)] for i in ids]
        assert [x is None for x in mine] == (lab < 0).tolist() and len({(x, y) for x, y in zip(mine, lab) if x is not None}) == lab.max() + 1
    assert spatial.close_pairs(df.limit(0), "k", 1.5, ["ev"]).count() == 0


def test_long_chain_component(spark):
    n = 300
    nodes, edges = spark.range(n).withColumnRenamed("id", "node"), spark.range(n - 1).selectExpr("id AS a", "id + 1 AS b")
    assert {r.component for r in components.connected_components(nodes, edges).collect()} == {0}
    assert {r.component for r in components.connected_components(nodes, edges, group_edges=10).collect()} == {0}
    g = spark.createDataFrame([(i % 3, i, i + 3) for i in range(60)] + [(7, 1, 2)], "g int, a long, b long")
    v = spark.createDataFrame([(i % 3, i) for i in range(63)] + [(7, 1), (7, 2), (7, 3)], "g int, node long")
    for most in (1_000_000, 5):
        assert {(r.g, r.node, r.component) for r in components.connected_components(v, g, ["g"], group_edges=most).collect()} == {(i % 3, i, i % 3) for i in range(63)} | {(7, 1, 1), (7, 2, 1), (7, 3, 3)}


def test_principal_axes_match_numpy(spark):
    rng = np.random.default_rng(4)
    p = rng.normal(0, 1, (200, 3)) * [9, 2, 1] + [1000, -50, 3]
    e = rng.uniform(0.1, 5, 200)
    df = spark.createDataFrame([(i % 2, *map(float, v), float(w)) for i, (v, w) in enumerate(zip(p, e))] + [(5, 1.0, 2.0, 3.0, 1.0)], "g int, x double, y double, z double, energy double")
    for r in components.principal_axes(df, ["g"]).collect():
        if r.g == 5:
            assert (r.n_hits, r.linearity, r.length) == (1, 0.0, 0.0)
            continue
        at = np.arange(200) % 2 == r.g
        c, u, ev = N.principal(p[at], e[at])
        assert np.allclose([r.cx, r.cy, r.cz], c) and np.isclose(abs(np.dot([r.dx, r.dy, r.dz], u)), 1)
        assert np.isclose(r.linearity, ev[0] / ev.sum()) and np.isclose(r.length, np.ptp((p[at] - c) @ u)) and np.isclose(r.transverse_rms, np.sqrt(ev[1] + ev[2]))


def test_segment_and_line_distances(spark):
    rng = np.random.default_rng(6)
    rows = rng.normal(0, 3, (40, 12))
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows], ", ".join(f"c{i} double" for i in range(12)))
    v = [spatial.vec(*[f"c{3 * k + i}" for i in range(3)]) for k in range(4)]
    got = df.select(spatial.segment_distance(*v).alias("s"), spatial.line_distance(v[0], spatial.sub(v[1], v[0]), v[2], spatial.sub(v[3], v[2])).alias("l")).collect()
    t = np.linspace(0, 1, 201)
    for r, x in zip(got, rows):
        a, b, c, d = x.reshape(4, 3)
        p, q = a + t[:, None] * (b - a), c + t[:, None] * (d - c)
        brute = np.sqrt(((p[:, None] - q[None]) ** 2).sum(2)).min()
        assert r.s <= brute + 1e-9 and brute - r.s < 0.06
        assert np.isclose(r.l, N.line_line(a, b - a, c, d - c))


# ---------------------------------------------------------------- scans
def test_scans_agree_with_direct_sums():
    rng = np.random.default_rng(7)
    c, n, search = 3, 40, 25
    p = np.clip(rng.normal(0, 1, (c, n)), 0, None)
    base, var = rng.uniform(0, 1, (c, n)), rng.uniform(0.5, 2, (c, n))
    actual = base + S.shifted(p, 11) + rng.normal(0, 0.01, (c, n))
    sh = [S.shifted(p, s) for s in range(search + 1)]
    assert np.allclose(S.unit_scan(p, base, actual, search), [((base + q - actual) ** 2).mean() for q in sh])
    assert np.allclose(S.clipped_scan(p, base, actual, var, search, clip=1.5), [((np.minimum(base + q, 1.5) - actual) ** 2 / var).sum() for q in sh])
    assert np.allclose(S.cosine_scan(p, base, actual, var, search), [S.cosine_at(p, base, actual, var, s) for s in range(search + 1)])
    assert S.unit_scan(p, base, actual, search).argmin() == 11 and abs(S.refine_subtick(p, base, actual, var, 11.0) - 11) <= 0.1


def test_contingency_degenerate(spark):
    df = spark.createDataFrame([(-1, 0), (-1, 1), (-1, -1)], "r int, t int")
    m = metrics.contingency_metrics(df, "r", "t").first()
    assert (m.purity, m.efficiency, m.split_rate, m.merge_rate, m.ari, m.noise_share) == (0, 0, 1, 0, 0, 1)
    m = metrics.contingency_metrics(spark.createDataFrame([(0, 5)] * 3 + [(1, 6)] * 2, "r int, t int"), "r", "t").first()
    assert (m.purity, m.efficiency, m.split_rate, m.merge_rate, m.ari) == (1, 1, 0, 0, 1)


def test_support_without_light_is_empty(spark):
    df = spark.createDataFrame([(1, c, 0.0) for c in range(4)] + [(2, c, float(v)) for c, v in enumerate((90, 8, 2, 0))], "g int, channel int, light double")
    assert {(r.g, r.channel) for r in support.top_share(df, ["g"], "channel", "light", 0.9).collect()} == {(2, 0)}
    assert {(r.g, r.channel) for r in support.top_share(df, ["g"], "channel", "light", 0.9, 2.0).collect()} == {(2, 0), (2, 1), (2, 2)}
