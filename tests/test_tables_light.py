"""Tables, sinks, support and light operators on literal rows."""

import numpy as np
from pyspark.sql import functions as F

from tickloom.functions import arrays as A
from tickloom.operators import flash, geometry, light, metrics, spatial, support, truth
from tickloom.sources import sinks, tables


def test_files_and_assets(tmp_path, spark):
    for n in ("b.txt", "a.txt", "sub/a.txt"):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_text("x")
    seen = []
    got = tables.expand_files([f"{tmp_path}/b*", f"{tmp_path}/*.txt", f"{tmp_path}/none*"], seen.append)
    assert [g.split("/")[-1] for g in got] == ["b.txt", "a.txt"] and len(seen) == 1
    assert tables.first_asset(["/nowhere", str(tmp_path / "a.txt")]) == str(tmp_path / "a.txt")
    assert tables.missing_assets({"a": ["/nowhere"], "b": [str(tmp_path)]}) == ["a"]
    assert tables.find_files(spark, str(tmp_path), "a.txt").count() == 2
    assert isinstance(tables.register_hdf5(spark), bool)


def test_lookup_tables(spark):
    t = tables.lookup_rows(spark, [(0, 1), (0, 2), (3, 4)], [5, None, 7], ["a", "c"], "v")
    df = spark.createDataFrame([(0, 1), (0, 2), (9, 9)], "a int, c int")
    assert [r.v for r in tables.lookup(df, t, ["a", "c"], "v", -1).orderBy("a", "c").collect()] == [5, -1, -1]
    inv = geometry.invert_map(spark.createDataFrame([(0, 1, 5, 1), (0, 2, 5, 2), (0, 3, None, 3)], "adc int, ch int, tpc int, o int"), ["adc", "ch"], ["tpc"], "o")
    assert [tuple(r) for r in inv.collect()] == [(5, 0, 2)]


def test_events_load_and_report_what_is_missing(spark):
    hits = spark.createDataFrame([(1, 1.0, 1.0, 1.0, 2.0, 1), (2, float("nan"), 1.0, 1.0, 2.0, 1), (3, 1.0, 1.0, 1.0, None, 1)], "hit_row long, x double, y double, z double, e double, event_id int")
    eh = spark.createDataFrame([(10, 1), (10, 1), (10, 2), (11, 3), (12, 9), (None, 1), (10, None)], "event_id long, hit_row long")
    cl = spark.createDataFrame([(10, 100, 2), (10, 99, 1), (11, None, 3), (12, 5, 4), (10, -1, 0)], "event_id long, light_id long, ref_id long")
    got = tables.load_events(hits, eh, cl, finite_only=True).collect()
    assert [(r.event_id, r.hit_row, r.light_id) for r in got] == [(10, 1, 99)]
    ev = spark.createDataFrame([(10,), (11,), (12,), (10,), (None,)], "event_id long")
    assert {r.event_id for r in tables.list_events(ev, cl).collect()} == {10, 12}
    assert {r.event_id for r in tables.list_events(ev, cl.limit(0)).collect()} == {10, 11, 12}
    st = {r.event_id: (r.ok, r.n_hits) for r in sinks.status_rows(ev.where("event_id IS NOT NULL"), tables.load_events(hits, eh, cl).withColumn("error", F.lit(None).cast("string")), ["event_id"]).collect()}
    assert st == {10: (True, 2), 11: (False, 0), 12: (False, 0)}


def test_current_rows_and_work_list(spark):
    v = spark.createDataFrame([(1, 1, None, "a"), (1, 2, None, "b"), (2, 1, None, "c"), (2, 1, 5, "c"), (3, 1, 2, "d")], "k int, ingest_ts int, removed_ts int, v string")
    assert {(r.k, r.v) for r in tables.current_rows(v, "k").collect()} == {(1, "b")}
    rows = [(f % 3, e) for f, e in enumerate(np.random.default_rng(0).integers(0, 500, 200).tolist())]
    df = spark.createDataFrame(rows, "file_id int, event_id int")
    order = sorted(set(rows))
    for off in (0, 3):
        assert sorted((r.file_id, r.event_id) for r in sinks.work_list(df, "file_id", "event_id", 4, off, slices=7).collect()) == order[off::4]


def test_overwrite_and_moves(spark):
    h = spark.createDataFrame([(1, 5, 0), (2, 0, 7)], "hit_row int, t_0 short, t_cluster_id short")
    r = spark.createDataFrame([(1, 9, 3)], "hit_row int, t_0 short, t_cluster_id short")
    out, before = sinks.overwrite_columns(h, r, ["hit_row"], ["t_0", "t_cluster_id"])
    assert {tuple(x) for x in out.collect()} == {(1, 9, 3), (2, 0, 7)} and tuple(before.first()) == (1, 1)
    lab = spark.createDataFrame([(1, i, 0) for i in range(4)], "event_id int, hit_row int, cluster_id int")
    mv = spark.createDataFrame([(1, "b", 1, [1, 2]), (1, "a", 9, [2, 3])], "event_id int, kind string, seq int, hits array<int>")
    assert {r.hit_row: r.cluster_id for r in sinks.move_relabel(lab, mv, ["event_id"]).collect()} == {0: 0, 1: 2, 2: 2, 3: 1}


def test_training_samples_mark_dead_channels(spark):
    hits = spark.createDataFrame([(1, 0, 0.1, 2.0), (1, 0, 0.2, 3.0), (1, 0, 9.9, 1.0), (2, 0, 0.0, 1.0)], "ev int, tpc int, x double, e double")
    lit = spark.createDataFrame([(1, 0, 0, 5, 1, [1.0, 4.0]), (1, 0, 0, 4, 0, [2.0])], "ev int, tpc int, adc int, ch int, channel int, samples array<float>")
    dead = spark.createDataFrame([(0, 5)], "adc int, ch int")
    s = tables.training_samples(spark.createDataFrame([(1, 0), (2, 0)], "ev int, tpc int"), hits, lit, {"x": (0.0, 10.0, 5)}, ["ev", "tpc"], dead).collect()
    assert len(s) == 1 and [tuple(v) for v in s[0].voxels] == [(0, 5.0), (4, 1.0)] and s[0].targets == [2.0, -10000.0]


# ---------------------------------------------------------------- light
def lit(spark, n=6, ticks=30):
    rows = []
    for c in range(n):
        a, m = [0.0] * ticks, [0.0] * ticks
        m[12] = 1000.0 if c < 4 else 100.0
        a[20] = 700.0
        rows.append((1, 0, c, a, m, [10.0] * ticks))
    return spark.createDataFrame(rows, "ev int, tpc int, channel int, actual array<double>, model array<double>, std array<double>")


R = light.LightRules(peak=10, half_window=3, least_channels=3, least_deficit=100.0)


def test_window_summaries_and_rankings(spark):
    c = spark.createDataFrame([(1, 0, 2.0), (1, 0, 10.0), (1, 0, 25.0), (1, 0, 2.0)], "ev int, tpc int, t0 double")
    s = light.window_summaries(lit(spark), c, ["ev", "tpc"], R)
    got = {r.t0: r for r in s.collect()}
    assert set(got) == {2.0, 10.0}
    assert (got[2.0].overflow_channels, got[2.0].window_overflow, got[2.0].peak_overflow) == (4, 4000.0, 4000.0)
    assert got[2.0].severity == 4000 / 4 + 0.002 * 4000 and (got[10.0].deficit_channels, got[10.0].window_deficit) == (6, 4200.0)
    assert [r.t0 for r in light.overflow_ranking(s, ["ev"], rules=R).collect()] == [2.0]
    assert [r.t0 for r in light.destination_ranking(s, ["ev", "tpc"], F.lit(2.0), 5.0, R).collect()] == [10.0]
    ticks = light.window_ticks(c, ["ev", "tpc"], 30, 3, 10)
    assert sorted(r.tick for r in ticks.collect()) == [9, 10, 11, 12, 13, 14, 15, *range(17, 24)]
    assert light.window_ticks(c.where("t0 > 20"), ["ev", "tpc"], 30, 3, 10).count() == 30
    assert light.window_chi2(lit(spark), ticks, ["ev", "tpc"], 1.0).first()["dof"] == 14 * 6
    holes = light.residual_holes(lit(spark), c, ["ev", "tpc"], 0.5, 3, 10).collect()
    assert holes == []  # the only hole is the brightest


def test_gates(spark):
    t = spark.createDataFrame([(20, 12, 500.0, 50.0, False, 1, False), (20, 13, 900.0, 1.0, False, 1, False), (20, 0, 499.0, 1.0, False, 1, False), (20, 0, 900.0, 1.0, True, 4, False), (20, 0, 900.0, 1.0, True, 4, True), (20, 0, None, 1.0, None, None, None)], "channels_before int, channels_after int, dchi2 double, energy double, track_like boolean, n_tpcs int, forced boolean")
    assert [r.accepted for r in light.light_gate(t).collect()] == [True, False, False, False, True, False]
    assert [r[0] for r in t.select(light.force_override({"dchi2": 500.0, "channels_before": 20})).collect()] == [True, True, False, True, True, False]


def test_images_and_peaks(spark):
    base = spark.createDataFrame([(1, 0, [1.0, 1.0, 1.0]), (1, 1, [0.0, 0.0, 5.0])], "ev int, channel int, samples array<double>")
    img = spark.createDataFrame([(1, 0, [2.0, 0.0, 0.0], 1.0), (1, 0, [-9.0, 0.0, 0.0], 0.0)], "ev int, channel int, samples array<double>, t0 double")
    assert {r.channel: r.samples for r in light.add_images(base, img, ["ev"]).collect()} == {0: [0.0, 3.0, 1.0], 1: [0.0, 0.0, 5.0]}
    assert tuple(light.event_peak(base, ["ev"]).first()) == (1, 2, 1, 5.0)
    f = geometry.fill_channels(base.where("channel = 1").withColumn("tpc", F.lit(0)), spark.createDataFrame([(0, c) for c in range(3)], "tpc int, channel int"), ["ev"], 2, 7.0)
    assert {r.channel: r.samples for r in f.collect()} == {0: [7.0, 7.0], 1: [0.0, 0.0, 5.0], 2: [7.0, 7.0]}
    p = light.waveform_pairs(base.withColumn("peak", F.lit(10.0)), F.array(*[F.lit(v) for v in (0.0, 1.0, 0.5)]), ["ev"])
    assert p.first()["predicted"] == [0.0, 0.0, 10.0]
    t = spark.range(1).select(A.default_template(6, 3, 2.0).alias("t")).first()["t"]
    assert np.allclose(t, [0, 1 / 3, 2 / 3, 1, np.exp(-0.5), np.exp(-1)])


def test_support_runs_veto_and_widening(spark):
    df = spark.createDataFrame([(1, c, v) for c, v in ((0, 50.0), (3, 40.0), (7, 30.0), (10, 60.0), (11, 1.0))], "g int, channel int, light double")
    runs = {r["side"]: (r["first"], r["last"]) for r in support.side_runs(df, ["g"], "channel", "light", 9, 0.99, 2).collect()}
    assert runs == {0: (0, 3), 1: (10, 10)}
    assert {r.channel for r in support.widened(df.where("channel = 0"), ["g"], 12, 3, 1).collect()} == set(range(6))
    allc = spark.createDataFrame([(1, c) for c in range(4)], "g int, channel int")
    sup, veto = spark.createDataFrame([(1, 0), (1, 1)], "g int, channel int"), spark.createDataFrame([(1, 0)], "g int, channel int")
    assert [r.channel for r in support.apply_veto(sup, veto, allc, ["g"], ["g"]).collect()] == [1]
    both = spark.createDataFrame([(1, 0), (1, 1)], "g int, channel int")
    assert sorted(r.channel for r in support.apply_veto(sup, both, allc, ["g"], ["g"]).collect()) == [2, 3]
    n = support.normalized_delta(spark.createDataFrame([(1, -4.0, 1.0, 4.0), (1, 2.0, 1.0, 4.0), (2, 0.0, 1.0, 1.0)], "c int, d double, e double, a double"), ["c"], "d", "e", "a")
    assert sorted(r.score for r in n.collect()) == [-0.5, 0.0, 0.25]


def test_segments_that_continue_each_other(spark):
    rows = [(1, 0, 0, *(0, 0, 0), *(30, 0, 0), 0.99), (1, 1, 1, *(31, 0.5, 0), *(60, 1, 0), 0.98), (1, 2, 1, *(31, 30, 0), *(60, 60, 0), 0.98), (1, 3, 0, *(31, 0, 0), *(50, 0, 0), 0.9)]
    s = spark.createDataFrame([(*r[:3], *map(float, r[3:])) for r in rows], "ev int, id int, tpc int, px double, py double, pz double, qx double, qy double, qz double, linearity double")
    assert [(r.a, r.b) for r in spatial.matched_segments(s, ["ev"], 5.0, 12.0, 40.0).collect()] == [(1, 3)]
    assert [(r.a, r.b) for r in spatial.matched_segments(s.where("id < 3"), ["ev"], 5.0, 12.0, 40.0).collect()] == [(0, 1)]


def test_time_relations(spark):
    l = spark.createDataFrame([(1, 10.0), (1, 20.0), (2, 5.0)], "g int, t double")
    r = spark.createDataFrame([(1, 15.0, "a"), (1, 26.0, "b"), (2, 10.0, "c")], "g int, u double, n string")
    assert {(x.t, x.n) for x in flash.near_pairs(l, r, ["g"], "t", "u", 5.0).collect()} == {(10.0, "a"), (20.0, "a"), (5.0, "c")}
    c = spark.createDataFrame([(1, 0.2), (1, 10.0), (1, 13.0), (1, 40.0)], "g int, t0 double")
    assert sorted(x.t0 for x in flash.canonical_insert(c, ["g"], F.lit(12.0), 5.0).collect()) == [12.0, 40.0]
    ev = spark.createDataFrame([(1, 5.0, 2.0), (2, float("nan"), 1.0), (3, None, None)], "event_id int, unix_ts double, unix_ts_usec double")
    li = spark.createDataFrame([(7, [3.0]), (8, [])], "light_id int, utime_ms array<double>")
    rf = spark.createDataFrame([(2, 7), (3, 8)], "event_id int, light_id int")
    assert {x.event_id: x.reference_ns for x in truth.reference_time_ns(ev, li, rf).collect()} == {1: 5e9 + 2e3, 2: 3e6, 3: None}


def test_scores(spark):
    d = spark.createDataFrame([(0, 1.0, 1.0), (0, 2.0, 4.0), (0, 3.0, 3.0), (1, 5.0, 5.0)], "c int, w double, g double")
    r = {x.c: x for x in metrics.regression_scores(d, ["c"], F.col("w"), F.col("g"), F.lit(True)).collect()}
    assert np.isclose(r[0].r2, 1 - (4 / 3) / (2 / 3)) and r[1].r2 == 1.0
    s = metrics.standardizer(d, ["c"], F.col("w"), F.col("w") > 1).where("c = 0").first()
    assert (s.n, s.mean, s.std) == (2, 2.5, 0.5)
    h = metrics.weighted_histogram(spark.createDataFrame([(-200.0, 1.0), (200.0, 1.0), (0.0, 2.0), (999.0, 4.0)], "x double, w double"), "x", "w", -200, 200, 5)
    assert {x.bin: x.weight_share for x in h.collect()} == {0: 0.125, 79: 0.125, 40: 0.25}


FAKE_H5PY = """
import numpy as np


class File:
    def __init__(self, path, mode="r"):
        self.tables = np.load(path)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.tables.close()

    def __getitem__(self, name):
        return self.tables[name]
"""


def test_hdf5_tables_by_a_stand_in(spark, tmp_path, monkeypatch):
    """The data source over a stand-in for h5py, which is not installed here: all rows of all files, row numbers, chosen columns."""
    import sys

    if "h5py" not in sys.modules:
        module = tmp_path / "h5py.py"
        module.write_text(FAKE_H5PY)
        monkeypatch.syspath_prepend(str(tmp_path))
        spark.sparkContext.addPyFile(str(module))
    rows = np.array([(i, 0.5 * i, i % 3) for i in range(7)], dtype=[("id", "i8"), ("E", "f8"), ("io_group", "i4")])
    for name in ("a.npz", "b.npz"):
        with open(tmp_path / name, "wb") as f:
            np.savez(f, hits=rows)
    assert tables.register_hdf5(spark)
    df = spark.read.format("hdf5_table").schema("row long, id long, E double").option("path", f"{tmp_path}/*.npz").option("dataset", "hits").load()
    got = sorted((r.row, r.id, r.E) for r in df.collect())
    assert got == sorted([(i, i, 0.5 * i) for i in range(7)] * 2)
    assert df.where("id > 4").agg({"E": "sum"}).first()[0] == 2 * (2.5 + 3.0)
    monkeypatch.delitem(sys.modules, "h5py", raising=False)
