"""Stages of the matching pipeline on simulated events whose times are known."""

import numpy as np
from pyspark.sql import functions as F

from tickloom.functions import numeric as N
from tickloom.functions import scans as S
from tickloom.stages import labels as L
from tickloom.stages import match as M
from tickloom.stages import models, pipeline

TICKS, PEAK, SEARCH = 120, 20, 80
RULES = M.rules_of("2x2", search=SEARCH, peak=PEAK, half_window=8)


def line(rng, a, b, n, width=0.2):
    t = rng.uniform(0, 1, n)[:, None]
    return np.asarray(a) + t * (np.asarray(b) - np.asarray(a)) + rng.normal(0, width, (n, 3))


def event(seed=0, reach=150.0):
    """A track through two TPCs and two blobs, each with its own time; the light is the model's own plus noise."""
    rng = np.random.default_rng(seed)
    parts = [(line(rng, (0, -50, 0), (60, 50, 40), 160), 12.0), (rng.normal((-40, 20, 60), 1.0, (60, 3)), 33.0), (rng.normal((-40, -40, -60), 1.0, (40, 3)), 55.0)]
    xyz = np.concatenate([p for p, _ in parts])
    true = np.concatenate([np.full(len(p), t) for p, t in parts])
    tpc = (xyz[:, 0] > 30).astype(int)
    e = rng.uniform(0.5, 1.5, len(xyz))
    model = models.LinearLight(12, TICKS, PEAK, reach=reach)
    actual = {}
    for t in (0, 1):
        img = sum(S.shifted(model.image(*xyz[(true == x) & (tpc == t)].T, e[(true == x) & (tpc == t)], t), x) for x in np.unique(true))
        actual[t] = img + rng.normal(0, 5, img.shape)
    return xyz, e, tpc, actual, {t: np.full_like(a, 100.0) for t, a in actual.items()}, model, true


def test_times_are_recovered():
    xyz, e, tpc, actual, var, model, true = event()
    o = pipeline.Options("2x2", iters=150, rules=RULES, reach=1.1, colocate=True)
    ev = pipeline.run_event(xyz, e, tpc, actual, var, {0: [12.0, 33.0, 55.0], 1: [12.0]}, model, o)
    got = np.isfinite(ev.t0)
    assert got.mean() > 0.95 and (np.abs(ev.t0 - true)[got] <= 2).mean() > 0.95
    assert ev.backbone == 1 and ev.kind[0] == "track"


def test_nd_times_and_frozen_tracks():
    xyz, e, tpc, actual, var, model, true = event(1)
    rules = M.rules_of("nd", search=SEARCH, peak=PEAK, half_window=8)
    o = pipeline.Options("nd", iters=150, rules=rules, eps=2.5, absorb=True, rescue=True, expand=True, grow=True)
    ev = pipeline.run_event(xyz, e, tpc, actual, var, {0: [33.0, 55.0]}, model, o)
    got = np.isfinite(ev.t0)
    assert got.mean() > 0.9 and (np.abs(ev.t0 - true)[got] <= 2).mean() > 0.9
    snap = M.snapshot(ev)
    assert M.changed_since(ev, snap) == 0
    ev.t0[snap[0][:3]] += 1
    assert M.changed_since(ev, snap) == 3


def placed(times, **how):
    xyz, e, tpc, actual, var, model, true = event(**how)
    ev = M.Event(xyz, e, tpc, actual, var, model, RULES, candidates={0: [12.0, 33.0, 55.0], 1: [12.0]})
    ev.label = np.unique(true, return_inverse=True)[1]
    ev.images = ev.predict()
    for c, t in enumerate(times):
        ev.assign(c, t, "test")
    return ev, true


def test_wrong_times_are_mended():
    ev, _ = placed([12.0, 55.0, 33.0])
    assert M.swap_tracks(ev, [(1, 2)]) == 1 and (ev.place[1], ev.place[2]) == (33.0, 55.0)
    ev, _ = placed([12.0, 36.0, 55.0])
    M.refine_blobs(ev)
    assert abs(ev.place[1] - 33) <= 1
    ev, _ = placed([12.0, 33.0, 57.0])
    ev.rules = M.rules_of("2x2", search=SEARCH, peak=PEAK, large_energy=10.0)
    assert M.grid_correct(ev) >= 1 and ev.place[2] == 55.0
    ev, _ = placed([12.0, 33.5, 55.0])
    ev.backbone = 3
    M.fine_correct(ev)
    assert ev.place[1] == 33.0


def test_light_rescue_moves_the_donor_home():
    ev, true = placed([12.0, 55.0, 55.0])
    ev.rules = M.rules_of("2x2", search=SEARCH, peak=PEAK, half_window=8, gate_channels=1, least_channels=3)
    assert M.light_rescue(ev, passes=2) >= 1
    assert (np.abs(ev.t0[true == 33.0] - 33) < 1).all() and ev.moves[0]["new"] == 33.0
    assert M.relabel_moves(ev).max() == 3


def test_late_donors_are_permuted_home():
    # both blobs stand at the other's time; many earlier candidates must not crowd these out of the pool
    ev, true = placed([12.0, 55.0, 33.0], reach=40.0)
    ev.candidates = {0: [1.0, 3.0, 5.0, 7.0, 12.0, 33.0, 55.0], 1: [12.0]}
    ev.rules = M.rules_of("2x2", search=SEARCH, peak=PEAK, half_window=8, gate_channels=99, least_channels=1, severe=1.0, overflow_adc=20.0, model_adc=20.0)
    severe = [(x, M.overflow(ev, 0, x)) for x in (33.0, 55.0)]
    gain = M.gates(ev.rules, False)[1]
    copy = ev.t0.copy()
    assert M.permute_donors(ev, 0, severe, M.Gates(0, gain.chi2, 1e9), set()) == 0 and (ev.t0[np.isfinite(copy)] == copy[np.isfinite(copy)]).all()  # too little for each MeV
    assert M.light_rescue(ev) == 2 and {m["kind"] for m in ev.moves} == {"reshuffle"}
    for t in (33.0, 55.0):
        assert (np.abs(ev.t0[true == t] - t) < 1).mean() > 0.9


def test_later_passes_ask_for_more_and_extreme_overflow_overrides_the_veto():
    r = M.rules_of("nd")
    (single, joint), (late, late_joint) = M.gates(r, False), M.gates(r, True)
    assert (single.channels, single.chi2, single.per_mev) == (8, 500.0, 10.0) and (late.channels, late.chi2, late.per_mev) == (12, 2000.0, 25.0)
    assert (joint.chi2, joint.per_mev) == (500.0, 10.0) and (late_joint.chi2, late_joint.per_mev) == (2000.0, 25.0)
    assert single.passed(8, 500.0, 50.0) and not single.passed(7, 500.0, 50.0) and not single.passed(8, 500.0, 51.0) and not single.passed(8, 499.0, 1.0)
    ev, _ = placed([12.0, 33.0, 55.0])
    assert M.overridden(ev, (22, 250.0, 1e6, 12), 14, 5000.0, 100.0)
    for over, fewer, gain, energy in (((21, 250.0, 0.0, 12), 14, 5000.0, 100.0), ((22, 249.0, 0.0, 12), 14, 5000.0, 100.0), ((22, 250.0, 0.0, 11), 14, 5000.0, 100.0), ((22, 250.0, 0.0, 12), 13, 5000.0, 100.0), ((22, 250.0, 0.0, 12), 14, 5000.0, 101.0)):
        assert not M.overridden(ev, over, fewer, gain, energy)


def test_small_phase_and_beam_place_by_candidates():
    for how in (M.place_small, lambda ev, c: M.place_beam(ev, 0, c)):
        ev, _ = placed([12.0])
        ev.rules = M.rules_of("nd", search=SEARCH, peak=PEAK)
        how(ev, [1, 2])
        assert abs(ev.place[1] - 33) <= 2 and abs(ev.place[2] - 55) <= 2


def test_family_and_region_take_neighbours():
    rng = np.random.default_rng(3)
    ev, _ = placed([12.0, 33.0, 55.0])
    near = rng.normal((-38.5, 20, 60), 0.5, (15, 3))
    for grow in (M.family_expand, lambda e: M.region_grow(e, least_cos=0.0, seed_cos=0.0, margin=1.0)):
        ev, _ = placed([12.0, 33.0, 55.0])
        ev.xyz, ev.e = np.concatenate([ev.xyz, near]), np.concatenate([ev.e, np.full(15, 1.0)])
        ev.tpc, ev.t0 = np.concatenate([ev.tpc, np.zeros(15, int)]), np.concatenate([ev.t0, np.full(15, np.nan)])
        ev.label = np.concatenate([ev.label, np.full(15, 3)])
        ev.images[(3, 0)] = ev.image(np.nonzero(ev.label == 3)[0], 0)
        assert grow(ev) >= 1 and ev.place[3] == 33.0


def test_absorption_respects_capacity():
    assert [L.capacity(*a) for a in (("track", 100), ("shower", 400), ("cluster", 60), ("cluster", 30))] == [0, 50, 12, 6]
    label = np.array([0] * 10 + [-1] * 5)
    p = np.column_stack([np.arange(15.0), np.zeros(15), np.zeros(15)])
    assert (L.adopt_noise(label, L.noise_list(p, label), 0) == 0).sum() == 12


def test_tracks_across_tpcs_join():
    rng = np.random.default_rng(5)
    p = line(rng, (-60, 0, 0), (60, 30, 20), 400)
    lab = L.labels_nd(p, np.ones(400), (p[:, 0] > 0).astype(int), iters=200)
    assert lab.backbone == 1 and (lab.label == 0).mean() > 0.95
    for how in ("nhc", "hca", "dvfs", "spectral"):
        assert L.labels_nd(p, np.ones(400), (p[:, 0] > 0).astype(int), how=how, iters=200).backbone >= 1


def test_line_helpers():
    rng = np.random.default_rng(8)
    p = np.concatenate([line(rng, (0, 0, 0), (50, 0, 0), 80), line(rng, (0, 30, 0), (0, 30, 60), 60), rng.uniform(-80, 80, (20, 3))])
    lab = N.fit_track_labels(p, rss_cut=1e3, iters=300)
    assert {np.bincount(lab[:80] + 1).argmax(), np.bincount(lab[80:140] + 1).argmax()} == {1, 2} and (lab[140:] >= 0).sum() < 4
    curve = N.rss_curve(p[:140], lab[:140])
    assert [k for k, *_ in curve] == [1, 2] and curve[1][1] < curve[0][1] and N.choose_k(curve, 0) in (1, 2) and N.choose_k([], 1) == 0
    gap = np.concatenate([np.linspace(0, 10, 30), np.linspace(30, 60, 40)])
    q = np.column_stack([gap, np.zeros(70), np.zeros(70)])
    assert (N.densest_stretch(q, np.zeros(70, int)) == 0).sum() == 30
    two = np.concatenate([rng.normal(0, 1, (60, 3)), rng.normal(12, 1, (60, 3))])
    assert N.gmm_split(two).max() == 1 and L.split_mixed(two, np.zeros(120, int), [0]).max() == 1


def naive_time(image, base, actual, var, search, mean=False):
    """The shift of lowest chi2, by shifting and summing cell by cell."""
    best = None
    for s in range(search + 1):
        moved = np.zeros_like(image)
        moved[:, s:] = image[:, : image.shape[1] - s]
        loss = ((np.minimum(base + moved, 60780.0) - actual) ** 2 / var)
        loss = loss.mean() if mean else loss.sum()
        if best is None or loss < best[0]:
            best = (loss, s)
    return best[1]


def test_both_detectors_on_a_fixed_event_worked_out_by_hand(spark):
    """Four TPCs with a blob each: no light is shared, so each time is the lowest point of its own curve, here found again without the stages."""
    rng = np.random.default_rng(11)
    model = models.LinearLight(12, TICKS, PEAK)
    times = [7.0, 21.0, 40.0, 63.0]
    places = [(-100, -50, 400), (100, 60, -300), (-90, 80, -200), (80, -70, 250)]
    hits, light, want = [], [], {}
    for t, when in enumerate(times):
        p = rng.normal(places[t], 0.8, (70, 3))
        e = rng.uniform(0.5, 1.5, 70)
        img = model.image(*p.T, e, t)
        a = S.shifted(img, when) + rng.normal(0, 3, img.shape)
        hits += [(5, 100 * t + i, *map(float, q), float(w), t) for i, (q, w) in enumerate(zip(p, e))]
        light += [(5, t, c, a[c].tolist(), [50.0] * TICKS, [when]) for c in range(12)]
        want[t] = naive_time(img, np.zeros_like(img), a, 50.0, SEARCH)
    assert want == dict(enumerate(times))
    h = spark.createDataFrame(hits, "event_id long, hit_row long, x double, y double, z double, e double, tpc int")
    l = spark.createDataFrame(light, "event_id long, tpc int, channel int, samples array<double>, variance array<double>, seeds array<double>")
    for o in (pipeline.Options("2x2", iters=100, rules=RULES, grow=True, colocate=True, rescue=True, expand=True), pipeline.Options("nd", iters=100, rules=M.rules_of("nd", search=SEARCH, peak=PEAK, half_window=8), eps=3.0, rescue=True, absorb=True, expand=True)):
        got = pipeline.match(h, l, o, lambda: models.LinearLight(12, TICKS, PEAK)).toPandas()
        assert len(got) == len(hits) and got.error.isna().all()
        for t, when in want.items():
            own = got[(got.tpc == t) & (got.cluster_id >= 0)]
            assert len(own) >= 60 and (np.abs(own.t0 - when) <= 1).all(), (o.detector, t, own.t0.unique())


def test_pipeline_in_spark_reports_failures(spark):
    xyz, e, tpc, actual, var, model, true = event()
    hits = [(1, i, *map(float, p), float(w), int(t)) for i, (p, w, t) in enumerate(zip(xyz, e, tpc))]
    hits += [(2, i, *r[2:]) for i, r in enumerate(hits[:5])] + [(1, 9999, float("nan"), 0.0, 0.0, 1.0, 0), hits[0]]
    h = spark.createDataFrame(hits, "event_id long, hit_row long, x double, y double, z double, e double, tpc int").withColumn("samples", F.lit(0))
    light = [(1, t, c, actual[t][c].tolist(), var[t][c].tolist(), [12.0, 33.0, 55.0]) for t in (0, 1) for c in range(12)]
    l = spark.createDataFrame(light, "event_id long, tpc int, channel int, samples array<double>, variance array<double>, seeds array<double>")
    out = pipeline.match(h, l, pipeline.Options("2x2", iters=100, rules=RULES), lambda: models.LinearLight(12, TICKS, PEAK))
    p = out.toPandas().set_index("hit_row")
    one = p[p.event_id == 1].sort_index()
    assert len(one) == len(true) and (np.abs(one.t0.to_numpy() - true) <= 2).mean() > 0.9
    s = {r.event_id: (r.ok, r.error) for r in pipeline.status(out).collect()}
    assert s[1] == (True, None) and s[2] == (False, "ValueError: no light")
    assert pipeline.match(h.limit(0), l, pipeline.Options()).count() == 0
    # an event too large for one task is matched TPC by TPC: every hit has a result, no cluster reaches over two TPCs
    q = pipeline.match(h, l, pipeline.Options("2x2", iters=100, rules=RULES), lambda: models.LinearLight(12, TICKS, PEAK), whole_hits=50).toPandas().set_index("hit_row")
    one = q[q.event_id == 1].sort_index()
    assert len(one) == len(true) and (np.abs(one.t0.to_numpy() - true) <= 2).mean() > 0.9
    assert (one[one.cluster_id >= 0].groupby("cluster_id").tpc.nunique() == 1).all() and one.error.isna().all()
    assert set(q[q.event_id == 2].error) == {"ValueError: no light"}


def test_models_in_spark(spark):
    h = spark.createDataFrame([(1, 0, 1.0, 2.0, 3.0, 4.0), (1, 1, 1.0, 2.0, 3.0, 0.0)], "cluster int, tpc int, x double, y double, z double, e double")
    img = {(r.tpc, r.channel): r.samples for r in models.predict_images(h, ["cluster"], lambda: models.LinearLight(4, 30, 10)).collect()}
    assert len(img) == 8 and max(img[(0, 0)]) > 0 and max(img[(1, 0)]) == 0
    w = models.RestrictedLight(models.LinearLight(24, 30, 10), share=0.3, group=2)
    x = np.zeros(3)
    assert (w.image(x, x - 60, x, x + 5, 0).max(1) > 0).sum() < 24
    b = models.predict_batches(spark.createDataFrame([([1.0, 2.0],), ([3.0, 4.0],)], "a array<double>"), "a", lambda: lambda v: v * 2, "b")
    assert [r.b for r in b.collect()] == [[2.0, 4.0], [6.0, 8.0]]
    s = spark.createDataFrame([(i, i % 2, [float(i), 0.0, 0.0]) for i in range(10)], "sample_id long, g int, samples array<double>")
    o = models.overlay_samples(s, ["g"], 2, 3, 1, most_shift=2).collect()
    assert sorted(r.source_count for r in o) == [2] * 4
    assert [r.v for r in models.evenly_ranked(spark.range(11).selectExpr("id", "double(id) AS v"), "v", "id", 3).orderBy("v").collect()] == [0, 5, 10]


def test_light_that_repeats_over_tpcs_comes_once(spark):
    """Six waveforms stand for the 12 channels of a TPC; whole and TPC by TPC the result is that of light laid out before."""
    xyz, e, tpc, actual, _, _, _ = event()
    hits = spark.createDataFrame([(1, i, *map(float, p), float(w), int(t)) for i, (p, w, t) in enumerate(zip(xyz, e, tpc))], "event_id long, hit_row long, x double, y double, z double, e double, tpc int")
    waves = {a: actual[a][:6].tolist() for a in (0, 1)}
    long = [(1, t, c, waves[t][c % 6], [100.0] * TICKS, [12.0, 33.0, 55.0]) for t in (0, 1) for c in range(12)]
    once = [(1, a, c, waves[a][c], 6, [0, 1], 100.0, None) for a in (0, 1) for c in range(6)] + [(1, t, -1, None, None, None, None, [12.0, 33.0, 55.0]) for t in (0, 1)]
    long = spark.createDataFrame(long, "event_id long, tpc int, channel int, samples array<double>, variance array<double>, seeds array<double>")
    once = spark.createDataFrame(once, "event_id long, tpc int, channel int, samples array<double>, every int, adcs array<int>, noise double, seeds array<double>")
    o = pipeline.Options("2x2", iters=150, rules=RULES, reach=1.1)
    for most in (10**6, 100):
        a, b = (sorted(map(tuple, pipeline.match(hits, l, o, lambda: models.LinearLight(12, TICKS, PEAK), most).collect())) for l in (long, once))
        assert a == b and len(a) == len(xyz) and all(r[-1] is None for r in a)
