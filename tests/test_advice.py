"""Registered queries and operators do their whole job: cases that were cut before."""

import json

import numpy as np
import pytest

from tickloom.operators import truth
from tickloom.plans import detector, detector_light, detector_stages, problems
from tickloom.sources import rescue
from tickloom.stages import models, pipeline


def write(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def brute_event(lo, hi, regions):
    return min((e for e, a, b in regions if a <= lo and hi < b), default=None)


def test_wide_regions_hold_their_hits(spark, tmp_path):
    refs = [(1, 9), (40_000, 9), (500, 2), (700, 2), (20_000, 3), (27_000, 3), (39_990, 1)]
    d = write(
        spark, tmp_path,
        hits=([(r,) for r in (1, 600, 8_000, 8_000, 21_000, 27_001, 39_990, 40_000, 40_001, None)], "hit_row long"),
        event_hits=(refs, "hit_row long, event_id long"),
    )
    got = {r.probe_id: r.event_row for r in detector.event_of_range(spark, d).collect()}
    assert got == {1: 9, 600: 2, 8_000: 9, 21_000: 3, 27_001: 9, 39_990: 1, 40_000: 9}


def test_event_of_range_against_brute_force(spark):
    rng = np.random.default_rng(3)
    regions = [(int(e), int(a), int(a + w)) for e, a, w in zip(rng.permutation(60), rng.integers(-300, 900, 60), rng.choice([0, 1, 7, 8, 16, 40, 300, 1500], 60))]
    probes = [(i, int(lo), int(lo + w)) for i, (lo, w) in enumerate(zip(rng.integers(-350, 1500, 400), rng.choice([0, 0, 1, 5, 30, 200, -3, -20], 400)))]
    got = {r.probe_id: r.event_row for r in truth.event_of_range(spark.createDataFrame(probes, "probe_id long, lo long, hi long"), spark.createDataFrame(regions, "event_row long, start long, stop long"), cell=8).collect()}
    # a range that ends before it starts is looked up in the cells of regions that are not empty
    for i, lo, hi in probes:
        want = brute_event(lo, hi, [r for r in regions if r[1] < r[2] and lo // 8 <= (r[2] - 1) // 8])
        assert got.get(i) == want, (i, lo, hi)


def test_what_a_column_does_not_take_is_rescued(spark):
    payloads = [
        {"id": {"v": 1, "src": "cal"}, "y": [2.5, 3.5], "l": [1, "a"]},
        {"id": {"v": 2}, "y": [2.5], "l": [1, None], "gain": {"v": 4, "src": "cal"}},
        {"id": 3, "y": [], "l": ["1.5"], "gain": {"v": 5}},
    ]
    raw = spark.createDataFrame([(i, "h", "c", 1, json.dumps(p)) for i, p in enumerate(payloads)], "raw_id long, dataset string, campaign string, file_no int, payload string")
    changes = spark.createDataFrame([], "dataset string, campaign string, file_no long, change string, field_old string, field_new string")
    out = rescue.promote(rescue.conform(raw, {"id": "bigint", "y": "double", "l": "array<double>"}, changes), {"gain": "double"}).orderBy("raw_id").collect()
    assert [(r.id, r.y, r.gain) for r in out] == [(1, 2.5, None), (2, 2.5, 4.0), (3, None, 5.0)]
    assert [{k: json.loads(v) for k, v in (r._rescued or {}).items()} for r in out] == [payloads[0], {"gain": payloads[1]["gain"]}, {"y": []}]


def test_tracks_are_drawn_as_often_as_in_the_reference(monkeypatch):
    seen = []

    def stop(*_, iters, **__):
        seen.append(iters)
        raise StopIteration

    monkeypatch.setattr(pipeline.L, "labels_2x2", stop)
    monkeypatch.setattr(pipeline.L, "labels_nd", stop)
    monkeypatch.setattr(pipeline, "match", lambda hits, light, o, make: options.append(o))
    monkeypatch.setattr(pipeline, "status", lambda result: result)
    for name in ("hits_in_tpcs", "event_light", "nd_hits", "nd_light"):
        monkeypatch.setattr(detector_stages, name, lambda spark, d: None)
    options = [pipeline.Options("2x2"), pipeline.Options("nd")]
    detector_stages.match_2x2(None, "")
    detector_stages.match_nd(None, "")
    for o in options:
        with pytest.raises(StopIteration):
            pipeline.run_event(np.zeros((2, 3)), np.ones(2), np.zeros(2, int), {0: np.zeros((12, 120))}, {0: np.ones((12, 120))}, {}, models.LinearLight(12, 120, 20), o)
    assert seen == [1200, 800, 1200, 800]


def test_every_assigned_hit_is_scattered(spark, tmp_path):
    d = write(
        spark, tmp_path,
        hits=([(1, i, i + 10, i) for i in range(6)], "file_id long, hit_row long, t_0 short, t_cluster_id short"),
        charge_events=([(1, 1)], "file_id long, event_id long"),
        event_hits=([(1, i + 50, i) for i in range(6)], "file_id long, ref_id long, hit_row long"),
    )
    assert {r.hit_row: (r.t0, r.cluster_id) for r in detector_light.scatter(spark, d).collect()} == {i: (i + 10, i) for i in range(6)}
    assert [(r.n_assigned, r.n_unassigned) for r in detector_light.file_summary(spark, d).collect()] == [(6, 0)]
    assert {r.final_row: r.t0 for r in detector_light.final_from_prompt(spark, d).collect()} == {i + 50: i + 10 for i in range(6)}


def test_training_samples_use_the_mask_of_the_own_file(spark, tmp_path, monkeypatch):
    wave = [100.0] * detector_light.TICKS
    d = write(
        spark, tmp_path,
        wvfm=([(i, i, f, 0, 5, wave) for i, f in ((1, 1), (2, 2), (3, 3))], "wvfm_row long, light_id long, file_id long, adc int, ch int, samples array<float>"),
        channel_mask=([(2, 0, 5, True), (3, 0, 5, None), (1, 0, 5, False)], "file_id long, adc int, ch int, dead boolean"),
    )
    hits = spark.createDataFrame([(i, 0, 1.0, 1.0, 1.0, 1.0) for i in (1, 2, 3)], "light_id long, hit_tpc_id int, x double, y double, z double, e double")
    monkeypatch.setattr(detector_light, "loaded", lambda spark, d: hits)
    monkeypatch.setattr(detector_light, "BOX", {c: (-1000.0, 1000.0, 5) for c in "xyz"})
    assert {r.light_id: r.targets for r in detector_light.training_samples(spark, d).collect()} == {1: [100.0], 2: [-10000.0], 3: [100.0]}


def test_tpcs_count_hits_without_references_and_each_once(spark, tmp_path):
    hits = [(1, 0, 1.0, 1), (1, 0, 2.0, 2), (2, 0, 4.0, 1), (3, 1, 8.0, 1), (4, 1, float("nan"), 1), (None, 2, 1.0, 1), (None, 2, 1.5, 1)]
    d = write(
        spark, tmp_path,
        hits=(hits, "hit_row long, hit_tpc_id int, e double, ingest_ts long"),
        event_hits=([(1, 1), (1, 2), (1, 3), (None, 1)], "hit_row long, event_id long"),
    )
    assert {r.hit_tpc_id: (r.n_hits, r.energy, r.n_refs) for r in problems.p4_tpc_hits(spark, d).collect()} == {0: (2, 6.0, 3), 1: (2, 8.0, 0), 2: (2, 2.5, 0)}
