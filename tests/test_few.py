"""Events of few hits by plain distances, without cells; nearest points without all pairs; one shuffle of hits."""

import numpy as np
import pytest

from tickloom.functions import numeric as N


def _no_grid(monkeypatch):
    def fail(*a, **k):
        raise AssertionError("cells for a few points")

    monkeypatch.setattr(N, "Grid", fail)


@pytest.mark.parametrize("groups", [False, True])
def test_few_points_need_no_cells(monkeypatch, groups):
    rng = np.random.default_rng(3)
    p = np.round(rng.normal(0, 20, (90, 3)), 1)
    g = rng.integers(0, 3, 90) if groups else None
    label = rng.integers(-1, 5, 90)

    def all_of():
        core, part, at, of = N.dbscan_links(p, 9.0, 3, g)
        first = N._by_first(part)
        name = dict(zip(part.tolist(), first.tolist()))
        links = sorted((int(i), name[int(c)]) for i, c in zip(at, of))
        pairs = sorted(tuple(int(x) for x in row) for row in zip(*N.linked_labels(p, label, 9.0, g)))
        near = N.nearest_labels(p, label < 0, label, 30.0, 1.2, g)
        return core.tolist(), first.tolist(), links, N._by_first(N.grid_components(p, 9.0, g)).tolist(), N.dbscan_labels(p, 9.0, 3).tolist(), pairs, [x.tolist() for x in near]

    monkeypatch.setattr(N, "FEW", -1)
    cells = all_of()
    monkeypatch.setattr(N, "FEW", 256)
    _no_grid(monkeypatch)
    assert all_of() == cells


def test_nearest_other_compares_no_crowd_with_all(monkeypatch):
    rng = np.random.default_rng(4)
    p, q = np.round(rng.normal(0, 20, (2500, 3)), 1), np.round(rng.normal(0, 20, (2500, 3)), 1)
    q = np.concatenate([q, p[:500], [[1e5, 0, 0]]])
    d = sum((p[:, k, None] - q[:, k]) ** 2 for k in range(3))
    d[d == 0] = np.inf
    most = 0
    between = N._between

    def counted(a, b, *more):
        nonlocal most
        most = max(most, len(a) * len(b))
        return between(a, b, *more)

    monkeypatch.setattr(N, "_between", counted)
    assert (N.nearest_other(p, q) == np.sqrt(d.min(1))).all()
    assert most <= 1_000_000


def test_hits_and_light_are_shuffled_once(spark):
    from tickloom.sources import tables
    from tickloom.stages import pipeline

    hits = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1.0, 0)], "hit_row long, x double, y double, z double, e double, tpc int")
    rows = spark.createDataFrame([(5, 1)], "event_id long, hit_row long")
    light = spark.createDataFrame([(5, 9, 1)], "event_id long, light_id long, ref_id long")
    plan = tables.load_events(hits, rows, light)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(event_id") <= 1  # of the light, not of the hits
    h = hits.selectExpr("5L AS event_id", "*")
    l = spark.createDataFrame([(5, 0, 0, [0.0] * 48, [1.0] * 48, [])], "event_id long, tpc int, channel int, samples array<double>, variance array<double>, seeds array<double>")
    plan = pipeline.match(h.unionByName(h), l)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2
    assert pipeline.match(h.unionByName(h), l).count() == 1  # repeated rows count once


def test_nd_waveforms_are_shuffled_once_as_stored(spark, tmp_path):
    from tickloom.plans import detector_stages

    wave = [10.0] * 47
    tables = {
        "wvfm": ([(4, 9, 0, 5, [*wave, 16.0]), (3, 9, 0, 5, [*wave, 12.0]), (3, 9, 0, 5, [*wave, 12.0]), (5, 9, 0, 7, [*wave, 10.0]), (6, 8, 3, 7, [*wave, 10.0]), (7, 9, None, 1, [*wave, 10.0])], "wvfm_row long, light_id long, adc int, ch int, samples array<float>"),
        "light_flash": ([(9, 1)], "light_id long, flash_id long"),
        "flash": ([(1, 0, [100.0, 120.0], 5.0, 3)], "flash_id long, tpc int, hit_time_range array<double>, tot_max double, n_sum_hits int"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    light = detector_stages.nd_light(spark, str(tmp_path), spark.createDataFrame([(1, 9), (1, 9), (2, 7)], "event_id long, light_id long"))
    got = {r.channel: r for r in light.collect()}
    assert len(got) == light.count() == 3 and {r.event_id for r in got.values()} == {1} and got[-1].seeds is not None and got[-1].samples is None
    assert got[0].samples[-1] == 2.0 and got[1].samples[-1] == 0.0  # the first row of a channel counts
    assert [(got[0].every, got[0].adcs), (got[1].every, got[1].adcs)] == [(2, [0, 3])] * 2
    plan = light._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(wvfm_row" not in plan and "REPARTITION_BY_COL" in plan
