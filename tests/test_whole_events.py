"""Events are matched whole, however many hits they have."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickloom.functions import numeric as N
from tickloom.plans import detector_stages
from tickloom.stages import labels as L
from tickloom.stages import match as M
from tickloom.stages import models, pipeline

#: Above the size from which events were cut into their TPCs.
HITS = 2_000_001


def whole(*_):
    """Stands for the stages: each hit's stage tells how many hits and TPCs came together."""

    def run(hits, light):
        n = hits.num_rows
        told = f"{n} hits, {len(np.unique(hits['tpc'].to_numpy()))} TPCs, {light.num_rows} waveforms"
        const = {"t0": 0.0, "cluster_id": 0, "stage": told, "error": told}
        kinds = {"t0": pa.float64(), "cluster_id": pa.int32(), "stage": pa.string(), "error": pa.string()}
        cols = {c: hits[c].cast(k) for c, k in (("event_id", pa.int64()), ("hit_row", pa.int64()), ("tpc", pa.int32()))} | {c: pa.repeat(pa.scalar(v, kinds[c]), n) for c, v in const.items()}
        return pa.table({c: cols[c] for c in ("event_id", "hit_row", "t0", "cluster_id", "tpc", "stage", "error")})

    return run


def told(spark, monkeypatch, query: str) -> list[tuple]:
    """What the stages of a query's events get to see, of one event of ``HITS`` hits in two TPCs and one of ten."""
    ids = spark.range(HITS + 10)
    hits = ids.select(F.when(F.col("id") < HITS, 1).otherwise(2).cast("long").alias("event_id"), F.lit(1).cast("long").alias("light_id"), F.col("id").alias("hit_row"), *[F.lit(1.0).alias(c) for c in "xyze"], (F.col("id") % 2).cast("int").alias("tpc"))
    once = "event_id long, tpc int, channel int, samples array<double>, {}, seeds array<double>"
    if query == "match_2x2":
        light = spark.createDataFrame([(e, t, 0, [1.0], [1.0], None) for e in (1, 2) for t in (0, 1)], once.format("variance array<double>"))
    else:
        light = spark.createDataFrame([(e, t, 0, [1.0], 1, [0, 1], 1.0, None) for e in (1, 2) for t in (0, 1)], once.format("every int, adcs array<int>, noise double"))
    for name, df in (("hits_in_tpcs", hits), ("nd_hits", hits), ("event_light", light), ("nd_light", light)):
        monkeypatch.setattr(detector_stages, name, lambda *_, df=df: df)
    monkeypatch.setattr(pipeline, "_event", whole)
    out = getattr(detector_stages, query)(spark, "")
    if query == "match_nd":
        return sorted((r.event_id, r.error, r.n_hits) for r in out.collect())
    if query == "match_2x2":
        out = out.groupBy("event_id", "stage").agg(F.count("hit_row").alias("n_hits"))
    return sorted((r.event_id, r.stage, r.n_hits) for r in out.collect())


@pytest.mark.parametrize("query", ["beam_nd", "match_2x2", "match_nd", "family_expand_nd", "region_grow_nd"])
def test_events_of_any_size_come_whole(spark, monkeypatch, query):
    assert told(spark, monkeypatch, query) == [(1, f"{HITS} hits, 2 TPCs, 2 waveforms", HITS), (2, "10 hits, 2 TPCs, 2 waveforms", 10)]


def test_line_of_most_points_is_found_through_cells(monkeypatch):
    rng = np.random.default_rng(5)
    p = np.concatenate([rng.uniform(0, 300, (6_000, 3)), np.array([20.0, 30.0, 40.0]) + rng.uniform(0, 1, (900, 1)) * [200.0, 150.0, 90.0] + rng.normal(0, 1, (900, 3))])
    want = N.fit_tracks(p, iters=200, reach=4.0)
    monkeypatch.setattr(N, "MANY", 1_000)
    found = []
    fullest = N._fullest_line
    monkeypatch.setattr(N, "_fullest_line", lambda *a: found.append(fullest(*a)) or found[-1])
    assert (N.fit_tracks(p, iters=200, reach=4.0) == want).all() and want.max() >= 0 and all(k is not None for k in found)


def test_pairs_of_two_times_are_counted_without_a_list(monkeypatch):
    rng = np.random.default_rng(6)
    p, group, v = rng.uniform(0, 60, (3_000, 3)), rng.integers(0, 3, 3_000), rng.integers(0, 4, 3_000) * 8.0
    i, j = N.radius_pairs(p, 5.0)
    ok = (group[i] == group[j]) & (np.abs(v[i] - v[j]) > 10)
    got = np.sort(np.concatenate([np.stack(b, 1) for b in N.near_pairs(p, 5.0, group, v, 10)]), axis=1)
    assert sorted(map(tuple, got.tolist())) == sorted(zip(i[ok].tolist(), j[ok].tolist()))
    # a crowded place of one time makes no pairs
    seen = []
    pairs = N.Grid.pairs
    monkeypatch.setattr(N.Grid, "pairs", lambda self, a, *b: seen.append(len(a)) or pairs(self, a, *b))
    assert not any(len(a) for a, _ in N.near_pairs(np.zeros((5_000, 3)), 4.0, np.zeros(5_000, int), np.zeros(5_000), 10)) and not any(seen)


def test_moves_add_up_the_light_of_moved_hits_only(monkeypatch):
    rng = np.random.default_rng(7)
    n, model = 4_000, models.LinearLight(6, 90, 20)
    xyz, tpc = rng.normal(0, 30, (n, 3)), rng.integers(0, 2, n)
    data = {t: rng.uniform(0, 50, (6, 90)) for t in (0, 1)}
    ev = M.Event(xyz, rng.uniform(0.5, 1.5, n), tpc, data, {t: np.ones((6, 90)) for t in (0, 1)}, model, M.rules_of("2x2", search=40, peak=20))
    ev.t0 = rng.choice([3.0, 17.0, 30.25], n)
    made = []
    light_of = ev.light_of
    monkeypatch.setattr(ev, "light_of", lambda h: made.append(len(h)) or light_of(h))
    for k in range(30):
        hits = np.nonzero((tpc == k % 2) & (ev.t0 == 3.0))[0][:5]
        M.commit_move(ev, k % 2, hits, 3.0, 17.0, M.moved_base(ev, k % 2, hits, 3.0, 17.0), "spatial")
    assert sorted(made)[-4] > 100 >= sorted(made)[-5]  # the families once each, then five hits at a time
    for (t, x), (light, m) in ev.sums.items():
        at = M.families(ev, t, x)
        assert m == len(at) and np.allclose(light, light_of(at), rtol=1e-12)


def test_segments_far_apart_or_aslant_are_not_measured(monkeypatch):
    rng = np.random.default_rng(8)
    seg = []
    for k in range(400):
        p, u = rng.uniform(-400, 400, 3), rng.normal(0, 1, 3)
        q = p + u / np.linalg.norm(u) * 50
        seg += [L.Segment(k % 7, np.array([], int), p, q, 0.9), L.Segment((k + 1) % 7, np.array([], int), q + 1.0, q + 1.0 + (q - p) + rng.normal(0, 4, 3), 0.95)]
    measured = []
    line_line = N.line_line
    monkeypatch.setattr(N, "line_line", lambda *a: measured.append(1) or line_line(*a))
    norm, norms = np.linalg.norm, []
    monkeypatch.setattr(np.linalg, "norm", lambda *a, **k: norms.append(1) or norm(*a, **k))
    track = L.join_segments(seg)
    assert len(np.unique(track)) < 420 and len(norms) < 20_000 and len(measured) < 5_000
