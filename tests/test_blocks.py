"""Components, density clusters and links without lists of pairs; groups cut into slabs."""

import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from tickloom.functions import numeric as N
from tickloom.operators import components as C
from tickloom.plans import detector_kernels as K
from tickloom.stages import labels as L


@pytest.fixture
def no_pairs(monkeypatch):
    """A crowded place of 30,000 points has 450 million pairs; none may be listed."""

    def fail(*_):
        raise AssertionError("pairs listed")

    monkeypatch.setattr(N, "radius_pairs", fail)
    return np.random.default_rng(0).normal(0, 1, (30_000, 3))


def cloud(n=1500):
    rng = np.random.default_rng(1)
    df = pd.DataFrame({"ev": np.where(rng.random(n) < 0.6, 1, rng.integers(2, 60, n)), "k": rng.permutation(n) + 5})
    for a, w in zip("xyz", (40, 12, 12)):
        df[a] = np.round(rng.uniform(-w, w, n), 1)
    return df


def test_dbscan_in_slabs_is_that_of_whole_groups(spark):
    df = cloud()
    want = {}
    for ev, g in df.groupby("ev"):
        p, k = g[list("xyz")].to_numpy(), g["k"].to_numpy()
        core, part, at, of = N.dbscan_links(p, 3.0, 4)
        name = {c: k[part == c].min() for c in set(part[core])}
        for i in range(len(k)):
            near = [name[c] for c in of[at == i]]
            want[(ev, k[i])] = name[part[i]] if core[i] else min(near, default=None)
    got = C.dbscan(spark.createDataFrame(df), "k", 3.0, 4, ["ev"], most=200).collect()
    assert {(r.ev, r.k): r.cluster for r in got} == want and len(got) == len(df)


def test_dbscan_of_a_crowded_place(no_pairs):
    assert (N.dbscan_labels(no_pairs, 12.0, 3) == 0).all()


def test_kernel_without_rows_in_an_event():
    run = K.each_event(lambda g, p: pd.DataFrame({"cluster": [], "part": []} if g["hit_row"].iloc[0] < 9 else {"cluster": [4], "part": ["primary"]}), "cluster long, part string")
    t = pa.table({"event_id": [1, 1, 2], "hit_row": [3, 2, 9], "x": [0.0] * 3, "y": [0.0] * 3, "z": [0.0] * 3})
    assert run(t).to_pylist() == [{"event_id": 2, "cluster": 4, "part": "primary"}]
    none = run(t.slice(0, 2))
    assert none.num_rows == 0 and none.schema.field("part").type == pa.string()


def test_components_in_slabs_are_those_of_whole_groups(spark):
    df = cloud()
    df.loc[5, "x"] = np.nan
    want = {}
    for ev, g in df.groupby("ev"):
        ok = g["x"].notna()
        want |= {(ev, k): k for k in g["k"][~ok]}
        p, k = g[ok][list("xyz")].to_numpy(), g[ok]["k"].to_numpy()
        part = N.grid_components(p, 2.5)
        want |= {(ev, k[i]): k[part == part[i]].min() for i in range(len(k))}
    for most in (200, 10**6):
        got = C.radius_components(spark.createDataFrame(df), "k", 2.5, ["ev"], most=most).collect()
        assert {(r.ev, r.k): r.component for r in got} == want and len(got) == len(df)


def test_noise_list_measures_only_near_hits(monkeypatch):
    def fail(*_):
        raise AssertionError("all hits measured against all")

    monkeypatch.setattr(N, "nearest", fail)
    p = np.array([[0.0, 0, 0], [3, 0, 0], [0, 3.5, 0], [0, 0, 3.7], [500, 0, 0], [539, 0, 0], [900, 0, 0]])
    found = L.noise_list(p, np.array([-1, 2, 5, 6, -1, 5, -1]))
    assert found == [(3.0, 0, 2), (3.5, 0, 5), (39.0, 4, 5)]


def test_labels_by_energy_of_slabs(spark):
    df = cloud().assign(e=1.0)
    h = spark.createDataFrame(df)
    whole, cut = (C.labels_by_energy(C.dbscan(h, "k", 3.0, 4, ["ev"], most=m), h, "k", "e", ["ev"]).toPandas().sort_values(["ev", "k"], ignore_index=True) for m in (10**6, 200))
    pd.testing.assert_frame_equal(whole, cut)
    n = whole[whole["label"] >= 0].groupby(["ev", "label"]).size()
    assert len(whole) == len(df) and all(v.is_monotonic_decreasing for _, v in n.groupby("ev"))


def test_links_of_a_crowded_place(no_pairs):
    label = np.arange(len(no_pairs)) % 40
    links = N.cluster_links(np.concatenate([no_pairs, [[500.0, 0, 0]]]), np.append(label, 40), 12.0)
    assert links[40] == set() and all(links[c] == set(range(40)) - {c} for c in range(40))


def test_components_of_a_crowded_place(no_pairs):
    assert (N.radius_components(no_pairs, 12.0) == 0).all()
    assert N.radius_components(np.concatenate([no_pairs, no_pairs + 100]), 12.0).max() == 1


@pytest.mark.parametrize("most", [200, 10**6])
def test_slabs_of_unique_keys_compare_only_their_ends(spark, monkeypatch, most):
    df = cloud()
    h = spark.createDataFrame(df)
    seen = []
    merged = C._merged
    monkeypatch.setattr(C, "_merged", lambda found, *a: seen.append(found.where("_cut").selectExpr("count(*) n", "count_if(_shared) s").first()) or merged(found, *a))
    for of in (lambda **o: C.radius_components(h, "k", 2.5, ["ev"], most=most, **o), lambda **o: C.dbscan(h, "k", 3.0, 4, ["ev"], most=most, **o)):
        plain, unique = ({tuple(r) for r in of(unique=u).collect()} for u in (False, True))
        assert plain == unique and of(unique=True).count() == len(df)
    assert all(r.s < r.n or not r.n for r in seen)


def test_noise_list_leaves_far_hits_out_of_cells(monkeypatch):
    rng = np.random.default_rng(2)
    p = np.concatenate([rng.uniform(0, 60, (400, 3)), rng.uniform(0, 60, (20_000, 3)) + [500, 0, 0]])
    label, group = rng.integers(0, 9, len(p)), np.repeat([4, 2, 4], [300, 100, 20_000])
    lost = np.arange(len(p)) % 9 == 0
    lost[400:] = False
    want = set()
    for i in np.nonzero(lost)[0]:
        b = np.nonzero(~lost & (group == group[i]))[0]
        d = N.apart(p, np.full(len(b), i), b)
        want |= {(i, c, d[label[b] == c].min()) for c in set(label[b[d <= 1.2 * d.min()]])} if d.min() <= 40 else set()
    held = []

    class Counted(N.Grid):
        def __init__(self, q, *more):
            held.append(len(q))
            super().__init__(q, *more)

    monkeypatch.setattr(N, "Grid", Counted)
    assert set(zip(*N.nearest_labels(p, lost, label, 40.0, 1.2, group))) == want and want
    assert max(held) < 3_000


def scattered(n, groups, labels, width):
    rng = np.random.default_rng(3)
    p, label, group = rng.uniform(0, width, (n, 3)), rng.integers(0, labels, n) * 3 - 1, rng.integers(0, groups, n)
    i, j = N.radius_pairs(p, 12.0)
    ok = (group[i] == group[j]) & (label[i] != label[j])
    i, j = i[ok], j[ok]
    return (p, label, 12.0, group), set(zip(group[i], np.minimum(label[i], label[j]), np.maximum(label[i], label[j])))


def test_links_of_small_events_hold_no_table_of_labels(monkeypatch):
    def fail(*_):
        raise AssertionError("labels of small events held against each other")

    monkeypatch.setattr(N, "_seekers", fail)
    given, want = scattered(6_000, 70, 40, 120)
    got = list(zip(*N.linked_labels(*given)))
    assert set(got) == want and got == sorted(want) and want


def test_links_of_very_many_labels_take_little_memory():
    given, want = scattered(12_000, 1, 6_000, 300)
    tracemalloc.start()
    got = list(zip(*N.linked_labels(*given)))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == sorted(want) and want
    assert most < 1e8


def test_links_by_several_tables(monkeypatch):
    given, want = scattered(6_000, 5, 40, 120)
    tables = []
    table = N._table_links
    monkeypatch.setattr(N, "_table_links", lambda *a: tables.append(len(a[0])) or table(*a))
    for small, pairs, n in ((2_000, 25_000_000, 0), (1_000, 25_000_000, 1), (1_000, 1_600, 5), (1_000, 1_599, 0)):
        monkeypatch.setattr(N, "SMALL", small)
        monkeypatch.setattr(N, "PAIRS", pairs)
        tables.clear()
        assert list(zip(*N.linked_labels(*given))) == sorted(want) and len(tables) == n


def test_noise_list_of_a_crowded_place_takes_little_memory():
    rng = np.random.default_rng(4)
    p = np.concatenate([rng.normal(0, 0.1, (2_000, 3)), rng.normal(0, 0.1, (4_000, 3)) + [20, 0, 0]])
    lost, label = np.arange(len(p)) < 2_000, np.arange(len(p)) % 3
    tracemalloc.start()
    at, of, dist = N.nearest_labels(p, lost, label, 40.0, 1.2)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert list(zip(at, of)) == [(i, c) for i in range(2_000) for c in range(3)]
    for c in range(3):
        b = 2_000 + np.nonzero(label[2_000:] == c)[0]
        want = [N.apart(p, np.full(len(b), i), b).min() for i in range(0, 2_000, 100)]
        assert (dist[of == c][::100] == want).all()
    assert most < 2.5e8
