"""Operators of the general problems against brute force on small fixtures, with their edge cases."""

import datetime as dt
import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickloom.operators.eager import KeyedJoin, eager_join_aggregate, heavy_keys
from tickloom.operators.references import Reference, orphan_references, orphan_report, probe_sorted
from tickloom.operators import skew
from tickloom.operators.skew import broadcast_if_small, carried, kept, ordered_rank, release, sliced_rank
from tickloom.operators.spikes import SpikeRules, faulty_waveforms, waveform_features
from tickloom.session import shared_dir
from tickloom.sources import compaction, rescue


def T(day, hour=0):
    return dt.datetime(2024, 3, day, hour)


# ---------------------------------------------------------------- skew helpers
def test_sliced_rank_is_dense_and_stable(spark):
    rows = [(None if i % 7 == 0 else i % 3, i) for i in range(500)]
    df = spark.createDataFrame(rows, "g int, v int")
    got = {(r.g, r.v): r.rank for r in sliced_rank(df, ["g"], ["v"], slices=5).collect()}
    for g in (None, 0, 1, 2):
        ranks = sorted(k for (a, _), k in got.items() if a == g)
        assert ranks == list(range(len(ranks)))
    assert got == {(r.g, r.v): r.rank for r in sliced_rank(df.orderBy(F.desc("v")), ["g"], ["v"], slices=5).collect()}
    assert sliced_rank(df.limit(0), ["g"], ["v"]).count() == 0


def test_broadcast_only_when_small(spark):
    assert "broadcast" in broadcast_if_small(spark.range(5), 5)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in broadcast_if_small(spark.range(6), 5)._jdf.queryExecution().logical().toString().lower()


def test_kept_frames_are_released_whatever_became_of_their_session(spark):
    df = kept(spark.range(10).withColumn("v", F.rand()))
    first = df.agg(F.sum("v")).first()
    assert df.is_cached and df.agg(F.sum("v")).first() == first

    class Gone:
        def unpersist(self):
            raise RuntimeError("the session has ended")

    skew._kept.append(Gone())
    release()
    assert not skew._kept and not df.is_cached and df.count() == 10


# ---------------------------------------------------------------- 4 heavy keys
def test_eager_aggregation_equals_the_join(spark):
    left = spark.createDataFrame([(1, "a", 0)] * 50 + [(1, "b", 0), (2, "b", 0), (None, "b", 0), (9, "c", 0), (2, None, 0)], "k int, g string, v int")
    right = spark.createDataFrame([(1, 2.0), (1, 3.0), (2, None), (None, 5.0)], "k int, v double")
    got = {r.g: (r.n, r.s) for r in eager_join_aggregate(left, right, "k", ["g"], {"s": F.col("v")}, "n").collect()}
    want = {r.g: (r.n, r.s) for r in left.drop("v").join(right, "k").groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s")).collect()}
    assert got == want and got["a"] == (100, 250.0) and got[None] == (1, None)
    assert eager_join_aggregate(left.limit(0), right, "k", ["g"], {"s": F.col("v")}).count() == 0


def test_left_sums_and_stored_rows(spark):
    left = spark.createDataFrame([(1, "a", 2.0)] * 3 + [(1, "b", None), (2, "b", 1.0), (None, "a", 7.0), (9, None, 1.0)], "k int, g string, v double")
    right = spark.createDataFrame([(1, 0.5), (1, 1.5), (2, 1.0), (None, 4.0)], "k int, v double")
    got = {r.g: (r.n, r.s, r.t, r.stored) for r in eager_join_aggregate(left, right, "k", ["g"], {"s": F.col("v")}, "n", {"t": F.col("v")}, "stored").collect()}
    assert got == {"a": (6, 6.0, 12.0, 4), "b": (3, 3.0, 1.0, 2), None: (0, None, None, 1)}


def test_heavy_keys_count_null_rows_in_the_total(spark):
    df = spark.createDataFrame([(1, 1)] * 6 + [(2, 3)] * 5 + [(None, None)] * 89, "k int, j int")
    other = spark.createDataFrame([(1,), (1,)], "j int")
    assert [(r.key_id, r.n_rows, r.n_joined) for r in heavy_keys([KeyedJoin(df, other, "j", "k", {})], 0.05).collect()] == [(1, 6, 12)]
    assert heavy_keys([KeyedJoin(df.limit(0), other, "j", "k", {})], 0.05).count() == 0
    assert [r.key_id for r in heavy_keys([KeyedJoin(df, other.limit(0), "j", "k", {})], 0.05).collect()] == [1]


# ---------------------------------------------------------------- 2 references
def brute_kind(key, at, parents):
    own = [(b, e) for k, b, e in parents if k == key]
    if not own:
        return "missing"
    if at is None:
        return None
    if any(b is not None and b <= at and (e is None or e > at) for b, e in own):
        return None
    return "late" if any(b is not None and b > at for b, _ in own) else "deleted"


def reference_case(rng, n_refs, n_parents, keys):
    def t():
        return None if rng.random() < 0.05 else T(1 + int(rng.integers(0, 20)), int(rng.integers(0, 24)))

    parents = [(int(rng.integers(0, keys)) if rng.random() > 0.02 else None, t(), t() if rng.random() < 0.4 else None) for _ in range(n_parents)]
    refs = [(i, None if rng.random() < 0.03 else -1 if rng.random() < 0.03 else 7 if rng.random() < 0.3 else int(rng.integers(0, keys + 20)), t()) for i in range(n_refs)]
    return refs + refs[:9], parents


@pytest.mark.parametrize("limits", [{}, {"per_group": 40, "per_range": 25}, {"per_group": 7, "per_range": 3, "quantile_ranges": 2}])
@pytest.mark.parametrize("hot", [0, 300])
def test_orphans_against_brute_force(spark, limits, hot):
    rng = np.random.default_rng(3)
    refs, parents = reference_case(rng, 600, 200, 60)
    # one key with many versions, some without begin or end
    parents += [(7, None if i % 50 == 0 else T(1 + int(rng.integers(0, 20)), int(rng.integers(0, 24))), T(1 + int(rng.integers(0, 20))) if i % 7 else None) for i in range(hot)]
    if hot:
        parents = [(k, b, e) for k, b, e in parents if k != 7 or e is not None]
    tabs = {
        "refs": spark.createDataFrame([(*r, "x") for r in refs], "ref_id long, k long, ref_ts timestamp_ntz, key string"),
        "par": spark.createDataFrame([(*p, 1) for p in parents], "pk long, ingest_ts timestamp_ntz, removed_ts timestamp_ntz, target int"),
    }
    got = orphan_references(tabs.__getitem__, [Reference("refs", "k", "par", "pk")], **limits)
    want = {(i, brute_kind(k, at, parents)) for i, k, at in refs if k is not None and k != -1}
    rows = [(r.ref_id, r.kind) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == {w for w in want if w[1]}
    assert sum(r.n_orphans for r in orphan_report(got).collect()) == len(rows)


def test_orphans_of_empty_tables(spark):
    refs = spark.createDataFrame([(1, 5, T(1))], "ref_id long, k long, ref_ts timestamp_ntz")
    par = spark.createDataFrame([], "pk long, ingest_ts timestamp_ntz, removed_ts timestamp_ntz")
    r = [Reference("refs", "k", "par", "pk")]
    assert [x.kind for x in orphan_references({"refs": refs, "par": par}.__getitem__, r).collect()] == ["missing"]
    assert orphan_references({"refs": refs.limit(0), "par": par}.__getitem__, r).count() == 0


def test_probe_without_parents():
    none = np.zeros(0, np.int64)
    assert probe_sorted(np.array([1]), np.array([2]), none, none, none).tolist() == [1]


# ---------------------------------------------------------------- 1 implausible readings
def quiet(rng, n=48, level=3000, sigma=10):
    return np.round(level + rng.normal(0, sigma, n))


def test_features_of_known_shapes():
    rng = np.random.default_rng(0)
    flat, spike, dip, pulse, stuck, both = (quiet(rng) for _ in range(6))
    spike[20:22] += 600
    dip[2:5] -= 400
    pulse[15:] += 4000 * np.exp(-np.arange(33) / 15)
    stuck[5:25] = 2950
    both[30:32] += [700, -450]  # swings to both sides
    spread, low, high, level, peak = waveform_features(np.stack([flat, spike, dip, pulse, stuck, np.full(48, 5.0), both]), SpikeRules())
    noise = (high - low) / 1.908
    assert not peak[0] > 150 and peak[1] > 400 and peak[2] < -250 and not abs(peak[3]) > 150 and 600 < peak[6] < 800
    assert level[4] == 2950 and level[5] == 5.0 and np.isnan(level[[0, 1, 2, 3, 6]]).all()
    assert np.isnan(noise[5]) and 5 < noise[0] < 18 and spread[5] == 0


def test_faulty_waveforms_masks_and_settings(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(60):
        rows.append((i, 1, 0, 1 + i % 2, quiet(rng).tolist(), i % 6))
    rows[0][4][10] = float("nan")
    rows[1][4][10] = 70000.0
    rows[2] = (2, 1, 0, 1, [2000.0] * 48, None)
    rows[3][4][20] += 900
    rows[4] = (4, 1, 0, 1, None, 1)
    rows[5] = (5, 1, 0, 1, [], 1)
    rows[6] = (6, 1, 0, 1, [60000.0] * 30 + [2000.0] * 2, 1)  # held at the rail
    rows[7] = (7, 1, 0, 1, [3000.0, 3001.0], 99)
    rows += [(100 + i, 2, 0, 1, [2500.0] * 48, 2) for i in range(3)]  # dead, not marked
    rows += [(200 + i, 3, 0, 1, quiet(rng).tolist(), 3) for i in range(3)]  # alive, marked
    rows += [(300 + i, 4, 0, 1, [2500.0] * 48, 2) for i in range(3)]  # dead and marked
    rows += [rows[2], (400, 5, None, None, [1.0, -5.0], 3)]
    w = spark.createDataFrame(rows, "wvfm_row long, file_id long, adc int, ch int, samples array<float>, light_id long").withColumn("dead", F.lit("?"))
    m = spark.createDataFrame([(1, 1, 0, 1, None), (2, 2, 0, 1, False), (3, 3, 0, 1, True), (4, 4, 0, 1, True), (5, 4, 0, 2, True)], "mask_row long, file_id long, adc int, ch int, dead boolean")
    c = spark.createDataFrame([(i, i, 0, 59990.0 + i) for i in range(20)] + [(50, 1, 0, 61000.0), (51, 1, 0, float("inf")), (52, 1, 0, None), (53, 1, 0, float("nan"))], "set_row long, file_id long, adc int, saturation_clip_threshold double")
    hours = [(i, [1.7e12 + 3.6e6 * i]) for i in range(5)] + [(5, None), (4, []), (3, [float("nan")]), (None, [1.0])]
    l = spark.createDataFrame(hours, "light_id long, utime_ms array<double>")
    got = {(r.tbl, r.row_id): r.reason for r in faulty_waveforms(w, m, c, l).collect()}
    assert got == {
        ("wvfm", 0): "impossible", ("wvfm", 1): "impossible", ("wvfm", 2): "stuck", ("wvfm", 3): "spike", ("wvfm", 400): "impossible",
        **{("wvfm", 100 + i): "stuck" for i in range(3)},
        ("channel_mask", 2): "unmarked", ("channel_mask", 3): "alive",
        ("clip_settings", 50): "setting", ("clip_settings", 51): "setting", ("clip_settings", 53): "setting",
    }
    assert faulty_waveforms(w.limit(0), m.limit(0), c.limit(0), l.limit(0)).count() == 0



def test_a_noisy_hour_has_fences_of_its_own(spark):
    rng = np.random.default_rng(2)
    rows = [(i, 1, 0, 1, quiet(rng, sigma=100 if i % 2 else 10).tolist(), i % 2) for i in range(400)]
    rows[0][4][20] += 600  # far outside in the quiet hour
    rows[1][4][20] += 600  # nothing in the noisy one
    w = spark.createDataFrame(rows, "wvfm_row long, file_id long, adc int, ch int, samples array<double>, light_id long")
    m = spark.createDataFrame([], "mask_row long, file_id long, adc int, ch int, dead boolean")
    c = spark.createDataFrame([], "set_row long, file_id long, adc int, saturation_clip_threshold double")
    l = spark.createDataFrame([(0, [0.0]), (1, [3.6e6])], "light_id long, utime_ms array<double>")
    assert [(r.row_id, r.reason) for r in faulty_waveforms(w, m, c, l).collect()] == [(0, "spike")]
    # with too few waveforms for an hour, the channel is judged at all hours
    few = SpikeRules(least_context=1000)
    assert faulty_waveforms(w, m, c, l.limit(0)).count() == faulty_waveforms(w, m, c, l, few).count()


# ---------------------------------------------------------------- 5 drifting schemas
def drift(spark):
    rng = np.random.default_rng(5)
    rows = []
    for no in range(1, 6):
        for i in range(30):
            r = {"id": int(rng.integers(1, 9_000_000)), "x": round(float(rng.normal(0, 100)), 4), "E": round(float(rng.uniform(0, 9)), 4)}
            if no >= 2:
                r["pos_x"] = r.pop("x")
            if no >= 3:
                r["E"] = str(r["E"])
                r["note"] = "a12" if i else None
            if no == 4:
                r["id"] = None
            if no == 4:
                r["pos_x"] = None
            if no == 5:
                r["x_cm"] = r.pop("pos_x")
                del r["E"]
                r["crate"] = int(rng.integers(100_000, 200_000))
            rows.append((len(rows), "hits", "c", no, json.dumps(r)))
    return spark.createDataFrame(rows + [rows[0], (999, "hits", "c", 3, "{broken"), (998, "hits", "c", 3, None)], "raw_id long, dataset string, campaign string, file_no int, payload string")


def test_field_changes(spark):
    got = {(r.file_no, r.change, r.field_old, r.field_new) for r in rescue.field_changes(drift(spark)).collect()}
    assert got == {(2, "renamed", "x", "pos_x"), (3, "retyped", "E", "E"), (3, "added", "", "note"), (5, "renamed", "pos_x", "x_cm"), (5, "removed", "E", ""), (5, "added", "", "crate")}
    # whatever the target schema takes, the rest is rescued: the changes are the same
    again = rescue.field_changes(drift(spark), {"id": "bigint", "x": "double", "E": "double", "note": "string", "crate": "boolean"})
    assert {(r.file_no, r.change, r.field_old, r.field_new) for r in again.collect()} == got
    long = rescue.ingest_long(drift(spark), {"id": "bigint", "E": "double"})
    taken = long.groupBy("field").agg(F.count("num").alias("num"), F.count("rescued").alias("rescued")).collect()
    assert {r.field: (r.num > 0, r.rescued > 0) for r in taken} == {"id": (True, True), "E": (True, True), "x": (False, True), "pos_x": (False, True), "note": (False, True), "x_cm": (False, True), "crate": (False, True), None: (False, False)}
    assert rescue.field_changes(drift(spark).limit(0)).count() == 0


def test_records_of_unnamed_campaigns_conform(spark):
    rows = [(i, None if i % 2 else "hits", None, no, json.dumps({"x" if no == 1 else "pos_x": 100 * i + 0.5})) for no in (1, 2) for i in range(20)]
    raw = spark.createDataFrame(rows, "raw_id long, dataset string, campaign string, file_no int, payload string")
    changes = rescue.field_changes(raw)
    assert {(r.dataset, r.campaign, r.change) for r in changes.collect()} == {("hits", "", "renamed"), ("", "", "renamed")}
    out = rescue.conform(raw, {"x": "double"}, changes).collect()
    assert len(out) == 40 and all(r.x == 100 * r.raw_id + 0.5 and r._rescued is None and r.campaign is None for r in out)


def test_conform_rescues_and_replays(spark):
    raw = drift(spark)
    t = rescue.conform(raw, {"id": "bigint", "x": "double", "E": "double"}, rescue.field_changes(raw))
    p = t.toPandas()
    assert len(p) == raw.count()
    assert p[(p.file_no > 1) & (p.file_no != 4) & (p.raw_id < 900)].x.notna().all() and p[p.file_no == 3].E.notna().sum() == 30
    assert p[p.raw_id == 999]._rescued.iloc[0] == {"": "{broken"} and p[p.raw_id == 998]._rescued.iloc[0] is None
    assert p[(p.file_no == 5)]._rescued.map(lambda m: set(m) == {"note", "crate"}).all()
    q = rescue.promote(t, {"crate": "int", "nowhere": "string"}).toPandas()
    assert q[q.file_no == 5].crate.notna().all() and q.nowhere.isna().all()
    assert q[(q.file_no == 5)]._rescued.map(lambda m: set(m) == {"note"}).all()


# ---------------------------------------------------------------- 6 many small files
def test_reports_of_layouts():
    one = {"file": "/a/b.FLOW.hdf5", "event_id": "007"}
    assert [r["_event"] for r in compaction.reports_of(json.dumps(one))] == [7]
    assert len(compaction.reports_of(json.dumps([one, one], indent=2))) == 2
    assert len(compaction.reports_of("\n".join([json.dumps(one)] * 3) + "\n")) == 3
    for bad in (None, "", "  \n", '{"file": "x", "ev', json.dumps(one) + "\n" + json.dumps(one)[:9], "5", json.dumps({"file": "x"}), json.dumps({"event_id": 1})):
        assert compaction.reports_of(bad) == []
    assert compaction.file_name("/a//b.FLOW.hdf5") == compaction.file_name("./b.FLOW") == "b.FLOW"


def test_blocks_of_groups_are_balanced(spark):
    rng = np.random.default_rng(7)
    sizes = rng.integers(1, 2000, 3000)
    files = spark.createDataFrame([(int(i), int(n)) for i, n in enumerate(sizes)], "f long, n long")
    for limit in (1024, 8):  # one block, or several
        p = compaction.plan_groups(files, "f", "n", target_bytes=40_000, block_groups=limit).toPandas()
        load = p.groupby("group_id").n.sum()
        assert len(p) == 3000 and p.f.is_unique and abs(len(load) - sizes.sum() / 40_000) <= 8
        assert load.max() < 1.25 * load.mean() and load.min() > 0.7 * load.mean()


def test_ordered_rank_and_carried(spark):
    rng = np.random.default_rng(8)
    rows = [(None if i % 5 == 0 else "g", None if i % 11 == 0 else 1e12 if i == 7 else float(rng.integers(0, 40)), i) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, x double, i int")
    for by in ([], ["g"]):
        want = {}
        for key in {r[0] if by else 0 for r in rows}:
            own = sorted((r for r in rows if not by or r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
            want |= {r[2]: k for k, r in enumerate(own)}
        assert {r.i: r.rank for r in ordered_rank(df, by, ["x", "i"]).collect()} == want
    assert ordered_rank(df.limit(0), [], ["x", "i"]).count() == 0
    seen = {n: (n * 10 if n % 3 == 0 else None) for n in range(-20, 60, 2)}
    d = spark.createDataFrame([("a", n, v) for n, v in seen.items()], "k string, n int, v int")
    for own in (True, False):
        got = {r.n: (r.p, r.q) for r in carried(d, ["k"], "n", {"p": F.col("v")}, {"q": F.col("v")}, own, width=7).collect()}
        for n in seen:
            before = [v for m, v in seen.items() if v is not None and (m < n or own and m == n)]
            after = [v for m, v in seen.items() if v is not None and (m > n or own and m == n)]
            assert got[n] == (before[-1] if before else None, after[0] if after else None)


def test_deal_classes_balances():
    classes = [(k, float(2 ** (k / 4)), 200 - k) for k in range(40)] + [(100, 1e5, 3)]
    groups = 7
    dealt = compaction.deal_classes(classes, groups)
    load = np.zeros(groups)
    for cls, mean, n in classes:
        assert sum(c for _, c in dealt[cls]) == n
        for g, c in dealt[cls]:
            load[g] += c * mean
    assert load.max() - sorted(load)[-4] <= 1e5  # three giants, the rest level
    assert np.ptp(np.sort(load)[:4]) <= max(m for _, m, _ in classes[:-1])


def test_consolidation_keeps_each_report_once(spark, tmp_path):
    rows = [(i, f"s{i}", 10, T(1 + i % 5), json.dumps({"file": f"x/{i % 9}.FLOW.hdf5", "event_id": i % 30, "n": i})) for i in range(200)]
    rows += [(300, "b", 5, T(1), '{"file'), (301, "n", None, None, None), (302, "e", 0, T(2), "")]
    df = spark.createDataFrame(rows, "shard_id long, path string, n_bytes long, mtime timestamp_ntz, content string").withColumn("report", F.lit("clash"))
    out = f"file://{tmp_path}/o"
    got = compaction.consolidate_reports(df, out, target_bytes=500).collect()
    want = {(f"{i % 9}.FLOW", i % 30) for i in range(200)}
    assert len(got) == len(want) and {(r.file, r.event_id) for r in got} == want
    last = {}
    for i in range(200):
        last[(f"{i % 9}.FLOW", i % 30)] = max(last.get((f"{i % 9}.FLOW", i % 30), (0, 0)), (i % 5, i))
    assert all(json.loads(r.report)["n"] == last[(r.file, r.event_id)][1] for r in got)
    manifest = json.loads((tmp_path / "o" / "manifest.json").read_text())
    assert 1 < len(manifest["files"]) <= 20 and manifest["rows"] == len(want)
    assert compaction.consolidate_reports(df.limit(0), f"file://{tmp_path}/e").count() == 0


def test_nothing_is_published_when_rows_are_lost(spark, tmp_path, monkeypatch):
    def lossy(batches, staging):
        for b in batches:
            cols = [pa.array([0], pa.int32()), pa.array(["x"]), pa.array([b.num_rows - 1], pa.int64()), pa.array([0], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["group_id", "name", "n_rows", "check"])

    monkeypatch.setattr(compaction, "_write", lossy)
    df = spark.range(10).withColumn("group_id", F.lit(0))
    with pytest.raises(RuntimeError):
        compaction.consolidate(df, f"file://{tmp_path}/lost")
    assert not (tmp_path / "lost" / "manifest.json").exists()


def test_shared_dir_follows_the_session(spark):
    base = spark.sparkContext.getCheckpointDir()
    a = shared_dir(spark, "x")
    assert a.startswith("file:") and a != shared_dir(spark, "x")
    assert base is None or base.split("/")[-1] in a
