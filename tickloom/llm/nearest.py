"""Records paired with the nearest record in time of the same entity, by learned indexes over shards.

A shard holds the entities of one hash bucket within one slab of time; slabs overlap by the
tolerance, so that a record's shard holds all its possible partners. Within a shard a piecewise
linear index over the sorted (entity, time) keys predicts positions within a bounded error, and a
search of that width around the prediction finds the exact neighbours. Crowded shards are cut
further along time, at quantiles; what such a cut needs of its neighbours is one record an entity,
the last one before it and the first one after it. Only where many records ask at one instant are
they spread by hashes of their ids, with a copy of that cut each. The work stays in proportion to
the records, however many of them one entity holds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.skew import broadcast_if_small, carried, kept
from tickloom.session import ensure_checkpoint_dir

#: Positions by which a prediction may be off, rows of a side in one group, slab width in tolerances.
MAX_ERROR = 16
ROWS_PER_GROUP = 200_000
SLAB_TOLERANCES = 64
#: Cuts of a crowded shard at most; beyond that they are larger.
MOST_CUTS = 1024


class LearnedIndex:
    """Positions in a sorted array, predicted by linear pieces that are never off by more than ``error``."""

    def __init__(self, keys: np.ndarray, error: int = MAX_ERROR):
        self.keys, self.error, n = keys, error, len(keys)
        begins = np.array([0], dtype=np.int64)
        ends = np.array([n], dtype=np.int64)  # pieces [begin, end)
        done_b: list[np.ndarray] = []
        while len(begins):
            # a piece runs straight from its first to its last key
            which = np.repeat(np.arange(len(begins)), ends - begins)
            at = np.concatenate([np.arange(b, e) for b, e in zip(begins, ends)]) if len(begins) > 1 else np.arange(begins[0], ends[0])
            if not len(at):
                break
            lo, hi = keys[begins], keys[ends - 1]
            slope = np.where(hi > lo, (ends - 1 - begins) / np.where(hi > lo, hi - lo, 1), 0.0)
            off = np.abs(begins[which] + (keys[at] - lo[which]) * slope[which] - at)
            first = np.concatenate([[0], np.cumsum(ends - begins)[:-1]])
            worst = np.maximum.reduceat(off, first)
            fine = (worst <= error) | (ends - begins <= 2)
            done_b.append(begins[fine])
            b, e = begins[~fine], ends[~fine]
            mid = (b + e) // 2
            begins, ends = np.concatenate([b, mid]), np.concatenate([mid, e])
        self.begin = np.sort(np.concatenate(done_b)) if done_b else np.zeros(0, np.int64)
        last = np.concatenate([self.begin[1:], [n]]) - 1 if n else self.begin
        self.first = keys[self.begin] if n else np.zeros(0)
        span = keys[last] - self.first if n else self.first
        self.slope = np.where(span > 0, (last - self.begin) / np.where(span > 0, span, 1), 0.0) if n else self.first
        self.last = last

    def window(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds between which the lower bound of each query lies."""
        piece = np.maximum(np.searchsorted(self.first, q, side="right") - 1, 0)
        at = self.begin[piece] + (q - self.first[piece]) * self.slope[piece]
        at = np.clip(at, self.begin[piece], self.last[piece] + 1).astype(np.int64)
        n = len(self.keys)
        return np.clip(at - self.error - 1, 0, n), np.clip(at + self.error + 2, 0, n)


def _lower_bound(less, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """First position in [lo, hi] whose element is not less; all queries step together."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) // 2
        up = open_ & less(np.minimum(mid, np.maximum(hi - 1, 0)))
        lo = np.where(up, mid + 1, lo)
        hi = np.where(open_ & ~up, mid, hi)


def nearest_in_shard(le: list[np.ndarray], lt: np.ndarray, re: list[np.ndarray], rt: np.ndarray, rid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position of the nearest right record of the same entity for each left one (-1: none), and the distance.

    Among equally near records the one with the smallest id is taken.
    """
    none = np.full(len(lt), -1, dtype=np.int64), np.full(len(lt), np.inf)
    if not len(lt) or not len(rt):
        return none
    order = np.lexsort((rid, rt, *reversed(re)))
    e, t, ids = [x[order] for x in re], rt[order], rid[order]
    new = np.concatenate([[True], np.any([x[1:] != x[:-1] for x in e], axis=0)])
    code = np.cumsum(new) - 1
    # of records alike in entity and time only the smallest id can be wanted
    keep = new | np.concatenate([[True], t[1:] != t[:-1]])
    code, t, ids, order = code[keep], t[keep], ids[keep], order[keep]
    heads = [x[new] for x in e]
    # entities of the left side, by the same codes
    k = len(heads[0])
    both = [np.concatenate([h, x]) for h, x in zip(heads, le)]
    rank = np.lexsort((np.concatenate([np.zeros(k), np.ones(len(lt))]), *reversed(both)))
    is_head = rank < k
    of = np.cumsum(is_head) - 1
    qcode = np.full(len(lt), -1, dtype=np.int64)
    left = ~is_head
    who = rank[left] - k
    cand = of[left]
    same = (cand >= 0) & np.all([h[np.maximum(cand, 0)] == x[who] for h, x in zip(heads, le)], axis=0)
    qcode[who[same]] = cand[same]
    q = np.nonzero(qcode >= 0)[0]
    if not len(q):
        return none
    base, width = min(t.min(), lt[q].min()), (max(t.max(), lt[q].max()) - min(t.min(), lt[q].min())) * 1.01 + 1.0
    index = LearnedIndex(code * width + (t - base))
    qc, qt = qcode[q], lt[q]
    lo, hi = index.window(qc * width + (qt - base))
    n = len(t)

    def less(at: np.ndarray) -> np.ndarray:
        return (code[at] < qc) | ((code[at] == qc) & (t[at] < qt))

    pos = _lower_bound(less, lo, hi)
    # rounding of the combined keys could misplace a query; those few are searched in full
    ok = ((pos == 0) | less(np.maximum(pos - 1, 0))) & ((pos == n) | ~less(np.minimum(pos, n - 1)))
    if not ok.all():
        pos = np.where(ok, pos, _lower_bound(less, np.zeros(len(q), np.int64), np.full(len(q), n)))
    a, b = np.maximum(pos - 1, 0), np.minimum(pos, n - 1)
    da = np.where((pos > 0) & (code[a] == qc), np.abs(qt - t[a]), np.inf)
    db = np.where((pos < n) & (code[b] == qc), np.abs(t[b] - qt), np.inf)
    left_better = (da < db) | ((da == db) & (ids[a] < ids[b]))
    best, dist = np.where(left_better, a, b), np.minimum(da, db)
    found, how = none
    found[q] = np.where(np.isfinite(dist), order[best], -1)
    how[q] = dist
    return found, how


def _probe(entities: int, tolerance: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        def col(t: pa.Table, name: str) -> np.ndarray:
            return t[name].combine_chunks().to_numpy(zero_copy_only=False)

        names = [f"e{i}" for i in range(entities)]
        rid = col(right, "id")
        at, dist = nearest_in_shard([col(left, n) for n in names], col(left, "t"), [col(right, n) for n in names], col(right, "t"), rid)
        ok = np.nonzero((at >= 0) & (dist <= tolerance))[0]
        return pa.table({"left_id": pa.array(col(left, "id")[ok], pa.int64()), "right_id": pa.array(rid[at[ok]] if len(ok) else [], pa.int64()), "dist": pa.array(dist[ok], pa.float64())})

    return run


def nearest_in_time(
    left: DataFrame, right: DataFrame, entity: list[str], tolerance: float, left_id: str, right_id: str, left_time: Column, right_time: Column, rows_per_group: int = ROWS_PER_GROUP
) -> DataFrame:
    """``left_id, right_id, dist``: for each left record the nearest right one of its entity within ``tolerance``.

    The tolerance is included; of equally near records the smallest ``right_id`` is taken; a right
    record may serve many. Records with a NULL in the entity, or a time that is NULL or no finite
    number, have no partner. ``entity`` columns are integers, ids too. Repeated rows give one pair.
    Left records without a partner are left out; empty sides give no rows.
    """
    width = tolerance * SLAB_TOLERANCES

    def sharded(df: DataFrame, id_: str, time: Column) -> DataFrame:
        t = time.cast("double")
        cols = [F.col(e).cast("long").alias(f"e{i}") for i, e in enumerate(entity)]
        out = df.select(F.col(id_).cast("long").alias("id"), t.alias("t"), *cols)
        finite = F.col("t").isNotNull() & ~F.isnan("t") & (F.abs("t") < 1e15)
        for i in range(len(entity)):
            finite = finite & F.col(f"e{i}").isNotNull()
        return out.where(finite & F.col("id").isNotNull())

    l, r = sharded(left, left_id, left_time), kept(sharded(right, right_id, right_time))
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    buckets = min(100_000, max(2 * parts, -(-r.count() // (rows_per_group // 4))))
    names = [f"e{i}" for i in range(len(entity))]
    bucket = F.pmod(F.xxhash64(*names), F.lit(buckets)).cast("int")
    l = l.withColumn("bucket", bucket).withColumn("slab", F.floor(F.col("t") / width))
    r = r.withColumn("bucket", bucket).withColumn("slab", F.explode(F.sequence(F.floor((F.col("t") - tolerance) / width), F.floor((F.col("t") + tolerance) / width))))

    l, r = _cut_crowded(l, r, names, rows_per_group)
    group = ["bucket", "slab", "cut", "salt"]
    pairs = l.groupBy(*group).cogroup(r.groupBy(*group)).applyInArrow(_probe(len(entity), tolerance), "left_id long, right_id long, dist double")
    best = pairs.groupBy("left_id").agg(F.min(F.struct("dist", "right_id")).alias("_b"))
    return best.select("left_id", "_b.right_id", "_b.dist")


def _cut_crowded(l: DataFrame, r: DataFrame, names: list[str], rows_per_group: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``cut`` and ``salt``, 0 but in crowded shards."""
    shard, one, zero = ["bucket", "slab"], F.lit(1), F.lit(0)
    n = F.count(one)
    plain = lambda df: df.withColumns({"cut": zero, "salt": zero})
    sizes = l.groupBy(*shard).agg(n.alias("n")).unionByName(r.groupBy(*shard).agg(n.alias("n"))).groupBy(*shard).agg(F.max("n").alias("n"))
    crowded = sizes.where(F.col("n") > rows_per_group).select(*shard, F.least(F.ceil(2 * F.col("n") / rows_per_group), F.lit(MOST_CUTS)).cast("int").alias("cuts"))
    ensure_checkpoint_dir(l.sparkSession)
    crowded = crowded.checkpoint()  # one row for each rows_per_group records
    if not crowded.limit(1).count():
        return plain(l), plain(r)
    some = broadcast_if_small(crowded)
    # of records alike in entity and time only the smallest id can be wanted
    rc = r.join(some, shard).groupBy(*shard, *names, "t").agg(F.min("id").alias("id"))
    lc = l.join(some, shard).drop("cuts")
    times = lc.select(*shard, "t").unionByName(rc.select(*shard, "t")).groupBy(*shard).agg(F.percentile_approx("t", [i / MOST_CUTS for i in range(1, MOST_CUTS)], 10 * MOST_CUTS).alias("q"))
    # of the fine quantiles as many as cuts are wanted; both sides must see the same ones
    picked = F.transform(F.sequence(one, F.col("cuts") - 1), lambda i: F.get("q", F.greatest(F.floor(i * MOST_CUTS / F.col("cuts")).cast("int"), one) - 1))
    bounds = times.join(some, shard).select(*shard, F.array_distinct(picked).alias("bounds")).checkpoint()
    bounds = broadcast_if_small(bounds)
    cut = F.size(F.filter("bounds", lambda b: b <= F.col("t")))
    lc, rc = (df.join(bounds, shard).withColumn("cut", cut.cast("long")).drop("bounds") for df in (lc, rc))
    # of the cuts before and after, each entity that asks needs its last and its first record
    at = F.struct("t", "id")
    ends = rc.groupBy(*shard, *names, "cut").agg(F.min(at).alias("first"), F.max(at).alias("last"))
    asks = lc.select(*shard, *names, "cut").distinct()
    both = ends.join(asks.withColumn("asks", F.lit(True)), [*shard, *names, "cut"], "full")
    near = carried(both, [*shard, *names], "cut", {"before": F.col("last")}, {"after": F.col("first")}, own=False).where("asks")
    rc = rc.select(*shard, *names, "cut", "t", "id").unionByName(near.select(*shard, *names, "cut", F.inline(F.array_compact(F.array("before", "after")))).select(*shard, *names, "cut", "t", "id"))
    # many records at one instant: copies of the cut, which is small on the other side
    full = lc.groupBy(*shard, "cut").agg(n.alias("n")).where(F.col("n") > rows_per_group).select(*shard, "cut", F.ceil(F.col("n") / rows_per_group).cast("int").alias("salts"))
    full = broadcast_if_small(full)
    lc = lc.join(full, [*shard, "cut"], "left").withColumn("salt", F.pmod(F.xxhash64("id"), F.coalesce("salts", one)).cast("int"))
    rc = rc.join(full, [*shard, "cut"], "left").withColumn("salt", F.explode(F.sequence(zero, F.coalesce("salts", one) - 1)))
    rest = [plain(df.join(some.select(*shard), shard, "left_anti")) for df in (l, r)]
    return tuple(a.select(*c).unionByName(b.select(*c)) for a, b, c in ((rest[0], lc, [*shard, "cut", "salt", "id", "t", *names]), (rest[1], rc, [*shard, "cut", "salt", "id", "t", *names])))
