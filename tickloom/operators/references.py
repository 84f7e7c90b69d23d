"""References to records that were not there: range-partitioned sorted arrays, probed in batches.

Keys are cut into ranges at quantiles of the parents' keys. Each range of parents becomes sorted
arrays in one Python worker; the references of the range are probed against them by binary search,
a whole Arrow table at a time. No range outgrows a task: one of too many parents is cut by a hash of
the keys; a key of too many versions is cut along time, where each slab also gets what the versions
before and after it can mean for its references; a range of too many references (one key may hold a
third of all) is salted, its references spread over several groups with a copy of the range each.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.skew import BROADCAST_ROWS, broadcast_if_small
from tickloom.session import ensure_checkpoint_dir

#: Parents per range, references per group, and ranges told apart by their quantiles: larger ones are cut by hashes.
PARENTS_PER_RANGE = 400_000
REFS_PER_GROUP = 400_000
QUANTILE_RANGES = 4096
#: Slabs of time that a key of too many versions is cut into at most.
SLABS = 1024

_NONE = np.iinfo(np.int64).min
_EVER = np.iinfo(np.int64).max
#: Later than any removal: the end of a version never removed, where ends are compared.
_LAST = "9999-12-31 23:59:59"


@dataclass(frozen=True)
class Reference:
    """Column ``fk`` of reference table ``tbl`` refers to ``key`` of ``target``."""

    tbl: str
    fk: str
    target: str
    key: str


def _micros(col: pa.ChunkedArray, null: int) -> np.ndarray:
    return col.combine_chunks().cast(pa.int64()).fill_null(null).to_numpy(zero_copy_only=False)


def probe_sorted(
    key: np.ndarray, at: np.ndarray, pkey: np.ndarray, begin: np.ndarray, end: np.ndarray
) -> np.ndarray:
    """0 there, 1 missing, 2 late, 3 deleted, for references (``key``, ``at``) to versions of parents.

    ``begin`` is the smallest int64 where unknown (such a version is never there nor late), ``end``
    the largest where the version was never removed. A reference of unknown time (smallest int64)
    can only be missing.
    """
    out = np.ones(len(key), dtype=np.int8)
    if not len(pkey) or not len(key):
        return out
    keys = np.unique(pkey)
    begins = np.unique(begin[begin != _NONE])
    width = len(begins) + 2
    order = np.lexsort((end, begin, pkey))
    pk, b, e = np.searchsorted(keys, pkey[order]), begin[order], end[order]
    rank = np.where(b == _NONE, 0, np.searchsorted(begins, b) + 1)
    e = np.where(b == _NONE, _NONE, e)
    code = pk.astype(np.int64) * width + rank
    # the latest end among the versions of a key that began so far: a running maximum restarted at each key
    erank = np.unique(e, return_inverse=True)
    lift = pk.astype(np.int64) * (len(erank[0]) + 1) + erank[1]
    latest = erank[0][np.maximum.accumulate(lift) % (len(erank[0]) + 1)]
    last_rank = np.zeros(len(keys), dtype=np.int64)
    np.maximum.at(last_rank, pk, rank)
    pos = np.searchsorted(keys, key)
    hit = (pos < len(keys)) & (keys[np.minimum(pos, len(keys) - 1)] == key)
    p = pos[hit].astype(np.int64)
    t = at[hit]
    seen = np.searchsorted(begins, t, side="right")  # begins that lie at or before the reference
    i = np.searchsorted(code, p * width + seen, side="right") - 1
    same = (i >= 0) & (pk[np.maximum(i, 0)] == p)
    there = same & (latest[np.maximum(i, 0)] > t) & (rank[np.maximum(i, 0)] > 0)
    late = last_rank[p] > seen
    out[hit] = np.where(there | (t == _NONE), 0, np.where(late, 2, 3))
    return out


_KINDS = pa.array(["missing", "late", "deleted"])


def _probe(refs: pa.Table, parents: pa.Table) -> pa.Table:
    found = probe_sorted(
        refs["key"].combine_chunks().to_numpy(zero_copy_only=False),
        _micros(refs["at"], _NONE),
        parents["key"].combine_chunks().to_numpy(zero_copy_only=False),
        _micros(parents["begin"], _NONE),
        _micros(parents["end"], _EVER),
    )
    at = np.nonzero(found)[0]
    return pa.table(
        {
            "fk_no": refs["fk_no"].take(pa.array(at)).combine_chunks().cast(pa.int32()),
            "ref_id": refs["ref_id"].take(pa.array(at)).combine_chunks().cast(pa.int64()),
            "at": refs["at"].take(pa.array(at)).combine_chunks(),
            "kind": _KINDS.take(pa.array(found[at] - 1)),
        }
    )


def _range_of(df: DataFrame, key: str, splits: list[float], name: str) -> DataFrame:
    """The number of the range that a key lies in; monotone, and the same for equal keys."""
    if not splits:
        return df.withColumn(name, F.when(F.col(key).isNotNull(), F.lit(0)))
    from pyspark.ml.feature import Bucketizer

    with_double = df.withColumn("_d", F.col(key).cast("double"))
    b = Bucketizer(splits=[-float("inf"), *splits, float("inf")], inputCol="_d", outputCol="_b", handleInvalid="keep")
    return b.transform(with_double).withColumn(name, F.col("_b").cast("int")).drop("_d", "_b")


def _slabs_of_versions(parent: DataFrame, per_range: int) -> DataFrame | None:
    """``target, key, slabs``: instants between which the versions of a key are about ``per_range``, for keys of more versions; None without such keys."""
    n = F.count(F.lit(1))
    heavy = parent.groupBy("target", "key").agg(n.alias("n")).where(F.col("n") > per_range)
    if not heavy.limit(1).count():
        return None
    versions = parent.join(broadcast_if_small(heavy), ["target", "key"]).where("begin IS NOT NULL")
    steps = F.transform(F.sequence(F.lit(1), F.least(F.ceil(F.col("n") / per_range).cast("int"), F.lit(SLABS)) - 1), lambda i: i)
    fine = versions.groupBy("target", "key", "n").agg(F.percentile_approx("begin", [i / SLABS for i in range(1, SLABS)], 10 * SLABS).alias("q"))
    # of the fine quantiles as many as slabs are wanted
    count = F.size(steps) + 1
    # approximate quantiles may differ from run to run; references and parents must see the same ones
    ensure_checkpoint_dir(parent.sparkSession)
    return fine.select("target", "key", F.array_distinct(F.transform(steps, lambda i: F.get("q", F.least(F.floor(i * SLABS / count).cast("int"), F.lit(SLABS - 1)) - 1))).alias("slabs")).checkpoint()


def _slab(at: str) -> Column:
    """How many of the key's instants lie at or before ``at``; 0 for keys without slabs and an unknown time."""
    return F.coalesce(F.size(F.filter("slabs", lambda s: s <= F.col(at))), F.lit(0)).cast("int")


def _in_slabs(parent: DataFrame, slabs: DataFrame) -> DataFrame:
    """Parents with their slab; slabs of one key also get a version for all before them, and a mark of the last one after.

    A reference in a slab is not before any version of the slabs before it, so of these only the
    latest end matters; of those after it only that there are some.
    """
    p = parent.join(slabs, ["target", "key"], "left").withColumn("slab", _slab("begin"))
    cut = p.where("slabs IS NOT NULL")
    end = F.coalesce("end", F.lit(_LAST).cast(parent.schema["end"].dataType))
    each = cut.groupBy("target", "key", "rng", "cut", "slab").agg(F.min("begin").alias("first"), F.max("begin").alias("last"), F.max(F.when(F.col("begin").isNotNull(), end)).alias("ends"))
    # one row a slab, at most SLABS a key; slabs without versions of their own may still hold references
    every = cut.select("target", "key", "rng", "cut", "slabs").distinct().select("target", "key", "rng", "cut", F.explode(F.sequence(F.lit(0), F.size("slabs"))).alias("slab"))
    along = Window.partitionBy("target", "key").orderBy("slab")
    before, after = along.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("target", "key").orderBy(F.desc("slab")).rowsBetween(Window.unboundedPreceding, -1)
    carry = every.join(each, ["target", "key", "rng", "cut", "slab"], "left").select(
        "target", "key", "rng", "cut", "slab",
        F.struct(F.min("first").over(before).alias("begin"), F.max("ends").over(before).alias("end")).alias("was"),
        F.struct(F.max("last").over(after).alias("begin"), F.max("last").over(after).alias("end")).alias("comes"),
    )
    cols = ["target", "key", "rng", "cut", "slab", "begin", "end"]
    # a row without begin says no more than that the key is known
    carried = carry.select("target", "key", "rng", "cut", "slab", F.inline(F.array("was", "comes")))
    return p.select(*cols).unionByName(carried.select(*cols))


def orphan_references(
    tables: Callable[[str], DataFrame],
    references: list[Reference],
    ref_id: str = "ref_id",
    at: str = "ref_ts",
    begin: str = "ingest_ts",
    end: str = "removed_ts",
    none_key: int = -1,
    per_range: int = PARENTS_PER_RANGE,
    per_group: int = REFS_PER_GROUP,
    quantile_ranges: int = QUANTILE_RANGES,
) -> DataFrame:
    """``tbl, ref_id, fk, kind, at`` of each reference whose record was not there at that time, once.

    A version of a record is there when ``begin <= at`` and ``end`` is NULL or ``> at``. If none is,
    ``kind`` is ``missing`` (no version at all), ``late`` (some version begins later) or ``deleted``.
    NULL and ``none_key`` refer to nothing. A reference without a time is reported only when
    ``missing``; a version without ``begin`` is never there and never late. Repeated rows come out
    once. Empty references give no rows; without parents every reference is missing.
    """
    targets = list(dict.fromkeys((r.target, r.key) for r in references))
    no = {t: i for i, t in enumerate(targets)}
    parents, splits, uneven = [], {}, False
    for t, k in targets:
        p = tables(t).select(F.col(k).cast("long").alias("key"), F.col(begin).alias("begin"), F.col(end).alias("end")).where("key IS NOT NULL")
        wanted = -(-p.count() // per_range)
        ranges = max(1, min(quantile_ranges, wanted))
        cuts: list[float] = []
        if ranges > 1:
            q = p.agg(F.percentile_approx("key", [i / ranges for i in range(1, ranges)], 4 * ranges + 1000).alias("q")).first()["q"]
            cuts = sorted({float(x) for x in q})
        # quantiles make ranges alike, unless too few were taken or one key spans several of them
        uneven = uneven or wanted > ranges or len(cuts) < ranges - 1
        splits[(t, k)] = cuts
        parents.append(_range_of(p, "key", cuts, "rng").withColumn("target", F.lit(no[(t, k)])))
    parent = reduce(DataFrame.unionByName, parents)

    refs = []
    for tbl in dict.fromkeys(r.tbl for r in references):
        own = [(i, r) for i, r in enumerate(references) if r.tbl == tbl]
        df = tables(tbl)
        df = df.select(F.col(ref_id).alias("ref_id"), F.col(at).alias("at"), *[F.col(r.fk).cast("long").alias(f"k{i}") for i, r in own])
        for i, r in own:
            df = _range_of(df, f"k{i}", splits[(r.target, r.key)], f"r{i}")
        each = F.array(
            *[
                F.struct(F.lit(i).alias("fk_no"), F.lit(no[(r.target, r.key)]).alias("target"), F.col(f"r{i}").alias("rng"), F.col(f"k{i}").alias("key"))
                for i, r in own
            ]
        )
        refs.append(
            df.select("ref_id", "at", F.inline(each)).where(F.col("key").isNotNull() & (F.col("key") != none_key))
        )
    ref = reduce(DataFrame.unionByName, refs)

    # at most quantile_ranges rows a target: ranges that quantiles could not make small enough
    sizes = parent.groupBy("target", "rng").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * per_range).collect() if uneven else []
    spark, slabs, group = ref.sparkSession, None, ["target", "rng"]
    if sizes:
        group.append("cut")
        large = F.broadcast(spark.createDataFrame([(r.target, r.rng, -(-r.n // per_range)) for r in sizes], "target int, rng int, cuts int"))
        by_hash = F.pmod(F.xxhash64("key"), F.coalesce("cuts", F.lit(1))).cast("int")
        ref, parent = (df.join(large, ["target", "rng"], "left").withColumn("cut", by_hash) for df in (ref, parent))
        slabs = _slabs_of_versions(parent.where("cuts IS NOT NULL"), per_range)
        ref, parent = ref.drop("cuts"), parent.drop("cuts")
        # of versions without begin it is enough to know that there are any
        unknown = F.col("begin").isNull()
        parent = parent.where(~unknown).unionByName(parent.where(unknown).withColumn("end", F.lit(None).cast(parent.schema["end"].dataType)).distinct())
    if slabs is not None:
        group.append("slab")
        slabs = broadcast_if_small(slabs)
        ref, parent = ref.join(slabs, ["target", "key"], "left").withColumn("slab", _slab("at")).drop("slabs"), _in_slabs(parent, slabs)

    crowded = ref.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > per_group).select(*group, F.ceil(F.col("n") / per_group).cast("int").alias("salts"))
    salts = crowded.limit(BROADCAST_ROWS + 1).collect()
    if salts:
        salts = F.broadcast(spark.createDataFrame(salts, crowded.schema)) if len(salts) <= BROADCAST_ROWS else crowded
        ref = ref.join(salts, group, "left").withColumn("salt", F.pmod(F.xxhash64("ref_id", "key"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
        parent = parent.join(salts, group, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
        group = [*group, "salt"]

    at_type = dict(ref.dtypes)["at"]
    ref = ref.select(*group, "fk_no", "ref_id", "key", "at")
    parent = parent.select(*group, "key", "begin", "end")
    missed = (
        ref.groupBy(*group).cogroup(parent.groupBy(*group)).applyInArrow(_probe, f"fk_no int, ref_id long, at {at_type}, kind string")
    )
    names = F.array(*[F.struct(F.lit(r.tbl).alias("tbl"), F.lit(r.fk).alias("fk")) for r in references])
    return (
        missed.dropDuplicates(["fk_no", "ref_id", "kind", "at"])
        .withColumn("_r", F.element_at(names, F.col("fk_no") + 1))
        .select("_r.tbl", "ref_id", "_r.fk", "kind", "at")
    )


def orphan_report(orphans: DataFrame, period: str = "month") -> DataFrame:
    """Number of orphans by table, column, kind and period of the reference's time (NULL if unknown)."""
    return (
        orphans.groupBy("tbl", "fk", "kind", F.date_format(F.date_trunc(period, "at"), "yyyy-MM-dd").alias("period"))
        .agg(F.count(F.lit(1)).alias("n_orphans"))
    )
