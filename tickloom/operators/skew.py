"""Building blocks against skew: kept frames, size-checked broadcasts, ranks in slices, joins on NULLs."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.session import ensure_checkpoint_dir

#: Rows up to which a side counts as small enough to broadcast once it has been counted.
BROADCAST_ROWS = 200_000


_kept: list[DataFrame] = []


def kept(df: DataFrame) -> DataFrame:
    """``df`` persisted (recomputed where an executor is lost) until ``release()``."""
    _kept.append(df.persist(StorageLevel.MEMORY_AND_DISK))
    return df


def kept_once(df: DataFrame, source: DataFrame) -> DataFrame:
    """``df`` kept, unless ``source``, which it is selected from, is."""
    return df if source.storageLevel.useMemory else kept(df)


def release() -> None:
    """Unpersist what operators have kept; results not read yet are still right, they are computed anew."""
    while _kept:
        df = _kept.pop()
        try:
            df.unpersist()
        except Exception:  # noqa: BLE001 - its session has ended, and with it what was kept
            continue


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint only when ``df`` is counted to hold at most ``max_rows`` rows.

    Beyond that the frame is returned without a hint, so that the join shuffles (AQE then splits
    skewed partitions). The count stops one row past the bound.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def join_null_safe(left: DataFrame, right: DataFrame, by: list[str], also: list[str] | None = None, how: str = "inner") -> DataFrame:
    """``left`` with the other columns of ``right``, matching NULL with NULL in ``by`` and plainly in ``also``."""
    keys = [*by, *(also or [])]
    r = right.select(*[F.col(k).alias(f"_by{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_by{i}")) if k in by else F.col(k) == F.col(f"_by{i}") for i, k in enumerate(keys)]
    return left.join(r, on, how).drop(*[f"_by{i}" for i in range(len(keys))])


def slices_for(df: DataFrame) -> int:
    return max(32, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def sliced_rank(df: DataFrame, by: list[str], order: list[str], slices: int | None = None, name: str = "rank") -> DataFrame:
    """0-based dense position of each row within its ``by`` group, although one group may hold most rows.

    Rows of a group are cut into ``slices`` by a hash of ``order``; a row's position is its
    ``row_number`` within (group, slice) plus the sizes of the slices before. No task ever holds
    more than a slice of a group. The positions are a function of the rows alone: every evaluation
    gives the same ones (rows equal in all of ``order`` are interchangeable).

    NULLs in ``by`` form a group of their own; an empty frame gives an empty frame.
    """
    s = slices or slices_for(df)
    cut = df.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(s)).cast("int"))
    sizes = cut.groupBy(*by, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    left = cut.withColumn(
        "_in", F.row_number().over(Window.partitionBy(*by, "_slice").orderBy(*order)).cast("long") - 1
    )
    return join_null_safe(left, offsets, by, ["_slice"]).select(*df.columns, (F.col("_in") + F.col("_before")).alias(name))


#: Width of the cells within which rows along an order are sorted at once.
CELL = 1024


def carried(
    df: DataFrame, by: list[str], at: str, past: dict[str, Column], ahead: dict[str, Column] | None = None, own: bool = True, width: int = CELL
) -> DataFrame:
    """``df`` with the last value before (``past``) and the next one after (``ahead``) each row that isn't NULL.

    Rows of a group are ordered by the whole number ``at``; with ``own`` a row's own value counts as
    the nearest. Only cells of ``width`` numbers are sorted row by row; what crosses their borders is
    carried over one row per cell, so that a group may hold most of the rows. ``by`` and ``at`` hold
    no NULL; rows alike in them are one another's neighbours in any order.
    """
    ahead = ahead or {}
    c = df.withColumn("_cell", F.floor(F.col(at) / width))
    upto = 0 if own else -1
    inside = Window.partitionBy(*by, "_cell")
    forth, back = (inside.orderBy(o).rowsBetween(Window.unboundedPreceding, upto) for o in (F.asc(at), F.desc(at)))
    near = c.withColumns({n: F.last(v, ignorenulls=True).over(forth) for n, v in past.items()} | {n: F.last(v, ignorenulls=True).over(back) for n, v in ahead.items()})
    place = {n: F.when(v.isNotNull(), F.col(at)) for n, v in (past | ahead).items()}
    cells = c.groupBy(*by, "_cell").agg(
        *[F.max_by(v, place[n]).alias(f"_o_{n}") for n, v in past.items()], *[F.min_by(v, place[n]).alias(f"_o_{n}") for n, v in ahead.items()]
    )
    along = Window.partitionBy(*by)
    before, after = (along.orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("_cell"), F.desc("_cell")))
    far = cells.select(
        *by, "_cell", *[F.last(f"_o_{n}", ignorenulls=True).over(before).alias(f"_f_{n}") for n in past], *[F.last(f"_o_{n}", ignorenulls=True).over(after).alias(f"_f_{n}") for n in ahead]
    )
    names = [*past, *ahead]
    return near.join(far, [*by, "_cell"], "left").withColumns({n: F.coalesce(n, f"_f_{n}") for n in names}).select(*df.columns, *names)


def quantile_buckets(df: DataFrame, by: list[str], x: str, buckets: int = 64, name: str = "_b") -> DataFrame:
    """``df`` with the number of its bucket: how many of the group's quantiles of ``x`` lie below the row's.

    The cuts are quantiles, so that no outlier leaves all other rows in one bucket; rows alike in
    ``x`` share one. NULL in ``x`` is bucket -1, before all others; NaN is in the last.
    """
    v = F.col(x).cast("double")
    ranks = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    sketch = F.kll_sketch_agg_double(F.when(~F.isnan(v), v))
    cuts = df.groupBy(*by).agg(F.when(F.count(F.when(~F.isnan(v), v)) > 0, F.kll_sketch_get_quantile_double(sketch, ranks)).alias("_cuts"))
    # sketches differ from run to run; all that follows must see the same cuts
    ensure_checkpoint_dir(df.sparkSession)
    cuts = cuts.checkpoint()
    wide = join_null_safe(df, cuts, by) if by else df.crossJoin(F.broadcast(cuts))  # one row
    # binary search: the number of cuts below the value
    steps = F.array(*[F.lit(1 << i) for i in reversed(range((buckets - 1).bit_length()))])
    below = F.aggregate(steps, F.lit(0), lambda n, step: n + F.when(F.coalesce(F.get("_cuts", n + step - 1) < v, F.lit(False)), step).otherwise(0))
    return wide.withColumn(name, F.when(v.isNull(), -1).otherwise(below).cast("int")).drop("_cuts")


def ordered_rank(df: DataFrame, by: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """0-based position of each row in its ``by`` group, in ascending ``order`` (a number first), although one group may hold all rows.

    Only rows of one bucket of the first column's quantiles are sorted together; the sizes of the
    buckets before are added. NULLs come first. A NULL in ``by`` is a group of its own.
    """
    b = quantile_buckets(df, by, order[0])
    sizes = b.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    sizes = sizes.select(*by, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = b.withColumn("_in", F.row_number().over(Window.partitionBy(*by, "_b").orderBy(*order)) - 1)
    return join_null_safe(inside, sizes, by, ["_b"]).select(*df.columns, (F.col("_in") + F.col("_before")).alias(name))
