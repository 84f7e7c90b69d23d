"""Per-key results over a join, by eager aggregation: both inputs are reduced by join key first.

``COUNT`` and ``SUM`` over ``L JOIN R ON k GROUP BY g`` distribute over the join: with ``n`` the
number of left rows of (k, g) and (m, s) the number and sum of the right rows of k, the joined
group has ``sum(n * m)`` rows and the sum ``sum(n * s)``. Only one compact state per join key
crosses the join, and a heavy group key ``g`` is reduced on the map side of the last exchange, so
no task is longer than another however many rows one ``g`` has.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.skew import kept


def key_states(df: DataFrame, keys: list[str], sums: dict[str, Column] | None = None) -> DataFrame:
    """One compact state per key: ``n`` rows and the wanted sums (NULL where a key has no value)."""
    aggs = [F.count(F.lit(1)).alias("n")] + [F.sum(c).alias(name) for name, c in (sums or {}).items()]
    return df.groupBy(*keys).agg(*aggs)


def eager_join_aggregate(
    left: DataFrame,
    right: DataFrame,
    on: str,
    group: list[str],
    sums: dict[str, Column] | None = None,
    count: str = "n_rows",
    left_sums: dict[str, Column] | None = None,
    stored: str | None = None,
) -> DataFrame:
    """``SELECT group, COUNT(*), SUM(..) FROM left JOIN right USING (on) GROUP BY group`` without the skew.

    ``sums`` maps result names to columns of ``right``, ``left_sums`` to columns of ``left``. NULL
    join keys match nothing; a NULL group is a group; repeated rows count as often as they are
    stored (their numbers multiply); a group whose values are all NULL has the sum NULL; empty
    inputs give an empty result. Columns that both inputs share, other than ``on``, do no harm:
    only states cross the join. With ``stored`` the join is a left one: every group of ``left``
    comes out, and the column of that name has the number of its left rows, matched or not.
    """
    ours, theirs = list((left_sums or {}).items()), list((sums or {}).items())
    ls = key_states(left if stored else left.where(F.col(on).isNotNull()), [on, *group], {f"_l{i}": c for i, (_, c) in enumerate(ours)})
    rs = key_states(right.where(F.col(on).isNotNull()), [on], {f"_s{i}": c for i, (_, c) in enumerate(theirs)})
    ls = ls.select(F.col(on).alias("_k"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("n").alias("_n"), *[f"_l{i}" for i in range(len(ours))])
    rs = rs.withColumnsRenamed({on: "_k", "n": "_m"})
    if stored:
        # states without a key match nothing and may be many: they are spread
        spread = F.pmod(F.xxhash64(*[f"_g{i}" for i in range(len(group))]), F.lit(1000)) + 1
        ls, rs = ls.withColumn("_spread", F.when(F.col("_k").isNull(), spread).otherwise(0)), rs.withColumn("_spread", F.lit(0).cast("long"))
    joined = ls.join(rs, ["_k", "_spread"] if stored else "_k", "left" if stored else "inner")
    times = F.coalesce("_m", F.lit(0))
    return joined.groupBy(*[F.col(f"_g{i}").alias(g) for i, g in enumerate(group)]).agg(
        F.sum(F.col("_n") * times).alias(count),
        *([F.sum("_n").alias(stored)] if stored else []),
        *[F.sum(F.col("_n") * F.col(f"_s{i}")).alias(name) for i, (name, _) in enumerate(theirs)],
        *[F.sum(F.when(times > 0, times * F.col(f"_l{i}"))).alias(name) for i, (name, _) in enumerate(ours)],
    )


@dataclass(frozen=True)
class KeyedJoin:
    """Per-key results wanted of ``left JOIN right USING (on)``, by ``key`` of ``left``, with sums of ``right``."""

    left: DataFrame
    right: DataFrame
    on: str
    key: str
    sums: dict[str, Column]


def heavy_keys(joins: list[KeyedJoin], share: float) -> DataFrame:
    """Keys that hold more than ``share`` of all rows of their table, read off the per-key results of each join.

    NULL is no key, yet its rows count in the total. Rows: ``key_name, key_id``, ``n_rows`` of the
    table as stored, ``n_joined`` over the join; at most ``1/share`` rows per join.
    """
    parts = []
    for j in joins:
        # one row per key, kept: the total and the keys beyond it are both read off these
        results = kept(eager_join_aggregate(j.left, j.right, j.on, [j.key], j.sums, "n_joined", stored="n_stored"))
        total = results.agg(F.sum("n_stored").alias("_total"))  # one row
        parts.append(
            results.join(F.broadcast(total), F.col("n_stored") > F.lit(share) * F.col("_total"), "inner")
            .where(F.col(j.key).isNotNull())
            .select(F.lit(j.key).alias("key_name"), F.col(j.key).cast("long").alias("key_id"), F.col("n_stored").alias("n_rows"), "n_joined")
        )
    return reduce(DataFrame.unionByName, parts)
