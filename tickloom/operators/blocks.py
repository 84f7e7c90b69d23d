"""Points of many groups in blocks of bounded rows, for NumPy kernels that take many groups at once.

Small groups share a block. A group of very many points is cut into slabs along the first axis; a
slab also gets the points within ``reach`` of it, so that each point meets all its neighbours in the
slab that owns it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.spatial import XYZ, place_known

#: Points a block holds, without those around a slab.
MOST = 300_000


def blocks(points: DataFrame, by: list[str], reach: float, axes: tuple[str, ...] = XYZ, most: int = MOST) -> tuple[DataFrame, bool]:
    """``points`` with ``_part`` (the block), ``_own`` (false: only near the slab), ``_cut`` (its group lies in several blocks) and ``_shared`` (another slab may have it too), and whether any is cut.

    Points without a known place, or with a NULL in ``by``, are near nothing and left out.
    """
    spark = points.sparkSession
    p = points.where(place_known(axes))
    for k in by:
        p = p.where(F.col(k).isNotNull())
    sizes = p.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    big = F.col("_n") > most // 4
    # one row a group of at least most / 4 points, and one of the rest
    rows = sizes.groupBy(*[F.when(big, F.col(k)).alias(k) for k in by], big.alias("_big")).agg(F.sum("_n").alias("_n")).collect()
    rest = sum(r["_n"] for r in rows if not r["_big"])
    spread = F.pmod(F.xxhash64(*by), F.lit(max(1, -(-rest // (most // 2))))) if by else F.lit(0)
    large = [r for r in rows if r["_big"]]
    if not large:
        return p.withColumns({"_part": spread.cast("long"), "_own": F.lit(True), "_cut": F.lit(False), "_shared": F.lit(False)}), False
    kinds = [points.schema[k] for k in by]
    cell = F.floor(F.col(axes[0]) / reach).cast("long")
    ends = []  # group, block, its first and last cell
    whole = [tuple(r[k] for k in by) for r in large if r["_n"] <= most]
    cut = {tuple(r[k] for k in by): -(-r["_n"] // most) for r in large if r["_n"] > most}
    part = -1
    for g in whole:
        ends.append((*g, part, None, None))
        part -= 1
    if cut:
        filled = p.select(*by, cell.alias("_c"))
        if by:
            filled = filled.join(F.broadcast(spark.createDataFrame(list(cut), _schema(kinds))), by, "left_semi")
        counts: dict[tuple, list] = {}
        for r in filled.groupBy(*by, "_c").count().collect():
            counts.setdefault(tuple(r[k] for k in by), []).append((r["_c"], r["count"]))
        for g, cells in sorted(counts.items(), key=str):
            share = sum(n for _, n in cells) / cut[g]
            held, first = 0, None
            for c, n in sorted(cells):
                if first is not None and held + n / 2 > share:
                    ends.append((*g, part, first, last))
                    part, held, first = part - 1, 0, None
                first, last, held = c if first is None else first, c, held + n
            ends.append((*g, part, first, last))
            part -= 1
    # the cells on both sides of a slab are its neighbourhood
    slabs = F.broadcast(spark.createDataFrame(ends, _schema(kinds, "_p long, _a long, _b long")))
    key = [F.col(k) == F.col(f"_by_{k}") for k in by]
    j = p.withColumn("_c", cell).join(slabs.withColumnsRenamed({k: f"_by_{k}" for k in by}), [*key, F.col("_a").isNull() | F.col("_c").between(F.col("_a") - 1, F.col("_b") + 1)], "left")
    out = j.withColumns({"_part": F.coalesce("_p", spread.cast("long")), "_own": F.coalesce(F.col("_c").between(F.col("_a"), F.col("_b")), F.lit(True)), "_cut": F.col("_a").isNotNull(), "_shared": F.coalesce((F.col("_c") <= F.col("_a")) | (F.col("_c") >= F.col("_b")), F.lit(False))})
    return out.drop("_c", "_p", "_a", "_b", *[f"_by_{k}" for k in by]), bool(cut)


def _schema(kinds: list, more: str = "") -> str:
    return ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kinds], *([more] if more else [])])


def by_block(points: DataFrame, by: list[str], schema: str, kernel: Callable[..., tuple[np.ndarray | None, list]]) -> DataFrame:
    """``by`` and the columns of ``schema``: the kernel on each block.

    It gets the block's table and a number for each row's group, and returns the rows (positions) that
    name the group of each row of the result, and the columns of the result.
    """
    kinds = [points.schema[k] for k in by]

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        group = np.zeros(t.num_rows, np.int64)
        for k in by:
            _, no = np.unique(t[k].combine_chunks().dictionary_encode().indices.to_numpy(), return_inverse=True)
            _, group = np.unique(group * (no.max(initial=0) + 1) + no, return_inverse=True)
        at, columns = kernel(t, group)
        keys = t.select(by).take(pa.array(at))
        return pa.table([*[keys[k] for k in by], *columns], names=[*by, *names])

    names = [c.split()[0] for c in schema.split(", ")]
    return points.groupBy("_part").applyInArrow(run, _schema(kinds, schema))


def places(t: pa.Table, axes: tuple[str, ...] = XYZ) -> np.ndarray:
    return np.column_stack([t[a].to_numpy().astype(float) for a in axes])
