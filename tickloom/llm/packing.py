"""Filling containers of fixed capacity by minimum bin slack over the lengths of all items.

What can fill a container depends only on how many items of each length are left, and there are no
more lengths than the capacity. So the plan is made on that histogram: with the longest item left
as a start, a bitset subset-sum over the remaining multiset finds the fill closest to the capacity
and, backtracked, how many items of each length make it; the pattern is repeated as often as the
counts allow. Each item then finds its container by its length and its rank within the length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.skew import kept, sliced_rank


def best_fill(counts: dict[int, int], order: list[int], room: int) -> dict[int, int]:
    """Counts by length whose sum is at most ``room`` and as close to it as any choice gets.

    ``order`` lists the lengths that may be used, longest first; reachable sums are the bits of one
    integer, and a length that is there many times enters as 1, 2, 4, ... copies.
    """
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in order:
        left = min(counts[length], room // length) if length <= room else 0
        copies = 1
        while left > 0:
            take = min(copies, left)
            new = (reach | (reach << (take * length))) & mask
            if new != reach:
                steps.append((reach, length, take))
                reach = new
                if reach >> room & 1:
                    break
            left -= take
            copies *= 2
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    out: dict[int, int] = {}
    for before, length, take in reversed(steps):
        if not before >> at & 1:
            out[length] = out.get(length, 0) + take
            at -= take * length
    return out


def plan_patterns(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """``(times, counts by length)`` patterns that use up the histogram of lengths 1..capacity."""
    counts = {n: c for n, c in histogram.items() if c > 0}
    order = sorted(counts, reverse=True)
    plan = []
    while order:
        longest = order[0]
        counts[longest] -= 1
        fill = best_fill(counts, order, capacity - longest)
        counts[longest] += 1
        fill[longest] = fill.get(longest, 0) + 1
        times = min(counts[n] // c for n, c in fill.items())
        plan.append((times, fill))
        for n, c in fill.items():
            counts[n] -= times * c
        if any(not counts[n] for n in fill):
            order = [n for n in order if counts[n]]
    return plan


def pack(items: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """``key, piece, start, length, container_id``: every item in a container, none filled beyond ``capacity``.

    An item longer than ``capacity`` is split into full pieces and a rest; no other is split. Items
    of NULL, zero or negative size take no room and are spread over the containers (over container
    0 when there are no others). Repeated rows are items of their own. The driver holds the
    histogram of lengths, at most ``capacity`` numbers.
    """
    width = F.greatest(F.coalesce(F.col(size), F.lit(0)).cast("long"), F.lit(0))
    last = F.greatest(F.ceil(width / capacity).cast("long") - 1, F.lit(0))
    # sizes may be costly; histogram and ranks share them
    pieces = kept(
        items.select(F.col(key), width.alias("_w"), F.posexplode(F.sequence(F.lit(0).cast("long"), last)).alias("piece", "_n"))
        .select(key, "piece", (F.col("_n") * capacity).alias("start"), F.least(F.col("_w") - F.col("_n") * capacity, F.lit(capacity)).cast("int").alias("length"))
    )
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = plan_patterns({n: c for n, c in histogram.items() if n}, capacity)
    total = sum(t for t, _ in plan)
    runs: dict[int, list[tuple[int, int, int]]] = {}
    first, used = 0, dict.fromkeys(histogram, 0)
    for times, fill in plan:
        for n, c in fill.items():
            runs.setdefault(n, []).append((used[n], first, c))
            used[n] += times * c
        first += times
    table = {n: tuple(np.array(x, dtype=np.int64) for x in zip(*r)) for n, r in runs.items()}
    shared = items.sparkSession.sparkContext.broadcast(table)
    ranked = sliced_rank(pieces, ["length"], [key, "piece"], name="_rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            out = rank % max(total, 1)
            order = np.argsort(length, kind="stable")
            cuts = np.nonzero(np.diff(length[order]))[0] + 1
            for at in np.split(order, cuts):
                if len(at) and length[at[0]] > 0:
                    begins, base, each = shared.value[int(length[at[0]])]
                    k = np.searchsorted(begins, rank[at], side="right") - 1
                    out[at] = base[k] + (rank[at] - begins[k]) // each[k]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in (key, "piece", "start", "length")] + [pa.array(out, pa.int64())], names=[key, "piece", "start", "length", "container_id"])

    kind = items.schema[key].dataType.simpleString()
    return ranked.mapInArrow(place, f"{key} {kind}, piece int, start long, length int, container_id long")
