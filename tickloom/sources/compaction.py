"""Consolidation of many small files: balanced longest-first groups, streamed through pyarrow.

The plan needs only how many files there are of each size: sizes are put into narrow classes, and
classes are dealt out longest first to the least loaded of a fixed number of output groups with a
heap, many files of a class at a time. A file's group then follows from its class and its rank in
the class. Each group is streamed into one Parquet file of a staging folder; when rows and hashes
add up, the manifest is published under its final name in one step, and readers go by the manifest.
"""

from __future__ import annotations

import heapq
import json
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.skew import join_null_safe, sliced_rank

TARGET_BYTES = 128 << 20
#: Groups that are planned together; beyond that there are several blocks of groups, planned alike.
BLOCK_GROUPS = 1024
#: Size classes per doubling of the size: members of a class differ by 4.4 % at most.
CLASSES_PER_OCTAVE = 16


def deal_classes(classes: list[tuple[int, float, int]], groups: int) -> dict[int, list[tuple[int, int]]]:
    """Longest-first scheduling of ``(class, mean size, count)`` onto ``groups`` least-loaded groups.

    Returns, per class, runs ``(group, number)`` in the order of the class's ranks. Files of a class
    are dealt one at a time to the least loaded group while there are few of them, else as even
    shares that level the loads first; either way the loads end within one file of each other,
    as with one heap operation per file.
    """
    heap = [(0.0, g) for g in range(groups)]
    out: dict[int, list[tuple[int, int]]] = {}
    for cls, mean, count in sorted(classes, key=lambda c: -c[1]):
        runs: dict[int, int] = {}
        if count > 8 * groups and mean > 0:
            # water-filling: raise the lowest loads to a common level, as far as whole files go
            loads = np.array(sorted(heap))
            lo, hi = loads[0, 0], loads[-1, 0] + mean * count
            for _ in range(60):
                level = (lo + hi) / 2
                take = np.floor(np.maximum(level - loads[:, 0], 0) / mean)
                lo, hi = (level, hi) if take.sum() <= count else (lo, level)
            take = np.floor(np.maximum(lo - loads[:, 0], 0) / mean).astype(int)
            runs = {int(g): int(t) for (_, g), t in zip(loads, take) if t}
            heap = [(float(load + t * mean), int(g)) for (load, g), t in zip(loads, take)]
            heapq.heapify(heap)
            count -= int(take.sum())
        for i in range(count):
            load, g = heap[0]
            # files without bytes level the numbers instead
            heapq.heapreplace(heap, (load + (mean or 1e-6), g))
            runs[g] = runs.get(g, 0) + 1
        out[cls] = sorted(runs.items())
    return out


def plan_groups(files: DataFrame, key: str, size: str, target_bytes: int = TARGET_BYTES, block_groups: int = BLOCK_GROUPS) -> DataFrame:
    """``files`` with ``group_id``: balanced groups of about ``target_bytes``, as many as the input needs.

    A NULL size counts as 0. ``key`` identifies a file; rows with equal keys and sizes may be told
    apart in any way. The driver sees one row per size class (about 1,000 at most), never a file, and
    deals the classes to ``block_groups`` groups at most: of more groups there are several blocks.
    Each takes every so many-th file of each class, so that one plan serves all of them.
    """
    width = F.coalesce(F.col(size), F.lit(0)).cast("double")
    cls = F.floor(CLASSES_PER_OCTAVE * F.log2(width + 1)).cast("int")
    classed = files.withColumn("_cls", cls)
    sizes = classed.groupBy("_cls").agg(F.avg(width).alias("mean"), F.count(F.lit(1)).alias("n")).collect()
    total = sum(r["mean"] * r["n"] for r in sizes)
    wanted = max(1, math.ceil(total / target_bytes))
    if wanted == 1:
        return classed.drop("_cls").withColumn("group_id", F.lit(0))
    blocks = -(-wanted // block_groups)
    groups = -(-wanted // blocks)
    dealt = deal_classes([(r["_cls"], r["mean"], -(-r["n"] // blocks)) for r in sizes], groups)
    # per class, where its runs end: at most BLOCK_GROUPS numbers for each of the classes
    table = {c: (np.cumsum([n for _, n in runs]), np.array([g for g, _ in runs])) for c, runs in dealt.items()}
    shared = files.sparkSession.sparkContext.broadcast(table)
    ranked = sliced_rank(classed, ["_cls"], [key], name="_rank")
    names = [f.name for f in files.schema.fields]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = b.column("_cls").to_numpy(zero_copy_only=False)
            r = b.column("_rank").to_numpy(zero_copy_only=False)
            g = np.zeros(len(c), dtype=np.int32)
            for one in np.unique(c):
                ends, ids = shared.value[int(one)]
                at = c == one
                # classes begin at different blocks, so that rare large files spread over them
                block, rank = (r[at] + int(one)) % blocks, r[at] // blocks
                g[at] = block * groups + ids[np.minimum(np.searchsorted(ends, rank, side="right"), len(ids) - 1)]
            yield pa.RecordBatch.from_arrays([b.column(n) for n in names] + [pa.array(g)], names=[*names, "group_id"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)
    return ranked.mapInArrow(assign, f"{ddl}, group_id int")


def _write(batches: Iterator[pa.RecordBatch], staging: str) -> Iterator[pa.RecordBatch]:
    """Stream sorted batches into one file per group; one row per written file.

    The name holds the attempt, so that a repeated or speculative task never touches another's file.
    """
    fs, root = pafs.FileSystem.from_uri(staging)
    fs.create_dir(root, recursive=True)
    ctx = TaskContext.get()
    tag = f"{ctx.taskAttemptId()}-{uuid.uuid4().hex[:8]}" if ctx else uuid.uuid4().hex
    writer, sink, now, done, state = None, None, None, [], None

    def close() -> None:
        if writer is not None:
            writer.close()
            sink.close()
            done.append(state)

    for batch in batches:
        ids = batch.column("group_id").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.nonzero(np.diff(ids))[0] + 1).tolist(), len(ids)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            part = batch.slice(a, b - a)
            if ids[a] != now:
                close()
                now = int(ids[a])
                name = f"group-{now:05d}-{tag}.parquet"
                sink = fs.open_output_stream(f"{root}/{name}")
                body = part.schema.remove(part.schema.get_field_index("_hash")).remove(part.schema.get_field_index("group_id") - (part.schema.get_field_index("group_id") > part.schema.get_field_index("_hash")))
                writer = pq.ParquetWriter(sink, body, compression="zstd")
                state = [now, name, 0, 0]
            writer.write_batch(part.select(body.names))
            state[2] += part.num_rows
            state[3] ^= int(np.bitwise_xor.reduce(part.column("_hash").to_numpy(zero_copy_only=False)))
    close()
    if done:
        cols = list(zip(*done))
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], names=["group_id", "name", "n_rows", "check"])


def rows_and_check(df: DataFrame, body: list[str]) -> tuple[int, int]:
    """Number of rows, and the exclusive or of their hashes."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*body)).alias("x")).first()
    return r["n"], r["x"] or 0


def consolidate(rows: DataFrame, out: str, expected: tuple[int, int] | None = None) -> list[str]:
    """Write ``rows`` (with ``group_id``) as one Parquet file per group below ``out``; the files of the manifest.

    The files are published only if their rows and the exclusive or of the rows' hashes agree with
    what was to be written (``expected``, or counted here); else nothing is published and an error
    is raised. The driver sees one row per written file of about TARGET_BYTES, 8 for each GB.
    """
    spark: SparkSession = rows.sparkSession
    body = [c for c in rows.columns if c != "group_id"]
    hashed = rows.withColumn("_hash", F.xxhash64(*body))
    staging = f"{out}/data"
    placed = hashed.repartition("group_id").sortWithinPartitions("group_id")
    written = placed.mapInArrow(lambda it: _write(it, staging), "group_id int, name string, n_rows long, check long").collect()
    want, want_check = expected or rows_and_check(rows, body)
    got_rows, got = sum(r["n_rows"] for r in written), 0
    for r in written:
        got ^= r["check"]
    if got_rows != want or got != want_check or len({r["group_id"] for r in written}) != len(written):
        raise RuntimeError(f"{out}: {got_rows} rows written where {want} were to be, or their hashes differ; nothing is published")
    manifest = {"files": sorted(r["name"] for r in written), "rows": got_rows, "check": got}
    fs, root = pafs.FileSystem.from_uri(out)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/manifest.tmp") as f:
        f.write(json.dumps(manifest).encode())
    fs.move(f"{root}/manifest.tmp", f"{root}/manifest.json")
    return [f"{staging}/{n}" for n in manifest["files"]]


def read_consolidated(spark: SparkSession, out: str, schema: str) -> DataFrame:
    """The rows of the published manifest; empty when it names no files."""
    fs, root = pafs.FileSystem.from_uri(out)
    with fs.open_input_stream(f"{root}/manifest.json") as f:
        names = json.loads(f.read())["files"]
    if not names:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{out}/data/{n}" for n in names])


# ---------------------------------------------------------------- event reports
def reports_of(content: str | None) -> list[dict]:
    """The reports in one file's content: an object, a list of objects, or one object per line.

    A content that can't be read whole holds none, nor do NULL and blank ones. What is no object,
    or has no ``file`` or no numeric ``event_id``, is no report.
    """
    if content is None or not content.strip():
        return []
    text = content.lstrip("﻿")
    try:
        whole = json.loads(text)
        found = whole if isinstance(whole, list) else [whole]
    except ValueError:
        try:
            found = [json.loads(line) for line in text.splitlines() if line.strip()]
        except ValueError:
            return []
        found = [y for x in found for y in (x if isinstance(x, list) else [x])]
    out = []
    for r in found:
        if isinstance(r, dict) and isinstance(r.get("file"), str) and r["file"]:
            e = r.get("event_id")
            try:
                number = int(e) if not isinstance(e, bool) and not (isinstance(e, float) and e != int(e)) else None
            except (TypeError, ValueError, OverflowError):
                number = None
            if number is not None and abs(number) < 2**63:
                out.append(r | {"_event": number})
    return out


def file_name(path: str) -> str:
    """Last component of a path, without a final ``.hdf5``."""
    last = path.replace("\\", "/").rstrip("/").rpartition("/")[2]
    return last.removesuffix(".hdf5")


REPORT_DDL = "file string, event_id long, report string, shard_id long"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for shard, mtime, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            for pos, r in enumerate(reports_of(content)):
                event = r.pop("_event")
                rows.append((file_name(r["file"]), event, json.dumps(r, ensure_ascii=True), shard, mtime, pos))
        cols = list(zip(*rows)) or [[]] * 6
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["file", "event_id", "report", "shard_id", "mtime", "pos"])


def unique_reports(shards: DataFrame, order: str = "mtime") -> DataFrame:
    """``file, event_id, report, shard_id``: each (file, event) once, as reported last.

    Of several reports the one of the latest ``mtime`` is kept (NULL is the earliest; then the
    largest ``shard_id``, then the last in the file). Copies are merged on the map side first, so a
    report that was copied very often is no burden.
    """
    parsed = shards.select("shard_id", F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', CAST({order} AS TIMESTAMP_NTZ))").alias("mtime"), "content").mapInArrow(
        _parse, "file string, event_id long, report string, shard_id long, mtime long, pos int"
    )
    last = F.struct(F.coalesce("mtime", F.lit(-(2**62))).alias("m"), F.coalesce("shard_id", F.lit(-(2**62))).alias("s"), "pos", "report", "shard_id")
    kept = parsed.groupBy("file", "event_id").agg(F.max(last).alias("_l"))
    return kept.select("file", "event_id", "_l.report", "_l.shard_id")


def consolidate_reports(shards: DataFrame, out: str, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """The event reports of tiny files, each kept once, in few files of about ``target_bytes`` below ``out``.

    The tiny files are the scheduled items, as large as the reports that they still contribute.
    """
    once = unique_reports(shards)
    # one row per tiny file, kept: the contents are parsed once for the plan and once to be written
    files = once.groupBy("shard_id").agg(F.sum(F.octet_length("report")).alias("bytes"), F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*once.columns)).alias("x")).persist(StorageLevel.MEMORY_AND_DISK)
    whole = files.agg(F.sum("n").alias("n"), F.bit_xor("x").alias("x")).first()
    plan = plan_groups(files.select("shard_id", "bytes"), "shard_id", "bytes", target_bytes).drop("bytes")
    rows = join_null_safe(once, plan, ["shard_id"])
    consolidate(rows.select(*once.columns, "group_id"), out, (whole["n"] or 0, whole["x"] or 0))
    files.unpersist()
    return read_consolidated(shards.sparkSession, out, REPORT_DDL)
