"""Writing results: scattering assigned hits over all hits, per-file summaries, work lists and status rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.skew import quantile_buckets

SHORT = (-32768, 32767)


def to_short(c: Column) -> Column:
    """Clipped to 16 bits; NaN and NULL become NULL."""
    return F.when(~F.isnan(c.cast("double")), F.least(F.greatest(c.cast("double"), F.lit(float(SHORT[0]))), F.lit(float(SHORT[1])))).cast("smallint")


def overflow_counts(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """``by, n_high, n_low, largest``: values beyond 16 bits, and the largest absolute one."""
    v = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    return df.groupBy(*by).agg(F.count_if(v > SHORT[1]).alias("n_high"), F.count_if(v < SHORT[0]).alias("n_low"), F.max(F.abs(v)).alias("largest"))


def scatter(all_hits: DataFrame, shards: DataFrame, by: list[str], row: str = "hit_row") -> DataFrame:
    """``by, row, t0, cluster_id`` for every hit: -1 where nothing was assigned.

    ``shards`` has by, row, t0, cluster_id and ``ok``; rows with ok = false are left out. A time is
    written only where finite and not negative, a cluster id wherever a shard names the hit. Of
    several shards for one hit that of the largest ``shard_id`` counts.
    """
    t = F.col("t0").cast("double")
    good = F.when(~F.isnan(t) & (t >= 0) & (t != float("inf")), t)
    s = shards.where(F.coalesce("ok", F.lit(True))).groupBy(*by, row).agg(F.max_by(F.struct(good.alias("t"), to_short(F.coalesce("cluster_id", F.lit(-1))).alias("c")), "shard_id").alias("_s"))
    out = all_hits.select(*by, row).distinct().join(s, [*by, row], "left")
    return out.select(*by, row, F.coalesce("_s.t", F.lit(-1.0)).cast("float").alias("t0"), F.coalesce("_s.c", F.lit(-1).cast("smallint")).alias("cluster_id"))


def final_from_prompt(final_prompt: DataFrame, hit_t0: DataFrame, by: list[str]) -> DataFrame:
    """Merged hits with the time and cluster of their prompt hit; -1 where that is out of range."""
    h = hit_t0.select(*by, F.col("hit_row").alias("prompt_row"), "t0", "cluster_id")
    j = final_prompt.join(h, [*by, "prompt_row"], "left")
    return j.select(*by, "final_row", "prompt_row", F.coalesce("t0", F.lit(-1.0).cast("float")).alias("t0"), F.coalesce("cluster_id", F.lit(-1).cast("smallint")).alias("cluster_id"))


def file_summary(hit_t0: DataFrame, status: DataFrame, by: list[str], version: str, detector: str | None = None) -> DataFrame:
    """Per file: hits, assigned and unassigned ones, processed and failed events."""
    n = hit_t0.groupBy(*by).agg(F.count(F.lit(1)).alias("n_calib_hits"), F.count_if(F.col("t0") >= 0).alias("n_assigned"))
    e = status.groupBy(*by).agg(
        F.sort_array(F.collect_set(F.when(F.col("ok"), F.col("event_id")))).alias("processed_event_ids"), F.sort_array(F.collect_set("event_id")).alias("all_event_ids"), F.count_if(~F.col("ok")).alias("n_failed")
    )
    out = n.join(e, by, "full").withColumn("n_unassigned", F.col("n_calib_hits") - F.col("n_assigned")).withColumn("version", F.lit(version))
    return out.withColumn("detector", F.lit(detector)) if detector else out


def overwrite_columns(hits: DataFrame, result: DataFrame, by: list[str], columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """``hits`` with ``columns`` taken from ``result`` (kept where it has no row), and how many values were not 0 before."""
    before = hits.agg(*[F.count_if(F.col(c) != 0).alias(f"{c}_nonzero") for c in columns])
    r = result.select(*by, *[F.col(c).alias(f"_{c}") for c in columns])
    out = hits.join(r, by, "left").select(*[F.coalesce(f"_{c}", c).cast(hits.schema[c].dataType).alias(c) if c in columns else F.col(c) for c in hits.columns])
    return out, before


def work_list(items: DataFrame, file: str, event: str, stride: int, offset: int, slices: int = 64) -> DataFrame:
    """Every ``stride``-th item from ``offset`` on, in the order of file and event; repeated items count once.

    Positions come from counts per file and per slice between quantiles of the event numbers, so no file, however
    large, is ordered in one task.
    """
    d = items.select(file, event).where(F.col(file).isNotNull() & F.col(event).isNotNull()).distinct()
    cut = quantile_buckets(d, [], event, slices, "_p")
    sizes = cut.groupBy(file, "_p").agg(F.count(F.lit(1)).alias("_n"))
    files = sizes.groupBy(file).agg(F.sum("_n").alias("_n"))
    over_files = Window.orderBy(file).rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    files = files.select(file, F.coalesce(F.sum("_n").over(over_files), F.lit(0)).alias("_f"))
    within = Window.partitionBy(file).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.withColumn("_b", F.coalesce(F.sum("_n").over(within), F.lit(0))).drop("_n").join(files, file)
    rank = F.row_number().over(Window.partitionBy(file, "_p").orderBy(event)) - 1
    return cut.withColumn("_r", rank).join(before, [file, "_p"]).where((F.col("_r") + F.col("_b") + F.col("_f")) % stride == offset).select(file, event)


def not_done(items: DataFrame, status: DataFrame, by: list[str]) -> DataFrame:
    """Items without a successful status row."""
    return items.join(status.where("ok").select(*by), by, "left_anti")


def status_rows(expected: DataFrame, done: DataFrame, by: list[str]) -> DataFrame:
    """A status for each expected event: ok, its number of hits, or an error where nothing came out."""
    d = done.groupBy(*by).agg(F.count(F.lit(1)).alias("n_hits"), F.max("error").alias("error"))
    j = expected.select(*by).distinct().join(d, by, "left")
    err = F.when(F.col("n_hits").isNull(), F.lit("no hits or no light")).otherwise(F.col("error"))
    return j.select(*by, err.isNull().alias("ok"), err.alias("error"), F.coalesce("n_hits", F.lit(0)).alias("n_hits"))


def move_relabel(labels: DataFrame, moves: DataFrame, by: list[str]) -> DataFrame:
    """Cluster ids after moves: each move (``seq``, ``hits`` array) gives its hits a new id from the largest on; later moves win."""
    top = labels.groupBy(*by).agg(F.max("cluster_id").alias("_top"))
    w = Window.partitionBy(*by).orderBy("kind", "seq")
    numbered = moves.withColumn("_n", F.row_number().over(w)).join(top, by)
    hit = numbered.select(*by, F.explode("hits").alias("hit_row"), (F.col("_top") + F.col("_n")).alias("_new"), "_n").groupBy(*by, "hit_row").agg(F.max_by("_new", "_n").alias("_new"))
    return labels.join(hit, [*by, "hit_row"], "left").withColumn("cluster_id", F.coalesce("_new", "cluster_id").cast("int")).drop("_new")


def move_summary(moves: DataFrame, by: list[str]) -> DataFrame:
    """Counts of tried, accepted and vetoed moves."""
    return moves.groupBy(*by).agg(F.count(F.lit(1)).alias("n_trials"), F.count_if("accepted").alias("n_accepted"), F.count_if("vetoed").alias("n_vetoed"), F.sum(F.when(F.col("accepted"), F.col("energy")).otherwise(0.0)).alias("energy_moved"))


def write_by_file(df: DataFrame, path: str, file: str = "file_id", mode: str = "overwrite") -> None:
    """Parquet, partitioned by file; rows of a file are brought together first, so that each makes few files."""
    df.repartition(file).write.mode(mode).partitionBy(file).parquet(path)


def export_where(parts: dict[str, DataFrame], condition: Column, path: str) -> list[str]:
    """Each table restricted to ``condition`` under its own name below ``path``; the folders written."""
    out = []
    for name, df in parts.items():
        df.where(condition).write.mode("overwrite").parquet(f"{path}/{name}")
        out.append(f"{path}/{name}")
    return out
