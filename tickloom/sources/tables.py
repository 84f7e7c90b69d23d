"""Reading detector tables: schemas, optional fields, file lists, events, channel maps, samples."""

from __future__ import annotations

import glob
import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.skew import broadcast_if_small

# The source tables and their columns.
SCHEMAS = {
    "charge_events": "event_id BIGINT, unix_ts DOUBLE, unix_ts_usec DOUBLE",
    "hits": "hit_row BIGINT, x DOUBLE, y DOUBLE, z DOUBLE, e DOUBLE, io_group INT",
    "final_hits": "final_row BIGINT, id BIGINT",
    "event_hits": "event_id BIGINT, hit_row BIGINT",
    "charge_light": "event_id BIGINT, light_id BIGINT",
    "light_events": "light_id BIGINT, utime_ms ARRAY<DOUBLE>",
    "wvfm": "light_id BIGINT, adc INT, ch INT, samples ARRAY<FLOAT>",
    "flash": "flash_id BIGINT, tpc INT, hit_time_range ARRAY<DOUBLE>, tot_max DOUBLE, n_sum_hits INT",
    "light_flash": "light_id BIGINT, flash_id BIGINT",
    "backtrack": "hit_row BIGINT, segment_ids ARRAY<BIGINT>, fraction ARRAY<DOUBLE>",
    "segments": "segment_id BIGINT, t DOUBLE, t0 DOUBLE, vertex_id BIGINT",
    "interactions": "vertex_id BIGINT, x_vert DOUBLE, y_vert DOUBLE, z_vert DOUBLE, t_vert DOUBLE",
}


def expand_files(patterns: list[str], warn: Callable[[str], None] = lambda _: None) -> list[str]:
    """Paths of all patterns, each once, in the order of their first match; a pattern without a match is warned of."""
    out: dict[str, None] = {}
    for p in patterns:
        hits = sorted(glob.glob(p)) or ([p] if os.path.exists(p) else [])
        if not hits:
            warn(f"no file matches {p}")
        out.update(dict.fromkeys(hits))
    return list(out)


def resolve_columns(df: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """Columns under their own names, each from the first of its alternatives that ``df`` has; an error names what is missing."""
    have = {c.lower(): c for c in df.columns}
    out = []
    for name, names in wanted.items():
        found = next((have[n.lower()] for n in [name, *names] if n.lower() in have), None)
        if found is None:
            raise ValueError(f"none of {[name, *names]} is among {df.columns}")
        out.append(F.col(found).alias(name))
    return df.select(*out)


def first_present(df: DataFrame, names: list[str]) -> Column:
    """The first value that is not NULL among those of ``names`` that the table has, in their order."""
    have = [n for n in names if n in df.columns]
    return F.coalesce(*[F.col(n) for n in have]) if have else F.lit(None).cast("double")


def write_mode(prompt: DataFrame, final: DataFrame) -> str:
    """'A' when both tables have the columns that take results, else 'B'."""
    need = {"t_0", "t_cluster_id"}
    return "A" if need <= set(prompt.columns) and need <= set(final.columns) else "B"


def list_events(events: DataFrame, charge_light: DataFrame | None = None) -> DataFrame:
    """Distinct events; with a light reference only those that have a light event, or all where none has."""
    e = events.where("event_id IS NOT NULL").select("event_id").distinct()
    if charge_light is None:
        return e
    lit = e.join(charge_light.where("light_id IS NOT NULL AND light_id <> -1"), "event_id", "left_semi")
    return lit if lit.limit(1).count() else e


def load_events(hits: DataFrame, event_hits: DataFrame, charge_light: DataFrame, finite_only: bool = False) -> DataFrame:
    """Hits of every event with its first light event: ``event_id, light_id`` and the hit's columns.

    Events without hits or without light drop out (``missing_events`` names them). Each (event, hit)
    pair comes once. ``finite_only`` drops hits whose place or energy is NULL or NaN.
    """
    light = charge_light.where("light_id IS NOT NULL AND light_id <> -1").groupBy("event_id").agg(F.min_by("light_id", "ref_id").alias("light_id"))
    # one shuffle serves the distinct rows and the join
    rows = event_hits.where("hit_row IS NOT NULL AND event_id IS NOT NULL").select("event_id", "hit_row").repartition("hit_row").distinct()
    h = hits.drop("event_id", "light_id")
    if finite_only:
        h = h.where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL AND e IS NOT NULL").where(~F.isnan("x") & ~F.isnan("y") & ~F.isnan("z") & ~F.isnan("e"))
    return rows.join(h, "hit_row").join(broadcast_if_small(light), "event_id")


def missing_events(events: DataFrame, loaded: DataFrame) -> DataFrame:
    return events.select("event_id").distinct().join(loaded.select("event_id"), "event_id", "left_anti")


def current_rows(df: DataFrame, key: str, begin: str = "ingest_ts", end: str = "removed_ts") -> DataFrame:
    """The latest version of each key, unless it was removed; of versions of one time the removed one is the latest.

    Rows are shuffled as they are, since few keys have several versions and structs are twice as wide.
    """
    cols = [c for c in df.columns if c != key]
    last = df.repartition(key).groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(begin, end)).alias("_r"))
    return last.where(F.col(f"_r.{end}").isNull()).select(key, *[F.col(f"_r.{c}").alias(c) for c in cols])


def shards_by_file(paths: DataFrame, path: str = "path") -> DataFrame:
    """``file, shards, paths``: shards named FILE__evN grouped by FILE."""
    name = F.element_at(F.split(path, "/"), -1)
    return paths.where(F.col(path).isNotNull()).groupBy(F.split(name, "__ev")[0].alias("file")).agg(F.count(F.lit(1)).alias("shards"), F.sort_array(F.collect_list(path)).alias("paths"))


def source_of_shards(reports: DataFrame) -> DataFrame:
    """``file, source``: the first path that a file's reports name, by shard."""
    return reports.where("file IS NOT NULL").groupBy("file").agg(F.min_by("path", "shard_id").alias("source"))


def find_files(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Paths of files called ``name`` anywhere below ``root``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(root).select("path")


def union_of(spark: SparkSession, folders: list[str]) -> DataFrame:
    """All Parquet folders as one table; columns that one lacks are NULL there."""
    out = None
    for f in folders:
        d = spark.read.parquet(f)
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    if out is None:
        raise ValueError("no folder given")
    return out


# ---------------------------------------------------------------- lookup tables
def lookup_rows(spark: SparkSession, keys: list[tuple[int, ...]], values: list, names: list[str], value: str) -> DataFrame:
    """A lookup table with its filled entries as rows."""
    kind = "double" if any(isinstance(v, float) for v in values) else "bigint"
    return spark.createDataFrame([(*k, v) for k, v in zip(keys, values) if v is not None], ", ".join(f"{n} int" for n in names) + f", {value} {kind}")


def lookup(df: DataFrame, table: DataFrame, keys: list[str], value: str, default) -> DataFrame:
    """``df`` with the table's value, ``default`` where it has none."""
    return df.join(table.select(*keys, value), keys, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def first_asset(candidates: list[str], required: bool = False, hint: str = "") -> str | None:
    """The first path that exists; an error with a hint when a required one is nowhere."""
    found = next((c for c in candidates if os.path.exists(c)), None)
    if found is None and required:
        raise FileNotFoundError(f"none of {candidates} exists. {hint}".strip())
    return found


def missing_assets(assets: dict[str, list[str]]) -> list[str]:
    return [n for n, c in assets.items() if first_asset(c) is None]


# ---------------------------------------------------------------- training samples
def training_samples(pairs: DataFrame, hits: DataFrame, light: DataFrame, box: dict, by: list[str], dead: DataFrame | None = None, dead_value: float = -10000.0, mask_by: tuple[str, ...] | list[str] = ("adc", "ch")) -> DataFrame:
    """``by, voxels, targets``: sparse voxel energies and peak light per channel of (event, TPC) pairs.

    ``voxels`` are sorted structs (vox, energy); ``targets`` are the channels' largest samples in
    channel order, ``dead_value`` on dead channels: those that ``dead`` names by ``mask_by``. Pairs without hits or light drop out.
    """
    from tickloom.operators.geometry import voxelize

    vox = voxelize(hits.join(pairs.select(*by).distinct(), by, "left_semi"), by, box).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("vox", "energy"))).alias("voxels"))
    l = light.join(pairs.select(*by).distinct(), by, "left_semi").select(*dict.fromkeys([*by, *mask_by]), "channel", F.array_max("samples").cast("double").alias("_p"))
    if dead is not None:
        l = l.join(dead.select(*mask_by).distinct().withColumn("_d", F.lit(True)), list(mask_by), "left").withColumn("_p", F.when(F.col("_d"), F.lit(dead_value)).otherwise(F.col("_p")))
    targets = l.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("channel", "_p"))), lambda s: s["_p"]).alias("targets"))
    return vox.join(targets, by)


def scaled_targets(samples: DataFrame, scale: float = 1e-3) -> DataFrame:
    """Only the targets are read, NaN as 0, scaled."""
    return samples.select(F.transform("targets", lambda v: F.nanvl(F.coalesce(v, F.lit(0.0)), F.lit(0.0)) * scale).alias("targets"))


# ---------------------------------------------------------------- HDF5
def register_hdf5(spark: SparkSession) -> bool:
    """A batch data source 'hdf5_table' (options path, dataset), where h5py is installed; False where it is not."""
    try:
        import h5py  # noqa: F401
    except ImportError:
        return False
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class Rows(InputPartition):
        def __init__(self, path: str, lo: int, hi: int):
            self.path, self.lo, self.hi = path, lo, hi

    class Reader(DataSourceReader):
        def __init__(self, schema, options):
            self.schema_, self.options = schema, options

        def partitions(self):
            import h5py

            out = []
            for path in expand_files(self.options["path"].split(",")):
                with h5py.File(path, "r") as f:
                    n = len(f[self.options["dataset"]])
                out += [Rows(path, lo, min(n, lo + 1_000_000)) for lo in range(0, n, 1_000_000)]
            return out

        def read(self, part):
            import h5py

            with h5py.File(part.path, "r") as f:
                rows = f[self.options["dataset"]][part.lo : part.hi]
            names = [x.name for x in self.schema_.fields]
            for i, r in enumerate(rows):
                yield tuple(part.lo + i if n == "row" else (r[n].tolist() if hasattr(r[n], "tolist") else r[n]) for n in names)

    class Hdf5(DataSource):
        @classmethod
        def name(cls):
            return "hdf5_table"

        def reader(self, schema):
            return Reader(schema, self.options)

    spark.dataSource.register(Hdf5)
    return True
