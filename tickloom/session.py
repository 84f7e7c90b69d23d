"""Session helpers: building a local session, reading tables, and the shared folder of the cluster."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", name: str = "tickloom") -> SparkSession:
    """A local session for tests and benches; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TICKLOOM_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, what: str) -> str:
    """A fresh folder (as a URI) below the folder that all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset and the session runs
    on one machine, as in tests, a temporary folder is made, and set for ``checkpoint()`` too; on a
    cluster that is an error, since its executors would write where no other can read.
    """
    ensure_checkpoint_dir(spark)
    base = spark.sparkContext.getCheckpointDir()
    if "://" not in base and not base.startswith("file:"):
        base = "file://" + os.path.abspath(base)
    if base.startswith("file:/") and not base.startswith("file://"):
        base = "file://" + base[len("file:"):]
    return f"{base.rstrip('/')}/{what}_{uuid.uuid4().hex[:12]}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Set the folder of checkpoints from ``spark.checkpoint.dir``; see ``shared_dir``."""
    if not spark.sparkContext.getCheckpointDir():
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            master = spark.sparkContext.master
            if not (master == "local" or master.startswith("local[")):
                raise RuntimeError(f"spark.checkpoint.dir is unset and {master} is no single machine: name a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="tickloom_")
        spark.sparkContext.setCheckpointDir(base)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package wherever they run: sent to them once per application."""
    app = spark.sparkContext.applicationId
    root = os.path.dirname(os.path.abspath(__file__))
    if app in _shipped or not os.path.isdir(root):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="tickloom_"), "tickloom.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
