"""Session helpers: local sessions for tests and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", name: str = "vitaeflow", memory: str = "8g") -> SparkSession:
    """A local session with the settings the tests and the benchmark share."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in ``spark.checkpoint.dir``; only a local
    session without that setting gets a folder of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix="vitaeflow-ckpt-", dir=os.environ.get("TMPDIR"))
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that it survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def parallelism(spark: SparkSession) -> int:
    """Partitions a shuffle of this session uses."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def ship_package(spark: SparkSession) -> None:
    """Send this package to executors on which it is not installed."""
    root = os.path.dirname(os.path.abspath(__file__))
    base = os.path.join(tempfile.mkdtemp(prefix="vitaeflow-zip-"), "vitaeflow")
    archive = shutil.make_archive(base, "zip", os.path.dirname(root), os.path.basename(root))
    atexit.register(shutil.rmtree, os.path.dirname(archive), ignore_errors=True)
    spark.sparkContext.addPyFile(archive)
