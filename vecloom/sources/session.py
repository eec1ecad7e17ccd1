"""Session set-up and the few helpers that every job needs."""

from __future__ import annotations

import atexit
import io
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "vecloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the jobs expect; on a cluster the submitter's settings win."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.showConsoleProgress": "false",
    }
    return b.config(map=defaults | conf).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and whatever all machines must see."""
    ensure_checkpoint_dir(spark)
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    return (named or sc._jsc.sc().getCheckpointDir().get()).rstrip("/")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, for clusters on which it isn't installed.

    The archive is written to the shared folder; executors that start later get it too.
    """
    sc = spark.sparkContext
    if getattr(sc, "_vecloom_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    uri = f"{shared_folder(spark)}/vecloom-{uuid.uuid4().hex}.zip"
    path = sc._jvm.org.apache.hadoop.fs.Path(uri)
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(data.getvalue()))
    out.close()
    sc.addPyFile(uri)
    sc._vecloom_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, as stored."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Leave the cluster's shared checkpoint folder alone; set one of this machine only in local mode (tests, laptops).

    A cluster that names no folder is refused: one of the driver's own would be out of the executors' sight.
    """
    sc = spark.sparkContext
    if sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None):
        return
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        folder = tempfile.mkdtemp(prefix="vecloom-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)


#: Bytes of stored input for one task of a shuffle whose work is heavier than its data, and the most tasks.
TASK_BYTES, MOST_TASKS = 64 << 20, 100_000


def partitions_for(*frames: DataFrame) -> int:
    """Tasks for work on these frames: by the stored size of what they read, two per core at least.

    The sizes are those that the optimizer knows of the tables; nothing is run.
    """
    size = 0
    for df in frames:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        for i in range(leaves.size()):
            known = int(str(leaves.apply(i).stats().sizeInBytes()))
            size += known if known < 1 << 60 else 0  # a source without statistics
    cores = max(1, frames[0].sparkSession.sparkContext.defaultParallelism)
    return int(min(MOST_TASKS, max(2 * cores, -(-size // TASK_BYTES))))


def scan_partitions(df: DataFrame) -> int:
    """Partitions of a plan without exchanges (a scan and what is pipelined on it)."""
    return df._jdf.queryExecution().toRdd().getNumPartitions()


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """Round-robin the rows of a scan when it has too few splits to use every core.

    A table of a few large files whose row groups can't be split would keep heavy per-row work on a
    few tasks. All rows are kept; a scan that has enough splits is returned as it is, without a shuffle.
    """
    spark = df.sparkSession
    want = per_core * max(1, spark.sparkContext.defaultParallelism)
    if scan_partitions(df) >= want:
        return df
    return df.repartition(want)
