"""Session construction and shared-folder helpers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Session settings the engine relies on.  AQE re-plans joins at run time (a side
# whose measured shuffle output is small becomes a broadcast; skewed partitions are
# split), so no operator hard-codes a broadcast of data that grows with the input.
ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Window and UDF stages carry little data but much compute: let AQE coalesce
    # small shuffle partitions only down to the default parallelism, not to one task.
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "true",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16k",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Batches of long texts and vectors stay small in the Python workers.
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(master: str | None = None, app: str = "skewline", shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(ENGINE_CONF)
    conf["spark.ui.enabled"] = "false"
    conf["spark.ui.showConsoleProgress"] = "false"
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    apply_engine_conf(spark)
    ensure_checkpoint_dir(spark)
    return spark


def apply_engine_conf(spark: SparkSession) -> None:
    """Runtime SQL settings (safe on an existing session: only SQL confs), and the package for the workers."""
    for k, v in ENGINE_CONF.items():
        try:
            spark.conf.set(k, v)
        except Exception:  # pragma: no cover - static conf on a shared session
            pass
    ship_package(spark)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers through Spark, once per application: they can
    import it wherever they run, whatever their PYTHONPATH."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="skewline-package-"), "skewline_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    Only a local session may go without one (tests): it gets a private folder.  On a cluster
    a machine-local folder would lose data, so a missing setting is an error there."""
    sc = spark.sparkContext
    d = (spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
         or sc.getCheckpointDir())
    if not d:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="skewline-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


_WRITTEN: dict[str, list[str]] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark)
    path = os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(spark: SparkSession) -> int:
    """Delete the folders that this application has written to the shared folder, and say how many
    there were.  Frames that read them are of no use afterwards: call it between jobs."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for name in paths:
        p = jvm.org.apache.hadoop.fs.Path(name)
        p.getFileSystem(conf).delete(p, True)
    return len(paths)


@contextmanager
def whole_groups(spark: SparkSession):
    """Plans made inside rank rows after the shuffle only.  For keys that seldom repeat within a task:
    cutting their groups before the shuffle would sort every row once more and drop none."""
    limit = "spark.sql.optimizer.windowGroupLimitThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        yield
    finally:
        spark.conf.set(limit, before)


def materialize(df, name: str = "stage"):
    """Write ``df`` as a parquet table in the shared folder and return a scan of it.

    Used where several branches of one plan read the same intermediate result: the
    result is computed once, survives executor loss (reliable storage, not a local
    checkpoint) and downstream scans get column pruning and filter pushdown."""
    spark = df.sparkSession
    path = shared_path(spark, f"mat-{name}")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
