"""Session construction.

Pins the settings every operator relies on: UTC session zone (timestamps
are compared with DuckDB, which is zone-naive), ANSI mode on, AQE with
partition coalescing and skew-join splitting, and no web UI.
"""

from __future__ import annotations

import os
import tempfile
import threading

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


#: Folders of intermediate tables written by this process and the thread that asked for them, for ``clear_scratch``.
_SCRATCH: list[tuple[int, str]] = []


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "quillspark", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the library defaults.

    ``master`` is only set when given: on a cluster the launcher decides.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULTS)
    if master and master.startswith("local"):
        # local mode: the driver JVM is the only executor
        conf["spark.driver.memory"] = os.environ.get("QUILLSPARK_DRIVER_MEMORY", "16g")
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, configuring it only if unset.

    On a cluster ``spark.checkpoint.dir`` names a shared, fault-tolerant
    folder and is used as is; a cluster session without it is an error, as
    a machine-local folder would not be seen by other machines. Only a local
    session (one machine, as in tests) gets a scratch folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - a remote (Connect) session has no context
        if not configured:
            raise RuntimeError("set spark.checkpoint.dir to a shared folder") from None
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    if not configured and not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    if not configured:
        configured = tempfile.mkdtemp(prefix="quillspark-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for written intermediate tables."""
    base = checkpoint_dir(spark)
    path = os.path.join(base, "tables", name)
    _SCRATCH.append((threading.get_ident(), path))
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system, if it is there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether the shared file system has ``path``."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def clear_scratch(spark: SparkSession) -> int:
    """Remove the intermediate tables that this session's operators have written. Results are lazy and read them, so
    call it when the results wanted have been written. Returns the number of folders."""
    n = 0
    while _SCRATCH:
        remove_path(spark, _SCRATCH.pop()[1])
        n += 1
    return n


def clear_scratch_but_last(spark: SparkSession, since: int) -> int:
    """Remove this thread's intermediate tables from the ``since``-th of the process on, but for the newest: for flows that
    have written a step's result and need nothing else of what led to it. ``scratch_count`` gives the place to start."""
    own = [x for x in _SCRATCH[since:] if x[0] == threading.get_ident()][:-1]
    for x in own:
        _SCRATCH.remove(x)
        remove_path(spark, x[1])
    return len(own)


def scratch_count() -> int:
    return len(_SCRATCH)


def materialize(df, name: str):
    """Write ``df`` once as Parquet under the shared checkpoint folder and
    read it back: cuts the lineage (an executor loss re-reads the files
    instead of recomputing upstream stages) and, unlike a reliable RDD
    checkpoint, computes the plan a single time."""
    import uuid
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def spread(df, factor: int = 2):
    """Round-robin ``df`` over ``factor`` x the cluster's parallelism, but
    only when it has fewer partitions than that (small files or a single
    row group read as one task). For plain scans of text tables only; on
    large inputs, which arrive in many splits, it changes nothing."""
    try:
        target = df.sparkSession.sparkContext.defaultParallelism * factor
        current = df.rdd.getNumPartitions()   # of a plain scan: its splits, no job
    except Exception:  # noqa: BLE001 - no RDD view (remote session): leave as is
        return df
    return df.repartition(target) if current < target else df
