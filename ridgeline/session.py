"""Session helpers: one place for the Spark settings the library relies on.

The library never assumes it owns the session.  It reads
``spark.checkpoint.dir`` from whatever session it is given and only sets a
directory of its own when none is configured (local tests and the bench).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.driver.memory": "8g",
    "spark.sql.ansi.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app: str = "ridgeline",
                  extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the library defaults."""
    master = master or f"local[{os.environ.get('BENCH_CPUS', '*')}]"
    builder = SparkSession.builder.master(master).appName(app)
    for k, v in {**DEFAULT_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediate tables.

    Order: the context's checkpoint dir, then ``spark.checkpoint.dir`` from
    the conf; when neither is set, a fresh temp folder on a local master and
    an error on a cluster, where a machine's own folder is not shared.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    d = sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        try:
            d = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset key
            d = None
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="ridgeline-ckpt-", dir="/tmp")  # one machine: its own folder is shared
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for written tables."""
    base = checkpoint_dir(spark)
    return f"{base.rstrip('/')}/ridgeline-tables/{uuid.uuid4().hex}/{name}"


def snapshot(df):
    """``df`` written once as parquet in the shared folder and read back: columns prune, filters push down."""
    path = scratch_path(df.sparkSession, "snapshot")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df, eager: bool = True):
    """Reliable checkpoint (survives executor loss); never a local one."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)
