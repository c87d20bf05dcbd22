"""SparkSession helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Session settings every job relies on: ANSI semantics, AQE with skew-join
# splitting, UTC, no UI.
_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    # drill-downs checkpoint small picks; remove them once unreferenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = "local[*]", shuffle_partitions: int | None = 8,
                app: str = "tranche") -> SparkSession:
    """Local session for tests and the bench.  Without a ``master`` the session is the one that
    spark-submit configures: master, memory and partitions are left to it."""
    b = SparkSession.builder.appName(app)
    for k, v in _CONF.items():
        b = b.config(k, v)
    if master is not None:
        b = b.master(master).config("spark.driver.memory", os.environ.get("TRANCHE_DRIVER_MEMORY", "8g"))
    if shuffle_partitions is not None:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting points at shared storage and is used as is; unset,
    it is an error there.  Only in local mode do we pick a scratch folder of our own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="tranche-ckpt-")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir()
