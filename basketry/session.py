"""SparkSession construction and the checkpoint-directory policy."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on: UTC so timestamp_ntz arithmetic and
# date truncation agree with the SQL oracle, AQE for runtime re-planning
# (partition coalescing, skew-join splitting, size-checked broadcast).
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # remove reliable checkpoint files once their DataFrame is garbage collected
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str | None = None, app: str = "basketry",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULT_CONF.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def ensure_checkpoint_dir(spark: SparkSession) -> str | None:
    """Return the reliable checkpoint directory, setting one only in local mode.

    On a cluster the directory must be the shared folder named by
    ``spark.checkpoint.dir``; a machine-local temp folder is never used there.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if is_local(spark):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="basketry-ckpt-"))
        return sc.getCheckpointDir()
    return None


def materialize(df):
    """Cut lineage of an intermediate that is read several times.

    Uses a reliable checkpoint (survives executor loss) in the shared
    checkpoint directory.  On a cluster without one this fails: counts taken
    from the frame and the rows read later have to agree.
    """
    if not ensure_checkpoint_dir(df.sparkSession):
        raise RuntimeError("spark.checkpoint.dir must name a folder all executors share")
    return df.checkpoint(eager=True)
