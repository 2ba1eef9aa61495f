"""Session settings the jobs are designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings that hold at any size. Shuffle width is left to the cluster: adaptive
# execution coalesces small partitions and splits skewed ones at run time.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Joins on cells compute far more than they read: let small shuffles keep their width.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings to a running session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "8", name: str = "trailspan", memory: str = "8g", **extra) -> SparkSession:
    """Session on one machine, for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", cores if cores != "*" else "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str | None:
    """Folder for reliable checkpoints, as the cluster names it."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        context.setCheckpointDir(named)
        return named
    if context.master.startswith("local"):
        import tempfile

        folder = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(folder)
        return folder
    raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
