"""Session settings, shared checkpoint folder and size-checked broadcast."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # checkpoints that nothing refers to any more are removed
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app: str = "marginalia", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; every value can be overridden."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SQL_SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Checkpoint folder of the cluster; a scratch folder only where none is configured.

    On a cluster ``spark.checkpoint.dir`` names a folder all executors share, so a
    lost executor never takes a cut lineage with it. Local runs (tests) have no such
    setting and get a fresh folder on the driver host.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc.getCheckpointDir()
    if current:
        return current
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="marginalia-ckpt-")
    sc.setCheckpointDir(configured)
    return configured


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast hint only when a counted bound holds; otherwise leave the choice to AQE.

    The probe reads at most ``max_rows + 1`` rows of one column-free projection.
    """
    small = df.select(F.lit(1).alias("one")).limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if small else df


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds costly columns so that each is evaluated once per row.

    The optimizer copies an expression into every filter on its column that it pushes
    down. A one-item explode keeps filters above it and costs no shuffle.
    """
    for name, column in columns.items():
        df = df.select("*", F.explode(F.array(column)).alias(name))
    return df


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly over tasks, for costly per-row work.

    Splits say nothing of where the rows are: a file of one row group has all its rows in one of
    them. So rows are always dealt, in more parts than cores where the input is not small.
    """
    cores, splits = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    return df.repartition(cores if splits < cores else max(splits, 4 * cores))
