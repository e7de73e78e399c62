"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Planner settings every job here relies on. AQE sizes shuffles at run time, to few bytes a task:
# sorts and hash tables of a join and an aggregate of nearly distinct keys hold many times the bytes
# they read. Shuffles start in 200 pieces, the most that a task writes without sorting them in memory,
# and small ones are put together. AQE also splits skewed join partitions and switches to a broadcast join only when the
# measured size of a side is below the threshold.
PLANNER_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "200",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # File sizes are compressed: scale them before comparing with the broadcast threshold, so that
    # the planner broadcasts only what is small in memory. AQE checks measured sizes later.
    "spark.sql.sources.fileCompressionFactor": "4.0",
}


def build_session(app: str = "escrutinio", master: str | None = None, **extra: str) -> SparkSession:
    """Session with the planner defaults; `extra` keys use `__` for the dots of a setting name."""
    builder = SparkSession.builder.appName(app)
    # Call sites of column expressions are a debugging aid that slows the building of plans.
    builder = builder.config("spark.python.sql.dataFrameDebugging.enabled", "false")
    if master is not None:
        builder = builder.master(master)
    for key, value in PLANNER_DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


_MARK = "spark.escrutinio.defaults"


def apply_defaults(spark: SparkSession) -> SparkSession:
    """Set the planner defaults, once, on a session somebody else created."""
    if spark.conf.get(_MARK, None) is None:
        for key, value in PLANNER_DEFAULTS.items():
            spark.conf.set(key, value)
        spark.conf.set(_MARK, "set")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder reachable by every executor: `spark.checkpoint.dir`, or one in the warehouse if unset."""
    return spark.conf.get("spark.checkpoint.dir", None) or (
        spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    )


def cut_lineage(df: DataFrame) -> DataFrame:
    """`df` written once as a reliable checkpoint and read back by everything built on it.

    For tables that one plan uses many times: the plan stays small, and a lost executor repeats a
    read, not the whole history. Local sessions and clusters behave alike.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
