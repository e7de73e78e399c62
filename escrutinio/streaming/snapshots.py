"""Snapshot ingestion: a log of micro-batches, read as the last version of each key.

A stream writes each micro-batch to a partition of its own, `execucao=<run>/lote=<batch>`, and commits
it with one manifest, so readers never see half a batch. The run is the id of the query, which lives
in its checkpoint: a replay after a failure takes the place of the same batch, and another stream, or
one with a new checkpoint, adds its own beside it. Late readings enter the log like any other. Readers
take the last reading per key over the committed batches; `compact` folds a log into a new one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StringType, StructType

from escrutinio.operators.social import latest_snapshot
from escrutinio.sources import versions

PROFILE_KEY = ("sq_candidato", "ano_eleicao", "rede", "username", "coletado_em")
POST_KEY = ("username", "media_id")
RETRY_UNAVAILABLE_DAYS = 7  # fixed value
RUN_PROPERTY = "sql.streaming.queryId"


def open_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1000) -> DataFrame:
    """STR-01. File source with a fixed schema and a bound on the files of one micro-batch."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(path)
    )


def batch_writer(root: str, key: Sequence[str] | None = None, run: str | None = None) -> Callable[[DataFrame, int], None]:
    """STR-01. Writer of one micro-batch to its own partition of the log, committed as a whole.

    Rows that repeat a key inside the batch are written once; repeats over batches are resolved by
    the reader, so no state grows and nothing that comes late is lost. `run` is for callers outside a
    stream, whose runs have no id.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        own = run or batch.sparkSession.sparkContext.getLocalProperty(RUN_PROPERTY)
        if not own:
            raise ValueError("batch_writer: outside a stream the run needs a name")
        rows = batch if key is None else batch.dropDuplicates(list(key))
        partition = f"execucao={own}/lote={batch_id}"
        folder = versions.new_folder(partition)
        rows.write.parquet(f"{root}/{folder}")
        versions.commit(batch.sparkSession, root, {partition: folder})

    return write


def ingest(stream: DataFrame, root: str, checkpoint: str, name: str | None = None, key: Sequence[str] | None = None) -> StreamingQuery:
    """STR-01, STR-05. Take whatever is new in the source, then stop.

    An unchanged source gives no micro-batch, and a failed run leaves what was committed alone.
    """
    writer = stream.writeStream.foreachBatch(batch_writer(root, key)).option("checkpointLocation", checkpoint)
    if name is not None:
        writer = writer.queryName(name)
    return writer.trigger(availableNow=True).start()


def current(spark: SparkSession, root: str, schema: StructType, key: Sequence[str], order: Column) -> DataFrame:
    """Last version per key: the newest `order`, then the newest batch. A mergeable aggregate.

    A log without a committed batch is empty.
    """
    log_schema = StructType(list(schema.fields)).add("execucao", StringType()).add("lote", LongType())
    log = versions.read(spark, root, log_schema)
    if log is None:
        return spark.createDataFrame([], schema)
    others = [c for c in schema.fieldNames() if c not in key]
    rank = F.struct(order, F.col("lote"), F.col("execucao"))
    return (
        log.groupBy(*key)
        .agg(F.max_by(F.struct(*others), rank).alias("r"))
        .select(*key, "r.*")
        .select(*schema.fieldNames())
    )


def current_profiles(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """Every reading once (snapshots are never replaced)."""
    return current(spark, root, schema, PROFILE_KEY, F.lit(0))


def current_posts(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """Last reading of each post."""
    return current(spark, root, schema, POST_KEY, F.col("coletado_em"))


def compact(table: DataFrame, target: str) -> None:
    """Fold the current table into a new log with one base batch; an existing log is never replaced."""
    if versions.state(table.sparkSession, target)[0]:
        raise ValueError(f"compact: {target} is a log already")
    partition = "execucao=base/lote=-1"
    folder = versions.new_folder(partition)
    table.hint("rebalance").write.parquet(f"{target}/{folder}")
    versions.commit(table.sparkSession, target, {partition: folder})


def newer_than_known(items: DataFrame, known: DataFrame, since: Column) -> DataFrame:
    """STR-02. Items from `since` on that are newer than the last known one of their account."""
    last = known.groupBy("username").agg(F.max("timestamp").alias("_known"))
    fresh = F.col("_known").isNull() | (F.col("timestamp") > F.col("_known"))
    return (
        items.filter(F.col("timestamp") >= since)
        .join(last, "username", "left")
        .filter(fresh)
        .drop("_known")
    )


def recently_unavailable(profiles: DataFrame, now: Column, days: int = RETRY_UNAVAILABLE_DAYS) -> DataFrame:
    """STR-03. Accounts whose last reading failed less than `days` ago; the next round skips them."""
    age = F.timestamp_diff("SECOND", F.col("coletado_em"), now)
    return (
        latest_snapshot(profiles)
        .filter((F.col("status") != "ok") & (age < days * 86_400))
        .select("username")
    )
