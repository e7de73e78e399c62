"""Validated writes: a year is written once and becomes visible only after every check has passed."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from escrutinio.sources import versions
from escrutinio.sources.contracts import Contract, validate


class ControlMismatch(RuntimeError):
    """A control total of the staged data differs from its source."""


def write_table(df: DataFrame, contract: Contract, path: str, partitions: Sequence[str] = ()) -> None:
    """SNK-02. Parquet in contract column order, sorted by key inside each file.

    `rebalance` lets AQE choose the number and size of the files and split a dominant partition,
    so no task writes a whole year alone.
    """
    columns = [*contract.columns, *[p for p in partitions if p not in contract.columns]]
    ordered = df.select(*columns)
    ordered = ordered.hint("rebalance", *partitions) if partitions else ordered.hint("rebalance")
    if contract.key:
        ordered = ordered.sortWithinPartitions(*partitions, *contract.key)
    writer = ordered.write.mode("overwrite")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def publish_year(
    df: DataFrame,
    contract: Contract,
    root: str,
    year: int,
    controls: Sequence[Callable[[DataFrame], DataFrame]] = (),
) -> int:
    """SNK-01. Write the year once, check what was written, then commit it with one manifest.

    Each control takes the written table and gives rows with `controle` and `igual`; any false one
    stops the publication and leaves the previous year as it was. Readers go by the manifest, so
    they see the old year or the new one. Returns the number of the manifest.
    """
    spark = df.sparkSession
    folder = versions.new_folder(f"ano={year}")
    write_table(df, contract, f"{root}/{folder}")
    staged = spark.read.schema(contract.schema).parquet(f"{root}/{folder}")
    validate(staged, contract)
    for control in controls:
        # One row comes back, however many controls differ.
        bad = control(staged).filter(~F.col("igual")).agg(F.count(F.lit(1)).alias("n"), F.min("controle").alias("first")).first()
        if bad["n"]:
            raise ControlMismatch(f"{contract.name} {year}: {bad["n"]} control totals differ, as {bad["first"]}")
    return versions.commit(spark, root, {f"ano={year}": folder})


def write_report(df: DataFrame, path: str) -> None:
    """SNK-03. Report as CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def merge_last(
    old: DataFrame, new: DataFrame, key: Sequence[str], order: Column | None = None
) -> DataFrame:
    """SNK-04. Old and new rows, one per key; the new batch wins, then the larger `order`.

    One mergeable aggregate per key: appended snapshots stay, a replayed batch changes nothing.
    """
    rows = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)))
    others = [c for c in old.columns if c not in key]
    rank = F.struct(F.col("_batch"), F.lit(0) if order is None else order)
    return (
        rows.groupBy(*key)
        .agg(F.max_by(F.struct(*others), rank).alias("r"))
        .select(*key, "r.*")
        .select(*old.columns)
    )


def read_or_empty(spark: SparkSession, path: str, contract: Contract) -> DataFrame:
    """The stored table, or an empty one of the contract before the first write."""
    try:
        return spark.read.schema(contract.schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], contract.schema)
