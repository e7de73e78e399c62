"""Shared helpers: reading tables, the shared folder, folds, and Arrow batch plumbing."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows a Python worker turns into objects at a time: whole texts, so a batch of long ones stays small.
SLICE_ROWS = 512
# Rows of two numbers a shuffle partition takes where their number is known, and the fewest partitions.
PARTITION_ROWS, MIN_PARTITIONS = 20_000, 8


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`; where it is unset, one inside the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return folder.rstrip("/")


def staged(df: DataFrame, label: str) -> DataFrame:
    """`df` written as Parquet into the shared folder and read back.

    Cuts lineage where a table feeds several later steps: a lost executor repeats a read of files
    that every executor reaches, not the history of the table.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


@contextmanager
def shuffles_for(spark: SparkSession, rows: int) -> Iterator[None]:
    """Shuffles of tables of about so many short rows get that many partitions, at most the session's.

    For loops of many small jobs, whose time is otherwise that of empty tasks.
    """
    name = "spark.sql.shuffle.partitions"
    usual = spark.conf.get(name)
    spark.conf.set(name, min(int(usual), max(MIN_PARTITIONS, -(-rows // PARTITION_ROWS))))
    try:
        yield
    finally:
        spark.conf.set(name, usual)


def emptied(df: DataFrame) -> None:
    """Free the files of a staged table that nothing reads any more: an empty table takes its place."""
    df.sparkSession.createDataFrame([], df.schema).write.mode("overwrite").parquet(df.staged_path)


def fold(doc_id: Column | str) -> Column:
    """crc32 of the id as text, modulo 5; remainder 0 is held out. A null id counts as empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return (F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % 5).cast("int")


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of at most `rows`."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    column = batch.column(batch.schema.get_field_index(name))
    return column.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()


def values(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def over_slices(df: DataFrame, make: Callable[[pa.RecordBatch], dict], schema: str, rows: int = SLICE_ROWS) -> DataFrame:
    """Rows of `make(slice)`, a dict of columns in the order of `schema`, for every slice of `df`."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, rows):
            out = make(part)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def free_name(df: DataFrame, wanted: str) -> str:
    """`wanted`, with underscores in front until no column of `df` has the name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def append_columns(df: DataFrame, make: Callable[[pa.RecordBatch], dict], added: str, rows: int = SLICE_ROWS) -> DataFrame:
    """`df` with the columns `added` (DDL), which `make(slice)` gives by name; no column is reordered."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    new = _parse_datatype_string(added)
    arrow = to_arrow_schema(new)
    old = df.columns
    names = [*old, *(f.name for f in new)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, rows):
            out = make(pa.RecordBatch.from_arrays(part.columns, names=old))
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(out[f.name], type=f.type) for f in arrow)], names=names)

    # Columns go by number into the map, which takes no dots in names.
    plain = df.toDF(*[f"_{i}" for i in range(len(old))])
    return plain.mapInArrow(run, StructType([*df.schema.fields, *new.fields]))
