"""Versioned commits: data is written once into new folders, then one small manifest names what counts.

A table is a root with partition folders, each holding one folder per write (`versao=<id>`). The
manifests in `_manifesto` are numbered; the newest complete one lists the folder of every partition.
Readers resolve it first, so they see a write as a whole or not at all, whatever lies beside it: a
write in progress, one that failed its checks, or an older version. A manifest is created only if its
number is free, so two writers cannot both commit on top of the same state; the later one tries again.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructType

FOLDER = "_manifesto"
VERSION = "versao"
ATTEMPTS = 50


def file_system(spark: SparkSession, path: str):
    """The file system of a path and the path as it takes it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _numbers(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the manifests, newest first."""
    files, place = file_system(spark, f"{root}/{FOLDER}")
    if not files.exists(place):
        return []
    names = [s.getPath().getName() for s in files.listStatus(place)]
    return sorted((int(n) for n in names if n.isdigit()), reverse=True)


def _load(spark: SparkSession, root: str, number: int) -> dict[str, str] | None:
    """Partition to folder, or nothing while the manifest is incomplete."""
    files, place = file_system(spark, f"{root}/{FOLDER}/{number}")
    stream = files.open(place)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    body, _, digest = text.rpartition("\n")
    return json.loads(body) if digest == hashlib.md5(body.encode()).hexdigest() else None


def state(spark: SparkSession, root: str, number: int | None = None) -> tuple[int, dict[str, str]]:
    """Number and content of the newest complete manifest, or of the one asked for; (0, {}) before the first."""
    for n in _numbers(spark, root) if number is None else [number]:
        content = _load(spark, root, n)
        if content is not None:
            return n, content
    return 0, {}


def new_folder(partition: str) -> str:
    """Folder, below the root, for one more write of a partition."""
    return f"{partition}/{VERSION}={uuid.uuid4().hex}"


def commit(spark: SparkSession, root: str, written: dict[str, str]) -> int:
    """Make the folders in `written` (partition to folder) what readers see; the number of the manifest."""
    for _ in range(ATTEMPTS):
        latest = max(_numbers(spark, root), default=0)
        body = json.dumps({**state(spark, root)[1], **written}, sort_keys=True)
        files, place = file_system(spark, f"{root}/{FOLDER}/{latest + 1}")
        try:
            out = files.create(place, False)
        except Py4JJavaError as taken:
            if not files.exists(place):
                raise
            del taken
            continue
        out.write(bytearray(f"{body}\n{hashlib.md5(body.encode()).hexdigest()}".encode()))
        out.close()
        return latest + 1
    raise RuntimeError(f"{root}: other writers committed first, {ATTEMPTS} times")


def read(spark: SparkSession, root: str, schema: StructType | None = None, number: int | None = None) -> DataFrame | None:
    """The committed rows with the partition columns, or None where nothing was ever committed.

    Without a schema the folders' schemas are merged by name. A filter on a partition column prunes.
    """
    content = state(spark, root, number)[1]
    if not content:
        return None
    reader = spark.read.option("basePath", root)
    reader = reader.option("mergeSchema", True) if schema is None else reader.schema(StructType(list(schema.fields)).add(VERSION, StringType()))
    return reader.parquet(*[f"{root}/{folder}" for folder in content.values()]).drop(VERSION)


def unused(spark: SparkSession, root: str, keep: int = 1) -> list[str]:
    """Written folders that none of the last `keep` manifests names; the caller decides when they may go."""
    named: set[str] = set()
    for n in _numbers(spark, root)[:keep]:
        named |= set((_load(spark, root, n) or {}).values())
    files, place = file_system(spark, root)
    found, waiting = [], [place]
    prefix = files.makeQualified(place).toString().rstrip("/") + "/"
    while waiting:
        for status in files.listStatus(waiting.pop()):
            name = status.getPath().getName()
            if status.isDirectory() and name.startswith(f"{VERSION}="):
                found.append(status.getPath().toString().removeprefix(prefix))
            elif status.isDirectory() and not name.startswith("_"):
                waiting.append(status.getPath())
    return sorted(set(found) - named)
