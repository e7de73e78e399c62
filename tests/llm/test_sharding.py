import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from llm.sharding import Node, place, shard_documents, tree, with_slots


def test_slots_and_sizes(documents):
    rows = shard_documents(documents).collect()
    assert len(rows) == documents.count()
    texts = {(r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in documents.collect()}
    assert {(r.doc_id, r["size"], r.text_crc32) for r in rows} == texts
    for shard in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))


def test_empty_table(nothing):
    assert shard_documents(nothing).count() == 0


@pytest.mark.parametrize("shards", [24, 25, 30])
def test_one_more_shard_takes_rows_only_into_itself(spark, shards):
    rows = spark.range(4000).select(place(F.col("id"), tree(shards)).alias("a"), place(F.col("id"), tree(shards + 1)).alias("b")).collect()
    moved = [r.b for r in rows if r.a != r.b]
    assert moved and set(moved) == {shards}
    counts = Counter(r.a for r in rows)
    assert set(counts) == set(range(shards)) and max(counts.values()) < 2 * min(counts.values())


def test_movement_stays_in_subtrees_whose_weights_change(spark):
    old, new = tree(24), tree(24, weights={0: 3.0})
    rows = spark.range(4000).select(place(F.col("id"), old).alias("a"), place(F.col("id"), new).alias("b")).collect()
    region = lambda s: s // 8
    assert all(region(r.b) == 0 for r in rows if region(r.a) != region(r.b))
    assert all(r.b == 0 for r in rows if region(r.a) == region(r.b) and r.a // 4 == r.b // 4 and r.a != r.b)
    share = Counter(r.b for r in rows)
    assert share[0] > 2 * share[9]


def test_weightless_nodes_are_an_error():
    with pytest.raises(ValueError):
        place(F.lit(1), Node("root", (Node("a", shard=0, own_weight=0.0),)))
    with pytest.raises(ValueError):
        tree(0)


def test_slots_of_one_hot_shard(spark):
    rows = with_slots(spark.range(500).withColumn("shard", F.lit(3)), "shard", F.col("id"), []).collect()
    assert sorted(r.slot for r in rows) == list(range(500))
