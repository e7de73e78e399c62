import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from llm.components import components
from llm.near_copies import keep_one, near_components, op10_chosen_path
from tests.llm.conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets_of(texts, words):
    out = {}
    for i, t in texts.items():
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        out[i] = frozenset(tuple(w[k : k + words]) for k in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])
    return out


def smallest(nodes, links):
    parent = {i: i for i in nodes}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in nodes}


def brute(texts, words, threshold):
    sets, index, links = sets_of(texts, words), defaultdict(list), []
    for i in sorted(sets):
        seen = Counter(j for s in sets[i] for j in index[s])
        links += [(i, j) for j, n in seen.items() if 100 * n >= threshold * (len(sets[i]) + len(sets[j]) - n)]
        for s in sets[i]:
            index[s].append(i)
    return sets, smallest(sets, links)


def same(rows, texts, words, threshold):
    sets, want = brute(texts, words, threshold)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == {i: (len(sets[i]), want[i], want[i] == i) for i in texts}


def edited(text, share, seed):
    r = random.Random(seed)
    return " ".join(f"new{r.randrange(10**6)}" if r.random() < share else w for w in text.split())


@pytest.fixture(scope="module")
def family():
    """Groups of near copies at many distances, and one dense group larger than a node."""
    out, n = {}, 0
    for g in range(25):
        base = prose(80 + g, 100 + g)
        for k in range(6):
            out[n] = edited(base, 0.02 * k, n)
            n += 1
    dense = prose(200, 77)
    for k in range(70):
        out[n] = edited(dense, 0.02, n)
        n += 1
    return out


@pytest.mark.parametrize("words,threshold,node", [(3, 85, 512), (3, 85, 16), (5, 80, 512)])
def test_against_brute_force(spark, family, words, threshold, node):
    docs = spark.createDataFrame(list(family.items()), "doc_id long, text string")
    same(near_components(docs, words=words, threshold=threshold, node=node, depth=4).collect(), family, words, threshold)


def test_a_large_group_does_not_grow_down_the_trees(spark, monkeypatch):
    """A dense group of many nodes' size with texts near its rim: whole result, and rows in proportion."""
    import llm.near_copies as module

    base = prose(150, 5)
    texts = {i: edited(base, 0.004, i) for i in range(600)}
    for i in range(12):
        rim = edited(base, 0.03 + 0.005 * i, 5000 + i)
        texts |= {1000 + 10 * i + k: edited(rim, 0.01, 7000 + 10 * i + k) for k in range(3)}
    texts |= {2000 + i: prose(60, 900 + i) for i in range(20)}
    sizes = {}
    real = module.staged

    def counted(df, label):
        out = real(df, label)
        sizes[label] = max(sizes.get(label, 0), out.count())
        return out

    monkeypatch.setattr(module, "staged", counted)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    same(near_components(docs, words=3, threshold=85, node=64).collect(), texts, 3, 85)
    # Ten trees of 1 / 0.85 children, and no level beyond the first carries the group.
    assert sizes["nodes"] <= 12 * len(texts) and sizes["open"] <= 12 * len(texts)


def test_repeated_rows_of_an_id_are_compared_once(spark):
    near, far = prose(100, 8), prose(100, 9)
    rows = [(1, near)] * 700 + [(2, near + " end")] * 700 + [(3, far)] * 5 + [(1, far)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in near_components(docs, node=64).collect()}
    assert got == {(1, 1), (2, 1), (3, 1)}


def test_query(spark, folder):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    same(op10_chosen_path(spark, folder).collect(), texts, 3, 85)


def test_edge_rows(documents, nothing):
    rows = near_components(documents).collect()
    assert len(rows) == documents.count()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert by[2][0].component_id == by[1][0].component_id == 1 and not by[2][0].kept and by[1][0].kept
    assert by[3][0].n_shingles == by[4][0].n_shingles == by[5][0].n_shingles == 0 and by[4][0].kept
    assert by[10][0].component_id == 9 and by[11][0].n_shingles == 1
    assert all(r.component_id is None and r.kept for r in by[None])
    kept = keep_one(documents)
    assert kept.columns == documents.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in rows if r.kept)
    assert near_components(nothing).count() == 0


def test_components(spark):
    r = random.Random(5)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(500 + i, 501 + i) for i in range(60)] + [(900, 1000 + i) for i in range(50)] + [(7, 7), (None, 3)]
    got = {x.node: x.component for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert got == smallest({x for p in real for x in p}, real)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rounds_shuffle_to_as_many_partitions_as_the_links_fill(spark):
    from llm.components import components

    usual = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "211")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        before = spark.sparkContext.statusTracker()
        group = "rounds"
        spark.sparkContext.setJobGroup(group, "components")
        links = spark.createDataFrame([(i, i + 1) for i in range(20)] * 2 + [(50, 51), (51, 51), (None, 3)], "a long, b long")
        got = {r.node: r.component for r in components(links).collect()}
        assert spark.conf.get("spark.sql.shuffle.partitions") == "211"
        stages = [i for j in before.getJobIdsForGroup(group) for i in before.getJobInfo(j).stageIds]
        tasks = [before.getStageInfo(i).numTasks for i in stages if before.getStageInfo(i)]
        assert tasks and max(tasks) < 211
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {i: 0 for i in range(21)} | {50: 50, 51: 50}
