import numpy as np
import pytest

from llm.vectors import near_vectors, op6_sorted_projections
from tests.llm.test_near import smallest


def brute(rows, threshold=0.98):
    """(n_links, component) per id; unit vectors in double precision."""
    x, label = {}, {}
    for i, v, y in rows:
        a = np.array(v, float) if v is not None and None not in v else np.zeros(1)
        if y is not None and len(a) and np.isfinite(a).all() and a.any():
            x[i], label[i] = a / np.sqrt((a * a).sum()), y
    ids, links = sorted(x), []
    groups = {}
    for i in ids:
        groups.setdefault((label[i], len(x[i])), []).append(i)
    for own in groups.values():
        m = np.stack([x[i] for i in own])
        near = m @ m.T >= threshold
        links += [(own[a], own[b]) for a, b in zip(*np.nonzero(np.triu(near, 1)), strict=True)]
    n = {i: 0 for i, _, _ in rows}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    root = smallest([i for i, _, _ in rows], links)
    return {i: (n[i], root[i], root[i] == i) for i in n}


def result(df):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in df.collect()}


@pytest.mark.parametrize("window,block", [(32, 1024), (4, 8)])
def test_against_brute_force(spark, window, block):
    r = np.random.default_rng(2)
    rows, n = [], 0
    for g in range(30):
        base = r.standard_normal(16)
        for _ in range(int(r.integers(1, 25))):
            rows.append((n, [float(v) for v in base + r.standard_normal(16) * 0.09], g % 3))
            n += 1
    rows += [(n + i, rows[0][1], 0) for i in range(40)] + [(n + 50 + i, [2 * v for v in rows[5][1]], i) for i in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert result(near_vectors(df, window=window, block=block)) == brute(rows)


def test_edge_rows(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [1.0, 0.0], None), (4, None, 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1), (7, [None, 1.0], 1), (8, [], 1), (9, [1.0, 0.0, 0.0], 1), (10, [2.0, -0.0], 1), (11, [1e300, 0.0], 1), (12, [float("inf"), 0.0], 1)]
    df = spark.createDataFrame([(*x, "n") for x in rows], "vec_id long, embedding array<double>, label int, n_links string")
    want = {1: (3, 1, True), 2: (3, 1, False), 10: (3, 1, False), 11: (3, 1, False)} | {i: (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 12)}
    assert result(near_vectors(df)) == want
    assert near_vectors(df.limit(0)).count() == 0
    none = near_vectors(spark.createDataFrame([(None, [1.0], 1), (None, [1.0], 1)], "vec_id long, embedding array<double>, label int")).collect()
    assert all(r.component_id is None and r.kept and r.n_links == 0 for r in none) and len(none) == 2


def test_query_and_recall(spark, folder):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    assert result(op6_sorted_projections(spark, folder)) == brute(rows)


@pytest.mark.parametrize("common,options", [(2.0, {}), (2.0, {"exact": 0, "whole": 2048}), (0.0, {"exact": 0, "pass_cost": 128})])
def test_planted_pairs_in_a_large_label(spark, tmp_path, common, options):
    """Pairs at the threshold that nothing else connects; mean cosine of the label 0.8, or 0 in passes."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    r = np.random.default_rng(9)
    n, planted = 9000, 3000
    unit = lambda x: x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    x = unit(r.standard_normal((n, 64)) / 8 + common * np.eye(64)[0])
    u = r.standard_normal((planted, 64))
    u = unit(u - (u * x[:planted]).sum(axis=1, keepdims=True) * x[:planted])
    x = np.concatenate([x, 0.9801 * x[:planted] + np.sqrt(1 - 0.9801**2) * u])
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": list(x), "label": np.ones(len(x), np.int32)}), tmp_path / "v.parquet")
    near = unit(x) @ unit(x).T >= 0.98
    np.fill_diagonal(near, False)
    rows = near_vectors(spark.read.parquet(str(tmp_path / "v.parquet")), **options).collect()
    root = smallest(range(len(x)), np.argwhere(np.triu(near)).tolist())
    want = {i: (int(m), root[i]) for i, m in enumerate(near.sum(axis=1))}
    assert {q.vec_id: (q.n_links, q.component_id) for q in rows} == want


@pytest.mark.parametrize("cut", [{}, {"whole": 700, "window": 40}, {"exact": 0, "pass_cost": 64}])
def test_links_do_not_depend_on_a_sample_or_on_how_a_label_is_cut(spark, tmp_path, cut):
    """A dense spot of 2,000 vectors, 1,000 of them twins at the threshold, none of which a sample of 1,024 by hash holds (F2)."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    r, n, spot = np.random.default_rng(4), 5000, 1000
    unit = lambda x: x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    base = unit(unit(r.standard_normal((1, 64))) + r.standard_normal((spot, 64)) * 0.034)
    u = r.standard_normal((spot, 64))
    u = unit(u - (u * base).sum(axis=1, keepdims=True) * base)
    x = unit(np.concatenate([base, 0.98001 * base + np.sqrt(1 - 0.98001**2) * u, r.standard_normal((n - 2 * spot, 64))]))
    unseen = [q.id for q in spark.range(20000).where(F.pmod(F.xxhash64("id"), F.lit(n)) >= 1024).limit(2 * spot).collect()]
    ids = np.concatenate([r.permutation(unseen), np.arange(20000, 20000 + n - 2 * spot)])
    pq.write_table(pa.table({"vec_id": ids, "embedding": list(x), "label": np.ones(n, np.int32)}), tmp_path / "v.parquet")
    near = x @ x.T >= 0.98
    np.fill_diagonal(near, False)
    root = smallest(ids.tolist(), [(int(ids[a]), int(ids[b])) for a, b in np.argwhere(np.triu(near))])
    want = {int(i): (int(m), root[i], root[i] == i) for i, m in zip(ids, near.sum(axis=1), strict=True)}
    assert result(near_vectors(spark.read.parquet(str(tmp_path / "v.parquet")), **cut)) == want


def test_crowded_step_is_dealt_into_pieces(spark):
    """Vectors that the first direction doesn't part fill one step; its pieces meet each other."""
    from llm.vectors import directions

    r = np.random.default_rng(6)
    d = directions(8)[:, 0]
    x = r.standard_normal((300, 8))
    x -= (x @ d)[:, None] * d
    x = np.repeat(x / np.sqrt((x * x).sum(axis=1, keepdims=True)), 2, axis=0)
    x[1::2] += 0.05 * np.linalg.qr(r.standard_normal((8, 8)))[0][0]
    rows = [(i, [float(c) for c in v], "a") for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    assert result(near_vectors(df, whole=64, window=16)) == brute(rows)
