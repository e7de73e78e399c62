import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from llm.substrings import anchors, op4_suffix_order, remove_repeats
from tests.llm.conftest import prose


def brute(rows, length=200):
    seen = Counter(b[i : i + length] for b in rows for i in range(len(b) - length + 1))
    out = []
    for b in rows:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), kept))
    return out


@pytest.fixture(scope="module")
def texts():
    r = random.Random(1)
    base, line = prose(120, 11), prose(45, 12)[:230]
    out = [base, base, line, line[:199], line[:200], line[1:201], "x" * 500, "y" * 199, "ab" * 300, "é" * 150, "é" * 99, None, ""]
    for k in range(40):
        at = r.randrange(len(base))
        out.append(base[:at] + f" cut {k} " + base[at:])
        out.append(prose(30, 200 + k) + line[: 150 + 2 * k] + prose(20, 300 + k))
    return out


@pytest.mark.parametrize("bucket", [2000, 3])
def test_against_brute_force(spark, texts, bucket):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want = brute([(t or "").encode() for t in texts])
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeats(df, bucket=bucket).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_query(spark, folder):
    rows = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = {i: w for (i, _), w in zip(rows, brute([b for _, b in rows]), strict=True)}
    for r in op4_suffix_order(spark, folder).collect():
        n, gone, runs, kept = want[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, gone, runs, hashlib.sha256(kept).hexdigest())


def test_edge_rows(documents, nothing):
    rows = remove_repeats(documents).collect()
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows)
    texts = [(r.doc_id or 0, (r.text or "").encode()) for r in documents.collect()]
    assert got == sorted((i, *w) for (i, _), w in zip(texts, brute([b for _, b in texts]), strict=True))
    assert remove_repeats(nothing).count() == 0


def test_every_window_holds_an_anchor():
    r = np.random.default_rng(0)
    for raw in (r.integers(97, 103, 3000).astype(np.uint8), np.full(900, 65, np.uint8), np.tile(r.integers(0, 255, 7).astype(np.uint8), 100)):
        at = set(anchors(raw).tolist())
        assert all(any(p in at for p in range(s, s + 169)) for s in range(len(raw) - 199))
    assert len(anchors(np.zeros(199, np.uint8))) == 0
