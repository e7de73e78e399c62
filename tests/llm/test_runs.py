import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from llm.common import table
from llm.runs import Extensions, block_words, collapse, find_runs, lyndon_array, op13_baier_runs, periodic_runs, runs_of, stretches


def brute(text, least, repeats):
    """Every maximal stretch per period, periods ascending; a stretch counts under its smallest period."""
    out, n = [], len(text)
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            if text[i] != text[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and text[i] == text[i + q]:
                i += 1
            length = i + q - s
            smallest = next(d for d in range(1, q + 1) if all(text[k] == text[k + d] for k in range(s, s + length - d)))
            if length >= max(least, repeats * q) and smallest == q:
                out.append((s, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_lyndon(text):
    """Longest prefix of each suffix that is smaller than all its proper suffixes."""
    out = []
    for i in range(len(text)):
        best = 1
        for j in range(i + 1, len(text) + 1):
            w = text[i:j]
            if all(w < w[k:] for k in range(1, len(w))):
                best = j - i
        out.append(best)
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=24))
def test_lyndon_arrays(text):
    dense = np.unique(text, return_inverse=True)[1].tolist()
    letters = max(dense) + 1
    assert lyndon_array(dense, letters) == brute_lyndon(dense)
    other = [letters - 1 - c for c in dense]
    assert lyndon_array(other, letters) == brute_lyndon(other)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1), min_size=2, max_size=40), st.data())
def test_extensions(text, data):
    x = np.array(text)
    i, j = data.draw(st.integers(0, len(text) - 1)), data.draw(st.integers(0, len(text) - 1))
    if i == j:
        return
    ext = Extensions(x, len(x))
    right = next((k for k in range(len(text)) if max(i, j) + k >= len(text) or text[i + k] != text[j + k]), None)
    left = next((k for k in range(len(text) + 1) if min(i, j) - k < 0 or text[i - k] != text[j - k]), None)
    assert ext.right(np.array([i]), np.array([j]))[0] == right
    assert ext.left(np.array([i]), np.array([j]))[0] == left


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), min_size=1, max_size=40), min_size=1, max_size=4), st.integers(1, 10), st.integers(2, 4))
def test_runs_of_parts(parts, least, repeats):
    want = [(k, *r) for k, p in enumerate(parts) for r in brute(p, least, repeats)]
    assert sorted(runs_of([np.array(p) for p in parts], least, repeats)) == sorted(want)


def planted(r):
    """Words with periodic stretches of various periods, neighbours that break or continue them, and copies far apart."""
    words = [r.choice("abcdefgh") for _ in range(r.randrange(30))]
    for _ in range(r.randrange(1, 5)):
        q = r.choice([1, 1, 2, 3, 5, 8, 9, 13])
        root = [r.choice("abc") for _ in range(q)]
        words += (root * 40)[: r.randrange(q, 7 * q + 20)]
        words += [r.choice("abcdefgh") for _ in range(r.randrange(0, 12))]
    if r.random() < 0.3:
        words += words[: r.randrange(len(words) + 1)]
    return [w.encode() for w in words]


@pytest.mark.parametrize("least, repeats", [(24, 3), (24, 2), (10, 3), (6, 4), (1, 2), (40, 5)])
def test_texts_with_planted_runs(least, repeats):
    r = random.Random(7)
    texts = [planted(r) for _ in range(120)] + [[], [b"x"] * 23, [b"x"] * 24, [b"x"] * 25, [b"x", b"y"] * 12, list(b"abc") * 0]
    assert find_runs(texts, least, repeats) == [brute(t, least, repeats) for t in texts]


def test_stretches_lose_no_run():
    assert block_words(24, 3) == 9
    r = random.Random(3)
    for _ in range(300):
        q = r.randrange(1, 20)
        length = max(24, 3 * q) + r.randrange(4)
        head, tail = [100 + k for k in range(r.randrange(9))], [200 + k for k in range(r.randrange(9))]
        root = [*range(q - 1), 50]
        ids = np.array(head + (root * 60)[:length] + tail)
        (a, b), = stretches(ids, np.zeros(len(ids), np.int64), 24, 3)
        assert a <= len(head) and b >= len(head) + length


def reference(text, doc_id):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    return words


def test_query_as_brute_force(spark, folder):
    got = {r.doc_id: r for r in op13_baier_runs(spark, folder).collect()}
    rows = table(spark, folder, "documents").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    seen = 0
    for row in rows:
        words = reference(row.text, row.doc_id)
        if len(words) > 1500:
            continue
        code = {w: i for i, w in enumerate(dict.fromkeys(words))}
        runs = brute([code[w] for w in words], 24, 3)
        own = got[row.doc_id]
        assert own.n_runs == len(runs)
        assert own.runs_sha256 == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest()
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert own.collapsed_sha256 == hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest()
        if runs:
            from fractions import Fraction

            s, n, q = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
            assert (own.start, own.length, own.period, own.exponent_milli) == (s, n, q, 1000 * n // q)
            seen += 1
        else:
            assert (own.start, own.length, own.period, own.exponent_milli) == (None,) * 4
    assert seen


def test_odd_rows(documents, nothing):
    out = periodic_runs(documents)
    assert out.columns == [*documents.columns, "runs"] and out.count() == documents.count()
    assert periodic_runs(nothing).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(documents, runs="score")
    with pytest.raises(ValueError):
        find_runs([], repeats=1)


def test_collapse_keeps_the_first_period(spark):
    rows = [(1, "a " + "x y z " * 9 + "b"), (2, None), (3, "plain  text"), (None, "w " * 5000)]
    out = collapse(periodic_runs(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert [r.text for r in out] == ["a x y z b", None, "plain  text", "w"]
