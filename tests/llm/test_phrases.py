import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from llm.common import table
from llm.phrases import ORACLE, count_phrases, frequent_phrases, marked, pieces, split_words, scored, top_phrases


def parts(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall("[^ \t]+", p) for p in re.split("[.,;:!?\n-\r]", lowered)]


def brute(rows, least):
    """Counts of all phrases of one to four words per language, and of all words."""
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for words in parts(text):
            totals[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    counts[lang, k, " ".join(words[i : i + k])] += 1
    out = {(*key, n) for key, n in counts.items() if n >= least}
    return out | {(lang, 0, "", n) for lang, n in totals.items() if n}


def brute_scores(found, covered=80, top=2000):
    f = {(lang, p): n for lang, k, p, n in found if k}
    total = {lang: n for lang, k, _, n in found if not k}
    out = {}
    for (lang, p), a in f.items():
        w = p.split(" ")
        if len(w) < 2:
            continue
        longer = [n for (l2, q), n in f.items() if l2 == lang and len(q.split(" ")) > len(w) and f" {p} " in f" {q} "]
        if any(100 * n >= covered * a for n in longer):
            continue
        cuts = []
        for c in range(1, len(w)):
            left, right = f[lang, " ".join(w[:c])], f[lang, " ".join(w[c:])]
            cuts.append((2000000 * a // (left + right), c, left, right))
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, p.encode(), p, a, left, right, total[lang], score))
    return {(lang, i + 1, *row[3:]) for lang, rows in out.items() for i, row in enumerate(sorted(rows)[:top])}


def corpus(seed, n=60):
    r = random.Random(seed)
    common = ["The", "the", "of", "new", "york", "city", "état", "a\x1cb", "x\xa0y"]
    out = []
    for _ in range(n):
        words = []
        for _ in range(r.randrange(0, 60)):
            words += ["New", "York", "City", "Hall"] if r.random() < 0.1 else [r.choice(common) + r.choice(["", "", "", ",", ".", "\n", ";!", "\t"])]
        out.append((r.choice(["en", "en", "en", "fr", None]), " ".join(words) if r.random() > 0.05 else None))
    return out


def as_set(df, *columns):
    rows = [tuple(r[c] for c in columns) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("seed, sample, sample_least, bits", [(1, 8, 2, 20), (2, 1000, 1, 20), (3, 2, 1, 20), (4, 8, 2, 7)])
def test_counts_are_exact_whatever_the_sample(spark, seed, sample, sample_least, bits):
    """Empty samples take all expansion passes; a bitmap of 128 bits proposes nearly everything."""
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    found = frequent_phrases(docs, least=5, sample=sample, sample_least=sample_least, bits=bits)
    assert as_set(found, "lang", "k", "phrase", "n") == brute(rows, 5)


def test_scores_and_ranks(spark):
    rows = corpus(5, 120)
    found = brute(rows, 4)
    df = spark.createDataFrame(sorted(found), "lang string, k int, phrase string, n long")
    names = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert as_set(top_phrases(df), *names) == brute_scores(found)
    assert as_set(top_phrases(df, 7, 30), *names) == brute_scores(found, 30, 7)


def test_products_beyond_64_bits(spark):
    big = 4 * 10**12
    rows = [("en", 0, "", 9 * big), ("en", 1, "a", 2 * big), ("en", 1, "b", big + 1), ("en", 2, "a b", big), ("en", 3, "a b c", big - big // 5), ("en", 1, "c", big), ("en", 2, "b c", big)]
    out = {r.phrase: r for r in scored(spark.createDataFrame(rows, "lang string, k int, phrase string, n long")).collect()}
    assert set(out) == {"a b c"}
    assert out["a b c"].score == min(2000000 * (big - big // 5) // (3 * big), 2000000 * (big - big // 5) // (2 * big))
    rows[4] = ("en", 3, "a b c", big - big // 5 - 1)
    out = {r.phrase: r.score for r in scored(spark.createDataFrame(rows, "lang string, k int, phrase string, n long")).collect()}
    assert out["a b"] == 2000000 * big // (3 * big + 1)


def test_words_and_pieces():
    for texts in ([b""], [b" \t"], [b"A b,C\td", b"", b"e.f "], [".é x\xa0y ".encode(), b"z" * 3000]):
        words, piece = split_words(pieces(texts))
        want = [[w for w in p.split() if w] for p in pieces(texts).replace(b"\x1c", b"?").split(b"\xff")]
        assert words.to_pylist() == [w for p in want for w in p]
        assert piece.tolist() == [i for i, p in enumerate(want) for _ in p]


def told(out):
    """Phrases by text and number of hashes, of what `count_phrases` gives."""
    by_text, hashes = {}, 0
    for _, names, n in out:
        for name, m in zip(names.to_pylist(), n.tolist()):
            hashes += name is None
            if name is not None:
                by_text[name.decode()] = m
    return by_text, hashes


def test_marked_phrases_are_told_by_text(spark):
    text = pieces([b"One two, two three", b"four two three", b""])
    none = np.zeros(1 << 10, np.uint64)
    by_text, hashes = told(count_phrases(text, "en", none, None))
    assert by_text == {"en\t": 7} and hashes == 4
    bitmap, old = none, None
    for _ in range(4):
        rows = [(int(x),) for h, _, _ in count_phrases(text, "en", bitmap, old, by_text=False) for x in h.view(np.int64)]
        old, bitmap = bitmap, marked(bitmap, spark.createDataFrame(rows, "h long"))
    by_text, hashes = told(count_phrases(text, "en", bitmap, None))
    assert hashes == 0 and by_text["en\ttwo three"] == 2 and by_text["en\tfour two three"] == 1 and "en\tthree four" not in by_text and "en\ttwo two" not in by_text


def test_a_later_pass_counts_only_what_is_new():
    text = pieces([b"a b c d a b c d"])
    none, full = np.zeros(1 << 10, np.uint64), ~np.zeros(1 << 10, np.uint64)
    assert told(count_phrases(text, "en", full, full)) == ({}, 0)
    assert told(count_phrases(text, "en", none, none)) == ({}, 0)
    assert told(count_phrases(text, "en", none, None)) == ({"en\t": 8}, 4)
    by_text, hashes = told(count_phrases(text, "en", full, none))
    assert hashes == 0 and len(by_text) == 16 and by_text["en\ta b c d"] == 2 and "en\t" not in by_text


def test_as_sql(spark, folder):
    found = frequent_phrases(table(spark, folder, "documents"), sample=3)
    names = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    want = con.execute(f"select {', '.join(names)} from ({ORACLE['op12_toivonen_phrases']})").fetchall()
    assert want and as_set(top_phrases(found), *names) == set(want)


def test_the_ranking_is_cut_in_parts(spark, monkeypatch):
    import llm.phrases as module

    found = brute(corpus(5, 120), 4)
    df = spark.createDataFrame(sorted(found), "lang string, k int, phrase string, n long")
    for parts in (1, 3, 1000):
        monkeypatch.setattr(module, "PARTS", parts)
        assert as_set(top_phrases(df, 5), "lang", "rank", "phrase", "a", "l", "r", "n", "score") == brute_scores(found, top=5)


def test_odd_rows(documents, nothing):
    rows = [(r.lang, r.text) for r in documents.collect()]
    assert as_set(frequent_phrases(documents, least=2), "lang", "k", "phrase", "n") == brute(rows, 2)
    empty = frequent_phrases(nothing)
    assert empty.count() == 0 and top_phrases(empty).count() == 0
