import hashlib
import re

import pytest

from llm.contamination import clean_documents, contamination, op7_aho_corasick, scan
from tests.llm.conftest import prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return t.translate({i: i + 32 for i in range(65, 91)})


def brute(text, items, width=13):
    w = WORD.findall(lower(text or ""))
    hit, found = [False] * len(w), set()
    for name, item in items:
        v = WORD.findall(lower(item or ""))
        for k in range(max(1, len(v) - width + 1) if v else 0):
            window = v[k : k + width]
            for i in range(len(w) - len(window) + 1):
                if w[i : i + len(window)] == window:
                    hit[i : i + len(window)] = [True] * len(window)
                    found.add(str(name))
    return len(w), sum(hit), sorted(found)


ITEMS = [(1, prose(20, 5)), (2, prose(30, 6)), (3, "short item"), (4, prose(20, 5)), (5, None), (6, ""), (10, "Été à l'œuvre")]


@pytest.fixture
def benchmark(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.fixture
def texts(spark):
    rows = [
        (1, prose(50, 7) + ". " + prose(20, 5).upper() + "! " + prose(40, 8)), (2, prose(300, 9) + " Short-Item " + prose(30, 10)),
        (3, None), (4, ""), (5, "short item"), (5, "short item"), (6, "shortitem x"), (7, "ÉTÉ à l'œuvre et Été à l'œuvre"), (8, prose(30, 6)[40:]),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("pairs", [60_000, 7])
def test_against_brute_force(texts, benchmark, pairs):
    scanned, name = scan(texts, benchmark, max_pairs=pairs)
    rows = scanned.collect()
    assert len(rows) == texts.count()
    for r in rows:
        s = r[name]
        assert (s.n_words, s.n_hit, sorted(s["items"])) == brute(r.text, ITEMS)


def test_spans_map_to_the_original(texts, benchmark):
    rows = {r.doc_id: r for r in contamination(texts, benchmark).collect()}
    assert [rows[7].text[s.start : s.end] for s in rows[7].spans] == ["Été à l'œuvre"]
    assert [rows[2].text[s.start : s.end] for s in rows[2].spans] == ["Short-Item"]
    assert rows[5].contaminated and not rows[2].contaminated and not rows[3].contaminated


def test_edge_rows_and_empty_tables(documents, nothing, benchmark):
    assert clean_documents(documents, benchmark).columns == documents.columns
    assert clean_documents(documents, benchmark).count() == documents.count()
    assert clean_documents(documents, benchmark.limit(0)).count() == documents.count()
    assert contamination(nothing, benchmark).count() == 0
    gone = clean_documents(documents, benchmark.sparkSession.createDataFrame([("x", "one two")], "item_id string, text string"))
    assert gone.count() == documents.count() - 2


def test_query(spark, folder):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = op7_aho_corasick(spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows[::3]:
        n, hit, found = brute(texts[r.doc_id], items)
        digest = hashlib.sha256(",".join(found).encode()).hexdigest()
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, len(found), digest, hit > 0 and 20 * hit >= n)
