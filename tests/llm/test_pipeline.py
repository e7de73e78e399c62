import corpus_pipeline
from tests.llm.conftest import prose
from tests.llm.test_contamination import brute


def test_stages(spark, folder):
    folder = folder.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    counts = [docs.count()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        rows = {r.doc_id: r for r in docs.collect()}
        counts.append(len(rows))
        assert set(rows) <= set(before)
        if name == "decontamination":
            for i in set(before) - set(rows):
                n, hit, _ = brute(before[i].text, items)
                assert 20 * hit >= n and hit
        if name == "personal_data":
            assert set(rows) == set(before)
            assert not any("@mail" in r.text and ".example.com" in r.text for r in rows.values())
    assert counts[0] > counts[1] > counts[2] > counts[3] == counts[4]


def test_run_and_empty_table(spark, folder, nothing):
    assert corpus_pipeline.run(spark, folder).count() > 0
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert docs.count() == 0


def test_near_copies_keep_one_of_repeated_rows_and_null_ids(spark, folder):
    a, b, c, d = (prose(80, seed) for seed in (41, 42, 43, 44))
    rows = [(5, a), (5, a), (9, a), (None, a), (None, b), (None, b), (None, b + " end"), (7, c), (3, c + " end"), (3, c + " end"), (8, d), (8, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_copies(spark, docs, folder)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(got) == 6 and {(5, a), (3, c + " end"), (8, d), (8, None), (None, None)} <= set(got)
    assert len({(None, b), (None, b + " end")} & set(got)) == 1
