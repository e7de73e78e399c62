import numpy as np
import pytest
from pyspark.sql import functions as F

from llm.quality import CELLS, cell_of, estimate_prior, fit, keep_good, measures, op2_positive_unlabelled, score_documents


def test_held_out_scores(spark, folder):
    folder = folder.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = op2_positive_unlabelled(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id", "left").collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.quality is not None]
    good, bad = [r.score for r in held if r.quality == 1], [r.score for r in held if r.quality == 0]
    auc = np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])
    assert auc > 0.93
    assert np.mean([r.predicted == r.quality for r in held]) > 0.93


def test_labels_of_held_out_rows_change_nothing(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    other = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(score_documents(docs, x).collect()) for x in (labels, other))
    assert a == b


@pytest.mark.parametrize("prior", [0.3, 0.6, 0.85])
def test_prior_and_risk(prior):
    """Positives in cells 0-9, negatives in 8-19 of a small part of the grid."""
    r = np.random.default_rng(1)
    p, n = np.zeros(CELLS), np.zeros(CELLS)
    p[np.arange(10) * 50], n[np.arange(8, 20) * 50] = 1 / 10, 1 / 12
    positive, unlabelled = r.multinomial(5000, p), r.multinomial(20_000, prior * p + (1 - prior) * n)
    assert abs(estimate_prior(positive.astype(float), unlabelled.astype(float)) - prior) < 0.08
    score, _ = fit(positive.astype(float), unlabelled.astype(float))
    assert score[0] > 0.5 and np.isfinite(score).all() and ((score >= 0) & (score <= 1)).all()


def test_nothing_to_learn_from(documents, nothing):
    labels = documents.sparkSession.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    assert {r.score for r in score_documents(documents, labels).collect()} == {0.5}
    assert score_documents(nothing, labels).count() == 0
    assert fit(np.zeros(CELLS), np.zeros(CELLS))[1] == 0.5


def test_edge_rows(documents):
    labels = documents.sparkSession.createDataFrame([(1, 1), (1, 1), (6, 1), (11, 0)], "doc_id long, quality int")
    assert score_documents(documents, labels).count() == documents.count()
    kept = keep_good(documents, labels)
    assert kept.columns == documents.columns and kept.count() <= documents.count()


def test_measures_look_at_the_whole_text():
    assert measures(None) == measures(b"") == (0.0,) * 7
    plain = b"Some plain words, as people write them. " * 50
    assert cell_of(plain) != cell_of(plain + b"SPAM!! $$$ *** " * 200)
