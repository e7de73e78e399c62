from pyspark.sql import functions as F

from llm.common import fold
from llm.language import identify, op9_naive_bayes, predict, train


def test_held_out_accuracy(spark, folder):
    folder = folder.replace("0.001", "0.01")
    rows = op9_naive_bayes(spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 100 and sum(r.lang_pred == r.lang for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_texts_without_letters_are_undetermined(documents, nothing):
    model = train(documents)
    rows = identify(documents, model, score_name="p").collect()
    assert {r.lang_pred for r in rows if not any(c.isalpha() for c in r.text or "")} == {"und"}
    assert {r.lang_pred for r in rows if r.text and "alpha" in r.text} == {"en"}
    assert identify(nothing, model, score_name="p").count() == 0


def test_without_labels_nothing_is_known(documents):
    model = train(documents.withColumn("lang", F.lit(None).cast("string")))
    assert predict(["some text", None], model) == (["und", "und"], [0.0, 0.0])


def test_a_text_is_scored_alone(documents):
    model = train(documents)
    texts = ["alpha beta", "gamma 1", "é", ""]
    assert predict(texts, model)[1][1] == predict([texts[1]], model)[1][0]


def test_fold_is_crc32_of_the_id(spark):
    import zlib

    rows = spark.range(50).select("id", fold("id").alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in rows)
