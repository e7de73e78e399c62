"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts are sums over partitions; the matrix of log-probabilities (languages x buckets, at
most 2^24 cells) is broadcast, and a batch is scored in numpy over the n-grams it has.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import append_columns, fold, slices, table, values

ORDERS = (1, 2, 3)
BITS = 16
MAX_CELLS = 1 << 24
# Labelled rows the model is fitted on at most, chosen by hash of id and text.
MAX_TRAINING_ROWS = 50_000
SMOOTHING = 0.5
UNKNOWN = "und"


def _points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of all texts, each followed by spaces, and where each text starts.

    ASCII characters that are no letters become spaces. The spaces at the end keep every n-gram
    that starts in a text from reaching the next.
    """
    pad = " " * max(ORDERS)
    parts = [(t or "").lower() + pad for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]]).astype(np.int64)
    points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    points[(points < 128) & ((points < 97) | (points > 122))] = 32
    return points, starts


def _buckets(points: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Bucket of the n-gram that starts at each position, one array per order."""
    rolled = np.zeros(len(points), np.uint32)
    with np.errstate(over="ignore"):
        for n in range(1, max(ORDERS) + 1):
            shifted = np.full(len(points), 32, np.uint32)
            shifted[: len(points) - n + 1] = points[n - 1 :]
            rolled = rolled * np.uint32(0x01000193) + shifted + np.uint32(n)
            if n in ORDERS:
                mixed = (rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
                yield ((mixed ^ (mixed >> np.uint32(12))) * np.uint32(0x297A2D39)) >> np.uint32(32 - bits)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", max_rows: int = MAX_TRAINING_ROWS) -> dict:
    """Log-probabilities and priors from the rows of `docs` that have a language and a letter.

    At most about `max_rows` rows are used, by a hash of id and text: all of them while the table has
    no more. Without any such row the model is empty.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(key), F.crc32(F.col(text).cast("binary"))).alias("h")
    )
    total = docs.where(F.col(lang).isNotNull()).count()
    if total > max_rows:
        rows = rows.where(F.pmod("h", F.lit(1_000_000)) < F.lit(int(1_000_000 * max_rows / total)))
    languages = docs.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang")).distinct().count()
    bits = min(BITS, int(math.log2(MAX_CELLS / max(1, languages))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        rows_of: dict[str, int] = {}
        for part in slices(batches):
            names, texts = values(part, "lang"), values(part, "text")
            for name in set(names):
                own = [t for t, x in zip(texts, names, strict=True) if x == name and has_letter(t)]
                if not own:
                    continue
                rows_of[name] = rows_of.get(name, 0) + len(own)
                points, _ = _points(own)
                if name not in sums:
                    sums[name] = np.zeros(1 << bits, np.int64)
                for b in _buckets(points, bits):
                    sums[name] += np.bincount(b, minlength=1 << bits)
        for name, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * (len(at) + 1)), pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(s[at], rows_of[name]), pa.int64())], names=["lang", "bucket", "n"]
            )

    counted = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    names = sorted({r.lang for r in counted})
    index = {n: i for i, n in enumerate(names)}
    matrix, prior = np.zeros((len(names), 1 << bits)), np.zeros(len(names))
    for r in counted:
        if r.bucket < 0:
            prior[index[r.lang]] = r.n
        else:
            matrix[index[r.lang], r.bucket] = r.n
    matrix += SMOOTHING
    logs = np.log(matrix / matrix.sum(axis=1, keepdims=True)).astype(np.float32) if names else matrix
    return {"names": names, "bits": bits, "logs": logs, "prior": np.log(prior / prior.sum()) if names else prior}


def predict(texts: list[str | None], model: dict) -> tuple[list[str], list[float]]:
    """Most probable language and its posterior probability; `und` and 0 without a letter."""
    names = model["names"]
    if not names or not texts:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    points, starts = _points(texts)
    each = np.zeros((len(names), len(points)), np.float32)
    for b in _buckets(points, model["bits"]):
        for k in range(len(names)):
            each[k] += model["logs"][k][b]
    scores = np.add.reduceat(each.astype(np.float64), starts, axis=1) + model["prior"][:, None]
    best = scores.argmax(axis=0)
    share = 1.0 / np.exp(scores - scores.max(axis=0)).sum(axis=0)
    ok = [has_letter(t) for t in texts]
    return [names[b] if o else UNKNOWN for b, o in zip(best, ok, strict=True)], [float(s) if o else 0.0 for s, o in zip(share, ok, strict=True)]


def identify(docs: DataFrame, model: dict, text: str = "text", lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """`docs` with the predicted language and its probability.

    A null text, or one without letters, gives `und` and 0; so does a model without languages. Ties
    go to the first language in order of name. Every row is predicted on its own whole text.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make(batch: pa.RecordBatch) -> dict:
        names, scores = predict(values(batch, text), sent.value)
        return {lang_name: names, score_name: scores}

    return append_columns(docs, make, f"{lang_name} string, {score_name} double", rows=128)


def op9_naive_bayes(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = train(docs.where(fold("doc_id") != 0))
    scored = identify(docs.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op9_naive_bayes": op9_naive_bayes}
