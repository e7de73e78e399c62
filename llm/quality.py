"""Quality classifier by positive-unlabelled learning.

A text is described by binned shares (symbols, capitals, repeated words and so on). The bins form a
grid of fixed size, so the whole corpus is summed to counts per cell, for trusted positives and for
unlabelled texts, and the non-negative unbiased risk is minimised over those counts: nothing is
sampled. The class prior is the smallest ratio of unlabelled to positive mass over nested sets of
cells, ordered by how positive they look.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import append_columns, fold, free_name, staged, table, utf8

THRESHOLD = 0.3
# Feature -> edges of its bins. The product of the bins is the number of cells.
EDGES = {
    "symbols": (0.002, 0.01, 0.03, 0.1),
    "capitals": (0.05, 0.15, 0.3, 0.6),
    "same as before": (0.02, 0.1, 0.3),
    "distinct": (0.1, 0.25, 0.5),
    "word length": (2.5, 4.0, 8.0, 14.0),
    "digits": (0.02, 0.1, 0.3),
    "words": (0.5, 3.5, 20.5),
}
BINS = tuple(len(e) + 1 for e in EDGES.values())
CELLS = reduce(lambda a, b: a * b, BINS)
# Smallest share of the positives in a set of cells that may decide the prior.
PRIOR_SUPPORT = 0.05
PENALTY = 1e-4
STEPS = 1500

PLAIN = b" \t\n\r\x0b\x0c.,;:'\"()-?"


def measures(raw: bytes | None) -> tuple[float, ...]:
    """The features of a whole text, in the order of EDGES; zeros for null and empty."""
    if not raw:
        return (0.0,) * len(EDGES)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower, digits = counts[65:91].sum(), counts[97:123].sum(), counts[48:58].sum()
    plain = sum(int(counts[b]) for b in PLAIN)
    other = counts[:128].sum() - upper - lower - digits - plain
    words = raw.split()
    n = max(1, len(words))
    before = sum(map(bytes.__eq__, words, words[1:]))
    letters = upper + lower + counts[128:].sum()
    return (
        other / len(raw), upper / max(1, letters), before / n, len(set(words)) / n,
        (len(raw) - len(words)) / n, digits / len(raw), float(len(words)),
    )


def cell_of(raw: bytes | None) -> int:
    cell = 0
    for value, edges, size in zip(measures(raw), EDGES.values(), BINS, strict=True):
        cell = cell * size + int(np.searchsorted(edges, value, side="right"))
    return cell


def with_cell(docs: DataFrame, text: str, name: str) -> DataFrame:
    return append_columns(docs, lambda batch: {name: [cell_of(raw) for raw in utf8(batch, text)]}, f"`{name}` int")


def _design() -> np.ndarray:
    """One row per cell: its bins, one column each, and a constant."""
    at = np.array(np.unravel_index(np.arange(CELLS), BINS)).T
    return np.concatenate([np.eye(size)[at[:, i]] for i, size in enumerate(BINS)] + [np.ones((CELLS, 1))], axis=1)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled: min over nested sets of U(set) / P(set).

    U = prior * P + (1 - prior) * N, so U(set) / P(set) is at least the prior and reaches it where
    the set holds no negatives. Cells enter in order of P / U; sets need some support in P.
    """
    p, u = positive / positive.sum(), unlabelled / unlabelled.sum()
    seen = np.flatnonzero(p + u)
    order = seen[np.argsort(-(p[seen] / (p[seen] + u[seen])), kind="stable")]
    cp, cu = np.cumsum(p[order]), np.cumsum(u[order])
    enough = cp >= PRIOR_SUPPORT
    slack = np.sqrt(1.0 / positive.sum()) + np.sqrt(1.0 / unlabelled.sum())
    ratio = np.minimum(1.0, (cu[enough] + 0.1 * slack) / cp[enough])
    return float(np.clip(ratio.min(), 0.01, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray) -> tuple[np.ndarray, float]:
    """Score of every cell and the class prior, from counts per cell.

    Minimises prior * P[loss(+)] + max(0, U[loss(-)] - prior * P[loss(-)]) with the logistic loss.
    While the second part is negative, the step climbs it back instead. Without positives or without
    unlabelled texts every score is 0.5.
    """
    if not positive.sum() or not unlabelled.sum():
        return np.full(CELLS, 0.5), 0.5
    prior = estimate_prior(positive, unlabelled)
    x = _design()
    used = np.flatnonzero(positive + unlabelled)
    xs, p, u = x[used], (positive / positive.sum())[used], (unlabelled / unlabelled.sum())[used]
    w, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for step in range(1, STEPS + 1):
        z = xs @ w
        s = 1 / (1 + np.exp(-z))
        loss_neg = np.logaddexp(0, z)
        rest = u @ loss_neg - prior * (p @ loss_neg)
        g_rest = xs.T @ ((u - prior * p) * s)
        g_pos = xs.T @ (prior * p * (s - 1))
        g = (g_pos + g_rest if rest >= 0 else -g_rest) + PENALTY * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return 1 / (1 + np.exp(-(x @ w))), prior


def train(cells: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", label_key: str = "doc_id") -> tuple[np.ndarray, float]:
    """Scores per cell from a table of (key, cell), of which the key's fold is not held out.

    Labels with a null key or value count as missing; a key labelled twice is positive only if every
    label is 1. At most CELLS rows come to the driver.
    """
    good = labels.where(F.col(label).isNotNull()).groupBy(F.col(label_key).alias("_k")).agg(F.min(label).alias("_q"))
    learn = cells.where(fold(key) != 0).select(F.col(key).alias("_d"), "_cell")
    joined = learn.join(good.where((F.col("_q") == 1) & F.col("_k").isNotNull()), F.col("_d") == F.col("_k"), "left")
    rows = joined.groupBy("_cell").agg(F.count("*").alias("u"), F.count("_k").alias("p")).collect()
    p, u = np.zeros(CELLS), np.zeros(CELLS)
    for r in rows:
        p[r._cell], u[r._cell] = r.p, r.u
    return fit(p, u)


def _scored(df: DataFrame, scores: np.ndarray, cell: str, name: str) -> DataFrame:
    """Look the score up; the table has CELLS rows, which is the bound of the broadcast."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(i, float(s)) for i, s in enumerate(scores)], f"`_c{cell}` int, `{name}` double")
    return df.join(F.broadcast(grid), F.col(f"`{cell}`") == F.col(f"`_c{cell}`")).drop(f"_c{cell}")


def score_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: key, held_out, score (0 to 1, higher is better) and predicted (1 from `threshold` on).

    Null and empty texts have a cell of their own and a score; repeated rows are scored alike; an
    empty table gives no rows. A null key counts as empty text for the fold and has no label.
    """
    cells = staged(with_cell(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), "text", "_cell").drop("text"), "quality")
    scores, _ = train(cells, labels)
    out = _scored(cells, scores, "_cell", "score")
    return out.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that the classifier does not reject, with their columns as they are."""
    cells = with_cell(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), "text", "_cell").drop("text")
    scores, _ = train(cells, labels)
    cell, score = free_name(docs, "_cell"), free_name(docs, "_score")
    out = _scored(with_cell(docs, text, cell), scores, cell, score)
    return out.where(F.col(f"`{score}`") >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_positive_unlabelled(spark: SparkSession, folder: str) -> DataFrame:
    return score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


QUERIES = {"op2_positive_unlabelled": op2_positive_unlabelled}
