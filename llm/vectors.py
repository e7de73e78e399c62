"""Near-duplicate vectors by sorted projections with exact windows.

Equal vectors of a label are one class. Two unit vectors at cosine c lie sqrt(2 - 2c) apart, and no
projection on a unit direction takes them further apart. Classes are therefore ordered by label and
projection, the order is cut into blocks of about WHOLE classes, and only blocks within that reach of
each other meet. Inside a pair of blocks a class is compared with those in its window, the stretch of
the order within reach; projections on further directions leave out most of them, and cosines decide.
No link is missed, whatever the size of a label or the way it is cut. Links found are united to
components; inside a component every two classes are then compared, block by block, so its links are
counted completely.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm.common import over_slices, staged, table, values
from llm.components import components
from llm.near_copies import over_groups

# Rows of the order that are compared with their joint window at a time.
WINDOW = 256
# Most classes of a block of the order, and most bytes of their vectors.
WHOLE = 16384
BYTES = 8 << 20
# Steps of the first projection, from -1 to 1, at which the order of a label may be cut.
STEPS = 4096
# Directions on which classes are projected, the first of which orders them.
DIRECTIONS = 16
# Pieces of one step that holds more than a block.
PIECES = 1 << 20
# Classes of a component that one task compares with as many others at a time.
BLOCK = 1024


def _described(batch: pa.RecordBatch) -> dict:
    ids, digests, raw = values(batch, "vec_id"), [], []
    for v, label in zip(values(batch, "v"), values(batch, "label"), strict=True):
        x = None
        if v and label is not None and None not in v:
            x = np.array(v, np.float64) + 0.0
            if not np.isfinite(x).all() or not x.any():
                x = None
        raw.append(None if x is None else x.tobytes())
        digests.append(None if x is None else hashlib.blake2b(x.tobytes(), digest_size=16).digest())
    return {"vec_id": ids, "label": values(batch, "label"), "k": digests, "v": raw, "step": _steps(raw)}


def directions(size: int) -> np.ndarray:
    """Orthonormal directions of vectors of `size` components, as columns; the same in every task."""
    return np.linalg.qr(np.random.default_rng(size).standard_normal((size, min(size, DIRECTIONS))))[0]


def _steps(raw: list[bytes | None]) -> list[int | None]:
    """Step of the first projection of each vector."""
    out: list[int | None] = [None] * len(raw)
    for size in {len(r) for r in raw if r is not None}:
        at = [i for i, r in enumerate(raw) if r is not None and len(r) == size]
        first = unit([raw[i] for i in at]) @ directions(size // 8)[:, 0]
        for i, step in zip(at, np.clip((first + 1) * (STEPS / 2), 0, STEPS - 1).astype(int), strict=True):
            out[i] = int(step)
    return out


def unit(raw: list[bytes]) -> np.ndarray:
    """Unit vectors in double precision; scaled by the largest component first, so squares stay finite."""
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def reach(threshold: float) -> float:
    """The most that unit vectors at the threshold lie apart, with room for rounding."""
    return float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6


def _near(left: np.ndarray, right: np.ndarray, most: float) -> np.ndarray:
    """Which rows of projections lie at most about `most` apart; in single precision, so with some room."""
    a = np.column_stack([-2 * left, (left * left).sum(axis=1), np.ones(len(left))]).astype(np.float32)
    b = np.column_stack([right, np.ones(len(right)), (right * right).sum(axis=1)]).astype(np.float32)
    return a @ b.T <= most * most + 1e-4


def _spanning(threshold: float, window: int):
    """Of one block, or of a pair of blocks: links that connect all that its links connect."""
    most = reach(threshold)

    def make(group: dict) -> list[tuple]:
        own, (i, j) = np.array(group["own"]), (group["i"][0], group["j"][0])
        if not (own == i).any() or not (own == j).any():
            return []
        x, reps = unit(group["v"]), group["rep"]
        shadow = x @ directions(x.shape[1])
        order = np.argsort(shadow[:, 0], kind="stable")
        left, right = order[own[order] == i], order[own[order] == j]
        at, part, out = shadow[right, 0], np.arange(len(x)), []
        for start in range(0, len(left), window):
            some = left[start : start + window]
            ends = shadow[some[[0, -1]], 0] + (-most, most)
            first, last = np.searchsorted(at, ends[0]), np.searchsorted(at, ends[1], "right")
            if i == j:
                first = start
            others = right[first:last]
            close = _near(shadow[some], shadow[others], most)
            for n in np.flatnonzero(close.sum(axis=1) > (i == j)):  # more than itself
                p, near = some[n], others[close[n]]
                near = near[part[near] != part[p]]
                hit = near[np.einsum("ij,ij->i", x[np.full(len(near), p)], x[near]) >= threshold]
                names, seen = np.unique(part[hit], return_index=True)
                if len(names):
                    out += [(reps[p], reps[q]) for q in hit[seen]]
                    part[np.isin(part, names)] = part[p]
        return out

    return make


def _counted(threshold: float):
    """Of one block, or of a pair of blocks: every class and the vectors of other classes it links with."""

    def make(group: dict) -> list[tuple]:
        x, c, reps = unit(group["v"]), np.array(group["c"], np.int64), group["rep"]
        own, (i, j) = np.array(group["own"]), (group["i"][0], group["j"][0])
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        if not len(left) or not len(right):
            return []
        hit = np.einsum("ik,jk->ij", x[left], x[right]) >= threshold
        if i == j:
            np.fill_diagonal(hit, False)
            return [(reps[p], int(n)) for p, n in zip(left, hit @ c[right], strict=True)]
        return [(reps[p], int(n)) for p, n in zip(left, hit @ c[right], strict=True)] + [(reps[p], int(n)) for p, n in zip(right, hit.T @ c[left], strict=True)]

    return make


def _blocks(classes: DataFrame, whole: int) -> DataFrame:
    """(_l, _s, _step, block, pieces, low, high): stretches of about `whole` classes in the order of a label.

    A stretch ends between two steps; one that a crowded step makes larger is dealt into pieces.
    """
    steps = classes.groupBy(F.col("label").alias("_l"), F.col("size").alias("_s"), F.col("step").alias("_step")).agg(F.count("*").alias("n"))
    # At most STEPS rows of a label and size.
    before = F.sum("n").over(Window.partitionBy("_l", "_s").orderBy("_step")) - F.col("n")
    most = F.greatest(F.lit(1), F.least(F.lit(whole), F.floor(F.lit(BYTES) / F.col("_s"))))
    cut = steps.withColumn("block", F.floor(before / most).cast("long"))
    of_block = Window.partitionBy("_l", "_s", "block")
    return cut.select(
        "_l", "_s", "_step", "block", F.ceil(F.sum("n").over(of_block) / most).cast("long").alias("pieces"),
        F.min("_step").over(of_block).alias("low"), F.max("_step").over(of_block).alias("high"),
    )


def _meetings(blocks: DataFrame, threshold: float) -> DataFrame:
    """(_l, _s, piece, i, j): the pairs of pieces whose steps lie within reach, once for each of the two."""
    pieces = blocks.select("_l", "_s", "block", "pieces", "low", "high").distinct()
    first = F.col("block") * PIECES
    pieces = pieces.withColumn("piece", F.explode(F.sequence(first, first + F.col("pieces") - 1)))
    one = pieces.select("_l", "_s", F.col("piece").alias("i"), F.col("high").alias("_h"))
    two = pieces.select("_l", "_s", F.col("piece").alias("j"), F.col("low").alias("_w"))
    # A step more than the reach, as a projection is rounded where steps meet.
    room = int(np.ceil(reach(threshold) * STEPS / 2)) + 2
    pairs = one.join(two, ["_l", "_s"]).where((F.col("i") <= F.col("j")) & (F.col("_w") - F.col("_h") <= room))
    sides = F.array_distinct(F.array("i", "j"))
    return pairs.select("_l", "_s", F.explode(sides).alias("piece"), "i", "j")


def near_vectors(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.98, window: int = WINDOW, block: int = BLOCK, whole: int = WHOLE, exact: int | None = None, pass_cost: int | None = None
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row; links join equal labels at `threshold` or above.

    Every label goes the same way, and no link is missed: `window`, `whole` and `block` say how much
    is compared at a time and change no result. The work of a label grows with the pairs within reach
    in the order, up to all its pairs. `exact` and `pass_cost` chose a way by the size of a label;
    they are still taken and have no effect.

    Vectors that are null, empty, zero or hold null or non-finite components, and those with a null
    label, link with nothing. Vectors of different lengths never link. Equal vectors link with each
    other however many they are. Rows with a null id are components of their own with a null
    component and are kept. An empty table gives no rows.
    """
    kind = vectors.schema[label].dataType.simpleString()
    chosen = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v"), F.col(label).alias("label"))
    rows = staged(over_slices(chosen, _described, f"vec_id long, label {kind}, k binary, v binary, step int", rows=2048), "vectors")
    valid = rows.where(F.col("k").isNotNull() & F.col("vec_id").isNotNull())
    classes = valid.groupBy("label", "k").agg(F.min("vec_id").alias("rep"), F.count("*").alias("c"), F.first("v").alias("v"), F.min("step").alias("step"))
    classes = staged(classes.withColumn("size", F.length("v")), "classes")

    blocks = staged(_blocks(classes, whole), "blocks")
    in_step = (F.col("label") == F.col("_l")) & (F.col("size") == F.col("_s")) & (F.col("step") == F.col("_step"))
    own = F.col("block") * PIECES + F.pmod(F.xxhash64("rep"), F.col("pieces"))
    dealt = classes.join(blocks, in_step).select("label", "size", "rep", "v", own.alias("own"))
    meet = (F.col("label") == F.col("_l")) & (F.col("size") == F.col("_s")) & (F.col("own") == F.col("piece"))
    dealt = dealt.join(_meetings(blocks, threshold), meet).select("label", "size", "i", "j", "rep", "v", "own")
    found = over_groups(dealt, ("label", "size", "i", "j"), _spanning(threshold, window), "a long, b long")
    links = staged(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")

    named = components(links)
    sizes = staged(named.groupBy(F.col("component").alias("_c")).agg(F.count("*").alias("size")), "sizes")
    sized = named.join(sizes, F.col("component") == F.col("_c")).withColumn("_n", F.ceil(F.col("size") / block).cast("int"))
    sized = sized.withColumn("own", F.pmod(F.xxhash64("node"), F.col("_n")).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    blocks = sized.select("component", F.least("own", "_o").alias("i"), F.greatest("own", "_o").alias("j"), "node", "own")
    placed = staged(blocks, "blocks").join(classes.select("rep", "c", "v"), F.col("node") == F.col("rep")).drop("node")
    counted = over_groups(placed, ("component", "i", "j"), _counted(threshold), "rep long, n long")
    more = counted.groupBy(F.col("rep").alias("_r")).agg(F.sum("n").alias("n"))

    about = classes.select(F.col("label").alias("_l"), F.col("k").alias("_k"), "rep", "c").join(more, F.col("rep") == F.col("_r"), "left").drop("_r")
    about = staged(about.join(named, F.col("rep") == F.col("node"), "left"), "about")
    joined = rows.select("vec_id", "label", "k").join(about, (F.col("label") == F.col("_l")) & (F.col("k") == F.col("_k")), "left")
    with_id = F.col("vec_id").isNotNull()
    component = F.when(with_id, F.coalesce("component", "rep", "vec_id"))
    n = F.when(with_id & F.col("c").isNotNull(), F.col("c") - 1 + F.coalesce("n", F.lit(0))).otherwise(0)
    return joined.select("vec_id", n.cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def op6_sorted_projections(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(table(spark, folder, "embeddings"))


QUERIES = {"op6_sorted_projections": op6_sorted_projections}
