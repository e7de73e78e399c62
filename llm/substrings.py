"""Repeated substrings by suffix order and longest-previous-factor arrays.

A string of 200 bytes that occurs twice has its anchors in the same places both times: an anchor is
a 32-byte gram whose hash is the smallest of some 200-byte window that holds it. So only anchored
contexts meet: the 168 bytes before an anchor and the 200 from it on. Contexts that occur more than
once as a whole are settled by counting. Where one anchor has several contexts, they form a bucket:
its suffixes, cut at 200 bytes, are put in order, and the previous and next smaller positions in that
order give every suffix its longest match among the earlier and among the later ones. As only
matches of 200 bytes count, order among unequal suffixes is free, and they are ordered by hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import append_columns, emptied, over_slices, staged, table, utf8, values
from llm.near_copies import over_groups

LENGTH = 200
GRAM = 32
# Contexts of a bucket that one task puts in order. Suffixes of larger buckets are ordered by a shuffle.
BUCKET = 2000
# Parts a large bucket is cut into by distance to the anchor.
PARTS = 4

_RNG = np.random.default_rng(4)
_VALUE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SMALL = _RNG.integers(0, 1 << 32, 256, dtype=np.uint32)
_BASE = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, up to n."""
    with np.errstate(over="ignore"):
        while len(_POWERS[0]) <= n:
            size = len(_POWERS[0])
            for w, base in ((0, _BASE), (1, pow(_BASE, -1, 1 << 64))):
                _POWERS[w] = np.concatenate([_POWERS[w], _POWERS[w] * np.uint64(pow(base, size, 1 << 64))])
    return _POWERS[0], _POWERS[1]


class Hashes:
    """Hash of any substring from prefix sums of byte value x base^position, shifted to position 0."""

    def __init__(self, raw: np.ndarray):
        powers, self.inverse = _powers(len(raw))
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_VALUE[raw] * powers[: len(raw)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """`best` (minimum or maximum) of every `width` consecutive values, by doubling."""
    done = 1
    while done * 2 <= width:
        x = best(x[:-done], x[done:])
        done *= 2
    return best(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def anchors(raw: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """Positions whose gram hash is the smallest, ties included, of some window of `length` bytes.

    `gram` is a power of two: its hash doubles its reach five times for 32.
    """
    if len(raw) < length:
        return np.zeros(0, np.int64)
    h, step, factor = _SMALL[raw], 1, 0x01000193
    with np.errstate(over="ignore"):
        while step < gram:
            h = h[:-step] * np.uint32(factor) + h[step:]
            factor = factor * factor % (1 << 32)
            step *= 2
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        h = (h ^ (h >> np.uint32(12))) * np.uint32(0x297A2D39)
    width = length - gram + 1
    least = _sliding(h, width, np.minimum)
    # The largest of the minima of all windows that hold a position.
    pad = np.zeros(width - 1, np.uint32)
    around = _sliding(np.concatenate([pad, least, pad]), width, np.maximum)
    return np.flatnonzero(h == around)


def _anchored(length: int, gram: int):
    def make(batch: pa.RecordBatch) -> dict:
        out: dict = {"row": [], "core": [], "hull": [], "pos": []}
        for row, text in zip(values(batch, "row"), utf8(batch, "text"), strict=True):
            raw = np.frombuffer(text or b"", np.uint8)
            if len(raw) < length:
                continue
            p, hashes = anchors(raw, length, gram), Hashes(raw)
            start, end = np.maximum(0, p - (length - gram)), np.minimum(len(raw), p + length)
            with np.errstate(over="ignore"):
                hull = mixed(hashes.of(start, end) + (p - start).astype(np.uint64) * np.uint64(_BASE))
            out["row"].append(np.full(len(p), row))
            out["core"].append(hashes.of(p, p + gram).view(np.int64))
            out["hull"].append(hull.view(np.int64))
            out["pos"].append(p.astype(np.int32))
        return {k: np.concatenate(v) if v else [] for k, v in out.items()}

    return make


def _contexts(length: int, gram: int):
    """The bytes around the chosen anchors of a text, with where they begin."""

    def make(batch: pa.RecordBatch) -> dict:
        out: dict = {k: [] for k in ("core", "row", "start", "left", "c", "nh", "raw")}
        for row, text, chosen in zip(values(batch, "row"), utf8(batch, "text"), values(batch, "chosen"), strict=True):
            for x in chosen:
                start = max(0, x["pos"] - (length - gram))
                for k, v in (("core", x["core"]), ("row", row), ("start", start), ("left", x["pos"] - start), ("c", x["c"]), ("nh", x["nh"]), ("raw", text[start : x["pos"] + length])):
                    out[k].append(v)
        return out

    return make


def suffix_ranks(raws: list[bytes], lefts: list[int], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context, distance to its anchor and rank of every suffix with `length` bytes that covers its anchor."""
    text = np.frombuffer(b"".join(raws), np.uint8)
    sizes, left = np.array([len(r) for r in raws]), np.array(lefts)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    n = np.maximum(0, np.minimum(left, sizes - length) + 1)
    which = np.repeat(np.arange(len(raws)), n)
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = first[which] + offset
    return which, left[which] - offset, Hashes(text).of(at, at + length)


def matches(which: np.ndarray, distance: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each suffix has a match of full length among earlier and among later contexts.

    Suffixes are ordered by distance, rank and position. In that order the previous smaller position
    of a suffix, as far as its longest earlier match reaches full length, is its neighbour before,
    and the next one its neighbour after, if the neighbour has the same rank.
    """
    order = np.lexsort((which, rank, distance))
    same = (rank[order][1:] == rank[order][:-1]) & (distance[order][1:] == distance[order][:-1])
    earlier, later = np.zeros(len(which), bool), np.zeros(len(which), bool)
    earlier[order[1:]] = same
    later[order[:-1]] = same
    return earlier, later


def _spans(row: int, start: int, offsets: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """Runs of consecutive matched starts as byte ranges of a row."""
    cuts = np.flatnonzero(np.diff(offsets) > 1)
    firsts, lasts = offsets[np.concatenate([[0], cuts + 1])], offsets[np.concatenate([cuts, [len(offsets) - 1]])]
    return [(row, start + int(a), start + int(b) + length) for a, b in zip(firsts, lasts, strict=True)]


def _ordered(length: int):
    """Repeated ranges of the contexts of one bucket that occur once."""

    def make(group: dict) -> list[tuple]:
        which, distance, rank = suffix_ranks(group["raw"], group["left"], length)
        earlier, later = matches(which, distance, rank)
        hit, out = earlier | later, []
        offset = np.array(group["left"])[which] - distance
        ends = np.searchsorted(which, np.arange(len(group["c"]) + 1))
        for i, c in enumerate(group["c"]):
            own = slice(ends[i], ends[i + 1])
            if c == 1 and hit[own].any():
                out += _spans(group["row"][i], group["start"][i], offset[own][hit[own]], length)
        return out

    return make


def _distances(part: int, length: int, gram: int) -> tuple[int, int]:
    """Distances to the anchor, first and last, of one of PARTS parts of a bucket's suffixes."""
    width = length - gram + 1
    return part * width // PARTS, (part + 1) * width // PARTS - 1


def _parts(length: int, gram: int):
    """For each context and part: hashes of the bytes all its suffixes share, and of those any has."""

    def make(batch: pa.RecordBatch) -> dict:
        raws = values(batch, "raw")
        hashes = Hashes(np.frombuffer(b"".join(raws), np.uint8))
        sizes = np.array([len(r) for r in raws], np.int64)
        first = np.cumsum(sizes) - sizes
        get = {c: np.array(values(batch, c), np.int64) for c in ("row", "start", "left", "c")}
        out: dict = {k: [] for k in ("core", "hull", "part", "row", "start", "left", "c", "begin", "end")}
        for part in range(PARTS):
            near, far = _distances(part, length, gram)
            low, high = np.maximum(near, get["left"] + length - sizes), np.minimum(far, get["left"])
            ok = np.flatnonzero(low <= high)
            anchor = (first + get["left"])[ok]
            with np.errstate(over="ignore"):
                core = mixed(hashes.of(anchor - near, anchor + length - far) + np.uint64(part + 1))
                seen = (high[ok] * 1024 + low[ok]).astype(np.uint64)
                hull = mixed(hashes.of(anchor - high[ok], anchor - low[ok] + length) + seen * np.uint64(_BASE))
            at = get["start"][ok] + get["left"][ok]
            for k, v in (("core", core.view(np.int64)), ("hull", hull.view(np.int64)), ("part", np.full(len(ok), part)), ("begin", at - high[ok]), ("end", at - low[ok] + length)):
                out[k].append(v)
            for k in ("row", "start", "left", "c"):
                out[k].append(get[k][ok])
        return {k: np.concatenate(v) for k, v in out.items()}

    return make


def _suffix_rows(length: int, gram: int):
    """Suffixes of the asked part of each context, with their ranks."""

    def make(batch: pa.RecordBatch) -> dict:
        which, distance, rank = suffix_ranks(values(batch, "raw"), values(batch, "left"), length)
        bounds = [_distances(x, length, gram) for x in values(batch, "part")]
        near, far = np.array([x[0] for x in bounds], np.int64), np.array([x[1] for x in bounds], np.int64)
        ok = (distance >= near[which]) & (distance <= far[which]) if len(which) else np.zeros(0, bool)
        which, distance, rank = which[ok], distance[ok], rank[ok]
        get = lambda c: np.array(values(batch, c), np.int64)[which]
        return {"core": get("core"), "distance": distance.astype(np.int32), "rank": rank.view(np.int64), "row": get("row"), "begin": get("start") + get("left") - distance, "c": get("c")}

    return make


def _large_buckets(contexts: DataFrame, length: int, gram: int) -> DataFrame:
    """Repeated ranges of contexts of large buckets, by longer cores and then by shuffled suffixes.

    A bucket's suffixes are cut into parts by distance. All suffixes of a part share more than the
    anchor: contexts that differ there have no match in it, and parts that occur twice as a whole are
    settled by counting. What is left goes to the shuffle suffix by suffix, and equal suffixes are
    counted there, so no task holds a bucket.
    """
    parts = over_slices(contexts, _parts(length, gram), "core long, hull long, part int, row long, start int, left int, c long, begin int, end int", rows=2048)
    parts = staged(parts, "parts")
    hulls = staged(parts.groupBy("core", "hull").agg(F.sum("c").alias("n"), F.min(F.struct("row", "start", "left", "part")).alias("at")), "part_hulls")
    cores = hulls.groupBy(F.col("core").alias("_core")).agg(F.count("*").alias("nh"), F.min("n").alias("least"))
    cores = staged(cores.where("nh > 1 and least = 1").select("_core"), "part_cores")
    twice = hulls.where("n > 1").select(F.col("core").alias("_core"), F.col("hull").alias("_hull"))
    whole = parts.where("c = 1").join(twice, (F.col("core") == F.col("_core")) & (F.col("hull") == F.col("_hull"))).select("row", F.col("begin").alias("start"), "end")

    open_hulls = hulls.join(cores, F.col("core") == F.col("_core")).select("core", F.col("n").alias("c"), "at.*")
    raw = contexts.select(F.col("row").alias("_row"), F.col("start").alias("_start"), F.col("left").alias("_left"), "raw")
    asked = open_hulls.join(raw, (F.col("row") == F.col("_row")) & (F.col("start") == F.col("_start")) & (F.col("left") == F.col("_left")))
    suffixes = over_slices(asked.select("core", "c", "row", "start", "left", "part", "raw"), _suffix_rows(length, gram), "core long, distance int, rank long, row long, begin int, c long")
    suffixes = staged(suffixes, "suffixes")
    same = suffixes.groupBy(F.col("core").alias("_c"), F.col("distance").alias("_d"), F.col("rank").alias("_r")).agg(F.count("*").alias("n")).where("n > 1")
    big = suffixes.where("c = 1").join(staged(same, "same"), (F.col("core") == F.col("_c")) & (F.col("distance") == F.col("_d")) & (F.col("rank") == F.col("_r")))
    return whole.unionByName(big.select("row", F.col("begin").alias("start"), (F.col("begin") + length).alias("end")))


def repeated_ranges(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, bucket: int = BUCKET) -> DataFrame:
    """(row, start, end): byte ranges covered by strings of `length` bytes that start elsewhere too.

    `docs` has (row, text), one row number per row. Ranges may overlap. Texts are compared by 64-bit
    hashes of windows that share a hash of their anchor as well.
    """
    a = staged(over_slices(docs, _anchored(length, gram), "row long, core long, hull long, pos int"), "anchors")
    hulls = staged(a.groupBy("core", "hull").agg(F.count("*").alias("c")), "hulls")
    cores = hulls.groupBy(F.col("core").alias("_core")).agg(F.count("*").alias("nh"), F.sum("c").alias("total"), F.min("c").alias("least"))
    shared = staged(cores.where("total > 1").select("_core", "nh", (F.col("nh") > 1).alias("many"), F.col("least")), "cores")
    kinds = hulls.join(shared, F.col("core") == F.col("_core"))
    # Contexts that repeat whole, and those of anchors where some context does not.
    kinds = kinds.select(F.col("core").alias("_core"), F.col("hull").alias("_hull"), "c", "nh", (F.col("many") & (F.col("least") == 1)).alias("open"))
    kinds = staged(kinds.where("c > 1 or open"), "kinds")
    found = a.join(kinds, (F.col("core") == F.col("_core")) & (F.col("hull") == F.col("_hull"))).drop("_core", "_hull")
    found = staged(found, "found")
    for done in (a, hulls, shared, kinds):
        emptied(done)
    whole = found.where("c > 1").select("row", F.greatest(F.lit(0), F.col("pos") - (length - gram)).alias("start"), (F.col("pos") + length).alias("end"))

    one = found.where("open").groupBy("core", "hull").agg(F.min(F.struct("row", "pos")).alias("at"), F.first("c").alias("c"), F.first("nh").alias("nh"))
    lists = one.groupBy(F.col("at.row").alias("_row")).agg(F.collect_list(F.struct("core", F.col("at.pos").alias("pos"), "c", "nh")).alias("chosen"))
    # Rows alike in all columns share a number; their text is read once.
    texts = docs.join(staged(lists, "chosen"), F.col("row") == F.col("_row")).drop("_row")
    contexts = over_slices(texts, _contexts(length, gram), "core long, row long, start int, left int, c long, nh long, raw binary")
    contexts = staged(contexts, "contexts")
    ordered = over_groups(contexts.where(F.col("nh") <= bucket).drop("nh"), ("core",), _ordered(length), "row long, start int, end int")

    large = _large_buckets(contexts.where(F.col("nh") > bucket).drop("nh"), length, gram)
    return whole.unionByName(ordered).unionByName(large)


def _removed(text: bytes, spans: list[dict] | None) -> tuple[int, int, bytes]:
    """Bytes and maximal runs that ranges cover, and what is left."""
    if not spans:
        return 0, 0, text
    runs: list[list[int]] = []
    for a, b in sorted((x["start"], min(x["end"], len(text))) for x in spans):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    kept, at = [], 0
    for a, b in runs:
        kept.append(text[at:a])
        at = b
    return sum(b - a for a, b in runs), len(runs), b"".join([*kept, text[at:]])


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) per row; `kept` is what is left, as bytes.

    Every byte covered by a repeated string goes, at all places where it occurs. A null text counts as
    empty; texts shorter than the length lose nothing. Equal rows are copies of each other and lose
    the same. An empty table gives no rows.
    """
    base = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    base = base.withColumn("row", F.xxhash64("doc_id", "text"))
    ranges = repeated_ranges(base.select("row", "text"), **options)
    lists = ranges.groupBy(F.col("row").alias("_row")).agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    joined = base.join(staged(lists, "ranges"), F.col("row") == F.col("_row"), "left").drop("row", "_row")

    def make(batch: pa.RecordBatch) -> dict:
        n, gone, runs, left = [], [], [], []
        for raw, spans in zip(utf8(batch, "text"), values(batch, "spans"), strict=True):
            g, r, kept = _removed(raw, spans)
            n.append(len(raw))
            gone.append(g)
            runs.append(r)
            left.append(kept)
        return {"n_bytes": n, "n_removed": gone, "n_spans": runs, "kept": left}

    return append_columns(joined, make, "n_bytes long, n_removed long, n_spans long, kept binary").drop("text", "spans")


def op4_suffix_order(spark: SparkSession, folder: str) -> DataFrame:
    out = remove_repeats(table(spark, folder, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op4_suffix_order": op4_suffix_order}
