"""Periodic runs of words: Lyndon arrays by Baier's grouping, roots extended by common extensions.

The first phase of Baier's suffix sorter groups the suffixes of a text by the longest Lyndon word that
starts there, so the length of a group's context is the Lyndon array; it is run under both orders of
the words. Every run has a root that is such a longest Lyndon word under one of the two, hence all
positions' words are extended to both sides by longest common extensions, which are exact: they are
read from ranks of blocks of 1, 2, 4, ... words.

A run of at least `least` words and `repeats` periods repeats each of its blocks of some words (eight,
with 24 words and three periods) a period away. Stretches of a text without any repeated block hold no
run and are left out before grouping; this is a necessary condition, not a sample, and loses nothing.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import append_columns, over_slices, table, utf8, values

LEAST = 24
REPEATS = 3
# Words whose block ranks are held at a time; one longer stretch is held alone.
HELD_WORDS = 1 << 18

FOUND = "array<struct<start: long, length: long, period: long>>"


def lyndon_array(text: list[int], letters: int) -> list[int]:
    """Length of the longest Lyndon word at each position of a text over 0..letters-1.

    Groups lie in a linked list in ascending order and are taken from the highest down. Each member
    points to the nearest position before it in a lower group; positions that get equally many
    pointers out of one old group move together into a new group right above it, whose context is
    the old one followed by as many copies of the current one.
    """
    n = len(text)
    group, before = list(text), list(range(-1, n - 1))
    members: list[list[int]] = [[] for _ in range(letters)]
    for i, c in enumerate(text):
        members[c].append(i)
    size = [1] * letters
    lower, higher = list(range(-1, letters - 1)), [*range(1, letters), -1]
    out, done = [0] * n, bytearray(n)
    g = letters - 1
    while g >= 0:
        length = size[g]
        own = [i for i in members[g] if group[i] == g and not done[i]]
        for i in own:
            done[i] = 1
            out[i] = length
        pointers: dict[int, int] = {}
        for i in sorted(own):
            p, trail = before[i], []
            while p >= 0 and done[p]:
                trail.append(p)
                p = before[p]
            before[i] = p
            for t in trail:
                before[t] = p
            if p >= 0:
                pointers[p] = pointers.get(p, 0) + 1
        if pointers:
            moves: dict[tuple[int, int], list[int]] = {}
            for p, times in pointers.items():
                moves.setdefault((times, group[p]), []).append(p)
            # More copies lie higher, so they are placed first and fewer ones go between.
            for times, old in sorted(moves, reverse=True):
                new = len(size)
                rows = moves[times, old]
                for p in rows:
                    group[p] = new
                members.append(rows)
                size.append(size[old] + times * length)
                up = higher[old]
                lower.append(old)
                higher.append(up)
                higher[old] = new
                if up >= 0:
                    lower[up] = new
        members[g] = []
        g = lower[g]
    return out


class Extensions:
    """Longest common extensions to the right and to the left, for arrays of positions at once."""

    def __init__(self, text: np.ndarray, longest: int):
        self.n = len(text)
        self.ranks = [text.astype(np.int64)]
        step = 1
        while 2 * step <= longest:
            last = self.ranks[-1]
            key = (last[:-step] << 32) | last[step:]
            code = pa.array(key).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            self.ranks.append(code)
            step *= 2

    def right(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal words from i and j on."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            rank, far = self.ranks[k], np.maximum(i, j) + out
            ok = far < len(rank)
            at = np.flatnonzero(ok)
            same = rank[i[at] + out[at]] == rank[j[at] + out[at]]
            out[at[same]] += 1 << k
        return out

    def left(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal words up to and including i and j, backwards."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            rank, near = self.ranks[k], np.minimum(i, j) - out - (1 << k) + 1
            at = np.flatnonzero(near >= 0)
            same = rank[i[at] - out[at] - (1 << k) + 1] == rank[j[at] - out[at] - (1 << k) + 1]
            out[at[same]] += 1 << k
        return out


def block_words(least: int, repeats: int) -> int:
    """Words of a block that every such run repeats one period away, wherever in the run it starts.

    A block that starts before the first period's end has its copy a period later, if that still
    fits: 2 * period - 1 + block <= length, for every period.
    """
    return max(1, min(max(least, repeats * q) - 2 * q + 1 for q in range(1, least + 1)))


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def stretches(ids: np.ndarray, doc: np.ndarray, least: int, repeats: int) -> list[tuple[int, int]]:
    """(start, end) of the parts of texts in which every block occurs at least twice in its text.

    Blocks are compared by a hash; a collision makes a stretch longer and loses none.
    """
    block = block_words(least, repeats)
    n = len(ids) - block + 1
    if n <= 0 or len(ids) < least:
        return []
    with np.errstate(over="ignore"):
        # A block of any length out of two blocks of the power of two below it.
        h, width = _mixed(ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), 1
        while 2 * width <= block:
            h = _mixed(h[:-width] * np.uint64(3) + h[width:])
            width *= 2
        if width < block:
            h = _mixed(h[: -(block - width)] * np.uint64(5) + h[block - width :])
        h = _mixed(h[:n] + doc[:n].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    inside = doc[:n] == doc[block - 1 :]
    codes = pa.array(h).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    marked = (np.bincount(codes[inside], minlength=codes.max() + 1)[codes] > 1) & inside
    # Consecutive blocks belong together only within one text.
    joined = marked[1:] & marked[:-1] & (doc[1:n] == doc[: n - 1])
    starts = np.flatnonzero(marked & np.concatenate([[True], ~joined]))
    ends = np.flatnonzero(marked & np.concatenate([~joined, [True]]))
    return [(s, e + block) for s, e in zip(starts.tolist(), ends.tolist(), strict=True) if e + block - s >= least]


def runs_of(parts: list[np.ndarray], least: int = LEAST, repeats: int = REPEATS) -> list[tuple[int, int, int, int]]:
    """(part, start, length, period) of every run of the parts, each a text of its own."""
    if not parts:
        return []
    offsets = np.cumsum([0, *(len(p) + 1 for p in parts)])
    whole = np.empty(offsets[-1], np.int64)
    i_all, p_all = [], []
    top = max(int(p.max()) for p in parts) + 1
    for number, (part, offset) in enumerate(zip(parts, offsets[:-1].tolist(), strict=True)):
        whole[offset : offset + len(part)] = part
        # A word of its own after each part stops every extension.
        whole[offset + len(part)] = top + number
        used, dense = np.unique(part, return_inverse=True)
        letters = len(used)
        lengths = {tuple(x) for order in (dense, letters - 1 - dense) for x in enumerate(lyndon_array(order.tolist(), letters))}
        both = np.array(sorted(lengths), np.int64)
        i_all.append(both[:, 0] + offset)
        p_all.append(both[:, 1])
    i, p = np.concatenate(i_all), np.concatenate(p_all)
    ext = Extensions(whole, max(map(len, parts)))
    # A position and the one a period later: both ends grow while words agree. The separator that
    # ends a part differs from all other words, so no extension leaves it.
    right = ext.right(i, i + p)
    left = ext.left(i - 1, i + p - 1)
    length = left + p + right
    ok = (length >= least) & (length >= repeats * p)
    found = np.unique(np.stack([i[ok] - left[ok], length[ok], p[ok]], axis=1), axis=0)
    part = np.searchsorted(offsets, found[:, 0], side="right") - 1
    return [(int(k), int(s - offsets[k]), int(n), int(q)) for k, (s, n, q) in zip(part, found.tolist(), strict=True)]


def find_runs(texts: list[list[bytes]], least: int = LEAST, repeats: int = REPEATS) -> list[list[tuple[int, int, int]]]:
    """Per text (a list of words) its runs as (start, length, period), by start, then period."""
    if least < 1 or repeats < 2:
        raise ValueError("a run has at least one word and two periods")
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    sizes = [len(t) for t in texts]
    if not sum(sizes):
        return out
    ids = pa.array([w for t in texts for w in t], pa.large_binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(texts)), sizes)
    first = np.cumsum([0, *sizes])

    def settle(held: list[tuple[int, int]]) -> None:
        for k, start, length, period in runs_of([ids[a:b] for a, b in held], least, repeats):
            d = int(doc[held[k][0]])
            out[d].append((held[k][0] - int(first[d]) + start, length, period))

    held, words = [], 0
    for a, b in stretches(ids, doc, least, repeats):
        if held and words + b - a > HELD_WORDS:
            settle(held)
            held, words = [], 0
        held.append((a, b))
        words += b - a
    settle(held)
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def best_run(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length / period, compared exactly; ties go to the first in order."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words that no run contains after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    covered = np.cumsum(change)
    return [w for w, c in zip(words, covered.tolist(), strict=False) if not c]


def _words(batch: pa.RecordBatch, text: str) -> list[list[bytes]]:
    return [raw.split() if raw else [] for raw in utf8(batch, text)]


def periodic_runs(docs: DataFrame, text: str = "text", least: int = LEAST, repeats: int = REPEATS, runs: str = "runs") -> DataFrame:
    """`docs` with the runs of the whole text, an array of (start, length, period) in words from 0.

    Words are cut at ASCII white space. A null or empty text has no runs; repeated rows are searched
    each; an empty table stays empty. A text of n words, however long, is searched whole in memory
    that grows as n log n. Raises when `docs` has a column named as `runs`.
    """
    if runs.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the table has a column {runs} already; name another by runs=")

    def make(batch: pa.RecordBatch) -> dict:
        found = find_runs(_words(batch, text), least, repeats)
        return {runs: [[{"start": s, "length": n, "period": q} for s, n, q in own] for own in found]}

    return append_columns(docs, make, f"`{runs}` {FOUND}", rows=64)


def collapse(docs: DataFrame, text: str = "text", runs: str = "runs") -> DataFrame:
    """`docs` with each run of `text` cut to its first period; words are then joined by one space.

    A null text stays null, and a text without runs stays as it is. `runs` comes from `periodic_runs`.
    """

    def make(batch: pa.RecordBatch) -> dict:
        out = []
        for raw, own in zip(utf8(batch, text), values(batch, runs), strict=True):
            if raw and own:
                raw = b" ".join(kept_words(raw.split(), [(r["start"], r["length"], r["period"]) for r in own]))
            out.append(None if raw is None else raw.decode())
        return {"_collapsed": out}

    with_text = append_columns(docs, make, "_collapsed string", rows=64)
    return with_text.select(*[F.col("_collapsed").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])


def repeated_tail(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """Words of which a tail, chosen by the id, is one passage over and over; unchanged for nine ids in ten."""
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    times = -(-(n - a) // p)
    return words[:a] + (words[a : a + p] * times)[: n - a]


def with_repeated_tails(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text): the words of each text, joined by one space, with `repeated_tail`. A null text is empty."""

    def make(batch: pa.RecordBatch) -> dict:
        ids = values(batch, key)
        return {key: batch.column(0), text: [b" ".join(repeated_tail(w, i)).decode() for w, i in zip(_words(batch, text), ids, strict=True)]}

    kind = docs.schema[key].dataType.simpleString()
    return over_slices(docs.select(key, text), make, f"{key} {kind}, {text} string", rows=64)


DIGEST = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def digests(found: DataFrame, key: str = "doc_id", text: str = "text", runs: str = "runs") -> DataFrame:
    """Per row of `periodic_runs`: number of runs, the run of most periods, and digests of all runs and of the collapsed text."""

    def make(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {c.split()[0]: [] for c in DIGEST.split(", ")}
        for words, listed in zip(_words(batch, text), values(batch, runs), strict=True):
            own = [(r["start"], r["length"], r["period"]) for r in listed]
            start, length, period = best_run(own) or (None, None, None)
            out["n_runs"].append(len(own))
            out["start"].append(start)
            out["length"].append(length)
            out["period"].append(period)
            out["exponent_milli"].append(1000 * length // period if own else None)
            out["runs_sha256"].append(hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in own).encode()).hexdigest())
            out["collapsed_sha256"].append(hashlib.sha256(b" ".join(kept_words(words, own))).hexdigest())
        return {key: batch.column(0)} | out

    kind = found.schema[key].dataType.simpleString()
    return over_slices(found.select(key, text, runs), make, f"{key} {kind}, {DIGEST}", rows=64)


def op13_baier_runs(spark: SparkSession, folder: str) -> DataFrame:
    return digests(periodic_runs(with_repeated_tails(table(spark, folder, "documents").select("doc_id", "text"))))


QUERIES = {"op13_baier_runs": op13_baier_runs}
