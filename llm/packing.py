"""Packing of token sequences as vector bin packing with the dot-product heuristic.

A sequence has three capacities: tokens, segments and loss-bearing tokens. The open sequence takes,
of all pieces that fit, the one whose demand has the largest dot product with what is left of the
capacities (each in units of its capacity). Texts longer than a sequence are cut into whole
sequences first; when nothing fits into a larger gap, a piece is cut to fill it. Each task packs the rows
of its own partition from a pool of bounded size, so nothing is shuffled.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import slices, table, utf8, values

CAPACITY = 2048
MAX_SEGMENTS = 256
# Pieces a task holds while it packs; every one is placed sooner or later.
POOL = 4096
# Gaps of at least so many tokens are filled by cutting a piece.
CUT_GAP = 8
END_ID = 1
# Words whose ids a task remembers; beyond it the memory starts anew.
MEMORY_WORDS = 600_000

PIECES = "doc_id {key}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long, segments long, loss_tokens long"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# Letters whose case and form need no further normalisation: a-z and the lower case of Latin-1.
LETTERS = re.compile("[a-zß-öø-ÿ]+")


def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it is printable."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordIds(dict):
    """Ids of whole texts as little-endian bytes, by words at ASCII white space.

    The tokenizer drops white space and never joins characters across it, so the ids of a text are
    the ids of its words in order; each distinct word is encoded once while it is remembered. A run
    of letters is one unit of the merges, and so is a single mark after it.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.shown = _byte_letters()

    def __missing__(self, word: bytes) -> bytes:
        stem, mark = (word[:-1], word[-1:]) if len(word) > 1 and word[-1:] in (b".", b",") else (word, b"")
        letters = stem.decode().lower()
        if not LETTERS.fullmatch(letters):
            ids = self.tokenizer.encode(word.decode(), add_special_tokens=False).ids
            out = np.array(ids, "<u4").tobytes()
        elif mark:
            out = self[stem] + self[mark]
        else:
            units = letters if letters.isascii() else "".join(map(self.shown.__getitem__, letters.encode()))
            out = np.array([t.id for t in self.model.tokenize(units)], "<u4").tobytes()
        self[word] = out
        return out

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        if len(self) > MEMORY_WORDS:
            self.clear()
        out = []
        for t in texts:
            # Lower case in A-Z is what the tokenizer does first; its special tokens are case-sensitive.
            words = (t if b"<|" in t else t.lower()).split() if t else []
            out.append(b"".join(map(self.__getitem__, words)))
        return out


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """The memory of words of a worker process, which the tasks it runs one after the other share."""
    return WordIds(path)


class Packer:
    """Places pieces (row, start, length, loss per token or none) into sequences of one task."""

    def __init__(self, capacity: int = CAPACITY, max_segments: int = MAX_SEGMENTS, max_loss: int | None = None, cut_gap: int = CUT_GAP):
        self.limits = np.array([capacity, max_segments, capacity if max_loss is None else max_loss], np.float64)
        self.capacity, self.cut_gap = capacity, cut_gap
        self.rows: list[list] = []  # row, start, length, has loss
        self.n = 0

    def add(self, row, length: int, loss: bool = True) -> Iterator[tuple]:
        """Whole sequences of a long row at once; the rest waits in the pool."""
        start, step = 0, int(min(self.limits[0], self.limits[2] if loss else self.limits[0]))
        while length - start >= step:
            yield from self._closed([[row, start, step, loss]])
            start += step
        if length > start:
            self.rows.append([row, start, length - start, loss])

    def _closed(self, members: list[list]) -> Iterator[tuple]:
        offset = 0
        for row, start, length, loss in members:
            yield row, start, length, self.n, offset, loss
            offset += length
        self.n += 1

    def pack(self, final: bool = False) -> Iterator[tuple]:
        """Sequences out of the pool; unless final, the last, partly filled ones stay in it."""
        # Of pieces alike in bearing loss, the dot product is largest for the longest that fits: sorted
        # by length, the earliest last among equals, it is found by bisection.
        sides: dict[bool, list[tuple]] = {True: [], False: []}
        for i, (row, start, length, loss) in enumerate(sorted(self.rows, key=lambda p: -p[2])):
            sides[bool(loss)].append((length, -i, row, start))
        for side in sides.values():
            side.sort()
        waiting, self.rows = len(self.rows), []
        most, segments, bearing = (int(x) for x in self.limits)
        while waiting:
            left, places, lossy, members = most, segments, bearing, []
            while waiting and places:
                best = None
                for loss, side in sides.items():
                    at = bisect_left(side, (min(left, lossy) + 1 if loss else left + 1,)) - 1
                    if at >= 0:
                        length, order = side[at][:2]
                        dot = length / most * (left / most) + places / segments / segments + (length / bearing * (lossy / bearing) if loss else 0.0)
                        if best is None or (dot, order) > best[:2]:
                            best = (dot, order, loss, at)
                if best is not None:
                    loss, (length, _, row, start) = best[2], sides[best[2]].pop(best[3])
                    waiting -= 1
                    members.append([row, start, length, loss])
                    left, places, lossy = left - length, places - 1, lossy - (length if loss else 0)
                    continue
                # Nothing fits: the longest piece that can be cut fills the gap.
                for length, order, loss in sorted(((side[-1][0], side[-1][1], loss) for loss, side in sides.items() if side), reverse=True):
                    part = min(left, lossy) if loss else left
                    if left >= self.cut_gap and self.cut_gap <= part < length:
                        _, _, row, start = sides[loss].pop()
                        insort(sides[loss], (length - part, order, row, start + part))
                        members.append([row, start, part, loss])
                        break
                break
            used = sum(m[2] for m in members)
            if used >= self.capacity - self.cut_gap or not members:
                yield from self._closed(members)
            elif waiting or final:
                # Another limit closed it, or nothing more will come.
                yield from self._powers(members)
            else:
                self.rows += members

    def _powers(self, members: list[list]) -> Iterator[tuple]:
        """A sequence that stays partly filled, cut into sequences of powers of two, which need no padding."""
        used = sum(m[2] for m in members)
        queue = [list(m) for m in members]
        while used:
            want = 1 << (used.bit_length() - 1)
            used -= want
            taken = []
            while want:
                row, start, length, loss = queue[0]
                part = min(length, want)
                taken.append([row, start, part, loss])
                want -= part
                if part == length:
                    queue.pop(0)
                else:
                    queue[0] = [row, start + part, length - part, loss]
            yield from self._closed(taken)


def pack_texts(
    docs: DataFrame, key: str = "doc_id", text: str = "text", loss: str | None = None, path: str | None = None, capacity: int = CAPACITY,
    max_segments: int = MAX_SEGMENTS, max_loss: int | None = None, cut_gap: int = CUT_GAP, pool: int = POOL,
) -> DataFrame:
    """One row per piece: its place in its text, its checksum and its place in its sequence.

    `loss` names a boolean column: whether a row's tokens bear loss (all do without it; null: none).
    A null or empty text is its end id alone; repeated rows are packed each; an empty table gives no
    rows. Sequence ids are unique; offsets of a sequence have no gaps. No sequence exceeds any limit.
    """
    chosen = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), (F.coalesce(F.col(loss), F.lit(False)) if loss else F.lit(True)).alias("loss"))
    schema = PIECES.format(key=docs.schema[key].dataType.simpleString())
    path = path or tokenizer_path()
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    loss_limit = capacity if max_loss is None else max_loss
    if min(capacity, max_segments, loss_limit) < 1:
        raise ValueError("capacities must be at least 1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer = word_ids(path), Packer(capacity, max_segments, loss_limit, cut_gap)
        first = TaskContext.get().partitionId() << 40
        held: dict[int, tuple] = {}
        out: list[tuple] = []
        row = 0

        def flush() -> pa.RecordBatch:
            # Totals of a sequence, over its pieces; sequences are never cut between flushes.
            count, sums, lines = {}, {}, []
            for r, start, length, seq, offset, bears in out:
                count[seq] = count.get(seq, 0) + 1
                sums[seq] = sums.get(seq, 0) + (length if bears else 0)
            for r, start, length, seq, offset, bears in out:
                name, ids = held[r][:2]
                lines.append((name, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), len(ids) // 4, first + seq, offset, count[seq], sums[seq]))
            out.clear()
            waiting = {p[0] for p in packer.rows}
            for r in [r for r in held if r not in waiting]:
                del held[r]
            columns = list(zip(*lines, strict=True)) if lines else [[] for _ in arrow]
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        for part in slices(batches):
            for name, ids, bears in zip(values(part, "doc_id"), words.encode(utf8(part, "text")), values(part, "loss"), strict=True):
                ids += END_ID.to_bytes(4, "little")
                held[row] = (name, ids)
                out += packer.add(row, len(ids) // 4, bears)
                row += 1
            if len(packer.rows) >= pool:
                out += packer.pack()
                yield flush()
            elif len(out) >= pool:
                yield flush()
        out += packer.pack(final=True)
        yield flush()

    return chosen.mapInArrow(run, schema)


def op8_dot_product(spark: SparkSession, folder: str) -> DataFrame:
    return pack_texts(table(spark, folder, "documents"))


QUERIES = {"op8_dot_product": op8_dot_product}
