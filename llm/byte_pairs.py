"""Byte-level BPE encoding and decoding with contiguous rank arrays.

A text is cut at added tokens and then into words, and each word is encoded once while it is
remembered. The part boundaries of a short word, their ids and the ranks of adjacent pairs lie in
contiguous arrays: the least rank is found by a scan, its boundary is deleted, and the two neighbouring
ranks are refreshed. New words of a group of texts are merged together, words of one length as the rows of
one matrix, so that a step of the scan is one numpy operation over all of them. A scan per merge is
quadratic, so words of more than `SHORT` bytes are merged by a heap over the same ranks.
"""

from __future__ import annotations

import heapq
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import append_columns, over_slices, table, values

# Bytes a word may have to be merged by scans.
SHORT = 256
# Words whose ids a task remembers; beyond it the memory starts anew.
MEMORY_WORDS = 400_000
# Characters of text that are cut into words at a time; one longer text is cut alone.
HELD_CHARS = 1_000_000
NO_PAIR = 1 << 60

# White space as the splitting pattern means it (Unicode White_Space).
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECE = re.compile(f" ?[^{SPACES}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
# Below U+0250 letters and numbers are few enough to state: there the splitting pattern is this one.
LATIN_END = "\u0250"
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
LATIN = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^\t-\r \x85\xa0{LETTERS}{NUMBERS}]+"
    "|[\t-\r \x85\xa0]+(?![^\t-\r \x85\xa0])|[\t-\r \x85\xa0]+"
)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it is printable."""
    out, hidden = [], 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            out.append(chr(b))
        else:
            out.append(chr(256 + hidden))
            hidden += 1
    return out


class BytePairs:
    """Encoder and decoder of one vocabulary file; byte-level, without normaliser, dropout or affixes."""

    def __init__(self, path: str, short: int = SHORT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"]
        if spec.get("normalizer") or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split.get("use_regex", True):
            raise ValueError("only plain byte-level vocabularies are supported")
        if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            raise ValueError("dropout, affixes, unknown tokens and byte fallback are not supported")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens must match as they are")
        self.short = short
        # The library's own splitter, so that letters and digits are those of its Unicode tables.
        self.split = Tokenizer.from_file(path).pre_tokenizer
        vocab = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        self.letter = [vocab[c] for c in byte_letters()]
        self.size = 1 + max([*vocab.values(), *self.added.values()])
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank.setdefault(vocab[a] * self.size + vocab[b], r)
            self.merged.append(vocab[a + b])
        self.bytes: dict[int, bytes] = {}
        for token, i in [*vocab.items(), *self.added.items()]:
            own = [byte_of.get(c) for c in token]
            self.bytes[i] = token.encode() if None in own else bytes(own)
        self.table: pa.Array | None = None
        self.known: dict[str, bytes] = {}
        # The same ranks for arrays: all pairs in ascending order, and the first pairs by their two bytes.
        keys = np.fromiter(self.rank.keys(), np.int64, len(self.rank))
        ranks = np.fromiter(self.rank.values(), np.int64, len(self.rank))
        order = np.argsort(keys)
        self.keys, self.key_ranks = np.append(keys[order], NO_PAIR), np.append(ranks[order], NO_PAIR)
        self.new_ids = np.append(np.array(self.merged, np.int64), -1)
        self.letters = np.array(self.letter, np.int64)
        self.first_ranks = self._ranks(self.letters[:, None], self.letters[None, :])

    def scan(self, ids: list[int]) -> list[int]:
        """Ids of a short word: the array of ranks is scanned once per merge."""
        size, rank, merged = self.size, self.rank, self.merged
        ranks = [rank.get(a * size + b, NO_PAIR) for a, b in zip(ids, ids[1:])]
        while ranks:
            least = min(ranks)
            if least == NO_PAIR:
                break
            i = ranks.index(least)
            ids[i] = merged[least]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank.get(ids[i] * size + ids[i + 1], NO_PAIR)
            if i:
                ranks[i - 1] = rank.get(ids[i - 1] * size + ids[i], NO_PAIR)
        return ids

    def heap(self, ids: list[int]) -> list[int]:
        """The same merges for a long word, in n log n: the least rank, leftmost first."""
        n, size = len(ids), self.size
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(self.rank[k], i) for i in range(n - 1) if (k := ids[i] * size + ids[i + 1]) in self.rank]
        heapq.heapify(queue)
        while queue:
            r, i = heapq.heappop(queue)
            j = after[i]
            # An entry is stale when one of its parts has since been merged.
            if ids[i] < 0 or j >= n or self.rank.get(ids[i] * size + ids[j]) != r:
                continue
            ids[i], ids[j] = self.merged[r], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (k := self.rank.get(ids[i] * size + ids[after[i]])) is not None:
                    heapq.heappush(queue, (k, i))
            if before[i] >= 0 and (k := self.rank.get(ids[before[i]] * size + ids[i])) is not None:
                heapq.heappush(queue, (k, before[i]))
        return [x for x in ids if x >= 0]

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids; `NO_PAIR` where the two do not merge."""
        key = a * self.size + b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.key_ranks[at], NO_PAIR)

    def scan_all(self, words: np.ndarray) -> list[bytes]:
        """Ids of words of one length, a row of bytes each; all rows make a merge at every step."""
        ids = self.letters[words]
        ranks = self.first_ranks[words[:, :-1], words[:, 1:]]
        out: list[bytes] = [b""] * len(words)
        row = np.arange(len(words))
        while len(row):
            width = ids.shape[1]
            at = ranks.argmin(axis=1) if width > 1 else np.zeros(len(row), np.int64)
            least = ranks[np.arange(len(row)), at] if width > 1 else np.full(len(row), NO_PAIR)
            ended = least == NO_PAIR
            if ended.any():
                own = ids[ended].astype("<u4")
                for i, r in enumerate(row[ended].tolist()):
                    out[r] = own[i].tobytes()
                go = ~ended
                ids, ranks, row, at, least = ids[go], ranks[go], row[go], at[go], least[go]
                if not len(row):
                    break
            every = np.arange(len(row))
            ids[every, at] = self.new_ids[least]
            # One boundary fewer: what lies behind the merged pair moves one place to the front.
            place = np.arange(width - 1)[None, :]
            ids = np.take_along_axis(ids, place + (place > at[:, None]), axis=1)
            place = place[:, : width - 2]
            ranks = np.take_along_axis(ranks, place + (place >= at[:, None]), axis=1)
            right = np.flatnonzero(at < width - 2)
            ranks[right, at[right]] = self._ranks(ids[right, at[right]], ids[right, at[right] + 1])
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self._ranks(ids[left, at[left] - 1], ids[left, at[left]])
        return out

    def _learn(self, words: set[str]) -> None:
        of_length: dict[int, tuple[list[str], list[bytes]]] = {}
        for w in words:
            raw = w.encode()
            own = of_length.setdefault(len(raw), ([], []))
            own[0].append(w)
            own[1].append(raw)
        for length, (names, raws) in of_length.items():
            if length <= self.short:
                rows = np.frombuffer(b"".join(raws), np.uint8).reshape(-1, length)
                self.known.update(zip(names, self.scan_all(rows), strict=True))
            else:
                for w, raw in zip(names, raws, strict=True):
                    self.known[w] = np.array(self.heap([self.letter[b] for b in raw]), "<u4").tobytes()

    def words(self, text: str) -> list[str]:
        """The text cut as the splitting pattern cuts it; no character is lost."""
        if text.isascii() or max(text) < LATIN_END:
            return LATIN.findall(text)
        out: list[str] = []
        for piece in PIECE.findall(text):
            if piece.isascii() or max(piece) < LATIN_END:
                out += LATIN.findall(piece)
            else:
                out += [piece[a:b] for _, (a, b) in self.split.pre_tokenize_str(piece)]
        return out

    def _parts(self, text: str) -> list[str]:
        """Words, and added tokens as they are; those are known from the start."""
        out, start = [], 0
        for m in self.cut.finditer(text) if self.cut else ():
            out += self.words(text[start : m.start()])
            out.append(m.group())
            start = m.end()
        return out + self.words(text[start:])

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Per text its ids as little-endian unsigned 32-bit integers; a null or empty text has none."""
        out: list[bytes] = []
        held: list[list[str]] = []
        chars = 0
        for i, text in enumerate(texts):
            held.append(self._parts(text) if text else [])
            chars += len(text or "")
            if chars < HELD_CHARS and i + 1 < len(texts):
                continue
            known = self.known
            if len(known) > MEMORY_WORDS:
                known.clear()
            known.update((t, x.to_bytes(4, "little")) for t, x in self.added.items())
            new = set().union(*held) - known.keys()
            self._learn(new)
            out += [b"".join(map(known.__getitem__, parts)) for parts in held]
            for w in new:
                if len(w) > self.short:
                    del known[w]
            held, chars = [], 0
        return out

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> str:
        """Text of the ids; ids outside the vocabulary are skipped, bytes that are no UTF-8 become U+FFFD."""
        try:
            return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")
        except KeyError:
            return b"".join(self.bytes.get(i, b"") for i in ids).decode("utf-8", "replace")

    def decode_all(self, flat: np.ndarray, starts: np.ndarray) -> pa.Array:
        """`decode` of every list `flat[starts[i]:starts[i + 1]]`: the bytes of all tokens are gathered at once."""
        if self.table is None:
            self.table = pa.array([self.bytes.get(i, b"") for i in range(self.size + 1)], pa.large_binary())
        known = np.where((flat >= 0) & (flat < self.size), flat, self.size)
        taken = self.table.take(pa.array(known))
        ends = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1) if len(taken) else np.zeros(1, np.int64)
        text = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(ends[starts]), taken.buffers()[2]])
        try:
            return text.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([x.decode("utf-8", "replace") for x in text.to_pylist()], pa.string())


def _pairs_of(path: str):
    """One `BytePairs` per Python worker, made on first use."""
    held: list[BytePairs] = []

    def get() -> BytePairs:
        if not held:
            held.append(BytePairs(path))
        return held[0]

    return get


def encode_texts(docs: DataFrame, text: str = "text", path: str | None = None, ids: str = "ids") -> DataFrame:
    """`docs` with the ids of the whole text as `array<int>`; all other columns as they are.

    A null or empty text has no ids; repeated rows are encoded each; an empty table stays empty. A long
    text is encoded whole, in time that grows as n log n even without white space. Raises when `docs`
    has a column named as `ids`.
    """
    if ids.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the table has a column {ids} already; name another by ids=")
    get = _pairs_of(path or vocabulary_path())

    def make(batch: pa.RecordBatch) -> dict:
        raw = get().encode_all(values(batch, text))
        ends = np.cumsum([0, *(len(r) // 4 for r in raw)], dtype=np.int32)
        flat = np.frombuffer(b"".join(raw), "<u4").astype(np.int32)
        return {ids: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))}

    return append_columns(docs, make, f"`{ids}` array<int>", rows=64)


def decode_ids(rows: DataFrame, ids: str = "ids", path: str | None = None, text: str = "decoded") -> DataFrame:
    """`rows` with the text of their ids; null ids give the empty text, as do none.

    Raises when `rows` has a column named as `text`.
    """
    if text.lower() in {c.lower() for c in rows.columns}:
        raise ValueError(f"the table has a column {text} already; name another by text=")
    get = _pairs_of(path or vocabulary_path())
    def make(batch: pa.RecordBatch) -> dict:
        starts, flat = _flat(batch, ids)
        return {text: get().decode_all(flat, starts)}

    return append_columns(rows, make, f"`{text}` string", rows=64)


def _flat(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(where each list starts, all values in one array) of a column of lists; null lists are empty, null values left out."""
    column = batch.column(batch.schema.get_field_index(name))
    lengths = pc.coalesce(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    if flat.null_count:
        return _flat(pa.RecordBatch.from_arrays([pa.array([x and [i for i in x if i is not None] for x in column.to_pylist()], column.type)], [name]), name)
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64), flat.to_numpy(zero_copy_only=False)


def id_bytes(rows: DataFrame, key: str, ids: str, text: str) -> DataFrame:
    """(key, n_tokens, raw, text): ids as little-endian unsigned 32-bit integers, to be digested."""

    def make(batch: pa.RecordBatch) -> dict:
        starts, flat = _flat(batch, ids)
        raw = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts * 4), pa.py_buffer(flat.astype("<u4"))])
        return {key: batch.column(0), "n_tokens": np.diff(starts), "raw": raw.cast(pa.binary()), text: batch.column(2)}

    kind = rows.schema[key].dataType.simpleString()
    return over_slices(rows.select(key, ids, text), make, f"{key} {kind}, n_tokens long, raw binary, {text} string", rows=64)


def op11_rank_array(spark: SparkSession, folder: str) -> DataFrame:
    encoded = encode_texts(table(spark, folder, "documents").select("doc_id", "text")).drop("text")
    decoded = id_bytes(decode_ids(encoded), "doc_id", "ids", "decoded")
    return decoded.select("doc_id", "n_tokens", F.sha2("raw", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


QUERIES = {"op11_rank_array": op11_rank_array}
