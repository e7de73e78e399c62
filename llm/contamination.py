"""Benchmark decontamination with one Aho-Corasick automaton over normalised test items.

Texts are lower-cased in A-Z and cut into words of digits, a-z and non-ASCII characters. Every word
of the benchmark gets a code point of its own, so a text becomes a string with one character per
word (a fixed one for words the benchmark lacks), and the automaton, whose patterns are windows of
13 consecutive item words, reads that string once. A match is then word-aligned by construction;
word numbers lead back to offsets in the original text.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import append_columns, free_name, over_slices, table, utf8, values

WINDOW = 13
# (window, item) pairs of one automaton. Bounds what is sent to workers: 13 words each, so at most
# 780,000 codes, which fit below the surrogates and above them. More pairs make more automata.
MAX_PAIRS = 60_000
UNKNOWN = "\x00"
KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(0x80, 0x100))
FOLD = bytes(b if b in KEEP else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
RESULT = "n_words long, runs array<struct<first:int,last:int>>, items array<string>"


def words_of(raw: bytes | None) -> list[bytes]:
    return raw.translate(FOLD).split() if raw else []


def item_windows(items: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct (words, item) pairs; an item with fewer words than a window is one window.

    Null and wordless texts have none. Items without an id count as hits and are never listed.
    """

    def make(batch: pa.RecordBatch) -> dict:
        out: dict = {"words": [], "item": []}
        for name, raw in zip(values(batch, "item"), utf8(batch, "text"), strict=True):
            w = words_of(raw)
            for i in range(max(1, len(w) - window + 1) if w else 0):
                out["words"].append(b" ".join(w[i : i + window]))
                out["item"].append(name)
        return out

    chosen = items.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text"))
    return over_slices(chosen, make, "words binary, item string").distinct()


class Automaton:
    """Patterns over word codes; each pattern has its length and its items."""

    def __init__(self, pairs: list[tuple[bytes, str | None]]):
        import ahocorasick

        self.code: dict[bytes, str] = {}
        owners: dict[str, set] = {}
        for words, item in pairs:
            pattern = "".join(self.code.setdefault(w, self._char(len(self.code))) for w in words.split(b" "))
            owners.setdefault(pattern, set()).add(item)
        self.machine = ahocorasick.Automaton()
        for pattern, items in owners.items():
            self.machine.add_word(pattern, (len(pattern), items))
        self.empty = not owners
        if not self.empty:
            self.machine.make_automaton()

    @staticmethod
    def _char(n: int) -> str:
        return chr(n + 1 if n + 1 < 0xD800 else n + 1 + 0x800)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Runs of hit words (first and last number) and the items that occur."""
        if self.empty or not words:
            return [], set()
        get, items, runs = self.code.get, set(), []
        coded = "".join([get(w, UNKNOWN) for w in words])
        for end, (length, owners) in self.machine.iter(coded):
            items |= owners
            runs.append((end - length + 1, end))
        return merged(runs), items


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(runs):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def _scanner(pairs, text: str, prefix: str):
    """Function of a batch; the automaton is built once a task, from a broadcast of bounded size."""
    built: list[Automaton] = []

    def make(batch: pa.RecordBatch) -> dict:
        if not built:
            built.append(Automaton(pairs.value))
        n, runs, items = [], [], []
        for raw in utf8(batch, text):
            words = words_of(raw)
            r, i = built[0].scan(words)
            n.append(len(words))
            runs.append([{"first": a, "last": b} for a, b in r])
            items.append(sorted(x for x in i if x is not None))
        return {f"{prefix}n_words": n, f"{prefix}runs": runs, f"{prefix}items": items}

    return make


def scan(docs: DataFrame, items: DataFrame, text: str = "text", window: int = WINDOW, max_pairs: int = MAX_PAIRS) -> tuple[DataFrame, str]:
    """`docs` with a struct column of word count, runs of hit words and items; and that column's name.

    One automaton and one pass over the texts while the benchmark has at most `max_pairs` windows.
    A larger one is cut into that many parts by hash, each scanned in a pass of its own whose hits
    are keyed by the text's digest and united; no part is left out.
    """
    spark = docs.sparkSession
    pairs = item_windows(items, window=window)
    n = pairs.count()
    parts = max(1, -(-n * 5 // (max_pairs * 4))) if n > max_pairs else 1
    name = free_name(docs, "_scan")
    ddl = lambda p: ", ".join(p + c.strip() for c in re.split(r", (?=\w+ array)", RESULT))
    if parts == 1:
        sent = spark.sparkContext.broadcast([(bytes(r.words), r.item) for r in pairs.collect()])
        out = append_columns(docs, _scanner(sent, text, name), ddl(name))
        return _packed(out, docs, name), name
    hits, key = None, free_name(docs, "_key")
    texts = docs.select(F.col(text).alias("text")).where(F.length("text") > 0)
    for part in range(parts):
        own = pairs.where(F.pmod(F.xxhash64("words", "item"), F.lit(parts)) == part)
        sent = spark.sparkContext.broadcast([(bytes(r.words), r.item) for r in own.collect()])
        found = append_columns(texts, _scanner(sent, "text", ""), RESULT).where(F.size("runs") > 0)
        found = found.select(F.sha2("text", 256).alias("k"), "runs", "items").distinct()
        hits = found if hits is None else hits.unionByName(found)
    united = hits.groupBy("k").agg(F.flatten(F.collect_list("runs")).alias("r"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("i"))
    counted = append_columns(docs, _scanner(spark.sparkContext.broadcast([]), text, name), ddl(name)).withColumn(key, F.sha2(F.col(text), 256))
    joined = counted.join(united, F.col(key) == F.col("k"), "left")

    def make(batch: pa.RecordBatch) -> dict:
        runs = values(batch, f"{name}runs")
        found = values(batch, "r")
        return {f"{name}all": [[{"first": a, "last": b} for a, b in merged([(x["first"], x["last"]) for x in f])] if f else r for r, f in zip(runs, found, strict=True)]}

    out = append_columns(joined, make, f"{name}all array<struct<first:int,last:int>>")
    out = out.withColumn(f"{name}runs", F.col(f"{name}all")).withColumn(f"{name}items", F.coalesce("i", f"{name}items"))
    return _packed(out, docs, name), name


def _packed(out: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    c = lambda x: F.col(f"`{name}{x}`")
    hit = F.aggregate(c("runs"), F.lit(0).cast("long"), lambda s, r: s + (r["last"] - r["first"] + 1).cast("long"))
    fields = F.struct(c("n_words").alias("n_words"), hit.alias("n_hit"), c("runs").alias("runs"), c("items").alias("items"))
    return out.select(*[F.col(f"`{x}`") for x in docs.columns], fields.alias(name))


def contaminated(scanned):
    """The rule: some word is hit, and at least one word in 20."""
    return (scanned["n_hit"] > 0) & (scanned["n_hit"] * 20 >= scanned["n_words"])


def hit_spans(raw: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code-point offsets, end exclusive, of runs of hit words in the original text."""
    at = [m.span() for m in WORD.finditer(raw)]
    points = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    # Offsets of byte positions: code points that start before them.
    return [(int(points[at[a][0]]), int(points[at[b][1]])) for a, b in runs]


def contamination(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """`docs` with n_words, n_hit, items, spans and contaminated.

    Null and empty texts have no words and are clean. An empty benchmark hits nothing. Items of equal
    text are all listed; repeated rows count once. Columns of `docs` with one of the added names are
    replaced.
    """
    scanned, name = scan(docs, items, text, **options)

    def make(batch: pa.RecordBatch) -> dict:
        out = []
        for raw, s in zip(utf8(batch, text), values(batch, name), strict=True):
            runs = [(r["first"], r["last"]) for r in s["runs"]]
            out.append([{"start": a, "end": b} for a, b in hit_spans(raw, runs)] if runs else [])
        return {spans: out}

    spans = free_name(scanned, "_spans")
    base = append_columns(scanned, make, f"{spans} array<struct<start:int,end:int>>")
    s = F.col(f"`{name}`")
    added = {"n_words": s["n_words"], "n_hit": s["n_hit"], "items": s["items"], "spans": F.col(spans), "contaminated": contaminated(s)}
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in added]
    return base.select(*kept, *[v.alias(k) for k, v in added.items()])


def clean_documents(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of `docs` that are not contaminated, with their columns as they are."""
    scanned, name = scan(docs, items, text, **options)
    return scanned.where(~contaminated(F.col(f"`{name}`"))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_aho_corasick(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scanned, name = scan(docs, table(spark, folder, "benchmark"))
    s = F.col(name)
    return scanned.select(
        "doc_id", s["n_words"].alias("n_words"), s["n_hit"].alias("n_hit"), F.size(s["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(s["items"], ","), 256).alias("items_sha256"), contaminated(s).alias("contaminated"),
    )


QUERIES = {"op7_aho_corasick": op7_aho_corasick}
