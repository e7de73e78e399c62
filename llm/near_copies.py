"""Near-duplicate texts by a chosen-path set similarity join over word shingles.

Texts with equal shingle sets are one class. In each of several independent trees the classes are
branched by minwise tokens: a node picks one or two positions of the minwise signature, and its
members go to one child per picked position, named by their token there; 1 / threshold children on
average, so similar sets keep about one common node at every depth. Nodes small enough are compared
exhaustively by sketches, larger ones branch on. What sketches join is confirmed on the full sets
of the texts, skipping pairs that confirmed links already connect.

A group of very many near copies shares its tokens and would be carried whole down every tree. So the
members of large nodes are first compared in blocks that share a few representatives, and confirmed:
that connects most of such a group in time linear in it. Pairs inside a component that is known need no
comparison, so a node of one component is done, and in a node whose largest component leaves few other
members, those are compared with each other and with it, and nothing branches on.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import emptied, free_name, over_slices, shuffles_for, staged, table, utf8, values
from llm.components import components

SIGNATURE = 128
TREES = 10
# Members a node or group may have when it is compared exhaustively.
NODE = 512
# Members of a large node that all its blocks share.
REPRESENTATIVES = 4
DEPTH = 8
# Sketches let a pair pass from so many standard deviations below the threshold: of pairs at the
# threshold, about one in 30,000 is missed.
DEVIATIONS = 4.0

_RNG = np.random.default_rng(20)
_FACTOR = _RNG.integers(1, 1 << 62, SIGNATURE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _RNG.integers(1, 1 << 62, SIGNATURE, dtype=np.uint64)
_PLACE = np.array([0x9E3779B97F4A7C15 * (2 * i + 1) % (1 << 64) for i in range(64)], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


def shingles(raw: bytes | None, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; fewer words make one; none without words."""
    import xxhash

    parts = raw.lower().split() if raw else []
    if not parts:
        return np.zeros(0, np.uint64)
    if len(parts) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(parts), len(parts))], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    n = len(h) - words + 1
    with np.errstate(over="ignore"):
        total = np.zeros(n, np.uint64)
        for i in range(words):
            total += _mixed(h[i : i + n] * _PLACE[i])
    return np.unique(_mixed(total))


def signature(s: np.ndarray) -> np.ndarray:
    """Minwise hashes of a set, in pieces of bounded size."""
    out = np.full(SIGNATURE, np.iinfo(np.uint32).max, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(s), 4096):
            part = ((s[None, i : i + 4096] * _FACTOR[:, None] + _SHIFT[:, None]) >> np.uint64(32)).astype(np.uint32)
            out = np.minimum(out, part.min(axis=1))
    return out


def describe(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(doc_id, n, k, sig): id, size of the set, digest of the set, and signature (null when empty)."""
    chosen = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def make(batch: pa.RecordBatch) -> dict:
        n, k, sig = [], [], []
        for raw in utf8(batch, "text"):
            s = shingles(raw, words)
            n.append(len(s))
            k.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            sig.append(signature(s).tobytes() if len(s) else None)
        return {"doc_id": values(batch, "doc_id"), "n": n, "k": k, "sig": sig}

    return over_slices(chosen, make, "doc_id long, n long, k binary, sig binary")


def _children(nodes: np.ndarray, sig: np.ndarray, branch: float, root: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and child nodes: one position per node, and a second one for some nodes.

    Both choices depend on the node alone, so all its members branch alike.
    """
    first = _mixed(nodes)
    second = _mixed(first + np.uint64(0x5851F42D4C957F2D))
    place = (nodes * np.uint64(11) if root else first) % np.uint64(SIGNATURE)
    more = np.flatnonzero((second >> np.uint64(11)).astype(np.float64) / (1 << 53) < branch - 1)
    rows = np.concatenate([np.arange(len(nodes)), more])
    places = np.concatenate([place, (place[more] + np.uint64(1) + second[more] % np.uint64(SIGNATURE - 1)) % np.uint64(SIGNATURE)]).astype(np.int64)
    with np.errstate(over="ignore"):
        token = sig[rows, places].astype(np.uint64) + (places.astype(np.uint64) << np.uint64(32))
        return rows, _mixed(first[rows] * np.uint64(3) + _mixed(token))


def _signatures(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(values(batch, "sig")), np.uint32).reshape(-1, SIGNATURE)


def _roots(batch: pa.RecordBatch, trees: int, branch: float) -> dict:
    sig, reps = _signatures(batch), np.array(values(batch, "rep"), np.int64)
    nodes = np.tile(np.arange(1, trees + 1, dtype=np.uint64), len(reps))
    rows, child = _children(nodes, np.repeat(sig, trees, axis=0), branch, True)
    return {"node": child.view(np.int64), "rep": np.repeat(reps, trees)[rows]}


def _deeper(batch: pa.RecordBatch, branch: float) -> dict:
    nodes, reps = np.array(values(batch, "node"), np.int64).view(np.uint64), np.array(values(batch, "rep"), np.int64)
    rows, child = _children(nodes, _signatures(batch), branch, False)
    return {"node": child.view(np.int64), "rep": reps[rows]}


def _shared(rows: DataFrame) -> DataFrame:
    """Rows of nodes with at least two members, with the number of members."""
    # A class comes to a node by one path alone, so no row repeats.
    rows = staged(rows, "nodes")
    with shuffles_for(rows.sparkSession, rows.count()):
        counts = staged(rows.groupBy(F.col("node").alias("_node")).agg(F.count("*").alias("c")).where("c > 1"), "sizes")
        out = staged(rows.join(counts, F.col("node") == F.col("_node")).select("node", "rep", "c"), "nodes")
    emptied(rows)
    return out


def _sorted_out(level: DataFrame, known: DataFrame | None, node: int) -> DataFrame:
    """Rows of the nodes whose members are not all of one known component, as (node, rep, c, rest, other).

    `rest` is the number of members outside the largest component of the node, and `other` is true
    for them. In a node of at most `node` members all are others, and so they are if nothing is known.
    """
    if known is None:
        return level.select("node", "rep", "c", F.col("c").alias("rest"), F.lit(True).alias("other"))
    with shuffles_for(level.sparkSession, level.count()):
        named = level.join(known.select(F.col("node").alias("_n"), "component"), F.col("rep") == F.col("_n"), "left")
        named = staged(named.select("node", "rep", "c", F.coalesce("component", "rep").alias("component")), "named")
        sizes = named.groupBy("node", "component").agg(F.count("*").alias("m"))
        largest = sizes.groupBy(F.col("node").alias("_node")).agg(F.max(F.struct("m", "component")).alias("_top"), F.count("*").alias("_parts"))
        largest = staged(largest.where("_parts > 1").select("_node", "_top.m", F.col("_top.component").alias("_core")), "largest")
        small = F.col("c") <= node
        out = named.join(largest, F.col("node") == F.col("_node")).select(
            "node", "rep", "c", F.when(small, F.col("c")).otherwise(F.col("c") - F.col("m")).alias("rest"), (small | (F.col("component") != F.col("_core"))).alias("other")
        )
        out = staged(out, "open")
    emptied(named)
    return out


def groups(batches: Iterator[pa.RecordBatch], key: tuple[str, ...]) -> Iterator[dict]:
    """Consecutive rows with equal keys, as a dict of lists; rows come sorted by the key."""
    held: dict[str, list] = {}
    last = None
    for batch in batches:
        for start in range(0, batch.num_rows, 4096):
            part = batch.slice(start, 4096).to_pydict()
            names = list(part)
            keys = list(zip(*[part[c] for c in key], strict=True))
            at = 0
            for i in range(len(keys) + 1):
                if i == len(keys) or (i > at and keys[i] != keys[at]):
                    if i > at:
                        if keys[at] == last:
                            for c in names:
                                held[c] += part[c][at:i]
                        else:
                            if last is not None:
                                yield held
                            held, last = {c: part[c][at:i] for c in names}, keys[at]
                    at = i
    if last is not None:
        yield held


def over_groups(df: DataFrame, key: tuple[str, ...], make, schema: str) -> DataFrame:
    """Rows of `make(group)` (a list of tuples) for every group of rows with one key, one group at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def batch_of(lines: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*lines, strict=True)) if lines else [[] for _ in arrow]
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines: list[tuple] = []
        for group in groups(batches, key):
            lines += make(group)
            if len(lines) >= 8192:
                yield batch_of(lines)
                lines = []
        yield batch_of(lines)

    return df.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, schema)


def _agreement(sketch: np.ndarray, i: int) -> np.ndarray:
    return (sketch[i + 1 :] == sketch[i]).mean(axis=1)


def close_pairs(sketch: np.ndarray, n: np.ndarray, threshold: float, cut: float, first: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each member, or each of the `first`, the later ones whose sketch and size allow the threshold, with the agreement."""
    for i in range(len(n) - 1 if first is None else min(first, len(n) - 1)):
        same = _agreement(sketch, i)
        sizes = n[i + 1 :]
        ok = (same >= cut) & (np.minimum(sizes, n[i]) >= threshold * np.maximum(sizes, n[i]) - 1e-9)
        at = np.flatnonzero(ok)
        if len(at):
            yield i, at + i + 1, same[at]


class Union:
    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.parent[max(i, j)] = min(i, j)
        return True


def _sketches(group: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(group["sketch"]), np.uint8).reshape(-1, SIGNATURE), np.array(group["n"], np.int64)


def _clusters(threshold: float, cut: float):
    """Groups of a node's members that sketches connect: one row per member but the first.

    Members that are not `other` are of one component and are not compared among themselves.
    """

    def make(group: dict) -> list[tuple]:
        order = sorted(range(len(group["rep"])), key=lambda i: not group["other"][i])
        group = {c: [x[i] for i in order] for c, x in group.items()}
        sketch, n = _sketches(group)
        union = Union(len(n))
        for i, others, _ in close_pairs(sketch, n, threshold, cut, sum(group["other"])):
            for j in others.tolist():
                union.join(i, j)
        reps, out = group["rep"], []
        for i in range(len(n)):
            r = union.root(i)
            if r != i:
                out.append((group["node"][0], group["i"][0], group["j"][0], reps[r], reps[i]))
        return out

    return make


def _confirmed(threshold: int, words: int, cut: float):
    """What links that hold on the full sets connect in a group: one row per member but the first.

    Pairs that such links already connect are skipped.
    """

    def make(group: dict) -> list[tuple]:
        sets, keep = [], []
        for i, (text, k) in enumerate(zip(group["text"], group["k"], strict=True)):
            s = shingles((text or "").encode(), words)
            if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == k:
                sets.append(s)
                keep.append(i)
        if len(keep) < 2:
            return []
        sketch, n = _sketches({c: [group[c][i] for i in keep] for c in ("sketch", "n")})
        reps = [group["rep"][i] for i in keep]
        pairs = [(-a, i, j) for i, others, same in close_pairs(sketch, n, threshold / 100, cut) for j, a in zip(others.tolist(), same.tolist(), strict=True)]
        pairs.sort()
        union = Union(len(keep))
        for _, i, j in pairs:
            if union.root(i) != union.root(j):
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                    union.join(i, j)
        roots = [union.root(i) for i in range(len(keep))]
        return [(reps[r], reps[i]) for i, r in enumerate(roots) if r != i]

    return make


def _blocked(rows: DataFrame, node: int) -> DataFrame:
    """Add the pair of blocks (i, j): (0, 0) in a small node; larger ones meet block by block.

    The others of a large node are cut into blocks by hash, numbered first, and the members of its
    largest component into further blocks. An other goes to all pairs its block is part of; a member of the
    component only meets the blocks of others.
    """
    others = F.greatest(F.ceil(F.col("rest") / node).cast("int"), F.lit(1))
    cores = F.ceil((F.col("c") - F.col("rest")) / node).cast("int")
    rows = rows.withColumn("_others", others).withColumn("_cores", cores)
    own = F.when(F.col("other"), F.pmod(F.xxhash64("rep"), F.col("_others"))).otherwise(F.col("_others") + F.pmod(F.xxhash64("rep"), F.greatest("_cores", F.lit(1))))
    met = F.when(F.col("other"), F.col("_others") + F.col("_cores")).otherwise(F.col("_others"))
    rows = rows.withColumn("_own", own.cast("int")).withColumn("_with", F.explode(F.sequence(F.lit(0), met - 1)))
    return rows.select("node", F.least("_own", "_with").alias("i"), F.greatest("_own", "_with").alias("j"), "rep", "other").distinct()


def _star_blocks(level: DataFrame, node: int) -> DataFrame:
    """(g, rep): the members of large nodes in blocks of about `node`, each with the node's representatives.

    A class that is in large nodes of several trees goes to the largest of them alone.
    """
    once = level.where(F.col("c") > node).groupBy("rep").agg(F.max(F.struct("c", "node")).alias("_l")).select("rep", F.col("_l.node").alias("node"))
    once = staged(once, "large")
    # Minima under a few hashes: one row per node, whatever its size.
    least = [F.min_by("rep", F.xxhash64("rep", F.lit(k))).alias(f"_r{k}") for k in range(REPRESENTATIVES)]
    heads = staged(once.groupBy(F.col("node").alias("_node")).agg(F.ceil(F.count("*") / node).cast("int").alias("_blocks"), *least), "heads")
    block = F.xxhash64("node", F.pmod(F.xxhash64("rep"), F.col("_blocks").cast("long")))
    own = once.join(heads, F.col("node") == F.col("_node")).select(block.alias("g"), "rep")
    spread = heads.select(F.col("_node").alias("node"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks").cast("long") - 1)).alias("_b"), F.array(*[f"_r{k}" for k in range(REPRESENTATIVES)]).alias("_r"))
    return own.unionByName(spread.select(F.xxhash64("node", "_b").alias("g"), F.explode("_r").alias("rep"))).distinct()


def near_components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, threshold: int = 80, trees: int = TREES, node: int = NODE, depth: int = DEPTH
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row: components of texts alike in `threshold` percent.

    A null or empty text has no shingles and is a component of its own; so is a row with a null id, whose
    component is null and which is kept. Equal sets are linked whatever their number. Repeated rows
    share a component, and all rows that carry its smallest id are kept. An empty table gives no rows.
    """
    share = threshold / 100
    cut = share - DEVIATIONS * math.sqrt(share * (1 - share) / SIGNATURE)
    branch = 1 / share
    base = staged(describe(docs, key, text, words), "sets")
    own = base.where(F.col("k").isNotNull() & F.col("doc_id").isNotNull())
    reps = own.groupBy("k").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    reps = staged(reps, "classes")

    low = lambda b: {"_rep": values(b, "rep"), "n": values(b, "n"), "k": values(b, "k"), "sketch": [x.tobytes() for x in _signatures(b).astype(np.uint8)]}
    sketches = staged(over_slices(reps.select("rep", "n", "k", "sig"), low, "_rep long, n long, k binary, sketch binary", rows=2048), "sketches")

    def confirmed(members: DataFrame) -> DataFrame:
        """Links that hold on the full sets inside the groups (g, rep)."""
        members = staged(members.join(sketches, F.col("rep") == F.col("_rep")).drop("_rep"), "members")
        with shuffles_for(members.sparkSession, members.count()):
            wanted = staged(members.select(F.col("rep").alias("_rep")).distinct(), "wanted")
        texts = docs.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("text"))
        found = texts.join(wanted, F.col("_id") == F.col("_rep"), "left_semi")
        # Rows that repeat an id and its text are one; rows of another text are known by their digest.
        found = found.groupBy("_id", F.md5(F.col("text").cast("binary"))).agg(F.first("text").alias("text")).select("_id", "text")
        full = members.join(found, F.col("rep") == F.col("_id")).select("g", "rep", "n", "k", "sketch", "text")
        out = staged(over_groups(full, ("g",), _confirmed(threshold, words, cut), "a long, b long"), "confirmed")
        emptied(members)
        return out

    level = _shared(over_slices(reps.select("rep", "sig"), lambda b: _roots(b, trees, branch), "node long, rep long", rows=2048))
    stars = known = leaves = None
    if not level.where(F.col("c") > node).isEmpty():
        stars = confirmed(_star_blocks(level, node))
        known = components(stars)
    opened = []
    for step in range(depth):
        rows = _sorted_out(level, known, node)
        opened.append(rows if known is not None else level)
        if known is not None:
            emptied(level)
        # The last level is compared as it is; before, nodes with many others branch on.
        on = F.lit(False) if known is None or step == depth - 1 else F.col("rest") > node
        done = rows.where(~on)
        leaves = done if leaves is None else leaves.unionByName(done)
        large = rows.where(on)
        if known is None or step == depth - 1 or large.isEmpty():
            break
        with_sig = large.select("node", "rep").join(reps.select(F.col("rep").alias("_rep"), "sig"), F.col("rep") == F.col("_rep"))
        level = _shared(over_slices(with_sig.select("node", "rep", "sig"), lambda b: _deeper(b, branch), "node long, rep long", rows=2048))

    placed = _blocked(leaves, node).join(sketches.drop("k"), F.col("rep") == F.col("_rep")).drop("_rep")
    alike = staged(over_groups(placed, ("node", "i", "j"), _clusters(share, cut), "node long, i int, j int, a long, b long"), "alike")
    for rows in opened:
        emptied(rows)

    # Candidates: whole components of what sketches join, or the clusters of nodes where one is too large.
    candidate = components(alike)
    with shuffles_for(candidate.sparkSession, candidate.count()):
        small = staged(candidate.groupBy(F.col("component").alias("_c")).agg(F.count("*").alias("size")), "sizes")
    sized = candidate.join(small, F.col("component") == F.col("_c"))
    whole = sized.where(F.col("size") <= node).select(F.xxhash64("component").alias("g"), F.col("node").alias("rep"))
    big = sized.where(F.col("size") > node).select(F.col("node").alias("_n"))
    parts = alike.join(big, F.col("a") == F.col("_n")).select(F.xxhash64("node", "i", "j", "a").alias("g"), "a", "b")
    links = confirmed(whole.unionByName(parts.select("g", F.explode(F.array("a", "b")).alias("rep")).distinct()))
    links = links if stars is None else links.unionByName(stars)

    final = components(links)
    classes = reps.select(F.col("k").alias("_k"), "rep").join(final, F.col("rep") == F.col("node"), "left")
    classes = staged(classes.select("_k", F.coalesce("component", "rep").alias("component")), "classes")
    joined = base.select("doc_id", "n", "k").join(classes, F.col("k") == F.col("_k"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """`docs` without the rows whose id is not the smallest of its component; columns as they are.

    Rows with a null id stay.
    """
    found = near_components(docs, key, text, **options)
    gone = staged(found.where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    return docs.join(gone, F.col(f"`{key}`") == F.col("_gone"), "left_anti")


def keep_one_row(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """`docs` with one row of each component of rows: that of the smallest id, null ids last; columns as they are.

    Rows are numbered, so repeated rows and rows with a null id are compared like all others. Rows
    without shingles stay.
    """
    row = free_name(docs, "_row")
    numbered = staged(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = near_components(numbered, row, text, **options).select(F.col("doc_id").alias("_number"), F.col("component_id").alias("_group"))
    ids = numbered.select(F.col(row).alias("_r"), F.col(f"`{key}`").alias("_id"))
    order = F.struct(F.col("_id").isNull(), F.col("_id"), F.col("_r"))
    found = staged(found, "groups")
    several = found.groupBy("_group").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("_group").alias("_g"))
    members = staged(found.join(several, F.col("_group") == F.col("_g")).select("_number", "_g"), "several")
    chosen = members.join(ids, F.col("_number") == F.col("_r")).groupBy(F.col("_g").alias("_c")).agg(F.min_by("_r", order).alias("_chosen"))
    # The rows that go are few beside those that stay, and numbers alone.
    gone = members.join(chosen, F.col("_g") == F.col("_c")).where(F.col("_number") != F.col("_chosen")).select(F.col("_number").alias("_gone"))
    return numbered.join(staged(gone, "gone"), F.col(f"`{row}`") == F.col("_gone"), "left_anti").drop(row)


def op10_chosen_path(spark: SparkSession, folder: str) -> DataFrame:
    return near_components(table(spark, folder, "documents"), words=3, threshold=85)


QUERIES = {"op10_chosen_path": op10_chosen_path}
