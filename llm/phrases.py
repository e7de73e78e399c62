"""Phrase collocations by Toivonen's sampling: exact counts of frequent phrases and their scores.

A sample of the texts proposes phrases under a lowered threshold. One pass over all texts then counts
the proposed phrases and their negative border: phrases that were not proposed although both phrases
one word shorter inside them were. A border phrase that turns out frequent is proposed too, and a
further pass counts it with what this adds to the border, until no border phrase is frequent.

Proposed phrases are counted by their text. The border is large and nearly all rare, so it is counted
by a 64-bit hash: two phrases of one hash can only make it look more frequent, and then the next pass
counts both by their text. So all counts are exact, and any frequent phrase is counted, whatever the
sample held. The proposals reach the tasks as one bitmap of fixed size; where two phrases share a
bit, more is counted by text than was proposed, and nothing less. Tasks count what they read before
anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm.common import emptied, slices, staged, table, utf8, values

LONGEST = 4
LEAST = 30
# One text in so many proposes phrases, those it holds at least this often.
SAMPLE = 8
SAMPLE_LEAST = 2
# Bits of the bitmap, a power of two: 4 MB, whatever the corpus.
BITS = 25
# Bytes of text a task counts at a time.
HELD_BYTES = 2_000_000
TOP = 2000
# Parts a language is ranked in before its first phrases meet.
PARTS = 256
COVERED = 80
UNKNOWN = "und"

MARK = b"\xff"  # between pieces; no byte of UTF-8
SPLIT = b"\t"  # between a language and a phrase
_CUT = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", MARK * 10)
_SHARE = 2_000_000

COUNTED = "h long, phrase string, n long"


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _word_hashes(words: pa.Array, lang: str) -> np.ndarray:
    """Hash of each word: the sum of mixed (byte, place, language), all bytes at once."""
    if not len(words):
        return np.zeros(0, np.uint64)
    ends = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1).astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8, ends[-1] - ends[0], ends[0]).astype(np.uint64)
    place = np.arange(len(data), dtype=np.uint64) - np.repeat(ends[:-1] - ends[0], np.diff(ends)).astype(np.uint64)
    with np.errstate(over="ignore"):
        mixed = _mixed(data + (place << np.uint64(8)) + np.uint64(xxhash.xxh3_64_intdigest(lang.encode())))
        return _mixed(np.add.reduceat(mixed, ends[:-1] - ends[0]))


def split_words(text: bytes) -> tuple[pa.Array, np.ndarray]:
    """(words, number of each word's piece) of a marked text, without a Python object per word."""
    raw = np.frombuffer(text, np.uint8)
    mark = raw == MARK[0]
    inside = ~(mark | (raw == 32) | (raw == 9))
    edge = np.diff(inside.view(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])])
    return words, np.cumsum(mark)[starts]


def _grown(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of a phrase from that of the phrase without its last word, and that of the last word."""
    with np.errstate(over="ignore"):
        return _mixed(first * np.uint64(0x9E3779B97F4A7C15) + last + np.uint64(1))


def _has(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64((len(bitmap) << 6) - 1)
    return (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def pieces(texts: list[bytes]) -> bytes:
    """The texts in lower case (A-Z), with a mark between them and for every character that ends a piece."""
    return MARK.join(texts).lower().translate(_CUT)


def _codes(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each key's value, the values)."""
    coded = pa.array(keys).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_numpy(zero_copy_only=False)


def count_phrases(text: bytes, lang: str, new: np.ndarray, old: np.ndarray | None, by_text: bool = True) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
    """(hashes, phrases, counts) of one language's marked text; a phrase is null where only its hash is counted.

    A phrase is reached when both phrases one word shorter inside it are reached and in the bitmap
    `new`; words always are. What is in the bitmap is counted by text and the rest by hash, except
    what the pass with the bitmap `old` has counted the same way. Without `by_text` all is counted by
    hash. The number of all words goes with the phrase of no words.
    """
    words, piece = split_words(text)
    if not len(words):
        return
    coded = words.dictionary_encode()
    del words
    word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    shown = coded.dictionary
    own = _word_hashes(shown, lang)
    at = np.arange(len(word))
    if by_text and old is None:
        yield np.zeros(1, np.uint64), pa.array([lang.encode() + SPLIT]), np.array([len(at)])
    # Of the phrases of the length at hand: places in the text, the number of each, and per number its
    # hash, whether the earlier pass reached it, and the text of the proposed ones.
    number, hashes, before = word, own, np.full(len(own), old is not None)
    names = pc.binary_join_element_wise(lang.encode() + SPLIT, shown, b"") if by_text else None
    for k in range(1, LONGEST + 1):
        if k > 1:
            place = np.full(len(word) + 1, -1, np.int64)
            keep = proposed[number]
            place[at[keep]] = number[keep]
            both = (place[:-1] >= 0) & (place[1:] >= 0)
            if k == 2:
                both[:-1] &= piece[1:] == piece[:-1]
            at = np.flatnonzero(both)
            if not len(at):
                return
            number, keys = _codes((place[at] << 32) | place[at + 1])
            a, b = keys >> 32, keys & 0xFFFFFFFF
            # The last word of each phrase, from any place it starts at.
            some = np.empty(len(keys), np.int64)
            some[number] = at
            last = word[some + k - 1]
            before = went_on[a] & went_on[b]
            hashes = _grown(hashes[a], own[last])
        proposed = _has(new, hashes)
        was = _has(old, hashes) if old is not None else np.zeros(len(hashes), bool)
        # A bit may stand for another phrase, so the earlier pass went on only from what it had reached.
        went_on = before & was
        n = np.bincount(number, minlength=len(hashes))
        wanted = (n > 0) & ~(before & (was | ~proposed) if by_text else before)
        if by_text:
            if k > 1:
                texts = np.flatnonzero(proposed)
                joined = pc.binary_join_element_wise(names.take(pa.array(row_of[a[texts]])), shown.take(pa.array(last[texts])), b" ")
            else:
                texts, joined = np.arange(len(hashes)), names
            row_of = np.full(len(hashes), -1, np.int64)
            row_of[texts] = np.arange(len(texts))
            names = joined
            whole = np.flatnonzero(wanted & proposed)
            if len(whole):
                yield np.zeros(len(whole), np.uint64), names.take(pa.array(row_of[whole])), n[whole]
            wanted &= ~proposed
        hashed = np.flatnonzero(wanted)
        if len(hashed):
            yield hashes[hashed], pa.nulls(len(hashed), pa.binary()), n[hashed]


def counted(texts: DataFrame, least: int, sent: Broadcast, before: Broadcast | None, by_text: bool = True, held: int = HELD_BYTES) -> DataFrame:
    """What `count_phrases` counts in all of `texts` (lang, text) at least `least` times, as (h, phrase, n).

    `phrase` is the language, a tab and the words, or null for what is known by its hash alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[bytes]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            while waiting:
                lang, own = waiting.popitem()
                for h, names, n in count_phrases(pieces(own), lang, sent.value, None if before is None else before.value, by_text):
                    whole = pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), names.cast(pa.string()), pa.array(n)], names=["h", "phrase", "n"])
                    yield from slices([whole], 65_536)
                    del h, names, n, whole
                del own
            pa.default_memory_pool().release_unused()

        for batch in slices(batches, 64):
            for lang, raw in zip(values(batch, "lang"), utf8(batch, "text"), strict=True):
                if raw:
                    waiting.setdefault(lang, []).append(raw)
                    size += len(raw)
                    if size >= held:
                        yield from flush()
                        size = 0
        yield from flush()

    rows = texts.mapInArrow(run, COUNTED)
    sums = rows.groupBy("h", "phrase").agg(F.sum("n").alias("n"))
    return sums.where((F.col("n") >= least) | F.col("phrase").endswith(SPLIT.decode()))


def marked(bitmap: np.ndarray, found: DataFrame) -> np.ndarray:
    """A copy of `bitmap` with the bits of the hashes `h` of `found`; at most one row per word of it reaches the driver."""
    bit = F.col("h").bitwiseAND(F.lit((len(bitmap) << 6) - 1))
    one = F.expr("shiftleft(1L, cast(_bit & 63 as int))")
    rows = found.select(bit.alias("_bit")).select(F.shiftright("_bit", 6).cast("int").alias("at"), one.alias("bits"))
    rows = rows.groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = bitmap.copy()
    if rows.num_rows:
        out[rows["at"].to_numpy()] |= rows["bits"].to_numpy().astype(np.int64).view(np.uint64)
    return out


def frequent_phrases(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, sample: int = SAMPLE, sample_least: int = SAMPLE_LEAST, bits: int = BITS,
) -> DataFrame:
    """(lang, k, phrase, n): phrases of one to four words with at least `least` occurrences, exactly counted.

    k = 0 with the empty phrase has the number of all words of a language. Phrases are words joined by
    a space; they lie within a piece, and occurrences may overlap. Null texts are empty, null languages
    `und`; repeated rows count each; without words there are no rows. A long text is held whole by one
    task. The sample is drawn row by row by a hash; a poor one costs passes, never counts.
    """
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).alias("text"))
    # Copies have one hash and would come together or not at all, so rows are drawn one by one.
    drawn = staged(texts.where(F.pmod(F.xxhash64("text", F.monotonically_increasing_id()), F.lit(sample)) == 0), "sample")
    send = docs.sparkSession.sparkContext.broadcast
    proposed, old = send(np.zeros(max(1, (1 << bits) >> 6), np.uint64)), None

    def proposed_too(found: DataFrame) -> tuple[Broadcast, Broadcast]:
        """The next bitmap and the present one; the one before is not needed any more."""
        following = send(marked(proposed.value, found))
        if old is not None:
            old.unpersist()
        return following, proposed

    for _ in range(LONGEST):
        # Each round reaches phrases of one word more.
        proposed, old = proposed_too(counted(drawn, sample_least, proposed, old, by_text=False))
    emptied(drawn)
    old, parts = None, []
    while True:
        part = staged(counted(texts, least, proposed, old), "counted")
        parts.append(part.where("phrase is not null"))
        failed = part.where("phrase is null")
        if failed.isEmpty():
            break
        proposed, old = proposed_too(failed)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    # A tab is never part of a word, so the last one ends the language.
    words = F.substring_index("phrase", SPLIT.decode(), -1)
    out = out.select(F.expr("left(phrase, length(phrase) - length(substring_index(phrase, '\t', -1)) - 1)").alias("lang"), words.alias("phrase"), "n")
    size = F.when(F.col("phrase") == "", F.lit(0)).otherwise(F.size(F.split("phrase", " ")))
    return out.select("lang", size.alias("k"), "phrase", "n")


def _big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(20,0)")


def _part(first: int, n: int) -> Column:
    return F.array_join(F.slice("_words", first, n), " ")


def scored(found: DataFrame, covered: int = COVERED) -> DataFrame:
    """(lang, k, phrase, a, l, r, score) of the phrases of two to four words that no longer one covers.

    A phrase is cut where it scores least, at the first such cut. One is covered when a longer phrase
    that contains its words has at least `covered` percent of its occurrences.
    """
    known = found.where("k > 0").select("lang", "phrase", F.col("n").alias("f"))
    candidate = found.where("k > 1").withColumn("_words", F.split("phrase", " "))
    cuts = [
        F.struct(F.lit(c).alias("cut"), F.lit(side).alias("side"), (_part(1, c) if side == 0 else F.array_join(F.slice("_words", F.lit(c + 1), F.greatest(F.col("k") - c, F.lit(0))), " ")).alias("part"))
        for c in range(1, LONGEST) for side in (0, 1)
    ]
    # Covers: each longer phrase tells the shorter ones inside it how often it occurs.
    inner = [
        F.struct(_part(i + 1, m).alias("phrase"), (F.col("k") >= i + m).alias("ok"))
        for m in range(2, LONGEST) for i in range(LONGEST - m + 1)
    ]
    inside = (
        candidate.where("k > 2")
        .select("lang", F.col("k").alias("_k"), F.col("n").alias("longer"), F.explode(F.array(*inner)).alias("_i"))
        .where(F.col("_i.ok") & (F.size(F.split(F.col("_i.phrase"), " ")) < F.col("_k")))
        .select("lang", F.col("_i.phrase").alias("phrase"), F.lit(None).cast("int").alias("k"), F.lit(None).cast("long").alias("n"), "longer")
    )
    own = candidate.select("lang", "phrase", "k", "n", F.lit(None).cast("long").alias("longer"))
    alone = own.unionByName(inside).groupBy("lang", "phrase").agg(F.max("k").alias("k"), F.max("n").alias("a"), F.max("longer").alias("_longer"))
    alone = alone.where(F.col("_longer").isNull() | (_big("_longer") * 100 < _big("a") * covered)).withColumn("_words", F.split("phrase", " "))
    asked = alone.select("lang", "phrase", "k", "a", F.explode(F.filter(F.array(*cuts), lambda s: s["cut"] < F.col("k"))).alias("_cut"))
    asked = asked.select("lang", "phrase", "k", "a", "_cut.cut", "_cut.side", F.col("_cut.part").alias("_part"))
    sides = asked.join(known.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase"), "f"), (F.col("lang") == F.col("_lang")) & (F.col("_part") == F.col("_phrase")))

    def side(cut: int, number: int) -> Column:
        return F.max(F.when((F.col("cut") == cut) & (F.col("side") == number), F.col("f")))

    pairs = sides.groupBy("lang", "phrase", "k", "a").agg(*[side(c, s).alias(f"_{c}{s}") for c in range(1, LONGEST) for s in (0, 1)])
    choices = [
        F.when(F.col("k") > c, F.struct(F.expr(f"(cast({_SHARE} as decimal(10,0)) * cast(a as decimal(20,0))) div (cast(_{c}0 as decimal(20,0)) + cast(_{c}1 as decimal(20,0)))").alias("score"), F.lit(c).alias("cut"), F.col(f"_{c}0").alias("l"), F.col(f"_{c}1").alias("r")))
        for c in range(1, LONGEST)
    ]
    best = pairs.withColumn("_best", F.array_min(F.filter(F.array(*choices), lambda s: s.isNotNull())))
    return best.select("lang", "k", "phrase", "a", F.col("_best.l").alias("l"), F.col("_best.r").alias("r"), F.col("_best.score").alias("score"))


def top_phrases(found: DataFrame, top: int = TOP, covered: int = COVERED) -> DataFrame:
    """The first phrases of each language by score, occurrences and text, with their rank from 1 and all words `n`.

    A language is ranked in parts first, and only the first of each part are ranked together; only
    then do the phrases meet the totals. So no task sorts all phrases of a language.
    """
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = scored(found, covered).withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    first = parts.withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    totals = found.where("k = 0").select(F.col("lang").alias("_lang"), "n")
    out = ranked.join(totals, F.col("lang") == F.col("_lang"))
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_toivonen_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return top_phrases(frequent_phrases(table(spark, folder, "documents")))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE = {
    "op12_toivonen_phrases": f"""
    WITH cut AS (
        SELECT coalesce(lang, 'und') AS lang,
               unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
        FROM documents
    ), words AS (
        SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM cut
    ), placed AS (
        SELECT lang, 1 AS k, unnest(w) AS phrase FROM words
        UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words
        UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM words
        UNION ALL SELECT lang, 4, unnest(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) FROM words
    ), f AS MATERIALIZED (
        SELECT lang, k, phrase, count(*) AS n FROM placed GROUP BY ALL
    ), total AS (
        SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
    ), candidate AS MATERIALIZED (
        SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND n >= {LEAST}
    ), inner_phrases AS (
        SELECT DISTINCT c.lang, array_to_string(c.w[s.i:s.i + s.m - 1], ' ') AS phrase, c.a AS longer
        FROM candidate c, (SELECT m, unnest(range(1, 6 - m)) AS i FROM (SELECT unnest([2, 3]) AS m)) AS s
        WHERE s.m < c.k AND s.i + s.m - 1 <= c.k
    ), covered AS (
        SELECT DISTINCT c.lang, c.phrase FROM candidate c JOIN inner_phrases i USING (lang, phrase)
        WHERE 100 * i.longer::HUGEINT >= {COVERED} * c.a::HUGEINT
    ), cuts AS (
        SELECT c.lang, c.phrase, c.a, j, x.n AS l, y.n AS r, (2000000 * c.a::HUGEINT) // (x.n::HUGEINT + y.n::HUGEINT) AS score
        FROM candidate c, (SELECT unnest([1, 2, 3]) AS j) AS js, f x, f y
        WHERE j < c.k AND x.lang = c.lang AND x.phrase = array_to_string(c.w[1:j], ' ')
          AND y.lang = c.lang AND y.phrase = array_to_string(c.w[j + 1:], ' ')
    ), best AS (
        SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
    ), ranked AS (
        SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank,
               b.phrase, b.a, b.l, b.r, t.n, b.score::BIGINT AS score
        FROM best b JOIN total t USING (lang) ANTI JOIN covered v ON b.lang = v.lang AND b.phrase = v.phrase
    )
    SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= {TOP}
    """
}
QUERIES = {"op12_toivonen_phrases": op12_toivonen_phrases}
