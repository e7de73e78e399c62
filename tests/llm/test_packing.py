import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm.packing import Packer, WordIds, op8_dot_product, pack_texts, tokenizer_path


def ids_of(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for x in texts]


ODD = ["It's a TEST, isn't it? I'll go.", "naïve Café, ÉTÉ. ÀÉÎ ß straße,", "a,b.c ., .. ,,", "İstanbul ΣΑΣ ﬁn x́ é.", "12 3.14, 1,000.", "<|endoftext|> <|ENDOFTEXT|> <|x", "日本語 テキスト。", "tab\tnew\nline\x0b\x0c\x1c\x85\xa0　end", "😀😀, ok.", "'s 't ''s", "", "   ", "word" * 500]


def test_ids_are_those_of_the_tokenizer():
    got = WordIds(tokenizer_path()).encode([t.encode() for t in ODD])
    for raw, want, text in zip(got, ids_of(ODD), ODD, strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == want[:-1].tolist(), text


def check(rows, texts, capacity=2048, segments=256):
    """Every id in one piece, sequences without gaps and within their limits; returns the padding."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(texts)
    for (name, text), ids in zip(texts.items(), ids_of(texts.values()), strict=True):
        at = 0
        for r in sorted(pieces[name], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for rs in sequences.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity and len(rs) <= segments and rs[0].segments == len(rs)
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


def test_query(spark, folder):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = op8_dot_product(spark, folder).collect()
    padding = check(rows, texts)
    assert padding * 100 < sum(r.length for r in rows)


def test_edge_rows(documents, nothing):
    rows = pack_texts(documents).collect()
    assert len({r.doc_id for r in rows}) == len({r.doc_id for r in documents.collect()})
    assert sum(r.length for r in rows) == sum(len(x) for x in ids_of([r.text for r in documents.collect()]))
    assert pack_texts(nothing).count() == 0


@pytest.mark.parametrize("segments,loss", [(3, 2048), (256, 100), (2, 37)])
def test_all_three_limits_hold(spark, segments, loss):
    texts = {i: "alpha beta gamma " * (i % 23) for i in range(200)}
    docs = spark.createDataFrame([(i, t, i % 3 == 0) for i, t in texts.items()], "doc_id long, text string, loss boolean").coalesce(1)
    rows = pack_texts(docs, loss="loss", capacity=128, max_segments=segments, max_loss=loss, pool=50).collect()
    check(rows, texts, 128, segments)
    total = defaultdict(int)
    for r in rows:
        total[r.sequence_id] += r.length if r.doc_id % 3 == 0 else 0
    assert max(total.values()) <= loss
    assert all(r.loss_tokens == total[r.sequence_id] for r in rows)


def test_the_largest_dot_product_goes_first():
    p = Packer(10, 10, 10, cut_gap=100)
    for row, n in enumerate([6, 5, 4, 3, 2]):
        list(p.add(row, n))
    assert [x[:4] for x in p.pack(final=True)][:2] == [(0, 0, 6, 0), (2, 0, 4, 0)]


def test_pool_is_searched_by_length_and_words_are_shared_by_tasks():
    import random
    import time

    from llm.packing import word_ids

    assert word_ids(tokenizer_path()) is word_ids(tokenizer_path())
    r, p, out = random.Random(3), Packer(), []
    sizes = [r.choice([r.randrange(1, 60), r.randrange(1, 4000)]) for _ in range(60_000)]
    began = time.process_time()
    for i, n in enumerate(sizes):
        out += p.add(i, n, i % 3 > 0)
        if len(p.rows) >= 4096:
            out += p.pack()
    out += p.pack(final=True)
    assert time.process_time() - began < 8  # comparing each sequence with the whole pool took some 15 s
    placed, used = {}, {}
    for row, start, length, seq, offset, _ in out:
        placed.setdefault(row, []).append((start, length))
        assert offset == used.get(seq, 0)
        used[seq] = offset + length
    for i, n in enumerate(sizes):
        end = 0
        for start, length in sorted(placed[i]):
            assert start == end
            end += length
        assert end == n
    short = [n for n in used.values() if n < 2048 - 8]
    assert max(used.values()) <= 2048 and all(n & (n - 1) == 0 for n in short) and len(short) <= 64
