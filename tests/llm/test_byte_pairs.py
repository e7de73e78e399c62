import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from llm.byte_pairs import BytePairs, decode_ids, encode_texts, op11_rank_array, vocabulary_path
from llm.common import table
from tests.llm.conftest import prose

TRICKY = [
    "a  b", "a \n b\n", " leading", "trailing  ", "it's we'll I'm they'd 's 'tis", "x y 　z\x85w", "\x1c\x1d a\x1fb",
    "3.14159 1e10 ½ ²", "naïve Straße ÇA été ñ", "日本語 テスト 한국어", "🙂👨‍👩‍👧 ok", "<|endoftext|>", "a<|endoftext|> b <|endoftext|>\n", "<|endoftext", "\t\t", "  ",
    "\r\n\r\n x", "é ​ ﻿", "A" * 700, "ab" * 900 + " " + "." * 3000, "\x00\x01", "don't stop...  now!!! (ok)",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path())


@pytest.fixture(scope="module")
def pairs():
    return BytePairs(vocabulary_path())


def ids_of(pairs, text):
    return np.frombuffer(pairs.encode(text), "<u4").tolist()


def same(pairs, library, text):
    want = library.encode(text, add_special_tokens=False).ids
    got = ids_of(pairs, text)
    assert got == want, text[:80]
    assert pairs.decode(got) == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", TRICKY, ids=range(len(TRICKY)))
def test_as_the_library(pairs, library, text):
    same(pairs, library, text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'stremld.,!0123<|>"), st.characters(max_codepoint=0x2FF), st.characters(max_codepoint=0xFFFF, exclude_categories=("Cs", "Cn"))), max_size=60))
def test_noise_as_the_library(pairs, library, text):
    same(pairs, library, text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50_300), max_size=30))
def test_decoding_of_any_ids(pairs, library, ids):
    assert pairs.decode(ids) == library.decode(ids, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abcdehilnorst ", min_size=9, max_size=9), min_size=1, max_size=20))
def test_scans_and_heap_merge_alike(pairs, words):
    rows = np.frombuffer("".join(words).encode(), np.uint8).reshape(-1, 9)
    alone = [pairs.heap([pairs.letter[b] for b in w.encode()]) for w in words]
    assert [np.frombuffer(x, "<u4").tolist() for x in pairs.scan_all(rows)] == alone
    assert [pairs.scan([pairs.letter[b] for b in w.encode()]) for w in words] == alone


def test_groups_and_forgetting(pairs, library, monkeypatch):
    import llm.byte_pairs as module

    texts = [prose(300, i) + " é<|endoftext|>日本" for i in range(12)] + [None, ""]
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    for chars, memory in ((1, 0), (3000, 50), (10**9, 10**9)):
        monkeypatch.setattr(module, "HELD_CHARS", chars)
        monkeypatch.setattr(module, "MEMORY_WORDS", memory)
        assert [np.frombuffer(x, "<u4").tolist() for x in pairs.encode_all(texts)] == want


@pytest.mark.parametrize("ahead", ["", "a", "7", " ", "!"])
def test_every_character_below_the_end_of_latin(pairs, library, ahead):
    for c in map(chr, range(0x260)):
        same(pairs, library, f"{ahead}{c}x {c}{c} {c}")


def test_query_as_the_library(spark, folder, library):
    got = {r.doc_id: r for r in op11_rank_array(spark, folder).collect()}
    rows = table(spark, folder, "documents").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        own = got[r.doc_id]
        assert own.n_tokens == len(ids)
        assert own.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert own.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_odd_rows(documents, nothing, library):
    out = decode_ids(encode_texts(documents))
    assert out.columns == [*documents.columns, "ids", "decoded"]
    rows = out.collect()
    assert len(rows) == documents.count()
    assert all(r.ids == library.encode(r.text or "", add_special_tokens=False).ids and r.decoded == (r.text or "") for r in rows)
    assert encode_texts(nothing).count() == 0
    with pytest.raises(ValueError):
        encode_texts(documents, ids="score")
    with pytest.raises(ValueError):
        decode_ids(encode_texts(documents), text="lang")


def test_a_long_word_takes_little_time(pairs, library):
    same(pairs, library, prose(50, 3).replace(" ", "") * 200)
