import hashlib
import re

import numpy as np

from llm.personal_data import BASE, CELLS, KINDS, base_spans, candidates, find, fit, op1_weak_supervision, redact

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def brute(t):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(t):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(t):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


ODD = [
    "a@b.c@d.e.f x@y z@w.", "@a.b ..@-.-", "é.x@ñ.com a+b%c@d-e.f-g.", "1.2.3.4.5.6.7.8.9", "256.1.1.1 001.002.003.004", "1.2.3", "x1.2.3.4y",
    "4111 1111 1111 1111, 4111-1111-1111-1111. 4111  1111", "41111111111111111111111", "5500005555555559 5500005555555550", "+1 (706) 555-3138 4644348398010899",
    "+49 30 1234567. +1 +2 3", "+1 (826) 555-4081 190 12345", "++12345678901 +1-2-3-4-5-6-7-8-9-0-", "0" * 40, "+" + "1 " * 50, "",
]


def test_base_spans_on_odd_texts():
    import random

    r = random.Random(3)
    noise = ["".join(r.choice("01 .-+@a(b)\n25é") for _ in range(120)) for _ in range(400)]
    for t in [*ODD, *noise]:
        assert [(a, k, b) for k, a, b in base_spans(t)] == brute(t), t


def test_long_runs_are_linear():
    for t in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "@" * 100_000, "+1" * 100_000):
        assert isinstance(base_spans(t), list)


def test_query_keeps_base_spans(spark, folder):
    folder = folder.replace("0.001", "0.01")
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    more = 0
    for r in op1_weak_supervision(spark, folder).collect():
        base = brute(texts[r.doc_id])
        lines = [f"{BASE[k]}:{a}:{b}" for a, k, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(lines).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in base) for i in range(4)]
        spans = r.spans.split(",") if r.spans else []
        assert set(lines) <= set(spans)
        keys = [(int(s.split(":")[1]), KINDS.index(s.split(":")[0])) for s in spans]
        assert keys == sorted(keys)
        more += len(spans) - len(lines)
    assert more > 0


def test_em_trusts_labelers_that_agree():
    counts = np.zeros(CELLS)
    good = candidates('token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" x')
    bad = candidates("path/abcdefghijklm1234nopqrstuvw-xyz/part x")
    assert len(good) == 1 and len(bad) == 1
    counts[good[0]["cell"]], counts[bad[0]["cell"]] = 100, 100
    p = fit(counts)
    assert p[good[0]["cell"]] > 0.9 and p[bad[0]["cell"]] < 0.5


def test_edge_rows(documents, nothing):
    assert find(documents).count() == documents.count()
    assert all(r.spans == [] for r in find(documents).collect())
    assert find(nothing).count() == 0 and redact(nothing).count() == 0
    assert redact(documents).columns == documents.columns
    assert sorted(map(str, redact(documents).collect())) == sorted(map(str, documents.collect()))


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "mail a@b.co or 1.2.3.4, now", 99), (2, None, None)], "doc_id long, text string, n_chars int")
    rows = {r.doc_id: r for r in redact(docs, count="n_chars").collect()}
    assert rows[1].text == "mail [EMAIL] or [IP], now" and rows[1].n_chars == len(rows[1].text)
    assert rows[2].text is None and rows[2].n_chars is None


def test_long_credentials(spark):
    """A session token of 300 characters and a key of 2,000 are found and redacted whole; long runs stay linear."""
    r = __import__("random").Random(6)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    token = lambda n: "a1B" + "".join(r.choice(letters) for _ in range(n - 3))
    texts = [f'token = "{token(n)}" x' for n in (40, 129, 150, 300, 2000) for _ in range(8)]
    secret = KINDS.index("secret")
    for t in texts:
        assert [(s["kind"], s["start"], s["end"]) for s in candidates(t)] == [(secret, 9, len(t) - 3)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {x.text for x in redact(df).collect()} == {'token = "[SECRET]" x'}
    for t in ("a1" * 100_000, "a1" * 100_000 + "="):
        assert len(candidates(t)) <= 1
