"""Personal data by weak supervision: labelers vote, EM weighs them, a classifier decides on spans.

Four base kinds follow fixed patterns and are always reported. Further candidates (numbers without a
leading plus, account numbers, identity numbers, credentials) are voted on by three labelers: the
strict shape of the span, a gazetteer of words before it, and the characters around it. EM over the
counts of vote patterns estimates each labeler's reliability without labels; a logistic classifier,
fitted to the posterior over a fixed grid of features, accepts or drops the candidates.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import append_columns, free_name, over_slices, staged, table, values

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "identity", "secret")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
ANY = re.compile(r"[0-9@]")

MORE = {
    "phone": re.compile(r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])"),
    "account": re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![0-9A-Za-z])"),
    "identity": re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"),
    "secret": re.compile(r"(?<![0-9A-Za-z_/+-])[0-9A-Za-z_/+-]{20,}+(?![0-9A-Za-z_/+=-])"),
}
GAZETTEER = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "tel", "call", "fax", "mobile"),
    "account": ("iban", "account", "bank"),
    "identity": ("ssn", "social", "security", "identity", "id"),
    "secret": ("token", "secret", "password", "passwd", "key", "apikey", "auth", "bearer", "credential"),
}
WORDS = re.compile(r"[A-Za-z]+")
BEFORE = 32

# Votes: 0 against, 1 abstains, 2 in favour. Three labelers, three lengths, two shares of digits.
VOTES, LENGTHS, SHARES = 3, 3, 2
CELLS = len(KINDS) * VOTES**3 * LENGTHS * SHARES
SPAN = "array<struct<kind:int,start:int,end:int,cell:int,base:boolean>>"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _emails(t: str) -> list[tuple[int, int]]:
    """Matches by their @ sign: the local part is the whole run before it, as a leftmost search finds it."""
    out, low, at = [], 0, t.find("@")
    while at >= 0:
        start = at
        while start > low and t[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(t, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            low = m.end()
        at = t.find("@", max(at + 1, low))
    return out


def base_spans(t: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the four base kinds, leftmost and non-overlapping per kind."""
    if not ANY.search(t):
        return []
    out = [(0, a, b) for a, b in _emails(t)]
    for m in IP.finditer(t):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in m[0].split(".")):
            out.append((1, *m.span()))
    for m in CARD.finditer(t):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    for m in PHONE.finditer(t):
        if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            out.append((3, *m.span()))
    return sorted(out, key=lambda s: (s[1], s[0]))


def _shape(kind: str, s: str) -> int:
    """Labeler 1: the strict shape of a span."""
    if kind == "account":
        moved = "".join(str(int(c, 36)) for c in s[4:] + s[:4])
        return 2 if int(moved) % 97 == 1 else 0
    if kind == "identity":
        return 0 if s[:3] in ("000", "666") or s[0] == "9" or s[4:6] == "00" or s[7:] == "0000" else 2
    if kind == "secret":
        digits, upper = sum(c.isdigit() for c in s), sum(c.isupper() for c in s)
        lower = sum(c.islower() for c in s)
        if digits < 4 or upper + lower < 4:
            return 0
        hexadecimal = all(c in "0123456789abcdefABCDEF" for c in s) and len(s) in (32, 40, 64)
        return 2 if hexadecimal or (upper > 1 and lower > 1) else 1
    return 2


def _known_word(kind: str, t: str, start: int) -> int:
    """Labeler 2: a word of the kind's gazetteer shortly before the span."""
    before = [w.lower() for w in WORDS.findall(t[max(0, start - BEFORE) : start])]
    if any(w in GAZETTEER[kind] for w in before):
        return 2
    return 0 if any(w in words for k, words in GAZETTEER.items() if k != kind for w in before) else 1


def _surroundings(kind: str, t: str, start: int, end: int) -> int:
    """Labeler 3: the characters that touch the span or stand one space away."""
    left, right = t[max(0, start - 2) : start], t[end : end + 1]
    if kind == "secret":
        if left.endswith(("/", "#", "?", "&")):
            return 0
        return 2 if left[-1:] in ('"', "'", "=", ":") or left in ("= ", ": ") else 1
    if left[-1:].isalnum() or right.isalnum():
        return 0
    return 2 if left[-1:] in ("", " ", "\n", ":", "(", "<") and right in ("", " ", "\n", ",", ".", ";", ")", ">") else 1


def candidates(t: str | None) -> list[dict]:
    """Base spans and further candidates that touch none, each with its cell of votes and features."""
    if not t or not ANY.search(t):
        return []
    spans = [(k, a, b, True) for k, a, b in base_spans(t)]
    taken = bytearray(len(t))
    for _, a, b, _ in spans:
        taken[a:b] = b"\1" * (b - a)
    for kind, pattern in MORE.items():
        for m in pattern.finditer(t):
            a, b = m.span()
            if taken.find(1, a, b) < 0 and any("0" <= c <= "9" for c in m[0]):
                spans.append((KINDS.index(kind), a, b, False))
                taken[a:b] = b"\1" * (b - a)
    out = []
    for kind, a, b, base in sorted(spans, key=lambda s: (s[1], s[0])):
        name, s = KINDS[kind], t[a:b]
        votes = (2 if base else _shape(name, s), _known_word(name, t, a), _surroundings(name, t, a, b))
        length = 0 if b - a < 16 else 1 if b - a < 40 else 2
        share = int(sum("0" <= c <= "9" for c in s) * 2 >= b - a)
        cell = kind
        for vote in votes:
            cell = cell * VOTES + vote
        out.append({"kind": kind, "start": a, "end": b, "cell": (cell * LENGTHS + length) * SHARES + share, "base": base})
    return out


def _grid() -> np.ndarray:
    """Kind, three votes, length and share of digits of every cell."""
    return np.array(np.unravel_index(np.arange(CELLS), (len(KINDS), VOTES, VOTES, VOTES, LENGTHS, SHARES))).T


def reliabilities(counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """EM over counts per cell: P(true) per cell, and P(vote | false or true) per kind and labeler.

    Labelers are independent given the truth. Starts from labelers that are right more often than
    not; a little pseudo-count keeps that direction where a kind has few candidates.
    """
    grid, kinds = _grid(), len(KINDS)
    start = np.array([[0.5, 0.4, 0.1], [0.1, 0.4, 0.5]])
    votes = np.tile(start, (kinds, 3, 1, 1))
    prior = np.full(kinds, 0.5)
    for _ in range(rounds):
        logs = np.log(np.stack([1 - prior, prior], axis=1))[grid[:, 0]]
        for j in range(3):
            logs = logs + np.log(votes[grid[:, 0], j, :, grid[:, 1 + j]])
        p = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -50, 50)))
        for k in range(kinds):
            own = grid[:, 0] == k
            n = counts[own]
            prior[k] = (n @ p[own] + 1) / (n.sum() + 2)
            for j in range(3):
                for y, q in ((0, 1 - p[own]), (1, p[own])):
                    sums = np.array([(n * q)[grid[own, 1 + j] == v].sum() for v in range(VOTES)]) + 4 * start[y]
                    votes[k, j, y] = sums / sums.sum()
    return p, votes


def fit(counts: np.ndarray) -> np.ndarray:
    """Probability of a true span per cell: a logistic classifier fitted to the EM posterior.

    Cells that no candidate has count a little, at the posterior of their votes, so they have a
    sensible probability too.
    """
    posterior, _ = reliabilities(counts)
    grid = _grid()
    sizes = (len(KINDS), VOTES, VOTES, VOTES, LENGTHS, SHARES)
    x = np.concatenate([np.eye(n)[grid[:, i]] for i, n in enumerate(sizes)] + [np.ones((CELLS, 1))], axis=1)
    weight = np.sqrt(counts) + 0.05
    weight /= weight.sum()
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-x @ w))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(x.shape[1])
        w += np.linalg.solve(h, x.T @ (weight * (posterior - p)) - 1e-4 * w)
    return 1 / (1 + np.exp(-x @ w))


def _accepted(cells: DataFrame, threshold: float) -> list[int]:
    """Cells whose spans are kept, from counts per cell (at most CELLS rows to the driver)."""
    counts = np.zeros(CELLS)
    for r in cells.groupBy("cell").count().collect():
        counts[r.cell] = r["count"]
    return [int(c) for c in np.flatnonzero(fit(counts) >= threshold)]


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Per row: its key and its spans (kind, start, end in code points, base), in order of start and kind.

    Null and empty texts have none; repeated rows are searched each; an empty table gives no rows.
    """
    chosen = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    make = lambda batch: {"_found": [candidates(t) for t in values(batch, "text")]}
    found = staged(append_columns(chosen, make, f"_found {SPAN}").drop("text"), "spans")
    kept = F.array(*[F.lit(c) for c in _accepted(found.select(F.explode("_found.cell").alias("cell")), threshold)] or [F.lit(-1)])
    spans = F.filter("_found", lambda s: s["base"] | F.array_contains(kept, s["cell"]))
    return found.select("doc_id", spans.alias("spans"))


def redact(docs: DataFrame, text: str = "text", threshold: float = 0.5, count: str | None = None) -> DataFrame:
    """`docs` with every span replaced by its kind in brackets; overlapping spans by the first's.

    Other columns stay, but for `count`, which becomes the new length in code points. Null stays null.
    """
    cells = over_slices(docs.select(F.col(text).alias("text")), lambda b: {"cell": [s["cell"] for t in values(b, "text") for s in candidates(t)]}, "cell int")
    accepted = frozenset(_accepted(cells, threshold))
    name = free_name(docs, "_redacted")

    def make(batch) -> dict:
        out = []
        for t in values(batch, text):
            parts, at = [], 0
            for s in candidates(t):
                if s["base"] or s["cell"] in accepted:
                    if s["start"] >= at:
                        parts += [t[at : s["start"]], f"[{KINDS[s['kind']].upper()}]"]
                    at = max(at, s["end"])
            out.append("".join(parts) + t[at:] if parts else t)
        return {name: out}

    new = F.col(f"`{name}`")
    columns = [new.alias(c) if c == text else F.length(new).cast(docs.schema[c].dataType).alias(c) if c == count else F.col(f"`{c}`") for c in docs.columns]
    return append_columns(docs, make, f"`{name}` string").select(*columns)


def _listed(spans):
    names = F.array(*[F.lit(k) for k in KINDS])
    line = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, line), ",")


def op1_weak_supervision(spark: SparkSession, folder: str) -> DataFrame:
    found = find(table(spark, folder, "documents"))
    number = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long")
    base = F.filter("spans", lambda s: s["base"])
    return found.select(
        "doc_id", *[number(i).alias(f"n_{k}") for i, k in enumerate(BASE)],
        F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"),
    )


QUERIES = {"op1_weak_supervision": op1_weak_supervision}
