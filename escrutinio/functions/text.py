"""Label and search-text normalisation, relevance of a search hit, month strings."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F


LATIN_END = "\u0250"  # letters below it are told from their folding by a short table
HANGUL = range(0xAC00, 0xD7A4)  # composed by rule; such syllables stay as they are
OPEN, CLOSE = "\u0001", "\u0002"  # around entries of the table of longer replacements


@cache
def _decompositions(form: str) -> tuple[str, str, str]:
    """Characters that become one other without their marks, those others, and a table of the rest.

    Built from the Unicode decomposition rule over the whole character set, because Spark SQL has no
    normalisation function. An entry of the table is the character, its replacement and the marks.
    """
    source, target, longer = [], [], []
    for code in range(0xA0, 0x110000):
        if code in HANGUL or 0xD800 <= code < 0xE000:
            continue
        char = chr(code)
        if unicodedata.is_normalized(form, char):
            continue
        bare = "".join(c for c in unicodedata.normalize(form, char) if unicodedata.category(c)[0] != "M")
        if bare == char or unicodedata.category(char)[0] == "M":
            continue  # marks go by their class
        if len(bare) == 1:
            source.append(char)
            target.append(bare)
        else:
            longer.append(f"{OPEN}{char}{bare}{CLOSE}")
    return "".join(source), "".join(target), "".join(longer)


def strip_accents(text: Column, form: str = "NFD") -> Column:
    """Letters without marks; form NFKD also folds compatibility characters (`2º` becomes `2o`)."""
    source, target, longer = _decompositions(form)
    # Nearly all labels hold European letters alone: a short table does for them, and no marks occur.
    short = [(s, t) for s, t in zip(source, target, strict=True) if s < LATIN_END]
    long_entries = [e for e in longer[1:].split(OPEN) if e]
    near = "".join(re.escape(e[0]) for e in long_entries if e[0] < LATIN_END)
    beyond = text.rlike(rf"[^\x00-\u024F{'' if not near else ']|['}{near}]")
    simple = F.translate(text, "".join(s for s, _ in short), "".join(t for _, t in short))
    plain = F.regexp_replace(F.translate(text, source, target), r"\p{M}+", "")
    if not longer:
        return F.when(beyond, plain).otherwise(simple)
    table = F.lit(longer)

    def unfolded(char: Column) -> Column:
        key = F.concat(F.lit(OPEN), char)
        after = F.call_function("substring_index", table, key, F.lit(-1))
        entry = F.call_function("substring_index", after, F.lit(CLOSE), F.lit(1))
        return F.when(F.contains(table, key), entry).otherwise(char)

    # Few texts hold a character that folds to several; only they are taken apart.
    known = "".join(e[0] for e in long_entries if "\u1e00" <= e[0] < "\u1f00") + near
    rare = plain.rlike(rf"[^\x00-\u024F\u1E00-\u1EFF]|[{known}]")
    whole = F.when(rare, F.array_join(F.transform(F.split(plain, ""), unfolded), "")).otherwise(plain)
    return F.when(beyond, whole).otherwise(simple)


def collapse_spaces(text: Column) -> Column:
    """EXP-09. Trim and collapse white space, keeping case and accents."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize_label(label: Column) -> Column:
    """EXP-08. Upper case, no accents, single spaces."""
    return collapse_spaces(F.upper(strip_accents(label, "NFKD")))


def normalize_search(text: Column) -> Column:
    """EXP-10. Lower case, no accents, single spaces."""
    return collapse_spaces(strip_accents(F.lower(text), "NFD"))


def text_relevance(term: str, ballot: Column, civil: Column, party: Column) -> Column:
    """EXP-12 for text. 0 exact, 1 start of a name, 2 start of a word, 3 inside, null no match.

    The columns hold normalised text; `term` is normalised by the caller.
    """
    names = [F.coalesce(c, F.lit("")) for c in (ballot, civil, party)]
    word = F.lit(False)
    inside = F.lit(False)
    for n in names:
        word = word | n.startswith(term) | n.contains(" " + term)
        inside = inside | n.contains(term)
    return (
        F.when(names[0] == term, 0)
        .when(names[0].startswith(term) | names[1].startswith(term), 1)
        .when(word, 2)
        .when(inside, 3)
    )


def number_relevance(term: str, number: Column, party: Column) -> Column:
    """EXP-12 for digits. 0 exact number, 1 prefix of the number, 2 party number."""
    text = F.coalesce(number.cast("string"), F.lit(""))
    return (
        F.when(text == term, 0)
        .when(text.startswith(term), 1)
        .when(party.cast("bigint") == int(term), 2)
    )


def relevance(term: str, ballot: Column, civil: Column, party: Column, number: Column,
              party_number: Column) -> Column:
    """EXP-12. Tier of a hit for a normalised term, null when the row does not match."""
    if term.isdigit():
        return number_relevance(term, number, party_number)
    return text_relevance(term, ballot, civil, party)


MONTH_PATTERN = r"^\d{4}-(0[1-9]|1[0-2])$"  # fixed value: month label format


def is_month(label: Column) -> Column:
    """EXP-31. True for a `YYYY-MM` label."""
    return label.rlike(MONTH_PATTERN)


def next_month(label: Column) -> Column:
    """EXP-31. The month after a `YYYY-MM` label."""
    return F.date_format(F.add_months(F.to_date(label, "yyyy-MM"), 1), "yyyy-MM")


def month_number(label: Column) -> Column:
    """Months since year zero, so that consecutive months differ by one."""
    return F.substring(label, 1, 4).cast("int") * 12 + F.substring(label, 6, 2).cast("int")
