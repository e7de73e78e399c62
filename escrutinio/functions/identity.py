"""Pseudonymous person keys. Raw documents never leave these expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefix and length of the public identifier.
PUBLIC_PREFIX = "pub:"
PUBLIC_LENGTH = 12


def public_id(person: Column) -> Column:
    """EXP-13. Short public identifier derived from the internal person key."""
    return F.substring(F.sha2(F.concat(F.lit(PUBLIC_PREFIX), person), 256), 1, PUBLIC_LENGTH)


def salt_fingerprint(salt: str) -> Column:
    """DQ-16. Twelve hex digits that identify a salt without revealing it."""
    return F.substring(F.sha2(F.lit(salt), 256), 1, 12)


def _digit(text: Column, position: int) -> Column:
    return F.ascii(F.substring(text, position, 1)) - F.lit(48)


def _all_equal(text: Column, length: int) -> Column:
    return text == F.repeat(F.substring(text, 1, 1), F.lit(length))


def taxpayer_id_is_valid(digits: Column) -> Column:
    """EXP-15. Eleven digits, not all equal, both weighted modulo-11 check digits right."""
    valid = (F.length(digits) == 11) & ~_all_equal(digits, 11)
    for size in (9, 10):
        weighted = F.lit(0)
        for k in range(size):
            weighted = weighted + _digit(digits, k + 1) * F.lit(size + 1 - k)
        valid = valid & ((weighted * 10 % 11 % 10) == _digit(digits, size + 1))
    return F.coalesce(valid, F.lit(False))


def voter_id_is_valid(digits: Column) -> Column:
    """Twelve digits, not all equal."""
    return F.coalesce((F.length(digits) == 12) & ~_all_equal(digits, 12), F.lit(False))


def person_key(taxpayer: Column, voter: Column, salt: str) -> Column:
    """EXP-14. Salted SHA-256 of the first valid document; null when neither identifies anyone."""
    options = []
    for raw, test in ((taxpayer, taxpayer_id_is_valid), (voter, voter_id_is_valid)):
        digits = F.regexp_replace(raw, r"\D", "")
        declared = raw.isNotNull() & ~F.ltrim(raw).startswith("-")
        options.append(
            F.when(declared & test(digits), F.sha2(F.concat(F.lit(salt), digits), 256))
        )
    return F.coalesce(*options)


def ran_on_ballot(result_code: Column) -> Column:
    """EXP-16. A candidacy was on the ballot when it has a round result code."""
    return result_code.isNotNull()
