"""Checks that live inside a plan: the job fails, with a message, on the first offending row."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, columns: Iterable[str], context: str) -> None:
    """Raise `ValueError` when `df` lacks a column. Reads the schema only (DQ-01, minimum columns)."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{context}: missing columns {missing}")


def fail(message: str, *details: Column) -> Column:
    """Expression that raises `message` followed by the text of `details`."""
    parts: list[Column] = [F.lit(message)]
    for d in details:
        parts += [F.lit(" "), F.coalesce(d.cast("string"), F.lit("null"))]
    return F.raise_error(F.concat(*parts))


def checked(value: Column, valid: Column, message: str, *details: Column) -> Column:
    """`value` where `valid` is true, an error otherwise (a null condition is an error too)."""
    return F.when(F.coalesce(valid, F.lit(False)), value).otherwise(fail(message, *details))


def in_vocabulary(label: Column, known: Sequence[str], context: str) -> Column:
    """`label` when it belongs to a closed list; null or unknown labels raise (DQ-15)."""
    return checked(label, label.isin(*known), f"{context}: unknown label", label)


def single_value(df: DataFrame, columns: Sequence[str], context: str) -> Column:
    """Condition that is true when each of `columns` present in `df` has one value, else raises.

    One-row aggregate used as a scalar subquery: `df.filter(single_value(...))` adds one
    column-pruned pass and no shuffle of the data (DQ-03).
    """
    present = [c for c in columns if c in df.columns]
    if not present:
        return F.lit(True)
    varied = F.lit(False)
    for c in present:
        some_null = (F.count(c) < F.count(F.lit(1))) & (F.count(c) > 0)
        differs = F.coalesce(F.min(c) != F.max(c), F.lit(False))
        varied = varied | differs | some_null
    message = fail(f"{context}: one value at a time in {present}")
    return df.agg(F.when(varied, message).otherwise(F.lit(True)).alias("ok")).scalar()
