"""Group totals beside the rows, without a window over the group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def with_totals(df: DataFrame, by: Sequence[str], **aggregates: Column) -> DataFrame:
    """WIN-01. `df` plus one column per aggregate, taken over `by` or over the whole table.

    A partial aggregate joined back. The small side is broadcast only when AQE measures it small;
    otherwise the join shuffles and a dominant key is split by the skew rule. With no `by` the
    aggregates are a scalar subquery, so no join is planned at all.
    """
    named = [value.alias(name) for name, value in aggregates.items()]
    if by:
        return df.join(df.groupBy(*by).agg(*named), list(by), "left")
    row = df.agg(F.struct(*named).alias("t")).scalar()
    out = df.withColumn("_t", row)
    return out.select(*df.columns, *[F.col(f"_t.{name}").alias(name) for name in aggregates])


def money_sum(value: Column) -> Column:
    """Exact sum of an amount of money: independent of row order and of partitioning."""
    return F.sum(value.cast("decimal(18,4)")).cast("double")


def money_sum_where(value: Column, condition: Column) -> Column:
    """Exact sum over the rows of a condition; zero when there is none."""
    return F.coalesce(money_sum(F.when(condition, value)), F.lit(0.0))


def sum_where(value: Column, condition: Column) -> Column:
    """Integer sum over the rows of a condition; zero when there is none."""
    return F.coalesce(F.sum(F.when(condition, value)), F.lit(0).cast("bigint"))
