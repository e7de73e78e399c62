"""Ranks, exact quantiles and previous-row lookups that survive one dominant group.

A window over a whole group sorts that group in one task. Here the values of a group are first
collapsed to (value, count) pairs with map-side combine, then cut into ordered buckets that are a
function of the value alone. Bucket totals are few, so the running count over them is cheap; only
the inside of a bucket is sorted. Equal values always share a bucket, so ties stay exact, and no
sampling is involved, so a recomputed stage gives the same answer.

Bucket totals and the rows inside the buckets both read the counts, so the counts are written once
and what they come from is read once, for any number of quantiles and, stacked, of columns.

Internal columns start with `_ord_`; callers must not use that prefix.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from escrutinio.session import cut_lineage

_SLOTS = 4096  # buckets per power of two


def order_bucket(value: Column) -> Column:
    """Integer that grows with `value`: 4096 slots inside each power of two, mirrored below zero."""
    size = F.abs(value)
    exponent = F.floor(F.log2(size))
    slot = F.floor((size / F.pow(F.lit(2.0), exponent) - 1) * _SLOTS)
    magnitude = (exponent + 1100) * (2 * _SLOTS) + slot
    return (
        F.when(value == 0, F.lit(0).cast("bigint"))
        .when(value > 0, magnitude)
        .otherwise(-magnitude)
    )


def _counts(df: DataFrame, by: Sequence[str], value: Column, bucket, weight: Column | None):
    n = F.count(F.lit(1)) if weight is None else F.sum("_ord_w")
    columns = [*by, value.alias("_ord_v")]
    if weight is not None:
        columns.append(weight.alias("_ord_w"))
    return cut_lineage(
        df.filter(value.isNotNull())
        .select(*columns)
        .groupBy(*by, "_ord_v")
        .agg(n.alias("_ord_n"))
        .withColumn("_ord_b", bucket(F.col("_ord_v")))
    )


def _bucket_totals(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per bucket: rows of the group in earlier buckets, and rows of the whole group."""
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    earlier = group.orderBy("_ord_b").rowsBetween(Window.unboundedPreceding, -1)
    return (
        counts.groupBy(*by, "_ord_b")
        .agg(F.sum("_ord_n").alias("_ord_bn"))
        .withColumn("_ord_before", F.coalesce(F.sum("_ord_bn").over(earlier), F.lit(0)))
        .withColumn("_ord_total", F.sum("_ord_bn").over(group))
    )


def _inside(by: Sequence[str]):
    return (
        Window.partitionBy(*by, "_ord_b")
        .orderBy("_ord_v")
        .rowsBetween(Window.unboundedPreceding, -1)
    )


def _ranked(df, by, value, bucket, weight) -> DataFrame:
    counts = _counts(df, by, value, bucket, weight)
    totals = _bucket_totals(counts, by).drop("_ord_bn")
    start = F.col("_ord_before") + F.coalesce(F.sum("_ord_n").over(_inside(by)), F.lit(0))
    return counts.join(totals, [*by, "_ord_b"]).select(*by, "_ord_v", "_ord_n", "_ord_total", start.alias("_ord_start"))


def average_ranks(
    df: DataFrame, by: Sequence[str], value: str, rank: str = "posto", weight: str | None = None
) -> DataFrame:
    """WIN-12. One row per distinct value of a group with its rank 1..n; ties share the mean.

    Join it back on `by` and the value. `weight` counts a row that many times.
    """
    ranked = _ranked(
        df, by, F.col(value).cast("double"), order_bucket, None if weight is None else F.col(weight)
    )
    return ranked.select(
        *by,
        F.col("_ord_v").alias(value),
        (F.col("_ord_start") + (F.col("_ord_n") + 1) / F.lit(2.0)).alias(rank),
        F.col("_ord_total").alias("n_grupo"),
    )


def dense_index(df: DataFrame, by: Sequence[str], key: str, index: str = "indice") -> DataFrame:
    """`df` with a 0-based position of each row in its group; `key` is unique inside the group.

    The order is that of the md5 of the key's text: spread evenly, the same in any engine, and not an
    ordering of the data.
    """
    hashed = df.withColumn("_ord_h", F.md5(F.col(key).cast("string").cast("binary")))
    # The first four digits: 65,536 buckets, each sorted by itself.
    head = lambda h: F.conv(F.substring(h, 1, 4), 16, 10).cast("int")
    ranked = _ranked(hashed, by, F.col("_ord_h"), head, None)
    positions = ranked.select(*by, F.col("_ord_v").alias("_ord_h"), F.col("_ord_start").alias(index))
    return hashed.join(positions, [*by, "_ord_h"]).drop("_ord_h")


def exact_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    quantiles: Mapping[str, float],
    count: str | None = None,
    weight: str | None = None,
) -> DataFrame:
    """STA-03. Linearly interpolated quantiles of the non-null values of each group.

    One row per group that has a value: `by`, one column per entry of `quantiles`, and the number
    of values as `count` when asked. With no `by` there is one row, null without values. `weight`
    counts a row that many times.
    """
    weights = None if weight is None else F.col(weight)
    counts = _counts(df, by, F.col(value).cast("double"), order_bucket, weights)
    totals = _bucket_totals(counts, by)
    wanted = []
    for i, (_, q) in enumerate(quantiles.items()):
        place = (F.col("_ord_total") - 1) * F.lit(float(q))
        low = F.floor(place)
        wanted += [
            F.struct(F.lit(2 * i).alias("k"), low.alias("p"), (place - low).alias("f")),
            F.struct(F.lit(2 * i + 1).alias("k"), F.ceil(place).alias("p"), (place - low).alias("f")),
        ]
    in_bucket = F.filter(
        F.array(*wanted),
        lambda s: (s["p"] >= F.col("_ord_before")) & (s["p"] < F.col("_ord_before") + F.col("_ord_bn")),
    )
    targets = totals.withColumn("_ord_wanted", in_bucket).filter(F.size("_ord_wanted") > 0)
    start = F.col("_ord_before") + F.coalesce(F.sum("_ord_n").over(_inside(by)), F.lit(0))
    hits = (
        counts.join(targets, [*by, "_ord_b"])
        .withColumn("_ord_start", start)
        .withColumn(
            "_ord_hit",
            F.explode(
                F.filter(
                    F.col("_ord_wanted"),
                    lambda s: (s["p"] >= F.col("_ord_start")) & (s["p"] < F.col("_ord_start") + F.col("_ord_n")),
                )
            ),
        )
    )
    picks = []
    for i in range(len(quantiles)):
        for k in (2 * i, 2 * i + 1):
            picks.append(F.max(F.when(F.col("_ord_hit.k") == k, F.col("_ord_v"))).alias(f"_ord_q{k}"))
        picks.append(F.max(F.when(F.col("_ord_hit.k") == 2 * i, F.col("_ord_hit.f"))).alias(f"_ord_f{i}"))
    rows = hits.groupBy(*by).agg(*picks, F.max("_ord_total").alias("_ord_total"))
    out = [
        (F.col(f"_ord_q{2 * i}") + (F.col(f"_ord_q{2 * i + 1}") - F.col(f"_ord_q{2 * i}")) * F.col(f"_ord_f{i}")).alias(
            name
        )
        for i, name in enumerate(quantiles)
    ]
    if count is not None:
        out.append(F.col("_ord_total").alias(count))
    return rows.select(*by, *out)


def column_quantiles(
    df: DataFrame,
    by: Sequence[str],
    columns: Sequence[str],
    quantiles: Mapping[str, float],
    name: str = "coluna",
    count: str | None = None,
) -> DataFrame:
    """STA-03 of several columns in one pass: one row per group and column that has a value.

    The columns are stacked into (column, value) before anything is counted, so the table is read
    and shuffled once whatever their number. With no `by`, a table without values gives no row.
    """
    long = df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        list(by), list(columns), name, "_ord_value"
    )
    return exact_quantiles(long, [*by, name], "_ord_value", quantiles, count)


def wide_quantile(rows: DataFrame, columns: Sequence[str], value: str, name: str = "coluna") -> DataFrame:
    """One row with a column per entry of `columns`, from `column_quantiles` without groups; null without values."""
    return rows.agg(*[F.max(F.when(F.col(name) == c, F.col(value))).alias(c) for c in columns])


def previous_row(
    df: DataFrame, by: Sequence[str], order: str, bucket: Column, values: Sequence[str]
) -> DataFrame:
    """`df` plus `<v>_anterior`: the values of the row before it in its group, by `order`.

    `bucket` must not decrease with `order` (the calendar month of an instant, say): rows are
    sorted inside a bucket, and the first row of a bucket takes the last row of the one before.
    """
    keyed = df.withColumn("_ord_bk", bucket)
    kept = F.struct(*[F.col(v) for v in values])
    lasts = keyed.groupBy(*by, "_ord_bk").agg(F.max_by(kept, F.col(order)).alias("_ord_last"))
    across = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("_ord_bk")
    lasts = lasts.select(*by, "_ord_bk", F.lag("_ord_last").over(across).alias("_ord_carry"))
    inside = Window.partitionBy(*by, "_ord_bk").orderBy(order)
    before = F.coalesce(F.lag(kept).over(inside), F.col("_ord_carry"))
    return (
        keyed.join(lasts, [*by, "_ord_bk"])
        .withColumn("_ord_prev", before)
        .select(*df.columns, *[F.col(f"_ord_prev.{v}").alias(f"{v}_anterior") for v in values])
    )
