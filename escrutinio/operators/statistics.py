"""Rank correlation with bootstrap intervals, log regression, small classifiers."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from escrutinio.functions.checks import checked, require_columns
from escrutinio.functions.rates import ratio
from escrutinio.operators.ordering import average_ranks, exact_quantiles
from escrutinio.session import cut_lineage

MIN_PAIRS = 10  # fixed value: pairs below which a correlation is not reported
BOOTSTRAP = 2000  # fixed value: resamples
BOOTSTRAP_SEED = 2026  # fixed value
LEVEL = 0.95  # fixed value
BLOCK = 8  # resamples drawn together by one task
TASK_DRAWS = 100_000  # draws a task is given, while tasks are fewer than the next figure
MAX_TASKS = 20_000
SORTED_PAIRS = 1_000_000  # distinct pairs of a group that one task may sort


def _pair_counts(df: DataFrame, by: Sequence[str], x: str, y: str, weight: str | None) -> DataFrame:
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    xs, ys = F.col(x).cast("double"), F.col(y).cast("double")
    return (
        df.filter(xs.isNotNull() & ys.isNotNull())
        .groupBy(*by, xs.alias("_x"), ys.alias("_y"))
        .agg(n.alias("_w"))
    )


def _rank_pearson(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Pearson correlation of average ranks, from weighted distinct pairs."""
    rx = average_ranks(pairs, by, "_x", "_rx", "_w")
    ry = average_ranks(pairs, by, "_y", "_ry", "_w").drop("n_grupo")
    placed = pairs.join(rx, [*by, "_x"]).join(ry, [*by, "_y"])
    middle = (F.col("n_grupo") + 1) / F.lit(2.0)
    dx, dy = F.col("_rx") - middle, F.col("_ry") - middle
    w = F.col("_w")
    sums = placed.groupBy(*by).agg(
        F.sum(w).alias("n"),
        F.sum(w * dx * dy).alias("_xy"),
        F.sum(w * dx * dx).alias("_xx"),
        F.sum(w * dy * dy).alias("_yy"),
    )
    rho = ratio(F.col("_xy"), F.sqrt(F.col("_xx") * F.col("_yy")))
    return sums.select(*by, "n", F.when(F.col("n") >= 2, rho).alias("rho"))


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """STA-01. Rank correlation with mean ranks for ties; null pairs are left out.

    Fewer than two pairs or a constant side give null.
    """
    require_columns(df, [*by, x, y], "spearman")
    return _rank_pearson(_pair_counts(df, by, x, y, None), by)


def _draw_window(m: Column) -> tuple[Column, Column]:
    """Least and greatest number a Poisson draw of mean m can give: eight deviations and some more."""
    reach = F.lit(8.0) * F.sqrt(m.cast("double"))
    return F.greatest(F.floor(m - reach) - 8, F.lit(0).cast("bigint")), F.floor(m + reach) + 12


def _draw_steps(m: Column, low: Column, high: Column) -> Column:
    """Cumulative probabilities of low, low + 1, ..., high for a Poisson number of mean m.

    Built once per pair by the ratio of neighbouring probabilities, so its length grows with the
    square root of m alone.
    """
    start = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("c"), F.array().cast("array<double>").alias("all"))

    def step(s: Column, k: Column) -> Column:
        p = F.when(k == low, F.lit(1.0)).otherwise(s["p"] * m.cast("double") / k.cast("double"))
        return F.struct(p.alias("p"), (s["c"] + p).alias("c"), F.array_append(s["all"], s["c"] + p).alias("all"))

    return F.aggregate(
        F.sequence(low, high), start, step, lambda s: F.transform(s["all"], lambda c: c / s["c"])
    )


def _uniform(seed: int, resample: Column, identity: Column) -> Column:
    text = F.concat_ws("|", F.lit(str(seed)), resample.cast("string"), identity.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def _drawn(spread: DataFrame, by: Sequence[str], seed: int, resamples: int) -> DataFrame:
    """Pairs of a block of resamples with how often each counts in each of them, where it counts at all.

    One hash and one inversion for each. The uniform number comes out of a generator, whose input
    Spark does not copy into later expressions, so it is hashed once however often it is compared.
    """
    low, high = _draw_window(F.col("_m"))
    first, last = (F.col("_block") - 1) * BLOCK + 1, F.least(F.col("_block") * BLOCK, F.lit(resamples))
    rows = spread.filter("_block > 0").withColumn("_low", low).withColumn("_steps", _draw_steps(F.col("_m"), low, high))
    rows = rows.withColumn("_rep", F.explode(F.sequence(first, last)))
    rows = rows.withColumn("_u", F.explode(F.array(_uniform(seed, F.col("_rep"), F.col("_id")))))
    # Pairs that occur once, the rule, give at most 12 out of a number of 32 bits.
    single = reduce(lambda a, b: a + b, [(F.col("_u") >= F.col("_steps")[k]).cast("bigint") for k in range(13)])
    other = F.col("_low") + F.size(F.filter("_steps", lambda c: c <= F.col("_u")))
    weight = F.explode(F.array(F.when(F.col("_m") == 1, single).otherwise(other)))
    return rows.select(*by, "_block", "_rep", "_x", "_y", weight.alias("_w")).filter("_w > 0")


def _sorted_pearson(drawn: DataFrame, by: Sequence[str]) -> DataFrame:
    """Pearson correlation of average ranks of (_x, _y) counted `_w` times, by windows over each group."""

    def rank(c: str) -> Column:
        upto = F.sum("_w").over(Window.partitionBy(*by).orderBy(c))
        return upto - (F.sum("_w").over(Window.partitionBy(*by, c)) - 1) / F.lit(2.0)

    placed = drawn.withColumn("_rx", rank("_x")).withColumn("_ry", rank("_y"))
    w, n = F.col("_w"), F.col("_n")
    sums = placed.groupBy(*by).agg(
        F.sum(w).cast("double").alias("_n"),
        F.sum(w * F.col("_rx") * F.col("_ry")).alias("_xy"),
        F.sum(w * F.col("_rx") * F.col("_rx")).alias("_xx"),
        F.sum(w * F.col("_ry") * F.col("_ry")).alias("_yy"),
    )
    # Ranks have the mean (n + 1) / 2 whatever the ties.
    base = n * (n + 1) * (n + 1) / 4
    rho = ratio(F.col("_xy") - base, F.sqrt((F.col("_xx") - base) * (F.col("_yy") - base)))
    return sums.select(*by, F.when(n >= 2, rho).alias("rho"))


def correlation(
    df: DataFrame,
    x: str,
    y: str,
    by: Sequence[str] = ("cd_cargo",),
    id_column: str = "sq_candidato",
    resamples: int = BOOTSTRAP,
    level: float = LEVEL,
    seed: int = BOOTSTRAP_SEED,
    minimum: int = MIN_PAIRS,
    sorted_pairs: int = SORTED_PAIRS,
) -> DataFrame:
    """STA-02. Rank correlation per group with a percentile bootstrap interval.

    Equal pairs are one row with their number m, and in each resample it counts a Poisson number of
    mean m, drawn by inversion out of one md5 of (seed, resample, smallest id). So work follows the
    distinct pairs, and no resample needs positions or the size of its group. Only pairs are
    shuffled, to the blocks of resamples they are drawn in; draws are made, ranked and summed where
    they are. Groups of more than `sorted_pairs` distinct pairs, too many to sort in one task, are
    ranked through ordered buckets instead, with the same draws and results.

    Draws do not depend on the partitioning, and SQL can repeat them. They differ from those of
    another generator, so the interval agrees statistically and `rho` exactly.
    """
    require_columns(df, [*by, x, y, id_column], "correlation")
    if not 0 < level < 1:
        raise ValueError(f"correlation: level must be between 0 and 1, got {level}")
    if resamples < 1:
        raise ValueError("correlation: resamples must be positive")
    xs, ys = F.col(x).cast("double"), F.col(y).cast("double")
    # Everything below reads the pairs several times, so what they come from is computed once.
    pairs = cut_lineage(
        df.select(*by, F.col(id_column).alias("_id"), xs.alias("_x"), ys.alias("_y"))
        .groupBy(*by, "_x", "_y")
        .agg(F.min("_id").alias("_id"), F.count(F.lit(1)).alias("_m"))
    )
    complete = F.col("_x").isNotNull() & F.col("_y").isNotNull()
    sizes = pairs.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(complete, F.col("_m"))), F.lit(0).cast("bigint")).alias("n"),
        F.coalesce(F.sum(F.when(~complete, F.col("_m"))), F.lit(0).cast("bigint")).alias("n_excluidos"),
        F.count_if(complete).alias("_d"),
    )
    reported = sizes.filter(F.col("n") >= minimum)
    keys = list(by)
    pool = pairs.filter(complete)
    blocks = -(-resamples // BLOCK)
    # The pairs are few beside their draws, so tasks are as many as the draws ask for.
    extent = reported.agg(F.max("_d").alias("largest"), F.sum("_d").alias("all")).first()
    tasks = max(1, min(MAX_TASKS, -(-(extent["all"] or 0) * resamples // TASK_DRAWS)))

    def replicas_of(groups: DataFrame, rank: Callable[[DataFrame, Sequence[str]], DataFrame]) -> DataFrame:
        own = pool.join(groups.select(*by), keys, "left_semi")
        # Block 0 is the sample itself; the others hold `BLOCK` resamples each.
        spread = own.select(
            *by, "_id", "_x", "_y", "_m", F.explode(F.sequence(F.lit(0), F.lit(blocks))).alias("_block")
        ).repartition(tasks, *by, "_block")
        point = spread.filter("_block = 0").select(*by, "_block", F.lit(0).alias("_rep"), "_x", "_y", F.col("_m").alias("_w"))
        drawn = _drawn(spread, by, seed, resamples)
        inner = [*by, "_block", "_rep"]
        return rank(point, inner).unionByName(rank(drawn, inner)).select(*by, "_rep", "rho")

    small = replicas_of(reported.filter(F.col("_d") <= sorted_pairs), _sorted_pearson)
    if (extent["largest"] or 0) > sorted_pairs:
        many = reported.filter(F.col("_d") > sorted_pairs)
        small = small.unionByName(replicas_of(many, lambda d, keys: _rank_pearson(cut_lineage(d), keys).drop("n")))
    replicas = cut_lineage(small)
    point = replicas.filter("_rep = 0").select(*by, "rho")
    tail = (1 - level) / 2
    interval = exact_quantiles(
        replicas.filter("_rep > 0"), by, "rho", {"ic_inf": tail, "ic_sup": 1 - tail}, count="n_bootstrap_validos"
    )
    known = F.col("rho").isNotNull()
    return (
        sizes.join(point, keys, "left")
        .join(interval, keys, "left")
        .select(
            *by, "n", "n_excluidos", "rho",
            *[F.when(known, F.col(c)).alias(c) for c in ("ic_inf", "ic_sup", "n_bootstrap_validos")],
        )
    )


def log_residual(
    df: DataFrame,
    x: str = "seguidores",
    y: str = "votos",
    by: Sequence[str] = ("cd_cargo",),
    id_column: str = "sq_candidato",
    minimum: int = MIN_PAIRS,
) -> DataFrame:
    """WIN-13. Fit of log10(1+y) on log10(1+x) per group, and the residual of each row.

    The fit is one mergeable aggregate per group, joined back. Fewer than `minimum` pairs or a
    constant x give nulls; negative values raise.
    """
    require_columns(df, [*by, x, y, id_column], "log_residual")

    def log1(c: str) -> Column:
        ok = F.col(c).isNull() | (F.col(c) >= 0)
        return F.log10(1 + checked(F.col(c).cast("double"), ok, f"log_residual: negative {c}"))

    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    rows = df.withColumns({"_lx": F.when(both, log1(x)), "_ly": F.when(both, log1(y))})
    fit = (
        rows.groupBy(*by)
        .agg(
            F.regr_slope("_ly", "_lx").alias("_slope"),
            F.avg("_lx").alias("_mx"),
            F.avg("_ly").alias("_my"),
            F.count("_lx").alias("_k"),
            (F.max("_lx") > F.min("_lx")).alias("_varied"),
        )
        .withColumn(
            "inclinacao", F.when((F.col("_k") >= minimum) & F.col("_varied"), F.col("_slope"))
        )
        .withColumn("intercepto", F.col("_my") - F.col("inclinacao") * F.col("_mx"))
        .select(*by, "inclinacao", "intercepto")
    )
    expected = F.col("intercepto") + F.col("inclinacao") * F.col("_lx")
    return (
        rows.join(fit, list(by), "left")
        .withColumns(
            {
                "votos_esperados": F.pow(F.lit(10.0), expected) - 1,
                "residuo_log10": F.col("_ly") - expected,
            }
        )
        .withColumn("razao_obs_esperado", F.pow(F.lit(10.0), F.col("residuo_log10")))
        .select(
            id_column, *by, "intercepto", "inclinacao", "votos_esperados", "residuo_log10",
            "razao_obs_esperado",
        )
    )


# Bounds of the labels below.
EXPECTED_FACTOR = 1.5
STRENGTH_LABELS = ((0.1, "nenhuma"), (0.3, "fraca"), (0.5, "moderada"), (0.7, "forte"))
STRENGTH_TOP = "muito forte"


def expected_class(observed_to_expected: Column) -> Column:
    """STA-10. Above or below the expected votes; near it or unknown is neutral."""
    return (
        F.when(observed_to_expected >= EXPECTED_FACTOR, "acima")
        .when(observed_to_expected <= 1 / EXPECTED_FACTOR, "abaixo")
        .otherwise("neutro")
    )


def correlation_strength(rho: Column) -> Column:
    """STA-11. Verbal strength of a correlation."""
    size = F.abs(rho)
    ladder = F.when(rho.isNull(), F.lit(None).cast("string"))
    for bound, label in STRENGTH_LABELS:
        ladder = ladder.when(size < bound, label)
    return ladder.otherwise(STRENGTH_TOP)
