"""Social overview, correlations, follower series and the profiles of a candidate."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from escrutinio.operators.social import (
    CAMPAIGN_PERIODS,
    NOT_COLLECTED,
    Period,
    candidate_social,
    follower_series,
    follower_summary,
)
from escrutinio.operators.statistics import BOOTSTRAP, correlation, expected_class, log_residual

# The pairs shown, x against votes.
PAIRS = (
    ("seguidores_votos", "seguidores"),
    ("engajamento_votos", "engajamento_mediano"),
    ("ritmo_votos", "posts_semana_campanha"),
)


def social_overview(
    declared: DataFrame, profiles: DataFrame, posts: DataFrame, votes: DataFrame,
    by: Sequence[str] = ("cd_cargo",), periods: Sequence[Period] = CAMPAIGN_PERIODS,
) -> DataFrame:
    """QRY-13. One row per candidacy: account, pace, engagement, expected votes and status.

    A candidacy that declared an account nobody has read yet is `nao_coletado`, not `sem_rede`.
    """
    summary = candidate_social(profiles, posts, votes, periods)
    extra = [c for c in by if c not in summary.columns]
    if extra:
        summary = summary.join(votes.select("sq_candidato", *extra), "sq_candidato")
    fit = log_residual(summary, by=by).drop(*by)
    owners = declared.select("sq_candidato").distinct().withColumn("_declarou", F.lit(True))
    waiting = F.col("username").isNull() & F.col("_declarou")
    return (
        summary.join(fit, "sq_candidato", "left")
        .join(owners, "sq_candidato", "left")
        .withColumn("status", F.when(waiting, NOT_COLLECTED).otherwise(F.col("status")))
        .withColumn("classe_esperado", expected_class(F.col("razao_obs_esperado")))
        .drop("_declarou")
    )


def social_correlations(
    summary: DataFrame, by: Sequence[str] = ("cd_cargo",), resamples: int = BOOTSTRAP
) -> DataFrame:
    """QRY-14. The three pairs of each scope in one job: pairs become rows of a longer table."""
    long = reduce(
        lambda a, b: a.unionByName(b),
        [
            summary.select(
                F.lit(name).alias("par"), *by, "sq_candidato", F.col(x).cast("double").alias("x"),
                F.col("votos").cast("double").alias("y"),
            )
            for name, x in PAIRS
        ],
    )
    return correlation(long, "x", "y", by=["par", *by], resamples=resamples)


def account_series(profiles: DataFrame) -> DataFrame:
    """QRY-15. Points of the follower series with the summary of the account beside each.

    A reading shared by two candidacies counts once, under the smaller one.
    """
    once = profiles.groupBy("username", "coletado_em").agg(
        *[
            F.min_by(c, "sq_candidato").alias(c)
            for c in profiles.columns
            if c not in ("username", "coletado_em")
        ]
    )
    summary = follower_summary(once).select(
        "username", "n_snapshots", F.col("delta_abs").alias("total_delta_abs"),
        F.col("delta_pct").alias("total_delta_pct"), F.col("dias").alias("total_dias"),
    )
    return follower_series(once).join(summary, "username")


def candidate_profiles(declared: DataFrame, profiles: DataFrame, analysed: DataFrame) -> DataFrame:
    """QRY-17. Declared accounts and those read without being declared, with the last reading."""
    key = ["sq_candidato", "username"]
    last = profiles.groupBy(*key).agg(
        F.max_by(F.struct("status", "followers_count", "follows_count", "coletado_em"), "coletado_em").alias("r")
    )
    chosen = analysed.filter(F.col("seguidores").isNotNull()).select(*key).withColumn("_a", F.lit(True))
    return (
        declared.select(*key, "url_tse", "nr_ordem", "principal")
        .join(last, key, "full_outer")
        .join(chosen, key, "left")
        .select(
            *key, "url_tse", "nr_ordem",
            F.coalesce("principal", F.lit(False)).alias("principal"),
            F.coalesce("_a", F.lit(False)).alias("analisado"),
            F.coalesce(F.col("r.status"), F.lit(NOT_COLLECTED)).alias("status"),
            F.col("r.followers_count").alias("seguidores"),
            F.col("r.follows_count").alias("seguindo"),
            F.col("r.coletado_em").alias("coletado_em"),
        )
    )


