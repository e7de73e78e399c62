"""Ours against a reference set: profile of each candidate, reasons for gaps, medians, indices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from escrutinio.functions.rates import ratio
from escrutinio.operators.reference import PROFILE, relative_profile
from escrutinio.operators.spatial import concentration, largest_units_share
from escrutinio.session import cut_lineage

GEOGRAPHY = ("pct_maiores", "hhi", "n_efetivo_municipios")
FINANCE = (
    "custo_voto_pago", "receita_total", "receita_por_voto", "pct_publico", "pct_pessoa_fisica",
    "pct_autofinanciamento",
)
# Why a field has no number.
NO_UNITS = "sem votos em municípios"
NO_BASE = "sem eleitorado ou votos válidos na circunscrição"
NO_ACCOUNTS = "sem prestação de contas (receitas e despesas) para o candidato nos dados"
NO_VOTES = "sem votos: custo por voto indefinido"
NO_EXPENSE = "sem despesa lançada na prestação de contas"
NO_REVENUE = "sem receita lançada na prestação de contas"
ZERO_REVENUE = "receita total zero"


def geography(votes: DataFrame, electorate: DataFrame) -> DataFrame:
    """QRY-16. Units with votes, share of the largest, HHI and effective number of each candidacy.

    One grouped plan for all candidates; rows abroad have no municipality and stay out.
    """
    placed = (
        votes.filter(F.col("cd_mun_ibge").isNotNull())
        .groupBy("sq_candidato", "cd_mun_ibge")
        .agg(F.sum("votos").alias("votos"))
        .filter(F.col("votos") > 0)
    )
    spread = concentration(placed.join(electorate, "cd_mun_ibge"), electorate=electorate)
    return (
        largest_units_share(placed)
        .select("sq_candidato", "n_municipios_com_voto", "pct_maiores")
        .join(spread.select("sq_candidato", "hhi", "n_efetivo_municipios"), "sq_candidato", "left")
    )


def candidate_profiles(rated: DataFrame, shape: DataFrame, accounts: DataFrame) -> DataFrame:
    """QRY-16. Thirteen comparable fields per candidate, and a map field -> reason for each gap.

    `rated` has the votes and rates of each candidate, `shape` comes from `geography`, `accounts`
    from `candidate_accounts`. The result is written once, a row per candidate: selection, medians and
    indices all read it.
    """
    money = accounts.select("sq_candidato", *FINANCE, F.lit(True).alias("_contas"))
    rows = (
        rated.join(shape, "sq_candidato", "left")
        .join(money, "sq_candidato", "left")
        .withColumn("n_municipios_com_voto", F.coalesce("n_municipios_com_voto", F.lit(0).cast("bigint")))
    )
    reasons = []
    for c in GEOGRAPHY:
        reasons.append((c, F.when(F.col("hhi").isNull(), NO_UNITS)))
    for c in ("pct_validos", "penetracao"):
        reasons.append((c, F.when(F.col(c).isNull(), NO_BASE)))
    for c in FINANCE:
        if c == "custo_voto_pago":
            gap = F.when(F.col("votos") == 0, NO_VOTES).otherwise(NO_EXPENSE)
        else:
            gap = F.when(F.col("receita_total").isNull(), NO_REVENUE).otherwise(ZERO_REVENUE)
        reasons.append((c, F.when(F.col("_contas").isNull(), NO_ACCOUNTS).when(F.col(c).isNull(), gap)))
    pairs = F.array(*[F.struct(F.lit(c).alias("k"), r.alias("v")) for c, r in reasons])
    return cut_lineage(
        rows.withColumn("motivos", F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull()))).drop("_contas")
    )


def reference_indices(
    ours: DataFrame, reference: DataFrame, indicators: Sequence[str] = tuple(PROFILE),
    by: Sequence[str] = ("cd_cargo",), minimum: int = 1,
) -> DataFrame:
    """QRY-16. Relative profile as the screen shows it: context fields get a plain ratio too."""
    rel = relative_profile(ours, reference, indicators, by, minimum=minimum)
    return rel.withColumn(
        "indice",
        F.when(F.col("tipo") == "contexto", ratio(F.col("valor"), F.col("mediana_referencia"))).otherwise(
            F.col("indice")
        ),
    )


def side_order(side: DataFrame) -> DataFrame:
    """TOP-06. A side in display order: votes descending, then id."""
    return side.orderBy(F.desc("votos"), F.asc("sq_candidato"))
