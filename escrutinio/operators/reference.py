"""Comparison with a reference set: selection of elected, medians, relative profile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from escrutinio.functions.checks import checked, require_columns, single_value
from escrutinio.functions.rates import ratio
from escrutinio.functions.text import normalize_label
from escrutinio.operators.ordering import exact_quantiles
from escrutinio.session import cut_lineage

# The profile in display order and how each indicator is compared.
PROFILE = {
    "votos": "contexto",
    "pct_validos": "contexto",
    "penetracao": "razao",
    "n_municipios_com_voto": "contexto",
    "pct_maiores": "diferenca_pp",
    "n_efetivo_municipios": "razao",
    "custo_voto_pago": "razao",
    "receita_total": "contexto",
    "receita_por_voto": "razao",
    "pct_publico": "diferenca_pp",
    "pct_pessoa_fisica": "diferenca_pp",
    "pct_autofinanciamento": "diferenca_pp",
}
REFERENCE_SIZE = 5
OWN_PARTY = 14
MINIMUM_VALUES = 3
ELECTED_LABELS = ("ELEITO", "ELEITO POR QP", "ELEITO POR MEDIA")
NOT_ELECTED_LABELS = ("NAO ELEITO", "SUPLENTE", "2O TURNO")
SCOPE = ("cd_cargo", "sg_uf")


def is_elected(result: Column) -> Column:
    """True for an elected label, false for a known other label or null; unknown labels raise."""
    label = normalize_label(result)
    known = result.isNull() | label.isin(*ELECTED_LABELS, *NOT_ELECTED_LABELS)
    elected = F.coalesce(label.isin(*ELECTED_LABELS), F.lit(False))
    return checked(elected, known, "select_elected: unknown result label", result)


def select_elected(
    candidates: DataFrame,
    n: int = REFERENCE_SIZE,
    exclude_parties: Sequence[int] = (OWN_PARTY,),
    exclude_ids: Sequence[int] | DataFrame = (),
    by: Sequence[str] = SCOPE,
) -> DataFrame:
    """WIN-05. The n most voted elected candidates of other parties in each scope.

    Order is votes descending, then id. The position filter is a limit per group that Spark
    applies before the shuffle. A repeated candidacy and an elected one without votes raise.
    """
    if n < 1:
        raise ValueError(f"select_elected: n must be at least 1, got {n}")
    require_columns(
        candidates, [*by, "sq_candidato", "nr_partido", "ds_sit_tot_turno", "votos"], "select_elected"
    )
    once = (
        candidates.groupBy(*by, "sq_candidato")
        .agg(
            F.first(F.struct("nr_partido", "ds_sit_tot_turno", "votos")).alias("r"),
            F.count(F.lit(1)).alias("_rows"),
        )
        .select(
            *by,
            checked(
                F.col("sq_candidato"), F.col("_rows") == 1, "select_elected: repeated candidacy",
                F.col("sq_candidato"),
            ).alias("sq_candidato"),
            "r.*",
        )
    )
    elected = once.filter(is_elected(F.col("ds_sit_tot_turno"))).withColumn(
        "votos",
        checked(
            F.col("votos"), F.col("votos").isNotNull(), "select_elected: elected without votes",
            F.col("sq_candidato"),
        ),
    )
    if exclude_parties:
        elected = elected.filter(~F.col("nr_partido").isin(*exclude_parties))
    if isinstance(exclude_ids, DataFrame):
        elected = elected.join(exclude_ids.select("sq_candidato").distinct(), "sq_candidato", "left_anti")
    elif exclude_ids:
        elected = elected.filter(~F.col("sq_candidato").isin(*exclude_ids))
    order = Window.partitionBy(*by).orderBy(F.desc("votos"), F.asc("sq_candidato"))
    return (
        elected.withColumn("posicao", F.row_number().over(order))
        .filter(F.col("posicao") <= n)
        .select(*by, F.col("posicao").cast("bigint").alias("posicao"), "sq_candidato", "nr_partido", "votos")
    )


def _require_profile(indicators: Sequence[str], context: str) -> None:
    if not indicators:
        raise ValueError(f"{context}: no indicator asked for")
    outside = [i for i in indicators if i not in PROFILE]
    if outside:
        raise ValueError(f"{context}: indicator outside the profile: {outside}")


def _long(df: DataFrame, keys: Sequence[str], indicators: Sequence[str]) -> DataFrame:
    return df.select(*keys, *[F.col(i).cast("double").alias(i) for i in indicators]).unpivot(
        list(keys), list(indicators), "indicador", "valor"
    )


def reference_medians(
    reference: DataFrame,
    indicators: Sequence[str],
    by: Sequence[str] = SCOPE,
    minimum: int = MINIMUM_VALUES,
) -> DataFrame:
    """AGG-36. Median of each indicator per scope, null below `minimum` values; n is reported.

    The indicators are stacked and written once; counts and medians of all of them read that.
    """
    if minimum < 1:
        raise ValueError(f"reference_medians: minimum must be at least 1, got {minimum}")
    _require_profile(indicators, "reference_medians")
    require_columns(reference, [*by, *indicators], "reference_medians")
    keys = [*by, "indicador"]
    long = cut_lineage(_long(reference, by, indicators))
    counts = long.groupBy(*keys).agg(F.count("valor").alias("n"))
    medians = exact_quantiles(long, keys, "valor", {"_m": 0.5})
    return counts.join(medians, keys, "left").select(
        *keys, F.when(F.col("n") >= minimum, F.col("_m")).alias("mediana"), "n"
    )


def relative_profile(
    ours: DataFrame,
    reference: DataFrame,
    indicators: Sequence[str] = tuple(PROFILE),
    by: Sequence[str] = SCOPE,
    entity: str = "sq_candidato",
    minimum: int = MINIMUM_VALUES,
) -> DataFrame:
    """STA-09. Each of ours against the median of the reference: ratio, difference or context only.

    A scope without reference has `n_referencia` 0 and null median. One office, and one year unless
    the year is part of the scope.
    """
    context = "relative_profile"
    if "cd_cargo" not in by:
        raise ValueError(f"{context}: one office at a time, `by` must contain cd_cargo")
    _require_profile(indicators, context)
    require_columns(ours, [*by, entity, *indicators], context)
    require_columns(reference, [*by, *indicators], context)
    rows = ours
    if "ano_eleicao" not in by and "ano_eleicao" in ours.columns and "ano_eleicao" in reference.columns:
        years = ours.select("ano_eleicao").unionByName(reference.select("ano_eleicao"))
        rows = ours.filter(single_value(years, ["ano_eleicao"], context))
    medians = reference_medians(reference, indicators, by, minimum)
    kind = F.create_map(*[F.lit(x) for item in PROFILE.items() for x in item])
    value, median = F.col("valor"), F.col("mediana_referencia")
    # A repeated entity would repeat a row of the result; the grouped pass catches it.
    long = (
        _long(rows, [*by, entity], indicators)
        .groupBy(*by, entity, "indicador")
        .agg(F.first("valor").alias("valor"), F.count(F.lit(1)).alias("_rows"))
        .withColumn(
            entity,
            checked(F.col(entity), F.col("_rows") == 1, f"{context}: repeated entity", F.col(entity)),
        )
    )
    return (
        long.join(medians, [*by, "indicador"], "left")
        .select(
            *by,
            entity,
            "indicador",
            F.try_element_at(kind, F.col("indicador")).alias("tipo"),
            "valor",
            F.col("mediana").alias("mediana_referencia"),
            F.coalesce("n", F.lit(0)).cast("bigint").alias("n_referencia"),
        )
        .withColumn(
            "indice",
            F.when(F.col("tipo") == "razao", ratio(value, median)).when(
                F.col("tipo") == "diferenca_pp", value - median
            ),
        )
    )
