"""Votes by destination, the entity by unit table, rates of sums, party quotas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from escrutinio.functions.checks import fail, in_vocabulary, require_columns, single_value
from escrutinio.functions.rates import (
    LOW_COUNT_THRESHOLD,
    electoral_quotient,
    expected_events,
    integer_div,
    is_low_count,
    penetration,
    ratio,
    share_of_valid,
)
from escrutinio.operators.totals import sum_where, with_totals

# Labels of the destination of a vote. Any other label is an error.
VALID_DESTINATIONS = ("Válido",)
ANNULLED_DESTINATIONS = ("Anulado", "Anulado sub judice")
LIST_DESTINATIONS = ("Válido (legenda)",)


def votes_by_destination(
    votes: DataFrame, keys: Sequence[str] = ("sq_candidato", "cd_mun_ibge")
) -> DataFrame:
    """AGG-01. Valid, annulled and list-converted nominal votes per key, in one partial aggregate.

    Round and office must have a single value unless they are keys.
    """
    label = "nm_tipo_destinacao_votos"
    require_columns(
        votes, [*keys, label, "qt_votos_nominais", "qt_votos_nominais_validos"], "votes_by_destination"
    )
    fixed = [c for c in ("nr_turno", "cd_cargo") if c not in keys]
    known = (*VALID_DESTINATIONS, *ANNULLED_DESTINATIONS, *LIST_DESTINATIONS)
    return (
        votes.filter(single_value(votes, fixed, "votes_by_destination"))
        .withColumn("_d", in_vocabulary(F.col(label), known, "votes_by_destination"))
        .groupBy(*keys)
        .agg(
            sum_where(F.col("qt_votos_nominais_validos"), F.col("_d").isin(*VALID_DESTINATIONS))
            .alias("votos_nominais_validos"),
            sum_where(F.col("qt_votos_nominais"), F.col("_d").isin(*ANNULLED_DESTINATIONS))
            .alias("votos_anulados"),
            sum_where(F.col("qt_votos_nominais"), F.col("_d").isin(*LIST_DESTINATIONS))
            .alias("votos_convertidos_legenda"),
        )
    )


MAX_UNITS = 200_000  # units an explicit-zeros table may span; polling places of a country are half of it


def _unit_key(unit: Sequence[str]) -> Column:
    """One comparable value per unit: the column itself, or the text of several."""
    return F.col(unit[0]) if len(unit) == 1 else F.to_json(F.struct(*unit))


def _unit_list(electorate: DataFrame, unit: Sequence[str]) -> Column:
    """All units in order of their key, as one array in a scalar subquery.

    The dimension is bounded: beyond `MAX_UNITS` rows the job raises, and it never gathers more. So
    does a repeated or a null unit.
    """
    counted = F.transform(F.col("all"), lambda u: u["k"])
    limited = electorate.select(_unit_key(unit).alias("k"), *unit, "aptos", "validos").limit(MAX_UNITS + 1)
    gathered = limited.agg(F.array_sort(F.collect_list(F.struct("k", *unit, "aptos", "validos"))).alias("all"))
    wrong = (
        F.when(F.size("all") > MAX_UNITS, fail("dense_table(electorate): too many units", F.size("all")))
        .when(F.size(F.array_distinct(counted)) < F.size("all"), fail("dense_table(electorate): repeated key"))
        .when(F.exists(counted, lambda k: k.isNull()), fail("dense_table(electorate): null unit"))
    )
    return gathered.select(F.coalesce(wrong, F.col("all")).alias("u")).scalar()


def dense_table(
    votes: DataFrame,
    electorate: DataFrame,
    entity: str = "sq_candidato",
    unit: Sequence[str] = ("cd_mun_ibge",),
) -> DataFrame:
    """JOI-02. Every entity in every unit: `votos` (zero where there is no row), `aptos`, `validos`.

    One shuffle by entity. The votes of an entity, at most one row per unit, become an array; the
    units it lacks are added as zeros; in order of the units both arrays lie side by side, and the
    pairs are exploded. Units come from a scalar subquery, so nothing is joined and no row is copied.
    Repeated rows, votes in a unit without electorate and votes above the valid votes raise.
    """
    unit = list(unit)
    keys = [entity, *unit]
    require_columns(votes, [*keys, "votos"], "dense_table(votes)")
    require_columns(electorate, [*unit, "aptos", "validos"], "dense_table(electorate)")
    repeated = fail("dense_table(votes): repeated key", *[F.col(k) for k in keys])
    # Rows are placed by entity first: the check for repeats and the arrays share the one shuffle.
    once = (
        votes.repartition(entity)
        .groupBy(*keys)
        .agg(F.first("votos").alias("votos"), F.count(F.lit(1)).alias("_rows"))
        .select(
            entity,
            _unit_key(unit).alias("k"),
            F.when(F.col("_rows") > 1, repeated).otherwise(F.col("votos").cast("bigint")).alias("v"),
        )
    )
    zero = F.lit(0).cast("bigint")
    own = once.groupBy(entity).agg(F.collect_list(F.struct("k", "v")).alias("_own"), F.sum("v").alias("_votos_entidade"))
    own = own.withColumn("_units", _unit_list(electorate, unit))
    known, listed = F.transform("_units", lambda u: u["k"]), F.transform("_own", lambda o: o["k"])
    orphan = F.size(F.array_except(listed, known)) > 0
    lacking = F.transform(F.array_except(known, listed), lambda k: F.struct(k.alias("k"), zero.alias("v")))
    full = F.array_sort(F.concat("_own", lacking))
    pairs = F.when(orphan, fail("dense_table: votes without electorate", F.col(entity))).otherwise(
        F.zip_with("_units", full, lambda u, o: F.struct(*[u[c].alias(c) for c in (*unit, "aptos", "validos")], o["v"].alias("votos")))
    )
    excess = fail("dense_table: votes above the valid votes", *[F.col(k) for k in keys])
    rows = own.select(entity, "_votos_entidade", F.explode(pairs).alias("_p")).select(entity, "_p.*", "_votos_entidade")
    votos = F.when(F.col("votos") > F.col("validos"), excess).otherwise(F.coalesce("votos", zero))
    return rows.select(*keys, "aptos", "validos", votos.alias("votos"), "_votos_entidade")


def with_zeros(votes: DataFrame, electorate: DataFrame, entity: str = "sq_candidato",
               unit: Sequence[str] = ("cd_mun_ibge",)) -> DataFrame:
    """JOI-02 as users read it: entity, unit, `aptos`, `validos`, `votos`."""
    return dense_table(votes, electorate, entity, unit).drop("_votos_entidade")


def unit_indicators(
    votes: DataFrame,
    electorate: DataFrame,
    entity: str = "sq_candidato",
    unit: Sequence[str] = ("cd_mun_ibge",),
    threshold: float = LOW_COUNT_THRESHOLD,
) -> DataFrame:
    """WIN-03. All indicators of the entity by unit table.

    Every entity spans every unit, so the totals of electors and valid votes are the same for all
    of them: a one-row subquery over the electorate. The total of an entity travels with it into
    the table. No window, no extra shuffle beyond the table itself.
    """
    table = dense_table(votes, electorate, entity, unit)
    scope = electorate.agg(
        F.struct(F.sum("aptos").alias("aptos"), F.sum("validos").alias("validos")).alias("t")
    ).scalar()
    quotient = ratio(
        F.col("votos").cast("double") * F.col("_t.validos"),
        F.col("_votos_entidade").cast("double") * F.col("validos"),
    )
    return (
        table.withColumn("_t", scope)
        .withColumns(
            {
                "pct_validos": share_of_valid(),
                "penetracao": penetration(),
                "lq": quotient,
                "taxa_referencia": ratio(F.col("_votos_entidade"), F.col("_t.aptos")),
            }
        )
        .withColumn("esperado", expected_events(F.col("aptos"), F.col("taxa_referencia")))
        .withColumn("n_baixo", is_low_count(F.col("esperado"), threshold))
        .drop("_t", "_votos_entidade")
    )


def scope_totals(table: DataFrame, entity: str | Sequence[str] = "sq_candidato") -> DataFrame:
    """AGG-02. Sums per entity and the rates of those sums."""
    keys = [entity] if isinstance(entity, str) else list(entity)
    return (
        table.groupBy(*keys)
        .agg(*[F.sum(c).alias(c) for c in ("votos", "aptos", "validos")])
        .withColumns({"pct_validos": share_of_valid(), "penetracao": penetration()})
    )


def sparse_totals(
    votes: DataFrame, electorate: DataFrame, entity: str | Sequence[str] = "sq_candidato"
) -> DataFrame:
    """AGG-02 without the zeros: the base of every entity is the whole electorate."""
    keys = [entity] if isinstance(entity, str) else list(entity)
    scope = electorate.agg(
        F.struct(F.sum("aptos").alias("aptos"), F.sum("validos").alias("validos")).alias("t")
    ).scalar()
    return (
        votes.groupBy(*keys)
        .agg(F.sum("votos").alias("votos"))
        .withColumn("_t", scope)
        .select(*keys, "votos", F.col("_t.aptos").alias("aptos"), F.col("_t.validos").alias("validos"))
        .withColumns({"pct_validos": share_of_valid(), "penetracao": penetration()})
    )


def sparse_zeros(votes: DataFrame, electorate: DataFrame, entity: str = "sq_candidato") -> DataFrame:
    """JOI-02 as counts: units of each entity, those without a vote, and its votes."""
    units = electorate.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        votes.groupBy(entity)
        .agg(F.count_if(F.col("votos") > 0).alias("_com"), F.sum("votos").alias("votos"))
        .withColumn("unidades", units)
        .select(entity, "unidades", (F.col("unidades") - F.col("_com")).alias("sem_voto"), "votos")
    )


def sparse_low_count(
    votes: DataFrame, electorate: DataFrame, entity: str = "sq_candidato", unit: str = "cd_mun_ibge",
    threshold: float = LOW_COUNT_THRESHOLD,
) -> DataFrame:
    """EXP-07 without the zeros: each row of votes with its expected events and the flag.

    Every entity spans the whole electorate, so its reference rate needs the totals alone.
    """
    scope = electorate.agg(F.sum("aptos").alias("a")).scalar()
    rows = votes.join(electorate.select(unit, "aptos"), unit)
    rated = with_totals(rows, [entity], _v=F.sum("votos")).withColumn("taxa_referencia", ratio(F.col("_v"), scope))
    expected = expected_events(F.col("aptos"), F.col("taxa_referencia"))
    return rated.withColumn("esperado", expected).withColumn("n_baixo", is_low_count(F.col("esperado"), threshold)).drop("_v")


def sparse_penetration(
    votes: DataFrame, electorate: DataFrame, entity: str = "sq_candidato", unit: str = "cd_mun_ibge",
    reliable: bool = False,
) -> DataFrame:
    """Penetration of every entity in every unit as (`penetracao`, `peso`).

    A row of votes has weight 1; all pairs without one are rows of zero that weigh as many. A unit
    without electors has a null rate for everybody and adds no zero. With `reliable` only pairs above
    the low-count threshold count: an entity's zeros then weigh as many as its reliable units, counted
    in the array of units, less its reliable rows.
    """
    if not reliable:
        rows = votes.join(electorate.select(unit, "aptos"), unit).select(
            penetration().alias("penetracao"), F.lit(1).cast("bigint").alias("peso")
        )
        entities = votes.agg(F.count_distinct(entity).alias("n")).scalar()
        with_votes = rows.agg(F.count("penetracao").alias("n")).scalar()
        zeros = electorate.agg(F.count_if(F.col("aptos") > 0).alias("_u")).select(
            F.lit(0.0).alias("penetracao"), (F.col("_u") * entities - with_votes).alias("peso")
        )
        return rows.unionByName(zeros.filter(F.col("peso") > 0))
    rows = sparse_low_count(votes, electorate, entity, unit).withColumn("penetracao", penetration())
    some = F.col("penetracao").isNotNull() & ~F.col("n_baixo")
    own = rows.filter(some).select("penetracao", F.lit(1).cast("bigint").alias("peso"))
    units = _unit_list(electorate.withColumn("validos", F.lit(0).cast("bigint")), [unit])

    def counts(u: Column) -> Column:
        return (u["aptos"] > 0) & ~is_low_count(expected_events(u["aptos"], F.col("taxa_referencia")))

    zeros = (
        rows.groupBy(entity)
        .agg(F.first("taxa_referencia").alias("taxa_referencia"), F.count_if(some).alias("_own"))
        .withColumn("_u", units)
        .select(F.lit(0.0).alias("penetracao"), (F.size(F.filter("_u", counts)) - F.col("_own")).cast("bigint").alias("peso"))
    )
    return own.unionByName(zeros.filter(F.col("peso") > 0))


def party_votes(parties: DataFrame) -> DataFrame:
    """EXP-06. List total, party vote, electoral quotient, votes in quotients, party quotient."""
    list_own, list_converted = "qt_votos_legenda_validos", "qt_votos_nom_convr_leg_validos"
    require_columns(
        parties,
        [list_own, list_converted, "votos_nominais_validos", "qt_total_votos_validos_uf", "vagas"],
        "party_votes",
    )
    quotient = F.col("quociente_eleitoral")
    return (
        parties.withColumns(
            {
                "votos_legenda_total": F.col(list_own) + F.col(list_converted),
                "quociente_eleitoral": electoral_quotient(
                    F.col("qt_total_votos_validos_uf"), F.col("vagas")
                ),
            }
        )
        .withColumn("votacao_partido", F.col("votos_nominais_validos") + F.col("votos_legenda_total"))
        .withColumns(
            {
                "votacao_em_qe": ratio(F.col("votacao_partido"), quotient),
                "quociente_partidario": F.when(
                    quotient > 0, integer_div(F.col("votacao_partido"), quotient)
                ),
            }
        )
    )


def low_count_by_prefix(table: DataFrame, unit: str = "cd_mun_ibge", length: int = 2) -> DataFrame:
    """STA-13. Low-count flag with a reference rate per prefix of the unit code."""
    keyed = table.withColumn("_p", F.substring(F.col(unit).cast("string"), 1, length))
    summed = with_totals(keyed, ["_p"], _v=F.sum("votos"), _a=F.sum("aptos"))
    rate = ratio(F.col("_v"), F.col("_a"))
    expected = expected_events(F.col("aptos"), rate)
    return summed.withColumns(
        {"taxa_referencia": rate, "esperado": expected, "n_baixo": is_low_count(expected)}
    ).drop("_p", "_v", "_a")


