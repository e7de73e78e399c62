"""Candidate lists, groups, states, candidate sheet, municipality summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from escrutinio.functions.rates import penetration, ratio, share_of_valid, votes_per_km2
from escrutinio.operators.people import base_state, in_state, registration_status, scope_name
from escrutinio.operators.reconcile import ABROAD


def territory_votes(
    votes: DataFrame, by_zone: bool = False, state: str | None = None, unit: int | None = None
) -> DataFrame:
    """AGG-05. Votes by municipality, or municipality and zone; null municipality is abroad."""
    rows = votes.filter(in_state(state))
    if unit is not None:
        rows = rows.filter(F.col("cd_mun_ibge") == unit)
    keys = ["cd_mun_ibge", "nr_zona"] if by_zone else ["cd_mun_ibge"]
    return rows.groupBy(*keys).agg(F.sum("votos").alias("votos"))


def vote_totals(votes: DataFrame) -> DataFrame:
    """AGG-06. Votes per candidacy; candidacies without rows are absent."""
    return votes.groupBy("ano", "sq_candidato").agg(F.sum("votos").alias("votos"))


def electoral_base(
    electorate: DataFrame, by_zone: bool = False, state: str | None = None, unit: int | None = None
) -> DataFrame:
    """AGG-07. Electors and valid votes by territory, for every year and office of the input."""
    rows = electorate.filter(in_state(state))
    if unit is not None:
        rows = rows.filter(F.col("cd_mun_ibge") == unit)
    keys = ["cd_mun_ibge", "nr_zona"] if by_zone else ["cd_mun_ibge"]
    return rows.groupBy("ano", "ds_cargo", *keys).agg(
        F.sum("aptos").alias("aptos"), F.sum("votos_validos").alias("validos")
    )


def bases_by_scope(electorate: DataFrame) -> DataFrame:
    """Electors and valid votes of each (year, office, state), and of the country as state null.

    One rollup replaces a query per scope.
    """
    return (
        electorate.groupBy("ano", "ds_cargo", "sg_uf")
        .agg(F.sum("aptos").alias("_a"), F.sum("votos_validos").alias("_v"))
        .groupingSets(
            [["ano", "ds_cargo", "sg_uf"], ["ano", "ds_cargo"]], "ano", "ds_cargo", "sg_uf"
        )
        .agg(F.sum("_a").alias("aptos"), F.sum("_v").alias("validos"))
        .withColumnRenamed("sg_uf", "_escopo")
    )


def with_rates(candidates: DataFrame, votes: DataFrame, electorate: DataFrame) -> DataFrame:
    """Candidacies with their votes and the rates of their circumscription.

    The scope is compared through a text key, as the national base has a null state.
    """
    scope = F.coalesce(base_state(F.col("sg_uf")), F.lit(""))
    bases = bases_by_scope(electorate).withColumn("_escopo", F.coalesce("_escopo", F.lit("")))
    return (
        candidates.withColumn("_escopo", scope)
        .join(vote_totals(votes), ["ano", "sq_candidato"], "left")
        .join(bases, ["ano", "ds_cargo", "_escopo"], "left")
        .drop("_escopo")
        .withColumn("votos", F.coalesce("votos", F.lit(0).cast("bigint")))
        .withColumns({"pct_validos": share_of_valid(), "penetracao": penetration()})
    )


def candidate_list(
    candidates: DataFrame, votes: DataFrame, electorate: DataFrame, limit: int, offset: int = 0
) -> DataFrame:
    """QRY-02, TOP-01. One page by votes, name and id, with rates, labels and the total count."""
    total = candidates.agg(F.count(F.lit(1)).alias("n")).scalar()
    rows = with_rates(candidates, votes, electorate).withColumns(
        {
            "situacao": registration_status(F.col("ds_situacao_candidatura"), F.col("foi_as_urnas")),
            "abrangencia": scope_name(F.col("sg_uf")),
        }
    )
    ordered = rows.orderBy(F.desc("votos"), "nm_urna", "sq_candidato")
    return (ordered.offset(offset) if offset else ordered).limit(limit).withColumn("total", total)


def group_kpis(
    votes: DataFrame, electorate: DataFrame, members: DataFrame, office: str, year: int,
    state: str | None = None,
) -> DataFrame:
    """AGG-23. One row: votes of the members (abroad too), electors and valid votes, rates."""
    mine = votes.filter((F.col("ano") == year) & in_state(state)).join(
        members.select("sq_candidato").distinct(), "sq_candidato", "left_semi"
    )
    base = electorate.filter(
        (F.col("ano") == year) & (F.col("ds_cargo") == office) & in_state(state)
    ).agg(F.struct(F.sum("aptos").alias("a"), F.sum("votos_validos").alias("v")).alias("b"))
    return (
        mine.agg(F.coalesce(F.sum("votos"), F.lit(0).cast("bigint")).alias("votos"))
        .withColumn("_b", base.scalar())
        .select("votos", F.col("_b.a").alias("aptos"), F.col("_b.v").alias("validos"))
        .withColumns({"pct_validos": share_of_valid(), "penetracao": penetration()})
    )


def states_with_candidates(candidates: DataFrame) -> DataFrame:
    """QRY-03, AGG-34. Candidacies per state of a scope."""
    return candidates.groupBy("sg_uf").agg(F.count(F.lit(1)).alias("candidaturas"))


def group_listing(membership: DataFrame, candidates: DataFrame, groups: DataFrame) -> DataFrame:
    """QRY-01. Visible groups with their number of candidacies.

    `groups` has `grupo`, `rotulo`, `ano`, `oculto` (ranking and reference-only groups).
    """
    counts = (
        membership.join(candidates.select("sq_candidato", "ano"), "sq_candidato")
        .groupBy("grupo", "ano")
        .agg(F.count_distinct("sq_candidato").alias("n_candidaturas"))
    )
    return (
        groups.filter(~F.col("oculto"))
        .join(counts, ["grupo", "ano"], "left")
        .select("grupo", "rotulo", "ano", F.coalesce("n_candidaturas", F.lit(0).cast("bigint")).alias("n_candidaturas"))
    )


def votes_by_state(votes: DataFrame) -> DataFrame:
    """QRY-04. Votes of candidacies by state of the voter; abroad counts as `ZZ`."""
    state = F.when(F.col("cd_mun_ibge").isNull(), ABROAD).otherwise(F.col("sg_uf"))
    return votes.groupBy("sq_candidato", state.alias("uf")).agg(F.sum("votos").alias("votos"))


def top_units(
    votes: DataFrame, electorate: DataFrame, municipalities: DataFrame, top: int
) -> DataFrame:
    """QRY-04, TOP-02. Municipalities of one candidacy by votes then code, with penetration.

    The top-k is taken on summed votes before names and bases are joined, so only k rows travel.
    """
    best = (
        votes.filter(F.col("cd_mun_ibge").isNotNull())
        .groupBy("cd_mun_ibge")
        .agg(F.sum("votos").alias("votos"))
        .orderBy(F.desc("votos"), F.asc("cd_mun_ibge"))
        .limit(top)
    )
    base = electorate.groupBy("cd_mun_ibge").agg(F.sum("aptos").alias("aptos"))
    return (
        best.join(municipalities.select("cd_mun_ibge", "nome", "uf"), "cd_mun_ibge", "left")
        .join(base, "cd_mun_ibge", "left")
        .select("cd_mun_ibge", "nome", "uf", "votos", penetration().alias("penetracao"))
    )


def sheet_finances(accounts: DataFrame) -> DataFrame:
    """QRY-04. Expense with and without transfers, and cost per vote both ways.

    `accounts` has, per candidacy, `votos` and the columns of `expense_split` for both stages.
    """
    def with_transfers(kind: str) -> Column:
        return F.col(f"despesa_{kind}") + F.col(f"despesa_{kind}_repasses")

    return accounts.withColumns(
        {
            "despesa_total_contratada": with_transfers("contratada"),
            "despesa_total_paga": with_transfers("paga"),
            "custo_voto_contratado_com_repasses": ratio(with_transfers("contratada"), F.col("votos")),
            "custo_voto_pago_com_repasses": ratio(with_transfers("paga"), F.col("votos")),
        }
    )


def municipality_summary(
    candidates: DataFrame, membership: DataFrame, votes: DataFrame, electorate: DataFrame,
    municipalities: DataFrame,
) -> DataFrame:
    """QRY-11. Per group, office and municipality: candidacies, votes, electors, rates, density.

    One grouped plan for all municipalities; a filter on `cd_mun_ibge` reaches every scan.
    """
    members = membership.select("grupo", "sq_candidato").distinct().join(
        candidates.select("ano", "sq_candidato", "ds_cargo", F.col("sg_uf").alias("_uf")), "sq_candidato"
    )
    sizes = members.groupBy("grupo", "ano", "ds_cargo", "_uf").agg(
        F.count(F.lit(1)).alias("n_candidaturas")
    )
    summed = (
        votes.filter(F.col("cd_mun_ibge").isNotNull())
        .groupBy("ano", "sq_candidato", "cd_mun_ibge")
        .agg(F.sum("votos").alias("votos"))
        .join(members.drop("_uf"), ["ano", "sq_candidato"])
        .groupBy("grupo", "ano", "ds_cargo", "cd_mun_ibge")
        .agg(F.sum("votos").alias("votos"))
    )
    base = electorate.filter(F.col("cd_mun_ibge").isNotNull()).groupBy(
        "ano", "ds_cargo", "cd_mun_ibge"
    ).agg(F.sum("aptos").alias("aptos"), F.sum("votos_validos").alias("validos"))
    places = municipalities.select("cd_mun_ibge", "nome", F.col("uf").alias("_uf"), "area_km2")
    return (
        base.join(places, "cd_mun_ibge")
        .join(sizes, ["ano", "ds_cargo", "_uf"])
        .join(summed, ["grupo", "ano", "ds_cargo", "cd_mun_ibge"], "left")
        .withColumn("votos", F.coalesce("votos", F.lit(0).cast("bigint")))
        .select(
            "cd_mun_ibge", "grupo", "ano", "ds_cargo", "n_candidaturas", "votos", "aptos",
            penetration().alias("penetracao"), share_of_valid().alias("pct_validos"),
            votes_per_km2().alias("votos_km2"),
        )
    )
