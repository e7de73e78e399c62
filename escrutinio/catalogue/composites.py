"""User-level queries: lists, maps, finances, comparison, references."""

from __future__ import annotations

from pyspark.sql import functions as F

from escrutinio.catalogue.money import ACCOUNTS, SUMS
from escrutinio.catalogue.money import _accounts as money_accounts
from escrutinio.catalogue.period import YEAR_COUNTS, areas, year_counts
from escrutinio.catalogue.roles import (
    BALLOTS,
    CANDIDATES,
    EXPENSES,
    PRICES,
    REVENUE,
    VOTES,
    YEAR_AFTER,
    YEAR_BEFORE,
    ballots,
    candidates,
    counted,
    electorate,
    expense_entries,
    price_series,
    revenue,
    rounded,
    table,
    votes,
    with_sql,
)
from escrutinio.functions.rates import penetration, share_of_valid
from escrutinio.operators import finance as fi
from escrutinio.operators import reference as rf
from escrutinio.plans import accounts, catalog, comparison, lists, maps, references, screens

INDICATORS = ("votos", "penetracao", "pct_maiores", "n_efetivo_municipios", "pct_publico")


def _list_inputs(spark, d):
    """Candidacies with year, office and state; every eleventh is national."""
    c = candidates(spark, d)
    k = F.col("sq_candidato")
    c = c.select(
        F.lit(1997).alias("ano"), "sq_candidato", "nm_urna", F.lit("DEPUTADO FEDERAL").alias("ds_cargo"),
        F.when(k % 11 == 0, "BR").otherwise(F.col("sg_uf")).alias("sg_uf"), "nr_partido",
        "ds_situacao_candidatura", "ds_sit_tot_turno", (k % 13 != 0).alias("foi_as_urnas"),
    )
    # One election of all the rows; votes and electorate share one shuffled aggregate.
    base = counted(spark, d, "sq_candidato", "sg_uf", "cd_mun_ibge", "nr_zona").withColumn("ano", F.lit(1997))
    v = base.select("ano", "sq_candidato", "sg_uf", "cd_mun_ibge", "nr_zona", F.col("validos").alias("votos"))
    e = (
        base.groupBy("ano", "sg_uf", F.lit("DEPUTADO FEDERAL").alias("ds_cargo"), "cd_mun_ibge", "nr_zona")
        .agg(F.sum("aptos").alias("aptos"), F.sum("validos").alias("votos_validos"))
    )
    return c, v, e


def candidate_list(spark, d):
    c, v, e = _list_inputs(spark, d)
    out = lists.candidate_list(c, v, e, 40, 5)
    return rounded(
        out.select("sq_candidato", "sg_uf", "situacao", "abrangencia", "votos", "aptos", "validos", "pct_validos", "penetracao", "total")
    )


def states_with_candidates(spark, d):
    return lists.states_with_candidates(_list_inputs(spark, d)[0].filter("foi_as_urnas"))


def group_listing(spark, d):
    c, _, _ = _list_inputs(spark, d)
    membership = c.select(F.concat(F.lit("p"), F.col("nr_partido").cast("string")).alias("grupo"), "sq_candidato")
    groups = table(spark, d, "nation").select(
        F.concat(F.lit("p"), F.col("n_nationkey").cast("string")).alias("grupo"), F.col("n_name").alias("rotulo"),
        F.lit(1997).alias("ano"), (F.col("n_nationkey") % 6 == 0).alias("oculto"),
    )
    return lists.group_listing(membership, c, groups)


def votes_by_state(spark, d):
    _, v, _ = _list_inputs(spark, d)
    abroad = v.withColumn("cd_mun_ibge", F.when(F.col("cd_mun_ibge") % 8 != 0, F.col("cd_mun_ibge")))
    return lists.votes_by_state(abroad)


def top_units(spark, d):
    _, v, e = _list_inputs(spark, d)
    mun = table(spark, d, "nation").select(
        F.col("n_nationkey").alias("cd_mun_ibge"), F.col("n_name").alias("nome"), F.col("n_regionkey").cast("string").alias("uf")
    )
    return rounded(lists.top_units(v.filter(F.col("sq_candidato") == 4), e, mun, 10))


def sheet_finances(spark, d):
    split = fi.expense_split(expense_entries(spark, d), accounts.EXPENSES)
    v = votes(spark, d, "sq_candidato")
    out = lists.sheet_finances(split.join(v, "sq_candidato"))
    return rounded(
        out.select("sq_candidato", "despesa_total_contratada", "despesa_total_paga", "custo_voto_contratado_com_repasses", "custo_voto_pago_com_repasses"),
        4,
    )


def municipality_summary(spark, d):
    c, v, e = _list_inputs(spark, d)
    membership = c.select(F.concat(F.lit("p"), (F.col("nr_partido") % 4).cast("string")).alias("grupo"), "sq_candidato")
    mun = table(spark, d, "nation").select(
        F.col("n_nationkey").alias("cd_mun_ibge"), F.col("n_name").alias("nome"),
        F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("uf"), (F.col("n_nationkey") % 7 * 100.0).alias("area_km2"),
    )
    return rounded(lists.municipality_summary(c, membership, v, e, mun))


def _side_members(spark, d):
    """The candidacies a map shows: those of some parties."""
    return candidates(spark, d).filter(F.col("nr_partido").between(2, 12)).select("sq_candidato")


MAP_MEMBERS = "sq_candidato IN (SELECT s_suppkey FROM supplier WHERE s_nationkey BETWEEN 2 AND 12)"


def _map_inputs(spark, d, *unit):
    rows = ballots(spark, d)
    v = rows.join(_side_members(spark, d), "sq_candidato", "left_semi").groupBy(*unit).agg(
        F.sum("qt_votos_nominais_validos").alias("votos")
    )
    b = rows.filter(F.col("cd_mun_ibge") != 24).groupBy(*unit).agg(
        F.sum("qt_votos_nominais").alias("aptos"), F.sum("qt_votos_nominais_validos").alias("validos")
    )
    return v, b


def map_values(spark, d):
    return rounded(maps.map_values(*_map_inputs(spark, d, "cd_mun_ibge")))


def map_values_zone(spark, d):
    unit = ("cd_mun_ibge", "nr_zona")
    return rounded(maps.map_values(*_map_inputs(spark, d, *unit), unit))


def map_off(spark, d):
    v, _ = _map_inputs(spark, d, "cd_mun_ibge")
    return maps.votes_off_map(v.withColumn("cd_mun_ibge", F.when(F.col("cd_mun_ibge") % 3 != 0, F.col("cd_mun_ibge"))))


def map_common_breaks(spark, d):
    unit = ("cd_mun_ibge", "nr_zona")
    rows = ballots(spark, d)

    def one(year):
        r = rows.filter(F.col("ano") == year)
        v = r.join(_side_members(spark, d), "sq_candidato", "left_semi").groupBy(*unit).agg(F.sum("qt_votos_nominais_validos").alias("votos"))
        b = r.groupBy(*unit).agg(F.sum("qt_votos_nominais").alias("aptos"), F.sum("qt_votos_nominais_validos").alias("validos"))
        return maps.map_values(v, b, unit)

    return maps.map_breaks([one(YEAR_BEFORE), one(YEAR_AFTER)])


def side_frame(spark, d):
    rows = ballots(spark, d).filter(F.col("ano") == YEAR_BEFORE)
    v = rows.groupBy("sq_candidato", "cd_mun_ibge").agg(F.sum("qt_votos_nominais_validos").alias("votos"))
    b = rows.filter(F.col("cd_mun_ibge") != 7).groupBy("cd_mun_ibge").agg(
        F.sum("qt_votos_nominais").alias("aptos"), F.sum("qt_votos_nominais_validos").alias("validos")
    )
    return comparison.side_frame(v, b, candidates(spark, d).filter(F.col("nr_partido") == 2))


def two_side_comparison(spark, d):
    out = comparison.compare_sides(year_counts(spark, d, YEAR_BEFORE), year_counts(spark, d, YEAR_AFTER), areas(spark, d), 6)
    return rounded(out.select("nivel", "amc", "votos_2022", "votos_2026", "delta_penetracao", "swing_pp", "retencao", "ganho_absoluto"))


def comparison_of_sides(spark, d):
    """Parties 2 to 12 against 8 to 20, cut to the persons that are on both sides."""
    c = candidates(spark, d).withColumn("pessoa_id", F.concat(F.lit("p"), F.col("sq_candidato").cast("string")))
    rows = ballots(spark, d)

    def counts(year):
        r = rows.filter(F.col("ano") == year)
        v = r.groupBy("sq_candidato", "cd_mun_ibge").agg(F.sum("qt_votos_nominais_validos").alias("votos"))
        b = r.groupBy("cd_mun_ibge").agg(F.sum("qt_votos_nominais").alias("aptos"), F.sum("qt_votos_nominais_validos").alias("validos"))
        return v, b

    (v1, b1), (v2, b2) = counts(YEAR_BEFORE), counts(YEAR_AFTER)
    members = c.filter(F.col("nr_partido").between(2, 12)), c.filter(F.col("nr_partido").between(8, 20))
    out = comparison.two_sides(members, (v1, v2), (b1, b2), areas(spark, d), 6, same_people=True, classes=4)
    return rounded(
        out.select("nivel", "amc", "votos_2022", "votos_2026", "delta_penetracao", "swing_pp", "classe_2022", "classe_2026",
                   F.element_at("quebras", 1).alias("menor_quebra"), F.size("quebras").alias("n_quebras"))
    )


def comparison_lines(spark, d):
    """Account comparison in display order."""
    return comparison.revenue_lines(account_comparison(spark, d))


def first_round_candidates(spark, d):
    c = candidates(spark, d)
    k = F.col("sq_candidato")
    full = c.select(
        F.lit(YEAR_BEFORE).alias("ano"), F.when(k % 9 == 0, 2).otherwise(1).alias("nr_turno"), "sg_uf",
        F.lit("Deputado Federal").alias("ds_cargo"), "sq_candidato", F.col("nm_urna").alias("nm_urna_candidato"),
        F.sha2(k.cast("string"), 256).alias("pessoa_id"), "nr_partido", F.concat(F.lit("P"), F.col("nr_partido").cast("string")).alias("sg_partido"),
        "ds_situacao_candidatura", "ds_sit_tot_turno", (1000 + k).alias("nr_candidato"), F.col("nm_urna").alias("nm_candidato"),
        (k % 13 != 0).alias("foi_as_urnas"),
    )
    return catalog.candidates_view(full)


def difference_map(spark, d):
    out = comparison.compare_sides(year_counts(spark, d, YEAR_BEFORE), year_counts(spark, d, YEAR_AFTER), areas(spark, d), 6)
    return rounded(screens.difference_map(out.filter(F.col("nivel") == "amc")))


def _members(spark, d, party):
    return candidates(spark, d).filter(F.col("nr_partido") % 5 == party).select("sq_candidato", "nr_partido")


def _ledgers(spark, d, year):
    r = revenue(spark, d).filter(F.col("ano") == year)
    e = expense_entries(spark, d).filter(F.col("ano") == year)
    v = ballots(spark, d).filter(F.col("ano") == year).groupBy("sq_candidato").agg(
        F.sum("qt_votos_nominais_validos").alias("votos")
    )
    return v, r, e


def candidate_accounts(spark, d):
    v, r, e = _ledgers(spark, d, 1996)
    out = accounts.candidate_accounts(
        _members(spark, d, 1), v, r, e, prices=price_series(spark, d), origin="1996-09", base="1998-09"
    )
    return rounded(
        out.select(
            "sq_candidato", "nr_partido", "votos", "receita_total", "despesa_contratada", "despesa_paga", "divida",
            "custo_voto_contratado", "receita_por_voto", "saldo_contratado", "pct_receita_gasta", "sentido_alerta",
        ), 2,
    )


GROUP_COLUMNS = (
    "votos", "despesa_contratada", "despesa_paga", "saldo_contratado", "custo_voto_contratado",
    "mediana_custo_voto_contratado", "receita_por_voto", "mediana_receita_por_voto", "n_candidatos",
    "n_com_contas", "mediana", "receita_total", "receita_repasses_internos", "receita_minima", "receita_maxima",
)


def group_accounts(spark, d):
    v, r, e = _ledgers(spark, d, 1996)
    out = accounts.group_accounts(_members(spark, d, 1), v, r, e)
    return rounded(out.select(*GROUP_COLUMNS), 2)


def group_kpi_rows(spark, d):
    v, r, e = _ledgers(spark, d, 1996)
    out = accounts.group_accounts(_members(spark, d, 1), v, r, e)
    return rounded(screens.kpi_rows(out, screens.REVENUE_KPIS), 4)


def account_comparison(spark, d):
    def side(year):
        v, r, e = _ledgers(spark, d, year)
        base = ballots(spark, d).filter(F.col("ano") == year).agg(F.sum("qt_votos_nominais").alias("aptos"))
        return accounts.group_accounts(_members(spark, d, 1), v, r, e, electors=base)

    out = comparison.compare_accounts(side(1996), side(1998), price_series(spark, d), "1996-09", "1998-09")
    return rounded(out.select("indicador", "tipo", "de_nominal", "de", "para", "delta", "var_pct"), 4)


def _profiles(spark, d):
    e = electorate(spark, d)
    shape = references.geography(votes(spark, d), e)
    whole = e.agg(F.struct(F.sum("aptos").alias("a"), F.sum("validos").alias("v")).alias("t")).scalar()
    rated = (
        candidates(spark, d).join(votes(spark, d, "sq_candidato"), "sq_candidato", "left")
        .withColumn("votos", F.coalesce("votos", F.lit(0).cast("bigint")))
        .withColumn("_t", whole)
        .select("cd_cargo", "sg_uf", "sq_candidato", "nr_partido", "ds_sit_tot_turno", "votos",
                F.col("_t.a").alias("aptos"), F.col("_t.v").alias("validos"))
        .withColumns({"penetracao": penetration(), "pct_validos": share_of_valid()})
    )
    money = fi.revenue_summary(revenue(spark, d)).select("sq_candidato", "receita_total", "pct_publico", "pct_pessoa_fisica", "pct_autofinanciamento")
    acc = (
        money_accounts(spark, d).filter("sq_candidato % 9 <> 0").drop("receita_total").join(money, "sq_candidato", "left")
    )
    acc = fi.revenue_per_vote(fi.cost_per_vote(acc))
    return references.candidate_profiles(rated, shape, acc)


def geography(spark, d):
    return rounded(references.geography(votes(spark, d), electorate(spark, d)))


def profile_reasons(spark, d):
    return _profiles(spark, d).select("sq_candidato", F.explode("motivos").alias("campo", "motivo"))


def reference_medians(spark, d):
    return rounded(rf.reference_medians(_profiles(spark, d), INDICATORS))


def relative_profile(spark, d):
    p = _profiles(spark, d)
    return rounded(
        rf.relative_profile(p, p, INDICATORS)
    )


def reference_indices(spark, d):
    p = _profiles(spark, d)
    chosen = rf.select_elected(p, 5, exclude_parties=(14,))
    ref = p.join(chosen.select("sq_candidato"), "sq_candidato", "left_semi")
    return rounded(references.reference_indices(p.filter("nr_partido = 14"), ref, INDICATORS))


QUERIES = {
    f.__name__: f
    for f in (
        candidate_list, states_with_candidates, group_listing, votes_by_state, top_units,
        sheet_finances, municipality_summary, map_values, map_values_zone, map_off,
        map_common_breaks, side_frame, two_side_comparison, comparison_of_sides, comparison_lines, first_round_candidates,
        difference_map, candidate_accounts,
        group_accounts, group_kpi_rows, account_comparison, geography, profile_reasons,
        reference_medians, relative_profile, reference_indices,
    )
}

LISTED = (
    BALLOTS
    + ","
    + CANDIDATES
    + """, lista AS (SELECT sq_candidato, nm_urna, CASE WHEN sq_candidato % 11 = 0 THEN 'BR' ELSE sg_uf END AS sg_uf, nr_partido,
  CASE WHEN ds_situacao_candidatura IS NULL AND sq_candidato % 13 = 0 THEN 'Não foi às urnas' ELSE ds_situacao_candidatura END AS situacao,
  sq_candidato % 13 <> 0 AS urnas FROM candidatos),
v97 AS (SELECT * FROM votacao),
bases AS (SELECT sg_uf, CAST(sum(qt) AS BIGINT) AS aptos, CAST(sum(CASE WHEN flag = 'N' THEN qt ELSE 0 END) AS BIGINT) AS validos FROM v97 GROUP BY ALL
  UNION ALL SELECT 'BR', CAST(sum(qt) AS BIGINT), CAST(sum(CASE WHEN flag = 'N' THEN qt ELSE 0 END) AS BIGINT) FROM v97)
"""
)


def _map_sql(keys: str, year: str = "true", cand: str = MAP_MEMBERS, base: str = "cd_mun_ibge <> 24") -> str:
    return f"""(SELECT {keys}, CAST(sum(CASE WHEN flag = 'N' AND {cand} THEN qt ELSE 0 END) AS BIGINT) AS votos,
      CAST(sum(CASE WHEN {base} THEN qt ELSE 0 END) AS BIGINT) AS aptos,
      CAST(sum(CASE WHEN {base} AND flag = 'N' THEN qt ELSE 0 END) AS BIGINT) AS validos FROM votacao
      WHERE {year} AND (({base}) OR ({cand})) GROUP BY ALL)"""


def _map_out(keys: str) -> str:
    return with_sql(
        BALLOTS,
        f"""SELECT *, round(1000.0 * votos / nullif(aptos, 0)::DOUBLE, 6) + 0.0 AS penetracao,
        round(100.0 * votos / nullif(validos, 0)::DOUBLE, 6) + 0.0 AS pct_validos FROM {_map_sql(keys)}""",
    )


def _year_sql(year: int, alias: str) -> str:
    return f"""{alias} AS (SELECT amc, CAST(sum(aptos) AS BIGINT) AS aptos, CAST(sum(validos) AS BIGINT) AS validos, CAST(sum(votos) AS BIGINT) AS votos
      FROM contagem WHERE ano = {year} GROUP BY ROLLUP (amc))"""


CHANGE = """round(1000.0 * b.votos / b.aptos::DOUBLE - 1000.0 * a.votos / a.aptos::DOUBLE, 6) + 0.0 AS delta_penetracao"""
SIDE_BY_SIDE = YEAR_COUNTS + "," + _year_sql(YEAR_BEFORE, "a") + "," + _year_sql(YEAR_AFTER, "b")
MEMBERS = "SELECT s_suppkey FROM supplier WHERE s_nationkey % 5 = 1"
FACTOR = "(SELECT product(1 + variacao / 100) FROM serie WHERE mes > '1996-09' AND mes <= '1998-09')"


def _side(year: int, factor: str = "1") -> str:
    """Per-candidate accounts of a year as CTEs ending in `c`; money times `factor`."""
    return (
        REVENUE + "," + EXPENSES + "," + BALLOTS + (("," + PRICES) if factor != "1" else "")
        + f""", r AS (SELECT sq_candidato, sum(vr)::DOUBLE * {factor} AS receita_total, coalesce(sum(vr) FILTER (WHERE financeira), 0)::DOUBLE * {factor} AS rf
          FROM receitas WHERE ano = {year} AND sq_candidato IN ({MEMBERS}) GROUP BY ALL),
        e AS (SELECT sq_candidato, coalesce(sum(contratada) FILTER (WHERE NOT repasse), 0)::DOUBLE * {factor} AS c, coalesce(sum(paga) FILTER (WHERE NOT repasse), 0)::DOUBLE * {factor} AS p,
          sum(contratada)::DOUBLE * {factor} AS ct, sum(paga)::DOUBLE * {factor} AS pt FROM despesas WHERE ano = {year} AND sq_candidato IN ({MEMBERS}) GROUP BY ALL),
        v AS (SELECT sq_candidato, CAST(sum(CASE WHEN flag = 'N' THEN qt ELSE 0 END) AS BIGINT) AS votos FROM votacao WHERE ano = {year} GROUP BY ALL),
        c AS (SELECT s_suppkey AS sq_candidato, s_nationkey AS nr_partido, coalesce(votos, 0) AS votos, receita_total, rf, coalesce(e.c, 0) AS dc, coalesce(e.p, 0) AS dp,
          coalesce(ct, 0) AS ct, coalesce(pt, 0) AS pt FROM supplier LEFT JOIN r ON s_suppkey = r.sq_candidato LEFT JOIN e ON s_suppkey = e.sq_candidato
          LEFT JOIN v ON s_suppkey = v.sq_candidato WHERE s_nationkey % 5 = 1 AND (receita_total IS NOT NULL OR e.c IS NOT NULL))"""
    )


def _group_totals(year: int) -> str:
    return (
        _side(year)
        + f""", g AS (SELECT *, coalesce(repasse AND doador IN ({MEMBERS}), false) AS interno FROM classificadas WHERE ano = {year} AND sq_candidato IN ({MEMBERS})),
        liq AS (SELECT {SUMS} FROM g WHERE NOT interno),
        extra AS (SELECT coalesce(sum(vr) FILTER (WHERE interno), 0)::DOUBLE AS ri, coalesce(sum(vr) FILTER (WHERE repasse AND doador IS NULL), 0)::DOUBLE AS rd FROM g),
        tot AS (SELECT CAST(sum(votos) AS BIGINT) AS votos, sum(dc) AS despesa_contratada, sum(dp) AS despesa_paga, sum(receita_total - ct) AS saldo_contratado,
          sum(dc) FILTER (WHERE votos > 0) / sum(votos) FILTER (WHERE votos > 0) AS custo_voto_contratado, median(dc / votos) FILTER (WHERE votos > 0) AS mediana_custo_voto_contratado,
          sum(receita_total) FILTER (WHERE votos > 0) / sum(votos) FILTER (WHERE votos > 0 AND receita_total IS NOT NULL) AS receita_por_voto,
          median(receita_total / votos) FILTER (WHERE votos > 0) AS mediana_receita_por_voto, count(*) AS n_candidatos, count(receita_total) AS n_com_contas,
          median(receita_total) AS mediana, avg(receita_total) AS media FROM c)"""
    )


COMPARED = (*comparison.MONEY, *[f"receita_{c}" for c in fi.REVENUE_CATEGORIES], *comparison.SHARES)


def _side_row(year: int) -> str:
    """One row with the compared indicators of a year, nominal."""
    sums = ", ".join(f"liq.receita_{c}" for c in fi.REVENUE_CATEGORIES)
    return f"""(WITH {_group_totals(year)}, ap AS (SELECT sum(qt) AS aptos FROM votacao WHERE ano = {year})
      SELECT liq.receita_total, tot.receita_por_voto, 1000.0 * liq.receita_total / aptos::DOUBLE AS receita_por_mil_aptos, tot.media, tot.mediana, {sums},
      100.0 * (receita_fefc + receita_fundo_partidario) / liq.receita_total AS pct_publico, 100.0 * receita_recursos_proprios / liq.receita_total AS pct_autofinanciamento,
      100.0 * (receita_pessoa_fisica + receita_financiamento_coletivo) / liq.receita_total AS pct_pessoa_fisica, 100.0 * receita_estimavel / liq.receita_total AS pct_estimavel
      FROM tot, liq, ap)"""


def _compared(name: str) -> str:
    money = name not in comparison.SHARES
    old = f"a.{name} * f" if money else f"a.{name}"
    change = f"round(100.0 * (b.{name} / nullif({old}, 0) - 1), 4) + 0.0" if money else "NULL::DOUBLE"
    kind = "monetario" if money else "percentual"
    return f"""SELECT '{name}' AS indicador, '{kind}' AS tipo, round(a.{name}, 4) + 0.0 AS de_nominal, round({old}, 4) + 0.0 AS de, round(b.{name}, 4) + 0.0 AS para,
      round(b.{name} - {old}, 4) + 0.0 AS delta, {change} AS var_pct FROM a, b, fator"""


PROFILE_SQL = (
    VOTES
    + ","
    + CANDIDATES
    + ","
    + ACCOUNTS
    + f""", tt AS (SELECT sum(aptos) AS ta, sum(validos) AS tv FROM eleitorado),
  vc AS (SELECT sq_candidato, CAST(sum(votos) AS BIGINT) AS votos FROM votos GROUP BY ALL),
  rk AS (SELECT *, row_number() OVER (PARTITION BY sq_candidato ORDER BY votos DESC, cd_mun_ibge) AS rn FROM votos WHERE votos > 0),
  geo AS (SELECT sq_candidato, count(*) AS n_municipios_com_voto, 100.0 * sum(votos) FILTER (WHERE rn <= 10) / sum(votos)::DOUBLE AS pct_maiores,
    sum(votos::DOUBLE * votos) / power(sum(votos)::DOUBLE, 2) AS hhi, power(sum(votos)::DOUBLE, 2) / sum(votos::DOUBLE * votos) AS n_efetivo_municipios FROM rk GROUP BY ALL),
  pub AS (SELECT sq_candidato, sum(vr)::DOUBLE AS receita, 100.0 * coalesce(sum(vr) FILTER (WHERE categoria IN ('fefc', 'fundo_partidario')), 0)::DOUBLE / nullif(sum(vr)::DOUBLE, 0) AS pct
    FROM classificadas GROUP BY ALL),
  perfil AS (SELECT ca.cd_cargo, ca.sg_uf, ca.sq_candidato, ca.nr_partido, ca.ds_sit_tot_turno, coalesce(vc.votos, 0) AS votos, 1000.0 * coalesce(vc.votos, 0) / ta::DOUBLE AS penetracao,
    geo.pct_maiores, geo.hhi, geo.n_efetivo_municipios, ct.sq_candidato IS NOT NULL AS contas, ct.votos AS vca, ct.despesa_paga, pub.receita,
    CASE WHEN ct.sq_candidato IS NOT NULL THEN pub.pct END AS pct_publico
    FROM candidatos ca CROSS JOIN tt LEFT JOIN vc USING (sq_candidato) LEFT JOIN geo USING (sq_candidato)
    LEFT JOIN (SELECT * FROM contas WHERE sq_candidato % 9 <> 0) ct USING (sq_candidato) LEFT JOIN pub USING (sq_candidato)),
  longo AS (SELECT cd_cargo, sg_uf, sq_candidato, nr_partido, ds_sit_tot_turno, votos AS vv, unnest({list(INDICATORS)}) AS indicador,
    unnest([votos::DOUBLE, penetracao, pct_maiores, n_efetivo_municipios, pct_publico]) AS valor FROM perfil)
"""
)
KIND = "CASE indicador WHEN 'votos' THEN 'contexto' WHEN 'pct_maiores' THEN 'diferenca_pp' WHEN 'pct_publico' THEN 'diferenca_pp' ELSE 'razao' END"

ORACLE = {
    "candidate_list": with_sql(
        LISTED,
        """, c AS (SELECT sq_candidato, CAST(sum(CASE WHEN flag = 'N' THEN qt ELSE 0 END) AS BIGINT) AS votos FROM v97 GROUP BY ALL)
        SELECT l.sq_candidato, l.sg_uf, situacao, CASE WHEN l.sg_uf = 'BR' THEN 'nacional' ELSE 'estadual' END AS abrangencia, coalesce(votos, 0) AS votos,
        aptos, validos, round(100.0 * coalesce(votos, 0) / validos::DOUBLE, 6) + 0.0 AS pct_validos, round(1000.0 * coalesce(votos, 0) / aptos::DOUBLE, 6) + 0.0 AS penetracao,
        (SELECT count(*) FROM lista) AS total FROM lista l LEFT JOIN c USING (sq_candidato) LEFT JOIN bases b ON b.sg_uf = l.sg_uf
        ORDER BY coalesce(votos, 0) DESC, nm_urna, l.sq_candidato LIMIT 40 OFFSET 5""",
    ),
    "states_with_candidates": with_sql(LISTED, "SELECT sg_uf, count(*) AS candidaturas FROM lista WHERE urnas GROUP BY ALL"),
    "group_listing": """SELECT 'p' || n_nationkey AS grupo, n_name AS rotulo, 1997 AS ano, count(s_suppkey) AS n_candidaturas
        FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey WHERE n_nationkey % 6 <> 0 GROUP BY ALL""",
    "votes_by_state": with_sql(
        LISTED,
        """SELECT sq_candidato, CASE WHEN cd_mun_ibge % 8 = 0 THEN 'ZZ' ELSE sg_uf END AS uf, CAST(sum(CASE WHEN flag = 'N' THEN qt ELSE 0 END) AS BIGINT) AS votos
        FROM v97 GROUP BY ALL""",
    ),
    "top_units": with_sql(
        LISTED,
        """, t AS (SELECT cd_mun_ibge, CAST(sum(CASE WHEN flag = 'N' THEN qt ELSE 0 END) AS BIGINT) AS votos FROM v97 WHERE sq_candidato = 4 GROUP BY ALL),
        b AS (SELECT cd_mun_ibge, sum(qt) AS aptos FROM v97 GROUP BY ALL)
        SELECT cd_mun_ibge, n_name AS nome, CAST(n_regionkey AS VARCHAR) AS uf, votos, round(1000.0 * votos / aptos::DOUBLE, 6) + 0.0 AS penetracao
        FROM t JOIN b USING (cd_mun_ibge) JOIN nation ON n_nationkey = cd_mun_ibge ORDER BY votos DESC, cd_mun_ibge LIMIT 10""",
    ),
    "sheet_finances": with_sql(
        EXPENSES + "," + VOTES,
        """, e AS (SELECT sq_candidato, sum(contratada)::DOUBLE AS c, sum(paga)::DOUBLE AS p FROM despesas GROUP BY ALL),
        v AS (SELECT sq_candidato, sum(votos) AS votos FROM votos GROUP BY ALL)
        SELECT sq_candidato, round(c, 4) + 0.0 AS despesa_total_contratada, round(p, 4) + 0.0 AS despesa_total_paga,
        round(c / votos, 4) + 0.0 AS custo_voto_contratado_com_repasses, round(p / votos, 4) + 0.0 AS custo_voto_pago_com_repasses FROM e JOIN v USING (sq_candidato)""",
    ),
    "municipality_summary": with_sql(
        LISTED,
        """, b AS (SELECT cd_mun_ibge, sg_uf, CAST(sum(qt) AS BIGINT) AS aptos, CAST(sum(CASE WHEN flag = 'N' THEN qt ELSE 0 END) AS BIGINT) AS validos FROM v97 GROUP BY ALL),
        n AS (SELECT 'p' || nr_partido % 4 AS grupo, sg_uf, count(*) AS n_candidaturas FROM lista GROUP BY ALL),
        s AS (SELECT 'p' || l.nr_partido % 4 AS grupo, cd_mun_ibge, CAST(sum(CASE WHEN flag = 'N' THEN qt ELSE 0 END) AS BIGINT) AS votos FROM v97 JOIN lista l USING (sq_candidato) GROUP BY ALL)
        SELECT b.cd_mun_ibge, n.grupo, 1997 AS ano, 'DEPUTADO FEDERAL' AS ds_cargo, n_candidaturas, coalesce(votos, 0) AS votos, aptos,
        round(1000.0 * coalesce(votos, 0) / aptos::DOUBLE, 6) + 0.0 AS penetracao, round(100.0 * coalesce(votos, 0) / validos::DOUBLE, 6) + 0.0 AS pct_validos,
        round(coalesce(votos, 0) / nullif(b.cd_mun_ibge % 7 * 100.0::DOUBLE, 0), 6) + 0.0 AS votos_km2
        FROM b JOIN n USING (sg_uf) LEFT JOIN s ON s.grupo = n.grupo AND s.cd_mun_ibge = b.cd_mun_ibge""",
    ),
    "map_values": _map_out("cd_mun_ibge"),
    "map_values_zone": _map_out("cd_mun_ibge, nr_zona"),
    "map_off": with_sql(
        BALLOTS,
        f"""SELECT CAST(sum(qt) AS BIGINT) AS votos_fora_do_mapa FROM votacao WHERE flag = 'N' AND {MAP_MEMBERS} AND cd_mun_ibge % 3 = 0""",
    ),
    "map_common_breaks": with_sql(
        BALLOTS
        + ", m AS ("
        + " UNION ALL ".join(
            f"SELECT *, {y} AS ano FROM {_map_sql('cd_mun_ibge, nr_zona', f'ano = {y}', MAP_MEMBERS, 'true')}"
            for y in (YEAR_BEFORE, YEAR_AFTER)
        )
        + """), w AS (SELECT *, sum(votos) OVER p::DOUBLE / sum(aptos) OVER p AS r FROM m WINDOW p AS (PARTITION BY ano)),
        pool AS (SELECT 1000.0 * votos / nullif(aptos, 0)::DOUBLE AS v FROM w WHERE NOT aptos * r < 20 AND aptos > 0),
        qs AS (SELECT unnest(quantile_cont(v, [0.2, 0.4, 0.6, 0.8])) AS q FROM pool),
        cand AS (SELECT d, q, round(q * power(10.0, d - 1 - floor(log10(q)))) / power(10.0, d - 1 - floor(log10(q))) AS b FROM qs, (SELECT unnest([2, 3, 4, 5, 6]) AS d)),
        n AS (SELECT d, count(DISTINCT b) AS nb, count(DISTINCT q) AS nq FROM cand GROUP BY d),
        pick AS (SELECT coalesce(min(d) FILTER (WHERE nb = nq), 6) AS d FROM n)""",
        """SELECT CAST(row_number() OVER (ORDER BY b) - 1 AS INTEGER) AS ordem, b AS quebra FROM (SELECT DISTINCT b FROM cand JOIN pick USING (d))
        WHERE b > (SELECT min(v) FROM pool) AND b <= (SELECT max(v) FROM pool)""",
    ).replace("sum(votos) OVER p::DOUBLE", "(sum(votos) OVER p)::DOUBLE"),
    "side_frame": with_sql(
        BALLOTS,
        f"""SELECT cd_mun_ibge, CAST(sum(qt) AS BIGINT) AS aptos, CAST(sum(CASE WHEN flag = 'N' THEN qt ELSE 0 END) AS BIGINT) AS validos,
        CAST(sum(CASE WHEN flag = 'N' AND s_nationkey = 2 THEN qt ELSE 0 END) AS BIGINT) AS votos FROM votacao JOIN supplier ON s_suppkey = sq_candidato
        WHERE ano = {YEAR_BEFORE} AND cd_mun_ibge <> 7 GROUP BY ALL""",
    ),
    "two_side_comparison": with_sql(
        SIDE_BY_SIDE,
        f"""SELECT CASE WHEN a.amc IS NULL THEN 'total' ELSE 'amc' END AS nivel, a.amc, a.votos AS votos_2022, b.votos AS votos_2026, {CHANGE},
        round(100.0 * b.votos / b.validos::DOUBLE - 100.0 * a.votos / a.validos::DOUBLE, 6) + 0.0 AS swing_pp,
        round(b.votos::DOUBLE / nullif(a.votos, 0), 6) + 0.0 AS retencao, b.votos - a.votos AS ganho_absoluto FROM a JOIN b ON a.amc IS NOT DISTINCT FROM b.amc""",
    ),
    "comparison_of_sides": with_sql(
        BALLOTS,
        f""", m AS (SELECT ano, cd_mun_ibge, sum(qt)::BIGINT AS aptos, sum(CASE WHEN flag = 'N' THEN qt ELSE 0 END)::BIGINT AS validos,
          sum(CASE WHEN flag = 'N' AND s_nationkey BETWEEN 8 AND 12 THEN qt ELSE 0 END)::BIGINT AS votos FROM votacao JOIN supplier ON s_suppkey = sq_candidato
          WHERE ano IN ({YEAR_BEFORE}, {YEAR_AFTER}) GROUP BY ALL),
        w AS (SELECT *, (sum(votos) OVER p)::DOUBLE / sum(aptos) OVER p AS r FROM m WINDOW p AS (PARTITION BY ano)),
        pool AS (SELECT 1000.0 * votos / aptos::DOUBLE AS v FROM w WHERE aptos > 0 AND NOT aptos * r < 20),
        qs AS (SELECT unnest(quantile_cont(v, [0.25, 0.5, 0.75])) AS q FROM pool),
        cand AS (SELECT d, q, round(q * power(10.0, d - 1 - floor(log10(q)))) / power(10.0, d - 1 - floor(log10(q))) AS b FROM qs, (SELECT unnest([2, 3, 4, 5, 6]) AS d)),
        n AS (SELECT d, count(DISTINCT b) AS nb, count(DISTINCT q) AS nq FROM cand GROUP BY d),
        pick AS (SELECT coalesce(min(d) FILTER (WHERE nb = nq), 6) AS d FROM n),
        br AS (SELECT list(DISTINCT b ORDER BY b) AS bs FROM cand JOIN pick USING (d) WHERE b > (SELECT min(v) FROM pool) AND b <= (SELECT max(v) FROM pool)),
        t AS (SELECT ano, cd_mun_ibge % 9 AS amc, sum(aptos) AS aptos, sum(validos) AS validos, sum(votos)::BIGINT AS votos FROM m GROUP BY GROUPING SETS ((ano, cd_mun_ibge % 9), (ano))),
        a AS (SELECT *, 1000.0 * votos / aptos::DOUBLE AS p FROM t WHERE ano = {YEAR_BEFORE}), z AS (SELECT *, 1000.0 * votos / aptos::DOUBLE AS p FROM t WHERE ano = {YEAR_AFTER})""",
        """SELECT CASE WHEN a.amc IS NULL THEN 'total' ELSE 'amc' END AS nivel, a.amc, a.votos AS votos_2022, z.votos AS votos_2026, round(z.p - a.p, 6) + 0.0 AS delta_penetracao,
        round(100.0 * z.votos / z.validos::DOUBLE - 100.0 * a.votos / a.validos::DOUBLE, 6) + 0.0 AS swing_pp, len(list_filter(bs, lambda x: x <= a.p))::INT AS classe_2022,
        len(list_filter(bs, lambda x: x <= z.p))::INT AS classe_2026, round(bs[1], 6) + 0.0 AS menor_quebra, len(bs)::INT AS n_quebras
        FROM a JOIN z ON a.amc IS NOT DISTINCT FROM z.amc, br""",
    ),
    "comparison_lines": with_sql(
        PRICES,
        f", a AS {_side_row(1996)}, b AS {_side_row(1998)}, fator AS (SELECT {FACTOR} AS f), linha AS ("
        + " UNION ALL ".join(_compared(c) for c in COMPARED) + ")",
        "SELECT *, CAST(CASE tipo WHEN 'monetario' THEN 0 ELSE 1000 END + CASE indicador "
        + " ".join(f"WHEN '{c}' THEN {i + 1}" for i, c in enumerate((*comparison.MONEY, *comparison.SHARES)))
        + " ELSE 500 END AS BIGINT) AS ordem FROM linha",
    ),
    "first_round_candidates": with_sql(
        CANDIDATES,
        f"""SELECT {YEAR_BEFORE} AS ano, sq_candidato, sha256(sq_candidato::VARCHAR) AS pessoa_id, nm_urna, sg_uf, 'DEPUTADO FEDERAL' AS ds_cargo, nr_partido, 'P' || nr_partido AS sg_partido,
        ds_situacao_candidatura, ds_sit_tot_turno, 1000 + sq_candidato AS nr_candidato, nm_urna AS nm_civil, sq_candidato % 13 <> 0 AS foi_as_urnas,
        substr(sha256('pub:' || sha256(sq_candidato::VARCHAR)), 1, 12) AS pessoa_pub FROM candidatos WHERE sq_candidato % 9 <> 0""",
    ),
    "difference_map": with_sql(SIDE_BY_SIDE, f"SELECT a.amc, {CHANGE} FROM a JOIN b ON a.amc = b.amc"),
    "candidate_accounts": with_sql(
        _side(1996, FACTOR),
        """SELECT sq_candidato, nr_partido, votos, round(receita_total, 2) + 0.0 AS receita_total, round(dc, 2) + 0.0 AS despesa_contratada, round(dp, 2) + 0.0 AS despesa_paga,
        round(dc - dp, 2) + 0.0 AS divida, round(dc / nullif(votos, 0), 2) + 0.0 AS custo_voto_contratado, round(receita_total / nullif(votos, 0), 2) + 0.0 AS receita_por_voto,
        round(receita_total - ct, 2) + 0.0 AS saldo_contratado, round(100.0 * ct / nullif(receita_total, 0), 2) + 0.0 AS pct_receita_gasta,
        CASE WHEN ct / nullif(rf, 0) < 0.70 THEN 'abaixo' WHEN ct / nullif(rf, 0) > 1.10 THEN 'acima' END AS sentido_alerta FROM c""",
    ),
    "group_accounts": with_sql(
        _group_totals(1996),
        """SELECT votos, round(despesa_contratada, 2) + 0.0 AS despesa_contratada, round(despesa_paga, 2) + 0.0 AS despesa_paga, round(saldo_contratado, 2) + 0.0 AS saldo_contratado,
        round(custo_voto_contratado, 2) + 0.0 AS custo_voto_contratado, round(mediana_custo_voto_contratado, 2) + 0.0 AS mediana_custo_voto_contratado,
        round(receita_por_voto, 2) + 0.0 AS receita_por_voto, round(mediana_receita_por_voto, 2) + 0.0 AS mediana_receita_por_voto, n_candidatos, n_com_contas,
        round(mediana, 2) + 0.0 AS mediana, round(liq.receita_total, 2) + 0.0 AS receita_total, round(ri, 2) + 0.0 AS receita_repasses_internos,
        round(liq.receita_total - rd, 2) + 0.0 AS receita_minima, round(liq.receita_total, 2) + 0.0 AS receita_maxima FROM tot, liq, extra""",
    ),
    "group_kpi_rows": with_sql(
        _group_totals(1996),
        "SELECT * FROM ("
        + " UNION ALL ".join(
            f"SELECT {i} AS ordem, '{c}' AS chave, '{label}' AS rotulo, round({e}, 4) + 0.0 AS valor FROM tot, liq"
            for i, ((c, label), e) in enumerate(
                zip(
                    screens.REVENUE_KPIS.items(),
                    (
                        "liq.receita_total", "tot.receita_por_voto",
                        "100.0 * (receita_fefc + receita_fundo_partidario) / liq.receita_total",
                        "100.0 * receita_recursos_proprios / liq.receita_total",
                        "100.0 * (receita_pessoa_fisica + receita_financiamento_coletivo) / liq.receita_total",
                        "tot.saldo_contratado",
                    ),
                )
            )
        )
        + ") WHERE valor IS NOT NULL",
    ),
    "account_comparison": with_sql(
        PRICES,
        f", a AS {_side_row(1996)}, b AS {_side_row(1998)}, fator AS (SELECT {FACTOR} AS f)",
        " UNION ALL ".join(_compared(c) for c in COMPARED),
    ),
    "geography": with_sql(
        PROFILE_SQL,
        """SELECT sq_candidato, n_municipios_com_voto, round(pct_maiores, 6) + 0.0 AS pct_maiores, round(hhi, 6) + 0.0 AS hhi,
        round(n_efetivo_municipios, 6) + 0.0 AS n_efetivo_municipios FROM geo""",
    ),
    "profile_reasons": with_sql(
        PROFILE_SQL,
        f""", m AS (SELECT unnest(['custo_voto_pago', 'receita_total', 'receita_por_voto', 'pct_publico', 'pct_pessoa_fisica', 'pct_autofinanciamento']) AS campo, perfil.* FROM perfil),
        x AS (SELECT sq_candidato, campo, CASE WHEN NOT contas THEN '{references.NO_ACCOUNTS}'
          WHEN campo = 'custo_voto_pago' AND (despesa_paga IS NULL OR vca = 0) THEN CASE WHEN votos = 0 THEN '{references.NO_VOTES}' ELSE '{references.NO_EXPENSE}' END
          WHEN campo <> 'custo_voto_pago' AND receita IS NULL THEN '{references.NO_REVENUE}'
          WHEN campo = 'receita_por_voto' AND vca = 0 THEN '{references.ZERO_REVENUE}' END AS motivo FROM m
          UNION ALL SELECT sq_candidato, unnest(['pct_maiores', 'hhi', 'n_efetivo_municipios']), CASE WHEN hhi IS NULL THEN '{references.NO_UNITS}' END FROM perfil)
        SELECT sq_candidato, campo, motivo FROM x WHERE motivo IS NOT NULL""",
    ),
    "reference_medians": with_sql(
        PROFILE_SQL,
        """SELECT cd_cargo, sg_uf, indicador, round(CASE WHEN count(valor) >= 3 THEN median(valor) END, 6) + 0.0 AS mediana, count(valor) AS n
        FROM longo GROUP BY ALL""",
    ),
    "relative_profile": with_sql(
        PROFILE_SQL,
        f""", md AS (SELECT cd_cargo, sg_uf, indicador, CASE WHEN count(valor) >= 3 THEN median(valor) END AS med, count(valor) AS n FROM longo GROUP BY ALL)
        SELECT l.cd_cargo, l.sg_uf, l.sq_candidato, indicador, {KIND} AS tipo, round(valor, 6) + 0.0 AS valor, round(med, 6) + 0.0 AS mediana_referencia,
        coalesce(n, 0) AS n_referencia, round(CASE {KIND} WHEN 'razao' THEN valor / nullif(med, 0) WHEN 'diferenca_pp' THEN valor - med END, 6) + 0.0 AS indice
        FROM longo l LEFT JOIN md USING (cd_cargo, sg_uf, indicador)""",
    ),
    "reference_indices": with_sql(
        PROFILE_SQL,
        f""", el AS (SELECT *, row_number() OVER (PARTITION BY cd_cargo, sg_uf ORDER BY votos DESC, sq_candidato) AS pos FROM perfil
          WHERE ds_sit_tot_turno IN ('Eleito', 'Eleito por QP', 'Eleito por média') AND nr_partido <> 14),
        md AS (SELECT cd_cargo, indicador, median(valor) AS med, count(valor) AS n FROM longo WHERE sq_candidato IN (SELECT sq_candidato FROM el WHERE pos <= 5) GROUP BY ALL)
        SELECT l.cd_cargo, l.sq_candidato, indicador, {KIND} AS tipo, round(valor, 6) + 0.0 AS valor, round(med, 6) + 0.0 AS mediana_referencia,
        coalesce(n, 0) AS n_referencia, round(CASE {KIND} WHEN 'diferenca_pp' THEN valor - med ELSE valor / nullif(med, 0) END, 6) + 0.0 AS indice
        FROM longo l LEFT JOIN md USING (cd_cargo, indicador) WHERE l.nr_partido = 14""",
    ),
}
