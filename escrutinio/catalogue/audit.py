"""Contracts, control totals, reconciliation, result documents, provenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from escrutinio.catalogue.places import SECTION_BALLOTS, _section_ballots
from escrutinio.catalogue.roles import BALLOTS, CANDIDATES, ballots, candidates, rounded, table, with_sql
from escrutinio.functions.identity import salt_fingerprint
from escrutinio.operators import reconcile as rc
from escrutinio.plans import catalog
from escrutinio.session import cut_lineage
from escrutinio.sources.contracts import Column, Contract, contract_findings
from escrutinio.sources.text_files import (
    attach_unit,
    parse_results,
    project_contract,
    result_candidates,
    result_parties,
    result_totals,
    trim_labels,
)

ORDERS = Contract("pedidos", (
    Column("o_orderkey", "bigint", required=True),
    Column("o_custkey", "bigint", key=1),
    Column("o_orderstatus", "string", required=True),
    Column("o_totalprice", "double", low=1000.0, high=400000.0),
    Column("o_orderdate", "timestamp_ntz"),
    Column("o_orderpriority", "string", key=2),
))
TEXT_ORDERS = Contract("pedidos_texto", (
    Column("cd_pedido", "bigint", key=1),
    Column("ds_situacao", "string", source="DS_SIT"),
    Column("vr_total", "double"),
    Column("dt_pedido", "date"),
    Column("nr_zona", "smallint"),
))


def contract_check(spark, d):
    return contract_findings(table(spark, d, "orders"), ORDERS)


def _text_orders(spark, d):
    """Orders as the text an official file would hold: decimal comma, day first, sentinels."""
    od = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    k = F.col("o_orderkey")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    money = F.concat(
        F.call_function("div", cents, F.lit(100).cast("bigint")).cast("string"), F.lit(","),
        F.lpad((cents % 100).cast("string"), 2, "0"),
    )
    return od.select(
        F.concat(F.lit(" "), k.cast("string")).alias("CD_PEDIDO"),
        F.when(k % 10 == 0, "#NULO").when(k % 10 == 1, " #NE ").otherwise(F.concat(F.lit(" "), F.col("o_orderstatus"), F.lit("  x"))).alias("DS_SIT"),
        F.when(k % 12 == 0, "#NULO").when(k % 12 == 1, "").otherwise(money).alias("VR_TOTAL"),
        F.when(k % 14 == 0, "").otherwise(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("DT_PEDIDO"),
        F.when(k % 6 == 0, "-1").when(k % 6 == 1, "-3").when(k % 6 == 2, "-4").otherwise((k % 100).cast("string")).alias("NR_ZONA"),
    )


def typed_text(spark, d):
    return rounded(project_contract(_text_orders(spark, d), TEXT_ORDERS), 2)


def trimmed_labels(spark, d):
    rows = trim_labels(project_contract(_text_orders(spark, d), TEXT_ORDERS))
    return rows.select("cd_pedido", "ds_situacao")


def control_totals_text(spark, d):
    return rc.control_totals_text(
        _text_orders(spark, d), {"zonas": "NR_ZONA", "pedidos": "CD_PEDIDO"}, {"total": "VR_TOTAL"}
    )


def control_totals_compare(spark, d):
    expected = rc.control_totals_text(_text_orders(spark, d), {"nr_zona": "NR_ZONA"}, {"vr_total": "VR_TOTAL"})
    typed = project_contract(_text_orders(spark, d), TEXT_ORDERS)
    return rc.compare_controls(expected, rc.control_totals_table(typed, ["nr_zona"], ["vr_total"]))


def crosswalk_join(spark, d):
    cu = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("cd_municipio_tse"))
    na = table(spark, d, "nation").filter(F.col("n_nationkey") % 6 != 0).select(
        F.col("n_nationkey").alias("cd_municipio_tse"), (F.col("n_nationkey") + 1000).alias("cd_mun_ibge")
    )
    return attach_unit(cu, na)


def orphan_units(spark, d):
    cu = table(spark, d, "customer").select(
        F.col("c_nationkey").alias("cd_municipio_tse"), F.when(F.col("c_custkey") % 2 == 0, "ZZ").otherwise("SP").alias("sg_uf")
    )
    na = table(spark, d, "nation").filter(F.col("n_nationkey") % 6 != 0).select(
        F.col("n_nationkey").alias("cd_municipio_tse"), (F.col("n_nationkey") + 1000).alias("cd_mun_ibge")
    )
    return rc.orphan_units(attach_unit(cu, na))


def ambiguous_keys(spark, d):
    od = table(spark, d, "orders").select("o_custkey", "o_orderpriority")
    return rc.ambiguous_keys(od, "o_custkey", "o_orderpriority")


def payments_with_candidacy(spark, d):
    li = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("sq_prestador_contas"), F.col("l_quantity").cast("bigint").alias("v")
    )
    links = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("sq_prestador_contas"), F.col("o_custkey").alias("sq_candidato")
    )
    return rc.attach_candidacy(li, links).groupBy("sq_candidato").agg(F.sum("v").alias("valor"))


def _control_sides(spark, d):
    rows = ballots(spark, d)
    keys = ["sq_candidato", "cd_cargo"]
    section = rows.groupBy(*keys).agg(F.sum("qt_votos_nominais").alias("votos"))
    zone = (
        rows.filter(F.col("sq_candidato") % 10 != 3)
        .groupBy(*keys)
        .agg(F.sum("qt_votos_nominais").alias("qt_votos_nominais"))
    )
    return section, zone


def entity_control(spark, d):
    section, zone = _control_sides(spark, d)
    shifted = zone.withColumn(
        "qt_votos_nominais", F.col("qt_votos_nominais") + F.when(F.col("sq_candidato") % 10 == 4, 1).otherwise(0)
    )
    return rc.entity_control(section, shifted)


def entity_control_summary(spark, d):
    return rc.require_entity_control(rc.entity_control(*_control_sides(spark, d)))


def line_control(spark, d):
    rows = _section_ballots(spark, d)
    raw = table(spark, d, "lineitem").select("l_orderkey")
    return rc.line_control(rows, raw, files=0)


def section_totals_by_ballot(spark, d):
    return rc.section_totals_by_ballot(_section_ballots(spark, d))


def ballot_kind(spark, d):
    rows = _section_ballots(spark, d)
    return rows.groupBy(rc.ballot_kind(F.col("nr_votavel"), F.col("cd_cargo")).alias("tipo_votavel")).agg(
        F.sum("qt_votos").alias("votos")
    )


def ordinary_elections(spark, d):
    rows = _section_ballots(spark, d).withColumn("cd_eleicao", (F.col("nr_local") % 4).cast("int"))
    return rc.ordinary_elections(rows, [1, 3]).groupBy("cd_eleicao").agg(F.sum("qt_votos").alias("votos"))


def _published(spark, d):
    return ballots(spark, d).filter(F.col("sq_candidato") % 10 != 3).select("cd_cargo", "sq_candidato")


def _section_by_candidate(spark, d):
    return ballots(spark, d).select("cd_cargo", "sq_candidato", F.col("qt_votos_nominais").alias("qt_votos"))


def _ballot_list(spark, d):
    su = table(spark, d, "supplier").select(F.col("s_suppkey").alias("sq_candidato"))
    return su.withColumn("foi_as_urnas", F.col("sq_candidato") % 20 == 3)


def omitted_candidates(spark, d):
    return rc.omitted_candidates(_section_by_candidate(spark, d), _published(spark, d), _ballot_list(spark, d))


def null_vote_bridge(spark, d):
    rows = _section_ballots(spark, d)
    totals = rows.groupBy("cd_cargo").agg(
        F.sum(F.when(F.col("nr_votavel") == 96, F.col("qt_votos")).otherwise(0)).alias("votos_nulos")
    )
    return rc.null_vote_bridge(totals, omitted_candidates(spark, d))


def _rebuilt_inputs(spark, d):
    """Sections, turnout and published tables of an election, with omitted and differing rows."""
    rows = ballots(spark, d)
    k, q, zone = F.col("sq_candidato"), F.col("qt_votos_nominais"), F.col("nr_zona")
    listed = F.col("nm_tipo_destinacao_votos") == "Válido (legenda)"
    code = F.when(zone == 0, 95).when(zone == 1, 96).when(listed, 10 + k % 7).otherwise(1000 + k)
    section = rows.select("sg_uf", "cd_cargo", code.alias("nr_votavel"), F.when(code >= 1000, k).alias("sq_candidato"), q.alias("qt_votos"))
    # Turnout, published tables and the operator all read the sections: written once, summed by ballot.
    section = cut_lineage(section.groupBy("sg_uf", "cd_cargo", "nr_votavel", "sq_candidato").agg(F.sum("qt_votos").alias("qt_votos")))
    v, nominal = F.col("qt_votos"), F.col("nr_votavel") >= 1000
    party = F.col("nr_votavel") < 95
    left_out = (nominal & (F.col("sq_candidato") % 10 == 3)) | (party & (F.col("nr_votavel") == 16))
    scope = ["sg_uf", "cd_cargo"]

    def measure(some):
        return F.coalesce(F.sum(F.when(some, v)), F.lit(0).cast("bigint"))

    turnout = section.groupBy(*scope).agg(
        F.sum(2 * v).alias("aptos"), F.sum(v).alias("comparecimento"), measure(nominal | party).alias("nominais_e_legenda"),
        measure(F.col("nr_votavel") == 95).alias("votos_brancos"), measure(F.col("nr_votavel") == 96).alias("votos_nulos"),
        measure(left_out).alias("_fora"),
    )
    candidates_ = section.filter(nominal & ~left_out).groupBy(*scope, "sq_candidato").agg(F.sum(v).alias("votos")).withColumn(
        "votos", F.col("votos") + F.when(F.col("sq_candidato") % 11 == 0, 1).otherwise(0)
    )
    parties = section.filter(party & ~left_out).groupBy(*scope, F.col("nr_votavel").alias("nr_partido")).agg(F.sum(v).alias("votos_legenda"))
    totals = turnout.select(
        *scope, "aptos", "comparecimento", (F.col("nominais_e_legenda") - F.col("_fora")).alias("nominais_e_legenda"), "votos_brancos",
        (F.col("votos_nulos") + F.col("_fora") + F.when(F.col("sg_uf") == "R0", 1).otherwise(0)).alias("votos_nulos"),
    )
    ineligible = table(spark, d, "supplier").select(F.col("s_suppkey").alias("sq_candidato")).filter("sq_candidato % 10 = 3 AND sq_candidato % 50 <> 3")
    members = candidates(spark, d).filter("nr_partido = 2").select("sq_candidato")
    return section, turnout.drop("_fora"), candidates_, parties, totals, ineligible, members


def rebuilt_blocks(spark, d):
    return rounded(rc.rebuilt_blocks(*_rebuilt_inputs(spark, d)))


def _reconcile_sides(spark, d):
    """Order totals by status and month against themselves with planted differences."""
    od = table(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_totalprice")
    status = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    base = od.groupBy((F.col("o_custkey") % 50).alias("grupo"), status.alias("situacao_pedido")).agg(
        F.count(F.lit(1)).alias("pedidos"), F.sum(F.floor("o_totalprice")).alias("valor")
    )
    ours = base.filter(F.col("grupo") % 11 != 0)
    theirs = base.filter(F.col("grupo") % 13 != 0).withColumns(
        {
            "pedidos": F.col("pedidos") + F.when(F.col("grupo") % 7 == 0, 1).otherwise(0),
            "valor": F.when(F.col("grupo") % 5 != 0, F.col("valor")),
        }
    )
    return ours, theirs


def reconcile(spark, d):
    return rounded(rc.compare(*_reconcile_sides(spark, d), ["grupo", "situacao_pedido"]))


def reconcile_report(spark, d):
    ours, theirs = _reconcile_sides(spark, d)
    keys = ["grupo", "situacao_pedido"]
    return rounded(
        rc.compare_report(
            {
                "pedidos": rc.compare(ours.drop("valor"), theirs.drop("valor"), keys),
                "valores": rc.compare(ours.drop("pedidos"), theirs.drop("pedidos"), keys),
            }
        )
    )


def month_gaps(spark, d):
    od = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("mes")).distinct()
    return rc.month_gaps(od.filter(~F.substring("mes", 6, 2).isin("03", "04", "12")))


def salt_consistency(spark, d):
    od = table(spark, d, "orders").select(F.year("o_orderdate").alias("ano"), "o_orderpriority").distinct()
    prov = od.select(
        F.col("o_orderpriority").alias("conjunto"),
        F.when((F.col("ano") == 1997) & F.col("o_orderpriority").startswith("1"), salt_fingerprint("b"))
        .otherwise(salt_fingerprint("a")).alias("sal_impressao"),
    )
    return rc.salt_consistency(prov)


# --- result documents -----------------------------------------------------------------------------


def _documents(spark, d):
    """One result document per part, as the text the publisher would send."""
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    k = F.col("p_partkey")

    def text(c):
        return c.cast("string")

    def cand(i):
        return F.struct(
            text(k * 10 + i).alias("sqcand"), text(k * 100 + i).alias("n"),
            F.when(k % 4 == i, "Anulado").otherwise("Válido").alias("dvt"),
            F.when(k % 3 == 0, "Eleito").alias("st"), text(k % 50 + i).alias("vap"),
        )

    def party(j):
        return F.struct(
            text(F.col("p_size") + j).alias("n"), F.col("p_name").alias("sg"), text(k % 50 * 2 + 3).alias("tvtn"),
            F.when(k % 2 == 0, text(k % 9)).otherwise("").alias("tvtl"), F.array(cand(2 * j), cand(2 * j + 1)).alias("cand"),
        )

    office = F.struct(text(k % 8 + 1).alias("cd"), F.array(F.struct(F.array(party(0), party(1)).alias("par"))).alias("agr"))
    doc = F.struct(
        F.lower(F.concat(F.lit("u"), text(k % 27))).alias("cdabr"),
        F.struct(text(k * 7).alias("te"), text(k * 5).alias("c")).alias("e"),
        F.struct(
            text(k * 4).alias("vv"), text(k * 3).alias("vnom"), F.when(k % 2 == 0, text(k)).alias("vl"),
            text(k % 11).alias("vb"), text(k % 13).alias("tvn"),
        ).alias("v"),
        F.array(office).alias("carg"),
    )
    # Dealt by part: a small file of parts is one task, their documents are not.
    return parse_results(p.repartition("p_partkey").select(F.to_json(doc).alias("doc")), "doc")


def results_totals(spark, d):
    return result_totals(_documents(spark, d))


def results_candidates(spark, d):
    return result_candidates(_documents(spark, d))


def results_parties(spark, d):
    return result_parties(_documents(spark, d))


def published_blocks(spark, d):
    docs = cut_lineage(_documents(spark, d))  # five blocks of two sides read them: parsed once
    scope = ["sg_uf", "cd_cargo"]
    t = result_totals(docs).groupBy(*scope).agg(
        *[F.sum(c).alias(c) for c in ("aptos", "votos_validos", "votos_legenda")]
    )
    c = result_candidates(docs)
    p = result_parties(docs).groupBy(*scope, "nr_partido").agg(F.sum("votos_legenda").alias("votos_legenda"))
    ours_c = c.withColumn("votos", F.col("votos") + F.when(F.col("sq_candidato") % 1000 == 1, 1).otherwise(0))
    membership = c.select(F.concat(F.lit("g"), (F.col("nr_partido") % 5).cast("string")).alias("grupo"), "sq_candidato")
    blocks = rc.published_blocks(t, c, p, t.filter(F.col("cd_cargo") != 8), ours_c, p, membership)
    return rounded(rc.compare_report(blocks))


# --- dimensions and provenance --------------------------------------------------------------------


def _dimension_rows(spark, d):
    od = table(spark, d, "orders").select("o_orderdate", "o_orderstatus", "o_orderpriority")
    return od.select(
        F.year("o_orderdate").alias("ano"), F.col("o_orderstatus").alias("sg_uf"), F.col("o_orderpriority").alias("ds_cargo"),
        F.to_date("o_orderdate").alias("dt_geracao"),
    )


def dimensions(spark, d):
    return catalog.dimensions(_dimension_rows(spark, d))


def data_version(spark, d):
    a = _dimension_rows(spark, d).select("dt_geracao")
    b = table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("dt_geracao"))
    readings = table(spark, d, "events").select(F.date_trunc("second", "ts").cast("timestamp_ntz").alias("coletado_em"))
    return catalog.data_version([a, b], readings)


def provenance(spark, d):
    prov = _dimension_rows(spark, d).groupBy(F.col("ds_cargo").alias("conjunto")).agg(
        F.max("dt_geracao").alias("dt_geracao")
    ).withColumn("regra", F.concat(F.lit("regra "), "conjunto"))
    return catalog.with_provenance(table(spark, d, "region"), "2-HIGH", prov)


QUERIES = {
    f.__name__: f
    for f in (
        contract_check, typed_text, trimmed_labels, control_totals_text, control_totals_compare,
        crosswalk_join, orphan_units, ambiguous_keys, payments_with_candidacy, entity_control,
        entity_control_summary, line_control, section_totals_by_ballot, ballot_kind,
        ordinary_elections, omitted_candidates, null_vote_bridge, rebuilt_blocks, reconcile, reconcile_report,
        month_gaps, salt_consistency, results_totals, results_candidates, results_parties,
        published_blocks, dimensions, data_version, provenance,
    )
}

TEXT = """
texto AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 < 2 THEN NULL ELSE ' ' || o_orderstatus || '  x' END AS ds_situacao,
  CASE WHEN o_orderkey % 12 < 2 THEN NULL ELSE o_totalprice END AS vr, CASE WHEN o_orderkey % 14 <> 0 THEN CAST(o_orderdate AS DATE) END AS dt,
  CASE WHEN o_orderkey % 6 > 2 THEN o_orderkey % 100 END AS zona FROM orders)
"""
SIDES = """
base AS (SELECT o_custkey % 50 AS grupo, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS sp, count(*) AS pedidos,
  sum(CAST(floor(o_totalprice) AS BIGINT)) AS valor FROM orders GROUP BY ALL),
nosso AS (SELECT * FROM base WHERE grupo % 11 <> 0),
fonte AS (SELECT grupo, sp, pedidos + CASE WHEN grupo % 7 = 0 THEN 1 ELSE 0 END AS pedidos, CASE WHEN grupo % 5 <> 0 THEN valor END AS valor FROM base WHERE grupo % 13 <> 0),
ln AS (SELECT grupo, sp, 'pedidos' AS medida, pedidos::DOUBLE AS v FROM nosso UNION ALL SELECT grupo, sp, 'valor', valor::DOUBLE FROM nosso),
lf AS (SELECT grupo, sp, 'pedidos' AS medida, pedidos::DOUBLE AS v FROM fonte UNION ALL SELECT grupo, sp, 'valor', valor::DOUBLE FROM fonte),
j AS (SELECT coalesce(n.grupo, f.grupo) AS grupo, coalesce(n.sp, f.sp) AS situacao_pedido, coalesce(n.medida, f.medida) AS medida, n.v AS nosso, f.v AS fonte,
  f.grupo IS NOT NULL AS tem FROM ln n FULL JOIN lf f ON n.grupo = f.grupo AND n.sp IS NOT DISTINCT FROM f.sp AND n.medida = f.medida),
comp AS (SELECT *, nosso - fonte AS diferenca, 100.0 * (nosso - fonte) / nullif(fonte, 0) AS diferenca_pct,
  CASE WHEN nosso IS NULL THEN 'so_fonte' WHEN fonte IS NULL THEN 'so_nosso' WHEN abs(nosso - fonte) <= 0 THEN 'confere' ELSE 'diverge' END AS situacao
  FROM j WHERE NOT (tem AND fonte IS NULL))
"""
DOCS = """
doc AS (SELECT p_partkey AS k, 'U' || p_partkey % 27 AS sg_uf, p_partkey % 8 + 1 AS cd_cargo, p_name, p_size FROM part),
par AS (SELECT doc.*, j, CAST(p_size + j AS BIGINT) AS nr_partido FROM doc, (SELECT unnest([0, 1]) AS j)),
can AS (SELECT par.*, 2 * j + i AS q FROM par, (SELECT unnest([0, 1]) AS i)),
candidato AS (SELECT sg_uf, cd_cargo, k * 10 + q AS sq_candidato, k * 100 + q AS nr_candidato, nr_partido,
  CASE WHEN k % 4 = q THEN 'Anulado' ELSE 'Válido' END AS destinacao, CASE WHEN k % 3 = 0 THEN 'Eleito' END AS situacao, k % 50 + q AS votos FROM can)
"""
REPORT = """count(*) AS comparacoes, count(*) FILTER (WHERE situacao = 'confere') AS confere, count(*) FILTER (WHERE situacao = 'diverge') AS diverge,
  count(*) FILTER (WHERE situacao = 'so_nosso') AS so_nosso, count(*) FILTER (WHERE situacao = 'so_fonte') AS so_fonte,
  round(max(abs(diferenca)), 6) + 0.0 AS maior_diferenca"""

ORACLE = {
    "contract_check": """SELECT 'linhas' AS regra, count(*) AS ocorrencias FROM orders
        UNION ALL SELECT 'nulo:o_orderkey', count(*) FILTER (WHERE o_orderkey IS NULL) FROM orders
        UNION ALL SELECT 'nulo:o_orderstatus', count(*) FILTER (WHERE o_orderstatus IS NULL) FROM orders
        UNION ALL SELECT 'faixa:o_totalprice', count(*) FILTER (WHERE NOT o_totalprice BETWEEN 1000 AND 400000) FROM orders
        UNION ALL SELECT 'chave_repetida', CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey, o_orderpriority)""",
    "typed_text": with_sql(
        TEXT,
        """SELECT k AS cd_pedido, ds_situacao, round(vr, 2) + 0.0 AS vr_total, dt AS dt_pedido, CAST(zona AS SMALLINT) AS nr_zona FROM texto""",
    ),
    "trimmed_labels": with_sql(TEXT, r"SELECT k AS cd_pedido, regexp_replace(trim(ds_situacao), '\s+', ' ', 'g') AS ds_situacao FROM texto"),
    "control_totals_text": with_sql(
        TEXT,
        """SELECT count(*) AS linhas, CAST(sum(zona) AS BIGINT) AS zonas, count(*) FILTER (WHERE zona IS NULL) AS zonas_sentinela, 0::BIGINT AS zonas_nulo,
        CAST(sum(k) AS BIGINT) AS pedidos, 0::BIGINT AS pedidos_sentinela, 0::BIGINT AS pedidos_nulo,
        CAST(sum(CAST(round(vr * 100) AS BIGINT)) AS BIGINT) AS total, count(*) FILTER (WHERE vr IS NULL) AS total_nulo FROM texto""",
    ),
    "control_totals_compare": with_sql(
        TEXT,
        """, t AS (SELECT count(*) AS linhas, CAST(sum(zona) AS BIGINT) AS z, CAST(sum(CAST(round(vr * 100) AS BIGINT)) AS BIGINT) AS v FROM texto)
        SELECT 'linhas' AS controle, linhas AS esperado, linhas AS obtido, true AS igual FROM t
        UNION ALL SELECT 'nr_zona', z, z, true FROM t UNION ALL SELECT 'vr_total', v, v, true FROM t""",
    ),
    "crosswalk_join": "SELECT c_custkey, c_nationkey AS cd_municipio_tse, CASE WHEN c_nationkey % 6 <> 0 THEN c_nationkey + 1000 END AS cd_mun_ibge FROM customer",
    "orphan_units": "SELECT DISTINCT c_nationkey AS cd_municipio_tse FROM customer WHERE c_nationkey % 6 = 0 AND c_custkey % 2 <> 0",
    "ambiguous_keys": "SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) > 1",
    "payments_with_candidacy": "SELECT o_custkey AS sq_candidato, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS valor FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
    "entity_control": with_sql(
        BALLOTS,
        """, s AS (SELECT sq_candidato, 6 AS cd_cargo, CAST(sum(qt) AS BIGINT) AS secao FROM votacao GROUP BY ALL)
        SELECT sq_candidato, cd_cargo, secao, CASE WHEN sq_candidato % 10 <> 3 THEN secao + CASE WHEN sq_candidato % 10 = 4 THEN 1 ELSE 0 END END AS munzona,
        CASE sq_candidato % 10 WHEN 3 THEN 'fora' WHEN 4 THEN 'diverge' ELSE 'confere' END AS situacao FROM s""",
    ),
    "entity_control_summary": with_sql(
        BALLOTS,
        """SELECT count(DISTINCT sq_candidato) FILTER (WHERE sq_candidato % 10 = 3) AS candidatos_fora_do_munzona,
        CAST(sum(qt) FILTER (WHERE sq_candidato % 10 = 3) AS BIGINT) AS votos_fora_do_munzona FROM votacao""",
    ),
    "line_control": "SELECT count(*) AS linhas_lidas, count(*) FILTER (WHERE l_linenumber = 7) AS linhas_turno2_ignoradas, count(*) AS linhas_origem FROM lineitem",
    "section_totals_by_ballot": with_sql(
        SECTION_BALLOTS,
        """SELECT 1 AS cd_eleicao, cd_cargo, nr_votavel, sq_candidato, CAST(sum(qt) AS BIGINT) AS qt_votos FROM boletim WHERE nr_turno = 1 GROUP BY ALL""",
    ),
    "ballot_kind": with_sql(
        SECTION_BALLOTS,
        """SELECT CASE nr_votavel WHEN 95 THEN 'branco' WHEN 96 THEN 'nulo' WHEN 13 THEN 'legenda' ELSE 'nominal' END AS tipo_votavel,
        CAST(sum(qt) AS BIGINT) AS votos FROM boletim GROUP BY 1""",
    ),
    "ordinary_elections": with_sql(
        SECTION_BALLOTS,
        """SELECT CAST(nr_local % 4 AS INTEGER) AS cd_eleicao, CAST(sum(qt) AS BIGINT) AS votos FROM boletim WHERE nr_turno = 1 AND nr_local % 4 IN (1, 3) GROUP BY 1""",
    ),
    "omitted_candidates": with_sql(
        BALLOTS,
        """SELECT sq_candidato, 6 AS cd_cargo, CAST(sum(qt) AS BIGINT) AS votos, sq_candidato % 20 = 3 AS foi_as_urnas, sq_candidato % 20 = 3 AS inesperado
        FROM votacao WHERE sq_candidato % 10 = 3 GROUP BY sq_candidato""",
    ),
    "null_vote_bridge": with_sql(
        SECTION_BALLOTS + "," + BALLOTS,
        """, n AS (SELECT CAST(sum(qt) FILTER (WHERE nr_votavel = 96) AS BIGINT) AS a FROM boletim),
        o AS (SELECT CAST(sum(qt) FILTER (WHERE sq_candidato % 10 = 3) AS BIGINT) AS b FROM votacao)
        SELECT 6 AS cd_cargo, a AS votos_nulos, b AS votos_omitidos, a + b AS votos_nulos_reconciliados FROM n, o""",
    ),
    "rebuilt_blocks": with_sql(
        BALLOTS + "," + CANDIDATES,
        """, sec AS (SELECT sg_uf, sq_candidato AS k, qt, CASE WHEN nr_zona = 0 THEN 95 WHEN nr_zona = 1 THEN 96 WHEN flag = 'R' THEN 10 + sq_candidato % 7 ELSE 1000 + sq_candidato END AS cod FROM votacao),
        s AS (SELECT *, CASE WHEN cod >= 1000 THEN 'candidatos' WHEN cod < 95 THEN 'legenda' END AS tipo, CASE WHEN cod >= 1000 THEN k ELSE cod END AS chave,
          (cod >= 1000 AND k % 10 = 3) OR cod = 16 AS fora FROM sec),
        c AS (SELECT sg_uf, tipo, chave, any_value(fora) AS fora, sum(qt)::DOUBLE AS q FROM s WHERE tipo IS NOT NULL GROUP BY ALL),
        t AS (SELECT sg_uf, sum(2 * qt)::DOUBLE AS aptos, sum(qt)::DOUBLE AS comp, coalesce(sum(qt) FILTER (WHERE tipo IS NOT NULL), 0)::DOUBLE AS nl,
          coalesce(sum(qt) FILTER (WHERE cod = 95), 0)::DOUBLE AS br, coalesce(sum(qt) FILTER (WHERE fora), 0)::DOUBLE AS ponte FROM s GROUP BY ALL),
        u AS (SELECT tipo AS bloco, sg_uf, 6 AS cd_cargo, chave, 'votos' AS nome, q + CASE WHEN tipo = 'candidatos' AND chave % 11 = 0 THEN 1 ELSE 0 END AS nosso, q AS fonte FROM c WHERE NOT fora
          UNION ALL SELECT 'grupos', sg_uf, 6, chave, 'votos', q + CASE WHEN chave % 11 = 0 THEN 1 ELSE 0 END, q FROM c
            WHERE NOT fora AND tipo = 'candidatos' AND chave IN (SELECT sq_candidato FROM candidatos WHERE nr_partido = 2)
          UNION ALL SELECT 'omitidos_inelegiveis', sg_uf, NULL, NULL, 'n_omitidos', count(*)::DOUBLE, (count(*) FILTER (WHERE chave % 50 <> 3))::DOUBLE FROM c WHERE fora AND tipo = 'candidatos' GROUP BY sg_uf
          UNION ALL SELECT 'totais', sg_uf, 6, NULL, unnest(['aptos', 'comparecimento', 'nominais_e_legenda', 'votos_brancos']), unnest([aptos, comp, nl, br]), unnest([aptos, comp, nl, br]) FROM t
          UNION ALL SELECT 'nulos', sg_uf, 6, NULL, 'votos_que_viraram_nulos', ponte + CASE WHEN sg_uf = 'R0' THEN 1 ELSE 0 END, ponte FROM t)
        SELECT bloco, sg_uf, cd_cargo, chave, nome, nosso, fonte, nosso - fonte AS diferenca, round(100.0 * (nosso - fonte) / nullif(fonte, 0), 6) + 0.0 AS diferenca_pct,
        CASE WHEN nosso = fonte THEN 'confere' ELSE 'diverge' END AS situacao FROM u""",
    ),
    "reconcile": with_sql(
        SIDES,
        """SELECT grupo, situacao_pedido, medida, round(nosso, 6) + 0.0 AS nosso, round(fonte, 6) + 0.0 AS fonte, round(diferenca, 6) + 0.0 AS diferenca,
        round(diferenca_pct, 6) + 0.0 AS diferenca_pct, situacao FROM comp""",
    ),
    "reconcile_report": with_sql(
        SIDES, f"SELECT CASE medida WHEN 'pedidos' THEN 'pedidos' ELSE 'valores' END AS bloco, {REPORT} FROM comp GROUP BY 1"
    ),
    "month_gaps": """WITH m AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS mes FROM orders WHERE month(o_orderdate) NOT IN (3, 4, 12)),
        l AS (SELECT mes, CAST(substr(mes, 1, 4) AS INTEGER) * 12 + CAST(substr(mes, 6, 2) AS INTEGER) AS n FROM m),
        g AS (SELECT mes, n, lag(n) OVER (ORDER BY n) AS p FROM l)
        SELECT mes, 1::BIGINT AS linhas, true AS lacuna, strftime(CAST(mes || '-01' AS DATE) + INTERVAL 1 MONTH, '%Y-%m') AS proximo FROM g WHERE p IS NOT NULL AND n <> p + 1""",
    "salt_consistency": "SELECT DISTINCT o_orderpriority AS conjunto, o_orderpriority NOT LIKE '1%' AS consistente FROM orders",
    "results_totals": with_sql(
        DOCS,
        """SELECT sg_uf, cd_cargo, k * 7 AS aptos, k * 5 AS comparecimento, k * 4 AS votos_validos, k * 3 AS votos_nominais_validos,
        CASE WHEN k % 2 = 0 THEN k END AS votos_legenda, k % 11 AS votos_brancos, k % 13 AS votos_nulos FROM doc""",
    ),
    "results_candidates": with_sql(DOCS, "SELECT * FROM candidato"),
    "results_parties": with_sql(
        DOCS,
        """SELECT sg_uf, cd_cargo, nr_partido, p_name AS sg_partido, k % 50 * 2 + 3 AS votos_nominais, CASE WHEN k % 2 = 0 THEN k % 9 END AS votos_legenda FROM par""",
    ),
    "published_blocks": with_sql(
        DOCS,
        f""", t AS (SELECT sg_uf, cd_cargo, CAST(sum(k * 7) AS BIGINT) AS a, CAST(sum(k * 4) AS BIGINT) AS v, CAST(sum(CASE WHEN k % 2 = 0 THEN k END) AS BIGINT) AS l FROM doc GROUP BY ALL),
        tl AS (SELECT sg_uf, cd_cargo, unnest(['a', 'v', 'l']) AS m, unnest([a, v, l]) AS x FROM t),
        r1 AS (SELECT 'totais' AS bloco, CASE WHEN cd_cargo = 8 THEN 'so_fonte' ELSE 'confere' END AS situacao, CASE WHEN cd_cargo <> 8 THEN 0.0::DOUBLE END AS diferenca FROM tl WHERE x IS NOT NULL),
        nl AS (SELECT cd_cargo, m, sum(x) AS x FROM tl GROUP BY ALL),
        r2 AS (SELECT 'totais_nacionais', CASE WHEN cd_cargo = 8 THEN 'so_fonte' ELSE 'confere' END, CASE WHEN cd_cargo <> 8 THEN 0.0::DOUBLE END FROM nl WHERE x IS NOT NULL),
        r3 AS (SELECT 'candidatos', CASE WHEN sq_candidato % 1000 = 1 THEN 'diverge' ELSE 'confere' END, CASE WHEN sq_candidato % 1000 = 1 THEN 1.0::DOUBLE ELSE 0 END FROM candidato),
        p AS (SELECT sg_uf, cd_cargo, nr_partido, sum(CASE WHEN k % 2 = 0 THEN k % 9 END) AS x FROM par GROUP BY ALL),
        r4 AS (SELECT 'legenda', 'confere', 0.0::DOUBLE FROM p WHERE x IS NOT NULL),
        g AS (SELECT nr_partido % 5 AS g, cd_cargo, count(*) FILTER (WHERE sq_candidato % 1000 = 1)::DOUBLE AS dif FROM candidato GROUP BY ALL),
        r5 AS (SELECT 'grupos', CASE WHEN dif > 0 THEN 'diverge' ELSE 'confere' END, dif FROM g),
        u AS (SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3 UNION ALL SELECT * FROM r4 UNION ALL SELECT * FROM r5)""",
        f"SELECT bloco, {REPORT} FROM u GROUP BY bloco",
    ),
    "dimensions": """SELECT DISTINCT 'ano' AS dimensao, CAST(CAST(year(o_orderdate) AS INTEGER) AS VARCHAR) AS valor FROM orders
        UNION SELECT 'uf', o_orderstatus FROM orders UNION SELECT 'cargo', o_orderpriority FROM orders""",
    "data_version": """SELECT greatest((SELECT max(CAST(o_orderdate AS DATE)) FROM orders), (SELECT max(CAST(l_shipdate AS DATE)) FROM lineitem)) AS dt_geracao,
        greatest((SELECT max(CAST(o_orderdate AS DATE)) FROM orders), (SELECT max(CAST(l_shipdate AS DATE)) FROM lineitem))::VARCHAR || '+' ||
        (SELECT strftime(date_trunc('second', max(ts)), '%Y-%m-%d %H:%M:%S') FROM events) AS versao""",
    "provenance": """SELECT r_regionkey, r_name, '2-HIGH' AS fonte, (SELECT max(CAST(o_orderdate AS DATE)) FROM orders WHERE o_orderpriority = '2-HIGH') AS fonte_dt_geracao,
        'regra 2-HIGH' AS fonte_regra FROM region""",
}
