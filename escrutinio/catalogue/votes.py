"""Votes, rates, concentration, classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from escrutinio.catalogue.roles import (
    BALLOTS,
    CANDIDATES,
    DENSE,
    VOTES,
    ballots,
    candidates,
    electorate,
    rounded,
    table,
    votes,
    with_sql,
)
from escrutinio.functions.rates import electoral_quotient, votes_per_km2
from escrutinio.operators import groups, performance, reference, spatial
from escrutinio.plans import catalog, lists

SEATS = 40


def votes_by_destination(spark, d):
    return performance.votes_by_destination(ballots(spark, d))


def dense_indicators(spark, d):
    return rounded(performance.unit_indicators(votes(spark, d), electorate(spark, d)))


def dense_zeros(spark, d):
    return performance.sparse_zeros(votes(spark, d), electorate(spark, d))


def totals(spark, d):
    return rounded(performance.sparse_totals(votes(spark, d), electorate(spark, d)))


def table_totals(spark, d):
    v = votes(spark, d).join(electorate(spark, d), "cd_mun_ibge")
    base = electorate(spark, d).agg(F.struct(F.sum("aptos").alias("a"), F.sum("validos").alias("v")).alias("t")).scalar()
    own = v.groupBy("sq_candidato").agg(F.sum("votos").alias("votos")).withColumn("_t", base)
    return rounded(performance.scope_totals(own.select("sq_candidato", "votos", F.col("_t.a").alias("aptos"), F.col("_t.v").alias("validos"))))


def location_quotient(spark, d):
    t = votes(spark, d).join(electorate(spark, d), "cd_mun_ibge")
    return rounded(spatial.location_quotient(t).select("sq_candidato", "cd_mun_ibge", "lq"))


def low_count(spark, d):
    t = performance.unit_indicators(votes(spark, d), electorate(spark, d))
    return rounded(t.select("sq_candidato", "cd_mun_ibge", "votos", "taxa_referencia", "esperado", "n_baixo"))


def low_count_by_state(spark, d):
    t = electorate(spark, d).withColumnRenamed("validos", "votos").withColumn(
        "cd_mun_ibge", F.col("cd_mun_ibge") + 1000
    )
    return rounded(performance.low_count_by_prefix(t))


def concentration(spark, d):
    e = electorate(spark, d)
    t = votes(spark, d).join(e, "cd_mun_ibge")
    return rounded(spatial.concentration(t, electorate=e))


def concentration_dense(spark, d):
    return rounded(spatial.concentration(performance.with_zeros(votes(spark, d), electorate(spark, d))))


def top_k_share(spark, d):
    return rounded(spatial.largest_units_share(votes(spark, d), k=5))


def typology(spark, d):
    e = electorate(spark, d)
    t = spatial.concentration(votes(spark, d).join(e, "cd_mun_ibge"), electorate=e)
    q = e.agg(electoral_quotient(F.sum("validos"), F.lit(SEATS)).alias("q")).scalar()
    return rounded(spatial.typology(t, q))


def eb_smoothing(spark, d):
    t = votes(spark, d).join(electorate(spark, d), "cd_mun_ibge")
    return rounded(
        spatial.smoothed_rates(t, by=["sq_candidato"]).select(
            "sq_candidato", "cd_mun_ibge", "taxa_bruta", "eb_b", "eb_a", "peso", "taxa_eb"
        ),
        9,
    )


def party_quota(spark, d):
    party = candidates(spark, d).select("sq_candidato", "nr_partido")
    rows = performance.votes_by_destination(ballots(spark, d), ["sq_candidato"])
    parties = (
        rows.join(party, "sq_candidato")
        .groupBy("nr_partido")
        .agg(
            F.sum("votos_nominais_validos").alias("votos_nominais_validos"),
            F.sum("votos_convertidos_legenda").alias("qt_votos_nom_convr_leg_validos"),
            F.sum("votos_anulados").alias("qt_votos_legenda_validos"),
        )
    )
    whole = electorate(spark, d).agg(F.sum("validos").alias("v")).scalar()
    return rounded(
        performance.party_votes(
            parties.withColumns({"qt_total_votos_validos_uf": whole, "vagas": F.lit(SEATS)})
        )
    )


def top_elected(spark, d):
    c = candidates(spark, d).join(votes(spark, d, "sq_candidato"), "sq_candidato", "left")
    c = c.withColumn("votos", F.coalesce("votos", F.lit(0).cast("bigint")))
    return reference.select_elected(c, n=5, exclude_parties=(14,), exclude_ids=(0, 7))


def class_breaks(spark, d):
    t = performance.sparse_penetration(votes(spark, d), electorate(spark, d), reliable=True)
    return spatial.class_breaks(t, 5, "penetracao", low=None, weight="peso")


def quantile_scale(spark, d):
    t = performance.sparse_penetration(votes(spark, d), electorate(spark, d))
    return rounded(spatial.quantile_scale(t, 7, "penetracao", "peso"))


def class_of_value(spark, d):
    t = performance.sparse_penetration(votes(spark, d), electorate(spark, d))
    breaks = spatial.quantile_scale(t, 4, "penetracao", "peso")
    out = spatial.with_class(t.select(F.col("penetracao").alias("valor"), "peso"), breaks)
    return out.groupBy("classe").agg(F.sum("peso").alias("n"))


def symmetric_extent(spark, d):
    t = performance.sparse_penetration(votes(spark, d), electorate(spark, d))
    return spatial.symmetric_extent(t.select((F.col("penetracao") - 10).alias("valor")))


def divergent_breaks(spark, d):
    t = performance.sparse_penetration(votes(spark, d), electorate(spark, d))
    top = spatial.symmetric_extent(t.select((F.col("penetracao") - 10).alias("valor")))
    linear = spatial.divergent_breaks(F.col("extensao"), 5)
    logs = spatial.divergent_log_breaks(F.lit(8.0), 5)
    return rounded(
        top.select(F.posexplode(F.arrays_zip(linear.alias("linear"), logs.alias("log"))).alias("ordem", "b"))
        .select("ordem", "b.linear", "b.log")
    )


def density_km2(spark, d):
    t = electorate(spark, d).withColumn("area_km2", (F.col("cd_mun_ibge") % 7 * 12.5))
    return rounded(
        t.select("cd_mun_ibge", votes_per_km2("validos").alias("votos_km2"))
    )


def votes_by_zone(spark, d):
    return catalog.votes_by_zone(ballots(spark, d))


def electorate_by_zone(spark, d):
    detail = ballots(spark, d).withColumnsRenamed(
        {"qt_votos_nominais": "qt_aptos", "qt_votos_nominais_validos": "qt_total_votos_validos"}
    )
    return catalog.electorate_by_zone(detail)


def votes_by_territory(spark, d):
    mine = groups.members_filter(catalog.votes_by_zone(ballots(spark, d)), [1, 2, 3, 5, 8])
    return lists.territory_votes(mine, by_zone=True, state="R2")


def vote_totals(spark, d):
    return lists.vote_totals(catalog.votes_by_zone(ballots(spark, d)))


def electoral_base(spark, d):
    return lists.electoral_base(electorate_by_zone(spark, d))


def collective_candidate(spark, d):
    members = groups.members_by_rule(
        candidates(spark, d), party=3,
        listed=table(spark, d, "supplier").filter(F.col("s_acctbal") < 0).select(
            F.col("s_suppkey").alias("sq_candidato")
        ),
    )
    return groups.aggregate_group(votes(spark, d), members, "coletivo")


def group_votes(spark, d):
    membership = candidates(spark, d).select(
        F.concat(F.lit("p"), F.col("nr_partido").cast("string")).alias("grupo"), "sq_candidato"
    )
    return groups.aggregate_groups(votes(spark, d), membership)


def eligible_count(spark, d):
    c = candidates(spark, d)
    strict = groups.eligible_count(c, by=["sg_uf"])
    wide = groups.eligible_count(c, by=["sg_uf"], include_undecided=True)
    return wide.withColumnRenamed("n_candidatos", "n_em_disputa").join(strict, "sg_uf", "left").select(
        "sg_uf", F.coalesce("n_candidatos", F.lit(0).cast("bigint")).alias("n_candidatos"), "n_em_disputa"
    )


def group_kpis(spark, d):
    members = candidates(spark, d).filter(F.col("nr_partido") == 3)
    v, e = catalog.votes_by_zone(ballots(spark, d)), electorate_by_zone(spark, d)
    return rounded(lists.group_kpis(v, e, members, "DEPUTADO FEDERAL", 1997))


def per_candidate(spark, d):
    from escrutinio.operators.evolution import per_candidate as normalise

    c = candidates(spark, d)
    v = votes(spark, d, "sq_candidato").join(c.select("sq_candidato", "sg_uf"), "sq_candidato")
    base = electorate(spark, d).agg(F.sum("aptos").alias("a")).scalar()
    n = groups.eligible_count(c, by=["sg_uf"])
    t = v.groupBy("sg_uf").agg(F.sum("votos").alias("votos")).join(n, "sg_uf")
    return rounded(normalise(t.withColumn("aptos", base)))


QUERIES = {
    "votes_by_destination": votes_by_destination,
    "dense_indicators": dense_indicators,
    "dense_zeros": dense_zeros,
    "totals": totals,
    "table_totals": table_totals,
    "location_quotient": location_quotient,
    "low_count": low_count,
    "low_count_by_state": low_count_by_state,
    "concentration": concentration,
    "concentration_dense": concentration_dense,
    "top_k_share": top_k_share,
    "typology": typology,
    "eb_smoothing": eb_smoothing,
    "party_quota": party_quota,
    "top_elected": top_elected,
    "class_breaks": class_breaks,
    "quantile_scale": quantile_scale,
    "class_of_value": class_of_value,
    "symmetric_extent": symmetric_extent,
    "divergent_breaks": divergent_breaks,
    "density_km2": density_km2,
    "votes_by_zone": votes_by_zone,
    "electorate_by_zone": electorate_by_zone,
    "votes_by_territory": votes_by_territory,
    "vote_totals": vote_totals,
    "electoral_base": electoral_base,
    "collective_candidate": collective_candidate,
    "group_votes": group_votes,
    "eligible_count": eligible_count,
    "group_kpis": group_kpis,
    "per_candidate": per_candidate,
}

INDICATORS = (
    DENSE
    + """, tv AS (SELECT sq_candidato, sum(votos) AS vc FROM votos GROUP BY ALL),
te AS (SELECT sum(aptos) AS ta, sum(validos) AS tva FROM eleitorado),
ind AS (
  SELECT d.*, 100.0 * votos / nullif(validos, 0)::DOUBLE AS pct_validos,
         1000.0 * votos / nullif(aptos, 0)::DOUBLE AS penetracao,
         votos::DOUBLE * tva / nullif(vc::DOUBLE * validos, 0) AS lq,
         vc::DOUBLE / nullif(ta, 0) AS taxa_referencia,
         aptos * (vc::DOUBLE / nullif(ta, 0)) AS esperado,
         coalesce(aptos * (vc::DOUBLE / nullif(ta, 0)) < 20, true) AS n_baixo
  FROM densa d JOIN tv USING (sq_candidato) CROSS JOIN te)
"""
)
CONCENTRATION = (
    DENSE
    + """, partes AS (
  SELECT *, votos::DOUBLE / nullif(sum(votos) OVER w, 0) AS s,
         aptos::DOUBLE / nullif(sum(aptos) OVER w, 0) AS x,
         coalesce(votos::DOUBLE / nullif(validos, 0), 0) AS f
  FROM densa WINDOW w AS (PARTITION BY sq_candidato)),
conc AS (
  SELECT sq_candidato, CAST(sum(votos) AS BIGINT) AS votos, sum(s * s) AS hhi,
         1 / sum(s * s) AS n_efetivo_municipios, sum(s * f) AS dominancia_ames,
         sum((s - x) * (s - x)) AS indice_g
  FROM partes GROUP BY ALL)
"""
)
CONCENTRATION_OUT = """SELECT sq_candidato, votos, round(hhi, 6) + 0.0 AS hhi,
  round(n_efetivo_municipios, 6) + 0.0 AS n_efetivo_municipios,
  round(dominancia_ames, 6) + 0.0 AS dominancia_ames, round(indice_g, 6) + 0.0 AS indice_g FROM conc"""
SIGNIFICANT = "round(q * power(10.0, {d} - 1 - floor(log10(q)))) / power(10.0, {d} - 1 - floor(log10(q)))"

ORACLE = {
    "votes_by_destination": with_sql(
        BALLOTS,
        """SELECT sq_candidato, cd_mun_ibge,
        CAST(coalesce(sum(qt) FILTER (WHERE flag = 'N'), 0) AS BIGINT) AS votos_nominais_validos,
        CAST(coalesce(sum(qt) FILTER (WHERE flag = 'A'), 0) AS BIGINT) AS votos_anulados,
        CAST(coalesce(sum(qt) FILTER (WHERE flag = 'R'), 0) AS BIGINT) AS votos_convertidos_legenda
        FROM votacao GROUP BY ALL""",
    ),
    "dense_indicators": with_sql(
        INDICATORS,
        """SELECT sq_candidato, cd_mun_ibge, aptos, validos, votos,
        round(pct_validos, 6) + 0.0 AS pct_validos, round(penetracao, 6) + 0.0 AS penetracao,
        round(lq, 6) + 0.0 AS lq, round(taxa_referencia, 6) + 0.0 AS taxa_referencia,
        round(esperado, 6) + 0.0 AS esperado, n_baixo FROM ind""",
    ),
    "dense_zeros": with_sql(
        DENSE,
        """SELECT sq_candidato, count(*) AS unidades, count(*) FILTER (WHERE votos = 0) AS sem_voto,
        CAST(sum(votos) AS BIGINT) AS votos FROM densa GROUP BY ALL""",
    ),
    "low_count": with_sql(
        INDICATORS,
        """SELECT sq_candidato, cd_mun_ibge, votos, round(taxa_referencia, 6) + 0.0 AS taxa_referencia,
        round(esperado, 6) + 0.0 AS esperado, n_baixo FROM ind""",
    ),
    "low_count_by_state": with_sql(
        VOTES,
        """, t AS (SELECT cd_mun_ibge + 1000 AS cd_mun_ibge, aptos, validos AS votos,
          substr(CAST(cd_mun_ibge + 1000 AS VARCHAR), 1, 2) AS p FROM eleitorado),
        s AS (SELECT p, sum(votos)::DOUBLE / nullif(sum(aptos), 0) AS r FROM t GROUP BY ALL)
        SELECT cd_mun_ibge, aptos, votos, round(r, 6) + 0.0 AS taxa_referencia,
        round(aptos * r, 6) + 0.0 AS esperado, coalesce(aptos * r < 20, true) AS n_baixo
        FROM t JOIN s USING (p)""",
    ),
    "location_quotient": with_sql(
        VOTES,
        """, t AS (SELECT sq_candidato, cd_mun_ibge, votos, validos FROM votos JOIN eleitorado USING (cd_mun_ibge))
        SELECT sq_candidato, cd_mun_ibge,
        round(votos::DOUBLE * sum(validos) OVER w / nullif(sum(votos) OVER w * validos::DOUBLE, 0), 6) + 0.0 AS lq
        FROM t WINDOW w AS (PARTITION BY sq_candidato)""",
    ),
    "concentration": with_sql(CONCENTRATION, CONCENTRATION_OUT),
    "concentration_dense": with_sql(CONCENTRATION, CONCENTRATION_OUT),
    "top_k_share": with_sql(
        VOTES,
        """, r AS (SELECT *, row_number() OVER (PARTITION BY sq_candidato ORDER BY votos DESC, cd_mun_ibge) AS rn FROM votos)
        SELECT sq_candidato, CAST(sum(votos) AS BIGINT) AS votos,
        count(*) FILTER (WHERE votos > 0) AS n_municipios_com_voto,
        round(100.0 * sum(votos) FILTER (WHERE rn <= 5) / nullif(sum(votos), 0)::DOUBLE, 6) + 0.0 AS pct_maiores
        FROM r GROUP BY ALL""",
    ),
    "typology": with_sql(
        CONCENTRATION,
        f""", q AS (SELECT sum(validos)::BIGINT AS v, {SEATS} AS s FROM eleitorado),
        qe AS (SELECT v // s + CASE WHEN 2 * (v % s) > s THEN 1 ELSE 0 END AS qe FROM q),
        m AS (SELECT median(indice_g) AS mg, median(dominancia_ames) AS md FROM conc, qe WHERE votos >= 0.10::DOUBLE * qe)
        SELECT sq_candidato, round(0.10::DOUBLE * qe, 6) + 0.0 AS limiar_votos,
        round(mg, 6) + 0.0 AS mediana_g, round(md, 6) + 0.0 AS mediana_dominancia,
        CASE WHEN indice_g > mg THEN 'concentrado' WHEN indice_g <= mg THEN 'disperso' END || '-' ||
        CASE WHEN dominancia_ames > md THEN 'dominante' WHEN dominancia_ames <= md THEN 'compartilhado' END AS tipo,
        votos >= 0.10::DOUBLE * qe AS na_populacao_referencia FROM conc, qe, m""",
    ),
    "eb_smoothing": with_sql(
        VOTES,
        """, t AS (SELECT sq_candidato, cd_mun_ibge, votos::DOUBLE AS v, aptos::DOUBLE AS n,
          votos::DOUBLE / aptos AS r FROM votos JOIN eleitorado USING (cd_mun_ibge) WHERE aptos > 0),
        b AS (SELECT *, sum(v) OVER w / sum(n) OVER w AS b FROM t WINDOW w AS (PARTITION BY sq_candidato)),
        a AS (SELECT *, greatest(sum(n * (r - b) * (r - b)) OVER w / sum(n) OVER w - b / avg(n) OVER w, 0) AS a
          FROM b WINDOW w AS (PARTITION BY sq_candidato)),
        p AS (SELECT *, coalesce(a / nullif(a + b / n, 0), 0) AS p FROM a)
        SELECT sq_candidato, cd_mun_ibge, round(r, 9) + 0.0 AS taxa_bruta, round(b, 9) + 0.0 AS eb_b,
        round(a, 9) + 0.0 AS eb_a, round(p, 9) + 0.0 AS peso, round(p * r + (1 - p) * b, 9) + 0.0 AS taxa_eb FROM p""",
    ),
    "party_quota": with_sql(
        VOTES + "," + CANDIDATES,
        f""", p AS (SELECT nr_partido,
          CAST(coalesce(sum(qt) FILTER (WHERE flag = 'N'), 0) AS BIGINT) AS votos_nominais_validos,
          CAST(coalesce(sum(qt) FILTER (WHERE flag = 'R'), 0) AS BIGINT) AS qt_votos_nom_convr_leg_validos,
          CAST(coalesce(sum(qt) FILTER (WHERE flag = 'A'), 0) AS BIGINT) AS qt_votos_legenda_validos
          FROM votacao JOIN candidatos USING (sq_candidato) GROUP BY ALL),
        q AS (SELECT sum(validos)::BIGINT AS v, {SEATS} AS s FROM eleitorado),
        e AS (SELECT v AS qt_total_votos_validos_uf, s AS vagas, v // s + CASE WHEN 2 * (v % s) > s THEN 1 ELSE 0 END AS qe FROM q)
        SELECT p.*, qt_total_votos_validos_uf, vagas,
        qt_votos_legenda_validos + qt_votos_nom_convr_leg_validos AS votos_legenda_total, qe AS quociente_eleitoral,
        votos_nominais_validos + qt_votos_legenda_validos + qt_votos_nom_convr_leg_validos AS votacao_partido,
        round((votos_nominais_validos + qt_votos_legenda_validos + qt_votos_nom_convr_leg_validos)::DOUBLE / nullif(qe, 0), 6) + 0.0 AS votacao_em_qe,
        (votos_nominais_validos + qt_votos_legenda_validos + qt_votos_nom_convr_leg_validos) // nullif(qe, 0) AS quociente_partidario
        FROM p, e""",
    ),
    "top_elected": with_sql(
        VOTES + "," + CANDIDATES,
        """, t AS (SELECT c.*, coalesce(v.votos, 0)::BIGINT AS votos FROM candidatos c
          LEFT JOIN (SELECT sq_candidato, sum(votos) AS votos FROM votos GROUP BY ALL) v USING (sq_candidato)),
        r AS (SELECT *, row_number() OVER (PARTITION BY cd_cargo, sg_uf ORDER BY votos DESC, sq_candidato) AS posicao
          FROM t WHERE ds_sit_tot_turno IN ('Eleito', 'Eleito por QP', 'Eleito por média')
          AND nr_partido <> 14 AND sq_candidato NOT IN (0, 7))
        SELECT cd_cargo, sg_uf, posicao, sq_candidato, nr_partido, votos FROM r WHERE posicao <= 5""",
    ),
    "class_breaks": with_sql(
        INDICATORS,
        f""", pool AS (SELECT penetracao AS v FROM ind WHERE NOT n_baixo AND penetracao IS NOT NULL),
        qs AS (SELECT unnest(quantile_cont(v, [0.2, 0.4, 0.6, 0.8])) AS q FROM pool),
        e AS (SELECT min(v) AS lo, max(v) AS hi FROM pool),
        cand AS (SELECT d, q, CASE d {' '.join(f'WHEN {d} THEN ' + SIGNIFICANT.format(d=d) for d in range(2, 7))} END AS b
          FROM qs, (SELECT unnest([2, 3, 4, 5, 6]) AS d)),
        n AS (SELECT d, count(DISTINCT b) AS nb, count(DISTINCT q) AS nq FROM cand GROUP BY d),
        pick AS (SELECT coalesce(min(d) FILTER (WHERE nb = nq), 6) AS d FROM n)
        SELECT CAST(row_number() OVER (ORDER BY b) - 1 AS INTEGER) AS ordem, b AS quebra
        FROM (SELECT DISTINCT b FROM cand JOIN pick USING (d)), e WHERE b > lo AND b <= hi""",
    ),
    "quantile_scale": with_sql(
        INDICATORS,
        """SELECT DISTINCT round(q, 6) + 0.0 AS quebra FROM (
          SELECT unnest(quantile_cont(penetracao, [1/7.0, 2/7.0, 3/7.0, 4/7.0, 5/7.0, 6/7.0])) AS q, min(penetracao) AS lo
          FROM ind) WHERE q > lo""",
    ),
    "class_of_value": with_sql(
        INDICATORS,
        """, b AS (SELECT list(DISTINCT q) AS b FROM (SELECT unnest(quantile_cont(penetracao, [0.25, 0.5, 0.75])) AS q,
          min(penetracao) AS lo FROM ind) WHERE q > lo)
        SELECT CAST(len(list_filter(b, lambda x: penetracao >= x)) AS INTEGER) AS classe, count(*) AS n FROM ind, b GROUP BY ALL""",
    ),
    "symmetric_extent": with_sql(
        INDICATORS,
        """, m AS (SELECT max(abs(penetracao - 10)) AS m FROM ind)
        SELECT CASE WHEN m = 0 THEN 1.0::DOUBLE ELSE ceil(m / power(10.0, floor(log10(m)))) * power(10.0, floor(log10(m))) END AS extensao FROM m""",
    ),
    "divergent_breaks": with_sql(
        INDICATORS,
        """, m AS (SELECT max(abs(penetracao - 10)) AS m FROM ind),
        x AS (SELECT ceil(m / power(10.0, floor(log10(m)))) * power(10.0, floor(log10(m))) AS x FROM m)
        SELECT CAST(j AS INTEGER) AS ordem, round(-x + 2 * x * (j + 1) / 5, 6) + 0.0 AS linear,
        round(power(8.0, 2.0 * (j + 1) / 5 - 1), 6) + 0.0 AS log FROM x, (SELECT unnest([0, 1, 2, 3]) AS j)""",
    ),
    "density_km2": with_sql(
        VOTES,
        "SELECT cd_mun_ibge, round(validos / nullif(cd_mun_ibge % 7 * 12.5, 0)::DOUBLE, 6) + 0.0 AS votos_km2 FROM eleitorado",
    ),
    "votes_by_zone": with_sql(
        BALLOTS,
        """SELECT ano, sq_candidato, sg_uf, cd_mun_ibge, nr_zona,
        CAST(sum(CASE WHEN flag = 'N' THEN qt ELSE 0 END) AS BIGINT) AS votos FROM votacao GROUP BY ALL""",
    ),
    "electorate_by_zone": with_sql(
        BALLOTS,
        """SELECT ano, sg_uf, 'DEPUTADO FEDERAL' AS ds_cargo, cd_mun_ibge, nr_zona, CAST(sum(qt) AS BIGINT) AS aptos,
        CAST(sum(CASE WHEN flag = 'N' THEN qt ELSE 0 END) AS BIGINT) AS votos_validos FROM votacao GROUP BY ALL""",
    ),
    "votes_by_territory": with_sql(
        BALLOTS,
        """SELECT cd_mun_ibge, nr_zona, CAST(sum(CASE WHEN flag = 'N' THEN qt ELSE 0 END) AS BIGINT) AS votos
        FROM votacao WHERE sq_candidato IN (1, 2, 3, 5, 8) AND sg_uf = 'R2' GROUP BY ALL""",
    ),
    "vote_totals": with_sql(
        BALLOTS,
        """SELECT ano, sq_candidato, CAST(sum(CASE WHEN flag = 'N' THEN qt ELSE 0 END) AS BIGINT) AS votos
        FROM votacao GROUP BY ALL""",
    ),
    "electoral_base": with_sql(
        BALLOTS,
        """SELECT ano, 'DEPUTADO FEDERAL' AS ds_cargo, cd_mun_ibge, CAST(sum(qt) AS BIGINT) AS aptos,
        CAST(sum(CASE WHEN flag = 'N' THEN qt ELSE 0 END) AS BIGINT) AS validos FROM votacao GROUP BY ALL""",
    ),
    "collective_candidate": with_sql(
        VOTES,
        """SELECT 'coletivo' AS grupo, cd_mun_ibge, CAST(sum(votos) AS BIGINT) AS votos FROM votos
        WHERE sq_candidato IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 3 OR s_acctbal < 0) GROUP BY ALL""",
    ),
    "group_votes": with_sql(
        VOTES,
        """SELECT 'p' || s_nationkey AS grupo, cd_mun_ibge, CAST(sum(votos) AS BIGINT) AS votos
        FROM votos JOIN supplier ON sq_candidato = s_suppkey GROUP BY ALL""",
    ),
    "eligible_count": with_sql(
        CANDIDATES,
        """SELECT sg_uf, count(*) FILTER (WHERE ds_situacao_candidatura = 'APTO') AS n_candidatos,
        count(*) FILTER (WHERE ds_situacao_candidatura = 'APTO' OR ds_situacao_candidatura IS NULL) AS n_em_disputa
        FROM candidatos GROUP BY ALL HAVING n_em_disputa > 0""",
    ),
    "group_kpis": with_sql(
        BALLOTS,
        """, g AS (SELECT CAST(coalesce(sum(qt), 0) AS BIGINT) AS votos FROM votacao JOIN supplier ON sq_candidato = s_suppkey
          WHERE s_nationkey = 3 AND ano = 1997 AND flag = 'N'),
        b AS (SELECT CAST(sum(qt) AS BIGINT) AS aptos, CAST(sum(qt) FILTER (WHERE flag = 'N') AS BIGINT) AS validos
          FROM votacao WHERE ano = 1997)
        SELECT votos, aptos, validos, round(100.0 * votos / validos::DOUBLE, 6) + 0.0 AS pct_validos,
        round(1000.0 * votos / aptos::DOUBLE, 6) + 0.0 AS penetracao FROM g, b""",
    ),
    "per_candidate": with_sql(
        VOTES + "," + CANDIDATES,
        """, t AS (SELECT sg_uf, CAST(sum(votos) AS BIGINT) AS votos FROM votos JOIN candidatos USING (sq_candidato) GROUP BY ALL),
        n AS (SELECT sg_uf, count(*) AS n_candidatos FROM candidatos WHERE ds_situacao_candidatura = 'APTO' GROUP BY ALL),
        a AS (SELECT CAST(sum(aptos) AS BIGINT) AS aptos FROM eleitorado)
        SELECT sg_uf, votos, n_candidatos, aptos, round(votos / n_candidatos::DOUBLE, 6) + 0.0 AS votos_por_candidato,
        round(1000.0 * votos / aptos::DOUBLE, 6) + 0.0 AS penetracao,
        round(1000.0 * votos / aptos::DOUBLE / n_candidatos, 6) + 0.0 AS penetracao_por_candidato
        FROM t JOIN n USING (sg_uf), a""",
    ),
}
ORACLE["totals"] = ORACLE["table_totals"] = with_sql(
    DENSE,
    """, s AS (SELECT sq_candidato, CAST(sum(votos) AS BIGINT) AS votos, CAST(sum(aptos) AS BIGINT) AS aptos,
      CAST(sum(validos) AS BIGINT) AS validos FROM densa GROUP BY ALL)
    SELECT *, round(100.0 * votos / nullif(validos, 0)::DOUBLE, 6) + 0.0 AS pct_validos,
    round(1000.0 * votos / nullif(aptos, 0)::DOUBLE, 6) + 0.0 AS penetracao FROM s""",
)
