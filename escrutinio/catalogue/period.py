"""Two years over comparable areas, same persons, strongholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from escrutinio.catalogue.roles import (
    BALLOTS,
    YEAR_AFTER,
    YEAR_BEFORE,
    ballots,
    electorate,
    rounded,
    table,
    votes,
    with_sql,
)
from escrutinio.operators import evolution as ev
from escrutinio.operators import performance
from escrutinio.operators.statistics import correlation_strength, spearman


def areas(spark, d):
    return table(spark, d, "nation").select(
        F.col("n_nationkey").alias("cd_mun_ibge"), (F.col("n_nationkey") % 9).alias("amc")
    )


def year_counts(spark, d, year):
    return (
        ballots(spark, d)
        .filter(F.col("ano") == year)
        .groupBy("cd_mun_ibge")
        .agg(
            F.sum("qt_votos_nominais").alias("aptos"),
            F.sum("qt_votos_nominais_validos").alias("validos"),
            F.coalesce(
                F.sum(F.when(F.col("sq_candidato") % 4 == 1, F.col("qt_votos_nominais_validos"))), F.lit(0)
            ).alias("votos"),
        )
    )


def evolution_area(spark, d):
    old, new = year_counts(spark, d, YEAR_BEFORE), year_counts(spark, d, YEAR_AFTER)
    # One municipality of each year is left out, so that some areas exist in one year only.
    old = old.filter(F.col("cd_mun_ibge") % 9 != 8)
    return rounded(ev.evolution(old, new, areas(spark, d), office=6))


def area_counts(spark, d):
    return ev.to_areas(year_counts(spark, d, YEAR_BEFORE), areas(spark, d))


def _people(spark, d, year):
    od = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    return (
        od.filter(F.year("o_orderdate") == year)
        .groupBy(F.col("o_custkey").cast("string").alias("pessoa_id"))
        .agg(F.sum(F.floor("o_totalprice")).alias("votos"))
    )


def same_people(spark, d):
    return rounded(ev.same_people(_people(spark, d, YEAR_BEFORE), _people(spark, d, YEAR_AFTER)))


def common_people(spark, d):
    return ev.common_people(_people(spark, d, YEAR_BEFORE), _people(spark, d, YEAR_AFTER))


def _quotients(spark, d):
    """Location quotient of candidacy 3 by zone and municipality in both years."""
    unit = ["cd_mun_ibge", "nr_zona"]
    rows = ballots(spark, d)
    sides = []
    for y in (YEAR_BEFORE, YEAR_AFTER):
        mine = rows.filter((F.col("ano") == y) & (F.col("nm_tipo_destinacao_votos") == "Válido"))
        per = mine.groupBy(*unit).agg(
            F.sum("qt_votos_nominais").alias("v"),
            F.sum(F.when(F.col("sq_candidato") % 20 == 3, F.col("qt_votos_nominais")).otherwise(0)).alias("c"),
        )
        whole = per.agg(F.struct(F.sum("v").alias("v"), F.sum("c").alias("c")).alias("t")).scalar()
        quotient = F.col("c").cast("double") * F.col("_t.v") / (F.col("_t.c").cast("double") * F.col("v"))
        sides.append(per.withColumn("_t", whole).select(*unit, quotient.alias(f"lq_{y}"), F.col("v").alias(f"v_{y}")))
    return (
        sides[0].join(sides[1], unit)
        .withColumn("n_baixo", (F.col(f"v_{YEAR_BEFORE}") < 60) | (F.col(f"v_{YEAR_AFTER}") < 60))
        .withColumn("amc", F.col("cd_mun_ibge") * 100 + F.col("nr_zona"))
        .select("amc", f"lq_{YEAR_BEFORE}", f"lq_{YEAR_AFTER}", "n_baixo")
    )


def strongholds(spark, d):
    return ev.strongholds(_quotients(spark, d), before=str(YEAR_BEFORE), after=str(YEAR_AFTER))


def stronghold_overlap(spark, d):
    out = ev.stronghold_overlap(_quotients(spark, d), before=str(YEAR_BEFORE), after=str(YEAR_AFTER))
    return rounded(out)


def rank_correlation(spark, d):
    """Votes of a candidacy against its lines, by region of the voter."""
    rows = ballots(spark, d).groupBy("sg_uf", "sq_candidato").agg(
        F.sum("qt_votos_nominais").alias("x"), F.count(F.lit(1)).alias("y")
    )
    out = rounded(spearman(rows, "x", "y", ["sg_uf"]))
    return out.withColumn("forca", correlation_strength(F.col("rho")))


def unit_penetration_change(spark, d):
    """Evolution of every candidacy at once: the scope is a key, not a loop."""
    v = votes(spark, d, "ano", "sq_candidato", "cd_mun_ibge")
    e = electorate(spark, d, "ano", "cd_mun_ibge")
    t = v.join(e, ["ano", "cd_mun_ibge"])
    old, new = (t.filter(F.col("ano") == y).drop("ano") for y in (YEAR_BEFORE, YEAR_AFTER))
    return rounded(
        ev.evolution(old, new, areas(spark, d), ["sq_candidato"], office=6).select(
            "sq_candidato", "amc", "delta_penetracao", "swing_pp", "retencao", "ganho_absoluto"
        )
    )


def collective_indicators(spark, d):
    """All unit indicators with the party as the entity."""
    su = table(spark, d, "supplier").select(F.col("s_suppkey").alias("sq_candidato"), F.col("s_nationkey").alias("grupo"))
    v = votes(spark, d).join(su, "sq_candidato").groupBy("grupo", "cd_mun_ibge").agg(F.sum("votos").alias("votos"))
    return rounded(performance.unit_indicators(v, electorate(spark, d), "grupo"))


QUERIES = {
    "evolution_area": evolution_area,
    "area_counts": area_counts,
    "same_people": same_people,
    "common_people": common_people,
    "strongholds": strongholds,
    "stronghold_overlap": stronghold_overlap,
    "rank_correlation": rank_correlation,
    "unit_penetration_change": unit_penetration_change,
    "collective_indicators": collective_indicators,
}

YEAR_COUNTS = (
    BALLOTS
    + """, contagem AS (
  SELECT ano, cd_mun_ibge, cd_mun_ibge % 9 AS amc, qt AS aptos,
         CASE WHEN flag = 'N' THEN qt ELSE 0 END AS validos,
         CASE WHEN flag = 'N' AND sq_candidato % 4 = 1 THEN qt ELSE 0 END AS votos
  FROM votacao)
"""
)
CHANGES = """
  1000.0 * b.votos / nullif(b.aptos, 0)::DOUBLE - 1000.0 * a.votos / nullif(a.aptos, 0)::DOUBLE"""


def _people_sql(select: str) -> str:
    return with_sql(
        f"""pessoas AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS ano, CAST(o_custkey AS VARCHAR) AS pessoa_id,
          CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS votos FROM orders
          WHERE year(o_orderdate) IN ({YEAR_BEFORE}, {YEAR_AFTER}) GROUP BY ALL),
        lado AS (SELECT pessoa_id, max(votos) FILTER (WHERE ano = {YEAR_BEFORE}) AS a,
          max(votos) FILTER (WHERE ano = {YEAR_AFTER}) AS b FROM pessoas GROUP BY ALL)""",
        select,
    )


QUOTIENTS = (
    BALLOTS
    + f""", q AS (
  SELECT ano, cd_mun_ibge * 100 + nr_zona AS amc, sum(qt) AS v,
         sum(CASE WHEN sq_candidato % 20 = 3 THEN qt ELSE 0 END) AS c
  FROM votacao WHERE flag = 'N' AND ano IN ({YEAR_BEFORE}, {YEAR_AFTER}) GROUP BY ALL),
l AS (SELECT ano, amc, v, c::DOUBLE * sum(v) OVER w / (sum(c) OVER w * v::DOUBLE) AS lq FROM q WINDOW w AS (PARTITION BY ano)),
par AS (SELECT a.amc, a.lq AS la, b.lq AS lb, a.v < 60 OR b.v < 60 AS n_baixo
  FROM l a JOIN l b USING (amc) WHERE a.ano = {YEAR_BEFORE} AND b.ano = {YEAR_AFTER})
"""
)

ORACLE = {
    "evolution_area": with_sql(
        YEAR_COUNTS,
        f""", a AS (SELECT amc, CAST(sum(aptos) AS BIGINT) AS aptos, CAST(sum(validos) AS BIGINT) AS validos,
          CAST(sum(votos) AS BIGINT) AS votos FROM contagem WHERE ano = {YEAR_BEFORE} AND cd_mun_ibge % 9 <> 8 GROUP BY ALL),
        b AS (SELECT amc, CAST(sum(aptos) AS BIGINT) AS aptos, CAST(sum(validos) AS BIGINT) AS validos,
          CAST(sum(votos) AS BIGINT) AS votos FROM contagem WHERE ano = {YEAR_AFTER} GROUP BY ALL)
        SELECT coalesce(a.amc, b.amc) AS amc, a.aptos AS aptos_2022, a.validos AS validos_2022, a.votos AS votos_2022,
        b.aptos AS aptos_2026, b.validos AS validos_2026, b.votos AS votos_2026,
        round(1000.0 * a.votos / a.aptos::DOUBLE, 6) + 0.0 AS penetracao_2022,
        round(1000.0 * b.votos / b.aptos::DOUBLE, 6) + 0.0 AS penetracao_2026,
        round(100.0 * a.votos / a.validos::DOUBLE, 6) + 0.0 AS pct_validos_2022,
        round(100.0 * b.votos / b.validos::DOUBLE, 6) + 0.0 AS pct_validos_2026,
        round({CHANGES}, 6) + 0.0 AS delta_penetracao,
        round(100.0 * b.votos / b.validos::DOUBLE - 100.0 * a.votos / a.validos::DOUBLE, 6) + 0.0 AS swing_pp,
        round(b.votos::DOUBLE / nullif(a.votos, 0), 6) + 0.0 AS retencao, b.votos - a.votos AS ganho_absoluto
        FROM a FULL JOIN b ON a.amc = b.amc""",
    ),
    "area_counts": with_sql(
        YEAR_COUNTS,
        f"""SELECT amc, CAST(sum(aptos) AS BIGINT) AS aptos, CAST(sum(validos) AS BIGINT) AS validos,
        CAST(sum(votos) AS BIGINT) AS votos FROM contagem WHERE ano = {YEAR_BEFORE} GROUP BY ALL""",
    ),
    "same_people": _people_sql(
        """SELECT count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS n_comuns, count(a) AS n_2022, count(b) AS n_2026,
        CAST(sum(a) FILTER (WHERE b IS NOT NULL) AS BIGINT) AS votos_2022,
        CAST(sum(b) FILTER (WHERE a IS NOT NULL) AS BIGINT) AS votos_2026,
        round(sum(b) FILTER (WHERE a IS NOT NULL)::DOUBLE / sum(a) FILTER (WHERE b IS NOT NULL), 6) + 0.0 AS retencao FROM lado"""
    ),
    "common_people": _people_sql(
        "SELECT pessoa_id, a AS votos_2022, b AS votos_2026 FROM lado WHERE a IS NOT NULL AND b IS NOT NULL"
    ),
    "strongholds": with_sql(
        QUOTIENTS,
        f"""SELECT CAST(amc AS INTEGER) AS amc, coalesce(NOT n_baixo AND la >= 2, false) AS reduto_{YEAR_BEFORE},
        coalesce(NOT n_baixo AND lb >= 2, false) AS reduto_{YEAR_AFTER} FROM par WHERE NOT n_baixo AND (la >= 2 OR lb >= 2)""",
    ),
    "stronghold_overlap": with_sql(
        QUOTIENTS,
        f""", s AS (SELECT NOT n_baixo AND la >= 2 AS a, NOT n_baixo AND lb >= 2 AS b FROM par),
        r AS (SELECT rank() OVER (ORDER BY la) + (count(*) OVER (PARTITION BY la) - 1) / 2.0 AS ra,
          rank() OVER (ORDER BY lb) + (count(*) OVER (PARTITION BY lb) - 1) / 2.0 AS rb FROM par)
        SELECT count(*) FILTER (WHERE a) AS n_redutos_{YEAR_BEFORE}, count(*) FILTER (WHERE b) AS n_redutos_{YEAR_AFTER},
        round(count(*) FILTER (WHERE a AND b)::DOUBLE / nullif(count(*) FILTER (WHERE a OR b), 0), 6) + 0.0 AS jaccard,
        (SELECT round(corr(ra, rb), 6) + 0.0 FROM r) AS spearman FROM s""",
    ),
    "rank_correlation": with_sql(
        BALLOTS,
        """, t AS (SELECT sg_uf, sq_candidato, sum(qt) AS x, count(*) AS y FROM votacao GROUP BY ALL),
        r AS (SELECT sg_uf, rank() OVER (PARTITION BY sg_uf ORDER BY x) + (count(*) OVER (PARTITION BY sg_uf, x) - 1) / 2.0 AS rx,
          rank() OVER (PARTITION BY sg_uf ORDER BY y) + (count(*) OVER (PARTITION BY sg_uf, y) - 1) / 2.0 AS ry FROM t),
        c AS (SELECT sg_uf, count(*) AS n, corr(rx, ry) AS rho FROM r GROUP BY ALL)
        SELECT sg_uf, n, round(rho, 6) + 0.0 AS rho, CASE WHEN abs(rho) < 0.1 THEN 'nenhuma' WHEN abs(rho) < 0.3 THEN 'fraca'
        WHEN abs(rho) < 0.5 THEN 'moderada' WHEN abs(rho) < 0.7 THEN 'forte' ELSE 'muito forte' END AS forca FROM c""",
    ),
    "unit_penetration_change": with_sql(
        BALLOTS,
        f""", v AS (SELECT ano, sq_candidato, cd_mun_ibge, sum(qt) AS votos FROM votacao WHERE flag = 'N' GROUP BY ALL),
        e AS (SELECT ano, cd_mun_ibge, sum(qt) AS aptos, sum(CASE WHEN flag = 'N' THEN qt ELSE 0 END) AS validos FROM votacao GROUP BY ALL),
        s AS (SELECT ano, sq_candidato, cd_mun_ibge % 9 AS amc, CAST(sum(votos) AS BIGINT) AS votos,
          CAST(sum(aptos) AS BIGINT) AS aptos, CAST(sum(validos) AS BIGINT) AS validos FROM v JOIN e USING (ano, cd_mun_ibge) GROUP BY ALL),
        a AS (SELECT * FROM s WHERE ano = {YEAR_BEFORE}), b AS (SELECT * FROM s WHERE ano = {YEAR_AFTER})
        SELECT coalesce(a.sq_candidato, b.sq_candidato) AS sq_candidato, coalesce(a.amc, b.amc) AS amc,
        round({CHANGES}, 6) + 0.0 AS delta_penetracao,
        round(100.0 * b.votos / b.validos::DOUBLE - 100.0 * a.votos / a.validos::DOUBLE, 6) + 0.0 AS swing_pp,
        round(b.votos::DOUBLE / nullif(a.votos, 0), 6) + 0.0 AS retencao, b.votos - a.votos AS ganho_absoluto
        FROM a FULL JOIN b ON a.sq_candidato = b.sq_candidato AND a.amc = b.amc""",
    ),
    "collective_indicators": with_sql(
        BALLOTS,
        """, v AS (SELECT s_nationkey AS grupo, cd_mun_ibge, CAST(sum(qt) AS BIGINT) AS votos FROM votacao
          JOIN supplier ON sq_candidato = s_suppkey WHERE flag = 'N' GROUP BY ALL),
        e AS (SELECT cd_mun_ibge, CAST(sum(qt) AS BIGINT) AS aptos, CAST(sum(CASE WHEN flag = 'N' THEN qt ELSE 0 END) AS BIGINT) AS validos FROM votacao GROUP BY ALL),
        t AS (SELECT g.grupo, e.*, coalesce(v.votos, 0) AS votos FROM (SELECT DISTINCT grupo FROM v) g CROSS JOIN e
          LEFT JOIN v ON v.grupo = g.grupo AND v.cd_mun_ibge = e.cd_mun_ibge),
        w AS (SELECT *, sum(votos) OVER p AS vc, sum(aptos) OVER p AS ta, sum(validos) OVER p AS tv FROM t WINDOW p AS (PARTITION BY grupo))
        SELECT grupo, cd_mun_ibge, aptos, validos, votos, round(100.0 * votos / validos::DOUBLE, 6) + 0.0 AS pct_validos,
        round(1000.0 * votos / aptos::DOUBLE, 6) + 0.0 AS penetracao, round(votos::DOUBLE * tv / (vc::DOUBLE * validos), 6) + 0.0 AS lq,
        round(vc::DOUBLE / ta, 6) + 0.0 AS taxa_referencia, round(aptos * (vc::DOUBLE / ta), 6) + 0.0 AS esperado,
        aptos * (vc::DOUBLE / ta) < 20 AS n_baixo FROM w""",
    ),
}
