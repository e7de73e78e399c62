"""Polling places, grid cells, coverage, nearest zone, spatial autocorrelation."""

from __future__ import annotations

from pyspark.sql import functions as F

from escrutinio.catalogue.roles import (
    BALLOTS,
    PLACE_VOTES,
    PLACES,
    ballots,
    place_votes,
    places,
    rounded,
    table,
    with_sql,
)
from escrutinio.operators import places as pl
from escrutinio.operators import spatial
from escrutinio.plans import maps

SITE_KEY = ["cd_mun_ibge", "nr_zona", "nr_local_votacao"]


def _sections(spark, d):
    """Line items as sections of the place their order number picks."""
    li = table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_shipdate"
    )
    k, n = F.col("l_orderkey") % 520, F.col("l_partkey")
    return li.select(
        (k % 25).cast("int").alias("cd_mun_ibge"),
        (k % 3).cast("int").alias("nr_zona"),
        k.alias("nr_local_votacao"),
        F.when(k % 13 == 0, "ZZ").otherwise("R1").alias("sg_uf"),
        (n * 10 + F.col("l_linenumber")).cast("string").alias("nr_secao"),
        F.when(n % 3 != 0, F.concat(F.lit("Escola "), (n % 7).cast("string"))).alias("nm_local_votacao"),
        F.when(n % 5 == 0, -1.0).when(n % 5 == 1, F.lit(None).cast("double")).otherwise(-20 - F.col("l_tax") * 100).alias("nr_latitude"),
        F.when(n % 5 == 0, -1.0).when(n % 5 == 2, 10.5).otherwise(-50 - F.col("l_discount") * 100).alias("nr_longitude"),
        F.col("l_quantity").cast("bigint").alias("qt_eleitor_secao"),
        F.to_date("l_shipdate").alias("dt_geracao"),
    )


def coordinate_cleaning(spark, d):
    out = pl.clean_coordinates(_sections(spark, d))
    return rounded(out.select("sg_uf", "cd_mun_ibge", "nr_zona", "nr_latitude", "nr_longitude"))


def suspicious_places(spark, d):
    rows = _sections(spark, d).withColumn("cd_municipio_tse", F.col("cd_mun_ibge"))
    return pl.suspicious_places(rows)


def place_rollup(spark, d):
    return rounded(pl.roll_up_places(pl.clean_coordinates(_sections(spark, d)), SITE_KEY))


def _section_ballots(spark, d):
    li = table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag"
    )
    k = F.col("l_orderkey") % 520
    nobody = F.col("l_returnflag") == "R"
    return li.select(
        (k % 25).cast("int").alias("cd_mun_ibge"),
        (k % 3).cast("int").alias("nr_zona"),
        k.alias("nr_local"),
        F.when(F.col("l_linenumber") == 7, 2).otherwise(1).alias("nr_turno"),
        F.lit(6).alias("cd_cargo"),
        F.lit(1).alias("cd_eleicao"),
        F.when(~nobody, F.col("l_suppkey")).alias("sq_candidato"),
        F.when(~nobody, 1000 + F.col("l_suppkey"))
        .when(F.col("l_partkey") % 3 == 0, 95)
        .when(F.col("l_partkey") % 3 == 1, 96)
        .otherwise(13)
        .cast("int")
        .alias("nr_votavel"),
        F.col("l_quantity").cast("bigint").alias("qt_votos"),
    )


BALLOT_KEY = ["cd_mun_ibge", "nr_zona", "nr_local"]


def section_to_place_votes(spark, d):
    return pl.place_votes(_section_ballots(spark, d), BALLOT_KEY)


def section_to_place_totals(spark, d):
    return pl.place_totals(_section_ballots(spark, d), BALLOT_KEY)


def assigned_cells(spark, d):
    return pl.assign_cells(places(spark, d)).select("nr_local", "h3", "h3_r7", "h3_r6")


def _with_cells(spark, d):
    return pl.assign_cells(places(spark, d))


def _local_votes(spark, d):
    p = _with_cells(spark, d)
    v = place_votes(spark, d).groupBy(*BALLOT_KEY).agg(F.sum("votos").alias("votos"))
    return p.join(v, BALLOT_KEY)


def cell_aggregate(spark, d):
    return rounded(spatial.cell_indicators(_local_votes(spark, d), "h3_r6"))


def cell_aggregate_by_zone(spark, d):
    return rounded(spatial.cell_indicators(_local_votes(spark, d), "h3_r6", ["nr_zona"]))


def coverage(spark, d):
    return rounded(spatial.cell_coverage(_local_votes(spark, d), "h3"))


def coverage_by_state(spark, d):
    return rounded(pl.coverage_by_state(place_votes(spark, d), _with_cells(spark, d)))


def place_coverage(spark, d):
    return pl.place_coverage(_with_cells(spark, d))


def votes_by_cell(spark, d):
    mine = place_votes(spark, d).filter(F.col("sq_candidato").isin(3, 4, 5))
    return pl.votes_by_cell(_with_cells(spark, d), mine, "h3_r7")


def uncovered_votes(spark, d):
    return pl.uncovered_votes(place_votes(spark, d), _with_cells(spark, d))


def grid_points(spark, d):
    return rounded(pl.grid_points(_local_votes(spark, d)))


def density_points(spark, d):
    return rounded(maps.density_points(place_votes(spark, d), _with_cells(spark, d), 50, 10))


def density_grid(spark, d):
    return rounded(maps.density_points(place_votes(spark, d), _with_cells(spark, d), 40, national=True))


def nearest_zone(spark, d):
    """Places without the parity of their number look for the zone of the nearest other place."""
    p = places(spark, d)
    sites = p.filter(F.col("nr_local") % 2 == 0).select(
        "cd_mun_ibge", "nr_zona", "lat", "lon", F.col("aptos").alias("eleitores")
    )
    points = p.filter(F.col("nr_local") % 2 == 1).select(F.col("nr_local").alias("ponto"), "cd_mun_ibge", "lat", "lon")
    return pl.nearest_zone(points, sites).select("ponto", "cd_mun_ibge", "nr_zona")


def _ring(spark, d):
    na = table(spark, d, "nation").select("n_nationkey")
    return na.select(
        F.col("n_nationkey").alias("id"),
        F.explode(F.array((F.col("n_nationkey") + 5) % 25, (F.col("n_nationkey") + 20) % 25)).alias("vizinho"),
    )


def _unit_rate(spark, d):
    return (
        ballots(spark, d)
        .groupBy(F.col("cd_mun_ibge").alias("id"))
        .agg(
            (F.sum("qt_votos_nominais_validos") / F.sum("qt_votos_nominais").cast("double")).alias("valor")
        )
    )


def moran_local(spark, d):
    return rounded(spatial.moran_local(_unit_rate(spark, d), _ring(spark, d)))


def moran_global(spark, d):
    return rounded(spatial.moran_global(_unit_rate(spark, d), _ring(spark, d)))


def moran_global_p(spark, d):
    return rounded(spatial.moran_global_p(_unit_rate(spark, d), _ring(spark, d)))


def moran_local_p(spark, d):
    return rounded(spatial.moran_local_p(_unit_rate(spark, d), _ring(spark, d)))


def municipality_dimension(spark, d):
    na = table(spark, d, "nation")
    crosswalk = na.select(
        F.col("n_nationkey").alias("cd_mun_ibge"), (F.col("n_nationkey") + 500).alias("cd_municipio_tse"),
        F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("sg_uf"),
        F.col("n_name").alias("nm_municipio_ibge"),
    )
    raw = na.select(
        F.when(F.col("n_nationkey") != 99, F.col("n_nationkey").cast("string")).alias("CD_MUN"),
        (F.col("n_nationkey") * 10.5 + 1).alias("AR_MUN_2024"),
    )
    merges = na.filter(F.col("n_nationkey") < 12).select(
        (F.col("n_nationkey") % 5).alias("conjunto"), F.col("n_nationkey").alias("cd_mun_ibge")
    )
    return rounded(pl.build_municipalities(crosswalk, pl.clean_areas(raw), merges))


QUERIES = {
    f.__name__: f
    for f in (
        coordinate_cleaning, suspicious_places, place_rollup, section_to_place_votes,
        section_to_place_totals, assigned_cells, cell_aggregate, cell_aggregate_by_zone, coverage,
        coverage_by_state, place_coverage, votes_by_cell, uncovered_votes, grid_points,
        density_points, density_grid, nearest_zone, moran_local, moran_global, moran_global_p,
        moran_local_p, municipality_dimension,
    )
}

SECTIONS = """
secoes AS (
  SELECT CAST(l_orderkey % 520 % 25 AS INTEGER) AS cd_mun_ibge, CAST(l_orderkey % 520 % 3 AS INTEGER) AS nr_zona,
         l_orderkey % 520 AS nr_local_votacao, CASE WHEN l_orderkey % 520 % 13 = 0 THEN 'ZZ' ELSE 'R1' END AS sg_uf,
         l_partkey * 10 + l_linenumber AS secao, CASE WHEN l_partkey % 3 <> 0 THEN 'Escola ' || l_partkey % 7 END AS nome,
         CASE l_partkey % 5 WHEN 0 THEN -1.0::DOUBLE WHEN 1 THEN NULL ELSE -20 - l_tax * 100 END AS lat,
         CASE l_partkey % 5 WHEN 0 THEN -1.0::DOUBLE WHEN 2 THEN 10.5::DOUBLE ELSE -50 - l_discount * 100 END AS lon,
         CAST(l_quantity AS BIGINT) AS qt, CAST(l_shipdate AS DATE) AS dt
  FROM lineitem),
limpas AS (SELECT * REPLACE (CASE WHEN ruim THEN NULL ELSE lat END AS lat, CASE WHEN ruim THEN NULL ELSE lon END AS lon) FROM (
  SELECT *, coalesce(lat = -1 AND lon = -1, false) OR (lat IS NULL) <> (lon IS NULL)
    OR coalesce(NOT (lat BETWEEN -35 AND 6 AND lon BETWEEN -75 AND -28), false) OR sg_uf = 'ZZ' AS ruim FROM secoes))
"""
SECTION_BALLOTS = """
boletim AS (
  SELECT CAST(l_orderkey % 520 % 25 AS INTEGER) AS cd_mun_ibge, CAST(l_orderkey % 520 % 3 AS INTEGER) AS nr_zona,
         l_orderkey % 520 AS nr_local, CASE WHEN l_linenumber = 7 THEN 2 ELSE 1 END AS nr_turno, 6 AS cd_cargo,
         CASE WHEN l_returnflag <> 'R' THEN l_suppkey END AS sq_candidato,
         CAST(CASE WHEN l_returnflag <> 'R' THEN 1000 + l_suppkey WHEN l_partkey % 3 = 0 THEN 95 WHEN l_partkey % 3 = 1 THEN 96 ELSE 13 END AS INTEGER) AS nr_votavel,
         CAST(l_quantity AS BIGINT) AS qt
  FROM lineitem)
"""
STEP = "0.0078125 0.03125 0.125".split()
CELLS = (
    PLACES
    + ", celulas AS (SELECT *, "
    + ", ".join(
        f"CASE WHEN lat IS NOT NULL THEN '{s}_' || CAST(floor(lat / {s}::DOUBLE) AS BIGINT) || '_' || CAST(floor(lon / {s}::DOUBLE) AS BIGINT) END AS {n}"
        for s, n in zip(STEP, ("h3", "h3_r7", "h3_r6"))
    )
    + " FROM locais)"
)
LOCAL = (
    CELLS
    + ","
    + PLACE_VOTES
    + """, soma AS (SELECT cd_mun_ibge, nr_zona, nr_local, CAST(sum(votos) AS BIGINT) AS votos FROM votos_local GROUP BY ALL),
  juntos AS (SELECT c.*, s.votos FROM celulas c JOIN soma s USING (cd_mun_ibge, nr_zona, nr_local))
"""
)


def _cells_sql(key: str) -> str:
    by = f"{key}, " if key else ""
    part = f"PARTITION BY {key}" if key else ""
    return with_sql(
        LOCAL
        + f""", ref AS (SELECT DISTINCT {by} sum(votos) OVER ({part})::DOUBLE / sum(aptos) OVER ({part}) AS r FROM juntos),
        g AS (SELECT {by} h3_r6 AS h3, CAST(sum(aptos) AS BIGINT) AS aptos, CAST(sum(votos) AS BIGINT) AS votos FROM juntos WHERE h3_r6 IS NOT NULL GROUP BY ALL)""",
        f"""SELECT {'g.' + key + ',' if key else ''} h3, aptos, votos, round(r, 6) + 0.0 AS taxa_referencia, round(1000.0 * votos / aptos::DOUBLE, 6) + 0.0 AS penetracao,
        round(aptos * r, 6) + 0.0 AS esperado, aptos * r < 20 AS n_baixo FROM g, ref {f'WHERE g.{key} = ref.{key}' if key else ''}""",
    )


GRID = LOCAL + """, grade AS (SELECT CAST(floor(lat / 0.1::DOUBLE) AS BIGINT) AS y, CAST(floor(lon / 0.1::DOUBLE) AS BIGINT) AS x,
  sum(lat * votos) / sum(votos) AS lat, sum(lon * votos) / sum(votos) AS lon, CAST(sum(votos) AS BIGINT) AS votos
  FROM juntos WHERE votos > 0 AND lat IS NOT NULL GROUP BY 1, 2)"""
LOST = """(SELECT CAST(coalesce(sum(votos) FILTER (WHERE lat IS NULL OR lon IS NULL), 0) AS BIGINT) FROM juntos)"""
LOST_PCT = """(SELECT round(100.0 * coalesce(sum(votos) FILTER (WHERE lat IS NULL OR lon IS NULL), 0)::DOUBLE / sum(votos), 2) + 0.0 FROM juntos)"""
MORAN = (
    BALLOTS
    + """, v AS (SELECT cd_mun_ibge AS id, sum(CASE WHEN flag = 'N' THEN qt ELSE 0 END)::DOUBLE / sum(qt) AS valor FROM votacao GROUP BY ALL),
  z AS (SELECT id, valor, valor - avg(valor) OVER () AS z FROM v),
  l AS (SELECT a.id, a.valor, a.z, (b.z + c.z) / 2 AS lag FROM z a JOIN z b ON b.id = (a.id + 5) % 25 JOIN z c ON c.id = (a.id + 20) % 25)
"""
)

ORACLE = {
    "coordinate_cleaning": with_sql(
        SECTIONS,
        "SELECT sg_uf, cd_mun_ibge, nr_zona, round(lat, 6) + 0.0 AS nr_latitude, round(lon, 6) + 0.0 AS nr_longitude FROM limpas",
    ),
    "suspicious_places": with_sql(
        SECTIONS,
        """SELECT DISTINCT sg_uf, cd_mun_ibge AS cd_municipio_tse, nr_zona, nr_local_votacao FROM secoes
        WHERE sg_uf <> 'ZZ' AND lat IS NOT NULL AND lon IS NOT NULL AND NOT (lat = -1 AND lon = -1)
        AND NOT (lat BETWEEN -35 AND 6 AND lon BETWEEN -75 AND -28)""",
    ),
    "place_rollup": with_sql(
        SECTIONS,
        """, n AS (SELECT cd_mun_ibge, nr_zona, nr_local_votacao, nome FROM (SELECT *, row_number() OVER (PARTITION BY cd_mun_ibge, nr_zona, nr_local_votacao ORDER BY secao, nome) AS rn
          FROM limpas WHERE nome IS NOT NULL) WHERE rn = 1),
        c AS (SELECT cd_mun_ibge, nr_zona, nr_local_votacao, lat, lon FROM (SELECT *, row_number() OVER (PARTITION BY cd_mun_ibge, nr_zona, nr_local_votacao ORDER BY secao, lat, lon) AS rn
          FROM limpas WHERE lat IS NOT NULL) WHERE rn = 1),
        s AS (SELECT cd_mun_ibge, nr_zona, nr_local_votacao, CAST(count(*) AS INTEGER) AS qt_secoes, CAST(sum(qt) AS BIGINT) AS qt_eleitor_secao, max(dt) AS dt_geracao
          FROM limpas GROUP BY ALL)
        SELECT s.*, n.nome AS nm_local_votacao, round(c.lat, 6) + 0.0 AS nr_latitude, round(c.lon, 6) + 0.0 AS nr_longitude FROM s
        LEFT JOIN n USING (cd_mun_ibge, nr_zona, nr_local_votacao) LEFT JOIN c USING (cd_mun_ibge, nr_zona, nr_local_votacao)""",
    ),
    "section_to_place_votes": with_sql(
        SECTION_BALLOTS,
        """SELECT cd_mun_ibge, nr_zona, nr_local, cd_cargo, sq_candidato, CAST(sum(qt) AS BIGINT) AS votos
        FROM boletim WHERE nr_turno = 1 AND sq_candidato IS NOT NULL GROUP BY ALL""",
    ),
    "section_to_place_totals": with_sql(
        SECTION_BALLOTS,
        """SELECT cd_mun_ibge, nr_zona, nr_local, cd_cargo, CAST(coalesce(sum(qt) FILTER (WHERE sq_candidato IS NOT NULL), 0) AS BIGINT) AS votos_nominais,
        CAST(coalesce(sum(qt) FILTER (WHERE nr_votavel = 13), 0) AS BIGINT) AS votos_legenda,
        CAST(coalesce(sum(qt) FILTER (WHERE nr_votavel = 95), 0) AS BIGINT) AS votos_brancos,
        CAST(coalesce(sum(qt) FILTER (WHERE nr_votavel = 96), 0) AS BIGINT) AS votos_nulos FROM boletim WHERE nr_turno = 1 GROUP BY ALL""",
    ),
    "assigned_cells": with_sql(CELLS, "SELECT nr_local, h3, h3_r7, h3_r6 FROM celulas"),
    "cell_aggregate": _cells_sql(""),
    "cell_aggregate_by_zone": _cells_sql("nr_zona"),
    "coverage": with_sql(
        LOCAL,
        """, g AS (SELECT cd_mun_ibge, CAST(sum(votos) AS BIGINT) AS votos, 100.0 * coalesce(sum(votos) FILTER (WHERE h3 IS NULL), 0) / sum(votos)::DOUBLE AS p FROM juntos GROUP BY ALL)
        SELECT cd_mun_ibge, votos, round(p, 6) + 0.0 AS pct_votos_sem_coordenada, p > 5 AS alerta_cobertura_h3 FROM g""",
    ),
    "coverage_by_state": with_sql(
        CELLS + "," + PLACE_VOTES,
        """SELECT v.sg_uf, CAST(sum(v.votos) AS BIGINT) AS votos, CAST(coalesce(sum(v.votos) FILTER (WHERE c.h3 IS NULL), 0) AS BIGINT) AS votos_sem_coordenada,
        CAST(coalesce(sum(v.votos) FILTER (WHERE c.nr_local IS NULL), 0) AS BIGINT) AS votos_sem_cadastro,
        round(coalesce(sum(v.votos) FILTER (WHERE c.h3 IS NULL), 0)::DOUBLE / sum(v.votos), 6) + 0.0 AS fracao_sem_coordenada
        FROM votos_local v LEFT JOIN celulas c USING (cd_mun_ibge, nr_zona, nr_local) GROUP BY ROLLUP (v.sg_uf)""",
    ),
    "place_coverage": with_sql(
        CELLS, "SELECT count(*) AS locais, count(h3) AS locais_com_h3, count(*) FILTER (WHERE h3 IS NULL) AS locais_sem_coordenada FROM celulas"
    ),
    "votes_by_cell": with_sql(
        CELLS + "," + PLACE_VOTES,
        """, s AS (SELECT cd_mun_ibge, nr_zona, nr_local, sum(votos) AS votos FROM votos_local WHERE sq_candidato IN (3, 4, 5) GROUP BY ALL)
        SELECT h3_r7 AS h3, CAST(coalesce(sum(s.votos), 0) AS BIGINT) AS votos, CAST(sum(aptos) AS BIGINT) AS aptos
        FROM celulas LEFT JOIN s USING (cd_mun_ibge, nr_zona, nr_local) WHERE h3_r7 IS NOT NULL GROUP BY h3_r7""",
    ),
    "uncovered_votes": with_sql(LOCAL, f"SELECT {LOST} AS sem_coordenada, (SELECT CAST(sum(votos) AS BIGINT) FROM juntos) AS total"),
    "grid_points": with_sql(GRID, "SELECT y, x, round(lat, 6) + 0.0 AS lat, round(lon, 6) + 0.0 AS lon, votos FROM grade"),
    "density_points": with_sql(
        LOCAL,
        f""", p AS (SELECT lat, lon, votos FROM juntos WHERE votos > 0 AND lat IS NOT NULL)
        SELECT round(lat, 6) + 0.0 AS lat, round(lon, 6) + 0.0 AS lon, votos, (SELECT count(*) FROM p) AS total, 60 < (SELECT count(*) FROM p) AS truncado,
        {LOST} AS votos_sem_coordenada, {LOST_PCT} AS pct_votos_sem_coordenada FROM p ORDER BY votos DESC, lat, lon LIMIT 50 OFFSET 10""",
    ),
    "density_grid": with_sql(
        GRID,
        f"""SELECT round(lat, 6) + 0.0 AS lat, round(lon, 6) + 0.0 AS lon, votos, (SELECT count(*) FROM grade) AS total, 40 < (SELECT count(*) FROM grade) AS truncado,
        {LOST} AS votos_sem_coordenada, {LOST_PCT} AS pct_votos_sem_coordenada FROM grade ORDER BY votos DESC, lat, lon LIMIT 40""",
    ),
    "nearest_zone": with_sql(
        PLACES,
        """, s AS (SELECT cd_mun_ibge, lat, lon, arg_max(nr_zona, (aptos, -nr_zona)) AS nr_zona FROM locais WHERE nr_local % 2 = 0 AND lat IS NOT NULL GROUP BY 1, 2, 3),
        u AS (SELECT cd_mun_ibge, CASE WHEN min(nr_zona) = max(nr_zona) THEN min(nr_zona) END AS unica FROM locais WHERE nr_local % 2 = 0 GROUP BY 1),
        p AS (SELECT nr_local AS ponto, cd_mun_ibge, lat, lon FROM locais WHERE nr_local % 2 = 1),
        m AS (SELECT ponto, arg_min(s.nr_zona, ((p.lat - s.lat) * (p.lat - s.lat) + (p.lon - s.lon) * (p.lon - s.lon), s.nr_zona)) AS z
          FROM p JOIN s ON p.cd_mun_ibge = s.cd_mun_ibge AND p.lat IS NOT NULL GROUP BY ponto)
        SELECT p.ponto, p.cd_mun_ibge, coalesce(u.unica, m.z) AS nr_zona FROM p LEFT JOIN m USING (ponto) LEFT JOIN u ON u.cd_mun_ibge = p.cd_mun_ibge""",
    ),
    "moran_local": with_sql(
        MORAN,
        """, m AS (SELECT avg(z * z) AS m2 FROM z)
        SELECT id, round(valor, 6) + 0.0 AS valor, round(z * lag / m2, 6) + 0.0 AS lisa,
        CASE WHEN z > 0 THEN 'alto' ELSE 'baixo' END || '-' || CASE WHEN lag > 0 THEN 'alto' ELSE 'baixo' END AS quadrante FROM l, m""",
    ),
    "moran_global": with_sql(MORAN, "SELECT round(sum(z * lag) / sum(z * z), 6) + 0.0 AS moran_i FROM l"),
    "moran_global_p": with_sql(
        MORAN,
        f""", lugar AS (SELECT id, z, row_number() OVER (ORDER BY md5(id::VARCHAR)) AS i FROM z),
        sorte AS (SELECT rep, z AS zp, row_number() OVER (PARTITION BY rep ORDER BY md5('{spatial.PERMUTATION_SEED}|' || rep || '|' || id)) AS i
          FROM lugar, range(1, 1000) r(rep)),
        posto AS (SELECT rep, id, zp FROM sorte JOIN lugar USING (i)),
        soma AS (SELECT a.rep, sum(a.zp * (b.zp + c.zp) / 2) AS s FROM posto a JOIN posto b ON b.rep = a.rep AND b.id = (a.id + 5) % 25
          JOIN posto c ON c.rep = a.rep AND c.id = (a.id + 20) % 25 GROUP BY ALL),
        o AS (SELECT sum(z * lag) / sum(z * z) AS i, sum(z * z) AS zz, -1.0 / (count(*) - 1) AS centro FROM l)
        SELECT round(any_value(i), 6) + 0.0 AS moran_i,
        round((count(*) FILTER (WHERE CASE WHEN i >= centro THEN s / zz >= i ELSE s / zz <= i END) + 1) / 1000.0, 6) + 0.0 AS pseudo_p FROM soma, o""",
    ),
    "moran_local_p": with_sql(
        MORAN,
        f""", lugar AS (SELECT l.id, l.valor, l.z, l.lag, row_number() OVER (ORDER BY md5(id::VARCHAR)) - 1 AS i FROM l),
        m AS (SELECT avg(z * z) AS m2, count(*) AS n FROM z),
        t AS (SELECT *, ('0x' || substr(md5('{spatial.PERMUTATION_SEED}|' || id || '|' || rep || '|' || (n - 3)), 1, 15))::BIGINT % (n - 2) AS t1,
          ('0x' || substr(md5('{spatial.PERMUTATION_SEED}|' || id || '|' || rep || '|' || (n - 2)), 1, 15))::BIGINT % (n - 1) AS t2
          FROM lugar, m, range(1, 1000) r(rep)),
        d AS (SELECT *, t1 + (t1 >= i)::INT AS a, CASE WHEN t2 = t1 THEN n - 2 ELSE t2 END + (CASE WHEN t2 = t1 THEN n - 2 ELSE t2 END >= i)::INT AS b FROM t),
        s AS (SELECT d.*, (x.z + y.z) / 2 AS lag_p FROM d JOIN lugar x ON x.i = d.a JOIN lugar y ON y.i = d.b)
        SELECT id, round(any_value(valor), 6) + 0.0 AS valor, round(any_value(z * lag / m2), 6) + 0.0 AS lisa,
        any_value(CASE WHEN z > 0 THEN 'alto' ELSE 'baixo' END || '-' || CASE WHEN lag > 0 THEN 'alto' ELSE 'baixo' END) AS quadrante,
        round((count(*) FILTER (WHERE CASE WHEN z * lag / m2 >= 0 THEN z * lag_p / m2 >= z * lag / m2 ELSE z * lag_p / m2 <= z * lag / m2 END) + 1) / 1000.0, 6) + 0.0 AS pseudo_p
        FROM s GROUP BY id""",
    ),
    "municipality_dimension": """WITH r AS (SELECT n_nationkey % 5 AS g, min(n_nationkey) AS a FROM nation WHERE n_nationkey < 12 GROUP BY 1)
        SELECT n_nationkey AS cd_mun_ibge, n_nationkey + 500 AS cd_mun_tse, 'R' || n_regionkey AS sg_uf, n_name AS nm_municipio,
        round(n_nationkey * 10.5::DOUBLE + 1, 6) + 0.0 AS area_km2, CASE WHEN n_nationkey < 12 THEN a ELSE n_nationkey END AS cd_amc
        FROM nation LEFT JOIN r ON g = n_nationkey % 5""",
}
