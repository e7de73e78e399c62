"""Polling places: roll-up of sections, coordinates, grid cells, coverage, nearest zone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from escrutinio.functions.checks import checked, fail, require_columns
from escrutinio.functions.rates import ratio
from escrutinio.operators.reconcile import ABROAD, BLANK_VOTE, NULL_VOTE
from escrutinio.operators.totals import sum_where

# Box of valid coordinates, placeholder of a missing pair, grid of the national map.
LATITUDE_BOX = (-35.0, 6.0)
LONGITUDE_BOX = (-75.0, -28.0)
MISSING_COORDINATE = -1.0
NATIONAL_GRID_DEGREES = 0.1
CELL_STEPS = (0.0078125, 0.03125, 0.125)  # degrees of the nested cells, fine to coarse

PLACE_KEY = ("cd_mun_ibge", "nr_zona", "nr_local")


def bad_coordinate(lat: Column, lon: Column, state: Column | None = None) -> Column:
    """EXP-17. True for the placeholder pair, half a pair, abroad, or a point outside the box."""
    absent = (lat == MISSING_COORDINATE) & (lon == MISSING_COORDINATE)
    half = lat.isNull() != lon.isNull()
    outside = ~(lat.between(*LATITUDE_BOX) & lon.between(*LONGITUDE_BOX))
    bad = F.coalesce(absent, F.lit(False)) | half | F.coalesce(outside, F.lit(False))
    return bad if state is None else bad | F.coalesce(state == ABROAD, F.lit(False))


def clean_coordinates(
    df: DataFrame, lat: str = "nr_latitude", lon: str = "nr_longitude", state: str | None = "sg_uf"
) -> DataFrame:
    """EXP-17. Both coordinates null when the pair is not valid; never half a pair."""
    bad = bad_coordinate(F.col(lat), F.col(lon), F.col(state) if state else None)
    return df.withColumns({c: F.when(~bad, F.col(c)) for c in (lat, lon)})


def suspicious_places(df: DataFrame) -> DataFrame:
    """EXP-17. Places at home whose complete pair falls outside the box (reported)."""
    lat, lon = F.col("nr_latitude"), F.col("nr_longitude")
    missing = (lat == MISSING_COORDINATE) & (lon == MISSING_COORDINATE)
    inside = lat.between(*LATITUDE_BOX) & lon.between(*LONGITUDE_BOX)
    return (
        df.filter((F.col("sg_uf") != ABROAD) & lat.isNotNull() & lon.isNotNull() & ~missing & ~inside)
        .select("sg_uf", "cd_municipio_tse", "nr_zona", "nr_local_votacao")
        .distinct()
    )


def _first_by(order: Column, value: Column) -> Column:
    """Value of the smallest `order` among rows where it is present; ties by the value."""
    return F.min(F.when(value.isNotNull(), F.struct(order.alias("o"), value.alias("v"))))["v"]


def roll_up_places(sections: DataFrame, keys: Sequence[str]) -> DataFrame:
    """AGG-08. One row per place: first label by section, one coherent coordinate pair, sums.

    Everything is a mergeable aggregate (minimum of a struct), so sections are never sorted.
    """
    order = F.coalesce(F.col("nr_secao").try_cast("bigint"), F.lit(2**62))
    pair = F.when(
        F.col("nr_latitude").isNotNull() & F.col("nr_longitude").isNotNull(),
        F.struct(F.col("nr_latitude").alias("lat"), F.col("nr_longitude").alias("lon")),
    )
    labels = [c for c in ("nm_local_votacao", "ds_endereco", "nm_bairro") if c in sections.columns]
    extra = [F.max("dt_geracao").alias("dt_geracao")] if "dt_geracao" in sections.columns else []
    return (
        sections.groupBy(*keys)
        .agg(
            *[_first_by(order, F.col(c)).alias(c) for c in labels],
            _first_by(order, pair).alias("_p"),
            F.count(F.lit(1)).cast("int").alias("qt_secoes"),
            F.sum("qt_eleitor_secao").alias("qt_eleitor_secao"),
            *extra,
        )
        .withColumns({"nr_latitude": F.col("_p.lat"), "nr_longitude": F.col("_p.lon")})
        .drop("_p")
    )


def place_votes(ballots: DataFrame, keys: Sequence[str]) -> DataFrame:
    """AGG-10. First-round nominal votes per place, office and candidate."""
    return (
        ballots.filter((F.col("nr_turno") == 1) & F.col("sq_candidato").isNotNull())
        .groupBy(*keys, "cd_cargo", "sq_candidato")
        .agg(F.sum("qt_votos").alias("votos"))
    )


def place_totals(ballots: DataFrame, keys: Sequence[str]) -> DataFrame:
    """AGG-10. First-round nominal, party-list, blank and null votes per place and office."""
    nobody = F.col("sq_candidato").isNull()
    code, votes = F.col("nr_votavel"), F.col("qt_votos")
    return (
        ballots.filter(F.col("nr_turno") == 1)
        .groupBy(*keys, "cd_cargo")
        .agg(
            sum_where(votes, ~nobody).alias("votos_nominais"),
            sum_where(votes, nobody & ~code.isin(BLANK_VOTE, NULL_VOTE)).alias("votos_legenda"),
            sum_where(votes, nobody & (code == BLANK_VOTE)).alias("votos_brancos"),
            sum_where(votes, nobody & (code == NULL_VOTE)).alias("votos_nulos"),
        )
    )


def cell_id(lat: Column, lon: Column, step: float) -> Column:
    """AGG-20. Id of the square cell of a point; null without a complete pair."""
    y, x = F.floor(lat / F.lit(step)), F.floor(lon / F.lit(step))
    return F.when(
        lat.isNotNull() & lon.isNotNull(),
        F.concat_ws("_", F.lit(f"{step:g}"), y.cast("string"), x.cast("string")),
    )


def assign_cells(
    places: DataFrame, lat: str = "lat", lon: str = "lon", steps: Sequence[float] = CELL_STEPS,
    names: Sequence[str] = ("h3", "h3_r7", "h3_r6"),
) -> DataFrame:
    """AGG-20. Cells at three nested resolutions: each step divides the next, so a fine cell lies
    in one coarse cell."""
    return places.withColumns(
        {name: cell_id(F.col(lat), F.col(lon), step) for name, step in zip(names, steps, strict=True)}
    )


def votes_by_cell(
    places: DataFrame, votes: DataFrame, cell: str = "h3", key: Sequence[str] = PLACE_KEY
) -> DataFrame:
    """AGG-15. Votes and electors per cell; electors count every place of the cell.

    Votes are summed per place before the join, so it carries one row per place.
    """
    summed = votes.groupBy(*key).agg(F.sum("votos").alias("votos"))
    return (
        places.filter(F.col(cell).isNotNull())
        .join(summed, list(key), "left")
        .groupBy(F.col(cell).alias("h3"))
        .agg(
            F.coalesce(F.sum("votos"), F.lit(0).cast("bigint")).alias("votos"),
            F.sum("aptos").alias("aptos"),
        )
    )


def coverage_by_state(
    votes: DataFrame, places: DataFrame, cell: str = "h3", key: Sequence[str] = PLACE_KEY
) -> DataFrame:
    """AGG-17. Votes by state and in total (`sg_uf` null): all, without a cell, without a place.

    One join against the distinct places and one rollup, instead of a second pass for the total.
    """
    known = places.groupBy(*key).agg(F.max(F.col(cell).isNotNull()).alias("_com"))
    return (
        votes.groupBy("sg_uf", *key)
        .agg(F.sum("votos").alias("votos"))
        .join(known, list(key), "left")
        .rollup("sg_uf")
        .agg(
            F.sum("votos").alias("votos"),
            sum_where(F.col("votos"), ~F.coalesce("_com", F.lit(False))).alias("votos_sem_coordenada"),
            sum_where(F.col("votos"), F.col("_com").isNull()).alias("votos_sem_cadastro"),
        )
        .withColumn("fracao_sem_coordenada", ratio(F.col("votos_sem_coordenada"), F.col("votos")))
    )


def place_coverage(places: DataFrame, cell: str = "h3") -> DataFrame:
    """AGG-17. One row: places, with a cell, without coordinates."""
    return places.agg(
        F.count(F.lit(1)).alias("locais"),
        F.count(cell).alias("locais_com_h3"),
        F.count_if(F.col(cell).isNull()).alias("locais_sem_coordenada"),
    )


def votes_at_places(
    votes: DataFrame, places: DataFrame, key: Sequence[str] = PLACE_KEY
) -> DataFrame:
    """JOI-08. Votes of a set of entities summed per place and joined to the place."""
    summed = votes.groupBy(*key).agg(F.sum("votos").alias("votos"))
    return summed.join(places, list(key))


def uncovered_votes(
    votes: DataFrame, places: DataFrame, by_cell: bool = False, key: Sequence[str] = PLACE_KEY
) -> DataFrame:
    """AGG-18. One row: votes in places that cannot be drawn, and all votes."""
    missing = F.col("h3").isNull() if by_cell else F.col("lat").isNull() | F.col("lon").isNull()
    return votes_at_places(votes, places, key).agg(
        sum_where(F.col("votos"), missing).alias("sem_coordenada"),
        F.coalesce(F.sum("votos"), F.lit(0).cast("bigint")).alias("total"),
    )


def grid_points(places_with_votes: DataFrame, step: float = NATIONAL_GRID_DEGREES) -> DataFrame:
    """AGG-19. Votes per square of the lat/lon grid, at their vote-weighted centre."""
    v = F.col("votos")
    return (
        places_with_votes.filter((v > 0) & F.col("lat").isNotNull() & F.col("lon").isNotNull())
        .groupBy(F.floor(F.col("lat") / F.lit(step)).alias("y"), F.floor(F.col("lon") / F.lit(step)).alias("x"))
        .agg(
            (F.sum(F.col("lat") * v) / F.sum(v)).alias("lat"),
            (F.sum(F.col("lon") * v) / F.sum(v)).alias("lon"),
            F.sum(v).alias("votos"),
        )
    )


# --- nearest place --------------------------------------------------------------------------------

FINEST_STEP = 0.01
LEVELS = 14  # the last step is above 80 degrees, more than the box


def _cells(lat: Column, lon: Column, level: Column) -> tuple[Column, Column]:
    step = F.lit(FINEST_STEP) * F.pow(F.lit(2.0), level)
    return F.floor(lat / step), F.floor(lon / step)


def nearest_zone(
    points: DataFrame, sites: DataFrame, unit: str = "cd_mun_ibge", point_id: str = "ponto"
) -> DataFrame:
    """JOI-12. Zone of the nearest polling place of the municipality, for each point. Exact.

    Points and sites meet only through grid cells of one municipality. First each point finds the
    finest level whose own cell holds a site: the nearest site is then within that cell's diagonal,
    hence inside the 3 by 3 block of the next level. Second, it is compared with the sites of that
    block only. Coincident sites keep the zone with most electors. A municipality with a single
    zone takes it even when no site has coordinates.
    """
    require_columns(points, [point_id, unit, "lat", "lon"], "nearest_zone(points)")
    require_columns(sites, [unit, "nr_zona", "lat", "lon", "eleitores"], "nearest_zone(sites)")
    only = sites.groupBy(unit).agg(
        F.when(F.min("nr_zona") == F.max("nr_zona"), F.min("nr_zona")).alias("_unica")
    )
    located = (
        sites.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
        .groupBy(unit, "lat", "lon")
        .agg(F.max_by("nr_zona", F.struct("eleitores", -F.col("nr_zona"))).alias("nr_zona"))
    )
    levels = F.explode(F.sequence(F.lit(0), F.lit(LEVELS)))
    spread = located.withColumnsRenamed({"lat": "_slat", "lon": "_slon"}).withColumn("_l", levels)
    sy, sx = _cells(F.col("_slat"), F.col("_slon"), F.col("_l"))
    spread = spread.withColumns({"_y": sy, "_x": sx})
    held = spread.select(unit, "_l", "_y", "_x").distinct()
    inside = points.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(
        point_id, unit, "lat", "lon"
    )
    py, px = _cells(F.col("lat"), F.col("lon"), F.col("_l"))
    found = (
        inside.withColumn("_l", levels)
        .withColumns({"_y": py, "_x": px})
        .join(held, [unit, "_l", "_y", "_x"])
        .groupBy(point_id, unit, "lat", "lon")
        .agg(F.least(F.min("_l") + 1, F.lit(LEVELS)).alias("_l"))
    )
    around = F.explode(
        F.array(*[F.struct(F.lit(i).alias("dy"), F.lit(j).alias("dx")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    )
    block = (
        found.withColumns({"_y": py, "_x": px})
        .withColumn("_d", around)
        .withColumns({"_y": F.col("_y") + F.col("_d.dy"), "_x": F.col("_x") + F.col("_d.dx")})
        .drop("_d")
    )
    dy, dx = F.col("lat") - F.col("_slat"), F.col("lon") - F.col("_slon")
    closest = (
        block.join(spread, [unit, "_l", "_y", "_x"])
        .groupBy(point_id)
        .agg(F.min(F.struct((dy * dy + dx * dx).alias("d"), F.col("nr_zona").alias("z"))).alias("_m"))
    )
    return (
        points.join(closest, point_id, "left")
        .join(only, unit, "left")
        .select(*points.columns, F.coalesce(F.col("_unica"), F.col("_m.z")).alias("nr_zona"))
    )


# --- municipality dimension -----------------------------------------------------------------------

LAGOON_CODES = (4300000, 4300009)  # fixed value: pseudo-codes of lagoons in the area table


def clean_areas(raw: DataFrame) -> DataFrame:
    """SRC-12. Area table without footer rows and lagoon codes; the area column is found by prefix."""
    area = next((c for c in raw.columns if c.startswith("AR_MUN_")), None)
    if area is None:
        raise ValueError("clean_areas: no AR_MUN_* column")
    code = F.col("CD_MUN").cast("int")
    return raw.filter(F.col("CD_MUN").isNotNull() & ~code.between(*LAGOON_CODES)).select(
        code.alias("cd_mun_ibge"), F.col(area).cast("double").alias("area_km2")
    )


def comparable_areas(codes: DataFrame, merges: DataFrame) -> DataFrame:
    """JOI-13. Comparable area of each municipality: the smallest code of its merged set.

    `merges` has one row per (set, municipality); a code it names that is not known raises.
    """
    known = codes.select("cd_mun_ibge").distinct().withColumn("_k", F.lit(True))
    named = (
        merges.join(known, "cd_mun_ibge", "left")
        .withColumn(
            "cd_mun_ibge",
            checked(
                F.col("cd_mun_ibge"), F.col("_k").isNotNull(),
                "comparable_areas: unknown municipality", F.col("cd_mun_ibge"),
            ),
        )
        .drop("_k")
    )
    roots = named.groupBy("conjunto").agg(F.min("cd_mun_ibge").alias("cd_amc"))
    mapped = named.join(roots, "conjunto").groupBy("cd_mun_ibge").agg(F.min("cd_amc").alias("cd_amc"))
    return codes.select("cd_mun_ibge").distinct().join(mapped, "cd_mun_ibge", "left").select(
        "cd_mun_ibge", F.coalesce("cd_amc", "cd_mun_ibge").alias("cd_amc")
    )


def build_municipalities(crosswalk: DataFrame, areas: DataFrame, merges: DataFrame) -> DataFrame:
    """JOI-13. Municipality dimension; a municipality without an official area raises."""
    missing = fail("build_municipalities: no official area for", F.col("cd_mun_ibge"))
    return (
        crosswalk.join(areas, "cd_mun_ibge", "left")
        .join(comparable_areas(crosswalk, merges), "cd_mun_ibge")
        .select(
            "cd_mun_ibge",
            F.col("cd_municipio_tse").alias("cd_mun_tse"),
            "sg_uf",
            F.col("nm_municipio_ibge").alias("nm_municipio"),
            F.when(F.col("area_km2").isNull(), missing).otherwise(F.col("area_km2")).alias("area_km2"),
            "cd_amc",
        )
    )
