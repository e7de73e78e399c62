"""Map values with class breaks, and density points."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from escrutinio.functions.rates import penetration, ratio, share_of_valid
from escrutinio.operators.places import NATIONAL_GRID_DEGREES, grid_points, uncovered_votes, votes_at_places
from escrutinio.operators.spatial import class_breaks, low_count
from escrutinio.session import cut_lineage

MAP_CLASSES = 5  # fixed value: quintiles


def map_values(
    votes: DataFrame, base: DataFrame, unit: Sequence[str] = ("cd_mun_ibge",), by: Sequence[str] = ()
) -> DataFrame:
    """QRY-05. Votes, base and rates by territory.

    Electors without votes give zero; votes without electors give null rates, they do not vanish.
    Votes and base are stacked and grouped once, so a territory on one side only needs no outer
    join. Rows without a territory (abroad) are left out and counted by `votes_off_map`.
    """
    keys = [*by, *unit]
    zero = F.lit(0).cast("bigint")
    stacked = votes.select(
        *keys, F.col("votos").cast("bigint").alias("votos"), zero.alias("aptos"), zero.alias("validos")
    ).unionByName(
        base.select(*keys, zero.alias("votos"), F.col("aptos").cast("bigint").alias("aptos"),
                    F.col("validos").cast("bigint").alias("validos"))
    )
    return (
        stacked.filter(F.col(unit[0]).isNotNull())
        .groupBy(*keys)
        .agg(*[F.sum(c).alias(c) for c in ("votos", "aptos", "validos")])
        .withColumns({"penetracao": penetration(), "pct_validos": share_of_valid()})
    )


def votes_off_map(votes: DataFrame, unit: str = "cd_mun_ibge") -> DataFrame:
    """QRY-05. Votes without a territory on the map."""
    return votes.filter(F.col(unit).isNull()).agg(
        F.coalesce(F.sum("votos"), F.lit(0).cast("bigint")).alias("votos_fora_do_mapa")
    )


def scale_rows(maps: Sequence[DataFrame], indicator: str = "penetracao") -> DataFrame:
    """Rows for the class breaks: the rate and the low-count flag against the rate of its own map.

    The maps are stacked and written once, a row per territory, since rates and rows both read them.
    """
    tagged = [
        m.select(F.lit(i).alias("_mapa"), "votos", "aptos", F.col(indicator).alias("valor")) for i, m in enumerate(maps)
    ]
    stacked = cut_lineage(reduce(DataFrame.unionByName, tagged))
    rates = stacked.groupBy("_mapa").agg(ratio(F.sum("votos"), F.sum("aptos")).alias("r"))
    # One entry per map: as many as the caller passed.
    by_map = rates.agg(F.map_from_entries(F.collect_list(F.struct("_mapa", "r"))).alias("m")).scalar()
    return (
        low_count(stacked.withColumn("_m", by_map).withColumn("taxa_referencia", F.try_element_at("_m", F.col("_mapa"))))
        .select("valor", "n_baixo")
    )


def map_breaks(maps: Sequence[DataFrame], indicator: str = "penetracao", classes: int = MAP_CLASSES) -> DataFrame:
    """QRY-05. Class breaks common to the maps received (one year, or both sides of a comparison)."""
    return class_breaks(scale_rows(maps, indicator), classes)


def density_points(
    votes: DataFrame, places: DataFrame, limit: int, offset: int = 0, national: bool = False
) -> DataFrame:
    """QRY-06. Places with votes, or grid squares of the country, most voted first, one page.

    The page carries the number of points, the votes without coordinates and their share.
    """
    located = votes_at_places(votes, places)
    points = (
        grid_points(located, NATIONAL_GRID_DEGREES).select("lat", "lon", "votos")
        if national
        else located.filter(
            (F.col("votos") > 0) & F.col("lat").isNotNull() & F.col("lon").isNotNull()
        ).select("lat", "lon", "votos")
    )
    total = points.agg(F.count(F.lit(1)).alias("n")).scalar()
    lost = uncovered_votes(votes, places)
    share = lost.select(
        F.struct(
            "sem_coordenada",
            F.round(F.lit(100.0) * F.coalesce(ratio(F.col("sem_coordenada"), F.col("total")), F.lit(0.0)), 2).alias("pct"),
        ).alias("s")
    )
    ordered = points.orderBy(F.desc("votos"), "lat", "lon")
    page = (ordered.offset(offset) if offset else ordered).limit(limit)
    return page.withColumn("_s", share.scalar()).select(
        "lat", "lon", "votos", total.alias("total"),
        (F.lit(offset + limit) < total).alias("truncado"),
        F.col("_s.sem_coordenada").alias("votos_sem_coordenada"),
        F.col("_s.pct").alias("pct_votos_sem_coordenada"),
    )
