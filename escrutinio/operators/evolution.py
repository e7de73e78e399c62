"""Two-period comparison over comparable areas, same persons, strongholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from escrutinio.functions.checks import fail, require_columns
from escrutinio.functions.rates import penetration, per_candidacy, ratio, share_of_valid
from escrutinio.operators.statistics import spearman

COUNTS = ("aptos", "validos", "votos")
SENATE_OFFICE = 5  # fixed value: office with one seat in one year and two in the other
STRONGHOLD = 2.0  # fixed value: location quotient from which an area is a stronghold


def to_areas(
    df: DataFrame, areas: DataFrame, by: Sequence[str] = (), unit: str = "cd_mun_ibge"
) -> DataFrame:
    """AGG-13. Counts summed over the comparable area of each municipality, before any rate.

    A municipality without an area and one that is repeated in the area table raise.
    """
    require_columns(df, [*by, unit, *COUNTS], "to_areas")
    require_columns(areas, [unit, "amc"], "to_areas(areas)")
    once = areas.groupBy(unit).agg(F.first("amc").alias("amc"), F.count(F.lit(1)).alias("_rows"))
    area = (
        F.when(F.col("_rows") > 1, fail("to_areas: municipality repeated", F.col(unit)))
        .when(F.col("amc").isNull(), fail("to_areas: municipality without an area", F.col(unit)))
        .otherwise(F.col("amc"))
    )
    # Counts are summed per municipality first: the join then carries one row per unit.
    units = df.groupBy(*by, unit).agg(*[F.sum(c).alias(c) for c in COUNTS])
    return (
        units.join(once, unit, "left")
        .withColumn("amc", area)
        .groupBy(*by, "amc")
        .agg(*[F.sum(c).alias(c) for c in COUNTS])
    )


def evolution(
    old: DataFrame,
    new: DataFrame,
    areas: DataFrame,
    by: Sequence[str] = (),
    *,
    office: int,
    before: str = "2022",
    after: str = "2026",
    unit: str = "cd_mun_ibge",
) -> DataFrame:
    """TMP-07. Change of penetration and of share, retention and gain by comparable area.

    Both years are stacked with a tag and summed in one grouped pass, so the two sides never meet
    in a join. An area present in one year only has null differences.
    """
    if office == SENATE_OFFICE:
        raise ValueError("evolution: the two-seat office is not comparable between the years")
    tagged = old.select(*by, unit, *COUNTS, F.lit(before).alias("_y")).unionByName(
        new.select(*by, unit, *COUNTS, F.lit(after).alias("_y"))
    )
    summed = to_areas(tagged, areas, [*by, "_y"], unit)
    sides = summed.groupBy(*by, "amc").agg(
        *[
            F.max(F.when(F.col("_y") == y, F.col(c))).alias(f"{c}_{y}")
            for y in (before, after)
            for c in COUNTS
        ]
    )
    return add_changes(sides, before, after)


def add_changes(sides: DataFrame, before: str = "2022", after: str = "2026") -> DataFrame:
    """Rates of both years and their differences, from `<count>_<year>` columns."""
    rates = {}
    for y in (before, after):
        rates[f"penetracao_{y}"] = penetration(f"votos_{y}", f"aptos_{y}")
        rates[f"pct_validos_{y}"] = share_of_valid(f"votos_{y}", f"validos_{y}")
    return sides.withColumns(rates).withColumns(
        {
            "delta_penetracao": F.col(f"penetracao_{after}") - F.col(f"penetracao_{before}"),
            "swing_pp": F.col(f"pct_validos_{after}") - F.col(f"pct_validos_{before}"),
            "retencao": ratio(F.col(f"votos_{after}"), F.col(f"votos_{before}")),
            "ganho_absoluto": F.col(f"votos_{after}") - F.col(f"votos_{before}"),
        }
    )


def strongholds(
    df: DataFrame, unit: str = "amc", threshold: float = STRONGHOLD, before: str = "2022",
    after: str = "2026",
) -> DataFrame:
    """SET-04. The reliable areas that are strongholds in either year, one row each.

    The lists of the reference result are given as rows: a list column would gather all areas of
    the country in one task.
    """
    require_columns(df, [unit, f"lq_{before}", f"lq_{after}", "n_baixo"], "strongholds")

    def strong(y: str) -> Column:
        return F.coalesce(~F.col("n_baixo") & (F.col(f"lq_{y}") >= threshold), F.lit(False))

    flagged = df.select(
        unit, strong(before).alias(f"reduto_{before}"), strong(after).alias(f"reduto_{after}")
    )
    return flagged.filter(F.col(f"reduto_{before}") | F.col(f"reduto_{after}"))


def stronghold_overlap(
    df: DataFrame, unit: str = "amc", threshold: float = STRONGHOLD, before: str = "2022",
    after: str = "2026",
) -> DataFrame:
    """SET-04. One row: rank correlation of the quotients, sizes and Jaccard of the strongholds."""
    marked = strongholds(df, unit, threshold, before, after)
    a, b = F.col(f"reduto_{before}"), F.col(f"reduto_{after}")
    rho = spearman(df, f"lq_{before}", f"lq_{after}").select("rho")
    return marked.agg(
        F.count_if(a).alias(f"n_redutos_{before}"),
        F.count_if(b).alias(f"n_redutos_{after}"),
        ratio(F.count_if(a & b), F.count_if(a | b)).alias("jaccard"),
    ).withColumn("spearman", rho.scalar())


def per_candidate(df: DataFrame) -> DataFrame:
    """EXP-27. Votes and penetration per eligible candidacy."""
    require_columns(df, ["votos", "aptos", "n_candidatos"], "per_candidate")
    n = F.col("n_candidatos")
    return df.withColumns(
        {"votos_por_candidato": per_candidacy(F.col("votos"), n), "penetracao": penetration()}
    ).withColumn("penetracao_por_candidato", per_candidacy(F.col("penetracao"), n))


def common_people(old: DataFrame, new: DataFrame, before: str = "2022", after: str = "2026"):
    """SET-03. Persons of both years with the votes of each, one row per person."""
    sides = _people(old, new, before, after)
    return sides.filter(F.col(f"_n_{before}") + F.col(f"_n_{after}") == 2).select(
        "pessoa_id", f"votos_{before}", f"votos_{after}"
    )


def _people(old: DataFrame, new: DataFrame, before: str, after: str) -> DataFrame:
    """Both years stacked and grouped by person; a person repeated in a year raises."""
    both = old.select("pessoa_id", "votos", F.lit(before).alias("_y")).unionByName(
        new.select("pessoa_id", "votos", F.lit(after).alias("_y"))
    )
    aggregates = []
    for y in (before, after):
        here = F.col("_y") == y
        repeated = fail("same_people: person repeated in", F.lit(y))
        n = F.count_if(here)
        aggregates += [
            F.sum(F.when(here, F.col("votos"))).alias(f"votos_{y}"),
            F.when(n > 1, repeated).otherwise(n).alias(f"_n_{y}"),
        ]
    return both.filter(F.col("pessoa_id").isNotNull()).groupBy("pessoa_id").agg(*aggregates)


def same_people(old: DataFrame, new: DataFrame, before: str = "2022", after: str = "2026"):
    """SET-03. One row: size of each side, and votes and retention of the persons in both."""
    for df, y in ((old, before), (new, after)):
        require_columns(df, ["pessoa_id", "votos"], f"same_people({y})")
    both = (F.col(f"_n_{before}") == 1) & (F.col(f"_n_{after}") == 1)
    return (
        _people(old, new, before, after)
        .agg(
            F.count_if(both).alias("n_comuns"),
            F.coalesce(F.sum(f"_n_{before}"), F.lit(0)).cast("bigint").alias(f"n_{before}"),
            F.coalesce(F.sum(f"_n_{after}"), F.lit(0)).cast("bigint").alias(f"n_{after}"),
            *[
                F.coalesce(F.sum(F.when(both, F.col(f"votos_{y}"))), F.lit(0)).cast("bigint").alias(f"votos_{y}")
                for y in (before, after)
            ],
        )
        .withColumn("retencao", ratio(F.col(f"votos_{after}"), F.col(f"votos_{before}")))
    )
