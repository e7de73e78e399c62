"""Two-side comparison between years, and the person list behind it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from escrutinio.functions.rates import penetration, share_of_valid
from escrutinio.operators.evolution import COUNTS, add_changes, common_people, evolution
from escrutinio.operators.finance import REVENUE_CATEGORIES, compare_revenue
from escrutinio.operators.people import people_pairs
from escrutinio.operators.spatial import assign_class
from escrutinio.plans.maps import map_breaks
from escrutinio.session import cut_lineage

MONEY = ("receita_total", "receita_por_voto", "receita_por_mil_aptos", "media", "mediana")
SHARES = ("pct_publico", "pct_autofinanciamento", "pct_pessoa_fisica", "pct_estimavel")


def side_frame(votes: DataFrame, base: DataFrame, members: DataFrame) -> DataFrame:
    """Every municipality of the base with the votes of the members, zero where there are none.

    Votes and base are stacked and grouped; a municipality with votes only is not in the base and
    stays out, as does abroad.
    """
    mine = votes.filter(F.col("cd_mun_ibge").isNotNull()).join(
        members.select("sq_candidato").distinct(), "sq_candidato", "left_semi"
    )
    zero = F.lit(0).cast("bigint")
    stacked = mine.select(
        "cd_mun_ibge", zero.alias("aptos"), zero.alias("validos"), "votos", F.lit(0).alias("_base")
    ).unionByName(
        base.filter(F.col("cd_mun_ibge").isNotNull()).select(
            "cd_mun_ibge", "aptos", "validos", zero.alias("votos"), F.lit(1).alias("_base")
        )
    )
    return (
        stacked.groupBy("cd_mun_ibge")
        .agg(*[F.sum(c).alias(c) for c in COUNTS], F.max("_base").alias("_base"))
        .filter(F.col("_base") == 1)
        .drop("_base")
    )


def restrict_to_common(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """QRY-08, same-persons option: both sides cut to the persons that are on both."""
    people = common_people(
        old.select("pessoa_id", F.lit(0).cast("bigint").alias("votos")).distinct(),
        new.select("pessoa_id", F.lit(0).cast("bigint").alias("votos")).distinct(),
    ).select("pessoa_id")
    return old.join(people, "pessoa_id", "left_semi"), new.join(people, "pessoa_id", "left_semi")


def compare_sides(old: DataFrame, new: DataFrame, areas: DataFrame, office: int) -> DataFrame:
    """QRY-08. Evolution by comparable area (`nivel` = `amc`) and of the whole scope (`total`).

    Both levels are grouping sets over the counts of the areas: the inputs are read once, and the
    whole scope has the rates of the summed counts.
    """
    by_area = evolution(old, new, areas, office=office)
    counts = [f"{c}_{y}" for y in ("2022", "2026") for c in COUNTS]
    levels = by_area.select("amc", *counts).groupingSets([["amc"], []], "amc").agg(
        *[F.sum(c).alias(c) for c in counts], F.grouping("amc").alias("_all")
    )
    level = F.when(F.col("_all") == 1, "total").otherwise("amc")
    return add_changes(levels).withColumn("nivel", level).drop("_all")


def compare_breaks(old: DataFrame, new: DataFrame, classes: int = 5) -> DataFrame:
    """QRY-08. Class breaks shared by the maps of both sides."""
    def rates(side: DataFrame) -> DataFrame:
        return side.withColumns({"penetracao": penetration(), "pct_validos": share_of_valid()})

    return map_breaks([rates(old), rates(new)], classes=classes)


def two_sides(
    members: tuple[DataFrame, DataFrame], votes: tuple[DataFrame, DataFrame], base: tuple[DataFrame, DataFrame],
    areas: DataFrame, office: int, same_people: bool = False, classes: int | None = 5,
) -> DataFrame:
    """QRY-08. The whole comparison of two sides: by area and in total, with common map classes.

    `members` are the candidacies of each side, however they were chosen (group, persons or ids); with
    `same_people` both are cut to the persons on both sides first. `quebras` holds the breaks common
    to both maps and `classe_2022`, `classe_2026` the class of each rate; `classes=None` leaves them out.
    The sides, a row per municipality, are written once: areas, total and breaks read them.
    """
    old, new = restrict_to_common(*members) if same_people else members
    sides = [cut_lineage(side_frame(v, b, m)) for v, b, m in zip(votes, base, (old, new), strict=True)]
    rows = compare_sides(*sides, areas, office)
    if classes is None:
        return rows
    breaks = compare_breaks(*sides, classes).agg(F.array_sort(F.collect_list("quebra")).alias("b")).scalar()
    return rows.withColumn("quebras", breaks).withColumns(
        {f"classe_{y}": assign_class(F.col(f"penetracao_{y}"), F.col("quebras")) for y in ("2022", "2026")}
    )


def compare_accounts(
    old: DataFrame, new: DataFrame, prices: DataFrame, origin: str, base: str
) -> DataFrame:
    """QRY-08, TMP-06. Revenue of two one-row group accounts, the old side nominal.

    Long form: `indicador`, `tipo`, `de_nominal`, `de`, `para`, `delta`, `var_pct`.
    """
    money = [*MONEY, *[f"receita_{c}" for c in REVENUE_CATEGORIES]]
    names = [*money, *SHARES]
    left = old.select(*[F.col(c).alias(f"{c}_2022") for c in names])
    row = new.select(F.struct(*[F.col(c).alias(f"{c}_2026") for c in names]).alias("x")).scalar()
    both = left.withColumn("_x", row).select(*left.columns, "_x.*")
    nominal = both.withColumns({f"_nominal_{c}": F.col(f"{c}_2022") for c in names})
    wide = compare_revenue(nominal, money, SHARES, prices, origin, base)
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("indicador"),
                F.lit("monetario" if c in money else "percentual").alias("tipo"),
                F.col(f"_nominal_{c}").alias("de_nominal"),
                F.col(f"{c}_2022").alias("de"),
                F.col(f"{c}_2026").alias("para"),
                F.col(f"delta_{c}").alias("delta"),
                (F.col(f"var_pct_{c}") if c in money else F.lit(None).cast("double")).alias("var_pct"),
            )
            for c in names
        ]
    )
    return wide.select(F.inline(rows))


def people_in_both(
    candidates: DataFrame, votes: DataFrame, year_from: int, year_to: int, limit: int,
    term: str | None = None, state: str | None = None, office: str | None = None,
    always: DataFrame | None = None, two_seat_office: str = "SENADOR",
) -> DataFrame:
    """QRY-10. One page of persons with both candidacies and their votes, plus requested persons.

    `total` is the number of matches of the whole list.
    """
    pairs = people_pairs(candidates, year_from, year_to, term, state, office)
    totals = votes.groupBy("ano", "sq_candidato").agg(F.sum("votos").alias("votos"))

    def with_votes(df: DataFrame) -> DataFrame:
        for side in ("de", "para"):
            names = {"ano": f"ano_{side}", "sq_candidato": f"sq_candidato_{side}", "votos": f"votos_{side}"}
            df = df.join(totals.withColumnsRenamed(names), [f"ano_{side}", f"sq_candidato_{side}"], "left")
            df = df.withColumn(f"votos_{side}", F.coalesce(f"votos_{side}", F.lit(0).cast("bigint")))
        return df

    rows = with_votes(pairs)
    tail = [F.asc("nm_urna_para"), F.asc("sq_candidato_para"), F.asc("sq_candidato_de")]
    order = [F.asc("nivel"), F.desc("votos_para"), *tail] if term else tail
    page = rows.orderBy(*order).limit(limit)
    if term:
        page = page.drop("nivel")
    if always is not None:
        page = page.unionByName(with_votes(people_pairs(candidates, year_from, year_to, only=always))).distinct()
    same = F.col("ds_cargo_de") == F.col("ds_cargo_para")
    return page.withColumns(
        {
            "mesmo_cargo": same,
            "comparavel": same & (F.col("ds_cargo_para") != two_seat_office),
            "total": pairs.agg(F.count(F.lit(1)).alias("n")).scalar(),
        }
    )


def revenue_lines(comparison: DataFrame, order: Sequence[str] = (*MONEY, *SHARES)) -> DataFrame:
    """QRY-18. Comparison rows in display order: money first, then shares."""
    rank = F.when(F.col("tipo") == "monetario", 0).otherwise(1)
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("indicador"))
    return comparison.withColumn("ordem", rank * 1000 + F.when(place > 0, place).otherwise(500))
