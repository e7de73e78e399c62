"""Location quotient, concentration, typology, smoothing, spatial autocorrelation, classes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from escrutinio.functions.checks import checked, fail, require_columns
from escrutinio.functions.rates import expected_events, is_low_count, penetration, ratio
from escrutinio.operators.ordering import column_quantiles, dense_index, exact_quantiles, wide_quantile
from escrutinio.operators.totals import sum_where, with_totals
from escrutinio.session import cut_lineage

LARGEST_UNITS = 10  # fixed value: units summed in the share of the largest
PERMUTATION_SEED = 20261004  # fixed value
COVERAGE_ALERT_PCT = 5.0  # fixed value: share of votes without a cell that raises an alert


def location_quotient(table: DataFrame, entity: str = "sq_candidato") -> DataFrame:
    """WIN-02. `(v_ci / V_c) / (v_i / V)` from cross products; undefined where a total is zero."""
    require_columns(table, [entity, "votos", "validos"], "location_quotient")
    return (
        with_totals(table, [entity], _vc=F.sum("votos"), _vt=F.sum("validos"))
        .withColumn(
            "lq",
            ratio(
                F.col("votos").cast("double") * F.col("_vt"),
                F.col("_vc").cast("double") * F.col("validos"),
            ),
        )
        .drop("_vc", "_vt")
    )


def low_count(
    df: DataFrame, electors: str = "aptos", rate: str = "taxa_referencia", threshold: float = 20.0
) -> DataFrame:
    """EXP-07 over a table: expected events and the flag."""
    expected = expected_events(F.col(electors), F.col(rate))
    return df.withColumns({"esperado": expected, "n_baixo": is_low_count(expected, threshold)})


def concentration(
    table: DataFrame,
    entity: str | Sequence[str] = "sq_candidato",
    electorate: DataFrame | None = None,
) -> DataFrame:
    """AGG-11. HHI between units, effective number, dominance and the G index, in one aggregate.

    The sums of squares are expanded (`Σ(s-x)² = Σs² - 2Σsx + Σx²`), so nothing is joined back to
    the rows and map-side combine does most of the work. Counts are whole numbers, so their squares
    are summed exactly and the difference is taken before anything is rounded: nearly equal shares
    lose no digits. With `electorate` the table may leave out the zero rows: the `Σx²` part then
    comes from the electorate, once for all entities.
    """
    keys = [entity] if isinstance(entity, str) else list(entity)
    require_columns(table, [*keys, "votos", "aptos", "validos"], "concentration")
    kinds = dict(table.dtypes)
    whole = all(kinds[c] in ("tinyint", "smallint", "int", "bigint") for c in ("votos", "aptos"))
    v, a = F.col("votos"), F.col("aptos")
    squares = _exact_sums if whole else _double_sums
    share = v.cast("double") * F.coalesce(ratio(v, F.col("validos")), F.lit(0.0))
    sums = table.groupBy(*keys).agg(
        F.sum("votos").alias("votos"), F.sum(share).alias("_vf"), F.sum(a).alias("_a"),
        *squares(_vv=(v, v), _va=(v, a), _aa=(a, a)),
    )
    if electorate is not None:
        names = ["_a", "_aa"] + (["_aa_low"] if whole else [])
        total = electorate.agg(F.sum(a).alias("_a"), *squares(_aa=(a, a)))
        sums = sums.drop(*names).withColumn("_t", total.select(F.struct(*names).alias("t")).scalar())
        sums = sums.select(*sums.columns, "_t.*").drop("_t")
    total = F.col("votos").cast("double")
    vv, va, aa = (_double_of(c, whole) for c in ("_vv", "_va", "_aa"))
    hhi = ratio(vv, total * total)
    spread = hhi - 2 * ratio(va, total * F.col("_a")) + ratio(aa, F.col("_a") * F.col("_a").cast("double"))
    if whole:
        spread = F.coalesce(_exact_spread(), spread)
    return sums.select(
        *keys,
        "votos",
        hhi.alias("hhi"),
        ratio(F.lit(1.0), hhi).alias("n_efetivo_municipios"),
        ratio(F.col("_vf"), total).alias("dominancia_ames"),
        F.greatest(spread, F.when(spread.isNotNull(), F.lit(0.0))).alias("indice_g"),
    )


def _double_sums(**products: tuple[Column, Column]) -> list[Column]:
    return [F.sum(x.cast("double") * y.cast("double")).alias(name) for name, (x, y) in products.items()]


def _exact_sums(**products: tuple[Column, Column]) -> list[Column]:
    """Sums of products of counts as two whole numbers each: the upper bits and, as `<name>_low`, the lower 32."""
    out = []
    for name, (x, y) in products.items():
        p = x.cast("bigint") * y.cast("bigint")
        out += [F.sum(F.shiftright(p, 32)).alias(name), F.sum(p.bitwiseAND(F.lit((1 << 32) - 1))).alias(f"{name}_low")]
    return out


def _decimal_of(name: str) -> Column:
    return F.expr(f"cast({name} as decimal(20,0)) * cast(4294967296 as decimal(10,0)) + cast({name}_low as decimal(20,0))")


def _double_of(name: str, whole: bool) -> Column:
    return _decimal_of(name).cast("double") if whole else F.col(name)


def _exact_spread() -> Column:
    """`(A²Σv² - 2VAΣva + V²Σa²) / (VA)²` in whole numbers; null where they pass 38 digits or a total is zero."""

    def times(x: str, y: str, sums: str) -> str:
        pair = f"try_multiply(cast({x} as decimal(38,0)), cast({y} as decimal(38,0)))"
        wide = f"cast(cast({sums} as decimal(20,0)) * cast(4294967296 as decimal(10,0)) + cast({sums}_low as decimal(20,0)) as decimal(38,0))"
        return f"try_multiply({pair}, {wide})"

    both = f"try_add({times('_a', '_a', '_vv')}, {times('votos', 'votos', '_aa')})"
    cross = f"try_multiply(cast(2 as decimal(38,0)), {times('votos', '_a', '_va')})"
    top = F.expr(f"cast(try_subtract({both}, {cross}) as double)")
    under = F.col("votos").cast("double") * F.col("_a").cast("double")
    return top / F.nullif(under * under, F.lit(0.0))


def largest_units_share(
    table: DataFrame,
    entity: str | Sequence[str] = "sq_candidato",
    k: int = LARGEST_UNITS,
    unit: str = "cd_mun_ibge",
) -> DataFrame:
    """AGG-12. Share of the votes in the k largest units, and the number of units with votes.

    An entity has one row per unit, so its window is no longer than the list of units; sum, count
    and the k largest come out of the same sorted pass.
    """
    keys = [entity] if isinstance(entity, str) else list(entity)
    if k < 1:
        raise ValueError(f"largest_units_share: k must be at least 1, got {k}")
    require_columns(table, [*keys, unit, "votos"], "largest_units_share")
    repeated = fail("largest_units_share: repeated key", *[F.col(c) for c in (*keys, unit)])
    once = (
        table.groupBy(*keys, unit)
        .agg(F.sum("votos").alias("votos"), F.count(F.lit(1)).alias("_rows"))
        .withColumn("votos", F.when(F.col("_rows") > 1, repeated).otherwise(F.col("votos")))
    )
    order = Window.partitionBy(*keys).orderBy(F.desc("votos"), F.asc(unit))
    return (
        once.withColumn("_rn", F.row_number().over(order))
        .groupBy(*keys)
        .agg(
            F.sum("votos").alias("votos"),
            F.count_if(F.col("votos") > 0).alias("n_municipios_com_voto"),
            F.sum(F.when(F.col("_rn") <= k, F.col("votos"))).alias("_top"),
        )
        .select(
            *keys,
            "votos",
            "n_municipios_com_voto",
            (F.lit(100.0) * ratio(F.col("_top"), F.col("votos"))).alias("pct_maiores"),
        )
    )


def typology(
    candidates: DataFrame, quotient: int | Column, entity: str = "sq_candidato"
) -> DataFrame:
    """WIN-15. Concentrated or dispersed by dominant or shared, against reference medians.

    The reference population has at least one tenth of the electoral quotient in votes. A tie with
    the median goes to the lower class; without a population medians and type are null. The
    candidates, one row each, are written once: both medians and the result read them.
    """
    require_columns(candidates, [entity, "votos", "indice_g", "dominancia_ames"], "typology")
    q = F.lit(quotient) if isinstance(quotient, int) else quotient
    floor_votes = F.lit(0.10) * checked(q, q > 0, "typology: electoral quotient must be positive", q)
    g, d = F.col("indice_g"), F.col("dominancia_ames")
    flagged = cut_lineage(
        candidates.withColumn("limiar_votos", floor_votes).select(
            entity,
            "limiar_votos",
            "indice_g",
            "dominancia_ames",
            ((F.col("votos") >= F.col("limiar_votos")) & g.isNotNull() & d.isNotNull()).alias(
                "na_populacao_referencia"
            ),
        )
    )
    both = ["indice_g", "dominancia_ames"]
    medians = column_quantiles(flagged.filter("na_populacao_referencia"), [], both, {"m": 0.5})
    row = wide_quantile(medians, both, "m").select(F.struct(*both).alias("t")).scalar()
    return (
        flagged.withColumn("_t", row)
        .withColumns({"mediana_g": F.col("_t.indice_g"), "mediana_dominancia": F.col("_t.dominancia_ames")})
        .withColumn(
            "tipo",
            F.concat(
                F.when(g > F.col("mediana_g"), "concentrado").when(
                    g <= F.col("mediana_g"), "disperso"
                ),
                F.lit("-"),
                F.when(d > F.col("mediana_dominancia"), "dominante").when(
                    d <= F.col("mediana_dominancia"), "compartilhado"
                ),
            ),
        )
        .select(
            entity, "limiar_votos", "mediana_g", "mediana_dominancia", "tipo",
            "na_populacao_referencia",
        )
    )


def smoothed_rates(
    df: DataFrame, events: str = "votos", base: str = "aptos", by: Sequence[str] = ()
) -> DataFrame:
    """WIN-04. Global empirical-Bayes rates by the method of moments (Marshall 1991).

    Units with an empty base are left out. The weighted variance is expanded to
    `Σ(v²/n)/Σn - b²`, so the prior of a group needs one partial aggregate.
    """
    require_columns(df, [events, base, *by], "smoothed_rates")
    v, n = F.col(events).cast("double"), F.col(base).cast("double")
    kept = df.filter(F.col(base) > 0)
    summed = with_totals(
        kept, by, _v=F.sum(v), _n=F.sum(n), _vvn=F.sum(v * v / n), _k=F.count(F.lit(1))
    )
    b = F.col("_v") / F.col("_n")
    variance = F.col("_vvn") / F.col("_n") - b * b
    prior = F.greatest(variance - b / (F.col("_n") / F.col("_k")), F.lit(0.0))
    return (
        summed.withColumns({"taxa_bruta": v / n, "eb_b": b, "eb_a": prior})
        .withColumn(
            "peso",
            F.coalesce(
                ratio(F.col("eb_a"), F.col("eb_a") + F.col("eb_b") / n), F.lit(0.0)
            ),
        )
        .withColumn(
            "taxa_eb", F.col("peso") * F.col("taxa_bruta") + (1 - F.col("peso")) * F.col("eb_b")
        )
        .drop("_v", "_n", "_vvn", "_k")
    )


# --- spatial autocorrelation ----------------------------------------------------------------------


def _deviations(values: DataFrame) -> DataFrame:
    """Unit, value, deviation from the mean; a null value or a repeated unit raises."""
    require_columns(values, ["id", "valor"], "moran(values)")
    value = F.col("valor").cast("double")
    once = (
        values.groupBy("id")
        .agg(F.first("valor").alias("valor"), F.count(F.lit(1)).alias("_rows"))
        .withColumn(
            "valor",
            checked(
                value,
                value.isNotNull() & (F.col("_rows") == 1),
                "moran: null value or repeated unit",
                F.col("id"),
            ),
        )
        .drop("_rows")
    )
    return once.withColumn("z", F.col("valor") - once.agg(F.avg("valor").alias("m")).scalar())


def _links(values: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Distinct edges without loops; an unknown unit on either end raises."""
    known = values.select(F.col("id").alias("k"))
    edges = neighbours.filter(F.col("id") != F.col("vizinho")).select("id", "vizinho").distinct()
    unknown = fail("moran: unknown unit in the neighbour list", F.col("id"), F.col("vizinho"))
    return (
        edges.join(known.withColumn("a", F.lit(True)), F.col("id") == F.col("k"), "left")
        .drop("k")
        .join(known.withColumn("b", F.lit(True)), F.col("vizinho") == F.col("k"), "left")
        .drop("k")
        .withColumn("id", F.when(F.col("a") & F.col("b"), F.col("id")).otherwise(unknown))
        .select("id", "vizinho")
    )


def _lags(units: DataFrame, links: DataFrame) -> DataFrame:
    """Mean deviation of the neighbours of each unit; a unit without neighbours raises."""
    near = units.select(F.col("id").alias("vizinho"), F.col("z").alias("_zn"))
    means = links.join(near, "vizinho").groupBy("id").agg(
        F.avg("_zn").alias("lag"), F.count(F.lit(1)).alias("k")
    )
    island = fail("moran: unit without neighbour", F.col("id"))
    return units.join(means, "id", "left").withColumn(
        "lag", F.when(F.col("k").isNull(), island).otherwise(F.col("lag"))
    )


def moran_global(values: DataFrame, neighbours: DataFrame) -> DataFrame:
    """STA-04. One row with Moran's I (row-standardised weights); null without variance."""
    rows = _lags(_deviations(values), _links(values, neighbours))
    return rows.agg(ratio(F.sum(F.col("z") * F.col("lag")), F.sum(F.col("z") * F.col("z"))).alias("moran_i"))


def moran_local(values: DataFrame, neighbours: DataFrame) -> DataFrame:
    """STA-04. Local statistic and quadrant of each unit; all null without variance."""
    units = _deviations(values)
    rows = _lags(units, _links(values, neighbours))
    m2 = units.agg(F.avg(F.col("z") * F.col("z")).alias("m2")).scalar()

    def side(c: Column) -> Column:
        return F.when(c > 0, "alto").otherwise("baixo")

    varied = F.col("_m2") > 0
    return rows.withColumn("_m2", m2).select(
        "id",
        "valor",
        F.when(varied, F.col("z") * F.col("lag") / F.nullif(F.col("_m2"), F.lit(0.0))).alias("lisa"),
        F.when(varied, F.concat(side(F.col("z")), F.lit("-"), side(F.col("lag")))).alias("quadrante"),
    )


def _as_extreme(observed: Column, drawn: Column, centre: Column) -> Column:
    return F.when(observed >= centre, drawn >= observed).otherwise(drawn <= observed)


def _no_inference(permutations: int) -> bool:
    """True when no draws are asked for; a negative number of them is an error."""
    if permutations < 0:
        raise ValueError("permutations: a number of draws is not negative")
    return permutations == 0


def moran_global_p(
    values: DataFrame, neighbours: DataFrame, permutations: int = 999, seed: int = PERMUTATION_SEED
) -> DataFrame:
    """STA-04. Moran's I with its pseudo-p under random relabelling.

    A permutation is a row, not a loop: in each one the units are ordered by a seeded hash and the
    deviation of the j-th goes to the j-th unit. Draws depend on (seed, permutation, unit) only,
    so a retried task repeats them, and so can SQL: the hash is an md5 of their text.
    """
    if _no_inference(permutations):
        return moran_global(values, neighbours).withColumn("pseudo_p", F.lit(None).cast("double"))
    units = dense_index(_deviations(values), [], "id", "i")
    links = _links(values, neighbours)
    rows = _lags(units, links)
    observed = rows.agg(
        F.struct(
            ratio(F.sum(F.col("z") * F.col("lag")), F.sum(F.col("z") * F.col("z"))).alias("i"),
            F.sum(F.col("z") * F.col("z")).alias("zz"),
            F.count(F.lit(1)).alias("n"),
        ).alias("o")
    ).scalar()
    drawn = units.select(
        "id", "z", F.explode(F.sequence(F.lit(1), F.lit(permutations))).alias("p")
    ).withColumn("h", F.concat_ws("|", F.lit(str(seed)), F.col("p").cast("string"), F.col("id").cast("string")))
    placed = dense_index(drawn, ["p"], "h", "i").select("p", "i", F.col("z").alias("zp"))
    degree = links.groupBy("id").agg(F.count(F.lit(1)).alias("k"))
    ends = (
        links.join(degree, "id")
        .join(units.select("id", F.col("i").alias("i")), "id")
        .join(units.select(F.col("id").alias("vizinho"), F.col("i").alias("j")), "vizinho")
        .select("i", "j", "k")
    )
    simulated = (
        placed.join(ends, "i")
        .join(placed.select("p", F.col("i").alias("j"), F.col("zp").alias("zj")), ["p", "j"])
        .groupBy("p")
        .agg(F.sum(F.col("zp") * F.col("zj") / F.col("k")).alias("s"))
        .withColumn("o", observed)
    )
    centre = F.when(F.col("o.n") > 1, F.lit(-1.0) / (F.col("o.n") - 1)).otherwise(F.lit(0.0))
    hit = _as_extreme(F.col("o.i"), ratio(F.col("s"), F.col("o.zz")), centre)
    tally = simulated.agg(F.count_if(hit).alias("m"), F.first("o").alias("o"))
    return tally.select(
        F.col("o.i").alias("moran_i"),
        F.when(F.col("o.i").isNotNull(), (F.col("m") + 1) / F.lit(float(permutations + 1))).alias(
            "pseudo_p"
        ),
    )


def _distinct_draws(n_others: Column, k: Column, *salt: Column) -> Column:
    """k distinct positions out of `n_others`, uniform over subsets (Floyd's algorithm)."""

    def take(chosen: Column, j: Column) -> Column:
        text = F.concat_ws("|", *[c.cast("string") for c in (*salt, j)])
        t = F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint"), j + 1)
        return F.when(F.array_contains(chosen, t), F.array_append(chosen, j)).otherwise(
            F.array_append(chosen, t)
        )

    empty = F.array().cast("array<bigint>")
    return F.aggregate(F.sequence(n_others - k, n_others - 1), empty, take)


def moran_local_p(
    values: DataFrame, neighbours: DataFrame, permutations: int = 999, seed: int = PERMUTATION_SEED
) -> DataFrame:
    """STA-04. Local statistic, quadrant and conditional pseudo-p of each unit.

    One row per (unit, permutation) draws as many distinct other units as the unit has neighbours,
    so the work is permutations times edges, never units times units. Draws come from md5 too.
    """
    if _no_inference(permutations):
        return moran_local(values, neighbours).withColumn("pseudo_p", F.lit(None).cast("double"))
    units = dense_index(_deviations(values), [], "id", "i")
    rows = _lags(units, _links(values, neighbours))
    m2 = units.agg(
        F.struct(F.avg(F.col("z") * F.col("z")).alias("m2"), F.count(F.lit(1)).alias("n")).alias("t")
    ).scalar()
    draws = (
        rows.withColumn("_t", m2)
        .filter(F.col("_t.m2") > 0)
        .select("id", "i", "z", "lag", "k", "_t",
                F.explode(F.sequence(F.lit(1), F.lit(permutations))).alias("p"))
        .withColumn(
            "j",
            F.explode(
                _distinct_draws(F.col("_t.n") - 1, F.col("k"), F.lit(seed), F.col("id"), F.col("p"))
            ),
        )
        # Positions skip the unit itself.
        .withColumn("j", F.col("j") + F.when(F.col("j") >= F.col("i"), 1).otherwise(0))
    )
    others = units.select(F.col("i").alias("j"), F.col("z").alias("zj"))
    simulated = (
        draws.join(others, "j")
        .groupBy("id", "p")
        .agg(
            F.avg("zj").alias("lag_p"), F.first("z").alias("z"), F.first("lag").alias("lag"),
            F.first("_t.m2").alias("m2"),
        )
    )
    hit = _as_extreme(
        F.col("z") * F.col("lag") / F.col("m2"), F.col("z") * F.col("lag_p") / F.col("m2"), F.lit(0.0)
    )
    tally = simulated.groupBy("id").agg(
        ((F.count_if(hit) + 1) / F.lit(float(permutations + 1))).alias("pseudo_p")
    )
    return moran_local(values, neighbours).join(tally, "id", "left")


# --- grid cells -----------------------------------------------------------------------------------


def cell_indicators(places: DataFrame, cell: str, by: Sequence[str] = ()) -> DataFrame:
    """AGG-14. Votes and electors per cell with rates of sums.

    The reference rate covers every place received, also those without a cell.
    """
    require_columns(places, [*by, cell, "aptos", "votos"], "cell_indicators")
    sums = places.groupBy(*by, F.col(cell).alias("h3")).agg(
        F.sum("aptos").alias("aptos"), F.sum("votos").alias("votos")
    )
    whole = with_totals(sums, by, _v=F.sum("votos"), _a=F.sum("aptos"))
    return low_count(
        whole.filter(F.col("h3").isNotNull())
        .withColumns({"taxa_referencia": ratio(F.col("_v"), F.col("_a")), "penetracao": penetration()})
        .drop("_v", "_a")
    )


def cell_coverage(
    places: DataFrame,
    cell: str = "h3_r8",
    by: Sequence[str] = (),
    threshold: float = COVERAGE_ALERT_PCT,
) -> DataFrame:
    """AGG-16. Share of the votes of a municipality cast in places without a cell, and the alert."""
    require_columns(places, [*by, "cd_mun_ibge", cell, "votos"], "cell_coverage")
    pct = F.lit(100.0) * ratio(F.col("_sem"), F.col("votos"))
    return (
        places.groupBy(*by, "cd_mun_ibge")
        .agg(
            F.sum("votos").alias("votos"),
            sum_where(F.col("votos"), F.col(cell).isNull()).alias("_sem"),
        )
        .withColumn("pct_votos_sem_coordenada", pct)
        .withColumn("alerta_cobertura_h3", F.col("pct_votos_sem_coordenada") > threshold)
        .drop("_sem")
    )


# --- class breaks ---------------------------------------------------------------------------------

BREAK_DIGITS = 2  # fixed value: significant digits of a class break
BREAK_DIGITS_MAX = 6  # fixed value: digits used when rounding would merge breaks


def _significant(value: Column, digits: Column) -> Column:
    """Round half up to `digits` significant digits, in decimal arithmetic.

    The shortest decimal text of the double is split into mantissa and exponent, so the rounding
    sees the digits a reader sees. The digit sequence is an exact decimal(38, 0).
    """
    # `cast(double as string)` is the shortest text that reads back as the same double.
    text = F.lower(F.abs(value).cast("string"))
    mantissa = F.regexp_extract(text, r"^([0-9.]+)", 1)
    power = F.coalesce(
        F.nullif(F.regexp_extract(text, r"e(-?\d+)$", 1), F.lit("")).cast("int"), F.lit(0)
    )
    decimals = F.length(F.regexp_extract(mantissa, r"\.(\d*)$", 1))
    whole = F.regexp_replace(F.regexp_replace(mantissa, r"\.", ""), r"^0+", "")
    size = F.length(whole)  # significant digits present
    drop = F.greatest(size - digits, F.lit(0))
    kept = F.substring(whole, F.lit(1), size - drop).cast("decimal(38,0)")
    next_digit = F.ascii(F.substring(whole, size - drop + 1, F.lit(1))) - 48
    up = F.when((drop > 0) & (next_digit >= 5), F.lit(1)).otherwise(F.lit(0))
    units = (kept + up).cast("string")
    scaled = F.concat(units, F.lit("E"), (power - decimals + drop).cast("string")).cast("double")
    return F.when(value == 0, F.lit(0.0)).otherwise(F.signum(value) * scaled)


def class_breaks(
    values: DataFrame, k: int = 5, column: str = "valor", low: str | None = "n_baixo", weight: str | None = None
) -> DataFrame:
    """STA-05. One row per break, `ordem` and `quebra`, common to all the rows received.

    Rows of several years are pooled by the caller (a union). Nulls and, when `low` names a
    column, unreliable rows are left out. Type-7 quantiles rounded to two significant digits, more
    when rounding would merge distinct ones; kept inside (minimum, maximum]. Fewer than `2k`
    values or no break left is an error. `weight` counts a row that many times.
    """
    if k < 2:
        raise ValueError(f"class_breaks: k must be at least 2, got {k}")
    require_columns(values, [column] + ([low] if low else []), "class_breaks")
    v = F.col(column).cast("double")
    finite = checked(v, ~F.isnan(v) & (F.abs(v) < float("inf")), "class_breaks: value not finite")
    pool = values.filter(v.isNotNull()) if low is None else values.filter(
        v.isNotNull()
        & ~F.when(F.col(low).isNull(), fail("class_breaks: low-count flag missing")).otherwise(
            F.col(low)
        )
    )
    pool = pool.select(finite.alias("v"), *([F.col(weight).alias("w")] if weight else []))
    inner = {f"q{j}": j / k for j in range(1, k)}
    # The ends are quantiles too, so one pass gives breaks, range and count.
    found = exact_quantiles(
        pool, [], "v", {**inner, "lo": 0.0, "hi": 1.0}, count="n", weight="w" if weight else None
    )

    whole = found.agg(F.max(F.struct(*found.columns)).alias("e")).withColumn(
        "n", F.coalesce(F.col("e.n"), F.lit(0))
    )
    raw = F.when(F.col("n") < 2 * k, fail("class_breaks: too few values", F.col("n"))).otherwise(
        F.array(*[F.col(f"e.{name}") for name in inner])
    )
    # Each precision rounds every quantile; the lowest one that keeps distinct quantiles apart wins.
    digits = F.explode(F.sequence(F.lit(BREAK_DIGITS), F.lit(BREAK_DIGITS_MAX))).alias("d")
    tried = (
        whole.select("e", raw.alias("raw"), digits)
        .select("e", "d", F.explode("raw").alias("q"))
        .groupBy("d", "e")
        .agg(
            F.collect_set(_significant(F.col("q"), F.col("d"))).alias("b"),
            F.count_distinct("q").alias("apart"),
        )
    )
    rank = F.when(F.size("b") == F.col("apart"), F.col("d")).otherwise(
        F.lit(2 * BREAK_DIGITS_MAX) - F.col("d") + BREAK_DIGITS_MAX
    )
    best = tried.agg(F.min_by(F.struct("b", "e"), rank).alias("w"))
    inside = F.array_sort(
        F.filter("w.b", lambda x: (x > F.col("w.e.lo")) & (x <= F.col("w.e.hi")))
    )
    kept = best.select(inside.alias("b")).select(
        F.when(F.size("b") == 0, fail("class_breaks: no variation")).otherwise(F.col("b")).alias("b")
    )
    return kept.select(F.posexplode("b").alias("ordem", "quebra"))


def quantile_scale(values: DataFrame, classes: int, column: str = "valor", weight: str | None = None) -> DataFrame:
    """STA-06. Own-data quantile breaks; repeated breaks and breaks not above the minimum go."""
    names = {f"q{j}": j / classes for j in range(1, classes)}
    found = exact_quantiles(values, [], column, {**names, "lo": 0.0}, weight=weight)
    breaks = found.select("lo", F.explode(F.array(*[F.col(n) for n in names])).alias("quebra"))
    return breaks.filter(F.col("quebra") > F.col("lo")).select("quebra").distinct()


def assign_class(value: Column, breaks: Column) -> Column:
    """STA-07. Index of the class `[b_j, b_{j+1})` a value falls in; null stays null."""
    return F.when(value.isNotNull(), F.size(F.filter(breaks, lambda b: value >= b)))


def with_class(values: DataFrame, breaks: DataFrame, column: str = "valor") -> DataFrame:
    """STA-07 with breaks as rows (at most k - 1 of them, by construction)."""
    row = breaks.agg(F.array_sort(F.collect_list("quebra")).alias("b")).scalar()
    return (
        values.withColumn("_b", row)
        .withColumn("classe", assign_class(F.col(column), F.col("_b")))
        .drop("_b")
    )


def symmetric_extent(values: DataFrame, column: str = "valor") -> DataFrame:
    """STA-08. Largest absolute value rounded up to one significant digit; all zeros give 1."""
    top = F.max(F.abs(F.col(column).cast("double")))
    step = F.pow(F.lit(10.0), F.floor(F.log10(F.col("m"))))
    return values.agg(top.alias("m")).select(
        F.when(F.coalesce(F.col("m"), F.lit(0.0)) == 0, F.lit(1.0))
        .otherwise(F.ceil(F.col("m") / step) * step)
        .alias("extensao")
    )


def divergent_breaks(extent: Column, classes: int, centre: float = 0.0) -> Column:
    """STA-08. Breaks of a linear scale symmetric around `centre`, as an array."""
    steps = [F.lit(centre) - extent + 2 * extent * F.lit((j + 1) / classes) for j in range(classes - 1)]
    return F.array(*steps)


def divergent_log_breaks(factor: Column, classes: int) -> Column:
    """STA-08 for ratios: breaks between 1/factor and factor, evenly spaced in the logarithm."""
    return F.array(
        *[F.pow(factor, F.lit(2.0 * (j + 1) / classes - 1.0)) for j in range(classes - 1)]
    )
