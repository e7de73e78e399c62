"""Revenue, expense, cost per vote, balance, distribution and price deflation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from escrutinio.functions.checks import checked, fail, require_columns
from escrutinio.functions.rates import ratio
from escrutinio.functions.text import is_month, month_number, normalize_label
from escrutinio.operators.ordering import exact_quantiles
from escrutinio.operators.totals import money_sum, money_sum_where

# Fixed values, all compared after label normalisation. A label outside these lists is an error.
REVENUE_CATEGORIES = (
    "fefc",
    "fundo_partidario",
    "pessoa_fisica",
    "recursos_proprios",
    "financiamento_coletivo",
    "partido_outros_recursos",
    "outros_candidatos",
    "outros",
)
# Source label -> category; an empty category means that the origin decides.
SOURCE_CATEGORY = {
    "FUNDO ESPECIAL": "fefc",
    "FUNDO PARTIDARIO": "fundo_partidario",
    "OUTROS RECURSOS": "",
}
ORIGIN_CATEGORY = {
    "RECURSOS DE PESSOAS FISICAS": "pessoa_fisica",
    "DOACOES PELA INTERNET": "pessoa_fisica",
    "RECURSOS PROPRIOS": "recursos_proprios",
    "RECURSOS DE FINANCIAMENTO COLETIVO": "financiamento_coletivo",
    "RECURSOS DE PARTIDO POLITICO": "partido_outros_recursos",
    "RECURSOS DE OUTROS CANDIDATOS": "outros_candidatos",
    "FUNDO ESPECIAL DE FINANCIAMENTO DE CAMPANHA": "fefc",
    "FUNDO PARTIDARIO": "fundo_partidario",
    "DOACOES PARA CAMPANHA": "outros_candidatos",
    "RENDIMENTOS DE APLICACOES FINANCEIRAS": "outros",
    "COMERCIALIZACAO DE BENS COM OR": "outros",
    "COMERCIALIZACAO DE BENS COM FEFC": "outros",
    "RECURSOS DE ORIGENS NAO IDENTIFICADAS": "outros",
}
FINANCIAL_NATURES = ("FINANCEIRO",)
IN_KIND_NATURES = ("ESTIMAVEL", "ESTIMADO")
TRANSFER_ORIGINS = (
    "RECURSOS DE OUTROS CANDIDATOS",
    "FUNDO ESPECIAL DE FINANCIAMENTO DE CAMPANHA",
    "FUNDO PARTIDARIO",
    "DOACOES PARA CAMPANHA",
)
EXPENSE_TRANSFERS = ("DOACOES FINANCEIRAS A OUTROS CANDIDATOS/PARTIDOS",)
SPENDING_LOWER = 0.70
SPENDING_UPPER = 1.10
DEFAULT_ORIGIN_MONTH = "2022-09"
DEFAULT_TARGET_MONTH = "2026-09"
FINAL_ACCOUNTS_SHARE = 0.95


def _lookup(table: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def _category(source: Column, origin: Column, raw_source: Column, raw_origin: Column) -> Column:
    """Category from normalised labels; the raw ones are for the message of an unknown label."""
    by_source, by_origin = _lookup(SOURCE_CATEGORY, source), _lookup(ORIGIN_CATEGORY, origin)
    return (
        F.when(by_source.isNull(), fail("unknown ds_fonte_receita", raw_source))
        .when(by_origin.isNull(), fail("unknown ds_origem_receita", raw_origin))
        .when(by_source == "", by_origin)
        .otherwise(by_source)
    )


def revenue_category(source: Column, origin: Column) -> Column:
    """JOI-11. Category of a revenue entry: the source decides, `OUTROS RECURSOS` defers to the origin.

    The closed dictionaries are literals of the plan, so no join and no pass over distinct labels.
    """
    return _category(normalize_label(source), normalize_label(origin), source, origin)


def classify_revenue(revenue: DataFrame) -> DataFrame:
    """JOI-11 over a table: adds `categoria`."""
    require_columns(revenue, ["ds_fonte_receita", "ds_origem_receita"], "classify_revenue")
    return revenue.withColumn(
        "categoria", revenue_category(F.col("ds_fonte_receita"), F.col("ds_origem_receita"))
    )


def is_transfer(origin: Column) -> Column:
    """True when a revenue entry came from another campaign; told by the origin."""
    return F.coalesce(normalize_label(origin).isin(*TRANSFER_ORIGINS), F.lit(False))


def _summed_labels(revenue: DataFrame, by: Sequence[str], context: str) -> DataFrame:
    """Entries summed per raw label, then classified.

    Labels are normalised once per (scope, label) instead of once per entry, and map-side combine
    sees the long list of entries. Sums stay exact decimals. A negative entry raises.
    """
    labels = [c for c in LABEL_COLUMNS if c in revenue.columns]
    require_columns(revenue, [*by, "ds_origem_receita", "ds_natureza_receita", "vr_receita"], context)
    if "categoria" not in labels:
        require_columns(revenue, ["ds_fonte_receita"], context)
    value = F.col("vr_receita").cast("decimal(18,4)")
    summed = revenue.groupBy(*by, *labels).agg(
        F.sum(value).alias("_sum"), F.min("vr_receita").alias("_least")
    )
    # One normalisation per label, in a projection of its own.
    clean = summed.withColumns({f"_{c}": normalize_label(F.col(c)) for c in labels if c != "categoria"})
    nature, origin = F.col("_ds_natureza_receita"), F.col("_ds_origem_receita")
    financial = checked(
        nature.isin(*FINANCIAL_NATURES),
        nature.isin(*FINANCIAL_NATURES, *IN_KIND_NATURES),
        "unknown ds_natureza_receita",
        F.col("ds_natureza_receita"),
    )
    category = (
        F.col("categoria")
        if "categoria" in labels
        else _category(
            F.col("_ds_fonte_receita"), origin, F.col("ds_fonte_receita"), F.col("ds_origem_receita")
        )
    )
    present = F.coalesce(F.col("_least"), F.lit(0.0))
    return clean.select(
        *by,
        category.alias("categoria"),
        checked(F.col("_sum"), present >= 0, f"{context}: negative amount", present).alias("_v"),
        financial.alias("_fin"),
        F.coalesce(origin.isin(*TRANSFER_ORIGINS), F.lit(False)).alias("_rep"),
    )


LABEL_COLUMNS = ("categoria", "ds_fonte_receita", "ds_origem_receita", "ds_natureza_receita")


def revenue_summary(revenue: DataFrame, by: Sequence[str] = ("sq_candidato",)) -> DataFrame:
    """AGG-24. Totals by nature and category, shares, and concentration of the sources.

    Takes entries with their raw labels, or already classified ones. Negative amounts and unknown
    labels raise; a zero total gives null shares. With no `by` the result is one row.
    """
    rows = _summed_labels(revenue, by, "revenue_summary")

    def total(condition: Column | None = None) -> Column:
        v = F.col("_v") if condition is None else F.when(condition, F.col("_v"))
        return F.coalesce(F.sum(v).cast("double"), F.lit(0.0))

    sums = [
        total().alias("receita_total"),
        total(F.col("_fin")).alias("receita_financeira"),
        total(~F.col("_fin")).alias("receita_estimavel"),
        total(F.col("_rep")).alias("receita_repasses_candidatos"),
        *[total(F.col("categoria") == c).alias(f"receita_{c}") for c in REVENUE_CATEGORIES],
    ]
    return revenue_shares(rows.groupBy(*by).agg(*sums) if by else rows.agg(*sums))


def revenue_shares(sums: DataFrame) -> DataFrame:
    """Shares and source concentration of a table of summed revenue."""
    total = F.col("receita_total")

    def pct(*names: str) -> Column:
        part = F.lit(0.0)
        for n in names:
            part = part + F.col(n)
        return F.lit(100.0) * ratio(part, total)

    hhi = F.lit(0.0)
    for c in REVENUE_CATEGORIES:
        share = ratio(F.col(f"receita_{c}"), total)
        hhi = hhi + share * share
    return sums.withColumns(
        {
            "receita_sem_repasses": total - F.col("receita_repasses_candidatos"),
            "pct_publico": pct("receita_fefc", "receita_fundo_partidario"),
            "pct_autofinanciamento": pct("receita_recursos_proprios"),
            "pct_pessoa_fisica": pct("receita_pessoa_fisica", "receita_financiamento_coletivo"),
            "pct_estimavel": pct("receita_estimavel"),
            "hhi_fontes": F.when(total > 0, hhi),
        }
    ).withColumn("n_efetivo_fontes", ratio(F.lit(1.0), F.col("hhi_fontes")))


def group_revenue(
    revenue: DataFrame, members: DataFrame, entity: str = "sq_candidato"
) -> DataFrame:
    """AGG-25. One row: the revenue of a group without transfers between its members.

    `members` has one column named as `entity`. A transfer whose donor is a member leaves the
    total; one with an unknown donor stays and is reported apart. Both amounts are returned, so the
    possible range is total minus unknown to total.
    """
    donor = "sq_candidato_doador"
    require_columns(
        revenue, [entity, "ds_origem_receita", "vr_receita", donor], "group_revenue"
    )
    ids = members.select(F.col(entity)).distinct()
    mine = revenue.join(ids, entity, "left_semi")
    flagged = mine.join(
        ids.select(F.col(entity).alias(donor), F.lit(True).alias("_dentro")), donor, "left"
    )
    transfer = is_transfer(F.col("ds_origem_receita"))
    internal = transfer & F.coalesce(F.col("_dentro"), F.lit(False))
    marked = flagged.withColumns(
        {"_interno": internal, "_desconhecido": transfer & F.col(donor).isNull()}
    )
    # A tag keeps the three results in one pass: the summary groups by it and internal rows go
    # to a group of their own.
    parts = marked.groupBy().agg(
        money_sum_where(F.col("vr_receita"), F.col("_interno")).alias("receita_repasses_internos"),
        money_sum_where(F.col("vr_receita"), F.col("_desconhecido")).alias(
            "receita_repasses_doador_desconhecido"
        ),
    )
    extras = parts.select(F.struct(*parts.columns).alias("x")).scalar()
    summary = revenue_summary(marked.filter(~F.col("_interno")), by=())
    return (
        summary.withColumn("_x", extras)
        .withColumns({c: F.col(f"_x.{c}") for c in parts.columns})
        .drop("_x")
    )


def campaign_expense(
    expenses: DataFrame,
    value: str,
    by: Sequence[str] = ("sq_candidato",),
    include_transfers: bool = False,
    name: str = "despesa",
) -> DataFrame:
    """AGG-26. Expense of the own campaign, without transfers to others unless asked.

    A null origin raises. A candidacy that only made transfers keeps no row, as it has no expense.
    """
    require_columns(expenses, [*by, "ds_origem_despesa", value], "campaign_expense")
    origin = F.col("ds_origem_despesa")
    transfer = checked(
        normalize_label(origin).isin(*EXPENSE_TRANSFERS),
        origin.isNotNull(),
        "campaign_expense: ds_origem_despesa missing",
    )
    kept = expenses.withColumn("_t", transfer)
    if not include_transfers:
        kept = kept.filter(~F.col("_t"))
    else:
        kept = kept.filter(F.col("_t").isNotNull())
    total = money_sum(F.col(value)).alias(name)
    return kept.groupBy(*by).agg(total) if by else kept.agg(F.coalesce(total, F.lit(0.0)).alias(name))


def expense_split(
    expenses: DataFrame, values: Sequence[str], by: Sequence[str] = ("sq_candidato",)
) -> DataFrame:
    """AGG-26 and AGG-27 in one pass: per value column its own-campaign part, transfers and total."""
    origin = F.col("ds_origem_despesa")
    transfer = checked(
        normalize_label(origin).isin(*EXPENSE_TRANSFERS),
        origin.isNotNull(),
        "expense_split: ds_origem_despesa missing",
    )
    aggregates = []
    for v in values:
        short = v.removeprefix("vr_")
        aggregates += [
            money_sum_where(F.col(v), ~F.col("_t")).alias(short),
            money_sum_where(F.col(v), F.col("_t")).alias(f"{short}_repasses"),
            F.coalesce(money_sum(F.col(v)), F.lit(0.0)).alias(f"{short}_com_repasses"),
        ]
    return expenses.withColumn("_t", transfer).groupBy(*by).agg(*aggregates)


def paid_expense() -> Column:
    """EXP-23. Missing paid expense is zero when contracted expense exists; without accounts, null."""
    contracted, paid = F.col("despesa_contratada"), F.col("despesa_paga")
    return F.when(paid.isNull() & contracted.isNotNull(), F.lit(0.0)).otherwise(paid.cast("double"))


def cost_per_vote(df: DataFrame) -> DataFrame:
    """EXP-24. Contracted and paid cost per vote, and the debt."""
    require_columns(df, ["despesa_contratada", "despesa_paga", "votos"], "cost_per_vote")
    return df.withColumn("despesa_paga", paid_expense()).withColumns(
        {
            "custo_voto_contratado": ratio(F.col("despesa_contratada"), F.col("votos")),
            "custo_voto_pago": ratio(F.col("despesa_paga"), F.col("votos")),
            "divida": F.col("despesa_contratada") - F.col("despesa_paga"),
        }
    )


def _eligible_median(df: DataFrame, by: Sequence[str], value: Column, when: Column, name: str):
    return exact_quantiles(
        df.filter(when).select(*by, value.alias("_r")), by, "_r", {name: 0.5}
    )


def _beside(sums: DataFrame, medians: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    if by:
        return sums.join(medians, list(by), "left")
    return sums.withColumn(name, medians.scalar())


def total_cost_per_vote(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """AGG-28. Cost per vote of a group: sum over sum, the median of candidates, and exclusions."""
    require_columns(df, [*by, "despesa_contratada", "despesa_paga", "votos"], "total_cost_per_vote")
    rows = df.withColumn("despesa_paga", paid_expense())
    with_accounts = F.col("despesa_contratada").isNotNull()
    eligible = with_accounts & (F.col("votos") > 0)
    votes = F.sum(F.when(eligible, F.col("votos")))
    sums = rows.groupBy(*by).agg(
        ratio(money_sum_where(F.col("despesa_contratada"), eligible), votes).alias(
            "custo_voto_contratado"
        ),
        ratio(money_sum_where(F.col("despesa_paga"), eligible), votes).alias("custo_voto_pago"),
        F.count_if(with_accounts & (F.col("votos") <= 0)).alias("candidatos_sem_voto_excluidos"),
        F.count_if(~with_accounts).alias("candidatos_sem_contas_excluidos"),
    )
    name = "mediana_custo_voto_contratado"
    cost = ratio(F.col("despesa_contratada"), F.col("votos"))
    return _beside(sums, _eligible_median(rows, by, cost, eligible, name), by, name)


def revenue_per_vote(df: DataFrame) -> DataFrame:
    """EXP-25. Revenue per vote."""
    require_columns(df, ["receita_total", "votos"], "revenue_per_vote")
    return df.withColumn("receita_por_voto", ratio(F.col("receita_total"), F.col("votos")))


def total_revenue_per_vote(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """AGG-29. Revenue per vote of a group, by the same rule as the cost."""
    require_columns(df, [*by, "receita_total", "votos"], "total_revenue_per_vote")
    with_accounts = F.col("receita_total").isNotNull()
    eligible = with_accounts & (F.col("votos") > 0)
    sums = df.groupBy(*by).agg(
        ratio(
            money_sum_where(F.col("receita_total"), eligible),
            F.sum(F.when(eligible, F.col("votos"))),
        ).alias("receita_por_voto"),
        F.count_if(with_accounts & (F.col("votos") <= 0)).alias("candidatos_sem_voto_excluidos"),
        F.count_if(~with_accounts).alias("candidatos_sem_contas_excluidos"),
    )
    name = "mediana_receita_por_voto"
    value = ratio(F.col("receita_total"), F.col("votos"))
    return _beside(sums, _eligible_median(df, by, value, eligible, name), by, name)


def revenue_per_thousand(
    df: DataFrame, revenue: str = "receita_total", electors: str = "aptos"
) -> DataFrame:
    """EXP-25. Revenue per thousand electors of the circumscription, counted once."""
    require_columns(df, [revenue, electors], "revenue_per_thousand")
    return df.withColumn(
        "receita_por_mil_aptos", F.lit(1000.0) * ratio(F.col(revenue), F.col(electors))
    )


def campaign_balance(df: DataFrame) -> DataFrame:
    """EXP-26. Revenue minus contracted, financial revenue minus paid, share spent.

    Expenses must include transfers to others.
    """
    require_columns(
        df,
        ["receita_total", "receita_financeira", "despesa_contratada", "despesa_paga"],
        "campaign_balance",
    )
    contracted = F.col("despesa_contratada")
    return df.withColumn("despesa_paga", paid_expense()).withColumns(
        {
            "saldo_contratado": F.col("receita_total") - contracted,
            "saldo_financeiro": F.col("receita_financeira") - F.col("despesa_paga"),
            "pct_receita_gasta": F.lit(100.0) * ratio(contracted, F.col("receita_total")),
        }
    )


def spending_alert(df: DataFrame) -> DataFrame:
    """EXP-22. Spending over financial revenue, and the alert outside the inclusive band."""
    require_columns(
        df, ["receita_financeira", "despesa_contratada", "despesa_paga"], "spending_alert"
    )
    has_accounts = F.col("despesa_contratada").isNotNull()
    contracted = F.col("razao_gasto_contratada")
    direction = F.when(contracted < SPENDING_LOWER, "abaixo").when(
        contracted > SPENDING_UPPER, "acima"
    )
    return (
        df.withColumn("despesa_paga", paid_expense())
        .withColumns(
            {
                f"razao_gasto_{kind}": F.when(
                    has_accounts, ratio(F.col(f"despesa_{kind}"), F.col("receita_financeira"))
                )
                for kind in ("contratada", "paga")
            }
        )
        .withColumns(
            {
                "alerta_declaracao": F.when(contracted.isNotNull(), direction.isNotNull()),
                "sentido_alerta": direction,
            }
        )
    )


def revenue_distribution(
    df: DataFrame, column: str = "receita_total", by: Sequence[str] = ()
) -> DataFrame:
    """AGG-30. Count, sum, mean, exact quartiles and maximum over candidates with accounts."""
    require_columns(df, [*by, column], "revenue_distribution")
    value = F.col(column).cast("double")
    sums = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_candidatos"),
        F.count(value).alias("n_com_contas"),
        money_sum(value).alias("soma"),
        F.max(value).alias("maximo"),
    )
    quartiles = {"p25": 0.25, "mediana": 0.5, "p75": 0.75}
    q = exact_quantiles(df, by, column, quartiles)
    if by:
        out = sums.join(q, list(by), "left")
    else:
        out = sums.withColumn("_q", q.select(F.struct(*quartiles).alias("q")).scalar()).withColumns(
            {name: F.col(f"_q.{name}") for name in quartiles}
        )
    return out.withColumn("media", ratio(F.col("soma"), F.col("n_com_contas"))).select(
        *by, "n_candidatos", "n_com_contas", "soma", "media", "mediana", "p25", "p75", "maximo"
    )


def accounts_status(revenue: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """AGG-31. `FINAL` for a year with at least 95 % final accounts, else `PARCIAL`.

    `overrides` (`ano`, `situacao`) carries human decisions and wins.
    """
    final = F.avg((F.upper("tp_prestacao_contas") == "FINAL").cast("int"))
    status = F.when(final >= FINAL_ACCOUNTS_SHARE, "FINAL").otherwise("PARCIAL")
    years = revenue.groupBy("ano").agg(status.alias("situacao"))
    if overrides is None:
        return years
    manual = overrides.select("ano", F.col("situacao").alias("_m"))
    return years.join(manual, "ano", "full_outer").select(
        "ano", F.coalesce("_m", "situacao").alias("situacao")
    )


def has_movement(value: str, *labels: str) -> Column:
    """FIL-04. False for a "no movement" row: every label null and value zero."""
    empty = F.col(value).eqNullSafe(F.lit(0).cast("double"))
    for label in labels:
        empty = empty & F.col(label).isNull()
    return ~empty


def expense_ledger(contracted: DataFrame, paid: DataFrame) -> DataFrame:
    """JOI-04. Contracted and paid expense per (year, entity, origin); a missing side is zero.

    Both sides are stacked and grouped once, so one shuffle serves both sums, and null origins
    meet as equal.
    """
    keys = ["ano", "sq_candidato", "ds_origem_despesa"]
    none = F.lit(None).cast("double")
    c = contracted.filter(has_movement("vr_despesa_contratada", "ds_origem_despesa")).select(
        *keys, F.col("vr_despesa_contratada").cast("double"), none.alias("vr_despesa_paga")
    )
    p = paid.select(
        *keys, none.alias("vr_despesa_contratada"), F.col("vr_pagto_despesa").cast("double").alias("vr_despesa_paga")
    )
    return (
        c.unionByName(p)
        .groupBy(*keys)
        .agg(
            F.coalesce(money_sum(F.col("vr_despesa_contratada")), F.lit(0.0)).alias(
                "vr_despesa_contratada"
            ),
            F.coalesce(money_sum(F.col("vr_despesa_paga")), F.lit(0.0)).alias("vr_despesa_paga"),
        )
    )


def ledger(
    entries: DataFrame,
    keys: Sequence[str],
    value: str,
    count: str = "qt_lancamentos",
    generated: str | None = "dt_geracao",
) -> DataFrame:
    """AGG-09, AGG-35. Entries summed by labels, with their number and the newest file date."""
    extra = [F.max(generated).alias(generated)] if generated else []
    return entries.groupBy(*keys).agg(
        money_sum(F.col(value)).alias(value), F.count(F.lit(1)).cast("int").alias(count), *extra
    )


# --- prices ---------------------------------------------------------------------------------------


MONTHS_MAX = 10_000  # months of a price series; far beyond any real one


def price_index(series: DataFrame) -> DataFrame:
    """TMP-01. Index chained from 100 by the monthly change in percent.

    The series has one row per month and is folded as one ordered array. More than `MONTHS_MAX` rows
    are no such series and raise; the array never holds more than one beyond that.
    """
    short = series.orderBy("mes").limit(MONTHS_MAX + 1)
    folded = short.agg(F.array_sort(F.collect_list(F.struct("mes", "variacao"))).alias("s"))
    long = fail("price_index: more months than a series has", F.lit(MONTHS_MAX))
    folded = folded.select(F.when(F.size("s") > MONTHS_MAX, long).otherwise(F.col("s")).alias("s"))
    start = F.struct(F.lit(100.0).alias("i"), F.array().cast("array<double>").alias("out"))

    def step(acc: Column, row: Column) -> Column:
        level = acc["i"] * (1 + row["variacao"] / 100)
        return F.struct(level.alias("i"), F.array_append(acc["out"], level).alias("out"))

    levels = F.aggregate("s", start, step, lambda acc: acc["out"])
    return folded.select(
        F.inline(F.arrays_zip(F.col("s"), levels.alias("indice")))
    ).select("s.mes", "s.variacao", "indice")


def price_factor(series: DataFrame, origin: str | Column, base: str | Column) -> DataFrame:
    """TMP-02. One row, `fator`: product of the monthly changes after `origin` up to `base`.

    Equal months give 1. A malformed month, a base before the origin, and a month that is missing
    or repeated raise.
    """
    require_columns(series, ["mes", "variacao"], "price_factor")
    o = F.lit(origin) if isinstance(origin, str) else origin
    b = F.lit(base) if isinstance(base, str) else base
    span = month_number(b) - month_number(o)
    inside = F.when((F.col("mes") > o) & (F.col("mes") <= b), 1 + F.col("variacao") / 100)
    summed = series.agg(
        F.coalesce(F.product(inside), F.lit(1.0)).alias("fator"),
        F.count(inside).alias("_n"),
        F.count_distinct(F.when(inside.isNotNull(), F.col("mes"))).alias("_d"),
    )
    return summed.select(
        F.when(~is_month(o) | ~is_month(b), fail("price_factor: month must be YYYY-MM", o, b))
        .when(b < o, fail("price_factor: base month before the origin", o, b))
        .when(
            (F.col("_n") != span) | (F.col("_d") != span),
            fail("price_factor: a month of the series is missing or repeated", o, b),
        )
        .otherwise(F.col("fator"))
        .alias("fator")
    )


def resolve_base_month(
    series: DataFrame, origin: str = DEFAULT_ORIGIN_MONTH, target: str = DEFAULT_TARGET_MONTH
) -> DataFrame:
    """TMP-03. One row, `mes_base`: the target when published, else the last month after the origin."""
    last = series.filter(F.col("mes") > origin).agg(F.max("mes").alias("m"))
    return last.select(
        F.when(F.col("m").isNull(), fail("no month of the series after the origin", F.lit(origin)))
        .otherwise(F.least(F.lit(target), F.col("m")))
        .alias("mes_base")
    )


def deflate(
    df: DataFrame, columns: Sequence[str], series: DataFrame, origin: str, base: str
) -> DataFrame:
    """TMP-04. Columns times the price factor, read once as a scalar subquery."""
    require_columns(df, columns, "deflate")
    factor = price_factor(series, origin, base).scalar()
    out = df.withColumn("_f", factor)
    return out.withColumns({c: F.col(c).cast("double") * F.col("_f") for c in columns}).drop("_f")


def compare_revenue(
    df: DataFrame,
    money: Sequence[str],
    shares: Sequence[str],
    series: DataFrame,
    origin: str,
    base: str,
    before: str = "2022",
    after: str = "2026",
) -> DataFrame:
    """TMP-06. Two years of money (old side deflated, delta, % change) and percentages (points)."""
    both = set(money) & set(shares)
    if both:
        raise ValueError(f"compare_revenue: column is both money and share: {sorted(both)}")
    names = [*money, *shares]
    require_columns(df, [f"{c}_{y}" for c in names for y in (before, after)], "compare_revenue")
    fixed = deflate(df, [f"{c}_{before}" for c in money], series, origin, base) if money else df
    new, old = (lambda c: F.col(f"{c}_{after}")), (lambda c: F.col(f"{c}_{before}"))
    return fixed.withColumns(
        {
            **{f"delta_{c}": new(c) - old(c) for c in names},
            **{f"var_pct_{c}": F.lit(100.0) * (ratio(new(c), old(c)) - 1) for c in money},
        }
    )
