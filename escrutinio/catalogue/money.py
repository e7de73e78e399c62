"""Revenue, expense, cost per vote, balance, distribution, prices."""

from __future__ import annotations

from pyspark.sql import functions as F

from escrutinio.catalogue.roles import (
    EXPENSES,
    PRICES,
    REVENUE,
    expense_entries,
    price_series,
    revenue,
    rounded,
    table,
    with_sql,
)
from escrutinio.operators import finance as fi
from escrutinio.operators.totals import money_sum
from escrutinio.plans import accounts, catalog, screens

SUMMED = (
    "receita_total", "receita_financeira", "receita_estimavel", "receita_repasses_candidatos",
    *[f"receita_{c}" for c in fi.REVENUE_CATEGORIES], "receita_sem_repasses",
)


def _money(df, *extra):
    return rounded(df, money=(*SUMMED, *extra))


def revenue_classified(spark, d):
    rows = fi.classify_revenue(revenue(spark, d))
    return rounded(
        rows.groupBy("ano", "categoria").agg(F.count(F.lit(1)).alias("n"), money_sum(F.col("vr_receita")).alias("valor")),
        money=("valor",),
    )


def revenue_summary(spark, d):
    return _money(fi.revenue_summary(revenue(spark, d)))


def revenue_summary_year(spark, d):
    return _money(fi.revenue_summary(revenue(spark, d), by=["ano"]))


def revenue_grand_summary(spark, d):
    return _money(fi.revenue_summary(revenue(spark, d), by=[]))


def group_revenue(spark, d):
    members = table(spark, d, "customer").filter(F.col("c_nationkey") == 3).select(
        F.col("c_custkey").alias("sq_candidato")
    )
    out = fi.group_revenue(fi.classify_revenue(revenue(spark, d)), members)
    return _money(out, "receita_repasses_internos", "receita_repasses_doador_desconhecido").select(
        "receita_total", "receita_sem_repasses", "receita_repasses_internos",
        "receita_repasses_doador_desconhecido", "pct_publico", "hhi_fontes",
    )


def campaign_expense(spark, d):
    return rounded(
        fi.campaign_expense(expense_entries(spark, d), "vr_despesa_contratada"), money=("despesa",)
    )


def campaign_expense_total(spark, d):
    return rounded(
        fi.campaign_expense(expense_entries(spark, d), "vr_despesa_paga", by=["ano"], include_transfers=True),
        money=("despesa",),
    )


def expense_split(spark, d):
    out = fi.expense_split(expense_entries(spark, d), accounts.EXPENSES)
    return rounded(out, 2)


def _accounts(spark, d):
    """Votes, revenue and expense of each candidacy: every ninth has no accounts."""
    e = fi.campaign_expense(expense_entries(spark, d), "vr_despesa_contratada", include_transfers=True)
    p = fi.campaign_expense(
        expense_entries(spark, d).filter(F.col("sq_candidato") % 5 != 0), "vr_despesa_paga", include_transfers=True,
        name="despesa_paga",
    )
    r = fi.revenue_summary(revenue(spark, d)).select(
        "sq_candidato", "receita_total", "receita_financeira"
    )
    v = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("sq_candidato")).agg(
        F.sum(F.when(F.col("l_suppkey") % 11 != 0, F.col("l_quantity").cast("bigint")).otherwise(0)).alias("votos")
    )
    return (
        v.join(e.withColumnRenamed("despesa", "despesa_contratada").filter("sq_candidato % 9 <> 0"), "sq_candidato", "left")
        .join(p.filter("sq_candidato % 9 <> 0"), "sq_candidato", "left")
        .join(r, "sq_candidato", "left")
    )


def cost_per_vote(spark, d):
    return rounded(
        fi.cost_per_vote(_accounts(spark, d)).drop("receita_total", "receita_financeira"),
        money=("despesa_contratada", "despesa_paga", "divida"),
    )


def cost_per_vote_total(spark, d):
    return rounded(fi.total_cost_per_vote(_accounts(spark, d)))


def median_cost(spark, d):
    return rounded(screens.median_cost(_accounts(spark, d)))


def revenue_per_vote(spark, d):
    return rounded(
        fi.revenue_per_vote(_accounts(spark, d)).select("sq_candidato", "votos", "receita_total", "receita_por_voto"),
        money=("receita_total",),
    )


def revenue_per_vote_total(spark, d):
    return rounded(fi.total_revenue_per_vote(_accounts(spark, d)))


def revenue_per_thousand(spark, d):
    t = fi.revenue_summary(revenue(spark, d), by=["ano"]).select("ano", "receita_total")
    base = table(spark, d, "lineitem").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("a")).scalar()
    return rounded(fi.revenue_per_thousand(t.withColumn("aptos", base)), money=("receita_total",))


def revenue_distribution(spark, d):
    return rounded(fi.revenue_distribution(_accounts(spark, d)), 2)


def balance(spark, d):
    return rounded(
        fi.campaign_balance(_accounts(spark, d)),
        money=("receita_total", "receita_financeira", "despesa_contratada", "despesa_paga", "saldo_contratado", "saldo_financeiro"),
    )


def spending_alert(spark, d):
    return rounded(
        fi.spending_alert(_accounts(spark, d)).select(
            "sq_candidato", "razao_gasto_contratada", "razao_gasto_paga", "alerta_declaracao", "sentido_alerta"
        )
    )


def scatter_points(spark, d):
    t = fi.revenue_per_vote(fi.cost_per_vote(_accounts(spark, d)))
    return rounded(accounts.scatter_points(t))


def scatter_missing(spark, d):
    return accounts.scatter_missing(fi.revenue_per_vote(fi.cost_per_vote(_accounts(spark, d))), "pago")


def accounts_status(spark, d):
    od = table(spark, d, "orders").select(
        F.year("o_orderdate").alias("ano"),
        F.when(F.col("o_orderkey") % (F.year("o_orderdate") - 1985) == 0, "Parcial").otherwise("Final").alias("tp_prestacao_contas"),
    )
    return fi.accounts_status(od)


def ledger(spark, d):
    return rounded(
        fi.ledger(
            revenue(spark, d),
            ["ano", "sq_candidato", "ds_fonte_receita", "ds_natureza_receita"], "vr_receita",
        ),
        2,
    )


def expense_ledger(spark, d):
    e = expense_entries(spark, d)
    label = F.when(F.col("ds_origem_despesa").startswith("Pub"), F.lit(None).cast("string")).otherwise(F.col("ds_origem_despesa"))
    c = e.filter(F.col("ano") < 1999).withColumn("ds_origem_despesa", label)
    p = e.filter(F.col("ano") > 1996).withColumn("ds_origem_despesa", label).withColumnRenamed(
        "vr_despesa_paga", "vr_pagto_despesa"
    )
    return rounded(fi.expense_ledger(c, p), 2)


def movement_filter(spark, d):
    rows = revenue(spark, d).withColumns(
        {
            "ds_fonte_receita": F.when(F.col("sq_candidato") % 6 != 0, F.col("ds_fonte_receita")),
            "ds_origem_receita": F.when(F.col("sq_candidato") % 6 != 0, F.col("ds_origem_receita")),
            "vr_receita": F.when(F.col("sq_candidato") % 4 == 0, 0.0).otherwise(F.col("vr_receita")),
        }
    )
    return rounded(catalog.revenue_view(rows).select("ano", "sq_candidato", "vr_receita"), 2)


def price_index(spark, d):
    return rounded(fi.price_index(price_series(spark, d)))


def price_factor(spark, d):
    s = price_series(spark, d)
    base = fi.resolve_base_month(s, "1996-09", "2026-09").scalar()
    return rounded(fi.price_factor(s, "1996-09", base).withColumn("mes_base", base), 9)


def deflated(spark, d):
    t = fi.revenue_summary(revenue(spark, d), by=["ano"]).select("ano", "receita_total")
    return rounded(fi.deflate(t, ["receita_total"], price_series(spark, d), "1996-09", "1998-09"), 2)


def compare_revenue(spark, d):
    t = fi.revenue_summary(revenue(spark, d), by=["sq_candidato", "ano"])
    names = ("receita_total", "receita_fefc", "pct_publico")
    wide = t.filter(F.col("ano").isin(1996, 1998)).groupBy("sq_candidato").agg(
        *[
            F.max(F.when(F.col("ano") == y, F.col(c))).alias(f"{c}_{n}")
            for c in names
            for y, n in ((1996, 2022), (1998, 2026))
        ]
    )
    out = fi.compare_revenue(
        wide, ["receita_total", "receita_fefc"], ["pct_publico"], price_series(spark, d), "1996-09", "1998-09"
    )
    return rounded(out, 4)


def stacked_revenue(spark, d):
    return rounded(
        screens.stacked_revenue(fi.revenue_summary(revenue(spark, d), by=[])), money=("valor",)
    )


QUERIES = {
    f.__name__: f
    for f in (
        revenue_classified, revenue_summary, revenue_summary_year, revenue_grand_summary, group_revenue,
        campaign_expense, campaign_expense_total, expense_split, cost_per_vote, cost_per_vote_total,
        median_cost, revenue_per_vote, revenue_per_vote_total, revenue_per_thousand,
        revenue_distribution, balance, spending_alert, scatter_points, scatter_missing,
        accounts_status, ledger, expense_ledger, movement_filter, price_index, price_factor,
        deflated, compare_revenue, stacked_revenue,
    )
}

CATS = fi.REVENUE_CATEGORIES
SUMS = (
    "coalesce(sum(vr), 0)::DOUBLE AS receita_total, "
    "coalesce(sum(vr) FILTER (WHERE financeira), 0)::DOUBLE AS receita_financeira, "
    "coalesce(sum(vr) FILTER (WHERE NOT financeira), 0)::DOUBLE AS receita_estimavel, "
    "coalesce(sum(vr) FILTER (WHERE repasse), 0)::DOUBLE AS receita_repasses_candidatos, "
    + ", ".join(f"coalesce(sum(vr) FILTER (WHERE categoria = '{c}'), 0)::DOUBLE AS receita_{c}" for c in CATS)
)
HHI = " + ".join(f"power(receita_{c} / nullif(receita_total, 0), 2)" for c in CATS)
SHARES = f"""round(receita_total - receita_repasses_candidatos, 2) + 0.0 AS receita_sem_repasses,
  round(100.0 * (receita_fefc + receita_fundo_partidario) / nullif(receita_total, 0), 6) + 0.0 AS pct_publico,
  round(100.0 * receita_recursos_proprios / nullif(receita_total, 0), 6) + 0.0 AS pct_autofinanciamento,
  round(100.0 * (receita_pessoa_fisica + receita_financiamento_coletivo) / nullif(receita_total, 0), 6) + 0.0 AS pct_pessoa_fisica,
  round(100.0 * receita_estimavel / nullif(receita_total, 0), 6) + 0.0 AS pct_estimavel,
  round({HHI}, 6) + 0.0 AS hhi_fontes, round(1 / ({HHI}), 6) + 0.0 AS n_efetivo_fontes"""
ROUNDED_SUMS = ", ".join(
    f"round({c}, 2) + 0.0 AS {c}"
    for c in ("receita_total", "receita_financeira", "receita_estimavel", "receita_repasses_candidatos",
              *[f"receita_{c}" for c in CATS])
)


def _summary_sql(key: str) -> str:
    prefix = f"{key}, " if key else ""
    group = "GROUP BY ALL" if key else ""
    return with_sql(
        REVENUE + f", s AS (SELECT {prefix}{SUMS} FROM classificadas {group})",
        f"SELECT {prefix}{ROUNDED_SUMS}, {SHARES} FROM s",
    )


ACCOUNTS = (
    EXPENSES
    + ","
    + REVENUE
    + """, contas AS (
  SELECT v.*, e.despesa_contratada, e.despesa_paga, r.receita_total, r.receita_financeira FROM
  (SELECT l_suppkey AS sq_candidato, CAST(sum(CASE WHEN l_suppkey % 11 <> 0 THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS votos
   FROM lineitem GROUP BY ALL) v
  LEFT JOIN (SELECT sq_candidato, sum(contratada)::DOUBLE AS despesa_contratada,
    coalesce(sum(paga) FILTER (WHERE sq_candidato % 5 <> 0), 0)::DOUBLE AS despesa_paga FROM despesas
    WHERE sq_candidato % 9 <> 0 GROUP BY ALL) e USING (sq_candidato)
  LEFT JOIN (SELECT sq_candidato, sum(vr)::DOUBLE AS receita_total, coalesce(sum(vr) FILTER (WHERE financeira), 0)::DOUBLE AS receita_financeira
    FROM receitas GROUP BY ALL) r USING (sq_candidato))
"""
)
FACTOR = "(SELECT coalesce(product(1 + variacao / 100) FILTER (WHERE mes > '1996-09' AND mes <= '1998-09'), 1) FROM serie)"

ORACLE = {
    "revenue_classified": with_sql(
        REVENUE,
        "SELECT ano, categoria, count(*) AS n, round(sum(vr)::DOUBLE, 2) + 0.0 AS valor FROM classificadas GROUP BY ALL",
    ),
    "revenue_summary": _summary_sql("sq_candidato"),
    "revenue_summary_year": _summary_sql("ano"),
    "revenue_grand_summary": _summary_sql(""),
    "group_revenue": with_sql(
        REVENUE
        + f""", m AS (SELECT c_custkey AS k FROM customer WHERE c_nationkey = 3),
        g AS (SELECT *, coalesce(repasse AND doador IN (SELECT k FROM m), false) AS interno FROM classificadas
          WHERE sq_candidato IN (SELECT k FROM m)),
        s AS (SELECT {SUMS} FROM g WHERE NOT interno)""",
        f"""SELECT round(receita_total, 2) + 0.0 AS receita_total, round(receita_total - receita_repasses_candidatos, 2) + 0.0 AS receita_sem_repasses,
        (SELECT round(coalesce(sum(vr), 0)::DOUBLE, 2) + 0.0 FROM g WHERE interno) AS receita_repasses_internos,
        (SELECT round(coalesce(sum(vr), 0)::DOUBLE, 2) + 0.0 FROM g WHERE repasse AND doador IS NULL) AS receita_repasses_doador_desconhecido,
        round(100.0 * (receita_fefc + receita_fundo_partidario) / nullif(receita_total, 0), 6) + 0.0 AS pct_publico,
        round({HHI}, 6) + 0.0 AS hhi_fontes FROM s""",
    ),
    "campaign_expense": with_sql(
        EXPENSES,
        "SELECT sq_candidato, round(sum(contratada)::DOUBLE, 2) + 0.0 AS despesa FROM despesas WHERE NOT repasse GROUP BY ALL",
    ),
    "campaign_expense_total": with_sql(
        EXPENSES, "SELECT ano, round(sum(paga)::DOUBLE, 2) + 0.0 AS despesa FROM despesas GROUP BY ALL"
    ),
    "expense_split": with_sql(
        EXPENSES,
        "SELECT sq_candidato, "
        + ", ".join(
            f"""round(coalesce(sum({c}) FILTER (WHERE NOT repasse), 0)::DOUBLE, 2) + 0.0 AS despesa_{c},
            round(coalesce(sum({c}) FILTER (WHERE repasse), 0)::DOUBLE, 2) + 0.0 AS despesa_{c}_repasses,
            round(sum({c})::DOUBLE, 2) + 0.0 AS despesa_{c}_com_repasses"""
            for c in ("contratada", "paga")
        )
        + " FROM despesas GROUP BY ALL",
    ),
    "cost_per_vote": with_sql(
        ACCOUNTS,
        """SELECT sq_candidato, votos, round(despesa_contratada, 2) + 0.0 AS despesa_contratada, round(despesa_paga, 2) + 0.0 AS despesa_paga,
        round(despesa_contratada / nullif(votos, 0), 6) + 0.0 AS custo_voto_contratado, round(despesa_paga / nullif(votos, 0), 6) + 0.0 AS custo_voto_pago,
        round(despesa_contratada - despesa_paga, 2) + 0.0 AS divida FROM contas""",
    ),
    "cost_per_vote_total": with_sql(
        ACCOUNTS,
        """SELECT round(sum(despesa_contratada::DECIMAL(18,4)) FILTER (WHERE votos > 0)::DOUBLE / sum(votos) FILTER (WHERE votos > 0 AND despesa_contratada IS NOT NULL), 6) + 0.0 AS custo_voto_contratado,
        round(sum(despesa_paga::DECIMAL(18,4)) FILTER (WHERE votos > 0)::DOUBLE / sum(votos) FILTER (WHERE votos > 0 AND despesa_contratada IS NOT NULL), 6) + 0.0 AS custo_voto_pago,
        count(*) FILTER (WHERE despesa_contratada IS NOT NULL AND votos <= 0) AS candidatos_sem_voto_excluidos,
        count(*) FILTER (WHERE despesa_contratada IS NULL) AS candidatos_sem_contas_excluidos,
        round(median(despesa_contratada / votos) FILTER (WHERE votos > 0), 6) + 0.0 AS mediana_custo_voto_contratado FROM contas""",
    ),
    "median_cost": with_sql(
        ACCOUNTS,
        "SELECT round(median(despesa_contratada / votos), 6) + 0.0 AS mediana FROM contas WHERE despesa_contratada > 0 AND votos > 0",
    ),
    "revenue_per_vote": with_sql(
        ACCOUNTS,
        "SELECT sq_candidato, votos, round(receita_total, 2) + 0.0 AS receita_total, round(receita_total / nullif(votos, 0), 6) + 0.0 AS receita_por_voto FROM contas",
    ),
    "revenue_per_vote_total": with_sql(
        ACCOUNTS,
        """SELECT round(sum(receita_total::DECIMAL(18,4)) FILTER (WHERE votos > 0)::DOUBLE / sum(votos) FILTER (WHERE votos > 0 AND receita_total IS NOT NULL), 6) + 0.0 AS receita_por_voto,
        count(*) FILTER (WHERE receita_total IS NOT NULL AND votos <= 0) AS candidatos_sem_voto_excluidos,
        count(*) FILTER (WHERE receita_total IS NULL) AS candidatos_sem_contas_excluidos,
        round(median(receita_total / votos) FILTER (WHERE votos > 0), 6) + 0.0 AS mediana_receita_por_voto FROM contas""",
    ),
    "revenue_per_thousand": with_sql(
        REVENUE,
        """, a AS (SELECT CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS aptos FROM lineitem)
        SELECT ano, round(sum(vr)::DOUBLE, 2) + 0.0 AS receita_total, any_value(aptos) AS aptos,
        round(1000.0 * sum(vr)::DOUBLE / any_value(aptos), 6) + 0.0 AS receita_por_mil_aptos FROM receitas, a GROUP BY ano""",
    ),
    "revenue_distribution": with_sql(
        ACCOUNTS,
        """SELECT count(*) AS n_candidatos, count(receita_total) AS n_com_contas, round(sum(receita_total::DECIMAL(18,4))::DOUBLE, 2) + 0.0 AS soma,
        round(sum(receita_total::DECIMAL(18,4))::DOUBLE / count(receita_total), 2) + 0.0 AS media, round(median(receita_total), 2) + 0.0 AS mediana,
        round(quantile_cont(receita_total, 0.25), 2) + 0.0 AS p25, round(quantile_cont(receita_total, 0.75), 2) + 0.0 AS p75,
        round(max(receita_total), 2) + 0.0 AS maximo FROM contas""",
    ),
    "balance": with_sql(
        ACCOUNTS,
        """SELECT sq_candidato, votos, round(despesa_contratada, 2) + 0.0 AS despesa_contratada, round(despesa_paga, 2) + 0.0 AS despesa_paga,
        round(receita_total, 2) + 0.0 AS receita_total, round(receita_financeira, 2) + 0.0 AS receita_financeira,
        round(receita_total - despesa_contratada, 2) + 0.0 AS saldo_contratado, round(receita_financeira - despesa_paga, 2) + 0.0 AS saldo_financeiro,
        round(100.0 * despesa_contratada / nullif(receita_total, 0), 6) + 0.0 AS pct_receita_gasta FROM contas""",
    ),
    "spending_alert": with_sql(
        ACCOUNTS,
        """, z AS (SELECT *, despesa_contratada / nullif(receita_financeira, 0) AS c,
          CASE WHEN despesa_contratada IS NOT NULL THEN despesa_paga / nullif(receita_financeira, 0) END AS p FROM contas)
        SELECT sq_candidato, round(c, 6) + 0.0 AS razao_gasto_contratada, round(p, 6) + 0.0 AS razao_gasto_paga,
        CASE WHEN c IS NOT NULL THEN c < 0.70 OR c > 1.10 END AS alerta_declaracao,
        CASE WHEN c < 0.70 THEN 'abaixo' WHEN c > 1.10 THEN 'acima' END AS sentido_alerta FROM z""",
    ),
    "scatter_points": with_sql(
        ACCOUNTS,
        """SELECT sq_candidato, round(receita_total / votos, 6) + 0.0 AS x, round(despesa_contratada / votos, 6) + 0.0 AS y,
        round(100.0 * despesa_contratada / receita_total, 6) + 0.0 AS despesa_sobre_receita
        FROM contas WHERE votos > 0 AND receita_total > 0 AND despesa_contratada > 0""",
    ),
    "scatter_missing": with_sql(
        ACCOUNTS,
        "SELECT count(*) FILTER (WHERE NOT coalesce(votos > 0 AND receita_total > 0 AND despesa_paga > 0, false)) AS sem_dados FROM contas",
    ),
    "accounts_status": """SELECT CAST(year(o_orderdate) AS INTEGER) AS ano,
        CASE WHEN avg(CASE WHEN o_orderkey % (year(o_orderdate) - 1985) = 0 THEN 0 ELSE 1 END) >= 0.95 THEN 'FINAL' ELSE 'PARCIAL' END AS situacao
        FROM orders GROUP BY 1""",
    "ledger": """SELECT CAST(year(o_orderdate) AS INTEGER) AS ano, o_custkey AS sq_candidato,
        ['Fundo Especial', 'Fundo Partidário', 'Outros Recursos', 'outros  recursos', 'OUTROS RECURSOS'][CAST((o_orderkey // 3) % 5 + 1 AS INTEGER)] AS ds_fonte_receita,
        ['Financeiro', 'Estimável', 'FINANCEIRO'][CAST((o_orderkey // 7) % 3 + 1 AS INTEGER)] AS ds_natureza_receita,
        round(sum(CAST(o_totalprice AS DECIMAL(18,4)))::DOUBLE, 2) + 0.0 AS vr_receita, CAST(count(*) AS INTEGER) AS qt_lancamentos,
        max(CAST(o_orderdate AS DATE)) AS dt_geracao FROM orders GROUP BY 1, 2, 3, 4""",
    "expense_ledger": with_sql(
        EXPENSES,
        """, e AS (SELECT *, ['Serviços prestados por terceiros', 'Doações financeiras a outros candidatos/partidos', NULL,
          'Despesas com pessoal'][CAST(rotulo + 1 AS INTEGER)] AS o FROM despesas),
        c AS (SELECT ano, sq_candidato, o, sum(contratada)::DOUBLE AS v FROM e WHERE ano < 1999 GROUP BY ALL),
        p AS (SELECT ano, sq_candidato, o, sum(paga)::DOUBLE AS v FROM e WHERE ano > 1996 GROUP BY ALL)
        SELECT coalesce(c.ano, p.ano) AS ano, coalesce(c.sq_candidato, p.sq_candidato) AS sq_candidato, coalesce(c.o, p.o) AS ds_origem_despesa,
        round(coalesce(c.v, 0), 2) + 0.0 AS vr_despesa_contratada, round(coalesce(p.v, 0), 2) + 0.0 AS vr_despesa_paga
        FROM c FULL JOIN p ON c.ano = p.ano AND c.sq_candidato = p.sq_candidato AND c.o IS NOT DISTINCT FROM p.o""",
    ),
    "movement_filter": """SELECT CAST(year(o_orderdate) AS INTEGER) AS ano, o_custkey AS sq_candidato,
        CASE WHEN o_custkey % 4 = 0 THEN 0.0::DOUBLE ELSE round(o_totalprice, 2) + 0.0 END AS vr_receita FROM orders
        WHERE NOT (o_custkey % 6 = 0 AND (o_custkey % 4 = 0 OR o_totalprice = 0))""",
    "price_index": with_sql(
        PRICES,
        """SELECT mes, round(variacao, 6) + 0.0 AS variacao,
        round(100 * exp(sum(ln(1 + variacao / 100)) OVER (ORDER BY mes)), 6) + 0.0 AS indice FROM serie""",
    ),
    "price_factor": with_sql(
        PRICES,
        """, b AS (SELECT least('2026-09', max(mes)) AS mes_base FROM serie WHERE mes > '1996-09')
        SELECT round(product(1 + variacao / 100), 9) + 0.0 AS fator, any_value(mes_base) AS mes_base FROM serie, b
        WHERE mes > '1996-09' AND mes <= mes_base""",
    ),
    "deflated": with_sql(
        REVENUE + "," + PRICES,
        f"SELECT ano, round(sum(vr)::DOUBLE * {FACTOR}, 2) + 0.0 AS receita_total FROM receitas GROUP BY ano",
    ),
    "compare_revenue": with_sql(
        REVENUE + "," + PRICES,
        f""", s AS (SELECT sq_candidato, ano, sum(vr)::DOUBLE AS t, coalesce(sum(vr) FILTER (WHERE categoria = 'fefc'), 0)::DOUBLE AS f,
          100.0 * coalesce(sum(vr) FILTER (WHERE categoria IN ('fefc', 'fundo_partidario')), 0)::DOUBLE / nullif(sum(vr)::DOUBLE, 0) AS p
          FROM classificadas WHERE ano IN (1996, 1998) GROUP BY ALL),
        w AS (SELECT sq_candidato, max(t) FILTER (WHERE ano = 1996) * {FACTOR} AS ta, max(t) FILTER (WHERE ano = 1998) AS tb,
          max(f) FILTER (WHERE ano = 1996) * {FACTOR} AS fa, max(f) FILTER (WHERE ano = 1998) AS fb,
          max(p) FILTER (WHERE ano = 1996) AS pa, max(p) FILTER (WHERE ano = 1998) AS pb FROM s GROUP BY ALL)
        SELECT sq_candidato, round(ta, 4) + 0.0 AS receita_total_2022, round(tb, 4) + 0.0 AS receita_total_2026,
        round(fa, 4) + 0.0 AS receita_fefc_2022, round(fb, 4) + 0.0 AS receita_fefc_2026,
        round(pa, 4) + 0.0 AS pct_publico_2022, round(pb, 4) + 0.0 AS pct_publico_2026,
        round(tb - ta, 4) + 0.0 AS delta_receita_total, round(fb - fa, 4) + 0.0 AS delta_receita_fefc, round(pb - pa, 4) + 0.0 AS delta_pct_publico,
        round(100.0 * (tb / nullif(ta, 0) - 1), 4) + 0.0 AS var_pct_receita_total,
        round(100.0 * (fb / nullif(fa, 0) - 1), 4) + 0.0 AS var_pct_receita_fefc FROM w""",
    ),
    "stacked_revenue": with_sql(
        REVENUE,
        f"""SELECT CAST(i - 1 AS INTEGER) AS ordem, c AS categoria,
        (SELECT round(coalesce(sum(vr), 0)::DOUBLE, 2) + 0.0 FROM classificadas WHERE categoria = c) AS valor
        FROM (SELECT unnest({list(CATS)}) AS c, unnest(range(1, {len(CATS) + 1})) AS i)""",
    ),
}
