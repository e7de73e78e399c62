"""Finances of candidates and groups from one pass over each ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from escrutinio.functions.rates import ratio
from escrutinio.operators.finance import (
    campaign_balance,
    cost_per_vote,
    deflate,
    expense_split,
    group_revenue,
    revenue_distribution,
    revenue_per_thousand,
    revenue_per_vote,
    revenue_summary,
    spending_alert,
    total_cost_per_vote,
    total_revenue_per_vote,
)
from escrutinio.operators.totals import money_sum
from escrutinio.session import cut_lineage

EXPENSES = ("vr_despesa_contratada", "vr_despesa_paga")


def candidate_accounts(
    members: DataFrame, votes: DataFrame, revenue: DataFrame, expenses: DataFrame,
    prices: DataFrame | None = None, origin: str | None = None, base: str | None = None,
) -> DataFrame:
    """QRY-07. One row per member that has entries: revenue, expense, cost, balance, alert.

    `members` has `sq_candidato` and the scope columns to carry. A member with entries but only
    transfers has expense zero; one without any entry is left out, as absence is not zero. With a
    price series the money of the year is brought to the base month.
    """
    ids = members.select("sq_candidato").distinct()
    mine_r = revenue.join(ids, "sq_candidato", "left_semi")
    mine_e = expenses.join(ids, "sq_candidato", "left_semi")
    revenue_rows = revenue_summary(mine_r)
    expense_rows = expense_split(mine_e, EXPENSES)
    summed_votes = votes.groupBy("sq_candidato").agg(F.sum("votos").alias("votos"))
    zero = F.lit(0.0)
    money = [c for c in expense_rows.columns if c != "sq_candidato"]
    joined = (
        members.join(revenue_rows, "sq_candidato", "left")
        .join(expense_rows, "sq_candidato", "left")
        .filter(F.col("receita_total").isNotNull() | F.col("despesa_contratada").isNotNull())
        .join(summed_votes, "sq_candidato", "left")
        .withColumns(
            {**{c: F.coalesce(c, zero) for c in money},
             "votos": F.coalesce("votos", F.lit(0).cast("bigint"))}
        )
    )
    if prices is not None:
        # Sums are exact in nominal cents; the factor is applied once to each sum.
        joined = deflate(joined, [*_money_columns(revenue_rows), *money], prices, origin, base)
    costed = revenue_per_vote(cost_per_vote(joined))
    # Balance and alert use the expense with transfers; the expense without them comes back after.
    own = {"despesa_contratada": "_contratada", "despesa_paga": "_paga"}
    whole = costed.withColumnsRenamed(own).withColumns(
        {name: F.col(f"{name}_com_repasses") for name in own}
    )
    judged = spending_alert(campaign_balance(whole)).withColumns(
        {name: F.col(kept) for name, kept in own.items()}
    )
    return judged.select(
        *costed.columns, "saldo_contratado", "saldo_financeiro", "pct_receita_gasta",
        "razao_gasto_contratada", "razao_gasto_paga", "alerta_declaracao", "sentido_alerta",
    )


def _money_columns(summary: DataFrame) -> list[str]:
    return [c for c in summary.columns if c.startswith("receita_")]


def group_accounts(
    members: DataFrame, votes: DataFrame, revenue: DataFrame, expenses: DataFrame,
    electors: DataFrame | None = None, **prices,
) -> DataFrame:
    """QRY-07. One row: cost, net revenue, distribution, balance of a group.

    `electors` is a one-row table with `aptos`: the electorate of the circumscriptions of the
    group, each counted once.
    """
    # Sums, two medians and the quartiles all read these rows: they are computed once.
    rows = cut_lineage(candidate_accounts(members, votes, revenue, expenses, **prices))
    net = group_revenue(revenue, members.select("sq_candidato"))
    if prices.get("prices") is not None:
        net = deflate(net, _money_columns(net), prices["prices"], prices["origin"], prices["base"])
    parts = [
        rows.agg(
            money_sum(F.col("despesa_contratada")).alias("despesa_contratada"),
            money_sum(F.col("despesa_paga")).alias("despesa_paga"),
            F.sum("votos").alias("votos"),
            money_sum(F.col("saldo_contratado")).alias("saldo_contratado"),
            money_sum(F.col("saldo_financeiro")).alias("saldo_financeiro"),
        ),
        total_cost_per_vote(rows).withColumnsRenamed(
            {"candidatos_sem_voto_excluidos": "custo_sem_voto", "candidatos_sem_contas_excluidos": "custo_sem_contas"}
        ),
        total_revenue_per_vote(rows),
        revenue_distribution(rows),
        net,
    ]
    first, others = parts[0], parts[1:]
    cells = [p.select(F.struct(*p.columns).alias("x")).scalar().alias(f"_x{i}") for i, p in enumerate(others)]
    out = first.select("*", *cells).select(
        *first.columns, *[F.col(f"_x{i}.{c}") for i, p in enumerate(others) for c in p.columns]
    )
    out = out.withColumns(
        {
            "receita_minima": F.col("receita_total") - F.col("receita_repasses_doador_desconhecido"),
            "receita_maxima": F.col("receita_total"),
        }
    )
    if electors is None:
        return out
    return revenue_per_thousand(out.withColumn("aptos", electors.scalar()))


def scatter_points(accounts: DataFrame, stage: str = "contratado") -> DataFrame:
    """STA-14. Rows with positive revenue and cost per vote, and the expense to revenue ratio."""
    expense = {"contratado": "despesa_contratada", "pago": "despesa_paga"}[stage]
    cost = F.col(f"custo_voto_{stage}")
    return accounts.filter(
        (F.col("receita_por_voto") > 0) & (cost > 0) & (F.col("receita_total") > 0)
    ).select(
        "sq_candidato", F.col("receita_por_voto").alias("x"), cost.alias("y"),
        (F.lit(100.0) * ratio(F.col(expense), F.col("receita_total"))).alias("despesa_sobre_receita"),
    )


def scatter_missing(accounts: DataFrame, stage: str = "contratado") -> DataFrame:
    """STA-14. How many candidates the scatter leaves out."""
    cost = F.col(f"custo_voto_{stage}")
    shown = (F.col("receita_por_voto") > 0) & (cost > 0) & (F.col("receita_total") > 0)
    return accounts.agg(F.count_if(~F.coalesce(shown, F.lit(False))).alias("sem_dados"))
