"""Rows behind the screens: KPI lists, stacked revenue, bars, difference map."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from escrutinio.operators.finance import REVENUE_CATEGORIES
from escrutinio.operators.ordering import exact_quantiles
from escrutinio.functions.rates import ratio

# Column of a one-row summary -> label of its KPI.
REVENUE_KPIS = {
    "receita_total": "Receita total do grupo",
    "receita_por_voto": "Receita por voto",
    "pct_publico": "% recursos públicos",
    "pct_autofinanciamento": "% autofinanciamento",
    "pct_pessoa_fisica": "% pessoas físicas",
    "saldo_contratado": "Saldo da campanha",
}
SOCIAL_KPIS = {
    "seguidores_total": "Seguidores somados",
    "mediana_seguidores": "Mediana de seguidores",
    "mediana_posts_semana_campanha": "Posts por semana na campanha (mediana)",
    "mediana_pct_video": "Vídeos e reels (mediana)",
    "mediana_engajamento_mediano": "Engajamento por post (mediana)",
}


def kpi_rows(summary: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    """QRY-18. A one-row summary as (`ordem`, `chave`, `rotulo`, `valor`); nulls disappear."""
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("ordem"), F.lit(c).alias("chave"), F.lit(label).alias("rotulo"),
                F.col(c).cast("double").alias("valor"),
            )
            for i, (c, label) in enumerate(labels.items())
        ]
    )
    return summary.select(F.inline(rows)).filter(F.col("valor").isNotNull())


def stacked_revenue(summary: DataFrame) -> DataFrame:
    """QRY-18. Revenue of a group by category, in display order."""
    return kpi_rows(summary, {f"receita_{c}": c for c in REVENUE_CATEGORIES}).select(
        "ordem", F.col("rotulo").alias("categoria"), "valor"
    )


def difference_map(changes: DataFrame) -> DataFrame:
    """QRY-18. Areas with a defined change of penetration."""
    return changes.filter(F.col("delta_penetracao").isNotNull()).select("amc", "delta_penetracao")


def median_cost(accounts: DataFrame) -> DataFrame:
    """STA-12. Median of cost per vote where both are positive."""
    both = (F.col("despesa_contratada") > 0) & (F.col("votos") > 0)
    rows = accounts.filter(both).select(ratio(F.col("despesa_contratada"), F.col("votos")).alias("r"))
    return exact_quantiles(rows, [], "r", {"mediana": 0.5})
