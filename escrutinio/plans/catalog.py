"""Base views over the published tables, and the dimensions drawn from them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from escrutinio.functions.checks import require_columns
from escrutinio.functions.identity import public_id
from escrutinio.operators.finance import expense_ledger, has_movement
from escrutinio.sources.text_files import read_partitioned


def candidates_view(candidates: DataFrame) -> DataFrame:
    """FIL-03. First-round candidacies with upper-case office and the public person id."""
    require_columns(
        candidates,
        ["ano", "nr_turno", "sg_uf", "ds_cargo", "sq_candidato", "nm_urna_candidato", "pessoa_id"],
        "candidates_view",
    )
    return candidates.filter(F.col("nr_turno") == 1).select(
        "ano", "sq_candidato", "pessoa_id", F.col("nm_urna_candidato").alias("nm_urna"), "sg_uf",
        F.upper("ds_cargo").alias("ds_cargo"), "nr_partido", "sg_partido",
        "ds_situacao_candidatura", "ds_sit_tot_turno", "nr_candidato",
        F.col("nm_candidato").alias("nm_civil"), "foi_as_urnas",
        public_id(F.col("pessoa_id")).alias("pessoa_pub"),
    )


def votes_by_zone(votes: DataFrame) -> DataFrame:
    """AGG-03. First-round valid nominal votes by municipality and zone."""
    return (
        votes.filter(F.col("nr_turno") == 1)
        .groupBy("ano", "sq_candidato", "sg_uf", "cd_mun_ibge", "nr_zona")
        .agg(F.sum("qt_votos_nominais_validos").alias("votos"))
    )


def electorate_by_zone(detail: DataFrame) -> DataFrame:
    """AGG-04. First-round electors and valid votes by office, municipality and zone."""
    return (
        detail.filter(F.col("nr_turno") == 1)
        .groupBy("ano", "sg_uf", F.upper("ds_cargo").alias("ds_cargo"), "cd_mun_ibge", "nr_zona")
        .agg(F.sum("qt_aptos").alias("aptos"), F.sum("qt_total_votos_validos").alias("votos_validos"))
    )


def municipalities_view(crosswalk: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """JOI-13. Municipalities with comparable area and size; without `extra` an area is itself."""
    base = crosswalk.select(
        "cd_mun_ibge", F.col("nm_municipio_ibge").alias("nome"), F.col("sg_uf").alias("uf")
    ).distinct()
    if extra is None:
        return base.select(
            "cd_mun_ibge", F.col("cd_mun_ibge").alias("cd_amc"), "nome", "uf",
            F.lit(None).cast("double").alias("area_km2"),
        )
    sizes = extra.select("cd_mun_ibge", F.col("cd_amc").alias("_a"), "area_km2")
    return base.join(sizes, "cd_mun_ibge", "left").select(
        "cd_mun_ibge", F.coalesce("_a", "cd_mun_ibge").alias("cd_amc"), "nome", "uf", "area_km2"
    )


def places_view(places: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """First-round polling places with their cell when there is one."""
    base = places.filter(F.col("nr_turno") == 1).select(
        "ano", "sg_uf", "cd_mun_ibge", "nr_zona", F.col("nr_local_votacao").alias("nr_local"),
        F.col("nr_latitude").alias("lat"), F.col("nr_longitude").alias("lon"),
        F.col("qt_eleitor_secao").alias("aptos"),
    )
    if cells is None:
        return base.withColumn("h3", F.lit(None).cast("string"))
    key = ["ano", "cd_mun_ibge", "nr_zona", "nr_local"]
    return base.join(cells.select(*key, "h3"), key, "left")


def revenue_view(revenue: DataFrame) -> DataFrame:
    """Revenue entries of both rounds, without "no movement" rows; a missing donor column is null."""
    donor = "sq_candidato_doador"
    rows = revenue if donor in revenue.columns else revenue.withColumn(donor, F.lit(None).cast("bigint"))
    return rows.filter(has_movement("vr_receita", "ds_fonte_receita", "ds_origem_receita")).select(
        "ano", "sq_candidato", "ds_fonte_receita", "ds_origem_receita", "ds_natureza_receita",
        "vr_receita", donor,
    )


def years(candidates: DataFrame) -> DataFrame:
    """AGG-33."""
    return candidates.select("ano").distinct()


def dimension(candidates: DataFrame, column: str) -> DataFrame:
    """AGG-33. Distinct values of a column (years, states, offices)."""
    return candidates.select(column).distinct()


def dimensions(candidates: DataFrame) -> DataFrame:
    """QRY-12. Years, states and offices as (`dimensao`, `valor`), in one pass."""
    pairs = F.array(
        *[
            F.struct(F.lit(d).alias("dimensao"), F.col(c).cast("string").alias("valor"))
            for d, c in (("ano", "ano"), ("uf", "sg_uf"), ("cargo", "ds_cargo"))
        ]
    )
    return candidates.select(F.inline(pairs)).distinct()


def data_version(tables: Sequence[DataFrame], readings: DataFrame | None = None) -> DataFrame:
    """AGG-32. One row: newest file date over the tables, and the version with the last reading."""
    newest = reduce(
        lambda a, b: a.unionByName(b),
        [t.agg(F.max("dt_geracao").cast("date").alias("dt_geracao")) for t in tables],
    ).agg(F.max("dt_geracao").alias("dt_geracao"))
    if readings is None:
        return newest.withColumn("versao", F.col("dt_geracao").cast("string"))
    last = readings.agg(F.max("coletado_em").alias("c")).scalar()
    return newest.withColumn(
        "versao", F.concat_ws("+", F.col("dt_geracao").cast("string"), last.cast("string"))
    )


def with_provenance(df: DataFrame, dataset: str, provenance: DataFrame) -> DataFrame:
    """QRY-21. Every row names its dataset, the newest file date and the rule applied."""
    row = provenance.filter(F.col("conjunto") == dataset).agg(
        F.struct(F.max("dt_geracao").alias("dt_geracao"), F.max("regra").alias("regra")).alias("p")
    )
    return df.withColumn("_p", row.scalar()).select(
        *df.columns, F.lit(dataset).alias("fonte"), F.col("_p.dt_geracao").alias("fonte_dt_geracao"),
        F.col("_p.regra").alias("fonte_regra"),
    )


@dataclass(frozen=True)
class Catalog:
    """Views over a folder of published tables, `<root>/<table>/ano=YYYY/*.parquet`."""

    spark: SparkSession
    root: str

    def table(self, name: str) -> DataFrame:
        return read_partitioned(self.spark, f"{self.root}/{name}")

    def candidates(self) -> DataFrame:
        return candidates_view(self.table("consulta_cand"))

    def votes(self) -> DataFrame:
        return votes_by_zone(self.table("votacao_candidato_munzona"))

    def electorate(self) -> DataFrame:
        return electorate_by_zone(self.table("detalhe_votacao_munzona"))

    def municipalities(self) -> DataFrame:
        return municipalities_view(
            self.table("municipio_tse_ibge"), self.spark.read.parquet(f"{self.root}/municipios")
        )

    def places(self) -> DataFrame:
        return places_view(self.table("eleitorado_local_votacao"), self.table("locais_h3"))

    def place_votes(self) -> DataFrame:
        return self.table("votos_local")

    def revenue(self) -> DataFrame:
        return revenue_view(self.table("receitas_candidatos"))

    def expenses(self) -> DataFrame:
        return expense_ledger(
            self.table("despesas_contratadas_candidatos"), self.table("despesas_pagas_candidatos")
        )

    def prices(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/ipca")

    def register(self) -> None:
        """Temp views for SQL users, under the names the base views are known by."""
        for name, view in (
            ("candidatos", self.candidates), ("votos_munzona", self.votes),
            ("eleitorado_munzona", self.electorate), ("municipios", self.municipalities),
            ("locais_votacao", self.places), ("votos_local", self.place_votes),
            ("receitas", self.revenue), ("despesas", self.expenses), ("ipca", self.prices),
        ):
            view().createOrReplaceTempView(name)
