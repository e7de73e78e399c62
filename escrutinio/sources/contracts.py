"""Table contracts: what each column of a table is called, holds and must satisfy.

A contract is its list of columns; the key, the required columns and the ranges are read off the flags
of the columns. Names, types, keys and bounds are fixed values: they are the layout of the official
files and of the tables made from them.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = {
    "string": T.StringType(), "boolean": T.BooleanType(), "tinyint": T.ByteType(), "smallint": T.ShortType(),
    "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "date": T.DateType(), "timestamp": T.TimestampType(),
    "timestamp_ntz": T.TimestampNTZType(),
}


class ContractViolation(ValueError):
    """The data does not follow its contract and must not be published."""


class Column(NamedTuple):
    """A column. `key` is its place in the key, from 1 on; `source` its name in the official file.

    `low` and `high` bound its values, both ends included. A derived column is made, not read.
    """

    name: str
    type: str
    key: int = 0
    required: bool = False
    derived: bool = False
    low: float | None = None
    high: float | None = None
    source: str | None = None


class Contract(NamedTuple):
    """A table by its name and its columns in order."""

    name: str
    fields: tuple[Column, ...]

    @property
    def key(self) -> list[str]:
        return [c.name for c in sorted(self.fields, key=lambda c: c.key) if c.key]

    @property
    def required(self) -> list[str]:
        return [c.name for c in self.fields if c.required]

    @property
    def ranges(self) -> dict[str, tuple[float, float]]:
        return {c.name: (c.low, c.high) for c in self.fields if c.low is not None}

    @property
    def columns(self) -> list[str]:
        return [c.name for c in self.fields]

    @property
    def read_columns(self) -> list[str]:
        return [c.name for c in self.fields if not c.derived]

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, KINDS[c.type]) for c in self.fields])

    def source_name(self, name: str) -> str:
        """Name of a column in the official file: the stated one, or its own in upper case."""
        return next(c.source for c in self.fields if c.name == name) or name.upper()


# The layout of every table.
TABLES = (
    Contract("municipio_tse_ibge", (
        Column("cd_uf_ibge", "tinyint"),
        Column("sg_uf", "string", required=True),
        Column("cd_municipio_tse", "int", key=1, required=True),
        Column("nm_municipio_tse", "string"),
        Column("cd_mun_ibge", "int", required=True, source="CD_MUNICIPIO_IBGE"),
        Column("nm_municipio_ibge", "string"),
        Column("dt_geracao", "date"),
    )),
    Contract("consulta_cand", (
        Column("ano_eleicao", "smallint", key=1, required=True),
        Column("nr_turno", "tinyint", key=3, required=True),
        Column("cd_eleicao", "int", key=2, required=True),
        Column("sg_uf", "string", required=True),
        Column("sg_ue", "string"),
        Column("nm_ue", "string"),
        Column("cd_cargo", "tinyint", required=True),
        Column("ds_cargo", "string"),
        Column("sq_candidato", "bigint", key=4, required=True),
        Column("nr_candidato", "int"),
        Column("nm_candidato", "string"),
        Column("nm_urna_candidato", "string"),
        Column("cd_situacao_candidatura", "tinyint"),
        Column("ds_situacao_candidatura", "string"),
        Column("tp_agremiacao", "string"),
        Column("nr_partido", "smallint", required=True),
        Column("sg_partido", "string"),
        Column("nm_partido", "string"),
        Column("nr_federacao", "smallint"),
        Column("sg_federacao", "string"),
        Column("sq_coligacao", "bigint"),
        Column("dt_nascimento", "date"),
        Column("ds_genero", "string"),
        Column("ds_grau_instrucao", "string"),
        Column("ds_cor_raca", "string"),
        Column("ds_ocupacao", "string"),
        Column("cd_sit_tot_turno", "tinyint"),
        Column("ds_sit_tot_turno", "string"),
        Column("pessoa_id", "string", derived=True),
        Column("foi_as_urnas", "boolean", required=True, derived=True),
        Column("dt_geracao", "date", required=True),
    )),
    Contract("votacao_candidato_munzona", (
        Column("ano_eleicao", "smallint", key=1, required=True),
        Column("nr_turno", "tinyint", key=3, required=True),
        Column("cd_eleicao", "int", key=2, required=True),
        Column("sg_uf", "string", key=4, required=True),
        Column("cd_municipio_tse", "int", key=5, required=True, source="CD_MUNICIPIO"),
        Column("cd_mun_ibge", "int", derived=True),
        Column("nr_zona", "smallint", key=6, required=True),
        Column("cd_cargo", "tinyint", key=7, required=True),
        Column("ds_cargo", "string"),
        Column("sq_candidato", "bigint", key=8, required=True),
        Column("nr_candidato", "int"),
        Column("nm_candidato", "string"),
        Column("nm_urna_candidato", "string"),
        Column("nr_partido", "smallint"),
        Column("sg_partido", "string"),
        Column("nr_federacao", "smallint"),
        Column("ds_situacao_candidatura", "string"),
        Column("ds_sit_tot_turno", "string"),
        Column("st_voto_em_transito", "string", key=9),
        Column("qt_votos_nominais", "bigint", required=True),
        Column("nm_tipo_destinacao_votos", "string"),
        Column("qt_votos_nominais_validos", "bigint"),
        Column("dt_geracao", "date", required=True),
    )),
    Contract("detalhe_votacao_munzona", (
        Column("ano_eleicao", "smallint", key=1, required=True),
        Column("nr_turno", "tinyint", key=3, required=True),
        Column("cd_eleicao", "int", key=2, required=True),
        Column("sg_uf", "string", key=4, required=True),
        Column("cd_municipio_tse", "int", key=5, required=True, source="CD_MUNICIPIO"),
        Column("cd_mun_ibge", "int", derived=True),
        Column("nr_zona", "smallint", key=6, required=True),
        Column("cd_cargo", "tinyint", key=7, required=True),
        Column("ds_cargo", "string"),
        Column("qt_aptos", "bigint", required=True),
        Column("qt_secoes_principais", "int"),
        Column("qt_secoes_agregadas", "int"),
        Column("qt_secoes_nao_instaladas", "int"),
        Column("qt_total_secoes", "int"),
        Column("qt_comparecimento", "bigint"),
        Column("qt_eleitores_secoes_nao_instaladas", "bigint"),
        Column("qt_abstencoes", "bigint"),
        Column("st_voto_em_transito", "string", key=8),
        Column("qt_votos", "bigint"),
        Column("qt_votos_concorrentes", "bigint"),
        Column("qt_total_votos_validos", "bigint"),
        Column("qt_votos_nominais_validos", "bigint"),
        Column("qt_total_votos_leg_validos", "bigint"),
        Column("qt_votos_leg_validos", "bigint"),
        Column("qt_votos_nom_convr_leg_validos", "bigint"),
        Column("qt_total_votos_anulados", "bigint"),
        Column("qt_votos_nominais_anulados", "bigint"),
        Column("qt_votos_legenda_anulados", "bigint"),
        Column("qt_total_votos_anul_subjud", "bigint"),
        Column("qt_votos_nominais_anul_subjud", "bigint"),
        Column("qt_votos_legenda_anul_subjud", "bigint"),
        Column("qt_votos_brancos", "bigint"),
        Column("qt_total_votos_nulos", "bigint"),
        Column("qt_votos_nulos", "bigint"),
        Column("qt_votos_nulos_tecnicos", "bigint"),
        Column("qt_votos_anulados_apu_sep", "bigint"),
        Column("dt_geracao", "date", required=True),
    )),
    Contract("votacao_partido_munzona", (
        Column("ano_eleicao", "smallint", key=1, required=True),
        Column("nr_turno", "tinyint", key=3, required=True),
        Column("cd_eleicao", "int", key=2, required=True),
        Column("sg_uf", "string", key=4, required=True),
        Column("cd_municipio_tse", "int", key=5, required=True, source="CD_MUNICIPIO"),
        Column("cd_mun_ibge", "int", derived=True),
        Column("nr_zona", "smallint", key=6, required=True),
        Column("cd_cargo", "tinyint", key=7, required=True),
        Column("ds_cargo", "string"),
        Column("tp_agremiacao", "string"),
        Column("nr_partido", "smallint", key=8, required=True),
        Column("sg_partido", "string"),
        Column("nr_federacao", "smallint"),
        Column("sg_federacao", "string"),
        Column("sq_coligacao", "bigint", key=9),
        Column("st_voto_em_transito", "string", key=10),
        Column("qt_votos_legenda_validos", "bigint"),
        Column("qt_votos_nom_convr_leg_validos", "bigint"),
        Column("qt_total_votos_leg_validos", "bigint"),
        Column("qt_votos_nominais_validos", "bigint"),
        Column("qt_votos_legenda_anul_subjud", "bigint"),
        Column("qt_votos_nominais_anul_subjud", "bigint"),
        Column("qt_votos_legenda_anulados", "bigint"),
        Column("qt_votos_nominais_anulados", "bigint"),
        Column("dt_geracao", "date", required=True),
    )),
    Contract("consulta_vagas", (
        Column("ano_eleicao", "smallint", key=1, required=True),
        Column("cd_eleicao", "int", key=2, required=True),
        Column("sg_uf", "string"),
        Column("sg_ue", "string", key=3, required=True),
        Column("cd_cargo", "tinyint", key=4, required=True),
        Column("ds_cargo", "string"),
        Column("qt_vaga", "int", required=True),
        Column("dt_posse", "date"),
        Column("dt_geracao", "date", required=True),
    )),
    Contract("eleitorado_local_votacao", (
        Column("aa_eleicao", "smallint", key=1, required=True),
        Column("nr_turno", "tinyint", key=2, required=True),
        Column("sg_uf", "string", key=3, required=True),
        Column("cd_municipio_tse", "int", key=4, required=True, source="CD_MUNICIPIO"),
        Column("cd_mun_ibge", "int", derived=True),
        Column("nr_zona", "smallint", key=5, required=True),
        Column("nr_local_votacao", "int", key=6, required=True),
        Column("nm_local_votacao", "string"),
        Column("ds_endereco", "string"),
        Column("nm_bairro", "string"),
        Column("nr_latitude", "double", low=-35.0, high=6.0),
        Column("nr_longitude", "double", low=-75.0, high=-28.0),
        Column("qt_secoes", "int", derived=True),
        Column("qt_eleitor_secao", "bigint"),
        Column("dt_geracao", "date"),
    )),
    Contract("votacao_secao", (
        Column("ano_eleicao", "smallint"),
        Column("nr_turno", "tinyint"),
        Column("sg_uf", "string"),
        Column("cd_municipio_tse", "int", source="CD_MUNICIPIO"),
        Column("nr_zona", "smallint"),
        Column("cd_cargo", "tinyint"),
        Column("nr_votavel", "int"),
        Column("qt_votos", "bigint"),
        Column("nr_local_votacao", "int"),
        Column("sq_candidato", "bigint"),
        Column("dt_geracao", "date"),
    )),
    Contract("votos_local", (
        Column("ano_eleicao", "smallint", required=True),
        Column("nr_turno", "tinyint", key=1, required=True, low=1.0, high=1.0),
        Column("sg_uf", "string", key=2, required=True),
        Column("cd_municipio_tse", "int", key=3, required=True, source="CD_MUNICIPIO"),
        Column("cd_mun_ibge", "int", derived=True),
        Column("nr_zona", "smallint", key=4, required=True),
        Column("nr_local", "int", key=5, required=True),
        Column("cd_cargo", "tinyint", key=6, required=True),
        Column("sq_candidato", "bigint", key=7, required=True),
        Column("votos", "bigint", required=True),
        Column("dt_geracao", "date", required=True),
    )),
    Contract("totais_local", (
        Column("ano_eleicao", "smallint", required=True),
        Column("nr_turno", "tinyint", key=1, required=True, low=1.0, high=1.0),
        Column("sg_uf", "string", key=2, required=True),
        Column("cd_municipio_tse", "int", key=3, required=True, source="CD_MUNICIPIO"),
        Column("cd_mun_ibge", "int", derived=True),
        Column("nr_zona", "smallint", key=4, required=True),
        Column("nr_local", "int", key=5, required=True),
        Column("cd_cargo", "tinyint", key=6, required=True),
        Column("votos_nominais", "bigint", required=True),
        Column("votos_legenda", "bigint", required=True),
        Column("votos_brancos", "bigint", required=True),
        Column("votos_nulos", "bigint", required=True),
        Column("dt_geracao", "date", required=True),
    )),
    Contract("locais_h3", (
        Column("ano_eleicao", "smallint", required=True),
        Column("nr_turno", "tinyint", key=1, required=True, low=1.0, high=1.0),
        Column("sg_uf", "string", key=2, required=True),
        Column("cd_municipio_tse", "int", key=3, required=True),
        Column("cd_mun_ibge", "int", derived=True),
        Column("nr_zona", "smallint", key=4, required=True),
        Column("nr_local", "int", key=5, required=True),
        Column("lat", "double", required=True, low=-35.0, high=6.0),
        Column("lon", "double", required=True, low=-75.0, high=-28.0),
        Column("h3", "string", required=True),
        Column("h3_r7", "string", required=True),
        Column("h3_r6", "string", required=True),
        Column("aptos", "bigint", required=True),
        Column("dt_geracao", "date"),
    )),
    Contract("receitas_candidatos", (
        Column("ano_eleicao", "smallint", key=1, required=True, source="AA_ELEICAO"),
        Column("nr_turno", "tinyint", key=3, required=True, source="ST_TURNO"),
        Column("cd_eleicao", "int", key=2, required=True),
        Column("sg_uf", "string", key=4, required=True),
        Column("sq_prestador_contas", "bigint", key=5, required=True),
        Column("tp_prestacao_contas", "string", key=6),
        Column("dt_prestacao_contas", "date", key=7),
        Column("sq_candidato", "bigint", required=True),
        Column("cd_cargo", "tinyint"),
        Column("nr_partido", "smallint"),
        Column("sg_partido", "string"),
        Column("ds_fonte_receita", "string", key=8),
        Column("ds_origem_receita", "string", key=9),
        Column("ds_natureza_receita", "string", key=10),
        Column("vr_receita", "double", required=True),
        Column("qt_lancamentos", "int", required=True, derived=True),
        Column("dt_geracao", "date", required=True),
    )),
    Contract("despesas_contratadas_candidatos", (
        Column("ano_eleicao", "smallint", key=1, required=True, source="AA_ELEICAO"),
        Column("nr_turno", "tinyint", key=3, required=True, source="ST_TURNO"),
        Column("cd_eleicao", "int", key=2, required=True),
        Column("sg_uf", "string", key=4, required=True),
        Column("sq_prestador_contas", "bigint", key=5, required=True),
        Column("tp_prestacao_contas", "string", key=6),
        Column("dt_prestacao_contas", "date", key=7),
        Column("sq_candidato", "bigint", required=True),
        Column("cd_cargo", "tinyint"),
        Column("nr_partido", "smallint"),
        Column("sg_partido", "string"),
        Column("ds_origem_despesa", "string", key=8),
        Column("vr_despesa_contratada", "double", required=True),
        Column("qt_lancamentos", "int", required=True, derived=True),
        Column("dt_geracao", "date", required=True),
    )),
    Contract("despesas_pagas_candidatos", (
        Column("ano_eleicao", "smallint", key=1, required=True, source="AA_ELEICAO"),
        Column("nr_turno", "tinyint", key=3, required=True, source="ST_TURNO"),
        Column("cd_eleicao", "int", key=2, required=True),
        Column("sg_uf", "string", key=4, required=True),
        Column("sq_prestador_contas", "bigint", key=5, required=True),
        Column("tp_prestacao_contas", "string", key=6),
        Column("dt_prestacao_contas", "date", key=7),
        Column("sq_candidato", "bigint", required=True, derived=True),
        Column("ds_fonte_despesa", "string", key=8),
        Column("ds_origem_despesa", "string", key=9),
        Column("vr_pagto_despesa", "double", required=True),
        Column("qt_lancamentos", "int", required=True, derived=True),
        Column("dt_geracao", "date", required=True),
    )),
    Contract("ipca", (
        Column("mes", "string", key=1, required=True),
        Column("variacao", "double", required=True),
        Column("indice", "double", required=True),
    )),
    Contract("municipios", (
        Column("cd_mun_ibge", "int", key=1, required=True),
        Column("cd_mun_tse", "int", required=True),
        Column("sg_uf", "string", required=True),
        Column("nm_municipio", "string", required=True),
        Column("area_km2", "double", required=True, derived=True, low=0.0, high=2000000.0),
        Column("cd_amc", "int", required=True, derived=True),
    )),
    Contract("redes_candidatos", (
        Column("ano_eleicao", "smallint", key=1, required=True),
        Column("sq_candidato", "bigint", key=2, required=True),
        Column("rede", "string", key=3, required=True, derived=True),
        Column("username", "string", key=4, required=True, derived=True),
        Column("url_tse", "string", required=True),
        Column("nr_ordem", "int", required=True),
        Column("principal", "boolean", required=True, derived=True),
        Column("dt_geracao", "date"),
    )),
    Contract("redes_perfis", (
        Column("sq_candidato", "bigint", key=1, required=True),
        Column("ano_eleicao", "smallint", key=2, required=True),
        Column("rede", "string", key=3, required=True),
        Column("username", "string", key=4, required=True),
        Column("status", "string", required=True),
        Column("followers_count", "bigint", low=0.0, high=10000000000.0),
        Column("follows_count", "bigint", low=0.0, high=10000000000.0),
        Column("media_count", "bigint", low=0.0, high=100000000.0),
        Column("coletado_em", "timestamp", key=5, required=True),
    )),
    Contract("redes_posts", (
        Column("username", "string", key=1, required=True),
        Column("media_id", "string", key=2, required=True),
        Column("timestamp", "timestamp", required=True),
        Column("media_type", "string", required=True),
        Column("media_product_type", "string"),
        Column("like_count", "bigint", low=0.0, high=10000000000.0),
        Column("comments_count", "bigint", low=0.0, high=10000000000.0),
        Column("permalink", "string"),
        Column("coletado_em", "timestamp", required=True),
    )),
)

CONTRACTS: dict[str, Contract] = {c.name: c for c in TABLES}


def check_schema(df: DataFrame, contract: Contract) -> None:
    """DQ-01, schema half: same columns (order aside) and exact types. No job runs."""
    expected = {f.name: f.dataType for f in contract.schema.fields}
    actual = {f.name: f.dataType for f in df.schema.fields}
    if set(expected) != set(actual):
        missing, extra = sorted(set(expected) - set(actual)), sorted(set(actual) - set(expected))
        raise ContractViolation(f"{contract.name}: missing {missing}, unexpected {extra}")
    for name, kind in expected.items():
        if actual[name] != kind:
            raise ContractViolation(
                f"{contract.name}: {name} is {actual[name].simpleString()}, "
                f"expected {kind.simpleString()}"
            )


def contract_findings(df: DataFrame, contract: Contract) -> DataFrame:
    """DQ-01, data half: one row per rule with its number of offences, from two aggregates.

    Nulls and ranges share one aggregate. Repeated keys come from a grouped count, which unlike a
    distinct count also sees rows with a null key part.
    """
    offences = {f"nulo:{c}": F.count_if(F.col(c).isNull()) for c in contract.required}
    for c, (low, high) in contract.ranges.items():
        offences[f"faixa:{c}"] = F.count_if(~F.col(c).between(low, high))
    found = df.agg(
        F.count(F.lit(1)).alias("linhas"),
        *[e.cast("bigint").alias(f"r{i}") for i, e in enumerate(offences.values())],
    )
    rules = [F.struct(F.lit("linhas").alias("regra"), F.col("linhas").alias("ocorrencias"))]
    rules += [
        F.struct(F.lit(name).alias("regra"), F.col(f"r{i}").alias("ocorrencias"))
        for i, name in enumerate(offences)
    ]
    out = found.select(F.inline(F.array(*rules)))
    if contract.key:
        repeated = (
            df.groupBy(*contract.key)
            .agg(F.count(F.lit(1)).alias("n"))
            .agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("ocorrencias"))
            .select(F.lit("chave_repetida").alias("regra"), "ocorrencias")
        )
        out = out.unionByName(repeated)
    return out


def validate(df: DataFrame, contract: Contract) -> None:
    """DQ-01. Raise `ContractViolation` when the data breaks a rule; only counts reach the driver."""
    check_schema(df, contract)
    rows = contract_findings(df, contract).filter("regra <> 'linhas' AND ocorrencias > 0")
    broken = [f"{r.regra} ({r.ocorrencias})" for r in rows.collect()]
    if broken:
        raise ContractViolation(f"{contract.name}: {', '.join(sorted(broken))}")
