"""Star-schema tables in the roles of the election tables, as DataFrames and as SQL text.

supplier = candidacy (its nation = party), nation of a customer = municipality, region = state,
quantity = votes, return flag = destination of the vote, year of the order = election year,
order = revenue entry, discounted price = paid expense, events = profile readings and posts,
first components of an embedding = coordinates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from escrutinio.session import apply_defaults

YEAR_BEFORE, YEAR_AFTER = 1996, 1998
Case = Callable[[SparkSession, str], DataFrame]


# Layout of the tables: giving it saves a job that reads file footers for every table of a query.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder, in a session that has the planner defaults."""
    return apply_defaults(spark).read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def r6(value: Column | str) -> Column:
    """Rounded for a comparison by value; adding zero turns a negative zero positive."""
    return F.round(F.col(value) if isinstance(value, str) else value, 6) + F.lit(0.0)


def r2(value: Column | str) -> Column:
    return F.round(F.col(value) if isinstance(value, str) else value, 2) + F.lit(0.0)


def rounded(df: DataFrame, digits: int = 6, money: tuple[str, ...] = ()) -> DataFrame:
    """Every double column rounded; columns in `money` to cents."""
    doubles = [n for n, t in df.dtypes if t == "double"]
    return df.withColumns({n: (r2(n) if n in money else F.round(n, digits) + F.lit(0.0)) for n in doubles})


# --- votes ----------------------------------------------------------------------------------------


def ballots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item in the layout of the candidate vote file."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_returnflag")
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    cu = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    na = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    # Dimensions first: the order side carries the unit before it meets the line items.
    units = (
        od.join(cu, F.col("o_custkey") == F.col("c_custkey"))
        .join(na, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            "o_orderkey",
            F.year("o_orderdate").alias("ano"),
            F.col("c_nationkey").alias("cd_mun_ibge"),
            F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("sg_uf"),
            (F.col("c_custkey") % 20).cast("int").alias("nr_zona"),
        )
    )
    qty = F.col("l_quantity").cast("bigint")
    flag = F.col("l_returnflag")
    return li.join(units, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "ano",
        F.lit(1).alias("nr_turno"),
        F.lit(6).alias("cd_cargo"),
        F.lit("Deputado Federal").alias("ds_cargo"),
        F.col("l_suppkey").alias("sq_candidato"),
        "cd_mun_ibge",
        "sg_uf",
        "nr_zona",
        F.when(flag == "N", "Válido").when(flag == "A", "Anulado").otherwise("Válido (legenda)").alias(
            "nm_tipo_destinacao_votos"
        ),
        qty.alias("qt_votos_nominais"),
        F.when(flag == "N", qty).otherwise(0).alias("qt_votos_nominais_validos"),
    )


BALLOTS = """
votacao AS (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS ano, l_suppkey AS sq_candidato,
         c_nationkey AS cd_mun_ibge, 'R' || n_regionkey AS sg_uf,
         CAST(c_custkey % 20 AS INTEGER) AS nr_zona, l_returnflag AS flag,
         CAST(l_quantity AS BIGINT) AS qt
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
"""


def counted(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    """All and valid votes per key, from one aggregate.

    Votes and electorate both start here with the same aggregate list, so Spark computes the
    shuffled result once and reuses it in every branch of a plan.
    """
    return (
        ballots(spark, sf_dir)
        .groupBy(*keys)
        .agg(
            F.sum("qt_votos_nominais").alias("aptos"),
            F.sum("qt_votos_nominais_validos").alias("validos"),
        )
        .filter((F.col("aptos") > 0) & (F.col("validos") >= 0))
    )


UNIT_KEYS = ("sq_candidato", "cd_mun_ibge")


def votes(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    """Valid votes per key (candidacy and municipality by default)."""
    keys = keys or UNIT_KEYS
    base = counted(spark, sf_dir, *dict.fromkeys((*UNIT_KEYS, *keys))).filter(F.col("validos") > 0)
    named = base.select("sq_candidato", "cd_mun_ibge", *[k for k in keys if k not in UNIT_KEYS], F.col("validos").alias("votos"))
    if set(UNIT_KEYS) <= set(keys):
        return named.select(*keys, "votos")
    return named.groupBy(*keys).agg(F.sum("votos").alias("votos"))


def electorate(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    """Electors and valid votes per key (municipality by default)."""
    keys = keys or ("cd_mun_ibge",)
    return (
        counted(spark, sf_dir, *dict.fromkeys((*UNIT_KEYS, *keys)))
        .groupBy(*keys)
        .agg(F.sum("aptos").alias("aptos"), F.sum("validos").alias("validos"))
    )


VOTES = (
    BALLOTS
    + """, votos AS (
  SELECT sq_candidato, cd_mun_ibge, CAST(sum(qt) AS BIGINT) AS votos
  FROM votacao WHERE flag = 'N' GROUP BY ALL),
eleitorado AS (
  SELECT cd_mun_ibge, CAST(sum(qt) AS BIGINT) AS aptos,
         CAST(coalesce(sum(qt) FILTER (WHERE flag = 'N'), 0) AS BIGINT) AS validos
  FROM votacao GROUP BY ALL)
"""
)
DENSE = (
    VOTES
    + """, densa AS (
  SELECT c.sq_candidato, e.cd_mun_ibge, e.aptos, e.validos, coalesce(v.votos, 0) AS votos
  FROM (SELECT DISTINCT sq_candidato FROM votos) c CROSS JOIN eleitorado e
  LEFT JOIN votos v ON v.sq_candidato = c.sq_candidato AND v.cd_mun_ibge = e.cd_mun_ibge)
"""
)


def with_sql(*parts: str) -> str:
    """Common table expressions followed by the final select."""
    return "WITH " + " ".join(parts)


# --- candidacies ----------------------------------------------------------------------------------

RESULT_LABELS = ("Eleito", "Eleito por QP", "Eleito por média", "Não eleito", "Suplente", "2º turno")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as candidacies: result, party and state follow their keys."""
    su = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    na = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    labels = F.array(*[F.lit(x) for x in RESULT_LABELS])
    return su.join(na, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("sq_candidato"),
        F.lit(6).alias("cd_cargo"),
        F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("sg_uf"),
        F.col("s_nationkey").alias("nr_partido"),
        F.col("s_name").alias("nm_urna"),
        F.element_at(labels, (F.col("s_suppkey") % 6 + 1).cast("int")).alias("ds_sit_tot_turno"),
        F.when(F.col("s_suppkey") % 7 == 0, F.lit(None).cast("string"))
        .when(F.col("s_suppkey") % 7 == 1, "INAPTO")
        .otherwise("APTO")
        .alias("ds_situacao_candidatura"),
    )


CANDIDATES = """
candidatos AS (
  SELECT s_suppkey AS sq_candidato, 6 AS cd_cargo, 'R' || n_regionkey AS sg_uf,
         s_nationkey AS nr_partido, s_name AS nm_urna,
         ['Eleito', 'Eleito por QP', 'Eleito por média', 'Não eleito', 'Suplente', '2º turno']
           [CAST(s_suppkey % 6 + 1 AS INTEGER)] AS ds_sit_tot_turno,
         CASE s_suppkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'INAPTO' ELSE 'APTO' END
           AS ds_situacao_candidatura
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)
"""

# --- money ----------------------------------------------------------------------------------------

SOURCES = ("Fundo Especial", "Fundo Partidário", "Outros Recursos", "outros  recursos", "OUTROS RECURSOS")
ORIGINS = (
    "Recursos de pessoas físicas",
    "Doações pela Internet",
    "Recursos próprios",
    "Recursos de Financiamento Coletivo",
    "Recursos de partido político",
    "Recursos de outros candidatos",
    "Doações para campanha",
    "Rendimentos de aplicações financeiras",
)
NATURES = ("Financeiro", "Estimável", "FINANCEIRO")


def _pick(labels: tuple[str, ...], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in labels]), (number % len(labels) + 1).cast("int"))


def revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as revenue entries of the supplier-sized set of candidacies.

    The candidacy is the customer modulo one hundred times the scale, which keeps a few hundred
    entries per candidacy at any scale.
    """
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    key = F.col("o_orderkey")
    return od.select(
        F.year("o_orderdate").alias("ano"),
        F.col("o_custkey").alias("sq_candidato"),
        _pick(SOURCES, F.floor(key / 3)).alias("ds_fonte_receita"),
        _pick(ORIGINS, key).alias("ds_origem_receita"),
        _pick(NATURES, F.floor(key / 7)).alias("ds_natureza_receita"),
        F.col("o_totalprice").alias("vr_receita"),
        F.when(key % 3 == 0, F.lit(None).cast("bigint")).otherwise(F.col("o_custkey") + key % 5).alias(
            "sq_candidato_doador"
        ),
        F.to_date("o_orderdate").alias("dt_geracao"),
    )


REVENUE = """
receitas AS (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS ano, o_custkey AS sq_candidato,
         CASE (o_orderkey // 3) % 5 WHEN 0 THEN 'fefc' WHEN 1 THEN 'fundo_partidario' ELSE '' END AS fonte,
         ['pessoa_fisica', 'pessoa_fisica', 'recursos_proprios', 'financiamento_coletivo',
          'partido_outros_recursos', 'outros_candidatos', 'outros_candidatos', 'outros']
           [CAST(o_orderkey % 8 + 1 AS INTEGER)] AS origem,
         o_orderkey % 8 IN (5, 6) AS repasse,
         (o_orderkey // 7) % 3 <> 1 AS financeira,
         CAST(o_totalprice AS DECIMAL(18, 4)) AS vr,
         CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey + o_orderkey % 5 END AS doador,
         CAST(o_orderdate AS DATE) AS dt_geracao
  FROM orders),
classificadas AS (
  SELECT *, CASE WHEN fonte <> '' THEN fonte ELSE origem END AS categoria FROM receitas)
"""

EXPENSE_LABELS = (
    "Serviços prestados por terceiros",
    "Doações financeiras a outros candidatos/partidos",
    "Publicidade por materiais impressos",
    "Despesas com pessoal",
)


def expense_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as expenses of their supplier: contracted, and paid net of discount, in decimals."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_linenumber", "l_extendedprice", "l_discount", "l_shipdate"
    )
    gross = F.col("l_extendedprice").cast("decimal(15,2)")
    net = F.round(gross * (F.lit(1).cast("decimal(4,2)") - F.col("l_discount").cast("decimal(4,2)")), 2)
    return li.select(
        F.year("l_shipdate").alias("ano"),
        F.col("l_suppkey").alias("sq_candidato"),
        _pick(EXPENSE_LABELS, F.col("l_linenumber")).alias("ds_origem_despesa"),
        gross.cast("double").alias("vr_despesa_contratada"),
        net.cast("double").alias("vr_despesa_paga"),
    )


EXPENSES = """
despesas AS (
  SELECT CAST(year(l_shipdate) AS INTEGER) AS ano, l_suppkey AS sq_candidato,
         l_linenumber % 4 = 1 AS repasse, l_linenumber % 4 AS rotulo,
         CAST(l_extendedprice AS DECIMAL(15, 2)) AS contratada,
         round(CAST(l_extendedprice AS DECIMAL(15, 2))
               * (CAST(1 AS DECIMAL(4, 2)) - CAST(l_discount AS DECIMAL(4, 2))), 2) AS paga
  FROM lineitem)
"""


def price_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months of the orders with a monthly change that follows the month number."""
    od = table(spark, sf_dir, "orders").select("o_orderdate")
    return (
        od.select(F.date_format("o_orderdate", "yyyy-MM").alias("mes"))
        .distinct()
        .withColumn("variacao", F.substring("mes", 6, 2).cast("double") / 10)
    )


PRICES = """
serie AS (
  SELECT mes, CAST(substr(mes, 6, 2) AS DOUBLE) / 10 AS variacao
  FROM (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS mes FROM orders))
"""

# --- profiles and posts ---------------------------------------------------------------------------

SOCIAL_PERIODS = (
    ("pre_campanha", "2024-01-01", "2024-01-10"),
    ("campanha", "2024-01-11", "2024-01-22"),
    ("pos_eleicao", "2024-01-23", None),
    ("total", "2024-01-01", None),
)


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events other than posts as readings: each user has two accounts, errors are failures."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    good = F.col("event_type") != "error"
    return ev.filter(F.col("event_type").isin("error", "view", "signup")).select(
        F.col("user_id").alias("sq_candidato"),
        F.concat(
            F.lit("conta"), F.col("user_id").cast("string"), F.when(F.col("event_id") % 3 == 0, "b").otherwise("a")
        ).alias("username"),
        F.when(good, "ok").otherwise("nao_encontrado").alias("status"),
        F.when(good, F.floor(F.col("value") * 100)).alias("followers_count"),
        F.when(good, F.floor(F.col("value") * 10)).alias("follows_count"),
        F.when(good, F.floor(F.col("value"))).alias("media_count"),
        F.col("ts").alias("coletado_em"),
    )


PROFILES = """
perfis AS (
  SELECT user_id AS sq_candidato,
         'conta' || user_id || CASE WHEN event_id % 3 = 0 THEN 'b' ELSE 'a' END AS username,
         CASE WHEN event_type <> 'error' THEN 'ok' ELSE 'nao_encontrado' END AS status,
         CASE WHEN event_type <> 'error' THEN CAST(floor(value * 100) AS BIGINT) END AS followers_count,
         CASE WHEN event_type <> 'error' THEN CAST(floor(value * 10) AS BIGINT) END AS follows_count,
         ts AS coletado_em
  FROM events WHERE event_type IN ('error', 'view', 'signup'))
"""


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Click and purchase events as posts, each read twice; some hide their likes."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    rows = ev.filter(F.col("event_type").isin("click", "purchase")).select(
        F.concat(F.lit("conta"), F.col("user_id").cast("string"), F.lit("a")).alias("username"),
        F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("media_id"),
        F.col("ts").alias("timestamp"),
        F.when(F.col("event_type") == "click", "VIDEO").otherwise("IMAGE").alias("media_type"),
        F.when(F.col("event_id") % 9 != 0, F.floor(F.col("value") * 10)).alias("_likes"),
        F.floor(F.col("value")).alias("comments_count"),
        F.explode(F.array(F.lit(0), F.lit(1))).alias("_reading"),
    )
    late = F.expr("make_dt_interval(0, 30)") * (F.col("_reading") + 1)
    return rows.select(
        "username",
        "media_id",
        "timestamp",
        "media_type",
        (F.col("_likes") + F.col("_reading")).alias("like_count"),
        "comments_count",
        (F.col("timestamp") + late).alias("coletado_em"),
    )


POSTS = """
posts AS (
  SELECT 'conta' || user_id || 'a' AS username, 'm' || event_id AS media_id, ts AS "timestamp",
         CASE WHEN event_type = 'click' THEN 'VIDEO' ELSE 'IMAGE' END AS media_type,
         CASE WHEN event_id % 9 <> 0 THEN CAST(floor(value * 10) AS BIGINT) + 1 END AS like_count,
         CAST(floor(value) AS BIGINT) AS comments_count,
         ts + INTERVAL 60 HOUR AS coletado_em
  FROM events WHERE event_type IN ('click', 'purchase'))
"""

# --- places ---------------------------------------------------------------------------------------


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as polling places: the first two components give coordinates, some are missing."""
    em = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    v = F.col("vec_id")
    lat = F.round(F.col("embedding")[0].cast("double") * 20 - 15, 5)
    lon = F.round(F.col("embedding")[1].cast("double") * 20 - 50, 5)
    known = v % 11 != 0
    return em.select(
        (v % 25).cast("int").alias("cd_mun_ibge"),
        (v % 3).cast("int").alias("nr_zona"),
        v.alias("nr_local"),
        F.concat(F.lit("R"), (v % 5).cast("string")).alias("sg_uf"),
        F.when(known, lat).alias("lat"),
        F.when(known, lon).alias("lon"),
        (v % 400 + 100).alias("aptos"),
    )


PLACES = """
locais AS (
  SELECT CAST(vec_id % 25 AS INTEGER) AS cd_mun_ibge, CAST(vec_id % 3 AS INTEGER) AS nr_zona,
         vec_id AS nr_local, 'R' || vec_id % 5 AS sg_uf,
         CASE WHEN vec_id % 11 <> 0 THEN round(CAST(embedding[1] AS DOUBLE) * 20 - 15, 5) END AS lat,
         CASE WHEN vec_id % 11 <> 0 THEN round(CAST(embedding[2] AS DOUBLE) * 20 - 50, 5) END AS lon,
         vec_id % 400 + 100 AS aptos
  FROM embeddings)
"""


def place_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items cast at places: the order number picks the place, some of them unknown."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    k = F.col("l_orderkey") % 520
    return li.select(
        F.col("l_suppkey").alias("sq_candidato"),
        (k % 25).cast("int").alias("cd_mun_ibge"),
        (k % 3).cast("int").alias("nr_zona"),
        k.alias("nr_local"),
        F.concat(F.lit("R"), (k % 5).cast("string")).alias("sg_uf"),
        F.col("l_quantity").cast("bigint").alias("votos"),
    )


PLACE_VOTES = """
votos_local AS (
  SELECT l_suppkey AS sq_candidato, CAST(l_orderkey % 520 % 25 AS INTEGER) AS cd_mun_ibge,
         CAST(l_orderkey % 520 % 3 AS INTEGER) AS nr_zona, l_orderkey % 520 AS nr_local,
         'R' || l_orderkey % 520 % 5 AS sg_uf, CAST(l_quantity AS BIGINT) AS votos
  FROM lineitem)
"""
