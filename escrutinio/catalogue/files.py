"""Sources, publication and ingestion: tables written as files of each format and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from escrutinio.catalogue.roles import table
from escrutinio.operators import reconcile as rc
from escrutinio.session import shared_folder
from escrutinio.sources import publish
from escrutinio.sources import text_files as tf
from escrutinio.sources.contracts import Column, Contract
from escrutinio.streaming import snapshots

ORDER = Contract(
    "pedidos",
    (
        Column("o_orderkey", "bigint", key=1, required=True),
        Column("o_custkey", "bigint", required=True),
        Column("o_orderstatus", "string"),
        Column("o_totalprice", "double", low=0.0, high=1e9),
    ),
)
STATE_FILE = Contract(
    "arquivo",
    (
        Column("cd", "bigint", key=1, required=True),
        Column("ds_situacao", "string"),
        Column("vr", "double"),
        Column("dt", "date"),
        Column("qt", "int"),
    ),
)


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/arquivos-{uuid.uuid4().hex}"


def _official(spark, d):
    """Orders as an official file has them: all text, decimal commas, day first, markers for what is missing."""
    od = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    k = F.col("o_orderkey")
    return od.select(
        k.cast("string").alias("CD"),
        F.when(k % 9 == 0, "#NULO").otherwise(F.concat(F.lit("Situação;"), F.col("o_orderstatus"))).alias("DS_SITUACAO"),
        F.replace(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(",")).alias("VR"),
        F.when(k % 7 == 0, "#NE").otherwise(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("DT"),
        F.when(k % 5 == 0, "-1").otherwise((k % 100).cast("string")).alias("QT"),
    )


def delimited_files(spark, d):
    folder = _folder(spark)
    tf.write_delimited(_official(spark, d), folder, "votos", 1996, ".csv")
    # The union file repeats every row of the others and is left out by its name.
    tf.write_delimited(_official(spark, d), folder, "votos", 1996, tf.UNION_FILE)
    return tf.project_contract(tf.keep_state_files(tf.read_delimited(spark, folder)), STATE_FILE)


def delimited_layouts(spark, d):
    folder = _folder(spark)
    rows = _official(spark, d)
    tf.write_delimited(rows.filter("cast(CD as bigint) % 2 = 0").select("CD", "VR"), f"{folder}/a", "votos", 1996)
    tf.write_delimited(rows.filter("cast(CD as bigint) % 2 = 1").select("QT", "VR", "CD"), f"{folder}/b", "votos", 1998)
    return tf.read_delimited(spark, [f"{folder}/a", f"{folder}/b"]).select("CD", "VR", "QT")


def partitioned_years(spark, d):
    root = _folder(spark)
    od = table(spark, d, "orders").withColumn("ano", F.year("o_orderdate"))
    # Two layouts of one table: each has a column that the other lacks.
    od.filter("ano < 1997").select("ano", "o_orderkey", "o_totalprice").write.partitionBy("ano").parquet(root)
    od.filter("ano >= 1997").select("ano", "o_orderpriority", "o_orderkey").write.mode("append").partitionBy("ano").parquet(root)
    return tf.read_partitioned(spark, root).filter("ano BETWEEN 1996 AND 1998").select("ano", "o_orderkey", "o_totalprice", "o_orderpriority")


def month_series_file(spark, d):
    folder = _folder(spark)
    months = table(spark, d, "orders").groupBy(F.trunc("o_orderdate", "month").alias("m")).agg(F.count(F.lit(1)).alias("n"))
    # A document holds one object per month, as many as the calendar has.
    rows = F.array_sort(F.collect_list(F.struct(F.date_format("m", "dd/MM/yyyy").alias("data"), ((F.col("n") % 40) / 8).cast("string").alias("valor"))))
    months.agg(F.to_json(rows).alias("value")).write.text(folder)
    return tf.read_month_series(spark, folder)


def member_list_file(spark, d):
    folder = _folder(spark)
    k = F.col("s_suppkey")
    listed = table(spark, d, "supplier").select(
        F.when(k % 13 != 0, k.cast("string")).otherwise(" ").alias("sq"), F.concat(F.lit("g"), F.col("s_nationkey").cast("string")).alias("grupo"),
        F.when(k % 3 == 0, "indicado").when(k % 3 == 1, "proprio").alias("origem"),
    )
    listed.write.option("header", True).csv(folder)
    return tf.read_list(spark, folder, "sq", {"grupo": "g4"})


def published_years(spark, d):
    root = _folder(spark)
    od = table(spark, d, "orders").withColumn("ano", F.year("o_orderdate"))

    def year(y):
        return od.filter(F.col("ano") == y).select(*ORDER.columns)

    def control(staged):
        return rc.compare_controls(
            rc.control_totals_table(year(1996), ["o_custkey"], ["o_totalprice"]), rc.control_totals_table(staged, ["o_custkey"], ["o_totalprice"])
        )

    # The first version of 1996 is incomplete and is replaced by one that passes its controls.
    publish.publish_year(year(1996).filter("o_orderstatus = 'F'"), ORDER, root, 1996)
    publish.publish_year(year(1998), ORDER, root, 1998)
    publish.publish_year(year(1996), ORDER, root, 1996, [control])
    return tf.read_partitioned(spark, root).select("ano", *ORDER.columns)


def ingested_log(spark, d):
    root = _folder(spark)
    ev = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type")
    source, log, checkpoint = f"{root}/origem", f"{root}/log", f"{root}/posicao"
    # Newer readings first: those that come late must not replace them. The third run finds nothing new.
    for part in (ev.filter("event_id % 2 = 1"), ev.filter("event_id % 2 = 0"), None):
        if part is not None:
            part.write.mode("append").parquet(source)
        snapshots.ingest(snapshots.open_stream(spark, source, ev.schema), log, checkpoint).awaitTermination()
    return snapshots.current(spark, log, ev.schema, ["user_id"], F.struct("ts", "event_id"))


QUERIES = {
    f.__name__: f
    for f in (delimited_files, delimited_layouts, partitioned_years, month_series_file, member_list_file, published_years, ingested_log)
}

ORACLE = {
    "delimited_files": """SELECT o_orderkey AS cd, CASE WHEN o_orderkey % 9 <> 0 THEN 'Situação;' || o_orderstatus END AS ds_situacao, round(o_totalprice, 2) AS vr,
        CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) END AS dt, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey % 100 AS INTEGER) END AS qt FROM orders""",
    "delimited_layouts": """SELECT o_orderkey::VARCHAR AS "CD", replace(printf('%.2f', o_totalprice), '.', ',') AS "VR",
        CASE WHEN o_orderkey % 2 = 1 THEN CASE WHEN o_orderkey % 5 = 0 THEN '-1' ELSE (o_orderkey % 100)::VARCHAR END END AS "QT" FROM orders""",
    "partitioned_years": """SELECT CAST(year(o_orderdate) AS INTEGER) AS ano, o_orderkey, CASE WHEN year(o_orderdate) < 1997 THEN o_totalprice END AS o_totalprice,
        CASE WHEN year(o_orderdate) >= 1997 THEN o_orderpriority END AS o_orderpriority FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1998""",
    "month_series_file": "SELECT strftime(o_orderdate, '%Y-%m') AS mes, (count(*) % 40) / 8.0::DOUBLE AS variacao FROM orders GROUP BY 1",
    "member_list_file": "SELECT s_suppkey AS sq_candidato, s_suppkey % 3 = 0 AS indicado FROM supplier WHERE s_nationkey = 4 AND s_suppkey % 13 <> 0",
    "published_years": """SELECT CAST(year(o_orderdate) AS INTEGER) AS ano, o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders
        WHERE year(o_orderdate) IN (1996, 1998)""",
    "ingested_log": """SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id, max(ts) AS ts, max_by(event_type, (ts, event_id)) AS event_type
        FROM events GROUP BY user_id""",
}
