"""Annotation tables made of order tables, so that queries over annotations have rows at every size.

An order is a document of one sentence and one proposition; its lines are mentions, and arguments of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.session import table


def annotation_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    number, sent = F.col("l_linenumber"), (F.col("l_orderkey") % 4).cast("int").alias("sent_no")
    key = (((F.col("l_orderkey") * 10 + number) * 1_000_000 + F.col("l_partkey")) * 1000 + F.col("l_suppkey") % 1000).alias("mention_id")  # line numbers repeat in an order
    mention = line.select(
        F.col("l_orderkey").alias("doc_id"), sent, key, F.col("l_returnflag").alias("type"), F.col("l_linestatus").alias("subtype"),
        F.when(number % 3 == 0, "PRON").when(number % 3 == 1, "NAME").otherwise("DESC").alias("mention_type"), (3 - number % 3).alias("level"),
        F.when(F.col("l_partkey") % 11 != 0, F.col("l_partkey")).alias("entity_id"), F.concat(F.lit("w"), (F.col("l_partkey") % 50).cast("string")).alias("headword"), F.concat_ws(" ", F.lit("the"), F.concat(F.lit("w"), (F.col("l_partkey") % 50).cast("string"))).alias("text"),
    )
    role = F.when(number == 1, "sub").when(number == 2, "obj").when(number == 3, "iobj").otherwise("temp").alias("role")
    argument = line.select(F.lit("prop").alias("owner"), F.col("l_orderkey").alias("owner_id"), role, key)
    order_sent = (F.col("o_orderkey") % 4).cast("int").alias("sent_no")
    prop = orders.select(F.col("o_orderkey").alias("doc_id"), order_sent, F.col("o_orderkey").alias("prop_id"), F.lit("verb").alias("kind"), F.lower(F.element_at(F.split("o_orderpriority", "-"), -1)).alias("predicate"), F.when(F.col("o_orderstatus") == "P", "negative").otherwise("default").alias("status"))
    event = orders.select(F.col("o_orderkey").alias("doc_id"), order_sent, F.col("o_orderkey").alias("event_id"), F.concat_ws(".", F.lit("Order"), "o_orderstatus").alias("type"), F.lower(F.element_at(F.split("o_orderpriority", "-"), -1)).alias("anchor"))
    return {"mention": mention, "argument": argument.unionByName(argument.withColumn("owner", F.lit("event")).where("role <> 'temp'")), "prop": prop, "event": event, "sentence": orders.select(F.col("o_orderkey").alias("doc_id"), order_sent, F.col("o_orderpriority").alias("sentence"))}


#: The same tables in SQL.
SQL = """mention AS (SELECT l_orderkey AS doc_id, (l_orderkey % 4)::INT AS sent_no, ((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 1000 + l_suppkey % 1000 AS mention_id, l_returnflag AS type, l_linestatus AS subtype,
        CASE l_linenumber % 3 WHEN 0 THEN 'PRON' WHEN 1 THEN 'NAME' ELSE 'DESC' END AS mention_type, 3 - l_linenumber % 3 AS level, CASE WHEN l_partkey % 11 <> 0 THEN l_partkey END AS entity_id, 'w' || (l_partkey % 50) AS headword, 'the w' || (l_partkey % 50) AS text FROM lineitem),
    argument AS (SELECT 'prop' AS owner, l_orderkey AS owner_id, CASE l_linenumber WHEN 1 THEN 'sub' WHEN 2 THEN 'obj' WHEN 3 THEN 'iobj' ELSE 'temp' END AS role, ((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 1000 + l_suppkey % 1000 AS mention_id FROM lineitem
        UNION ALL SELECT 'event', l_orderkey, CASE l_linenumber WHEN 1 THEN 'sub' WHEN 2 THEN 'obj' ELSE 'iobj' END, ((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 1000 + l_suppkey % 1000 FROM lineitem WHERE l_linenumber <= 3),
    prop AS (SELECT o_orderkey AS doc_id, (o_orderkey % 4)::INT AS sent_no, o_orderkey AS prop_id, 'verb' AS kind, lower(string_split(o_orderpriority, '-')[-1]) AS predicate, CASE WHEN o_orderstatus = 'P' THEN 'negative' ELSE 'default' END AS status FROM orders),
    event AS (SELECT o_orderkey AS doc_id, (o_orderkey % 4)::INT AS sent_no, o_orderkey AS event_id, 'Order.' || o_orderstatus AS type, lower(string_split(o_orderpriority, '-')[-1]) AS anchor FROM orders)"""
