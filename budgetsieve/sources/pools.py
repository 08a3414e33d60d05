"""Pools over the supplied tables: items with target, label, score, alert flag, group and partition.

Each pool is a DataFrame and, under the same name, a SQL text for the comparison engine.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SQL = {
    "o": """o AS (SELECT o_orderkey AS item_id, o_orderstatus AS target, (o_orderpriority = '1-URGENT')::INT AS label,
      o_totalprice / max(o_totalprice) OVER (PARTITION BY o_orderstatus) AS mu, (o_orderpriority = '5-LOW')::INT AS alert,
      o_custkey AS scaffold, (o_custkey % 64)::INT AS part_id, ((o_orderkey * 7919) % 1000) / 1000.0e0 AS u_conf FROM orders)""",
    "p": """p AS (SELECT event_id AS item_id, (user_id % 5)::INT AS target, (event_type = 'purchase')::INT AS label,
      1.0e0 - exp(-value / 50.0e0) AS mu, (event_type = 'error')::INT AS alert, user_id AS scaffold, (user_id % 16)::INT AS part_id,
      ((event_id * 7919) % 1000) / 1000.0e0 AS u_conf FROM events)""",
    "d": """d AS (SELECT doc_id AS item_id, lang AS target, quality AS label, n_chars::DOUBLE / max(n_chars) OVER (PARTITION BY lang) AS mu,
      toxic AS alert, source AS scaffold, text FROM documents JOIN labels USING (doc_id))""",
    "v": """v AS (SELECT vec_id AS item_id, label AS class, embedding::DOUBLE[] AS x, (vec_id % 7 = 0)::INT AS alert, vec_id % 37 AS scaffold, (vec_id % 16)::INT AS part_id FROM embeddings)""",
    "r": """r AS (SELECT user_id AS target, event_type AS method, (day(ts) % 3)::INT AS seed, avg(value) AS metric, count(*)::DOUBLE AS n, max(value) AS top FROM events GROUP BY ALL)""",
    "q": """q AS (SELECT user_id AS target, (1 + (day(ts) - 1) // 4)::INT AS round, count(*) FILTER (event_type = 'purchase')::BIGINT AS hits, count(*)::BIGINT AS queried FROM events GROUP BY ALL)""",
}


class Pools:
    """The pools of one data folder, each read once and lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def o(self) -> DataFrame:
        """Orders, scored by price within their status."""
        orders = self.table("orders")
        most = orders.groupBy("o_orderstatus").agg(F.max("o_totalprice").alias("most"))  # one row a target
        return orders.join(F.broadcast(most), "o_orderstatus").select(
            F.col("o_orderkey").alias("item_id"),
            F.col("o_orderstatus").alias("target"),
            (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("label"),
            (F.col("o_totalprice") / F.col("most")).alias("mu"),
            (F.col("o_orderpriority") == "5-LOW").cast("int").alias("alert"),
            F.col("o_custkey").alias("scaffold"),
            (F.col("o_custkey") % 64).cast("int").alias("part_id"),
            ((F.col("o_orderkey") * 7919 % 1000) / F.lit(1000.0)).alias("u_conf"),
        )

    @cached_property
    def p(self) -> DataFrame:
        """Events as predictions of a purchase."""
        return self.table("events").select(
            F.col("event_id").alias("item_id"),
            (F.col("user_id") % 5).cast("int").alias("target"),
            (F.col("event_type") == "purchase").cast("int").alias("label"),
            (F.lit(1.0) - F.exp(-F.col("value") / F.lit(50.0))).alias("mu"),
            (F.col("event_type") == "error").cast("int").alias("alert"),
            F.col("user_id").alias("scaffold"),
            (F.col("user_id") % 16).cast("int").alias("part_id"),
            ((F.col("event_id") * 7919 % 1000) / F.lit(1000.0)).alias("u_conf"),
        )

    @cached_property
    def d(self) -> DataFrame:
        """Labelled documents by language."""
        docs = self.table("documents").join(self.table("labels"), "doc_id")
        most = docs.groupBy("lang").agg(F.max("n_chars").alias("most"))
        return docs.join(F.broadcast(most), "lang").select(F.col("doc_id").alias("item_id"), F.col("lang").alias("target"), F.col("quality").alias("label"), (F.col("n_chars").cast("double") / F.col("most")).alias("mu"), F.col("toxic").alias("alert"), F.col("source").alias("scaffold"), "text")

    @cached_property
    def v(self) -> DataFrame:
        """Vectors in double precision."""
        return self.table("embeddings").select(F.col("vec_id").alias("item_id"), F.col("label").alias("class"), F.col("embedding").cast("array<double>").alias("x"), (F.col("vec_id") % 7 == 0).cast("int").alias("alert"), (F.col("vec_id") % 37).alias("scaffold"), (F.col("vec_id") % 16).cast("int").alias("part_id"))

    @cached_property
    def r(self) -> DataFrame:
        """Results of a metric by target, method and seed."""
        return self.table("events").groupBy(F.col("user_id").alias("target"), F.col("event_type").alias("method"), (F.dayofmonth("ts") % 3).alias("seed")).agg(F.avg("value").alias("metric"), F.count("*").cast("double").alias("n"), F.max("value").alias("top"))

    @cached_property
    def q(self) -> DataFrame:
        """A log of rounds: hits and queries by target."""
        return self.table("events").groupBy(F.col("user_id").alias("target"), (F.lit(1) + F.floor((F.dayofmonth("ts") - 1) / 4)).cast("int").alias("round")).agg(F.count_if(F.col("event_type") == "purchase").alias("hits"), F.count("*").alias("queried"))
