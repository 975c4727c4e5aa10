"""The given tables, read as the entities that the operators work on; and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A segment for each order, a model for each of its line numbers; orders with one line number have no choice and go."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("segment_id"), F.col("l_linenumber").alias("model_id")).agg((F.max("l_quantity") / 50.0).alias("predicted_quality"), F.max("l_extendedprice").alias("cost"), (F.max("l_discount") * 10).alias("actual_quality"))
    many = rows.groupBy("segment_id").count().where("count > 1").select("segment_id")
    return rows.join(many, "segment_id", "left_semi")


OBSERVATIONS = """
obs0 AS (SELECT l_orderkey AS segment_id, l_linenumber AS model_id, max(l_quantity) / 50.0 AS predicted_quality, max(l_extendedprice) AS cost, max(l_discount) * 10 AS actual_quality FROM lineitem GROUP BY 1, 2),
obs AS (SELECT * FROM obs0 WHERE segment_id IN (SELECT segment_id FROM obs0 GROUP BY 1 HAVING count(*) > 1))"""


def curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with the coherence of each with the turn before: the shorter text's length over the longer's; null at the start."""
    from pyspark.sql.window import Window as W

    w = W.partitionBy("conv_id").orderBy("turn")
    n, before = F.length("text"), F.lag(F.length("text")).over(w)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", (F.least(n, before) / F.greatest(n, before, F.lit(1))).alias("score0"), before.isNull().alias("first")).select("conv_id", "turn", "text", F.when(~F.col("first"), F.col("score0")).alias("score"))


CURVE = """
t AS (SELECT conv_id, turn, length(text) AS n, lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations),
curve AS (SELECT conv_id, turn, least(n, b) / greatest(n, b, 1)::DOUBLE AS score FROM t WHERE b IS NOT NULL)"""
