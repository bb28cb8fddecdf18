"""The tables seen as evidence, intervals and genotypes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def evidence(spark, d) -> DataFrame:
    return read(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("sample"), (F.col("user_id") % 10).alias("chrom"),
        (F.unix_seconds(F.col("ts").cast("timestamp")) - 1704067200).alias("pos"), F.col("event_type").alias("svt"), (F.floor("value") % 61).alias("qual"))


def intervals(spark, d) -> DataFrame:
    s = F.col("l_partkey") * 100 + F.col("l_linenumber") * 7
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("ln"), (F.col("l_suppkey") % 10).alias("chrom"), s.alias("s"),
        (s + 1 + F.floor(F.col("l_quantity") * 10)).alias("e"), F.col("l_suppkey").alias("sample"), F.col("l_returnflag").alias("t"))


def genotypes(spark, d) -> DataFrame:
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("ln"), F.col("l_partkey").alias("site"), F.col("l_suppkey").alias("sample"),
        F.floor("l_quantity").alias("ref"), F.floor(F.col("l_discount") * 100 + 0.5).alias("alt"), (F.col("l_linestatus") == "F").alias("precise"), F.col("l_returnflag").alias("role"))


E_SQL = "e AS (SELECT event_id AS id, user_id AS sample, user_id % 10 AS chrom, CAST(floor(epoch(ts)) AS BIGINT) - 1704067200 AS pos, event_type AS svt, CAST(floor(value) AS BIGINT) % 61 AS qual FROM events)"
I_SQL = "i AS (SELECT l_orderkey AS id, l_linenumber AS ln, l_suppkey % 10 AS chrom, l_partkey * 100 + l_linenumber * 7 AS s, l_partkey * 100 + l_linenumber * 7 + 1 + CAST(floor(l_quantity * 10) AS BIGINT) AS e, l_suppkey AS sample, l_returnflag AS t FROM lineitem)"
G_SQL = "g AS (SELECT l_orderkey AS id, l_linenumber AS ln, l_partkey AS site, l_suppkey AS sample, CAST(floor(l_quantity) AS BIGINT) AS ref, CAST(floor(l_discount * 100 + 0.5) AS BIGINT) AS alt, l_linestatus = 'F' AS precise, l_returnflag AS role FROM lineitem)"
