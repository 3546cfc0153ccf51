"""The bindings that all queries share: files with a status and a score, and their SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scans import table

AS_OF = dt.date(2001, 7, 20)


def money(name: str):
    return F.col(name).cast("decimal(18,2)")


def files(spark: SparkSession, d: str) -> DataFrame:
    """batch_id, line_no, status, score, amount, shipped of every line item."""
    flag, line = F.col("l_returnflag"), F.col("l_linestatus")
    status = F.when((flag == "R") & (line == "F"), "CONFIRMED").when((flag == "A") & (line == "F"), "NEED_REVIEW").when((flag == "N") & (line == "F"), "NEED_SUPPLEMENT").when((flag == "N") & (line == "O"), "NORMAL").when(flag == "A", "FAILED").otherwise("QUEUED")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("batch_id"), F.col("l_linenumber").alias("line_no"), status.alias("status"), F.round(F.col("l_discount") * 1000).alias("score"), money("l_extendedprice").alias("amount"), F.to_date("l_shipdate").alias("shipped"), "l_partkey", "l_quantity")


FILES = """files AS (SELECT l_orderkey AS batch_id, l_linenumber AS line_no,
  CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'CONFIRMED' WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'NEED_REVIEW'
    WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'NEED_SUPPLEMENT' WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'NORMAL'
    WHEN l_returnflag = 'A' THEN 'FAILED' ELSE 'QUEUED' END AS status,
  round(l_discount * 1000) AS score, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, CAST(l_shipdate AS DATE) AS shipped, l_partkey, l_quantity FROM lineitem)"""
