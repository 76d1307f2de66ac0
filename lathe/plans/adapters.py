"""Views of the test tables as prompts, trajectories and token sequences, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored samples of prompts from order lines: ``uid, sample_index, score, acc, pred, n_tokens, data_source``."""
    li = table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    return li.select(
        F.col("l_orderkey").alias("uid"),
        (F.row_number().over(w) - 1).alias("sample_index"),
        (F.col("l_discount") * 10 - F.col("l_tax") * 5).alias("score"),
        F.col("l_tax").alias("format_score"),
        (F.col("l_discount") > 0.05).cast("int").alias("acc"),
        (F.col("l_partkey") % 3).alias("pred"),
        F.col("l_quantity").cast("int").alias("n_tokens"),
        F.col("l_returnflag").alias("data_source"),
    )


SAMPLES = """samples AS (SELECT l_orderkey AS uid,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 AS INTEGER) AS sample_index,
  l_discount * 10 - l_tax * 5 AS score, l_tax AS format_score, CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END AS acc, l_partkey % 3 AS pred,
  CAST(l_quantity AS INTEGER) AS n_tokens, l_returnflag AS data_source FROM lineitem)"""

TOKEN_COLUMNS = {
    "rewards": "value / 100",
    "values": "(event_id % 17) / 17.0D",
    "old_lp": "-(1 + event_id % 7) / 8.0D",
    "new_lp": "-(1 + event_id % 5) / 8.0D",
    "roll_lp": "-(1 + event_id % 6) / 8.0D",
    "ref_lp": "-(1 + event_id % 9) / 10.0D",
    "adv": "((event_id % 11) - 5) / 4.0D",
    "spi": "(1 + event_id % 3) / 4.0D",
    "vpreds": "(event_id % 13) / 13.0D",
    "returns": "(event_id % 19) / 19.0D",
    "mask": "if(event_type = 'error', 0, 1)",
}


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token arrays of each user's events in time order: ``uid, sid`` and the arrays of ``TOKEN_COLUMNS``."""
    ev = table(spark, sf_dir, "events")
    cols = [F.expr(e).alias(n) for n, e in TOKEN_COLUMNS.items()]
    rows = ev.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", *cols))).alias("t"))
    return rows.select((F.col("user_id") % 50).alias("uid"), F.col("user_id").alias("sid"), *(F.col(f"t.{n}").alias(n) for n in TOKEN_COLUMNS))


TOKENS = "tok AS (SELECT user_id % 50 AS uid, user_id AS sid, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS pos, " + ", ".join(f"{e.replace('.0D', '.0').replace('if(', 'CASE WHEN ').replace(', 0, 1)', ' THEN 0 ELSE 1 END')} AS {n}" for n, e in TOKEN_COLUMNS.items()).replace(" AS values", ' AS "values"') + " FROM events)"
