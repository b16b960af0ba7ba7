"""Registry of the library's queries over the driver's tables, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """A table of fewer files than the cluster has cores, dealt over these before costly work on each row; others stay as they are read."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if len(rows.inputFiles()) < cores else rows


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as station readings: views are lows, clicks are highs."""
    return read(spark, sf_dir, "events").selectExpr("user_id AS station", "ts", "event_type AS type", "value")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"), "label")


def web_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph of parts, their suppliers and the suppliers' nations: nations are dangling."""
    parts = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("page"), F.concat(F.lit("s"), "l_suppkey").alias("t"))
    nations = read(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("page"), F.concat(F.lit("n"), "s_nationkey").alias("t"))
    return parts.unionByName(nations).groupBy("page").agg(F.collect_set("t").alias("targets"))


WEB_EDGES = "(SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier)"


def item_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as rows of numbers: price by quantity, discount and tax; label 1 for returned lines."""
    return read(spark, sf_dir, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber AS id", "l_quantity / 50 AS quantity", "l_discount * 10 AS discount", "l_tax * 10 AS tax", "l_extendedprice / 100000 AS price", "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label")


ITEMS = "(SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity / 50 AS quantity, l_discount * 10 AS discount, l_tax * 10 AS tax, l_extendedprice / 100000 AS price, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label FROM lineitem)"
FEATURES = ["quantity", "discount", "tax", "price"]


def load() -> None:
    """Import the modules that register queries."""
    from loomspark.plans import queries_learn, queries_programs, queries_relational  # noqa: F401


load()
