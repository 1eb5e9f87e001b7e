"""The register of queries, and the tables that stand for the study's own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query, and its SQL where SQL can say the same."""

    def keep(run):
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as predictions: family, sub, target, prediction, and a total order of the lines of a family."""
    part = table(spark, folder, "part").select("p_partkey", "p_retailprice")
    rows = table(spark, folder, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(
        F.col("l_returnflag").alias("family"), F.col("l_linestatus").alias("sub"), F.col("l_extendedprice").alias("target"),
        (F.col("l_quantity") * F.col("p_retailprice")).alias("prediction"),
        *[F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount")],
    )


PREDICTIONS = """preds AS (
  SELECT l_returnflag AS family, l_linestatus AS sub, l_extendedprice AS target, l_quantity * p_retailprice AS prediction,
         l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as experiment runs: (family, n, seed, mae), one row for each run."""
    orders = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    keys = [F.col("c_mktsegment").alias("family"), F.col("o_orderpriority").alias("n"), (F.col("o_orderkey") % 5).alias("seed")]
    return orders.groupBy(*keys).agg(F.round(F.avg("o_totalprice"), 4).alias("mae"))


def baselines(spark: SparkSession, folder: str) -> DataFrame:
    """(family, zero_shot): the error of a family without tuning."""
    orders = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return orders.groupBy(F.col("c_mktsegment").alias("family")).agg(F.round(F.avg("o_totalprice"), 4).alias("zero_shot"))


RUNS = """runs AS (
  SELECT c_mktsegment AS family, o_orderpriority AS n, o_orderkey % 5 AS seed, round(avg(o_totalprice), 4) AS mae
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3),
zero AS (SELECT c_mktsegment AS family, round(avg(o_totalprice), 4) AS zero_shot FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)"""


def histories(spark: SparkSession, folder: str) -> DataFrame:
    """Events as loss histories: (run, grp, epoch, loss), epochs from 1."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, folder, "events").select(
        F.col("user_id").alias("run"), (F.col("user_id") % 5).alias("grp"), F.row_number().over(order).alias("epoch"), F.col("value").alias("loss")
    )


HISTORIES = """hist AS (
  SELECT user_id AS run, user_id % 5 AS grp, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch, value AS loss FROM events)"""


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """(id, label, family, x): embeddings in double precision; family is the label's parity."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "label", (F.col("label") % 2).alias("family"), x.alias("x"))


VECTORS = "vecs AS (SELECT vec_id AS id, label, label % 2 AS family, embedding::DOUBLE[] AS x FROM embeddings)"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")
