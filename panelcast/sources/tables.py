"""Sales rows from the star schema: ``(series_key, ds, y)`` at transaction grain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.operators.series import key_of

# Which table a key attribute lives in.
ATTRIBUTES = {
    "nation": ("nation", "n_name"),
    "region": ("region", "r_name"),
    "segment": ("customer", "c_mktsegment"),
    "status": ("orders", "o_orderstatus"),
    "priority": ("orders", "o_orderpriority"),
    "brand": ("part", "p_brand"),
    "type": ("part", "p_type"),
    "returnflag": ("lineitem", "l_returnflag"),
    "event_type": ("events", "event_type"),
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _with_customer(spark: SparkSession, folder: str, facts: DataFrame, needed: set) -> DataFrame:
    # No hint: Spark broadcasts a dimension only when its size on disk is below the threshold, and
    # otherwise sorts and merges with run-time splitting of hot keys.
    facts = facts.join(table(spark, folder, "customer"),
                       F.col("o_custkey") == F.col("c_custkey"))
    if needed & {"nation", "region"}:
        facts = facts.join(table(spark, folder, "nation"),
                           F.col("c_nationkey") == F.col("n_nationkey"))
    if "region" in needed:
        facts = facts.join(table(spark, folder, "region"),
                           F.col("n_regionkey") == F.col("r_regionkey"))
    return facts


def _measures(spark: SparkSession, folder: str, fact: str) -> tuple:
    """A fact table, its date and its amount."""
    if fact == "orders":
        return table(spark, folder, "orders"), F.col("o_orderdate"), F.col("o_totalprice")
    if fact == "lineitem":
        net = F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))
        return table(spark, folder, "lineitem"), F.col("l_shipdate"), net
    if fact == "events":
        return table(spark, folder, "events"), F.col("ts"), F.col("value")
    raise ValueError(f"unknown fact table {fact!r}")


def _with_dimensions(spark: SparkSession, folder: str, fact: str, facts: DataFrame, owners: set) -> DataFrame:
    if fact == "lineitem" and "part" in owners:
        facts = facts.join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
    if fact == "lineitem" and owners & {"orders", "customer", "nation", "region"}:
        facts = facts.join(table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    if fact != "events" and owners & {"customer", "nation", "region"}:
        facts = _with_customer(spark, folder, facts, owners)
    return facts


def read_sales_table(
    spark: SparkSession, folder: str, fact: str = "orders", keys: tuple[str, ...] = ()
) -> DataFrame:
    """Transactions of one fact table, keyed by attributes of it or its dimensions."""
    facts, when, amount = _measures(spark, folder, fact)
    facts = _with_dimensions(spark, folder, fact, facts, {ATTRIBUTES[k][0] for k in keys})
    key: Column = key_of([ATTRIBUTES[k][1] for k in keys])
    return facts.select(
        key.alias("series_key"), when.cast("date").alias("ds"), amount.cast("double").alias("y")
    ).na.drop(subset=["ds", "y"])


def read_sales_sums(
    spark: SparkSession, folder: str, fact: str = "orders", keys: tuple[str, ...] = ()
) -> DataFrame:
    """Sales of each key and day, as ``read_sales_table`` summed by key and day.

    The facts are summed per foreign key and day before they meet a dimension: what a hot customer or part
    sends into the join is one row per day, not one per transaction.
    """
    owners = {ATTRIBUTES[k][0] for k in keys}
    facts, when, amount = _measures(spark, folder, fact)
    foreign = []
    if fact == "orders" and owners & {"customer", "nation", "region"}:
        foreign.append("o_custkey")
    if fact == "lineitem" and "part" in owners:
        foreign.append("l_partkey")
    if fact == "lineitem" and owners & {"orders", "customer", "nation", "region"}:
        foreign.append("l_orderkey")
    own = [ATTRIBUTES[k][1] for k in keys if ATTRIBUTES[k][0] == fact]
    sums = facts.select(
        *dict.fromkeys(foreign + own), when.cast("date").alias("ds"), amount.cast("double").alias("y")
    ).na.drop(subset=["ds", "y"]).groupBy(*dict.fromkeys(foreign + own), "ds").agg(F.sum("y").alias("y"))
    joined = _with_dimensions(spark, folder, fact, sums, owners)
    key = key_of([ATTRIBUTES[k][1] for k in keys])
    return joined.select(key.alias("series_key"), "ds", "y").groupBy("series_key", "ds").agg(F.sum("y").alias("y"))
