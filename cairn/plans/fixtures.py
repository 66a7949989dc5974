"""Entities and derived inputs of the registered queries, over the given tables."""

from __future__ import annotations

from typing import Annotated

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..entity import Bool, Dimension, Double, Fact, Identity, Int, Key, Long, MaxLength, String, Type2
from ..functions.scalars import date_key
from ..operators.mapper import Mapper


def as_of() -> Column:
    """The clock of all loads here."""
    return F.lit("2002-01-01 00:00:00").cast("timestamp_ntz")



class Customer(Dimension):
    CustomerKey: Annotated[Long, Key(), Identity()]
    Id: Long
    IntegrationId: Long
    Name: Annotated[String | None, MaxLength(100), Type2()]
    Inactive: Bool
    Source: Int


class OrderLine(Fact):
    OrderLineKey: Annotated[Long, Key(), Identity()]
    Id: Long
    OrderId: Long
    ProductId: Long
    Quantity: Int


class UserActivity(Fact):
    UserActivityKey: Annotated[Long, Key(), Identity()]
    UserId: Long
    EventId: Long
    EventType: String


class Part:
    p_partkey: Long
    p_name: String
    p_size: Int
    p_retailprice: Double


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source_customer(spark: SparkSession, sf_dir: str, source: int = 1) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("CustomerId"), F.col("c_name").alias("CustomerName"), (F.col("c_acctbal") < 0).alias("Inactive"), F.lit(source).alias("Source"))


def changed_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = source_customer(spark, sf_dir).where("CustomerId % 13 <> 0")
    name = F.when(F.col("CustomerId") % 7 == 0, F.concat("CustomerName", F.lit("x"))).otherwise(F.col("CustomerName"))
    return c.withColumn("CustomerName", name).withColumn("Inactive", F.when(F.col("CustomerId") % 11 == 0, ~F.col("Inactive")).otherwise(F.col("Inactive")))


def customer_mapper(seed: int = 1) -> Mapper:
    return (
        Mapper(Customer)
        .map("CustomerId", "Id")
        .map("CustomerId", "IntegrationId")
        .map("CustomerName", "Name")
        .map("Inactive", "Inactive")
        .map("Source", "Source")
        .hash("KeyHash", lambda h: h.with_seed(seed).include("Id"))
        .hash("ChangeHash", lambda h: h.with_seed(seed).all())
    )


def mapped(rows: DataFrame, seed: int = 1) -> DataFrame:
    return customer_mapper(seed).apply(rows, as_of())


def existing_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dimension before the load: nine in ten customers, some deleted."""
    rows = mapped(source_customer(spark, sf_dir).where("CustomerId % 10 <> 0"))
    gone = F.col("Id") % 17 == 0
    from ..operators.surrogate import global_rank

    return (
        global_rank(rows.drop("CustomerKey"), ["Id"], "CustomerKey")
        .withColumn("FromDate", F.lit("1995-01-01 00:00:00").cast("timestamp_ntz"))
        .withColumn("FromDateKey", F.lit(19950101))
        .withColumn("IsDeleted", gone)
        .withColumn("ToDate", F.when(gone, F.lit("2001-01-01 00:00:00").cast("timestamp_ntz")))
        .withColumn("ToDateKey", date_key(F.col("ToDate")))
        .select(*rows.columns)
    )


LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def source_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with repeated ids; the line order is total."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(*LINE_ORDER, (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("OrderLineId"), F.col("l_orderkey").alias("OrderId"), F.col("l_partkey").alias("ProductId"), F.col("l_quantity").cast("int").alias("Quantity"))


def line_mapper() -> Mapper:
    return (
        Mapper(OrderLine)
        .map("OrderLineId", "Id")
        .map("OrderId", "OrderId")
        .map("ProductId", "ProductId")
        .map("Quantity", "Quantity")
        .hash("KeyHash", lambda h: h.include("Id"))
        .hash("ChangeHash", lambda h: h.all())
    )


def first_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("OrderLineId").orderBy(*LINE_ORDER)
    return source_lines(spark, sf_dir).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select("OrderLineId", "OrderId", "ProductId", "Quantity")


def existing_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = first_lines(spark, sf_dir).where("OrderLineId % 3 <> 0").withColumn("Quantity", F.when(F.col("OrderLineId") % 5 == 0, F.col("Quantity") + 1).otherwise(F.col("Quantity")))
    return line_mapper().apply(rows, as_of()).withColumn("IsDeleted", F.col("Id") % 19 == 0).withColumn("OrderLineKey", F.col("Id"))


def micro_batches(spark: SparkSession, sf_dir: str, size: int = 1000) -> DataFrame:
    """Events in order of time, numbered in batches."""
    from ..operators.surrogate import global_rank

    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    return global_rank(e, ["ts", "event_id"], "rn").withColumn("batch_no", F.expr(f"(rn - 1) div {size}")).drop("rn")


# The same inputs as DuckDB SQL.
F1 = "SELECT c_custkey AS CustomerId, c_name AS CustomerName, c_acctbal < 0 AS Inactive, 1 AS Source FROM customer"
F2 = f"""SELECT CustomerId, CASE WHEN CustomerId % 7 = 0 THEN CustomerName || 'x' ELSE CustomerName END AS CustomerName,
 CASE WHEN CustomerId % 11 = 0 THEN NOT Inactive ELSE Inactive END AS Inactive, Source FROM ({F1}) WHERE CustomerId % 13 <> 0"""


def sha(text: str) -> str:
    return f"to_base64(unhex(sha1({text})))"


def key_hash(seed: int, i: str = "CustomerId") -> str:
    return sha(f"""'{{"h":["' || {i} || '","{seed}"]}}'""")


def change_hash(seed: int) -> str:
    return sha(
        f"""'{{"h":["0","' || CustomerId || '","' || CASE WHEN Inactive THEN 'True' ELSE 'False' END || '","' || CustomerId || '","' || CustomerName || '","{seed}","' || Source || '"]}}'"""
    )


def mapped_sql(rows: str, seed: int = 1) -> str:
    return f"SELECT CustomerId AS Id, CustomerName AS Name, Inactive, Source, {key_hash(seed)} AS KeyHash, {change_hash(seed)} AS ChangeHash FROM ({rows})"


F3 = f"""SELECT row_number() OVER (ORDER BY Id) AS CustomerKey, *, TIMESTAMP '1995-01-01' AS FromDate, Id % 17 = 0 AS IsDeleted, true AS IsActive,
 CASE WHEN Id % 17 = 0 THEN TIMESTAMP '2001-01-01' END AS ToDate FROM ({mapped_sql(F1)}) WHERE Id % 10 <> 0"""

F4 = f"""SELECT {', '.join(LINE_ORDER)}, l_orderkey * 10 + l_linenumber AS OrderLineId, l_orderkey AS OrderId, l_partkey AS ProductId, CAST(l_quantity AS INT) AS Quantity FROM lineitem"""
F4_FIRST = f"SELECT * FROM ({F4}) QUALIFY row_number() OVER (PARTITION BY OrderLineId ORDER BY {', '.join(LINE_ORDER)}) = 1"
F5 = f"""SELECT OrderLineId, OrderId, ProductId, CASE WHEN OrderLineId % 5 = 0 THEN Quantity + 1 ELSE Quantity END AS Quantity, OrderLineId % 19 = 0 AS IsDeleted FROM ({F4_FIRST}) WHERE OrderLineId % 3 <> 0"""
