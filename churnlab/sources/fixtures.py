"""The five domain tables derived from the driver's TPC-H-like parquet.

Each derivation is one projection (plus at most one equi-join) over the raw
tables, so Catalyst prunes the raw columns a query does not use and pushes
the queries' filters below the join into the parquet scans.  The rules are in
FIXTURES.md §2; nulls are produced by rule because the raw tables have none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlab.sources.raw import read_table


def _day(ts: Column) -> Column:
    return F.to_date(ts)


def _plus_days(day: Column, n: Column) -> Column:
    return F.date_add(day, n.cast("int"))


def _null_if(cond: Column, value: Column) -> Column:
    return F.when(cond, F.lit(None)).otherwise(value)


def _ticket_id() -> Column:
    return F.col("l_orderkey") * 10 + F.col("l_linenumber")


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    c = read_table(spark, sf_dir, "customer")
    key = F.col("o_orderkey")
    sub = key % 40
    sub_channel = (
        F.when(sub == 0, "outbound_smb")
        .when(sub == 1, "inbound_smb")
        .when(sub == 2, "hospitality")
        .when(sub == 3, "smb_partner")
        .when(sub == 4, F.lit(None).cast("string"))
        .otherwise("retail")
    )
    rsn = key % 7
    return o.join(c, o["o_custkey"] == c["c_custkey"], "inner").select(
        F.col("o_custkey").alias("contract"),
        _day(F.col("o_orderdate")).alias("sale_date"),
        F.when(F.col("o_orderpriority") == "5-LOW", "renewal").otherwise("new").alias("sale_type"),
        F.col("c_mktsegment").alias("customer_type"),
        sub_channel.alias("sub_channel"),
        F.when((F.col("o_orderstatus") == "P") & (key % 3 == 0), "plan_change")
        .otherwise("activation")
        .alias("movement_type"),
        F.when(rsn <= 2, "sale").when(rsn == 3, "transfer").otherwise("new_sale").alias("reason"),
    )


def _lineitem_orders(spark: SparkSession, sf_dir: str, lineitem: DataFrame | None = None) -> DataFrame:
    li = lineitem if lineitem is not None else read_table(spark, sf_dir, "lineitem")
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return li.join(o, li["l_orderkey"] == o["o_orderkey"], "inner")


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _lineitem_orders(spark, sf_dir)
    pk = F.col("l_partkey")
    ship = _day(F.col("l_shipdate"))
    sub = pk % 10
    subarea = _null_if(
        F.col("l_linenumber") == 7,
        F.when(sub == 0, "aging_0_30")
        .when(sub == 1, "aging_over_180")
        .when(sub <= 5, "bill_amount")
        .otherwise("bill_detail"),
    )
    area = F.col("l_suppkey") % 5
    return j.select(
        _ticket_id().alias("ticket_id"),
        _null_if(pk % 89 == 0, F.col("o_custkey")).alias("contract"),
        _null_if(pk % 97 == 0, ship).alias("opened"),
        _null_if(pk % 7 == 0, _plus_days(ship, F.col("l_quantity") % 20)).alias("closed"),
        _null_if(pk % 17 == 0, F.lit("service")).alias("class"),
        F.when(F.col("l_quantity") > 45, "technical")
        .when(F.col("l_returnflag") == "A", "auto_reversal")
        .otherwise("billing_inquiry")
        .alias("reason"),
        F.when(area == 0, "credit_note").when(area == 1, "credit_notes").otherwise("general").alias("area"),
        subarea.alias("subarea"),
        F.when(F.col("l_tax") == 0.08, "void").otherwise("closed").alias("status"),
    )


def service_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    day = _day(F.col("o_orderdate"))
    return o.select(
        F.col("o_custkey").alias("contract"),
        _null_if(key % 31 == 0, day).alias("opened"),
        _null_if(key % 13 == 0, _plus_days(day, key % 15)).alias("finished"),
        F.when(F.col("o_orderpriority").isin("4-NOT SPECIFIED", "5-LOW"), "uninstall")
        .otherwise("install")
        .alias("order_type"),
        F.when(F.col("o_orderstatus") == "P", "open").otherwise("completed").alias("status"),
    )


def discounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").filter(F.col("l_linestatus") == "F")
    ship = _day(F.col("l_shipdate"))
    pk = F.col("l_partkey")
    end = (
        F.when(F.col("l_suppkey") % 4 == 0, F.lit("1900-01-01").cast("date"))
        .when(pk % 23 == 0, F.lit(None).cast("date"))
        .otherwise(_plus_days(ship, pk % 120 - 80))
    )
    return li.select(
        _ticket_id().alias("ticket_id"),
        F.when(F.col("l_discount") == 0.0, F.lit(0.0))
        .otherwise(F.round(F.col("l_extendedprice") * F.col("l_discount"), 2))
        .alias("discount_amount"),
        F.col("l_discount").alias("discount_pct"),
        end.alias("discount_end"),
        _plus_days(ship, F.lit(2) - F.col("l_quantity") % 10).alias("ticket_date"),
    )


def retention_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").filter(
        (F.col("l_linestatus") == "O") | (F.col("l_suppkey") % 3 == 0)
    )
    j = _lineitem_orders(spark, sf_dir, li)
    pk = F.col("l_partkey")
    k = F.col("l_suppkey") % 14
    strategy = (
        F.when(k == 13, F.lit(None).cast("string"))
        .when((k % 2 == 0) & (k < 11), F.concat(F.lit("excluded_"), k.cast("string")))
        .otherwise("discount")
    )
    flag = F.col("l_returnflag")
    return j.select(
        _null_if(pk % 89 == 0, F.col("o_custkey")).alias("contract"),
        _ticket_id().alias("ticket_id"),
        _null_if(pk % 53 == 0, F.col("l_shipdate") + F.expr("INTERVAL 15 HOURS")).alias("finished_ts"),
        F.when(F.col("l_tax") >= 0.02, "retained").otherwise("lost").alias("outcome"),
        F.when(flag == "R", "offer").when(flag == "A", "service").otherwise("relocation").alias("subarea_group"),
        strategy.alias("strategy"),
    )
