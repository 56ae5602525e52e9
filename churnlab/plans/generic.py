"""The cohort operators on the raw order tables, without any business rule.

Customers play the contract, orders the anchor events and shipments (line
items) the follow-up events.  Each query exercises one operator at full table
size so that it is checked apart from the domain vocabulary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlab.config import DayWindow
from churnlab.functions.dates import cohort as cohort_of
from churnlab.operators.flags import flag_rows, segment_recurrence, split_contacted
from churnlab.operators.metrics import monthly_counts, monthly_mean_days, ordered
from churnlab.operators.windows import events_within, follow_on
from churnlab.sources.raw import read_table

W30 = DayWindow(0, 30)
W60 = DayWindow(0, 60)
W90 = DayWindow(0, 90)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_key"),
        F.col("o_custkey").alias("customer"),
        F.to_date("o_orderdate").alias("order_date"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
    )


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_key"),
        F.to_date("l_shipdate").alias("ship_date"),
        F.col("l_returnflag").alias("return_flag"),
    )
    return li.join(orders(spark, sf_dir), "order_key", "inner")


def _anchors(spark, sf_dir, cond=None) -> DataFrame:
    # an order without a day can anchor no window; stating it keeps the branches
    # of one plan identical (join-inferred filters add nothing) so they share scans
    o = orders(spark, sf_dir).filter(F.col("order_date").isNotNull())
    if cond is not None:
        o = o.filter(cond)
    return o.select("customer", "order_date").distinct()


def _ship_days(spark, sf_dir, returns_only=False) -> DataFrame:
    s = shipments(spark, sf_dir)
    if returns_only:
        s = s.filter(F.col("return_flag") == "R")
    return s.select("customer", "ship_date").distinct()


def raw_events_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval join: shipment days (0,30] after an order day of the same
    customer; pairs and distinct customers by order month."""
    pairs = events_within(_anchors(spark, sf_dir), _ship_days(spark, sf_dir), "customer", "order_date", "ship_date", W30)
    per = pairs.groupBy(cohort_of(F.col("order_date")).alias("month"), "customer").agg(F.count("*").alias("_p"))
    out = per.groupBy("month").agg(F.sum("_p").alias("pairs"), F.count("customer").alias("total"))
    return ordered(out, ["month"])


def raw_follow_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Follow-on: return days (0,60] after some urgent order day of the same
    customer; matching return days and customers by return month."""
    hits = follow_on(
        _ship_days(spark, sf_dir, returns_only=True),
        _anchors(spark, sf_dir, F.col("priority") == "1-URGENT"),
        "customer",
        "order_date",
        "ship_date",
        W60,
    )
    per = hits.groupBy(cohort_of(F.col("ship_date")).alias("month"), "customer").agg(F.count("*").alias("_e"))
    out = per.groupBy("month").agg(F.sum("_e").alias("events"), F.count("customer").alias("total"))
    return ordered(out, ["month"])


def raw_flag_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer-level flag: customers of finished orders split by whether a
    return follows (0,90] after any of their finished orders; by order month."""
    rows = flag_rows(
        _anchors(spark, sf_dir, F.col("status") == "F"),
        _ship_days(spark, sf_dir, returns_only=True),
        "customer",
        "order_date",
        "ship_date",
        W90,
    )
    return monthly_counts(rows, "customer", "order_date", "churned", flag_key="customer")


def raw_segment_recurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recurrence segments: shipments (60,90] after an urgent order, segmented
    by the customer's shipments in (30,60] and (0,30]; customers by segment
    and order month."""
    pairs = events_within(
        _anchors(spark, sf_dir, F.col("priority") == "1-URGENT"),
        _ship_days(spark, sf_dir),
        "customer",
        "order_date",
        "ship_date",
        W90,
        days_col="days",
    )
    seg = segment_recurrence(pairs, "customer", "days", (30, 60, 90), ("none", "previous", "previous_two"))
    return monthly_counts(seg, "customer", "order_date", by=["segment"])


def raw_split_contacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacted split: open-order days of customers with / without a return
    (0,30] after one of them; customers by branch and order month."""
    anchors = _anchors(spark, sf_dir, F.col("status") == "O")
    pairs = events_within(anchors, _ship_days(spark, sf_dir, returns_only=True), "customer", "order_date", "ship_date", W30)
    yes, no = split_contacted(anchors, pairs, "customer")
    both = yes.withColumn("branch", F.lit("contacted")).unionByName(no.withColumn("branch", F.lit("not_contacted")))
    return monthly_counts(both, "customer", "order_date", by=["branch"])


def raw_monthly_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly distinct count: customers with an order, by order month."""
    return monthly_counts(_anchors(spark, sf_dir), "customer", "order_date")


def raw_monthly_mean_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolution time: mean days order -> shipment over line items shipped
    after their order day, and distinct customers, by order month."""
    return monthly_mean_days(shipments(spark, sf_dir), "customer", "order_date", "ship_date")


GENERIC_QUERIES = {
    "raw_events_within": raw_events_within,
    "raw_follow_on": raw_follow_on,
    "raw_flag_by_key": raw_flag_by_key,
    "raw_segment_recurrence": raw_segment_recurrence,
    "raw_split_contacted": raw_split_contacted,
    "raw_monthly_distinct": raw_monthly_distinct,
    "raw_monthly_mean_days": raw_monthly_mean_days,
}

# DuckDB oracles in the plain join + DISTINCT formulation.
_ORD = (
    "ord AS (SELECT o_orderkey AS order_key, o_custkey AS customer, CAST(o_orderdate AS DATE) AS order_date, "
    "o_orderstatus AS status, o_orderpriority AS priority FROM orders)"
)
_SHIP = (
    "ship AS (SELECT o.customer, o.order_date, CAST(l.l_shipdate AS DATE) AS ship_date, "
    "l.l_returnflag AS return_flag FROM lineitem l JOIN ord o ON l.l_orderkey = o.order_key)"
)
_W = "s.ship_date > a.order_date AND date_diff('day', a.order_date, s.ship_date) <= {hi}"

GENERIC_ORACLE = {
    "raw_events_within": f"""WITH {_ORD}, {_SHIP},
a AS (SELECT DISTINCT customer, order_date FROM ord WHERE order_date IS NOT NULL),
s AS (SELECT DISTINCT customer, ship_date FROM ship),
p AS (SELECT DISTINCT a.customer, a.order_date, s.ship_date FROM a JOIN s ON a.customer = s.customer
      WHERE {_W.format(hi=30)})
SELECT CAST(month(order_date) AS BIGINT) AS month, COUNT(*) AS pairs, COUNT(DISTINCT customer) AS total
FROM p GROUP BY ALL""",
    "raw_follow_on": f"""WITH {_ORD}, {_SHIP},
a AS (SELECT DISTINCT customer, order_date FROM ord WHERE order_date IS NOT NULL AND priority = '1-URGENT'),
s AS (SELECT DISTINCT customer, ship_date FROM ship WHERE return_flag = 'R'),
h AS (SELECT DISTINCT s.customer, s.ship_date FROM s JOIN a ON a.customer = s.customer WHERE {_W.format(hi=60)})
SELECT CAST(month(ship_date) AS BIGINT) AS month, COUNT(*) AS events, COUNT(DISTINCT customer) AS total
FROM h GROUP BY ALL""",
    "raw_flag_by_key": f"""WITH {_ORD}, {_SHIP},
a AS (SELECT DISTINCT customer, order_date FROM ord WHERE order_date IS NOT NULL AND status = 'F'),
s AS (SELECT DISTINCT customer, ship_date FROM ship WHERE return_flag = 'R'),
h AS (SELECT DISTINCT s.customer FROM s JOIN a ON a.customer = s.customer WHERE {_W.format(hi=90)}),
f AS (SELECT a.customer, a.order_date, CASE WHEN h.customer IS NOT NULL THEN 'churned' ELSE 'kept' END AS flag
      FROM a LEFT JOIN h ON a.customer = h.customer)
SELECT CAST(month(order_date) AS BIGINT) AS month, COUNT(DISTINCT customer) AS total,
  COUNT(DISTINCT CASE WHEN flag = 'churned' THEN customer END) AS churned,
  COUNT(DISTINCT CASE WHEN flag = 'kept' THEN customer END) AS kept
FROM f GROUP BY ALL""",
    "raw_segment_recurrence": f"""WITH {_ORD}, {_SHIP},
met AS (SELECT customer, o.order_date, (s.ship_date - o.order_date - 1) // 30 AS slot FROM ord o JOIN ship s USING (customer)
  WHERE o.priority = '1-URGENT' AND s.ship_date - o.order_date BETWEEN 1 AND 90),
history AS (SELECT customer, bool_or(slot = 0) AS slot0, bool_or(slot = 1) AS slot1 FROM met GROUP BY customer)
SELECT if(NOT slot1, 'none', if(slot0, 'previous_two', 'previous')) AS segment,
  CAST(month(order_date) AS BIGINT) AS month, COUNT(DISTINCT customer) AS total
FROM met JOIN history USING (customer) WHERE slot = 2 GROUP BY ALL""",
    "raw_split_contacted": f"""WITH {_ORD}, {_SHIP},
a AS (SELECT DISTINCT customer, order_date FROM ord WHERE order_date IS NOT NULL AND status = 'O'),
s AS (SELECT DISTINCT customer, ship_date FROM ship WHERE return_flag = 'R'),
k AS (SELECT DISTINCT a.customer FROM a JOIN s ON a.customer = s.customer WHERE {_W.format(hi=30)}),
t AS (SELECT a.customer, a.order_date,
        CASE WHEN k.customer IS NOT NULL THEN 'contacted' ELSE 'not_contacted' END AS branch
      FROM a LEFT JOIN k ON a.customer = k.customer)
SELECT branch, CAST(month(order_date) AS BIGINT) AS month, COUNT(DISTINCT customer) AS total
FROM t GROUP BY ALL""",
    "raw_monthly_distinct": f"""WITH {_ORD}
SELECT CAST(month(order_date) AS BIGINT) AS month, COUNT(DISTINCT customer) AS total
FROM ord WHERE order_date IS NOT NULL GROUP BY ALL""",
    "raw_monthly_mean_days": f"""WITH {_ORD}, {_SHIP},
r AS (SELECT customer, order_date, date_diff('day', order_date, ship_date) AS d FROM ship WHERE ship_date > order_date)
SELECT CAST(month(order_date) AS BIGINT) AS month,
  CAST((200 * SUM(d) + COUNT(d)) // (2 * COUNT(d)) AS DOUBLE) / 100 AS mean_days,
  COUNT(DISTINCT customer) AS total
FROM r GROUP BY ALL""",
}
