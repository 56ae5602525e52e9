"""SQL (DuckDB dialect) for every query, written from the queries' meaning.

The domain tables are derived from the raw test tables (FIXTURES.md §2).  On them each
query is stated in terms of day sets per contract: an event is followed by another if
one EXISTS within a number of days, a contract is marked if any of its rows is
followed by a departure, and recurrence is a per-contract summary of the slots of one
pair set.  Month and counts are BIGINT on both sides, and means of whole days use exact
integer rounding.
"""

from __future__ import annotations

from churnlab.config import FIXTURE_RULES, Rules

DOMAIN_CTES = """
sales AS (
  SELECT o.o_custkey AS contract,
         CAST(o.o_orderdate AS DATE) AS sale_date,
         CASE WHEN o.o_orderpriority = '5-LOW' THEN 'renewal' ELSE 'new' END AS sale_type,
         c.c_mktsegment AS customer_type,
         CASE o.o_orderkey % 40 WHEN 0 THEN 'outbound_smb' WHEN 1 THEN 'inbound_smb'
              WHEN 2 THEN 'hospitality' WHEN 3 THEN 'smb_partner' WHEN 4 THEN NULL
              ELSE 'retail' END AS sub_channel,
         CASE WHEN o.o_orderstatus = 'P' AND o.o_orderkey % 3 = 0 THEN 'plan_change'
              ELSE 'activation' END AS movement_type,
         CASE WHEN o.o_orderkey % 7 <= 2 THEN 'sale' WHEN o.o_orderkey % 7 = 3 THEN 'transfer'
              ELSE 'new_sale' END AS reason
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
),
tickets AS (
  SELECT l.l_orderkey * 10 + l.l_linenumber AS ticket_id,
         CASE WHEN l.l_partkey % 89 = 0 THEN NULL ELSE o.o_custkey END AS contract,
         CASE WHEN l.l_partkey % 97 = 0 THEN NULL ELSE CAST(l.l_shipdate AS DATE) END AS opened,
         CASE WHEN l.l_partkey % 7 = 0 THEN NULL
              ELSE CAST(l.l_shipdate AS DATE) + CAST(l.l_quantity % 20 AS INTEGER) END AS closed,
         CASE WHEN l.l_partkey % 17 = 0 THEN NULL ELSE 'service' END AS class,
         CASE WHEN l.l_quantity > 45 THEN 'technical'
              WHEN l.l_returnflag = 'A' THEN 'auto_reversal'
              ELSE 'billing_inquiry' END AS reason,
         CASE l.l_suppkey % 5 WHEN 0 THEN 'credit_note' WHEN 1 THEN 'credit_notes'
              ELSE 'general' END AS area,
         CASE WHEN l.l_linenumber = 7 THEN NULL
              WHEN l.l_partkey % 10 = 0 THEN 'aging_0_30'
              WHEN l.l_partkey % 10 = 1 THEN 'aging_over_180'
              WHEN l.l_partkey % 10 <= 5 THEN 'bill_amount'
              ELSE 'bill_detail' END AS subarea,
         CASE WHEN l.l_tax = CAST(0.08 AS DOUBLE) THEN 'void' ELSE 'closed' END AS status
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
),
service_orders AS (
  SELECT o_custkey AS contract,
         CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS opened,
         CASE WHEN o_orderkey % 13 = 0 THEN NULL
              ELSE CAST(o_orderdate AS DATE) + CAST(o_orderkey % 15 AS INTEGER) END AS finished,
         CASE WHEN o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') THEN 'uninstall'
              ELSE 'install' END AS order_type,
         CASE WHEN o_orderstatus = 'P' THEN 'open' ELSE 'completed' END AS status
  FROM orders
),
discounts AS (
  SELECT l_orderkey * 10 + l_linenumber AS ticket_id,
         CASE WHEN l_discount = CAST(0.0 AS DOUBLE) THEN CAST(0.0 AS DOUBLE)
              ELSE round(l_extendedprice * l_discount, 2) END AS discount_amount,
         l_discount AS discount_pct,
         CASE WHEN l_suppkey % 4 = 0 THEN DATE '1900-01-01'
              WHEN l_partkey % 23 = 0 THEN NULL
              ELSE CAST(l_shipdate AS DATE) + CAST(l_partkey % 120 - 80 AS INTEGER) END AS discount_end,
         CAST(l_shipdate AS DATE) + CAST(2 - l_quantity % 10 AS INTEGER) AS ticket_date
  FROM lineitem WHERE l_linestatus = 'F'
),
retention_tickets AS (
  SELECT CASE WHEN l.l_partkey % 89 = 0 THEN NULL ELSE o.o_custkey END AS contract,
         l.l_orderkey * 10 + l.l_linenumber AS ticket_id,
         CASE WHEN l.l_partkey % 53 = 0 THEN NULL
              ELSE l.l_shipdate + INTERVAL 15 HOUR END AS finished_ts,
         CASE WHEN l.l_tax >= CAST(0.02 AS DOUBLE) THEN 'retained' ELSE 'lost' END AS outcome,
         CASE l.l_returnflag WHEN 'R' THEN 'offer' WHEN 'A' THEN 'service'
              ELSE 'relocation' END AS subarea_group,
         CASE WHEN l.l_suppkey % 14 = 13 THEN NULL
              WHEN l.l_suppkey % 14 % 2 = 0 AND l.l_suppkey % 14 < 11
                   THEN 'excluded_' || CAST(l.l_suppkey % 14 AS VARCHAR)
              ELSE 'discount' END AS strategy
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  WHERE l.l_linestatus = 'O' OR l.l_suppkey % 3 = 0
)"""


def _texts(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _query(*parts: str) -> str:
    *ctes, last = parts
    return "WITH " + ",\n".join([DOMAIN_CTES.strip(), *ctes]) + "\n" + last


def _monthly(rows: str, day: str, key: str = "contract", by: str = "", marked: bool = True) -> str:
    """Distinct keys by month, and of these the ones with marked and with unmarked contracts."""
    group = f"{by}, " if by else ""
    split = f""",
  COUNT(DISTINCT {key}) FILTER (WHERE departed) AS churned,
  COUNT(DISTINCT {key}) FILTER (WHERE NOT departed) AS kept""" if marked else ""
    state = ", COALESCE(contract IN (SELECT contract FROM marked), FALSE) AS departed" if marked else ""
    return f"""SELECT {group}CAST(month({day}) AS BIGINT) AS month, COUNT(DISTINCT {key}) AS total{split}
FROM (SELECT *{state} FROM {rows}) GROUP BY ALL"""


def _followed(row_day: str, by: str, first: int, last: int, row: str = "e", key: str = "contract") -> str:
    """Some day of ``by`` is ``first`` to ``last`` days after the row's day."""
    return f"EXISTS (SELECT 1 FROM {by} f WHERE f.{key} = {row}.{key} AND f.day - {row}.{row_day} BETWEEN {first} AND {last})"


def _marked(rows: str, day: str, first: int = 1, last: int = 60, by: str = "departure") -> str:
    return f"marked AS (SELECT contract FROM {rows} e WHERE {_followed(day, by, first, last)} GROUP BY contract)"


def _mean(days: str, weight: str, unit: int = 1) -> str:
    """Exact half-up mean of whole numbers of a ``unit``-th, two places."""
    return f"CAST((200 * SUM({days} * {weight}) + {unit} * NULLIF(SUM({weight}), 0)) // (2 * {unit} * SUM({weight})) AS DOUBLE) / 100"


def build(rules: Rules = FIXTURE_RULES) -> dict[str, str]:
    r = rules
    usable = f"class IS NOT NULL AND subarea NOT IN ({_texts(r.aging_subareas)}) AND status <> {_texts([r.void_status])}"
    year = lambda c: f"{c} BETWEEN DATE '{r.year}-01-01' AND DATE '{r.year}-12-31'"
    open_end = f"discount_end BETWEEN DATE '{r.open_ended_year}-01-01' AND DATE '{r.open_ended_year}-12-31'"
    is_billing, is_reversal = (f"reason = {_texts([x])}" for x in (r.billing_reason, r.reversal_reason))

    def days(name: str, table: str, day: str, where: str, key: str = "contract") -> str:
        return f"{name} AS (SELECT {key}, {day} AS day FROM {table} WHERE {key} IS NOT NULL AND {where} GROUP BY ALL)"

    sale = days("sale", "sales", "sale_date", f"""sale_type = {_texts([r.new_sale_type])}
    AND customer_type IN ({_texts(r.customer_types)}) AND sub_channel NOT IN ({_texts(r.excluded_sub_channels)})
    AND movement_type = {_texts([r.movement_type])} AND reason IN ({_texts(r.sale_reasons)}) AND {year('sale_date')}""")
    inquiry = days("inquiry", "tickets", "opened", f"opened IS NOT NULL AND {usable} AND {is_billing}")
    reversal = days("reversal", "tickets", "opened", f"{usable} AND {is_reversal}")
    departure = days("departure", "service_orders", "finished", f"""opened IS NOT NULL AND finished IS NOT NULL
    AND order_type = {_texts([r.uninstall_type])} AND status = {_texts([r.completed_status])}""")

    def met(first: int, last: int, rows: str = "sale") -> str:
        """Pairs of a row's day and an inquiry's day, with the 60-day slot they are apart."""
        return f"""met AS (SELECT contract, e.day AS began, i.day AS asked, (i.day - e.day - 1) // 60 AS slot
  FROM {rows} e JOIN inquiry i USING (contract) WHERE i.day - e.day BETWEEN {first} AND {last})"""

    out: dict[str, str] = {}

    # new sales
    out["q01_sale_to_ticket"] = _query(
        sale, inquiry, f"asked_soon AS (SELECT * FROM sale e WHERE {_followed('day', 'inquiry', 1, 60)})", _monthly("asked_soon", "day", marked=False)
    )
    for name, first, last in (("q02_sale_to_ticket_churn", 1, 60), ("q03_tenure_ticket_churn", 180, 210)):
        out[name] = _query(sale, inquiry, departure, met(first, last), _marked("met", "asked"), _monthly("met", "began"))

    def recurring(slots: int, segment: str) -> list[str]:
        """Rows of the last slot with what their contract did in the earlier ones."""
        history = ", ".join(f"bool_or(slot = {i}) AS slot{i}" for i in range(slots - 1))
        return [
            sale,
            inquiry,
            met(1, 60 * slots),
            f"history AS (SELECT contract, {history} FROM met GROUP BY contract)",
            f"recurring AS (SELECT contract, began, asked, {segment} AS segment FROM met JOIN history USING (contract) WHERE slot = {slots - 1})",
        ]

    two = recurring(2, "if(slot0, 'repeat', 'new')")
    three = recurring(3, "if(NOT slot1, 'new', if(slot0, 'repeat_le_2m', 'repeat_2m_4m'))")
    out["q04_repeat_ticket_segments"] = _query(*two, _monthly("recurring", "began", by="segment", marked=False))
    for name, parts in (("q05_repeat_ticket_segments_churn", two), ("q06_repeat_ticket_3_segments_churn", three)):
        out[name] = _query(departure, *parts, _marked("recurring", "asked"), _monthly("recurring", "began", by="segment"))

    # discounts
    out["q07_discount_end_to_ticket"] = _query(
        days("inquiry", "tickets", "opened", f"opened IS NOT NULL AND {usable} AND {is_billing}", "ticket_id"),
        f"""ended AS (SELECT * FROM discounts e WHERE {year('discount_end')} AND {year('ticket_date')}
    AND {_followed('discount_end', 'inquiry', 1, 60, key='ticket_id')})""",
        _monthly("ended", "discount_end", "ticket_id", marked=False),
    )
    followed_up = days("departure", "service_orders", "finished", "finished IS NOT NULL")

    def granted(day: str, where: str) -> str:
        return f"granted AS (SELECT ticket_id, t.contract, d.{day} AS day FROM discounts d JOIN tickets t USING (ticket_id) WHERE {where} GROUP BY ALL)"

    out["q08_zero_discount_followup"] = _query(
        followed_up, granted("ticket_date", "discount_amount = 0"), _marked("granted", "day"), _monthly("granted", "day", "ticket_id")
    )
    out["q09_dated_discount_churn"] = _query(
        departure, granted("discount_end", f"NOT ({open_end})"), _marked("granted", "day"), _monthly("granted", "day", "ticket_id")
    )

    def retained(offer: bool = False, strategies: bool = False) -> str:
        extra = f" AND subarea_group = {_texts([r.offer_group])}" if offer else ""
        extra += f" AND strategy NOT IN ({_texts(r.excluded_strategies)})" if strategies else ""
        return f"""retained AS (SELECT contract, ticket_id, CAST(finished_ts AS DATE) AS day FROM retention_tickets
  WHERE contract IS NOT NULL AND finished_ts IS NOT NULL AND outcome = {_texts([r.retained_outcome])}{extra} GROUP BY ALL)"""

    def departures(rows: str, day: str) -> str:
        """The departure days of each marked contract."""
        return f"""departures AS (SELECT contract, day AS churn_date FROM departure g WHERE EXISTS (
  SELECT 1 FROM {rows} e WHERE e.contract = g.contract AND g.day - e.{day} BETWEEN 1 AND 60))"""

    times = "times AS (SELECT contract, COUNT(*) AS n FROM departures GROUP BY contract)"
    for name, where in (("q10_zero_pct_retained_churn", "discount_pct = 0"), ("q10_any_pct", "TRUE")):
        out[name] = _query(
            departure,
            retained(offer=True),
            f"granted AS (SELECT ticket_id, discount_pct, retained.contract, day FROM discounts JOIN retained USING (ticket_id) WHERE {where} GROUP BY ALL)",
            departures("granted", "day"),
            times,
            f"""SELECT CAST(month(day) AS BIGINT) AS month, COUNT(DISTINCT ticket_id) AS total,
  COUNT(DISTINCT ticket_id) FILTER (WHERE n IS NOT NULL) AS churned, COUNT(DISTINCT ticket_id) FILTER (WHERE n IS NULL) AS kept,
  {_mean('CAST(round(discount_pct * 1000000) AS BIGINT)', 'COALESCE(n, 1)', 1000000)} AS mean_pct
FROM granted LEFT JOIN times USING (contract) GROUP BY ALL""",
        )

    def reversed_discounts(where: str) -> str:
        return f"""matched AS (SELECT t.ticket_id, d.ticket_id AS discount_ticket_id, t.contract,
    t.opened AS reversal_date, d.ticket_date AS discount_date
  FROM tickets t, discounts d WHERE t.ticket_id = d.ticket_id AND {is_reversal} AND {where} GROUP BY ALL)"""

    out["q11_reversal_discount_match"] = _query(reversed_discounts("TRUE"), "SELECT * FROM matched")
    out["q12_open_discount_reversal_churn"] = _query(
        departure,
        reversed_discounts(f"{usable} AND {open_end} AND t.opened > d.ticket_date"),
        departures("matched", "reversal_date"),
        "SELECT matched.*, churn_date FROM matched LEFT JOIN departures USING (contract)",
    )

    # retention
    out["q13_retained_by_month"] = _query(retained(), _monthly("retained", "day", marked=False))
    for name, offer, strategies, first, last in (
        ("q14_retained_offer_churn_0_60", True, False, 1, 60),
        ("q15_retained_offer_churn_90_120", True, False, 91, 120),
        ("q16_retained_strategy_churn_90_120", False, True, 91, 120),
        ("q17_retained_offer_strategy_churn_0_120", True, True, 1, 120),
    ):
        out[name] = _query(departure, retained(offer, strategies), _marked("retained", "day", first, last), _monthly("retained", "day"))

    # reversals
    out["q18_reversals_by_month"] = _query(reversal, _monthly("reversal", "day", marked=False))
    called = [departure, reversal, inquiry, met(1, 60, "reversal"), _marked("met", "asked")]
    out["q19_reversal_ticket_churn"] = out["q20c_reversal_with_call_churn"] = _query(*called, _monthly("met", "began"))
    silent = f"silent AS (SELECT * FROM reversal s WHERE NOT EXISTS (SELECT 1 FROM reversal e WHERE e.contract = s.contract AND {_followed('day', 'inquiry', 1, 60)}))"
    out["q20a_reversal_no_call_churn"] = _query(departure, reversal, inquiry, silent, _marked("silent", "day"), _monthly("silent", "day"))
    out["q20b_reversal_no_call_as_written"] = _query(
        reversal, inquiry, silent, "SELECT CAST(NULL AS BIGINT) AS month, CAST(0 AS BIGINT) AS total FROM (SELECT 1) WHERE EXISTS (SELECT 1 FROM silent)"
    )
    quiet_marked = _marked("silent", "day").replace("marked AS", "quiet_marked AS", 1)
    columns = ", ".join(f"MAX({c}) FILTER (WHERE side = '{side}') AS {side}_{c}" for side in ("called", "not_called") for c in ("total", "churned", "kept"))
    out["q20d_reversal_call_comparison"] = _query(
        *called,
        silent,
        quiet_marked,
        f"sides AS (SELECT 'called' AS side, * FROM ({_monthly('met', 'began')}) UNION ALL SELECT 'not_called', * FROM ({_monthly('silent', 'day').replace('FROM marked)', 'FROM quiet_marked)')}))",
        f"SELECT month, {columns} FROM sides GROUP BY month",
    )

    # credit notes
    notes = f"""notes AS (SELECT contract, opened, closed, closed - opened AS took FROM tickets WHERE contract IS NOT NULL
  AND opened IS NOT NULL AND {usable} AND {is_billing} AND area IN ({_texts(r.credit_note_areas)}) GROUP BY ALL)"""
    out["q21_credit_note_resolution"] = _query(
        notes, f"SELECT CAST(month(opened) AS BIGINT) AS month, {_mean('took', '1')} AS mean_days, COUNT(DISTINCT contract) AS total FROM notes WHERE took > 0 GROUP BY ALL"
    )
    out["q22_credit_note_resolution_churn"] = _query(
        departure,
        notes,
        departures("notes", "closed"),
        times,
        f"""SELECT CAST(month(opened) AS BIGINT) AS month, {_mean('took', 'COALESCE(n, 1)')} AS mean_days, COUNT(DISTINCT contract) AS total,
  {_mean('took', 'n')} AS churned_mean_days, COUNT(DISTINCT contract) FILTER (WHERE n IS NOT NULL) AS churned,
  {_mean('took', 'if(n IS NULL, 1, NULL)')} AS kept_mean_days, COUNT(DISTINCT contract) FILTER (WHERE n IS NULL) AS kept
FROM notes LEFT JOIN times USING (contract) WHERE took > 0 GROUP BY ALL""",
    )

    # toggles: the row's own flag, other windows, narrower inquiries, all months apart, detail rows
    def by_row(rows: str, began: str, asked: str) -> str:
        hit = _followed(asked, "departure", 1, 60)
        return f"""SELECT CAST(month({began}) AS BIGINT) AS month, COUNT(DISTINCT contract) AS total,
  COUNT(DISTINCT contract) FILTER (WHERE hit) AS churned, COUNT(DISTINCT contract) FILTER (WHERE NOT hit) AS kept
FROM (SELECT *, {hit} AS hit FROM {rows} e) GROUP BY ALL"""

    out["q02_event_flag"] = _query(sale, inquiry, departure, met(1, 60), by_row("met", "began", "asked"))
    out["q19_event_flag"] = _query(departure, reversal, inquiry, met(1, 60, "reversal"), by_row("met", "began", "asked"))
    # other join keys or another way to count, same rows
    out["q13_by_bitmaps"] = out["q13_retained_by_month"]
    out["q02_auto_bins"], out["q19_auto_bins"] = out["q02_sale_to_ticket_churn"], out["q19_reversal_ticket_churn"]
    for name, offer, strategies, last in (("q14_window_0_30", True, False, 30), ("q17_window_0_60", True, True, 60)):
        out[name] = _query(departure, retained(offer, strategies), _marked("retained", "day", 1, last), _monthly("retained", "day"))
    for name, where in (("q02_subarea", "subarea = 'bill_amount'"), ("q02_area", f"area IN ({_texts(r.credit_note_areas)})")):
        narrow = days("inquiry", "tickets", "opened", f"opened IS NOT NULL AND {usable} AND {is_billing} AND {where}")
        out[name] = _query(sale, narrow, departure, met(1, 60), _marked("met", "asked"), _monthly("met", "began"))
    out["q08_strict"] = _query(departure, granted("ticket_date", "discount_amount = 0"), _marked("granted", "day"), _monthly("granted", "day", "ticket_id"))
    out["q11_probe"] = _query(reversed_discounts(f"{usable} AND {open_end} AND t.opened > d.ticket_date"), "SELECT * FROM matched")
    out["q19_year_month"] = out["q19_reversal_ticket_churn"].replace("CAST(month(began) AS BIGINT)", "CAST(100 * year(began) + month(began) AS BIGINT)")
    # detail rows: each once per departure day of its marked contract, recurring ones also
    # once per row of the earlier slots
    fate = "churn_date, churn_date IS NOT NULL AS churned"
    for name, parts, began in (
        ("q02_detail", [sale, inquiry, departure, met(1, 60)], "sale_date"),
        ("q03_detail", [sale, inquiry, departure, met(180, 210)], "sale_date"),
        ("q19_detail", [departure, reversal, inquiry, met(1, 60, "reversal")], "reversal_date"),
    ):
        out[name] = _query(
            *parts, departures("met", "asked"), f"SELECT DISTINCT contract, began AS {began}, asked AS ticket_date, {fate} FROM met LEFT JOIN departures USING (contract)"
        )
    row = "r.segment, r.contract, r.began AS sale_date, r.asked AS ticket_date"
    first = "LEFT JOIN (SELECT * FROM met WHERE slot = 0) a ON a.contract"
    out["q04_detail"] = _query(
        *two, f"SELECT DISTINCT {row}, a.contract AS contract_1, a.began AS sale_date_1, a.asked AS ticket_date_1 FROM recurring r {first} = r.contract"
    )
    out["q05_detail"] = _query(
        departure,
        *two,
        departures("recurring", "asked"),
        f"""SELECT DISTINCT {row}, {fate}, a.contract AS contract_1, a.asked AS ticket_date_1
FROM recurring r LEFT JOIN departures d ON d.contract = r.contract {first} = r.contract""",
    )
    out["q06_detail"] = _query(
        departure,
        *three,
        departures("recurring", "asked"),
        f"""SELECT DISTINCT {row}, {fate}, b.contract AS contract_2, b.asked AS ticket_date_2, a.contract AS contract_1, a.asked AS ticket_date_1
FROM recurring r LEFT JOIN departures d ON d.contract = r.contract LEFT JOIN (SELECT * FROM met WHERE slot = 1) b ON b.contract = r.contract {first} = b.contract""",
    )
    out["q19_event_detail"] = _query(
        departure,
        reversal,
        inquiry,
        met(1, 60, "reversal"),
        f"""SELECT DISTINCT e.contract, began AS reversal_date, asked AS ticket_date, g.day AS churn_date, g.day IS NOT NULL AS churned
FROM met e LEFT JOIN departure g ON g.contract = e.contract AND g.day - e.asked BETWEEN 1 AND 60""",
    )
    # narrower inquiries and the row's own flag in the queries of later tickets
    narrow = days("inquiry", "tickets", "opened", f"opened IS NOT NULL AND {usable} AND {is_billing} AND subarea = 'bill_detail'")
    out["q03_subarea"] = _query(sale, narrow, departure, met(180, 210), _marked("met", "asked"), _monthly("met", "began"))
    narrow = days("inquiry", "tickets", "opened", f"opened IS NOT NULL AND {usable} AND {is_billing} AND area IN ({_texts(r.credit_note_areas)})")
    out["q04_area"] = _query(*[narrow if p is inquiry else p for p in two], _monthly("recurring", "began", by="segment", marked=False))
    for name, parts in (("q05_event_flag", two), ("q06_event_flag", three)):
        out[name] = _query(departure, *parts, by_row("recurring", "began", "asked").replace("SELECT CAST", "SELECT segment, CAST", 1))
    return out


ORACLE_SQL = build(FIXTURE_RULES)

RAW_VIEWS = ("customer", "orders", "lineitem")


def duckdb_connection(sf_dir: str):
    """In-process DuckDB with the raw tables as views (tests only)."""
    import os

    import duckdb

    con = duckdb.connect()
    for name in RAW_VIEWS:
        path = os.path.join(sf_dir, f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con
