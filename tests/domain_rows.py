"""Builders for hand-made domain tables (edge cases with known answers)."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from churnlab.sources import DomainTables

SCHEMAS = {
    "sales": "contract BIGINT, sale_date DATE, sale_type STRING, customer_type STRING, "
    "sub_channel STRING, movement_type STRING, reason STRING",
    "tickets": "ticket_id BIGINT, contract BIGINT, opened DATE, closed DATE, class STRING, "
    "reason STRING, area STRING, subarea STRING, status STRING",
    "service_orders": "contract BIGINT, opened DATE, finished DATE, order_type STRING, status STRING",
    "discounts": "ticket_id BIGINT, discount_amount DOUBLE, discount_pct DOUBLE, discount_end DATE, "
    "ticket_date DATE",
    "retention_tickets": "contract BIGINT, ticket_id BIGINT, finished_ts TIMESTAMP_NTZ, outcome STRING, "
    "subarea_group STRING, strategy STRING",
}

D0 = date(1997, 1, 10)


def day(n: int) -> date:
    return D0 + timedelta(days=n)


_ids = iter(range(10_000, 10_000_000))


def sale(contract, d, sale_type="new", customer_type="HOUSEHOLD", sub_channel="retail",
         movement_type="activation", reason="sale"):
    return (contract, d, sale_type, customer_type, sub_channel, movement_type, reason)


def ticket(contract, opened, *, ticket_id=None, closed=None, cls="service", reason="billing_inquiry",
           area="general", subarea="bill_amount", status="closed"):
    return (next(_ids) if ticket_id is None else ticket_id, contract, opened, closed, cls, reason, area,
            subarea, status)


def order(contract, finished, *, opened="same", order_type="uninstall", status="completed"):
    return (contract, finished if opened == "same" else opened, finished, order_type, status)


def discount(ticket_id, *, amount=0.0, pct=0.0, end=None, ticket_date=None):
    return (ticket_id, amount, pct, end, ticket_date)


def retention(contract, ts, *, ticket_id=None, outcome="retained", group="offer", strategy="discount"):
    if isinstance(ts, date) and not isinstance(ts, datetime):
        ts = datetime(ts.year, ts.month, ts.day, 12, 0)
    return (contract, next(_ids) if ticket_id is None else ticket_id, ts, outcome, group, strategy)


def tables(spark, sales=(), tickets=(), orders=(), discounts=(), retention=()) -> DomainTables:
    rows = {
        "sales": sales,
        "tickets": tickets,
        "service_orders": orders,
        "discounts": discounts,
        "retention_tickets": retention,
    }
    return DomainTables.from_frames(
        {name: spark.createDataFrame(list(r), SCHEMAS[name]) for name, r in rows.items()}
    )


def rows(df, *cols):
    """Collected rows as tuples (optionally of the named columns), sorted."""
    sel = df.select(*cols) if cols else df
    return sorted((tuple(r) for r in sel.collect()), key=repr)
