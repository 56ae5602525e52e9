"""Qualify operators: turn a domain table into distinct anchor events.

Every operator filters, projects and de-duplicates.  The de-duplication is
what bounds the later joins: a contract contributes at most one row per
distinct date, however many raw rows it has.  ``distinct`` shuffles on all
output columns (after a map-side partial aggregate), so one hot contract is
spread over tasks by date here rather than landing on a single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlab.config import Rules
from churnlab.functions.dates import in_year, to_day
from churnlab.functions.predicates import any_of, none_of
from churnlab.operators.skew import shared_distinct


def new_sales(sales: DataFrame, rules: Rules, year: int | None = None) -> DataFrame:
    """Qualified new sales of one year -> distinct ``(contract, sale_date)``."""
    y = rules.year if year is None else year
    return (
        sales.filter(
            (F.col("sale_type") == rules.new_sale_type)
            & any_of(F.col("customer_type"), rules.customer_types)
            & in_year(F.col("sale_date"), y)
            & none_of(F.col("sub_channel"), rules.excluded_sub_channels)
            & (F.col("movement_type") == rules.movement_type)
            & any_of(F.col("reason"), rules.sale_reasons)
            & F.col("contract").isNotNull()
        )
        .select("contract", "sale_date")
        .distinct()
    )


def _clean_ticket(rules: Rules):
    # class present, sub-area outside the ageing buckets, status not void
    return (
        F.col("class").isNotNull()
        & none_of(F.col("subarea"), rules.aging_subareas)
        & none_of(F.col("status"), (rules.void_status,))
    )


def billing_tickets(
    tickets: DataFrame,
    rules: Rules,
    key: str = "contract",
    subarea: str | None = None,
    area: tuple[str, ...] | None = None,
) -> DataFrame:
    """Clean billing-inquiry tickets -> distinct ``(key, ticket_date)``.

    ``key`` is ``contract`` or ``ticket_id``; ``subarea`` / ``area`` are the
    optional narrowing filters of the scripts.
    """
    cond = (
        _clean_ticket(rules)
        & (F.col("reason") == rules.billing_reason)
        & F.col(key).isNotNull()
        & F.col("opened").isNotNull()
    )
    if subarea is not None:
        cond = cond & (F.col("subarea") == subarea)
    if area is not None:
        cond = cond & any_of(F.col("area"), area)
    return tickets.filter(cond).select(key, F.col("opened").alias("ticket_date")).distinct()


def reversals(
    tickets: DataFrame,
    rules: Rules,
    clean: bool = True,
    with_ticket: bool = False,
) -> DataFrame:
    """Automatic reversals -> distinct ``(contract, reversal_date)``.

    The opening date is not required, so a null ``reversal_date`` can appear.
    ``with_ticket`` keys rows by ticket id (contract may then be null);
    ``clean=False`` applies the reason filter alone.
    """
    cond = F.col("reason") == rules.reversal_reason
    if clean:
        cond = cond & _clean_ticket(rules)
        cond = cond & (F.col("ticket_id").isNotNull() if with_ticket else F.col("contract").isNotNull())
    cols = (["ticket_id"] if with_ticket else []) + ["contract", F.col("opened").alias("reversal_date")]
    return tickets.filter(cond).select(*cols).distinct()


REVERSAL_BIT, BILLING_BIT = 1, 2


def ticket_events(tickets: DataFrame, rules: Rules) -> DataFrame:
    """Reversals and billing tickets in one pass -> distinct
    ``(contract, day, kinds)``, ``kinds`` a bit mask of the kinds seen
    that day (1 reversal, 2 billing).

    The kind is aggregated per (contract, day) instead of grouped on, and
    every branch reads the same two aggregate outputs (the mask and ``day``,
    the group's own date), so filters added later (``day IS NOT NULL``
    inferred from a join) stay above the aggregate and all branches keep an
    identical aggregate: queries that need both kinds share one scan and one
    shuffle of the tickets table (Spark reuses the identical exchange).
    """
    base = tickets.filter(
        _clean_ticket(rules)
        & F.col("contract").isNotNull()
        & F.col("reason").isin(rules.reversal_reason, rules.billing_reason)
    )
    kind = F.when(F.col("reason") == rules.reversal_reason, F.lit(REVERSAL_BIT)).otherwise(F.lit(BILLING_BIT))
    return base.groupBy("contract", "opened").agg(
        F.bit_or(kind).alias("kinds"), F.max("opened").alias("day")
    ).select("contract", "day", "kinds")


def _has(bit: int):
    return F.col("kinds").bitwiseAND(F.lit(bit)) == bit


def is_reversal():
    """The (contract, day) of :func:`ticket_events` has a reversal."""
    return _has(REVERSAL_BIT)


def is_billing():
    """The (contract, day) of :func:`ticket_events` has a billing ticket."""
    return _has(BILLING_BIT)


def reversals_from_events(events: DataFrame) -> DataFrame:
    """``reversals(..., clean=True)`` taken from :func:`ticket_events`."""
    return events.filter(_has(REVERSAL_BIT)).select("contract", F.col("day").alias("reversal_date"))


def billing_from_events(events: DataFrame) -> DataFrame:
    """``billing_tickets(...)`` (by contract) taken from :func:`ticket_events`."""
    return events.filter(_has(BILLING_BIT) & F.col("day").isNotNull()).select(
        "contract", F.col("day").alias("ticket_date")
    )


def credit_notes(tickets: DataFrame, rules: Rules) -> DataFrame:
    """Clean billing tickets of the credit-note areas -> distinct
    ``(contract, opened, closed)`` (``closed`` may be null)."""
    cond = (
        _clean_ticket(rules)
        & (F.col("reason") == rules.billing_reason)
        & any_of(F.col("area"), rules.credit_note_areas)
        & F.col("contract").isNotNull()
        & F.col("opened").isNotNull()
    )
    return tickets.filter(cond).select("contract", "opened", "closed").distinct()


def retained(
    retention: DataFrame,
    rules: Rules,
    offer_only: bool = False,
    exclude_strategies: bool = False,
    with_ticket: bool = False,
) -> DataFrame:
    """Retained contracts -> distinct ``(contract, [ticket_id,] retained_date)``.

    ``retained_date`` is ``DATE(finished_ts)``.  ``exclude_strategies`` drops
    the listed strategies and, like the scripts' ``<>`` chain, null ones too.
    """
    cond = (
        F.col("contract").isNotNull()
        & F.col("finished_ts").isNotNull()
        & (F.col("outcome") == rules.retained_outcome)
    )
    if offer_only:
        cond = cond & (F.col("subarea_group") == rules.offer_group)
    if exclude_strategies:
        cond = cond & none_of(F.col("strategy"), rules.excluded_strategies)
    cols = ["contract"] + (["ticket_id"] if with_ticket else [])
    # DATE(ts): the wall-clock day of a zone-less timestamp, the UTC day of a
    # zoned one (independent of the session time zone)
    day = to_day(F.col("finished_ts"), retention.schema["finished_ts"].dataType).alias("retained_date")
    # never drops a row (the timestamp is already non-null); stated so that
    # filters later joins infer on the day are already present in every branch
    return retention.filter(cond).select(*cols, day).filter(F.col("retained_date").isNotNull()).distinct()


def uninstalls(service_orders: DataFrame, rules: Rules) -> DataFrame:
    """Completed uninstall orders (the churn event) -> distinct
    ``(contract, churn_date)``; both order dates must be present."""
    return (
        service_orders.filter(
            (F.col("order_type") == rules.uninstall_type)
            & (F.col("status") == rules.completed_status)
            & F.col("finished").isNotNull()
            & F.col("opened").isNotNull()
            & F.col("contract").isNotNull()
        )
        .select("contract", F.col("finished").alias("churn_date"))
        .distinct()
    )


def finished_orders(service_orders: DataFrame) -> DataFrame:
    """Any finished service order, whatever its type or status -> distinct
    ``(contract, churn_date)``."""
    return (
        service_orders.filter(F.col("finished").isNotNull() & F.col("contract").isNotNull())
        .select("contract", F.col("finished").alias("churn_date"))
        .distinct()
    )


# -- discounts ---------------------------------------------------------------


def _picked(rows: DataFrame, unique: bool) -> DataFrame:
    return rows.distinct() if unique else rows


def zero_amount_discounts(discounts: DataFrame, unique: bool = True) -> DataFrame:
    """Discounts of amount 0 -> distinct ``(ticket_id, discount_date)``."""
    rows = discounts.filter(F.col("discount_amount") == 0.0)
    return _picked(rows.select("ticket_id", F.col("ticket_date").alias("discount_date")), unique)


def dated_discounts(discounts: DataFrame, rules: Rules, unique: bool = True) -> DataFrame:
    """Discounts with a real end date (not the open-ended sentinel year) ->
    distinct ``(ticket_id, discount_end)``; a null end is dropped."""
    rows = discounts.filter(~in_year(F.col("discount_end"), rules.open_ended_year))
    return _picked(rows.select("ticket_id", "discount_end"), unique)


def open_ended_discounts(discounts: DataFrame, rules: Rules, unique: bool = True) -> DataFrame:
    """Discounts whose end carries the sentinel year -> distinct
    ``(ticket_id, discount_date)``."""
    rows = discounts.filter(in_year(F.col("discount_end"), rules.open_ended_year))
    return _picked(rows.select("ticket_id", F.col("ticket_date").alias("discount_date")), unique)


def all_discounts(discounts: DataFrame, unique: bool = True) -> DataFrame:
    """Every discount -> distinct ``(ticket_id, discount_date)``."""
    return _picked(discounts.select("ticket_id", F.col("ticket_date").alias("discount_date")), unique)


def pct_discounts(discounts: DataFrame, unique: bool = True) -> DataFrame:
    """Every discount -> distinct ``(ticket_id, discount_pct)``."""
    return _picked(discounts.select("ticket_id", "discount_pct"), unique)


def zero_pct_discounts(discounts: DataFrame, unique: bool = True) -> DataFrame:
    """Discounts of 0 percent -> distinct ``(ticket_id, discount_pct)``."""
    return pct_discounts(discounts.filter(F.col("discount_pct") == 0.0), unique)


def year_discounts(discounts: DataFrame, rules: Rules, year: int | None = None, unique: bool = True) -> DataFrame:
    """Discounts whose end and ticket dates both fall in ``year`` ->
    distinct ``(ticket_id, discount_end, discount_date)``."""
    y = rules.year if year is None else year
    rows = discounts.filter(F.col("ticket_id").isNotNull() & in_year(F.col("discount_end"), y) & in_year(F.col("ticket_date"), y))
    return _picked(rows.select("ticket_id", "discount_end", F.col("ticket_date").alias("discount_date")), unique)


DISCOUNT_KINDS = ("zero_amount", "zero_pct", "pct", "dated", "open_ended", "all", "within_year")


def discounts(discounts: DataFrame, rules: Rules, kind: str, year: int | None = None, unique: bool = True) -> DataFrame:
    """One qualify entry point for the discount subsets the scripts use.  With
    ``unique=False`` rows aren't de-duplicated yet (:func:`attach_ticket` does it)."""
    if kind == "zero_amount":
        return zero_amount_discounts(discounts, unique)
    if kind == "zero_pct":
        return zero_pct_discounts(discounts, unique)
    if kind == "pct":
        return pct_discounts(discounts, unique)
    if kind == "dated":
        return dated_discounts(discounts, rules, unique)
    if kind == "open_ended":
        return open_ended_discounts(discounts, rules, unique)
    if kind == "all":
        return all_discounts(discounts, unique)
    if kind == "within_year":
        return year_discounts(discounts, rules, year, unique)
    raise ValueError(f"unknown discount kind {kind!r}; one of {DISCOUNT_KINDS}")


def ticket_contracts(tickets: DataFrame) -> DataFrame:
    """Ticket id -> contract lookup (contract may be null), distinct.

    The contract comes out through a count, so a filter on it (``contract IS NOT NULL``
    inferred from a later join) stays above and all readers share one scan.
    """
    found = tickets.filter(F.col("ticket_id").isNotNull()).groupBy("ticket_id", F.col("contract").alias("_owner"))
    return found.agg(F.count("*").alias("_n")).select("ticket_id", F.when(F.col("_n") > 0, F.col("_owner")).alias("contract"))


def attach_ticket(left: DataFrame, tickets: DataFrame) -> DataFrame:
    """Distinct rows of ``left`` (keyed by ticket id) with their ticket's contract (inner
    equi-join on ``ticket_id``; a ticket id with several contracts gives a row for each).

    ``left`` is a filtered projection, not yet de-duplicated: then Spark builds its runtime
    Bloom filter from the scan of ``left`` and drops the tickets that can't match before
    they are de-duplicated and shuffled (:func:`churnlab.session.tune` sets from what size
    on).  The join's rows are de-duplicated once, in an exchange that all readers share.
    """
    rows = left.filter(F.col("ticket_id").isNotNull()).join(ticket_contracts(tickets), "ticket_id", "inner")
    return shared_distinct(rows, [*left.columns, "contract"])
