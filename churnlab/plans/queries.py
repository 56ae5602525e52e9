"""The 22 named queries, composed from the operators.

Every query takes the domain tables and a ``Rules`` value and returns a
DataFrame; nothing is collected.  Counting queries return one row per cohort
month (and segment) with ``total`` and, where a churn step exists, ``churned``
and ``kept``: the figure each script prints is one of these columns.  The
scripts' commented-out variants are keyword toggles:

* ``flag_level="event"``: churn counted against the row's own window only
  (default ``"contract"``: one churn marks every anchor of the contract);
* ``cohort="year_month"``: group by ``yyyymm`` instead of the month number;
* ``subarea=`` / ``area=``: narrower billing tickets;
* ``detail=True``: distinct detail rows instead of counts;
* ``strict=True`` (Q08): only completed uninstalls count as churn.
"""

from __future__ import annotations

import datetime
import hashlib
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlab.config import (
    NEW,
    RECURRENCE_2,
    RECURRENCE_3,
    REPEAT,
    REPEAT_2M_4M,
    REPEAT_LE_2M,
    W_0_60,
    W_0_120,
    W_90_120,
    W_AFTER,
    W_TENURE,
    DayWindow,
    Rules,
)
from churnlab.functions.dates import cohort as cohort_of
from churnlab.functions.rounding import half_up_mean_units, units
from churnlab.operators import bitmaps
from churnlab.operators import cohorts as q
from churnlab.operators.flags import (
    attach_earlier,
    attach_outcomes,
    flag_rows,
    flag_via_anchors,
    lift_flag,
    mark_contact,
    outcome_counts,
    segment_recurrence,
    split_contacted,
)
from churnlab.operators.metrics import detail as detail_rows
from churnlab.operators.metrics import monthly_counts, monthly_mean_days, ordered
from churnlab.operators.skew import shared_distinct, spread_left_join
from churnlab.operators.windows import events_within, follow_on, reachable
from churnlab.sources import DomainTables

# --------------------------------------------------------------------------
# shared steps
# --------------------------------------------------------------------------


def _uninstalls(t: DomainTables, rules: Rules) -> DataFrame:
    return t.memo(("uninstalls", rules), lambda: q.uninstalls(t.service_orders, rules))


def _uninstalls_after(t: DomainTables, rules: Rules, anchors: tuple, window: DayWindow = W_0_60) -> DataFrame:
    """Uninstalls that can follow the anchor set of that memo key: between the days reachable
    from its earliest and latest row where these are known (:func:`measure_reach`), else all."""
    days = t.reach.get(anchors)
    churn = _uninstalls(t, rules)
    return churn if days is None else reachable(churn, "churn_date", *days, window)


def _new_sales(t: DomainTables, rules: Rules) -> DataFrame:
    return t.memo(("new_sales", rules), lambda: q.new_sales(t.sales, rules))


def _ticket_events(t: DomainTables, rules: Rules) -> DataFrame:
    return t.memo(("ticket_events", rules), lambda: q.ticket_events(t.tickets, rules))


def _billing(t: DomainTables, rules: Rules, subarea=None, area=None) -> DataFrame:
    return t.memo(
        ("billing", rules, subarea, area), lambda: q.billing_tickets(t.tickets, rules, subarea=subarea, area=area)
    )


def _reversals(t: DomainTables, rules: Rules) -> DataFrame:
    return t.memo(("reversals", rules), lambda: q.reversals(t.tickets, rules))


def _finished_orders(t: DomainTables, rules: Rules) -> DataFrame:
    return t.memo(("finished_orders", rules), lambda: q.finished_orders(t.service_orders))


def _credit_notes(t: DomainTables, rules: Rules) -> DataFrame:
    return t.memo(("credit_notes", rules), lambda: q.credit_notes(t.tickets, rules))


def _retained(t: DomainTables, rules: Rules, offer_only=False, exclude_strategies=False) -> DataFrame:
    return t.memo(
        ("retained", rules, offer_only, exclude_strategies),
        lambda: q.retained(t.retention_tickets, rules, offer_only=offer_only, exclude_strategies=exclude_strategies),
    )


# Anchor sets that many queries start from: at most one row per key and day,
# orders of magnitude smaller than the tables they come from.
ANCHOR_SETS = {
    "new_sales": lambda t, r: _new_sales(t, r),
    "billing": lambda t, r: _billing(t, r),
    "reversals": lambda t, r: _reversals(t, r),
    "ticket_events": lambda t, r: _ticket_events(t, r),
    "uninstalls": lambda t, r: _uninstalls(t, r),
    "finished_orders": lambda t, r: _finished_orders(t, r),
    "credit_notes": lambda t, r: _credit_notes(t, r),
    "retained": lambda t, r: _retained(t, r),
    "retained_offer": lambda t, r: _retained(t, r, offer_only=True),
    "retained_strategy": lambda t, r: _retained(t, r, exclude_strategies=True),
    "retained_offer_strategy": lambda t, r: _retained(t, r, offer_only=True, exclude_strategies=True),
}
# The day of each set after which departures are looked for.
ANCHOR_DAYS = {
    "ticket_events": "day",
    "credit_notes": "closed",
    "retained": "retained_date",
    "retained_offer": "retained_date",
    "retained_strategy": "retained_date",
    "retained_offer_strategy": "retained_date",
}
_MEMO_KEYS = {
    "billing": ("billing", None, None),
    "retained": ("retained", False, False),
    "retained_offer": ("retained", True, False),
    "retained_strategy": ("retained", False, True),
    "retained_offer_strategy": ("retained", True, True),
}


def _memo_key(name: str, rules: Rules) -> tuple:
    first, *rest = _MEMO_KEYS.get(name, (name,))
    return (first, rules, *rest)


def measure_reach(t: DomainTables, rules: Rules, names: list[str] | None = None) -> None:
    """Earliest and latest day of the anchor sets, one small job each; later queries on ``t``
    read only the service orders that these days can reach, the bounds being pushed to the
    scan.  Worth it where the sets are materialized or much narrower than the orders."""
    for name, day in ANCHOR_DAYS.items():
        if names is None or name in names:
            first, last = ANCHOR_SETS[name](t, rules).agg(F.min(day), F.max(day)).first()
            t.reach[_memo_key(name, rules)] = (first, last)


def materialize_anchors(
    t: DomainTables,
    rules: Rules,
    spark,
    folder: str | None = None,
    names: list[str] | None = None,
    buckets: int | None = None,
) -> dict[str, str]:
    """Write the shared anchor sets once as parquet and make later queries on
    ``t`` read them back.

    Every query then starts from these small sets instead of re-scanning the
    source tables, and its lineage is cut there: a lost executor re-reads a
    file instead of re-running the scans and de-duplications.  ``folder``
    defaults to the cluster's shared ``spark.checkpoint.dir`` (never a
    machine-local folder); there is no default if neither is given.  Each call
    writes to its own run folder, so concurrent runs never overwrite each
    other; ``names`` restricts the sets written (default: all of
    ``ANCHOR_SETS``).

    With ``buckets`` the sets are tables of the session's catalog, bucketed and sorted by
    contract in that many files each: joins and windows on the contract then need no
    exchange.  A bucket holds a contract's rows whole, at most one per day and kind.
    :func:`drop_anchors` forgets the tables.
    """
    if folder is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            try:
                folder = spark.sparkContext.getCheckpointDir()
            except Exception:
                folder = None
    if not folder:
        raise ValueError("no folder given and spark.checkpoint.dir is not set")
    tag = "rules_" + hashlib.sha1(repr(rules).encode()).hexdigest()[:10]
    run = uuid.uuid4().hex[:12]
    unknown = set(names or ()) - set(ANCHOR_SETS)
    if unknown:
        raise ValueError(f"unknown anchor sets {sorted(unknown)}")
    paths = {}
    for name, build in ANCHOR_SETS.items():
        if names is not None and name not in names:
            continue
        path = f"{folder.rstrip('/')}/churnlab_anchors/{tag}/{run}/{name}"
        if buckets:
            table = f"churnlab_{run}_{name}"
            rows = build(t, rules).repartition(buckets, "contract")
            rows.write.bucketBy(buckets, "contract").sortBy("contract").option("path", path).format("parquet").saveAsTable(table)
            t._plans[_memo_key(name, rules)] = spark.table(table)
            t.tables.append(table)
        else:
            build(t, rules).write.mode("overwrite").parquet(path)
            t._plans[_memo_key(name, rules)] = spark.read.parquet(path)
        paths[name] = path
    measure_reach(t, rules, list(paths))
    return paths


def drop_anchors(t: DomainTables, spark) -> None:
    """Forgets the bucketed tables of ``t`` and what was measured on them; their files stay
    in the folder they were written to.  Queries start from the source tables again."""
    for table in t.tables:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    t.tables.clear()
    t._plans.clear()
    t.reach.clear()




def churn_rows(
    anchors: DataFrame,
    churn: DataFrame,
    anchor_date: str,
    window: DayWindow = W_0_60,
    bin_days: int | str | None = None,
) -> DataFrame:
    """Add a row-level ``churned``: a churn event (``contract, churn_date``)
    inside ``window`` after this row's ``anchor_date`` (one existence join)."""
    return flag_rows(anchors, churn, "contract", anchor_date, "churn_date", window, bin_days=bin_days)


def flag_key(flag_level: str) -> str | None:
    """Key the row flag is lifted to: the contract (default, as the scripts
    join churn back on contract alone) or none (``event``)."""
    if flag_level == "event":
        return None
    if flag_level == "contract":
        return "contract"
    raise ValueError(f"unknown flag_level {flag_level!r}")


def churn_detail(
    rows: DataFrame,
    churn: DataFrame,
    anchor_date: str,
    window: DayWindow,
    flag_level: str,
    cols: list[str],
) -> DataFrame:
    """Distinct detail rows with the churn date, as the scripts' commented-out lists: each row
    once per churn date inside ``window`` after any row of its contract (``flag_level="event"``:
    after the row itself), with a null date when there is none.  The rows of contracts
    with many are split (:func:`spread_left_join`)."""
    if flag_key(flag_level) is None:
        pairs = events_within(rows, churn, "contract", anchor_date, "churn_date", window)
        missed = flag_rows(rows, churn, "contract", anchor_date, "churn_date", window).filter(~F.col("churned"))
        fanned = pairs.withColumn("churned", F.lit(True)).unionByName(missed.withColumn("churn_date", F.lit(None).cast("date")))
    else:
        hits = follow_on(churn, rows, "contract", anchor_date, "churn_date", window)
        fanned = attach_outcomes(rows, hits, "contract", "churn_date", spread_by=cols)
    return detail_rows(fanned, [*cols, "churn_date", "churned"])


def _churn_counts(rows, key, date_col, *, flag_level, cohort, by=()):
    # rows are at (contract, day) grain or coarser per contract-month, so the
    # lift is a window over a handful of partial rows per contract
    return monthly_counts(rows, key, date_col, "churned", by=by, cohort=cohort, flag_key=flag_key(flag_level))


def after_sales(df: DataFrame, date: str, rules: Rules, first: int, last: int | None) -> DataFrame:
    """Rows whose date is ``first`` to ``last`` days after some day of the sales year:
    nothing else can match, and the bounds reach the scan."""
    out = df.filter(F.col(date) >= F.date_add(F.lit(datetime.date(rules.year, 1, 1)), first))
    return out if last is None else out.filter(F.col(date) <= F.date_add(F.lit(datetime.date(rules.year, 12, 31)), last))


def _uninstalls_after_sales(t: DomainTables, rules: Rules, window: DayWindow) -> DataFrame:
    """Uninstalls that can follow a ticket inside ``window`` after a sale of the year; the
    bounds reach the scan of the service orders."""
    return after_sales(_uninstalls(t, rules), "churn_date", rules, window.min_days + W_0_60.min_days, window.max_days + W_0_60.max_days)


def sale_ticket_pairs(
    t: DomainTables,
    rules: Rules,
    window: DayWindow,
    subarea: str | None = None,
    area: tuple[str, ...] | None = None,
    days_col: str | None = None,
    bin_days: int | None = None,
) -> DataFrame:
    """(contract, sale_date, ticket_date[, days]) for billing tickets inside
    ``window`` after a qualified new sale (``bin_days``: day-binned join for
    contracts with very long histories, ``"auto"`` for those only that are heavy)."""
    sales = _new_sales(t, rules)
    bills = after_sales(_billing(t, rules, subarea, area), "ticket_date", rules, window.min_days, window.max_days)
    return events_within(sales, bills, "contract", "sale_date", "ticket_date", window, days_col, bin_days)


def reversal_sets(t: DomainTables, rules: Rules, bin_days: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(reversals, reversal-ticket pairs) from one pass over the tickets."""
    events = _ticket_events(t, rules)
    revs = q.reversals_from_events(events)
    bills = q.billing_from_events(events)
    return revs, events_within(revs, bills, "contract", "reversal_date", "ticket_date", W_0_60, bin_days=bin_days)


def reversal_ticket_pairs(t: DomainTables, rules: Rules, bin_days: int | None = None) -> DataFrame:
    """(contract, reversal_date, ticket_date): billing ticket (0,60] after a reversal."""
    return reversal_sets(t, rules, bin_days)[1]


# --------------------------------------------------------------------------
# Q01-Q06: new sales -> billing tickets -> churn
# --------------------------------------------------------------------------


def q01_sale_to_ticket(
    t: DomainTables,
    rules: Rules,
    *,
    cohort="month",
    subarea=None,
    area=None,
    detail=False,
    bin_days=None,
) -> DataFrame:
    """Contracts with a billing ticket in (0,60] after a new sale, by sale month."""
    pairs = sale_ticket_pairs(t, rules, W_0_60, subarea, area, bin_days=bin_days)
    if detail:
        return pairs
    return monthly_counts(pairs, "contract", "sale_date", cohort=cohort)


def _sale_churn(t, rules, window, *, flag_level, cohort, subarea, area, detail, bin_days=None):
    pairs = sale_ticket_pairs(t, rules, window, subarea, area, bin_days=bin_days)
    churn = _uninstalls_after_sales(t, rules, window)
    if detail:
        return churn_detail(pairs, churn, "ticket_date", W_0_60, flag_level, ["contract", "sale_date", "ticket_date"])
    rows = churn_rows(pairs, churn, "ticket_date", bin_days=bin_days)
    return _churn_counts(rows, "contract", "sale_date", flag_level=flag_level, cohort=cohort)


def q02_sale_to_ticket_churn(
    t: DomainTables,
    rules: Rules,
    *,
    flag_level="contract",
    cohort="month",
    subarea=None,
    area=None,
    detail=False,
    bin_days=None,
) -> DataFrame:
    """Q01 contracts split by churn (uninstall in (0,60] after the ticket)."""
    return _sale_churn(
        t, rules, W_0_60, flag_level=flag_level, cohort=cohort, subarea=subarea, area=area, detail=detail,
        bin_days=bin_days,
    )


def q03_tenure_ticket_churn(
    t: DomainTables,
    rules: Rules,
    *,
    flag_level="contract",
    cohort="month",
    subarea=None,
    area=None,
    detail=False,
    bin_days=None,
) -> DataFrame:
    """Billing ticket in [180,210] days after the sale, then churn (0,60]."""
    return _sale_churn(
        t, rules, W_TENURE, flag_level=flag_level, cohort=cohort, subarea=subarea, area=area, detail=detail,
        bin_days=bin_days,
    )


def _segment_pairs(t, rules, edges, subarea, area, bin_days=None):
    return sale_ticket_pairs(t, rules, DayWindow(0, edges[-1]), subarea, area, days_col="days", bin_days=bin_days)


SEGMENT_LABELS = {RECURRENCE_2: (NEW, REPEAT), RECURRENCE_3: (NEW, REPEAT_2M_4M, REPEAT_LE_2M)}


def _segments(pairs: DataFrame, edges) -> DataFrame:
    return segment_recurrence(pairs, "contract", "days", edges, SEGMENT_LABELS[edges]).drop("days")


def _with_earlier(rows: DataFrame, pairs: DataFrame, edges, cols: list[str]) -> DataFrame:
    """Segment rows with the contract's rows of the earlier buckets as ``contract_<bucket>``
    and ``<col>_<bucket>``, from the nearest bucket back: bucket 1 shows only where bucket 2
    does, as in the scripts' chain.  Every combination of rows is a row."""
    spread_by = rows.columns
    key = "contract"
    for i in range(len(edges) - 1, 0, -1):
        low = edges[i - 2] if i > 1 else 0
        found = pairs.filter(F.col("days").between(low + 1, edges[i - 1]))
        own = f"contract_{i}"
        earlier = found.select(F.col("contract").alias(key), F.col("contract").alias(own), *[F.col(c).alias(f"{c}_{i}") for c in cols])
        rows, key = attach_earlier(rows, earlier, key, spread_by), own
    return rows


def _segment_churn(t, rules, edges, *, flag_level, cohort, subarea, area, detail, bin_days):
    pairs = _segment_pairs(t, rules, edges, subarea, area, bin_days)
    seg = _segments(pairs, edges)
    churn = _uninstalls_after_sales(t, rules, DayWindow(edges[-2], edges[-1]))
    if detail:
        rows = churn_detail(seg, churn, "ticket_date", W_0_60, flag_level, ["contract", "sale_date", "ticket_date", "segment"])
        return detail_rows(_with_earlier(rows, pairs, edges, ["ticket_date"]), _detail_columns(edges, ["ticket_date"], ["churn_date", "churned"]))
    rows = churn_rows(seg, churn, "ticket_date")
    return _churn_counts(rows, "contract", "sale_date", flag_level=flag_level, cohort=cohort, by=["segment"])


def _detail_columns(edges, earlier: list[str], more: list[str] = ()) -> list[str]:
    back = [f"{c}_{i}" for i in range(len(edges) - 1, 0, -1) for c in ["contract", *earlier]]
    return ["segment", "contract", "sale_date", "ticket_date", *more, *back]


def q04_repeat_ticket_segments(
    t: DomainTables,
    rules: Rules,
    *,
    cohort="month",
    subarea=None,
    area=None,
    detail=False,
    bin_days=None,
) -> DataFrame:
    """Tickets in (60,120] after a sale: ``repeat`` if the contract also had one
    in (0,60], else ``new``; contracts by segment and sale month."""
    pairs = _segment_pairs(t, rules, RECURRENCE_2, subarea, area, bin_days)
    seg = _segments(pairs, RECURRENCE_2)
    if detail:
        earlier = ["sale_date", "ticket_date"]
        return detail_rows(_with_earlier(seg, pairs, RECURRENCE_2, earlier), _detail_columns(RECURRENCE_2, earlier))
    return monthly_counts(seg, "contract", "sale_date", by=["segment"], cohort=cohort)


def q05_repeat_ticket_segments_churn(
    t: DomainTables,
    rules: Rules,
    *,
    flag_level="contract",
    cohort="month",
    subarea=None,
    area=None,
    detail=False,
    bin_days=None,
) -> DataFrame:
    """Q04 segments split by churn (0,60] after the (60,120] ticket."""
    return _segment_churn(
        t, rules, RECURRENCE_2, flag_level=flag_level, cohort=cohort, subarea=subarea, area=area, detail=detail,
        bin_days=bin_days,
    )


def q06_repeat_ticket_3_segments_churn(
    t: DomainTables,
    rules: Rules,
    *,
    flag_level="contract",
    cohort="month",
    subarea=None,
    area=None,
    detail=False,
    bin_days=None,
) -> DataFrame:
    """Tickets in (120,180] after a sale in three segments (``repeat_le_2m``,
    ``repeat_2m_4m``, ``new``), split by churn (0,60] after that ticket."""
    return _segment_churn(
        t, rules, RECURRENCE_3, flag_level=flag_level, cohort=cohort, subarea=subarea, area=area, detail=detail,
        bin_days=bin_days,
    )


# --------------------------------------------------------------------------
# Q07-Q12: discounts
# --------------------------------------------------------------------------


def q07_discount_end_to_ticket(t: DomainTables, rules: Rules, *, cohort="month", detail=False) -> DataFrame:
    """Discounts ending in the year whose own ticket is a billing ticket opened
    (0,60] after the end; distinct tickets by end month."""
    disc = q.year_discounts(t.discounts, rules)
    bills = q.billing_tickets(t.tickets, rules, key="ticket_id")
    pairs = events_within(disc, bills, "ticket_id", "discount_end", "ticket_date", W_0_60)
    if detail:
        return pairs
    return monthly_counts(pairs, "ticket_id", "discount_end", cohort=cohort)


def _discount_tickets(t: DomainTables, rules: Rules, kind: str) -> DataFrame:
    # not de-duplicated before the join: the scan feeds the runtime Bloom filter on tickets
    return q.attach_ticket(q.discounts(t.discounts, rules, kind, unique=False), t.tickets)


def _ticket_churn_counts(rows, churn, date_col, *, flag_level, cohort, detail):
    # tickets are finer than (contract, day): test windows on distinct
    # (contract, day) anchors, then join the flag back to the tickets
    flagged = flag_via_anchors(
        rows, churn, "contract", date_col, "churn_date", W_0_60,
        level=flag_level, spread_by=["ticket_id", date_col],
    )
    if detail:
        return flagged
    return monthly_counts(flagged, "ticket_id", date_col, "churned", cohort=cohort)


def q08_zero_discount_followup(
    t: DomainTables,
    rules: Rules,
    *,
    strict=False,
    flag_level="contract",
    cohort="month",
    detail=False,
) -> DataFrame:
    """Zero-amount discounts; churn is *any* finished order (0,60] after the
    discount's ticket date (``strict=True``: completed uninstalls only);
    distinct tickets by ticket-date month.  A ticket without contract is
    never churned; the rows of null and of heavy contracts are spread by a salt."""
    rows = _discount_tickets(t, rules, "zero_amount")
    churn = _uninstalls(t, rules) if strict else _finished_orders(t, rules)
    return _ticket_churn_counts(rows, churn, "discount_date", flag_level=flag_level, cohort=cohort, detail=detail)


def q09_dated_discount_churn(
    t: DomainTables,
    rules: Rules,
    *,
    flag_level="contract",
    cohort="month",
    detail=False,
) -> DataFrame:
    """Discounts with a real end date; churn (0,60] after the end; distinct
    tickets by end month."""
    rows = _discount_tickets(t, rules, "dated")
    churn = _uninstalls(t, rules)
    return _ticket_churn_counts(rows, churn, "discount_end", flag_level=flag_level, cohort=cohort, detail=detail)


def q10_zero_pct_retained_churn(t: DomainTables, rules: Rules, *, kind="zero_pct", cohort="month", detail=False) -> DataFrame:
    """Retained-with-offer tickets carrying a 0 % discount (``kind="pct"``: any); churn (0,60]
    after retention; distinct tickets and the mean percentage (over the rows repeated per
    churn date) by retention month, summed in millionths, so exact in any order."""
    ret = q.retained(t.retention_tickets, rules, offer_only=True, with_ticket=True)
    found = ret.join(q.discounts(t.discounts, rules, kind), "ticket_id", "inner")
    rows = shared_distinct(found, ["ticket_id", "contract", "retained_date", "discount_pct"])
    churn = _uninstalls(t, rules)
    hits = follow_on(churn, rows, "contract", "retained_date", "churn_date", W_0_60)
    if detail:
        return attach_outcomes(rows, hits, "contract", "churn_date", spread_by=["ticket_id"])
    # the scripts average over rows repeated once per churn date of the
    # contract: weigh each row by that count instead of materialising copies
    counts = outcome_counts(hits, "contract", "churn_date")
    weighted = spread_left_join(rows, counts, ["contract"], ["ticket_id"]).select(
        "*",
        F.coalesce(F.col("_outcomes"), F.lit(1)).alias("_w"),
        F.col("_outcomes").isNotNull().alias("churned"),
    )
    f = F.col("churned").cast("int")
    per = weighted.groupBy(cohort_of(F.col("retained_date"), cohort).alias("month"), F.col("ticket_id")).agg(
        F.max(f).alias("_any"),
        F.min(f).alias("_all"),
        F.sum(units(F.col("discount_pct")) * F.col("_w")).alias("_s"),
        F.sum(F.when(F.col("discount_pct").isNotNull(), F.col("_w"))).alias("_n"),
    )
    out = per.groupBy("month").agg(
        F.count("ticket_id").alias("total"),
        F.count(F.when(F.col("_any") == 1, F.col("ticket_id"))).alias("churned"),
        F.count(F.when(F.col("_all") == 0, F.col("ticket_id"))).alias("kept"),
        half_up_mean_units(F.sum("_s"), F.sum("_n")).alias("mean_pct"),
    )
    return ordered(out, ["month"])


REVERSAL_DISCOUNT_COLS = ["ticket_id", "discount_ticket_id", "contract", "reversal_date", "discount_date"]


def q11_reversal_discount_match(
    t: DomainTables,
    rules: Rules,
    *,
    clean=False,
    discount_kind="all",
    ordered_dates=False,
) -> DataFrame:
    """Reversal tickets matched to discounts on ticket id: distinct detail rows.
    As written: reason filter only, every discount, no date order."""
    revs = q.reversals(t.tickets, rules, clean=clean, with_ticket=True)
    disc = q.discounts(t.discounts, rules, discount_kind)
    if ordered_dates:
        rows = events_within(disc, revs, "ticket_id", "discount_date", "reversal_date", W_AFTER)
    else:
        rows = revs.join(disc, "ticket_id", "inner")
    # both sides are distinct and every column of both is kept, so the join
    # output is already distinct: no DISTINCT (another hash aggregate over all
    # output rows) is needed
    return rows.select(*[F.col("ticket_id").alias(c) if c == "discount_ticket_id" else c for c in REVERSAL_DISCOUNT_COLS])


def q12_open_discount_reversal_churn(t: DomainTables, rules: Rules) -> DataFrame:
    """Clean reversals after an open-ended discount of the same ticket; each
    row repeated per churn date (0,60] after any such reversal of the contract,
    null when none: distinct detail rows."""
    revs = q.reversals(t.tickets, rules, clean=True, with_ticket=True)
    disc = q.discounts(t.discounts, rules, "open_ended", unique=False)
    found = events_within(disc, revs, "ticket_id", "discount_date", "reversal_date", W_AFTER)
    rows = shared_distinct(found, ["ticket_id", "contract", "reversal_date", "discount_date"])
    churn = _uninstalls(t, rules)
    hits = follow_on(churn, rows, "contract", "reversal_date", "churn_date", W_0_60)
    fanned = attach_outcomes(rows, hits, "contract", "churn_date", spread_by=["ticket_id"])
    # distinct pairs times distinct churn dates per contract: already distinct
    cols = REVERSAL_DISCOUNT_COLS + ["churn_date"]
    return fanned.select(*[F.col("ticket_id").alias(c) if c == "discount_ticket_id" else c for c in cols])


# --------------------------------------------------------------------------
# Q13-Q17: retention
# --------------------------------------------------------------------------


def q13_retained_by_month(t: DomainTables, rules: Rules, *, cohort="month") -> DataFrame:
    """Distinct retained contracts by retention month."""
    ret = _retained(t, rules)
    return monthly_counts(ret, "contract", "retained_date", cohort=cohort)


def _retained_churn(t, rules, window, *, offer_only, exclude_strategies, flag_level, cohort, detail):
    ret = _retained(t, rules, offer_only, exclude_strategies)
    churn = _uninstalls_after(t, rules, ("retained", rules, offer_only, exclude_strategies), window)
    if detail:
        return churn_detail(ret, churn, "retained_date", window, flag_level, ["contract", "retained_date"])
    rows = churn_rows(ret, churn, "retained_date", window)
    return _churn_counts(rows, "contract", "retained_date", flag_level=flag_level, cohort=cohort)


def q13_by_bitmaps(t: DomainTables, rules: Rules, *, cohort="month") -> DataFrame:
    """Q13 as a growing count: the rows up to the rules' year and the later ones make bitmaps
    apart, which are then joined (:class:`churnlab.operators.bitmaps.DistinctState` keeps them
    in files)."""
    ret = _retained(t, rules)
    numbers = bitmaps.numbered(ret, "contract")
    month = cohort_of(F.col("retained_date"), cohort)
    late = F.col("retained_date") >= F.lit(datetime.date(rules.year + 1, 1, 1))
    parts = [bitmaps.cohort_bitmaps(ret.filter(c), numbers, "contract", month) for c in (~late, late)]
    return ordered(bitmaps.counts(bitmaps.merged(parts[0].unionByName(parts[1]))), ["month"])


def q14_retained_offer_churn_0_60(
    t: DomainTables,
    rules: Rules,
    *,
    window=W_0_60,
    flag_level="contract",
    cohort="month",
    detail=False,
) -> DataFrame:
    """Retained for an offer reason; churn (0,60] after retention."""
    return _retained_churn(
        t, rules, window, offer_only=True, exclude_strategies=False,
        flag_level=flag_level, cohort=cohort, detail=detail,
    )


def q15_retained_offer_churn_90_120(
    t: DomainTables,
    rules: Rules,
    *,
    window=W_90_120,
    flag_level="contract",
    cohort="month",
    detail=False,
) -> DataFrame:
    """Retained for an offer reason; churn (90,120] after retention."""
    return _retained_churn(
        t, rules, window, offer_only=True, exclude_strategies=False,
        flag_level=flag_level, cohort=cohort, detail=detail,
    )


def q16_retained_strategy_churn_90_120(
    t: DomainTables,
    rules: Rules,
    *,
    window=W_90_120,
    flag_level="contract",
    cohort="month",
    detail=False,
) -> DataFrame:
    """Retained with a strategy outside the excluded list (null strategy
    dropped); churn (90,120]."""
    return _retained_churn(
        t, rules, window, offer_only=False, exclude_strategies=True,
        flag_level=flag_level, cohort=cohort, detail=detail,
    )


def q17_retained_offer_strategy_churn_0_120(
    t: DomainTables,
    rules: Rules,
    *,
    window=W_0_120,
    flag_level="contract",
    cohort="month",
    detail=False,
) -> DataFrame:
    """Both restrictions; churn (0,120]."""
    return _retained_churn(
        t, rules, window, offer_only=True, exclude_strategies=True,
        flag_level=flag_level, cohort=cohort, detail=detail,
    )


# --------------------------------------------------------------------------
# Q18-Q20: reversals
# --------------------------------------------------------------------------


def q18_reversals_by_month(t: DomainTables, rules: Rules, *, cohort="month") -> DataFrame:
    """Distinct contracts with an automatic reversal by month (a reversal
    without opening date gives a null month)."""
    return monthly_counts(_reversals(t, rules), "contract", "reversal_date", cohort=cohort)


def q19_reversal_ticket_churn(
    t: DomainTables,
    rules: Rules,
    *,
    flag_level="contract",
    cohort="month",
    detail=False,
    bin_days=None,
) -> DataFrame:
    """Reversal -> billing ticket (0,60] -> churn (0,60] after the ticket;
    by reversal month."""
    pairs = reversal_ticket_pairs(t, rules, bin_days)
    return _called_churn(t, rules, pairs, flag_level=flag_level, cohort=cohort, detail=detail, bin_days=bin_days)


def _called_churn(t, rules, pairs, *, flag_level, cohort, detail, bin_days=None):
    churn = _uninstalls_after(t, rules, ("ticket_events", rules))
    if detail:
        return churn_detail(pairs, churn, "ticket_date", W_0_60, flag_level, ["contract", "reversal_date", "ticket_date"])
    rows = churn_rows(pairs, churn, "ticket_date", bin_days=bin_days)
    return _churn_counts(rows, "contract", "reversal_date", flag_level=flag_level, cohort=cohort)


def _called_split(t, rules, bin_days=None):
    revs, pairs = reversal_sets(t, rules, bin_days)
    return revs, pairs, split_contacted(revs, pairs, "contract")


def q20a_reversal_no_call_churn(
    t: DomainTables,
    rules: Rules,
    *,
    flag_level="contract",
    cohort="month",
    detail=False,
    bin_days=None,
) -> DataFrame:
    """Reversals of contracts with no billing ticket (0,60] after any of their
    reversals; churn (0,60] after the reversal; by reversal month."""
    _, _, (_, not_called) = _called_split(t, rules, bin_days)
    churn = _uninstalls_after(t, rules, ("ticket_events", rules))
    if detail:
        return churn_detail(not_called, churn, "reversal_date", W_0_60, flag_level, ["contract", "reversal_date"])
    rows = churn_rows(not_called, churn, "reversal_date")
    return _churn_counts(rows, "contract", "reversal_date", flag_level=flag_level, cohort=cohort)


def q20b_reversal_no_call_as_written(t: DomainTables, rules: Rules) -> DataFrame:
    """The split as the script computes it: the left join keeps only the
    optional side's columns, so all not-called reversals collapse into one
    all-null row; counted by month this is ``(month=null, total=0)``, or no
    row when every reversal contract was called."""
    # the script's churn step finds nothing, as the one row it could mark has no contract
    silent = _marked_events(t, rules).filter(q.is_reversal() & ~F.col("called"))
    return silent.agg(F.count("*").alias("_n")).filter(F.col("_n") > 0).select(
        F.lit(None).cast("bigint").alias("month"), F.lit(0).cast("bigint").alias("total")
    )


def q20c_reversal_with_call_churn(
    t: DomainTables,
    rules: Rules,
    *,
    flag_level="contract",
    cohort="month",
    detail=False,
    bin_days=None,
) -> DataFrame:
    """Reversal pairs of called contracts; churn (0,60] after the ticket; by
    reversal month (the same figures as Q19)."""
    # the called branch's rows are the pairs themselves: every pair's contract
    # is called by definition, so no join against the split is needed
    _, pairs, _ = _called_split(t, rules, bin_days)
    return _called_churn(t, rules, pairs, flag_level=flag_level, cohort=cohort, detail=detail, bin_days=bin_days)


def q20d_reversal_call_comparison(
    t: DomainTables,
    rules: Rules,
    *,
    flag_level="contract",
    cohort="month",
    bin_days=None,
) -> DataFrame:
    """Called and not-called monthly results side by side: one conditional aggregate over
    events marked once per contract (the null month of undated reversals is a group)."""
    if flag_level == "event":
        return _compared_by_event(t, rules, cohort, bin_days)
    flag_key(flag_level)  # refuses unknown levels
    marked = _marked_events(t, rules)
    # a called contract's churn window opens at each ticket that answers a reversal, a
    # silent one's at each reversal; counted are followed and silent reversals
    opens = F.when(F.col("called"), F.col("answer")).otherwise(q.is_reversal())
    counted = F.when(F.col("called"), F.col("followed")).otherwise(q.is_reversal())
    rows = marked.select("contract", "day", "called", opens.alias("_opens"), counted.alias("_counted")).filter(F.col("_opens") | F.col("_counted"))
    hit = churn_rows(rows, _uninstalls_after(t, rules, ("ticket_events", rules)), "day").withColumn("churned", F.col("churned") & F.col("_opens"))
    lifted = lift_flag(hit, "churned", ["contract"]).filter(F.col("_counted"))
    per = lifted.groupBy(cohort_of(F.col("day"), cohort).alias("month"), "contract").agg(
        F.max("called").alias("called"), F.max("churned").alias("churned")
    )
    sides = []
    for side, cond in (("called", F.col("called")), ("not_called", ~F.col("called"))):
        total = F.count(F.when(cond, F.col("contract")))
        churned = F.count(F.when(cond & F.col("churned"), F.col("contract")))
        # a side without contracts in a month has no figures there, not zeros
        sides += [F.when(total > 0, x).alias(f"{side}_{name}") for name, x in (("total", total), ("churned", churned), ("kept", total - churned))]
    return ordered(per.groupBy("month").agg(*sides), ["month"])


def _marked_events(t: DomainTables, rules: Rules) -> DataFrame:
    """Ticket events with the contact marks, from one scan and one pass by contract."""
    events = _ticket_events(t, rules)
    return mark_contact(events, "contract", "day", q.is_reversal(), q.is_billing(), W_0_60)


def _compared_by_event(t, rules, cohort, bin_days):
    """The comparison with each row's own churn: two results joined on month."""
    called = q20c_reversal_with_call_churn(t, rules, flag_level="event", cohort=cohort, bin_days=bin_days)
    silent = q20a_reversal_no_call_churn(t, rules, flag_level="event", cohort=cohort, bin_days=bin_days)
    left, right = (df.select(F.col("month").alias(f"_{side}"), *[F.col(c).alias(f"{side}_{c}") for c in ("total", "churned", "kept")])
                   for side, df in (("called", called), ("not_called", silent)))
    joined = left.join(right, F.col("_called").eqNullSafe(F.col("_not_called")), "full")
    return ordered(joined.withColumn("month", F.coalesce("_called", "_not_called")).select("month", *left.columns[1:], *right.columns[1:]), ["month"])


# --------------------------------------------------------------------------
# Q21-Q22: credit-note resolution time
# --------------------------------------------------------------------------


def q21_credit_note_resolution(t: DomainTables, rules: Rules, *, cohort="month") -> DataFrame:
    """Mean days open -> close of credit-note tickets (same-day and open ones
    excluded) and distinct contracts, by opening month."""
    return monthly_mean_days(_credit_notes(t, rules), "contract", "opened", "closed", cohort=cohort)


def q22_credit_note_resolution_churn(t: DomainTables, rules: Rules, *, cohort="month") -> DataFrame:
    """Q21 with churn (0,60] after closing.  Rows repeat once per churn date of
    the contract, so the mean is over that fan-out (it differs from Q21);
    ``churned_*`` / ``kept_*`` split the same figures by the contract flag."""
    # a note without close date neither anchors a churn window nor enters the
    # mean (closed > opened); dropping it up front gives both branches the same
    # filter, and the notes are already one row per (contract, opened, closed),
    # so no re-dedupe: the two branches share one scan of the tickets
    notes = _credit_notes(t, rules).filter(F.col("closed").isNotNull())
    churn = _uninstalls_after(t, rules, ("credit_notes", rules))
    hits = follow_on(churn, notes, "contract", "closed", "churn_date", W_0_60, dedupe_anchors=False)
    weighted = notes.join(outcome_counts(hits, "contract", "churn_date"), "contract", "left").select(
        "*",
        F.coalesce(F.col("_outcomes"), F.lit(1)).alias("_w"),
        F.col("_outcomes").isNotNull().alias("churned"),
    )
    return monthly_mean_days(weighted, "contract", "opened", "closed", cohort=cohort, split="churned", weight="_w")


QUERIES = {
    "q01_sale_to_ticket": q01_sale_to_ticket,
    "q02_sale_to_ticket_churn": q02_sale_to_ticket_churn,
    "q03_tenure_ticket_churn": q03_tenure_ticket_churn,
    "q04_repeat_ticket_segments": q04_repeat_ticket_segments,
    "q05_repeat_ticket_segments_churn": q05_repeat_ticket_segments_churn,
    "q06_repeat_ticket_3_segments_churn": q06_repeat_ticket_3_segments_churn,
    "q07_discount_end_to_ticket": q07_discount_end_to_ticket,
    "q08_zero_discount_followup": q08_zero_discount_followup,
    "q09_dated_discount_churn": q09_dated_discount_churn,
    "q10_zero_pct_retained_churn": q10_zero_pct_retained_churn,
    "q11_reversal_discount_match": q11_reversal_discount_match,
    "q12_open_discount_reversal_churn": q12_open_discount_reversal_churn,
    "q13_retained_by_month": q13_retained_by_month,
    "q14_retained_offer_churn_0_60": q14_retained_offer_churn_0_60,
    "q15_retained_offer_churn_90_120": q15_retained_offer_churn_90_120,
    "q16_retained_strategy_churn_90_120": q16_retained_strategy_churn_90_120,
    "q17_retained_offer_strategy_churn_0_120": q17_retained_offer_strategy_churn_0_120,
    "q18_reversals_by_month": q18_reversals_by_month,
    "q19_reversal_ticket_churn": q19_reversal_ticket_churn,
    "q20a_reversal_no_call_churn": q20a_reversal_no_call_churn,
    "q20b_reversal_no_call_as_written": q20b_reversal_no_call_as_written,
    "q20c_reversal_with_call_churn": q20c_reversal_with_call_churn,
    "q20d_reversal_call_comparison": q20d_reversal_call_comparison,
    "q21_credit_note_resolution": q21_credit_note_resolution,
    "q22_credit_note_resolution_churn": q22_credit_note_resolution_churn,
}
