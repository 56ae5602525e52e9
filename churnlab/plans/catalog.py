"""Registry used by ``__spark_entry__``: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from churnlab.config import FIXTURE_RULES, DayWindow
from churnlab.plans import queries as Q
from churnlab.plans.generic import GENERIC_ORACLE, GENERIC_QUERIES
from churnlab.plans.oracle import ORACLE_SQL
from churnlab.sources import DomainTables

FLAGSHIP = "q19_reversal_ticket_churn"


def _bind(fn) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        # built anew on each call: Spark lists a folder's files when a DataFrame is made,
        # so kept DataFrames would miss later files and belong to an earlier session
        return fn(DomainTables.from_testdata(spark, sf_dir), FIXTURE_RULES)

    named = fn.func if isinstance(fn, partial) else fn
    run.__name__, run.__doc__ = named.__name__, named.__doc__
    return run


# the queries' toggles, each with the production rules
TOGGLES = {
    "q02_event_flag": partial(Q.q02_sale_to_ticket_churn, flag_level="event"),
    "q19_event_flag": partial(Q.q19_reversal_ticket_churn, flag_level="event"),
    "q13_by_bitmaps": Q.q13_by_bitmaps,
    "q14_window_0_30": partial(Q.q14_retained_offer_churn_0_60, window=DayWindow(0, 30)),
    "q17_window_0_60": partial(Q.q17_retained_offer_strategy_churn_0_120, window=DayWindow(0, 60)),
    "q02_subarea": partial(Q.q02_sale_to_ticket_churn, subarea="bill_amount"),
    "q02_area": partial(Q.q02_sale_to_ticket_churn, area=FIXTURE_RULES.credit_note_areas),
    "q08_strict": partial(Q.q08_zero_discount_followup, strict=True),
    "q11_probe": partial(Q.q11_reversal_discount_match, clean=True, discount_kind="open_ended", ordered_dates=True),
    "q19_year_month": partial(Q.q19_reversal_ticket_churn, cohort="year_month"),
    "q03_subarea": partial(Q.q03_tenure_ticket_churn, subarea="bill_detail"),
    "q04_area": partial(Q.q04_repeat_ticket_segments, area=FIXTURE_RULES.credit_note_areas),
    "q05_event_flag": partial(Q.q05_repeat_ticket_segments_churn, flag_level="event"),
    "q06_event_flag": partial(Q.q06_repeat_ticket_3_segments_churn, flag_level="event"),
    "q10_any_pct": partial(Q.q10_zero_pct_retained_churn, kind="pct"),
    "q02_detail": partial(Q.q02_sale_to_ticket_churn, detail=True),
    "q03_detail": partial(Q.q03_tenure_ticket_churn, detail=True),
    "q04_detail": partial(Q.q04_repeat_ticket_segments, detail=True),
    "q05_detail": partial(Q.q05_repeat_ticket_segments_churn, detail=True),
    "q06_detail": partial(Q.q06_repeat_ticket_3_segments_churn, detail=True),
    "q02_auto_bins": partial(Q.q02_sale_to_ticket_churn, bin_days="auto"),
    "q19_auto_bins": partial(Q.q19_reversal_ticket_churn, bin_days="auto"),
    "q19_detail": partial(Q.q19_reversal_ticket_churn, detail=True),
    "q19_event_detail": partial(Q.q19_reversal_ticket_churn, detail=True, flag_level="event"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The 22 scripts' queries (Q01-Q22, with Q20a-d) on the domain tables,
    then each generic operator on the raw order tables."""
    out = {name: _bind(fn) for name, fn in {**Q.QUERIES, **TOGGLES}.items()}
    out.update(GENERIC_QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    sql = {**ORACLE_SQL, **GENERIC_ORACLE}
    return {name: sql[name] for name in queries() if name in sql}
