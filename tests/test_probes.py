"""Known values at sf0.01 (FIXTURES.md §3) and invariants of the flags."""

import pytest
from pyspark.sql import functions as F

from churnlab.config import FIXTURE_RULES as R
from churnlab.config import W_0_60, W_0_120
from churnlab.operators import cohorts as q
from churnlab.operators.flags import split_contacted
from churnlab.plans import queries as Q
from churnlab.sources import DomainTables
from paths import SF_CHECK


@pytest.fixture(scope="module")
def t(spark):
    return DomainTables.from_testdata(spark, SF_CHECK)


def month(df, m=1):
    return tuple(df.filter(F.col("month") == m).drop("month").first())


def test_anchor_sizes(t):
    assert q.new_sales(t.sales, R).count() == 720
    assert q.billing_tickets(t.tickets, R).count() == 21_213
    assert q.reversals(t.tickets, R).count() == 10_772
    assert q.credit_notes(t.tickets, R).count() == 8_615
    # FIXTURES counts completed uninstalls at the order grain (contract,
    # opened, finished); the churn operator keeps (contract, churn_date),
    # the only columns any flag or fan-out uses.
    orders = t.service_orders.filter(
        "order_type = 'uninstall' AND status = 'completed' AND finished IS NOT NULL AND opened IS NOT NULL"
    )
    assert orders.select("contract", "opened", "finished").distinct().count() == 3_540
    assert q.uninstalls(t.service_orders, R).count() == 3_536


@pytest.mark.parametrize(
    "fn, expected",
    [
        (Q.q01_sale_to_ticket, (20,)),
        (Q.q02_sale_to_ticket_churn, (20, 3, 17)),
        (Q.q03_tenure_ticket_churn, (15, 1, 14)),
        (Q.q07_discount_end_to_ticket, (60,)),
        (Q.q08_zero_discount_followup, (129, 56, 74)),
        (Q.q09_dated_discount_churn, (1842, 993, 861)),
        (Q.q13_retained_by_month, (1200,)),
        (Q.q14_retained_offer_churn_0_60, (658, 255, 403)),
        (Q.q15_retained_offer_churn_90_120, (658, 153, 505)),
        (Q.q16_retained_strategy_churn_90_120, (867, 232, 635)),
        (Q.q17_retained_offer_strategy_churn_0_120, (375, 166, 209)),
        (Q.q18_reversals_by_month, (676,)),
        (Q.q19_reversal_ticket_churn, (231, 52, 179)),
        (Q.q20a_reversal_no_call_churn, (85, 18, 67)),
        (Q.q20c_reversal_with_call_churn, (231, 52, 179)),
        (Q.q21_credit_note_resolution, (9.31, 475)),
    ],
)
def test_month_one_probe(t, fn, expected):
    assert month(fn(t, R)) == expected


def test_q01_month_10(t):
    assert month(Q.q01_sale_to_ticket(t, R), 10) == (24,)


def test_q08_strict_filter(t):
    assert month(Q.q08_zero_discount_followup(t, R, strict=True))[1] == 21


def test_q10_probe(t):
    assert month(Q.q10_zero_pct_retained_churn(t, R)) == (25, 2, 23, 0.0)


def test_q19_event_level(t):
    assert month(Q.q19_reversal_ticket_churn(t, R, flag_level="event"))[1] == 17


def test_q21_q22_means_differ(t):
    assert month(Q.q21_credit_note_resolution(t, R), 11)[0] == 9.33
    assert month(Q.q22_credit_note_resolution_churn(t, R), 1)[0] == 9.31
    assert month(Q.q22_credit_note_resolution_churn(t, R), 11)[0] == 9.43


def test_segment_probes(t):
    q04 = Q.q04_repeat_ticket_segments(t, R)
    assert q04.count() == 24
    assert tuple(q04.filter("segment = 'new' AND month = 1").select("total").first()) == (7,)
    q05 = Q.q05_repeat_ticket_segments_churn(t, R)
    assert tuple(q05.filter("segment = 'new' AND month = 1").drop("segment", "month").first()) == (7, 0, 7)
    assert Q.q06_repeat_ticket_3_segments_churn(t, R).count() == 35
    det = Q.q06_repeat_ticket_3_segments_churn(t, R, detail=True)
    per_seg = {
        r["segment"]: (r["n"], r["c"])
        for r in det.groupBy("segment")
        .agg(F.countDistinct("contract").alias("n"), F.countDistinct(F.when(F.col("churned"), F.col("contract"))).alias("c"))
        .collect()
    }
    assert per_seg == {"repeat_le_2m": (48, 3), "repeat_2m_4m": (45, 1), "new": (113, 7)}


def test_segment_edge_buckets_one_and_three(t):
    pairs = Q.sale_ticket_pairs(t, R, Q.DayWindow(0, 180), days_col="d")
    per = pairs.groupBy("contract").agg(
        F.max(F.col("d") <= 60).alias("b1"),
        F.max((F.col("d") > 60) & (F.col("d") <= 120)).alias("b2"),
        F.max(F.col("d") > 120).alias("b3"),
    )
    assert per.filter("b1 AND b3 AND NOT b2").count() == 43


def test_row_counts_of_detail_queries(t):
    assert Q.q11_reversal_discount_match(t, R).count() == 14_138
    assert Q.q12_open_discount_reversal_churn(t, R).count() == 1_361
    assert Q.q20b_reversal_no_call_as_written(t, R).collect()[0].asDict() == {"month": None, "total": 0}
    assert Q.q18_reversals_by_month(t, R).count() == 13
    assert Q.q20d_reversal_call_comparison(t, R).count() == 13


def test_called_plus_not_called_is_all(t):
    revs = q.reversals(t.tickets, R)
    called, not_called = split_contacted(revs, Q.reversal_ticket_pairs(t, R), "contract")
    n_called = called.select("contract").distinct().count()
    n_not = not_called.select("contract").distinct().count()
    assert (n_called, n_not) == (1_203, 286)
    assert n_called + n_not == revs.select("contract").distinct().count()


# -- invariants --------------------------------------------------------------------


@pytest.mark.parametrize(
    "fn",
    [Q.q02_sale_to_ticket_churn, Q.q14_retained_offer_churn_0_60, Q.q19_reversal_ticket_churn,
     Q.q20a_reversal_no_call_churn],
)
def test_churned_plus_kept_is_total(t, fn):
    for r in fn(t, R).collect():
        assert r["churned"] + r["kept"] == r["total"]


def test_wider_window_never_lowers_churn(t):
    narrow = {r["month"]: r["churned"] for r in Q.q14_retained_offer_churn_0_60(t, R, window=W_0_60).collect()}
    wide = {r["month"]: r["churned"] for r in Q.q14_retained_offer_churn_0_60(t, R, window=W_0_120).collect()}
    assert all(wide[m] >= narrow[m] for m in narrow)


def test_duplicated_input_changes_nothing(spark, t):
    doubled = DomainTables.from_frames(
        {
            "sales": t.sales.unionByName(t.sales),
            "tickets": t.tickets.unionByName(t.tickets),
            "service_orders": t.service_orders.unionByName(t.service_orders),
            "discounts": t.discounts,
            "retention_tickets": t.retention_tickets,
        }
    )
    for fn in (Q.q02_sale_to_ticket_churn, Q.q19_reversal_ticket_churn, Q.q22_credit_note_resolution_churn):
        assert sorted(map(tuple, fn(doubled, R).collect())) == sorted(map(tuple, fn(t, R).collect()))


def test_year_month_cohort(t):
    out = Q.q19_reversal_ticket_churn(t, R, cohort="year_month")
    months = [r["month"] for r in out.collect()]
    assert all(199501 <= m <= 200112 for m in months)
    by_month = Q.q19_reversal_ticket_churn(t, R).agg(F.sum("total")).first()[0]
    assert out.agg(F.sum("total")).first()[0] >= by_month


def test_day_bins_on_real_pairs(t):
    sales, bills = q.new_sales(t.sales, R), q.billing_tickets(t.tickets, R)
    plain = Q.events_within(sales, bills, "contract", "sale_date", "ticket_date", Q.DayWindow(0, 180))
    binned = Q.events_within(sales, bills, "contract", "sale_date", "ticket_date", Q.DayWindow(0, 180), bin_days=180)
    assert binned.count() == plain.count() == binned.distinct().count()
    assert binned.exceptAll(plain).count() == 0


@pytest.mark.parametrize(
    "fn",
    [Q.q01_sale_to_ticket, Q.q02_sale_to_ticket_churn, Q.q03_tenure_ticket_churn, Q.q06_repeat_ticket_3_segments_churn,
     Q.q19_reversal_ticket_churn, Q.q20d_reversal_call_comparison],
)
def test_day_binned_queries_give_the_same_result(t, fn):
    plain = sorted(map(tuple, fn(t, R).collect()), key=repr)
    assert sorted(map(tuple, fn(t, R, bin_days=180).collect()), key=repr) == plain
