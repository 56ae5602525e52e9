"""Hand-built edge cases with expected rows written by hand (FIXTURES.md §4)."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from churnlab.config import FIXTURE_RULES as R
from churnlab.config import W_0_60, W_90_120, W_TENURE, DayWindow
from churnlab.functions.dates import utc_day
from churnlab.functions.rounding import half_up_mean_2dp
from churnlab.operators import cohorts as q
from churnlab.operators.windows import events_within
from churnlab.plans import queries as Q
from domain_rows import D0, day, discount, order, retention, rows, sale, tables, ticket


def _month_rows(df):
    return {r["month"]: tuple(r)[1:] for r in df.collect()}


# -- windows -----------------------------------------------------------------


@pytest.mark.parametrize(
    "window, expected",
    [
        (W_0_60, [1, 60]),
        (DayWindow(60, 120), [61, 120]),
        (DayWindow(120, 180), [121, 180]),
        (W_TENURE, [180, 210]),
        (W_90_120, [120]),
        (DayWindow(0, None), [1, 60, 61, 120, 121, 180, 210, 211]),
    ],
)
def test_window_edges(spark, window, expected):
    offsets = [0, 1, 60, 61, 120, 121, 180, 210, 211]
    a = spark.createDataFrame([(1, D0)], "contract BIGINT, a_date DATE")
    b = spark.createDataFrame([(1, day(n)) for n in offsets], "contract BIGINT, b_date DATE")
    out = events_within(a, b, "contract", "a_date", "b_date", window, days_col="days")
    assert sorted(r["days"] for r in out.collect()) == expected


def test_null_dates_never_pair(spark):
    a = spark.createDataFrame([(1, None), (1, D0)], "contract BIGINT, a_date DATE")
    b = spark.createDataFrame([(1, None), (1, day(5))], "contract BIGINT, b_date DATE")
    out = events_within(a, b, "contract", "a_date", "b_date", W_0_60)
    assert rows(out) == [(1, D0, day(5))]


# -- qualify operators ---------------------------------------------------------


def test_null_vocabulary_is_dropped(spark):
    t = tables(
        spark,
        sales=[sale(1, D0), sale(2, D0, sub_channel=None), sale(3, D0, sub_channel="hospitality")],
        tickets=[
            ticket(1, day(1)),
            ticket(2, day(1), subarea=None),
            ticket(3, day(1), status=None),
            ticket(4, day(1), subarea="aging_0_30"),
            ticket(5, day(1), status="void"),
            ticket(6, day(1), cls=None),
        ],
        retention=[
            retention(1, D0, strategy="discount"),
            retention(2, D0, strategy=None),
            retention(3, D0, strategy="excluded_4"),
        ],
    )
    assert rows(q.new_sales(t.sales, R), "contract") == [(1,)]
    assert rows(q.billing_tickets(t.tickets, R), "contract") == [(1,)]
    assert rows(q.retained(t.retention_tickets, R, exclude_strategies=True), "contract") == [(1,)]
    assert len(rows(q.retained(t.retention_tickets, R))) == 3


def test_duplicate_facts_give_one_anchor(spark):
    t = tables(spark, tickets=[ticket(1, day(3)), ticket(1, day(3)), ticket(1, day(4))])
    assert rows(q.billing_tickets(t.tickets, R)) == [(1, day(3)), (1, day(4))]


def test_sale_year_rule(spark):
    t = tables(spark, sales=[sale(1, date(1996, 12, 31)), sale(2, date(1997, 12, 31))])
    assert rows(q.new_sales(t.sales, R), "contract") == [(2,)]
    assert rows(q.new_sales(t.sales, R, year=1996), "contract") == [(1,)]


# -- flags ---------------------------------------------------------------------


def _two_month_contract(spark):
    # anchors in January and September; the only churn follows the January ticket
    sep = date(1997, 9, 10)
    return tables(
        spark,
        sales=[sale(1, D0), sale(1, sep)],
        tickets=[ticket(1, day(5)), ticket(1, date(1997, 9, 15))],
        orders=[order(1, day(35))],
    )


def test_contract_level_flag_marks_every_month(spark):
    t = _two_month_contract(spark)
    out = _month_rows(Q.q02_sale_to_ticket_churn(t, R))
    assert out == {1: (1, 1, 0), 9: (1, 1, 0)}


def test_event_level_flag_marks_own_window_only(spark):
    t = _two_month_contract(spark)
    out = _month_rows(Q.q02_sale_to_ticket_churn(t, R, flag_level="event"))
    assert out == {1: (1, 1, 0), 9: (1, 0, 1)}


def test_detail_rows_carry_contract_flag(spark):
    t = _two_month_contract(spark)
    det = Q.q02_sale_to_ticket_churn(t, R, detail=True)
    assert sorted(r["churned"] for r in det.collect()) == [True, True]


# -- recurrence segments -------------------------------------------------------


def test_bucket_gap_is_new(spark):
    # tickets at +30 (bucket 1) and +150 (bucket 3) but none in (60,120]
    t = tables(spark, sales=[sale(1, D0)], tickets=[ticket(1, day(30)), ticket(1, day(150))])
    det = Q.q06_repeat_ticket_3_segments_churn(t, R, detail=True)
    assert rows(det, "contract", "ticket_date", "segment") == [(1, day(150), "new")]


def test_three_segments(spark):
    t = tables(
        spark,
        sales=[sale(1, D0), sale(2, D0), sale(3, D0)],
        tickets=[
            ticket(1, day(30)), ticket(1, day(90)), ticket(1, day(150)),  # 1, 2, 3
            ticket(2, day(90)), ticket(2, day(150)),  # 2, 3
            ticket(3, day(150)),  # 3
        ],
    )
    det = Q.q06_repeat_ticket_3_segments_churn(t, R, detail=True)
    assert rows(det, "contract", "segment") == [(1, "repeat_le_2m"), (2, "repeat_2m_4m"), (3, "new")]


def test_buckets_across_sales_of_one_contract(spark):
    # bucket 1 from the first sale, bucket 2 from the second: still repeat
    s2 = day(100)
    t = tables(spark, sales=[sale(1, D0), sale(1, s2)], tickets=[ticket(1, day(30)), ticket(1, day(190))])
    det = Q.q04_repeat_ticket_segments(t, R, detail=True)
    assert rows(det, "contract", "sale_date", "segment") == [(1, s2, "repeat")]


# -- reversals -------------------------------------------------------------------


def test_no_call_split_and_as_written(spark):
    t = tables(
        spark,
        tickets=[
            ticket(1, day(0), reason="auto_reversal"),  # called: billing ticket +10
            ticket(1, day(10)),
            ticket(2, day(0), reason="auto_reversal"),  # no call
            ticket(3, None, reason="auto_reversal"),  # no call, no date
        ],
        orders=[order(2, day(20))],
    )
    assert _month_rows(Q.q20a_reversal_no_call_churn(t, R)) == {None: (1, 0, 1), 1: (1, 1, 0)}
    assert _month_rows(Q.q20c_reversal_with_call_churn(t, R)) == {1: (1, 0, 1)}
    assert rows(Q.q20b_reversal_no_call_as_written(t, R)) == [(None, 0)]
    comp = {r["month"]: tuple(r)[1:] for r in Q.q20d_reversal_call_comparison(t, R).collect()}
    assert comp == {None: (None, None, None, 1, 0, 1), 1: (1, 0, 1, 1, 1, 0)}


def test_as_written_split_is_empty_when_all_called(spark):
    t = tables(spark, tickets=[ticket(1, day(0), reason="auto_reversal"), ticket(1, day(10))])
    assert rows(Q.q20b_reversal_no_call_as_written(t, R)) == []


def test_null_opened_reversal_gives_null_month(spark):
    t = tables(spark, tickets=[ticket(1, None, reason="auto_reversal"), ticket(2, day(3), reason="auto_reversal")])
    assert _month_rows(Q.q18_reversals_by_month(t, R)) == {None: (1,), 1: (1,)}


# -- credit notes ----------------------------------------------------------------


def test_two_churn_dates_weigh_the_mean(spark):
    t = tables(
        spark,
        tickets=[
            ticket(1, day(0), closed=day(4), area="credit_note"),
            ticket(2, day(0), closed=day(10), area="credit_notes"),
            ticket(3, day(0), closed=day(0), area="credit_note"),  # same day: out of the mean
            ticket(4, day(0), closed=day(6), area="general"),  # not a credit note
        ],
        orders=[order(1, day(14)), order(1, day(24)), order(3, day(30))],
    )
    assert _month_rows(Q.q21_credit_note_resolution(t, R)) == {1: (7.0, 2)}
    # contract 1 counts twice (two churn dates): (4 + 4 + 10) / 3
    assert _month_rows(Q.q22_credit_note_resolution_churn(t, R)) == {1: (6.0, 2, 4.0, 1, 10.0, 1)}


# -- retention and time zones ------------------------------------------------------


def test_late_timestamp_stays_on_its_day(spark):
    t = tables(spark, retention=[retention(1, datetime(1997, 3, 31, 23, 30))])
    assert _month_rows(Q.q13_retained_by_month(t, R)) == {3: (1,)}


def test_utc_day_ignores_session_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Costa_Rica")
        df = spark.sql("SELECT TIMESTAMP '2021-03-01 02:00:00 UTC' AS ts")
        got = df.select(utc_day(F.col("ts")).alias("d"), F.to_date("ts").alias("local")).first()
        assert got["d"] == date(2021, 3, 1)
        assert got["local"] == date(2021, 2, 28)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_retention_windows(spark):
    t = tables(
        spark,
        retention=[retention(1, D0), retention(2, D0), retention(3, D0, group="service")],
        orders=[order(1, day(30)), order(2, day(100))],
    )
    assert _month_rows(Q.q14_retained_offer_churn_0_60(t, R)) == {1: (2, 1, 1)}
    assert _month_rows(Q.q15_retained_offer_churn_90_120(t, R)) == {1: (2, 1, 1)}
    assert _month_rows(Q.q17_retained_offer_strategy_churn_0_120(t, R)) == {1: (2, 2, 0)}


# -- discounts -----------------------------------------------------------------------


def test_unmatched_and_contractless_tickets(spark):
    t = tables(
        spark,
        tickets=[ticket(1, day(0), ticket_id=101), ticket(None, day(0), ticket_id=102)],
        discounts=[
            discount(101, ticket_date=day(0)),
            discount(102, ticket_date=day(0)),
            discount(103, ticket_date=day(0)),  # no ticket: dropped
        ],
        orders=[order(1, day(10), order_type="install", status="open")],  # any order counts
    )
    assert _month_rows(Q.q08_zero_discount_followup(t, R)) == {1: (2, 1, 1)}
    assert _month_rows(Q.q08_zero_discount_followup(t, R, strict=True)) == {1: (2, 0, 2)}


def test_discount_end_ticket_and_open_ended(spark):
    t = tables(
        spark,
        tickets=[
            ticket(1, day(20), ticket_id=201),
            ticket(1, day(5), ticket_id=202, reason="auto_reversal"),
        ],
        discounts=[
            discount(201, end=day(0), ticket_date=day(-5)),
            discount(202, end=date(1900, 1, 1), ticket_date=day(1)),
        ],
        orders=[order(1, day(25))],
    )
    assert _month_rows(Q.q07_discount_end_to_ticket(t, R)) == {1: (1,)}
    assert _month_rows(Q.q09_dated_discount_churn(t, R)) == {1: (1, 1, 0)}
    det = Q.q12_open_discount_reversal_churn(t, R)
    assert rows(det) == [(202, 202, 1, day(5), day(1), day(25))]
    assert rows(Q.q11_reversal_discount_match(t, R), "ticket_id") == [(202,)]


# -- rounding ---------------------------------------------------------------------------


@pytest.mark.parametrize("total, count, expected", [(201, 200, 1.01), (1, 3, 0.33), (2, 3, 0.67), (7, 1, 7.0)])
def test_half_up_mean(spark, total, count, expected):
    df = spark.createDataFrame([(total, count)], "t BIGINT, n BIGINT")
    assert df.select(half_up_mean_2dp(F.col("t"), F.col("n"))).first()[0] == expected


def test_half_up_mean_of_nothing_is_null(spark):
    df = spark.createDataFrame([(0, 0)], "t BIGINT, n BIGINT")
    assert df.select(half_up_mean_2dp(F.col("t"), F.col("n"))).first()[0] is None


# -- toggles ---------------------------------------------------------------------------


def test_subarea_and_area_toggles(spark):
    t = tables(
        spark,
        sales=[sale(1, D0), sale(2, D0)],
        tickets=[
            ticket(1, day(5), subarea="bill_amount", area="credit_note"),
            ticket(2, day(5), subarea="bill_detail", area="general"),
        ],
    )
    assert _month_rows(Q.q01_sale_to_ticket(t, R)) == {1: (2,)}
    assert _month_rows(Q.q01_sale_to_ticket(t, R, subarea="bill_detail")) == {1: (1,)}
    assert _month_rows(Q.q01_sale_to_ticket(t, R, area=R.credit_note_areas)) == {1: (1,)}


def test_reversal_discount_probe_toggles(spark):
    t = tables(
        spark,
        tickets=[
            ticket(1, day(5), ticket_id=301, reason="auto_reversal", status="void"),  # not clean
            ticket(2, day(5), ticket_id=302, reason="auto_reversal"),
        ],
        discounts=[
            discount(301, end=date(1900, 1, 1), ticket_date=day(1)),
            discount(302, end=day(40), ticket_date=day(9)),  # after the reversal
        ],
    )
    assert rows(Q.q11_reversal_discount_match(t, R), "ticket_id") == [(301,), (302,)]
    assert rows(Q.q11_reversal_discount_match(t, R, clean=True), "ticket_id") == [(302,)]
    assert rows(Q.q11_reversal_discount_match(t, R, discount_kind="open_ended"), "ticket_id") == [(301,)]
    assert rows(Q.q11_reversal_discount_match(t, R, ordered_dates=True), "ticket_id") == [(301,)]


def test_ticket_grain_event_level(spark):
    # contract 1: discount tickets on day 0 (churn +10) and day 100 (no churn after)
    t = tables(
        spark,
        tickets=[ticket(1, day(0), ticket_id=401), ticket(1, day(0), ticket_id=402)],
        discounts=[discount(401, ticket_date=day(0)), discount(402, ticket_date=day(100))],
        orders=[order(1, day(10))],
    )
    assert _month_rows(Q.q08_zero_discount_followup(t, R)) == {1: (1, 1, 0), 4: (1, 1, 0)}
    assert _month_rows(Q.q08_zero_discount_followup(t, R, flag_level="event")) == {1: (1, 1, 0), 4: (1, 0, 1)}


def test_year_month_cohort_keeps_years_apart(spark):
    t = tables(spark, retention=[retention(1, date(1997, 3, 5)), retention(1, date(1998, 3, 5))])
    assert _month_rows(Q.q13_retained_by_month(t, R)) == {3: (1,)}
    assert _month_rows(Q.q13_retained_by_month(t, R, cohort="year_month")) == {199703: (1,), 199803: (1,)}


def test_survey_named_operators(spark):
    from churnlab.operators import flag_contract, monthly_distinct

    t = _two_month_contract(spark)
    pairs = Q.sale_ticket_pairs(t, R, W_0_60)
    flagged = flag_contract(pairs, q.uninstalls(t.service_orders, R), "contract", "ticket_date", "churn_date", W_0_60)
    assert sorted(r["churned"] for r in flagged.collect()) == [True, True]
    assert _month_rows(monthly_distinct(flagged, "contract", "sale_date", "churned")) == {1: (1, 1, 0), 9: (1, 1, 0)}
    d = tables(spark, discounts=[discount(1, amount=0.0, pct=0.1, end=date(1900, 1, 1), ticket_date=D0)])
    assert q.discounts(d.discounts, R, "zero_amount").count() == 1
    assert q.discounts(d.discounts, R, "zero_pct").count() == 0
    assert q.discounts(d.discounts, R, "open_ended").count() == 1
    assert q.discounts(d.discounts, R, "dated").count() == 0
    with pytest.raises(ValueError):
        q.discounts(d.discounts, R, "nope")


def test_zoned_retention_timestamp_uses_utc_day(spark):
    from churnlab.sources import DomainTables

    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Costa_Rica")
        ret = spark.sql(
            "SELECT 1L AS contract, 5L AS ticket_id, TIMESTAMP '1997-03-01 02:00:00 UTC' AS finished_ts, "
            "'retained' AS outcome, 'offer' AS subarea_group, 'discount' AS strategy"
        )
        t = DomainTables.from_frames({"retention_tickets": ret})
        assert rows(q.retained(t.retention_tickets, R), "retained_date") == [(date(1997, 3, 1),)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_tune_sizes_partitions(spark):
    from churnlab.session import tune

    keys = ("spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes",
            "spark.sql.adaptive.coalescePartitions.initialPartitionNum",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        tune(spark, input_bytes=100 * (1 << 40))
        assert int(spark.conf.get("spark.sql.shuffle.partitions")) == 40_000
        tune(spark, input_bytes=100 * (1 << 40), shuffle_bytes=1 << 40)
        assert int(spark.conf.get("spark.sql.shuffle.partitions")) == 8192
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


@pytest.mark.parametrize("window, bins", [(W_0_60, 60), (W_TENURE, 31), (W_90_120, 45), (DayWindow(0, 180), 365)])
def test_day_bins_find_the_same_pairs(spark, window, bins):
    offsets = [0, 1, 29, 30, 31, 59, 60, 61, 90, 91, 119, 120, 121, 179, 180, 181, 210, 211, 400]
    a = spark.createDataFrame([(1, day(n)) for n in (0, 3, 45, 200)] + [(2, None)], "contract BIGINT, a_date DATE")
    b = spark.createDataFrame([(1, day(n)) for n in offsets] + [(2, day(5))], "contract BIGINT, b_date DATE")
    plain = events_within(a, b, "contract", "a_date", "b_date", window)
    binned = events_within(a, b, "contract", "a_date", "b_date", window, bin_days=bins)
    assert binned.columns == plain.columns
    assert rows(binned) == rows(plain) and len(rows(plain)) > 0


def test_day_bins_reject_a_too_narrow_bin(spark):
    a = spark.createDataFrame([(1, D0)], "contract BIGINT, a_date DATE")
    with pytest.raises(ValueError):
        events_within(a, a.withColumnRenamed("a_date", "b_date"), "contract", "a_date", "b_date", W_0_60, bin_days=30)


@pytest.mark.parametrize("kind", ["bigint", "int", "double", "decimal(38,9)"])
def test_keys_of_every_type_join(spark, kind):
    from churnlab.sources.extracts import key_text

    a = spark.sql(f"SELECT CAST(12345678 AS {kind}) AS k")
    b = spark.sql("SELECT ' 12345678 ' AS k")
    left, right = (df.select(key_text(df["k"], df.schema["k"].dataType, "k").alias("k")) for df in (a, b))
    assert [r.k for r in left.join(right, "k").collect()] == ["12345678"]


def test_key_with_a_fraction_raises(spark):
    from churnlab.sources.extracts import key_text

    df = spark.sql("SELECT 1.5D AS k")
    with pytest.raises(Exception, match="not a whole number"):
        df.select(key_text(df["k"], df.schema["k"].dataType, "k")).collect()


def test_salt_stays_in_the_join_keys(spark):
    from churnlab.operators import flag_by_key

    rows = spark.createDataFrame([(1, 10), (None, 11), (2, 12)], "contract BIGINT, ticket BIGINT")
    marks = spark.createDataFrame([(1,)], "contract BIGINT")
    out = flag_by_key(rows, marks, "contract", spread_by=["ticket"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "_salt" in next(x for x in plan.splitlines() if "Join" in x and "_salt" in x)
    assert sorted((r.ticket, r.churned) for r in out.collect()) == [(10, True), (11, False), (12, False)]


def test_files_added_later_are_read(spark, tmp_path):
    from pathlib import Path

    from churnlab.plans import catalog

    # files anew, as the given ones and their folder are read-only
    folder = tmp_path / "sf"
    folder.mkdir()
    for name in ("orders", "customer", "lineitem"):
        (folder / f"{name}.parquet").write_bytes(Path(f"/root/testdata/sf0.001/{name}.parquet").read_bytes())
    run = catalog.queries()["q18_reversals_by_month"]
    whole = sum(r.total for r in run(spark, str(folder)).collect())
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    (folder / "lineitem.parquet").unlink()
    lines.filter("l_orderkey % 2 = 0").write.parquet(str(folder / "lineitem.parquet"))
    half = sum(r.total for r in run(spark, str(folder)).collect())
    lines.filter("l_orderkey % 2 <> 0").write.mode("append").parquet(str(folder / "lineitem.parquet"))
    assert half < whole == sum(r.total for r in run(spark, str(folder)).collect())
