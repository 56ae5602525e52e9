"""Heavy keys, shared scans, runtime filters and date ranges: results and what the plans did."""

import contextlib
import random
from collections import Counter, defaultdict
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from churnlab.config import FIXTURE_RULES as R
from churnlab.config import W_0_60, DayWindow
from churnlab.functions.rounding import half_up_mean_units, units
from churnlab.operators.bitmaps import DistinctState, numbered
from churnlab.operators.flags import attach_outcomes, flag_rows, mark_contact
from churnlab.operators.skew import FINE, heavy_keys, shared_distinct, spread_left_join
from churnlab.operators.windows import dealt_in_bins, events_within, key_bins, reachable
from churnlab.plans import queries as Q
from churnlab.sources import DOMAIN_TABLES, DomainTables
from paths import SF_CHECK
from plan_nodes import metric, nodes, scans, shuffled_rows

NO_BROADCAST = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
BLOOM = "spark.sql.optimizer.runtime.bloomFilter."


@contextlib.contextmanager
def conf(spark, **values):
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture(scope="module")
def extracts(spark, tmp_path_factory):
    """The domain tables as files of their own."""
    root = tmp_path_factory.mktemp("extracts")
    t = DomainTables.from_testdata(spark, SF_CHECK)
    for name in DOMAIN_TABLES:
        getattr(t, name).write.parquet(str(root / name))
    return str(root)


def tables(spark, root):
    return DomainTables.from_frames({n: spark.read.parquet(f"{root}/{n}") for n in DOMAIN_TABLES})


# -- heavy keys --------------------------------------------------------------


def skewed(spark, n=60_000):
    """A third of the rows has key 7, a tenth none."""
    return spark.range(n).selectExpr("CASE WHEN id % 3 = 0 THEN 7 WHEN id % 10 = 1 THEN NULL ELSE 100 + id END AS k", "id AS ticket")


def test_heavy_keys_are_found_with_their_share(spark):
    found = {r.k: r["_fan"] for r in heavy_keys(skewed(spark), "k", pieces=200).collect()}
    assert list(found) == [7] and abs(found[7] - 200 * FINE / 3) < 3
    assert heavy_keys(spark.range(1000).withColumnRenamed("id", "k"), "k", pieces=50).collect() == []
    assert heavy_keys(skewed(spark).limit(0), "k", pieces=50).collect() == []
    text = skewed(spark).withColumn("k", F.col("k").cast("string"))
    assert [r.k for r in heavy_keys(text, "k", pieces=200).collect()] == ["7"]


def test_spread_join_equals_the_plain_join(spark):
    rows = skewed(spark, 6000)
    right = spark.createDataFrame([(7, 1), (7, 2), (105, 3), (101, None), (None, 4), (5, 5)], "k BIGINT, v INT")
    got = spread_left_join(rows, right, ["k"], ["ticket"], pieces=64)
    want = rows.join(right, "k", "left").select("k", "ticket", "v")
    assert got.columns == ["k", "ticket", "v"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    two = rows.withColumn("d", F.col("ticket") % 2)
    by_two = spread_left_join(two, right.withColumn("d", F.lit(0).cast("bigint")), ["k", "d"], ["ticket"], pieces=64)
    assert by_two.filter("k = 7").count() == 2000 + 1000  # even tickets match twice


def test_largest_task_is_near_the_median(spark):
    """One key with a third of the rows and a tenth without key: every join task reads about the same."""
    parts = 300
    rows = skewed(spark, 120_000)
    right = rows.select("k").distinct().withColumn("v", F.lit(True))
    off = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": str(parts)} | NO_BROADCAST
    with conf(spark, **off):
        sizes = lambda df: sorted(r.n for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.count("v")).collect())
        plain = sizes(rows.join(right, "k", "left"))
        spread = sizes(spread_left_join(rows, right, ["k"], ["ticket"]))
    assert sum(plain) == sum(spread) == 120_000
    assert plain[-1] > 100 * plain[len(plain) // 2]
    assert spread[-1] <= 3 * spread[len(spread) // 2]


def test_fan_out_splits_a_heavy_contract(spark):
    rows = spark.range(9000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE 100 + id END AS contract", "id AS ticket")
    hits = spark.createDataFrame([(7, date(1997, 1, d)) for d in (1, 2, 3)] + [(101, date(1997, 2, 1)), (9, date(1997, 2, 1))], "contract BIGINT, churn_date DATE")
    off = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "60"} | NO_BROADCAST
    with conf(spark, **off):
        out = attach_outcomes(rows, hits, "contract", "churn_date", spread_by=["ticket"])
        got = Counter((r.contract, r.churned) for r in out.collect())
        sizes = sorted(r.n for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.max("churn_date")).collect())
    assert got[(7, True)] == 9000 and got[(101, True)] == 1 and sum(got.values()) == 9000 + 6000
    assert sizes[-1] <= 3 * sizes[len(sizes) // 2]


def test_readers_share_the_distinct_rows(spark):
    rows = spark.range(1000).selectExpr("id % 10 AS a", "nullif(id % 7, 3) AS b")
    once = shared_distinct(rows, ["a", "b"])
    assert once.count() == 70 and once.filter("b IS NULL").count() == 10
    with conf(spark, **NO_BROADCAST):
        both = once.filter("b IS NOT NULL").groupBy("a").agg(F.count("*").alias("n")).join(once.select("a").distinct(), "a")
        both.collect()
    assert [n for n, _ in nodes(both)].count("RangeExec") == 1


# -- one table in two roles --------------------------------------------------

TWO_ROLES = {
    "q08": Q.q08_zero_discount_followup, "q09": Q.q09_dated_discount_churn, "q12": Q.q12_open_discount_reversal_churn,
    "q20b": Q.q20b_reversal_no_call_as_written, "q20d": Q.q20d_reversal_call_comparison, "q20a": Q.q20a_reversal_no_call_churn,
}


@pytest.mark.parametrize("name", TWO_ROLES)
def test_tickets_are_scanned_once(spark, extracts, name):
    with conf(spark, **NO_BROADCAST):
        df = TWO_ROLES[name](tables(spark, extracts), R)
        df.collect()
    assert len(scans(df, "/tickets")) == 1


def test_comparison_has_half_the_exchanges(spark, extracts):
    with conf(spark, **NO_BROADCAST):
        one = Q.q20d_reversal_call_comparison(tables(spark, extracts), R)
        two = Q._compared_by_event(tables(spark, extracts), R, "month", None)
        one.collect(), two.collect()
    exchanges = lambda df: sum(n in ("ShuffleExchangeExec", "ReusedExchangeExec") for n, _ in nodes(df))
    assert 2 * exchanges(one) <= exchanges(two) + 1


# -- semi-join reduction -----------------------------------------------------


@pytest.mark.parametrize("query", [Q.q08_zero_discount_followup, Q.q12_open_discount_reversal_churn])
def test_bloom_filter_drops_tickets_before_the_shuffle(spark, extracts, query):
    """Tickets that reach an exchange are about those whose id a discount has."""
    t = tables(spark, extracts)
    disc = t.discounts.filter("discount_amount = 0.0" if query is Q.q08_zero_discount_followup else "discount_end < DATE '1901-01-01'")
    n_tickets = t.tickets.count()
    matching = t.tickets.join(disc, "ticket_id", "left_semi").count()
    rows = {}
    for on in ("true", "false"):
        with conf(spark, **NO_BROADCAST, **{BLOOM + "enabled": on, BLOOM + "applicationSideScanSizeThreshold": "1", BLOOM + "creationSideThreshold": "1GB"}):
            df = query(tables(spark, extracts), R)
            result = sorted(map(tuple, df.collect()), key=repr)
            scan = scans(df, "/tickets")[0]
            filters = [p for n, p in nodes(df) if n == "FilterExec" and "might_contain" in p.condition().toString()]
            rows[on] = (result, shuffled_rows(df, "opened") + shuffled_rows(df, "_owner") + shuffled_rows(df, "contract"))
            assert metric(scan, "numOutputRows") == n_tickets and bool(filters) == (on == "true")
            if on == "true":
                assert metric(filters[0], "numOutputRows") <= 1.1 * matching + 50 < n_tickets / 2
    assert rows["true"][0] == rows["false"][0]


# -- date ranges -------------------------------------------------------------


def test_outcomes_outside_the_reachable_days_are_not_read(spark, tmp_path):
    """Row groups of service orders beyond the anchors' days plus the window are skipped."""
    day0 = date(1990, 1, 1)
    orders = spark.range(200_000).selectExpr(
        "id % 500 AS contract", f"DATE_ADD(DATE '{day0}', CAST(id DIV 40 AS INT)) AS opened", f"DATE_ADD(DATE '{day0}', CAST(id DIV 40 AS INT)) AS finished",
        "'uninstall' AS order_type", "'completed' AS status",
    )
    path = str(tmp_path / "service_orders")
    orders.coalesce(1).sortWithinPartitions("finished").write.option("parquet.block.size", 65536).parquet(path)
    retained = spark.range(300).selectExpr(
        "id AS contract", "id AS ticket_id", "CAST(DATE '1997-03-01' AS TIMESTAMP_NTZ) AS finished_ts", "'retained' AS outcome", "'offer' AS subarea_group", "'x' AS strategy"
    )
    t = DomainTables.from_frames({"service_orders": spark.read.parquet(path), "retention_tickets": retained})
    read = []
    for measured in (False, True):
        if measured:
            Q.measure_reach(t, R, ["retained_offer"])
        df = Q.q14_retained_offer_churn_0_60(t, R)
        assert [tuple(r) for r in df.collect()] == [(3, 300, 300, 0)]
        scan = scans(df, "/service_orders")[0]
        read.append(metric(scan, "numOutputRows"))
    assert read[0] == 200_000 and read[1] < 200_000 / 5
    pushed = scan.metadata().apply("PushedFilters")
    assert "GreaterThanOrEqual(finished,1997-03-02)" in pushed and "LessThanOrEqual(finished,1997-04-30)" in pushed
    # the anchors' own days are what is measured, also where they are read from written sets
    Q.materialize_anchors(t, R, spark, folder=str(tmp_path / "sets"), names=["retained_offer_strategy"])
    assert t.reach[("retained", R, True, True)] == (date(1997, 3, 1), date(1997, 3, 1))


def test_static_bounds_of_sales_reach_the_scan(spark, extracts):
    df = Q.q02_sale_to_ticket_churn(tables(spark, extracts), R)
    df.collect()
    pushed = scans(df, "/service_orders")[0].metadata().apply("PushedFilters")
    assert "GreaterThanOrEqual(finished,1997-01-03)" in pushed and "LessThanOrEqual(finished,1998-04-30)" in pushed


def test_reachable_keeps_all_that_can_follow(spark):
    days = [date(1997, 1, 1) + timedelta(d) for d in range(100)]
    out = spark.createDataFrame([(d,) for d in days], "d DATE")
    got = lambda *a: sorted(r.d for r in reachable(out, "d", *a).collect())
    assert got(days[10], days[20], DayWindow(0, 30)) == days[11:51]
    assert got(days[10], days[20], DayWindow(5, None)) == days[16:]
    assert got(None, None, DayWindow(0, 30)) == []


def test_measured_reach_changes_no_result(spark, extracts):
    plain, bounded = tables(spark, extracts), tables(spark, extracts)
    Q.measure_reach(bounded, R)
    assert len(bounded.reach) == len(Q.ANCHOR_DAYS)
    for fn in (Q.q16_retained_strategy_churn_90_120, Q.q19_reversal_ticket_churn, Q.q20d_reversal_call_comparison, Q.q22_credit_note_resolution_churn):
        assert sorted(map(tuple, fn(plain, R).collect()), key=repr) == sorted(map(tuple, fn(bounded, R).collect()), key=repr)


# -- contact marks and exact means -------------------------------------------


def test_contact_marks_equal_brute_force(spark):
    rnd = random.Random(3)
    rows = {(rnd.randrange(40), rnd.choice([None, *range(0, 400)])): rnd.randrange(1, 4) for _ in range(900)}
    start = date(1997, 1, 1)
    data = [(c, None if d is None else start + timedelta(d), k) for (c, d), k in rows.items()]
    df = spark.createDataFrame(data, "contract INT, day DATE, kinds INT")
    marked = mark_contact(df, "contract", "day", F.col("kinds").bitwiseAND(F.lit(1)) == 1, F.col("kinds").bitwiseAND(F.lit(2)) == 2, W_0_60)
    by = defaultdict(list)
    for (c, d), k in rows.items():
        by[c].append((d, k))
    followed = lambda c, d: d is not None and any(x is not None and k & 2 and 1 <= x - d <= 60 for x, k in by[c])
    answer = lambda c, d: d is not None and any(x is not None and k & 1 and 1 <= d - x <= 60 for x, k in by[c])
    called = {c for c, v in by.items() if any(k & 1 and followed(c, d) for d, k in v)}
    for r in marked.collect():
        d = None if r.day is None else (r.day - start).days
        assert r.followed == bool(r.kinds & 1 and followed(r.contract, d))
        assert r.answer == bool(r.kinds & 2 and answer(r.contract, d))
        assert r.called == (r.contract in called)


def test_means_of_doubles_round_ties_away_from_zero_in_any_order(spark):
    import duckdb

    from churnlab.plans.oracle import _mean

    groups = {1: [0.005], 2: [0.1, 0.2, 0.15, 0.05], 3: [0.01, 0.02], 4: [1.005, 1.005], 5: [0.333333] * 3, 6: [0.0, None], 7: [None], 8: [2.5, 0.015] * 40}
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    want = {1: 0.01, 2: 0.13, 3: 0.02, 4: 1.01, 5: 0.33, 6: 0.0, 7: None, 8: 1.26}
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "g INT, x DOUBLE").repartition(5)
        got = df.groupBy("g").agg(half_up_mean_units(F.sum(units(F.col("x"))), F.count("x")).alias("m"))
        assert {r.g: r.m for r in got.collect()} == want
    con = duckdb.connect()
    con.execute("CREATE TABLE t (g INT, x DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", rows)
    sql = f"SELECT g, {_mean('CAST(round(x * 1000000) AS BIGINT)', 'if(x IS NULL, NULL, 1)', 1000000)} FROM t GROUP BY g"
    assert dict(con.execute(sql).fetchall()) == want
    below = spark.createDataFrame([(-0.005,)], "x DOUBLE").agg(half_up_mean_units(F.sum(units(F.col("x"))), F.count("x")).alias("m"))
    assert below.first().m == -0.01


# -- bins from the keys' own counts ------------------------------------------


def histories(spark, seed=5):
    """Contract 7 has nearly every day of ten years, the others a few; left and right events."""
    rnd = random.Random(seed)
    start = date(1990, 1, 1)
    rows = []
    for side in (0, 1):
        rows += [(side, 7, start + timedelta(d)) for d in range(3650) if rnd.random() < 0.9]
        rows += [(side, 100 + i % 900, start + timedelta(rnd.randrange(3650))) for i in range(6000)]
    rows = sorted({*rows, (0, 8, None), (1, 8, None), (0, None, start), (1, 7, None)}, key=repr)
    df = spark.createDataFrame(rows, "side INT, contract INT, day DATE")
    return rows, df.filter("side = 0").select("contract", F.col("day").alias("a")), df.filter("side = 1").select("contract", F.col("day").alias("b"))


def test_auto_bins_give_the_same_pairs(spark):
    rows, left, right = histories(spark)
    window = DayWindow(0, 30)
    days = defaultdict(lambda: ([], []))
    for side, c, d in rows:
        if c is not None and d is not None:
            days[c][side].append(d)
    want = sorted((c, a, b) for c, (x, y) in days.items() for a in x for b in y if 1 <= (b - a).days <= 30)
    for bins in (None, 45, "auto"):
        got = events_within(left, right, "contract", "a", "b", window, bin_days=bins)
        assert sorted(map(tuple, got.collect())) == want
        flagged = flag_rows(left, right, "contract", "a", "b", window, bin_days=bins)
        assert flagged.columns == ["contract", "a", "churned"]
        hit = {(c, a) for c, a, _ in want}
        assert all(r.churned == ((r.contract, r.a) in hit) for r in flagged.collect()) and flagged.count() == left.count()


def test_only_heavy_keys_are_binned_and_no_task_stands_out(spark):
    _, left, right = histories(spark)
    window = DayWindow(0, 30)
    with conf(spark, **{"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "32"}, **NO_BROADCAST):
        bins = key_bins(left, right, "contract", "a", "b", window)
        found = [tuple(r) for r in bins.collect()]
        assert [c for c, *_ in found] == [7] and found[0][1] >= 30
        sides = dealt_in_bins(left, right, "contract", "a", "b", window, "auto")
        largest = []
        for df, size in zip(sides, (left.count(), right.count())):
            read = df.repartition(32, "contract", "_bin").groupBy(F.spark_partition_id()).count()
            sizes = [r["count"] for r in read.collect()]
            assert sum(sizes) >= size
            largest.append(max(sizes) / sum(sizes))
        light = sides[1].filter("contract <> 7")
        assert light.filter("_bin <> 0").count() == 0 and light.count() == right.filter("contract <> 7").count()
    assert max(largest) < 0.06


# -- bucketed anchor tables and growing counts -------------------------------


def test_bucketed_anchors_need_no_exchange_before_the_count(spark, extracts, tmp_path):
    plain, t = tables(spark, extracts), tables(spark, extracts)
    Q.materialize_anchors(t, R, spark, folder=str(tmp_path), names=["ticket_events", "uninstalls", "retained_offer", "new_sales", "billing"], buckets=8)
    try:
        for fn, most in ((Q.q19_reversal_ticket_churn, 2), (Q.q14_retained_offer_churn_0_60, 2), (Q.q06_repeat_ticket_3_segments_churn, 2), (Q.q20d_reversal_call_comparison, 2)):
            with conf(spark, **NO_BROADCAST):
                df = fn(t, R)
                got = sorted(map(tuple, df.collect()), key=repr)
            assert got == sorted(map(tuple, fn(plain, R).collect()), key=repr)
            shuffles = [p.outputPartitioning().toString() for n, p in nodes(df) if n == "ShuffleExchangeExec"]
            # the groups by month and the one task that sorts them
            assert len(shuffles) <= most and not any("contract" in s for s in shuffles), fn.__name__
            assert not scans(df, "/tickets") and not scans(df, "/service_orders")
    finally:
        Q.drop_anchors(t, spark)
    assert not t.tables and not t._plans and not t.reach


def test_numbers_are_dense(spark):
    keys = spark.range(1000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 7 = 1 THEN NULL ELSE concat('c', id) END AS c")
    n = {r.c: r["_number"] for r in numbered(keys, "c", start=50).collect()}
    assert sorted(n.values()) == list(range(50, 50 + len(n))) and None not in n and "hot" in n
    assert numbered(keys.limit(0), "c").collect() == []


@pytest.mark.parametrize("which", ["q13", "q18", "q01"])
def test_growing_counts_read_only_new_rows(spark, extracts, tmp_path, which):
    """State after each of three parts equals the distinct counts over all rows so far."""
    t = tables(spark, extracts)
    rows, day = {
        "q13": lambda: (Q._retained(t, R), "retained_date"),
        "q18": lambda: (Q._reversals(t, R), "reversal_date"),
        "q01": lambda: (Q.sale_ticket_pairs(t, R, W_0_60), "sale_date"),
    }[which]()
    cuts = [F.col(day) < "1997-02-01", (F.col(day) >= "1997-02-01") & (F.col(day) < "1997-09-01"), F.coalesce(F.col(day) >= "1997-09-01", F.lit(True))]
    state = DistinctState(spark, str(tmp_path / "state"))
    month = F.month(F.col(day)).cast("bigint")
    for i, cut in enumerate(cuts):
        part = str(tmp_path / f"part{i}")
        rows.filter(cut).write.parquet(part)
        state.add(spark.read.parquet(part), "contract", month)
        state.add(spark.read.parquet(part).limit(5), "contract", month)  # again: no change
    want = {"q13": Q.q13_retained_by_month, "q18": Q.q18_reversals_by_month, "q01": Q.q01_sale_to_ticket}[which](t, R)
    total = state.totals()
    assert sorted(map(tuple, total.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert not scans(total, "/part")
    numbers = [r["_number"] for r in state._read("numbers").collect()]
    assert sorted(numbers) == list(range(len(numbers)))
