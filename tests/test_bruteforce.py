"""Random small domain tables (nulls, duplicates, one contract holding a third
of all tickets) against plain-Python brute force of the query semantics."""

import random
from collections import defaultdict
from datetime import date, datetime, timedelta

import pytest

from churnlab.config import FIXTURE_RULES as R
from churnlab.plans import queries as Q
from domain_rows import order, retention, sale, tables, ticket

START = date(1997, 1, 1)
_RETENTION: dict = {}
AGING = set(R.aging_subareas)


def _d(rng, p_null=0.0):
    return None if rng.random() < p_null else START + timedelta(days=rng.randrange(0, 400))


def _random_tables(spark, seed):
    rng = random.Random(seed)
    contracts = list(range(1, 25))

    def contract():
        return 1 if rng.random() < 1 / 3 else rng.choice(contracts)  # contract 1 is hot

    tickets = []
    for _ in range(600):
        opened = _d(rng, 0.05)
        closed = None if opened is None or rng.random() < 0.1 else opened + timedelta(days=rng.randrange(0, 20))
        row = ticket(
            None if rng.random() < 0.03 else contract(),
            opened,
            closed=closed,
            cls=None if rng.random() < 0.05 else "service",
            reason=rng.choice(["billing_inquiry", "billing_inquiry", "auto_reversal", "technical"]),
            area=rng.choice(["credit_note", "credit_notes", "general"]),
            subarea=rng.choice(["bill_amount", "bill_detail", "aging_0_30", None]),
            status=rng.choice(["closed", "closed", "void", None]),
        )
        tickets.append(row)
        if rng.random() < 0.1:
            tickets.append(row)  # exact duplicate fact
    orders = []
    for _ in range(150):
        fin = _d(rng, 0.1)
        orders.append(
            order(
                contract(),
                fin,
                opened=None if rng.random() < 0.1 else fin,
                order_type=rng.choice(["uninstall", "install"]),
                status=rng.choice(["completed", "open"]),
            )
        )
    sales = [
        sale(contract(), _d(rng), sub_channel=rng.choice(["retail", "retail", None, "hospitality"]))
        for _ in range(200)
    ]
    ret = []
    for _ in range(200):
        d = _d(rng)
        ts = datetime(d.year, d.month, d.day, rng.choice([0, 12, 23]), rng.choice([0, 30]))
        ret.append(
            retention(
                None if rng.random() < 0.03 else contract(),
                None if rng.random() < 0.05 else ts,
                outcome=rng.choice(["retained", "retained", "lost"]),
                group=rng.choice(["offer", "service", "relocation"]),
                strategy=rng.choice(["discount", "excluded_4", None]),
            )
        )
    t = tables(spark, sales=sales, tickets=tickets, orders=orders, retention=ret)
    _RETENTION[seed] = ret
    return t, sales, tickets, orders


# -- brute force ----------------------------------------------------------------------


def _clean(t):
    _, _, _, _, cls, _, _, sub, status = t
    return cls is not None and sub is not None and sub not in AGING and status is not None and status != "void"


def _in(later, earlier, lo, hi):
    return later is not None and earlier is not None and lo < (later - earlier).days <= hi


def _uninstalls(orders):
    return {(c, f) for c, o, f, typ, st in orders if typ == "uninstall" and st == "completed" and f and o and c}


def _reversals(tickets):
    return {(t[1], t[2]) for t in tickets if _clean(t) and t[1] is not None and t[5] == "auto_reversal"}


def _billing(tickets):
    return {(t[1], t[2]) for t in tickets if _clean(t) and t[1] is not None and t[2] and t[5] == "billing_inquiry"}


def _counts(rows, churned_keys, month_of):
    """rows: (key, date) -> {month: (total, churned, kept)}"""
    per = defaultdict(set)
    for k, d in rows:
        per[None if d is None else d.month].add(k)
    return {m: (len(ks), len(ks & churned_keys), len(ks - churned_keys)) for m, ks in per.items()}


def brute_q19(tickets, orders):
    pairs = {(c, r, b) for c, r in _reversals(tickets) for c2, b in _billing(tickets) if c == c2 and _in(b, r, 0, 60)}
    un = _uninstalls(orders)
    churned = {c for c, _, b in pairs for c2, f in un if c2 == c and _in(f, b, 0, 60)}
    return _counts({(c, r) for c, r, _ in pairs}, churned, None)


def brute_q20a(tickets, orders):
    revs = _reversals(tickets)
    called = {c for c, r in revs for c2, b in _billing(tickets) if c == c2 and _in(b, r, 0, 60)}
    rows = {(c, r) for c, r in revs if c not in called}
    un = _uninstalls(orders)
    churned = {c for c, r in rows for c2, f in un if c2 == c and _in(f, r, 0, 60)}
    return _counts(rows, churned, None)


def brute_q06(sales, tickets, orders):
    qual = {
        (c, d)
        for c, d, st, ct, sub, mv, rs in sales
        if st == "new" and ct in R.customer_types and d and d.year == R.year
        and sub is not None and sub not in R.excluded_sub_channels and mv == "activation" and rs in R.sale_reasons
    }
    pairs = [(c, s, b, (b - s).days) for c, s in qual for c2, b in _billing(tickets) if c == c2 and _in(b, s, 0, 180)]
    has = defaultdict(set)
    for c, _, _, d in pairs:
        has[c].add(1 if d <= 60 else 2 if d <= 120 else 3)
    rows = [(c, s, b) for c, s, b, d in pairs if d > 120]
    un = _uninstalls(orders)
    churned = {c for c, _, b in rows for c2, f in un if c2 == c and _in(f, b, 0, 60)}
    out = {}
    for seg in ("new", "repeat_2m_4m", "repeat_le_2m"):
        def segment(c):
            if 2 not in has[c]:
                return "new"
            return "repeat_le_2m" if 1 in has[c] else "repeat_2m_4m"

        sub = {(c, s) for c, s, _ in rows if segment(c) == seg}
        for m, v in _counts(sub, churned, None).items():
            out[(seg, m)] = v
    return out


def _half_up(total, n):
    return ((200 * total + n) // (2 * n)) / 100


def brute_q22(tickets, orders):
    notes = {
        (t[1], t[2], t[3])
        for t in tickets
        if _clean(t) and t[1] is not None and t[2] and t[5] == "billing_inquiry" and t[6] in R.credit_note_areas
    }
    un = _uninstalls(orders)
    dates = defaultdict(set)
    for c, o, cl in notes:
        for c2, f in un:
            if c2 == c and _in(f, cl, 0, 60):
                dates[c].add(f)
    acc = defaultdict(lambda: [0, 0, set()])
    for c, o, cl in notes:
        if cl is not None and cl > o:
            w = max(1, len(dates[c]))
            a = acc[o.month]
            a[0] += (cl - o).days * w
            a[1] += w
            a[2].add(c)
    return {m: (_half_up(s, n), len(cs)) for m, (s, n, cs) in acc.items()}


# -- tests ------------------------------------------------------------------------------

SEEDS = [1, 2, 3]


@pytest.mark.parametrize("seed", SEEDS)
def test_reversal_queries_match_brute_force(spark, seed):
    t, _, tickets, orders = _random_tables(spark, seed)
    got19 = {r["month"]: tuple(r)[1:] for r in Q.q19_reversal_ticket_churn(t, R).collect()}
    assert got19 == brute_q19(tickets, orders)
    got20 = {r["month"]: tuple(r)[1:] for r in Q.q20a_reversal_no_call_churn(t, R).collect()}
    assert got20 == brute_q20a(tickets, orders)


@pytest.mark.parametrize("seed", SEEDS)
def test_segments_match_brute_force(spark, seed):
    t, sales, tickets, orders = _random_tables(spark, seed)
    got = {(r["segment"], r["month"]): tuple(r)[2:] for r in Q.q06_repeat_ticket_3_segments_churn(t, R).collect()}
    assert got == brute_q06(sales, tickets, orders)


@pytest.mark.parametrize("seed", SEEDS)
def test_weighted_resolution_matches_brute_force(spark, seed):
    t, _, tickets, orders = _random_tables(spark, seed)
    got = {r["month"]: (r["mean_days"], r["total"]) for r in Q.q22_credit_note_resolution_churn(t, R).collect()}
    assert got == brute_q22(tickets, orders)


def brute_retained(ret, orders, offer, strategies, lo, hi):
    rows = {
        (c, ts.date())
        for c, _, ts, outcome, group, strategy in ret
        if c is not None and ts is not None and outcome == "retained"
        and (not offer or group == "offer")
        and (not strategies or (strategy is not None and strategy not in R.excluded_strategies))
    }
    un = _uninstalls(orders)
    churned = {c for c, d in rows for c2, f in un if c2 == c and _in(f, d, lo, hi)}
    return _counts(rows, churned, None)


@pytest.mark.parametrize("seed", SEEDS)
def test_retention_matches_brute_force(spark, seed):
    t, _, _, orders = _random_tables(spark, seed)
    ret = _RETENTION[seed]
    got14 = {r["month"]: tuple(r)[1:] for r in Q.q14_retained_offer_churn_0_60(t, R).collect()}
    assert got14 == brute_retained(ret, orders, True, False, 0, 60)
    got16 = {r["month"]: tuple(r)[1:] for r in Q.q16_retained_strategy_churn_90_120(t, R).collect()}
    assert got16 == brute_retained(ret, orders, False, True, 90, 120)
