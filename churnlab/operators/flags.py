"""Flags and segments attached to anchor rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlab.config import DayWindow
from churnlab.functions.dates import in_window
from churnlab.operators.skew import shuffle_partitions, spread_left_join
from churnlab.operators.windows import BIN, dealt_in_bins

def flag_rows(
    anchors: DataFrame,
    outcomes: DataFrame,
    key: str,
    anchor_date: str,
    outcome_date: str,
    window: DayWindow,
    flag: str = "churned",
    bin_days: int | str | None = None,
) -> DataFrame:
    """Row-level flag: true when an outcome of the same key falls inside
    ``window`` after this row's own date.

    Planned as one existence join (sort-merge or broadcast on the key): each
    anchor row comes out once, whatever the number of matching outcomes.  ``bin_days`` adds
    day bins to the key as in :func:`churnlab.operators.windows.events_within`.
    """
    o = outcomes.select(key, F.col(outcome_date).alias("_out"))
    columns, keys = anchors.columns, [key]
    if bin_days is not None:
        anchors, o = dealt_in_bins(anchors, o, key, anchor_date, "_out", window, bin_days)
        keys.append(BIN)
    a, o = anchors.alias("_a"), o.alias("_o")
    cond = in_window(F.col("_o._out"), F.col(f"_a.{anchor_date}").outer(), window)
    for k in reversed(keys):
        cond = (F.col(f"_o.{k}") == F.col(f"_a.{k}").outer()) & cond
    return a.select("*", o.where(cond).exists().alias(flag)).select(*columns, flag)


def flag_contract(
    anchors: DataFrame,
    outcomes: DataFrame,
    key: str,
    anchor_date: str,
    outcome_date: str,
    window: DayWindow,
    flag: str = "churned",
) -> DataFrame:
    """Contract-level flag on anchor rows at (key, date) grain: true on every
    row of a key with an outcome inside ``window`` after *any* of its anchors
    (existence join, then a window max over the key's rows)."""
    rows = flag_rows(anchors, outcomes, key, anchor_date, outcome_date, window, flag)
    return lift_flag(rows, flag, [key])


def lift_flag(df: DataFrame, flag: str, keys: Sequence[str]) -> DataFrame:
    """Key-level flag: true on every row of a key that has one true row
    (one churn marks all anchors of that contract, earlier or later)."""
    return df.withColumn(flag, F.max(F.col(flag)).over(Window.partitionBy(*keys)))


def flag_by_key(
    df: DataFrame,
    marked: DataFrame,
    key: str | Sequence[str],
    flag: str = "churned",
    spread_by: Sequence[str] | None = None,
) -> DataFrame:
    """Key-level flag from a set of marked keys: true on every row of ``df``
    whose key occurs in ``marked``.

    ``marked`` is reduced to distinct keys, so the left join never multiplies
    rows.  With ``spread_by`` the rows of a heavy key, and those with a null key, are
    split by a hash of these columns (:func:`spread_left_join`).
    """
    keys = [key] if isinstance(key, str) else list(key)
    marks = marked.select(*keys).distinct().withColumn(flag, F.lit(True))
    out = spread_left_join(df, marks, keys, spread_by) if spread_by else df.join(marks, keys, "left")
    return out.withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def flag_via_anchors(
    rows: DataFrame,
    outcomes: DataFrame,
    key: str,
    anchor_date: str,
    outcome_date: str,
    window: DayWindow,
    level: str = "contract",
    flag: str = "churned",
    spread_by: Sequence[str] | None = None,
) -> DataFrame:
    """Flag rows of a finer grain than (key, date), e.g. tickets of a contract.

    The window test runs once per distinct ``(key, anchor_date)`` (at most one
    row per key and day, whatever the number of rows behind it), and the result
    is joined back to the rows: by key (``level="contract"``: one hit marks
    every row of the key) or by key and day (``level="event"``).
    """
    if level not in ("contract", "event"):
        raise ValueError(f"unknown level {level!r}")
    anchors = rows.filter(F.col(key).isNotNull()).select(key, anchor_date).distinct()
    hit = flag_rows(anchors, outcomes, key, anchor_date, outcome_date, window, flag="_hit")
    marks = hit.filter(F.col("_hit"))
    on = [key] if level == "contract" else [key, anchor_date]
    return flag_by_key(rows, marks, on, flag, spread_by)


def outcome_counts(hits: DataFrame, key: str, outcome_date: str, count_col: str = "_outcomes") -> DataFrame:
    """Distinct outcome dates per key (the multiplicity a left join of the
    anchors to those dates would produce)."""
    return hits.select(key, outcome_date).distinct().groupBy(key).agg(F.count(outcome_date).alias(count_col))


def attach_outcomes(
    df: DataFrame,
    hits: DataFrame,
    key: str,
    outcome_date: str,
    flag: str = "churned",
    spread_by: Sequence[str] | None = None,
) -> DataFrame:
    """Each row repeated once per distinct ``(key, outcome_date)`` of ``hits``
    (a null date when there is none), as the scripts' detail output does."""
    dates = hits.select(key, outcome_date).distinct()
    out = spread_left_join(df, dates, [key], spread_by) if spread_by else df.join(dates, key, "left")
    return out.withColumn(flag, F.col(outcome_date).isNotNull())


def attach_earlier(
    df: DataFrame,
    earlier: DataFrame,
    key: str,
    spread_by: Sequence[str],
) -> DataFrame:
    """Each row repeated once per distinct row of ``earlier`` with the same ``key`` (other
    columns null when there is none): the earlier events that made it a repeat contact."""
    return spread_left_join(df, earlier.distinct(), [key], spread_by)


def mark_contact(
    events: DataFrame,
    key: str,
    date: str,
    cause: Column,
    contact: Column,
    window: DayWindow,
) -> DataFrame:
    """Which causes were followed by a contact of the same key, in one pass over ``events``
    (one row per key and day; a day may be both).

    Adds ``followed`` (a cause with a contact inside ``window`` after it), ``answer`` (a contact
    inside ``window`` after some cause) and ``called`` (the key has a followed cause).  Ranges
    over the key's sorted days replace the join of causes and contacts; an undated row is
    in no range.
    """
    if window.max_days is None:
        raise ValueError("mark_contact needs a bounded window")
    days = Window.partitionBy(key).orderBy(F.unix_date(F.col(date)))
    ahead = days.rangeBetween(window.min_days, window.max_days)
    behind = days.rangeBetween(-window.max_days, -window.min_days)
    dated = F.col(date).isNotNull()
    is_cause, is_contact = (cause & dated).cast("int"), (contact & dated).cast("int")
    out = events.select(
        "*",
        (F.coalesce(F.max(is_contact).over(ahead), F.lit(0)) * is_cause == 1).alias("followed"),
        (F.coalesce(F.max(is_cause).over(behind), F.lit(0)) * is_contact == 1).alias("answer"),
    )
    return out.withColumn("called", F.max("followed").over(Window.partitionBy(key)))


def bucket_of(days: str, edges: Sequence[int]) -> Column:
    """Bucket number 1..n of a day difference for edges e1 < ... < en:
    (0, e1] -> 1, (e1, e2] -> 2, ..."""
    expr = None
    for i, edge in enumerate(edges, start=1):
        cond = F.col(days) <= edge
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr


def segment_recurrence(
    pairs: DataFrame,
    key: str,
    days_col: str,
    edges: Sequence[int],
    labels: Sequence[str],
    segment_col: str = "segment",
) -> DataFrame:
    """Repeat-contact segment of the rows in the last bucket.

    ``pairs`` is one interval join over ``(0, edges[-1]]`` with the day
    difference in ``days_col``.  Per key, flags say which earlier buckets
    occur (from any sale of the key).  The segment is the length of the run
    of consecutive earlier buckets going back from the last one: with edges
    (60, 120, 180), buckets 2 and 1 -> ``labels[2]``, bucket 2 only ->
    ``labels[1]``, no bucket 2 -> ``labels[0]`` (a key seen in buckets 1 and 3
    but not 2 is ``labels[0]``).

    One join and a window over the key (already the join's partitioning)
    replace one join per bucket and the chained left joins.
    """
    n = len(edges)
    if len(labels) != n:
        raise ValueError("need one label per possible run length 0..n-1")
    w = Window.partitionBy(key)
    b = pairs.withColumn("_bucket", bucket_of(days_col, edges))
    # all flags in one projection: one Window operator, one pass over the key
    b = b.select("*", *[F.max((F.col("_bucket") == i).cast("int")).over(w).alias(f"_b{i}") for i in range(1, n)])
    # run = b_{n-1} * (1 + b_{n-2} * (1 + ... * (1 + b_1))), built innermost first
    run = F.lit(0)
    for i in range(1, n):
        run = F.col(f"_b{i}") * (F.lit(1) + run)
    label = F.element_at(F.array(*[F.lit(x) for x in labels]), (run + 1).cast("int"))
    last = b.filter(F.col("_bucket") == n)
    return last.withColumn(segment_col, label).drop("_bucket", *[f"_b{i}" for i in range(1, n)])


def split_contacted(anchors: DataFrame, pairs: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Anchors of keys with at least one pair (contacted) and of keys with none.

    Contact is a property of the key: every anchor of a contacted key goes to
    the contacted branch, even one without a pair of its own.

    The anchors are dealt to a stated number of partitions, which adaptive execution doesn't
    coalesce: their rows compress so well that it would put millions into one task, which
    sorts them once for each join.  It is a left join with the distinct keys, as Spark pushes
    semi and anti joins below such a deal and then drops it.
    """
    keys = pairs.select(key).distinct().withColumn("_met", F.lit(True))
    dealt = anchors.repartition(shuffle_partitions(anchors), key)
    marked = dealt.join(keys, key, "left").select(*anchors.columns, "_met")
    return marked.filter(F.col("_met")).drop("_met"), marked.filter(F.col("_met").isNull()).drop("_met")
