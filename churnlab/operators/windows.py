"""Interval operators: events of one kind followed by events of another kind
of the same key inside a day window.

Both are equi-joins on the key with the day window as a residual condition,
so Spark plans a sort-merge (or, below the broadcast threshold measured at
runtime, a broadcast hash) join on the key; no cartesian or nested-loop join.
Inputs are expected to be de-duplicated on (key, date) by the qualify
operators, which caps the rows per key at the number of distinct dates.
"""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlab.config import DayWindow
from churnlab.functions.dates import day_diff, in_window
from churnlab.operators.skew import FAN, heavy_keys


BIN, WIDTH, SALTS = "_bin", "_width", "_salts"


def key_bins(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_date: str,
    right_date: str,
    window: DayWindow,
    pieces: int | None = None,
) -> DataFrame:
    """``(key, _width, _salts)``: for the keys that hold more than a share of all events
    (:func:`churnlab.operators.skew.heavy_keys`), how to cut them.

    The width of a bin is the key's span of days divided by the pieces it should be cut into,
    but no less than the window, so that an event reaches two bins at most.  Where that
    gives too few bins, each bin's left events are split by ``_salts`` and its right events
    repeated.  At most one row for each shuffle partition.
    """
    days = left.select(key, F.col(left_date).alias("_day")).unionAll(right.select(key, F.col(right_date).alias("_day")))
    heavy = F.broadcast(heavy_keys(days, key, pieces))
    spans = days.join(heavy, key).groupBy(key).agg((F.datediff(F.max("_day"), F.min("_day")) + 1).alias("_span"), F.max(FAN).alias(FAN))
    least = window.max_days - window.min_days + 1
    width = F.greatest(F.ceil(F.col("_span") / F.col(FAN)), F.lit(least)).cast("int")
    cut = spans.filter(F.col("_span").isNotNull()).select(key, width.alias(WIDTH), "_span", FAN)
    # pieces meet in partitions by their hash: four times as many even that out
    return cut.select(key, WIDTH, F.greatest(F.ceil(4 * F.col(FAN) * F.col(WIDTH) / F.col("_span")), F.lit(1)).cast("int").alias(SALTS))


def dealt_in_bins(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_date: str,
    right_date: str,
    window: DayWindow,
    bin_days: int | str,
) -> tuple[DataFrame, DataFrame]:
    """Both sides with a day bin ``_bin``: a left event is in one, a right event in the one or
    two that its window reaches, so that each pair meets in exactly one.

    ``bin_days`` is one width for all keys, or ``"auto"``: bins and salts of :func:`key_bins`
    for the heavy keys and the single bin 0, without copies, for all others.  A left event's
    salt is a hash of its row.
    """
    if window.max_days is None:
        raise ValueError("bins need a bounded window")
    ld, rd = F.unix_date(F.col(left_date)), F.unix_date(F.col(right_date))
    bins_of = lambda w: F.sequence(F.floor((rd - window.max_days) / w), F.floor((rd - window.min_days) / w))
    if bin_days != "auto":
        if bin_days < window.max_days - window.min_days + 1:
            raise ValueError("bin_days needs a window no wider than the bin")
        return left.withColumn(BIN, F.floor(ld / bin_days)), right.withColumn(BIN, F.explode(bins_of(bin_days)))
    cuts = F.broadcast(key_bins(left, right, key, left_date, right_date, window))
    width, salts, none = F.col(WIDTH), F.col(SALTS), F.lit(0).cast("bigint")
    # one number for bin and salt; a bin's salts are consecutive
    own = F.floor(ld / width) * salts + F.pmod(F.xxhash64(*left.columns), salts)
    dealt = left.join(cuts, key, "left").withColumn(BIN, F.when(width.isNotNull(), own).otherwise(none))
    first, last = F.floor((rd - window.max_days) / width), F.floor((rd - window.min_days) / width)
    every = F.sequence(first * salts, last * salts + salts - 1)
    copies = F.explode(F.when(width.isNotNull() & rd.isNotNull(), every).otherwise(F.array(none)))
    return dealt.select(*left.columns, BIN), right.join(cuts, key, "left").withColumn(BIN, copies).select(*right.columns, BIN)


def events_within(
    left: DataFrame,
    right: DataFrame,
    key: str | Sequence[str],
    left_date: str,
    right_date: str,
    window: DayWindow,
    days_col: str | None = None,
    bin_days: int | str | None = None,
) -> DataFrame:
    """Inner interval join: pairs (left event, right event) with equal ``key``
    and ``right_date`` inside ``window`` days after ``left_date``.

    The output has all left columns, the right columns except the key and,
    if ``days_col`` is given, the day difference.  Other column names must not
    collide.  Distinct inputs give distinct pairs.

    ``bin_days`` adds a day bin to the join key (:func:`dealt_in_bins`): a width for all keys,
    at least the window's, or ``"auto"`` for bins of the heavy keys only, their widths taken
    from the keys' counts and spans.  A heavy key is then spread over many join groups, and
    each compares the days of a bin instead of all days with all.  The output is
    partitioned by (key, bin).
    """
    keys = [key] if isinstance(key, str) else list(key)
    if bin_days is not None:
        left, right = dealt_in_bins(left, right, keys[0], left_date, right_date, window, bin_days)
        keys = keys + [BIN]
    lhs, rhs = left.alias("_l"), right.alias("_r")
    days = day_diff(F.col(f"_r.{right_date}"), F.col(f"_l.{left_date}"))
    cond = in_window(F.col(f"_r.{right_date}"), F.col(f"_l.{left_date}"), window)
    for k in keys:
        cond = (F.col(f"_l.{k}") == F.col(f"_r.{k}")) & cond
    cols = [F.col(f"_l.{c}") for c in left.columns if c != "_bin"]
    cols += [F.col(f"_r.{c}") for c in right.columns if c not in keys]
    if days_col:
        cols.append(days.alias(days_col))
    return lhs.join(rhs, cond, "inner").select(*cols)


def follow_on(
    outcomes: DataFrame,
    anchors: DataFrame,
    key: str,
    anchor_date: str,
    outcome_date: str,
    window: DayWindow,
    dedupe_anchors: bool = True,
) -> DataFrame:
    """Outcome rows that fall inside ``window`` after *some* anchor of the
    same key (a left-semi join; the outcome side is never multiplied).

    The anchor side is reduced to distinct ``(key, anchor_date)`` first, which
    bounds the rows per key by its number of days.  Pass
    ``dedupe_anchors=False`` when the anchors are already at (key, few dates)
    grain and are read elsewhere in the same plan: the projection then stays
    identical to that other use and Spark shares the scan and shuffle.
    """
    a = anchors.select(key, F.col(anchor_date).alias("_anchor"))
    if dedupe_anchors:
        a = a.distinct()
    a = a.alias("_a")
    o = outcomes.alias("_o")
    cond = (F.col(f"_o.{key}") == F.col(f"_a.{key}")) & in_window(
        F.col(f"_o.{outcome_date}"), F.col("_a._anchor"), window
    )
    return o.join(a, cond, "left_semi")


def reachable(
    outcomes: DataFrame,
    outcome_date: str,
    first: datetime.date | None,
    last: datetime.date | None,
    window: DayWindow,
) -> DataFrame:
    """Outcomes that can follow an anchor dated ``first`` to ``last`` (the earliest and the
    latest; none without anchors).  The bounds are constants, so they reach the scan and
    files and row groups outside are skipped."""
    if first is None or last is None:
        return outcomes.filter(F.lit(False))
    out = outcomes.filter(F.col(outcome_date) >= F.lit(first + datetime.timedelta(window.min_days)))
    if window.max_days is None:
        return out
    return out.filter(F.col(outcome_date) <= F.lit(last + datetime.timedelta(window.max_days)))
