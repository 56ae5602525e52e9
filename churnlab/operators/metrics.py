"""Monthly aggregates.

Counts are distinct keys per cohort.  Instead of several ``countDistinct``
columns (which Spark expands into one copy of every row per distinct column),
rows are first reduced to one per (group, cohort, key) with the flags'
max/min, then counted; the first step runs on the key partitioning already
present, the second is a partial/final aggregate over a handful of groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlab.config import CHURNED, KEPT
from churnlab.functions.dates import cohort as cohort_of
from churnlab.functions.dates import day_diff
from churnlab.functions.rounding import half_up_mean_2dp


def ordered(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Sort a small result (one row per cohort and group): only the finished groups go to
    one task, the aggregate before stays parallel, and no sampling job is needed."""
    return df.repartition(1).sortWithinPartitions(*cols)


def _unique(cols: Sequence[str]) -> list[str]:
    return list(dict.fromkeys(cols))


def monthly_counts(
    df: DataFrame,
    key: str,
    date_col: str,
    flag: str | None = None,
    by: Sequence[str] = (),
    cohort: str = "month",
    flag_key: str | Sequence[str] | None = None,
) -> DataFrame:
    """Distinct ``key`` per cohort of ``date_col`` (and ``by`` groups).

    Without ``flag``: columns ``[*by, month, total]``.  With a boolean
    ``flag``: also ``churned`` (keys with a true row) and ``kept`` (keys with a
    false row).  ``flag_key`` lifts the flag first: a row counts as flagged
    when any row with the same ``flag_key`` is (the contract-level churn
    flag); it is computed from one partial row per (group, cohort, key) and a
    window over the few such rows of a flag key, so no row is re-joined.
    For contract-level flags ``churned + kept = total``.  A null key counts in
    no column (like ``COUNT(DISTINCT key)``) but its group still shows.
    """
    month = cohort_of(F.col(date_col), cohort).alias("month")
    groups = [*by, "month"]
    if flag is None:
        per = df.select(*by, month, key).distinct()
        return ordered(per.groupBy(*groups).agg(F.count(key).alias("total")), groups)

    f = F.col(flag).cast("int")
    if flag_key is None:
        per = df.groupBy(*by, month, F.col(key)).agg(F.max(f).alias("_any"), F.min(f).alias("_all"))
    else:
        fk = [flag_key] if isinstance(flag_key, str) else list(flag_key)
        part = df.groupBy(*_unique([*by, key, *fk]), month).agg(F.max(f).alias("_h"))
        part = part.withColumn("_f", F.max("_h").over(Window.partitionBy(*fk)))
        if fk == [key]:
            per = part.select(*by, "month", key, F.col("_f").alias("_any"), F.col("_f").alias("_all"))
        else:
            per = part.groupBy(*by, "month", key).agg(F.max("_f").alias("_any"), F.min("_f").alias("_all"))
    out = per.groupBy(*groups).agg(
        F.count(key).alias("total"),
        F.count(F.when(F.col("_any") == 1, F.col(key))).alias(CHURNED),
        F.count(F.when(F.col("_all") == 0, F.col(key))).alias(KEPT),
    )
    return ordered(out, groups)


# the survey's name for the same operator
monthly_distinct = monthly_counts


def monthly_mean_days(
    df: DataFrame,
    key: str,
    start: str,
    end: str,
    cohort: str = "month",
    split: str | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Mean whole days from ``start`` to ``end`` (rows with ``end > start``),
    rounded half-up to 2 decimals, and distinct ``key`` per cohort of
    ``start``: columns ``month, mean_days, total``.

    ``weight`` (a positive whole number per row) counts a row that many times,
    as if it were repeated; with a boolean ``split`` column the same pair is
    added for its true rows (``churned_mean_days``, ``churned``) and false
    rows (``kept_mean_days``, ``kept``).

    The ``end > start`` condition is applied inside the aggregates (and
    cohorts without a valid row are dropped afterwards) rather than as a row
    filter: a filter would be pushed into the scan of this branch only, and a
    plan that reads the same rows elsewhere could no longer share the scan.
    """
    valid = F.col(end) > F.col(start)
    w = F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
    rows = df.select(
        "*",
        F.when(valid, day_diff(F.col(end), F.col(start)).cast("bigint")).alias("_days"),
        F.when(valid, w).alias("_wt"),
    )
    month = cohort_of(F.col(start), cohort).alias("month")

    conds: list[tuple[str, Column | None]] = [("", None)]
    if split:
        conds += [("churned_", F.col(split)), ("kept_", ~F.col(split))]
    aggs = []
    for prefix, cond in conds:
        dw = F.col("_days") * F.col("_wt")
        ww = F.col("_wt")
        if cond is not None:
            dw, ww = F.when(cond, dw), F.when(cond, ww)
        aggs += [F.sum(dw).alias(f"_{prefix}s"), F.sum(ww).alias(f"_{prefix}n")]
    per = rows.groupBy(month, F.col(key)).agg(*aggs)
    out_aggs = []
    for prefix, _ in conds:
        n_keys = F.count(F.when(F.col(f"_{prefix}n") > 0, F.col(key)))
        out_aggs += [
            half_up_mean_2dp(F.sum(f"_{prefix}s"), F.sum(f"_{prefix}n")).alias(f"{prefix}mean_days"),
            n_keys.alias("total" if prefix == "" else prefix.rstrip("_")),
        ]
    out = per.groupBy("month").agg(*out_aggs, F.sum("_n").alias("_valid")).filter(F.col("_valid") > 0)
    return ordered(out.drop("_valid"), ["month"])


def detail(df: DataFrame, cols: Sequence[str | Column]) -> DataFrame:
    """Distinct detail rows instead of counts."""
    return df.select(*cols).distinct()
