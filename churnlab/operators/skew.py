"""Joins that split heavy keys, and distinct rows that several branches of a plan share.

Heavy keys are found at run time by a mergeable frequency sketch and are the only ones
that are salted; into how many pieces follows from their estimated counts.  Nothing is
collected: the sketch is one row of the plan, and the keys it reports are broadcast, at
most one for each shuffle partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALT, FAN = "_salt", "_fan"
LEAST_TRACKED, MOST_TRACKED = 1_000, 1_000_000
# a heavy key is cut finer than a partition's share, so that pieces which meet in one
# partition by their hash don't make it much larger than the others
FINE = 8
MERGE_GROUPS = 200


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def heavy_keys(df: DataFrame, key: str, pieces: int | None = None) -> DataFrame:
    """``(key, _fan)``: the keys of ``df`` that hold more than one of ``pieces`` equal shares
    of its rows, and into how many pieces of ``1 / FINE`` share they are cut.

    ``pieces`` defaults to the number of shuffle partitions.  The sketch tracks four times
    as many keys, so its counts are off by at most about a third of a share, and a key with
    that many rows more than a share is never missed.  The null key is not reported.
    """
    pieces = pieces or shuffle_partitions(df)
    tracked = min(MOST_TRACKED, max(LEAST_TRACKED, 4 * pieces))
    # the tasks' sketches are merged in groups first, so that no task reads them all
    groups = df.groupBy(F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS)).alias("_g"))
    partial = groups.agg(F.expr(f"approx_top_k_accumulate(`{key}`, {tracked})").alias("_sketch"), F.count("*").alias("_n"))
    # grouped by a constant, as the merge doesn't take tasks without a sketch
    one = partial.groupBy((F.col("_g") < 0).alias("_none"))
    whole = one.agg(F.expr(f"approx_top_k_combine(_sketch, {tracked})").alias("_sketch"), F.sum("_n").alias("_all"))
    top = F.expr(f"approx_top_k_estimate(_sketch, {min(pieces, tracked // 2)})")
    rows = whole.select(F.explode(top).alias("_t"), "_all")
    fan = F.ceil(F.col("_t.count") * F.lit(FINE * pieces) / F.col("_all")).cast("int")
    return rows.select(F.col("_t.item").alias(key), F.least(fan, F.lit(FINE * pieces)).alias(FAN)).filter(F.col(key).isNotNull() & (F.col(FAN) > FINE))


def spread_left_join(
    df: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str],
    pieces: int | None = None,
) -> DataFrame:
    """Left equi-join on ``keys`` that splits the rows of heavy values of the first key.

    The rows of ``df`` with a heavy key get a salt below the key's fan, a stable hash of
    ``spread_by`` (a re-run after the loss of an executor sees the same); those of ``right``
    with that key are repeated once per salt.  All other keys keep salt 0 and one copy.
    Rows with a null key match nothing and are spread over all pieces.
    """
    pieces = pieces or shuffle_partitions(df)
    key = keys[0]
    heavy = F.broadcast(heavy_keys(df, key, pieces))  # at most ``pieces`` rows
    hashed = F.xxhash64(*[F.col(c) for c in spread_by])
    salt = F.when(F.col(key).isNull(), F.pmod(hashed, F.lit(FINE * pieces))).otherwise(F.pmod(hashed, F.coalesce(F.col(FAN), F.lit(1))))
    left = df.join(heavy, key, "left").withColumn(SALT, salt.cast("int")).drop(FAN)
    every = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(FAN), F.lit(1)) - 1))
    copies = right.join(heavy, key, "left").withColumn(SALT, every).drop(FAN)
    return left.join(copies, [*keys, SALT], "left").drop(SALT).select(*df.columns, *[c for c in right.columns if c not in keys])


def shared_distinct(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct rows of ``cols``, de-duplicated map-side and dealt by all columns, whose
    exchange every reader in one plan shares.

    Grouping is by one struct, so the rows are dealt anew even where ``df`` is already
    partitioned by some of the columns (its own skew isn't kept), and the columns come out
    through a count, so that neither a filter nor a pruned column of one reader reaches
    below: all readers have the same exchange, and Spark runs it once.
    """
    rows = df.groupBy(F.struct(*cols).alias("_row")).agg(F.count("*").alias("_n"))
    return rows.select(*[F.when(F.col("_n") > 0, F.col(f"_row.{c}")).alias(c) for c in cols])
