"""Exact distinct counts that grow with the data.

``COUNT(DISTINCT key)`` by cohort can't be added up from the counts of parts.  Bitmaps can:
keys get dense numbers, a cohort's keys are the set bits of fixed-size bitmaps (one for
each 32,768 numbers), and the bitmaps of old and new rows are joined by OR.  A state in
files holds the numbers and the bitmaps; adding rows reads the new rows and the state,
never the old rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NUMBER = "_number"


def numbered(keys: DataFrame, key: str, start: int = 0) -> DataFrame:
    """``(key, _number)``: dense numbers from ``start`` on for the distinct keys.

    Keys are dealt by hash and numbered within their share of the table; a share's first
    number is the size of the shares before it, from one small row a share.  No task sees
    more than its share.
    """
    shares = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = keys.filter(F.col(key).isNotNull()).select(key).distinct().withColumn("_share", F.pmod(F.xxhash64(key), F.lit(shares)))
    sizes = distinct.groupBy("_share").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_share").rowsBetween(Window.unboundedPreceding, -1)  # at most ``shares`` rows
    firsts = sizes.select("_share", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_first"))
    place = F.row_number().over(Window.partitionBy("_share").orderBy(key))
    found = distinct.withColumn("_place", place).join(F.broadcast(firsts), "_share")
    return found.select(key, (F.col("_first") + F.col("_place") - 1 + F.lit(start)).cast("bigint").alias(NUMBER))


def cohort_bitmaps(rows: DataFrame, numbers: DataFrame, key: str, cohort: Column) -> DataFrame:
    """``(cohort, bucket, bits)`` of the keys of ``rows``.  A null key sets no bit, but its cohort
    shows (with bucket null), as in ``GROUP BY cohort``."""
    found = rows.select(cohort.alias("cohort"), key).distinct().join(numbers, key, "left")
    bucket = F.bitmap_bucket_number(F.col(NUMBER)).alias("bucket")
    return found.groupBy("cohort", bucket).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col(NUMBER))).alias("bits"))


def merged(bitmaps: DataFrame) -> DataFrame:
    return bitmaps.groupBy("cohort", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def counts(bitmaps: DataFrame) -> DataFrame:
    """``(month, total)`` from merged bitmaps."""
    return bitmaps.groupBy(F.col("cohort").alias("month")).agg(F.sum(F.when(F.col("bucket").isNotNull(), F.bitmap_count("bits")).otherwise(0)).cast("bigint").alias("total"))


class DistinctState:
    """Distinct counts by cohort kept in a folder that all executors share.

    ``add`` writes a new version below ``folder`` and then names it in a file, so a failed
    run leaves the version before.  Adding the same rows twice changes no count.
    """

    def __init__(self, spark: SparkSession, folder: str, key_type: str = "bigint", cohort_type: str = "bigint"):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.schemas = {"numbers": f"k {key_type}, {NUMBER} bigint", "bitmaps": f"cohort {cohort_type}, bucket bigint, bits binary"}

    def _versions(self) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/versions")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _read(self, table: str) -> DataFrame:
        versions = self._versions()
        if not versions:
            return self.spark.createDataFrame([], self.schemas[table])
        names = versions if table == "numbers" else versions[-1:]  # numbers are added to, bitmaps replaced
        paths = [f"{self.folder}/data/{v.split('_', 1)[1]}/{table}" for v in names]
        return self.spark.read.schema(self.schemas[table]).parquet(*paths)

    def add(self, rows: DataFrame, key: str, cohort: Column) -> None:
        """Adds the keys of new ``rows`` to their cohorts."""
        version, run = len(self._versions()), uuid.uuid4().hex[:12]
        old = self._read("numbers").withColumnRenamed("k", key)
        start = (old.agg(F.max(NUMBER)).first()[0] + 1) if version else 0
        new = rows.filter(F.col(key).isNotNull()).select(key).distinct().join(old.select(key), key, "left_anti")
        place = f"{self.folder}/data/{run}"
        numbered(new, key, start).withColumnRenamed(key, "k").write.parquet(f"{place}/numbers")
        added = self.spark.read.schema(self.schemas["numbers"]).parquet(f"{place}/numbers").withColumnRenamed("k", key)
        bits = cohort_bitmaps(rows, old.unionByName(added), key, cohort)
        merged(self._read("bitmaps").unionByName(bits)).write.parquet(f"{place}/bitmaps")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/versions/{version:08d}_{run}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(path, False).close()

    def totals(self) -> DataFrame:
        return counts(self._read("bitmaps"))
