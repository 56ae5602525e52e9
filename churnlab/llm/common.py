"""Helpers shared by the operators: tables, the shared folder, components, shingles."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MIX = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(columns: list[str], name: str) -> str:
    """``name``, with underscores added until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


@lru_cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="churnlab-")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that the cluster names in spark.checkpoint.dir.

    Only a local session without that setting gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{_local_root()}"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{uuid.uuid4().hex}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def written_at(df: DataFrame, *partition_by: str) -> tuple[DataFrame, str]:
    """df written as Parquet in the shared folder and read again, and its folder: cuts the
    lineage, and a lost executor costs no recomputation of what is before."""
    path = shared_folder(df.sparkSession)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """The table of :func:`written_at`."""
    return written_at(df, *partition_by)[0]


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder that :func:`written_at` made, once nothing reads it any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def released(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of queries that have ended: it waits until the driver
    collects its garbage, which one with a large heap seldom does."""
    for _ in range(2):  # what the first finds may still be named by what goes with it
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.2)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node reachable.

    Large-star and small-star rounds on the edge table; each round is written to
    the shared folder.  A hub's neighbours stay rows of a joinable table.
    """
    e = edges.filter("a <> b").selectExpr("greatest(a, b) AS u", "least(a, b) AS v").distinct()
    e, seen = written(e), None
    for _ in range(max_rounds):
        both = e.unionByName(e.selectExpr("v AS u", "u AS v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").selectExpr("v AS u", "m AS v").filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.selectExpr("greatest(v, m) AS u", "least(v, m) AS v").unionByName(low.selectExpr("u", "m AS v"))
        e = written(small.filter("u <> v").distinct())
        sign = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if sign == seen:
            break
        seen = sign
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.selectExpr("u AS node", "v AS root").unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, remembered for up to ``size`` words."""

    def __init__(self, size: int = 400_000):
        super().__init__()
        self.size = size

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.size:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


HASHES = WordHashes()


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    h = h ^ (h >> np.uint64(31))
    h = h * MIX
    return h ^ (h >> np.uint64(29))


def words_of(text: str | None) -> list[bytes]:
    """The words [^ \\t-\\r]+ of the text with A-Z lower-cased (bytes.split and
    bytes.lower know exactly these characters)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_hashes(words: list[bytes], width: int = 5) -> np.ndarray:
    """A 64-bit hash for each run of ``width`` words, in order; with fewer words one
    for the whole sequence; none without words."""
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))
    k = min(width, len(words))
    h = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        h = h * MIX + w[i : i + len(h)]
    return mixed(h)
