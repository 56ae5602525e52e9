"""SparkSession construction and the runtime SQL settings the queries rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Runtime SQL settings: adaptive execution re-plans joins from real stage sizes
# (broadcast only below the threshold, split skewed partitions, coalesce tiny
# ones).  The session time zone is left alone: day extraction never depends on
# it (zone-less timestamps give their wall-clock day, zoned ones their UTC day).
RUNTIME_SQL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    # no static broadcast: file sizes are estimates, only measured sizes decide
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    # lookups by ticket id: a Bloom filter of the filtered discounts drops tickets before
    # they are shuffled, where the tickets' scan is worth it and the discounts' isn't too large
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1GB",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "100GB",
}


def tune(
    spark: SparkSession,
    input_bytes: int | None = None,
    shuffle_bytes: int | None = None,
    scan_partition_bytes: int = 256 << 20,
    shuffle_partition_bytes: int = 128 << 20,
    max_shuffle_partitions: int = 40_000,
    lookup_ids: int | None = None,
) -> SparkSession:
    """Apply ``RUNTIME_SQL_CONF`` to an existing session.

    ``input_bytes`` are the bytes of the columns a query reads from its largest table;
    they size the scan splits' upper bound.  ``shuffle_bytes`` are the bytes it shuffles
    (default: a tenth of the input, as anchors are de-duplicated map-side) and size the
    initial shuffle partitions, from twice the cores up to ``max_shuffle_partitions``, as
    map tasks times partitions blocks are fetched; AQE coalesces what is smaller.
    ``lookup_ids`` is about how many ticket ids the filtered discounts hold; it sizes the
    Bloom filter of the ticket lookups (eight bits an id, at most 256 MB; beyond that the
    filter passes more tickets, never too few).
    """
    for key, value in RUNTIME_SQL_CONF.items():
        spark.conf.set(key, value)
    if lookup_ids:
        bits = str(min(8 * lookup_ids, 2**31 - 8))
        for name, value in (("expectedNumItems", lookup_ids), ("maxNumItems", lookup_ids), ("numBits", bits), ("maxNumBits", bits)):
            spark.conf.set(f"spark.sql.optimizer.runtime.bloomFilter.{name}", str(value))
    if input_bytes or shuffle_bytes:
        try:
            cores = spark.sparkContext.defaultParallelism
        except Exception:  # Spark Connect: no SparkContext on the client
            cores = 1
        shuffled = shuffle_bytes or input_bytes // 10
        parts = max(2 * cores, min(max_shuffle_partitions, -(-shuffled // shuffle_partition_bytes)))
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(scan_partition_bytes))
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(parts))
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(shuffle_partition_bytes))
    return spark


def local_session(
    cores: int | str = "*",
    shuffle_partitions: int = 8,
    driver_memory: str = "8g",
    app_name: str = "churnlab",
) -> SparkSession:
    """A local session for tests and the bench (Spark UI off).

    On a cluster, use the cluster's session and call :func:`tune`.  The queries
    are short acyclic plans, so they neither checkpoint nor cache: a lost
    executor's shuffle output is recomputed from the (deterministic) lineage.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in RUNTIME_SQL_CONF.items():
        builder = builder.config(key, value)
    # pinned for reproducible local output (results do not depend on it)
    spark = builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
