"""Session settings for a given input size."""

from __future__ import annotations

from pyspark.sql import SparkSession

MIB = 1024**2
PARTITION_BYTES = 128 * MIB
MAX_PARTITIONS = 50_000
MAX_SCAN_TASKS = 100_000


def shuffle_settings(input_bytes: int, cores: int) -> dict[str, str]:
    """Adaptive settings that keep a shuffle partition near 128 MB.

    AQE can only merge partitions, so the initial number must suit the whole
    input.  Blocks grow as map times reduce tasks, hence the two limits: 100 TB
    are scanned by 100 000 tasks of 1 GB and shuffled into 50 000 partitions of
    2 GB, which spill but fit.  Skewed join partitions are split further.
    """
    scan = max(2 * PARTITION_BYTES, input_bytes // MAX_SCAN_TASKS)
    wanted = -(-input_bytes // PARTITION_BYTES)
    initial = min(max(wanted, 2 * cores), MAX_PARTITIONS)
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(initial),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(PARTITION_BYTES),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.files.maxPartitionBytes": str(scan),
    }


def configure(spark: SparkSession, input_bytes: int, cores: int | None = None) -> None:
    cores = cores or spark.sparkContext.defaultParallelism
    for key, value in shuffle_settings(input_bytes, cores).items():
        spark.conf.set(key, value)
