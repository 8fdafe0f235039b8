"""Session settings and table access shared by every operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: A side of a join is broadcast only when its table is fixed in size and below this.
BROADCAST_ROWS = 20_000


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings the operators rely on; what the cluster sets (memory, partitions) stays as it is."""
    for key, value in (
        ("spark.sql.session.timeZone", "UTC"),
        ("spark.sql.adaptive.enabled", "true"),
        ("spark.sql.adaptive.coalescePartitions.enabled", "true"),
        ("spark.sql.adaptive.skewJoin.enabled", "true"),
        ("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k"),  # rows here cost far more CPU than their bytes tell
        ("spark.sql.execution.arrow.maxRecordsPerBatch", "2000"),
    ):
        spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession, fallback: str = "/tmp/lexforge-checkpoints") -> str:
    """The shared checkpoint folder that the session names. Where none is set, one of this machine's serves a local session (tests); on a cluster that raises."""
    at = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = fallback
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(at)
    return at


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_rows(df: DataFrame, what: str, limit: int = BROADCAST_ROWS) -> list:
    """Collects a dimension table whose size is fixed, after checking that bound; raises beyond it."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what} has more than {limit} rows; it is no bounded dimension table")
    return rows


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows spread over all shuffle partitions by key, for Python work that is heavy for its bytes; adaptive execution would join these partitions again."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
