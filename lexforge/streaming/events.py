"""Run events as a stream: duplicates dropped by run and sequence, windowed counts, and the state machine of runs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

#: The statuses of a run and what may follow each.
FOLLOWS = {"queued": ("starting", "cancelled"), "starting": ("running", "failed", "cancelled"), "running": ("completed", "failed", "cancelling"), "cancelling": ("cancelled", "failed", "completed"), "completed": (), "failed": (), "cancelled": ()}


def read_events(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", glob: str | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8)
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.format(fmt).load(path)


def deduplicated(events: DataFrame, keys: list[str], time: str = "ts", late: str = "7 days") -> DataFrame:
    """Each event once; state older than the watermark is dropped."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def windowed(events: DataFrame, time: str, size: str, by: list[str], value: str, late: str = "1 hour") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.window(time, size), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def next_status(now: str, event: str) -> str:
    """The status after an event; one that may not follow leaves it."""
    return event if event in FOLLOWS.get(now, ()) else now


def run_status(events: DataFrame, run: str = "run_id", order: str = "sequence", status: str = "status") -> DataFrame:
    """Streaming state machine: run, status, sequence after each batch. Events at or before a run's last sequence are ignored."""
    schema = T.StructType([events.schema[run], T.StructField("status", T.StringType()), T.StructField("sequence", T.LongType())])
    state = T.StructType([T.StructField("status", T.StringType()), T.StructField("sequence", T.LongType())])

    def step(key: tuple, batches: Iterator[pd.DataFrame], kept) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        now, last = kept.get if kept.exists else ("queued", -1)
        for pdf in batches:
            for s, n in sorted(zip(pdf[order], pdf[status])):
                if s > last:
                    now, last = next_status(now, n), int(s)
        kept.update((now, last))
        yield pd.DataFrame([(key[0], now, last)], columns=[f.name for f in schema])

    return events.groupBy(run).applyInPandasWithState(step, schema, state, "update", "NoTimeout")


def status_changes(events: DataFrame, run: str, order: str, status: str) -> DataFrame:
    """Batch form: events at which a run's status differs from the one before."""
    by = W.partitionBy(run).orderBy(order)
    return events.withColumn("previous", F.lag(status).over(by)).where(~F.col("previous").eqNullSafe(F.col(status)))


def tail(events: DataFrame, run: str, after: int, order: str = "sequence") -> DataFrame:
    """Events of a run after a sequence, for a reader that resumes."""
    return events.where((F.col("run_id") == run) & (F.col(order) > after)).orderBy(order)


def append(events: DataFrame, path: str, state: str, keys: tuple[str, ...] = ("run_id", "sequence"), time: str = "ts", late: str = "3650 days"):  # noqa: ANN201
    """The running query that appends each (run, sequence) once to a Parquet store; `state` is its checkpoint folder, so a restart goes on."""
    return deduplicated(events, list(keys), time, late).writeStream.format("parquet").option("path", path).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
