"""Structured Streaming forms of the event operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from heronlake.operators.events import STAGE_PROGRESS, TERMINAL

EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The events table as a stream of files; ``path`` names one file or a folder of them."""
    glob = path[:-1] + "[" + path[-1] + "]"  # a pattern, for a stream cannot start from a single file's plain path
    return spark.readStream.schema(EVENT).parquet(glob).withColumn("ts", F.col("ts").cast("timestamp"))


def dedupe(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each (job_id, event_id) once; state older than the watermark is dropped."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["job_id", "event_id"])


def request_rate(stream: DataFrame, client: str, limit: int, delay: str = "1 hour") -> DataFrame:
    g = stream.withWatermark("ts", delay).groupBy(F.col(client).alias("client"), F.window("ts", "60 seconds").alias("w")).agg(F.count("*").alias("n"))
    return g.where(F.col("n") > limit).select("client", F.col("w.start").alias("window_start"), "n")


class JobProgress(StatefulProcessor):
    """Per job: greatest progress, the first end by event id, and the number of events."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("job", "progress int, status string, end_id long, events long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        progress, status, end_id, n = self.state.get() if self.state.exists() else (0, "running", None, 0)
        for pdf in rows:
            for event_id, stage in zip(pdf["event_id"], pdf["stage"]):
                n += 1
                progress = max(progress, STAGE_PROGRESS.get(stage, 0))
                if stage in TERMINAL and (end_id is None or event_id < end_id):
                    status, end_id = stage, int(event_id)
        self.state.update((int(progress), status, end_id, int(n)))
        yield pd.DataFrame({"job_id": [key[0]], "progress": [progress], "status": [status], "events": [n]})

    def close(self) -> None:
        pass


class ExpiringJobs(StatefulProcessor):
    """Per job: the latest event id; state unused for the time to live is dropped by the store."""

    def __init__(self, ttl_ms: int = 1_800_000):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", "event_id long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.state.get()[0] if self.state.exists() else -1
        for pdf in rows:
            last = max(last, int(pdf["event_id"].max()))
        self.state.update((last,))
        yield pd.DataFrame({"job_id": [key[0]], "last_event_id": [last]})

    def close(self) -> None:
        pass


def progress_stream(stream: DataFrame) -> DataFrame:
    """job_id, progress, status, events of job events, as updates; folds to the batch operators' result."""
    return stream.groupBy("job_id").transformWithStateInPandas(JobProgress(), "job_id long, progress int, status string, events long", "Update", "None")


def expiring_stream(stream: DataFrame, ttl_ms: int = 1_800_000) -> DataFrame:
    return stream.groupBy("job_id").transformWithStateInPandas(ExpiringJobs(ttl_ms), "job_id long, last_event_id long", "Update", "ProcessingTime")


def drain(stream: DataFrame, name: str, checkpoint: str, mode: str = "update", once: bool = False) -> DataFrame:
    """Run a stream over what is there and give all rows it emitted, from files in the checkpoint folder.

    ``once`` runs a single batch: a stream with processing-time state never counts as finished.
    """
    spark = stream.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    out = f"{checkpoint}/{name}-rows"

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batch_id_{batch_id}")

    try:
        q = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{checkpoint}/{name}-log").trigger(**({"once": True} if once else {"availableNow": True})).start()
        q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.parquet(f"{out}/*")
