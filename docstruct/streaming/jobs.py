"""Job state over a stream of job events.

Aggregates (latest state, counts per window) are ordinary streaming aggregations. Following each job
from event to event comes in two forms. ``track_jobs`` keeps one small value per job in the RocksDB
store and costs only what a micro-batch holds, but all rows of a job in a micro-batch go through one
task. ``track_job_batches`` orders rows per time bucket like the batch operators, so no job is too
large, and rewrites a table of the last events per job with every micro-batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from docstruct import constants as K
from docstruct.operators import jobs as J

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_job_events(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    """Parquet folder as a stream; the number of files bounds what one micro-batch holds."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def latest_jobs_stream(job_events: DataFrame) -> DataFrame:
    """Latest row per job, for update or complete output mode."""
    return J.latest_jobs(job_events)


def status_counts_stream(job_events: DataFrame, width: str = "1 day", lateness: str = "1 day") -> DataFrame:
    """Events per status and window, final once the watermark has passed (append mode)."""
    return J.status_counts(job_events.withWatermark("ts", lateness), width)


class JobTracker(StatefulProcessor):
    """Emits each event with the status it came from and, for submissions, whether it counts.

    State per job: last status, and whether a submission is in flight. The rows of a job in one
    micro-batch are sorted by (ts, event_id); batches are expected in order.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("job", "status string, in_flight boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, in_flight = self.state.get() if self.state.exists() else (None, False)
        frame = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        before, accepted = [], []
        for now in frame["status"]:
            before.append(status)
            accepted.append(None if now != "pending" else not in_flight)
            if now == "pending" or now in K.TERMINAL_STATUSES:
                in_flight = now == "pending"
            status = now
        self.state.update((status, bool(in_flight)))
        yield pd.DataFrame(
            {
                "job_id": key[0],
                "event_id": frame["event_id"].to_numpy(),
                "from_status": before,
                "to_status": frame["status"].to_numpy(),
                "accepted": accepted,
            }
        )

    def close(self) -> None:
        pass


def track_jobs(job_events: DataFrame) -> DataFrame:
    """Transitions and accepted submissions of a stream: the twin of the batch operators in ``jobs``.

    The session needs the RocksDB state store (``ROCKSDB``) as ``spark.sql.streaming.stateStore.providerClass``.
    All events of a job in one micro-batch meet in one task: ``track_job_batches`` is the one for busy jobs.
    """
    tracked = (
        job_events.select("job_id", "event_id", "ts", "status")
        .groupBy("job_id")
        .transformWithStateInPandas(
            statefulProcessor=JobTracker(),
            outputStructType="job_id bigint, event_id bigint, from_status string, to_status string, accepted boolean",
            outputMode="Append",
            timeMode="None",
        )
    )
    return tracked.withColumn("allowed", J.is_allowed(F.col("from_status"), F.col("to_status")))


def write_stream(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    return (
        df.writeStream.format("parquet")
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )


def upsert_jobs_stream(job_events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps the job store up to date; each micro-batch writes its own folder, so a retry replaces it."""

    def save(batch: DataFrame, batch_id: int) -> None:
        J.latest_jobs(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        job_events.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def track_job_batches(job_events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Tables ``transitions`` and ``submissions`` under ``path``, one folder per micro-batch.

    ``state`` holds the last event and the last submission or end of each job; its rows stand before
    those of the next micro-batch. A repeated micro-batch reads the same state and replaces its output.
    """
    columns = ["job_id", "event_id", "ts", "status", "error_message"]

    def run(batch: DataFrame, batch_id: int) -> None:
        rows = read = batch.select(*columns, F.lit(False).alias("carried")).persist()
        if batch_id > 0:
            before = batch.sparkSession.read.parquet(f"{path}/state/batch={batch_id - 1}")
            rows = rows.unionByName(before.select(*columns, F.lit(True).alias("carried")))
        marks = J.submission_marks(rows)
        new = ~F.col("carried")
        tables = {
            "transitions": J.transition_rows(J.with_neighbours(rows).filter(new)),
            "submissions": J.submission_rows(J.with_neighbours(marks).filter(new)),
            "state": J.latest_jobs(rows).unionByName(J.latest_jobs(marks)).select(columns).distinct(),
        }
        for name, table in tables.items():
            table.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")
        read.unpersist()

    return (
        job_events.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
