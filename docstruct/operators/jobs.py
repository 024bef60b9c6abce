"""Job state, progress and logs as tables.

``job_events``: (job_id, event_id, ts, status, error_message, ...), ordered by (ts, event_id) in a job.
A single job may own a large share of all events, so nothing sorts a whole job in one task: latest
state is an aggregate with partial results, log tails are rank filters, and neighbouring events are
found per time bucket with one carried row per bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docstruct import constants as K
from docstruct import labels
from docstruct.functions import text as T

ORDER = ["ts", "event_id"]


def event_jobs(events: DataFrame) -> DataFrame:
    """The ``events`` table read as job events."""
    kind = F.col("event_type")
    return events.select(
        F.col("user_id").alias("job_id"),
        "event_id",
        "ts",
        F.when(kind == "signup", "pending")
        .when(kind == "view", "parsing")
        .when(kind == "click", "analyzing")
        .when(kind == "purchase", "completed")
        .when(kind == "error", "failed")
        .alias("status"),
        F.when(kind == "error", F.concat(F.lit("error "), F.col("props"))).alias("error_message"),
        "props",
    )


def event_logs(events: DataFrame) -> DataFrame:
    return event_jobs(events).select(
        "job_id", "event_id", "ts", F.concat("status", F.lit(" "), F.col("props")).alias("line")
    )


def latest_jobs(job_events: DataFrame) -> DataFrame:
    """Last row per job: an aggregate, so each task sends one row per job."""
    fields = [c for c in job_events.columns if c != "job_id"]
    return job_events.groupBy("job_id").agg(
        F.max_by(F.struct(*fields), F.struct(*ORDER)).alias("last")
    ).select("job_id", *[F.col(f"last.{c}").alias(c) for c in fields])


def with_neighbours(job_events: DataFrame, bucket: str = "hour") -> DataFrame:
    """Adds the previous event's status and the next event's time within the job.

    Rows are ordered inside (job, time bucket); only the first and last event of each bucket cross the
    bucket border, through a table of one row per job and bucket.
    """
    keyed = job_events.withColumn("bucket", F.date_trunc(bucket, "ts"))
    in_bucket = Window.partitionBy("job_id", "bucket").orderBy(*ORDER)
    by_bucket = Window.partitionBy("job_id").orderBy("bucket")
    borders = (
        keyed.groupBy("job_id", "bucket")
        .agg(F.max_by("status", F.struct(*ORDER)).alias("last_status"), F.min("ts").alias("first_ts"))
        .select(
            "job_id",
            "bucket",
            F.lag("last_status").over(by_bucket).alias("status_before"),
            F.lead("first_ts").over(by_bucket).alias("ts_after"),
        )
    )
    return (
        keyed.withColumns({"prev": F.lag("status").over(in_bucket), "next": F.lead("ts").over(in_bucket)})
        .join(borders, ["job_id", "bucket"])
        .withColumns(
            {
                "previous_status": F.coalesce("prev", "status_before"),
                "next_ts": F.coalesce("next", "ts_after"),
            }
        )
        .drop("bucket", "prev", "next", "status_before", "ts_after")
    )


def is_allowed(previous: Column, status: Column) -> Column:
    known = F.array(*[F.lit(f"{a}>{b}") for a, b in K.JOB_TRANSITIONS])
    step = F.concat(previous, F.lit(">"), status)
    return F.when(previous.isNull(), status == "pending").otherwise(F.array_contains(known, step))


def transition_rows(neighbours: DataFrame) -> DataFrame:
    return neighbours.select(
        "job_id",
        "event_id",
        "ts",
        F.col("previous_status").alias("from_status"),
        F.col("status").alias("to_status"),
        F.coalesce("error_message", F.lit("")).alias("error_message"),
        is_allowed(F.col("previous_status"), F.col("status")).alias("allowed"),
    )


def job_transitions(job_events: DataFrame) -> DataFrame:
    """Every event with the status it came from and whether the state machine allows the step."""
    return transition_rows(with_neighbours(job_events))


def submission_marks(job_events: DataFrame) -> DataFrame:
    return job_events.filter(F.col("status").isin("pending", *K.TERMINAL_STATUSES))


def submission_rows(neighbours: DataFrame) -> DataFrame:
    return neighbours.filter(F.col("status") == "pending").select(
        "job_id",
        "event_id",
        "ts",
        (F.coalesce("previous_status", F.lit("completed")) != "pending").alias("accepted"),
    )


def accepted_submissions(job_events: DataFrame) -> DataFrame:
    """Submissions with a flag: False while the same job is still in flight.

    Of submissions and terminal events only, a submission counts when the event before it is terminal
    or absent.
    """
    return submission_rows(with_neighbours(submission_marks(job_events)))


def clean_log_lines(logs: DataFrame) -> DataFrame:
    lines = logs.withColumn("line", F.rtrim(F.col("line"), F.lit(T.WHITE_SPACE)))
    return lines.filter(F.col("line") != "")


def log_tail(logs: DataFrame, n: int = K.LOG_TAIL_LINES) -> DataFrame:
    """Last ``n`` non-blank lines per job, numbered from the oldest (1)."""
    newest = Window.partitionBy("job_id").orderBy(*[F.col(c).desc() for c in ORDER])
    kept = clean_log_lines(logs).withColumn("back", F.row_number().over(newest)).filter(F.col("back") <= n)
    in_order = Window.partitionBy("job_id").orderBy(F.col("back").desc())
    return kept.select("job_id", F.row_number().over(in_order).alias("line_no"), "line")


def stamp_logs(logs: DataFrame) -> DataFrame:
    """Puts the ISO time stamp before each line; stamps without a zone are taken as UTC."""
    zoned = logs.schema["ts"].dataType.typeName() == "timestamp"
    offset = F.date_format("ts", "xxx") if zoned else F.lit("+00:00")
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), offset)
    return logs.withColumn("line", F.concat(stamp, F.lit(" "), F.col("line")))


def _status_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def job_progress(jobs: DataFrame, logs: DataFrame | None = None, locale: str = labels.DEFAULT_LOCALE) -> DataFrame:
    """Stage, percent and message: last log line, else the error, else the text of the stage."""
    stages = labels.STAGE_LABELS[locale]
    if logs is not None:
        last = clean_log_lines(logs).groupBy("job_id").agg(F.max_by("line", F.struct(*ORDER)).alias("last_line"))
        jobs = jobs.join(last, "job_id", "left")
    else:
        jobs = jobs.withColumn("last_line", F.lit(None).cast("string"))
    status = F.col("status")
    stage = F.element_at(_status_map({s: v[0] for s, v in stages.items()}), status)
    note = F.element_at(_status_map({s: v[1] for s, v in stages.items()}), status)
    percent = F.element_at(_status_map({s: v[0] for s, v in K.JOB_STAGES.items()}), status)
    return jobs.select(
        "job_id",
        "status",
        F.coalesce(stage, F.lit(stages["unknown"][0])).alias("current_stage"),
        F.coalesce(percent, F.lit(0)).alias("progress_percent"),
        F.coalesce(
            "last_line", F.nullif("error_message", F.lit("")), note, F.lit(stages["unknown"][1])
        ).alias("summary_message"),
    )


def job_steps(jobs: DataFrame, locale: str = labels.DEFAULT_LOCALE) -> DataFrame:
    """Four steps per job. A failed job shows parsing as done only if it has a log."""
    names = labels.STEP_LABELS[locale]
    logged = F.coalesce(F.col("log_path"), F.lit("")) != ""
    rows = []
    for i, key in enumerate(K.JOB_STEPS):
        state = F.element_at(_status_map({s: v[1][i] for s, v in K.JOB_STAGES.items()}), F.col("status"))
        if key == "parse":
            state = F.when((F.col("status") == "failed") & ~logged, "pending").otherwise(state)
        rows.append(
            F.struct(
                F.lit(i + 1).alias("step_no"),
                F.lit(key).alias("step"),
                F.lit(names[key]).alias("label"),
                F.coalesce(state, F.lit("pending")).alias("state"),
            )
        )
    return jobs.select("job_id", "status", F.inline(F.array(*rows)))


def completed_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.filter(F.col("status") == "completed")


def unfinished_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.filter(~F.col("status").eqNullSafe("completed")).withColumn("reason", F.lit("not_completed"))


def read_artifacts(
    jobs: DataFrame, reports: DataFrame, parsed: DataFrame, json_reports: DataFrame
) -> DataFrame:
    """Finished jobs with their report, parsed text and JSON; each side has one row per job."""
    return (
        completed_jobs(jobs)
        .join(reports.select("job_id", "markdown_report"), "job_id", "left")
        .join(parsed.select("job_id", "parsed_markdown"), "job_id", "left")
        .join(json_reports.select("job_id", "json_report"), "job_id", "left")
    )


def micros(interval: Column) -> Column:
    """Microseconds of a day-time interval; independent of the session time zone."""
    days, hours, minutes, seconds = (F.extract(F.lit(u), interval) for u in ("DAY", "HOUR", "MINUTE", "SECOND"))
    whole = (days.cast("bigint") * 24 + hours) * 60 + minutes
    return whole * 60_000_000 + (seconds * 1_000_000).cast("bigint")


def stage_durations(job_events: DataFrame) -> DataFrame:
    """Per status: how often it was left for a next event and the microseconds spent in it."""
    spent = micros(F.col("next_ts") - F.col("ts"))
    return (
        with_neighbours(job_events)
        .filter(F.col("next_ts").isNotNull())
        .groupBy("status")
        .agg(
            F.count(F.lit(1)).alias("stays"),
            F.sum(spent).alias("total_micros"),
            F.max(spent).alias("longest_micros"),
        )
    )


def status_counts(job_events: DataFrame, width: str = "1 day") -> DataFrame:
    """Events per status and time window; the same plan serves a stream (see ``streaming``)."""
    return (
        job_events.groupBy(F.window("ts", width).alias("w"), "status")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), "status", "n")
    )


def append_jobs(batch: DataFrame, path: str) -> None:
    """Stores job rows; ``read_jobs`` makes the last write of a job win."""
    batch.write.mode("append").parquet(path)


def read_jobs(spark, path: str) -> DataFrame:
    return latest_jobs(spark.read.parquet(path))


def get_job(jobs: DataFrame, job_id) -> DataFrame:
    """The row of one job; raises KeyError when there is none."""
    found = jobs.filter(F.col("job_id") == F.lit(job_id))
    if not found.take(1):
        raise KeyError(f"unknown job: {job_id}")
    return found
