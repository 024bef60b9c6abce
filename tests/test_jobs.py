import random
from datetime import datetime, timedelta

import pytest

from docstruct.operators import jobs as J
from docstruct.streaming import jobs as SJ
from pyspark.sql import functions as F

SCHEMA = "job_id bigint, event_id bigint, ts timestamp, status string, error_message string"


def job_rows(seed, n):
    """One job owns a third of all events; several events share a time stamp."""
    rnd, rows = random.Random(seed), []
    start = datetime(2024, 1, 1)
    for i in range(n):
        job = 0 if rnd.random() < 0.33 else rnd.randint(1, 40)
        ts = start + timedelta(hours=rnd.randint(0, 400))
        status = rnd.choice(["pending", "parsing", "analyzing", "completed", "failed"])
        rows.append((job, i, ts, status, "boom" if status == "failed" else None))
    return rows


@pytest.fixture(scope="module")
def events(spark):
    rows = job_rows(5, 3000)
    return rows, spark.createDataFrame(rows, SCHEMA)


def by_job(rows):
    jobs = {}
    for r in sorted(rows, key=lambda r: (r[2], r[1])):
        jobs.setdefault(r[0], []).append(r)
    return jobs


def test_latest(events):
    rows, df = events
    expected = {j: rs[-1][1] for j, rs in by_job(rows).items()}
    assert {r.job_id: r.event_id for r in J.latest_jobs(df).collect()} == expected


def test_transitions_and_submissions(events):
    rows, df = events
    previous, accepted = {}, {}
    for rs in by_job(rows).values():
        last, open_ = None, False
        for r in rs:
            previous[r[1]] = last
            if r[3] == "pending":
                accepted[r[1]] = not open_
                open_ = True
            elif r[3] in ("completed", "failed"):
                open_ = False
            last = r[3]
    got = J.job_transitions(df).collect()
    assert {r.event_id: r.from_status for r in got} == previous
    first = [r for r in got if r.from_status is None]
    assert all(r.allowed == (r.to_status == "pending") for r in first)
    assert {r.event_id: r.accepted for r in J.accepted_submissions(df).collect()} == accepted


def test_stage_durations(events):
    rows, df = events
    total = {}
    for rs in by_job(rows).values():
        for a, b in zip(rs, rs[1:]):
            total[a[3]] = total.get(a[3], 0) + int((b[2] - a[2]).total_seconds()) * 1_000_000
    assert {r.status: r.total_micros for r in J.stage_durations(df).collect()} == total


def test_log_tail(spark):
    rows = [(1, i, datetime(2024, 1, 1) + timedelta(seconds=i), f"line {i} " if i % 2 else "  ") for i in range(100)]
    logs = spark.createDataFrame(rows, "job_id bigint, event_id bigint, ts timestamp, line string")
    tail = J.log_tail(logs).orderBy("line_no").collect()
    assert [r.line for r in tail] == [f"line {i}" for i in range(41, 100, 2)]
    assert J.stamp_logs(logs).orderBy("event_id").first().line == "2024-01-01T00:00:00+00:00   "


def test_progress_and_steps(spark):
    jobs = spark.createDataFrame(
        [(1, "parsing", None, "a.log"), (2, "failed", "boom", None), (3, "weird", None, None), (4, "failed", "x", "b.log")],
        "job_id bigint, status string, error_message string, log_path string",
    )
    progress = {r.job_id: r for r in J.job_progress(jobs).collect()}
    assert (progress[1].progress_percent, progress[2].progress_percent, progress[3].progress_percent) == (35, 100, 0)
    assert progress[2].summary_message == "boom" and progress[1].current_stage == "文档解析"
    steps = {}
    for r in J.job_steps(jobs).orderBy("job_id", "step_no").collect():
        steps.setdefault(r.job_id, []).append(r.state)
    assert steps[1] == ["completed", "active", "pending", "pending"]
    assert steps[2] == ["completed", "pending", "failed", "failed"]
    assert steps[3] == ["pending"] * 4
    assert steps[4] == ["completed", "completed", "failed", "failed"]


def test_store(spark, tmp_path, events):
    rows, df = events
    path = f"{tmp_path}/jobs"
    J.append_jobs(df.filter("event_id < 1500"), path)
    J.append_jobs(df.filter("event_id >= 1500"), path)
    stored = J.read_jobs(spark, path)
    assert sorted(stored.select("job_id", "event_id").collect()) == sorted(
        J.latest_jobs(df).select("job_id", "event_id").collect()
    )
    assert J.get_job(stored, 0).count() == 1
    with pytest.raises(KeyError):
        J.get_job(stored, -1)


def test_artifacts_only_of_completed_jobs(spark):
    jobs = spark.createDataFrame([(1, "completed"), (2, "failed")], "job_id bigint, status string")
    one = spark.createDataFrame([(1, "# r"), (2, "# s")], "job_id bigint, x string")
    got = J.read_artifacts(
        jobs, one.withColumnRenamed("x", "markdown_report"), one.filter("job_id = 2").withColumnRenamed("x", "parsed_markdown"),
        one.withColumnRenamed("x", "json_report"),
    ).collect()
    assert [(r.job_id, r.markdown_report, r.parsed_markdown) for r in got] == [(1, "# r", None)]


def write_batches(df, path):
    """Files in event order, one per micro-batch."""
    for low, high in ((0, 4), (4, 9), (9, 17)):
        days = F.datediff("ts", F.lit("2024-01-01"))
        df.filter((days >= low) & (days < high)).coalesce(1).write.mode("append").parquet(path)


def test_stream_equals_batch(spark, tmp_path, events):
    _, df = events
    path = f"{tmp_path}/events"
    write_batches(df, path)
    stream = SJ.read_job_events(spark, path, df.schema, files_per_batch=1)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", SJ.ROCKSDB)
    query = SJ.write_stream(SJ.track_jobs(stream), f"{tmp_path}/out", f"{tmp_path}/check")
    query.awaitTermination(180)
    assert query.exception() is None
    out = spark.read.parquet(f"{tmp_path}/out")
    batch = J.job_transitions(df)
    columns = ["event_id", "from_status", "to_status", "allowed"]
    assert sorted(map(repr, out.select(columns).collect())) == sorted(map(repr, batch.select(columns).collect()))
    accepted = out.filter("accepted is not null").select("event_id", "accepted")
    assert sorted(accepted.collect()) == sorted(J.accepted_submissions(df).select("event_id", "accepted").collect())


def test_batched_stream_equals_batch(spark, tmp_path, events):
    _, df = events
    path = f"{tmp_path}/events"
    write_batches(df, path)
    stream = SJ.read_job_events(spark, path, df.schema, files_per_batch=1)
    SJ.track_job_batches(stream, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(300)
    for name, batch in (("transitions", J.job_transitions(df)), ("submissions", J.accepted_submissions(df))):
        out = spark.read.parquet(f"{tmp_path}/out/{name}").select(batch.columns)
        assert sorted(map(repr, out.collect())) == sorted(map(repr, batch.collect()))


def test_job_store_stream(spark, tmp_path, events):
    _, df = events
    path = f"{tmp_path}/events"
    write_batches(df, path)
    stream = SJ.read_job_events(spark, path, df.schema, files_per_batch=1)
    SJ.upsert_jobs_stream(stream, f"{tmp_path}/store", f"{tmp_path}/check").awaitTermination(180)
    stored = J.latest_jobs(spark.read.parquet(f"{tmp_path}/store").drop("batch"))
    assert sorted(stored.select("job_id", "event_id").collect()) == sorted(
        J.latest_jobs(df).select("job_id", "event_id").collect()
    )


def test_window_counts_stream(spark, tmp_path, events):
    _, df = events
    path = f"{tmp_path}/events"
    write_batches(df, path)
    stream = SJ.read_job_events(spark, path, df.schema, files_per_batch=1)
    SJ.write_stream(SJ.status_counts_stream(stream), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(180)
    out = {(r.window_start, r.status): r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    batch = {(r.window_start, r.status): r.n for r in J.status_counts(df).collect()}
    assert out and all(batch[k] == n for k, n in out.items())
