"""Job states from a stream of log lines."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LOGS = 400
STEPS = {"build": 4, "a": 3, "b": 4, "compare": 2}
FINAL = ("completed", "failed", "cancelled")
STATE = "status string, lines long, progress long, logs array<string>"
ROW = "job_id string, status string, lines long, progress long, logs array<string>"


def advance(status: str, lines: int, progress: int, logs: list[str], kind: str, event: str, line: str) -> tuple[str, int, int, list[str]]:
    """The state after one event (log, completed, failed, cancelled). A final state stays
    as it is; progress reaches 95 by lines and 100 when completed."""
    if status in FINAL:
        return status, lines, progress, logs
    if event in FINAL:
        return event, lines, 100 if event == "completed" else progress, logs
    lines += 1
    return "running", lines, min(95, max(progress, 5 + lines * STEPS.get(kind, 3))), [*logs, line][-LOGS:]


def cancel(spark: SparkSession, job: str, seq: int) -> DataFrame:
    """Stops what runs under the job's group (setJobGroup) and gives the event that ends the
    job; one that has ended stays as it is."""
    spark.sparkContext.cancelJobGroup(job)
    return spark.createDataFrame([(job, "", seq, "cancelled", "")], "job_id string, kind string, seq long, event string, line string")


def job_states(events: DataFrame) -> DataFrame:
    """States of jobs from a stream (job_id, kind, seq, event, line), an updated row a job
    and batch; within a batch events go by seq. State is one row of at most LOGS lines
    for each job."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else ("running", 0, 0, [])
        now = (now[0], now[1], now[2], list(now[3]))
        rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
        for kind, event, line in zip(rows["kind"], rows["event"], rows["line"]):
            now = advance(*now, kind, event, line)
        state.update(now)
        yield pd.DataFrame([(key[0], *now)], columns=["job_id", "status", "lines", "progress", "logs"])

    return events.groupBy("job_id").applyInPandasWithState(update, ROW, STATE, "update", "NoTimeout")


def latest_states(events: DataFrame) -> DataFrame:
    """The same of a finished log, as a batch: up to the first final event of each job. seq
    is anything that has an order, a struct too. The first final events are found before
    anything is sorted; then only what comes up to them is, job by job, and of a job's lines
    the last LOGS are gathered."""
    final = F.col("event").isin(*FINAL)
    ends = events.where(final).groupBy(F.col("job_id").alias("__job")).agg(F.min(F.struct("seq", "event")).alias("__end"))
    both = events.join(ends.hint("shuffle_hash"), F.col("job_id").eqNullSafe(F.col("__job")), "left")
    live = both.where(F.col("__end").isNull() | (F.col("seq") <= F.col("__end.seq"))).withColumn("__log", F.coalesce(~final, F.lit(True)))
    back = Window.partitionBy("job_id").orderBy(F.desc("__log"), F.desc("seq"))
    line = F.when(F.col("__log") & (F.col("__n") <= LOGS), F.struct((-F.col("__n")).alias("n"), "line"))
    logs = F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"])
    step = F.coalesce(F.create_map(*[F.lit(x) for kv in STEPS.items() for x in kv])[F.first("kind")], F.lit(3))
    n, end = F.count_if("__log"), F.coalesce(F.first("__end.event"), F.lit("running"))
    numbered = live.withColumn("__n", F.row_number().over(back))
    return numbered.groupBy("job_id").agg(end.alias("status"), n.alias("lines"), F.when(end == "completed", 100).when(n == 0, 0).otherwise(F.least(F.lit(95), 5 + n * step)).alias("progress"), logs.alias("logs"))


def dedupe_status(feed: DataFrame, delay: str = "30 minutes") -> DataFrame:
    """A status feed (id, at, status) with each finished id once, within a watermark."""
    return feed.where(F.col("status").isin("done", "success", "failed", "error")).withWatermark("at", delay).dropDuplicatesWithinWatermark(["id"])
