"""Job events folded into each job's state (Q9, Q10): a batch form, and the same as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FIELDS = ("percentage", "message", "file_name", "status", "result", "error")
ENDS = ("job_finished", "job_failed")
STATE = "job_id string, percentage int, message string, file_name string, status string, result string, error string, completed boolean, events bigint"


def fold(events: DataFrame) -> DataFrame:
    """Of (seq, job_id, event, ...): the last known value of every field, whether the job ended, and how many events there were.

    The last non-null value by seq is an aggregate that combines before the shuffle; no job's events are gathered.
    """
    last = [F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in FIELDS]
    done = F.max(F.col("event").isin(*ENDS))
    return events.groupBy("job_id").agg(*last, done.alias("completed"), F.count(F.lit(1)).alias("events"))


def changes(events: DataFrame) -> DataFrame:
    """Events that change something: one that equals its job's event before is left out."""
    w = W.partitionBy("job_id").orderBy("seq")
    same = F.lit(True)
    for c in ("event", *FIELDS):
        same = same & F.col(c).eqNullSafe(F.lag(c).over(w))
    return events.withColumn("_same", same & (F.row_number().over(w) > 1)).where("NOT _same").drop("_same")


def _step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    kept = list(state.get) if state.exists else [None] * len(FIELDS) + [False, 0] + [-1] * len(FIELDS)
    for batch in batches:
        for row in batch.sort_values("seq").to_dict("records"):
            for i, c in enumerate(FIELDS):
                at = len(FIELDS) + 2 + i
                if not pd.isna(row[c]) and row["seq"] > kept[at]:
                    kept[i], kept[at] = row[c], row["seq"]
            kept[len(FIELDS)] = bool(kept[len(FIELDS)] or row["event"] in ENDS)
            kept[len(FIELDS) + 1] += 1
    kept[0] = None if kept[0] is None else int(kept[0])
    state.update(tuple(kept))
    out = dict(zip(("job_id", *FIELDS, "completed", "events"), [key[0], *kept[: len(FIELDS) + 2]], strict=True))
    frame = pd.DataFrame([out])
    frame["percentage"] = frame["percentage"].astype("Int32")
    yield frame


def track(events: DataFrame) -> DataFrame:
    """The stream's form: after each batch the new state of every job that it touches (output mode `update`)."""
    kinds = "percentage int, message string, file_name string, status string, result string, error string, completed boolean, events bigint, " + ", ".join(f"s{i} bigint" for i in range(len(FIELDS)))
    return events.groupBy("job_id").applyInPandasWithState(_step, STATE, kinds, "update", "NoTimeout")


def stale(events: DataFrame, minutes: int = 15) -> DataFrame:
    """Q4 on a stream (ts, job_id, event): jobs that are silent for so long, as event-time sessions that close."""
    session = events.withWatermark("ts", f"{minutes} minutes").groupBy(F.session_window("ts", f"{minutes} minutes").alias("w"), "job_id")
    return session.agg(F.max(F.col("event").isin(*ENDS)).alias("ended")).where("NOT ended").select("job_id", F.col("w.end").alias("silent_since"))
