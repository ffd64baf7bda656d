"""The job queue: rows of job_status and file_metadata and the steps between their states."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.schema import FILE_METADATA, JOB_STATUS, names_of

IN_FLIGHT, POLL_SECONDS, STALE_MINUTES = 2, 2, 15
STALE_MESSAGE = "Job timed out"
ACTIVE = ("PENDING", "RUNNING")


def clamp_progress(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(0)), F.lit(100))


def linear_progress(done: Column, total: Column, low: int, high: int) -> Column:
    """A stage's part of the whole, in whole steps."""
    part = F.when(total > 0, F.floor(done * (high - low) / total)).otherwise(0)
    return F.least(F.greatest(part + low, F.lit(low)), F.lit(high)).cast("int")


def claimable(jobs: DataFrame, limit: int) -> DataFrame:
    """H7: ids of the oldest pending jobs that have a task."""
    return jobs.where("status = 'PENDING' AND task_name IS NOT NULL").orderBy("created_at", "id").limit(limit).select("id")


def claimed(jobs: DataFrame, limit: int, now: str) -> DataFrame:
    """All jobs, the claimed ones running; one writer at a time calls this."""
    mine = F.broadcast(claimable(jobs, limit).withColumn("_claimed", F.lit(True)))  # `limit` rows
    got = F.coalesce("_claimed", F.lit(False))
    new = {"status": F.lit("RUNNING"), "progress_percentage": F.lit(0), "updated_at": F.lit(now)}
    return jobs.join(mine, "id", "left").withColumns({k: F.when(got, v).otherwise(F.col(k)) for k, v in new.items()}).select(*jobs.columns)


def reclaimed(jobs: DataFrame, cutoff: str, now: str) -> DataFrame:
    """Running jobs last heard of before the cutoff have failed; times are ISO texts and compare as such."""
    stale = (F.col("status") == "RUNNING") & (F.col("updated_at") < cutoff)
    new = {"status": F.lit("FAILED"), "error_message": F.lit(STALE_MESSAGE), "updated_at": F.lit(now)}
    return jobs.withColumns({k: F.when(F.coalesce(stale, F.lit(False)), v).otherwise(F.col(k)) for k, v in new.items()})


def reset(jobs: DataFrame) -> DataFrame:
    """Q5."""
    return jobs.withColumn("status", F.when(F.col("status") == "RUNNING", "PENDING").otherwise(F.col("status")))


def progressed(jobs: DataFrame, updates: DataFrame) -> DataFrame:
    """Of (job_id, percentage, status, result, error): progress is clamped; an end overwrites result and error."""
    u = updates.select("job_id", F.col("percentage").alias("_p"), F.col("status").alias("_s"), F.col("result").alias("_r"), F.col("error").alias("_e"))
    ends = F.coalesce(F.col("_s").isin("FINISHED", "FAILED"), F.lit(False))
    return jobs.join(u, "job_id", "left").withColumns({
        "progress_percentage": F.when(F.col("_p").isNotNull(), clamp_progress(F.col("_p"))).otherwise(F.col("progress_percentage")), "status": F.coalesce("_s", "status"),
        "result": F.when(ends, F.col("_r")).otherwise(F.col("result")), "error_message": F.when(ends, F.col("_e")).otherwise(F.col("error_message")),
    }).select(*jobs.columns)


def files_after(files: DataFrame, jobs: DataFrame) -> DataFrame:
    """A file's status follows the end of its job."""
    ended = jobs.where("status IN ('FINISHED', 'FAILED')").select("storage_object_id", F.when(F.col("status") == "FINISHED", "completed").otherwise("failed").alias("_s"))
    return files.join(ended.dropDuplicates(["storage_object_id"]), "storage_object_id", "left").withColumn("status", F.coalesce("_s", "status")).select(*files.columns)


def active_jobs(jobs: DataFrame) -> DataFrame:
    """T9, H9."""
    return jobs.where(F.col("status").isin(*ACTIVE)).orderBy("created_at", "id")


def job_status(jobs: DataFrame, job_id: str) -> dict:
    """The row of a job; an id that isn't there is an error."""
    found = jobs.where(F.col("job_id") == job_id).limit(1).collect()
    if not found:
        raise ValueError(f"no such job: {job_id}")
    return found[0].asDict()


def upload_rows(paths: list[tuple[str, int]], collection: str, task: str, params: dict, now: str, repo: str | None = None, group: str | None = None, start_id: int = 1) -> tuple[list[dict], list[dict], list[str]]:
    """A pending job and a pending file row for each (path, size); a path without a name is an error of its own."""
    job_rows, file_rows, errors = [], [], []
    blank = lambda spec: dict.fromkeys(names_of(spec))
    for i, (path, size) in enumerate(paths):
        name = path.replace("\\", "/").rpartition("/")[2]
        if not name:
            errors.append(f"{path}: no file name")
            continue
        obj = str(uuid.uuid5(uuid.NAMESPACE_URL, f"{path} {now} {i}"))
        job_rows.append(blank(JOB_STATUS) | {"id": start_id + i, "job_id": obj, "status": "PENDING", "created_at": now, "updated_at": now, "progress_percentage": 0, "file_name": name, "storage_object_id": obj, "task_name": task, "task_params": json.dumps(params | {"path": path})})
        file_rows.append(blank(FILE_METADATA) | {"id": start_id + i, "storage_object_id": obj, "full_path": path, "file_type": name.rpartition(".")[2] if "." in name else None, "size_bytes": size, "repo_name": repo, "group_id": group, "status": "pending", "created_at": now, "collection": collection})
    return job_rows, file_rows, errors


def one_kind(paths: list[str]) -> list[str]:
    """Archives and other files aren't mixed; the first path decides."""
    is_zip = lambda p: p.lower().endswith(".zip")
    return [p for p in paths if is_zip(p) == is_zip(paths[0])]


def added_paths(old: list[str], new: list[str], most: int) -> list[str]:
    """New paths, each once, as far as there is room."""
    return (old + [p for p in dict.fromkeys(new) if p not in set(old)])[:most]


@dataclass
class Registry:
    """Tasks by name. A task takes its parameters and a progress callback, and returns its result's text."""

    tasks: dict[str, Callable[[dict, Callable[[int, str], None]], str]] = field(default_factory=dict)

    def register(self, name: str, task: Callable) -> None:
        self.tasks[name] = task

    def run(self, job: dict, emit: Callable[[dict], None]) -> dict:
        """Q6, Q7: the row's end; any exception of the task is that job's failure alone."""

        def progress(percentage: int, message: str = "") -> None:
            emit({"job_id": job["job_id"], "event": "job_progress", "percentage": min(100, max(0, percentage)), "message": message})

        name = job.get("task_name")
        if name not in self.tasks:
            end = {"status": "FAILED", "result": None, "error": f"unknown task: {name}" if name else "no task"}
        else:
            try:
                end = {"status": "FINISHED", "result": self.tasks[name](json.loads(job.get("task_params") or "{}"), progress), "error": None}
            except Exception as e:  # noqa: BLE001
                end = {"status": "FAILED", "result": None, "error": str(e) or type(e).__name__}
        emit({"job_id": job["job_id"], "event": "job_finished" if end["status"] == "FINISHED" else "job_failed", "percentage": 100 if end["status"] == "FINISHED" else None, **end})
        return end | {"job_id": job["job_id"], "percentage": 100 if end["status"] == "FINISHED" else None}


def poll(jobs: DataFrame, registry: Registry, emit: Callable[[dict], None], now: str, cutoff: str, limit: int = IN_FLIGHT) -> DataFrame:
    """Q2: one round of the loop: reclaim, claim, run, record. The driver holds the rows of `limit` claimed jobs."""
    fresh = reclaimed(jobs, cutoff, now)
    mine = [r.asDict() for r in fresh.join(F.broadcast(claimable(fresh, limit)), "id", "left_semi").collect()]
    ends = [registry.run(r, emit) for r in sorted(mine, key=lambda r: (r["created_at"], r["id"]))]
    running = claimed(fresh, limit, now)
    if not ends:
        return running
    return progressed(running, jobs.sparkSession.createDataFrame(ends, "job_id string, percentage int, status string, result string, error string"))


def poll_loop(load: Callable[[], DataFrame], save: Callable[[DataFrame], None], registry: Registry, emit: Callable[[dict], None], clock: Callable[[], tuple[str, str]], stop: Callable[[], bool], seconds: float = 2.0) -> int:
    """Q2: rounds of poll() until told to stop; the table is read and written by the caller's functions, clock gives (now, cutoff).
    Returns the number of rounds. A round that fails is reported, and the loop lives (Q7)."""
    import time

    rounds = 0
    while not stop():
        try:
            save(poll(load(), registry, emit, *clock()))
        except Exception as e:  # noqa: BLE001
            emit({"job_id": None, "event": "poll_failed", "error": str(e)})
        rounds += 1
        if not stop():
            time.sleep(seconds)
    return rounds
