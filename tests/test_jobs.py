"""The queue, and the event stream against its batch twin."""

from pyspark.sql import functions as F

from sparkloom.operators import jobs
from sparkloom.plans.queries_chunk import _events
from sparkloom.schema import JOB_STATUS, migrated, struct
from sparkloom.streaming import tracker

NOW, OLD = "2024-05-01T12:00:00Z", "2024-05-01T11:00:00Z"


def table(spark, *rows):
    names = struct(JOB_STATUS).names
    return spark.createDataFrame([tuple((dict.fromkeys(names) | r)[n] for n in names) for r in rows], JOB_STATUS)


def test_poll(spark):
    q = table(
        spark,
        {"id": 1, "job_id": "a", "status": "PENDING", "created_at": "1", "task_name": "ok", "task_params": '{"x": 2}'},
        {"id": 2, "job_id": "b", "status": "PENDING", "created_at": "2", "task_name": "bad"},
        {"id": 3, "job_id": "c", "status": "PENDING", "created_at": "0", "task_name": None},
        {"id": 4, "job_id": "d", "status": "RUNNING", "created_at": "0", "updated_at": "2024-05-01T10:00:00Z"},
        {"id": 5, "job_id": "e", "status": "PENDING", "created_at": "9", "task_name": "ok"},
    )
    r, seen = jobs.Registry(), []
    r.register("ok", lambda params, progress: (progress(150, "m"), str(params.get("x")))[1])
    r.register("bad", lambda params, progress: 1 / 0)
    got = {x.job_id: x for x in jobs.poll(q, r, seen.append, NOW, OLD).collect()}
    assert (got["a"].status, got["a"].result, got["a"].progress_percentage) == ("FINISHED", "2", 100)
    assert (got["b"].status, got["b"].error_message) == ("FAILED", "division by zero") and got["c"].status == got["e"].status == "PENDING"
    assert got["d"].status == "FAILED" and got["d"].error_message == jobs.STALE_MESSAGE
    assert [e["event"] for e in seen] == ["job_progress", "job_finished", "job_failed"] and seen[0]["percentage"] == 100
    assert r.run({"job_id": "z", "task_name": "none"}, seen.append)["status"] == "FAILED"


def test_stream_equals_batch(spark, sf, tmp_path):
    events = _events(spark, sf)
    for i in range(3):
        events.where(F.col("seq") % 3 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = {}

    def keep(df, _):
        out.update({r.job_id: tuple(r) for r in df.collect()})

    q = tracker.track(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert out == {r.job_id: tuple(r) for r in tracker.fold(events).collect()}


def test_migration(spark):
    assert migrated(spark.createDataFrame([(1,)], "id int"), "tools").first().max_chunk_limit == 5
