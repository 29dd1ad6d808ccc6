"""Failures as state: attempts, removal on success, and a batch that runs again."""

import random
import shutil
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tessera.operators import ingest
from tessera.streaming import failures

START = datetime(2024, 1, 1)


def event(sid, n, status="failed", reason="r"):
    return sid, f"https://h/{sid}", status, reason, START + timedelta(seconds=n)


def write(spark, rows, path):
    spark.createDataFrame(rows, failures.EVENTS).coalesce(1).write.mode("append").parquet(path)


def told(spark, folder):
    return {r.source_id: (r.attempts, r.last_reason, r.last_at) for r in failures.failing(spark, folder).collect()}


def test_attempts_reasons_and_success(spark, tmp_path):
    log, out = f"{tmp_path}/log", f"{tmp_path}/state"
    assert told(spark, out) == {}
    write(spark, [event("a", 1), event("a", 2, reason="x" * 300), event("b", 3), event("c", 4, "ok"), (None, "u", "failed", "r", START), event("d", 5, reason=None)], log)
    failures.track(spark, log, out).awaitTermination()
    got = told(spark, out)
    assert got["a"] == (2, "x" * 240, START + timedelta(seconds=2)) and got["b"][0] == 1 and got["d"][1] == "" and set(got) == {"a", "b", "d"}
    write(spark, [event("a", 6, "ok"), event("b", 7, "low_quality"), event("d", 8, "ok"), event("d", 9)], log)
    failures.track(spark, log, out).awaitTermination()
    got = told(spark, out)
    assert {k: v[0] for k, v in got.items()} == {"b": 2, "d": 1}


def test_a_batch_that_runs_again_counts_once(spark, tmp_path):
    log, out = f"{tmp_path}/log", f"{tmp_path}/state"
    for n in range(3):
        write(spark, [event("a", n), event("b", n)], log)
        failures.track(spark, log, out).awaitTermination()
    newest = max((tmp_path / "state" / "_checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    before = told(spark, out)
    newest.unlink()  # as after a crash before the batch was marked as done
    (newest.parent / f".{newest.name}.crc").unlink(missing_ok=True)
    shutil.rmtree(f"{out}/changes/batch={newest.name}")
    failures.track(spark, log, out).awaitTermination()
    assert told(spark, out) == before == {k: (3, "r", START + timedelta(seconds=2)) for k in "ab"}


def test_state_equals_the_aggregate_over_the_whole_log(spark, tmp_path):
    rnd, log, out = random.Random(1), f"{tmp_path}/log", f"{tmp_path}/state"
    for n in range(3):
        write(spark, [event(str(rnd.randint(0, 9)), 100 * n + i, rnd.choice(["failed", "failed", "ok"]), f"r{i}") for i in range(30)], log)
    failures.track(spark, log, out, files_at_a_time=1).awaitTermination()
    every = [tuple(r) for r in spark.read.parquet(log).orderBy("at").collect()]
    want = {}
    for sid, _, status, reason, at in every:
        want[sid] = None if status == "ok" else ((want.get(sid) or (0,))[0] + 1, reason, at)
    assert told(spark, out) == {k: v for k, v in want.items() if v}
    of_log = ingest.failures(spark.read.parquet(log), "source_id", F.col("status") != "ok", F.col("status") == "ok", "at", "reason")
    assert {r.source_id for r in of_log.collect()} == set(told(spark, out))
