"""Failing listings as keyed state of a stream.

Each listing that fails has attempts, the last reason and the last time as its
state; a success removes them. So no log is read again, and a batch that runs
again starts from the state of the batch before, which counts it once. Changes
are written for each batch, over what an earlier run of it wrote; the last
change of a listing says whether it still fails.

Defined results: events without a key are left out; events of a batch count in
the order of their time, then of their place in ``order``; a reason is cut at
240 characters, and a NULL one is empty; a success of a listing that never
failed changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import ingest
from ..sources import files

EVENTS = "source_id string, url string, status string, reason string, at timestamp"
STATE = "url string, attempts int, last_reason string, last_at timestamp"
CHANGES = f"source_id string, {STATE}"
STORE = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Attempts(StatefulProcessor):
    """Counts failures of a listing until it succeeds."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("failing", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["at", "reason"], kind="stable", na_position="first")
        known = self.state.get() if self.state.exists() else None
        failing = list(known) if known is not None else None
        before = failing
        for e in events.itertuples(index=False):
            if e.status == "ok":
                failing = None
            else:
                attempts = 1 + (failing[1] if failing else 0)
                failing = [e.url, attempts, (e.reason or "")[:240], e.at.to_pydatetime() if pd.notna(e.at) else None]
        if failing:
            self.state.update(tuple(failing))
            yield pd.DataFrame([(key[0], *failing)], columns=["source_id", "url", "attempts", "last_reason", "last_at"])
        elif before:
            self.state.clear()
            yield pd.DataFrame([(key[0], before[0], 0, None, None)], columns=["source_id", "url", "attempts", "last_reason", "last_at"])

    def close(self) -> None:
        pass


def changes(events: DataFrame) -> DataFrame:
    """Changed states of a stream of events; 0 attempts where a listing no longer fails."""
    known = events.filter("source_id is not null and status is not null")
    return known.groupBy("source_id").transformWithStateInPandas(statefulProcessor=Attempts(), outputStructType=CHANGES, outputMode="Update", timeMode="None")


def track(spark: SparkSession, log: str, folder: str, files_at_a_time: int = 100) -> StreamingQuery:
    """Take in the events that a log of Parquet files has gained, and stop."""
    spark.conf.set(*STORE)
    read = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_at_a_time).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(log)

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")

    out = changes(read).writeStream.outputMode("update").foreachBatch(store)
    return out.option("checkpointLocation", f"{folder}/_checkpoint").trigger(availableNow=True).start()


def failing(spark: SparkSession, folder: str) -> DataFrame:
    """Listings that fail now: source_id, url, attempts, last_reason, last_at."""
    if not files.exists(spark, f"{folder}/changes"):
        return spark.createDataFrame([], CHANGES)
    every = spark.read.schema(f"{CHANGES}, batch int").parquet(f"{folder}/changes")
    last = ingest.last_wins(every, ["source_id"], [F.col("batch").desc()])
    return last.filter("attempts > 0").drop("batch")
