"""The state of runs from a stream of events."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from longleaf.session import shared_dir

STATE = "started long, done long, failed long, last_event long, begun long"
OUT = "user_id long, started long, done long, failed long, last_event long"


def states(events: DataFrame) -> DataFrame:
    """(user_id, started, done, failed, last_event) whenever a job has new events.

    Within a batch the order of events doesn't matter. Over batches a run begins with the largest id of a signup; what
    comes late with a lower id belongs to a run before and counts for nothing.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """A job's new events over its state: a signup begins a new run, whose counts start again. Only ids are held."""
        started, done, failed, last, begun = state.get if state.exists else (0, 0, 0, -1, 0)
        new, seen = begun - 1, {"purchase": [], "error": []}
        for f in frames:
            last = max(last, int(f["event_id"].max()))
            starts = f.loc[f["event_type"] == "signup", "event_id"]
            new = max(new, int(starts.max())) if len(starts) else new
            for kind, ids in seen.items():
                ids.append(f.loc[(f["event_type"] == kind) & (f["event_id"] >= max(begun, new)), "event_id"].to_numpy())
        if new >= begun and new >= 0:
            started, done, failed, begun = 1, 0, 0, new
        n = {kind: sum(int((x >= begun).sum()) for x in ids) for kind, ids in seen.items()}
        done, failed = done + n["purchase"], failed + n["error"]
        state.update((started, done, failed, last, begun))
        yield pd.DataFrame({"user_id": [key[0]], "started": [started], "done": [done], "failed": [failed], "last_event": [last]})

    return events.groupBy("user_id").applyInPandasWithState(fold, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _status(spark: SparkSession, path: str):
    files, at = _at(spark, path)
    return files.getFileStatus(at)


def _folder(spark: SparkSession, path: str) -> None:
    files, at = _at(spark, path)
    files.mkdirs(at)


def run_state(spark: SparkSession, d: str, name: str = "events", files_at_once: int = 1000) -> DataFrame:
    """The last state of every job after all of a log that is there now.

    Each micro-batch writes a folder of its own, which a batch that runs again overwrites, so a lost
    executor or a restart leaves no state twice. The table is one file or a folder of part files; without
    any batch there are no states.
    """
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{d}/{name}.parquet").schema
    log = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once)
    if _status(spark, f"{d}/{name}.parquet").isDirectory():
        log = log.parquet(f"{d}/{name}.parquet")
    else:  # a stream lists folders only
        log = log.option("pathGlobFilter", f"{name}.parquet").parquet(d)
    _folder(spark, f"{base}/out")
    rows = states(log.filter("user_id is not null and event_id is not null").select("user_id", "event_id", "event_type"))
    sink = lambda frame, batch: frame.write.mode("overwrite").parquet(f"{base}/out/batch={batch}")
    rows.writeStream.outputMode("update").option("checkpointLocation", f"{base}/at").foreachBatch(sink).trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(f"{OUT}, batch long").parquet(f"{base}/out")
    last = out.groupBy("user_id").agg(F.max_by(F.struct("started", "done", "failed", "last_event"), "batch").alias("s"))
    return last.select("user_id", "s.started", "s.done", "s.failed", "s.last_event")
