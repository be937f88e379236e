"""Structured Streaming over the event log and watched folders."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltstone.operators.maintenance import missing_rows, stale_rows
from siltstone.session import cut


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event-time window and type, with a watermark where ``events`` streams."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    grouped = rows.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return grouped.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Event counts of each user's sessions."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    return rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("session_start"), "n")


def watch(spark: SparkSession, root: str, checkpoint: str, apply: Callable[[DataFrame, int], None], max_files: int = 1024) -> StreamingQuery:
    """Additions and changes below a folder as micro-batches of ``path, content, modificationTime, length``; resumable
    by its checkpoint, bounded by ``max_files`` a trigger. Removals come from ``removed`` between snapshots."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", "true").load(root)
    return files.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def snapshot_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """``path, change`` between snapshots ``(path, hash)``: added, changed or removed."""
    added = missing_rows(new, old, ["path"]).select("path", F.lit("added").alias("change"))
    removed = stale_rows(old, new, ["path"]).select("path", F.lit("removed").alias("change"))
    differ = new.join(old.withColumnRenamed("hash", "was"), "path").filter("hash <> was").select("path", F.lit("changed").alias("change"))
    return added.unionByName(differ).unionByName(removed)


def watermark(position: int, config: str, counts: dict[str, int], fingerprint: str) -> str:
    """Identity of a projection's state; equal ones need no reconciliation."""
    return hashlib.sha256(json.dumps([position, config, sorted(counts.items()), fingerprint]).encode()).hexdigest()


@dataclass(frozen=True)
class EventLog:
    """Events as an append-only table, in the order of their ids."""

    spark: SparkSession
    path: str

    def append(self, events: DataFrame) -> None:
        """Add ``events (id, ...)``; ids must be new and lie after all that are there."""
        last, low = self.last_id(), events.agg(F.min("id").alias("low"), F.count("*").alias("n"), F.count_distinct("id").alias("d")).first()
        if low.n and (low.low <= last or low.n != low.d):
            raise ValueError(f"ids must be distinct and come after {last}")
        events.write.mode("append").parquet(self.path)

    def _table(self) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.parquet(self.path) if there else None

    def last_id(self) -> int:
        found = self._table()
        return 0 if found is None else found.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]

    def scan(self, artifact: int | None = None) -> DataFrame:
        """Events by id, of one artifact if it is given."""
        rows = self._table()
        if rows is None:
            raise ValueError("nothing was appended")
        return (rows if artifact is None else rows.filter(F.col("artifact_id") == artifact)).orderBy("id")


@dataclass(frozen=True)
class Folder:
    """A watched folder whose last seen state is a table, so that it can be resumed.

    A poll gives the first ``most`` changes by path; those that it leaves stay pending, as
    the state only takes over what was handled.
    """

    spark: SparkSession
    root: str
    state: str
    most: int = 1024

    def _versions(self) -> list[int]:
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(self.state)
        fs = fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(fs_path)] if fs.exists(fs_path) else []
        done = (n for n in names if n.isdigit() and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.state}/{n}/_SUCCESS")))
        return sorted(int(n) for n in done)

    def seen(self) -> DataFrame:
        versions = self._versions()
        return self.spark.read.parquet(f"{self.state}/{versions[-1]}") if versions else self.spark.createDataFrame([], "path string, hash string")

    def poll(self) -> DataFrame:
        """``path, change, hash``: added, changed and removed files, at most ``most``."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(self.root)
        now = cut(files.select("path", F.sha2("content", 256).alias("hash")))
        delta = snapshot_delta(self.seen(), now).join(now, "path", "left")
        return cut(delta.select("path", "change", "hash").orderBy("path").limit(self.most))

    def commit(self, handled: DataFrame) -> None:
        """Take over what was handled, as a new version of the state."""
        old = self.seen().join(handled.select("path"), "path", "left_anti")
        new = old.unionByName(handled.filter("change <> 'removed'").select("path", "hash"))
        new.write.parquet(f"{self.state}/{(self._versions() or [0])[-1] + 1}")
