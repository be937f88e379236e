"""Projections and event logs: reconciliation, upserts, folds, lifecycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Lifecycle of an index generation.
GENERATION_NEXT = [
    ("building", "evaluated"),
    ("evaluated", "shadow"),
    ("shadow", "active"),
    ("active", "retired"),
    ("retired", "collectable"),
    ("retired", "active"),
    ("collectable", "tombstoned"),
]


def stale_rows(projection: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Projection rows whose key is gone: to be deleted."""
    return projection.join(truth.select(*keys).distinct(), keys, "left_anti")


def missing_rows(truth: DataFrame, projection: DataFrame, keys: list[str]) -> DataFrame:
    """Truth rows that aren't projected under the same key: to be added."""
    return truth.join(projection.select(*keys).distinct(), keys, "left_anti")


def reconcile(projection: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """The projection after stale rows went and missing ones came; idempotent."""
    kept = projection.join(truth.select(*keys).distinct(), keys, "left_semi")
    return kept.unionByName(missing_rows(truth, projection, keys).select(*projection.columns))


def upsert_changed(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``new`` over ``old`` with what happened to each key; a row is updated only if a column differs."""
    values = [c for c in new.columns if c != key]
    joined = old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    same = F.lit(True)
    for c in values:
        same = same & F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    added, kept = F.col(f"o.{key}").isNull(), F.col(f"n.{key}").isNull()
    action = F.when(added, "insert").when(kept, "keep").when(same, "same").otherwise("update")
    return joined.select(F.coalesce(f"n.{key}", f"o.{key}").alias(key), *[F.when(kept, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in values], action.alias("action"))


def latest(events: DataFrame, entity: str, order: str, *values: str) -> DataFrame:
    """State fold that keeps each entity's last event: a map-side combined ``max_by``."""
    return events.groupBy(entity).agg(F.max(order).alias(order), *[F.max_by(v, order).alias(v) for v in values], F.count("*").alias("n_events"))


def tombstoned(documents: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """``documents`` with what is in ``gone`` marked (``tombstoned``), not deleted; marks stay."""
    marks = gone.select(*keys).distinct().withColumn("mark_", F.lit(True))
    was = F.col("tombstoned") if "tombstoned" in documents.columns else F.lit(False)
    return documents.join(marks, keys, "left").withColumn("tombstoned", was | F.col("mark_").isNotNull()).drop("mark_")


def live(documents: DataFrame) -> DataFrame:
    return documents.filter(~F.col("tombstoned")).drop("tombstoned")


def active_versions(events: DataFrame) -> DataFrame:
    """Per source of ``events (id, source, kind, artifact, hash)`` the last start that no later stale event of the
    same artifact and hash removed."""
    starts = events.filter("kind = 'ParserStarted'").groupBy("source").agg(F.max_by(F.struct("id", "artifact", "hash"), "id").alias("s")).select("source", "s.*")
    stale = events.filter("kind = 'SourceBecameStale'").select("source", "artifact", "hash", F.col("id").alias("stale_id"))
    gone = starts.join(stale, ["source", "artifact", "hash"]).filter("stale_id > id").select("source").distinct()
    return starts.join(gone, "source", "left_anti")


def keep_newest(df: DataFrame, n: int, order: str, *keys: str) -> DataFrame:
    """Retention: the newest n rows (of each key)."""
    if not keys:
        return df.orderBy(F.desc(order)).limit(n)
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return df.withColumn("nth_", nth).filter(F.col("nth_") <= n).drop("nth_")


def order_violations(events: DataFrame, entity: str, order: str, time: str) -> DataFrame:
    """Events whose time lies before that of the entity's previous one."""
    before = Window.partitionBy(entity).orderBy(order)
    return events.withColumn("previous_", F.lag(time).over(before)).filter(F.col(time) < F.col("previous_"))


def payload_violations(events: DataFrame, column: str, payload: Column) -> DataFrame:
    """Events whose column isn't what their payload says."""
    return events.filter(~F.col(column).eqNullSafe(payload))


def generation_step(now: Column, to: Column) -> Column:
    """Whether a generation may go from one state to another."""
    allowed = F.lit(False)
    for a, b in GENERATION_NEXT:
        allowed = allowed | ((now == a) & (to == b))
    return allowed


def review_queue(candidates: DataFrame, promoted: DataFrame, key: str) -> DataFrame:
    return candidates.join(promoted.select(key).distinct(), key, "left_anti")


def memory_gate(n_evidence: Column, secure: Column, confidence_milli: Column, approved: Column) -> Column:
    """First gate that a memory candidate fails, else Promoted."""
    return F.when(n_evidence < 1, "MissingEvidence").when(~secure, "SecurityDenied").when(confidence_milli < 500, "LowConfidence").when(~approved, "ApprovalRequired").otherwise("Promoted")
