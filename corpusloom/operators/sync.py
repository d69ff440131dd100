"""Change processing on tables: delta pulls, reconciliation, deletion scans, queue claims, policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Delays in milliseconds after so many failed attempts, the last for all further ones.
BACKOFF = [500, 1000, 2000, 5000, 15000, 30000, 60000]


def delta(changes: DataFrame, last_seen: str | None, inclusive: bool = False) -> DataFrame:
    """STR-01: documents updated after the watermark, both compared as strings. A later document with the watermark's own
    time is missed, unless inclusive."""
    if last_seen is None:
        return changes
    at = F.col("updated_at")
    return changes.where(at >= last_seen if inclusive else at > last_seen)


def watermark(changes: DataFrame) -> DataFrame:
    return changes.agg(F.max("updated_at").alias("last_seen"))


def reconciled(changes: DataFrame, local: DataFrame) -> DataFrame:
    """STR-02: changes (id, filepath, status, updated_ms, type, has_url) against local files (ino, filepath, remote_id,
    mirrored_ms, dirty_since): each change's path and outcome."""
    odd = F.col("filepath").isNull() | ~F.contains("filepath", F.lit("/")) | F.endswith("filepath", F.lit("/"))
    own = changes.withColumn("filepath", F.when(odd, F.concat(F.lit("/"), F.col("id").cast("string"), F.lit(".md"))).otherwise(F.col("filepath")))
    by_id = local.where("remote_id IS NOT NULL").select(F.col("remote_id").alias("id"), F.col("mirrored_ms").alias("m"), F.col("dirty_since").alias("d"), F.lit(True).alias("known"))
    by_path = local.select("filepath", F.col("dirty_since").alias("pd"), F.lit(True).alias("there"))
    joined = own.join(by_id, "id", "left").join(by_path, "filepath", "left")
    binary = F.coalesce(F.col("type").isin("image", "pdf", "video", "audio", "webpage"), F.lit(False))
    done = F.col("status") == "done"
    newer = F.coalesce(F.col("d") > F.col("updated_ms"), F.lit(False))
    newer_there = F.coalesce(F.col("pd") > F.col("updated_ms"), F.lit(False))
    same = F.coalesce(F.col("m") >= F.col("updated_ms"), F.lit(False)) & done
    outcome = (
        F.when(F.col("known") & newer, "SkippedDirty")
        .when(F.col("known") & same, "Unchanged")
        .when(F.col("known"), "Updated")
        .when(~done, "DeferredProcessing")
        .when(F.col("there") & newer_there, "SkippedDirty")
        .when(F.col("there"), "Attached")
        .when(binary, F.when(F.col("has_url"), "NeedsRehydrate").otherwise("DeferredProcessing"))
        .otherwise("Created")
    )
    return joined.select("id", "filepath", outcome.alias("outcome"))


def deleted(local: DataFrame, remote: DataFrame) -> DataFrame:
    """STR-08, JOI-05: local files whose remote id is gone."""
    return local.where("remote_id IS NOT NULL").join(remote.select(F.col("id").alias("remote_id")).distinct(), "remote_id", "left_anti")


def latest(ops: DataFrame, key: str = "filepath", seq: str = "seq") -> DataFrame:
    """STR-03 with nothing in flight: each path's newest operation; the last remote id that isn't null stays."""
    rest = [c for c in ops.columns if c not in (key, seq, "remote_id")]
    out = [F.max(seq).alias(seq), F.max_by(F.struct(*rest), seq).alias("_x")]
    if "remote_id" in ops.columns:
        out.append(F.max_by("remote_id", F.when(F.col("remote_id").isNotNull(), F.col(seq))).alias("remote_id"))
    return ops.groupBy(key).agg(*out).select(key, seq, "_x.*", *(["remote_id"] if "remote_id" in ops.columns else []))


def claimable(queue: DataFrame, now_ms: int, n: int = 1) -> DataFrame:
    """STR-04: the oldest entries that are due, not in flight and not poisoned."""
    return queue.where((F.col("updated_at") <= now_ms) & F.col("inflight_started_at").isNull() & ~F.coalesce(F.col("poisoned"), F.lit(False))).orderBy("updated_at", "filepath").limit(n)


def backoff_ms(attempt: Column) -> Column:
    """STR-06."""
    out = F.lit(BACKOFF[-1])
    for i in range(len(BACKOFF) - 2, -1, -1):
        out = F.when(attempt <= i + 1, BACKOFF[i]).otherwise(out)
    return out


def finalised(queue: DataFrame, results: DataFrame, now_ms: int, most: int = 7) -> DataFrame:
    """STR-05: queue after results (filepath, ok): a success leaves the pending slot, or nothing; a failure counts and
    waits, and is poisoned after so many."""
    own = queue.join(results, "filepath", "left")
    promoted = own.where(F.col("ok") & F.col("pending_op").isNotNull()).select("filepath", F.col("pending_op").alias("op"), F.lit(None).cast("string").alias("pending_op"), F.lit(0).alias("attempt"), F.lit(now_ms).cast("long").alias("updated_at"), F.lit(None).cast("long").alias("inflight_started_at"), F.lit(False).alias("poisoned"))
    tries = F.col("attempt") + 1
    failed = own.where(~F.col("ok")).select("filepath", "op", "pending_op", tries.alias("attempt"), (F.lit(now_ms) + backoff_ms(tries)).cast("long").alias("updated_at"), F.lit(None).cast("long").alias("inflight_started_at"), (tries >= most).alias("poisoned"))
    rest = own.where(F.col("ok").isNull()).select("filepath", "op", "pending_op", "attempt", "updated_at", "inflight_started_at", "poisoned")
    return promoted.unionByName(failed).unionByName(rest)


def debounced(writes: DataFrame, quiet_ms: int = 500) -> DataFrame:
    """STR-07: of writes (filepath, at_ms) those that a pause follows."""
    after = F.lead("at_ms").over(Window.partitionBy("filepath").orderBy("at_ms"))
    return writes.withColumn("_n", after).where(F.col("_n").isNull() | (F.col("_n") - F.col("at_ms") > quiet_ms)).drop("_n")


def poll_tier(age_s: Column) -> Column:
    """STR-09: how an entry in flight is polled by its age."""
    return F.when(age_s < 60, "fast").when(age_s < 300, "medium").when(age_s < 3600, "slow").otherwise("stop")


def poll_interval(base_s: Column, active: Column, empty: Column) -> Column:
    """STR-10 without its jitter."""
    return F.when(active, F.greatest(base_s / 3, F.lit(10.0))).when(empty >= 3, F.least(base_s * 2, F.lit(60.0))).otherwise(base_s.cast("double"))


def retargeted(queue: DataFrame, moves: DataFrame) -> DataFrame:
    """DML-05: entries of a moved path follow it; the destination's own go."""
    own = queue.join(moves.select(F.col("new").alias("filepath")), "filepath", "left_anti").join(moves.withColumnRenamed("old", "filepath"), "filepath", "left")
    return own.select(F.coalesce("new", "filepath").alias("filepath"), *[c for c in queue.columns if c != "filepath"])
