"""Watching files: snapshots, debounced batches, and what a batch sets off.

poll() watches one folder from the driver, which is all that a listing needs;
watch() does the same for a stream of changes from many folders, and closes
sessions by a watermark, so a batch fires once later changes (or the heartbeats
of with_heartbeat) have come in.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftgraph.functions import text as T


def snapshot_diff(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, change, file_type): paths that are new, changed (size, mtime or type) or removed between two snapshots."""
    a = before.select(F.col("path").alias("_p"), F.struct("size", "mtime", "file_type").alias("a"))
    b = now.select("path", F.struct("size", "mtime", "file_type").alias("b"))
    both = b.join(a, F.col("path") == F.col("_p"), "full_outer")
    change = F.when(F.col("a").isNull(), F.lit("new")).when(F.col("b").isNull(), F.lit("removed")).when(~F.col("a").eqNullSafe(F.col("b")), F.lit("changed"))
    return both.select(F.coalesce("path", "_p").alias("path"), change.alias("change"), F.coalesce("b.file_type", "a.file_type").alias("file_type")).filter("change is not null")


def incremental(now: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, state): new if the manifest lacks the path or has an older mtime by more than a microsecond; else unchanged; deleted if only the manifest has it."""
    m = manifest.select(F.col("path").alias("_p"), F.col("mtime").alias("_m"))
    both = now.select("path", "mtime").join(m, F.col("path") == F.col("_p"), "full_outer")
    state = F.when(F.col("path").isNull(), F.lit("deleted")).when(F.col("_p").isNull() | (F.col("mtime") - F.col("_m") > 1e-6), F.lit("new")).otherwise(F.lit("unchanged"))
    return both.select(F.coalesce("path", "_p").alias("path"), state.alias("state"))


def debounced(changes: DataFrame, seconds: float = 3.0, keys: list[str] | None = None, late: str = "1 second") -> DataFrame:
    """(keys, start, end, changes, files, action): changes (path, ts, file_type) gathered until `seconds` pass without one.

    Action is `flag` if any change isn't code, else `rebuild`.  On a stream a
    watermark, `late` behind the latest change, closes the sessions; a batch is
    handled alike without one.  Without keys, changes with a column `root` are
    gathered for each root folder, which spreads them over tasks, and others
    belong to one folder, whose changes make one sequence.
    Rows without a path are heartbeats: they move the time on and count nothing.
    """
    df = changes.withWatermark("ts", late) if changes.isStreaming else changes
    df = df.filter(F.when(F.col("path").isNotNull(), F.col("ts")).isNotNull())  # names ts, so that it stays behind the watermark
    if not keys and "root" in changes.columns:
        keys = ["root"]
    if changes.isStreaming and not keys:
        df = df.withColumn("_all", F.pmod(F.hash("path"), F.lit(1)))  # streams need a key beside the window; one folder has one sequence, and this is always 0
    w = F.session_window("ts", f"{int(seconds * 1000)} milliseconds").alias("w")
    out = df.groupBy(*(keys or (["_all"] if changes.isStreaming else [])), w).agg(F.count("*").alias("changes"), F.approx_count_distinct("path").alias("files") if changes.isStreaming else F.countDistinct("path").alias("files"), F.max((F.col("file_type") != "code").cast("int")).alias("other"))
    return out.select(*(keys or []), F.col("w.start").alias("start"), F.col("w.end").alias("end"), "changes", "files", action(F.col("other") == 1).alias("action"))


def action(other_than_code: Column) -> Column:
    return F.when(other_than_code, F.lit("flag")).otherwise(F.lit("rebuild"))


def with_heartbeat(changes: DataFrame) -> DataFrame:
    """A stream of changes (path, ts, file_type) with a row without a path each second, so that time goes on when nothing changes."""
    beat = changes.sparkSession.readStream.format("rate").option("rowsPerSecond", 1).load()
    none = F.lit(None).cast("string")
    return changes.unionByName(beat.select(none.alias("path"), F.col("timestamp").alias("ts"), none.alias("file_type")), allowMissingColumns=True)


def watch(changes: DataFrame, checkpoint: str, on_flag: Callable[[DataFrame], None], on_rebuild: Callable[[DataFrame], None], seconds: float = 3.0, late: str = "1 second", every: str | None = "500 milliseconds") -> StreamingQuery:
    """A query that calls on_flag or on_rebuild with the closed sessions of each trigger; a batch with any flag doesn't rebuild.

    It runs on, a trigger `every` so often; with None it handles what is there and ends.
    """

    def each(batch: DataFrame, _: int) -> None:
        rows = batch.persist()
        flags = rows.filter("action = 'flag'")
        if not flags.isEmpty():
            on_flag(flags)
        elif not rows.isEmpty():
            on_rebuild(rows)
        rows.unpersist()

    writer = debounced(changes, seconds, late=late).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(each)
    return writer.trigger(**({"processingTime": every} if every else {"availableNow": True})).start()


#: Endings by kind, of what is watched; office files and film aren't.
_KINDS = {"code": frozenset(T.CODE), "document": frozenset(T.DOCUMENT), "paper": frozenset(["pdf"]), "image": frozenset("png jpg jpeg gif webp svg".split())}


def watched(path: str) -> str | None:
    """The kind of a path below the root if it is watched: not in the folder of results nor under a hidden name."""
    parts = path.split("/")
    if any(p == "kg-out" or p.startswith(".") for p in parts) or "." not in parts[-1]:
        return None
    end = parts[-1].rsplit(".", 1)[1].lower()
    return next((k for k, ends in _KINDS.items() if end in ends), None)


Snapshot = dict[str, tuple[int, int, str]]


def snapshot(root: str | Path, follow_links: bool = False) -> Snapshot:
    """(size, time in nanoseconds, kind) of each watched path below a folder."""
    out: Snapshot = {}
    for folder, inner, names in os.walk(root, followlinks=follow_links):
        inner[:] = [d for d in inner if not d.startswith(".") and d != "kg-out"]
        for name in names:
            full = os.path.join(folder, name)
            path = os.path.relpath(full, root)
            kind = watched(path)
            if kind:
                try:
                    st = os.stat(full)
                except OSError:
                    continue  # gone since it was listed
                out[path] = (st.st_size, st.st_mtime_ns, kind)
    return out


def changed(before: Snapshot, now: Snapshot) -> dict[str, str]:
    """Kinds of the paths that are new, other or gone."""
    return {p: (now.get(p) or before[p])[2] for p in before.keys() | now.keys() if before.get(p) != now.get(p)}


def poll(spark, root: str | Path, on_change: Callable[[dict[str, str]], None], seconds: float = 3.0, every: float = 0.5, follow_links: bool = False, until: Callable[[], bool] = lambda: False, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
    """Looks at a folder every so often, and calls on_change with all that changed once `seconds` went by without another change."""
    before, pending, last = snapshot(root, follow_links), {}, clock()
    while not until():
        sleep(every)
        now = snapshot(root, follow_links)
        new = changed(before, now)
        before = now
        if new:
            pending |= new
            last = clock()
        if pending and clock() - last >= seconds:
            on_change(pending)
            pending = {}
