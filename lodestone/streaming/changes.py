"""Changes of files: debounced batches, and a hash-gated sync in batch and as a stream.

A change only says that a path is to be looked at again; the content's hash decides. So a late or repeated event is harmless,
and replaying events in any order ends where one batch ends.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.functions.predicates import INDEX_EXTENSIONS, extension_of
from lodestone.operators.mutations import sync

QUIET = "800 milliseconds"
#: Directories whose changes aren't watched.
UNWATCHED = (".git", "node_modules", ".lodestone", "dist", "build", "vendor", ".idea")


def source(spark: SparkSession, folder: str) -> DataFrame:
    """The stream of changes (path, op, ts) that are logged in a folder, a JSON object a line; new files are taken as they come."""
    return spark.readStream.schema("path string, op string, ts timestamp").json(folder)


def watched(events: DataFrame) -> DataFrame:
    """Events of source files outside of the unwatched directories."""
    parts = F.split("path", "/")
    return events.where(extension_of("path").isin(*INDEX_EXTENSIONS) & ~F.exists(parts, lambda p: p.isin(*UNWATCHED)))


def debounce(events: DataFrame, gap: str = QUIET) -> DataFrame:
    """path, first_ts, last_ts, n and op: bursts of a path's events that are less than gap apart, with the last one's op."""
    burst = F.session_window("ts", gap)
    found = events.groupBy("path", burst.alias("burst")).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"), F.max_by("op", F.struct("ts", "op")).alias("op"))
    return found.select("path", "first_ts", "last_ts", "n", "op")


def latest(events: DataFrame) -> DataFrame:
    """The last event of each path."""
    return events.groupBy("path").agg(F.max("ts").alias("ts"), F.max_by("op", F.struct("ts", "op")).alias("op"))


def apply(files: DataFrame, changed: DataFrame, content: DataFrame) -> DataFrame:
    """files (path, content_hash) after a batch: changed (path, op) paths are looked up in content (path, content_hash).

    A path that is no longer in content goes, one with another hash is replaced, and one with the same hash is untouched.
    """
    touched = changed.select("path").distinct()
    now = touched.join(content, "path", "left")
    untouched = files.join(touched, "path", "left_anti")
    return untouched.select("path", "content_hash").unionByName(now.where("content_hash is not null").select("path", "content_hash"))


def plan(files: DataFrame, changed: DataFrame, content: DataFrame) -> DataFrame:
    """path and action of what a batch does."""
    touched = changed.select("path").distinct()
    return sync(files.join(touched, "path", "left_semi"), content.join(touched, "path", "left_semi"))


def stream(events: DataFrame, on_batch: Callable[[DataFrame, int], None], checkpoint: str, late: str = "10 minutes", gap: str = QUIET) -> StreamingQuery:
    """Runs a stream of events (path, op, ts) to its end: bursts that the watermark has closed go to on_batch, once each."""
    bursts = debounce(events.withWatermark("ts", late), gap)
    return bursts.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(on_batch).trigger(availableNow=True).start()


def windowed(events: DataFrame, size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """start, op and n by tumbling, or with slide by sliding windows."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.groupBy(w.alias("w"), "op").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "op", "n")
