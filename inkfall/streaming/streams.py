"""Incremental forms: windows over events, debouncing, keyed merges and index maintenance by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_stream(spark: SparkSession, path: str, like: DataFrame, files_at_once: int = 100) -> DataFrame:
    """A folder of Parquet files as a stream, with timestamps in UTC."""
    stream = spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_at_once).parquet(path)
    return with_timestamps(stream)


def with_timestamps(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})


def tumbling(events: DataFrame, size: str, late: str | None = None, ts: str = "ts", keys: tuple[str, ...] = ("event_type",), slide: str | None = None) -> DataFrame:
    """Events, their sum and the errors among them per window; streams and tables alike."""
    held = events.withWatermark(ts, late) if late else events
    span = F.window(ts, size, slide) if slide else F.window(ts, size)
    out = held.groupBy(span.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total", "errors")


def sessions(events: DataFrame, gap: str, late: str | None = None, ts: str = "ts", keys: tuple[str, ...] = ("user_id",)) -> DataFrame:
    held = events.withWatermark(ts, late) if late else events
    out = held.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def debounced(changes: DataFrame, gap: str, late: str | None = None, ts: str = "ts", path: str = "path", event: str = "event_type") -> DataFrame:
    """Changes are flushed once nothing has happened for a while, each path with its last event.

    A quiet spell is one for all paths. A stream asks for a second key beside the session, a constant one here.
    What a session holds grows with its events, so a gap should be short against their pace: its events are sorted by
    path and time once, and the last of each path is the one before another path. `debounced_table` has no such bound.
    """
    held = changes.withWatermark(ts, late) if late else changes
    spans = held.withColumn("every", F.lit(0)).groupBy(F.session_window(ts, gap).alias("w"), "every").agg(F.sort_array(F.collect_list(F.struct(F.col(path).alias("path"), F.col(ts).alias("ts"), F.col(event).alias("event")))).alias("seen"))
    last = F.filter("seen", lambda x, i: ~F.get("seen", i + 1)["path"].eqNullSafe(x["path"]) | (i == F.size("seen") - 1))
    return spans.select("w.start", F.explode(last).alias("s")).select("start", "s.path", "s.event")


def debounced_table(changes: DataFrame, gap_seconds: float, ts: str = "ts", path: str = "path", event: str = "event_type", order: str = "event_id") -> DataFrame:
    """The same over a table: quiet spells are found hour by hour, so that no window holds all events.

    An hour's first event belongs to the spell of the hour before if that one's last event is near; how the
    hours link is settled on a row per hour.
    """
    from pyspark.sql import Window

    gap = int(gap_seconds * 1_000_000)
    rows = changes.withColumn("at", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("hour", F.floor(F.col("at") / F.lit(3_600_000_000)))
    w = Window.partitionBy("hour").orderBy("at", order)
    rows = rows.withColumn("new", (F.col("at") - F.lag("at").over(w) >= gap).cast("int")).withColumn("n", F.sum(F.coalesce("new", F.lit(0))).over(w))
    hours = rows.groupBy("hour").agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.max("n").alias("last"))
    up = Window.orderBy("hour")  # a row per hour
    starts = hours.withColumn("starts", (F.coalesce(F.col("lo") - F.lag("hi").over(up), F.lit(gap)) >= gap).cast("int"))
    offsets = starts.select(F.col("hour").alias("h"), (F.sum(F.col("starts") + F.col("last")).over(up) - F.col("last")).alias("base"))
    found = rows.join(offsets, F.col("hour") == F.col("h")).withColumn("spell", F.col("base") + F.col("n"))
    return found.groupBy("spell", path).agg(F.max(F.struct("at", order, F.col(event).alias("event")))["event"].alias("event"))


def unseen(stream: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """What is not known yet: a stream against a table."""
    return stream.join(known.select(*keys).distinct(), keys, "left_anti")


def once_each(stream: DataFrame, keys: list[str], late: str, ts: str = "ts") -> DataFrame:
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def run_available(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Runs what is there to its end into a table in the driver's memory: for results of a bounded size, such as windows in a report.

    `run_to` writes results that grow.
    """
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def run_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Runs what is there to its end into Parquet files, each row once."""
    q = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def watched(spark: SparkSession, folder: str, files_at_once: int = 1000) -> DataFrame:
    """path, modified, size, content of files as they come into a folder or change. What is deleted shows in a scan: see file_changes."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_at_once).load(folder)
    return files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content")


def merging_sink(read: Callable[[], DataFrame | None], write: Callable[[DataFrame], None], keys: list[str], by: list[str] | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a batch's last row per key, by the given columns, replaces what the table holds.

    A batch that is run again gives the same table.
    """
    from inkfall.operators.operations import latest, upsert

    def run(batch: DataFrame, _: int) -> None:
        old = read()
        write(latest(batch, keys, by) if old is None else upsert(old, batch, keys, by))

    return run


def index_sink(read: Callable[[], DataFrame | None], write: Callable[[DataFrame], None], stem: bool = False) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: postings follow the documents that come in or change."""
    from inkfall.operators.search import build_postings, merge_postings

    def run(batch: DataFrame, _: int) -> None:
        old = read()
        write(build_postings(batch, stem) if old is None else merge_postings(old, batch, stem=stem))

    return run
