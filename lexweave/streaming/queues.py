"""Streams of documents: a folder as a queue with a dead-letter table, event windows, and copies across epochs."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.session import ensure_checkpoint_dir, show_package

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def folder_stream(spark: SparkSession, folder: str, schema: str, pattern: str = "*.parquet", files: int = 100) -> DataFrame:
    """New Parquet files of a folder. ``files`` a batch is the back-pressure; Spark keeps track of what was read."""
    show_package(spark)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", pattern).parquet(folder)


def run_queue(stream: DataFrame, step: Callable[[DataFrame], DataFrame], valid, out: str, dead: str, checkpoint: str) -> None:
    """Processes what there is and stops. Rows that ``valid`` refuses go to ``dead``; a batch that fails is run again from the checkpoint.

    Batches are written to a folder of their own, and overwritten if repeated, so each row counts once.
    """

    def work(batch: DataFrame, number: int) -> None:
        ok = F.coalesce(valid, F.lit(False))
        step(batch.where(ok)).write.mode("overwrite").parquet(f"{out}/batch={number}")
        batch.where(~ok).write.mode("overwrite").parquet(f"{dead}/batch={number}")

    stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_queue_with_retry(stream: DataFrame, step: Callable[[DataFrame], DataFrame], out: str, dead: str, checkpoint: str, tries: int = 2) -> None:
    """Processes what there is and stops; a batch whose step fails ``tries`` times goes to ``dead`` as it came, and the queue goes on."""

    def work(batch: DataFrame, number: int) -> None:
        for k in range(1, tries + 1):
            try:
                step(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")
                return
            except Exception:
                if k == tries:
                    batch.write.mode("overwrite").parquet(f"{dead}/batch={number}")

    stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_stages(spark: SparkSession, stages: list[tuple[str, Callable[[DataFrame], DataFrame]]], source: str, schema: str, root: str) -> dict[str, int]:
    """Queues in a row: each stage reads the folder that the one before it wrote; gives rows by stage. A stage that is run again takes up what is new."""
    counts, folder = {}, source
    for name, step in stages:
        stream = folder_stream(spark, folder, schema)
        target = f"{root}/{name}/out"

        def work(batch: DataFrame, number: int, step=step, target=target) -> None:
            step(batch).coalesce(8).write.mode("overwrite").parquet(f"{target}/batch={number}")

        stream.writeStream.foreachBatch(work).option("checkpointLocation", f"{root}/{name}/state").trigger(availableNow=True).start().awaitTermination()
        done = spark.read.option("basePath", target).option("recursiveFileLookup", True).parquet(target)
        counts[name], folder, schema = done.count(), f"{target}/*", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in done.schema)
    return counts


def feed_queue(rows: DataFrame, folder: str, key: str, last: int | None, size: int = 1000) -> int | None:
    """Puts the rows of a table with a key above ``last`` into a queue's folder, about ``size`` a file, and gives the new last key."""
    new = rows if last is None else rows.where(F.col(key) > last)
    top = new.agg(F.max(key)).first()[0]
    if top is None:
        return last
    new.where(F.col(key) <= top).write.option("maxRecordsPerFile", size).mode("append").parquet(folder)
    return top


def sliding_windows(events: DataFrame, length: str = "2 days", slide: str = "1 day", late: str = "1 hour") -> DataFrame:
    """``start, event_type, n`` by windows that overlap."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", length, slide).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def event_windows(events: DataFrame, length: str = "1 day", late: str = "1 hour") -> DataFrame:
    """``start, event_type, n, total`` by tumbling window; rows later than ``late`` behind the newest are dropped from a stream."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    grouped = timed.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """``user_id, start, end, n``: runs of a user's events with no gap of ``gap``."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    grouped = timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def finished(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """The result of a stream over all input that there is, as a table. A batch that is repeated replaces itself."""
    spark, name = stream.sparkSession, f"s{uuid.uuid4().hex}"
    folder = f"{ensure_checkpoint_dir(spark)}/stream-{name}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out" if mode == "complete" else f"{folder}/out/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{folder}/out")
    return out if mode == "complete" else out.drop("batch")


def new_documents(stream: DataFrame, time: str | None = None, late: str = "30 days") -> DataFrame:
    """The first document of each text: the state holds hashes only. With a column of times, a text is forgotten ``late`` after it was seen."""
    hashed = stream.withColumn("_h", F.sha2(F.coalesce("text", F.lit("")), 256))
    if time is None:
        return hashed.dropDuplicates(["_h"]).drop("_h")
    return hashed.withWatermark(time, late).dropDuplicatesWithinWatermark(["_h"]).drop("_h")


def _q_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = finished(event_windows(folder_stream(spark, sf_dir, EVENTS, "events.parquet")))
    return out.select(F.col("start").cast("date").alias("day"), "event_type", "n", F.round("total", 3).alias("total"))


def _q_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = finished(sliding_windows(folder_stream(spark, sf_dir, EVENTS, "events.parquet")))
    return out.select(F.col("start").cast("date").alias("day"), "event_type", "n")


def _q_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = finished(sessions(folder_stream(spark, sf_dir, EVENTS, "events.parquet")))
    return out.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.max("n").alias("longest"))


QUERIES = {"stream_windows": _q_windows, "stream_sessions": _q_sessions, "stream_sliding": _q_sliding}
ORACLE_SQL = {
    "stream_windows": "SELECT ts::DATE AS day, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2",
    "stream_sliding": "SELECT (ts::DATE - k)::DATE AS day, event_type, count(*) AS n FROM events, (VALUES (0), (1)) t(k) GROUP BY 1, 2",
    "stream_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
        s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), c AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY 1, 2)
        SELECT user_id, count(*) AS n_sessions, max(n) AS longest FROM c GROUP BY 1""",
}
