"""Incremental work: streams that route new pages, and resuming from state tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from docsieve.sources import markup


def page_stream(spark, path: str, schema: StructType, *, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files as they arrive below ``path``."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def route(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, n_alnum, native_text, n_images, n_rows, route): ocr for pages without text, review for little text or many images."""
    seen = markup.inspect(pages, page_id, html)
    rule = F.when(F.col("native_text") == "missing", "ocr").when((F.col("native_text") == "low") | (F.col("n_images") > 3), "review").otherwise("native")
    return seen.withColumn("route", rule)


def write_routes(pages: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Route all that has arrived and stop; a restart goes on after the last finished batch, each row once."""
    out = route(pages).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return out.trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, *, ts: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, key, n) over a stream or a table; rows later than ``late`` are dropped from streams."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.window(ts, width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), key, "n")


def pending(regions: DataFrame, state: DataFrame, key: str, binding: str) -> DataFrame:
    """Regions that have no complete state row with the same binding hash: what a resumed run still has to do."""
    done = state.filter("status = 'complete'").select(key, binding).distinct()
    return regions.join(done, [key, binding], "left_anti")


def stale(state: DataFrame, regions: DataFrame, key: str, binding: str) -> DataFrame:
    """State rows whose region is gone or has another binding."""
    return state.join(regions.select(key, binding).distinct(), [key, binding], "left_anti")


def next_action(actions: DataFrame, job: str, *, order: str = "action_order") -> DataFrame:
    """(job, action): the first action of each job that isn't complete; null where all are."""
    open_one = F.when(F.col("status") != "complete", F.struct(order, "action"))
    return actions.groupBy(job).agg(F.min(open_one)["action"].alias("action"))
