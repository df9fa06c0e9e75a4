"""Chunked ingest as Structured Streaming: chunks arrive in batches and are put in place by position."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.position import POS


def write_chunks(stream: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Appends each batch with its number; `latest` then lets the last write of a position win.

    A batch that is replayed after a failure overwrites its own folder, so nothing is there twice.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if once else query).start()


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*").drop("batch")


def latest(chunks: DataFrame, order: str = "_batch") -> DataFrame:
    """One row for each position: that of the last batch. An aggregation, combined before the shuffle."""
    rest = [c for c in chunks.columns if c not in (POS, order)]
    return chunks.groupBy(POS).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(POS, "_r.*")


def extent(chunks: DataFrame) -> DataFrame:
    """How long the target has grown."""
    return chunks.agg((F.max(POS) + 1).alias("length"))


def exhaust(spark: SparkSession, starts: list[Callable], concurrent: bool = True) -> None:
    """Drains several chunk streams: side by side in scheduler pools of their own, which share the
    executors in turn, or one after the other."""
    running = []
    for n, start in enumerate(starts):
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"drain-{n}" if concurrent else None)
        query = start()
        if concurrent:
            running.append(query)
        else:
            query.awaitTermination()
    spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)
    drain(*running)


def drain(*queries) -> None:
    """Waits for queries that run side by side."""
    for q in queries:
        q.awaitTermination()


def sample_count(stream: DataFrame, by: str) -> DataFrame:
    """Running number of samples by group, for streams and tables alike."""
    return stream.groupBy(by).agg(F.count(F.lit(1)).alias("n_samples"))


def process(stream: DataFrame, partial: Callable, merge: Callable, schema: str, key: str) -> DataFrame:
    """A user's fold: `partial` (pandas frames to pandas frames) runs on batches of rows where they
    are, `merge` (one pandas frame) on each key's partial results."""

    def run(frames):
        for f in frames:
            yield partial(f)

    return stream.mapInPandas(run, schema).groupBy(key).applyInPandas(merge, schema)


def windowed_counts(events: DataFrame, ts: str, by: str, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by event-time window; late rows are taken up to the watermark."""
    if events.isStreaming:
        events = events.withWatermark(ts, late)
    return events.groupBy(F.window(ts, length), by).agg(F.count(F.lit(1)).alias("n"))
