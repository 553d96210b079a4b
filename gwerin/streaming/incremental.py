"""Incremental runs with Structured Streaming: new files in, facts out, once each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gwerin.operators import rules


def new_words(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    """Stream of delivered word files; ``files`` per trigger bound a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def stream_facts(words: DataFrame, out: str, state: str, then: Callable[[DataFrame, int], None] | None = None, parts: int = 256) -> StreamingQuery:
    """Facts of all words delivered so far, kept right from batch to batch.

    Words are stored below ``out``/words by batch and part, a part being the videos of one
    hash value; the facts of the parts that a batch touches are derived anew from all their
    words and replace those below ``out``/facts. So a video that comes in several batches
    has the neighbours and deliveries of a single run, and a batch that is run again
    replaces itself. ``parts`` must not change between runs.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        part = F.pmod(F.xxhash64("video_url"), F.lit(parts)).alias("part")
        df.select("*", part).write.mode("overwrite").partitionBy("part").parquet(f"{out}/words/batch={number}")
        touched = [r["part"] for r in df.select(part).distinct().collect()]  # at most ``parts``
        if not touched:
            return
        known = spark.read.parquet(f"{out}/words").where((F.col("batch") <= number) & F.col("part").isin(touched)).drop("batch", "part")
        found = rules.scan_facts(rules.enrich(known)).select("*", part)
        found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{out}/facts")
        if then is not None:
            then(found, number)

    return words.writeStream.foreachBatch(batch).option("checkpointLocation", state).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, kind: str, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """(window_start, kind, n) of a stream or table; rows later than ``late`` are dropped by a stream."""
    marked = events.withWatermark(time, late) if events.isStreaming else events
    return marked.groupBy(F.window(time, width), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), kind, "n")
