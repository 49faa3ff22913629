"""Incremental ingest: new documents flow into a store once each, by the hash of their content."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import TimerValues

from lexmill import session
from lexmill.operators import cleanup, quality


def prepare(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Documents with content_hash, cleaned text and status: ready, or needs_review where the quality gate objects."""
    hashed = docs.withColumn("content_hash", F.sha2(F.coalesce(text_col, F.lit("")), 256))
    cleaned = hashed.withColumn(text_col, cleanup.clean_markdown(cleanup.clean_artifacts(F.col(text_col))))
    return cleaned.withColumn("status", F.when(quality.gate(F.col(text_col)) == "ok", "ready").otherwise("needs_review"))


class FirstOfContent(StatefulProcessor):
    """Passes a content's first row, by `order`, and none when it comes again; the state is that it came.

    A state that was not touched for `keep` milliseconds is forgotten, if that is given.
    """

    def __init__(self, order: str, keep: int | None = None):
        self.order, self.keep = order, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean", self.keep)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timers: TimerValues) -> Iterator[Row]:
        first = None
        for row in rows:
            if first is None or _before(row[self.order], first[self.order]):
                first = row
        if not self.seen.exists():
            yield first
        self.seen.update((True,))

    def close(self) -> None:
        pass


def _before(a: Any, b: Any) -> bool:
    """Whether a value comes before another; null comes last."""
    return a is not None and (b is None or a < b)


def once(stream: DataFrame, order: str, keep: int | None = None) -> DataFrame:
    """The rows of a stream with a content_hash, each content once; of copies in a batch the first by `order`.

    What was met is kept as state by content, part of the stream's checkpoint, so nothing that is stored is read again.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row of each content in an Arrow batch, so that few rows of a frequent one meet in one task."""
        for batch in batches:
            at = pc.sort_indices(batch, [("content_hash", "ascending"), (order, "ascending")])
            codes = batch.column("content_hash").dictionary_encode().indices.take(at).to_numpy(zero_copy_only=False)
            yield batch.take(at.filter(pa.array(np.append(True, codes[1:] != codes[:-1])[: len(codes)])))

    by_content = stream.mapInArrow(firsts, stream.schema).groupBy("content_hash")
    return by_content.transformWithState(FirstOfContent(order, keep), stream.schema, "Append", "ProcessingTime" if keep else "None")


def ingest(spark: SparkSession, source: str, store: str, checkpoint: str, schema: str, order: str = "doc_id", pattern: str = "*", keep: int | None = None) -> StreamingQuery:
    """Take up all Parquet files that came to `source` since the last run and whose names fit the pattern, then stop.

    A run that was stopped goes on from its checkpoint: the store has each row once.
    """
    session.tune(spark)
    stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(source)
    fresh = once(prepare(stream), order, keep)
    return fresh.writeStream.format("parquet").outputMode("append").option("path", store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts and sums of events per window and type; works on streams and tables. Events later than `late` are left out of streams."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "events", "total")
