"""Score a stream of documents: the scoring plan keeps no state, so it runs on a stream as it is."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.bands import DEFAULT, Band
from ..operators.detect import detect


def document_stream(spark: SparkSession, folder: str, schema: str = "doc_id bigint, text string", *, max_files: int = 100) -> DataFrame:
    """Parquet files as they arrive in a folder, some per micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)


def score_stream(docs: DataFrame, scorer: Any, *, text_col: str = "text", bands: Sequence[Band] = DEFAULT) -> DataFrame:
    """A detection per document of the stream; append mode, no watermark needed."""
    return detect(docs, scorer, text_col=text_col, bands=bands)


def write_scores(scored: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Write what is there as Parquet, each document exactly once, then stop."""
    return scored.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def for_each_batch(scored: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand each micro-batch of results to ``sink``; a batch that is handed over twice has the same number."""
    return scored.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
