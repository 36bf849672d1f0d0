"""Curation of a stream of documents: the quality ladder is stateless, exact dedup keeps hashes within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators.filters import FilterConfig, keep_documents, with_reason


def filter_stream(docs: DataFrame, config: FilterConfig = FilterConfig()) -> DataFrame:
    return keep_documents(docs, config)


def exact_dedup_stream(docs: DataFrame, time_col: str, watermark: str) -> DataFrame:
    """First arrivals of each text, up to white space, within the watermark; state older than that is dropped."""
    keyed = docs.withColumn("_h", F.md5(t.normalise_space(F.col("text")))).withWatermark(time_col, watermark)
    return keyed.dropDuplicatesWithinWatermark(["_h"]).drop("_h")


def reason_counts_stream(docs: DataFrame, time_col: str, window: str, watermark: str) -> DataFrame:
    """Rejections by reason in windows of event time."""
    marked = with_reason(docs).where("reason is not null").withWatermark(time_col, watermark)
    return marked.groupBy(F.window(time_col, window), "reason").agg(F.count("*").alias("n"))
