"""Streams of reads against static features."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.joins import overlap_join
from ..operators.reports import feature_count


def annotate(stream: DataFrame, features: DataFrame, sink: Callable[[DataFrame, int], None], width: int = 1000) -> DataStreamWriter:
    """A writer that joins each micro-batch of reads with the features that they overlap and gives it to sink(pairs, batch)."""
    return stream.writeStream.foreachBatch(lambda batch, n: sink(overlap_join(batch, features, width=width), n))


def count(stream: DataFrame, features: DataFrame, path: str, width: int = 1000) -> DataStreamWriter:
    """A writer that adds each micro-batch's counts per feature to path, one folder a batch, so that a batch that is run
    again replaces itself."""

    def add(batch: DataFrame, n: int) -> None:
        feature_count(batch, features, width=width).filter("Count > 0").write.mode("overwrite").parquet(f"{path}/batch={n}")

    return stream.writeStream.foreachBatch(add)


def totals(counts: DataFrame) -> DataFrame:
    """name, Length, Count over all batches that count() has written."""
    return counts.groupBy("name", "Length").agg(F.sum("Count").alias("Count"))
