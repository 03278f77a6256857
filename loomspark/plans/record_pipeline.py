"""The record pipeline: length filter, buffered sort, dynamic batches, padded cost of each batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.operators import batching, filters


def run(records: DataFrame, key: str = "doc_id", frames: str = "n_chars", tokens: str = "n_tokens", sort_size: int = 500, cap: int = 40_000, **bounds) -> DataFrame:
    """(shard, batch, n_rows, longest, frames, padded): records (key, frames, tokens) filtered, sorted inside buffers of sort_size and batched in each buffer."""
    kept = filters.length_filter(records, F.col(frames), F.col(tokens), **bounds)
    placed = batching.buffered_sort(kept, key, frames, sort_size).withColumnRenamed("buffer", "shard")
    made = batching.dynamic_batches(placed.select("shard", "place", key, frames), "shard", ["place"], key, frames, cap)
    return made.groupBy("shard", "batch").agg(
        F.count("*").alias("n_rows"), F.max(frames).alias("longest"), F.sum(frames).alias("frames"), (F.max(frames) * F.count("*")).alias("padded")
    )
