"""Manifest mixing: sources sampled at their own rates, concatenated, ordered by a seeded hash, packed and batched."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions import tokens as tk
from loomspark.operators import batching
from loomspark.sources.files import Manifest


def mix(manifest: Manifest, tables: dict[str, DataFrame], key: str, seed: int) -> DataFrame:
    """Rows of all sources of the manifest that their coins keep, with source, data_struct and place. The coin is tossed right after the scan."""
    parts = []
    for s in manifest.sources:
        part = batching.sampled(tables[s.name], key, s.sampling_rate, seed)
        parts.append(part.withColumns({"source": F.lit(s.name), "data_struct": F.lit(s.data_struct), "system_prompt": F.lit(s.system_prompt)}))
    return batching.hashed_order(reduce(DataFrame.unionByName, parts), key, seed)


def packed(rows: DataFrame, question: Column, think: Column, reply: Column, prompt: Column) -> DataFrame:
    """rows with ids (prompt and answer) and labels."""
    out = rows.withColumn("ids", F.concat(prompt, tk.answer(F.col("data_struct"), question, think, reply)))
    return out.withColumn("labels", tk.labels(F.col("ids"), F.size(prompt)))
