"""SentencePiece encoding and decoding of whole texts, by shared-prefix segmentation (see pieces).

Rows are read by themselves: no shuffle, and memory bounded by a chunk of text and the memos.

Defined results: a null text is empty and has no ids; other columns pass through; repeated rows
each get their own result; an empty table gives an empty table. A column named like one that is
added is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.llm.common import chunks, trimmed
from loomspark.llm.pieces import Encoder

ADDED = {"ids": (pa.list_(pa.int32()), "array<int>"), "n_tokens": (pa.int64(), "long"), "round_trip": (pa.bool_(), "boolean")}


def encode(docs: DataFrame, model: str) -> DataFrame:
    """docs with ids, n_tokens and round_trip: whether decoding the ids gives the text."""
    keep = docs.drop(*ADDED)
    schema = T.StructType([*keep.schema.fields, *T._parse_datatype_string(", ".join(f"{k} {v[1]}" for k, v in ADDED.items())).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder.load(model)
        for b in chunks(batches):
            texts = b.column("text").to_pylist()
            ids = enc.encode(b.column("text"))
            same = [enc.decode(x) == (t or "") for x, t in zip(ids, texts)]
            n = np.array([len(x) for x in ids], np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(np.concatenate(ids).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*b.columns, lists, pa.array(n), pa.array(same)], names=[*b.schema.names, *ADDED])

    return keep.mapInArrow(trimmed(run), schema)


def decode(df: DataFrame, model: str, ids: str = "ids", to: str = "text") -> DataFrame:
    """df with the text of its ids; null ids give a null text."""
    keep = df.drop(to) if to != ids else df
    schema = T.StructType([*keep.schema.fields, T.StructField(to, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder.load(model)
        for b in batches:
            texts = [None if x is None else enc.decode(np.array(x, np.int64)) for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, to])

    return keep.mapInArrow(trimmed(run), schema)


def token_counts(docs: DataFrame, model: str) -> DataFrame:
    """Rows (doc_id, n_tokens, n_words): ids and marked words of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder.load(model)
        for b in chunks(batches):
            got = np.array(enc.count(b.column("text")), np.int64)
            yield pa.record_batch([b.column("doc_id"), pa.array(got[:, 0]), pa.array(got[:, 1])], ["doc_id", "n_tokens", "n_words"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(run), "doc_id long, n_tokens long, n_words long")
