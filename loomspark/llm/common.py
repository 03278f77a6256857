"""What the operators share: vectorised words and hashes, bounded chunks, shared folders.

A word is hashed as a polynomial over its UTF-8 bytes modulo 2^64, through a table of random
64-bit values, and then mixed. One cumulative sum gives the hashes of all words of a chunk.
Two different words share a hash with a chance of about 2^-64.
"""

from __future__ import annotations

import ctypes
import functools
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

#: Space, and tab to carriage return.
SPACES = bytes([0x20, *range(0x09, 0x0E)])
#: Text handled at once, in bytes; a longer document is handled alone.
CHUNK_BYTES = 1 << 20

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 & ~7 | 5
_GRAM = 0xC2B2AE3D27D4EB4F & ~7 | 3
_TABLE = np.random.Generator(np.random.PCG64(20240501)).integers(1, 1 << 64, 256, dtype=np.uint64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit mixer, so that all bits of the result depend on all bits of x."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & _MASK)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i below n."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16, 0 if have is None else 2 * len(have[0]))
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        _POWERS[base] = have = (both[0], both[1])
    return have


@dataclass
class Words:
    """Words of some documents: hash and byte range in buf of each, and where each document's begin."""

    buf: np.ndarray
    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    ptr: np.ndarray  # document i has words ptr[i] to ptr[i + 1]

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))

    def grams(self, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the n words from each position on, and which of them lie in one document."""
        h = self.hashes
        if len(h) < n:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        p, q = _powers(_GRAM, len(h))
        s = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * p[: len(h)], dtype=np.uint64)])
        m = len(h) - n + 1
        doc = self.doc_of()
        return mix((s[n:] - s[:m]) * q[:m], seed), doc[:m] == doc[n - 1 :]


def hashed(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte range."""
    p, q = _powers(_BASE, len(buf) + 1)
    s = np.empty(len(buf) + 1, np.uint64)
    s[0] = 0
    np.cumsum(_TABLE[buf] * p[: len(buf)], out=s[1:])
    return mix((s[end] - s[start]) * q[start])


def words(texts: pa.Array, separators: bytes = SPACES, lower_ascii: bool = False) -> Words:
    """Maximal runs of other bytes than separators (ASCII) in each text. A null text has none."""
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null(b"")
    n = len(texts)
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and n else np.zeros(0, np.uint8)
    begin = (off[:-1] - off[0]) + np.arange(n) + 1 if n else np.zeros(0, np.int64)
    buf = np.insert(data, off[:-1] - off[0], 32) if n else data
    if lower_ascii:
        lut = np.arange(256, dtype=np.uint8)
        lut[65:91] += 32
        buf = lut[buf]
    in_word = np.ones(256, np.int8)
    in_word[list(separators)] = 0
    d = np.diff(in_word[buf], prepend=np.int8(0), append=np.int8(0))
    start, end = np.flatnonzero(d == 1), np.flatnonzero(d == -1)
    return Words(buf, hashed(buf, start, end), start, end, np.append(np.searchsorted(start, begin), len(start)))


def not_single_spaced(w: Words, size: np.ndarray) -> np.ndarray:
    """Documents (of `size` bytes each, words between spaces) in which a space stands at an end or beside another one."""
    doc, some = w.doc_of(), w.ptr[:-1] < w.ptr[1:]
    begin = np.cumsum(size + 1) - size
    odd = (size > 0) & ~some
    if len(w.start):
        odd[doc[1:][(w.start[1:] - w.end[:-1] > 1) & (doc[1:] == doc[:-1])]] = True
    odd[some] |= (w.start[w.ptr[:-1][some]] != begin[some]) | (w.end[w.ptr[1:][some] - 1] != (begin + size)[some])
    return odd


def byte_sizes(texts: pa.Array) -> np.ndarray:
    return pc.binary_length(texts.fill_null("")).to_numpy(zero_copy_only=False).astype(np.int64)


def ragged(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for n[0] places, then the same for the next ones."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


class Memo:
    """Runs of ids by word hash, in sorted arrays."""

    def __init__(self, dtype: np.dtype):
        self.hashes, self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids = np.zeros(0, dtype)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash, or -1."""
        if not len(self.hashes):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at, -1)

    def add(self, h: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        """Adds hashes, ascending and new; n may count ids that aren't kept."""
        to = np.searchsorted(self.hashes, h)
        self.hashes = np.insert(self.hashes, to, h)
        self.at = np.insert(self.at, to, len(self.ids) + np.cumsum(n) - n)
        self.n = np.insert(self.n, to, n)
        self.ids = np.concatenate([self.ids, ids])


#: For matching that overlooks case and marks: besides white space, ASCII punctuation parts words.
MARKS = bytes(sorted({*SPACES, *range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)}))


def folded_words(texts: pa.Array) -> Words:
    """Lower-cased words between white space and ASCII punctuation."""
    return words(pc.utf8_lower(texts.cast(pa.large_string())), MARKS)


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about `most` bytes of text."""
    for b in batches:
        if not b.num_rows:
            continue
        size = np.cumsum(np.nan_to_num(pc.binary_length(b.column(column).fill_null("")).to_numpy(zero_copy_only=False)))
        at = 0
        while at < b.num_rows:
            to = int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right"))
            to = max(to, at + 1)
            yield b.slice(at, to - at)
            at = to


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which a worker gives free memory back: several idle workers stay beside an executor, and allocators keep what a task used."""

    @functools.wraps(run)
    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
        if trim:
            trim(0)

    return outer


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder below spark.checkpoint.dir; below the warehouse's where that is unset, as in tests. Its path names its file system."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{top.rstrip('/')}/{what}-{uuid.uuid4().hex}")
    path = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return re.sub("^file:/+", "file:///", path)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """A worker's file system for a path of Spark's, and the path in it."""
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a copy in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession, "checkpoints"))
    return df.checkpoint()


def released(spark: SparkSession, path: str) -> None:
    """Deletes a folder that an operator wrote, through Spark's file systems."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
