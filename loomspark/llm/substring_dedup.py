"""Substring dedup: words under a window of WINDOW words that also starts in an earlier document go.

1. Anchors: each window's anchor is its smallest hash of GRAM words. Equal windows have equal
   anchors, so a window whose anchor lies in one document only can't repeat. Anchors of several documents
   are kept in a filter of at most MAX_FILTER bytes (false hits only cost work: where it is full, more
   windows that don't recur are looked up), in segments that workers read from the shared folder.
2. Segments: runs of a document's windows with the same kept anchor, with all their words. Equal
   segments become one before any is gathered. Segments are ordered by anchor, so all places of
   a window meet. An anchor whose different segments have more than SHARD words is dealt anew by single
   windows, as equal windows of equal hash became one and others need not meet.
3. Anchors are streamed in order: an FM-index is built over at most SHARD words of whole anchors, and
   their segments are read backwards through it: matching statistics of WINDOW or more are the windows
   that recur, and the rows of the match give the smallest doc_id that holds it.
4. Runs of windows with an earlier holder go back to their documents, and the words they cover are removed.

Defined results: a null text has no words; a document with a null doc_id neither loses words nor
makes others lose them; rows that repeat a doc_id don't take words from each other, and each keeps
its own; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import Words, _powers, checkpointed, chunks, mix, opened, ragged, shared_dir, words
from loomspark.llm.fm_index import FMIndex

WINDOW, GRAM = 50, 10
SHARD = 400_000
#: Windows of a segment.
RUN = 256
BITS, PROBES, MAX_FILTER = 12, 3, 128 << 20
FILTER_PARTS = 64


def _windows(w: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Each window's first word and its anchor, of the windows that lie in one document."""
    gram = min(GRAM, window)
    h, _ = w.grams(gram, 31)
    width = window - gram + 1
    n = len(w.hashes) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    low, k = h, 1
    while 2 * k <= width:
        low, k = np.minimum(low[:-k], low[k:]), 2 * k
    if width > k:
        low = np.minimum(low[: len(low) - (width - k)], low[width - k :])
    doc = w.doc_of()
    at = np.flatnonzero(doc[:n] == doc[window - 1 :])
    return at, low[at]


def _whole(w: Words) -> np.ndarray:
    """A hash of each document's words."""
    p, q = _powers(0x2545F4914F6CDD1D, len(w.hashes) + 1)
    s = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w.hashes * p[: len(w.hashes)], dtype=np.uint64)])
    return mix((s[w.ptr[1:]] - s[w.ptr[:-1]]) * q[w.ptr[:-1]] + np.diff(w.ptr).astype(np.uint64), 17)


def _anchors(docs: DataFrame, window: int) -> DataFrame:
    """Rows (anchor, doc_id) of the anchors of every document's windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            w = words(b.column("text"))
            at, anchor = _windows(w, window)
            doc = w.doc_of()[at] if len(at) else at
            new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]) if len(at) else np.zeros(0, bool)
            yield pa.record_batch([pa.array(anchor[new].view(np.int64)), b.column("doc_id").take(pa.array(doc[new]))], ["anchor", "doc_id"])

    return docs.mapInArrow(run, "anchor long, doc_id long")


def _bits(h: np.ndarray, i: int, size) -> np.ndarray:
    return ((mix(h, 50 + i) >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)


def _kept_filter(docs: DataFrame, window: int) -> str:
    """Writes the filter of anchors of several documents; returns its folder."""
    several = _anchors(docs, window).groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).filter("a < z").select("anchor", F.pmod("anchor", F.lit(FILTER_PARTS)).alias("part"))
    most = MAX_FILTER * 8 // FILTER_PARTS
    kind = pa.schema([("part", pa.int64()), ("size", pa.int64()), ("segment", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A partition holds whole parts, in order; each is built by itself.
        part, held = None, []

        def built() -> pa.RecordBatch:
            h = np.concatenate(held).view(np.uint64)
            size = max(64, min(len(h) * BITS, most) + 7 & ~7)
            bits = np.zeros(size, bool)
            for i in range(PROBES):
                bits[_bits(h, i, size).astype(np.int64)] = True
            return pa.RecordBatch.from_pylist([{"part": part, "size": size, "segment": np.packbits(bits, bitorder="little").tobytes()}], schema=kind)

        for b in batches:
            anchors, parts = b.column("anchor").to_numpy(), b.column("part").to_numpy()
            for p in np.unique(parts).tolist():
                if p != part and held:
                    yield built()
                    held = []
                part = p
                held.append(anchors[parts == p])
        if held:
            yield built()

    path = shared_dir(docs.sparkSession, "anchors")
    several.repartition("part").sortWithinPartitions("part").mapInArrow(run, "part long, size long, segment binary").write.parquet(path)
    return path


class _Filter:
    _held: dict[str, "_Filter"] = {}

    @classmethod
    def load(cls, path: str) -> "_Filter":
        if path not in cls._held:
            cls._held.clear()
            cls._held[path] = cls(path)
        return cls._held[path]

    def __init__(self, path: str):
        files, top = opened(path)
        self.parts: dict[int, tuple[int, np.ndarray]] = {}
        for f in files.get_file_info(fs.FileSelector(top)):
            if f.path.endswith(".parquet"):
                for b in pq.read_table(files.open_input_file(f.path)).to_batches():
                    for part, size, raw in zip(b.column("part").to_pylist(), b.column("size").to_pylist(), b.column("segment")):
                        self.parts[part] = size, np.frombuffer(raw.as_buffer(), np.uint8)

    def holds(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), bool)
        part = h.view(np.int64) % FILTER_PARTS
        for p, (size, raw) in self.parts.items():
            at = np.flatnonzero(part == p)
            for i in range(PROBES):
                k = _bits(h[at], i, size)
                at = at[(raw[(k >> np.uint64(3)).astype(np.int64)] >> (k & np.uint64(7)).astype(np.uint8)) & 1 == 1]
            out[at] = True
        return out


def _segments(docs: DataFrame, path: str, window: int, texts: bool) -> DataFrame:
    """Rows (anchor, segment, doc_id, whole, start, n) of all segments, n words each, with these if texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = _Filter.load(path)
        for b in chunks(batches):
            w = words(b.column("text"))
            at, anchor = _windows(w, window)
            if not len(at):
                continue
            doc = w.doc_of()[at]
            new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]))
            ends = np.append(new, len(at))[1:] - 1
            keep = kept.holds(anchor[new])
            new, ends = new[keep], ends[keep]
            times = (ends - new) // RUN + 1  # long runs, as of periodic texts, are cut
            new = ragged(np.zeros(len(new), np.int64), times) * RUN + np.repeat(new, times)
            ends = np.minimum(new + RUN - 1, np.repeat(ends, times))
            lo, hi, doc, anchor = at[new], at[ends] + window, doc[new], anchor[new]
            p, q = _powers(0x2545F4914F6CDD1D, len(w.hashes) + 1)
            s = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w.hashes * p[: len(w.hashes)], dtype=np.uint64)])
            name = mix((s[hi] - s[lo]) * q[lo] + (hi - lo).astype(np.uint64), 23) ^ mix(anchor, 29)
            columns = [pa.array(anchor.view(np.int64)), pa.array(name.view(np.int64)), b.column("doc_id").take(pa.array(doc)), pa.array(_whole(w)[doc].view(np.int64)), pa.array((lo - w.ptr[doc]).astype(np.int32)), pa.array((hi - lo).astype(np.int32))]
            names = ["anchor", "segment", "doc_id", "whole", "start", "n"]
            if texts:
                raw = w.hashes.tobytes()
                columns.append(pa.array([raw[8 * i : 8 * j] for i, j in zip(lo.tolist(), hi.tolist())], pa.binary()))
                names.append("words")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, "anchor long, segment long, doc_id long, whole long, start int, n int" + ", words binary" * texts)


_FOUND = pa.schema([("segment", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("holder", pa.int64())])


def _earlier(texts: list[np.ndarray], first: np.ndarray, last: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(text, position, run of windows, smallest holder) of windows that have a holder before some document with that text."""
    index = FMIndex(texts, window)
    length, low, high = index.matching_statistics(texts)
    full = np.flatnonzero(length >= window)
    if not len(full):
        return (np.zeros(0, np.int64),) * 4
    holder = first[np.searchsorted(index.begin, index.sa, "right") - 1]
    # Rows of a full match are one group of rows with a common prefix of that length.
    groups = np.flatnonzero(index.lcp[:-1] < window)
    least = np.minimum.reduceat(holder, groups)[np.searchsorted(groups, low[full], "right") - 1]
    begin = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    text = np.searchsorted(begin, full, "right") - 1
    on = least < last[text]
    text, at, least = text[on], full[on] - begin[text[on]], least[on]
    if not len(at):
        return (np.zeros(0, np.int64),) * 4
    new = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (at[1:] != at[:-1] + 1) | (least[1:] != least[:-1])]))
    return text[new], at[new], np.diff(np.append(new, len(at))), least[new]


def _recurring(rows: DataFrame, window: int, most: int) -> DataFrame:
    """Rows (segment, at, n, holder) of the recurring windows of rows (key, segment, first, last, words), whose keys are streamed in order."""

    def indexed(t: pa.Table) -> pa.Table:
        """Of whole keys, `most` words at a time."""
        key, names = t.column("key").to_numpy(), t.column("segment").to_numpy()
        first, last = t.column("first").to_numpy(), t.column("last").to_numpy()
        texts = [np.frombuffer(x, np.uint64) for x in t.column("words").to_pylist()]
        total = np.cumsum([len(x) for x in texts])
        borders = np.append(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), len(key))
        out, i = [], 0
        while i < len(borders) - 1:
            a = borders[i]
            done = total[a - 1] if a else 0
            j = i + 1
            while j < len(borders) - 1 and total[borders[j + 1] - 1] - done <= most:
                j += 1
            b = borders[j]
            text, at, n, least = _earlier(texts[a:b], first[a:b], last[a:b], window)
            out.append(pa.Table.from_arrays([pa.array(names[a:b][text]), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(least)], schema=_FOUND))
            i = j
        return pa.concat_tables(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += b.column("words").nbytes
            if size > 8 * most:
                t = pa.Table.from_batches(held)
                key = t.column("key").to_numpy()
                cut = int(np.searchsorted(key, key[-1]))
                if cut:
                    yield from indexed(t.slice(0, cut)).to_batches()
                    held = t.slice(cut).combine_chunks().to_batches()
                    size = sum(x.column("words").nbytes for x in held)
        if held:
            yield from indexed(pa.Table.from_batches(held)).to_batches()

    ordered = rows.select("key", "segment", "first", "last", "words").repartition("key").sortWithinPartitions("key", "first")
    return ordered.mapInArrow(run, "segment long, at int, n int, holder long")


def _by_window(rows: DataFrame, window: int) -> DataFrame:
    """Segments of hot anchors as single windows: (segment, key, words, first, last), key and content by the window's own words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                raw = b.column("words")[i].as_py()
                h = np.frombuffer(raw, np.uint64)
                n = len(h) - window + 1
                p, q = _powers(0x2545F4914F6CDD1D, len(h) + 1)
                s = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * p[: len(h)], dtype=np.uint64)])
                key = mix((s[window:] - s[:n]) * q[:n], 37).view(np.int64)
                same = lambda c: pa.array([b.column(c)[i].as_py()] * n, pa.int64())
                yield pa.record_batch([pa.array(key), same("segment"), pa.array(np.arange(n, dtype=np.int32)), same("first"), same("last"), pa.array([raw[8 * j : 8 * (j + window)] for j in range(n)], pa.binary())], ["key", "segment", "place", "first", "last", "words"])

    return rows.select("segment", "first", "last", "words").mapInArrow(run, "key long, segment long, place int, first long, last long, words binary")


def repeats(docs: DataFrame, window: int = WINDOW, hot: int = SHARD) -> DataFrame:
    """Rows (doc_id, whole, lo, hi): ranges of words of docs (doc_id long, text) under windows that start in an earlier document; hot: words of an index; an anchor with more is dealt anew."""
    known = docs.filter("doc_id is not null")
    path = _kept_filter(known, window)
    places = checkpointed(_segments(known, path, window, False))
    distinct = _segments(known, path, window, True).groupBy("anchor", "segment").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.first("words").alias("words"))
    counts = places.groupBy("anchor", "segment").agg(F.max("n").alias("n")).groupBy("anchor").agg(F.sum("n").alias("n"))
    many = checkpointed(counts.filter(F.col("n") > hot).select("anchor"))
    hot_ids = many.limit(1).count() > 0
    usual = distinct.join(many, "anchor", "left_anti") if hot_ids else distinct
    found = _recurring(usual.withColumnRenamed("anchor", "key"), window, hot)
    if hot_ids:
        single = _by_window(distinct.join(many, "anchor", "left_semi"), window)
        whole = single.groupBy("key").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.first("words").alias("words")).filter("first < last")
        least = _recurring(whole.withColumn("segment", F.col("key")), window, hot)
        back = single.select("key", F.col("segment").alias("of"), "place").join(least, F.col("key") == least["segment"])
        found = found.unionByName(back.select(F.col("of").alias("segment"), F.col("place").alias("at"), F.lit(1).alias("n"), "holder"))
    hits = places.select("segment", "doc_id", "whole", "start").join(found, "segment").filter(F.col("holder") < F.col("doc_id"))
    return hits.select("doc_id", "whole", (F.col("start") + F.col("at")).alias("lo"), (F.col("start") + F.col("at") + F.col("n") - 1 + window).alias("hi"))


def dedup(docs: DataFrame, window: int = WINDOW, hot: int = SHARD) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, removed, kept): removed holds ranges of words (lo, hi); kept is the other words, joined by a space."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spans = repeats(docs, window, hot).groupBy("doc_id").agg(F.collect_list(F.struct("whole", "lo", "hi")).alias("spans"))
    both = docs.join(spans.withColumnRenamed("doc_id", "_doc"), F.col("doc_id") == F.col("_doc"), "left").select("doc_id", "text", "spans")
    pair = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            w = words(b.column("text"))
            whole, n_docs = _whole(w).view(np.int64), b.num_rows
            change = np.zeros(len(w.hashes) + 1, np.int64)
            lists = b.column("spans")
            owner = np.repeat(np.arange(n_docs), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            flat = lists.flatten()
            if len(flat):
                mine = flat.field("whole").to_numpy() == whole[owner]
                base = w.ptr[owner[mine]]
                np.add.at(change, base + flat.field("lo").to_numpy()[mine], 1)
                np.add.at(change, base + flat.field("hi").to_numpy()[mine], -1)
            gone = np.cumsum(change)[:-1] > 0
            doc = w.doc_of()
            n_words, n_gone = np.diff(w.ptr), np.bincount(doc[gone], minlength=n_docs)
            keep = np.flatnonzero(~gone)
            # The kept words' bytes, and after each but a document's last one a space.
            own = doc[keep]
            more = np.append(own[1:] == own[:-1], False) if len(keep) else np.zeros(0, bool)
            size = w.end[keep] - w.start[keep] + more
            at = np.repeat(w.start[keep] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            raw = np.append(w.buf, np.uint8(32))[at]
            raw[(np.cumsum(size) - 1)[more]] = 32
            off = np.concatenate([[0], np.cumsum(np.bincount(own, size, n_docs).astype(np.int64))])
            kept = pa.Array.from_buffers(pa.large_string(), n_docs, [None, pa.py_buffer(off.astype(np.int64).tobytes()), pa.py_buffer(raw.tobytes())]).cast(pa.string())
            edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])) != 0)
            # Ranges end at document borders too.
            inner = w.ptr[1:-1][(w.ptr[1:-1] > 0) & (w.ptr[1:-1] < len(gone))]
            inner = np.unique(inner[gone[inner] & gone[inner - 1]]) if len(gone) else inner
            edge = np.sort(np.concatenate([edge, inner, inner]))
            lo, hi = edge[::2], edge[1::2]
            of = doc[lo] if len(lo) else lo
            ranges = pa.StructArray.from_arrays([pa.array((lo - w.ptr[of]).astype(np.int32)), pa.array((hi - w.ptr[of]).astype(np.int32))], ["lo", "hi"])
            removed = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n_docs + 1)).astype(np.int32)), ranges).cast(pair)
            yield pa.record_batch([b.column("doc_id"), pa.array(n_words.astype(np.int64)), pa.array(n_gone.astype(np.int64)), removed, kept], ["doc_id", "n_words", "n_removed", "removed", "kept"])

    return both.mapInArrow(run, "doc_id long, n_words long, n_removed long, removed array<struct<lo:int,hi:int>>, kept string")
