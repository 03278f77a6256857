"""Token-ID output: Arrow IPC files of equal-length sequences, and reading them back.

Documents are range-partitioned by doc_id, so files in order hold documents in ascending doc_id
order. Each file is in Arrow's random-access file format: record batches of (ids, mask), both
fixed-size lists of `length` values, so sequence i is a view of the mapped file, without a copy.
Tokens of a file's documents follow each other without gaps; the last sequence is filled with
zeros under mask 0. Beside each file lies an index (doc_id, start in the file, n_tokens), as the
end id may also occur inside a text. Ids are 16 bits wide where the vocabulary allows.

A file is written under a temporary name and then moved, so a repeated or speculative task
replaces it by the same content. Folders are reached through pyarrow's file systems.

Defined results: a null text is empty and gives the end id alone; null doc_ids come first;
repeated doc_ids each have their place, ordered by text; an empty table gives no files and no
rows; other columns are not read.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import Memo, byte_sizes, chunks, hashed, not_single_spaced, opened, ragged, words

LENGTH, BATCH = 1024, 256
#: Entries that a worker's memo of encoded words may hold; it starts anew beyond.
MEMO = 3_000_000
_MEMO: dict[str, Memo] = {}
#: Marks that are pre-tokens of their own after a letter at a word's end.
_MARKS = b".,;:!?"
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[list(_MARKS)] = True
_SPACE = np.zeros(256, bool)
_SPACE[[*range(9, 14), *range(28, 32)]] = True


class Encoder:
    """Byte-level BPE of the tokenizers library with a memo of words.

    A text is cut before each space if each stands between two other characters than white space:
    byte-level pre-tokens never reach across such a place, so the parts' ids joined are the text's
    ids. Other texts are encoded in one piece.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = special_as_text
        size = self.tok.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.leads = np.zeros(size, bool)
        self.leads[[i for t, i in self.tok.get_vocab().items() if t.startswith("Ġ")]] = True
        self.marks = np.zeros(256, self.dtype)
        for m in _MARKS:
            self.marks[m] = self._ids([chr(m)])[0][0]
        self.key = f"{path} {special_as_text}"

    _loaded: dict[tuple[str, bool], "Encoder"] = {}

    @classmethod
    def load(cls, path: str, special_as_text: bool = False) -> "Encoder":
        """One encoder per worker and setting."""
        if (path, special_as_text) not in cls._loaded:
            cls._loaded[path, special_as_text] = cls(path, special_as_text)
        return cls._loaded[path, special_as_text]

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, raw: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of n words, each after a space, and how many each has: a word's first id is of a token that begins with the space."""
        text = raw.decode()
        ids = self._ids([text])[0]
        begin = np.flatnonzero(self.leads[ids])
        if len(begin) == n:
            return ids, np.diff(np.append(begin, len(ids)))
        parts = self._ids([" " + w for w in text[1:].split(" ")])
        return np.concatenate(parts), np.array([len(p) for p in parts])

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all whole texts, one after the other, and how many each has."""
        memo = _MEMO.get(self.key)
        if memo is None or len(memo.hashes) > MEMO:
            memo = _MEMO[self.key] = Memo(self.dtype)
        w = words(texts, b" ")
        buf, start, end, ptr, n_docs = w.buf, w.start, w.end, w.ptr, len(texts)
        size = byte_sizes(texts)
        begin = np.cumsum(size + 1) - size
        doc = w.doc_of()
        whole = not_single_spaced(w, size) | self._odd(buf, start, end, begin, size, doc)
        first = np.zeros(len(start), bool)
        first[ptr[:-1][ptr[:-1] < ptr[1:]]] = True
        use = np.flatnonzero(~first & ~whole[doc])
        last = buf[end[use] - 1]
        cut = _MARK[last] & _LETTER[buf[np.maximum(end[use] - 2, 0)]] & (end[use] - start[use] > 1)
        h = hashed(buf, start[use], end[use] - cut)
        distinct, at, back = np.unique(h, return_index=True, return_inverse=True)
        new = np.flatnonzero(memo.find(distinct) < 0)
        for i in range(0, len(new), 20_000):
            some = new[i : i + 20_000]
            a, b = start[use[at[some]]] - 1, (end[use] - cut)[at[some]]
            memo.add(distinct[some], *self._encode(buf[ragged(a, b - a)].tobytes(), len(some)))
        place = memo.find(distinct)[back]
        n = memo.n[place]
        heads = [t[: t.find(" ")] if not odd and " " in t else t for t, odd in zip(texts.fill_null("").to_pylist(), whole)]
        heads = self._ids(heads)
        # Each text is its head's ids and then its words' ids, with the mark's where one was cut off.
        n_head = np.array([len(x) for x in heads], np.int64)
        total = n_head + np.bincount(doc[use], n + cut, n_docs).astype(np.int64)
        to = np.cumsum(total) - total
        out = np.empty(int(total.sum()), self.dtype)
        out[ragged(to, n_head)] = np.concatenate([np.zeros(0, self.dtype), *heads])
        ends = np.cumsum(n + cut)
        before = np.concatenate([[0], np.cumsum(np.bincount(doc[use], n + cut, n_docs).astype(np.int64))])[:-1]
        put = ends - (n + cut) + (to + n_head - before)[doc[use]]
        out[ragged(put, n)] = memo.ids[ragged(memo.at[place], n)]
        out[(put + n)[cut]] = self.marks[last[cut]]
        return out, total

    @staticmethod
    def _odd(buf, start, end, begin, size, doc) -> np.ndarray:
        """Texts with white space beside a space, or outside ASCII."""
        odd = np.zeros(len(size), bool)
        odd[doc[_SPACE[buf[start]] | _SPACE[buf[end - 1]]]] = True
        # White space outside ASCII, wherever it stands.
        lead = np.flatnonzero((buf == 0xC2) | (buf >= 0xE1) & (buf <= 0xE3))
        lead = lead[lead + 1 < len(buf)]
        if len(lead):
            a, b, c = buf[lead], buf[lead + 1], buf[np.minimum(lead + 2, len(buf) - 1)]
            found = (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & ((b == 0x9A) & (c == 0x80) | (b == 0xA0) & (c == 0x8E))
            found |= (a == 0xE2) & ((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F)) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
            odd[np.searchsorted(begin, lead[found], "right") - 1] = True
        return odd


class _Writer:
    """Cuts a stream of ids into sequences and writes record batches of them."""

    def __init__(self, sink, dtype: np.dtype, length: int, batch: int):
        self.length, self.batch, self.dtype, self.rest, self.n = length, batch, dtype, [], 0
        value = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(value, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.out = pa.ipc.new_file(sink, self.schema)

    def add(self, ids: np.ndarray) -> None:
        self.rest.append(ids)
        self.n += len(ids)
        if self.n >= self.length * self.batch:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate([np.zeros(0, self.dtype), *self.rest])
        step = self.length * self.batch
        full = len(ids) if last else len(ids) // step * step
        for i in range(0, full, step):
            part = ids[i : min(i + step, full)]
            pad = -len(part) % self.length
            mask = np.ones(len(part) + pad, bool)
            if pad:
                part = np.concatenate([part, np.zeros(pad, self.dtype)])
                mask[-pad:] = False
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (part, mask)]
            self.out.write_batch(pa.record_batch(lists, schema=self.schema))
        self.rest = [ids[full:].copy()]
        self.n = len(ids) - full

    def close(self) -> None:
        self._flush(True)
        self.out.close()


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 0, length: int = LENGTH, batch: int = BATCH, special_as_text: bool = False) -> list[dict]:
    """Encodes docs (doc_id, text) into files below path; returns one entry per file, in order: part, docs, tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        files, top = opened(path)
        files.create_dir(top, recursive=True)
        enc, writer, sink, index, at = Encoder.load(tokenizer, special_as_text), None, None, [], 0
        temp = f"{top}/_temporary-{part:06d}-{uuid.uuid4().hex}"
        for b in chunks(batches):
            if writer is None:
                sink = files.open_output_stream(temp)
                writer = _Writer(sink, enc.dtype, length, batch)
            ids, sizes = enc(b.column("text"))
            if end_id is not None:
                ids = np.insert(ids, np.cumsum(sizes), np.array(end_id, enc.dtype))
                sizes = sizes + 1
            writer.add(ids)
            start = at + np.cumsum(sizes) - sizes
            at += int(sizes.sum())
            index.append(pa.record_batch([b.column("doc_id").cast(pa.int64()), pa.array(start), pa.array(sizes)], ["doc_id", "start", "n_tokens"]))
        if writer is not None:
            writer.close()
            sink.close()
            with files.open_output_stream(f"{temp}-index") as f, pa.ipc.new_file(f, index[0].schema) as w:
                for x in index:
                    w.write_batch(x)
            files.move(f"{temp}-index", f"{top}/part-{part:06d}.index.arrow")
            files.move(temp, f"{top}/part-{part:06d}.arrow")
            yield pa.record_batch([pa.array([v], pa.int64()) for v in (part, sum(x.num_rows for x in index), at)], ["part", "docs", "tokens"])

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows = ordered.mapInArrow(run, "part long, docs long, tokens long").collect()
    return sorted((r.asDict() for r in rows), key=lambda r: r["part"])


class SequenceFile:
    """Random access to one file: sequence i, or any range of the file's token stream."""

    def __init__(self, uri: str):
        files, path = opened(uri)
        self._source = pa.memory_map(path) if isinstance(files, fs.LocalFileSystem) else files.open_input_file(path)
        self._file = pa.ipc.open_file(self._source)
        self.length = self._file.schema.field("ids").type.list_size
        self._at, self._batch = -1, None
        first = self._get(0) if self._file.num_record_batches else None
        self._rows = first.num_rows if first is not None else 0

    def _get(self, k: int) -> pa.RecordBatch:
        if k != self._at:
            self._at, self._batch = k, self._file.get_batch(k)
        return self._batch

    def _flat(self, k: int, column: str) -> np.ndarray:
        a = self._get(k).column(column)
        return a.flatten().to_numpy(zero_copy_only=column == "ids")

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (a view of the file) and mask of sequence i."""
        k, j = divmod(i, self._rows)
        cut = slice(j * self.length, (j + 1) * self.length)
        return self._flat(k, "ids")[cut], self._flat(k, "mask")[cut]

    def tokens(self, start: int, n: int) -> np.ndarray:
        step, out = self._rows * self.length, []
        while n > 0:
            k, j = divmod(start, step)
            got = self._flat(k, "ids")[j : j + n]
            out.append(got)
            start, n = start + len(got), n - len(got)
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.uint16)


def read(spark, path: str, parts: list[dict]) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) of the written files; start counts over all files."""
    before, at = {}, 0
    for k, p in enumerate(parts):
        before[k] = (p["part"], at)
        at += p["tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column("id").to_pylist():
                part, base = before[k]
                name = f"{path}/part-{part:06d}"
                files, index = opened(f"{name}.index.arrow")
                seqs = SequenceFile(f"{name}.arrow")
                with files.open_input_file(index) as f:
                    reader = pa.ipc.open_file(f)
                    for i in range(reader.num_record_batches):
                        x = reader.get_batch(i)
                        crc = [zlib.crc32(seqs.tokens(s, n).astype("<u4").tobytes()) for s, n in zip(x.column("start").to_pylist(), x.column("n_tokens").to_pylist())]
                        yield pa.record_batch([x.column("doc_id"), pc.add(x.column("start"), base), x.column("n_tokens"), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.range(0, len(parts), 1, max(1, len(parts))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
