"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

Counting: each task turns its training texts into token and bigram hashes, sorts and counts them in
bounded batches, and sends sorted runs to buckets by the hashes' top bits, so a frequent n-gram arrives
once per batch, not once per occurrence. A bucket adds its runs up and fills its own segment of the
filter: an n-gram whose count is c is stored for each level 0 to floor(log_RATIO c). Segments take
BITS bits per stored entry at any size. Workers map the segments from the shared folder. Where they are
more than MAX_FILTER bytes in all, workers map those of single tokens only, and the bigrams are routed.

Scoring: the level of an n-gram is found by probing level after level until one is missing; a level
stands for the mean of its counts. With c of the probed levels, P0(w) = (1 - u) c(w) / sum of c for
known tokens and u, the share of training tokens seen once, for unknown ones; then
P(w | h) = (c(h w) + PRIOR P0(w)) / (c(h) + PRIOR). The first token of a text has P0.

Routed bigrams: the most frequent of each bucket, at most HEAVY in all, go to all workers with the levels that
the filter gives them; the others are sent, with the levels of h and w, to the buckets that hold their
segments, and the parts of a text's score are added up by its row, like those of the base score.

The base score needs exact counts. Tokens of the highest counts, at most HEAVY of them, go to all
workers; the other tokens of each text are sent, as runs, to the buckets that hold their counts, and the
parts of a text are added up by its row.

Words are identified by 64-bit hashes, bigrams by 48 bits of theirs.

Defined results: a null or empty text has one token, the end; null doc_ids count as an empty text
for the fold; repeated rows each count and each get a row; without training tokens N and V are 0, the base
score is 0 - log10(1) for each token, and the model gives unknown tokens probability 1; an empty table gives no rows.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.common import chunks, mix, opened, shared_dir, words

RATIO = 1.5
BITS, PROBES = 12, 4
#: Bytes of segments that workers map whole; larger filters are probed where their segments are.
MAX_FILTER = 256 << 20
HEAVY = 1 << 21
#: Tokens that a task counts at once, and rare tokens or bigrams that it sends on at once.
BATCH, RARE_BATCH = 2_000_000, 1_000_000
PRIOR = 300.0
BEGIN, END = np.uint64(0x5BD1E995A3C4F00D), np.uint64(0x27D4EB2F165667C5)
_LEVELS = 110
_BOUNDS = np.array([math.ceil(RATIO**q - 1e-9) for q in range(_LEVELS + 1)], np.float64)
#: The mean of the counts of each level.
_VALUE = np.where(_BOUNDS[1:] > _BOUNDS[:-1], (_BOUNDS[:-1] + _BOUNDS[1:] - 1) / 2, _BOUNDS[:-1])


def level(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(_BOUNDS[1:], counts, "right")


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, each text's end among them; where texts begin; the bigram that ends at each token."""
    w = words(texts, lower_ascii=True)
    h = np.insert(w.hashes, w.ptr[1:], END)
    ptr = w.ptr + np.arange(len(w.ptr))
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[ptr[:-1]] = BEGIN
    return h, ptr, mix(before * np.uint64(0x9FB21C651E98DF25) + h, 3)


def _counted(parts: list[np.ndarray], weights: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, ascending, and how often they occur."""
    x = np.concatenate(parts)
    if weights is None:
        x.sort()
        new = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
        return x[new], np.diff(np.append(new, len(x)))
    order = np.argsort(x, kind="stable")
    x = x[order]
    new = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return x[new], np.add.reduceat(np.concatenate(weights)[order], new) if len(x) else np.zeros(0, np.int64)


def _thin(h: np.ndarray, order: int) -> bytes:
    """Bytes of hashes; of bigrams the upper 48 bits."""
    return h.tobytes() if order == 1 else np.ascontiguousarray(h.view(np.uint16).reshape(-1, 4)[:, 1:]).tobytes()


def _thick(raw: bytes, order: int) -> np.ndarray:
    if order == 1:
        return np.frombuffer(raw, np.uint64)
    x = np.zeros((len(raw) // 6, 4), np.uint16)
    x[:, 1:] = np.frombuffer(raw, np.uint16).reshape(-1, 3)
    return x.reshape(-1).view(np.uint64)


def _edges(h: np.ndarray, bits: int) -> np.ndarray:
    """Where each bucket begins in ascending hashes."""
    return np.append(np.searchsorted(h, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)), len(h))


_RUN = pa.schema([("gram", pa.int32()), ("bucket", pa.int64()), ("once", pa.binary()), ("more", pa.binary()), ("counts", pa.binary())])


def _runs(docs: DataFrame, bits: int) -> DataFrame:
    """Sorted runs of counted n-grams, by order and bucket."""

    def rows(h: list[np.ndarray], order: int) -> Iterator[pa.RecordBatch]:
        x, n = _counted(h)
        out, edges = [], _edges(x, bits)
        for b, (i, j) in enumerate(zip(edges, edges[1:])):
            if j > i:
                one = n[i:j] == 1
                out.append({"gram": order, "bucket": b, "once": _thin(x[i:j][one], order), "more": _thin(x[i:j][~one], order), "counts": n[i:j][~one].astype(np.int64).tobytes()})
        for k in range(0, len(out), 512):
            yield pa.RecordBatch.from_pylist(out[k : k + 512], schema=_RUN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])
        n = 0
        for b in chunks(batches):
            h, _, pairs = tokens(b.column("text"))
            held[0].append(h)
            held[1].append(pairs)
            n += len(h)
            if n >= BATCH:
                for k in (0, 1):
                    yield from rows(held[k], k + 1)
                held, n = ([], []), 0
        if n:
            for k in (0, 1):
                yield from rows(held[k], k + 1)

    return docs.select("text").mapInArrow(run, "gram int, bucket long, once binary, more binary, counts binary")


def _positions(h: np.ndarray, q: int, i: int, size: np.ndarray) -> np.ndarray:
    """Bit of probe i for level q in a segment of `size` bits."""
    x = mix(h ^ np.uint64((q * 0x9E3779B97F4A7C15 + i * 0xD6E8FEB86659FD93) & (1 << 64) - 1), 11)
    return ((x >> np.uint64(32)) * size) >> np.uint64(32)


_SEGMENT = pa.schema([("gram", pa.int32()), ("bucket", pa.int64()), ("tokens", pa.int64()), ("distinct", pa.int64()), ("once", pa.int64()), ("quantised", pa.float64()), ("levels", pa.list_(pa.int64())), ("size", pa.int64()), ("segment", pa.binary()), ("hashes", pa.binary()), ("counts", pa.binary())])
_SEGMENT_DDL = "gram int, bucket long, tokens long, distinct long, once long, quantised double, levels array<long>, size long, segment binary, hashes binary, counts binary"


def _segment(frequent: int):
    """Makes a bucket's segment; of single tokens hashes and counts are kept, of bigrams the hashes of the `frequent` most frequent and their levels in the filter."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        order, bucket = key[0].as_py(), key[1].as_py()
        parts, weights = [], []
        for r in t.to_pylist():
            one, more = _thick(r["once"], order), _thick(r["more"], order)
            parts += [one, more]
            weights += [np.ones(len(one), np.int64), np.frombuffer(r["counts"], np.int64)]
        h, n = _counted(parts, weights)
        q = level(n)
        size = max(64, int((q + 1).sum()) * BITS + 7 & ~7)
        if size >= 1 << 32:
            raise ValueError("a segment of 2^32 bits or more: the texts need more partitions")
        bits = np.zeros(size, bool)
        active, rest = h, q
        j = 0
        while len(active):
            for i in range(PROBES):
                bits[_positions(active, j, i, np.uint64(size)).astype(np.int64)] = True
            keep = rest > j
            active, rest, j = active[keep], rest[keep], j + 1
        row = {"gram": order, "bucket": bucket, "tokens": int(n.sum()), "distinct": len(h), "once": int((n == 1).sum()), "quantised": float(_VALUE[q].sum()), "levels": np.bincount(q, minlength=_LEVELS).tolist(), "size": size, "segment": np.packbits(bits, bitorder="little").tobytes()}
        if order == 1:
            row |= {"hashes": h.tobytes(), "counts": n.tobytes()}
        else:
            top = np.sort(np.argsort(-q, kind="stable")[:frequent])
            raw = np.frombuffer(row["segment"], np.uint8)
            row |= {"hashes": h[top].tobytes(), "counts": _levels(raw, h[top], np.full(len(top), size, np.uint64), np.zeros(len(top), np.uint64)).astype(np.int8).tobytes()}
        return pa.Table.from_pylist([row], schema=_SEGMENT)

    return run


def _levels(raw: np.ndarray, h: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Level of each n-gram, -1 if unknown, by probing one level after the other in segments of size bits from bit at of raw."""
    out = np.full(len(h), -1, np.int64)
    left = np.arange(len(h))
    j = 0
    keep = size > 0
    while True:
        left, h, size, at = left[keep], h[keep], size[keep], at[keep]
        if not len(left) or j >= _LEVELS:
            return out
        for i in range(PROBES):
            p = at + _positions(h, j, i, size)
            hit = (raw[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
            if not hit.all():
                left, h, size, at = left[hit], h[hit], size[hit], at[hit]
        out[left] = j
        keep, j = np.ones(len(left), bool), j + 1


@dataclass
class Model:
    """What scoring needs besides the segments at path."""

    path: str
    bits: int
    tokens: int
    distinct: int
    once: int
    quantised: float
    heavy: tuple[np.ndarray, np.ndarray]
    complete: bool  # whether heavy holds all known tokens
    pairs: tuple[np.ndarray, np.ndarray] | None = None  # frequent bigrams and their levels, where bigrams are routed


def _flat(path: str) -> str:
    return f"{path}-filter/bits"


def _flattened(spark: SparkSession, path: str, bits: int, orders: tuple[int, ...]) -> None:
    """Copies all segments of the orders, a few at a time, into one file that workers can map, and their sizes and places into one beside it.

    One task copies at most MAX_FILTER bytes, or the segments of single tokens of a larger filter, some
    1.5 bytes a distinct token.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            files, top = opened(path)
            _, to = opened(_flat(path))
            files.create_dir(to.rpartition("/")[0], recursive=True)
            temp, at, places = f"{to}-{uuid.uuid4().hex}", 0, np.zeros((2, 2, 1 << bits), np.uint64)
            with files.open_output_stream(temp) as out:
                for k in orders:
                    for f in sorted(x.path for x in files.get_file_info(fs.FileSelector(f"{top}/gram={k}", allow_not_found=True)) if x.path.endswith(".parquet")):
                        for b in pq.ParquetFile(files.open_input_file(f)).iter_batches(8, columns=["bucket", "size", "segment"]):
                            for r in b.to_pylist():
                                out.write(r["segment"])
                                places[:, k - 1, r["bucket"]] = r["size"], at * 8
                                at += len(r["segment"])
            with files.open_output_stream(f"{temp}.places") as out:
                out.write(places.tobytes())
            files.move(f"{temp}.places", f"{to}.places")
            files.move(temp, to)
            yield pa.record_batch([pa.array([at], pa.int64())], ["bytes"])

    spark.range(0, 1, 1, 1).mapInArrow(run, "bytes long").collect()


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_SEGMENT_DDL).parquet(path)


def train(docs: DataFrame, max_filter: int = MAX_FILTER, heavy: int = HEAVY) -> Model:
    """Counts docs (text) and writes the filter's segments and the tokens' counts to the shared folder."""
    spark = docs.sparkSession
    bits = min(20, max(6, math.ceil(math.log2(max(1, docs.rdd.getNumPartitions()) * 8))))
    path = shared_dir(spark, "ngrams")
    grouped = _runs(docs, bits).groupBy("gram", "bucket")
    made = grouped.applyInArrow(_segment(heavy >> bits), _SEGMENT_DDL)
    made.write.partitionBy("gram").parquet(path)
    stored = _stored(spark, path)
    routed = (stored.agg(F.sum("size")).first()[0] or 0) > max_filter * 8
    _flattened(spark, path, bits, (1,) if routed else (1, 2))
    one = stored.filter("gram = 1")
    total = one.agg(*[F.sum(c).alias(c) for c in ("tokens", "distinct", "once", "quantised")]).first()
    if total["tokens"] is None:
        return Model(path, bits, 0, 0, 0, 0.0, (np.zeros(0, np.uint64), np.zeros(0, np.int64)), True)
    spread = {r["q"]: r["n"] for r in one.select(F.posexplode("levels").alias("q", "n")).groupBy("q").agg(F.sum("n").alias("n")).collect()}
    least, held = _LEVELS, 0
    while least and held + spread.get(least - 1, 0) <= heavy:
        least -= 1
        held += spread.get(least, 0)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h, n in zip(b.column("hashes").to_pylist(), b.column("counts").to_pylist()):
                h, n = np.frombuffer(h, np.uint64), np.frombuffer(n, np.int64)
                keep = level(n) >= least
                yield pa.record_batch([pa.array([h[keep].tobytes()], pa.binary()), pa.array([n[keep].tobytes()], pa.binary())], ["h", "n"])

    rows = one.select("bucket", "hashes", "counts").orderBy("bucket").select("hashes", "counts").mapInArrow(pick, "h binary, n binary").collect()
    h = np.concatenate([np.frombuffer(r["h"], np.uint64) for r in rows])
    n = np.concatenate([np.frombuffer(r["n"], np.int64) for r in rows])
    order = np.argsort(h)
    pairs = None
    if routed:
        rows2 = stored.filter("gram = 2").select("hashes", "counts").collect()
        h2, q2 = (np.concatenate([np.zeros(0, k), *(np.frombuffer(r[c], k) for r in rows2)]) for c, k in (("hashes", np.uint64), ("counts", np.int8)))
        order2 = np.argsort(h2)
        pairs = (h2[order2], q2[order2])
    return Model(path, bits, total["tokens"], total["distinct"], total["once"], total["quantised"], (h[order], n[order].astype(np.uint32 if n.max(initial=0) < 1 << 32 else np.int64)), least == 0, pairs)


class Filter:
    """The segments, mapped or read once per worker."""

    _held: dict[str, "Filter"] = {}

    @classmethod
    def load(cls, path: str, bits: int) -> "Filter":
        if path not in cls._held:
            cls._held.clear()
            cls._held[path] = cls(path, bits)
        return cls._held[path]

    def __init__(self, path: str, bits: int):
        self.shift = np.uint64(64 - bits)
        files, flat = opened(_flat(path))
        # By order and bucket: bits, and the first one's place in the flat file.
        self.size, self.at = np.frombuffer(files.open_input_file(f"{flat}.places").read(), np.uint64).reshape(2, 2, 1 << bits)
        if not self.size.any():
            self.raw = np.zeros(0, np.uint8)
        elif isinstance(files, fs.LocalFileSystem):
            self.raw = np.memmap(flat, np.uint8, "r")
        else:
            self.raw = np.frombuffer(files.open_input_file(flat).read(), np.uint8)

    def levels(self, h: np.ndarray, order: int) -> np.ndarray:
        """Level of each n-gram, -1 if unknown, by probing one level after the other."""
        h = h if order == 1 else h & np.uint64(~0xFFFF & (1 << 64) - 1)
        bucket = (h >> self.shift).astype(np.int64)
        return _levels(self.raw, h, self.size[order - 1][bucket], self.at[order - 1][bucket])


_PART = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"


def score(docs: DataFrame, model: Model, held_out: Column) -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of docs (doc_id, text)."""
    spark = docs.sparkSession
    path, bits, n_all, v_all = model.path, model.bits, model.tokens, model.distinct
    unseen = (model.once + 1) / (n_all + 2)
    mass = model.quantised
    shared = spark.sparkContext.broadcast((model.heavy, model.pairs))
    complete, routed = model.complete, model.pairs is not None
    low = math.log10(n_all + 0.1 * (v_all + 1)) if n_all else -1.0
    routes = bits if routed else max(1, bits - 3)
    kind = pa.schema([("bucket", pa.int64()), ("order", pa.int32()), ("hashes", pa.binary()), ("rows", pa.binary()), ("times", pa.binary()), ("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])

    def chance(q2: np.ndarray, context: np.ndarray, p0: np.ndarray) -> np.ndarray:
        c2 = np.where(q2 >= 0, _VALUE[q2], 0.0)
        return (np.minimum(c2, context) + PRIOR * p0) / (context + PRIOR)

    def alone(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """c and P0 of tokens of levels q."""
        c1 = np.where(q >= 0, _VALUE[q], 0.0)
        return c1, np.where(q >= 0, (1 - unseen) * c1 / max(mass, 1.0), unseen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        (heavy, counts), frequent = shared.value
        known = Filter.load(path, bits)
        first = TaskContext.get().partitionId() << 40
        held: dict[int, list] = {1: [], 2: []}
        n_held = {1: 0, 2: 0}

        def sent(order: int) -> Iterator[pa.RecordBatch]:
            """What is held of an order by route: hashes, rows as steps from the first one, and what is known of each."""
            h, r, n = (np.concatenate([x[k] for x in held[order]]) for k in range(3))
            held[order], n_held[order] = [], 0
            by = np.argsort(h, kind="stable")
            h, r, n = h[by], r[by], n[by]
            edges, least = _edges(h, routes), int(r.min())
            r = (r - least).astype(np.uint32)
            out = [{"bucket": b, "order": order, "hashes": _thin(h[i:j], order), "rows": r[i:j].tobytes(), "times": n[i:j].tobytes(), "row": least} for b, (i, j) in enumerate(zip(edges, edges[1:])) if j > i]
            yield pa.RecordBatch.from_pylist(out, schema=kind)

        def hold(order: int, h: np.ndarray, r: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(h):
                held[order].append((h, r, n))
                n_held[order] += len(h)
            if n_held[order] >= RARE_BATCH:
                yield from sent(order)

        for b in chunks(batches):
            h, ptr, pairs = tokens(b.column("text"))
            n_docs = b.num_rows
            doc = np.repeat(np.arange(n_docs), np.diff(ptr))
            distinct, back = np.unique(h, return_inverse=True)
            q = known.levels(distinct, 1)
            c1, p0 = alone(q)
            context = np.empty(len(h))
            context[1:] = c1[back[:-1]]
            context[ptr[:-1]] = _VALUE[-1]
            start = np.zeros(len(h), bool)
            start[ptr[:-1]] = True
            p0 = p0[back]
            later = np.zeros(len(h), bool)
            if routed:
                # Without a known h, P(w | h) is P0(w) whatever the bigram's level.
                pairs &= np.uint64(~0xFFFF & (1 << 64) - 1)
                q2 = np.full(len(h), -1, np.int64)
                if len(frequent[0]):
                    at = np.minimum(np.searchsorted(frequent[0], pairs), len(frequent[0]) - 1)
                    q2 = np.where(frequent[0][at] == pairs, frequent[1][at], q2)
                later = ~start & (context > 0) & (q2 < 0)
            else:
                q2 = known.levels(pairs, 2)
            p = np.where(later, 1.0, np.where(start, p0, chance(q2, context, p0)))
            score = np.bincount(doc, np.log10(p), n_docs)
            at = np.minimum(np.searchsorted(heavy, distinct), max(0, len(heavy) - 1))
            found = heavy[at] == distinct if len(heavy) else np.zeros(len(distinct), bool)
            exact = np.where(found, counts[at] if len(heavy) else 0, 0).astype(np.float64)
            sure = (found | complete)[back]
            base = np.bincount(doc[sure], (np.log10(exact + 0.1) - low if n_all else np.zeros(len(distinct)))[back][sure], n_docs)
            n_known = np.bincount(doc[found[back]], minlength=n_docs)
            rows = first + np.arange(n_docs)
            first += n_docs
            empty = pa.nulls(n_docs, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(rows % (1 << routes)), pa.nulls(n_docs, pa.int32()), empty, empty, empty, pa.array(rows), b.column("doc_id"), b.column("held_out"), pa.array(np.diff(ptr).astype(np.int64)), pa.array(n_known.astype(np.int64)), pa.array(base), pa.array(score)], schema=kind)
            if not complete:
                rare = np.flatnonzero(~sure)
                order = np.lexsort((back[rare], doc[rare]))
                d, t = doc[rare][order], back[rare][order]
                new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (t[1:] != t[:-1])])) if len(d) else np.zeros(0, np.int64)
                yield from hold(1, distinct[t[new]], rows[d[new]], np.diff(np.append(new, len(d))).astype(np.uint32))
            if later.any():
                i = np.flatnonzero(later)
                q1 = q.astype(np.int8)[back]
                yield from hold(2, pairs[i], rows[doc[i]], np.ascontiguousarray(np.stack([q1[i - 1], q1[i]], 1)).view(np.uint16).ravel())
        for order in (1, 2):
            if n_held[order]:
                yield from sent(order)

    part = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])

    def gathered(runs: pa.Table, order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Hashes, rows and what is known of each, of about RARE_BATCH at a time."""
        held, n = [], 0
        for x in runs.filter(pc.equal(runs.column("order"), order)).select(["hashes", "rows", "times", "row"]).to_batches(64):
            for r in x.to_pylist():
                held.append((_thick(r["hashes"], order), np.frombuffer(r["rows"], np.uint32).astype(np.int64) + r["row"], np.frombuffer(r["times"], np.uint32 if order == 1 else np.uint16)))
                n += len(held[-1][0])
                if n >= RARE_BATCH:
                    yield tuple(np.concatenate(k) for k in zip(*held))
                    held, n = [], 0
        if held:
            yield tuple(np.concatenate(k) for k in zip(*held))

    def partial(rows: np.ndarray, n_known: np.ndarray, base: np.ndarray, score: np.ndarray) -> pa.Table:
        none = lambda t: pa.nulls(len(rows), t)
        return pa.Table.from_arrays([pa.array(rows), none(pa.int64()), none(pa.bool_()), none(pa.int64()), pa.array(n_known), pa.array(base), pa.array(score)], schema=part)

    def resolve(key: tuple[pa.Scalar, ...], mine: pa.Table, table: pa.Table) -> pa.Table:
        runs = mine.filter(pc.is_valid(mine.column("hashes")))
        out = [mine.filter(pc.is_null(mine.column("hashes"))).select(part.names).cast(part)]
        if not runs.num_rows:
            return out[0]
        one, two = (table.filter(pc.equal(table.column("gram"), k)) for k in (1, 2))
        pieces = sorted(zip(one.column("bucket").to_pylist(), one.column("hashes").to_pylist(), one.column("counts").to_pylist()))
        have = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x, np.uint64) for _, x, _ in pieces)])
        counts = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x, np.int64) for _, _, x in pieces)])
        for h, r, n in gathered(runs, 1):
            at = np.minimum(np.searchsorted(have, h), max(0, len(have) - 1))
            found = have[at] == h if len(have) else np.zeros(len(h), bool)
            c = np.where(found, counts[at] if len(have) else 0, 0)
            rows, back = np.unique(r, return_inverse=True)
            out.append(partial(rows, np.bincount(back, n * found, len(rows)).astype(np.int64), np.bincount(back, n * (np.log10(c + 0.1) - low), len(rows)), np.zeros(len(rows))))
        segment = [(s, np.frombuffer(x, np.uint8)) for s, x in zip(two.column("size").to_pylist(), two.column("segment").to_pylist())]
        for h, r, n in gathered(runs, 2):
            # A route of bigrams is one bucket, which has no segment if none of its bigrams was learnt.
            q2 = _levels(segment[0][1], h, np.full(len(h), segment[0][0], np.uint64), np.zeros(len(h), np.uint64)) if segment else np.full(len(h), -1)
            q = n.view(np.int8).reshape(-1, 2)
            p = chance(q2, alone(q[:, 0].astype(np.int64))[0], alone(q[:, 1].astype(np.int64))[1])
            rows, back = np.unique(r, return_inverse=True)
            out.append(partial(rows, np.zeros(len(rows), np.int64), np.zeros(len(rows)), np.bincount(back, np.log10(p), len(rows))))
        return pa.concat_tables(out)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text")
    scored = texts.mapInArrow(run, "bucket long, order int, hashes binary, rows binary, times binary, " + _PART)
    if complete and not routed:
        whole = scored
    else:
        wanted = [k for k, on in ((1, not complete), (2, routed)) if on]
        ones = F.col("gram") == 1
        table = _stored(spark, path).filter(F.col("gram").isin(wanted)).select(F.shiftright("bucket", bits - routes).alias("route"), "gram", "bucket", "size", F.when(~ones, F.col("segment")).alias("segment"), F.when(ones, F.col("hashes")).alias("hashes"), F.when(ones, F.col("counts")).alias("counts"))
        parts = scored.groupBy("bucket").cogroup(table.groupBy("route")).applyInArrow(resolve, _PART)
        whole = parts.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base"), F.sum("score").alias("score"))
    return whole.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
