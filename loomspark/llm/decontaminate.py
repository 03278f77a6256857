"""Benchmark decontamination: a BM25 inverted index of test items, block-max pruning, verified overlap.

Every text is cut into passages of SPAN times the longest item's words, each half over the next, so
any copy of an item lies whole in some passage. For each passage all items are retrieved whose
BM25 score (every distinct passage word as a query term) reaches the item's own cutoff: its score
against itself, less what the dearest words of a fifth of its five-word runs could take away.
An item that shares four fifths of its runs with a passage therefore is never missed.

Retrieval is block-max pruned, over many passages at once. Common terms whose weights alone can't
reach any cutoff are left out of the first step (their sum only lowers the cutoffs); bounds of
blocks of items are added up from the blocks' largest weights, and items of blocks whose bound
reaches 1 (weights are in units of the cutoff) are scored exactly. Retrieved items are then verified by shared five-word
runs of the passage with the item's question and answer together (SIMILARITY of all runs at least),
and by the question and the answer each: one of its runs at least, or all its words in a row if they
are fewer than five. Items come as question and answer, or as one text, whose last quarter of words
then counts as the answer.

The items are cut into shards of at most SHARD_WORDS words; each shard is broadcast by itself, a worker
builds its index once, and texts are read by themselves, without a shuffle of texts.

Defined results: null texts are empty; an item with fewer than five words is one run of all of
them; one without words is never found, nor is an empty question or answer asked for; rows that repeat
an item_id are items of their own, listed once each; null item_ids are dropped; repeated rows of texts
each get their own result; of passages with equal shares the first is named; without items nothing is
contaminated; other columns pass through untouched, but one named like the added one is replaced, so a
caller can name that; a very long text is one chunk and is held by one task.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import chunks, folded_words

GRAM, SIMILARITY = 5, 0.8
K1, B = 1.2, 0.75
SPAN = 3
BLOCK = 16
SHARD_WORDS = 2_000_000
#: Indexes that a worker keeps; a job over more shards builds them in turn.
KEPT = 4


def _runs(h: np.ndarray, n: int = GRAM) -> list[tuple[int, ...]]:
    """Runs of n words; of fewer words, all of them."""
    h = h.tolist()
    return [tuple(h[i : i + n]) for i in range(max(1, len(h) - n + 1))] if h else []


class Index:
    """BM25 index of one shard of items: (item_id, question, answer)."""

    def __init__(self, items: list[tuple[int, str, str]]):
        w = folded_words(pa.array([x for _, q, a in items for x in (q, a)], pa.large_string()))
        self.items = []
        for k, (item, _, _) in enumerate(items):
            q, a = (w.hashes[w.ptr[2 * k + j] : w.ptr[2 * k + j + 1]] for j in (0, 1))
            if len(q) + len(a):
                self.items.append((item, q, a))
        self.items.sort(key=lambda x: (len(x[1]) + len(x[2]), x[0]))
        self.longest = max((len(q) + len(a) for _, q, a in self.items), default=0)
        n, df, length = len(self.items), Counter(), []
        bags = []
        for _, q, a in self.items:
            bag = Counter(np.concatenate([q, a]).tolist())
            bags.append(bag)
            df.update(bag.keys())
            length.append(sum(bag.values()))
        mean = sum(length) / max(1, n)
        idf = {t: math.log(1 + (n - c + 0.5) / (c + 0.5)) for t, c in df.items()}
        weights, cutoff = [], []
        for bag, m in zip(bags, length):
            weights.append({t: idf[t] * c * (K1 + 1) / (c + K1 * (1 - B + B * m / mean)) for t, c in bag.items()})
            runs = max(1, m - GRAM + 1)
            lost = sorted(weights[-1].values(), reverse=True)[: runs - math.ceil(SIMILARITY * runs - 1e-9)]
            cutoff.append(max(1e-9, sum(weights[-1].values()) - sum(lost)) * (1 - 1e-9))
        # The most common terms that by themselves reach no item's cutoff need not be looked for.
        common, plain = set(), [0.0] * n
        holders: dict[int, list[int]] = {}
        for i, x in enumerate(weights):
            for t in x:
                holders.setdefault(t, []).append(i)
        for t in sorted(df, key=lambda t: (-df[t], t)):
            if any(plain[i] + weights[i][t] >= 0.5 * cutoff[i] for i in holders[t]):
                break
            common.add(t)
            for i in holders[t]:
                plain[i] += weights[i][t]
        self.terms = np.array(sorted(t for t in df if t not in common), np.uint64)
        place = {t: k for k, t in enumerate(self.terms.tolist())}
        left = [c - p for c, p in zip(cutoff, plain)]
        self.rare = [{place[t]: v / left[i] for t, v in x.items() if t in place} for i, x in enumerate(weights)]
        self.full = [{t: v / cutoff[i] for t, v in x.items()} for i, x in enumerate(weights)]
        # Block-max postings of the rare terms: term k has entries ptr[k] to ptr[k + 1] of (block, largest weight).
        self.n_blocks = -(-n // BLOCK)
        best: dict[tuple[int, int], float] = {}
        for i, x in enumerate(self.rare):
            for k, v in x.items():
                best[k, i // BLOCK] = max(v, best.get((k, i // BLOCK), 0.0))
        keys = sorted(best)
        self.block = np.array([b for _, b in keys], np.int64)
        self.most = np.array([best[k] for k in keys])
        self.ptr = np.searchsorted(np.array([k for k, _ in keys], np.int64), np.arange(len(self.terms) + 1))
        self.runs = [(set(_runs(np.concatenate([q, a]))), [(min(len(x), GRAM), set(_runs(x))) for x in (q, a) if len(x)]) for _, q, a in self.items]

    _held: dict[str, "Index"] = {}

    @classmethod
    def load(cls, name: str, items) -> "Index":
        """A shard's index, built once by a worker; items() gives the shard."""
        if name not in cls._held:
            while len(cls._held) >= KEPT:
                del cls._held[next(iter(cls._held))]
            cls._held[name] = cls(items())
        return cls._held[name]

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each word among the rare terms, or -1."""
        if not len(self.terms):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)

    def search(self, w) -> Iterator[tuple[int, int, float, float, int, int]]:
        """(document's position, item's position, shared share of the runs, BM25 score in cutoffs, first and last word) of each verified item of each passage."""
        stride = max(1, self.longest * SPAN // 2)
        term = self.lookup(w.hashes)
        hit = np.flatnonzero(term >= 0)
        if not len(hit):
            return
        doc = w.doc_of()[hit]
        own = (hit - w.ptr[doc]) // stride
        # A word lies in the passage that begins in its stride and in the one before; passages are numbered over all documents.
        first = np.concatenate([[0], np.cumsum(np.diff(w.ptr) // stride + 1)])
        passage = first[doc] + own
        before = np.flatnonzero(own > 0)
        passage, k = np.concatenate([passage, passage[before] - 1]), np.concatenate([term[hit], term[hit[before]]])
        # A repeated term counts once in a passage.
        key = np.unique(passage * len(self.terms) + k)
        passage, k = key // len(self.terms), key % len(self.terms)
        n = self.ptr[k + 1] - self.ptr[k]
        entry = np.repeat(self.ptr[k] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        cell = np.repeat(passage, n) * self.n_blocks + self.block[entry]
        cells, at = np.unique(cell, return_inverse=True)
        bound = np.bincount(at, self.most[entry], len(cells))
        for c in cells[bound >= 1 - 1e-9].tolist():
            p, b = divmod(c, self.n_blocks)
            d = int(np.searchsorted(first, p, "right")) - 1
            lo = int(w.ptr[d]) + (p - int(first[d])) * stride
            hi = min(lo + 2 * stride, int(w.ptr[d + 1]))
            own = w.hashes[lo:hi]
            have = set(own.tolist())
            runs: dict[int, set] = {}

            def said(n: int) -> set:
                if n not in runs:
                    runs[n] = set(_runs(own, n)) if len(own) >= n else set()
                return runs[n]

            for i in range(b * BLOCK, min((b + 1) * BLOCK, len(self.items))):
                score = sum(v for t, v in self.full[i].items() if t in have)
                if score < 1 - 1e-9:
                    continue
                every, parts = self.runs[i]
                share = len(every & said(min(GRAM, len(self.items[i][1]) + len(self.items[i][2])))) / len(every)
                if share >= SIMILARITY - 1e-9 and all(x & said(n) for n, x in parts):
                    yield d, i, share, score, lo - int(w.ptr[d]), hi - int(w.ptr[d])


def split_items(items: DataFrame) -> DataFrame:
    """item_id, question, answer of items that may have only a text."""
    if {"question", "answer"} <= set(items.columns):
        return items.select("item_id", F.coalesce("question", F.lit("")).alias("question"), F.coalesce("answer", F.lit("")).alias("answer"))
    parts = F.split(F.coalesce(F.col("text"), F.lit("")), r"\s+")
    n = F.size(parts)
    cut = n - F.greatest(F.floor(n / 4), F.lit(0)).cast("int")
    return items.select(
        "item_id",
        F.array_join(F.slice(parts, F.lit(1), cut), " ").alias("question"),
        F.array_join(F.slice(parts, cut + 1, n), " ").alias("answer"),
    )


def shards(items: DataFrame, most: int = SHARD_WORDS) -> Iterator[list[tuple[int, str, str]]]:
    """The items in shards of at most `most` words, streamed to the driver one partition at a time."""
    rows, n = [], 0
    for r in split_items(items).filter("item_id is not null").toLocalIterator():
        size = len(r["question"].split()) + len(r["answer"].split())
        if rows and n + size > most:
            yield rows
            rows, n = [], 0
        rows.append((r["item_id"], r["question"], r["answer"]))
        n += size
    if rows:
        yield rows


_KIND = pa.list_(pa.struct([("item_id", pa.int64()), ("share", pa.float64()), ("score", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64())]))


def leaks(docs: DataFrame, items: DataFrame, to: str = "leaked_items") -> DataFrame:
    """docs with leaked_items: array of (item_id, share, score, first_word, last_word), the best passage of each found item, by item_id and then place."""
    ddl = "array<struct<item_id:long,share:double,score:double,first_word:long,last_word:long>>"
    out = docs.withColumn(to, F.array().cast(ddl))
    for shard in shards(items):
        out = _against(out, shard, to)
    return out


def _against(docs: DataFrame, shard: list[tuple[int, str, str]], to: str) -> DataFrame:
    shared, name = docs.sparkSession.sparkContext.broadcast(shard), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index.load(name, lambda: shared.value)
        for b in chunks(batches):
            found: list[dict] = [{} for _ in range(b.num_rows)]
            for d, i, share, score, lo, hi in index.search(folded_words(b.column("text"))):
                if share > found[d].get(i, {"share": 0})["share"]:
                    found[d][i] = {"item_id": index.items[i][0], "share": share, "score": score, "first_word": lo, "last_word": hi}
            old = b.column(to).to_pylist()
            rows = [sorted(o + list(f.values()), key=lambda x: (x["item_id"], x["first_word"])) for o, f in zip(old, found)]
            yield pa.RecordBatch.from_arrays([c if n != to else pa.array(rows, _KIND) for n, c in zip(b.schema.names, b.columns)], names=b.schema.names)

    return docs.mapInArrow(run, docs.schema)
