"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Training takes at most `examples` labelled rows (those with the smallest hash of doc_id), joins
them to their whole texts, keeps one of each family of near copies, and selects the terms whose
presence depends on the label (likelihood-ratio statistic). A term is a lower-cased word, or the
first 4 to 8 letters (PREFIXES) of a longer one. An example's vector holds its selected terms, weighted by
(1 + log tf) * idf and normed. The index keeps, by term and block of examples, the entries and
their largest weight. A text's nearest examples are exact: blocks are taken by falling upper
bound until the bound falls below the k-th similarity found.

The vote is similarity-weighted over the neighbours, drawn towards the rate of toxic ones among examples
without any selected term by a weight of SHRINK. A text without selected terms has that rate as its
score. The score of others is the vote through a logistic curve, which is fitted to the votes that CALIBRATION
of the examples get from the others; with fewer than LEAST examples of either label it is the vote itself.
The model's size is bounded by `examples`; scoring reads each row by itself, without a shuffle.

Defined results: a null text is empty; an empty one has no terms; null doc_ids are scored but
never trained on; repeated labels of a document count once (toxic if any says so), null labels
never; without any labelled row every score is 0.5; ties in similarity go to the smaller example id.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import checkpointed, chunks, mix, trimmed, words

EXAMPLES = 12_000
PREFIXES = (4, 5, 6, 7, 8)
#: Words of which a worker remembers the selected terms; it starts anew beyond.
MEMO = 200_000
#: Text whose terms are listed at once, in bytes, and examples whose terms are looked up at once: lists of terms take many times the bytes of a text.
TERMS_BYTES, PICKED = 1 << 17, 64
NEIGHBOURS = 15
SHRINK = 0.5
#: A term is selected if it is this many times likelier in toxic examples and its likelihood-ratio statistic is this high.
LIFT, EVIDENCE = 3.0, 22.0
#: Examples whose votes the curve is fitted to, and examples of each label that this takes.
CALIBRATION, LEAST = 2000, 20
BLOCK = 32
_WORD = re.compile(r"\w+")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def terms(text: str) -> Counter:
    found = Counter(_WORD.findall(text.lower()))
    for w, n in list(found.items()):
        for k in PREFIXES:
            if len(w) > k:
                found[w[:k] + "*"] += n
    return found


def _families(texts: pa.Array) -> list[int]:
    """A sketch that near copies mostly share: of the two smallest hashes of five words (all words if fewer)."""
    w = words(texts, lower_ascii=True)
    grams, inside = w.grams(5, seed=7)
    out = []
    for a, b in zip(w.ptr[:-1], w.ptr[1:]):
        h = np.unique(grams[a : max(a, b - 4)]) if b - a >= 5 else w.hashes[a:b]
        key = np.uint64(len(h) if b - a < 5 else 5)
        for x in h[:2] if b - a >= 5 else h:
            key = mix(np.array([key ^ x]))[0]
        out.append(int(key.astype(np.int64)))
    return out


class Model:
    """The labelled vectors in a block-max inverted index."""

    def __init__(self, weights: dict[str, float], vectors: list[tuple[int, int, dict[str, float]]], empty: tuple[int, int]):
        """weights: idf of the selected terms. vectors: (doc_id, label, term to weight). empty: toxic and all examples without terms."""
        self.idf = weights
        self.memo: dict[str, tuple[str, ...]] = {}
        self.base = (empty[0] + 0.5) / (empty[1] + 1)
        self.curve: tuple[float, float] | None = None
        # Examples with the same strongest term stand together, so that blocks differ in their bounds.
        vectors = sorted(vectors, key=lambda v: (max(v[2], key=lambda t: (v[2][t], t)), v[0]))
        self.ids, self.labels = [v[0] for v in vectors], np.array([v[1] for v in vectors], float)
        self.n_blocks = -(-len(vectors) // BLOCK)
        entries: dict[str, dict[int, list]] = {}
        for i, (_, _, v) in enumerate(vectors):
            for t, x in v.items():
                entries.setdefault(t, {}).setdefault(i // BLOCK, []).append((i % BLOCK, x))
        self.post = {t: {b: (np.array([p[0] for p in e]), np.array([p[1] for p in e])) for b, e in by.items()} for t, by in entries.items()}
        self.most = {t: np.array([by[b][1].max() if b in by else 0.0 for b in range(self.n_blocks)]) for t, by in self.post.items()}

    def vector(self, text: str) -> dict[str, float]:
        found, memo = _WORD.findall(text.lower()), self.memo
        if len(memo) > MEMO:
            memo.clear()
        for w in set(found).difference(memo):
            own = [w[:k] + "*" for k in PREFIXES if len(w) > k]
            memo[w] = tuple(t for t in (w, *own) if t in self.idf)
        n: Counter = Counter()
        for w in filter(memo.__getitem__, found):
            n.update(memo[w])
        v = {t: (1 + math.log(c)) * self.idf[t] for t, c in n.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    def nearest(self, v: dict[str, float], k: int = NEIGHBOURS) -> list[tuple[float, int]]:
        """The k examples of largest cosine above 0, as (similarity, position)."""
        bound = np.zeros(self.n_blocks)
        for t, x in v.items():
            if t in self.most:
                bound += x * self.most[t]
        best: list[tuple[float, int]] = []
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or len(best) == k and bound[b] < best[-1][0] - 1e-12:
                break
            score = np.zeros(BLOCK)
            for t, x in v.items():
                e = self.post.get(t, {}).get(int(b))
                if e is not None:
                    score[e[0]] += x * e[1]
            best += [(round(float(score[i]), 12), int(b) * BLOCK + int(i)) for i in np.flatnonzero(score > 0)]
            best = sorted(best, key=lambda p: (-p[0], self.ids[p[1]]))[:k]
        return best

    def vote(self, near: list[tuple[float, int]]) -> float:
        up = sum(s * self.labels[i] for s, i in near) + SHRINK * self.base
        return min(1.0, up / (sum(s for s, _ in near) + SHRINK))

    def calibrate(self, vectors: list[tuple[int, int, dict[str, float]]]) -> None:
        """Fits the curve to the votes that examples get from the others: those of smallest hash of doc_id."""
        place = {d: i for i, d in enumerate(self.ids)}
        order = mix(np.array([v[0] for v in vectors], np.int64).view(np.uint64), 5).argsort(kind="stable")[:CALIBRATION]
        votes, labels = [], []
        for j in order.tolist():
            d, label, v = vectors[j]
            votes.append(self.vote([p for p in self.nearest(v, NEIGHBOURS + 1) if p[1] != place[d]][:NEIGHBOURS]))
            labels.append(label)
        if min(labels.count(0), labels.count(1)) >= LEAST:
            self.curve = logistic(np.array(votes), np.array(labels, float))

    def score(self, text: str) -> tuple[float, list[tuple[float, int]]]:
        v = self.vector(text)
        near = self.nearest(v) if v else []
        p = self.vote(near)
        if near and self.curve:
            p = 1 / (1 + math.exp(-max(-500.0, min(500.0, self.curve[0] * p + self.curve[1]))))
        return p, near


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) of the likeliest curve 1 / (1 + exp(-(a x + b))), a at least 0, with labels drawn in by one row of each."""
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -500, 500)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - t) * x).sum() + 1e-3 * a, (p - t).sum()])
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum()]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 5 / max(1e-12, np.abs(step).max()))
        a, b = max(0.0, a - step[0]), b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def train(docs: DataFrame, labels: DataFrame, learn: Column, examples: int = EXAMPLES) -> Model:
    """docs (doc_id, text), labels (doc_id, toxic); learn: which rows of labels may be learnt from."""
    spark = docs.sparkSession
    known = labels.select("doc_id", "toxic").filter(learn & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, most=TERMS_BYTES):
            found = [terms(t or "") for t in b.column("text").to_pylist()]
            yield pa.record_batch(
                [b.column("doc_id"), b.column("toxic"), pa.array(_families(b.column("text")), pa.int64()), pa.array([list(c) for c in found], pa.list_(pa.string())), pa.array([list(c.values()) for c in found], pa.list_(pa.int32()))],
                ["doc_id", "toxic", "family", "terms", "counts"],
            )

    made = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic", "text").mapInArrow(trimmed(run), "doc_id long, toxic int, family long, terms array<string>, counts array<int>")
    made = made.groupBy("family", "toxic").agg(F.min_by(F.struct("doc_id", "terms", "counts"), "doc_id").alias("x")).select("toxic", "x.*")
    made = checkpointed(made)
    n = {r["toxic"]: r["n"] for r in made.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = n.get(1, 0), n.get(0, 0)
    counts = made.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("toxic").alias("a"), F.count("*").alias("df"))
    a, df = F.col("a"), F.col("df")
    share = bad / max(1, bad + good)
    stat = 2 * (F.when(a > 0, a * F.log(a / (df * max(share, 1e-9)))).otherwise(0) + F.when(df > a, (df - a) * F.log((df - a) / (df * max(1 - share, 1e-9)))).otherwise(0))
    kept = counts.filter((a / max(1, bad) > LIFT * (df - a) / max(1, good)) & (stat >= EVIDENCE)) if bad and good else counts.limit(0)
    idf = {r["term"]: math.log((bad + good + 1) / (r["df"] + 1)) + 1 for r in kept.collect()}
    if not n:
        return Model({}, [], (0, 0))
    wanted = spark.sparkContext.broadcast(set(idf))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(i, PICKED) for b in batches for i in range(0, b.num_rows, PICKED)):
            pairs = [[(t, c) for t, c in zip(ts, cs) if t in wanted.value] for ts, cs in zip(b.column("terms").to_pylist(), b.column("counts").to_pylist())]
            yield pa.record_batch([b.column("doc_id"), b.column("toxic"), pa.array([[t for t, _ in p] for p in pairs], pa.list_(pa.string())), pa.array([[c for _, c in p] for p in pairs], pa.list_(pa.int32()))], ["doc_id", "toxic", "terms", "counts"])

    picked = made.mapInArrow(trimmed(pick), "doc_id long, toxic int, terms array<string>, counts array<int>")
    vectors = []
    for r in picked.filter(F.size("terms") > 0).collect():
        v = {t: (1 + math.log(c)) * idf[t] for t, c in zip(r["terms"], r["counts"])}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vectors.append((r["doc_id"], r["toxic"], {t: x / norm for t, x in v.items()}))
    hit = sum(v[1] for v in vectors)
    model = Model(idf, vectors, (bad - hit, bad + good - len(vectors)))
    model.calibrate(vectors)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, score, evidence) of every document; evidence: its nearest examples, their similarity and label."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in chunks(batches):
            got = [m.score(t or "") for t in b.column("text").to_pylist()]
            why = [[{"doc_id": m.ids[i], "similarity": s, "toxic": int(m.labels[i])} for s, i in near] for _, near in got]
            yield pa.record_batch([b.column("doc_id"), pa.array([g[0] for g in got], pa.float64()), pa.array(why, kind)], ["doc_id", "score", "evidence"])
        m.memo.clear()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(run), "doc_id long, score double, evidence array<struct<doc_id:long,similarity:double,toxic:int>>")


def accepted(docs: DataFrame, model: Model, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """The rows of docs whose text scores below the threshold, as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, text):
            keep = [shared.value.score(t or "")[0] < threshold for t in b.column(text).to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))
        shared.value.memo.clear()

    return docs.mapInArrow(trimmed(run), docs.schema)
