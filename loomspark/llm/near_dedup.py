"""Near-duplicate classes by BagMinHash over multisets of five-word shingles.

A text is the multiset of its shingles (lower-cased words; a text of fewer words is one shingle);
a shingle's weight is how often it occurs. Two texts are linked if their weighted Jaccard similarity,
sum of smaller over sum of larger weights, is SIMILARITY or more. Classes are connected components.

Signatures: the weight axis is cut into dyadic blocks (0,1], (1,2], (2,4], ... Each shingle has a
Poisson process on each block that its weight reaches, at a rate of WIDTH x the block's width;
its points come in ascending time, each with a random signature place and a random position in the
block (32 bits, each of which halves the block), and a point counts if it lies below the weight. What a
process gives thus depends on the shingle and the block alone. A place keeps the earliest time, so two
texts agree in a place with a probability of exactly their similarity. A process is followed only
while its next point can still be earlier than the text's latest place.

Links: equal texts are one node from the start. Each of BANDS bands deals nodes to buckets; every
node of a bucket is verified against the bucket's first one (the node whose buckets are the
fullest), so a bucket of n nodes gives n - 1 candidates. Where the verified links leave a bucket in more than one component, its nodes of
different components are compared as well, in blocks, without making rows of their pairs. No bucket is capped.
A link of similarity s is overlooked with a probability of (1 - s^ROWS)^BANDS, 3.3e-5 at most; links
below SIMILARITY are not made, so a copy of which a fifth of the shingles changed is not one.

Defined results: a null text or one without words is a class of its own; equal texts are one class
whatever their rows' other columns; a class is named by its smallest doc_id, which is null if its
rows have none; repeated rows each get a row; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import _powers, checkpointed, chunks, folded_words, fresh, mix, trimmed

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 26, 5
WIDTH = BANDS * ROWS
_MOST = 200_000
#: A character of a word.
WORD = r"[^\x09-\x0D\x20-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]"
#: Nodes and shingles of a block, and nodes and shingles that are multiplied at once, in comparing buckets as a whole.
BLOCK, ITEMS, STRIP, _COLUMNS = 1024, 1_000_000, 256, 2048


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, weight) of the distinct shingles, by document and shingle; a hash of each document's words."""
    w = folded_words(texts)
    n = np.diff(w.ptr)
    p, q = _powers(0x2545F4914F6CDD1D, len(w.hashes) + 1)
    s = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w.hashes * p[: len(w.hashes)], dtype=np.uint64)])
    whole = mix((s[w.ptr[1:]] - s[w.ptr[:-1]]) * q[w.ptr[:-1]] + n.astype(np.uint64), 17)
    grams, inside = w.grams(SHINGLE, 5)
    doc = w.doc_of()[: len(grams)][inside]
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    doc, h = np.concatenate([doc, short]), np.concatenate([grams[inside], whole[short]])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])])) if len(h) else np.zeros(0, np.int64)
    return doc[new], h[new], np.diff(np.append(new, len(h))), whole


def signatures(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int, width: int = WIDTH) -> np.ndarray:
    """BagMinHash signatures of n documents: n x width times, infinite where a document has no shingle."""
    seeds, docs, reach, wide = [], [], [], []
    k = 0
    while True:
        low, size = (0, 1) if k == 0 else (1 << k - 1, 1 << k - 1)
        on = np.flatnonzero(weight > low)
        if not len(on):
            break
        seeds.append(mix(h[on], 100 + k))
        docs.append(doc[on])
        reach.append(np.minimum(weight[on] - low, size) / size)
        wide.append(np.full(len(on), float(size * width)))
        k += 1
    out = np.full(n * width, np.inf)
    if not seeds:
        return out.reshape(n, width)
    seed, at, reach, rate = (np.concatenate(x) for x in (seeds, docs, reach, wide))
    time, step = np.zeros(len(seed)), 0
    while len(seed):
        many = int(np.clip(_MOST // len(seed), 1, 64)) if step else 1
        r = mix(seed[:, None] + np.arange(step, step + many, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), 1)
        gap = -np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate[:, None]
        # Added up one by one, so that times don't depend on how many are made at once.
        times = np.cumsum(np.concatenate([time[:, None], gap], axis=1), axis=1)[:, 1:]
        r = mix(r, 2)
        place = ((r >> np.uint64(32)) * np.uint64(width)) >> np.uint64(32)
        inside = (r & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 < reach[:, None]
        latest = out.reshape(n, width).max(axis=1)
        good = inside & (times < latest[at][:, None])
        np.minimum.at(out, (at[:, None] * width + place.astype(np.int64))[good], times[good])
        latest = out.reshape(n, width).max(axis=1)
        time, step = times[:, -1], step + many
        on = time < latest[at]
        seed, at, reach, rate, time = seed[on], at[on], reach[on], rate[on], time[on]
    return out.reshape(n, width)


def bands(sig: np.ndarray) -> np.ndarray:
    """One hash for each band of each signature; the band's number is part of it."""
    x = sig.view(np.uint64).reshape(len(sig), -1, ROWS)
    out = np.arange(x.shape[1], dtype=np.uint64)[None, :] + np.uint64(1)
    for i in range(ROWS):
        out = mix(out ^ x[:, :, i], 20 + i)
    return out


def _signed(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, mark, node, n, bands): a hash of the text as it is and one of its words, its number of shingles and its buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            doc, h, weight, whole = shingles(b.column("text"))
            n = np.bincount(doc, weight, b.num_rows).astype(np.int64)
            keys = bands(signatures(doc, h, weight, b.num_rows)).view(np.int64)
            some = n > 0
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some * keys.shape[1])]).astype(np.int32)), pa.array(keys[some].reshape(-1)))
            yield pa.record_batch([b.column("doc_id"), b.column("mark"), pa.array(whole.view(np.int64), mask=~some), pa.array(n), lists], ["doc_id", "mark", "node", "n", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text").mapInArrow(trimmed(run), "doc_id long, mark long, node long, n long, bands array<long>")


def _sets(docs: DataFrame) -> DataFrame:
    """Rows (node, items): each shingle's occurrences as distinct sorted hashes, so the multisets' similarity is these sets'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            doc, h, weight, whole = shingles(b.column("text"))
            at = np.repeat(np.arange(len(h)), weight)
            turn = np.arange(len(at)) - np.repeat(np.cumsum(weight) - weight, weight)
            items, owner = mix(h[at] + turn.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), 9), doc[at]
            items = items[np.lexsort((items, owner))]
            ptr = np.searchsorted(owner, np.arange(b.num_rows + 1))
            raw = [items[i:j].tobytes() for i, j in zip(ptr, ptr[1:])]
            yield pa.record_batch([pa.array(whole.view(np.int64)), pa.array(raw, pa.binary())], ["node", "items"])

    return docs.select("text").mapInArrow(trimmed(run), "node long, items binary").dropDuplicates(["node"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with their similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sims = []
            for x, y in zip(b.column("x"), b.column("y")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                both = int((x[at] == y).sum())
                sims.append(both / (len(x) + len(y) - both))
            yield pa.record_batch([b.column("a"), b.column("b"), pa.array(sims, pa.float64())], ["a", "b", "similarity"])

    x, y = (sets.select(F.col("node").alias(k), F.col("items").alias(v)) for k, v in (("a", "x"), ("b", "y")))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(trimmed(run), "a long, b long, similarity double")


def components(links: DataFrame) -> DataFrame:
    """Rows (node, component) of all nodes of links (a, b): the smallest node that can be reached, by spreading labels and jumping along them."""
    edges = checkpointed(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("component"))
    labels = checkpointed(labels)
    while True:
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", F.col("component").alias("was"), F.least("component", "near").alias("to"))
        ends = labels.select(F.col("node").alias("to"), F.col("component").alias("end"))
        step = checkpointed(step.join(ends, "to").select("node", "was", F.least("to", "end").alias("component")))
        labels = step.select("node", "component")
        if not step.filter("was <> component").limit(1).count():
            return labels


def _overlaps(items: list[np.ndarray], n: int) -> np.ndarray:
    """Sizes of the intersections of the first n sets with the others."""
    joined = np.concatenate(items)
    owner = np.repeat(np.arange(len(items)), [len(x) for x in items])
    order = np.argsort(joined, kind="stable")
    joined, owner = joined[order], owner[order]
    place = np.cumsum(np.concatenate([[0], joined[1:] != joined[:-1]]))
    shared = np.bincount(place) > 1
    keep = shared[place]
    owner, place = owner[keep], (np.cumsum(shared) - 1)[place[keep]]
    out = np.zeros((n, len(items) - n), np.float32)
    for at in range(0, int(shared.sum()), _COLUMNS):
        i, j = np.searchsorted(place, [at, at + _COLUMNS])
        x = np.zeros((len(items), _COLUMNS), np.float32)
        x[owner[i:j], place[i:j] - at] = 1
        out += x[:n] @ x[n:].T
    return out


def _strip(left, right, bucket: int, keys, n, part, raw, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of left and right that are linked as far as 32 bits of each shingle tell, and are to be compared in this bucket."""
    none = (np.zeros(0, np.int64),) * 2
    if not len(left) or not len(right):
        return none
    on = (part[left][:, None] != part[right][None, :]) & (np.minimum.outer(n[left], n[right]) >= least * np.maximum.outer(n[left], n[right]))
    on &= left[:, None] != right[None, :]
    for b in range(int(np.flatnonzero(keys[left[0]] == bucket)[0])):
        on &= keys[left, b][:, None] != keys[right, b][None, :]
    if not on.any():
        return none
    left, right, on = left[on.any(1)], right[on.any(0)], on[on.any(1)][:, on.any(0)]
    items = [np.unique(np.frombuffer(raw[int(k)].as_buffer(), np.uint32)) for k in (*left, *right)]
    both = _overlaps(items, len(left))
    # Shingles of one set that share their 32 bits count once; add back what a set so lost.
    m = np.array([len(x) for x in items])
    both += np.minimum((n[left] - m[: len(left)])[:, None], (n[right] - m[len(left) :])[None, :])
    x, y = np.nonzero(on & (both >= least * (n[left][:, None] + n[right][None, :] - both)))
    return left[x], right[y]


def _across(members: DataFrame, nodes: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links (a, b) between nodes of a bucket in different components, one for each two components of a cell.

    A bucket is cut into blocks of about BLOCK nodes, or fewer long ones; a cell holds two blocks of a
    bucket and compares them by matrix products. Two nodes are compared in the first bucket that they
    share. Cells get 32 bits of each shingle, which can only make too many links, and these are verified.
    """
    w = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / ITEMS)).cast("long")
    sizes = members.groupBy("bucket").agg(w.alias("w"))
    rows = members.join(sizes, "bucket").withColumn("p", F.pmod(F.xxhash64("node"), F.col("w")))
    cell = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("w") - 1), lambda q: F.struct(F.least(F.col("p"), q).alias("i"), F.greatest(F.col("p"), q).alias("j"))))
    rows = rows.withColumn("cell", cell).select("bucket", F.col("cell.i").alias("i"), F.col("cell.j").alias("j"), "p", "node", "n", "component")

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [(np.frombuffer(x.as_buffer(), np.uint64) >> np.uint64(32)).astype(np.uint32).tobytes() for x in b.column("items")]
            yield b.set_column(b.schema.get_field_index("items"), "items", pa.array(raw, pa.binary()))

    rows = rows.join(nodes.select("node", "bands"), "node").join(sets, "node")
    rows = rows.mapInArrow(trimmed(thin), rows.schema)
    kind = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        bucket, i, j = (k.as_py() for k in key)
        t = t.sort_by("node")
        p, node, n, part = (t.column(c).to_numpy() for c in ("p", "node", "n", "component"))
        keys, raw = np.array(t.column("bands").to_pylist(), np.int64), t.column("items")
        left, right = np.flatnonzero(p == i), np.flatnonzero(p == j)
        ends: dict[tuple[int, int], tuple[int, int]] = {}  # of a link for each two components
        for at in range(0, len(left), STRIP):
            for x, y in zip(*_strip(left[at : at + STRIP], right, bucket, keys, n, part, raw, least)):
                ends.setdefault((min(part[x], part[y]), max(part[x], part[y])), (node[x], node[y]))
        return pa.Table.from_arrays([pa.array([e[k] for e in ends.values()], pa.int64()) for k in (0, 1)], schema=kind)

    found = rows.groupBy("bucket", "i", "j").applyInArrow(run, "a long, b long").distinct()
    return _verified(found, sets).filter(F.col("similarity") >= least).select("a", "b")


def _classed(docs: DataFrame, similarity: float) -> DataFrame:
    """Rows (doc_id, mark, node, component, class_id) of every row of docs; the last two are null without words."""
    signed = checkpointed(_signed(docs))
    nodes = signed.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    dealt = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    # The original of a group of copies agrees with most of them, so its buckets are the fullest: such a node comes first.
    full = dealt.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    dealt = checkpointed(dealt.join(full, "bucket"))
    weight = dealt.groupBy("node").agg(F.sum("size").alias("weight"))
    firsts = dealt.select("bucket", "node").join(weight, "node").groupBy("bucket").agg(F.max_by("node", F.struct("weight", "node")).alias("a"))
    dealt = checkpointed(dealt.join(firsts, "bucket").select("bucket", "a", F.col("node").alias("b"), "n"))
    stars = dealt.filter("a <> b").select("a", "b").distinct()
    wanted = stars.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    ids = nodes.join(wanted, "node").select(F.col("doc_id").alias("_wanted")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = _sets(texts.join(ids, texts["doc_id"].eqNullSafe(ids["_wanted"]), "left_semi"))
    sets = checkpointed(sets.join(wanted, "node", "left_semi"))
    measured = checkpointed(_verified(stars, sets))
    least = similarity - 1e-9
    links = measured.filter(F.col("similarity") >= least).select("a", "b")
    found = components(links)
    # What is left to compare: nodes of different components that share a bucket.
    members = dealt.select("bucket", F.col("b").alias("node"), "n").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = members.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size"))
    mixed = mixed.filter("lo <> hi and size > 2").select("bucket")
    rest = checkpointed(_across(members.join(mixed, "bucket"), nodes, sets, least))
    if rest.limit(1).count():
        found = components(links.unionByName(rest))
    named = nodes.select("node", "doc_id").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = named.groupBy("component").agg(F.min("doc_id").alias("class_id"))
    of = named.join(names, "component").select("node", "component", "class_id")
    return signed.select("doc_id", "mark", "node").join(of, "node", "left")


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Rows (doc_id, class_id) of every row of docs (doc_id, text)."""
    return _classed(docs, similarity).select("doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def firsts(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each class, as it is: of the smallest doc_id (rows without one come last), then of the smallest hash of the text, then of all columns. Rows without words all stay."""
    rows = _classed(docs, similarity).filter("component is not null")
    # Equal rows are counted before a class is gathered.
    counted = rows.groupBy("component", "doc_id", "mark").agg(F.count("*").alias("n"))
    best = counted.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "n")).alias("w"))
    mark, n, at = (fresh(docs, x) for x in ("_mark", "_rows", "_at"))
    best = checkpointed(best.select(F.col("w.doc_id").alias(at), F.col("w.mark").alias(mark), F.col("w.n").alias(n)))
    worded = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    bare = docs.filter(~worded)
    kept = docs.filter(worded).join(best, F.col("doc_id").cast("long").eqNullSafe(F.col(at)) & (F.xxhash64("text") == F.col(mark)))
    once = kept.filter(F.col(n) == 1).select(*docs.columns)
    if best.filter(F.col(n) > 1).limit(1).count():
        whole = F.struct(*docs.columns)
        more = kept.filter(F.col(n) > 1).groupBy(at, mark).agg(F.min_by(whole, F.xxhash64(*docs.columns)).alias("row"))
        once = once.unionByName(more.select("row.*"))
    return once.unionByName(bare)
