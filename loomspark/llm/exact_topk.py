"""Exact top-k search by inner product with a three-phase uniform threshold.

Vectors become integers, and their dimensions are cut into SLICES. A slice gives each query a
score list; a score is the sum over an object's lists.

1. Every query gathers the heads of its local lists over one block of candidates, the fullest.
   Heads are completed by the object's other lists, which lie in the same block, so the k-th best
   of the gathered scores is a floor that the k-th best score of all can't be below.
2. The floor / SLICES is the safe cutoff: an object that reaches the floor reaches the cutoff in
   some list. Cutoffs go back to the queries, and every list gives up all entries from it on;
   what an object lacks counts as the cutoff at most, and objects whose sum then stays below the
   floor are dropped. A block whose longest vector can't lift any of a block's queries to its floor
   is passed over without products. Products of all other blocks are made here, once.
3. The scores of the remaining ones are resolved exactly; each cell keeps its k best, and these are merged.

Queries and candidates are packed into blocks and dealt over a grid of cells, each of at most
SIDE x SIDE blocks, so neither side is broadcast and no task holds more than a cell. Lists of the
same query are merged in two steps, so none grows with the number of cells.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do
rows without an id; vectors of unequal length are compared as if filled with zeros (one without
components scores 0); rows that repeat an id are all candidates for other ids, and the id is queried
once; equal scores are ranked by id; with fewer than k candidates all are returned; an empty
table gives no rows. Scores beyond 63 bits are not supported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import checkpointed

SLICES = 4
QUERIES, CANDIDATES = 512, 4096
SIDE = 8
MERGE = 64
_BLOCK = "seq long, ids binary, values binary, dims int, floors binary"


def quantised(df: DataFrame, vector: str = "embedding", scale: float = 64.0) -> DataFrame:
    """Rows (vec_id, v): floor(scale * x) of each component, of the vectors that take part."""
    x = F.transform(vector, lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = df.filter(F.col("vec_id").isNotNull() & F.col(vector).isNotNull() & F.coalesce(fine, F.lit(False)))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of at most `size` rows of (vec_id, v, floor)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seq = TaskContext.get().partitionId() << 32
        for b in batches:
            for at in range(0, b.num_rows, size):
                s = b.slice(at, size)
                ids, lists = s.column("vec_id").to_numpy(), s.column("v")
                n = lists.value_lengths().to_numpy()
                dims = int(n.max(initial=0))
                m = np.zeros((len(ids), dims), np.int64)
                m[np.arange(dims) < n[:, None]] = lists.flatten().to_numpy()
                floors = s.column("floor").to_numpy(zero_copy_only=False).astype(np.float64)
                yield pa.RecordBatch.from_pylist([{"seq": seq, "ids": ids.tobytes(), "values": m.tobytes(), "dims": dims, "floors": floors.tobytes()}], schema=pa.schema([("seq", pa.int64()), ("ids", pa.binary()), ("values", pa.binary()), ("dims", pa.int32()), ("floors", pa.binary())]))
                seq += 1

    return rows.mapInArrow(run, _BLOCK)


def _blocks(t: pa.Table) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    out = []
    for r in t.to_pylist():
        ids = np.frombuffer(r["ids"], np.int64)
        out.append((ids, np.frombuffer(r["values"], np.int64).reshape(len(ids), r["dims"]), np.frombuffer(r["floors"], np.float64)))
    return out


def _lists(q: np.ndarray, c: np.ndarray) -> list[np.ndarray]:
    """Score lists of each slice (queries x candidates), exact in whatever type they come."""
    d = min(q.shape[1], c.shape[1])
    q, c = q[:, :d], c[:, :d]
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, d)
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    cuts = np.linspace(0, d, SLICES + 1).astype(int)
    return [q[:, a:b].astype(kind) @ c[:, a:b].astype(kind).T for a, b in zip(cuts, cuts[1:])]


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest scores, ties to smaller ids."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = scores >= least
        scores, ids = scores[near], ids[near]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def _heads(q, c, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Phase 1: each query's k best completed heads of the local lists."""
    lists = _lists(q[1], c[1])
    n = len(c[0])
    m = min(k + 1, n)
    seen = np.concatenate([np.argpartition(x, n - m, axis=1)[:, n - m :] for x in lists], axis=1)
    total = sum(np.take_along_axis(x, seen, 1).astype(np.int64) for x in lists)
    for i, own in enumerate(q[0].tolist()):
        at, first = np.unique(seen[i], return_index=True)
        keep = c[0][at] != own
        yield i, *_best(total[i][first[keep]], c[0][at[keep]], k)


def _resolved(q, c, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Phases 2 and 3: entries from the cutoff on, pruned by their upper bounds, then resolved."""
    length = lambda m: np.sqrt((m.astype(np.float64) ** 2).sum(1))
    if (length(q[1]) * length(c[1]).max(initial=0) * (1 + 1e-9) < q[2]).all():
        return
    lists = _lists(q[1], c[1])
    cut = (q[2] / SLICES)[:, None]
    known, upper = np.zeros(lists[0].shape, bool), np.zeros(lists[0].shape)
    for x in lists:
        over = x >= cut
        known |= over
        upper += np.where(over, x, cut)
    known &= upper >= q[2][:, None] - 1e-6 * np.abs(q[2][:, None])
    for i, own in enumerate(q[0].tolist()):
        at = np.flatnonzero(known[i])
        at = at[c[0][at] != own]
        score = sum(x[i, at].astype(np.int64) for x in lists)
        yield i, *_best(score, c[0][at], k)


def _over_cells(queries: DataFrame, candidates: DataFrame, sides: tuple[int, int], step, k: int) -> DataFrame:
    """Rows (query_id, best) of step over each cell of blocks; best: (negated score, vec_id), ascending."""
    spread = lambda n: F.pmod(F.xxhash64("seq"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = queries.withColumn("g", spread(sides[0])).withColumn("h", every(sides[1]))
    right = candidates.withColumn("h", spread(sides[1])).withColumn("g", every(sides[0]))
    kind = pa.schema([("query_id", pa.int64()), ("h", pa.int64()), ("best", pa.list_(pa.struct([("neg", pa.int64()), ("vec_id", pa.int64())])))])

    def run(key: tuple[pa.Scalar, ...], a: pa.Table, b: pa.Table) -> pa.Table:
        rows, others = [], _blocks(b)
        for q in _blocks(a):
            got: list[list] = [[] for _ in q[0]]
            for c in others:
                for i, s, ids in step(q, c, k):
                    got[i].append((s, ids))
            for i, own in enumerate(q[0].tolist()):
                s, ids = _best(np.concatenate([np.zeros(0, np.int64), *(x[0] for x in got[i])]), np.concatenate([np.zeros(0, np.int64), *(x[1] for x in got[i])]), k)
                rows.append({"query_id": own, "h": key[1].as_py(), "best": [{"neg": -x, "vec_id": y} for x, y in zip(s.tolist(), ids.tolist())]})
        return pa.Table.from_pylist(rows, schema=kind)

    lists = left.groupBy("g", "h").cogroup(right.groupBy("g", "h")).applyInArrow(run, "query_id long, h long, best array<struct<neg:long,vec_id:long>>")
    merged = F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, k).alias("best")
    n = sides[1]
    while n > MERGE:
        n = -(-n // MERGE)
        lists = lists.withColumn("h", F.pmod("h", F.lit(n))).groupBy("query_id", "h").agg(merged)
    return lists.groupBy("query_id").agg(merged)


def search(vectors: DataFrame, is_query: Column, k: int = 20, vector: str = "embedding", scale: float = 64.0) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k best other rows for each row of vectors (vec_id, vector) where is_query holds."""
    none = F.lit(float("-inf")).alias("floor")
    rows = quantised(vectors, vector, scale)
    asked = rows.filter(F.coalesce(is_query, F.lit(False))).dropDuplicates(["vec_id"])
    candidates = checkpointed(_packed(rows.select("vec_id", "v", none), CANDIDATES))
    n_queries, blocks = asked.count(), candidates.agg(F.count("*").alias("n"), F.max_by("seq", F.struct(F.length("ids"), "seq")).alias("fullest")).first()
    sides = (max(1, -(-n_queries // (QUERIES * SIDE))), max(1, -(-blocks["n"] // SIDE)))
    fullest = candidates.filter(F.col("seq") == F.lit(blocks["fullest"]))
    heads = _over_cells(_packed(asked.select("vec_id", "v", none), QUERIES), fullest, (sides[0], 1), _heads, k)
    kth = F.when(F.size("best") == k, -F.element_at("best", k)["neg"].cast("double")).otherwise(F.lit(float("-inf")))
    cutoffs = heads.select(F.col("query_id").alias("vec_id"), kth.alias("floor"))
    second = _packed(asked.join(cutoffs, "vec_id").select("vec_id", "v", "floor"), QUERIES)
    best = _over_cells(second, candidates, sides, _resolved, k)
    return best.select("query_id", F.posexplode("best").alias("p", "b")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.neg")).alias("score"))
