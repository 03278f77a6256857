"""Codebooks: k-means, moving averages, residual codes, segmentation, arithmetic coding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.operators import joins
from loomspark.operators.batching import seeds
from loomspark.runtime import row_index, work_dir


def kmeans_step(points: DataFrame, codes: DataFrame, vec: str = "vec", most: int = joins.BOOK_ROWS) -> DataFrame:
    """(code, vec, n): means of the points nearest to each code; a code without points keeps its vector.

    Each task adds its points up by code, so only (tasks x codes) sums are shuffled. Beyond `most`
    codes the points are compared cell by cell and added up by code and place.
    """
    rows = joins.codebook(codes, most=most)
    if rows is None:
        near = joins.nearest_code(points.select(vec), codes, vec, "code", most)
        flat = near.select("code", F.lit(1).cast("long").alias("n"), F.posexplode(vec).alias("pos", "x"))
    else:
        flat = _sums(points.select(vec), rows, vec).select("code", "n", F.posexplode("total").alias("pos", "x"))
    flat = flat.groupBy("code", "pos").agg((F.sum(F.col("x").cast("double")) / F.sum("n")).alias("x"), F.sum("n").alias("n"))
    means = flat.groupBy("code").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("mean"), F.max("n").alias("n"))
    old = codes.select("code", F.transform("vec", lambda v: v.cast("double")).alias("vec"))
    return old.join(means, "code", "left").select("code", F.coalesce("mean", "vec").alias("vec"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def _sums(points: DataFrame, rows: tuple[np.ndarray, np.ndarray], vec: str) -> DataFrame:
    """(code, total, n) of each task's points by their nearest code."""
    book = points.sparkSession.sparkContext.broadcast(rows)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, m = book.value
        total, n = np.zeros_like(m), np.zeros(len(m), np.int64)
        for b in batches:
            if not len(b):
                continue
            x = np.stack(b[vec].to_list()).astype(np.float64)
            near = joins.nearest_rows(x, m)[0]
            np.add.at(total, near, x)
            n += np.bincount(near, minlength=len(m))
        on = np.flatnonzero(n)
        if not len(on):
            return  # a task without points: empty lists have no Arrow type
        yield pd.DataFrame({"code": names[on], "total": list(total[on]), "n": n[on]})

    return points.mapInPandas(partial, "code long, total array<double>, n long")


def kmeans(points: DataFrame, key: str, k: int, iterations: int = 10, seed: int = 0, vec: str = "vec") -> DataFrame:
    """(code, vec, n) after some steps from hashed seeds; each step's codebook is a table of the shared folder."""
    codes = seeds(points.select(key, vec), key, k, seed).select("code", F.col(vec).alias("vec"))
    for _ in range(iterations):
        path = work_dir(points.sparkSession, "codes")
        kmeans_step(points, codes, vec).write.parquet(path)
        codes = points.sparkSession.read.parquet(path)
    return codes


def ema_update(old: DataFrame, step: DataFrame, decay: float = 0.99, eps: float = 1e-5) -> DataFrame:
    """(code, size, total, vec): moving averages of the codes' sizes and sums, and their quotient with smoothed sizes.

    old: (code, size, total array); step: (code, n, added array), a row for each code.
    """
    both = old.join(step, "code")
    size = F.col("size") * decay + F.col("n") * (1 - decay)
    total = F.zip_with("total", "added", lambda a, b: a.cast("double") * decay + b.cast("double") * (1 - decay))
    moved = both.select("code", size.alias("size"), total.alias("total"))
    every = moved.agg(F.sum("size").alias("all"), F.count("*").alias("k"))
    smooth = (F.col("size") + eps) / (F.col("all") + F.col("k") * eps) * F.col("all")
    return moved.crossJoin(F.broadcast(every)).select("code", "size", "total", F.transform("total", lambda x: x / smooth).alias("vec"))


def replace_dead(codes: DataFrame, points: DataFrame, key: str, threshold: float = 2.0, seed: int = 0, size: str = "size", vec: str = "vec") -> DataFrame:
    """codes with the vectors of hashed points where the size is below the threshold; 0 replaces none."""
    n = codes.filter(F.col(size) < threshold).count() if threshold > 0 else 0
    if not n:
        return codes
    dead = row_index(codes.filter(F.col(size) < threshold).select("code"), "code", "_rank")
    fresh = seeds(points.select(key, vec), key, n, seed).select(F.col("code").alias("_rank"), F.col(vec).alias("_fresh"))
    got = dead.join(fresh, "_rank").select("code", "_fresh")
    return codes.join(joins.small(got), "code", "left").withColumn(vec, F.coalesce(F.col("_fresh"), F.col(vec))).drop("_fresh")


def residual_codes(points: DataFrame, books: list[DataFrame], vec: str = "vec", most: int = joins.BOOK_ROWS) -> DataFrame:
    """points with codes (array, one for each book) and the residual vector that is left. A book of more than `most` codes is compared cell by cell."""
    many = [joins.codebook(b, most=most) for b in books]
    if any(m is None for m in many):
        return _residual_by_book(points, books, vec, most)
    shared = points.sparkSession.sparkContext.broadcast(many)

    @F.pandas_udf("struct<codes:array<bigint>,residual:array<double>>")
    def encode(v: pd.Series) -> pd.DataFrame:
        x = np.stack(v.to_list()).astype(np.float64) if len(v) else np.zeros((0, 1))
        codes = []
        for names, m in shared.value if len(v) else []:
            near = joins.nearest_rows(x, m)[0]
            codes.append(names[near])
            x = x - m[near]
        return pd.DataFrame({"codes": list(np.stack(codes, 1)) if len(x) else [], "residual": list(x)})

    return points.withColumn("_r", encode(vec)).withColumn("codes", F.col("_r.codes")).withColumn("residual", F.col("_r.residual")).drop("_r")


def _residual_by_book(points: DataFrame, books: list[DataFrame], vec: str, most: int) -> DataFrame:
    """residual_codes, one book after the other."""
    out = points.withColumn("codes", F.array().cast("array<bigint>")).withColumn("residual", F.transform(vec, lambda x: x.cast("double")))
    for b in books:
        near = b.select(F.col("code").alias("_code"), F.transform("vec", lambda x: x.cast("double")).alias("_near"))
        out = joins.nearest_code(out, b, "residual", "_code", most).join(joins.small(near), "_code")
        out = out.withColumn("codes", F.concat("codes", F.array("_code"))).withColumn("residual", F.zip_with("residual", "_near", lambda x, y: x - y)).drop("_code", "_near")
    return out


def residual_decode(df: DataFrame, books: list[DataFrame], codes: str = "codes") -> DataFrame:
    """df with the sum of its codes' vectors."""
    out = None
    for i, b in enumerate(books):
        df = df.withColumn("code", F.get(codes, F.lit(i))).join(joins.small(b.select("code", F.col("vec").alias(f"_v{i}"))), "code").drop("code")
        part = F.transform(f"_v{i}", lambda x: x.cast("double"))
        out = part if out is None else F.zip_with(out, part, lambda x, y: x + y)
    return df.withColumn("decoded", out).drop(*[f"_v{i}" for i in range(len(books))])


def density(sim: np.ndarray, k: int, fixed: bool) -> tuple[np.ndarray, np.ndarray]:
    """rho and delta of the frames of a similarity matrix; `fixed` uses distances and rewards density, the other form is kept for old weights."""
    near = -np.sort(-sim, axis=1)[:, 1 : k + 1]
    rho = np.exp((1 if fixed else -1) * near.mean(1)) if near.shape[1] else np.ones(len(sim))
    value = 1 - sim if fixed else sim
    higher = rho[None, :] > rho[:, None]
    delta = np.where(higher, value, np.inf).min(1)
    return rho, np.where(higher.any(1), delta, value.max(1))


def grow_segments(sim: np.ndarray, score: np.ndarray, threshold: float, beta: float, span: int) -> list[tuple[int, int]]:
    """(start, length) of segments that tile the frames: from the best free frame rightwards and then leftwards while similarity less beta x score exceeds the threshold."""
    n = len(score)
    free = np.ones(n, bool)
    out = []
    for seed in np.argsort(-score, kind="stable"):
        if not free[seed]:
            continue
        lo = hi = seed
        free[seed] = False
        for step in (1, -1):
            t = seed + step
            while 0 <= t < n and free[t] and hi - lo + 1 < span and sim[seed, t] - beta * score[t] > threshold:
                free[t] = False
                lo, hi = min(lo, t), max(hi, t)
                t += step
        out.append((int(lo), int(hi - lo + 1)))
    return sorted(out)


def segments(frames: DataFrame, series: str, t: str, vec: str, variant: str = "fixed", k: int = 10, beta: float = 0.2, threshold: float = 0.7, span: int = 4, most: int = 4096) -> DataFrame:
    """(series, segment, start, length, vec): similar neighbouring frames of a series, with their mean. A series longer than `most` frames raises."""
    fixed = {"fixed": True, "default": False}[variant]

    def run(p: pd.DataFrame) -> pd.DataFrame:
        if len(p) > most:
            raise ValueError(f"a series of {len(p)} frames")
        p = p.sort_values(t)
        x = np.stack(p[vec].to_list()).astype(np.float64)
        u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        sim = (u @ u.T + 1) / 2
        rho, delta = density(sim, min(k, len(x) - 1), fixed)
        cuts = grow_segments(sim, rho * delta, threshold, beta, span)
        return pd.DataFrame({series: p[series].iloc[0], "segment": np.arange(len(cuts)), "start": [a for a, _ in cuts], "length": [n for _, n in cuts], "vec": [x[a : a + n].mean(0) for a, n in cuts]})

    kind = dict(frames.dtypes)[series]
    return frames.select(series, t, vec).groupBy(series).applyInPandas(run, f"{series} {kind}, segment long, start long, length long, vec array<double>")


_TOP, _HALF, _QUARTER = (1 << 32) - 1, 1 << 31, 1 << 30


def arithmetic_encode(symbols: list[int], cdf: list[int]) -> bytes:
    """Range code of symbols whose widths are the steps of cdf (from 0, below 2^30 in all)."""
    low, high, pending, bits, total = 0, _TOP, 0, [], cdf[-1]
    for s in symbols:
        width = high - low + 1
        low, high = low + width * cdf[s] // total, low + width * cdf[s + 1] // total - 1
        while True:
            if high < _HALF or low >= _HALF:
                bit = int(low >= _HALF)
                bits += [bit] + [1 - bit] * pending
                pending = 0
            elif low >= _QUARTER and high < 3 * _QUARTER:
                pending += 1
                low, high = low - _QUARTER, high - _QUARTER
            else:
                break
            low, high = 2 * low & _TOP, 2 * high + 1 & _TOP
    pending += 1
    bit = int(low >= _QUARTER)
    bits += [bit] + [1 - bit] * pending
    return np.packbits(np.array(bits, np.uint8)).tobytes()


def arithmetic_decode(code: bytes, n: int, cdf: list[int]) -> list[int]:
    """The n symbols of a range code."""
    bits = np.unpackbits(np.frombuffer(code, np.uint8)).tolist()
    low, high, total, at = 0, _TOP, cdf[-1], 32
    value = int("".join(map(str, (bits + [0] * 32)[:32])), 2)
    steps, out = np.array(cdf), []
    for _ in range(n):
        width = high - low + 1
        s = int(np.searchsorted(steps, ((value - low + 1) * total - 1) // width, "right")) - 1
        out.append(s)
        low, high = low + width * cdf[s] // total, low + width * cdf[s + 1] // total - 1
        while True:
            if high < _HALF or low >= _HALF:
                base = _HALF if low >= _HALF else 0
            elif low >= _QUARTER and high < 3 * _QUARTER:
                base = _QUARTER
            else:
                break
            bit = bits[at] if at < len(bits) else 0
            at += 1
            low, high, value = 2 * (low - base), 2 * (high - base) + 1, 2 * (value - base) + bit
    return out


def coded(df: DataFrame, key: str, order: str, symbol: str, cdf: list[int]) -> DataFrame:
    """(key, code, n): each key's symbols, in order, as a range code."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        s = p.sort_values(order)[symbol].tolist()
        return pd.DataFrame({key: [p[key].iloc[0]], "code": [arithmetic_encode(s, cdf)], "n": [len(s)]})

    return df.select(key, order, symbol).groupBy(key).applyInPandas(run, f"{key} {dict(df.dtypes)[key]}, code binary, n long")


def decoded(df: DataFrame, cdf: list[int]) -> DataFrame:
    """df (code, n) with its symbols."""

    @F.pandas_udf("array<bigint>")
    def run(code: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([arithmetic_decode(c, k, cdf) for c, k in zip(code, n)])

    return df.withColumn("symbols", run("code", "n"))


def winners(candidates: DataFrame, task: str, round_: str, valid: Column, score: Column) -> DataFrame:
    """The best valid candidate of each task and round; a round without one has none. score may call any judge."""
    w = Window.partitionBy(task, round_).orderBy(F.desc("_score"), "candidate")
    judged = candidates.filter(valid).withColumn("_score", score)
    return judged.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_score")
