"""Positional operators over ordered values."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_p(df: DataFrame, group: str, p: str, order: list[Column], limit: float) -> DataFrame:
    """Rows of a group, in order, until their probabilities reach the limit; the row that reaches it stays."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_before", F.sum(p).over(w) - F.col(p)).filter(F.round("_before", 9) < limit).drop("_before")


def quantised_cdf(df: DataFrame, group: str, symbol: str, p: str, bits: int, least: int) -> DataFrame:
    """Adds cdf: running sum of integer widths of the symbols, each at least `least`, in all at most 2^bits."""
    room = (1 << bits) - least * F.count("*").over(Window.partitionBy(group))
    width = F.floor(F.round(F.col(p) * room, 6)) + least
    w = Window.partitionBy(group).orderBy(symbol).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_width", width).withColumn("cdf", F.sum("_width").over(w)).drop("_width")


def repetitions(df: DataFrame, group: str, order: str, token: str, window: int, share: float) -> DataFrame:
    """Adds repeats: whether the token occurs in at least window x share of the `window` rows before it."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(-window, -1)
    before = F.collect_list(token).over(w)
    return df.withColumn("repeats", F.size(F.filter(before, lambda x: x == F.col(token))) >= window * share)


def segments(n: Column, size: int, overlap: float) -> Column:
    """(start, size) of segments at a stride of (1 - overlap) x size, at least 1; the last ones may be short."""
    stride = max(1, int((1 - overlap) * size))
    return F.transform(F.sequence(F.lit(0).cast("long"), n - 1, F.lit(stride).cast("long")), lambda s: F.struct(s.alias("start"), F.least(F.lit(size).cast("long"), n - s).alias("size")))


def overlap_add(df: DataFrame, series: str, t: str, vec: str, size: int, stride: int) -> DataFrame:
    """(series, pos, value): frames laid `stride` apart and averaged under triangular weights."""
    x = df.select(series, F.col(t).alias("_t"), F.posexplode(vec).alias("_i", "_v"))
    w = 0.5 - F.abs((F.col("_i") + 1) / (size + 1) - 0.5)
    x = x.select(series, (F.col("_t") * stride + F.col("_i")).alias("pos"), F.col("_v").cast("double").alias("v"), w.alias("w"))
    return x.groupBy(series, "pos").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("value"))


def windowed_overlap_add(df: DataFrame, series: str, t: str, vec: str, size: int, stride: int, floor: float = 1e-11) -> DataFrame:
    """(series, pos, value): Hann-windowed frames added and divided by the sum of squared windows, where that exceeds floor."""
    x = df.select(series, F.col(t).alias("_t"), F.posexplode(vec).alias("_i", "_v"))
    w = 0.5 - 0.5 * F.cos(2 * math.pi * F.col("_i") / size)
    x = x.select(series, (F.col("_t") * stride + F.col("_i")).alias("pos"), F.col("_v").cast("double").alias("v"), w.alias("w"))
    summed = x.groupBy(series, "pos").agg(F.sum(F.col("w") * F.col("v")).alias("s"), F.sum(F.col("w") * F.col("w")).alias("e"))
    return summed.filter(F.col("e") > floor).select(series, "pos", (F.col("s") / F.col("e")).alias("value"))


def cross_fade(tail: Column, head: Column, n: int) -> Column:
    """n values from one chunk's tail into the next one's head."""
    up = lambda i: (i + 1) / F.lit(float(n + 1))
    return F.transform(F.arrays_zip(tail.alias("a"), head.alias("b")), lambda x, i: x["b"].cast("double") * up(i) + x["a"].cast("double") * (1 - up(i)))


def interpolated(values: Column, size: Column) -> Column:
    """Linear interpolation to another length, sample centres aligned."""
    n = F.size(values)

    def at(k: Column) -> Column:
        x = F.greatest(F.lit(0.0), (k + 0.5) * (n / size) - 0.5)
        low = F.floor(x).cast("int")
        part = x - low
        return F.get(values, low).cast("double") * (1 - part) + F.get(values, F.least(n - 1, low + 1)).cast("double") * part

    return F.transform(F.sequence(F.lit(0), size - 1), at)
