"""Shared folders, a hash that other engines can repeat, and row numbers without a single-task window."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Ranges that row_index numbers by themselves.
MOST_RANGES = 10_000


def work_dir(spark: SparkSession, what: str) -> str:
    """A new folder below spark.checkpoint.dir, or below the warehouse where that is unset; its path names its file system."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{top.rstrip('/')}/{what}-{uuid.uuid4().hex}")
    path = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return re.sub("^file:/+", "file:///", path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash32(*parts: Column | str) -> Column:
    """The first 32 bits of the md5 of the parts' texts joined by ':', as a long: a coin that every run and engine tosses alike."""
    text = F.concat_ws(":", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def hash32_sql(*parts: str) -> str:
    """DuckDB's text of the same hash."""
    return f"('0x' || substr(md5(concat_ws(':', {', '.join(f'({p})::VARCHAR' for p in parts)})), 1, 8))::BIGINT"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once: what a lambda only names would be worked out anew for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def row_index(df: DataFrame, key: str, name: str = "row", width: int = 100_000) -> DataFrame:
    """df with the row number (from 0) in the order of a unique integer key.

    Rows are numbered inside ranges of about `width` rows, cut at quantiles of the key however it is
    spread, and each range starts at the number of rows in the ranges before it; only the ranges'
    counts, at most MOST_RANGES, are brought into one order. Up to `width` rows are one range.
    """
    from pyspark.ml.feature import Bucketizer

    keys = df.select(F.col(key).cast("double").alias("_at")).persist()
    k = min(MOST_RANGES, keys.count() // width + 1)
    borders = sorted(set(keys.approxQuantile("_at", [i / k for i in range(1, k)], 0.25 / k))) if k > 1 else []
    if not borders:
        keys.unpersist()
        return df.withColumn(name, (F.row_number().over(Window.orderBy(key)) - 1).cast("long"))
    cut = Bucketizer(splits=[float("-inf"), *borders, float("inf")], inputCol="_at", outputCol="_range")
    starts, n = [], 0
    for r in cut.transform(keys).groupBy("_range").agg(F.count("*").alias("n")).orderBy("_range").collect():
        starts.append((r["_range"], n))
        n += r["n"]
    keys.unpersist()
    ranged = cut.transform(df.withColumn("_at", F.col(key).cast("double")))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(key)) - 1
    known = F.broadcast(df.sparkSession.createDataFrame(starts, "_range double, _start long"))
    return ranged.withColumn("_inside", inside).join(known, "_range").withColumn(name, (F.col("_start") + F.col("_inside")).cast("long")).drop("_range", "_at", "_inside", "_start")
