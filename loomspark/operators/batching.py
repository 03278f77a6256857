"""Ordering, sampling, sharding, batching and padding."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.runtime import hash32, let, row_index

SHUFFLE_SIZE, SORT_SIZE, BATCH_SIZE, MAX_FRAMES = 10_000, 500, 16, 12_000
_DEALT = 1 << 32


def coin(seed: int, *parts: Column | str) -> Column:
    """A number in [0, 1) that depends on the seed and the parts alone."""
    return hash32(F.lit(seed), *parts) / _DEALT


def buffered_shuffle(df: DataFrame, key: str, size: int = SHUFFLE_SIZE, seed: int = 0) -> DataFrame:
    """Adds buffer and place: rows of consecutive buffers in the order of a hash."""
    out = row_index(df, key, "_row").withColumn("buffer", F.floor(F.col("_row") / size))
    return out.withColumn("place", F.row_number().over(Window.partitionBy("buffer").orderBy(hash32(F.lit(seed), key), key)) - 1).drop("_row")


def buffered_sort(df: DataFrame, key: str, length: str, size: int = SORT_SIZE) -> DataFrame:
    """Adds buffer and place: rows of consecutive buffers by length, equal ones as they came."""
    out = row_index(df, key, "_row").withColumn("buffer", F.floor(F.col("_row") / size))
    return out.withColumn("place", F.row_number().over(Window.partitionBy("buffer").orderBy(length, key)) - 1).drop("_row")


def hashed_order(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Adds the row's place in a seeded order of all rows."""
    named = df.withColumn("_hash", hash32(F.lit(seed), key) * F.lit(1 << 20) + F.pmod(F.col(key), F.lit(1 << 20)))
    return row_index(named, "_hash", "place").drop("_hash")


def sampled(df: DataFrame, key: str, rate: Column | float, seed: int = 0) -> DataFrame:
    """Rows whose coin falls below the rate."""
    return df.filter(coin(seed, key) < rate)


def shards(df: DataFrame, key: str, world: int, workers: int, n_rows: int | None = None) -> DataFrame:
    """(rank, worker, turn) for each row: strides by rank, then by worker; fewer rows than ranks, or fewer rows of a rank than workers, are repeated."""
    rows = row_index(df, key, "_row")
    n = df.count() if n_rows is None else n_rows
    per_rank = max(n, world) if n else 0
    # Places 0 .. per_rank - 1 repeat the rows; place p goes to rank p % world.
    copies = F.sequence(F.col("_row"), F.lit(per_rank - 1).cast("long"), F.lit(max(1, n)).cast("long"))
    out = rows.withColumn("_place", F.explode(copies)).withColumn("rank", F.col("_place") % world).withColumn("_at", F.floor(F.col("_place") / world))
    size = F.floor((F.lit(per_rank) - 1 - F.col("rank")) / world) + 1
    last = F.greatest(size, F.lit(workers)) - 1
    out = out.withColumn("_slot", F.explode(F.sequence(F.col("_at"), last, size)))
    return out.withColumn("worker", F.col("_slot") % workers).withColumn("turn", F.floor(F.col("_slot") / workers)).drop("_row", "_place", "_at", "_slot")


def static_batches(df: DataFrame, key: str, size: int = BATCH_SIZE) -> DataFrame:
    """Adds batch: rows in order, `size` at a time; the last one may hold fewer."""
    return row_index(df, key, "_row").withColumn("batch", F.floor(F.col("_row") / size)).drop("_row")


def dynamic_batches(df: DataFrame, shard: str, order: list[str], key: str, length: str, cap: int = MAX_FRAMES) -> DataFrame:
    """(shard, key, length, batch): a batch closes before the row that would lift longest x rows above the cap.

    A row longer than the cap is a batch of its own. Sorted rows of a shard are streamed past one fold, so a
    shard is never held; it is one task's work.
    """
    rows = df.select(*dict.fromkeys([shard, *order, key]), F.col(length).cast("long").alias("_len")).repartition(shard).sortWithinPartitions(shard, *order)
    kind = T.StructType([rows.schema[shard], rows.schema[key], T.StructField(length, T.LongType()), T.StructField("batch", T.LongType())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, batch, most, n = object(), -1, 0, 0
        for b in parts:
            out = []
            for s, x in zip(b.column(shard).to_pylist(), b.column("_len").to_pylist()):
                if s != now:
                    now, batch, most, n = s, -1, 0, 0
                longest = max(most, x or 0)
                if n == 0 or longest * (n + 1) > cap:
                    batch, longest, n = batch + 1, x or 0, 0
                most, n = longest, n + 1
                out.append(batch)
            yield pa.RecordBatch.from_arrays([b.column(shard), b.column(key), b.column("_len"), pa.array(out, pa.int64())], names=kind.names)

    return rows.mapInArrow(run, kind)


def batches(df: DataFrame, kind: str, key: str, **options) -> DataFrame:
    """Static or dynamic batches by name; another name raises."""
    if kind == "static":
        return static_batches(df, key, **options)
    if kind == "dynamic":
        return dynamic_batches(df, key=key, **options)
    raise ValueError(f"unknown kind of batches: {kind}")


def padded(array: Column, size: Column | int, fill: Column, left: bool = False) -> Column:
    """The array with fill up to a size on one side; a longer one is cut on that side."""
    size = F.lit(size) if isinstance(size, int) else size
    n = F.size(array)
    fills = F.array_repeat(fill, F.greatest(size - n, F.lit(0)))
    if left:
        return F.when(n >= size, F.slice(array, n - size + 1, size)).otherwise(F.concat(fills, array))
    return F.when(n >= size, F.slice(array, F.lit(1), size)).otherwise(F.concat(array, fills))


def collated(df: DataFrame, batch: str, columns: dict[str, Column], left: tuple[str, ...] = ()) -> DataFrame:
    """df with each array column padded to its batch's longest, and <column>_len; those in `left` are padded before."""
    w = Window.partitionBy(batch)
    for c in columns:
        df = df.withColumn(f"{c}_len", F.size(c)).withColumn(f"_{c}_most", F.max(F.size(c)).over(w))
    for c, fill in columns.items():
        df = df.withColumn(c, padded(F.col(c), F.col(f"_{c}_most"), fill, c in left))
    return df.drop(*[f"_{c}_most" for c in columns])


def collated_records(df: DataFrame, batch: str, key: str, gan: bool = False, dpo: bool = False, speaker: bool = False) -> DataFrame:
    """Training records of batches, longest speech_feat first (place): padded token, frame and sample columns with their lengths.

    speech and pitch_feat are kept only if gan, reject_speech_token only if dpo; embedding is the
    speaker's or the utterance's. Fills have the type of their column's values.
    """
    whole, none = F.lit(0).cast("long"), lambda t: F.lit(0.0).cast(t)
    kinds = {f.name: f.dataType.elementType for f in df.schema if isinstance(f.dataType, T.ArrayType)}
    frame = F.array_repeat(none(kinds["speech_feat"].elementType), F.greatest(F.size(F.get("speech_feat", F.lit(0))), F.lit(0)))
    columns = {"text_token": whole, "speech_token": whole, "speech_feat": frame}
    columns |= {c: none(kinds[c]) for c in ("speech", "pitch_feat")} if gan else {}
    columns |= {"reject_speech_token": whole} if dpo else {}
    place = F.row_number().over(Window.partitionBy(batch).orderBy(F.size("speech_feat").desc(), key)) - 1
    rows = df.select(batch, key, place.cast("long").alias("place"), F.col("spk_embedding" if speaker else "utt_embedding").alias("embedding"), *columns)
    return collated(rows, batch, columns)


def cropped(array: Column, size: int, start: Column, fill: Column) -> Column:
    """`size` values from start on (taken modulo the places there are), or all and then fill."""
    n = F.size(array)
    return F.when(n > size, F.slice(array, (F.pmod(start, n - size + 1) + 1).cast("int"), F.lit(size))).otherwise(F.concat(array, F.array_repeat(fill, F.lit(size) - n)))


def cycled(array: Column, size: int) -> Column:
    """The first `size` values of the array said again and again."""
    times = F.ceil(F.lit(size) / F.greatest(F.size(array), F.lit(1))).cast("int")
    return F.slice(F.flatten(F.array_repeat(array, times)), F.lit(1), F.lit(size))


def picked(names: Column, share: Column, seed: Column) -> Column:
    """round(n x share) of the names, chosen and kept in the order of a hash."""
    ranked = F.array_sort(F.transform(names, lambda x: F.struct(hash32(seed, x).alias("h"), x.alias("x"))))
    return F.transform(F.slice(ranked, F.lit(1), F.round(F.size(names) * share).cast("int")), lambda p: p["x"])


def seeds(df: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    """k rows by the order of a hash (code from 0); with fewer rows they repeat."""
    best = df.withColumn("_hash", hash32(F.lit(seed), key)).orderBy("_hash", key).limit(k)
    n = F.count("*").over(Window.partitionBy())
    ranked = best.withColumn("_rank", F.row_number().over(Window.orderBy("_hash", key)) - 1).withColumn("_n", n)
    return ranked.withColumn("code", F.explode(F.sequence(F.col("_rank").cast("long"), F.lit(k - 1).cast("long"), F.col("_n").cast("long")))).drop("_hash", "_rank", "_n")


def curriculum_cut(tokens: Column, index: Column, total: Column, seed: int, chance: float = 0.3, width: float = 0.1) -> Column:
    """The tokens without the first int(n x index / total); the index is moved by up to width x total with a chance."""
    noise = (coin(seed + 1, index) * 2 - 1) * width * total
    moved = F.greatest(F.lit(0), F.least((index + noise).cast("long"), total - 1))
    at = F.when(coin(seed, index) < chance, moved).otherwise(index)
    cut = (F.size(tokens) * (at / total)).cast("int")
    return F.slice(tokens, cut + 1, F.size(tokens))


def bistream(key: Column, text: Column, speech: Column, ratio: float = 3.0, chance: float = 0.5, seed: int = 0) -> Column:
    """Whether a row is taken as a two-sided stream: by coin, and only with enough speech for its text."""
    return (coin(seed, key) < chance) & (speech / text > ratio)


def conditioning(values: Column, key: Column, seed: int = 0, chance: float = 0.5, share: float = 0.3) -> Column:
    """The first r values and then zeros; none with a chance, otherwise r is dealt from 0 to int(share x n)."""
    n = F.size(values)
    most = (n * share).cast("int")
    r = F.when(coin(seed, key) < chance, 0).otherwise((coin(seed + 1, key) * (most + 1)).cast("int"))
    return let(r, lambda r: F.transform(values, lambda v, i: F.when(i < r, v).otherwise(v * 0)))


def restored(df: DataFrame, key: str, total: int) -> DataFrame:
    """Rows in their first order; raises if one of the keys 0 to total - 1 is missing."""
    n = df.agg(F.countDistinct(key)).first()[0]
    if n != total:
        raise ValueError(f"{total - n} rows are missing")
    return df.orderBy(key)
