"""Keyed stateful streams: hop windows with overlap, phase machines and two-sided interleaving.

Each operator is a processor over rows (key, seq, token, ..., last) that come in order of seq within
a key, for transformWithStateInPandas; `batch` gives the same rows of a finished table.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Folded(StatefulProcessor):
    """Keeps a key's buffer and counters, hands new rows to fold() and forgets the key after its last row."""

    state_schema = "tokens array<bigint>, numbers array<bigint>"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("session", self.state_schema)

    def start(self) -> tuple[list[int], list[int]]:
        raise NotImplementedError

    def fold(self, key: Any, tokens: list[int], numbers: list[int], rows: list[tuple]) -> tuple[list[int], list[int], list[dict]]:
        """New buffer, counters and output rows after some input rows."""
        raise NotImplementedError

    def finish(self, key: Any, tokens: list[int], numbers: list[int]) -> list[dict]:
        return []

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = pd.concat(list(rows)).sort_values("seq")
        tokens, numbers = self.start()
        if self._state.exists():
            was = self._state.get()
            tokens, numbers = list(was[0]), list(was[1])
        ends = bool(held["last"].any())
        tokens, numbers, out = self.fold(key[0], tokens, numbers, list(held.itertuples(index=False)))
        if ends:
            out += self.finish(key[0], tokens, numbers)
            self._state.clear()
        else:
            self._state.update((tokens, numbers))
        if out:
            yield pd.DataFrame(out)

    def close(self) -> None:
        pass


class HopWindows(Folded):
    """Emits hop + overlap tokens when so many are there, drops the hop, and lets the hop grow up to a limit; the rest follows at the end."""

    output = "key long, chunk long, tokens array<bigint>, final boolean"

    def __init__(self, hop: int = 25, overlap: int = 20, scale: float = 1.0, most: int = 100):
        self.hop, self.overlap, self.scale, self.most = hop, overlap, scale, most

    def start(self):
        return [], [self.hop, 0]

    def fold(self, key, tokens, numbers, rows):
        out = []
        hop, chunk = numbers
        tokens = tokens + [int(r.token) for r in rows]
        while len(tokens) >= hop + self.overlap:
            out.append({"key": key, "chunk": chunk, "tokens": tokens[: hop + self.overlap], "final": False})
            tokens, chunk = tokens[hop:], chunk + 1
            hop = min(self.most, int(hop * self.scale)) if self.scale != 1 else hop
        return tokens, [hop, chunk], out

    def finish(self, key, tokens, numbers):
        return [{"key": key, "chunk": numbers[1], "tokens": tokens, "final": True}]


class PrefixWindows(Folded):
    """Emits all tokens so far with a look-ahead; the first hop is filled up so that prompt and hop end together. Output names the offset of what is new."""

    output = "key long, chunk long, start long, stop long, final boolean"

    def __init__(self, hop: int = 25, look_ahead: int = 3, prompt: int = 0):
        self.hop, self.look_ahead, self.prompt = hop, look_ahead, prompt

    def start(self):
        return [], [0, 0, 0]

    def fold(self, key, tokens, numbers, rows):
        n, offset, chunk = numbers
        n += len(rows)
        out = []
        while True:
            hop = self.hop + (-self.prompt % self.hop if offset == 0 else 0)
            if n - offset < hop + self.look_ahead:
                return [], [n, offset, chunk], out
            out.append({"key": key, "chunk": chunk, "start": offset, "stop": offset + hop, "final": False})
            offset, chunk = offset + hop, chunk + 1

    def finish(self, key, tokens, numbers):
        n, offset, chunk = numbers
        return [{"key": key, "chunk": chunk, "start": offset, "stop": n, "final": True}]


class Phases(Folded):
    """Rows of a text phase and then an audio phase: the text phase ends with a token, or after a budget of tokens, which forces that token's place."""

    output = "key long, step long, text_token long, audio_token long, is_text_end boolean, is_audio_end boolean"

    def __init__(self, text_end: int, audio_end: int, budget: int):
        self.text_end, self.audio_end, self.budget = text_end, audio_end, budget

    def start(self):
        return [], [0, 0]

    def fold(self, key, tokens, numbers, rows):
        step, speaks = numbers
        out = []
        for r in rows:
            token = int(r.token)
            if not speaks:
                token = self.text_end if step + 1 >= self.budget else token
                end = token == self.text_end
                out.append({"key": key, "step": step, "text_token": token, "audio_token": None, "is_text_end": end, "is_audio_end": False})
                speaks = int(end)
            elif speaks == 1:
                end = token == self.audio_end
                out.append({"key": key, "step": step, "text_token": None, "audio_token": token, "is_text_end": True, "is_audio_end": end})
                speaks = 2 if end else 1
            step += 1
        return [], [step, speaks], out


class TwoSided(Folded):
    """Text and speech tokens in rounds as both arrive: `text_chunk` of text, then `speech_chunk` of speech; the rest at the end."""

    output = "key long, place long, token long, is_text boolean"

    def __init__(self, text_chunk: int = 5, speech_chunk: int = 15):
        self.text_chunk, self.speech_chunk = text_chunk, speech_chunk

    def start(self):
        return [], [0, 0]

    def fold(self, key, tokens, numbers, rows):
        # The buffer holds text first; numbers: how much of it is text, and the next place.
        n, place = numbers
        text = tokens[:n] + [int(r.token) for r in rows if r.is_text]
        speech = tokens[n:] + [int(r.token) for r in rows if not r.is_text]
        out = []
        while len(text) >= self.text_chunk and len(speech) >= self.speech_chunk:
            for part, kind in ((text[: self.text_chunk], True), (speech[: self.speech_chunk], False)):
                out += [{"key": key, "place": place + i, "token": t, "is_text": kind} for i, t in enumerate(part)]
                place += len(part)
            text, speech = text[self.text_chunk :], speech[self.speech_chunk :]
        return text + speech, [len(text), place], out

    def finish(self, key, tokens, numbers):
        n, place = numbers
        return [{"key": key, "place": place + i, "token": t, "is_text": i < n} for i, t in enumerate(tokens)]


def stream(rows: DataFrame, processor: Folded) -> DataFrame:
    """The processor over a stream of rows (key, seq, token, ..., last)."""
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=processor, outputStructType=processor.output, outputMode="Append", timeMode="None")


def hop_windows(rows: DataFrame, hop: int, overlap: int) -> DataFrame:
    """The rows of HopWindows with a fixed hop, by built-in operators: a token goes to each chunk that holds its place, so no key is held whole."""
    w = Window.partitionBy("key").orderBy("seq")
    sizes = rows.groupBy("key").agg(F.count("*").alias("_n"), F.bool_or("last").alias("_ended"))
    sizes = sizes.withColumn("_full", F.greatest(F.lit(0).cast("long"), F.floor((F.col("_n") - overlap - hop) / hop) + 1))
    placed = rows.withColumn("_i", F.row_number().over(w) - 1).select("key", "token", "_i").join(sizes, "key")
    lo = F.greatest(F.lit(0).cast("long"), F.floor((F.col("_i") - hop - overlap) / hop) + 1)
    hi = F.least(F.floor(F.col("_i") / hop), F.col("_full") - 1)
    none = F.array().cast("array<bigint>")
    own = F.concat(F.when(hi >= lo, F.sequence(lo, hi)).otherwise(none), F.when(F.col("_ended") & (F.col("_i") >= F.col("_full") * hop), F.array("_full")).otherwise(none))
    dealt = placed.select("key", "token", "_i", "_full", F.explode(own).alias("chunk"))
    out = dealt.groupBy("key", "chunk", "_full").agg(F.array_sort(F.collect_list(F.struct("_i", F.col("token").cast("long").alias("token")))).alias("t"))
    out = out.select("key", "chunk", F.transform("t", lambda x: x["token"]).alias("tokens"), (F.col("chunk") == F.col("_full")).alias("final"))
    # A rest without tokens still ends its key.
    bare = sizes.filter(F.col("_ended") & (F.col("_n") == F.col("_full") * hop)).select("key", F.col("_full").alias("chunk"), none.alias("tokens"), F.lit(True).alias("final"))
    return out.unionByName(bare)


def batch(rows: DataFrame, processor: Folded) -> DataFrame:
    """The same rows of a finished table."""
    if isinstance(processor, HopWindows) and processor.scale == 1:
        return hop_windows(rows, processor.hop, processor.overlap)
    names = [f.split(" ")[0] for f in processor.output.split(", ")]

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("seq")
        key = p["key"].iloc[0]
        tokens, numbers = processor.start()
        tokens, numbers, out = processor.fold(key, tokens, numbers, list(p.itertuples(index=False)))
        if bool(p["last"].any()):
            out += processor.finish(key, tokens, numbers)
        return pd.DataFrame(out, columns=names)

    return rows.groupBy("key").applyInPandas(run, processor.output)


def streamed(rows: DataFrame, processor: Folded, work: str) -> DataFrame:
    """rows (key, seq, token, ..., last) through a file source, in two runs of the query by seq that share its checkpoint, and the sink's rows."""
    spark = rows.sparkSession
    middle = rows.groupBy("key").agg(F.floor(F.avg("seq")).alias("_middle"))
    halved = rows.join(middle, "key")
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        for part in (halved.filter("seq <= _middle"), halved.filter("seq > _middle")):
            part.drop("_middle").write.mode("append").parquet(f"{work}/source")
            read = spark.readStream.schema(rows.schema).parquet(f"{work}/source")
            q = stream(read, processor).writeStream.format("parquet").option("path", f"{work}/sink").option("checkpointLocation", f"{work}/state").trigger(availableNow=True).start()
            q.awaitTermination()
    finally:
        if old is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    return spark.read.schema(processor.output).parquet(f"{work}/sink")


def multiplexed(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """rows of interleaved requests with their turn in their own request's queue, and whether they close it."""
    w = Window.partitionBy(key).orderBy(seq)
    return rows.withColumn("turn", (F.row_number().over(w) - 1).cast("long")).withColumn("closes", F.lead(seq).over(w).isNull())


def fed(rows: DataFrame, key: str, seq: str, ids: str) -> DataFrame:
    """(key, place, id): the ids of a request's text pieces, which come one after the other, as one sequence."""
    w = Window.partitionBy(key).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    n = F.greatest(F.size(ids), F.lit(0))
    started = rows.withColumn("_start", F.coalesce(F.sum(n).over(w), F.lit(0).cast("long")))
    return started.select(key, "_start", F.posexplode(ids).alias("_i", "id")).select(key, (F.col("_start") + F.col("_i")).alias("place"), "id")


def first_output(rows: DataFrame, key: str, ts: str, kind: str, first: str, out: str) -> DataFrame:
    """(key, latency, n): seconds from a key's first `first` row to its first `out` row, and how many rows `out` has."""
    at = lambda k: F.min(F.when(F.col(kind) == k, F.col(ts)))
    seconds = F.unix_micros(at(out).cast("timestamp")) - F.unix_micros(at(first).cast("timestamp"))
    return rows.groupBy(key).agg((seconds / 1e6).alias("latency"), F.count_if(F.col(kind) == out).alias("n"))


def encode_windows(n, context: int, sub: int, chunk: int, left: int):
    """(start, stop, cache): the inputs of each chunk of an incremental encoder, and how many outputs its cache keeps."""
    window, stride = (chunk - 1) * sub + context, sub * chunk
    last = n - context + 1
    starts = F.when(last > 0, F.sequence(F.lit(0).cast("long"), (last - 1).cast("long"), F.lit(stride).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.transform(starts, lambda s, i: F.struct(s.alias("start"), F.least(s + window, n).alias("stop"), F.least(i * chunk, F.lit(chunk * left)).cast("long").alias("cache")))


def new_suffix(values, offset):
    """What a recomputed sequence has beyond what was already given out."""
    return F.slice(values, offset + 1, F.greatest(F.size(values) - offset, F.lit(0)))
