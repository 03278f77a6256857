"""Readers and sinks of the record formats."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_parquet_rows(spark: SparkSession, path: str, columns: Iterable[str] | None = None, skip_corrupt: bool = True) -> DataFrame:
    """Rows of Parquet files; files that can't be read are skipped if skip_corrupt."""
    df = spark.read.option("ignoreCorruptFiles", str(skip_corrupt).lower()).parquet(path)
    return df.select(*columns) if columns else df


def fan_out(rows: DataFrame, texts: DataFrame, key: str = "utt") -> DataFrame:
    """One row for each of rows and each text of its key, with tts_index and tts_text; texts: (key, texts array)."""
    return rows.join(texts, key).select(*rows.columns, F.posexplode("texts").alias("tts_index", "tts_text"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file; blank lines are no rows."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per line; characters outside ASCII stay as they are."""
    df.write.mode(mode).json(path)


def json_items(df: DataFrame, column: str, item: str, to: str = "item") -> DataFrame:
    """A row for each object of a column of JSON texts: an object counts as a list of one; other types raise."""
    text = F.trim(F.col(column))
    listed = F.when(text.startswith("["), text).when(text.startswith("{"), F.concat(F.lit("["), text, F.lit("]")))
    checked = F.when(text.startswith("[") | text.startswith("{"), listed).otherwise(F.raise_error(F.lit("neither a JSON list nor an object")).cast("string"))
    return df.withColumn(to, F.explode(F.from_json(checked, f"array<{item}>")))


def example_lists(df: DataFrame, column: str, item: str, to: str = "example") -> DataFrame:
    """A row for each example of JSON texts that are a list, or an object with the list under `examples`."""
    c = F.col(column)
    listed = F.coalesce(F.from_json(F.get_json_object(c, "$.examples"), f"array<{item}>"), F.when(F.trim(c).startswith("["), F.from_json(c, f"array<{item}>")))
    return df.withColumn(to, F.explode(F.coalesce(listed, F.raise_error(F.lit("no examples")).cast(f"array<{item}>"))))


def read_lists(spark: SparkSession, path: str) -> DataFrame:
    """Stripped lines of a list file."""
    return spark.read.text(path).select(F.trim("value").alias("src"))


def last_wins(df: DataFrame, key: str, order: str, *values: str) -> DataFrame:
    """For each key the values of its latest row."""
    return df.groupBy(key).agg(*[F.max_by(v, order).alias(v) for v in values])


def first_wins(df: DataFrame, key: str, order: str, *values: str) -> DataFrame:
    """For each key the values of its earliest row."""
    return df.groupBy(key).agg(*[F.min_by(v, order).alias(v) for v in values])


@dataclass
class Source:
    """One entry of a mixing manifest."""

    name: str
    dataset_path: str
    data_struct: str
    sampling_rate: float = 1.0
    stage: str | None = None
    rate: float = 1.0
    system_prompt: str = ""


@dataclass
class Manifest:
    sources: list[Source] = field(default_factory=list)

    @classmethod
    def parse(cls, entries: list[dict], check_exists: bool = False) -> "Manifest":
        """Checks names (unique), rates (in (0, 1]; compression above 0) and paths."""
        out = cls()
        for e in entries:
            compress = e.get("compress") or {}
            s = Source(e["name"], expand(e["dataset_path"]), e["data_struct"], float(e.get("sampling_rate", 1.0)), compress.get("stage"), float(compress.get("rate", 1.0)), e.get("system_prompt") or "")
            if s.name in {x.name for x in out.sources}:
                raise ValueError(f"two sources are named {s.name}")
            if not 0 < s.sampling_rate <= 1:
                raise ValueError(f"{s.name}: sampling_rate must be in (0, 1]")
            if s.rate <= 0:
                raise ValueError(f"{s.name}: compress.rate must be above 0")
            if check_exists and not os.path.exists(s.dataset_path):
                raise FileNotFoundError(s.dataset_path)
            out.sources.append(s)
        return out

    @classmethod
    def load(cls, path: str, check_exists: bool = False) -> "Manifest":
        """Reads a YAML file with a list of sources."""
        import yaml

        with open(path, encoding="utf-8") as f:
            return cls.parse(yaml.safe_load(f), check_exists)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(vars(s).values()) for s in self.sources], "name string, dataset_path string, data_struct string, sampling_rate double, stage string, rate double, system_prompt string")


def expand(path: str) -> str:
    """A path with ~ and $VAR replaced."""
    return os.path.expanduser(os.path.expandvars(path))


def read_binary(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)


def verified(content: Column, prefix: Column) -> Column:
    """Whether the SHA-256 of the content begins with a prefix."""
    return F.sha2(content.cast("binary"), 256).startswith(prefix)


def step_key(step: Column, digits: int = 8) -> Column:
    """A step number filled with zeros."""
    return F.lpad(step.cast("string"), digits, "0")


def generation_rows(df: DataFrame, step: str, prediction: str, truth: str, source: str, question: str) -> dict[str, DataFrame]:
    """The three result sets of a generation run, keyed by step; a missing truth falls back to the source text, lists are joined by ' / '."""
    key = step_key(F.col(step)).alias("key")
    joined = lambda c: F.concat_ws(" / ", c)
    return {
        "prediction": df.select(key, joined(F.col(prediction)).alias("text")),
        "truth": df.select(key, F.coalesce(F.col(truth), F.col(source)).alias("text")),
        "question": df.select(key, F.col(question).alias("text")),
    }


def write_results(df: DataFrame, path: str, columns: list[str]) -> None:
    """The same rows as JSON lines and as CSV with a header, columns in a fixed order."""
    out = df.select(*columns)
    out.write.json(f"{path}/json")
    out.write.option("header", True).csv(f"{path}/csv")


def append_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def run_info(df: DataFrame, **info: str) -> DataFrame:
    """df with the run's settings as columns, for a file beside saved weights."""
    return df.withColumns({k: F.lit(v) for k, v in info.items()})


def throttled(df: DataFrame, index: str, interval: int) -> DataFrame:
    """Rows of every interval-th step."""
    return df.filter((F.col(index) + 1) % interval == 0)


def average_lowest(scores: DataFrame, weights: DataFrame, n: int, key: str = "checkpoint", loss: str = "loss") -> DataFrame:
    """Elementwise mean (pos, value) over the n checkpoints of lowest loss; weights: (key, values array)."""
    best = scores.orderBy(loss, key).limit(n).select(key)
    return weights.join(F.broadcast(best), key).select(F.posexplode("values").alias("pos", "value")).groupBy("pos").agg(F.avg(F.col("value").cast("double")).alias("value"))


def format_by_marker(listing: DataFrame, markers: dict[str, str], folder: str = "folder", name: str = "name") -> DataFrame:
    """(folder, format) by which marker file a folder holds; the first of markers wins, none raises."""
    names = F.collect_set(name)
    out = F.raise_error(F.lit("no known marker file")).cast("string")
    for marker, kind in reversed(markers.items()):
        out = F.when(F.array_contains("names", marker), F.lit(kind)).otherwise(out)
    return listing.groupBy(folder).agg(names.alias("names")).select(folder, out.alias("format"))


def audio_pairs(df: DataFrame, path: str = "path") -> DataFrame:
    """Adds the reference path that a synthesized file's name gives: <root>/<a>/<b>/<file> for <a>_<b>_..."""
    file = F.element_at(F.split(F.col(path), "/"), -1)
    parts = F.split(file, "_")
    return df.withColumn("reference", F.concat_ws("/", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), file))


def write_each(df: DataFrame, path: str, folder: str, name: str, text: str, suffix: str = ".json") -> None:
    """A file <folder>/<name><suffix> with each row's text, by the workers' file systems."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        files, top = fs.FileSystem.from_uri(path)
        for b in batches:
            for where, what, said in zip(*(b.column(c).to_pylist() for c in (folder, name, text))):
                files.create_dir(f"{top}/{where}", recursive=True)
                with files.open_output_stream(f"{top}/{where}/{what}{suffix}") as out:
                    out.write(said.encode())
            yield pa.record_batch([pa.array([b.num_rows], pa.int64())], ["n"])

    df.select(folder, name, text).mapInArrow(run, "n long").agg(F.sum("n")).collect()


def read_dumps(spark: SparkSession, path: str, schema: str, key: str = "question_key", suffix: str = ".json") -> DataFrame:
    """One row for each key of the JSON dumps in a folder and the folders in it; files that can't be read go, a missing key is the file's stem, and of a repeated key the first file's stays."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(path)
    below = F.split(F.substring_index(F.regexp_replace("path", r"/+", "/"), "/" + os.path.basename(path.rstrip("/")) + "/", -1), "/")
    rows = raw.select(below.alias("_at"), F.col("content").cast("string").alias("_raw")).filter(F.size("_at") <= 2)
    rows = rows.withColumn("_r", F.from_json("_raw", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})).filter(F.col("_r").isNotNull() & F.col("_r._bad").isNull())
    stem = F.regexp_replace(F.element_at("_at", -1), re.escape(suffix) + "$", "")
    named = rows.withColumn("_key", F.coalesce(F.nullif(F.col(f"_r.{key}"), F.lit("")), stem))
    best = named.groupBy("_key").agg(F.min_by("_r", "_at").alias("_r"))
    return best.select(F.col("_key").alias(key), *[F.col(f"_r.{f.name}").alias(f.name) for f in T._parse_datatype_string(schema).fields if f.name != key])


def first_valid(responses: DataFrame, key: str, attempt: str, text: str, state: Column, most: int = 8, delay: float = 10.0) -> DataFrame:
    """(key, attempt, text, waited): the first attempt whose state is 'ok' among the first `most`, and the seconds of linear back-off before it; without one, attempt and text are null and waited covers all."""
    tried = responses.filter(F.col(attempt) <= most).select(key, F.col(attempt).cast("long").alias("_n"), F.col(text).alias("_text"), (state == "ok").alias("_ok"))
    got = tried.groupBy(key).agg(F.min(F.when(F.col("_ok"), F.struct("_n", "_text"))).alias("_best"), F.max("_n").alias("_last"))
    failed = F.coalesce(F.col("_best._n") - 1, F.least(F.col("_last"), F.lit(most - 1).cast("long")))
    return got.select(key, F.col("_best._n").alias("attempt"), F.col("_best._text").alias("text"), (failed * (failed + 1) / 2 * delay).alias("waited"))
