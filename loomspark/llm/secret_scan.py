"""Secret scans, by DataFrame functions alone.

Three base patterns give spans; character Markov models add more. For each candidate token the
models' log-likelihood ratio (random strings against ordinary identifiers) is summed over its
character pairs. Every row is scanned by itself: no shuffle, no group that could be hot, and time in
proportion to the text, however long a token or however many the matches.

The models are trained on labelled rows: hashes of numbers as random strings; as ordinary identifiers,
words of a bounded sample of the texts (SAMPLE_DOCS rows, WORDS words) and of a fixed list, joined as
identifiers are. A tenth of the labelled rows is held out, and sets the threshold.

Defined results: a null text is empty and has no spans; other columns (null or not) are untouched, but
one that is named like the spans' column is replaced, so a caller can name that; repeated rows each get
their own result; spans that begin together are ordered by kind; an empty table gives an empty table, and
nothing to sample leaves the fixed list.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.runtime import let

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Matches of HEX that are long enough. A match of HEX is a whole run of such characters, so this finds the same ones.
LONG_HEX = r"[0-9a-f]{24,}"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
#: Candidates of the Markov models: tokens of 20 characters or more that hold a digit.
TOKEN = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
KINDS = ("assign", "access", "hex", "random")
#: Log-likelihood ratio (nats per character pair) from which a candidate counts as random.
THRESHOLD = 0.25
#: Labelled rows of each kind, rows whose texts are sampled for words, and words that are kept of them.
SAMPLES, SAMPLE_DOCS, WORDS = 6000, 2000, 2000
PARTS = (
    "user account name value index count total request response handler service client server config default "
    "option session cache buffer stream reader writer parser builder factory manager context element document "
    "version release build test data table column record field number string object array list map key hash "
    "file path folder image report order product customer payment invoice address email phone status error "
    "message event queue worker thread process system network remote local public private static final main"
).split()
_BLOCK = 64


def common_words(docs: DataFrame, text: str = "text", rows: int = SAMPLE_DOCS, most: int = WORDS) -> list[str]:
    """Words of 3 to 12 letters from the `rows` texts of smallest hash, the `most` that most of these texts hold."""
    chosen = docs.select(F.xxhash64(text).alias("_h")).distinct().orderBy("_h").limit(rows)
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z])[A-Za-z]{3,12}(?![A-Za-z])"), F.lit(0)))
    sample = docs.select(text).join(F.broadcast(chosen), F.xxhash64(text) == F.col("_h"), "left_semi").distinct()
    words = sample.select(F.explode(found).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return [r["w"] for r in words.orderBy(F.desc("n"), "w").limit(most).collect()]


def labelled_samples(spark: SparkSession, n: int = SAMPLES, parts: list[str] | None = None) -> DataFrame:
    """n made rows of each label (token, label): 1 for random strings, 0 for ordinary identifiers of some parts (PARTS if none)."""
    rows = spark.range(n)
    digest = F.sha2(F.concat(F.lit("random"), F.col("id").cast("string")), 256)
    random = F.when(F.col("id") % 3 == 0, F.substring(digest, 1, 40)).otherwise(
        F.regexp_replace(F.base64(F.unhex(digest)), "=+$", "")
    )
    parts = PARTS if parts is None else parts
    listed = F.from_json(F.lit(json.dumps(parts)), "array<string>")
    pick = lambda k: F.element_at(listed, (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(parts))) + 1).cast("int"))
    number = F.pmod(F.xxhash64("id", F.lit("n")), F.lit(2100)).cast("string")
    sep = F.element_at(F.array(F.lit("_"), F.lit("-"), F.lit("/"), F.lit("")), (F.col("id") % 4 + 1).cast("int"))
    plain = F.concat_ws("", pick(1), sep, F.when(F.col("id") % 4 == 3, F.initcap(pick(2))).otherwise(pick(2)), sep, pick(3), sep, number)
    return rows.select(random.alias("token"), F.lit(1).alias("label")).unionByName(
        rows.select(plain.alias("token"), F.lit(0).alias("label"))
    )


def train(samples: DataFrame, alpha: float = 0.5) -> list[float]:
    """Log-likelihood ratio of each character pair of ALPHABET, row by row; at most len(ALPHABET)^2 counts are collected."""
    k = len(ALPHABET)
    at = lambda i: F.instr(F.lit(ALPHABET), F.expr(f"substr(token, {i}, 1)"))
    pairs = (
        samples.filter(F.length("token") > 1)
        .select("label", F.col("token"), F.explode(F.expr("sequence(1, length(token) - 1)")).alias("i"))
        .select("label", at("i").alias("a"), at("i + 1").alias("b"))
        .filter("a > 0 and b > 0")
        .groupBy("label", "a", "b")
        .count()
    )
    n = [[[alpha] * k for _ in range(k)] for _ in range(2)]
    for r in pairs.collect():
        n[r["label"]][r["a"] - 1][r["b"] - 1] += r["count"]
    out = []
    for a in range(k):
        for b in range(k):
            p, q = (n[x][a][b] / sum(n[x][a]) for x in (1, 0))
            out.append(round(math.log(p / q), 6))
    return out


def threshold_of(samples: DataFrame, llr: list[float], share: float = 0.005) -> float:
    """Halfway between the ratios that all but a share of the ordinary samples stay below and all but a share of the random ones reach; THRESHOLD without samples of both."""
    r = samples.filter(F.length("token") > 1).select("label", _ratio(F.col("token"), llr).alias("r"))
    got = r.agg(F.expr(f"percentile(r, {1 - share}) filter (where label = 0)").alias("plain"), F.expr(f"percentile(r, {share}) filter (where label = 1)").alias("random")).first()
    return THRESHOLD if None in (got["plain"], got["random"]) else round((got["plain"] + got["random"]) / 2, 6)


def fit(docs: DataFrame, text: str = "text") -> tuple[list[float], float]:
    """The models and their threshold, from words of docs."""
    samples = labelled_samples(docs.sparkSession, parts=PARTS + common_words(docs, text))
    held = F.pmod(F.xxhash64("token"), F.lit(10)) == 0
    llr = train(samples.filter(~held))
    return llr, threshold_of(samples.filter(held), llr)


def _ratio(token: Column, llr: list[float]) -> Column:
    """Mean log-likelihood ratio of a token's character pairs."""
    k = len(ALPHABET)
    table = F.from_json(F.lit(json.dumps(llr)), "array<double>")
    places = F.from_json(F.lit(json.dumps([ALPHABET.find(chr(c)) for c in range(128)])), "array<int>")
    at = F.transform(F.split(token, ""), lambda c: F.get(places, F.ascii(c)))
    pairs = lambda x: F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), lambda a, b: F.get(table, a * k + b))
    return let(let(at, pairs), lambda p: F.aggregate(p, F.lit(0.0), lambda acc, v: acc + v) / F.size(p))


def _running(x: Column, op, zero: Column) -> Column:
    """zero, op(zero, x[0]), op(op(zero, x[0]), x[1]), ...: one more value than x has, by blocks, so that growing arrays stay short."""
    fold = lambda a: F.aggregate(a, F.array(zero), lambda acc, v: F.concat(acc, F.array(op(F.element_at(acc, -1), v))))

    def joined(inner: Column, bases: Column) -> Column:
        parts = F.transform(inner, lambda r, i: F.transform(F.slice(r, F.lit(1), F.size(r) - 1), lambda v: op(F.get(bases, i), v)))
        return F.concat(F.flatten(parts), F.array(F.element_at(bases, -1)))

    blocks = lambda x: F.transform(F.sequence(F.lit(0), F.size(x) - 1, F.lit(_BLOCK)), lambda b: fold(F.slice(x, b + 1, F.lit(_BLOCK))))
    return let(let(x, blocks), lambda inner: let(fold(F.transform(inner, lambda r: F.element_at(r, -1))), lambda bases: joined(inner, bases)))


def _spans(text: Column, kind: str, pattern: str, keep, values: Column | None = None) -> Column:
    """Spans (start, end in code points) of the pattern's matches that keep(match, value) accepts; values: one for each match, the match itself if not given."""

    def placed(found: Column, between: Column, values: Column) -> Column:
        sizes = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m).alias("n")))

        def kept(sizes: Column, before: Column) -> Column:
            rows = F.transform(sizes, lambda s, i: F.struct((F.get(before, i) + s["gap"]).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), F.get(before, i + 1).alias("end"), keep(F.get(found, i), F.get(values, i)).alias("keep")))
            return F.transform(F.filter(rows, lambda r: r["keep"]), lambda r: F.struct(r["start"].alias("start"), r["kind"].alias("kind"), r["end"].alias("end")))

        total = lambda s: _running(F.transform(s, lambda x: (x["gap"] + x["n"]).cast("long")), lambda a, v: a + v, F.lit(0).cast("long"))
        return let(sizes, lambda s: let(total(s), lambda before: kept(s, before)))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    spans = let(found, lambda f: let(between, lambda b: placed(f, b, f) if values is None else let(values, lambda v: placed(f, b, v))))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return F.when(text.rlike(pattern), spans).otherwise(none)


def scan(df: DataFrame, llr: list[float], text: str = "text", threshold: float = THRESHOLD, to: str = "secret_spans") -> DataFrame:
    """df with the spans of secrets: array of (start, kind, end), by start and then kind (an index into KINDS)."""
    t = F.coalesce(F.col(text), F.lit(""))
    values = F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(2))
    kinds = [
        _spans(t, "assign", ASSIGN, lambda m, v: F.length(v) >= MIN_ASSIGN, values),
        _spans(t, "access", ACCESS, lambda m, v: F.length(m) >= MIN_ACCESS),
        _spans(t, "hex", LONG_HEX, lambda m, v: F.length(m) >= MIN_HEX),
        _spans(t, "random", TOKEN, lambda m, v: _ratio(m, llr) >= threshold),
    ]
    return df.withColumn(to, F.array_sort(F.concat(*kinds)))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _merged(spans: Column) -> Column:
    """Runs (start, end) of spans, by start, that overlap or touch."""

    def cut(s: Column, most: Column) -> Column:
        # A run begins where no span before reaches; it ends where those before the next run end.
        at = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.get(s, i)["start"] > F.get(most, i))
        return let(F.concat(at, F.array(F.size(s))), lambda k: F.transform(F.slice(k, F.lit(1), F.size(k) - 1), lambda a, i: F.struct(F.get(s, a)["start"].alias("start"), F.get(most, F.get(k, i + 1)).alias("end"))))

    ends = lambda s: _running(F.transform(s, lambda x: x["end"]), F.greatest, F.lit(-1).cast("long"))
    return let(spans, lambda s: let(ends(s), lambda most: cut(s, most)))


def redact(df: DataFrame, text: str = "text", spans: str = "secret_spans", mark: str = "[secret]") -> DataFrame:
    """Each run of overlapping spans becomes one mark; a text without spans stays as it is."""

    def masked(chars: Column, m: Column) -> Column:
        cut = lambda a, b: F.array_join(F.slice(chars, (a + 1).cast("int"), (b - a).cast("int")), "")
        before = lambda i: F.coalesce(F.get(m, i - 1)["end"], F.lit(0).cast("long"))
        pieces = F.transform(m, lambda x, i: F.concat(cut(before(i), x["start"]), F.lit(mark)))
        return F.concat(F.array_join(pieces, ""), cut(F.element_at(m, -1)["end"], F.size(chars).cast("long")))

    whole = let(F.split(F.col(text), ""), lambda chars: let(_merged(F.col(spans)), lambda m: masked(chars, m)))
    return df.withColumn(text, F.when(F.size(spans) > 0, whole).otherwise(F.col(text)))


def secrets_digest(spark: SparkSession, df: DataFrame) -> DataFrame:
    """The contract's columns of a scan."""
    llr, threshold = fit(df)
    found = scan(df.select("doc_id", "text"), llr, threshold=threshold)
    s = F.col("secret_spans")
    count = lambda k: F.size(F.filter(s, lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(listed(F.filter(s, lambda x: x["kind"] < 3)), 256).alias("base_sha256"),
        listed(s).alias("spans"),
    )
