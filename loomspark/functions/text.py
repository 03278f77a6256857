"""Text cleaning, JSON checks, splitting and tokenizing as column functions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Marks that end a piece, by language; commas count on demand.
MARKS_ZH, MARKS = "。？！；：、.?!;", ".?!;:"
COMMAS = "，,"
QUOTES = '"”'
#: Language names and their codes.
LANGUAGES = {"english": "en", "chinese": "zh", "german": "de", "spanish": "es", "french": "fr", "mandarin": "zh", "castilian": "es"}


def clean_json(text: Column) -> Column:
    """JSON text without white space and code fences around it."""
    x = F.regexp_replace(text, r"^\s+|\s+$", "")
    x = F.regexp_replace(x, r"^```json\s*", "")
    return F.regexp_replace(x, r"\s*```$", "")


def without_controls(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x1f\x7f]", "")


def envelope(text: Column) -> Column:
    """'empty', 'invalid', 'error' or 'ok' for a response's text."""
    valid = F.coalesce(F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))), F.lit(0)) == 1
    return (
        F.when(F.coalesce(F.trim(text), F.lit("")) == "", "empty")
        .when(~valid, "invalid")
        .when(F.get_json_object(text, "$.error").isNotNull(), "error")
        .otherwise("ok")
    )


def message_content(text: Column) -> Column:
    """The first choice's message of a chat response, null if blank."""
    c = F.get_json_object(text, "$.choices[0].message.content")
    return F.when(F.trim(c) != "", c)


def json_or_wrapped(text: Column) -> Column:
    """The text if it is JSON, or between brackets if that makes it JSON; null otherwise."""
    wrapped = F.concat(F.lit("["), text, F.lit("]"))
    n = F.json_array_length(wrapped)
    return F.when(n == 1, text).when(n > 1, wrapped)


def last_user_line(transcript: Column) -> Column:
    """What follows 'user:' in the last line that begins so."""
    lines = F.filter(F.split(transcript, "\n"), lambda x: F.lower(F.trim(x)).startswith("user:"))
    return F.when(F.size(lines) > 0, F.trim(F.substr(F.trim(F.element_at(lines, -1)), F.lit(6))))


def names(items: Column) -> Column:
    """Stripped names without blanks."""
    return F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")


def plain_marks(text: Column) -> Column:
    """Raised digits written out, brackets and long dashes away."""
    x = F.replace(F.replace(text, F.lit("²"), F.lit("平方")), F.lit("³"), F.lit("立方"))
    for c in "（）【】`":
        x = F.replace(x, F.lit(c), F.lit(""))
    return F.replace(x, F.lit("——"), F.lit(" "))


_ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "- - twenty thirty forty fifty sixty seventy eighty ninety".split()
_SCALES = "- thousand million billion trillion quadrillion quintillion".split()


def number_words(n: int) -> str:
    """An integer in English words."""
    if n < 20:
        return _ONES[n]
    if n < 100:
        return _TENS[n // 10] + (f"-{_ONES[n % 10]}" if n % 10 else "")
    if n < 1000:
        return f"{_ONES[n // 100]} hundred" + (f" and {number_words(n % 100)}" if n % 100 else "")
    parts, k = [], 0
    while n:
        n, low = divmod(n, 1000)
        if low:
            parts.append((number_words(low) + (f" {_SCALES[k]}" if k else ""), low, k))
        k += 1
        if k == len(_SCALES) and n:
            return " ".join([number_words(int(d)) for d in str(n)] + [p[0] for p in reversed(parts)])
    texts = [p[0] for p in reversed(parts)]
    last = parts[0]
    if len(texts) > 1 and last[2] == 0 and last[1] < 100:
        return ", ".join(texts[:-1]) + f" and {texts[-1]}"
    return ", ".join(texts)


def spelt_numbers(df: DataFrame, text: str, to: str) -> DataFrame:
    """df with each digit run of a text in words."""

    @F.pandas_udf("string")
    def spell(x: pd.Series) -> pd.Series:
        memo: dict[str, str] = {}

        def one(m: re.Match) -> str:
            d = m.group()
            if d not in memo:
                if len(memo) > 100_000:
                    memo.clear()
                memo[d] = number_words(int(d)) if len(d) <= 21 else " ".join(_ONES[int(c)] for c in d)
            return memo[d]

        return x.map(lambda t: None if t is None else re.sub(r"[0-9]+", one, t))

    return df.withColumn(to, spell(text))


def pieces(text: Column, zh: bool = False, comma_split: bool = False) -> Column:
    """The text cut after its marks, a closing quote kept with its mark; of a run of marks the first stays. An empty text has none."""
    marks = (MARKS_ZH if zh else MARKS) + (COMMAS if comma_split else "")
    any_mark = "[" + "".join("\\" + c if c in ".?" else c for c in marks) + "]"
    end = "。" if zh else "."
    closed = F.when(text == "", text).when(F.right(text, F.lit(1)).rlike(any_mark), text).otherwise(F.concat(text, F.lit(end)))
    found = F.regexp_extract_all(closed, F.lit(f"([^{marks.replace('.', '.')}]+{any_mark})([{QUOTES}]?){any_mark}*"), F.lit(0))
    return F.transform(found, lambda x: F.regexp_replace(x, f"^([^{marks}]+{any_mark}[{QUOTES}]?).*$", "$1"))


def merged_pieces(parts: Column, length, most: int = 80, least: int = 60, tail: int = 20) -> Column:
    """Pieces joined greedily: one closes when it is longer than `least` and the next would lift it above `most`; a last one below `tail` joins the one before."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, x: Column) -> Column:
        close = (length(F.concat(acc["open"], x)) > most) & (length(acc["open"]) > least)
        return F.struct(F.when(close, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"), F.when(close, x).otherwise(F.concat(acc["open"], x)).alias("open"))

    def finish(acc: Column) -> Column:
        n = F.size(acc["done"])
        joined = F.concat(F.slice(acc["done"], F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(F.concat(F.coalesce(F.get(acc["done"], n - 1), F.lit("")), acc["open"])))
        return F.when(acc["open"] == "", acc["done"]).when((length(acc["open"]) < tail) & (n > 0), joined).otherwise(F.concat(acc["done"], F.array(acc["open"])))

    return F.aggregate(parts, start, step, finish)


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, " "), lambda x: x != ""))


def split_paragraph(text: Column, zh: bool = False, most: int = 80, least: int = 60, tail: int = 20, comma_split: bool = False) -> Column:
    """Pieces of a text; length is in characters for Chinese, in words otherwise."""
    return merged_pieces(pieces(text, zh, comma_split), F.length if zh else word_count, most, least, tail)


def without_blanks(text: Column) -> Column:
    """Spaces stay only between two ASCII characters that aren't spaces."""
    return F.regexp_replace(text, r"(?<![\x00-\x1f\x21-\x7f]) | (?![\x00-\x1f\x21-\x7f])", "")


def normalised(text: Column, zh: bool = False) -> Column:
    """Pieces ready to be spoken: marked-up texts stay whole; punctuation alone goes."""
    cleaned = F.trim(text)
    if zh:
        cleaned = plain_marks(without_blanks(F.replace(cleaned, F.lit("\n"), F.lit(""))))
        cleaned = F.regexp_replace(F.replace(cleaned, F.lit("."), F.lit("。")), "[，,、]+$", "。")
    kept = F.filter(split_paragraph(cleaned, zh), lambda x: ~x.rlike(r"^[\p{P}\p{S}\s]*$"))
    return F.when(text.contains("<|") & text.contains("|>"), F.array(text)).otherwise(kept)


def encoded(text: Column, specials: dict[str, int] | None = None, size: int = 50_000) -> Column:
    """Ids of a deterministic word tokenizer: specials have their own, other words a hashed one."""
    from loomspark.runtime import hash32

    words = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    known = F.create_map(*[F.lit(x) for kv in (specials or {"<unk>": size}).items() for x in kv])
    return F.transform(words, lambda w: F.coalesce(F.try_element_at(known, w).cast("long"), F.pmod(hash32(w), F.lit(size))))


def language(name: Column) -> Column:
    """A language's code from its code or name; an unknown one raises."""
    codes = F.create_map(*[F.lit(x) for kv in ({c: c for c in LANGUAGES.values()} | LANGUAGES).items() for x in kv])
    return F.coalesce(F.try_element_at(codes, F.lower(name)), F.raise_error(F.concat(F.lit("unknown language "), name)).cast("string"))


def compressed(df: DataFrame, key: str, text: str, rate: float, to: str = "compressed") -> DataFrame:
    """df with the share `rate` (rounded up) of each text's words that fewest other texts hold, in their order; of equally frequent ones the earlier. Blank texts give ''."""
    words = df.select(key, F.posexplode(F.filter(F.split(F.col(text), r"\s+"), lambda x: x != "")).alias("pos", "word"))
    spread = words.groupBy("word").agg(F.countDistinct(key).alias("df"))
    ranked = words.join(spread, "word").withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy("df", "pos"))).withColumn("n", F.count("*").over(Window.partitionBy(key)))
    kept = ranked.filter(F.col("r") <= F.ceil(F.col("n") * rate)).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("w"))
    kept = kept.select(key, F.array_join(F.transform("w", lambda x: x["word"]), " ").alias(to))
    return df.join(kept, key, "left").withColumn(to, F.coalesce(F.col(f"`{to}`"), F.lit("")))
