"""Row predicates and projections of the record stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of the length filter.
MAX_FRAMES, MIN_FRAMES, MAX_TOKENS, MIN_TOKENS, MIN_RATIO, MAX_RATIO = 10240, 10, 200, 1, 0.0005, 1.0
#: Fixed value: ids that count as a leading begin-of-text.
BOS_IDS = (0, 1, 2)


def length_filter(df: DataFrame, frames: Column, tokens: Column, speech_tokens: Column | None = None, max_frames: int = MAX_FRAMES, min_frames: int = MIN_FRAMES, max_tokens: int = MAX_TOKENS, min_tokens: int = MIN_TOKENS, min_ratio: float = MIN_RATIO, max_ratio: float = MAX_RATIO) -> DataFrame:
    """Rows with frames and tokens within inclusive bounds, a token to frame ratio within its own (not asked without frames), and no empty list of speech tokens."""
    ratio = tokens / frames
    keep = frames.between(min_frames, max_frames) & tokens.between(min_tokens, max_tokens)
    keep &= (frames == 0) | ratio.between(min_ratio, max_ratio)
    if speech_tokens is not None:
        keep &= F.size(speech_tokens) > 0
    return df.filter(keep)


def frames(samples: Column, rate: Column) -> Column:
    """Frames of ten milliseconds."""
    return samples / rate * 100


def usable_rate(rate: Column, target: int, least: int) -> Column:
    """A sample rate is usable as it is, or from the least one on if it must be resampled."""
    return (rate == target) | (rate >= least)


def not_blank(text: Column) -> Column:
    return F.trim(text) != ""


def text_phase(phase: Column, token: Column) -> Column:
    """Tokens of the text phase; without a phase all tokens from 0 on."""
    return (F.coalesce(phase, F.lit("text")) == "text") & (token >= 0)


def without_leading_bos(tokens: Column) -> Column:
    """The tokens without a begin-of-text id in the first place."""
    return F.when(F.get(tokens, F.lit(0)).isin(*BOS_IDS), F.slice(tokens, F.lit(2), F.size(tokens))).otherwise(tokens)


def valid_calls(calls: Column) -> Column:
    """At least one call, and every call has parameters."""
    return F.coalesce((F.size(calls) > 0) & F.forall(calls, lambda c: F.coalesce(F.size(c["parameters"]) > 0, F.lit(False))), F.lit(False))


def only_marks(text: Column) -> Column:
    """No character but punctuation and symbols; true of an empty text."""
    return text.rlike(r"^[\p{P}\p{S}]*$")


def has_chinese(text: Column) -> Column:
    return text.rlike("[一-鿿]")


def ignored(label: Column, ignore: int = -100) -> Column:
    """Labels below 0 become the ignored one."""
    return F.when(label < 0, F.lit(ignore)).otherwise(label)


def missing_parameters(required: Column, parameters: Column) -> Column:
    """Required names that a map of parameters lacks."""
    return F.array_except(required, F.map_keys(parameters))


def length_in_bounds(n: Column, prompt: Column, least: int = 2, most: int = 20) -> Column:
    """An output's length against bounds that follow the prompt's."""
    return n.between(prompt * least, prompt * most)


def voicing(periodicity: Column, loudness: Column, silence: float = -60.0, threshold: float = 0.21) -> Column:
    """Periodicity, 0 in silence and null where it is unvoiced."""
    p = F.when(loudness < silence, 0.0).otherwise(periodicity)
    return F.when(p >= threshold, p)


def compression_choice(df: DataFrame, stage: Column, rate: Column, part: str, with_both: bool = True) -> Column:
    """The text of `part` (question, solution or answer) that a compression stage selects from the columns <part>_compress_<rate>.

    No stage, or rate 1, selects the plain text; question_solution is known only if with_both.
    """
    stages = {"question": ["question"], "solution": ["solution"], "answer": []}
    if with_both:
        stages["question_solution"] = ["question", "solution"]
    suffix = f"{part}_compress_"
    rates = [c for c in df.columns if c.startswith(suffix)]
    packed = F.lit(None).cast("string")
    for c in rates:
        packed = F.when(rate == float(c[len(suffix):]), F.col(f"`{c}`")).otherwise(packed)
    compressed = stage.isin(*[s for s, parts in stages.items() if part in parts])
    known = stage.isNull() | (rate == 1.0) | stage.isin(*stages)
    plain = stage.isNull() | (rate == 1.0) | ~compressed
    return F.when(~known, F.raise_error(F.concat(F.lit("unknown stage "), stage)).cast("string")).when(plain, F.col(part)).otherwise(packed)
