"""Token packing, interleaving and label masks on arrays.

Fixed values of the vocabulary layout: the text vocabulary takes ids 0 to 151999, with specials from
151936 on; each audio layer takes 6625 ids, with specials from 6561 on.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspark.runtime import let

TEXT_VOCAB, AUDIO_VOCAB = 152_000, 6_625
TEXT_SPECIAL, AUDIO_SPECIAL = 151_936, 6_561
TEXT = {n: TEXT_SPECIAL + i for i, n in enumerate(("eot", "pad_t", "input_t", "answer_t", "asr", "com_qt", "com_at", "com_aat", "com_think", "end_think"))}
AUDIO = {n: AUDIO_SPECIAL + i for i, n in enumerate(("eoa", "pad_a", "input_a", "answer_a", "split"))}
IGNORE = -100
REPLACEMENT = 6_560
CODES = 4_096


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def _repeat(x: int, n: Column | int) -> Column:
    return F.array_repeat(_long(x), F.lit(n) if isinstance(n, int) else n)


def _strided(a: Column, step: int, first: int) -> Column:
    """Values first, first + step, ... of an array."""
    return F.filter(a, lambda x, i: i % step == first)


def _shifted(a: Column, layer: int) -> Column:
    return F.transform(a, lambda x: layer_shift(x, layer))


def _places(frames: Column, places: tuple[int, ...]) -> Column:
    return F.flatten(F.transform(frames, lambda f: F.transform(F.array(*map(F.lit, places)), lambda i: F.get(f, i))))


def _chunk(a: Column, start: Column, n: int, f=lambda x: x) -> Column:
    """f of the n values from start on, fewer at the end; a slice inside a lambda would copy the whole array for each chunk."""
    stop = F.least(start + n, F.size(a)) - 1
    places = F.when(stop >= start, F.sequence(start, stop)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: f(F.get(a, i)))


def layer_shift(x: Column, layer: Column | int) -> Column:
    """An audio id's place in the joint vocabulary."""
    return x + TEXT_VOCAB + layer * AUDIO_VOCAB


def simple_shift(x: Column, layer: Column | int = 0) -> Column:
    """As layer_shift, for models with one audio vocabulary."""
    return x + TEXT_VOCAB


def upsampled(tokens: Column, factor: int, blank: int | None = None) -> Column:
    """Each token `factor` times, or once and then blanks."""
    if blank is None:
        return F.flatten(F.transform(tokens, lambda t: F.array_repeat(t, F.lit(factor))))
    return F.flatten(F.transform(tokens, lambda t: F.concat(F.array(t), _repeat(blank, factor - 1))))


def single_layer(tokens: Column, latency: int, pad: int = AUDIO["pad_a"], end: int = AUDIO["eoa"]) -> Column:
    return F.concat(_repeat(pad, latency), tokens, F.array(_long(end)))


def grouped_layers(tokens: Column, layers: int, latency: int = 0, pad: int = AUDIO["pad_a"], end: int = AUDIO["eoa"], fill_with_end: bool = False) -> Column:
    """Tokens dealt round robin to layers, after an end token and fill to a full round; fill_with_end fills with ends and knows no latency."""
    if fill_with_end and latency:
        raise ValueError("no latency with end fill")
    full = F.concat(tokens, F.array(_long(end)))
    full = F.concat(full, _repeat(end if fill_with_end else pad, F.pmod(-F.size(full), F.lit(layers))))
    return F.array(*[F.concat(_repeat(pad, latency), _strided(full, layers, l)) for l in range(layers)])


def ungrouped(layers: Column, latency: int = 0, pad: int = AUDIO["pad_a"], end: int = AUDIO["eoa"], replacement: int = REPLACEMENT) -> Column:
    """The tokens of dealt layers up to the first end, pads replaced; null without an end."""

    def joined(layers: Column) -> Column:
        n = F.size(F.get(layers, F.lit(0)))
        steps = F.when(n > latency, F.sequence(F.lit(latency), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.flatten(F.transform(steps, lambda i: F.transform(layers, lambda l: F.get(l, i))))

    def cut(flat: Column) -> Column:
        at = F.array_position(flat, _long(end))
        return F.when(at > 0, F.transform(F.slice(flat, F.lit(1), at.cast("int") - 1), lambda x: F.when(x == pad, _long(replacement)).otherwise(x)))

    return let(let(layers, joined), cut)


def delayed_layers(tokens: Column, pad: int, end: int, width: int = 8) -> Column:
    """Layers 1 to width - 1 of tokens in groups of `width` (whose first is a mark): layer l waits l steps and is filled to a common length."""
    return F.array(*[F.concat(_repeat(pad, l), _strided(tokens, width, l), F.array(_long(end)), _repeat(pad, width - 1 - l)) for l in range(1, width)])


def undelayed(layers: Column, width: int = 8) -> Column:
    """Frames (arrays of width - 1 values) of delayed layers, without what follows the end."""

    def framed(layers: Column) -> Column:
        n = F.size(F.get(layers, F.lit(0))) - width
        frames = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(frames, lambda i: F.transform(layers, lambda l, k: F.get(l, i + k + 1)))

    return let(layers, framed)


#: Which places of a frame belong to each level, coarse to fine.
LEVELS = {3: ((0,), (1, 4), (2, 3, 5, 6)), 4: ((0,), (1, 8), (2, 5, 9, 12), (3, 4, 6, 7, 10, 11, 13, 14))}


def hierarchy(frames: Column, levels: int = 3) -> Column:
    """Frames as one array per level."""
    return let(frames, lambda f: F.array(*[_places(f, places) for places in LEVELS[levels]]))


def interleaved(text: Column, speech: Column, text_chunk: int = 13, speech_chunk: int = 26) -> Column:
    """(token, is_text) in turns of text_chunk and speech_chunk until both are used up."""
    part = lambda a, i, n, t: _chunk(a, i * n, n, lambda x: F.struct(x.alias("token"), F.lit(t).alias("is_text")))

    def dealt(text: Column, speech: Column) -> Column:
        rounds = F.greatest(F.ceil(F.size(text) / text_chunk), F.ceil(F.size(speech) / speech_chunk)).cast("int")
        turns = F.when(rounds > 0, F.sequence(F.lit(0), rounds - 1)).otherwise(F.array().cast("array<int>"))
        return F.flatten(F.transform(turns, lambda i: F.concat(part(text, i, text_chunk, True), part(speech, i, speech_chunk, False))))

    return let(text, lambda t: let(speech, lambda s: dealt(t, s)))


def with_fill(text: Column, speech: Column, fill: int, text_chunk: int = 5, speech_chunk: int = 15) -> Column:
    """Full rounds of text and speech, each text chunk followed by its speech; where text runs out a fill token closes it and the rest of the speech follows."""

    def dealt(text: Column, speech: Column) -> Column:
        rounds = F.floor(F.size(text) / text_chunk).cast("int")
        turns = F.when(rounds > 0, F.sequence(F.lit(0), rounds - 1)).otherwise(F.array().cast("array<int>"))
        body = F.flatten(F.transform(turns, lambda i: F.concat(_chunk(text, i * text_chunk, text_chunk), _chunk(speech, i * speech_chunk, speech_chunk))))
        rest = lambda a, n: F.slice(a, rounds * n + 1, F.greatest(F.size(a), F.lit(1)))
        return F.concat(body, rest(text, text_chunk), F.array(_long(fill)), rest(speech, speech_chunk))

    return let(text, lambda t: let(speech, lambda s: dealt(t, s)))


def answer(kind: Column, question: Column, think: Column, reply: Column) -> Column:
    """The answer's ids for each data structure; an unknown one raises."""
    one = lambda n: F.array(_long(TEXT[n]))
    q = F.concat(one("com_qt"), question, one("eot"))
    t = F.concat(one("com_think"), think, one("eot"))
    a = F.concat(one("com_at"), reply, one("eot"), one("com_aat"))
    return (
        F.when(kind == "com-reason", F.concat(q, t, a))
        .when(kind.isin("sats-reason", "sats-reason-is"), F.concat(t, a))
        .when(kind == "sats-reason-ht", F.concat(one("com_qt"), one("com_think"), a))
        .when(kind == "com", F.concat(q, a))
        .when(kind.isin("sats", "s2s"), a)
        .when(kind == "sds", one("com_aat"))
        .otherwise(F.raise_error(F.concat(F.lit("unknown data structure "), kind)).cast("array<bigint>"))
    )


def labels(ids: Column, prompt: Column) -> Column:
    """Labels of ids: the prompt's places and ids below 0 are ignored."""
    return F.transform(ids, lambda x, i: F.when((i < prompt) | (x < 0), _long(IGNORE)).otherwise(x))


def packed_duration(code: Column, n: Column, codes: int = CODES) -> Column:
    """A code and how often it is said as one id; -1 without a duration."""
    return F.when(n > 0, code + (n - 1) * codes).otherwise(F.lit(-1))


def unpacked_duration(x: Column, codes: int = CODES, book: Column | None = None) -> tuple[Column, Column]:
    """The code and how often it is said. An id can't tell a code of `codes` or more from a longer duration: its book (code div codes) must be kept beside."""
    first = F.lit(0).cast("long") if book is None else book * codes
    left = x - first
    return F.when(x >= 0, first + left % codes), F.when(x >= 0, F.floor(left / codes) + 1).otherwise(F.lit(0))


def regulated(values: Column, times: Column, size: Column | None = None, fill: Column | None = None) -> Column:
    """Each value as often as its time says (below 0: never), filled to a size if one is given."""
    out = F.flatten(F.transform(F.arrays_zip(values.alias("v"), times.alias("n")), lambda x: F.array_repeat(x["v"], F.greatest(x["n"], F.lit(0)).cast("int"))))
    return out if size is None else F.concat(out, F.array_repeat(fill, F.greatest(size - F.size(out), F.lit(0))))


def inference_layers(size: Column, layers: int) -> Column:
    """The prompt's ids for each audio layer and then the text layer: input mark, pads, end, answer mark."""
    audio = [F.concat(*[_shifted(p, l) for p in (F.array(_long(AUDIO["input_a"])), F.array_repeat(_long(AUDIO["pad_a"]), size), F.array(_long(AUDIO["eoa"]), _long(AUDIO["answer_a"])))]) for l in range(layers)]
    text = F.concat(F.array(_long(TEXT["input_t"])), F.array_repeat(_long(TEXT["pad_t"]), size), F.array(_long(TEXT["eot"]), _long(TEXT["answer_t"])))
    return F.array(*audio, text)


def remapped(code: Column, used: Column, unknown: str, key: Column | None = None) -> Column:
    """A code's place among the used ones; others get a hashed place, one extra place, or a fixed one (its number as text)."""
    from loomspark.runtime import hash32

    at = F.array_position(used, code) - 1
    other = {"random": lambda: F.pmod(hash32(key), F.size(used)), "extra": lambda: F.size(used).cast("long")}.get(unknown, lambda: _long(int(unknown)))()
    return F.when(at >= 0, at).otherwise(other.cast("long"))


def unmapped(place: Column, used: Column) -> Column:
    """The code at a place, the last one's for places beyond."""
    return F.get(used, F.least(place.cast("int"), F.size(used) - 1))


def pcm16(x: Column) -> Column:
    """A waveform value as a 16-bit integer, held in its range."""
    return F.greatest(F.lit(-32768), F.least(F.lit(32767), (x.cast("double") * 32768).cast("int"))).cast("smallint")


def reflected(a: Column, left: int, right: int) -> Column:
    """The array mirrored at both ends, without its end values; short arrays get zeros first and lose them afterwards."""
    extra = F.greatest(F.lit(max(left, right) + 1) - F.size(a), F.lit(0))
    x = F.concat(a, F.array_repeat(F.lit(0.0).cast("double"), extra))
    n = F.size(x)
    out = F.concat(F.reverse(F.slice(x, F.lit(2), F.lit(left))), x, F.reverse(F.slice(x, n - right, F.lit(right))))
    return F.slice(out, F.lit(1), F.size(out) - extra)


def trimmed(a: Column, left: int, right: int) -> Column:
    return F.slice(a, F.lit(left + 1), F.greatest(F.size(a) - left - right, F.lit(0)))
