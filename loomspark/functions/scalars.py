"""Numeric column functions: vectors, logits, waveforms, schedules."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspark.runtime import let


def _total(x: Column, f) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + f(v.cast("double")))


def rounded(x: Column, places: int) -> Column:
    """x rounded half away from zero; what is rounded to zero keeps its sign, as in IEEE arithmetic (F.round gives 0.0 for -0.0)."""
    return F.round(F.abs(x), places) * F.signum(x)


def unit(x: Column) -> Column:
    """A vector at length one; a zero vector stays."""
    scaled = lambda x, norm: F.transform(x, lambda v: v.cast("double") / F.when(norm > 0, norm).otherwise(1.0))
    return let(x, lambda x: let(F.sqrt(_total(x, lambda v: v * v)), lambda norm: scaled(x, norm)))


def softmax(x: Column, temperature: float = 1.0) -> Column:
    powers = lambda x: let(F.array_max(x), lambda top: F.transform(x, lambda v: F.exp((v - top) / temperature)))
    shares = lambda e: let(_total(e, lambda v: v), lambda total: F.transform(e, lambda v: v / total))
    return let(let(x, powers), shares)


def repetition_penalty(x: Column, seen: Column, penalty: float) -> Column:
    """Logits of the seen ids: negative ones multiplied, others divided."""
    return F.transform(x, lambda v, i: F.when(F.array_contains(seen, i.cast("long")), F.when(v < 0, v * penalty).otherwise(v / penalty)).otherwise(v))


def peak_normalised(x: Column, limit: float = 1.0) -> Column:
    """A waveform scaled down to the limit if its peak exceeds it."""
    scaled = lambda x, peak: F.transform(x, lambda v: F.when(peak > limit, v / peak * limit).otherwise(v))
    return let(x, lambda x: let(F.array_max(F.transform(x, lambda v: F.abs(v))), lambda peak: scaled(x, peak)))


def held(x: Column, limit: float = 0.99, rescale: bool = False) -> Column:
    """Values clamped to the limit, or all scaled so that the peak keeps it."""
    if rescale:
        return peak_normalised(x, limit)
    return F.transform(x, lambda v: F.greatest(F.lit(-limit), F.least(F.lit(limit), v)))


def safe_log(x: Column, floor: float = 1e-7) -> Column:
    return F.log(F.greatest(x, F.lit(floor)))


def symlog(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def symexp(x: Column) -> Column:
    return F.signum(x) * (F.exp(F.abs(x)) - 1)


def mono(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x.cast("double") + y.cast("double")) / 2)


def channels(x: Column, n: int) -> Column:
    return F.array_repeat(x, F.lit(n))


def extra_padding(n: Column, kernel: int, stride: int, padding: int = 0) -> Column:
    """Values to add so that windows of a kernel and stride cover all."""
    windows = F.ceil((n - kernel + padding) / stride + 1)
    return (windows - 1) * stride + (kernel - padding) - n


def bandwidth_per_quantizer(bins: Column, rate: Column) -> Column:
    return F.log2(bins) * rate


def quantizers(bandwidth_kbps: Column, bins: Column, rate: Column) -> Column:
    return F.greatest(F.floor(bandwidth_kbps * 1000 / bandwidth_per_quantizer(bins, rate)), F.lit(1).cast("long"))


def noam(step: Column, lr: float, warmup: int) -> Column:
    if warmup == 0:
        return lr * F.pow(step, F.lit(-0.5))
    return lr * math.sqrt(warmup) * F.least(F.pow(step, F.lit(-0.5)), step * warmup**-1.5)


def root_decay(step: Column, lr: float, most: int, least: float, power: float = 0.5) -> Column:
    """Learning rate that falls with a power of the share of steps left: 0.5 for square-root, 2 for square."""
    return F.greatest(lr * F.pow((most - step) / most, F.lit(power)), F.lit(least))


def cosine_decay(step: Column, lr: float, most: int, least: float) -> Column:
    return (lr - least) * 0.5 * (1 + F.cos(math.pi * step / most)) + least


def warmup_cosine(step: Column, lr: float, warmup: int, decay: int, least: float) -> Column:
    fall = least + (lr - least) * 0.5 * (F.cos(math.pi * (step - warmup) / decay) + 1)
    return F.when((step <= warmup) & F.lit(warmup > 0), lr * step / max(warmup, 1)).when(step > warmup + decay, F.lit(least)).otherwise(fall)


def poly_decay(step: Column, lr: float, decay: int, power: float, least: float, cycle: bool = False) -> Column:
    span = F.when(step == 0, F.lit(1.0)).otherwise(F.ceil(step / decay)) * decay if cycle else F.lit(float(decay))
    at = step if cycle else F.least(step, F.lit(decay))
    return (lr - least) * F.pow(1 - at / span, F.lit(power)) + least


def noam_hold(step: Column, lr: float, warmup: int, hold: int, rate: float, least: float) -> Column:
    return F.greatest(lr * max(1.0, warmup**rate) / F.greatest(F.lit(1.0), F.pow(F.greatest(step - hold, F.lit(0)), F.lit(rate))), F.lit(least))


def hand_over(step: Column, start: int, end: int, steepness: float = 6.0) -> Column:
    """Probability that rises from 0 before start to 1 after end along a sigmoid."""
    x = ((step - start) / (end - start) - 0.5) * steepness
    return F.when(step < start, 0.0).when(step > end, 1.0).otherwise(1 / (1 + F.exp(-x)))
