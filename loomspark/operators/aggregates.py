"""Metric aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.runtime import let


def mean_std_ci(value: Column, prefix: str = "") -> list[Column]:
    """Mean, sample deviation and half width of the 95 % interval; the last two are 0 below two values."""
    n, std = F.count(value), F.coalesce(F.stddev_samp(value), F.lit(0.0))
    std = F.when(n < 2, 0.0).otherwise(std)
    return [F.avg(value).alias(f"{prefix}mean"), std.alias(f"{prefix}std"), (F.lit(1.96) * std / F.sqrt(n)).alias(f"{prefix}ci95"), n.alias(f"{prefix}n")]


def by_layer(df: DataFrame, layer: str, value: str) -> DataFrame:
    return df.groupBy(layer).agg(*mean_std_ci(F.col(value)))


def layer_summary(layers: DataFrame, layer: str, a: str, b: str) -> DataFrame:
    """Means over layers of two measures, their gap, and the gap over the upper half of the layers."""
    n = layers.agg(F.count("*").alias("n"))
    upper = F.col(layer) >= F.floor(F.col("n") / 2)
    half = lambda c: F.avg(F.when(upper, F.col(c)))
    return layers.crossJoin(F.broadcast(n)).agg(F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), (F.avg(a) - F.avg(b)).alias("gap"), (half(a) - half(b)).alias("upper_gap"))


def usage(df: DataFrame, code: str, size: int) -> DataFrame:
    """(code, n) of all codes from 0 to size - 1; negative ones don't count."""
    counts = df.filter((F.col(code) >= 0) & (F.col(code) < size)).groupBy(F.col(code).cast("long").alias("code")).agg(F.count("*").alias("n"))
    return df.sparkSession.range(size).withColumnRenamed("id", "code").join(counts, "code", "left").select("code", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def usage_summary(counts: DataFrame) -> DataFrame:
    return counts.agg(F.count_if(F.col("n") > 0).alias("active"), (F.count_if(F.col("n") > 0) / F.count("*")).alias("fraction"), F.count_if(F.col("n") == 0).alias("dead"))


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.sum(value * weight) / F.sum(weight)


def masked_accuracy(pred: Column, target: Column, ignore: int = -1) -> Column:
    """Share of right ones among targets that aren't ignored."""
    on = target != ignore
    return F.count_if(on & (pred == target)) / F.count_if(on)


def mean_without_nan(value: Column) -> Column:
    return F.avg(F.when(~F.isnan(value), value))


def precision_recall_f1(pred: Column, target: Column) -> list[Column]:
    tp, fp, fn = F.count_if(pred & target), F.count_if(pred & ~target), F.count_if(~pred & target)
    p, r = tp / (tp + fp), tp / (tp + fn)
    return [tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), p.alias("precision"), r.alias("recall"), (2 * p * r / (p + r)).alias("f1")]


def rmse(a: Column, b: Column) -> Column:
    return F.sqrt(F.avg((a - b) * (a - b)))


def cents(a: Column, b: Column) -> Column:
    """Difference of two pitches in cents."""
    return 1200 * (F.log2(a) - F.log2(b))


def frame_rate(tokens: Column, frames: Column, rate: float = 75.0) -> Column:
    return F.sum(tokens) / F.sum(frames) * rate


def real_time_factor(elapsed: Column, length: Column) -> Column:
    return elapsed / length


def log_softmax(x: Column) -> Column:
    """Log-softmax of an array of doubles, shifted by its maximum."""

    def shifted(x: Column, top: Column) -> Column:
        total = F.log(F.aggregate(x, F.lit(0.0), lambda s, v: s + F.exp(v - top)))
        return let(total, lambda t: F.transform(x, lambda v: v - top - t))

    return let(x, lambda x: let(F.array_max(x), lambda top: shifted(x, top)))


def smoothed_kl(logits: Column, target: Column, smoothing: float) -> Column:
    """Divergence of a smoothed one-hot target from the softmax of the logits, without ignored (negative) targets: null there."""
    n = F.size(logits)
    low = F.lit(smoothing) / (n - 1)
    terms = F.transform(log_softmax(logits), lambda v, i: F.when(i == target, F.lit(1 - smoothing)).otherwise(low) * (F.when(i == target, F.log(F.lit(1 - smoothing))).otherwise(F.log(low)) - v))
    return F.when(target >= 0, F.aggregate(terms, F.lit(0.0), lambda s, v: s + v))


def preference_loss(chosen: Column, rejected: Column, ref_chosen: Column, ref_rejected: Column, beta: float = 0.1, smoothing: float = 0.0, ipo: bool = False) -> list[Column]:
    """Loss of preferring the chosen answer, and the rewards of both."""
    logits = (chosen - rejected) - (ref_chosen - ref_rejected)
    sig = lambda x: -F.log1p(F.exp(-x))
    if ipo:
        loss = (logits - 1 / (2 * beta)) * (logits - 1 / (2 * beta))
    else:
        loss = -sig(beta * logits) * (1 - smoothing) - sig(-beta * logits) * smoothing
    return [loss.alias("loss"), (beta * (chosen - ref_chosen)).alias("chosen_reward"), (beta * (rejected - ref_rejected)).alias("rejected_reward")]


def l1(a: Column, b: Column) -> Column:
    return F.avg(F.abs(a - b))


def hinge(real: Column, fake: Column) -> Column:
    return F.avg(F.greatest(1 - real, F.lit(0.0))) + F.avg(F.greatest(1 + fake, F.lit(0.0)))


def norm_of_norms(norm: Column) -> Column:
    return F.sqrt(F.sum(norm * norm))


def masked_mse(a: Column, b: Column, on: Column) -> Column:
    return F.avg(F.when(on, (a - b) * (a - b)))
