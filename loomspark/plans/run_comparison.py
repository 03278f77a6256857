"""Comparison of three runs: aligned token positions, cosine per layer, statistics per layer and sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.operators import aggregates, joins


def similarities(a: DataFrame, b: DataFrame, c: DataFrame) -> DataFrame:
    """(key, layer, pair, similarity) over positions of a that have partners in b and c.

    Runs: (key, pos, token, layers array<array<double>>). Positions are aligned on tokens first, so only vectors of common positions are joined.
    """
    thin = [r.select("key", "pos", "token") for r in (a, b, c)]
    ab = joins.align_occurrences(thin[0], thin[1], "key", "token", "pos")
    ac = joins.align_occurrences(thin[0], thin[2], "key", "token", "pos")
    places = joins.merge_alignments(ab, ac, "key")
    vec = lambda r, name, at: r.select("key", F.col("pos").alias(at), F.posexplode("layers").alias("layer", name))
    x = places.join(vec(a, "va", "i"), ["key", "i"]).join(vec(b, "vb", "j"), ["key", "j", "layer"]).join(vec(c, "vc", "l"), ["key", "l", "layer"])
    cos = lambda p, q: joins.dot(F.col(p), F.col(q)) / (F.sqrt(joins.dot(F.col(p), F.col(p))) * F.sqrt(joins.dot(F.col(q), F.col(q))))
    pairs = F.explode(F.create_map(F.lit("ab"), cos("va", "vb"), F.lit("ac"), cos("va", "vc"))).alias("pair", "similarity")
    return x.select("key", "layer", pairs)


def compare(a: DataFrame, b: DataFrame, c: DataFrame) -> DataFrame:
    """(pair, layer, mean, std, ci95, n)."""
    return similarities(a, b, c).groupBy("pair", "layer").agg(*aggregates.mean_std_ci(F.col("similarity")))
