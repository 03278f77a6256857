"""Queries over metric aggregations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomspark.operators import aggregates as ag
from loomspark.operators import joins
from loomspark.queries.joins import NEAREST_SQL, book
from loomspark.registry import query
from loomspark.runtime import table

SIMS = "SELECT key, layer, round(list_cosine_similarity(a::DOUBLE[], b::DOUBLE[]), 9) AS sim FROM (SELECT vec_id AS key, l AS layer, embedding[l * 8 + 1:l * 8 + 8] AS a, embedding[(l * 8 + 8) % 64 + 1:(l * 8 + 8) % 64 + 8] AS b FROM embeddings, unnest(range(0, 8)) t(l))"


def layer_sims(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("key"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("layer"), "embedding")
    a, b = F.slice("embedding", F.col("layer") * 8 + 1, F.lit(8)), F.slice("embedding", (F.col("layer") * 8 + 8) % 64 + 1, F.lit(8))
    sim = joins.dot(a, b) / (F.sqrt(joins.dot(a, a)) * F.sqrt(joins.dot(b, b)))
    return e.select("key", F.col("layer").cast("long").alias("layer"), F.round(sim, 9).alias("sim"))


@query("x31_layer_cosine", f"SELECT key, layer, round(sim, 6) AS sim FROM ({SIMS})")
def _(spark, sf):
    return layer_sims(spark, sf).withColumn("sim", F.round("sim", 6))


@query("a01_layer_statistics", f"SELECT layer, round(avg(sim), 6) AS mean, round(stddev_samp(sim), 6) AS std, round(1.96 * stddev_samp(sim) / sqrt(count(*)), 6) AS ci95, count(*) AS n FROM ({SIMS}) GROUP BY layer")
def _(spark, sf):
    return ag.by_layer(layer_sims(spark, sf), "layer", "sim").select("layer", *[F.round(c, 6).alias(c) for c in ("mean", "std", "ci95")], "n")


@query("a02_sample_means", f"SELECT key, round(avg(sim), 6) AS mean, count(*) AS pairs FROM ({SIMS}) GROUP BY key")
def _(spark, sf):
    return layer_sims(spark, sf).groupBy("key").agg(F.round(F.avg("sim"), 6).alias("mean"), F.count("*").alias("pairs"))


LAYERS = f"SELECT layer, avg(sim) AS a, avg(sim * sim) AS b FROM ({SIMS}) GROUP BY layer"


@query("a03_layer_summary", f"SELECT round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b, round(avg(a) - avg(b), 6) AS gap, round(avg(a) FILTER (layer >= 4) - avg(b) FILTER (layer >= 4), 6) AS upper_gap FROM ({LAYERS})")
def _(spark, sf):
    layers = layer_sims(spark, sf).groupBy("layer").agg(F.avg("sim").alias("a"), F.avg(F.col("sim") * F.col("sim")).alias("b"))
    return ag.layer_summary(layers, "layer", "a", "b").select(*[F.round(c, 6).alias(c) for c in ("mean_a", "mean_b", "gap", "upper_gap")])


USAGE = "SELECT c AS code, count(e.vec_id) AS n FROM range(0, 40) t(c) LEFT JOIN embeddings e ON e.label * 2 - 2 = c GROUP BY c"


def usage(spark, sf):
    return ag.usage(table(spark, sf, "embeddings").withColumn("code", F.col("label") * 2 - 2), "code", 40)


@query("a04_code_usage", USAGE)
def _(spark, sf):
    return usage(spark, sf)


@query("a05_usage_summary", f"SELECT count(*) FILTER (n > 0) AS active, round(count(*) FILTER (n > 0) / 40.0, 6) AS fraction, count(*) FILTER (n = 0) AS dead FROM ({USAGE})")
def _(spark, sf):
    return ag.usage_summary(usage(spark, sf)).withColumn("fraction", F.round("fraction", 6))


@query("o09_top_codes", f"SELECT code, n FROM ({USAGE}) ORDER BY n DESC, code LIMIT 10")
def _(spark, sf):
    return usage(spark, sf).orderBy(F.desc("n"), "code").limit(10)


@query("a06_weighted_loss", "SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS loss FROM lineitem GROUP BY l_returnflag")
def _(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(ag.weighted_mean(F.col("l_discount"), F.col("l_quantity")), 6).alias("loss"))


@query("a07_metrics_across_workers", "SELECT round(sum(d * n) / sum(n), 6) AS discount, round(sum(t * n) / sum(n), 6) AS tax FROM (SELECT l_linenumber, avg(l_discount) AS d, avg(l_tax) AS t, count(*) AS n FROM lineitem GROUP BY l_linenumber)")
def _(spark, sf):
    per = table(spark, sf, "lineitem").groupBy("l_linenumber").agg(F.avg("l_discount").alias("d"), F.avg("l_tax").alias("t"), F.count("*").alias("n"))
    return per.agg(F.round(ag.weighted_mean(F.col("d"), F.col("n")), 6).alias("discount"), F.round(ag.weighted_mean(F.col("t"), F.col("n")), 6).alias("tax"))


LABELLED = "SELECT l.*, d.lang, d.n_chars FROM labels l JOIN documents d USING (doc_id)"


def labelled(spark, sf):
    return table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "doc_id")


@query("a08_masked_accuracy", f"SELECT lang, round(count(*) FILTER (quality = toxic AND n_chars > 1000) / count(*) FILTER (n_chars > 1000), 6) AS accuracy FROM ({LABELLED}) GROUP BY lang")
def _(spark, sf):
    target = F.when(F.col("n_chars") > 1000, F.col("toxic")).otherwise(-1)
    return labelled(spark, sf).groupBy("lang").agg(F.round(ag.masked_accuracy(F.col("quality"), target), 6).alias("accuracy"))


@query("a09_means_without_nan", "SELECT round(avg(value), 6) AS mean, round(avg(value) FILTER (user_id % 5 <> 0), 6) AS f1, count(*) FILTER (user_id % 5 = 0) AS skipped FROM events")
def _(spark, sf):
    v = F.when(F.col("user_id") % 5 == 0, float("nan")).otherwise(F.col("value"))
    return table(spark, sf, "events").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(ag.mean_without_nan(v), 6).alias("f1"), F.count_if(F.isnan(v)).alias("skipped"))


@query("a10_voiced_f1", f"""SELECT lang, tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1
FROM (SELECT lang, count(*) FILTER (quality = 1 AND n_chars > 900) AS tp, count(*) FILTER (quality = 1 AND n_chars <= 900) AS fp, count(*) FILTER (quality = 0 AND n_chars > 900) AS fn FROM ({LABELLED}) GROUP BY lang)""")
def _(spark, sf):
    out = labelled(spark, sf).groupBy("lang").agg(*ag.precision_recall_f1(F.col("quality") == 1, F.col("n_chars") > 900))
    return out.select("lang", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("a11_rmse_and_cents", """SELECT round(avg(r), 6) AS rmse, round(sqrt(avg(c)), 4) AS cents FROM (
  SELECT user_id, sqrt(avg((value - user_id) ** 2)) AS r, avg((1200 * (log2(value) - log2(user_id + 1))) ** 2) FILTER (value > 1) AS c FROM events GROUP BY user_id)""")
def _(spark, sf):
    e = table(spark, sf, "events")
    c = F.when(F.col("value") > 1, ag.cents(F.col("value"), F.col("user_id") + 1))
    per = e.groupBy("user_id").agg(ag.rmse(F.col("value"), F.col("user_id")).alias("r"), F.avg(c * c).alias("c"))
    return per.agg(F.round(F.avg("r"), 6).alias("rmse"), F.round(F.sqrt(F.avg("c")), 4).alias("cents"))


@query("a12_frame_rate", "SELECT lang, round(sum(length(source)) / sum(n_chars) * 75, 6) AS rate FROM documents GROUP BY lang")
def _(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(F.round(ag.frame_rate(F.length("source"), F.col("n_chars")), 6).alias("rate"))


@query("a13_mean_ratio_rate", "SELECT round(avg(nz / total) * 150, 6) AS rate FROM (SELECT user_id, count(*) FILTER (event_id % 3 <> 0) AS nz, sum(event_id % 3) AS total FROM events GROUP BY user_id)")
def _(spark, sf):
    per = table(spark, sf, "events").groupBy("user_id").agg(F.count_if(F.col("event_id") % 3 != 0).alias("nz"), F.sum(F.col("event_id") % 3).alias("total"))
    return per.agg(F.round(F.avg(F.col("nz") / F.col("total")) * 150, 6).alias("rate"))


METRICS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("a14_epoch_means", "SELECT l_linenumber AS epoch, " + ", ".join(f"round(avg({m}), 4) AS {m}" for m in METRICS) + " FROM lineitem GROUP BY l_linenumber")
def _(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("epoch")).agg(*[F.round(F.avg(m), 4).alias(m) for m in METRICS])


@query("a15_category_histogram", "SELECT role AS category, count(*) AS n FROM conversations GROUP BY role")
def _(spark, sf):
    return table(spark, sf, "conversations").groupBy(F.col("role").alias("category")).agg(F.count("*").alias("n"))


@query("a16_segment_means", "SELECT label AS segment, i - 1 AS pos, round(avg(embedding[i]::DOUBLE), 6) AS value FROM embeddings, unnest(range(1, 65)) t(i) GROUP BY label, i")
def _(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("label").alias("segment"), F.posexplode("embedding").alias("pos", "x"))
    return e.groupBy("segment", F.col("pos").cast("long").alias("pos")).agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("value"))


@query("a17_real_time_factor", "SELECT event_id, value / (user_id + 1) AS rtf FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", ag.real_time_factor(F.col("value"), F.col("user_id") + 1).alias("rtf"))


@query("a18_smoothed_kl", """WITH s AS (SELECT vec_id, label % 65 - 1 AS y, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings),
l AS (SELECT vec_id, y, list_transform(x, lambda v: v - ln(list_sum(list_transform(x, lambda w: exp(w))))) AS lp FROM s),
k AS (SELECT vec_id, sum(CASE WHEN i - 1 = y THEN 0.9 * (ln(0.9) - lp[i]) ELSE 0.1 / 63 * (ln(0.1 / 63) - lp[i]) END) AS kl FROM l, unnest(range(1, 65)) t(i) WHERE y >= 0 GROUP BY vec_id)
SELECT round(avg(kl), 5) AS loss, count(*) AS n FROM k""")
def _(spark, sf):
    x = F.transform("embedding", lambda v: v.cast("double"))
    e = table(spark, sf, "embeddings").select(ag.smoothed_kl(x, F.col("label") % 65 - 1, 0.1).alias("kl"))
    return e.agg(F.round(F.avg("kl"), 5).alias("loss"), F.count("kl").alias("n"))


@query("a19_preference_loss", """SELECT round(avg(ln(1 + exp(-0.1 * z))), 6) AS loss, round(avg(0.1 * (c - rc)), 6) AS chosen_reward, round(avg(0.1 * (r - rr)), 6) AS rejected_reward
FROM (SELECT *, (c - r) - (rc - rr) AS z FROM (SELECT -l_tax * 10 AS c, -l_discount * 20 AS r, -l_tax * 12 AS rc, -l_discount * 10 AS rr FROM lineitem))""")
def _(spark, sf):
    t, d = F.col("l_tax"), F.col("l_discount")
    x = table(spark, sf, "lineitem").select(*ag.preference_loss(-t * 10, -d * 20, -t * 12, -d * 10))
    return x.agg(*[F.round(F.avg(c), 6).alias(c) for c in ("loss", "chosen_reward", "rejected_reward")])


@query("a20_losses", """SELECT round(avg(abs(l_discount - l_tax)), 6) AS l1, round(avg(greatest(1 - l_discount * 20, 0)) + avg(greatest(1 + l_tax - 1.05, 0)), 6) AS hinge,
round(avg(abs(l_quantity - 25)), 6) AS feature FROM lineitem""")
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.agg(F.round(ag.l1(F.col("l_discount"), F.col("l_tax")), 6).alias("l1"), F.round(ag.hinge(F.col("l_discount") * 20, F.col("l_tax") - 1.05), 6).alias("hinge"), F.round(ag.l1(F.col("l_quantity"), F.lit(25)), 6).alias("feature"))


@query("a21_any_multi_call", "SELECT max(n) > 1 AS multi FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)")
def _(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("n")).agg(F.bool_or(F.col("n") > 1).alias("multi"))


@query("a22_norm_of_norms", "SELECT round(sqrt(sum(n * n)), 6) AS norm FROM (SELECT sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings)")
def _(spark, sf):
    e = table(spark, sf, "embeddings").select(F.sqrt(joins.dot(F.col("embedding"), F.col("embedding"))).alias("n"))
    return e.agg(F.round(ag.norm_of_norms(F.col("n")), 6).alias("norm"))


@query("a23_masked_code_error", f"WITH {NEAREST_SQL} SELECT round(avg((e.embedding[i]::DOUBLE - b.vec[i]::DOUBLE) ** 2), 6) AS mse FROM embeddings e JOIN n USING (vec_id) JOIN b USING (code), unnest(range(1, 65)) t(i) WHERE e.label % 2 = 0")
def _(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").alias("vec"))
    b = book(spark, sf)
    x = joins.nearest_code(e, b).join(joins.small(b.withColumnRenamed("vec", "near")), "code")
    x = x.select("label", F.explode(F.arrays_zip("vec", "near")).alias("p"))
    a, c = F.col("p.vec").cast("double"), F.col("p.near").cast("double")
    return x.agg(F.round(ag.masked_mse(a, c, F.col("label") % 2 == 0), 6).alias("mse"))
