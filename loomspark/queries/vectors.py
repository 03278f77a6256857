"""Queries over vectors, codebooks, segmentation and schedules."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.functions import audio
from loomspark.functions import scalars as sc
from loomspark.operators import quantize as qz
from loomspark.queries.joins import BOOK_SQL, NEAREST_SQL, SERIES_SQL, book, series
from loomspark.registry import query
from loomspark.runtime import hash32, hash32_sql, table


def points(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec"))


@query("c01_kmeans_step", f"""WITH {NEAREST_SQL}, m AS (SELECT n.code, i, avg(e.embedding[i]::DOUBLE) AS x, count(*) AS c FROM embeddings e JOIN n USING (vec_id), unnest(range(1, 65)) t(i) GROUP BY n.code, i)
SELECT b.code, i - 1 AS pos, round(coalesce(m.x, b.vec[i]::DOUBLE), 5) AS x, coalesce(m.c, 0) AS n FROM b CROSS JOIN unnest(range(1, 65)) u(i) LEFT JOIN m USING (code, i)""")
def _(spark, sf):
    out = qz.kmeans_step(points(spark, sf), book(spark, sf))
    return out.select("code", "n", F.posexplode("vec").alias("pos", "x")).select("code", F.col("pos").cast("long").alias("pos"), F.round("x", 5).alias("x"), "n")


def _kmeans_sql(k: int, steps: int) -> str:
    parts = [f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY {hash32_sql('0', 'vec_id')}, vec_id) - 1 AS code, vec, 0::BIGINT AS n FROM e QUALIFY code < {k})"]
    for i in range(steps):
        parts.append(f"""n{i} AS MATERIALIZED (SELECT e.vec_id, arg_min(c.code, struct_pack(d := round(list_distance(e.vec, c.vec) ** 2, 9), c := c.code)) AS code FROM e, c{i} c GROUP BY e.vec_id),
m{i} AS (SELECT code, list(x ORDER BY i) AS vec, max(n) AS n FROM (SELECT n.code, i, avg(e.vec[i]) AS x, count(*) AS n FROM e JOIN n{i} n USING (vec_id), unnest(range(1, 65)) t(i) GROUP BY n.code, i) GROUP BY code),
c{i + 1} AS MATERIALIZED (SELECT c.code, coalesce(m.vec, c.vec) AS vec, coalesce(m.n, 0) AS n FROM c{i} c LEFT JOIN m{i} m USING (code))""")
    return f"WITH e AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS vec FROM embeddings),\n" + ",\n".join(parts) + f"\nSELECT code, i - 1 AS pos, round(vec[i], 5) AS x, n FROM c{steps}, unnest(range(1, 65)) t(i)"


@query("c01_kmeans", _kmeans_sql(16, 5))
def _(spark, sf):
    out = qz.kmeans(points(spark, sf), "vec_id", 16, 5).select("code", F.posexplode("vec").alias("pos", "x"), "n")
    return out.select(F.col("code").cast("long").alias("code"), F.col("pos").cast("long").alias("pos"), F.round("x", 5).alias("x"), "n")


@query("c02_ema_update", """WITH s AS (SELECT label AS code, count(*) AS n, list_transform(range(1, 65), lambda i: 0) AS z FROM embeddings GROUP BY label),
a AS (SELECT label AS code, i, sum(embedding[i]::DOUBLE) AS x FROM embeddings, unnest(range(1, 65)) t(i) GROUP BY label, i),
z AS (SELECT code, (0.9 * 2 + 0.1 * n)::DOUBLE AS size FROM s), t AS (SELECT sum(size) AS total, count(*) AS k FROM z)
SELECT a.code, i - 1 AS pos, round(size, 6) AS size, round((0.9 * 1 + 0.1 * x) / ((size + 0.00001) / (total + k * 0.00001) * total), 6) AS x FROM a JOIN z USING (code), t""")
def _(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("label").alias("code"), F.posexplode("embedding").alias("pos", "x"))
    added = e.groupBy("code", "pos").agg(F.sum(F.col("x").cast("double")).alias("x"), F.count("*").alias("n")).groupBy("code").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("added"))
    old = added.select("code", F.lit(2.0).alias("size"), F.array_repeat(F.lit(1.0), 64).alias("total"))
    out = qz.ema_update(old, added, 0.9)
    return out.select("code", F.round("size", 6).alias("size"), F.posexplode("vec").alias("pos", "x")).select("code", F.col("pos").cast("long").alias("pos"), "size", F.round("x", 6).alias("x"))


@query("c03_dead_codes", f"""WITH c AS (SELECT label AS code, count(*) AS size, min(vec_id) AS vec FROM embeddings GROUP BY label), d AS (SELECT code, row_number() OVER (ORDER BY code) AS r FROM c WHERE size < 50),
f AS (SELECT vec_id, row_number() OVER (ORDER BY {hash32_sql('0', 'vec_id')}, vec_id) AS r FROM embeddings) SELECT c.code, c.size, coalesce(f.vec_id, c.vec) AS vec FROM c LEFT JOIN d USING (code) LEFT JOIN f USING (r)""")
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    codes = e.groupBy(F.col("label").alias("code")).agg(F.count("*").alias("size"), F.min("vec_id").alias("vec"))
    return qz.replace_dead(codes, e.select("vec_id", F.col("vec_id").alias("vec")), "vec_id", 50)


@query("c04_residual_codes", f"""WITH {NEAREST_SQL}, b2 AS (SELECT code, list_transform(vec, lambda x: x::DOUBLE / 2) AS vec FROM b),
r AS (SELECT e.vec_id, n.code AS first, list_transform(range(1, 65), lambda i: e.embedding[i]::DOUBLE - b.vec[i]::DOUBLE) AS v FROM embeddings e JOIN n USING (vec_id) JOIN b USING (code))
SELECT r.vec_id, any_value(first) AS first, arg_min(b2.code, struct_pack(d := round(list_distance(r.v, b2.vec) ** 2, 9), c := b2.code)) AS second FROM r, b2 GROUP BY r.vec_id""")
def _(spark, sf):
    b = book(spark, sf)
    half = b.select("code", F.transform("vec", lambda x: x.cast("double") / 2).alias("vec"))
    out = qz.residual_codes(points(spark, sf), [b, half])
    return out.select("vec_id", F.col("codes")[0].alias("first"), F.col("codes")[1].alias("second"))


@query("c04_residual_round_trip", "SELECT vec_id, TRUE AS same FROM embeddings")
def _(spark, sf):
    b = book(spark, sf)
    out = qz.residual_decode(qz.residual_codes(points(spark, sf), [b, b]), [b, b])
    gap = F.aggregate(F.zip_with("vec", F.zip_with("decoded", "residual", lambda x, y: x + y), lambda x, y: F.abs(x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)
    return out.select("vec_id", (gap < 1e-9).alias("same"))


def _segments_sql(sign: int, value: str, threshold: float = 0.7) -> str:
    """Densities and distances of 50 frames each, then the seeds by falling score: as many frames to the right as fit, then to the left, four in all."""
    ok = "coalesce(free[%s] AND sim[seed + 1][%s] - 0.2::DOUBLE * score[%s] > %s::DOUBLE, FALSE)"
    run = "list_max(list_filter(range(0, %s), lambda q: coalesce(list_bool_and(list_transform(range(1, q + 1), lambda z: %s)), TRUE)))"
    right, left = (ok % (at, at, at, threshold) for at in ("seed + 1 + z", "greatest(seed + 1 - z, 0)"))
    return f"""WITH RECURSIVE s AS ({SERIES_SQL}),
p AS MATERIALIZED (SELECT a.series, a.t AS i, b.t AS j, (list_cosine_similarity(a.vec::DOUBLE[], b.vec::DOUBLE[]) + 1) / 2 AS sim FROM s a JOIN s b ON a.series = b.series),
k AS MATERIALIZED (SELECT series, i, exp({sign} * avg(sim)) AS rho FROM (SELECT *, row_number() OVER (PARTITION BY series, i ORDER BY sim DESC) AS r FROM p) WHERE r BETWEEN 2 AND 11 GROUP BY series, i),
d AS (SELECT p.series, p.i, any_value(x.rho) * coalesce(min({value}) FILTER (y.rho > x.rho), max({value})) AS score FROM p JOIN k x ON p.series = x.series AND p.i = x.i JOIN k y ON p.series = y.series AND p.j = y.i GROUP BY p.series, p.i),
w AS (SELECT series, list(line ORDER BY i) AS sim FROM (SELECT series, i, list(sim ORDER BY j) AS line FROM p GROUP BY series, i) GROUP BY series),
m AS MATERIALIZED (SELECT * FROM (SELECT series, list(score ORDER BY i) AS score, list(i ORDER BY score DESC, i) AS seeds FROM d GROUP BY series) JOIN w USING (series)),
f AS (SELECT series, 1::BIGINT AS step, list_transform(score, lambda x: TRUE) AS free, -1::BIGINT AS lo, -1::BIGINT AS hi FROM m
 UNION ALL SELECT series, step + 1, list_transform(free, lambda x, q: x AND (lo2 < 0 OR q - 1 < lo2 OR q - 1 > hi2)), lo2, hi2 FROM
 (SELECT *, CASE WHEN free[seed + 1] THEN seed - {run % ("4 - r", left)} ELSE -1 END AS lo2, CASE WHEN free[seed + 1] THEN seed + r ELSE -1 END AS hi2 FROM
 (SELECT *, {run % ("4", right)} AS r FROM (SELECT f.*, seeds[step] AS seed, score, sim FROM f JOIN m ON f.series = m.series WHERE step <= len(seeds)))))
SELECT series, row_number() OVER (PARTITION BY series ORDER BY lo) - 1 AS segment, lo AS start, hi - lo + 1 AS length FROM f WHERE lo >= 0"""


@query("c05_segments", _segments_sql(-1, "sim"))
def _(spark, sf):
    return qz.segments(series(spark, sf), "series", "t", "vec", "default").drop("vec")


@query("c06_segments_fixed", _segments_sql(1, "1 - sim"))
def _(spark, sf):
    return qz.segments(series(spark, sf), "series", "t", "vec", "fixed").drop("vec")


@query("c05_segments_looser", _segments_sql(-1, "sim", 0.4))
def _(spark, sf):
    return qz.segments(series(spark, sf), "series", "t", "vec", "default", threshold=0.4).drop("vec")


@query("c06_segments_fixed_looser", _segments_sql(1, "1 - sim", 0.3))
def _(spark, sf):
    return qz.segments(series(spark, sf), "series", "t", "vec", "fixed", threshold=0.3).drop("vec")


@query("c07_tiling", f"SELECT series, count(*) AS frames, TRUE AS tiles FROM ({SERIES_SQL}) GROUP BY series")
def _(spark, sf):
    s = series(spark, sf)
    cut = qz.segments(s, "series", "t", "vec").groupBy("series").agg(F.sum("length").alias("n"), F.count("*").alias("k"), F.min("start").alias("a"))
    frames = s.groupBy("series").agg(F.count("*").alias("frames"))
    return frames.join(cut, "series").select("series", "frames", ((F.col("n") == F.col("frames")) & (F.col("a") == 0)).alias("tiles"))


CDF = [0, 10, 25, 45, 70, 100]


@query("c08_arithmetic_round_trip", "SELECT user_id, count(*) AS n, TRUE AS same FROM events GROUP BY user_id")
def _(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", (F.length("event_type") * 7 % 5).cast("long").alias("s"))
    back = qz.decoded(qz.coded(e, "user_id", "event_id", "s", CDF), CDF)
    want = e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "s"))), lambda x: x["s"]).alias("want"))
    return back.join(want, "user_id").select("user_id", "n", (F.col("symbols") == F.col("want")).alias("same"))


@query("c09_judged_winners", f"""SELECT user_id, round_no, candidate FROM (SELECT user_id, event_id // 1000 AS round_no, event_id AS candidate, row_number() OVER (PARTITION BY user_id, event_id // 1000 ORDER BY {hash32_sql('9', 'event_id')} DESC, event_id) AS r
FROM events WHERE (props->>'k')::INT % 3 > 0) WHERE r = 1""")
def _(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.expr("event_id div 1000").alias("round_no"), F.col("event_id").alias("candidate"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    return qz.winners(e, "user_id", "round_no", F.col("k") % 3 > 0, hash32(F.lit(9), "candidate")).select("user_id", "round_no", "candidate")


@query("x30_unit_vectors", "SELECT vec_id, i - 1 AS i, v[i] / sqrt(n) AS v FROM (SELECT vec_id, v, list_sum(list_transform(v, lambda y: y * y)) AS n FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)), unnest(range(1, len(v) + 1)) t(i)")
def _(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode(sc.unit(F.col("embedding"))).alias("i", "v")).withColumn("i", F.col("i").cast("long"))


@query("x32_penalised_softmax", """SELECT vec_id, i - 1 AS i, e[i] / n AS p FROM (SELECT vec_id, e, list_sum(e) AS n FROM (SELECT vec_id, list_transform(l, lambda x: exp(x / 0.7)) AS e FROM (SELECT vec_id, list_transform(embedding, lambda x, i: CASE WHEN i IN (1, 4) THEN CASE WHEN x < 0 THEN x::DOUBLE * 1.3 ELSE x::DOUBLE / 1.3 END ELSE x::DOUBLE END) AS l FROM embeddings))), unnest(range(1, len(e) + 1)) t(i)""")
def _(spark, sf):
    x = F.transform("embedding", lambda v: v.cast("double"))
    seen = F.array(F.lit(0).cast("long"), F.lit(3).cast("long"))
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode(sc.softmax(sc.repetition_penalty(x, seen, 1.3), 0.7)).alias("i", "p")).withColumn("i", F.col("i").cast("long"))


@query("x33_peaks", """SELECT vec_id, list_transform(x, lambda v: round(CASE WHEN m > 1 THEN v / m ELSE v END, 6)) AS peak, list_transform(x, lambda v: round(greatest(-0.99, least(0.99, v)), 6)) AS held FROM
(SELECT vec_id, x, list_max(list_transform(x, lambda v: abs(v))) AS m FROM (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE * 4) AS x FROM embeddings))""")
def _(spark, sf):
    x = F.transform("embedding", lambda v: v.cast("double") * 4)
    r = lambda a: F.transform(a, lambda v: sc.rounded(v, 6))
    return table(spark, sf, "embeddings").select("vec_id", r(sc.peak_normalised(x)).alias("peak"), r(sc.held(x)).alias("held"))


@query("x34_logs", "SELECT event_id, round(ln(greatest(value, 1e-7)), 6) AS safe, round(sign(value - 30) * ln(1 + abs(value - 30)), 6) AS sym, round(sign(value - 30) * (exp(abs(value - 30) / 50) - 1), 6) AS ex FROM events")
def _(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select("event_id", F.round(sc.safe_log(v), 6).alias("safe"), F.round(sc.symlog(v - 30), 6).alias("sym"), F.round(sc.symexp((v - 30) / 50), 6).alias("ex"))


@query("x35_channels", "SELECT vec_id, list_transform(range(1, 33), lambda i: round((embedding[i]::DOUBLE + embedding[32 + i]::DOUBLE) / 2, 7)) AS mono, 2 AS n FROM embeddings")
def _(spark, sf):
    m = F.transform(sc.mono(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32)), lambda x: sc.rounded(x, 7))
    return table(spark, sf, "embeddings").select("vec_id", sc.channels(m, 2)[1].alias("mono"), F.size(sc.channels(m, 2)).alias("n"))


@query("x36_extra_padding", "SELECT doc_id, (ceil((n_chars - 7 + 2) / 4.0 + 1)::BIGINT - 1) * 4 + 5 - n_chars AS extra FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", sc.extra_padding(F.col("n_chars"), 7, 4, 2).alias("extra"))


@query("x37_quantizers", "SELECT n_nationkey, round(log2(2 ** (n_nationkey % 8 + 4)) * 75, 6) AS per, greatest(floor(n_nationkey * 1000 / (log2(2 ** (n_nationkey % 8 + 4)) * 75))::BIGINT, 1) AS n FROM nation")
def _(spark, sf):
    bins = F.pow(F.lit(2.0), F.col("n_nationkey") % 8 + 4)
    return table(spark, sf, "nation").select("n_nationkey", F.round(sc.bandwidth_per_quantizer(bins, F.lit(75)), 6).alias("per"), sc.quantizers(F.col("n_nationkey"), bins, F.lit(75)).alias("n"))


@query("x38_schedules", """SELECT s AS step, round(0.001 * sqrt(25) * least(s ** -0.5, s * 25 ** -1.5), 9) AS noam, round(greatest(0.001 * ((1000 - s) / 1000.0::DOUBLE) ** 0.5, 0.0001), 9) AS square_root, round(greatest(0.001 * ((1000 - s) / 1000.0::DOUBLE) ** 2, 0.0001), 9) AS square,
round(0.0009 * 0.5 * (1 + cos(pi() * s / 1000)) + 0.0001, 9) AS cosine, round(CASE WHEN s <= 100 THEN 0.001 * s / 100 WHEN s > 600 THEN 0.0001 ELSE 0.0001 + 0.0009 * 0.5 * (cos(pi() * (s - 100) / 500) + 1) END, 9) AS warm,
round(0.0009 * (1 - least(s, 400) / 400.0::DOUBLE) ** 2 + 0.0001, 9) AS poly, round(greatest(0.001 * 10 / greatest(1, greatest(s - 200, 0) ** 0.5), 0.0001), 9) AS hold FROM range(1, 1000) t(s)""")
def _(spark, sf):
    s = F.col("step")
    out = {"noam": sc.noam(s, 1e-3, 25), "square_root": sc.root_decay(s, 1e-3, 1000, 1e-4), "square": sc.root_decay(s, 1e-3, 1000, 1e-4, 2.0), "cosine": sc.cosine_decay(s, 1e-3, 1000, 1e-4), "warm": sc.warmup_cosine(s, 1e-3, 100, 500, 1e-4), "poly": sc.poly_decay(s, 1e-3, 400, 2.0, 1e-4), "hold": sc.noam_hold(s, 1e-3, 100, 200, 0.5, 1e-4)}
    return spark.range(1, 1000).withColumnRenamed("id", "step").select("step", *[F.round(c, 9).alias(k) for k, c in out.items()])


@query("x39_hand_over", "SELECT s AS step, round(CASE WHEN s < 100 THEN 0 WHEN s > 300 THEN 1 ELSE 1 / (1 + exp(-(((s - 100) / 200.0::DOUBLE - 0.5) * 6))) END, 6) AS p FROM range(0, 500) t(s)")
def _(spark, sf):
    return spark.range(0, 500).select(F.col("id").alias("step"), F.round(sc.hand_over(F.col("id"), 100, 300), 6).alias("p"))


def clips(spark, sf):
    """Waveforms of a series' vectors one after the other."""
    s = series(spark, sf).groupBy("series").agg(F.array_sort(F.collect_list(F.struct("t", "vec"))).alias("x"))
    return s.select("series", F.flatten(F.transform("x", lambda v: F.transform(v["vec"], lambda y: y.cast("double")))).alias("x"))


@query("c10_resampled")
def _(spark, sf):
    x = clips(spark, sf).select("series", audio.waveform(audio.wav_bytes(F.col("x"), 16_000), 24_000).alias("x"))
    return x.select("series", F.size("x").cast("long").alias("n"), F.transform("x", lambda v: F.round(v, 6)).alias("x"))


@query("c10_fbank_and_f0")
def _(spark, sf):
    x = clips(spark, sf).withColumn("feat", audio.fbank(F.col("x")))
    return x.select("series", F.size("feat").cast("long").alias("frames"), "feat", audio.f0(F.col("x"), F.size("feat")).alias("f0"))
