"""Queries over orders, limits and masks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomspark.functions import masks, sequences
from loomspark.functions.scalars import rounded
from loomspark.operators import batching, joins
from loomspark.plans import record_pipeline
from loomspark.queries.filters import WORDS_SQL, n_words
from loomspark.queries.joins import SERIES_SQL, series
from loomspark.registry import query
from loomspark.runtime import hash32, hash32_sql, table

KEPT_SQL = f"SELECT doc_id, n_chars, w FROM (SELECT doc_id, n_chars, {WORDS_SQL} AS w FROM documents) WHERE n_chars BETWEEN 10 AND 10240 AND w BETWEEN 1 AND 1000 AND w / n_chars BETWEEN 0.0005 AND 1"


@query("record_pipeline", f"""WITH RECURSIVE kept AS ({KEPT_SQL}),
numbered AS (SELECT *, (row_number() OVER (ORDER BY doc_id) - 1) // 500 AS shard FROM kept),
placed AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY n_chars, doc_id) AS place FROM numbered),
fold AS (
  SELECT shard, place, n_chars AS len, 0::BIGINT AS batch, n_chars AS most, 1::BIGINT AS n FROM placed WHERE place = 1
  UNION ALL
  SELECT p.shard, p.place, p.n_chars, CASE WHEN greatest(f.most, p.n_chars) * (f.n + 1) > 40000 THEN f.batch + 1 ELSE f.batch END,
    CASE WHEN greatest(f.most, p.n_chars) * (f.n + 1) > 40000 THEN p.n_chars ELSE greatest(f.most, p.n_chars) END,
    CASE WHEN greatest(f.most, p.n_chars) * (f.n + 1) > 40000 THEN 1 ELSE f.n + 1 END
  FROM fold f JOIN placed p ON p.shard = f.shard AND p.place = f.place + 1)
SELECT shard, batch, count(*) AS n_rows, max(len) AS longest, sum(len)::BIGINT AS frames, max(len) * count(*) AS padded FROM fold GROUP BY shard, batch""")
def _(spark, sf):
    records = table(spark, sf, "documents").filter(F.col("n_chars").between(10, 10240)).select("doc_id", "n_chars", n_words().alias("n_tokens"))
    return record_pipeline.run(records, max_tokens=1000)


@query("o01_buffered_shuffle", f"SELECT doc_id, buffer, row_number() OVER (PARTITION BY buffer ORDER BY {hash32_sql('7', 'doc_id')}, doc_id) - 1 AS place FROM (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 300 AS buffer FROM documents)")
def _(spark, sf):
    return batching.buffered_shuffle(table(spark, sf, "documents").select("doc_id"), "doc_id", 300, 7).select("doc_id", "buffer", F.col("place").cast("long").alias("place"))


@query("o02_buffered_sort", "SELECT doc_id, buffer, row_number() OVER (PARTITION BY buffer ORDER BY n_chars, doc_id) - 1 AS place FROM (SELECT doc_id, n_chars, (row_number() OVER (ORDER BY doc_id) - 1) // 500 AS buffer FROM documents)")
def _(spark, sf):
    return batching.buffered_sort(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars").select("doc_id", "buffer", F.col("place").cast("long").alias("place"))


def _order_sql(seed):
    return f"SELECT event_id, row_number() OVER (ORDER BY {hash32_sql(str(seed), 'event_id')} * 1048576 + event_id % 1048576) - 1 AS place FROM events"


@query("o03_epoch_shuffle", _order_sql(3))
def _(spark, sf):
    return batching.hashed_order(table(spark, sf, "events").select("event_id"), "event_id", 3)


@query("o04_joint_shuffle", f"SELECT event_id, event_type, place FROM ({_order_sql(11)}) JOIN events USING (event_id)")
def _(spark, sf):
    return batching.hashed_order(table(spark, sf, "events").select("event_id", "event_type"), "event_id", 11)


@query("o05_first_keys", "SELECT DISTINCT user_id FROM events ORDER BY user_id LIMIT 20")
def _(spark, sf):
    return table(spark, sf, "events").select("user_id").distinct().orderBy("user_id").limit(20)


@query("o06_restored_order", "SELECT event_id, event_type FROM events")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type")
    parts = [e.filter(F.col("event_id") % 3 == k) for k in (2, 0, 1)]
    return batching.restored(parts[0].unionByName(parts[1]).unionByName(parts[2]), "event_id", e.count())


@query("o07_longest_first_in_batch", "SELECT doc_id, batch, row_number() OVER (PARTITION BY batch ORDER BY n_chars DESC, doc_id) - 1 AS place FROM (SELECT doc_id, n_chars, (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS batch FROM documents)")
def _(spark, sf):
    b = batching.static_batches(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id", 16)
    w = Window.partitionBy("batch").orderBy(F.desc("n_chars"), "doc_id")
    return b.select("doc_id", "batch", (F.row_number().over(w) - 1).cast("long").alias("place"))


@query("o08_top_k_with_ties", "SELECT user_id, event_id FROM (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY length(event_type) DESC) AS r FROM events) WHERE r <= 5")
def _(spark, sf):
    e = table(spark, sf, "events").withColumn("r", F.rank().over(Window.partitionBy("user_id").orderBy(F.desc(F.length("event_type")))))
    return e.filter("r <= 5").select("user_id", "event_id")


@query("o10_nearest_frames", f"""WITH s AS ({SERIES_SQL}), p AS (SELECT a.series, a.t AS i, b.t AS j, round((list_cosine_similarity(a.vec::DOUBLE[], b.vec::DOUBLE[]) + 1) / 2, 9) AS sim FROM s a JOIN s b ON a.series = b.series),
r AS (SELECT *, row_number() OVER (PARTITION BY series, i ORDER BY sim DESC, j) AS r FROM p) SELECT series, i, round(avg(sim), 5) AS mean_similarity FROM r WHERE r BETWEEN 2 AND 11 GROUP BY series, i""")
def _(spark, sf):
    p = joins.series_similarity(series(spark, sf), "series", "t", "vec", 50).withColumn("similarity", F.round("similarity", 9))
    r = p.withColumn("r", F.row_number().over(Window.partitionBy("series", "i").orderBy(F.desc("similarity"), "j")))
    return r.filter("r between 2 and 11").groupBy("series", "i").agg(F.round(F.avg("similarity"), 5).alias("mean_similarity"))


@query("o11_lowest_scores", "SELECT event_id, value FROM events ORDER BY value, event_id LIMIT 25")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", "value").orderBy("value", "event_id").limit(25)


@query("o12_greedy_pick", "SELECT user_id, arg_max(event_id, struct_pack(v := value, e := -event_id)) AS event_id FROM events GROUP BY user_id")
def _(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("event_id"))


@query("w01_occurrence_index", "SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events")
def _(spark, sf):
    return joins.occurrence(table(spark, sf, "events"), ["user_id", "event_type"], "event_id").select("event_id", F.col("k").cast("long").alias("k"))


@query("w02_causal_sum", "SELECT event_id, (sum(length(event_type)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS total FROM events")
def _(spark, sf):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf, "events").select("event_id", F.sum(F.length("event_type")).over(w).alias("total"))


def _chunk_sql(left):
    lo = f"greatest((i // 4 - {left}) * 4, 0)" if left is not None else "0"
    return f"SELECT conv_id, i, j >= {lo} AND j < least((i // 4 + 1) * 4, n) AS seen, j FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id), unnest(range(0, n)) a(i), unnest(range(0, n)) b(j)"


def _mask(spark, sf, mask):
    n = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").cast("int").alias("n"))
    rows = n.select("conv_id", F.posexplode(mask(F.col("n"))).alias("i", "row"))
    return rows.select("conv_id", F.col("i").cast("long").alias("i"), F.posexplode("row").alias("j", "seen")).withColumn("j", F.col("j").cast("long"))


@query("w02_causal_mask", _chunk_sql(None).replace("j >= 0 AND j < least((i // 4 + 1) * 4, n)", "j <= i"))
def _(spark, sf):
    return _mask(spark, sf, masks.causal)


@query("w03_chunk_mask_left", _chunk_sql(1))
def _(spark, sf):
    return _mask(spark, sf, lambda n: masks.chunked(n, 4, 1))


@query("w04_chunk_mask", _chunk_sql(None))
def _(spark, sf):
    return _mask(spark, sf, lambda n: masks.chunked(n, 4))


@query("w05_chunk_policy", _chunk_sql(1).replace("AS seen", "OR (SELECT FALSE) AS seen") + " WHERE conv_id % 2 = 0 UNION ALL " + _chunk_sql(None).replace("j >= 0 AND j < least((i // 4 + 1) * 4, n)", "TRUE") + " WHERE conv_id % 2 = 1")
def _(spark, sf):
    static = _mask(spark, sf, lambda n: masks.by_policy(n, static_chunk=4, left=1)).filter(F.col("conv_id") % 2 == 0)
    return static.unionByName(_mask(spark, sf, lambda n: masks.by_policy(n)).filter(F.col("conv_id") % 2 == 1))


@query("w06_padding_mask", "SELECT conv_id, list_transform(range(0, m), lambda i: i >= n) AS mask FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id), (SELECT max(n) AS m FROM (SELECT count(*) AS n FROM conversations GROUP BY conv_id))")
def _(spark, sf):
    n = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").cast("int").alias("n"))
    most = n.agg(F.max("n").alias("m"))
    return n.crossJoin(F.broadcast(most)).select("conv_id", masks.padding(F.col("n"), F.col("m")).alias("mask"))


PROBS = "SELECT user_id, event_type, count(*) / sum(count(*)) OVER (PARTITION BY user_id) AS p, count(*) AS n FROM events GROUP BY user_id, event_type"


def _probs(spark, sf):
    n = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("user_id")))


@query("w07_top_p", f"SELECT user_id, event_type FROM (SELECT *, sum(p) OVER (PARTITION BY user_id ORDER BY n DESC, event_type ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - p AS before FROM ({PROBS})) WHERE round(before, 9) < 0.8")
def _(spark, sf):
    return sequences.top_p(_probs(spark, sf), "user_id", "p", [F.desc("n"), F.col("event_type")], 0.8).select("user_id", "event_type")


@query("w08_quantized_cdf", f"SELECT user_id, event_type, sum(q) OVER (PARTITION BY user_id ORDER BY event_type ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS cdf FROM (SELECT *, floor(round(p * (65536 - 2 * count(*) OVER (PARTITION BY user_id)), 6))::BIGINT + 2 AS q FROM ({PROBS}))")
def _(spark, sf):
    return sequences.quantised_cdf(_probs(spark, sf), "user_id", "event_type", "p", 16, 2).select("user_id", "event_type", "cdf")


@query("w09_repetitions", "SELECT event_id, coalesce(n, 0) >= 10 * 0.3 AS repeats FROM (SELECT e.event_id, (SELECT count(*) FROM numbered x WHERE x.user_id = e.user_id AND x.k BETWEEN e.k - 10 AND e.k - 1 AND x.event_type = e.event_type) AS n FROM numbered e)".replace("numbered", "(SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events)"))
def _(spark, sf):
    return sequences.repetitions(table(spark, sf, "events"), "user_id", "event_id", "event_type", 10, 0.3).select("event_id", "repeats")


@query("w10_sliding_segments", "SELECT doc_id, s AS start, least(s + 400, n_chars) - s AS size FROM documents, unnest(range(0, n_chars, 300)) t(s)")
def _(spark, sf):
    d = table(spark, sf, "documents")
    return d.filter("n_chars > 0").select("doc_id", F.explode(sequences.segments(F.col("n_chars"), 400, 0.25)).alias("s")).select("doc_id", "s.start", "s.size")


@query("w11_overlap_add", """WITH f AS (SELECT vec_id // 50 AS series, vec_id % 50 AS t, embedding AS v FROM embeddings),
x AS (SELECT series, t * 48 + i - 1 AS pos, v[i]::DOUBLE AS v, 0.5 - abs((i / 65.0) - 0.5) AS w FROM f, unnest(range(1, 65)) u(i))
SELECT series, pos, round(sum(w * v) / sum(w), 6) AS value FROM x GROUP BY series, pos""")
def _(spark, sf):
    return sequences.overlap_add(series(spark, sf), "series", "t", "vec", 64, 48).select("series", "pos", F.round("value", 6).alias("value"))


@query("w12_windowed_overlap_add", """WITH f AS (SELECT vec_id // 50 AS series, vec_id % 50 AS t, embedding AS v FROM embeddings),
x AS (SELECT series, t * 16 + i - 1 AS pos, v[i]::DOUBLE AS v, 0.5 - 0.5 * cos(2 * pi() * (i - 1) / 64) AS w FROM f, unnest(range(1, 65)) u(i))
SELECT series, pos, round(sum(w * v) / sum(w * w), 5) AS value FROM x GROUP BY series, pos HAVING sum(w * w) > 1e-3""")
def _(spark, sf):
    return sequences.windowed_overlap_add(series(spark, sf), "series", "t", "vec", 64, 16, floor=1e-3).select("series", "pos", F.round("value", 5).alias("value"))


@query("w13_cross_fade", "SELECT vec_id, list_transform(range(1, 17), lambda i: round(embedding[i]::DOUBLE * (i / 17.0) + embedding[48 + i]::DOUBLE * (1 - i / 17.0), 6)) AS faded FROM embeddings")
def _(spark, sf):
    fade = sequences.cross_fade(F.slice("embedding", 49, 16), F.slice("embedding", 1, 16), 16)
    return table(spark, sf, "embeddings").select("vec_id", F.transform(fade, lambda x: rounded(x, 6)).alias("faded"))


@query("w14_interpolated", """WITH x AS (SELECT vec_id, embedding AS e, k, greatest(0::DOUBLE, (k + 0.5::DOUBLE) * (64::DOUBLE / 100) - 0.5::DOUBLE) AS x FROM embeddings, unnest(range(0, 100)) t(k)),
l AS (SELECT *, floor(x)::INT AS low FROM x)
SELECT vec_id, k, e[low + 1]::DOUBLE * (1 - (x - low)) + e[least(63, low + 1) + 1]::DOUBLE * (x - low) AS v FROM l""")
def _(spark, sf):
    v = sequences.interpolated(F.col("embedding"), F.lit(100))
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode(v).alias("k", "v")).withColumn("k", F.col("k").cast("long"))
