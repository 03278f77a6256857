"""Queries over sampling, sharding, batching and padding."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.operators import batching as bt
from loomspark.operators import tools
from loomspark.queries.tokens import IDS, ids
from loomspark.registry import query
from loomspark.runtime import hash32_sql, table

TWO32 = 1 << 32


def coin_sql(*parts):
    return f"({hash32_sql(*parts)} / {TWO32}.0::DOUBLE)"


@query("b01_sampled_sources", f"SELECT doc_id, source FROM documents WHERE {coin_sql('5', 'doc_id')} < CASE source WHEN 'src0' THEN 0.25 WHEN 'src1' THEN 1.0 ELSE 0.5 END")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source")
    return bt.sampled(d, "doc_id", F.when(F.col("source") == "src0", 0.25).when(F.col("source") == "src1", 1.0).otherwise(0.5), 5)


@query("b02_shards", """WITH r AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS row, count(*) OVER () AS n FROM benchmark),
p AS (SELECT item_id, place, place % 3 AS rank, place // 3 AS spot, (greatest(n, 3) - 1 - place % 3) // 3 + 1 AS size FROM r, unnest(range(row, greatest(n, 3), n)) t(place))
SELECT item_id, rank, slot % 16 AS worker, slot // 16 AS turn FROM p, unnest(range(spot, greatest(size, 16), size)) t(slot)""")
def _(spark, sf):
    return bt.shards(table(spark, sf, "benchmark").select("item_id"), "item_id", 3, 16).select("item_id", *[F.col(c).cast("long").alias(c) for c in ("rank", "worker", "turn")])


@query("b03_modulo_split", "SELECT doc_id, doc_id % 7 AS worker FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.pmod("doc_id", F.lit(7)).alias("worker"))


@query("b04_static_batches", "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS batch FROM documents")
def _(spark, sf):
    return bt.batches(table(spark, sf, "documents").select("doc_id"), "static", "doc_id", size=16)


DYNAMIC = """WITH RECURSIVE p AS (SELECT doc_id // 250 AS shard, doc_id, n_chars, row_number() OVER (PARTITION BY doc_id // 250 ORDER BY doc_id) AS k FROM documents),
f AS (SELECT shard, doc_id, n_chars, k, 0::BIGINT AS batch, n_chars AS most, 1::BIGINT AS n FROM p WHERE k = 1
 UNION ALL SELECT p.shard, p.doc_id, p.n_chars, p.k, CASE WHEN greatest(f.most, p.n_chars) * (f.n + 1) > 12000 THEN f.batch + 1 ELSE f.batch END,
 CASE WHEN greatest(f.most, p.n_chars) * (f.n + 1) > 12000 THEN p.n_chars ELSE greatest(f.most, p.n_chars) END, CASE WHEN greatest(f.most, p.n_chars) * (f.n + 1) > 12000 THEN 1 ELSE f.n + 1 END
 FROM f JOIN p ON p.shard = f.shard AND p.k = f.k + 1) SELECT shard, doc_id, n_chars, batch FROM f"""


def sharded(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "n_chars", F.expr("doc_id div 250").alias("shard"))


@query("b05_dynamic_batches", DYNAMIC)
def _(spark, sf):
    return bt.dynamic_batches(sharded(spark, sf), "shard", ["doc_id"], "doc_id", "n_chars")


@query("b06_batches_by_name", f"SELECT 'dynamic' AS kind, doc_id, batch FROM ({DYNAMIC}) UNION ALL SELECT 'static', doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 16 FROM documents")
def _(spark, sf):
    d = sharded(spark, sf)
    made = {"dynamic": bt.batches(d, "dynamic", "doc_id", shard="shard", order=["doc_id"], length="n_chars"), "static": bt.batches(d, "static", "doc_id", size=16)}
    a, b = (x.select(F.lit(k).alias("kind"), "doc_id", "batch") for k, x in made.items())
    return a.unionByName(b)


BATCHED = f"SELECT doc_id, ids, (row_number() OVER (ORDER BY doc_id) - 1) // 8 AS batch FROM ({IDS})"


def batched(spark, sf):
    return bt.static_batches(ids(spark, sf), "doc_id", 8)


@query("b07_collated", f"SELECT doc_id, batch, len(ids) AS n, list_concat(ids, list_transform(range(0, max(len(ids)) OVER (PARTITION BY batch) - len(ids)), lambda i: 0)) AS ids FROM ({BATCHED})")
def _(spark, sf):
    out = bt.collated(batched(spark, sf), "batch", {"ids": F.lit(0).cast("long")})
    return out.select("doc_id", "batch", F.col("ids_len").cast("long").alias("n"), "ids")


@query("b08_two_sided_collate", f"""SELECT doc_id, list_concat(list_transform(range(0, max(len(p)) OVER w - len(p)), lambda i: -1), p, a, list_transform(range(0, max(len(a)) OVER w - len(a)), lambda i: -1)) AS ids
FROM (SELECT *, ids[1:len(ids) // 3] AS p, ids[len(ids) // 3 + 1:] AS a FROM ({BATCHED})) WINDOW w AS (PARTITION BY batch)""")
def _(spark, sf):
    n = F.floor(F.size("ids") / 3).cast("int")
    b = batched(spark, sf).select("doc_id", "batch", F.slice("ids", F.lit(1), n).alias("p"), F.slice("ids", n + 1, F.size("ids") + 1).alias("a"))
    pad = F.lit(-1).cast("long")
    return bt.collated(b, "batch", {"p": pad, "a": pad}, left=("p",)).select("doc_id", F.concat("p", "a").alias("ids"))


@query("b09_padded", f"SELECT doc_id, CASE WHEN len(ids) >= 20 THEN ids[1:20] ELSE list_concat(ids, list_transform(range(0, 20 - len(ids)), lambda i: 9)) END AS r, CASE WHEN len(ids) >= 20 THEN ids[len(ids) - 19:] ELSE list_concat(list_transform(range(0, 20 - len(ids)), lambda i: 9), ids) END AS l FROM ({IDS})")
def _(spark, sf):
    nine = F.lit(9).cast("long")
    return ids(spark, sf).select("doc_id", bt.padded(F.col("ids"), 20, nine).alias("r"), bt.padded(F.col("ids"), 20, nine, left=True).alias("l"))


@query("b10_cropped", f"SELECT doc_id, CASE WHEN len(ids) > 12 THEN ids[s + 1:s + 12] ELSE list_concat(ids, list_transform(range(0, 12 - len(ids)), lambda i: 0)) END AS ids FROM (SELECT *, CASE WHEN len(ids) > 12 THEN {hash32_sql('2', 'doc_id')} % (len(ids) - 11) ELSE 0 END AS s FROM ({IDS}))")
def _(spark, sf):
    from loomspark.runtime import hash32

    return ids(spark, sf).select("doc_id", bt.cropped(F.col("ids"), 12, hash32(F.lit(2), "doc_id"), F.lit(0).cast("long")).alias("ids"))


@query("b11_cycled", f"SELECT doc_id, list_transform(range(0, 25), lambda i: ids[i % len(ids) + 1]) AS ids FROM ({IDS}) WHERE len(ids) > 0")
def _(spark, sf):
    return ids(spark, sf).filter(F.size("ids") > 0).select("doc_id", bt.cycled(F.col("ids"), 25).alias("ids"))


@query("b12_picked_parameters", f"""SELECT event_id, list(name ORDER BY h, name) AS names FROM (SELECT event_id, name, h, row_number() OVER (PARTITION BY event_id ORDER BY h, name) AS r FROM
 (SELECT event_id, name, {hash32_sql('event_id', 'name')} AS h FROM events, unnest(['a', 'b', 'c', 'd', 'e']) t(name))) WHERE r <= 3 GROUP BY event_id""")
def _(spark, sf):
    names = F.array(*map(F.lit, "abcde"))
    return table(spark, sf, "events").select("event_id", bt.picked(names, F.lit(0.6), F.col("event_id")).alias("names"))


@query("b13_codebook_seeds", f"SELECT code - 1 AS code, vec_id FROM (SELECT vec_id, row_number() OVER (ORDER BY {hash32_sql('4', 'vec_id')}, vec_id) AS code FROM embeddings) WHERE code <= 64")
def _(spark, sf):
    return bt.seeds(table(spark, sf, "embeddings").select("vec_id"), "vec_id", 64, 4).select("code", "vec_id")


@query("b14_distractors", f"""WITH pool AS (SELECT DISTINCT source AS name FROM documents), focus AS (SELECT item_id AS request, 'src' || (item_id % 20) AS f FROM benchmark),
valid AS (SELECT request, name, min(kind * 10 + place) AS spot FROM (SELECT item_id AS request, 'src' || ((item_id + 1) % 25) AS name, 1 AS kind, 0 AS place FROM benchmark UNION ALL SELECT item_id, 'src' || ((item_id + 2) % 25), 0, 0 FROM benchmark)
 JOIN pool USING (name) JOIN focus USING (request) WHERE name <> f GROUP BY request, name),
every AS (SELECT request, name, spot // 10 AS kind, 0::BIGINT AS place FROM valid UNION ALL SELECT request, name, 2, {hash32_sql('name')} FROM focus, pool WHERE name <> f AND NOT EXISTS (SELECT 1 FROM valid v WHERE v.request = focus.request AND v.name = pool.name))
SELECT request, rank, name FROM (SELECT request, name, row_number() OVER (PARTITION BY request ORDER BY kind, place, name) AS rank FROM every) WHERE rank <= 6""")
def _(spark, sf):
    from loomspark.runtime import hash32

    pool = table(spark, sf, "documents").select(F.col("source").alias("name")).distinct()
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("request"))
    name = lambda k, n: F.concat(F.lit(" src"), ((F.col("request") + k) % n).cast("string"))
    picks = b.select("request", F.lit(1).alias("kind"), F.lit(0).alias("place"), name(1, 25).alias("name")).unionByName(b.select("request", F.lit(0).alias("kind"), F.lit(0).alias("place"), name(2, 25).alias("name")))
    requests = b.select("request", F.array(F.trim(name(0, 20))).alias("focus"))
    return tools.distractors(requests, pool, picks, 6, hash32("name")).withColumn("rank", F.col("rank").cast("long"))


@query("b15_curriculum_cut", f"""SELECT doc_id, ids[trunc(len(ids) * (spot / 5000::DOUBLE))::INT + 1:] AS ids FROM (SELECT *, CASE WHEN {coin_sql('1', 'doc_id')} < 0.3
 THEN greatest(0, least(trunc(doc_id + ({coin_sql('2', 'doc_id')} * 2 - 1) * 0.1 * 5000)::BIGINT, 4999)) ELSE doc_id END AS spot FROM ({IDS}))""")
def _(spark, sf):
    return ids(spark, sf).select("doc_id", bt.curriculum_cut(F.col("ids"), F.col("doc_id"), F.lit(5000), 1).alias("ids"))


@query("b16_bistream", f"SELECT event_id, {coin_sql('3', 'event_id')} < 0.5 AND (event_id % 100) / (user_id + 1) > 3.0 AS bistream FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", bt.bistream(F.col("event_id"), F.col("user_id") + 1, F.col("event_id") % 100, seed=3).alias("bistream"))


@query("b17_conditioning", f"SELECT doc_id, list_transform(ids, lambda v, i: CASE WHEN i <= r THEN v ELSE 0 END) AS ids FROM (SELECT *, CASE WHEN {coin_sql('6', 'doc_id')} < 0.5 THEN 0 ELSE trunc({coin_sql('7', 'doc_id')} * (trunc(len(ids) * 0.3) + 1)) END AS r FROM ({IDS}))")
def _(spark, sf):
    return ids(spark, sf).select("doc_id", bt.conditioning(F.col("ids"), F.col("doc_id"), 6).alias("ids"))


def _records(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", (F.col("vec_id") % 7 + 1).cast("int").alias("n"), "embedding", F.expr("vec_id div 16").alias("batch"))
    frames = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.slice("embedding", i * 8 - 7, F.lit(8)))
    tokens = lambda k: F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.col("vec_id") + i * k)
    return e.select("batch", "vec_id", tokens(1).alias("text_token"), tokens(2).alias("speech_token"), frames.alias("speech_feat"), F.slice("embedding", F.lit(1), F.col("n") * 2).alias("speech"), F.slice("embedding", F.lit(9), F.col("n")).alias("pitch_feat"), tokens(3).alias("reject_speech_token"), F.lit("spk").alias("spk_embedding"), F.lit("utt").alias("utt_embedding"))


def _record_sql(columns):
    pads = {"text_token": ("list_transform(range(1, n + 1), lambda i: vec_id + i)", "0"), "speech_token": ("list_transform(range(1, n + 1), lambda i: vec_id + i * 2)", "0"), "reject_speech_token": ("list_transform(range(1, n + 1), lambda i: vec_id + i * 3)", "0"),
            "speech_feat": ("list_transform(range(1, n + 1), lambda i: embedding[i * 8 - 7:i * 8])", "[0, 0, 0, 0, 0, 0, 0, 0]"), "speech": ("embedding[1:n * 2]", "0"), "pitch_feat": ("embedding[9:n + 8]", "0")}
    made = ", ".join(f"list_concat({c}, list_transform(range(0, max(len({c})) OVER w - len({c})), lambda i: {pads[c][1]})) AS {c}, len({c})::INT AS {c}_len" for c in columns)
    raw = ", ".join(f"{pads[c][0]} AS {c}" for c in columns)
    return f"batch, vec_id, row_number() OVER (PARTITION BY batch ORDER BY n DESC, vec_id) - 1 AS place, {made} FROM (SELECT vec_id // 16 AS batch, vec_id, n, {raw} FROM (SELECT vec_id, embedding, vec_id % 7 + 1 AS n FROM embeddings)) WINDOW w AS (PARTITION BY batch)"


@query("b07_collated_records", f"SELECT 'utt' AS embedding, {_record_sql(['text_token', 'speech_token', 'speech_feat'])}")
def _(spark, sf):
    return bt.collated_records(_records(spark, sf), "batch", "vec_id")


@query("b07_collated_records_gan_dpo", f"SELECT 'spk' AS embedding, {_record_sql(['text_token', 'speech_token', 'speech_feat', 'speech', 'pitch_feat', 'reject_speech_token'])}")
def _(spark, sf):
    return bt.collated_records(_records(spark, sf), "batch", "vec_id", gan=True, dpo=True, speaker=True)
