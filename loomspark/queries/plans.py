"""Queries over whole pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.operators import batching, tools
from loomspark.plans import mixing, run_comparison, stages, tool_rows
from loomspark.queries.batching import coin_sql
from loomspark.queries.filters import WORDS_SQL, n_words
from loomspark.queries.tokens import IDS, ids
from loomspark.registry import query
from loomspark.runtime import hash32, hash32_sql, table
from loomspark.sources.files import Manifest

MIX = [
    {"name": "en", "dataset_path": "/data/en", "data_struct": "com", "sampling_rate": 0.5},
    {"name": "de", "dataset_path": "/data/de", "data_struct": "sats-reason"},
    {"name": "fr", "dataset_path": "/data/fr", "data_struct": "s2s", "sampling_rate": 0.8, "system_prompt": "Be brief."},
]


@query("plan_manifest_mix", f"""WITH x AS (SELECT i.doc_id, ids, d.lang AS source FROM ({IDS}) i JOIN documents d USING (doc_id) WHERE d.lang IN ('en', 'de', 'fr')),
k AS (SELECT *, row_number() OVER (ORDER BY {hash32_sql('13', 'doc_id')} * 1048576 + doc_id % 1048576) - 1 AS place FROM x WHERE {coin_sql('13', 'doc_id')} < CASE source WHEN 'en' THEN 0.5 WHEN 'de' THEN 1.0 ELSE 0.8 END),
a AS (SELECT *, list_concat([151942], ids, [151936, 151943]) AS r FROM k)
SELECT doc_id, source, place, list_concat([151938, 151937], CASE source WHEN 'en' THEN list_concat([151941], ids, [151936], r) WHEN 'de' THEN list_concat([151944], ids, [151936], r) ELSE r END) AS ids,
list_concat([-100, -100], CASE source WHEN 'en' THEN list_concat([151941], ids, [151936], r) WHEN 'de' THEN list_concat([151944], ids, [151936], r) ELSE r END) AS labels FROM a""")
def _(spark, sf):
    d = ids(spark, sf).withColumnRenamed("ids", "words").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    parts = {k: d.filter(F.col("lang") == k).drop("lang") for k in ("en", "de", "fr")}
    rows = mixing.mix(Manifest.parse(MIX), parts, "doc_id", 13)
    w = F.col("words")
    prompt = F.array(F.lit(151938).cast("long"), F.lit(151937).cast("long"))
    return mixing.packed(rows, w, w, w, prompt).select("doc_id", "source", "place", "ids", "labels")


def _runs(k):
    return f"SELECT user_id AS key, event_id AS pos, length(event_type) + event_id % 4 AS token, event_id % (SELECT count(*) FROM embeddings) AS vec_id FROM events WHERE event_id % 3 = {k}"


@query("plan_run_comparison", f"""WITH {", ".join(f"{n} AS (SELECT *, row_number() OVER (PARTITION BY key, token ORDER BY pos) AS k FROM ({_runs(i)}))" for i, n in enumerate("abc"))},
p AS (SELECT a.key, a.vec_id AS x, b.vec_id AS y, c.vec_id AS z FROM a JOIN b USING (key, token, k) JOIN c USING (key, token, k)),
s AS (SELECT l AS layer, list_cosine_similarity(e.embedding[l * 16 + 1:l * 16 + 16]::DOUBLE[], f.embedding[l * 16 + 1:l * 16 + 16]::DOUBLE[]) AS ab, list_cosine_similarity(e.embedding[l * 16 + 1:l * 16 + 16]::DOUBLE[], g.embedding[l * 16 + 1:l * 16 + 16]::DOUBLE[]) AS ac
 FROM p JOIN embeddings e ON e.vec_id = x JOIN embeddings f ON f.vec_id = y JOIN embeddings g ON g.vec_id = z, unnest(range(0, 4)) t(l)), u AS (SELECT layer, 'ab' AS pair, ab AS v FROM s UNION ALL SELECT layer, 'ac', ac FROM s)
SELECT pair, layer, round(avg(v), 5) AS mean, round(stddev_samp(v), 5) AS std, round(1.96 * stddev_samp(v) / sqrt(count(*)), 5) AS ci95, count(*) AS n FROM u GROUP BY pair, layer""")
def _(spark, sf):
    e = table(spark, sf, "events").withColumn("vec_id", F.col("event_id") % table(spark, sf, "embeddings").count())
    layers = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda l: F.slice("embedding", l * 16 + 1, F.lit(16)))
    e = e.join(table(spark, sf, "embeddings").select("vec_id", layers.alias("layers")), "vec_id")
    run = lambda k: e.filter(F.col("event_id") % 3 == k).select(F.col("user_id").alias("key"), F.col("event_id").alias("pos"), (F.length("event_type") + F.col("event_id") % 4).alias("token"), "layers")
    out = run_comparison.compare(run(0), run(1), run(2))
    return out.select("pair", F.col("layer").cast("long").alias("layer"), *[F.round(c, 5).alias(c) for c in ("mean", "std", "ci95")], "n")


SPEC = """'{"name":"' || name || '","n":' || length(name) || '}'"""


@query("plan_tool_rows", f"""WITH pool AS (SELECT name, {SPEC} AS spec FROM (SELECT DISTINCT source AS name FROM documents)), q AS (SELECT item_id AS request, text AS question, 'src' || (item_id % 7) AS f, 'src' || (item_id % 7 + 1) AS g, item_id % 3 = 0 AS two FROM benchmark),
own AS (SELECT request, 0 AS kind, 0::BIGINT AS spot, f AS name FROM q UNION ALL SELECT request, 0, 1, g FROM q WHERE two),
ex AS (SELECT request, 1 AS kind, row_number() OVER (PARTITION BY request ORDER BY {hash32_sql('name')}, name) AS spot, name FROM q, pool WHERE name <> f AND (NOT two OR name <> g) QUALIFY spot <= 3),
l AS (SELECT request, string_agg(spec, chr(10) ORDER BY kind, spot) AS tools FROM (SELECT * FROM own UNION ALL SELECT * FROM ex) JOIN pool USING (name) GROUP BY request)
SELECT request, '{tools.INTRO}' || chr(10) || chr(10) || '{tools.SIGNATURES}' || chr(10) || '<tools>' || chr(10) || tools || chr(10) || '</tools>' || chr(10) || chr(10) || '{tools.FORMAT}' || chr(10) || chr(10) || '{tools.MULTI}' || question AS instruction, '' AS input,
'<tool_call>' || chr(10) || '{{"name": "' || f || '", "arguments": {{"a":1}}}}' || chr(10) || '</tool_call>' || CASE WHEN two THEN chr(10) || '<tool_call>' || chr(10) || '{{"name": "' || g || '", "arguments": {{}}}}' || chr(10) || '</tool_call>' ELSE '' END AS output FROM q JOIN l USING (request)""")
def _(spark, sf):
    pool = table(spark, sf, "documents").select(F.col("source").alias("name")).distinct()
    pool = pool.withColumn("spec", F.concat(F.lit('{"name":"'), "name", F.lit('","n":'), F.length("name").cast("string"), F.lit("}")))
    name = lambda k: F.concat(F.lit("src"), (F.col("item_id") % 7 + k).cast("string"))
    call = lambda k, p: F.struct(name(k).alias("function"), F.lit("d").alias("description"), F.lit(p).cast("string").alias("parameters"))
    first, second = call(0, '{"a":1}'), call(1, "{}")
    b = table(spark, sf, "benchmark")
    examples = b.select(F.col("item_id").alias("request"), F.col("text").alias("question"), F.when(F.col("item_id") % 3 == 0, F.array(first, second)).otherwise(F.array(first)).alias("function_calls"))
    picks = spark.createDataFrame([], "request long, kind int, place int, name string")
    return tool_rows.convert(examples, pool, picks, 3, hash32("name"))


STEPS = [
    {"stage": "length_filter", "frames": "n_chars", "tokens": "n_tokens", "max_tokens": 1000},
    {"stage": "sample", "key": "doc_id", "rate": 0.5, "seed": 21},
    {"stage": "batch", "kind": "static", "key": "doc_id", "size": 8},
    {"stage": "select", "columns": ["doc_id", "batch"]},
]


@query("plan_configured_stages", f"""SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 8 AS batch FROM (SELECT doc_id, n_chars, {WORDS_SQL} AS w FROM documents)
WHERE n_chars BETWEEN 10 AND 10240 AND w BETWEEN 1 AND 1000 AND w / n_chars BETWEEN 0.0005 AND 1 AND {coin_sql('21', 'doc_id')} < 0.5""")
def _(spark, sf):
    d = table(spark, sf, "documents").filter(F.col("n_chars").between(10, 10240)).select("doc_id", "n_chars", n_words().alias("n_tokens"))
    return stages.run(d, STEPS)
