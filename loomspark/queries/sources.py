"""Queries over readers and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.functions import audio, text
from loomspark.operators import joins
from loomspark.registry import query
from loomspark.runtime import table, work_dir
from loomspark.sources import files


@query("s01_parquet_rows", "SELECT doc_id, lang, n_chars FROM documents")
def _(spark, sf):
    return files.read_parquet_rows(spark, f"{sf}/documents.parquet", ["doc_id", "lang", "n_chars"])


@query("s02_fan_out", """
WITH t AS (SELECT conv_id AS utt, list(text ORDER BY turn) AS texts FROM conversations GROUP BY conv_id)
SELECT d.doc_id AS utt, d.lang, (i - 1)::INTEGER AS tts_index, texts[i] AS tts_text
FROM documents d JOIN t ON d.doc_id = t.utt, unnest(range(1, len(texts) + 1)) u(i)
""")
def _(spark, sf):
    conv = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("utt"))
    texts = conv.agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("texts"))
    return files.fan_out(table(spark, sf, "documents").select(F.col("doc_id").alias("utt"), "lang"), texts)


@query("s03_s04_jsonl_round_trip", "SELECT doc_id, lang, md5(text) AS text_md5 FROM documents")
def _(spark, sf):
    path = work_dir(spark, "jsonl")
    files.write_jsonl(table(spark, sf, "documents").select("doc_id", "lang", "text"), path)
    rows = files.read_jsonl(spark, path, "doc_id long, lang string, text string")
    return rows.select("doc_id", "lang", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("s05_json_list_or_object", "SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def _(spark, sf):
    e = table(spark, sf, "events")
    e = e.select("event_id", F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("["), "props", F.lit("]"))).otherwise(F.col("props")).alias("json"))
    return files.json_items(e, "json", "struct<k:bigint>").select("event_id", "item.k")


@query("s06_examples", "SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def _(spark, sf):
    e = table(spark, sf, "events")
    listed = F.concat(F.lit("["), "props", F.lit("]"))
    e = e.select("event_id", F.when(F.col("event_id") % 2 == 0, listed).otherwise(F.concat(F.lit('{"examples":'), listed, F.lit("}"))).alias("json"))
    return files.example_lists(e, "json", "struct<k:bigint>").select("event_id", "example.k")


@query("s07_line_lists", "SELECT trim(url) AS src FROM pages WHERE trim(url) <> ''")
def _(spark, sf):
    path = work_dir(spark, "lists")
    table(spark, sf, "pages").select(F.concat(F.lit("  "), "url", F.lit(" "))).write.text(path)
    return files.read_lists(spark, path).filter("src <> ''")


@query("s07_merge_last_wins", "SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def _(spark, sf):
    return files.last_wins(table(spark, sf, "events"), "user_id", "event_id", "event_type", "value")


MANIFEST = [
    {"name": "plain", "dataset_path": "/data/plain", "data_struct": "com-reason", "sampling_rate": 0.5},
    {"name": "short", "dataset_path": "/data/short", "data_struct": "sats-reason", "sampling_rate": 1.0, "compress": {"stage": "solution", "rate": 0.7}},
    {"name": "chat", "dataset_path": "/data/chat", "data_struct": "s2s", "system_prompt": "Be brief."},
]


@query("s08_manifest", """
SELECT * FROM (VALUES ('plain', '/data/plain', 'com-reason', 0.5::DOUBLE, NULL, 1.0::DOUBLE, ''),
  ('short', '/data/short', 'sats-reason', 1.0::DOUBLE, 'solution', 0.7::DOUBLE, ''),
  ('chat', '/data/chat', 's2s', 1.0::DOUBLE, NULL, 1.0::DOUBLE, 'Be brief.')) t(name, dataset_path, data_struct, sampling_rate, stage, rate, system_prompt)
""")
def _(spark, sf):
    return files.Manifest.parse(MANIFEST).frame(spark)


@query("s09_first_key_wins", "SELECT conv_id, arg_min(role, turn) AS role, arg_min(md5(text), turn) AS text_md5 FROM conversations GROUP BY conv_id")
def _(spark, sf):
    c = table(spark, sf, "conversations").withColumn("text_md5", F.md5(F.col("text").cast("binary")))
    return files.first_wins(c, "conv_id", "turn", "role", "text_md5")


@query("s11_file_list", "SELECT DISTINCT 'audio/' || doc_id || '.wav' AS src FROM documents")
def _(spark, sf):
    path = work_dir(spark, "filelist")
    table(spark, sf, "documents").select(F.format_string("audio/%d.wav", "doc_id")).write.text(path)
    return files.read_lists(spark, path)


@query("s12_generation_sinks", """
SELECT 'prediction' AS kind, lpad(conv_id::VARCHAR, 8, '0') AS key, string_agg(text, ' / ' ORDER BY turn) FILTER (role = 'assistant') AS text FROM conversations GROUP BY conv_id
UNION ALL SELECT 'truth', lpad(conv_id::VARCHAR, 8, '0'), coalesce(min(text) FILTER (role = 'system'), min(text) FILTER (role = 'user'), '') FROM conversations GROUP BY conv_id
UNION ALL SELECT 'question', lpad(conv_id::VARCHAR, 8, '0'), min(text) FILTER (role = 'user') FROM conversations GROUP BY conv_id
""")
def _(spark, sf):
    c = table(spark, sf, "conversations")
    of = lambda role: F.when(F.col("role") == role, F.col("text"))
    answers = F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", F.struct("turn", "text")))), lambda x: x["text"])
    rows = c.groupBy("conv_id").agg(F.when(F.count(of("assistant")) > 0, answers).alias("prediction"), F.min(of("system")).alias("truth"), F.coalesce(F.min(of("user")), F.lit("")).alias("source"), F.min(of("user")).alias("question"))
    sets = files.generation_rows(rows, "conv_id", "prediction", "truth", "source", "question")
    out = [df.select(F.lit(k).alias("kind"), "key", F.when(F.lit(k) == "prediction", F.nullif("text", F.lit(""))).otherwise(F.col("text")).alias("text")) for k, df in sets.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("s13_json_and_csv", "SELECT doc_id, lang, n_chars FROM documents UNION ALL SELECT doc_id, lang, n_chars FROM documents")
def _(spark, sf):
    path = work_dir(spark, "results")
    files.write_results(table(spark, sf, "documents"), path, ["doc_id", "lang", "n_chars"])
    kind = "doc_id long, lang string, n_chars long"
    return spark.read.schema(kind).json(f"{path}/json").unionByName(spark.read.schema(kind).option("header", True).csv(f"{path}/csv"))


@query("s14_append_metrics", "SELECT event_id AS steps, user_id AS text_tokens, value AS first_audio_latency_sec FROM events")
def _(spark, sf):
    path = work_dir(spark, "metrics")
    e = table(spark, sf, "events").select(F.col("event_id").alias("steps"), F.col("user_id").alias("text_tokens"), F.col("value").alias("first_audio_latency_sec"))
    for part in (0, 1):
        files.append_metrics(e.filter(F.col("steps") % 2 == part), path)
    return spark.read.schema("steps long, text_tokens long, first_audio_latency_sec double").json(path)


@query("s16_average_lowest", """
WITH s AS (SELECT vec_id AS checkpoint, embedding[1]::DOUBLE AS loss, embedding AS values FROM embeddings),
b AS (SELECT checkpoint, values FROM s ORDER BY loss, checkpoint LIMIT 5)
SELECT (i - 1)::INTEGER AS pos, round(avg(values[i]::DOUBLE), 6) AS value FROM b, unnest(range(1, 65)) t(i) GROUP BY i
""")
def _(spark, sf):
    e = table(spark, sf, "embeddings").withColumnRenamed("vec_id", "checkpoint").withColumnRenamed("embedding", "values")
    scores = e.select("checkpoint", F.col("values")[0].cast("double").alias("loss"))
    return files.average_lowest(scores, e.select("checkpoint", "values"), 5).select("pos", F.round("value", 6).alias("value"))


@query("s17_run_info", "SELECT item_id AS step, length(text) AS size, 'base' AS model, 'bf16' AS dtype FROM benchmark")
def _(spark, sf):
    path = work_dir(spark, "checkpoint")
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("step"), F.length("text").cast("long").alias("size"))
    files.run_info(b, model="base", dtype="bf16").write.parquet(path)
    return spark.read.parquet(path)


@query("s18_throttled_scalars", "SELECT event_id, value FROM events WHERE (event_id + 1) % 50 = 0")
def _(spark, sf):
    return files.throttled(table(spark, sf, "events").select("event_id", "value"), "event_id", 50)


@query("s19_format_by_marker", "SELECT lang AS folder, CASE WHEN count(*) FILTER (doc_id % 100 = 1) > 0 THEN 'second' ELSE 'third' END AS format FROM documents GROUP BY lang")
def _(spark, sf):
    names = F.when(F.col("doc_id") % 100 == 1, "model2.yaml").otherwise("model3.yaml")
    listing = table(spark, sf, "documents").select(F.col("lang").alias("folder"), names.alias("name"))
    return files.format_by_marker(listing, {"model1.yaml": "first", "model2.yaml": "second", "model3.yaml": "third"})


@query("s20_verified_prefix", "SELECT doc_id, starts_with(sha256(text), CASE WHEN doc_id % 3 = 0 THEN substr(sha256(text), 1, 8) ELSE 'zz' END) AS ok FROM documents")
def _(spark, sf):
    d = table(spark, sf, "documents")
    prefix = F.when(F.col("doc_id") % 3 == 0, F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 8)).otherwise("zz")
    return d.select("doc_id", files.verified(F.col("text"), prefix).alias("ok"))


@query("s10_decoded_audio", "SELECT vec_id, i - 1 AS i, greatest(-32768, least(32767, trunc(embedding[i]::DOUBLE * 4 * 32768))) / 32768 AS v FROM embeddings, unnest(range(1, len(embedding) + 1)) t(i)")
def _(spark, sf):
    x = F.transform("embedding", lambda v: v.cast("double") * 4)
    e = table(spark, sf, "embeddings").select("vec_id", audio.waveform(audio.wav_bytes(x, 24_000), 24_000).alias("x"))
    return e.select("vec_id", F.posexplode("x").alias("i", "v")).withColumn("i", F.col("i").cast("long"))


@query("s15_retried", """WITH a AS (SELECT user_id, props, event_id % 4 = 0 AS ok, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
g AS (SELECT user_id, min(n) FILTER (ok) AS attempt, max(n) AS tried FROM a WHERE n <= 8 GROUP BY user_id)
SELECT g.user_id, attempt, props AS text, 5.0::DOUBLE * coalesce(attempt - 1, least(tried, 7)) * (coalesce(attempt - 1, least(tried, 7)) + 1) AS waited FROM g LEFT JOIN a ON a.user_id = g.user_id AND a.n = g.attempt""")
def _(spark, sf):
    k = F.col("event_id") % 4
    raw = F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit("{"), "props")).when(k == 2, F.lit("  ")).otherwise(F.concat(F.lit('{"error":'), "props", F.lit("}")))
    e = joins.occurrence(table(spark, sf, "events").withColumn("text", text.without_controls(raw)), ["user_id"], "event_id", "n")
    return files.first_valid(e, "user_id", "n", "text", text.envelope(F.col("text")))


@query("s09_dumps", "SELECT question_key, loss FROM (SELECT 'q' || (doc_id % 400) AS question_key, n_chars AS loss, row_number() OVER (PARTITION BY doc_id % 400 ORDER BY lang, doc_id) AS r FROM documents WHERE doc_id % 7 > 0) WHERE r = 1")
def _(spark, sf):
    # One file for each document; every seventh can't be read.
    path = work_dir(spark, "dumps")
    good = F.to_json(F.struct(F.concat(F.lit("q"), (F.col("doc_id") % 400).cast("string")).alias("question_key"), F.col("n_chars").alias("loss")))
    d = table(spark, sf, "documents").select("lang", F.format_string("%012d", "doc_id").alias("name"), F.when(F.col("doc_id") % 7 > 0, good).otherwise("{").alias("dump"))
    files.write_each(d, path, "lang", "name", "dump")
    return files.read_dumps(spark, path, "question_key string, loss long")
