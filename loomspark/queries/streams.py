"""Queries over streams and their batch twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomspark.functions import text
from loomspark.registry import query
from loomspark.runtime import hash32_sql, table, work_dir
from loomspark.streaming import sessions

ROWS = "SELECT user_id AS key, event_id AS seq, event_id % 50 AS token, event_type IN ('click', 'view') AS is_text, event_id = max(event_id) OVER (PARTITION BY user_id) AS last FROM events"
NUMBERED = f"SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) - 1 AS i, count(*) OVER (PARTITION BY key) AS n FROM ({ROWS})"


def rows(spark, sf):
    e = table(spark, sf, "events")
    last = e.groupBy("user_id").agg(F.max("event_id").alias("_last"))
    return e.join(last, "user_id").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), (F.col("event_id") % 50).alias("token"), F.col("event_type").isin("click", "view").alias("is_text"), (F.col("event_id") == F.col("_last")).alias("last"))


HOPS = f"""WITH r AS ({NUMBERED}), k AS (SELECT key, n, greatest(0, (n - 30) // 10 + 1) AS full_chunks FROM r GROUP BY key, n),
c AS (SELECT key, c AS chunk, c * 10 AS lo, CASE WHEN c < full_chunks THEN c * 10 + 30 ELSE n END AS hi, c >= full_chunks AS final FROM k, unnest(range(0, full_chunks + 1)) t(c))
SELECT c.key, c.chunk, coalesce(list(r.token ORDER BY r.i) FILTER (r.i IS NOT NULL), []) AS tokens, c.final FROM c LEFT JOIN r ON r.key = c.key AND r.i >= c.lo AND r.i < c.hi GROUP BY c.key, c.chunk, c.final"""


@query("t01_hop_windows", HOPS)
def _(spark, sf):
    return sessions.batch(rows(spark, sf), sessions.HopWindows(10, 20))


@query("t01_t02_t04_hop_windows_streamed", HOPS)
def _(spark, sf):
    return sessions.streamed(rows(spark, sf), sessions.HopWindows(10, 20), work_dir(spark, "stream"))


@query("t02_flush", f"WITH r AS ({NUMBERED}) SELECT key, greatest(0, (n - 30) // 10 + 1) AS chunk, n - 10 * greatest(0, (n - 30) // 10 + 1) AS left_over FROM r GROUP BY key, n")
def _(spark, sf):
    out = sessions.batch(rows(spark, sf), sessions.HopWindows(10, 20)).filter("final")
    return out.select("key", "chunk", F.size("tokens").cast("long").alias("left_over"))


PREFIX = f"""WITH k AS (SELECT key, max(n) AS n FROM ({NUMBERED}) GROUP BY key), f AS (SELECT key, n, CASE WHEN n < 18 + 3 THEN 0 ELSE 1 + (n - 21) // 10 END AS m FROM k)
SELECT key, c AS chunk, CASE WHEN c = 0 THEN 0 ELSE 18 + (c - 1) * 10 END AS start, CASE WHEN c = m THEN n ELSE 18 + c * 10 END AS stop, c = m AS final FROM f, unnest(range(0, m + 1)) t(c)"""


@query("t03_prefix_windows", PREFIX)
def _(spark, sf):
    return sessions.batch(rows(spark, sf), sessions.PrefixWindows(10, 3, 12))


@query("t04_sessions", f"SELECT key, count(*) AS n, bool_or(last) AS ended FROM ({ROWS}) GROUP BY key")
def _(spark, sf):
    return rows(spark, sf).groupBy("key").agg(F.count("*").alias("n"), F.bool_or("last").alias("ended"))


TWO = f"""WITH s AS (SELECT key, token, is_text, row_number() OVER (PARTITION BY key, is_text ORDER BY seq) - 1 AS i, count(*) FILTER (is_text) OVER (PARTITION BY key) AS nt, count(*) FILTER (NOT is_text) OVER (PARTITION BY key) AS ns FROM ({ROWS})),
p AS (SELECT *, least(nt // 2, ns // 3) AS full_rounds FROM s)
SELECT key, token, is_text, CASE WHEN is_text THEN CASE WHEN i < full_rounds * 2 THEN i // 2 * 5 + i % 2 ELSE full_rounds * 5 + i - full_rounds * 2 END
 ELSE CASE WHEN i < full_rounds * 3 THEN i // 3 * 5 + 2 + i % 3 ELSE full_rounds * 5 + (nt - full_rounds * 2) + i - full_rounds * 3 END END AS place FROM p"""


@query("t05_two_sided", TWO)
def _(spark, sf):
    return sessions.batch(rows(spark, sf), sessions.TwoSided(2, 3))


@query("t05_two_sided_streamed", TWO)
def _(spark, sf):
    return sessions.streamed(rows(spark, sf), sessions.TwoSided(2, 3), work_dir(spark, "stream"))


PHASES = f"""WITH r AS ({NUMBERED}), e AS (SELECT *, CASE WHEN i + 1 >= 12 THEN 7 ELSE token END AS t FROM r), x AS (SELECT key, min(i) FILTER (t = 7) AS te FROM e GROUP BY key),
a AS (SELECT r.key, min(i) AS ae FROM r JOIN x USING (key) WHERE i > te AND token = 9 GROUP BY r.key)
SELECT e.key, i AS step, CASE WHEN i <= coalesce(te, n) THEN t END AS text_token, CASE WHEN i > te THEN token END AS audio_token, coalesce(i >= te, FALSE) AS is_text_end, coalesce(i = ae, FALSE) AS is_audio_end
FROM e JOIN x USING (key) LEFT JOIN a USING (key) WHERE i <= coalesce(ae, n)"""


@query("t06_t07_phases", PHASES)
def _(spark, sf):
    return sessions.batch(rows(spark, sf), sessions.Phases(7, 9, 12))


@query("t08_first_output", "SELECT user_id, round((epoch_us(min(ts) FILTER (event_type = 'purchase')) - epoch_us(min(ts) FILTER (event_type = 'view'))) / 1e6, 6) AS latency, count(*) FILTER (event_type = 'purchase') AS n FROM events GROUP BY user_id")
def _(spark, sf):
    out = sessions.first_output(table(spark, sf, "events"), "user_id", "ts", "event_type", "view", "purchase")
    return out.withColumn("latency", F.round("latency", 6))


@query("t11_encode_windows", "SELECT doc_id, s AS start, least(s + 67, n_chars) AS stop, least((s // 64) * 16, 32) AS cache FROM documents, unnest(range(0, n_chars - 7 + 1, 64)) t(s) WHERE n_chars >= 7")
def _(spark, sf):
    w = sessions.encode_windows(F.col("n_chars"), 7, 4, 16, 2)
    return table(spark, sf, "documents").select("doc_id", F.explode(w).alias("w")).select("doc_id", "w.*")


@query("t12_new_suffix", "SELECT conv_id, turn, list(turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS fresh FROM conversations")
def _(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    full = F.collect_list("turn").over(w.rowsBetween(Window.unboundedPreceding, 0))
    c = table(spark, sf, "conversations").withColumn("full", full)
    return c.select("conv_id", "turn", sessions.new_suffix(F.col("full"), F.greatest(F.size("full") - 2, F.lit(0))).alias("fresh"))


@query("t13_consumed", f"SELECT key, list(token ORDER BY seq) FILTER (is_text) AS text_ids, list(token ORDER BY seq) FILTER (NOT is_text) AS audio_ids FROM ({ROWS}) GROUP BY key HAVING bool_or(is_text) AND NOT bool_and(is_text)")
def _(spark, sf):
    r = rows(spark, sf)
    ids = lambda on: F.transform(F.array_sort(F.collect_list(F.when(on, F.struct("seq", "token")))), lambda x: x["token"])
    out = r.groupBy("key").agg(ids(F.col("is_text")).alias("text_ids"), ids(~F.col("is_text")).alias("audio_ids"))
    return out.filter((F.size("text_ids") > 0) & (F.size("audio_ids") > 0))


@query("t09_multiplexed", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS turn, event_id = max(event_id) OVER (PARTITION BY user_id) AS closes FROM events")
def _(spark, sf):
    return sessions.multiplexed(table(spark, sf, "events").select("user_id", "event_id"), "user_id", "event_id")


@query("t10_fed_text", f"""WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') AS ws FROM conversations),
r AS (SELECT conv_id, turn, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) - 1 AS place, {hash32_sql('word')} % 50000 AS id FROM r""")
def _(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", text.encoded(F.col("text")).alias("ids"))
    return sessions.fed(c, "conv_id", "turn", "ids")
