"""Queries over joins and alignments."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.operators import joins, tools
from loomspark.registry import query
from loomspark.runtime import hash32, hash32_sql, table
from loomspark.sources import files

#: All events are dealt to the runs.
RUN_SQL = "SELECT user_id AS key, event_id AS pos, length(event_type) + event_id % 4 AS tok FROM events WHERE event_id % 3 = {}"


def _run(spark, sf, k, runs=3):
    e = table(spark, sf, "events").filter(F.col("event_id") % runs == k)
    return e.select(F.col("user_id").alias("key"), F.col("event_id").alias("pos"), (F.length("event_type") + F.col("event_id") % (runs + 1)).alias("tok"))


@query("j01_common_runs", "SELECT a.conv_id AS key, a.text AS a, d.lang AS b, l.toxic AS c FROM conversations a JOIN documents d ON d.doc_id = a.conv_id JOIN labels l ON l.doc_id = a.conv_id WHERE a.turn = 0")
def _(spark, sf):
    a = table(spark, sf, "conversations").filter("turn = 0").select(F.col("conv_id").alias("key"), F.col("text").alias("a"))
    b = table(spark, sf, "documents").select(F.col("doc_id").alias("key"), F.col("lang").alias("b"))
    c = table(spark, sf, "labels").select(F.col("doc_id").alias("key"), F.col("toxic").alias("c"))
    return joins.common_runs(a, b, c, "key")


@query("j02_pool_lookup", """SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'spec ' || event_type
 ELSE '{"name":"' || event_type || '","description":"d","parameters":{"type":"object","properties":{},"required":[]}}' END AS definition FROM events""")
def _(spark, sf):
    e = table(spark, sf, "events")
    pool = e.filter(F.col("event_type").isin("click", "view")).select(F.col("event_type").alias("name")).distinct().withColumn("spec", F.concat(F.lit("spec "), "name"))
    return tools.with_definitions(e.select("event_id", F.col("event_type").alias("function"), F.lit("d").alias("description")), pool).select("event_id", "definition")


@query("j03_one_to_many", "SELECT c.conv_id, c.turn, d.n_chars FROM documents d JOIN conversations c ON c.conv_id = d.doc_id")
def _(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("conv_id"), "n_chars").join(table(spark, sf, "conversations").select("conv_id", "turn"), "conv_id")


@query("j04_audio_pairs", "SELECT 'out/' || lang || '_' || source || '_' || doc_id || '.wav' AS path, concat_ws('/', lang, source, lang || '_' || source || '_' || doc_id || '.wav') AS reference FROM documents")
def _(spark, sf):
    d = table(spark, sf, "documents").select(F.concat(F.lit("out/"), F.concat_ws("_", "lang", "source", "doc_id"), F.lit(".wav")).alias("path"))
    return files.audio_pairs(d)


@query("j05_without", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND doc_id NOT IN (SELECT conv_id FROM conversations)")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    return joins.without(d, table(spark, sf, "labels"), table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id")), key="doc_id")


OCC_SQL = """a AS (SELECT *, row_number() OVER (PARTITION BY key, tok ORDER BY pos) AS k FROM (%s)),
b AS (SELECT *, row_number() OVER (PARTITION BY key, tok ORDER BY pos) AS k FROM (%s)),
c AS (SELECT *, row_number() OVER (PARTITION BY key, tok ORDER BY pos) AS k FROM (%s)),
ab AS (SELECT a.key, a.pos AS i, b.pos AS j FROM a JOIN b USING (key, tok, k)), ac AS (SELECT a.key, a.pos AS i, c.pos AS l FROM a JOIN c USING (key, tok, k))""" % tuple(RUN_SQL.format(i) for i in (0, 1, 2))


@query("j07_aligned_occurrences", f"WITH {OCC_SQL} SELECT * FROM ab")
def _(spark, sf):
    return joins.align_occurrences(_run(spark, sf, 0), _run(spark, sf, 1), "key", "tok", "pos")


@query("j06_merged_alignments", f"WITH {OCC_SQL} SELECT ab.key, ab.i, ab.j, ac.l FROM ab JOIN ac ON ab.key = ac.key AND ab.i = ac.i")
def _(spark, sf):
    a = _run(spark, sf, 0)
    ab, ac = (joins.align_occurrences(a, _run(spark, sf, k), "key", "tok", "pos") for k in (1, 2))
    return joins.merge_alignments(ab, ac, "key")


#: Rows of the table of lengths, one by one, then the walk back from its last corner.
LCS_SQL = """WITH RECURSIVE e AS (SELECT user_id AS key, event_id AS pos, length(event_type) + event_id % 3 AS tok FROM events),
x AS (SELECT key, list(pos ORDER BY pos) AS xs, list(tok ORDER BY pos) AS a FROM e WHERE pos % 2 = 0 GROUP BY key),
y AS (SELECT key, list(pos ORDER BY pos) AS ys, list(tok ORDER BY pos) AS b FROM e WHERE pos % 2 = 1 GROUP BY key),
s AS MATERIALIZED (SELECT * FROM x JOIN y USING (key)),
f AS (SELECT key, 0::BIGINT AS i, [list_transform(range(len(b) + 1), lambda z: 0::BIGINT)] AS best FROM s
 UNION ALL SELECT f.key, i + 1, list_append(best, list_prepend(0::BIGINT, list_transform(range(1, len(b) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: greatest(best[i + 1][k + 1], CASE WHEN b[k] = a[i + 1] THEN best[i + 1][k] + 1 ELSE 0 END))))))
  FROM f JOIN s ON f.key = s.key WHERE i < len(a)),
g AS (SELECT s.key, len(a) AS i, len(b) AS j, FALSE AS pair, best FROM f JOIN s ON f.key = s.key WHERE f.i = len(a)
 UNION ALL SELECT g.key, CASE WHEN a[i] = b[j] OR best[i][j + 1] >= best[i + 1][j] THEN i - 1 ELSE i END, CASE WHEN a[i] <> b[j] AND best[i][j + 1] >= best[i + 1][j] THEN j ELSE j - 1 END, a[i] = b[j], best
  FROM g JOIN s ON g.key = s.key WHERE i > 0 AND j > 0)
SELECT s.key, xs[i + 1] AS i, ys[j + 1] AS j FROM g JOIN s ON g.key = s.key WHERE pair"""


@query("j08_lcs_alignment", LCS_SQL)
def _(spark, sf):
    return joins.align_lcs(_run(spark, sf, 0, 2), _run(spark, sf, 1, 2), "key", "tok", "pos")


SERIES_SQL = "SELECT vec_id // 50 AS series, vec_id % 50 AS t, embedding AS vec FROM embeddings"


def series(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select(F.expr("vec_id div 50").alias("series"), (F.col("vec_id") % 50).alias("t"), F.col("embedding").alias("vec"))


@query("j09_series_similarity", f"WITH s AS ({SERIES_SQL}) SELECT a.series, a.t AS i, b.t AS j, round((list_cosine_similarity(a.vec::DOUBLE[], b.vec::DOUBLE[]) + 1) / 2, 5) AS similarity FROM s a JOIN s b ON a.series = b.series")
def _(spark, sf):
    return joins.series_similarity(series(spark, sf), "series", "t", "vec", 50).withColumn("similarity", F.round("similarity", 5))


BOOK_SQL = "SELECT vec_id AS code, embedding AS vec FROM embeddings WHERE vec_id % 25 = 0"
NEAREST_SQL = f"b AS ({BOOK_SQL}), n AS (SELECT e.vec_id, arg_min(b.code, struct_pack(d := round(list_distance(e.embedding::DOUBLE[], b.vec::DOUBLE[]) ** 2, 9), c := b.code)) AS code FROM embeddings e, b GROUP BY e.vec_id)"


def book(spark, sf):
    e = table(spark, sf, "embeddings").filter(F.col("vec_id") % 25 == 0)
    return e.select(F.col("vec_id").alias("code"), F.col("embedding").alias("vec"))


@query("j10_nearest_code", f"WITH {NEAREST_SQL} SELECT * FROM n")
def _(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    return joins.nearest_code(e, book(spark, sf)).select("vec_id", "code")


@query("j11_code_vectors", "SELECT e.vec_id, b.embedding AS vec FROM embeddings e JOIN embeddings b ON b.vec_id = (e.label * 25) WHERE (e.label * 25) % 25 = 0")
def _(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", (F.col("label") * 25).cast("long").alias("code"))
    return e.join(joins.small(book(spark, sf)), "code").select("vec_id", "vec")


@query("j12_cached_records", "SELECT e.event_id, coalesce(d.lang, 'none') AS lang FROM events e LEFT JOIN documents d ON e.user_id = d.doc_id")
def _(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("user_id"), "lang")
    return joins.lookup(table(spark, sf, "events").select("event_id", "user_id"), d, "user_id", {"lang": F.lit("none")}).select("event_id", "lang")
