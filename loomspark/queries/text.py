"""Queries over text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.functions import text as tx
from loomspark.operators import tools
from loomspark.registry import query
from loomspark.runtime import hash32_sql, table


@query("x01_clean_json", "SELECT event_id, props AS json FROM events")
def _(spark, sf):
    raw = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("  ```json\n"), "props", F.lit("\n```  "))).otherwise(F.concat(F.lit(" "), "props", F.lit("\n")))
    return table(spark, sf, "events").select("event_id", tx.clean_json(raw).alias("json"))


@query("x02_without_controls", r"SELECT page_id, md5(regexp_replace(html, '[\x00-\x1f\x7f]', '', 'g')) AS text_md5 FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(tx.without_controls(F.col("html")).cast("binary")).alias("text_md5"))


@query("x03_envelope", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'invalid' WHEN 2 THEN 'empty' ELSE 'error' END AS state FROM events")
def _(spark, sf):
    k = F.col("event_id") % 4
    raw = F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit("{"), "props")).when(k == 2, F.lit("  ")).otherwise(F.concat(F.lit('{"error":'), "props", F.lit("}")))
    return table(spark, sf, "events").select("event_id", tx.envelope(raw).alias("state"))


@query("x04_message_content", "SELECT event_id, CASE WHEN event_id % 3 > 0 THEN event_type END AS content FROM events")
def _(spark, sf):
    said = F.when(F.col("event_id") % 3 > 0, F.col("event_type")).otherwise("  ")
    raw = F.concat(F.lit('{"choices":[{"message":{"content":"'), said, F.lit('"}}]}'))
    return table(spark, sf, "events").select("event_id", tx.message_content(raw).alias("content"))


@query("x05_json_or_wrapped", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN '[' || props || ',' || props || ']' END AS json FROM events")
def _(spark, sf):
    k = F.col("event_id") % 3
    raw = F.when(k == 0, F.col("props")).when(k == 1, F.concat("props", F.lit(","), "props")).otherwise(F.concat("props", F.lit("{")))
    return table(spark, sf, "events").select("event_id", tx.json_or_wrapped(raw).alias("json"))


@query("x06_coerced", """SELECT event_id, v.kind, CASE WHEN v.kind = 'integer' THEN (props->>'k') WHEN v.kind = 'number' THEN (props->>'k') || '.5' WHEN v.kind = 'boolean' THEN CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'maybe' END ELSE event_type END AS value
FROM events, (VALUES ('integer'), ('number'), ('boolean'), ('string')) v(kind)""")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").alias("k"), F.explode(F.array(*map(F.lit, ("integer", "number", "boolean", "string")))).alias("kind"))
    raw = F.when(F.col("kind") == "integer", F.concat("k", F.when(F.col("event_id") % 2 == 0, ".9").otherwise(""))).when(F.col("kind") == "number", F.concat(F.lit(" "), "k", F.lit(".5"))).when(F.col("kind") == "boolean", F.when(F.col("event_id") % 2 == 0, "ON").otherwise("maybe")).otherwise(F.col("event_type"))
    return e.select("event_id", "kind", tools.coerced(raw, F.col("kind")).alias("value"))


@query("x07_last_user_line", "SELECT conv_id, arg_max(trim(replace(text, chr(10), ' ')), turn) AS said FROM conversations WHERE role = 'user' GROUP BY conv_id")
def _(spark, sf):
    line = F.concat(F.initcap("role"), F.lit(": "), F.translate("text", "\n", " "))
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("t"))
    return c.select("conv_id", tx.last_user_line(F.col("t")).alias("said")).filter("said is not null")


@query("x08_names", "SELECT lang, list(DISTINCT trim(source) ORDER BY trim(source)) AS names FROM documents GROUP BY lang")
def _(spark, sf):
    d = table(spark, sf, "documents").groupBy("lang").agg(F.concat(F.collect_set(F.concat(F.lit(" "), "source", F.lit("  "))), F.array(F.lit(" "))).alias("n"))
    return d.select("lang", F.array_sort(tx.names(F.col("n"))).alias("names"))


#: Whole texts between marks that the synthetic tables lack.
MARKED = "'（a²）' || text || '——【b】`' || source"


def marked():
    return F.concat(F.lit("（a²）"), "text", F.lit("——【b】`"), "source")


PLAIN = "replace(replace(replace(replace(replace(replace(replace(replace(%s, '²', '平方'), '³', '立方'), '（', ''), '）', ''), '【', ''), '】', ''), '`', ''), '——', ' ')"


@query("x09_plain_marks", f"SELECT doc_id, md5({PLAIN % MARKED}) AS x FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(tx.plain_marks(marked()).cast("binary")).alias("x"))


#: Groups of three digits, each in words with its scale; texts are put together from what is between the digit runs and these words.
SPELT_SQL = r"""WITH v AS (SELECT string_split('zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen', ' ') AS ones,
 string_split('- - twenty thirty forty fifty sixty seventy eighty ninety', ' ') AS tens, string_split('- thousand million billion trillion quadrillion quintillion', ' ') AS scales),
r AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[0-9]+')) AS d FROM documents),
z AS (SELECT d, ltrim(d, '0') AS z FROM r WHERE length(d) <= 21),
g AS (SELECT d, k, substr(lpad(z, ((length(z) + 2) // 3 * 3)::INT, '0'), ((length(z) + 2) // 3 - 1 - k) * 3 + 1, 3)::INT AS low FROM z, unnest(range(0, (length(z) + 2) // 3)) t(k)),
h AS (SELECT d, k, low, low // 100 AS hundreds, low % 100 AS rest FROM g WHERE low > 0),
w AS (SELECT d, k, low, concat_ws(' and ', CASE WHEN hundreds > 0 THEN ones[hundreds + 1] || ' hundred' END, CASE WHEN rest = 0 THEN NULL WHEN rest < 20 THEN ones[rest + 1] WHEN rest % 10 = 0 THEN tens[rest // 10 + 1] ELSE tens[rest // 10 + 1] || '-' || ones[rest % 10 + 1] END)
 || CASE WHEN k > 0 THEN ' ' || scales[k + 1] ELSE '' END AS word FROM h, v),
n AS (SELECT d, string_agg(CASE WHEN k = top THEN '' WHEN k = 0 AND low < 100 THEN ' and ' ELSE ', ' END || word, '' ORDER BY k DESC) AS words FROM (SELECT *, max(k) OVER (PARTITION BY d) AS top FROM w) GROUP BY d
 UNION ALL SELECT d, 'zero' FROM z WHERE z = ''
 UNION ALL SELECT d, array_to_string(list_transform(string_split(d, ''), lambda c: ones[c::INT + 1]), ' ') FROM r, v WHERE length(d) > 21),
t AS (SELECT doc_id, text, regexp_split_to_array(text, '[0-9]+') AS ps, regexp_extract_all(text, '[0-9]+') AS ds FROM documents),
u AS (SELECT doc_id, i, ps[i] AS p, ds[i] AS d FROM t, unnest(range(1, coalesce(len(ps), 1) + 1)) x(i))
SELECT doc_id, string_agg(p || coalesce(words, ''), '' ORDER BY i) AS spelt FROM u LEFT JOIN n ON u.d = n.d GROUP BY doc_id"""


@query("x10_spelt_numbers", SPELT_SQL)
def _(spark, sf):
    return tx.spelt_numbers(table(spark, sf, "documents").select("doc_id", "text"), "text", "spelt").drop("text")


SPLIT_WORDS = "len(list_filter(string_split(%s, ' '), lambda x: x <> ''))"


@query("x11_split_paragraphs", rf"""WITH RECURSIVE b AS (SELECT item_id, CASE WHEN regexp_matches(right(text, 1), '[.?!;:]') THEN text ELSE text || '.' END AS t FROM benchmark),
q AS (SELECT item_id, list_transform(regexp_extract_all(t, '([^.?!;:]+[.?!;:])["”]?[.?!;:]*'), lambda x: regexp_extract(x, '^[^.?!;:]+[.?!;:]["”]?')) AS ps FROM b),
f AS (SELECT item_id, ps, 0 AS i, []::VARCHAR[] AS done, '' AS cur FROM q
 UNION ALL SELECT item_id, ps, i + 1, CASE WHEN {SPLIT_WORDS % "cur || ps[i + 1]"} > 12 AND {SPLIT_WORDS % "cur"} > 6 THEN list_append(done, cur) ELSE done END,
  CASE WHEN {SPLIT_WORDS % "cur || ps[i + 1]"} > 12 AND {SPLIT_WORDS % "cur"} > 6 THEN ps[i + 1] ELSE cur || ps[i + 1] END FROM f WHERE i < len(ps))
SELECT item_id, CASE WHEN cur = '' THEN done WHEN {SPLIT_WORDS % "cur"} < 4 AND len(done) > 0 THEN list_append(done[1:len(done) - 1], done[len(done)] || cur) ELSE list_append(done, cur) END AS parts FROM f WHERE i = len(ps)""")
def _(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", tx.split_paragraph(F.col("text"), most=12, least=6, tail=4).alias("parts"))


#: Characters, without the spaces that have no printing or control ASCII character on both sides.
UNSPACED = "array_to_string(list_filter(c, lambda x, i: x <> ' ' OR (i > 1 AND i < len(c) AND c[i - 1] <> ' ' AND c[i + 1] <> ' ' AND ord(c[i - 1]) < 128 AND ord(c[i + 1]) < 128)), '')"


@query("x12_without_blanks", f"SELECT doc_id, md5({UNSPACED}) AS x FROM (SELECT doc_id, string_split('漢 字  ' || text || ' 漢 ', '') AS c FROM documents)")
def _(spark, sf):
    x = tx.without_blanks(F.concat(F.lit("漢 字  "), "text", F.lit(" 漢 ")))
    return table(spark, sf, "documents").select("doc_id", F.md5(x.cast("binary")).alias("x"))


@query("x13_normalised")
def _(spark, sf):
    # Pieces of whole texts as they are, of marked-up ones, and by the Chinese rules.
    d = table(spark, sf, "documents")
    raised = F.concat(F.lit("漢 字（²），"), F.translate("text", ".", "。"))
    return d.select("doc_id", tx.normalised(F.col("text")).alias("plain"), tx.normalised(F.concat(F.lit("<|a|> "), "text")).alias("marked"), tx.normalised(raised, zh=True).alias("zh"))


@query("x14_encoded", f"SELECT doc_id, list_transform(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> ''), lambda w: CASE WHEN w = 'the' THEN 50000 ELSE {hash32_sql('w')} % 50000 END) AS ids FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.encoded(F.col("text"), {"the": 50000}).alias("ids"))


@query("x15_language", "SELECT doc_id, lang FROM documents")
def _(spark, sf):
    name = F.when(F.col("lang") == "en", "English").when(F.col("lang") == "de", "GERMAN").when(F.col("lang") == "es", "castilian").otherwise(F.col("lang"))
    return table(spark, sf, "documents").select("doc_id", tx.language(name).alias("lang"))


@query("x16_compressed", r"""WITH w AS (SELECT item_id, i, ws[i] AS word FROM (SELECT item_id, list_filter(regexp_split_to_array(text, '[ \t\n\r\f\v]+'), lambda x: x <> '') AS ws FROM benchmark), unnest(range(1, len(ws) + 1)) t(i)),
d AS (SELECT word, count(DISTINCT item_id) AS df FROM w GROUP BY word),
r AS (SELECT item_id, i, word, row_number() OVER (PARTITION BY item_id ORDER BY df, i) AS r, count(*) OVER (PARTITION BY item_id) AS n FROM w JOIN d USING (word))
SELECT item_id, string_agg(word, ' ' ORDER BY i) AS compressed FROM r WHERE r <= ceil(n * 0.6) GROUP BY item_id""")
def _(spark, sf):
    return tx.compressed(table(spark, sf, "benchmark"), "item_id", "text", 0.6).select("item_id", "compressed")
