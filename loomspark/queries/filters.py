"""Queries over projections, filters and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomspark.functions import text
from loomspark.operators import filters, tools
from loomspark.registry import query
from loomspark.runtime import hash32, hash32_sql, table

WORDS_SQL = "len(regexp_extract_all(text, '[^ \\t\\n]+'))"


def n_words(text="text"):
    return F.size(F.regexp_extract_all(F.col(text), F.lit(r"[^ \t\n]+"), F.lit(0)))


@query("p01_drop_add", "SELECT doc_id, lang, n_chars * 2 AS n_twice FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").withColumn("n_twice", F.col("n_chars") * 2).drop("text", "source", "n_chars")


def _qa(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("question"), F.reverse("text").alias("solution"))
    for part in ("question", "solution"):
        for rate in (0.7, 0.5):
            b = text.compressed(b, "item_id", part, rate, f"{part}_compress_{rate}")
    stage = F.element_at(F.array(F.lit("question"), F.lit("solution"), F.lit("answer"), F.lit("question_solution")), (F.col("item_id") % 5).cast("int"))
    return b.select(
        "*", F.when(F.col("item_id") % 5 > 0, stage).alias("stage"), F.when(F.col("item_id") % 3 == 0, 1.0).when(F.col("item_id") % 3 == 1, 0.7).otherwise(0.5).alias("rate"),
        F.concat("question", F.lit("!")).alias("answer"),
    )


def _choice_sql(both):
    def short(part, expr):
        return f"""{part}_w AS (SELECT item_id, i, ws[i] AS word, rate FROM (SELECT item_id, rate, list_filter(regexp_split_to_array({expr}, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') AS ws FROM q), unnest(range(1, len(ws) + 1)) t(i)),
    {part}_d AS (SELECT word, count(DISTINCT item_id) AS df FROM {part}_w GROUP BY word),
    {part}_r AS (SELECT item_id, i, word, rate, row_number() OVER (PARTITION BY item_id ORDER BY df, i) AS r, count(*) OVER (PARTITION BY item_id) AS n FROM {part}_w JOIN {part}_d USING (word)),
    {part}_s AS (SELECT item_id, string_agg(word, ' ' ORDER BY i) AS {part}_short FROM {part}_r WHERE r <= ceil(n * rate) GROUP BY item_id)"""

    def part(p, expr, hit):
        return f"CASE WHEN stage IN ({hit}) AND rate < 1 THEN coalesce({p}_short, '') ELSE {expr} END AS {p}"

    return f"""WITH q AS (SELECT item_id, text, CASE item_id % 5 WHEN 1 THEN 'question' WHEN 2 THEN 'solution' WHEN 3 THEN 'answer' WHEN 4 THEN {"'question_solution'" if both else "'answer'"} END AS stage,
      CASE item_id % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS rate FROM benchmark),
    {short("question", "text")}, {short("solution", "reverse(text)")}
    SELECT item_id, {part("question", "text", "'question'" + (", 'question_solution'" if both else ""))},
      {part("solution", "reverse(text)", "'solution'" + (", 'question_solution'" if both else ""))}, text || '!' AS answer FROM q LEFT JOIN question_s USING (item_id) LEFT JOIN solution_s USING (item_id)"""


@query("p02_compression_choice", _choice_sql(True))
def _(spark, sf):
    q = _qa(spark, sf)
    return q.select("item_id", *[filters.compression_choice(q, F.col("stage"), F.col("rate"), p).alias(p) for p in ("question", "solution", "answer")])


@query("p03_compression_choice_interleaved", _choice_sql(False))
def _(spark, sf):
    q = _qa(spark, sf).withColumn("stage", F.when(F.col("stage") == "question_solution", "answer").otherwise(F.col("stage")))
    return q.select("item_id", *[filters.compression_choice(q, F.col("stage"), F.col("rate"), p, with_both=False).alias(p) for p in ("question", "solution", "answer")])


def _examples(spark, sf):
    e = table(spark, sf, "events")
    call = lambda i: F.struct(F.concat(F.col("event_type"), F.lit(f"_{i}")).alias("function"), F.lit(f"call {i}").alias("description"), F.col("props").alias("parameters"))
    many = F.col("event_id") % 4
    none = F.lit(None).cast(tools.CALLS)
    calls = F.when(many == 0, none).when(many == 1, F.array(call(0))).when(many == 2, F.array(call(0), call(1))).otherwise(F.array().cast(tools.CALLS))
    return e.select(F.col("event_id"), F.concat(F.lit("q"), F.col("event_id").cast("string")).alias("question"), calls.alias("function_calls"), F.col("event_type").alias("function"), F.lit("flat").alias("description"), F.col("props").alias("parameters"))


@query("p04_single_calls", """SELECT 'q' || event_id AS question, CASE event_id % 4 WHEN 0 THEN event_type ELSE event_type || '_0' END AS function,
  CASE event_id % 4 WHEN 0 THEN 'flat' ELSE 'call 0' END AS description, props AS parameters FROM events WHERE event_id % 4 IN (0, 1)""")
def _(spark, sf):
    return tools.single_calls(_examples(spark, sf))


SPEC_SQL = """'{"name":"' || event_type || '","description":"about ' || event_type || '","parameters":{"type":"object","properties":' || %s || ',"required":[' || %s || ']}}'"""


@query("p05_tool_spec", "SELECT event_id, " + SPEC_SQL % ("CASE WHEN event_id % 2 = 0 THEN props ELSE '{}' END", "CASE WHEN event_id % 3 = 0 THEN '\"k\",\"v\"' ELSE '' END") + " AS spec FROM events")
def _(spark, sf):
    e = table(spark, sf, "events")
    required = F.when(F.col("event_id") % 3 == 0, F.array(F.lit("k"), F.lit("v")))
    spec = tools.tool_spec(F.col("event_type"), F.concat(F.lit("about "), "event_type"), F.when(F.col("event_id") % 2 == 0, F.col("props")), required)
    return e.select("event_id", spec.alias("spec"))


INSTRUCTION_SQL = "'" + f"{tools.INTRO}\n\n{tools.SIGNATURES}\n<tools>\n".replace("'", "''") + "' || tools || '" + f"\n</tools>\n\n{tools.FORMAT}\n\n".replace("'", "''") + "'"


@query("p06_rendered_rows", f"""SELECT event_id, {INSTRUCTION_SQL} || CASE WHEN event_id % 4 = 2 THEN '{tools.MULTI}' ELSE '{tools.SINGLE}' END || 'q' || event_id AS instruction, '' AS input,
  '<tool_call>' || chr(10) || '{{"name": "' || event_type || '_0", "arguments": ' || props || '}}' || chr(10) || '</tool_call>' ||
  CASE WHEN event_id % 4 = 2 THEN chr(10) || '<tool_call>' || chr(10) || '{{"name": "' || event_type || '_1", "arguments": ' || props || '}}' || chr(10) || '</tool_call>' ELSE '' END AS output
FROM (SELECT *, '{{"name": "' || event_type || '"}}' AS tools FROM events WHERE event_id % 4 IN (1, 2))""")
def _(spark, sf):
    e = _examples(spark, sf).filter(F.size("function_calls") > 0)
    listed = F.array(F.concat(F.lit('{"name": "'), "function", F.lit('"}')))
    many = F.size("function_calls") > 1
    text = F.when(many, tools.instruction(listed, F.col("question"), tools.MULTI)).otherwise(tools.instruction(listed, F.col("question"), tools.SINGLE))
    return e.select("event_id", text.alias("instruction"), F.lit("").alias("input"), tools.call_blocks(F.col("function_calls")).alias("output"))


TEMPLATES = [(f"mode{m}", a, f"[{m}] Ask one question that needs {'the tool' if a == 'single' else 'the tools'}: {{tool}}") for m in (1, 2, 3, 4) for a in ("single", "multiple")]


@query("p07_prompt_templates", """SELECT event_id, arity, mode, event_type AS tool, '[' || CASE WHEN mode = 'mode9' THEN '1' ELSE substr(mode, 5) END || '] Ask one question that needs ' || CASE arity WHEN 'single' THEN 'the tool' ELSE 'the tools' END || ': ' || event_type AS prompt
FROM (SELECT event_id, event_type, CASE event_id % 5 WHEN 0 THEN 'mode9' ELSE 'mode' || (event_id % 5) END AS mode, CASE event_id % 2 WHEN 0 THEN 'single' ELSE 'multiple' END AS arity FROM events)""")
def _(spark, sf):
    t = spark.createDataFrame(TEMPLATES, "mode string, arity string, template string")
    mode = F.when(F.col("event_id") % 5 == 0, "mode9").otherwise(F.concat(F.lit("mode"), (F.col("event_id") % 5).cast("string")))
    r = table(spark, sf, "events").select("event_id", mode.alias("mode"), F.when(F.col("event_id") % 2 == 0, "single").otherwise("multiple").alias("arity"), F.col("event_type").alias("tool"))
    return tools.filled_template(t, r)


@query("p08_embedding_choice", "SELECT vec_id, CASE WHEN label % 2 = 0 THEN embedding[1:32] ELSE embedding[33:64] END AS embedding FROM embeddings")
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", F.when(F.col("label") % 2 == 0, F.slice("embedding", 1, 32)).otherwise(F.slice("embedding", 33, 32)).alias("embedding"))


@query("p10_tool_lines", "SELECT lang, string_agg('{\"name\":\"' || source || '\",\"n\":' || n || '}', chr(10) ORDER BY source) AS tools FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source) GROUP BY lang")
def _(spark, sf):
    n = table(spark, sf, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    lines = F.array_sort(F.collect_list(F.struct("source", F.to_json(F.struct(F.col("source").alias("name"), "n")).alias("json"))))
    return n.groupBy("lang").agg(F.array_join(F.transform(lines, lambda x: x["json"]), "\n").alias("tools"))


@query("p11_extraction_prompt", """SELECT event_id, 'Question: ' || event_type || chr(10) || CASE WHEN event_id % 2 = 0 THEN 'Tool: a' || chr(10) || 'Required: k' || chr(10) || 'Allowed: x, y'
 ELSE 'Tool 1: a' || chr(10) || 'Required: k' || chr(10) || 'Allowed: x, y' || chr(10) || 'Tool 2: b' || chr(10) || 'Required: ' || chr(10) || 'Allowed: z' END AS prompt FROM events""")
def _(spark, sf):
    strings = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    two = F.col("event_id") % 2 == 1
    cut = lambda a: F.when(two, a).otherwise(F.slice(a, 1, 1))
    prompt = tools.extraction_prompt(F.col("event_type"), cut(strings("a", "b")), cut(F.array(strings("k"), strings())), cut(F.array(strings("x", "y"), strings("z"))))
    return table(spark, sf, "events").select("event_id", prompt.alias("prompt"))


@query("p12_accepted_parameters", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE (props->>'k') END AS k, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END AS flag, NULL::VARCHAR AS other FROM events""")
def _(spark, sf):
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    flag = F.when(F.col("event_id") % 2 == 0, "Yes").otherwise("off")
    found = F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("flag"), flag)).otherwise(F.create_map(F.lit("k"), k, F.lit("flag"), flag, F.lit("other"), F.lit("x")))
    kinds = F.create_map(F.lit("k"), F.lit("integer"), F.lit("flag"), F.lit("boolean"))
    got = e.select("event_id", tools.accepted_parameters(found, kinds, F.array(F.lit("k")), F.array(F.lit("flag"))).alias("p"))
    return got.select("event_id", *[F.try_element_at("p", F.lit(c)).alias(c) for c in ("k", "flag", "other")])


@query("p13_gather", "SELECT vec_id, list_transform([1, 5, 64], lambda i: embedding[i]) AS picked FROM embeddings")
def _(spark, sf):
    pos = F.array(F.lit(0), F.lit(4), F.lit(63))
    return table(spark, sf, "embeddings").select("vec_id", F.transform(pos, lambda p: F.get("embedding", p)).alias("picked"))


@query("f01_length_filter", f"""SELECT doc_id, n_chars, w AS n_words FROM (SELECT doc_id, n_chars, {WORDS_SQL} AS w FROM documents)
WHERE n_chars BETWEEN 10 AND 10240 AND w BETWEEN 1 AND 200 AND (n_chars = 0 OR w / n_chars BETWEEN 0.0005 AND 1)""")
def _(spark, sf):
    d = table(spark, sf, "documents").filter(F.col("n_chars").between(filters.MIN_FRAMES, filters.MAX_FRAMES)).select("doc_id", "n_chars", n_words().cast("long").alias("n_words"))
    return filters.length_filter(d, F.col("n_chars"), F.col("n_words"))


@query("f02_usable_rate", "SELECT event_id FROM events WHERE user_id * 100 = 2200 OR user_id * 100 >= 8000")
def _(spark, sf):
    return table(spark, sf, "events").filter(filters.usable_rate(F.col("user_id") * 100, 2200, 8000)).select("event_id")


@query("f03_not_blank", "SELECT doc_id, i FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents) WHERE trim(line) <> ''")
def _(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return lines.filter(filters.not_blank(F.col("line"))).select("doc_id", F.col("i").cast("long").alias("i"))


@query("f04_text_phase", "SELECT event_id FROM events WHERE coalesce(CASE WHEN event_type = 'click' THEN NULL WHEN event_type = 'view' THEN 'text' ELSE event_type END, 'text') = 'text' AND user_id - 20 >= 0")
def _(spark, sf):
    phase = F.when(F.col("event_type") == "click", None).when(F.col("event_type") == "view", "text").otherwise(F.col("event_type"))
    return table(spark, sf, "events").filter(filters.text_phase(phase, F.col("user_id") - 20)).select("event_id")


@query("f05_leading_bos", "SELECT conv_id, CASE WHEN ids[1] IN (0, 1, 2) THEN ids[2:] ELSE ids END AS ids FROM (SELECT conv_id, list(length(text) % 5 ORDER BY turn) AS ids FROM conversations GROUP BY conv_id)")
def _(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", (F.length("text") % 5).cast("long").alias("x")))).alias("s"))
    return c.select("conv_id", filters.without_leading_bos(F.transform("s", lambda x: x["x"])).alias("ids"))


@query("f06_valid_calls", "SELECT event_id, event_id % 4 IN (1, 2) AND (props->>'k')::INT % 2 = 0 AS ok FROM events")
def _(spark, sf):
    one = F.struct(F.when(F.get_json_object("props", "$.k").cast("int") % 2 == 0, F.create_map(F.lit("k"), F.lit("1"))).otherwise(F.from_json(F.lit("{}"), "map<string,string>")).alias("parameters"))
    many = F.col("event_id") % 4
    calls = F.when(many == 1, F.array(one)).when(many == 2, F.array(one, one)).when(many == 3, F.slice(F.array(one), 1, 0))
    return table(spark, sf, "events").select("event_id", filters.valid_calls(calls).alias("ok"))


@query("f07_only_marks", r"SELECT word, regexp_full_match(word, '[\p{P}\p{S}]*') AS marks FROM (SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM documents)")
def _(spark, sf):
    words = table(spark, sf, "documents").select(F.explode(F.split("text", " ")).alias("word")).distinct()
    return words.select("word", filters.only_marks(F.col("word")).alias("marks"))


@query("f08_has_chinese", "SELECT doc_id, doc_id % 3 = 0 OR regexp_matches(text, '[一-鿿]') AS zh FROM documents")
def _(spark, sf):
    text = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("漢"))).otherwise(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", filters.has_chinese(text).alias("zh"))


@query("f09_ignored_labels", "SELECT event_id, CASE WHEN user_id - 30 < 0 THEN -100 ELSE user_id - 30 END AS label FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", filters.ignored(F.col("user_id") - 30).alias("label"))


@query("f10_skipped_nan", "SELECT event_type, count(*) FILTER (user_id % 7 = 0) AS skipped, round(avg(value) FILTER (user_id % 7 <> 0), 6) AS mean FROM events GROUP BY event_type")
def _(spark, sf):
    v = F.when(F.col("user_id") % 7 == 0, float("nan")).otherwise(F.col("value"))
    e = table(spark, sf, "events").select("event_type", v.alias("v"))
    return e.groupBy("event_type").agg(F.count_if(F.isnan("v")).alias("skipped"), F.round(F.avg(F.when(~F.isnan("v"), F.col("v"))), 6).alias("mean"))


@query("f11_valid_codes", "SELECT vec_id, label - 3 AS code FROM embeddings WHERE label - 3 >= 0")
def _(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", (F.col("label") - 3).alias("code")).filter("code >= 0")


@query("f12_missing_parameters", "SELECT event_id, list_concat(['z'], CASE WHEN event_id % 2 = 0 THEN ['k'] ELSE [] END) AS missing FROM events")
def _(spark, sf):
    have = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("a"), F.lit(1))).otherwise(F.create_map(F.lit("k"), F.lit(1)))
    return table(spark, sf, "events").select("event_id", filters.missing_parameters(F.array(F.lit("z"), F.lit("k")), have).alias("missing"))


@query("f13_length_bounds", "SELECT event_id FROM events WHERE event_id % 300 BETWEEN 2 * user_id AND 20 * user_id")
def _(spark, sf):
    return table(spark, sf, "events").filter(filters.length_in_bounds(F.col("event_id") % 300, F.col("user_id"))).select("event_id")


@query("f14_voicing", "SELECT event_id, CASE WHEN p >= 0.21 THEN p END AS voiced FROM (SELECT event_id, CASE WHEN -user_id < -60 THEN 0.0 ELSE (event_id % 100) / 100.0::DOUBLE END AS p FROM events)")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", filters.voicing((F.col("event_id") % 100) / 100, -F.col("user_id")).alias("voiced"))


@query("u01_concatenated_sources", "SELECT 'documents' AS source_set, doc_id AS id, length(text) AS size FROM documents UNION ALL SELECT 'benchmark', item_id, length(text) FROM benchmark UNION ALL SELECT 'conversations', conv_id, length(text) FROM conversations")
def _(spark, sf):
    parts = [table(spark, sf, n).select(F.lit(n).alias("source_set"), F.col(k).alias("id"), F.length("text").cast("long").alias("size")) for n, k in (("documents", "doc_id"), ("benchmark", "item_id"), ("conversations", "conv_id"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("u02_common_keys", "SELECT doc_id AS key FROM documents INTERSECT SELECT doc_id FROM labels INTERSECT SELECT conv_id FROM conversations")
def _(spark, sf):
    a, b, c = (table(spark, sf, t).select(F.col(k).alias("key")) for t, k in (("documents", "doc_id"), ("labels", "doc_id"), ("conversations", "conv_id")))
    return a.intersect(b).intersect(c)


@query("u03_first_by_name", "SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source")
def _(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.min_by("doc_id", "doc_id").alias("doc_id"))


@query("u04_first_and_last_wins", "SELECT user_id, arg_min(event_type, event_id) AS first_type, arg_max(event_type, event_id) AS last_type FROM events GROUP BY user_id")
def _(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("first_type"), F.max_by("event_type", "event_id").alias("last_type"))


@query("u05_optional_names", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN ['b', 'c'] ELSE ['a', 'b', 'c'] END AS optional FROM events")
def _(spark, sf):
    props = F.create_map(*[F.lit(x) for x in ("a", 1, "b", 2, "c", 3)])
    return table(spark, sf, "events").select("event_id", tools.optional_names(props, F.when(F.col("event_id") % 2 == 0, F.array(F.lit("a")))).alias("optional"))


@query("u06_chosen_and_rejected", "SELECT event_id AS id, value AS v, TRUE AS chosen FROM events UNION ALL SELECT event_id, -value, FALSE FROM events")
def _(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.col("event_id").alias("id"), F.col("value").alias("v"), F.lit(True).alias("chosen")).unionByName(e.select(F.col("event_id").alias("id"), (-F.col("value")).alias("v"), F.lit(False).alias("chosen")))
