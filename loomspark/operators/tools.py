"""Tool schemas, calls and their training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.operators.joins import small

CALLS = "array<struct<function:string,description:string,parameters:string>>"
#: The frame around tool definitions in an instruction.
INTRO = "You may call one or more functions to assist with the user query."
SIGNATURES = "You are provided with function signatures within <tools></tools> XML tags:"
FORMAT = 'For each function call, return a json object with function name and arguments within <tool_call></tool_call> XML tags:\n<tool_call>\n{"name": <function-name>, "arguments": <args-json-object>}\n</tool_call>'
SINGLE, MULTI = "User:\n", "User question:\n"


def single_calls(df: DataFrame) -> DataFrame:
    """(question, function, description, parameters) of rows with a one-call list or flat columns; other rows go.

    df: question, function_calls (array or null), function, description, parameters.
    """
    one = (F.size("function_calls") == 1) & F.col("function_calls").isNotNull()
    flat = F.col("function_calls").isNull() & F.col("function").isNotNull()
    pick = lambda n: F.when(one, F.get("function_calls", F.lit(0))[n]).otherwise(F.col(n)).alias(n)
    return df.filter(one | flat).select("question", pick("function"), pick("description"), pick("parameters"))


def tool_spec(name: Column, description: Column, properties: Column, required: Column, kind: Column | None = None) -> Column:
    """A tool as JSON, with defaults for what its schema leaves out. properties: JSON text."""
    kind = F.coalesce(kind, F.lit("object")) if kind is not None else F.lit("object")
    quoted = lambda c: F.concat(F.lit('"'), F.coalesce(c, F.lit("")), F.lit('"'))
    listed = F.concat(F.lit("["), F.array_join(F.transform(F.coalesce(required, F.array().cast("array<string>")), lambda r: F.concat(F.lit('"'), r, F.lit('"'))), ","), F.lit("]"))
    return F.concat(F.lit('{"name":'), quoted(name), F.lit(',"description":'), quoted(description), F.lit(',"parameters":{"type":"'), kind, F.lit('","properties":'), F.coalesce(properties, F.lit("{}")), F.lit(',"required":'), listed, F.lit("}}"))


def instruction(tools: Column, question: Column, user: str = SINGLE) -> Column:
    """The instruction text of a question; tools: JSON texts."""
    return F.concat(F.lit(f"{INTRO}\n\n{SIGNATURES}\n<tools>\n"), F.array_join(tools, "\n"), F.lit(f"\n</tools>\n\n{FORMAT}\n\n{user}"), question)


def call_block(function: Column, parameters: Column) -> Column:
    """One call as the answer spells it; parameters: JSON text."""
    return F.concat(F.lit('<tool_call>\n{"name": "'), function, F.lit('", "arguments": '), F.coalesce(parameters, F.lit("{}")), F.lit("}\n</tool_call>"))


def call_blocks(calls: Column) -> Column:
    return F.array_join(F.transform(calls, lambda c: call_block(c["function"], c["parameters"])), "\n")


def with_definitions(calls: DataFrame, pool: DataFrame, name: str = "function") -> DataFrame:
    """calls with the pool's definition of each name, or a default one. pool: (name, spec), one row per name."""
    default = tool_spec(F.col(name), F.col("description"), F.lit(None).cast("string"), F.lit(None).cast("array<string>"))
    p = pool.select(F.col("name").alias("_name"), "spec")
    return calls.join(p, F.col(name) == F.col("_name"), "left").withColumn("definition", F.coalesce("spec", default)).drop("_name", "spec")


def optional_names(properties: Column, required: Column) -> Column:
    return F.array_except(F.map_keys(properties), F.coalesce(required, F.array().cast("array<string>")))


def coerced(value: Column, kind: Column) -> Column:
    """A value's text as its schema type wants it; what can't be read so stays as it is."""
    low = F.lower(F.trim(value))
    number = value.cast("string")
    whole = F.when(low.isin("true"), "1").when(low.isin("false"), "0").when(value.rlike(r"^-?[0-9]+$"), number).when(value.rlike(r"^-?[0-9]+\.[0-9]+$"), F.regexp_replace(value, r"\..*$", ""))
    real = F.when(value.rlike(r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"), F.trim(value))
    truth = F.when(low.isin("true", "yes", "1", "on"), "true").when(low.isin("false", "no", "0", "off"), "false")
    return (
        F.when(kind.isin("integer", "int"), F.coalesce(whole, value))
        .when(kind.isin("number", "float", "double"), F.coalesce(real, value))
        .when(kind.isin("boolean", "bool"), F.coalesce(truth, value))
        .otherwise(value)
    )


def accepted_parameters(found: Column, kinds: Column, required: Column, allowed: Column) -> Column:
    """Parameters (map of texts) that are required or allowed, coerced by their kinds; null if a required one is missing."""
    kept = F.map_filter(found, lambda k, v: F.array_contains(F.array_union(required, allowed), k))
    out = F.transform_values(kept, lambda k, v: coerced(v, F.element_at(kinds, k)))
    return F.when(F.size(F.array_except(required, F.map_keys(found))) == 0, out)


def extraction_prompt(question: Column, tools: Column, required: Column, allowed: Column) -> Column:
    """What to ask for the parameters of one tool, or of several by number. tools, required and allowed: arrays of equal length."""
    parts = F.transform(F.arrays_zip(tools.alias("t"), required.alias("r"), allowed.alias("a")), lambda x, i: F.concat(F.when(F.size(tools) > 1, F.concat(F.lit("Tool "), (i + 1).cast("string"), F.lit(": "))).otherwise(F.lit("Tool: ")), x["t"], F.lit("\nRequired: "), F.array_join(x["r"], ", "), F.lit("\nAllowed: "), F.array_join(x["a"], ", ")))
    return F.concat(F.lit("Question: "), question, F.lit("\n"), F.array_join(parts, "\n"))


def filled_template(templates: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (mode, arity, tool) with the prompt of their mode and arity; an unknown mode gets mode1's. templates: (mode, arity, template)."""
    t = small(templates)
    known = templates.select("mode").distinct().withColumn("_known", F.lit(True))
    r = requests.join(small(known), "mode", "left").withColumn("_mode", F.when(F.col("_known"), F.col("mode")).otherwise("mode1"))
    t = t.withColumnRenamed("mode", "_mode")
    return r.join(t, ["_mode", "arity"]).withColumn("prompt", F.replace("template", F.lit("{tool}"), F.col("tool"))).drop("_mode", "_known", "template")


def distractors(requests: DataFrame, pool: DataFrame, picks: DataFrame, total: int, order: Column) -> DataFrame:
    """(request, place, name): up to `total` tool names for each request.

    Picked names of the pool come first, less related before related, each once and never a focus
    name; other names of the pool follow in the given order. picks: (request, kind 0 or 1, place, name);
    requests: (request, focus array); pool: (name). Only as many other names as can be needed are looked at.
    """
    from pyspark.sql import Window

    valid = picks.withColumn("name", F.trim("name")).join(small(pool), "name").join(requests, "request").filter(~F.array_contains("focus", F.col("name")))
    valid = valid.groupBy("request", "name").agg(F.min(F.struct("kind", "place")).alias("at")).select("request", "name", F.col("at.kind").alias("kind"), F.col("at.place").cast("long").alias("place"))
    width = requests.agg(F.max(F.size("focus"))).first()[0] or 0
    spare = pool.withColumn("place", order).orderBy("place", "name").limit(2 * total + width)
    seen = valid.groupBy("request").agg(F.collect_set("name").alias("seen"))
    rest = requests.join(seen, "request", "left").select("request", "focus", "seen", F.lit(0).alias("one"))
    rest = rest.join(F.broadcast(spare.agg(F.collect_list(F.struct("name", "place")).alias("spare")).withColumn("one", F.lit(0))), "one")
    rest = rest.select("request", "focus", "seen", F.explode("spare").alias("s")).filter(~F.array_contains("focus", F.col("s.name")) & ~F.coalesce(F.array_contains("seen", F.col("s.name")), F.lit(False)))
    every = valid.select("request", "name", "kind", "place").unionByName(rest.select("request", F.col("s.name").alias("name"), F.lit(2).alias("kind"), F.col("s.place").cast("long").alias("place")))
    rank = F.row_number().over(Window.partitionBy("request").orderBy("kind", "place", "name"))
    return every.withColumn("rank", rank).filter(F.col("rank") <= total).select("request", "rank", "name")
