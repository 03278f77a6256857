"""Tool-call training rows: a file of examples and a pool of tools become instructions and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.operators import tools


def convert(examples: DataFrame, pool: DataFrame, picks: DataFrame, total: int, order: Column) -> DataFrame:
    """(request, instruction, input, output) of examples (request, question, function_calls).

    If any example has several calls, all are rendered in the form for several, and those without calls go; otherwise only those with
    one call stay. Each sees its own tools first and then distractors; pool: (name, spec); picks: see tools.distractors.
    """
    many = bool(examples.agg(F.bool_or(F.size("function_calls") > 1)).first()[0])
    kept = examples.filter(F.size("function_calls") > 0) if many else examples.filter(F.size("function_calls") == 1)
    used = F.array_distinct(F.transform("function_calls", lambda c: F.trim(c["function"])))
    kept = kept.withColumn("focus", used)
    calls = kept.select("request", F.posexplode("focus").alias("at", "function"), F.col("function_calls")[0]["description"].alias("description"))
    own = tools.with_definitions(calls, pool).select("request", F.lit(0).alias("kind"), F.col("at").cast("long").alias("at"), F.col("definition"))
    extra = tools.distractors(kept.select("request", "focus"), pool.select("name"), picks, total, order)
    extra = extra.join(pool, "name").select("request", F.lit(1).alias("kind"), F.col("rank").cast("long").alias("at"), F.col("spec").alias("definition"))
    listed = own.unionByName(extra).groupBy("request").agg(F.transform(F.array_sort(F.collect_list(F.struct("kind", "at", "definition"))), lambda x: x["definition"]).alias("tools"))
    text = tools.instruction(F.col("tools"), F.col("question"), tools.MULTI if many else tools.SINGLE)
    return kept.join(listed, "request").select("request", text.alias("instruction"), F.lit("").alias("input"), tools.call_blocks(F.col("function_calls")).alias("output"))
