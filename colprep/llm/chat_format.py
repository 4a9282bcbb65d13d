"""Chat formatting with tool-call linking, DataFrame functions only.

Calls and their results meet in a hash join by conversation and identifier. A call may name calls whose results it
needs; calls are ordered by level: 0 without such calls, else one more than the highest level it needs. Chains of
calls with one need are contracted by pointer doubling; calls with several needs are settled in rounds of joins. Arguments are checked against the tools' parameter lists (missing, unknown, or of
another type). Every message, call and result becomes one line of canonical JSON: sorted keys, no blanks, null
fields left out, numbers as the variant type writes them. (level, turn) orders the lines of a conversation, so no
conversation has to be gathered in one task.

Identifiers that several rows share are one call: links are made on aggregates, so repeated rows never multiply.

Cases: calls that need a call that does not exist ignore it and report ``dangling``; calls in a cycle, or behind one,
have a null level and report ``cycle``; arguments that are null or no JSON object report ``arguments``; a name that
no tool has reports ``tool``; results without their call report ``orphan``; calls without result report
``unanswered``; null texts become empty strings; null identifiers never link; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colprep.llm.common import written
from colprep.session import scratch_dir

LINE = ["conv_id", "turn", "kind", "call_id", "level", "errors", "json"]
# JSON schema types and the variant types that satisfy them.
TYPES = {
    "string": "STRING", "integer": "(TINYINT|SMALLINT|INT|BIGINT)", "number": r"(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL\(.*)", "boolean": "BOOLEAN", "array": "ARRAY.*", "object": "OBJECT.*",
}


@dataclass(frozen=True)
class Tool:
    """A tool and its parameters: name -> (type, required)."""

    name: str
    parameters: dict[str, tuple[str, bool]]


def argument_errors(name: Column, arguments: Column, tools: list[Tool]) -> Column:
    """Sorted array of what is wrong with the arguments of a call."""
    parsed = F.try_parse_json(arguments)
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    keys = F.json_object_keys(arguments)
    out = F.array(F.lit("tool"))
    for tool in tools:
        checks = []
        for key, (kind, required) in sorted(tool.parameters.items()):
            value = F.schema_of_variant(F.try_variant_get(parsed, f"$.{key}", "variant"))
            present = F.coalesce(F.array_contains(keys, key), F.lit(False))
            if required:
                checks.append(F.when(~present, F.lit(f"missing:{key}")))
            checks.append(F.when(present & ~F.coalesce(value.rlike(f"^{TYPES[kind]}$"), F.lit(False)), F.lit(f"type:{key}")))
        unknown = F.transform(F.array_except(F.coalesce(keys, F.array().cast("array<string>")), F.array(*[F.lit(k) for k in sorted(tool.parameters)]).cast("array<string>")), lambda k: F.concat(F.lit("unknown:"), k))
        found = F.array_sort(F.concat(F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>"), unknown))
        out = F.when(name == tool.name, F.when(is_object, found).otherwise(F.array(F.lit("arguments")))).otherwise(out)
    return out


def chain_ends(nodes: DataFrame) -> DataFrame:
    """Pointer doubling along calls with one need: (conv_id, call_id, end, dist, done).

    ``nodes``: conv_id, call_id, wanted (needs, null for none), need (one of them). The end is the first call on the
    way that needs none or several, ``dist`` steps away. A round doubles the steps, so a chain of n calls takes log n
    rounds of the same plan. Calls that never get to an end, in a cycle or behind one, are not done: every round
    settles some call of each chain that has an end, so a round that settles none is the last.
    """
    one = F.col("wanted") == 1
    steps = written(nodes.select(
        "conv_id", "call_id", F.when(one, F.col("need")).otherwise(F.col("call_id")).alias("end"), F.when(one, 1).otherwise(0).alias("dist"), F.coalesce(~one, F.lit(True)).alias("done"),
    ), "steps")
    open_, before = steps.where(~F.col("done")).count(), None
    while open_ and open_ != before:
        onward = steps.select("conv_id", F.col("call_id").alias("end"), F.col("end").alias("next"), F.col("dist").alias("more"), F.col("done").alias("settled"))
        moved = steps.where(~F.col("done")).join(onward, ["conv_id", "end"]).select("conv_id", "call_id", F.col("next").alias("end"), (F.col("dist") + F.col("more")).alias("dist"), F.col("settled").alias("done"))
        steps = written(steps.where("done").unionAll(moved), "steps")
        open_, before = steps.where(~F.col("done")).count(), open_
    return steps


def merge_levels(edges: DataFrame) -> DataFrame:
    """Levels of calls with several needs, by rounds over the newest ones alone.

    ``edges``: conv_id, call_id, end, dist (steps from the call to the end), kind of end: ``root`` needs nothing,
    ``merge`` has several needs itself, ``cycle`` never settles. A call holds the number of needs that are not settled
    and the highest level so far; a round joins the edges with the calls settled last.
    """
    spark = edges.sparkSession
    key = ["conv_id", "call_id"]
    waiting = written(edges.groupBy(*key).agg(F.count_if(F.col("kind") != "root").alias("open"), F.max(F.when(F.col("kind") == "root", F.col("dist"))).alias("top")), "waiting")
    between = written(edges.where("kind = 'merge'").select(*key, "end", "dist"), "between")
    path = scratch_dir(spark, "merge-levels")
    schema = waiting.select(*key, F.col("top").alias("level")).schema
    spark.createDataFrame([], schema).write.parquet(path)
    while True:
        newest = written(waiting.where("open = 0").select(*key, F.col("top").alias("level")), "newest")
        if newest.isEmpty():
            return spark.read.schema(schema).parquet(path)
        newest.write.mode("append").parquet(path)
        came = between.join(newest.withColumnRenamed("call_id", "end"), ["conv_id", "end"]).groupBy(*key).agg(F.count(F.lit(1)).alias("came"), F.max(F.col("level") + F.col("dist")).alias("high"))
        waiting = written(waiting.where("open > 0").join(came, key, "left").select(
            *key, (F.col("open") - F.coalesce("came", F.lit(0))).alias("open"), F.greatest("top", "high").alias("top"),
        ), "waiting")


def call_levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level, dangling) of distinct calls (conv_id, call_id, after array<string>).

    Chains are contracted to their ends first; only calls with several needs go through rounds level by level.
    """
    key = ["conv_id", "call_id"]
    needs = calls.select(*key, F.explode("after").alias("need")).where("need IS NOT NULL").distinct()
    known = calls.select("conv_id", F.col("call_id").alias("need")).distinct()
    marked = needs.join(known.withColumn("known", F.lit(True)), ["conv_id", "need"], "left")
    dangling = marked.where("known IS NULL").select(*key).distinct().withColumn("dangling", F.lit(True))
    needs = written(marked.where("known").drop("known"), "needs")
    counts = needs.groupBy(*key).agg(F.count(F.lit(1)).alias("wanted"), F.min("need").alias("need"))
    nodes = written(calls.select(*key).distinct().join(counts, key, "left"), "nodes")
    ends = chain_ends(nodes)
    merges = nodes.where("wanted > 1").select("conv_id", "call_id")
    is_merge = merges.select("conv_id", F.col("call_id").alias("end"), F.lit(True).alias("merge"))
    placed = written(ends.join(is_merge, ["conv_id", "end"], "left"), "placed")
    levels = placed.where("done AND merge IS NULL").select(*key, F.col("dist").alias("level"))
    if not merges.isEmpty():
        of_need = placed.select("conv_id", F.col("call_id").alias("need"), "end", (F.col("dist") + 1).alias("dist"), F.when(~F.col("done"), "cycle").when(F.col("merge"), "merge").otherwise("root").alias("kind"))
        settled = merge_levels(needs.join(merges, key).join(of_need, ["conv_id", "need"]).select(*key, "end", "dist", "kind"))
        behind = placed.where("done AND merge").join(settled.select("conv_id", F.col("call_id").alias("end"), F.col("level").alias("base")), ["conv_id", "end"])
        levels = levels.unionAll(behind.select(*key, (F.col("base") + F.col("dist")).alias("level")))
    return calls.select(*key).distinct().join(levels, key, "left").join(dangling, key, "left")


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def format_chats(messages: DataFrame, calls: DataFrame, results: DataFrame, tools: list[Tool]) -> DataFrame:
    """Lines (conv_id, turn, kind, call_id, level, errors, json).

    messages: conv_id, turn, role, text. calls: conv_id, turn, call_id, name, arguments (JSON text), after (array of
    call_ids). results: conv_id, turn, call_id, text.
    """
    key = ["conv_id", "call_id"]
    named = calls.where("conv_id IS NOT NULL AND call_id IS NOT NULL")
    gathered = written(named.groupBy(*key).agg(F.array_distinct(F.flatten(F.collect_set(F.coalesce("after", F.array().cast("array<string>"))))).alias("after")), "calls")
    levels = written(call_levels(gathered), "levels")
    answered = results.where("call_id IS NOT NULL").groupBy(*key).agg(F.count("*").alias("answers"))
    facts = levels.join(answered.hint("shuffle_hash"), key, "left")

    linked = calls.join(facts.hint("shuffle_hash"), key, "left")
    problems = F.array_compact(F.array(
        F.when(F.col("level").isNull(), "cycle"), F.when(F.col("dangling"), "dangling"), F.when(F.col("answers").isNull(), "unanswered"),
    ))
    errors = F.concat_ws(",", F.concat(argument_errors(F.col("name"), F.col("arguments"), tools), problems))
    call_lines = linked.select(
        "conv_id", "turn", F.lit("call").alias("kind"), "call_id", "level", errors.alias("errors"),
        _json(arguments=F.coalesce(F.try_parse_json("arguments"), F.parse_json(F.lit("{}"))), id=F.col("call_id"), name=F.col("name"), role=F.lit("assistant"), type=F.lit("tool_call")).alias("json"),
    )
    found = results.join(levels.select(*key, "level", F.lit(True).alias("known")).hint("shuffle_hash"), key, "left")
    result_lines = found.select(
        "conv_id", "turn", F.lit("result").alias("kind"), "call_id", "level", F.when(F.col("known"), "").otherwise("orphan").alias("errors"),
        _json(content=F.coalesce("text", F.lit("")), role=F.lit("tool"), tool_call_id=F.col("call_id")).alias("json"),
    )
    message_lines = messages.select(
        "conv_id", "turn", F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"), F.lit(None).cast("int").alias("level"), F.lit("").alias("errors"),
        _json(content=F.coalesce("text", F.lit("")), role=F.col("role")).alias("json"),
    )
    return message_lines.unionAll(call_lines).unionAll(result_lines)
