"""Chat formatting with tool calls, on DataFrame functions only.

A message may carry tool calls (JSON with ``tool_calls``: objects of id, name, arguments) or be a result (role ``tool``,
JSON with ``tool_call_id``). Calls and results are hash-joined by conversation and identifier; arguments are validated
against the tools' schemas; calls are put in topological order by the results they refer to (``$result:ID`` in
the arguments); everything is serialised as canonical JSON (keys sorted, no spaces). Calls may have the name and arguments
themselves or, as is common, under ``function``.

Conversations without tools can be linked too: with ``exchanges``, each user turn that carries no calls is taken as a call
of the tool ``reply`` (identifier from its turn, arguments measured from it), and the assistant's next turn as its result.
Such a call refers to the result before it, so levels count the exchanges that a reply builds on.

Levels are found by pointer doubling: calls that refer to one result each are chains, which are halved in every round,
however long; only calls on several results take a round for each of their kind that stand behind each other.

One row comes out for each message, call and result, with the columns that order them (turn, level, part), so a
conversation of any length is never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import written

#: Arguments of each tool: name -> {argument: (type, required[, least, most])}; the types are string, integer, number, boolean, array, object.
TOOLS: dict[str, dict[str, tuple]] = {
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "calculator": {"expression": ("string", True)},
    "weather": {"city": ("string", True), "days": ("integer", False), "metric": ("boolean", False)},
    "reply": {"after": ("string", False), "chars": ("integer", True, 1, 8_192), "turn": ("integer", True)},
}
# How Spark names the types of JSON values.
KINDS = {"string": "STRING", "integer": "BIGINT", "number": "(BIGINT|DECIMAL.*|DOUBLE)", "boolean": "BOOLEAN", "array": "ARRAY.*", "object": "OBJECT.*"}
CALLS = "tool_calls array<struct<id:string,name:string,arguments:string,function:struct<name:string,arguments:string>>>, tool_call_id string, content string"


def canonical(json: Column) -> Column:
    """JSON text with sorted keys and no spaces; null where it is no JSON."""
    return F.to_json(F.try_parse_json(json))


def _quoted(text: Column) -> Column:
    """A JSON string."""
    return F.coalesce(F.regexp_extract(F.to_json(F.struct(text.alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1), F.lit("null"))


def _entries(*pairs: tuple[str, Column]) -> Column:
    """A JSON object of pairs in the given (sorted) order."""
    parts = [F.concat(F.lit(("," if i else "{") + f'"{k}":'), F.coalesce(F.when(v != "", v), F.lit("null"))) for i, (k, v) in enumerate(pairs)]
    return F.concat(*parts, F.lit("}"))


def problems(tools: dict, name: Column, arguments: Column) -> Column:
    """What is wrong with a call's arguments, as a sorted array of texts; empty if they are valid."""
    found = []
    for tool, schema in sorted(tools.items()):
        here = name == tool
        for argument, (kind, required, *limits) in sorted(schema.items()):
            value = F.get_json_object(arguments, f"$.{argument}")
            typed = F.schema_of_variant(F.try_variant_get(F.try_parse_json(arguments), f"$.{argument}", "variant"))
            if required:
                found.append(F.when(here & value.isNull(), F.lit(f"missing {argument}")))
            found.append(F.when(here & value.isNotNull() & ~typed.rlike(f"^{KINDS[kind]}$"), F.lit(f"type of {argument}")))
            if limits:
                found.append(F.when(here & ~value.try_cast("double").between(*limits), F.lit(f"range of {argument}")))
        extra = F.array_except(F.json_object_keys(arguments), F.array(*map(F.lit, sorted(schema))) if schema else F.array().cast("array<string>"))
        found.append(F.when(here & (F.size(extra) > 0), F.concat(F.lit("unknown "), F.array_join(F.array_sort(extra), " "))))
    found.append(F.when(name.isNull() | ~name.isin(*tools), F.lit("unknown tool")))
    found.append(F.when(F.try_parse_json(arguments).isNull() | ~F.schema_of_variant(F.try_parse_json(arguments)).startswith("OBJECT"), F.lit("no object")))
    return F.array_sort(F.array_compact(F.array(*found)))


def _references(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, on, known): the results that each call refers to, and whether there is a call that they are of."""
    known = calls.select("conv_id", F.col("call_id").alias("on")).distinct().withColumn("known", F.lit(True))
    on = F.explode(F.array_distinct(F.regexp_extract_all("arguments", F.lit(r"\$result:([A-Za-z0-9_.-]+)"), F.lit(1))))
    refers = calls.select("conv_id", "call_id", on.alias("on")).distinct()
    return refers.join(known, ["conv_id", "on"], "left").withColumn("known", F.coalesce("known", F.lit(False)))


def _levels(calls: DataFrame, references: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): 0 for calls that refer to no other call's result, else one more than the deepest they
    refer to; null for those in or behind a cycle. References to calls that do not exist are no constraint."""
    key = ["conv_id", "call_id"]
    known, edges = calls.select(*key).distinct(), references.filter("known").select(*key, "on")
    if edges.isEmpty():
        return known.withColumn("level", F.lit(0))
    of = edges.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("on").alias("to"))
    chained = written(of.filter("n = 1").select(*key, "to", F.lit(1).alias("far")), "chat-chains")
    longest = chained.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    for _ in range(longest.bit_length()):  # what still points into a chain after that many rounds leads into a cycle
        ahead = chained.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("next"), F.col("far").alias("more"))
        chained = written(chained.join(ahead, ["conv_id", "to"], "left").select(*key, F.coalesce("next", "to").alias("to"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far")), "chat-chains")
    # the ends of chains: calls on nothing, and calls on several results
    starts = written(known.join(of, key, "left_anti").withColumn("level", F.lit(0)), "chat-levels")
    hops = edges.join(of.filter("n > 1").select(*key), key, "left_semi")
    if not hops.isEmpty():
        at = chained.select("conv_id", F.col("call_id").alias("on"), "to", "far")
        hops = written(hops.join(at, ["conv_id", "on"], "left").select(*key, F.coalesce("to", "on").alias("to"), (F.coalesce("far", F.lit(0)) + 1).alias("far")), "chat-hops")
        while True:
            met = hops.join(starts, key, "left_anti").join(starts.withColumnRenamed("call_id", "to"), ["conv_id", "to"], "left")
            ready = met.groupBy(*key).agg(F.max(F.col("level") + F.col("far")).alias("level"), F.bool_and(F.col("level").isNotNull()).alias("all"))
            ready = written(ready.filter("all").select(*key, "level"), "chat-levels")
            if ready.isEmpty():
                break
            starts = written(starts.unionByName(ready), "chat-levels")
    behind = chained.join(starts.withColumnRenamed("call_id", "to"), ["conv_id", "to"]).select(*key, (F.col("level") + F.col("far")).alias("level"))
    return known.join(starts.unionByName(behind), key, "left")


def format_chat(conversations: DataFrame, tools: dict | None = None, exchanges: bool = False) -> DataFrame:
    """One row for each message, call and result of conversations.

    conv_id, turn, part (0 message, 1 call, 2 result), kind, call_id, level, status, problems, json. Sorting a conversation by
    (turn, part, level, call_id) reads it in order: calls stand behind the message that makes them, those that others refer to first,
    and a linked result is placed at its own turn. status is ``linked``, ``orphan`` (a call without a result, a result
    without a call), ``early`` (a result at a turn before its call's) or ``repeated`` (an identifier that several calls or several results of a conversation share);
    null for messages. problems of a call: arguments that are missing, unknown, of another type or out of range, tools that are
    unknown, and results that no call gives (``dangling``). A null text is a message with null content; text that is no JSON is plain content. Null conv_id or
    turn are kept and never linked. Repeated rows are formatted each; other columns are not read. exchanges: see above."""
    tools = TOOLS if tools is None else tools
    base = conversations.select("conv_id", "turn", "role", "text", F.to_json(F.try_variant_get(F.try_parse_json(F.when(F.ltrim("text").startswith("{"), F.col("text"))), "$.content", "variant")).alias("content"), F.from_json(F.when(F.ltrim("text").startswith("{"), F.col("text")), CALLS).alias("j"))
    messages = base.select("conv_id", "turn", F.lit(0).alias("part"), F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"), F.lit(0).alias("level"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("array<string>").alias("problems"), _entries(("content", _quoted(F.when(F.col("j.tool_calls").isNotNull() | F.col("j.tool_call_id").isNotNull(), F.col("j.content")).otherwise(F.col("text")))), ("role", _quoted(F.col("role")))).alias("json"))
    special = base.filter(F.col("j.tool_calls").isNotNull() | F.col("j.tool_call_id").isNotNull())
    if special.isEmpty() and not exchanges:
        return messages
    special = written(special, "tool-messages")
    name, arguments = (F.coalesce(f"c.{x}", f"c.function.{x}").alias(x) for x in ("name", "arguments"))
    calls = special.select("conv_id", "turn", F.explode("j.tool_calls").alias("c")).select("conv_id", "turn", F.col("c.id").alias("call_id"), name, arguments)
    results = special.filter(F.col("j.tool_call_id").isNotNull()).select("conv_id", "turn", F.col("j.tool_call_id").alias("call_id"), F.coalesce(F.col("content"), _quoted(F.col("j.content"))).alias("content"))
    if exchanges:
        plain = base.filter(F.col("conv_id").isNotNull() & F.col("turn").isNotNull() & F.col("j.tool_calls").isNull() & F.col("j.tool_call_id").isNull())
        at = lambda turn: F.concat(F.lit("turn-"), turn.cast("string")).alias("call_id")
        after = F.when(F.col("turn") >= 2, F.concat(F.lit("$result:turn-"), (F.col("turn") - 2).cast("string")))  # the result at the turn before
        measured = F.to_json(F.struct(after.alias("after"), F.length(F.coalesce("text", F.lit(""))).alias("chars"), F.col("turn").cast("long").alias("turn")))
        calls = calls.unionByName(plain.filter("role = 'user'").select("conv_id", "turn", at(F.col("turn")), F.lit("reply").alias("name"), measured.alias("arguments")))
        results = results.unionByName(plain.filter("role = 'assistant'").select("conv_id", "turn", at(F.col("turn") - 1), _quoted(F.col("text")).alias("content")))
    calls = written(calls, "chat-calls")
    key = ["conv_id", "call_id"]
    n_calls = calls.groupBy(*key).agg(F.count(F.lit(1)).alias("n_calls"), F.min("turn").alias("called"))
    n_results = results.groupBy(*key).agg(F.count(F.lit(1)).alias("n_results"), F.max("turn").alias("answered"))
    links = n_calls.join(n_results, key, "full")
    repeated = (F.coalesce("n_calls", F.lit(0)) > 1) | (F.coalesce("n_results", F.lit(0)) > 1)
    status = F.when(repeated, "repeated").when(F.col("n_calls").isNull() | F.col("n_results").isNull(), "orphan").when(F.col("answered") < F.col("called"), "early").otherwise("linked")
    links = written(links.select(*key, status.alias("status")), "links")

    def linked(df: DataFrame) -> DataFrame:
        return df.join(links, key, "left").withColumn("status", F.coalesce("status", F.lit("orphan")))

    call_json = _entries(("arguments", F.coalesce(canonical(F.col("arguments")), _quoted(F.col("arguments")))), ("id", _quoted(F.col("call_id"))), ("name", _quoted(F.col("name"))))
    result_json = _entries(("content", F.col("content")), ("role", F.lit('"tool"')), ("tool_call_id", _quoted(F.col("call_id"))))
    references = written(_references(calls), "chat-references")
    lost = references.filter("NOT known").groupBy(*key).agg(F.array_sort(F.collect_list(F.concat(F.lit("dangling "), "on"))).alias("lost"))  # of one identifier
    wrong = F.array_sort(F.concat(problems(tools, F.col("name"), F.col("arguments")), F.coalesce("lost", F.array().cast("array<string>"))))
    out_calls = linked(calls).join(_levels(calls, references), key, "left").join(lost, key, "left").select("conv_id", "turn", F.lit(1).alias("part"), F.lit("call").alias("kind"), "call_id", "level", "status", wrong.alias("problems"), call_json.alias("json"))
    out_results = linked(results).select("conv_id", "turn", F.lit(2).alias("part"), F.lit("result").alias("kind"), "call_id", F.lit(0).alias("level"), "status", F.lit(None).cast("array<string>").alias("problems"), result_json.alias("json"))
    return messages.unionByName(out_calls).unionByName(out_results)
