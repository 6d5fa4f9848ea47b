"""Chat formatting with linked tool calls, in DataFrame and SQL functions only.

A turn's text may be a JSON object: an assistant's with `tool_calls` (id, name, arguments, after: ids it must
follow) and `content`, a tool's with `tool_call_id` and `content`. Calls and results are joined by
(conversation, identifier); calls are put in topological order by levels, chains by doubled steps; arguments are
held against the tools' schemas; every message becomes canonical JSON: keys in order, no white space.

The result has a row for each message, call and result, with the columns that order them. No conversation is
collected into one row or task, so one that holds a third of all turns is spread like any other rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._spark import cut

_BODY = "struct<content:string,tool_call_id:string,tool_calls:array<struct<id:string,name:string,arguments:string,after:array<string>>>>"
#: JSON types of a schema and the names that Spark's variant type has for them.
TYPES = {"string": "STRING", "integer": "BIGINT", "number": "(BIGINT|DOUBLE|DECIMAL.*)", "boolean": "BOOLEAN", "object": "OBJECT.*", "array": "ARRAY.*", "null": "VOID"}
#: Tools are broadcast up to this many; more are joined by name.
BROADCAST_TOOLS = 10_000


def _levels(calls: DataFrame) -> DataFrame:
    """calls with level: 0 without known predecessors, else one more than the largest of theirs; null in or behind a cycle.

    An edge (call, before, steps) says that the call comes at least so many levels after another. In each round calls
    whose edges all lead to placed ones are placed, and every edge that leads to a call with a single edge
    is carried on over it: a chain of n calls takes about log2(n) rounds, not n. Where many calls with several
    predecessors follow each other a round places at least one of them more; a round that places none ends it.
    """
    key = ["conv_id", "call_id"]
    names = calls.select(*key).distinct()
    edges = calls.selectExpr("conv_id", "call_id", "explode(after) as before", "1L as steps").distinct().join(names.withColumnRenamed("call_id", "before"), ["conv_id", "before"])
    edges = cut(edges.select("conv_id", "call_id", "before", "steps"))
    if edges.isEmpty():
        return calls.withColumn("level", F.lit(0))
    done = cut(names.join(edges.select(*key).distinct(), key, "left_anti").withColumn("level", F.lit(0).cast("long")))
    while True:
        state = edges.join(done.selectExpr("conv_id", "call_id as before", "level"), ["conv_id", "before"], "left")
        ready = state.groupBy(*key).agg(F.max(F.col("level") + F.col("steps")).alias("level"), F.bool_and(F.col("level").isNotNull()).alias("ok")).where("ok").drop("ok")
        ready = cut(ready)
        if ready.isEmpty():
            break
        done = cut(done.union(ready))
        left = edges.join(ready.select(*key), key, "left_anti")
        single = left.groupBy(*key).agg(F.count("*").alias("n"), F.min("before").alias("next"), F.min("steps").alias("more")).where("n = 1")
        on = single.selectExpr("conv_id", "call_id as before", "next", "more")
        edges = left.join(on, ["conv_id", "before"], "left").selectExpr("conv_id", "call_id", "coalesce(next, before) before", "steps + coalesce(more, 0L) steps")
        edges = cut(edges.groupBy("conv_id", "call_id", "before").agg(F.max("steps").alias("steps")))
    return calls.join(done.withColumn("level", F.col("level").cast("int")), key, "left")


def format_chat(turns: DataFrame, tools: DataFrame | None = None) -> DataFrame:
    """(conv_id, turn, level, part, role, call_id, status, valid, problems, json).

    turns: conv_id, turn, role, text. tools: name, required array<string>, types map<string,string> of JSON types.
    Sorted by (turn, level, part, call_id) a conversation reads in order: a message, then its calls by level,
    each followed by its results (part 0 message, 1 call, 2 result); a linked result takes the turn and level of
    its call. status: message, linked, no_result, no_call, duplicate (a later call or result of a used
    identifier) or cycle. valid is null but for calls; problems names missing, unknown and mistyped
    arguments, arguments that aren't an object, and unknown tools if tools is given.

    Text that isn't such an object is an ordinary message; null text is a message with null content. A null
    identifier links nothing. Repeated rows are duplicates of calls and results and plain repeats of
    messages. Other columns are ignored; an empty table gives none.
    """
    own = turns.select(turns["conv_id"], turns["turn"], turns["role"], turns["text"].cast("string").alias("text"))
    body = own.withColumn("b", F.when(F.expr("ltrim(text) like '{%'"), F.from_json("text", _BODY)))
    is_call, is_result = F.expr("b.tool_calls is not null"), F.expr("b.tool_call_id is not null and role = 'tool'")
    messages = body.where(~F.coalesce(is_result, F.lit(False))).select(
        "conv_id", "turn", F.lit(0).alias("level"), F.lit(0).alias("part"), "role", F.lit(None).cast("string").alias("call_id"),
        F.lit("message").alias("status"), F.lit(None).cast("boolean").alias("valid"), F.array().cast("array<string>").alias("problems"),
        F.to_json(F.struct(F.when(is_call, F.col("b.content")).otherwise(F.col("text")).alias("content"), "role"), {"ignoreNullFields": "false"}).alias("json"),
    )
    calls = body.where(is_call).selectExpr("conv_id", "turn", "role", "posexplode(b.tool_calls) as (pos, c)")
    calls = calls.selectExpr("conv_id", "turn", "role", "pos", "c.id call_id", "c.name", "c.arguments", "coalesce(c.after, array()) after")
    results = body.where(is_result).selectExpr("conv_id", "turn", "role", "b.tool_call_id call_id", "b.content content")
    calls, results = cut(calls), cut(results)
    if calls.isEmpty() and results.isEmpty():
        return messages

    # the first call and the first result of an identifier are linked
    first = calls.where("call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "pos")).alias("f"))
    calls = calls.join(first, ["conv_id", "call_id"], "left").withColumn("later", F.expr("f is not null and struct(turn, pos) <> f")).drop("f")
    order = _levels(calls.where("not later and call_id is not null")).select("conv_id", "call_id", "level", F.col("turn").alias("call_turn"))
    order = cut(order.dropDuplicates(["conv_id", "call_id"]))
    answered = results.groupBy("conv_id", "call_id").agg(F.min("turn").alias("result_turn"))
    calls = calls.join(order, ["conv_id", "call_id"], "left").join(answered, ["conv_id", "call_id"], "left")
    status = F.expr(
        "case when later then 'duplicate' when call_turn is not null and level is null then 'cycle' when result_turn is null then 'no_result' else 'linked' end"
    )
    calls = calls.withColumn("status", status).withColumn("v", F.expr("try_parse_json(arguments)"))
    calls = calls.withColumn("args", F.expr("from_json(if(schema_of_variant(v) like 'OBJECT%', arguments, null), 'map<string,variant>')"))
    problems = ["if(args is null, array('arguments: not an object'), array())"]
    if tools is not None:
        t = tools.select("name", "required", "types", F.lit(True).alias("known"))
        few = tools.limit(BROADCAST_TOOLS + 1).count() <= BROADCAST_TOOLS
        calls = calls.join(F.broadcast(t) if few else t, "name", "left")
        kinds = "map(" + ", ".join(f"'{k}', '{v}'" for k, v in TYPES.items()) + ")"
        problems += [
            "if(known is null, array(concat('tool: unknown ', coalesce(name, 'null'))), array())",
            "if(known and args is not null, transform(filter(required, k -> not map_contains_key(args, k)), k -> concat(k, ': missing')), array())",
            "if(known and args is not null, transform(filter(map_keys(args), k -> not map_contains_key(types, k)), k -> concat(k, ': unknown')), array())",
            f"""if(known and args is not null, transform(filter(map_keys(args), k -> map_contains_key(types, k)
                and not regexp_like(schema_of_variant(args[k]), concat('^', coalesce(element_at({kinds}, types[k]), types[k]), '$'))), k -> concat(k, ': not ', types[k])), array())""",
        ]
    calls = calls.withColumn("problems", F.expr(f"concat({', '.join(f'cast({p} as array<string>)' for p in problems)})"))
    call_rows = calls.select(
        "conv_id", "turn", F.coalesce("level", F.lit(0)).alias("level"), F.lit(1).alias("part"), "role", "call_id", "status", (F.size("problems") == 0).alias("valid"), "problems",
        F.to_json(F.struct(F.coalesce("v", F.expr("to_variant_object(struct(arguments as raw))")).alias("arguments"), F.col("call_id").alias("id"), "name"), {"ignoreNullFields": "false"}).alias("json"),
    )
    early = results.groupBy("conv_id", "call_id").agg(F.min("turn").alias("first_turn"))
    linked = results.join(order, ["conv_id", "call_id"], "left").join(early, ["conv_id", "call_id"], "left")
    result_rows = linked.select(
        "conv_id", F.coalesce("call_turn", "turn").alias("turn"), F.coalesce("level", F.lit(0)).alias("level"), F.lit(2).alias("part"), "role", "call_id",
        F.expr("case when call_turn is null then 'no_call' when turn > first_turn then 'duplicate' else 'linked' end").alias("status"),
        F.lit(None).cast("boolean").alias("valid"), F.array().cast("array<string>").alias("problems"),
        F.to_json(F.struct("content", "role", F.col("call_id").alias("tool_call_id")), {"ignoreNullFields": "false"}).alias("json"),
    )
    return messages.union(call_rows).union(result_rows)


#: Tools that turn_calls() names: required arguments and their JSON types.
TURN_TOOLS = [("note", ["text", "topic"], {"text": "string", "topic": "string"}), ("reply", ["text", "chars"], {"text": "string", "chars": "integer"})]
#: Turns with fewer characters are notes.
NOTE_CHARS = 300


def turn_calls(turns: DataFrame) -> DataFrame:
    """Conversations without tool calls as conversations with them: conv_id, turn, role, text.

    An assistant's turn is a call `turn-<turn>` of the tool reply, with its text and number of characters as arguments,
    or of note if it is short (which then lacks its topic); it follows the call of the assistant's turn two before.
    The user's turn after an assistant's is the result of that call, by its number; others stay messages. A null turn or
    text makes no call.
    """
    t = turns.select(turns["conv_id"], turns["turn"], turns["role"], turns["text"].cast("string").alias("text"))
    name = F.when(F.char_length("text") < NOTE_CHARS, F.lit("note")).otherwise(F.lit("reply"))
    chars = F.when(name == "reply", F.char_length("text"))
    call = F.struct(
        F.concat(F.lit("turn-"), "turn").alias("id"), name.alias("name"), F.struct("text", chars.alias("chars")).alias("arguments"),
        F.array(F.concat(F.lit("turn-"), F.col("turn") - 2)).alias("after"),
    )
    calls = F.to_json(F.struct(F.array(call).alias("tool_calls")))
    result = F.to_json(F.struct(F.concat(F.lit("turn-"), F.col("turn") - 1).alias("tool_call_id"), F.col("text").alias("content")))
    whole = F.col("turn").isNotNull() & F.col("text").isNotNull()
    is_call, is_result = whole & (F.col("role") == "assistant"), whole & (F.col("role") == "user") & (F.col("turn") > 0)
    return t.select(
        "conv_id", "turn",
        F.when(is_result, F.lit("tool")).otherwise(F.col("role")).alias("role"),
        F.when(is_call, calls).when(is_result, result).otherwise(F.col("text")).alias("text"),
    )
