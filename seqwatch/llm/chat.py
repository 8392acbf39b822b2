"""Chat formatting: tool calls and results linked by identifier, ordered, validated, and written as canonical JSON."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqwatch.llm.shared import appended, durable_root, written

CALLS = "struct<tool_calls:array<struct<id:string,name:string,arguments:string,depends_on:array<string>>>>"
RESULT = "struct<tool_call_id:string,content:string>"
#: Tools by which plain conversations are read as calls, with their arguments: name, argument, type, required.
TURN_TOOLS = [
    ("reply", "prompt", "string", True),
    ("lookup", "query", "string", True),
    ("lookup", "limit", "integer", True),
    ("measure", "chars", "number", True),
    ("measure", "exact", "boolean", False),
]
#: Turns of a conversation that are ordered in one group.
SPAN = 1000


def canonical(json: Column) -> Column:
    """JSON with sorted keys and without spaces; null where it isn't JSON."""
    return F.to_json(F.try_parse_json(json))


def quoted(text: Column) -> Column:
    """A text as a JSON string, null as JSON null."""
    one = F.to_json(F.array(text))
    return F.when(text.isNull(), "null").otherwise(F.substring(one, F.lit(2), F.length(one) - 2))


def parsed_events(messages: DataFrame) -> DataFrame:
    """Calls of assistant messages, results of tool messages, and all other messages, one row each.

    An assistant text that is a JSON object with `tool_calls` makes a row for each call; a tool text with
    `tool_call_id` is a result. All other rows are plain messages.
    """
    rows = messages.select("conv_id", "turn", "role", "text")
    calls = F.from_json("text", CALLS)["tool_calls"]
    result = F.from_json("text", RESULT)
    role, looks_json = F.coalesce("role", F.lit("")), F.coalesce(F.col("text").rlike(r"^\s*\{"), F.lit(False))
    rows = rows.withColumn("calls", F.when((role == "assistant") & looks_json, calls)).withColumn("result", F.when((role == "tool") & looks_json, result))
    is_call, is_result = F.coalesce(F.size("calls") > 0, F.lit(False)), F.col("result.tool_call_id").isNotNull()
    none = F.lit(None).cast("string")
    call = rows.filter(is_call).select("conv_id", "turn", "role", F.posexplode("calls").alias("seq", "call"))
    call = call.select("conv_id", "turn", "seq", "role", F.lit("call").alias("kind"), F.col("call.id").alias("call_id"), F.col("call.name").alias("name"), F.col("call.arguments").alias("body"), F.col("call.depends_on").alias("depends_on"))
    no_needs = F.lit(None).cast("array<string>").alias("depends_on")
    answer = rows.filter(~is_call & is_result).select("conv_id", "turn", F.lit(0).alias("seq"), "role", F.lit("result").alias("kind"), F.col("result.tool_call_id").alias("call_id"), none.alias("name"), F.col("result.content").alias("body"), no_needs)
    plain = rows.filter(~is_call & ~is_result).select("conv_id", "turn", F.lit(0).alias("seq"), "role", F.lit("message").alias("kind"), none.alias("call_id"), none.alias("name"), F.col("text").alias("body"), no_needs)
    return call.unionByName(answer).unionByName(plain)


def last_asked(rows: DataFrame) -> DataFrame:
    """Adds `asked`: the last user turn of its conversation that is lower than each row's.

    Turns are ordered within spans of SPAN turns, and the last user turns of spans over the spans, so that no
    conversation is gathered whole.
    """
    rows = rows.withColumn("span", F.floor(F.col("turn") / SPAN))
    user = F.when(F.col("role") == "user", F.col("turn"))
    within = Window.partitionBy("conv_id", "span").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("conv_id").orderBy(F.col("span").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    spans = rows.groupBy("conv_id", "span").agg(F.max(user).alias("last")).select(F.col("conv_id").alias("of"), F.col("span").alias("of_span"), F.last("last", ignorenulls=True).over(over).alias("earlier"))
    met = rows.withColumn("asked", F.max(user).over(within)).join(spans, F.expr("conv_id <=> of and span <=> of_span"))
    return met.withColumn("asked", F.coalesce("asked", "earlier")).drop("span", "of", "of_span", "earlier")


def turn_events(messages: DataFrame) -> DataFrame:
    """Plain conversations as calls: each user turn calls a tool and each assistant turn answers the last user turn before it.

    The turn decides the tool (`reply`, `lookup`, `measure` in turn) and the length of the text what is told: some calls
    lack an argument, have one of a wrong type or one too many. A call needs the one of the user turn before, but for
    every fourth length; lengths of 7 modulo 13 also need an identifier that nobody has.
    """
    rows = last_asked(messages.select("conv_id", "turn", "role", "text"))
    role, n = F.coalesce("role", F.lit("")), F.coalesce(F.length("text"), F.lit(0))
    rows = rows.withColumn("kind", F.when(role == "user", "call").when((role == "assistant") & F.col("asked").isNotNull(), "result").otherwise("message"))
    of = F.when(F.col("kind") == "call", F.col("turn")).when(F.col("kind") == "result", F.col("asked"))
    name_of = lambda turn: F.concat(F.lit("turn-"), turn.cast("string"))
    tool, odd, text, turn = F.pmod("turn", F.lit(3)), n % 5, quoted(F.col("text")), F.coalesce(F.col("turn").cast("string"), F.lit("0"))
    reply = F.concat(F.lit('{"prompt":'), text, F.lit("}"))
    limit = F.when(odd == 0, "").when(odd == 1, F.concat(F.lit('"limit":"'), turn, F.lit('",'))).otherwise(F.concat(F.lit('"limit":'), turn, F.lit(",")))
    lookup = F.concat(F.lit("{"), limit, F.lit('"query":'), text, F.lit("}"))
    told = F.when(odd == 2, '.5,"exact":true}').when(odd == 3, ',"extra":[1]}').when(odd == 4, ',"exact":"yes"}').otherwise("}")
    measure = F.concat(F.lit('{"chars":'), n.cast("string"), told)
    body = F.when(F.col("kind") == "call", F.when(tool == 1, lookup).when(tool == 2, measure).otherwise(reply)).otherwise(F.col("text"))
    name = F.when(F.col("kind") == "call", F.when(tool == 1, "lookup").when(tool == 2, "measure").otherwise("reply"))
    needs = F.filter(F.array(F.when(n % 4 != 3, name_of(F.col("asked"))), F.when(n % 13 == 7, F.lit("turn-none"))), lambda x: x.isNotNull())
    needs = F.when((F.col("kind") == "call") & (F.size(needs) > 0), needs)
    return rows.select("conv_id", "turn", F.lit(0).alias("seq"), "role", "kind", name_of(of).alias("call_id"), name.alias("name"), body.alias("body"), needs.alias("depends_on"))


def call_levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level, place) of calls: level 0 without dependencies, else one more than the highest needed.

    The place is the call's turn, or a later turn in which the last needed call stands or is answered.

    Levels settle in rounds, one for each step of the longest chain; each appends to one table. Calls in or behind a cycle, or behind an
    unknown identifier, have no level.
    """
    first = calls.filter("link = 'call' or link = 'unanswered'").select("conv_id", "call_id", "turn", "linked_turn", "depends_on")
    edges = first.select("conv_id", "call_id", "turn", F.explode("depends_on").alias("needs")).distinct()
    done = first.filter(F.coalesce(F.size("depends_on"), F.lit(0)) <= 0).select("conv_id", "call_id", F.lit(0).alias("level"), F.col("turn").alias("place"), F.greatest("turn", "linked_turn").alias("ready"))
    edges = written(edges, "chat-edges")
    if edges.isEmpty():
        return done.drop("ready")
    root = f"{durable_root(calls.sparkSession)}/chat-levels-{uuid.uuid4().hex}"
    done = appended(done, root)
    answers = first.select("conv_id", "call_id", "linked_turn")
    needed = edges.groupBy("conv_id", "call_id", "turn").agg(F.count("*").alias("needed"))
    while True:
        known = done.select("conv_id", F.col("call_id").alias("needs"), "level", "ready")
        met = edges.join(known, ["conv_id", "needs"]).groupBy("conv_id", "call_id").agg(F.count("*").alias("met"), F.max("level").alias("below"), F.max("ready").alias("ready"))
        fresh = needed.join(met, ["conv_id", "call_id"]).filter("met = needed").join(done, ["conv_id", "call_id"], "left_anti")
        place = F.greatest("turn", "ready")
        fresh = fresh.join(answers, ["conv_id", "call_id"]).select("conv_id", "call_id", (F.col("below") + 1).alias("level"), place.alias("place"), F.greatest(place, "linked_turn").alias("ready"))
        fresh = written(fresh, "chat-level")
        if fresh.isEmpty():
            return done.drop("ready")
        done = appended(fresh, root)


def type_of(value: Column) -> Column:
    """The JSON type of a variant."""
    kind = F.schema_of_variant(value)
    return (
        F.when(kind == "STRING", "string").when(kind == "BIGINT", "integer").when(kind.startswith("DECIMAL") | (kind == "DOUBLE"), "number").when(kind == "BOOLEAN", "boolean")
        .when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").otherwise("null")
    )


def validated(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """Adds `errors`: what is wrong with each call's arguments under the schema of its tool, in a fixed order.

    Of schemas (name, argument, type, required): an integer also passes as a number. A tool without a schema, and
    arguments that are no JSON object, are errors themselves.
    """
    rules = schemas.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("argument", "type", "required"))).alias("rules"))  # a tool's parameters
    calls = calls.join(rules, "name", "left").withColumn("given", F.from_json("body", "map<string,variant>"))
    kind = lambda r: type_of(F.element_at("given", r["argument"]))
    held = lambda r: F.map_contains_key("given", r["argument"])
    missing = F.transform(F.filter("rules", lambda r: r["required"] & ~held(r)), lambda r: F.concat(F.lit("missing:"), r["argument"]))
    wrong = F.filter("rules", lambda r: held(r) & (kind(r) != r["type"]) & ~((kind(r) == "integer") & (r["type"] == "number")))
    wrong = F.transform(wrong, lambda r: F.concat(F.lit("type:"), r["argument"]))
    unknown = F.transform(F.array_except(F.map_keys("given"), F.transform("rules", lambda r: r["argument"])), lambda a: F.concat(F.lit("unknown:"), a))
    errors = (
        F.when(F.col("rules").isNull(), F.array(F.lit("no schema")))
        .when(~F.coalesce(F.col("body").rlike(r"^\s*\{"), F.lit(False)) | F.try_parse_json("body").isNull() | F.col("given").isNull(), F.array(F.lit("not an object")))
        .otherwise(F.concat(F.sort_array(missing), F.sort_array(wrong), F.sort_array(unknown)))
    )
    return calls.withColumn("errors", errors).drop("rules", "given")


def format_chat(events: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per event: conv_id, turn, seq, kind, call_id, link, linked_turn, place, level, errors and canonical JSON.

    Calls and results are hash-joined by (conversation, identifier). `link` is `call` (answered), `unanswered`,
    `result`, `early` (before its call), `orphan` (no such call), `duplicate` (identifier already called or answered
    by an earlier turn) or `message`. (conv_id, place, level, turn, seq) is a topological order that departs from the
    order of turns only where it must: `place` is the turn, or the later turn of what must come first; `level` counts
    two for each step of dependency, one more for results. Plain messages, orphans and duplicates have level 0. Calls
    in a cycle or behind an unknown identifier, with their results, keep their turn and have no level.

    Null roles and texts are plain messages with JSON null; null identifiers link with nothing. Repeated rows keep
    their rows, the later ones as duplicates (of equal turns the lower seq, name, body is first). A very long text is one
    JSON string of its row. An empty table gives no rows. Other columns, whatever their names, are ignored. No
    conversation is gathered into one task: window functions order the rows of one identifier, or of one span of turns.
    """
    events = written(events, "chat-events")
    same = Window.partitionBy("conv_id", "kind", "call_id").orderBy(F.col("turn").asc_nulls_last(), "seq", "name", "body")
    linked = events.filter((F.col("kind") != "message") & F.col("call_id").isNotNull()).withColumn("nth", F.row_number().over(same))
    calls, results = linked.filter("kind = 'call'"), linked.filter("kind = 'result'")
    asked = calls.filter("nth = 1").select("conv_id", "call_id", F.col("turn").alias("call_turn"))
    answered = results.filter("nth = 1").select("conv_id", "call_id", F.col("turn").alias("result_turn"))

    calls = calls.join(answered, ["conv_id", "call_id"], "left")
    calls = calls.withColumn("link", F.when(F.col("nth") > 1, "duplicate").when(F.col("result_turn").isNull(), "unanswered").otherwise("call"))
    calls = written(validated(calls.withColumn("linked_turn", F.when(F.col("nth") == 1, F.col("result_turn"))), schemas), "chat-calls")
    levels = call_levels(calls)
    calls = calls.join(levels, ["conv_id", "call_id"], "left").withColumn("level", F.when(F.col("link") == "duplicate", 0).otherwise(2 * F.col("level"))).withColumn("place", F.when(F.col("link") == "duplicate", F.col("turn")).otherwise(F.coalesce("place", "turn")))

    results = results.join(asked.join(levels, ["conv_id", "call_id"], "left").withColumn("known", F.lit(True)), ["conv_id", "call_id"], "left")
    link = F.when(F.col("known").isNull(), "orphan").when(F.col("nth") > 1, "duplicate").when(F.col("call_turn") > F.col("turn"), "early").otherwise("result")
    results = results.withColumn("link", link).withColumn("linked_turn", F.col("call_turn")).withColumn("errors", F.array().cast("array<string>"))
    results = results.withColumn("level", F.when(F.col("link").isin("orphan", "duplicate"), 0).otherwise(2 * F.col("level") + 1))
    results = results.withColumn("place", F.when(F.col("link").isin("orphan", "duplicate"), F.col("turn")).otherwise(F.greatest("turn", F.coalesce("place", "call_turn"))))

    plain = events.filter((F.col("kind") == "message") | F.col("call_id").isNull()).withColumn("link", F.lit("message")).withColumn("linked_turn", F.lit(None).cast("long"))
    plain = plain.withColumn("level", F.lit(0)).withColumn("errors", F.array().cast("array<string>")).withColumn("place", F.col("turn"))

    columns = ["conv_id", "turn", "seq", "role", "kind", "call_id", "name", "body", "link", "linked_turn", "place", "level", "errors"]
    every = calls.select(*columns).unionByName(results.select(*columns)).unionByName(plain.select(*columns))
    role = quoted(F.col("role"))
    call = F.concat(F.lit('{"arguments":'), F.coalesce(canonical(F.col("body")), quoted(F.col("body"))), F.lit(',"id":'), quoted(F.col("call_id")), F.lit(',"name":'), quoted(F.col("name")), F.lit(',"role":'), role, F.lit("}"))
    result = F.concat(F.lit('{"content":'), quoted(F.col("body")), F.lit(',"role":'), role, F.lit(',"tool_call_id":'), quoted(F.col("call_id")), F.lit("}"))
    message = F.concat(F.lit('{"content":'), quoted(F.col("body")), F.lit(',"role":'), role, F.lit("}"))
    json = F.when((F.col("kind") == "call") & F.col("call_id").isNotNull(), call).when((F.col("kind") == "result") & F.col("call_id").isNotNull(), result).otherwise(message)
    return every.select("conv_id", "turn", "seq", "kind", "call_id", "link", "linked_turn", "place", "level", F.concat_ws(";", "errors").alias("errors"), json.alias("json"))
