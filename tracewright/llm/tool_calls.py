"""Tool calls and their results in conversations: linked, checked, ordered, serialised. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.plans.storage import materialize, store

MESSAGE = ("conv_id", "turn", "role", "content", "call_id", "name", "arguments", "refs")


def link(messages: DataFrame) -> DataFrame:
    """Add `status` and `linked_turn` to messages by a hash join of results and calls on (conv_id, call_id).

    Messages have conv_id, turn, role, content, call_id, name, arguments (JSON text) and refs (call_ids
    a call needs results of). A call has a name, a result has a call_id but no name. Of calls with the
    same identifier the one with the smallest turn counts, the others are `repeated`. A call is
    `answered` or `unanswered`; a result is `linked` if its call comes before it, `early` if not,
    `orphan` if there is none, and so is one without identifiers. Other messages are `plain`.
    """
    is_call = F.col("name").isNotNull()
    calls = messages.where(is_call & F.col("call_id").isNotNull()).groupBy("conv_id", "call_id").agg(F.min("turn").alias("_call"))
    answers = messages.where(~is_call & F.col("call_id").isNotNull()).groupBy("conv_id", "call_id").agg(F.min("turn").alias("_answer"))
    keys = calls.join(answers, ["conv_id", "call_id"], "left")
    joined = messages.join(keys, ["conv_id", "call_id"], "left")
    status = F.when(is_call, F.when(F.col("_call").isNull(), "repeated").when(F.col("turn") != F.col("_call"), "repeated")
                    .when(F.col("_answer").isNull(), "unanswered").otherwise("answered"))
    status = status.when(F.col("call_id").isNull(), F.when(F.col("role") == "tool", "orphan").otherwise("plain"))
    status = status.when(F.col("_call").isNull(), "orphan").when(F.col("_call") >= F.col("turn"), "early").otherwise("linked")
    linked = F.when(status == "linked", F.col("_call")).when(status == "answered", F.col("_answer"))
    return joined.select(*MESSAGE, status.alias("status"), linked.alias("linked_turn"))


def levels(messages: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of calls in topological order: 0 without needs, else one above the highest need.

    Needs that are no call of the conversation do not count. A call on a cycle, or behind one, has no
    row. There is one round for each level, over the calls that became free in the round before.
    """
    calls = messages.where("name is not null and call_id is not null").groupBy("conv_id", "call_id").agg(
        F.min_by("refs", "turn").alias("refs"))
    calls = store(calls, "calls")
    needs = calls.select("conv_id", "call_id", F.explode(F.array_distinct("refs")).alias("ref"))
    needs = store(needs.join(calls.select("conv_id", F.col("call_id").alias("ref")), ["conv_id", "ref"], "left_semi"), "needs")
    count = needs.groupBy("conv_id", "call_id").agg(F.count("*").alias("_n"))
    frontier = calls.join(count, ["conv_id", "call_id"], "left_anti").select("conv_id", "call_id", F.lit(0).alias("level"))
    done = frontier = store(frontier, "levels")
    # what is still missing of each call, and the highest level so far
    waiting = store(count.select("*", F.lit(0).alias("_high")), "waiting")
    level = 0
    while not waiting.isEmpty():
        met = needs.join(frontier.select("conv_id", F.col("call_id").alias("ref")), ["conv_id", "ref"]).groupBy(
            "conv_id", "call_id").agg(F.count("*").alias("_met"))
        left = materialize(waiting.join(met, ["conv_id", "call_id"], "left").select(
            "conv_id", "call_id", (F.col("_n") - F.coalesce("_met", F.lit(0))).alias("_n"), "_high"))
        level += 1
        frontier = store(left.where("_n <= 0").select("conv_id", "call_id", F.lit(level).alias("level")), "levels")
        if frontier.isEmpty():
            break
        waiting, done = left.where("_n > 0"), done.unionByName(frontier)
    return done


def _kind(value: Column) -> Column:
    """JSON type of a variant."""
    name = F.schema_of_variant(value)
    return (F.when(name == "VOID", "null").when(name == "BOOLEAN", "boolean").when(name == "BIGINT", "integer")
            .when(name.startswith("DECIMAL") | name.isin("DOUBLE", "FLOAT"), "number").when(name == "STRING", "string")
            .when(name.startswith("ARRAY"), "array").otherwise("object"))


def validate(messages: DataFrame, schemas: DataFrame) -> DataFrame:
    """Add `valid` and `canonical` (arguments with sorted keys and no spaces) to messages; both null for other messages than calls.

    `schemas` has a row per parameter: name, param, type (a JSON type), required. Arguments are valid
    if they are an object, the tool is known, every required parameter is there, every parameter is
    known and has its type; an integer is a number too. Text that is not JSON is not valid and has no
    canonical form. The schemas of a tool make one row, which its parameters bound.
    """
    tools = schemas.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("param", "type"))).alias("_types"), F.collect_list(
        F.when(F.col("required"), F.col("param"))).alias("_required"))
    parsed = messages.withColumn("_value", F.when(F.col("name").isNotNull(), F.try_parse_json("arguments")))
    joined = parsed.join(tools, "name", "left")
    given = F.from_json(F.to_json("_value"), "map<string,variant>")
    is_object = F.schema_of_variant("_value").startswith("OBJECT")

    def fits(key: Column, value: Column) -> Column:
        wanted = F.try_element_at("_types", key)
        return F.coalesce((_kind(value) == wanted) | ((_kind(value) == "integer") & (wanted == "number")), F.lit(False))

    right = F.size(F.map_filter("_given", lambda k, v: ~fits(k, v))) == 0
    complete = F.size(F.array_except("_required", F.map_keys("_given"))) == 0
    valid = F.coalesce(F.col("_types").isNotNull() & is_object & right & complete, F.lit(False))
    checked = joined.withColumn("_given", F.when(is_object, given))
    return checked.select(
        *messages.columns, F.when(F.col("name").isNotNull(), valid).alias("valid"), F.to_json("_value").alias("canonical"))


def _quoted(text: Column) -> Column:
    """A JSON string, or null."""
    inner = F.to_json(F.struct(text.alias("v")))
    return F.when(text.isNull(), "null").otherwise(F.substring(inner, F.lit(6), F.length(inner) - 6))


def serialise(messages: DataFrame) -> DataFrame:
    """Add `json`: the message as canonical JSON, keys in order and no spaces."""
    call = F.concat(F.lit('{"arguments":'), F.coalesce("canonical", _quoted(F.col("arguments"))), F.lit(',"content":'),
                    _quoted(F.col("content")), F.lit(',"id":'), _quoted(F.col("call_id")), F.lit(',"name":'),
                    _quoted(F.col("name")), F.lit(',"role":'), _quoted(F.col("role")), F.lit("}"))
    other = F.concat(F.lit('{"content":'), _quoted(F.col("content")), F.lit(',"role":'), _quoted(F.col("role")))
    result = F.concat(other, F.lit(',"tool_call_id":'), _quoted(F.col("call_id")), F.lit("}"))
    return messages.withColumn("json", F.when(F.col("name").isNotNull(), call).when(
        F.col("call_id").isNotNull(), result).otherwise(F.concat(other, F.lit("}"))))


def format_calls(messages: DataFrame, schemas: DataFrame) -> DataFrame:
    """Messages linked, validated, serialised and in order: by conversation, level and turn.

    A call has the level of its needs (`levels`), a result that of its call, another message level 0;
    a call on a cycle or behind one, and its result, has none and comes first. Within a level turns
    decide. A conversation of any size is sorted over partitions. Rows with null in any column are
    kept; repeated rows are kept; extra columns are dropped.
    """
    messages = store(link(messages.select(*MESSAGE)), "linked")
    ranked = messages.join(levels(messages), ["conv_id", "call_id"], "left").withColumn(
        "level", F.when(F.col("status").isin("plain", "orphan"), 0).otherwise(F.col("level")))
    done = serialise(validate(ranked, schemas))
    order = ["conv_id", "level", "turn", "call_id"]
    return done.repartitionByRange(*order).sortWithinPartitions(*order)
