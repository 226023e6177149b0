"""Tool-call linking: results by identifier, topological order, argument schemas, canonical JSON; all in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.store import stored

Schema = dict[str, tuple[str, bool]]  # field: (type, required)
# How a variant's own type is named, for each type that a schema may ask for.
TYPES = {"string": "STRING", "integer": "BIGINT", "number": "(BIGINT|DOUBLE|FLOAT|DECIMAL.*)", "boolean": "BOOLEAN", "array": "ARRAY<.*", "object": "OBJECT<.*"}


def json_text(value: Column) -> Column:
    """A JSON string, null for null."""
    inner = F.to_json(F.array(value.cast("string")))
    return F.when(value.isNull(), "null").otherwise(F.substring(inner, F.lit(2), F.length(inner) - 2))


def _fits(arguments: Column, schema: Schema) -> Column:
    """Whether parsed arguments are an object with the required fields, every known field of its type and no other field."""
    checks = [F.schema_of_variant(arguments).rlike("^OBJECT<")]
    for field, (kind, required) in schema.items():
        value = F.try_variant_get(arguments, f"$['{field}']", "variant")
        missing = value.isNull() | F.is_variant_null(value)
        right = F.schema_of_variant(value).rlike(f"^{TYPES[kind]}$")
        checks.append(F.when(missing, F.lit(not required)).otherwise(right))
    keys = F.json_object_keys(F.to_json(arguments))
    checks.append(F.size(F.array_except(keys, F.array(*map(F.lit, schema)))) == 0)
    out = checks[0]
    for check in checks[1:]:
        out = out & F.coalesce(check, F.lit(False))
    return F.coalesce(out, F.lit(False))


def positions(calls: DataFrame) -> DataFrame:
    """``calls`` (conv_id, call_id, after) with ``position``, 1 for a call that waits for none, else one more than that of
    the call it waits for; null if it waits for itself in a circle or for a call that isn't there.

    Every call jumps to the call it waits for, then by twice as many calls a round, so the rounds grow with the
    logarithm of the longest chain and a conversation of any length is no group of its own.
    """
    ids = calls.select("conv_id", F.col("call_id").alias("jump"), F.lit(True).alias("there"))
    nodes = calls.select("conv_id", "call_id", F.col("after").alias("jump")).join(ids, ["conv_id", "jump"], "left")
    lost = F.col("jump").isNotNull() & F.col("there").isNull()
    nodes = stored(nodes.select("conv_id", "call_id", F.when(~lost, F.col("jump")).alias("jump"), F.lit(1).alias("position"), lost.alias("lost")), "chain")
    total, moving = nodes.agg(F.count("*"), F.count("jump")).first()
    for _ in range(math.ceil(math.log2(total + 1)) + 1):
        if not moving:
            break
        target = nodes.select("conv_id", F.col("call_id").alias("jump"), F.col("jump").alias("next"), F.col("position").alias("more"), F.col("lost").alias("astray"))
        done, left = nodes.where("jump IS NULL"), nodes.where("jump IS NOT NULL")
        left = left.join(target, ["conv_id", "jump"]).select("conv_id", "call_id", F.col("next").alias("jump"), (F.col("position") + F.col("more")).alias("position"), (F.col("lost") | F.col("astray")).alias("lost"))
        nodes = stored(done.unionByName(left), "chain")
        moving = nodes.agg(F.count("jump")).first()[0]
    stuck = F.col("lost") | F.col("jump").isNotNull()
    return nodes.select("conv_id", "call_id", F.when(~stuck, F.col("position")).alias("position"))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, Schema]) -> DataFrame:
    """(conv_id, call_id, position, status, record) of every distinct call.

    ``calls`` has conv_id, call_id, name, arguments (JSON text) and after (the call it waits for, or null); ``results``
    has conv_id, call_id and content. The status is the first that holds: ``unlinkable`` (a null conversation or call
    id), ``duplicate`` (the id was used more than once), ``blocked`` (no topological position), ``unknown_tool``,
    ``invalid_arguments`` (not the JSON object its schema asks for; a null or broken text), ``no_result``, else ``ok``.
    Of calls or results that share an identifier the smallest counts, so a repeated identifier multiplies nothing.
    The record is canonical JSON: keys sorted, no blanks, arguments parsed and written anew the same way. Results
    without a call are left out. Empty tables give no rows; other columns are not read.

    All joins are equality joins on (conversation, call); nothing of a conversation is gathered in one row.
    """
    key = ["conv_id", "call_id"]
    one = calls.groupBy(key).agg(F.min(F.struct("name", "arguments", "after")).alias("c"), F.count("*").alias("uses"))
    one = stored(one.select(*key, "c.*", "uses"), "calls")
    got = results.groupBy(key).agg(F.min("content").alias("content"), F.lit(True).alias("answered"))
    known = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    placed = positions(one.where(known))
    rows = one.join(placed, key, "left").join(got, key, "left").withColumn("parsed", F.try_parse_json("arguments"))
    valid = F.lit(False)
    for name, schema in schemas.items():
        valid = F.when(F.col("name") == name, _fits(F.col("parsed"), schema)).otherwise(valid)
    status = (
        F.when(~known, "unlinkable")
        .when(F.col("uses") > 1, "duplicate")
        .when(F.col("position").isNull(), "blocked")
        .when(~F.coalesce(F.col("name").isin(*schemas), F.lit(False)), "unknown_tool")
        .when(~valid, "invalid_arguments")
        .when(F.col("answered").isNull(), "no_result")
        .otherwise("ok")
    )
    rows = rows.withColumn("status", status)
    fields = [
        ("after", json_text(F.col("after"))), ("arguments", F.coalesce(F.to_json("parsed"), json_text(F.col("arguments")))), ("call", json_text(F.col("call_id"))),
        ("position", F.coalesce(F.col("position").cast("string"), F.lit("null"))), ("result", json_text(F.col("content"))),
        ("status", json_text(F.col("status"))), ("tool", json_text(F.col("name"))),
    ]
    parts = [p for i, (name, value) in enumerate(fields) for p in (F.lit(("," if i else "{") + f'"{name}":'), value)]
    return rows.select(*key, F.col("position").cast("long").alias("position"), "status", F.concat(*parts, F.lit("}")).alias("record"))


def calls_of_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain conversations: each user turn asks the tool ``reply`` with its text and turn, after
    the user turn two before it if there is one; the assistant turn that follows is its result."""
    name = lambda turn: F.concat(F.lit("call-"), turn.cast("string"))
    asked = turns.where("role = 'user'")
    earlier = asked.select("conv_id", (F.col("turn") + 2).alias("turn"), F.lit(True).alias("has")).distinct()
    asked = asked.join(earlier, ["conv_id", "turn"], "left")
    arguments = F.to_json(F.struct(F.col("text").alias("query"), "turn"), {"ignoreNullFields": "false"})
    calls = asked.select("conv_id", name(F.col("turn")).alias("call_id"), F.lit("reply").alias("name"), arguments.alias("arguments"), F.when(F.col("has"), name(F.col("turn") - 2)).alias("after"))
    results = turns.where("role = 'assistant'").select("conv_id", name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


REPLY: dict[str, Schema] = {"reply": {"query": ("string", True), "turn": ("integer", True)}}
