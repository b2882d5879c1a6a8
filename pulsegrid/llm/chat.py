"""Chat formatting: tool calls linked with their results, ordered, validated and serialised.

Messages are rows; nothing is gathered by conversation, so one that holds a
third of all rows costs no more than its rows.
"""

from __future__ import annotations

import json
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import materialise


def canonical(value) -> str:
    """Canonical JSON: keys sorted, no blanks, whole floats as integers, no NaN."""

    def plain(v):
        if isinstance(v, float):
            if not math.isfinite(v):
                return None
            return int(v) if v.is_integer() and abs(v) < 2**53 else v
        if isinstance(v, dict):
            return {str(k): plain(x) for k, x in v.items()}
        return [plain(x) for x in v] if isinstance(v, list) else v

    text = json.dumps(plain(value), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    try:
        text.encode()
    except UnicodeEncodeError:  # half a surrogate pair has no UTF-8: written as its escape
        text = json.dumps(plain(value), sort_keys=True, separators=(",", ":"))
    return text


_KINDS = {"string": str, "boolean": bool, "array": list, "object": dict, "null": type(None)}


def _fits(value, kind: str) -> bool:
    if kind in ("integer", "number"):
        whole = isinstance(value, int) or (isinstance(value, float) and value.is_integer())
        return not isinstance(value, bool) and (whole or (kind == "number" and isinstance(value, float)))
    return isinstance(value, _KINDS[kind])


def checked_schema(schema: dict) -> dict:
    """The schema; ValueError if it names a type that JSON schemas don't have."""
    kinds = schema.get("type", [])
    for k in [kinds] if isinstance(kinds, str) else kinds:
        if k not in ("integer", "number", *_KINDS):
            raise ValueError(f"unknown type {k!r} in a schema")
    for inner in [*schema.get("properties", {}).values(), *schema.get("anyOf", []), *schema.get("allOf", []), *([schema["items"]] if isinstance(schema.get("items"), dict) else [])]:
        checked_schema(inner)
    return schema


def problem(value, schema: dict, at: str = "$") -> str | None:
    """First way in which a value breaks a JSON schema, or None.

    Checked: type, enum, const, required, properties, additionalProperties
    (false), items (one schema), minItems, maxItems, minLength, maxLength, pattern,
    minimum, maximum and their exclusive forms, anyOf, allOf; all else passes.
    """
    kinds = schema.get("type")
    if kinds is not None:
        kinds = [kinds] if isinstance(kinds, str) else kinds
        if not any(_fits(value, k) for k in kinds):
            return f"{at}: not {' or '.join(kinds)}"
    if ("enum" in schema and value not in schema["enum"]) or ("const" in schema and value != schema["const"]):
        return f"{at}: not one of the enum"
    for inner in schema.get("allOf", []):
        if found := problem(value, inner, at):
            return found
    if "anyOf" in schema and all(problem(value, inner, at) for inner in schema["anyOf"]):
        return f"{at}: none of anyOf"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        low, high = schema.get("exclusiveMinimum", -math.inf), schema.get("exclusiveMaximum", math.inf)
        if value < schema.get("minimum", -math.inf) or value > schema.get("maximum", math.inf) or not (low < value < high or low == -math.inf and high == math.inf):
            return f"{at}: out of bounds"
    if isinstance(value, str):
        if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", math.inf):
            return f"{at}: length"
        if "pattern" in schema and not re.search(schema["pattern"], value):
            return f"{at}: pattern"
    if isinstance(value, list):
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", math.inf):
            return f"{at}: number of items"
        for i, x in enumerate(value) if isinstance(schema.get("items"), dict) else ():
            if found := problem(x, schema["items"], f"{at}[{i}]"):
                return found
    if isinstance(value, dict):
        known = schema.get("properties", {})
        for k in schema.get("required", []):
            if k not in value:
                return f"{at}.{k}: missing"
        for k, x in value.items():
            if k in known:
                if found := problem(x, known[k], f"{at}.{k}"):
                    return found
            elif schema.get("additionalProperties", True) is False:
                return f"{at}.{k}: not allowed"
    return None


def references(value) -> list[str]:
    """Identifiers of the calls whose results arguments refer to: {"$ref": identifier} anywhere."""
    if isinstance(value, dict):
        if set(value) == {"$ref"} and isinstance(value["$ref"], str):
            return [value["$ref"]]
        return [r for x in value.values() for r in references(x)]
    return [r for x in value for r in references(x)] if isinstance(value, list) else []


_CALL = "call_id string, name string, arguments string, error string, refs array<string>"


def _checked(schemas: dict):
    columns = ["call_id", "name", "arguments", "error", "refs"]

    schemas = {k: checked_schema(v) for k, v in schemas.items()}
    plain = lambda x: x.encode("utf-8", "backslashreplace").decode()

    def one(name, text):
        try:
            value = json.loads(text or "{}", parse_constant=lambda c: None)
            error = problem(value, schemas[name]) if name in schemas else f"unknown tool {name}"
            return canonical(value), error and plain(error), sorted({plain(r) for r in references(value)})
        except ValueError:
            return text, "arguments are not JSON", []
        except RecursionError:
            return text, "arguments are nested too deeply", []

    def run(batches):
        for b in batches:
            done = [one(n, a) for n, a in zip(b.column("name").to_pylist(), b.column("arguments").to_pylist())]
            arrays = [pa.array(c, t) for c, t in zip(zip(*done) if done else [[]] * 3, (pa.string(), pa.string(), pa.list_(pa.string())))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("conv_id", "turn", "call_id", "name")), *arrays], names=["conv_id", "turn", *columns])

    return run


def order_calls(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """calls (conv_id, turn, call_id) with level, the length of the longest chain of references before a call; null in or after a cycle.

    edges: (conv_id, call_id, needs) between calls of one conversation.  Calls
    without references are at level 0.  A call is at the highest of level(needs)
    + w over its references.  In each round a reference to a call that has one
    reference itself, or none left, is put through to what that one needs; so
    a chain takes as many rounds as its length has binary digits, and any
    other order one a level at most.  In a round that settles nothing, all
    that is left is in or after a cycle.
    """
    key = ["conv_id", "call_id"]
    edges = materialise(edges.select(*key, "needs").distinct(), "references")
    heads = edges.select(*key).distinct()
    referring = heads.select("conv_id", F.col("call_id").alias("needs"), F.lit(True).alias("refers"))
    # rows (needs, w): level is at least level(needs) + w, or w where needs is null
    left = edges.join(referring, ["conv_id", "needs"], "left").select(*key, F.when(F.col("refers"), F.col("needs")).alias("needs"), F.lit(1).cast("long").alias("w"))
    left = materialise(left.groupBy(*key, "needs").agg(F.max("w").alias("w")), "open")
    settled = 0
    while True:
        known = F.max(F.when(F.col("needs").isNull(), F.col("w"))).alias("known")
        one = left.groupBy(*key).agg(F.count("needs").alias("n"), F.max("needs").alias("to"), F.max(F.when(F.col("needs").isNotNull(), F.col("w"))).alias("by"), known).where("n <= 1")
        one = materialise(one, "put-through")
        found = one.where("n = 0").select(*key, F.col("known").cast("int").alias("level"))
        before, settled = settled, found.count()
        if settled == before:
            break
        of = one.select("conv_id", F.col("call_id").alias("needs"), "n", "to", "by", "known")
        # lengths in cycles grow for ever; no chain is longer than the cap
        add = lambda c: F.least(F.col("w") + F.col(c), F.lit(1 << 40))
        on = F.when(F.col("by").isNotNull(), F.struct(F.col("to").alias("needs"), add("by").alias("w")))
        end = F.when(F.col("known").isNotNull(), F.struct(F.lit(None).cast("string").alias("needs"), add("known").alias("w")))
        put = F.when(F.col("n").isNull(), F.array(F.struct("needs", "w"))).otherwise(F.filter(F.array(on, end), lambda x: x.isNotNull()))
        following = left.join(of, ["conv_id", "needs"], "left").select(*key, F.explode(put).alias("x"))
        left = materialise(following.groupBy(*key, F.col("x.needs").alias("needs")).agg(F.max("x.w").alias("w")), "open")
    stuck = heads.withColumn("stuck", F.lit(True))
    out = calls.join(found, key, "left").join(stuck, key, "left")
    return out.withColumn("level", F.when(F.col("level").isNotNull(), F.col("level")).when(F.col("stuck").isNull(), F.lit(0))).drop("stuck")


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict) -> DataFrame:
    """One row a call: conv_id, call_id, turn, level, status, error, n_results, message.

    calls: (conv_id, turn, call_id, name, arguments: JSON); results: (conv_id,
    turn, call_id, content); schemas: JSON schema of each tool's arguments.
    Calls and results are joined by conversation and identifier.  Of several
    results the one of the first turn (then the smallest content) counts; of
    several calls with one identifier each is a row.  status: ok, unanswered,
    invalid (arguments break the schema, or the tool is unknown), unresolved (a
    reference to no call of the conversation) or cyclic, the first that holds
    of invalid, unresolved, cyclic, unanswered.  Order within a conversation:
    level, turn, call_id.  message: canonical JSON of call and result.  Rows
    with a null conv_id or call_id link with nothing and refer to nothing.
    Arguments that are not JSON, or nested more deeply than Python's recursion
    goes, are invalid and appear as text.  A schema with an unknown type is a
    ValueError before anything runs.
    """
    given = calls.select("conv_id", F.col("turn").cast("long"), F.col("call_id").cast("string"), F.col("name").cast("string"), F.col("arguments").cast("string"))
    kind = calls.schema["conv_id"].dataType.simpleString()
    checked = materialise(given.mapInArrow(_checked(schemas), f"conv_id {kind}, turn long, {_CALL}"), "calls")
    # an unbounded number of results of one identifier is one row after the partial aggregate
    first = results.where("call_id is not null and conv_id is not null").groupBy("conv_id", F.col("call_id").cast("string").alias("call_id")).agg(
        F.min(F.struct(F.col("turn").cast("long").alias("turn"), F.col("content").cast("string").alias("content"))).alias("r"), F.count("*").alias("n")
    )
    known = checked.select("conv_id", "call_id").where("call_id is not null").distinct()
    edges = checked.where(F.size("refs") > 0).select("conv_id", "call_id", F.explode("refs").alias("needs"))
    real = edges.join(known.withColumnRenamed("call_id", "needs"), ["conv_id", "needs"], "left_semi")
    dangling = edges.join(known.withColumnRenamed("call_id", "needs"), ["conv_id", "needs"], "left_anti").select("conv_id", "call_id").distinct().withColumn("dangling", F.lit(True))
    ordered = order_calls(checked, real)
    out = ordered.join(first, ["conv_id", "call_id"], "left").join(dangling, ["conv_id", "call_id"], "left")
    status = (
        F.when(F.col("error").isNotNull(), "invalid").when(F.col("dangling"), "unresolved").when(F.col("level").isNull(), "cyclic").when(F.col("n").isNull(), "unanswered").otherwise("ok")
    )
    out = out.withColumn("status", status)
    columns = ["call_id", "name", "arguments", "level", "turn", "status"]

    def serialise(batches):
        for b in batches:
            rows = b.to_pylist()
            text = []
            for r in rows:
                body = {c: r[c] for c in columns}
                if r["content"] is not None:
                    body["result"] = r["content"]
                try:
                    text.append(canonical(body | {"arguments": json.loads(r["arguments"] or "{}")}))
                except (ValueError, RecursionError):
                    text.append(canonical(body))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("conv_id", "call_id", "turn", "level", "status", "error", "n_results")), pa.array(text, pa.string())], names=["conv_id", "call_id", "turn", "level", "status", "error", "n_results", "message"])

    flat = out.select("conv_id", "call_id", "name", "arguments", "turn", "level", "status", "error", F.coalesce("n", F.lit(0)).alias("n_results"), F.col("r.content").alias("content"))
    return flat.mapInArrow(serialise, f"conv_id {kind}, call_id string, turn long, level int, status string, error string, n_results long, message string")


def dialogue_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) of a table of plain turns (conv_id, turn, role, text).

    Every turn of a user is a call of the tool "respond", identified by its
    turn, with the text as argument and a reference to the call two turns
    before if that is a user's too, so a chain is as long as its conversation;
    the next turn is its result if an assistant's.  Repeated rows are one.
    """
    turns = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").where("conv_id is not null and turn is not null").distinct()
    name = lambda t: F.concat(F.lit("turn-"), t.cast("string"))
    asks = turns.where("role = 'user'")
    prior = asks.select("conv_id", (F.col("turn") + 2).alias("turn")).distinct().withColumn("follows", F.lit(True))
    asks = asks.join(prior, ["conv_id", "turn"], "left")
    arguments = F.to_json(
        F.struct(F.coalesce("text", F.lit("")).alias("text"), F.when(F.col("follows"), F.struct(name(F.col("turn") - 2).alias("$ref"))).alias("after"))
    )
    calls = asks.select("conv_id", "turn", name(F.col("turn")).alias("call_id"), F.lit("respond").alias("name"), arguments.alias("arguments"))
    results = turns.where("role = 'assistant'").select("conv_id", "turn", name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


#: Schema of the tool that dialogue_calls() uses.
RESPOND = {"type": "object", "required": ["text"], "additionalProperties": False, "properties": {"text": {"type": "string"}, "after": {"type": "object"}}}
