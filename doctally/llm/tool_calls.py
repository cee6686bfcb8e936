"""Tool-call linking and chat formatting, in DataFrame operations only.

Calls and results are hash-joined by identifier. Calls may depend on an earlier call's result; their topological level is found by pointer doubling
along these dependencies (log2 of the longest chain rounds, each a join on a table in the shared folder), and a call on a cycle, or behind a
missing one, has the status `unordered`. Arguments are validated against the tool's schema (required, unknown and mistyped arguments), and everything is
serialised as canonical JSON: sorted keys, no white space.

One call and one result are linked for an identifier, the first of each by position; other calls are `duplicate_id`, other results `duplicate_result`, and a result without a call, or without
an identifier, is an `orphan_result`. So every call has a row and every result is in its call's row or has one of its own, no row holds a group, and identifiers and conversations may
have any share of the rows: groups are counted before they are shuffled, and the joins behind have one row an identifier on one side, which lets Spark split the other.

Nulls: a null identifier, tool or argument text makes a call invalid and keeps its row. Invalid JSON arguments are reported, not raised. Repeated rows (equal positions) are alike: if one
is linked, all are. Empty tables give empty results. Only the named columns are read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

#: Argument types of schemas and what they accept.
TYPES = {
    "string": "^STRING$",
    "integer": r"^(BIGINT|DECIMAL\(\d+,0\))$",
    "number": r"^(BIGINT|DOUBLE|DECIMAL\(\d+,\d+\))$",
    "boolean": "^BOOLEAN$",
    "array": "^ARRAY<",
    "object": "^OBJECT<",
    "null": "^VOID$",
}
#: Rows of a schema table that are sent to every executor at most (some 10 MB); a larger one is joined by a shuffle, every tool's calls in SALTS parts.
MAX_SCHEMA, SALTS = 100_000, 32


def canonical_json(text: Column) -> Column:
    """The JSON text with sorted keys and without white space; null if it is no JSON."""
    return F.to_json(F.try_parse_json(text))


def levels(calls: DataFrame) -> DataFrame:
    """(call_id, level) of calls (call_id, depends_on): 0 without dependency, one more than the call depended on; null on or behind a cycle or a missing call.

    Pointer doubling: each round every call's pointer jumps as far as all jumps before together.
    """
    now = materialise(calls.select("call_id", F.col("depends_on").alias("_to"), F.when(F.col("depends_on").isNull(), 0).otherwise(1).cast("long").alias("_far")))
    count, reach = now.count(), 1
    while now.where("_to is not null").limit(1).count() and reach <= 2 * count:
        other = now.select(F.col("call_id").alias("_to"), F.col("_to").alias("_next"), F.col("_far").alias("_more"), F.lit(True).alias("_there"))
        open_, closed = now.where("_to is not null"), now.where("_to is null")
        jumped = open_.join(other.hint("merge"), "_to", "left").select(
            "call_id",
            # a missing call keeps the pointer at itself for good: the chain never ends
            F.when(F.col("_there").isNull(), F.col("call_id")).otherwise(F.col("_next")).alias("_to"),
            (F.col("_far") + F.coalesce("_more", F.lit(0))).alias("_far"),
        )
        new = materialise(jumped.unionByName(closed))
        discard(now)
        now, reach = new, 2 * reach
    return now.select("call_id", F.when(F.col("_to").isNull(), F.col("_far")).alias("level"))


def _problems(arguments: Column, schema: Column) -> Column:
    """What is wrong with arguments (JSON text) under a schema (array of name, type, required), as sorted texts."""
    parsed = F.from_json(arguments, "map<string,variant>")
    kind = lambda name: F.schema_of_variant(F.element_at(parsed, name))
    has = lambda name: F.array_contains(F.map_keys(parsed), name)
    missing = F.transform(F.filter(schema, lambda s: s["required"] & ~has(s["name"])), lambda s: F.concat(F.lit("missing:"), s["name"]))
    names = F.transform(schema, lambda s: s["name"])
    unknown = F.transform(F.array_except(F.map_keys(parsed), names), lambda k: F.concat(F.lit("unknown:"), k))

    def wrong(s: Column) -> Column:
        fits = F.lit(False)
        for name, pattern in TYPES.items():
            fits = fits | ((s["type"] == name) & kind(s["name"]).rlike(pattern))
        return has(s["name"]) & ~fits

    mistyped = F.transform(F.filter(schema, wrong), lambda s: F.concat(F.lit("type:"), s["name"]))
    return F.array_sort(F.concat(missing, unknown, mistyped))


def _with_schemas(rows: DataFrame, schemas: DataFrame, most: int) -> DataFrame:
    """rows and _schema, the arguments of their tool."""
    tools = schemas.where("tool is not null").groupBy("tool").agg(F.array_sort(F.collect_list(F.struct("name", "type", "required"))).alias("_schema"))
    if schemas.count() <= most:
        return rows.join(F.broadcast(tools), "tool", "left")
    salted = tools.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("position"), F.lit(SALTS))).join(salted.hint("merge"), ["tool", "_salt"], "left").drop("_salt")


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame, max_schema: int = MAX_SCHEMA) -> DataFrame:
    """Calls with their results, levels, validation and canonical JSON, and the results that are linked to no call.

    calls: position (any sortable type), call_id, tool, arguments (JSON text), depends_on. results: position (of the same type), call_id, content. schemas: tool,
    name, type, required. Returns kind (call or result), position, call_id, tool, level, status (ok, invalid, duplicate_id, unordered, no_result; duplicate_result, orphan_result),
    problems (comma-joined), n_results and json.
    """
    calls = calls.select("position", "call_id", "tool", "arguments", "depends_on")
    results = results.select("position", "call_id", "content")
    first = calls.where("call_id is not null").groupBy("call_id").agg(F.min(F.struct("position", "depends_on")).alias("_f"))
    first = materialise(first.select("call_id", F.col("_f.position").alias("_first"), F.col("_f.depends_on").alias("depends_on")))
    level = levels(first.select("call_id", "depends_on"))
    answers = results.where("call_id is not null").groupBy("call_id").agg(F.min(F.struct("position", "content")).alias("_answer"), F.count(F.lit(1)).alias("_n"))
    facts = materialise(first.select("call_id", "_first").join(level, "call_id").join(answers, "call_id", "left"))
    rows = _with_schemas(calls.drop("depends_on").join(facts.hint("merge"), "call_id", "left"), schemas, max_schema)
    canonical = canonical_json(F.col("arguments"))
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json("arguments")).startswith("OBJECT"), F.lit(False))
    problems = (
        F.when(F.col("call_id").isNull(), F.array(F.lit("no id")))
        .when(F.col("_schema").isNull(), F.array(F.lit("unknown tool")))
        .when(~is_object, F.array(F.lit("arguments are no JSON object")))
        .otherwise(_problems(F.col("arguments"), F.col("_schema")))
    )
    rows = rows.withColumn("problems", F.array_join(problems, ",")).withColumn("_linked", F.coalesce(F.col("position") == F.col("_first"), F.lit(False)))
    n = F.when(F.col("_linked"), F.coalesce("_n", F.lit(0))).otherwise(0).cast("long")
    status = (
        F.when(F.col("call_id").isNotNull() & ~F.col("_linked"), "duplicate_id")
        .when(F.col("problems") != "", "invalid")
        .when(F.col("level").isNull(), "unordered")
        .when(n == 0, "no_result")
        .otherwise("ok")
    )
    quoted = lambda x: F.coalesce(F.regexp_extract(F.to_json(F.struct(x.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1), F.lit("null"))
    text = lambda x: F.when(x.isNull(), F.lit("null")).otherwise(quoted(x))
    json = lambda *fields: F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{k}":'), v) for k, v in fields)), F.lit("}"))
    answer = text(F.when(F.col("_linked"), F.col("_answer.content")))
    whole = json(("arguments", F.coalesce(canonical, text(F.col("arguments")))), ("id", text(F.col("call_id"))), ("name", text(F.col("tool"))), ("result", answer))
    linked = rows.select(
        F.lit("call").alias("kind"), "position", "call_id", "tool", F.when(F.col("_linked"), F.col("level")).alias("level"), status.alias("status"), "problems", n.alias("n_results"), whole.alias("json")
    )
    others = results.join(facts.select("call_id", F.col("_answer.position").alias("_taken")).hint("merge"), "call_id", "left").where("_taken is null or _taken != position")
    others = others.select(
        F.lit("result").alias("kind"), "position", "call_id", F.lit(None).cast("string").alias("tool"), F.lit(None).cast("long").alias("level"),
        F.when(F.col("_taken").isNull(), "orphan_result").otherwise("duplicate_result").alias("status"), F.lit("").alias("problems"), F.lit(0).cast("long").alias("n_results"),
        json(("content", text(F.col("content"))), ("id", text(F.col("call_id")))).alias("json"),
    )
    return linked.unionByName(others)


def exchanges(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as calls and results: every message that is not the assistant's calls the tool `reply` with its role, text and turn, the assistant's next turn is the
    result, and each call depends on the one two turns before, if there is one. A message without conversation or turn has no identifier."""
    number = lambda turn: F.concat(F.col("conv_id").cast("string"), F.lit(":"), turn.cast("string"))
    ours = messages.select("conv_id", "turn", "role", "text")
    place = F.struct("conv_id", "turn", F.coalesce("role", F.lit("")).alias("by"), F.coalesce("text", F.lit("")).alias("said")).alias("position")
    assistant = F.coalesce(F.col("role") == "assistant", F.lit(False))
    asked = ours.where(~assistant)
    earlier = materialise(asked.select(number(F.col("turn")).alias("depends_on")).where("depends_on is not null").distinct())
    calls = asked.select(
        place, number(F.col("turn")).alias("call_id"), F.lit("reply").alias("tool"), F.to_json(F.struct("turn", "text", "role")).alias("arguments"), number(F.col("turn") - 2).alias("_before")
    )
    calls = calls.join(earlier.hint("merge"), calls["_before"] == earlier["depends_on"], "left").drop("_before")
    results = ours.where(assistant).select(place, number(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def op9_tool_calls(spark, sf_dir):
    calls, results = exchanges(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    schema = [("reply", "role", "string", True), ("reply", "text", "string", True), ("reply", "turn", "integer", True)]
    linked = link(calls, results, spark.createDataFrame(schema, "tool string, name string, type string, required boolean"))
    role = F.when(F.col("kind") == "result", "assistant").otherwise(F.col("position.by")).alias("role")
    return linked.select("position.conv_id", "position.turn", role, "kind", "call_id", "level", "status", "problems", "n_results", "json")


ORACLE = r"""
WITH RECURSIVE m AS (SELECT conv_id, turn, role, text, coalesce(role, '') AS place, coalesce(text, '') AS said FROM conversations),
asked AS (SELECT *, conv_id || ':' || turn AS call_id FROM m WHERE place <> 'assistant'),
replied AS (SELECT *, conv_id || ':' || (turn - 1) AS call_id FROM m WHERE place = 'assistant'),
firsts AS (SELECT conv_id, turn, min((place, said)) AS f FROM asked WHERE call_id IS NOT NULL GROUP BY 1, 2),
chain AS (
    SELECT conv_id, turn, 0::BIGINT AS level FROM firsts x WHERE NOT EXISTS (SELECT 1 FROM firsts y WHERE y.conv_id = x.conv_id AND y.turn = x.turn - 2)
    UNION ALL SELECT x.conv_id, x.turn, c.level + 1 FROM firsts x JOIN chain c ON c.conv_id = x.conv_id AND c.turn = x.turn - 2),
answers AS (SELECT call_id, min(said) AS said, (min((said, text IS NOT NULL, coalesce(text, ''))))[2] AS there, count(*) AS n FROM replied WHERE call_id IS NOT NULL GROUP BY 1),
linked AS (SELECT a.*, c.level, r.said AS answer, r.there, r.n, coalesce((a.place, a.said) = f.f, false) AS l,
    CASE WHEN a.call_id IS NULL THEN 'no id' ELSE concat_ws(',', CASE WHEN role IS NULL THEN 'missing:role' END, CASE WHEN text IS NULL THEN 'missing:text' END) END AS problems
    FROM asked a LEFT JOIN firsts f ON f.conv_id = a.conv_id AND f.turn = a.turn LEFT JOIN chain c ON c.conv_id = a.conv_id AND c.turn = a.turn LEFT JOIN answers r ON r.call_id = a.call_id)
SELECT conv_id, turn, place AS role, 'call' AS kind, call_id, CASE WHEN l THEN level END AS level,
    CASE WHEN call_id IS NOT NULL AND NOT l THEN 'duplicate_id' WHEN problems <> '' THEN 'invalid' WHEN n IS NULL THEN 'no_result' ELSE 'ok' END AS status, problems,
    CASE WHEN l THEN coalesce(n, 0) ELSE 0 END AS n_results,
    '{"arguments":{' || concat_ws(',', '"role":' || to_json(role), '"text":' || to_json(text), '"turn":' || turn) || '},"id":' || coalesce(to_json(call_id), 'null') || ',"name":"reply","result":'
        || CASE WHEN l AND there THEN to_json(answer) ELSE 'null' END || '}' AS json FROM linked
UNION ALL SELECT r.conv_id, r.turn, 'assistant', 'result', r.call_id, NULL, CASE WHEN f.f IS NULL THEN 'orphan_result' ELSE 'duplicate_result' END, '', 0,
    '{"content":' || coalesce(to_json(r.text), 'null') || ',"id":' || coalesce(to_json(r.call_id), 'null') || '}'
    FROM replied r LEFT JOIN firsts f ON f.conv_id = r.conv_id AND f.turn = r.turn - 1 LEFT JOIN answers a ON a.call_id = r.call_id WHERE f.f IS NULL OR a.said <> r.said
"""
