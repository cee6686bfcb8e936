import json

import duckdb

from doctally.llm import tool_calls as C


def frames(spark):
    calls = [
        (1, "a", "add", '{"y": 2, "x": 1}', None), (2, "b", "add", '{"x": 1.5, "y": 2}', "a"), (3, "c", "add", '{"x": 1}', "b"), (4, "a", "add", '{"x":1,"y":1}', None), (5, "d", "add", "not json", None),
        (6, "e", "nope", "{}", None), (7, None, "add", "{}", None), (8, "f", "add", '{"x":1,"y":2,"z":3}', "g"), (9, "g", "add", '{"x":1,"y":2}', "f"), (10, "h", "add", '{"x":1,"y":2}', "gone"), (11, "i", "add", None, None), (12, "j", None, "[1]", "c"),
    ]
    results = [(20, "a", "3"), (21, "a", None), (22, "b", 'say "hi"\n'), (23, None, "x"), (24, "zz", "x"), (25, "c", "é")]
    schemas = [("add", "x", "integer", True), ("add", "y", "number", True)]
    return (
        spark.createDataFrame(calls, "position int, call_id string, tool string, arguments string, depends_on string"),
        spark.createDataFrame(results, "position int, call_id string, content string"),
        spark.createDataFrame(schemas, "tool string, name string, type string, required boolean"),
    )


def test_linking(spark):
    calls, results, schemas = frames(spark)
    rows = C.link(calls.withColumn("level", calls["tool"]), results, schemas).collect()
    got = {r["position"]: r for r in rows if r["kind"] == "call"}
    assert len(got) == 12 and len(rows) == 15
    # 20, 22 and 25 are in their calls' rows
    assert {r["position"]: (r["status"], r["json"]) for r in rows if r["kind"] == "result"} == {
        21: ("duplicate_result", '{"content":null,"id":"a"}'), 23: ("orphan_result", '{"content":"x","id":null}'), 24: ("orphan_result", '{"content":"x","id":"zz"}'),
    }
    by_shuffle = C.link(calls, results, schemas, max_schema=1).collect()
    assert sorted(map(repr, by_shuffle)) == sorted(map(repr, rows))
    assert {k: r["status"] for k, r in got.items()} == {
        1: "ok", 2: "invalid", 3: "invalid", 4: "duplicate_id", 5: "invalid", 6: "invalid", 7: "invalid", 8: "invalid", 9: "unordered", 10: "unordered", 11: "invalid", 12: "invalid",
    }
    assert [got[k]["level"] for k in (1, 2, 3, 12, 9, 10)] == [0, 1, 2, 3, None, None]
    assert [got[k]["problems"] for k in (2, 3, 6, 7, 8)] == ["type:x", "missing:y", "unknown tool", "no id", "unknown:z"]
    assert got[1]["json"] == '{"arguments":{"x":1,"y":2},"id":"a","name":"add","result":"3"}' and got[1]["n_results"] == 2
    assert json.loads(got[2]["json"])["result"] == 'say "hi"\n' and json.loads(got[11]["json"])["arguments"] is None
    assert all(json.loads(r["json"]) is not None for r in got.values())


def test_long_chains(spark):
    calls = spark.createDataFrame([(str(i), str(i - 1) if i else None) for i in range(300)], "call_id string, depends_on string")
    assert {int(r["call_id"]): r["level"] for r in C.levels(calls).collect()} == {i: i for i in range(300)}


def test_conversations_equal_sql(spark, stored, tmp_path):
    rows = [(1, 0, "system", "s"), (1, 1, "user", 'é "q" \\ /\t'), (1, 2, "assistant", "a"), (1, 3, "user", ""), (1, 4, "assistant", None), (2, 0, "user", "x"), (2, 0, "user", "x2"), (2, 1, "assistant", "y"), (None, 1, "user", "z"), (3, 5, None, None)]
    rows += [(4, 0, "assistant", "opening"), (4, 1, "user", None), (4, 2, "assistant", "b"), (4, 2, "assistant", "a"), (4, 3, "assistant", "c"), (5, None, "user", "q"), (5, None, "assistant", "q"), (None, None, None, None), (2, 1, "assistant", "y")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    sf = stored(conversations=table.withColumn("level", table["role"]))
    found = C.op9_tool_calls(spark, sf)
    names = sorted(found.columns)
    c = duckdb.connect()
    c.sql(f"create view conversations as select * from '{sf}/conversations.parquet/*.parquet'")
    rows = c.execute(C.ORACLE)
    at = [[d[0] for d in rows.description].index(n) for n in names]
    got = found.collect()
    assert sorted(repr(tuple(r[n] for n in names)) for r in got) == sorted(repr(tuple(r[i] for i in at)) for r in rows.fetchall())
    # straight from the definition: each message is a call, or a result in its call's row or its own
    state = {(r["conv_id"], r["turn"], r["role"], r["status"], r["problems"], r["level"], r["n_results"]) for r in got}
    assert len(got) == len(table.collect()) - 5 and state >= {
        (None, 1, "user", "invalid", "no id", None, 0), (5, None, "user", "invalid", "no id", None, 0), (5, None, "assistant", "orphan_result", "", None, 0), (4, 0, "assistant", "orphan_result", "", None, 0),
        (4, 1, "user", "invalid", "missing:text", 0, 2), (4, 2, "assistant", "duplicate_result", "", None, 0), (4, 3, "assistant", "orphan_result", "", None, 0), (2, 0, "user", "duplicate_id", "", None, 0),
        (2, 0, "user", "ok", "", 0, 2), (1, 3, "user", "ok", "", 1, 1), (3, 5, "", "invalid", "missing:role,missing:text", 0, 0), (None, None, "", "invalid", "no id", None, 0), (1, 0, "system", "no_result", "", 0, 0),
    }
    assert C.op9_tool_calls(spark, stored(conversations=table.limit(0))).count() == 0


def test_empty(spark):
    calls, results, schemas = (f.limit(0) for f in frames(spark))
    assert C.link(calls, results, schemas).count() == 0
