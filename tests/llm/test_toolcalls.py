import json

from tidegrid.llm import toolcalls

SCHEMAS = {"add": {"a": ("BIGINT", True), "b": ("BIGINT", False)}, "reply": {"text": ("STRING", True)}}


def call(*calls):
    return json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in calls]})


def result(i, content="done"):
    return json.dumps({"tool_call_id": i, "content": content})


def linked(spark, rows, **more):
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, kind string, place int")
    return sorted(toolcalls.link(frame, schemas=SCHEMAS, **more).collect(), key=lambda r: (r["conv_id"] is not None, r["conv_id"], r["position"]))


def test_calls_results_and_schemas(spark):
    out = linked(spark, [
        (1, 0, "system", "be brief"), (1, 1, "user", "add"), (1, 2, "assistant", call(("x", "add", '{"b": 2, "a":1}'), ("y", "add", '{"a":"1"}'), ("z", "fly", "{}"))),
        (1, 3, "tool", result("y")), (1, 4, "tool", result("x", "3")), (1, 5, "tool", result("q")), (1, 6, "assistant", "it is 3"),
    ])
    by = {(r["kind"], r["call_id"]): r for r in out}
    assert [r["position"] for r in out] == list(range(len(out)))
    assert by["call", "x"]["linked"] and by["call", "x"]["valid"] and json.loads(by["call", "x"]["json"])["arguments"] == {"a": 1, "b": 2}
    assert by["call", "x"]["json"] == '{"arguments":{"a":1,"b":2},"id":"x","name":"add","type":"call"}'
    assert by["call", "y"]["problem"] == "argument of another type" and by["call", "z"]["problem"] == "unknown tool" and not by["call", "z"]["linked"]
    assert by["result", "q"]["problem"] == "result without call"
    assert by["result", "turn-1"]["linked"] and by["call", "turn-1"]["linked"]
    assert by["result", "x"]["position"] > by["call", "x"]["position"]


def test_order_follows_what_calls_need(spark):
    needs = '{"a": "$result:late"}'
    out = linked(spark, [(1, 0, "assistant", call(("early", "add", needs))), (1, 1, "tool", result("early")), (1, 2, "assistant", call(("late", "add", '{"a": 1}'))), (1, 3, "tool", result("late")), (1, 4, "user", "so?")])
    at = {(r["kind"], r["call_id"]): r["position"] for r in out}
    assert at["call", "late"] < at["result", "late"] < at["call", "early"] < at["result", "early"]


def test_circles_and_odd_rows(spark):
    out = linked(spark, [
        (1, 0, "assistant", call(("a", "add", '{"a": "$result:b"}'), ("b", "add", '{"a": "$result:a"}'))), (2, None, None, None), (2, 1, "user", None), (2, 1, "user", None), (None, 0, "user", "hi"), (None, 1, "assistant", "ho"), (3, 0, "assistant", "{not json"), (3, 1, "tool", "{}"),
    ])
    problems = {(r["conv_id"], r["call_id"]): r["problem"] for r in out}
    assert problems[1, "a"] == problems[1, "b"] == "circle of calls"
    assert len(out) == 9 and sum(r["problem"] == "unknown role" for r in out) == 1
    assert [r["linked"] for r in out if r["conv_id"] is None] == [True, True]


def test_empty(spark):
    assert linked(spark, []) == []
