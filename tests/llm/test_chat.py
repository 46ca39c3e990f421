import json

from dpmine.llm import chat

TOOLS = [("f", [("a", "integer", True), ("b", "string", False), ("c", "array", False), ("d", "number", False)], True),
         ("g", [("o", "object", True), ("n", "null", False), ("t", "boolean", False)], False)]
CALLS = "conv_id long, call_id string, place long, name string, arguments string, depends_on array<string>"
RESULTS = "conv_id long, call_id string, content string"


def run(spark, calls, results):
    found = chat.format_tool_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS),
                                   spark.createDataFrame(TOOLS, chat.SCHEMA_COLUMNS))
    assert "Python" not in found._jdf.queryExecution().toString() and "Arrow" not in found._jdf.queryExecution().toString()
    return found.collect()


def test_validation_and_canonical_json(spark):
    cases = {
        '{"b": "x", "a": 1}': [], '{"a": 1.0}': [], '{"a": 1.5, "d": 2}': ["type:a"], '{"a":"1","z":0,"y":0}': ["type:a", "extra:y", "extra:z"],
        '{"b":"x"}': ["missing:a"], '[1]': ["not_an_object"], '{"a": 1': ["not_an_object"], None: ["not_an_object"], '': ["not_an_object"],
        '{"a":1,"b":null,"c":[1,"x"],"d":1e400}': ["type:b"], '{"a": 12345678901, "c": {}}': ["type:c"]}
    calls = [(1, f"c{i}", i, "f", text, None) for i, text in enumerate(cases)]
    calls += [(1, "g1", 50, "g", '{"t":true,"o":{"z":1,"a":[{"y":2,"b":"é\\n"}]},"n":null,"more":1}', []), (1, "h", 51, "nope", "{}", None)]
    got = {r.call_id: r for r in run(spark, calls, [(1, c[1], "ok") for c in calls])}
    for (text, want), c in zip(cases.items(), calls):
        if text and "1e400" in text:
            assert "type:b" in got[c[1]].errors or got[c[1]].errors == ["not_an_object"]
        else:
            assert got[c[1]].errors == want, text
    assert got["g1"].errors == [] and got["h"].errors == ["unknown_tool"]
    assert got["g1"].json.startswith('{"arguments":{"more":1,"n":null,"o":{"a":[{"b":"é\\n","y":2}],"z":1},"t":true},"call_id":"g1"')
    assert json.loads(got["c0"].json) == {"arguments": {"a": 1, "b": "x"}, "call_id": "c0", "conv_id": 1, "depends_on": [],
                                          "errors": [], "level": 0, "name": "f", "result": "ok"}


def test_linking(spark):
    ok = '{"a":1}'
    calls = [(1, "x", 0, "f", ok, None), (1, "y", 1, "f", ok, ["x", "gone", None]), (1, "y", 0, "f", ok, []), (2, "x", None, "f", ok, None),
             (None, "x", 0, "f", ok, None), (1, None, 3, "f", ok, None), (None, "x", 0, "f", ok, None)]
    results = [(1, "x", "b"), (1, "x", "a"), (1, "z", "lost"), (None, "x", "r"), (2, "x", None)]
    rows = run(spark, calls, results)
    got = {(r.conv_id, r.call_id): r for r in rows if r.conv_id and r.call_id}
    assert got[1, "x"].errors == ["duplicate_result"] and json.loads(got[1, "x"].json)["result"] == "a"
    assert got[1, "y"].errors == ["no_result", "duplicate_call"] and got[1, "y"].place == 0
    assert got[1, "z"].errors == ["no_call"] and got[2, "x"].errors == [] and got[2, "x"].level is None
    assert len(rows) == 4 + 3 + 1


def test_order(spark):
    ok = '{"a":1}'
    chain = [(1, f"c{i}", 100 - i, "f", ok, [f"c{i - 1}"] if i else []) for i in range(6)]         # places run backwards
    good = [(2, f"c{i}", i, "f", ok, [f"c{j}" for j in range(i)]) for i in range(5)]
    loop = [(3, "a", 0, "f", ok, ["b"]), (3, "b", 1, "f", ok, ["a"]), (3, "c", 2, "f", ok, ["b"]), (3, "d", 3, "f", ok, [])]
    own = [(4, "a", 0, "f", ok, ["a"])]
    rows = run(spark, chain + good + loop + own, [])
    level = {(r.conv_id, r.call_id): r.level for r in rows}
    assert [level[1, f"c{i}"] for i in range(6)] == list(range(6))
    assert [level[2, f"c{i}"] for i in range(5)] == list(range(5))
    assert level[3, "d"] == 0 and all(level[3, c] is None for c in "abc") and level[4, "a"] is None
    assert all(("cycle" in r.errors) == (r.level is None) for r in rows)


def test_empty_and_odd_tables(spark):
    assert run(spark, [], []) == []
    assert [r.errors for r in run(spark, [], [(1, "x", "y")])] == [["no_call"]]
    turns = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "r"), (None, 0, "user", "q"),
                                   (2, None, "user", None), (3, 0, "user", ""), (3, 0, "user", ""), (None, None, None, None)],
                                  "conv_id long, turn long, role string, text string")
    calls, results = chat.calls_of_conversations(turns)
    rows = chat.format_tool_calls(calls, results, spark.createDataFrame(TOOLS, chat.SCHEMA_COLUMNS)).collect()
    assert {(r.conv_id, r.call_id, r.n_calls, r.n_results) for r in rows} == {
        (1, "call_1_1", 1, 1), (None, None, 1, 0), (2, None, 1, 0), (3, "call_3_0", 2, 0)}
