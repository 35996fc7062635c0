"""Tool-call linking: against a plain reading in Python, canonical JSON, schemas and edge cases."""

import json
import random
from collections import defaultdict

import pytest

from lexlab.llm import chat as C
from tests.conftest import SF_SMALL

CALL = "conv_id long, turn long, call_id string, name string, arguments string, level int"
RESULT = "conv_id long, turn long, call_id string, content string, status string"
ANY = {"t": {"type": "object"}}


def ref(*ids):
    return json.dumps({"needs": [{"$ref": i} for i in ids]})


def brute(calls, results):
    """(kind, conv, turn, id) -> (status, other turn, level, in cycle), for ids that are not repeated."""
    by_c, by_r, out = {}, {}, {}
    for conv, turn, cid, name, args in sorted(calls, key=lambda x: x[1]):
        by_c.setdefault((conv, cid), (turn, args))
    for conv, turn, cid, _ in sorted(results, key=lambda x: x[1]):
        by_r.setdefault((conv, cid), turn)
    needs = {k: [(k[0], r) for r in C.references(json.loads(a)) if (k[0], r) in by_c] for k, (_, a) in by_c.items()}
    level, changed = {}, True
    while changed:
        changed = False
        for k, n in needs.items():
            if k not in level and all(x in level for x in n):
                level[k] = 1 + max((level[x] for x in n), default=-1)
                changed = True
    for k, (turn, _) in by_c.items():
        r = by_r.get(k)
        out["call", k[0], turn, k[1]] = ("linked", r, level.get(k), k not in level) if r is not None and r >= turn else (
            "no_result", None, level.get(k), k not in level)
    for k, turn in by_r.items():
        c = by_c.get(k)
        ok = c is not None and c[0] <= turn
        out["result", k[0], turn, k[1]] = ("linked", c[0], level.get(k), False) if ok else ("orphan", None, None, False)
    return out


def test_whole_table(spark):
    conv = spark.read.parquet(f"{SF_SMALL}/conversations.parquet")
    calls, results = C.events(conv)
    rows = C.link_tool_calls(calls, results, C.SCHEMAS).collect()
    want = brute([tuple(r)[:5] for r in calls.collect()], [tuple(r) for r in results.collect()])
    got = {(r["kind"], r["conv_id"], r["turn"], r["call_id"]): (r["status"], r["other_turn"], r["level"], r["in_cycle"]) for r in rows}
    assert got == want and len(rows) == len(want)
    assert {s for s, *_ in want.values()} >= {"linked", "no_result"}
    assert max(x[2] or 0 for x in want.values()) >= 1
    for r, args in ((r, json.loads(r["json"])) for r in rows if r["kind"] == "call"):
        assert r["json"] == C.canonical(args)
        assert r["valid"] == (not r["errors"])
        assert [e for e in r["errors"].split("; ") if e and not e.startswith("no call")] == C.problems(
            args["arguments"], C.SCHEMAS[args["name"]])


def test_order_cycles_duplicates_and_nulls(spark):
    calls = [(1, 1, "a", "t", "{}"), (1, 2, "b", "t", ref("a")), (1, 3, "c", "t", ref("a", "b")), (1, 3, "d", "t", ref("c", "zz")),
             (2, 1, "a", "t", ref("b")), (2, 2, "b", "t", ref("a")), (2, 3, "c", "t", ref("b")), (2, 4, "self", "t", ref("self")),
             (3, 1, "x", "t", "{}"), (3, 5, "x", "t", ref("x")), (3, 6, None, "t", "{}"), (None, 1, "n", "t", "{}"),
             (4, 1, "bad", "t", "{"), (4, 2, "null", "t", None), (4, 3, "tool", "u", "{}"), (4, 4, "list", "t", "[1]")]
    results = [(1, 2, "a", "r"), (1, 9, "d", None), (3, 2, "x", "r"), (3, 2, "x", "r"), (3, 3, None, "r"), (None, 2, "n", ""),
               (5, 1, "lost", "r"), (1, 1, "c", "too early"), (2, 2, "a", "x" * 300_000)]
    both = [C.link_tool_calls(spark.createDataFrame([(*c, 7) for c in calls], CALL),
                              spark.createDataFrame([(*r, "clash") for r in results], RESULT), ANY, in_task=n).collect()
            for n in (10_000, 1)]
    rows = both[0]
    assert sorted(map(repr, both[0])) == sorted(map(repr, both[1]))  # sorted in a task or by rounds
    assert len(rows) == len(calls) + len(results)
    call = defaultdict(list)
    for r in rows:
        call[r["kind"], r["conv_id"], r["call_id"]].append(r)
    one = {k: v[0] for k, v in call.items() if len(v) == 1}
    assert [one["call", 1, x]["level"] for x in "abcd"] == [0, 1, 2, 3]
    assert one["call", 1, "d"]["errors"] == "no call zz" and not one["call", 1, "d"]["valid"]
    assert [one["call", 2, x]["in_cycle"] for x in ("a", "b", "c", "self")] == [True] * 4
    assert sorted(r["status"] for r in call["call", 3, "x"]) == ["duplicate", "linked"]
    assert sorted(r["status"] for r in call["result", 3, "x"]) == ["duplicate", "linked"]
    assert one["call", 3, None]["status"] == one["result", 3, None]["status"] == "no_id"
    assert one["call", None, "n"]["status"] == "linked" and one["call", None, "n"]["other_turn"] == 2
    assert one["result", 5, "lost"]["status"] == "orphan" and one["result", 1, "c"]["status"] == "orphan"
    assert one["call", 1, "c"]["status"] == "no_result"
    assert [one["call", 4, x]["errors"] for x in ("bad", "null", "tool", "list")] == [
        "not JSON", "no arguments", "no tool u", "$: not object"]
    assert len(one["result", 2, "a"]["json"]) > 300_000


def test_empty_tables(spark):
    c, r = spark.createDataFrame([], CALL), spark.createDataFrame([], RESULT)
    assert C.link_tool_calls(c, r, ANY).count() == 0
    assert C.link_tool_calls(spark.createDataFrame([(1, 1, "a", "t", "{}", 0)], CALL), r, ANY).count() == 1


def test_long_chains_are_sorted():
    chain = [(str(i + 1), str(i)) for i in range(5000)]
    assert C._sorted(chain[::-1])["5000"] == 5000
    assert C._sorted([("a", "b"), ("b", "a"), ("c", "a"), ("d", "e"), ("d", "e")]) == {"d": 1}


def test_canonical_json():
    assert C.canonical({"b": [1.0, 2.5, 1e30, 1e-7, True, None], "a": "é\n\"", "€": {}, "\U0001f600": 0}) == (
        '{"a":"é\\n\\"","b":[1,2.5,1e+30,1e-7,true,null],"€":{},"\U0001f600":0}')
    with pytest.raises(ValueError):
        C.canonical(float("nan"))


def test_schema_rules():
    schema = {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {
        "a": {"type": ["integer", "null"], "minimum": 2, "maximum": 5}, "b": {"enum": ["x", 1]}, "c": {"type": "array", "minItems": 1, "items": {"type": "string", "maxLength": 2}}}}
    assert C.problems({"a": 2}, schema) == [] and C.problems({"a": None}, schema) == [] and C.problems({"a": 3.0}, schema) == []
    assert C.problems({"a": 1, "b": "y", "c": ["abc", 1], "d": 0}, schema) == [
        "$.a: less than 2", "$.b: not in enum", "$.c[0]: longer than 2", "$.c[1]: not string", "$.d: not allowed"]
    assert C.problems({"a": True}, schema) == ["$.a: not integer or null"]
    assert C.problems({"a": {"$ref": "x"}}, schema) == [] and C.problems({}, schema) == ["$.a: missing"]


def test_long_conversations_take_few_rounds(spark, monkeypatch):
    rng = random.Random(3)
    calls = [(1, i, f"a{i}", "t", ref(f"a{i - 1}") if i else "{}") for i in range(100)]
    calls += [(2, i, f"b{i}", "t", ref(*{f"b{max(0, i - rng.randint(1, 3))}" for _ in range(rng.choice([1, 1, 1, 1, 2]))}) if i else "{}")
              for i in range(100)]
    # a cycle of calls with one need, what hangs on it, a call that needs it and a free one, and what needs that
    calls += [(3, i, f"c{i}", "t", ref(f"c{(i + 1) % 5}")) for i in range(5)] + [
        (3, 5, "d", "t", ref("c0")), (3, 6, "e", "t", ref("d", "f")), (3, 7, "f", "t", "{}"), (3, 8, "g", "t", ref("e")),
        (3, 9, "h", "t", ref("f")), (3, 10, "i", "t", ref("h", "f"))]
    # calls that need several, one behind the other
    calls += [(4, i, f"k{i}", "t", ref(f"k{i - 1}", f"k{i - 2}") if i > 1 else "{}") for i in range(12)]
    empty = spark.createDataFrame([], RESULT)
    df = spark.createDataFrame([(*c, 7) for c in calls], CALL)
    want = {k[1:]: v[2:] for k, v in brute(calls, []).items()}
    stored, stage = [], C.stage_table
    monkeypatch.setattr(C, "stage_table", lambda *a: stored.append(a[1]) or stage(*a))
    for in_task, most in ((8, 25), (40, 25), (1, 150)):
        stored.clear()
        own = df.filter("conv_id <> 4" if in_task == 40 else "conv_id IN (1, 3)" if in_task == 8 else "conv_id > 1")
        rows = C.link_tool_calls(own, empty, ANY, in_task=in_task).collect()
        assert {(r["conv_id"], r["turn"], r["call_id"]): (r["level"], r["in_cycle"]) for r in rows} == {
            k: v for k, v in want.items() if k[0] in {r["conv_id"] for r in rows}}
        assert len(rows) == own.count() and len(stored) < most, (in_task, len(stored))


def test_turns_without_a_role_are_results(spark):
    conv = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, None, "r"), (1, 3, "assistant", "b")],
                                 "conv_id long, turn long, role string, text string")
    calls, results = C.events(conv)
    assert [(r["turn"], r["call_id"], r["content"]) for r in results.collect()] == [(2, "call_1_1", "r")]
    assert sorted(r["turn"] for r in calls.collect()) == [1, 3]


def test_odd_but_valid_json_crashes_nothing(spark):
    deep = "[" * 500 + "]" * 500
    args = ['{"context": 1e400}', '{"text": "x", "n_words": 1e400, "turn": 1}', '{"text": "\\ud800 half", "n_words": 1, "turn": 1}',
            '{"\\udfff": {"$ref": "\\ud800"}}', deep, "[" * 100_000, '{"a": ' * 300 + "1" + "}" * 300, "9" * 5000,
            '{"text": "\\ud83d\\ude00", "n_words": 1, "turn": 1}', "-1e-400", "[" * 100 + "]" * 100]
    calls = spark.createDataFrame([(1, i, f"c{i}", "answer", a, 0) for i, a in enumerate(args)], CALL)
    results = spark.createDataFrame([(1, 50, "c0", "r", "s")], RESULT)
    got = {r["turn"]: r for r in C.link_tool_calls(calls, results, C.SCHEMAS).collect() if r["kind"] == "call"}
    assert len(got) == len(args)
    assert got[0]["errors"] == got[1]["errors"] == "number out of range"
    assert got[2]["valid"] and "\\ud800 half" in got[2]["json"]
    assert not got[3]["valid"] and "no call \\ud800" in got[3]["errors"]
    assert [got[i]["errors"] for i in (4, 5, 6)] == ["nested deeper than 100"] * 3 and got[7]["errors"] == "not JSON"
    assert got[8]["valid"] and "\U0001f600" in got[8]["json"]
    assert got[9]["errors"] == got[10]["errors"].replace("array", "object") == "$: not object"
    for i, r in got.items():
        assert json.loads(r["json"])["id"] == f"c{i}"


def test_ties_do_not_follow_the_order_of_rows(spark):
    pair = [(1, 1, "a", "t", '{"x": 1}', 0), (1, 1, "a", "t", '{"x": 2}', 0)]
    empty = spark.createDataFrame([], RESULT)
    both = [{r["json"]: r["status"] for r in C.link_tool_calls(spark.createDataFrame(rows, CALL), empty, ANY).collect()}
            for rows in (pair, pair[::-1])]
    assert both[0] == both[1] and sorted(both[0].values()) == ["duplicate", "no_result"]
