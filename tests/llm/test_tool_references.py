"""References between calls: null conversations, chains, orphan results, hot identifiers."""

from __future__ import annotations

import json

from panelwright.llm import chat_tools

ANY = (chat_tools.Tool("any", (), closed=False),)


def linked(spark, rows):
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    calls, results, others = chat_tools.turns_as_tools(messages)
    return chat_tools.link_tools(calls, results, others, (*ANY, chat_tools.REPLY)).collect()


def call(conv, turn, name, *refs):
    return (conv, turn, "assistant", json.dumps({"tool_calls": [{"id": name, "name": "any", "arguments": json.dumps({"in": [{"$ref": r} for r in refs]})}]}))


def result(conv, turn, name):
    return (conv, turn, "tool", json.dumps({"tool_call_id": name, "content": "c"}))


def order(found, conv):
    return [(r.kind, r.call_id) for r in sorted((r for r in found if r.conv_id == conv), key=lambda r: r.position)]


def test_a_null_conversation_with_references(spark):
    rows = [call(None, 0, "b", "a"), result(None, 1, "b"), call(None, 2, "a"), result(None, 3, "a"), call(7, 0, "b", "a")]
    found = linked(spark, rows)
    assert order(found, None) == [("call", "a"), ("result", "a"), ("call", "b"), ("result", "b")]
    assert not any(r.in_cycle for r in found)
    assert {r.position for r in found if r.conv_id == 7} == {1}


def test_a_long_chain_and_a_cycle(spark):
    n = 8
    rows = [x for k in range(n) for x in (call(1, n - k, f"c{k}", *([f"c{k - 1}", "c0"] if k else [])), result(1, n - k, f"c{k}"))]
    rows += [call(2, 0, "x", "y"), result(2, 1, "x"), call(2, 2, "y", "x"), result(2, 3, "y"), call(2, 4, "z", "x"), call(2, 5, "w")]
    found = linked(spark, rows)
    assert order(found, 1) == [(kind, f"c{k}") for k in range(n) for kind in ("call", "result")]
    assert {r.call_id for r in found if r.conv_id == 2 and r.in_cycle} == {"x", "y", "z"}
    assert order(found, 2)[0] == ("call", "w")


def test_references_to_orphan_and_missing_results(spark):
    found = linked(spark, [call(1, 0, "a", "orphan"), result(1, 5, "orphan"), call(1, 1, "b", "nowhere"), call(1, 2, "c", "a")])
    assert not any(r.in_cycle for r in found)
    assert order(found, 1) == [("call", "b"), ("call", "c"), ("result", "orphan"), ("call", "a")]


def test_hot_identifiers_and_repeated_rows(spark):
    rows = [(None, i % 2, "user" if i % 2 == 0 else "assistant", f"t{i % 50}") for i in range(2000)] + [(i, 0, "user", "u") for i in range(1500)]
    found = linked(spark, rows)
    assert len(found) == 3500
    null = [r for r in found if r.conv_id is None]
    assert sorted(r.position for r in null) == list(range(1, 2001))
    assert all(r.linked_turn == 1 - r.turn for r in null) and all(r.position == 1 and r.linked_turn is None for r in found if r.conv_id is not None)
    assert {r.kind for r in null if r.position <= 1000} == {"call"}
