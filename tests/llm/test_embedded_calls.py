"""No assistant message is lost, whatever its JSON is like."""

from __future__ import annotations

import json

from panelwright.llm import chat_tools

CALL = {"id": "c1", "name": "reply", "arguments": '{"text":"x","turn":1}'}
ANSWERS = [
    '{"tool_calls": []}', '{"tool_calls": null}', '{"tool_calls": [null]}', '{"content": "hello", "tool_calls": []}', '{"tool_calls": [{"id": "a", "na', '{"tool_calls": {}}', '{"x": "\\"tool_calls\\""}',
    '{"tool_calls": [{"id": "a", "name": "reply", "arguments": "{}"}]} and then', '{\n"tool_calls": [\n', "plain", "", None,
]


def linked(spark, texts):
    rows = [(i, t, r, x) for i, a in enumerate(texts) for t, r, x in ((1, "user", f"question {i}"), (2, "assistant", a))]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {}
    for r in chat_tools.link_tools(*chat_tools.turns_as_tools(messages), (chat_tools.REPLY,)).collect():
        found.setdefault(r.conv_id, []).append(r)
    return found


def test_messages_without_calls_are_answers(spark):
    found = linked(spark, ANSWERS)
    for i, text in enumerate(ANSWERS):
        call, result = sorted(found[i], key=lambda r: r.kind)
        assert (call.kind, call.linked_turn, result.kind, result.linked_turn) == ("call", 2, "result", 1), text
        assert json.loads(result.canonical)["content"] == text


def test_calls_and_the_content_beside_them(spark):
    texts = [json.dumps({"tool_calls": [CALL]}, indent=2), json.dumps({"content": "first\nlook", "tool_calls": [CALL, CALL | {"id": "c2"}]}, indent=1), json.dumps({"content": None, "tool_calls": [CALL]})]
    found = linked(spark, texts)
    assert [sorted((r.kind, r.call_id) for r in found[i]) for i in range(3)] == [
        [("call", "0:1"), ("call", "c1")], [("call", "1:1"), ("call", "c1"), ("call", "c2"), ("result", "1:1")], [("call", "2:1"), ("call", "c1")]
    ]
    beside = next(r for r in found[1] if r.kind == "result")
    assert json.loads(beside.canonical)["content"] == "first\nlook" and beside.linked_turn == 1
