"""The reply kernel against a naive model, and its payload rules."""

import time
import re

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from docsieve.functions import jsonreply

TOKEN = re.compile(r'"(?:\\.|[^"\\])*(?:"|\\?$)|[{}]', re.DOTALL)


def naive_end(text, start):
    depth = 0
    for token in TOKEN.finditer(text, start):
        depth += {"{": 1, "}": -1}.get(token.group(), 0)
        if depth == 0:
            return token.end()
    return None


def naive_objects(text):
    found, at = [], 0
    while at < len(text):
        end = naive_end(text, at) if text[at] == "{" else None
        if end:
            found.append(text[at:end])
        at = end or at + 1
    return found


@settings(max_examples=3000, deadline=None)
@given(st.text(alphabet='{{}}""\\a', max_size=40))
def test_brace_objects_match_naive_scan(text):
    assert jsonreply.brace_objects(text) == naive_objects(text)


def test_many_open_braces_stay_linear():
    text = '{"a' * 200_000 + '{"x": 1}'
    assert jsonreply.brace_objects(text) == naive_tail(text)


def naive_tail(text):
    tail = text[-60:]
    return naive_objects(tail)[-1:]


def test_candidate_order_and_dedupe():
    reply = 'see {"b": 2}\n```json\n{"a": 1}\n```\nand {"b": 2}'
    assert jsonreply.candidate_texts(reply) == ['{"a": 1}', '{"b": 2}']
    assert jsonreply.candidate_texts('{"a": 1}') == ['{"a": 1}']
    assert jsonreply.candidate_texts("```\n\n```") == []
    assert jsonreply.candidate_texts("") == []


def test_first_parseable_wins_not_first():
    assert jsonreply.first_json('say {bad} then {"a": 1}')[:3] == (1, '{"a": 1}', {"a": 1})
    assert jsonreply.first_json("{'a': 1}")[3].startswith("Malformed JSON in model output: ")
    assert jsonreply.first_json("no braces")[3] == "No JSON object found in model output"


def test_truncated_outer_object_yields_inner():
    assert jsonreply.candidate_texts('{"fields": {"a": "1"}, "tables": [') == ['{"a": "1"}']
    assert jsonreply.candidate_texts('{"fields": {"a": "1"') == []


def tree(reply, full=False):
    return jsonreply._tree_batch(pa.array([reply]), pa.array([full])).to_pylist()[0]


def test_tree_keeps_order_kind_and_number_text():
    nodes = tree('{"b": 20.00, "a": true, "n": null, "s": "x", "i": 7}')["nodes"]
    assert [(n["key"], n["kind"], n["value"]) for n in nodes] == [
        ("b", "number", "20.0"), ("a", "boolean", "True"), ("n", "null", None), ("s", "string", "x"), ("i", "number", "7")]


def test_tree_duplicate_keys_last_value_first_position():
    nodes = tree('{"a": 1, "b": 2, "a": 3}')["nodes"]
    assert [(n["key"], n["value"]) for n in nodes] == [("a", "3"), ("b", "2")]


def test_tree_three_levels():
    got = tree('{"rows": [["x", {"deep": [1]}]]}')
    row = got["nodes"][0]["items"][0]
    assert [c["value"] for c in row["items"]] == ["x", '{"deep":[1]}']
    assert got["nodes"][0]["value"] is None
    assert tree('{"rows": [1]}', full=True)["nodes"][0]["value"] == "[1]"


def test_bare_array_payloads():
    assert tree('[{"a": 1}, {"b": 2}]')["kind"] == "object"          # the first object wins
    assert tree("[1, 2]")["kind"] == "array"                          # no object at all
    assert tree("[1, 2]")["error"] == "No JSON object found in model output"
    assert tree('```\n[{"a": 1}]\n```')["kind"] == "array"
    assert tree("[1, 2")["kind"] is None


def test_odd_inputs_are_data():
    assert tree('{"a": "\\ud800"}')["nodes"][0]["value"] == "?"
    assert tree('{"a": NaN}')["nodes"][0]["value"] == "nan"
    assert tree('{"a": ' + "9" * 5000 + "}")["nodes"][0]["value"] == "9" * 5000
    assert tree('{"a":' * 100_000 + "1" + "}" * 100_000)["kind"] is None
    assert tree(None) is None


FENCE_RULE = re.compile(r"```(?:json)?\s*(.*?)\s*```", re.DOTALL | re.IGNORECASE)  # the rule that fence_bodies follows


@given(st.text(alphabet="`jJsSoOnN {}\n\u00a0\u017f", max_size=40) | st.lists(st.sampled_from(["```", "json", "JSON", " ", "\n", "x", "`"]), max_size=14).map("".join))
def test_fences_follow_the_rule(text):
    assert jsonreply.fence_bodies(text) == [body.strip() for body in FENCE_RULE.findall(text)]


def test_open_fences_stay_linear():
    start = time.perf_counter()
    for text in ("```json" + " " * 200_000, "```" + "\n" * 200_000 + "x", "``` ```" * 30_000 + "`" * 100_001):
        jsonreply.first_json(text)
    assert time.perf_counter() - start < 1


def test_named_entries_and_depth():
    """A key-value reply comes back as its fields, the others as deep as their parser looks."""
    texts = ['{"fields": {"Invoice No": "7.", "x": {"y": 1}, "invoice-id": "8", "**": 1, "Due": null}, "summary": "s"}', '{"fields": [{"a": "N/A"}, 5, {"A": true}, {"b": 1.50}]}',
             '```[{"a": 1}, {"b": "2"}]```', '{"fields": "none", "c": "3", "d": ["e"]}', '{"fields": {}}', None, "{cut", '{"a": {"b": {"c": 1}}}', '{"a": {"b": {"c": 1}}}']
    named, depth = [True] * 7 + [False] * 2, [1] * 8 + [2]
    found = jsonreply._named_tree_batch(pa.array(texts, pa.string()), pa.array([False] * 9), pa.array(named), pa.array(depth, pa.int32())).to_pylist()
    entries = [t and [tuple(e.values()) for e in t["entries"]] for t in found]
    assert entries[0] == [(0, "invoice_number", "string", "7"), (2, "due", "null", None)]
    assert entries[1:7] == [[(0, "a", "string", None), (2, "b", "number", "1.5")], [(0, "a", "number", "1"), (1, "b", "string", "2")], [(0, "fields", "string", None), (1, "c", "string", "3")], [], None, []]
    assert all(not t["nodes"] for t in found[:7] if t) and not entries[7] and not entries[8]
    assert [t["nodes"][0]["items"] and t["nodes"][0]["items"][0]["key"] for t in found[7:]] == [[], "b"] and found[8]["nodes"][0]["items"][0]["items"] == []
