"""Nested payloads against a recursive walk."""

import json
import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from galley.operators.nested import child_table, flatten_batch, flatten_nested, unwrapped

_BLANK = " \t\r\n\f\v\u00a0\u2028\u2029\u3000\u0085\ufeff\u200b"


def unwrap(text):
    """The same, one text at a time."""
    while text is not None:
        text = text.strip(_BLANK)
        if text.startswith("```"):
            m = re.match(r"\A`{3,}[^\S\r\n]*[A-Za-z0-9_+.-]*\s*(.*?)\s*`{3,}\Z", text, re.S)
            text = m and m.group(1)
        elif text.startswith('"'):
            try:
                text = json.loads(text)
            except ValueError:
                return None
        else:
            return text or None
    return None


def walk(payload):
    text = unwrap(payload)
    try:
        value = json.loads(text) if text else None
    except ValueError:
        return []
    out = []

    def go(v, path, above):
        if isinstance(v, dict):
            if path:
                out.append((path, above))
            for k, x in v.items():
                go(x, f"{path}.{k}" if path else k, path)
        elif isinstance(v, list):
            for i, x in enumerate(v):
                go(x, f"{path}[{i}]", above)

    go(value, "", "")
    return sorted(out)


def flat(payloads):
    b = flatten_batch(pa.array(range(len(payloads))), pa.array(payloads, pa.string()))
    rows = [] if b is None else list(zip(b[0].to_pylist(), b[1].to_pylist(), b[2].to_pylist(), strict=True))
    return [sorted((p, q) for i, p, q in rows if i == n) for n in range(len(payloads))]


CASES = [
    '{"a":{"b":[{"c":1},null,{"d":{}}]},"a2":[[{"x":1}]]}',
    '[{"a":1},{"b":{"c":{}}}]',
    '{"a":{},"a":{"b":{}}}',
    '"{\\"a\\":{\\"b\\":{}}}"',
    '```json\n{"a":{}}\n```',
    '```json{"a":[{}]}```\n',
    '"```\\n{\\"a\\":{}}\\n```"',
    "﻿ \t{\"a\":{}} ",
    '{"a":"[{}]","b":"\\"{\\\\\\"c\\":1}"}',
    '{"k\\"x":{"y":{}},"\\u00e9":{}}',
    None, "", "   ", "null", "12", '"text"', "not json", '{"a":', '{"a":1,}', '{"a" 1}', "{1:2}", "[1,2,]", "[}", '{"a":tru}', "{} x", "{}{}", '{"a":"\\x"}', '{"a":"\n"}', "```\nno fence end",
]


def test_cases_alone_and_together():
    want = [walk(c) for c in CASES]
    assert flat(CASES) == want
    assert [flat([c])[0] for c in CASES] == want
    assert want[0] and want[3] and want[6] and not want[-1]


names = st.text("abé\"\\ ", min_size=1, max_size=3).filter(lambda k: "." not in k)
values = st.recursive(st.none() | st.booleans() | st.integers() | st.text('ab"\\{}[],:', max_size=6), lambda c: st.lists(c, max_size=3) | st.dictionaries(names, c, max_size=3), max_leaves=12)


@settings(max_examples=150, deadline=None)
@given(st.lists(values, min_size=1, max_size=4), st.booleans())
def test_any_value(vs, ascii_only):
    texts = [json.dumps(v, ensure_ascii=ascii_only) for v in vs]
    assert flat(texts) == [walk(t) for t in texts]


def test_deep_and_long():
    deep = "{\"a\":" * 300 + "{}" + "}" * 300
    assert len(flat([deep])[0]) == 300
    wide = json.dumps({"items": [{"n": i, "t": "x" * 50} for i in range(5000)]})
    assert len(flat([wide])[0]) == 5000


def test_slices():
    from galley.operators import nested

    b = pa.RecordBatch.from_pydict({"k": list(range(9)), "p": ["x" * 10, None, "y" * (5 << 20), "", "z" * 10, "w" * (3 << 20), "v" * (3 << 20), "u", None]})
    parts = list(nested._slices(b))
    assert sum(p.num_rows for p in parts) == 9 and [k for p in parts for k in p.column(0).to_pylist()] == list(range(9)) and len(parts) > 1
    assert list(nested._slices(b.slice(0, 0))) == []


def test_spark_links_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, '{"cards":[{"title":"t","facts":[{"f":1}]}]}', "x", 9), (1, '{"a":{}}', "x", 9), (2, None, None, None)], "id long, payload string, node_path string, k int")
    rows = flatten_nested(df, "id", "payload").collect()
    assert sorted((r.output_id, r.node_path, r.parent_path) for r in rows) == [(1, "a", ""), (1, "cards[0]", ""), (1, "cards[0].facts[0]", "cards[0]")]
    fact = next(r for r in rows if r.node_path.endswith("facts[0]"))
    card = next(r for r in rows if r.node_path == "cards[0]")
    assert fact.parent_no == card.node_no and fact.list_index == 0 and fact.field is None and card.depth == 2
    titles = child_table(flatten_nested(df, "id", "payload"), {"title": "$.title"}, F.col("node_path") == "cards[0]")
    assert [r.title for r in titles.collect()] == ["t"]
    assert flatten_nested(df.limit(0), "id", "payload").count() == 0


@pytest.mark.parametrize("query", ["p2_found", "p2_nodes", "p2_tables"])
def test_query(spark, data, query):
    import __spark_entry__

    assert __spark_entry__.queries()[query](spark, data).count() > 10


def test_wrapped_as_often_as_it_is():
    """No number of wrappings is too many: fences in fences, strings in strings, mixed."""
    fences = "```json\n" * 70 + '{"a": {"b": {}}}' + "\n```" * 70
    deep = '{"a": {}}'
    for i in range(12):
        deep = json.dumps(deep) if i % 2 else f"```\n{deep}\n```"
    assert unwrapped(pa.array([fences, deep, "``` open", '"open', "``````", '"\\"{}\\""', None, " "])).to_pylist() == ['{"a": {"b": {}}}', '{"a": {}}', None, None, None, "{}", None, None]
    got = flatten_batch(pa.array([1, 2]), pa.array([fences, deep]))
    assert list(zip(got.column("k").to_pylist(), got.column("node_path").to_pylist(), strict=True)) == [(1, "a"), (1, "a.b"), (2, "a")]


def test_escapes_and_doubled_names():
    cases = [r'{"a": {"x": "\u12"}}', r'{"a": {"x": "\q"}}', r'{"a": {"x": "\u00e9\\\n"}}', r'{"a": {}, "\u0061": {"b": {}}}', r'{"a": [{"k": {}, "k": 1}], "a": 2, "b": {}}', '{"a": 01}', '{"a": {}} x']
    got = flatten_batch(pa.array(range(len(cases))), pa.array(cases))
    assert list(zip(got.column("k").to_pylist(), got.column("node_path").to_pylist(), strict=True)) == [(2, "a"), (3, "a"), (3, "a.b"), (4, "b")]
