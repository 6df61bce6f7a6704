"""Token ids against a second library and a round trip; packing against its rules."""

import os
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from galley.llm import tokens as T
from galley.llm.packing import pack, plan_containers

pytestmark = pytest.mark.skipif(not os.path.exists(f"{T.TOKENIZERS}/byte_bpe_50k.tiktoken"), reason="vocabularies are not here")

TEXTS = [None, "", " ", "a", "Hello world", "don't  stop\n\n\nnow", "<|endoftext|> is text", "emoji 👩‍💻 ½ ​ \x1f", "草案数字が草案に" * 40, "x" * 3000, "word " * 4000, "\n" * 2000 + "a", "tab\t\tend   ", "lorem ipsum dolor " * 900, "a" + " " * 1500 + "b"]


@pytest.fixture(scope="module")
def other():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{T.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids if text else []


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 20), (300, 100), (T.CHUNK, T.OVERLAP)])
def test_against_a_second_library(spark, other, chunk, overlap):
    df = spark.createDataFrame([*enumerate(TEXTS), (99, "word " * 4000), (99, "word " * 4000), (99, "x")], "doc_id long, text string").selectExpr("*", "1 as k", "'z' as ids", "2 as row")
    got = T.encode(df, "doc_id", "text", chunk=chunk, overlap=overlap).collect()
    assert len(got) == len(TEXTS) + 3
    by = {r.doc_id: list(r.ids) for r in got if r.doc_id != 99}
    assert by == {i: other(t) for i, t in enumerate(TEXTS)}
    assert sorted(len(r.ids) for r in got if r.doc_id == 99) == sorted(len(other(t)) for t in ("word " * 4000, "word " * 4000, "x"))
    assert all(T.decode(by[i]) == (t or "") for i, t in enumerate(TEXTS))
    assert T.encode(df.limit(0), "doc_id", "text").count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab '\n.s1é草 \tdt"), min_size=60, max_size=400))
def test_stitching(text):
    enc = T.encoding()
    starts = list(range(0, max(1, len(text) - 20), 50))
    chunks = [dict(zip(("ids", "head_pos", "head_at", "tail_pos", "tail_at"), T.encode_chunk(text[s : s + 70], s, i + 1 == len(starts), enc, 20), strict=True)) for i, s in enumerate(starts)]
    got = T.stitch(chunks)
    assert got is None or got == enc.encode_ordinary(text)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 80), st.dictionaries(st.integers(1, 80), st.integers(1, 60), max_size=25))
def test_plan(capacity, counts):
    counts = {s: n for s, n in counts.items() if s <= capacity}
    runs, total = plan_containers(counts, capacity)
    fill = Counter()
    for size, n in counts.items():
        mine = sorted(r for r in runs if r[0] == size)
        for rank in range(n):
            _, first, per, container = [m for m in mine if m[1] <= rank][-1]
            fill[container + (rank - first) // per] += size
    weight = sum(s * n for s, n in counts.items())
    assert sum(fill.values()) == weight and all(v <= capacity for v in fill.values()) and sorted(fill) == list(range(total))
    assert total <= -(-weight * 3 // (2 * capacity)) + 1 or total == sum(n for s, n in counts.items() if 2 * s > capacity) or total <= -(-weight * 2 // capacity)


@pytest.mark.parametrize("per_salt", [200_000, 7])
def test_pack(spark, per_salt):
    rng = random.Random(1)
    items = [(i, rng.choice([0, 1, 5, 30, 34, 50, 51, 66, 100, 100, 100, 250])) for i in range(400)] + [(900, None), (901, -3), (5, 40)]
    df = spark.createDataFrame(items, "doc_id long, n_tokens long").selectExpr("*", "1 as salt", "2 as rank", "3 as n", "4 as tokens")
    rows = pack(df, "doc_id", "n_tokens", 100, per_salt).collect()
    fill = Counter()
    for r in rows:
        fill[r.container] += r.tokens
    assert max(fill.values()) <= 100
    by = Counter()
    for r in rows:
        by[r.doc_id] += r.tokens
    want = Counter()
    for i, n in items:
        want[i] += max(n or 0, 0)
    assert by == +want
    pieces = Counter(r.doc_id for r in rows if r.doc_id != 5)
    assert all(pieces[i] == -(-n // 100) for i, n in items if n and n > 0 and i != 5)
    weight = sum(want.values())
    assert len(fill) <= 1.25 * weight / 100 + 1
    again = pack(df.repartition(5), "doc_id", "n_tokens", 100, per_salt).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))
    assert pack(df.limit(0), "doc_id", "n_tokens", 100).count() == 0
