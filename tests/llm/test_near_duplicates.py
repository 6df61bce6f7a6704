"""Near duplicates against all pairs, with hot families and dirt."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from galley.llm import near_duplicates as nd
from galley.llm.components import connected_components

WORDS = [f"w{i}" for i in range(400)]


def brute(rows, size, threshold):
    texts = {}
    for i, t in sorted(r for r in rows if r[1] is not None):
        texts.setdefault(t, i)
    sh = {}
    for t, i in texts.items():
        w = re.findall(r"[^\W_]+", t.lower())
        sh[i] = {tuple(w[j : j + size]) for j in range(len(w) - size + 1)}
    parent = {i: i for i in sh}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sh)
    for a in ids:
        for b in ids:
            if a < b and sh[a] and sh[b] and len(sh[a] & sh[b]) >= threshold * len(sh[a] | sh[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return sorted((find(i), i) for i in ids if find(i) != i)


def edited(rng, words, n):
    w = list(words)
    for _ in range(n):
        at = rng.randrange(len(w))
        kind = rng.random()
        if kind < 0.4:
            w[at] = rng.choice(WORDS)
        elif kind < 0.7:
            w.insert(at, rng.choice(WORDS))
        else:
            del w[at]
    return w


def corpus(seed, families, members, alone):
    rng = random.Random(seed)
    rows = []
    for _ in range(families):
        base = [rng.choice(WORDS) for _ in range(rng.randrange(60, 160))]
        for _ in range(rng.randrange(2, members)):
            rows.append(" ".join(edited(rng, base, rng.randrange(0, 6))))
    rows += [" ".join(rng.choice(WORDS) for _ in range(100)) for _ in range(alone)]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_against_all_pairs(spark):
    rows = corpus(1, 12, 7, 120)
    got = nd.near_duplicates(spark.createDataFrame(rows, "id long, text string"), "id", "text", 3, 0.5)
    assert sorted(map(tuple, got.collect())) == brute(rows, 3, 0.5)


def test_defaults_five_words(spark):
    rows = corpus(2, 10, 5, 40)
    got = nd.near_duplicates(spark.createDataFrame(rows, "id long, text string").repartition(3), "id", "text")
    assert sorted(map(tuple, got.collect())) == brute(rows, 5, 0.8)


def test_a_family_of_a_third_of_all_rows(spark):
    rng = random.Random(3)
    base = [rng.choice(WORDS) for _ in range(120)]
    rows = [" ".join(edited(rng, base, rng.randrange(1, 8))) for _ in range(150)] + [" ".join(rng.choice(WORDS) for _ in range(90)) for _ in range(200)]
    rows = list(enumerate(rows))
    got = nd.near_duplicates(spark.createDataFrame(rows, "id long, text string").repartition(4), "id", "text", 3, 0.5)
    assert sorted(map(tuple, got.collect())) == brute(rows, 3, 0.5)


def test_dirt(spark):
    long = " ".join(f"v{i % 5000}" for i in range(60_000))
    same = "one two three four five six"
    rows = [(1, None, 0), (2, "", 0), (3, "one two", 0), (4, "one two", 0), (5, same, 0), (6, same, 0), (6, same, 0), (7, same.upper() + "!!", 0), (8, long, 0), (9, long + " tail", 0), (10, "...", 0)]
    df = spark.createDataFrame(rows, "k long, t string, sig int").withColumn("text_hash", F.lit("x")).withColumn("a", F.lit(1))
    got = nd.near_duplicates(df, "k", "t", 3, 0.5)
    assert got.columns == ["first_id", "k"]
    assert sorted(map(tuple, got.collect())) == [(5, 7), (8, 9)]
    assert nd.near_duplicates(df.limit(0), "k", "t", 3, 0.5).count() == 0


def test_chains_join(spark):
    rng = random.Random(5)
    words = [rng.choice(WORDS) for _ in range(100)]
    rows = []
    for i in range(12):
        rows.append((i, " ".join(words)))
        for _ in range(3):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
    got = sorted(map(tuple, nd.near_duplicates(spark.createDataFrame(rows, "id long, text string"), "id", "text", 3, 0.5).collect()))
    assert got == brute(rows, 3, 0.5) == [(0, i) for i in range(1, 12)]


def test_merge_stream_across_batches():
    """The members of a list come out whole, and each is linked, wherever batches end."""
    import numpy as np

    sketch = np.zeros(7, np.uint64)
    for cut in range(1, 7):
        key, ids = np.array([5, 5, 5, 5, 8, 8, 9], np.uint64), np.arange(7)
        parts = [nd._rows(key[a:b], ids[a:b], np.zeros(b - a), sketch[a:b], nd._POST) for a, b in ((0, cut), (cut, 7))]
        out = pa.Table.from_batches(list(nd._merge(38)(iter(parts)))).to_pydict()
        members = sorted(a for a, k in zip(out["a"], out["kind"], strict=True) if k == nd._MEMBER)
        links = {(a, b) for a, b, k in zip(out["a"], out["b"], out["kind"], strict=True) if k == nd._LINK}
        assert members == [0, 1, 2, 3] and (4, 5) in links and {(0, 1), (1, 2), (2, 3)} <= links and not any(6 in x for x in links)


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)]
    star = [(500, 600 + i) for i in range(300)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(chain + star, "a long, b long"), "a", "b").collect()}
    assert all(got[i] == 0 for i in range(61)) and got[101] == 100 and got[100] == 100 and all(got[600 + i] == 500 for i in range(300)) and len(got) == 61 + 2 + 301
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_pairs_that_meet_in_long_lists_only(spark):
    """All texts share a phrase; with this seed some pairs meet once or twice, in long lists only."""
    rng = random.Random(6)
    phrase = [rng.choice(WORDS) for _ in range(60)]
    rows = []
    for _ in range(60):
        common = [f"c{rng.randrange(10**9)}" for _ in range(14)]
        rows += [" ".join(phrase + common + [f"o{rng.randrange(10**9)}" for _ in range(34)]) for _ in range(2)]
    rows = list(enumerate(rows))
    want = brute(rows, 3, 0.5)
    assert len(want) == 60
    got = nd.near_duplicates(spark.createDataFrame(rows, "id long, text string"), "id", "text", 3, 0.5)
    assert sorted(map(tuple, got.collect())) == want


    # the same where lists above 20 members are cut, and where cuts leave them long
    for long in (20, 3):
        got = nd.near_duplicates(spark.createDataFrame(rows, "id long, text string"), "id", "text", 3, 0.5, long)
        assert sorted(map(tuple, got.collect())) == want


@pytest.mark.parametrize("threshold", [0.3, 0.7])
def test_other_thresholds(spark, threshold):
    """Isolated pairs right above the threshold: at least nine of ten are found, nothing is added."""
    rng = random.Random(8)
    rows = []
    for _ in range(120):
        own = lambda k: [f"w{rng.randrange(10**9)}" for _ in range(k)]
        shared = own(40 + round(60 * threshold))
        other = round((len(shared) - 2) * (1 / (threshold + 0.04) - 1) / 2)
        rows += [" ".join(shared + own(other)) for _ in range(2)]
    rows = list(enumerate(rows))
    want = set(brute(rows, 3, threshold))
    got = set(map(tuple, nd.near_duplicates(spark.createDataFrame(rows, "id long, text string"), "id", "text", 3, threshold).collect()))
    assert len(want) > 100 and got <= want and len(got) >= 0.9 * len(want)


def test_thresholds_out_of_range(spark):
    for bad in (0, 0.05, 1.1):
        with pytest.raises(ValueError):
            nd.near_duplicates(spark.createDataFrame([], "id long, text string"), "id", "text", 3, bad)


def test_blocks_of_a_list():
    """Every pair of two components comes out once per list, whatever the blocks and the batches are."""
    import numpy as np

    rng = np.random.default_rng(1)
    sig = rng.integers(0, 2, (9, nd.ROWS), dtype=np.uint32)
    comp = np.arange(9) // 2
    for blocks in (1, 3):
        own = np.arange(9) % blocks
        small = sig.astype(np.uint8)
        rows = sorted((key, min(o, x), max(o, x), int(o), k, int(comp[k]), 0, small[k].tobytes()) for key in (4, 5) for k, o in enumerate(own) for x in range(blocks))
        whole = pa.Table.from_pylist([dict(zip(("key", "i", "j", "own", "k", "c", "sketch", "rows"), r, strict=True)) for r in rows])
        for size in (1, 2, 5, 100):
            out = [p for b in nd._cross(1, 1)(iter(whole.to_batches(max_chunksize=size))) for p in zip(*b.to_pydict().values(), strict=True)]
            assert sorted(out) == sorted((a, b) for a in range(9) for b in range(a + 1, 9) if comp[a] != comp[b] for _ in (4, 5))
