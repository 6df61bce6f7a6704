"""Near-duplicate texts by an inverted join over signature coordinates.

1. Texts are reduced to their distinct ones (smallest id).
2. A signature of ``ROWS`` min-hash values per text is made from its word
   shingles; a coordinate joins a fixed choice of them (three at a threshold of 0.5).
3. Texts are posted under each (coordinate, value).  Equal pairs within one
   batch are combined before the shuffle: one posting stands for the batch,
   the others are linked to it, so a value that a third of all texts share costs
   one row per batch.
4. Each list is merged in order of its value as a stream: every member is
   linked to the first member and to the one before it.  That is linear in the
   postings, never all pairs; members are ordered by a hash that differs
   from list to list, so each text meets other partners in each list.  A sketch
   of one bit per signature row travels with the posting; links whose
   sketches agree too little are skipped without a look at the texts.
5. Links are verified exactly on the shingles of the two texts and joined to
   components.
6. Lists of three and more that still hold several components are merged again:
   every member against every member of another component, one common list being
   enough and none left out; lists whose members are one component already are
   skipped, as links between them cannot change the result.  Collisions are
   counted over the whole signature, not over the lists that are merged: of each
   pair first the agreeing sketch bits, then the agreeing rows, and the pair is
   retained from the match threshold on (what texts at the similarity threshold
   have, less four standard deviations: a loss under 0.01 %).
7. A list of more than ``LONG`` members (a phrase that unlike texts have in common)
   is not compared as it is: its members are posted again, under the list and each
   coordinate.  Unlike texts seldom meet a second time, alike ones almost surely
   do (the chance of step 3 once more), so the work for a posting stays bounded
   and grows in proportion with the collection.  Lists that stay long after
   ``DEPTH`` such cuts are members alike in nearly all rows; they are compared in
   blocks, all pairs of blocks spread over the tasks.

Signatures have 64 rows and 64 coordinates; how many rows a coordinate joins, and the
bits and rows asked of a pair, follow from the threshold, so that a pair at the
threshold shares no coordinate with a probability of 0.3 % at most.  Thresholds
for which even single rows lose more (below 0.09) are refused.  At 0.5, two texts
alone share no coordinate, or too few sketch bits, with a probability of 0.6 %;
at 0.55 of 0.1 %, at 0.6 of 0.02 %.  Texts in larger groups are linked by several
ways.

Defined results: null texts and texts with fewer words than a shingle are alike
to none; equal texts count once under their smallest id; texts with the same
shingles are alike; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galley.llm.components import connected_components
from galley.session import discard, materialize

#: Min-hash rows of a signature, and coordinates (several rows each).
ROWS, COORDINATES = 64, 64
#: Chance that a pair at the threshold shares no coordinate, at most.
MISSED = 0.003
#: Members of a list whose pairs are all compared; cuts of a longer one.
LONG, DEPTH = 16_384, 3


def rows_per_coordinate(threshold: float) -> int:
    """As many rows as leave a pair at the threshold without a common coordinate with a chance of MISSED at most."""
    if not 0 < threshold <= 1 or (1 - threshold) ** COORDINATES > MISSED:
        raise ValueError("threshold must be from 0.09 to 1")
    return next(w for w in range(16, 0, -1) if (1 - threshold**w) ** COORDINATES <= MISSED)


def least_bits(threshold: float) -> int:
    """Sketch bits in which texts at the threshold agree, less three standard deviations."""
    q = (1 + threshold) / 2
    return max(0, math.ceil(ROWS * q - 3 * (ROWS * q * (1 - q)) ** 0.5))


def least_rows(threshold: float) -> int:
    """Rows in which signatures of texts at the threshold agree, less four standard deviations."""
    return max(1, int(ROWS * threshold - 4 * (ROWS * threshold * (1 - threshold)) ** 0.5))


def words(text):
    """Runs of letters and digits of a text, in lower case."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def word_hashes(text):
    """The words of a text in order, as 64-bit hashes."""
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _family(rows: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240131)
    return rng.integers(1, 2**32, rows, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, rows, dtype=np.uint32)


def _triples(rows: int, coordinates: int, width: int) -> np.ndarray:
    rng = np.random.default_rng(20240607)
    return np.array([rng.choice(rows, width, replace=False) for _ in range(coordinates)])


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


# Odd multipliers of the shingle hash, by position in the shingle.
_POWERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def _shingles(lists: pa.ListArray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all shingles of a batch of word lists, in order, and how many each list has."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    off = lists.offsets.to_numpy().astype(np.int64)
    off = off - off[0]
    count = np.maximum(np.diff(off) - size + 1, 0)
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.uint64), count
    m = len(flat) - size + 1
    h = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            h = _mix(h + flat[j : j + m] * np.uint64(_POWERS[j % len(_POWERS)]) + np.uint64(j + 1))
    take = np.repeat(off[:-1] - (np.cumsum(count) - count), count) + np.arange(total)
    return h[take], count


def _sign(size: int, rows: int):
    """Signatures of a batch: words are hashed on the JVM side, shingles and minima are vector operations."""
    mult, add = _family(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                h, count = _shingles(part.column(2), size)
                if not len(h):
                    continue
                ok = count > 0
                x = (h >> np.uint64(32)).astype(np.uint32)
                at = (np.cumsum(count) - count)[ok]
                sig = np.empty((len(at), rows), np.uint32)
                with np.errstate(over="ignore"):
                    for r in range(rows):
                        sig[:, r] = np.minimum.reduceat(x * mult[r] + add[r], at)
                keep = pa.array(np.flatnonzero(ok))
                yield pa.RecordBatch.from_arrays([part.column(0).take(keep), part.column(1).take(keep), pa.array([s.tobytes() for s in sig], pa.binary())], names=["k", "text_hash", "sig"])

    return run


def _alike(size: int, threshold: float):
    """Of a batch of pairs with the word hashes of both texts, those above the threshold."""

    def distinct(pair: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        o = np.lexsort((h, pair))
        pair, h = pair[o], h[o]
        new = np.r_[True, (pair[1:] != pair[:-1]) | (h[1:] != h[:-1])]
        return pair[new], h[new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                n = part.num_rows
                sides = []
                for c in (2, 3):
                    h, count = _shingles(part.column(c), size)
                    sides.append(distinct(np.repeat(np.arange(n), count), h) if len(h) else (np.zeros(0, np.int64), h))
                (pa_, ha), (pb, hb) = sides
                na, nb = np.bincount(pa_, minlength=n), np.bincount(pb, minlength=n)
                pair, h = np.concatenate([pa_, pb]), np.concatenate([ha, hb])
                o = np.lexsort((h, pair))
                pair, h = pair[o], h[o]
                twice = pair[1:][(pair[1:] == pair[:-1]) & (h[1:] == h[:-1])] if len(pair) else pair
                common = np.bincount(twice, minlength=n)
                keep = (common > 0) & (common >= threshold * (na + nb - common))
                yield part.select([0, 1]).filter(pa.array(keep))

    return run


_LINK_SCHEMA = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("sketch", pa.int64()), ("kind", pa.int8())])
_POST, _LINK, _MEMBER = 0, 1, 2


def _coordinates(sig: np.ndarray, width: int) -> np.ndarray:
    """Values of the coordinates, one 64-bit key for each (coordinate, value)."""
    triples = _triples(ROWS, COORDINATES, width)
    with np.errstate(over="ignore"):
        key = np.zeros((len(sig), COORDINATES), np.uint64)
        for j in range(width):
            key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, triples[:, j]].astype(np.uint64) + np.uint64(1))
        return _mix(key + np.arange(1, COORDINATES + 1, dtype=np.uint64))


def _sketch(sig: np.ndarray) -> np.ndarray:
    bits = (sig & np.uint32(1)).astype(np.uint64)
    return (bits << np.arange(ROWS, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def _order(key: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Members by key and, within a key, by a hash of key and id."""
    with np.errstate(over="ignore"):
        return np.lexsort((_mix(key ^ (ids.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))), key))


def _similar(x: np.ndarray, y: np.ndarray, bits: int) -> np.ndarray:
    return np.bitwise_count(x ^ y) <= ROWS - bits


def _rows(key, a, b, sketch, kind) -> pa.RecordBatch:
    n = len(a)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.asarray(key, np.uint64).view(np.int64)), pa.array(np.asarray(a, np.int64)), pa.array(np.asarray(b, np.int64)), pa.array(np.asarray(sketch, np.uint64).view(np.int64)), pa.array(np.full(n, kind, np.int8))],
        schema=_LINK_SCHEMA,
    )


def _links(key: np.ndarray, ids: np.ndarray, sketch: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of sorted lists: each member to its list's first and to the one before; and where lists begin."""
    first = np.r_[True, key[1:] != key[:-1]]
    begin = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
    i = np.flatnonzero(~first)
    left = np.concatenate([begin[i], i - 1])
    right = np.concatenate([i, i])
    near = _similar(sketch[left], sketch[right], bits) & (ids[left] != ids[right])
    left, right = left[near], right[near]
    lo, hi = np.minimum(ids[left], ids[right]), np.maximum(ids[left], ids[right])
    if len(lo):
        lo, hi = np.unique(np.stack([lo, hi]), axis=1)
    return lo, hi, first


def _post(width: int, bits: int):
    """Postings of a batch; equal ones are combined: one posting, links and members for the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(len(ids), ROWS)
            sketch = np.repeat(_sketch(sig), COORDINATES)
            key, who = _coordinates(sig, width).ravel(), np.repeat(ids, COORDINATES)
            o = _order(key, who)
            key, who, sketch = key[o], who[o], sketch[o]
            lo, hi, first = _links(key, who, sketch, bits)
            last = np.r_[first[1:], True]
            single = first & last
            yield _rows(key[first], who[first], np.where(single[first], 0, 1), sketch[first], _POST)
            if len(lo):
                yield _rows(_mix(lo.astype(np.uint64)) ^ hi.astype(np.uint64), lo, hi, np.zeros(len(lo)), _LINK)
            more = ~first
            if more.any():
                yield _rows(key[more], who[more], np.zeros(more.sum()), sketch[more], _MEMBER)

    return run


def _merge(bits: int):
    """Merges sorted postings as a stream: links out, and the members of lists of three and more.

    State is the open list: its first and last member once it was given out, else its one or two members.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        given = False  # the members held were given out already
        for b in batches:
            kind = b.column(4).to_numpy()
            for passed in (_LINK, _MEMBER):
                if (kind == passed).any():
                    yield b.filter(pa.array(kind == passed))
            rest = np.flatnonzero(kind == _POST)
            if not len(rest):
                continue
            key = b.column(0).to_numpy()[rest].view(np.uint64)
            ids, many = b.column(1).to_numpy()[rest], b.column(2).to_numpy()[rest]
            sketch = b.column(3).to_numpy()[rest].view(np.uint64)
            carried = 0
            if held is not None and held["key"][0] == key[0]:
                carried = len(held["key"])
                key, ids, many, sketch = (np.concatenate([held[n], x]) for n, x in (("key", key), ("ids", ids), ("many", many), ("sketch", sketch)))
            else:
                given = False
            lo, hi, first = _links(key, ids, sketch, bits)
            if len(lo):
                yield _rows(np.zeros(len(lo)), lo, hi, np.zeros(len(lo)), _LINK)
            begin = np.flatnonzero(first)
            length = np.diff(np.r_[begin, len(key)])
            long = (length >= 3) | (np.add.reduceat(many, begin) > 0)
            long[0] |= given
            out = np.repeat(long, length)
            if given:
                out[:carried] = False
            if out.any():
                yield _rows(key[out], ids[out], np.zeros(out.sum()), sketch[out], _MEMBER)
            s, given = begin[-1], bool(long[-1])
            keep = np.unique([s, len(key) - 1]) if given else np.arange(s, len(key))
            held = {"key": key[keep], "ids": ids[keep], "many": many[keep], "sketch": sketch[keep]}

    return run


def _again(width: int):
    """Members (key, k, c, sketch, sig) of long lists posted under the list and each of their coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                sig = _signatures(part.column(4))
                with np.errstate(over="ignore"):
                    key = _mix(_coordinates(sig, width) ^ (part.column(0).to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None])
                who = pa.array(np.repeat(np.arange(len(sig)), COORDINATES))
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), *(part.column(c).take(who) for c in (1, 2, 3))], names=["key", "k", "c", "sketch"])

    return run


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, ROWS)


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, sig) with one byte of each row: a quarter of the signature, which unlike rows share once in 256 times."""
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in _signatures(b.column(1)).astype(np.uint8)], pa.binary())], names=["k", "rows"])


def _cross(bits: int, least: int):
    """Of sorted block pairs (key, i, j) the pairs of members of different components that agree in ``bits`` of the sketch and ``least`` rows."""

    def pairs(own: np.ndarray, ids: np.ndarray, comp: np.ndarray, sketch: np.ndarray, sig: np.ndarray, i: int, j: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        if not len(left) or not len(right):
            return
        step = max(1, 2**21 // len(right))
        for lo in range(0, len(left), step):
            part = left[lo : lo + step]
            near = _similar(sketch[part][:, None], sketch[right][None, :], bits)
            near &= comp[part][:, None] != comp[right][None, :]
            if i == j:
                near &= part[:, None] < right[None, :]
            x, y = np.nonzero(near)
            x, y = part[x], right[y]
            for at in range(0, len(x), 2**18):
                u, v = x[at : at + 2**18], y[at : at + 2**18]
                same = np.count_nonzero(sig[u] == sig[v], axis=1) >= least
                if same.any():
                    u, v = ids[u[same]], ids[v[same]]
                    yield np.minimum(u, v), np.maximum(u, v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def close(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            """The pairs of whole block pairs."""
            key, i, j, own, ids, comp, sketch = (rows.column(c).to_numpy() for c in range(7))
            sketch = sketch.view(np.uint64)
            sig = np.frombuffer(b"".join(rows.column(7).to_pylist()), np.uint8).reshape(len(ids), ROWS)
            begin = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
            for lo, hi in zip(begin, np.r_[begin[1:], len(key)], strict=True):
                for a, b in pairs(own[lo:hi], ids[lo:hi], comp[lo:hi], sketch[lo:hi], sig[lo:hi], i[lo], j[lo]):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            at = np.stack([b.column(c).to_numpy() for c in range(3)])
            last = int(np.flatnonzero(np.r_[True, (at[:, 1:] != at[:, :-1]).any(axis=0)])[-1])
            if held and any(held[-1].column(c)[-1].as_py() != at[c, 0] for c in range(3)):
                yield from close(pa.concat_batches(held))
                held = []
            if last:
                yield from close(pa.concat_batches([*held, b.slice(0, last)]))
                held = []
            held.append(b.slice(last))
        if held:
            yield from close(pa.concat_batches(held))

    return run


def _verify(pairs: DataFrame, texts: DataFrame, size: int, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts share at least ``threshold`` of their distinct shingles."""
    left = pairs.join(texts.select(F.col("k").alias("a"), F.col("t").alias("ta")), "a")
    both = left.join(texts.select(F.col("k").alias("b"), F.col("t").alias("tb")), "b")
    hashed = both.select("a", "b", word_hashes(F.col("ta")).alias("wa"), word_hashes(F.col("tb")).alias("wb"))
    return hashed.mapInArrow(_alike(size, threshold), "a long, b long")


def near_duplicates(df: DataFrame, key: str, text: str, shingle: int = 5, threshold: float = 0.8, long: int = LONG) -> DataFrame:
    """first_id and ``key`` of every distinct text in a group of alike texts, but the group's smallest id."""
    width, bits, least = rows_per_coordinate(threshold), least_bits(threshold), least_rows(threshold)
    slim = df.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t")).where(F.col(text).isNotNull())
    hashed = slim.select("k", F.unhex(F.md5("t")).alias("text_hash"), word_hashes(F.col("t")).alias("w"))
    signed = hashed.mapInArrow(_sign(shingle, ROWS), "k long, text_hash binary, sig binary")
    distinct = materialize(signed.groupBy("text_hash", "sig").agg(F.min("k").alias("k")).select("k", "sig"), "signatures")

    schema = "key long, a long, b long, sketch long, kind tinyint"
    posted = distinct.mapInArrow(_post(width, bits), schema)
    merged = posted.repartition("key").sortWithinPartitions("key", F.xxhash64("key", "a")).mapInArrow(_merge(bits), schema)
    merged = materialize(merged, "merged")
    links = merged.where(F.col("kind") == _LINK).select("a", "b").distinct()
    members = merged.where(F.col("kind") == _MEMBER).select("key", F.col("a").alias("k"), "sketch").distinct()

    edges = materialize(_verify(links, _texts_of(slim, links), shingle, threshold), "edges")
    comp = materialize(connected_components(edges, "a", "b"), "components")

    of = comp.select(F.col("id").alias("k"), "component")
    placed = members.join(of, "k", "left").select("key", "k", F.coalesce("component", "k").alias("c"), "sketch")
    pairs = materialize(_crossed(_open_lists(placed, distinct, width, long), distinct, bits, least, long).join(links, ["a", "b"], "left_anti"), "crossed")
    if not pairs.isEmpty():
        more = _verify(pairs, _texts_of(slim, pairs), shingle, threshold)
        star = comp.where("id <> component").select(F.col("component").alias("a"), F.col("id").alias("b"))
        edges = materialize(star.unionByName(more), "edges")
        comp = materialize(connected_components(edges, "a", "b"), "components")
    # the result reads the components alone
    discard(distinct, merged, edges, pairs)
    return comp.where("id <> component").select(F.col("component").alias("first_id"), F.col("id").alias(key))


def _open(placed: DataFrame) -> DataFrame:
    """The members of the lists that hold several components, with the number ``n`` of the list's members."""
    lists = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select("key", "n")
    return placed.join(lists, "key").select("key", "k", "c", "sketch", "n")


def _open_lists(placed: DataFrame, distinct: DataFrame, width: int, long: int) -> DataFrame:
    """key, k, c, sketch, n of the lists to compare; those of more than ``long`` members are cut by posting them again."""
    current = materialize(_open(placed), "open")
    out = current.where(F.col("n") <= long)
    for _ in range(DEPTH):
        rest = current.where(F.col("n") > long)
        if rest.isEmpty():
            return out
        again = rest.select("key", "k", "c", "sketch").join(distinct, "k").select("key", "k", "c", "sketch", "sig").mapInArrow(_again(width), "key long, k long, c long, sketch long")
        current = materialize(_open(again), "open")
        out = out.unionByName(current.where(F.col("n") <= long))
    return out.unionByName(current.where(F.col("n") > long))


def _crossed(lists: DataFrame, distinct: DataFrame, bits: int, least: int, long: int) -> DataFrame:
    """The pairs (a, b) of members of different components that agree enough, each once; lists above ``long`` in pairs of blocks."""
    short = distinct.join(lists.select("k").distinct(), "k", "left_semi").select("k", "sig").mapInArrow(_short, "k long, rows binary")
    x = lists.withColumn("blocks", F.ceil(F.col("n") / long).cast("int")).withColumn("own", F.pmod(F.xxhash64("key", "k"), F.col("blocks")).cast("int"))
    dealt = x.join(short, "k").withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "k", "c", "sketch", "rows")
    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_cross(bits, least), "a long, b long").distinct()


def _texts_of(slim: DataFrame, pairs: DataFrame) -> DataFrame:
    """The texts that stand in a pair; one row per id."""
    ids = pairs.select(F.col("a").alias("k")).union(pairs.select(F.col("b").alias("k"))).distinct()
    return slim.join(ids, "k", "left_semi")
