"""Filling containers of fixed capacity with items, by matching of large items.

The plan needs only how many items there are of each size: at most ``capacity``
numbers, gathered with map-side counting, whatever the number of items.  Items
above a third of the capacity fit at most twice into a container: the largest
is matched greedily with the largest that still fits.  The smaller sizes then
go, in falling order, into the smallest gap that holds them (best fit); gaps are
kept as runs of containers, so a step places a whole run at once.

Each item finds its container by its rank among the items of its size.  Ranks
come from counts of (size, salt): a size that holds a third of all rows is
spread over as many salts as it needs and never ordered in one task.

Defined results: items of size 0, null or less are left out; an item above the
capacity is split into full pieces and a rest (``piece_no`` from 0), no other is
split; ties are broken by the key, so the result is the same on every run;
repeated keys are items of their own.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from galley.session import materialize

#: Items of one size that are ordered in one task.
ROWS_PER_SALT = 200_000


def plan_containers(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Runs (size, first rank, items of the size per container, first container), and the number of containers."""
    left = {s: n for s, n in counts.items() if 0 < s <= capacity and n > 0}
    rank = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int]] = []
    gaps: list[tuple[int, int, int]] = []  # heap of (gap, first container, containers)
    total = 0

    def place(size: int, per: int, first: int, containers: int) -> None:
        runs.append((size, rank[size], per, first))
        rank[size] += per * containers
        left[size] -= per * containers

    large = sorted((s for s in left if 3 * s > capacity), reverse=True)
    for i, s in enumerate(large):
        j = i
        while left[s] > 0:
            while j < len(large) and (s + large[j] > capacity or not left[large[j]] or (large[j] == s and left[s] < 2)):
                j += 1
            if j == len(large):
                n = left[s]
                place(s, 1, total, n)
                gap = capacity - s
            elif large[j] == s:
                n = left[s] // 2
                place(s, 2, total, n)
                gap = capacity - 2 * s
            else:
                n = min(left[s], left[large[j]])
                gap = capacity - s - large[j]
                place(s, 1, total, n)
                place(large[j], 1, total, n)
            if gap:
                gaps.append((gap, total, n))
            total += n
    by_gap: dict[int, list[tuple[int, int]]] = {}
    for g, first, n in gaps:
        by_gap.setdefault(g, []).append((first, n))
    order = sorted(by_gap)
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        heap = [g for g in order if g >= s]
        heapq.heapify(heap)
        while left[s] > 0 and heap:
            g = heap[0]
            spans = by_gap.get(g)
            if not spans:
                heapq.heappop(heap)
                continue
            first, n = spans.pop()
            per = g // s
            full = min(n, left[s] // per)
            if full:
                place(s, per, first, full)
                by_gap.setdefault(g - per * s, []).append((first, full))
            if full < n and left[s] > 0:  # fewer than `per` are left: one container takes them
                rest = left[s]
                place(s, rest, first + full, 1)
                by_gap.setdefault(g - rest * s, []).append((first + full, 1))
                full += 1
            if full < n:
                spans.append((first + full, n - full))
        if left[s] > 0:
            per = capacity // s
            full, rest = divmod(left[s], per)
            if full:
                place(s, per, total, full)
                by_gap.setdefault(capacity - per * s, []).append((total, full))
                total += full
            if rest:
                place(s, rest, total, 1)
                by_gap.setdefault(capacity - rest * s, []).append((total, 1))
                total += 1
        order = sorted(g for g in by_gap if g > 0 and by_gap[g])
    return runs, total


def _assign(runs: list[tuple[int, int, int, int]]):
    runs = sorted(runs)
    size, first_rank, per, container = (np.array([r[i] for r in runs], np.int64) for i in range(4))
    span = np.int64(1) << 40  # ranks of one size stay below 2**40

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = size * span + first_rank
        for b in batches:
            s, r = b.column(2).to_numpy(zero_copy_only=False), b.column(3).to_numpy(zero_copy_only=False)
            at = np.searchsorted(start, s.astype(np.int64) * span + r, "right") - 1
            bins = container[at] + (r - first_rank[at]) // per[at]
            yield pa.RecordBatch.from_arrays([pa.array(bins, pa.int64()), b.column(0), b.column(1), b.column(2)], names=["container", "k", "piece_no", "tokens"])

    return run


def pack(items: DataFrame, key: str, size: str, capacity: int, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """container, ``key``, piece_no and tokens of every item with a size above 0."""
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    base = materialize(items.select(F.col(key).cast("long").alias("k"), F.col(size).cast("long").alias("n")).where(F.col(size) > 0), "sizes")
    full, rest = F.floor(F.col("n") / capacity).cast("int"), (F.col("n") % capacity)
    pieces = base.select("k", "n", F.explode(F.sequence(F.lit(0), F.when(rest > 0, full).otherwise(full - 1))).alias("piece_no"))
    pieces = pieces.select("k", F.col("piece_no").cast("int").alias("piece_no"), F.when(F.col("piece_no") < F.floor(F.col("n") / capacity), capacity).otherwise(F.col("n") % capacity).cast("int").alias("tokens"))
    # at most `capacity` rows come to the driver
    counts = {r["tokens"]: r["n"] for r in pieces.groupBy("tokens").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs, _ = plan_containers(counts, capacity)
    salts = max(1, -(-max(counts.values(), default=1) // rows_per_salt))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("k", "piece_no"), F.lit(salts)))
    if salts == 1:
        ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("tokens").orderBy("k", "piece_no")) - 1)
    else:
        per_salt = salted.groupBy("tokens", "salt").agg(F.count(F.lit(1)).alias("m"))
        before = per_salt.select("tokens", "salt", (F.sum("m").over(Window.partitionBy("tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))).alias("before"))
        within = salted.withColumn("rank", F.row_number().over(Window.partitionBy("tokens", "salt").orderBy("k", "piece_no")) - 1)
        ranked = within.join(before, ["tokens", "salt"]).withColumn("rank", F.col("rank") + F.coalesce("before", F.lit(0)))
    out = ranked.select("k", "piece_no", "tokens", F.col("rank").cast("long").alias("rank"))
    return out.mapInArrow(_assign(runs), "container long, k long, piece_no int, tokens int").withColumnRenamed("k", key)
