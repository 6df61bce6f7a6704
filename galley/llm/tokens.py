"""Encoding of whole texts with a public byte-level tokenizer.

Texts up to ``chunk`` characters are encoded as they are.  Longer ones are cut
into chunks that overlap, spread over the cluster, pre-tokenised from each
chunk's own start and stitched where the pre-token boundaries of two
neighbours agree again: the splitting pattern looks only ahead, so from a
common boundary on both chunks split alike.  Only boundaries after a
character that is no white space are used, as a run of white space is the one
token that depends on what follows it.  Where two chunks never agree inside
their overlap (one run of letters longer than it), the text is encoded whole.

Defined results: null and empty texts give an empty list; a special token's
spelling is ordinary text; a repeated key keeps its rows.  ``decode`` joins
the raw bytes of the tokens.
"""

from __future__ import annotations

import base64
import os
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.session import materialize

#: Where the vocabularies lie; a parameter of every function here.
TOKENIZERS = os.environ.get("GALLEY_TOKENIZERS", "/opt/tokenizers")
DEFAULT = "byte_bpe_50k"
#: Characters of a chunk and of its overlap with the next one.
CHUNK, OVERLAP = 8192, 512

#: Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def load_ranks(name: str, folder: str) -> dict[bytes, int]:
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encoding(name: str = DEFAULT, folder: str = TOKENIZERS):
    """The tokenizer, built once per process (worker processes are reused, functions are not)."""
    cache = sys.__dict__.setdefault("_galley_encodings", {})
    if (name, folder) not in cache:
        import tiktoken

        cache[name, folder] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=load_ranks(name, folder), special_tokens={})
    return cache[name, folder]


def decode(ids: list[int], name: str = DEFAULT, folder: str = TOKENIZERS) -> str:
    """The text of token ids: their raw bytes, joined."""
    enc = encoding(name, folder)
    return b"".join(enc.decode_single_token_bytes(i) for i in ids).decode("utf-8", "replace")


def boundaries(text: str) -> list[int]:
    """Ends of the pre-tokens whose last character is no white space, but for the end of the text."""
    import regex

    pattern = sys.__dict__.setdefault("_galley_pattern", regex.compile(PATTERN))
    n = len(text)
    return [e for m in pattern.finditer(text) if (e := m.end()) < n and not text[e - 1].isspace()]


def encode_chunk(text: str, start: int, is_last: bool, enc, overlap: int) -> tuple[list[int], list[int], list[int], list[int], list[int]]:
    """ids of a chunk, and (position, ids before it) of the boundaries in the overlaps at its two ends."""
    cuts = boundaries(text)
    head = [c for c in cuts if c <= overlap] if start else []
    tail = [c for c in cuts if c >= len(text) - overlap] if not is_last else []
    tail = [c for c in tail if not head or c > head[-1]]
    marks = sorted({*head, *tail})
    ids: list[int] = []
    at: dict[int, int] = {}
    prev = 0
    for c in marks:
        ids += enc.encode_ordinary(text[prev:c])
        at[c] = len(ids)
        prev = c
    ids += enc.encode_ordinary(text[prev:])
    return ids, [start + c for c in head], [at[c] for c in head], [start + c for c in tail], [at[c] for c in tail]


def stitch(chunks: list[dict]) -> list[int] | None:
    """The ids of a text from its chunks in order; None where two neighbours never agree."""
    out: list[int] = []
    begin = 0
    for k, c in enumerate(chunks):
        if k + 1 == len(chunks):
            return out + list(c["ids"][begin:])
        nxt = chunks[k + 1]
        heads = dict(zip(nxt["head_pos"], nxt["head_at"], strict=True))
        for p, i in zip(c["tail_pos"], c["tail_at"], strict=True):
            if p in heads and i >= begin:
                out += list(c["ids"][begin:i])
                begin = heads[p]
                break
        else:
            return None
    return out


_LIST = "list<element: int32>"


def _lists(rows: list) -> pa.Array:
    flat = np.concatenate([np.asarray(r, np.int32) for r in rows]) if rows else np.zeros(0, np.int32)
    offsets = np.r_[0, np.cumsum([len(r) for r in rows], dtype=np.int64)].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))


def _encode_whole(name: str, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(name, folder)
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                ids = [enc.encode_ordinary(t) if t else [] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(ids)], names=["k", "ids"])

    return run


def _cut(chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(b.num_rows):
                k, t = b.column(0)[lo].as_py(), b.column(1)[lo].as_py()
                row = b.column(2)[lo].as_py()
                starts = list(range(0, max(1, len(t) - overlap), chunk))
                yield pa.RecordBatch.from_pydict(
                    {"k": [k] * len(starts), "row": [row] * len(starts), "chunk_no": list(range(len(starts))), "start": starts, "n_chunks": [len(starts)] * len(starts), "piece": [t[s : s + chunk + overlap] for s in starts]},
                    schema=pa.schema([("k", pa.int64()), ("row", pa.string()), ("chunk_no", pa.int32()), ("start", pa.int64()), ("n_chunks", pa.int32()), ("piece", pa.string())]),
                )

    return run


def _encode_chunks(name: str, folder: str, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(name, folder)
        for b in batches:
            d = b.to_pydict()
            rows = [encode_chunk(t, s, no + 1 == n, enc, overlap) for t, s, no, n in zip(d["piece"], d["start"], d["chunk_no"], d["n_chunks"], strict=True)]
            ids, head_pos, head_at, tail_pos, tail_at = ([r[i] for r in rows] for i in range(5))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), _lists(ids), pa.array(head_pos, pa.list_(pa.int64())), _lists(head_at), pa.array(tail_pos, pa.list_(pa.int64())), _lists(tail_at)],
                names=["k", "row", "chunk_no", "ids", "head_pos", "head_at", "tail_pos", "tail_at"],
            )

    return run


def _stitch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(b.num_rows):
            ids = stitch(b.column(2)[lo].as_py())
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, 1), b.column(1).slice(lo, 1), b.column(3).slice(lo, 1), _lists([ids or []]), pa.array([ids is not None])], names=["k", "row", "times", "ids", "agreed"])


def encode(df: DataFrame, key: str = "doc_id", text: str | Column = "text", name: str = DEFAULT, folder: str = TOKENIZERS, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``key`` and ``ids`` (array<int>) of every row; see the module's text for the method."""
    if not 0 < overlap < chunk // 2:
        raise ValueError("overlap must be positive and less than half a chunk")
    text = F.col(text) if isinstance(text, str) else text
    slim = df.select(F.col(key).cast("long").alias("k"), text.cast("string").alias("t"))
    is_long = F.coalesce(F.length("t") > chunk + overlap, F.lit(False))
    short = slim.where(~is_long).mapInArrow(_encode_whole(name, folder), "k long, ids array<int>")
    # rows of one key with different texts stay apart by the text's own hash; equal rows are chunks of one text, counted
    big = slim.where(is_long).select("k", "t", F.concat_ws("-", F.xxhash64("t"), F.length("t")).alias("row"))
    chunks = big.mapInArrow(_cut(chunk, overlap), "k long, row string, chunk_no int, start long, n_chunks int, piece string")
    chunks = chunks.repartition(_spread(df.sparkSession), "k", "row", "chunk_no")
    coded = chunks.mapInArrow(_encode_chunks(name, folder, overlap), "k long, row string, chunk_no int, ids array<int>, head_pos array<long>, head_at array<int>, tail_pos array<long>, tail_at array<int>")
    whole = coded.groupBy("k", "row").agg(F.array_sort(F.collect_set(F.struct("chunk_no", "ids", "head_pos", "head_at", "tail_pos", "tail_at"))).alias("chunks"), F.sum(F.when(F.col("chunk_no") == 0, 1).otherwise(0)).cast("int").alias("times"))
    # read twice below: stitched once, kept in the shared scratch folder
    joined = materialize(whole.mapInArrow(_stitch_rows, "k long, row string, times int, ids array<int>, agreed boolean"), "stitched")
    repeated = F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("i")
    out = short.unionByName(joined.where("agreed").select("k", "ids", repeated).select("k", "ids"))
    failed = joined.where("not agreed").select("k", "row")
    if not failed.isEmpty():
        out = out.unionByName(big.join(failed, ["k", "row"], "left_semi").select("k", "t").mapInArrow(_encode_whole(name, folder), "k long, ids array<int>"))
    return out.withColumnRenamed("k", key)


def _spread(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def token_counts(df: DataFrame, key: str = "doc_id", text: str | Column = "text", **how) -> DataFrame:
    """``key`` and ``n_tokens`` of every row."""
    return encode(df, key, text, **how).select(key, F.size("ids").alias("n_tokens"))
