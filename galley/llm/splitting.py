"""Splitting oversized texts at natural boundaries, by recursive bisection.

A text above the limit is cut at the strongest boundary near its middle
(paragraph, line, sentence, word, and only then any character); halves that
still exceed the limit minus the overlap are cut again.  Then each piece
after the first is given the last ``overlap`` characters of the one before.

Defined results: white space of any kind at both ends of a text does not count
and is not kept; null, blank and short texts are one piece or none and give no
row here; pieces lose no character in between; a cut never parts a base
character from its combining marks or joiners where another place is in reach.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OVERLAP = 200

_PARAGRAPH = re.compile(r"\n[^\S\n]*\r?\n\s*")
_LINE = re.compile(r"\r?\n\s*")
_SENTENCE = re.compile(r"[.!?…]+[\"'”’)\]]*\s+|[。！？]+[」』）]*\s*|[।؟]\s*")
_WORD = re.compile(r"\s+")
_LEVELS = (_PARAGRAPH, _LINE, _SENTENCE, _WORD)


def _nearest(text: str, lo: int, hi: int, mid: int, pattern: re.Pattern) -> int | None:
    best = None
    for m in pattern.finditer(text, lo, hi):
        e = m.end()
        if lo < e < hi and (best is None or abs(e - mid) < abs(best - mid)):
            best = e
        elif best is not None and e > mid:
            break
    return best


def _any_place(text: str, mid: int, lo: int, hi: int) -> int:
    for d in range(min(64, hi - lo)):
        for p in (mid + d, mid - d):
            if lo < p < hi and not unicodedata.combining(text[p]) and text[p] not in "‍️" and text[p - 1] != "‍":
                return p
    return mid


def cut_place(text: str, lo: int, hi: int, least: int) -> int:
    """Where to cut text[lo:hi]: the strongest boundary of its middle half, else a word's end anywhere, else the middle."""
    mid, quarter = (lo + hi) // 2, (hi - lo) // 4
    for pattern in _LEVELS:
        p = _nearest(text, lo + quarter, hi - quarter, mid, pattern)
        if p is not None:
            return p
    p = _nearest(text, lo + least, hi - least, mid, _WORD) if hi - lo > 2 * least else None
    return p if p is not None else _any_place(text, mid, lo, hi)


def spans(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Parts of ``text`` without overlap: the first up to ``limit``, the others up to ``limit - overlap``."""
    out, todo = [], [(0, len(text))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= limit - (overlap if lo else 0):
            out.append((lo, hi))
        else:
            p = cut_place(text, lo, hi, overlap)
            todo += [(p, hi), (lo, p)]
    return out


def split_text(text: str, limit: int, overlap: int = OVERLAP) -> list[str]:
    """The pieces of one text; a text within the limit is its own only piece."""
    text = text.strip()
    parts = spans(text, limit, overlap)
    return [text[max(0, lo - overlap) if i else lo : hi] for i, (lo, hi) in enumerate(parts)]


def _split_rows(limit: int, overlap: int):
    schema = pa.schema([("k", pa.int64()), ("piece_no", pa.int32()), ("n_pieces", pa.int32()), ("start", pa.int64()), ("piece", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(b.num_rows):
                text = b.column(1)[lo].as_py().strip()
                if len(text) <= limit:
                    continue
                parts = spans(text, limit, overlap)
                starts = [max(0, a - overlap) if i else a for i, (a, _) in enumerate(parts)]
                pieces = [text[s:e] for s, (_, e) in zip(starts, parts, strict=True)]
                n = len(parts)
                yield pa.RecordBatch.from_pydict({"k": [b.column(0)[lo].as_py()] * n, "piece_no": list(range(n)), "n_pieces": [n] * n, "start": starts, "piece": pieces}, schema=schema)

    return run


def split_oversized(df: DataFrame, key: str, text: str | Column, limit: int, overlap: int = OVERLAP) -> DataFrame:
    """``key``, piece_no (from 0), n_pieces, start and piece of every text above ``limit``.

    Texts that cannot exceed the limit are dropped on the JVM side before
    Python sees them; no shuffle.
    """
    if limit < 4 * overlap or overlap < 0:
        raise ValueError("the limit must be at least four times the overlap")
    text = F.col(text) if isinstance(text, str) else text
    slim = df.select(F.col(key).cast("long").alias("k"), text.cast("string").alias("t")).where(F.length("t") > limit)
    return slim.mapInArrow(_split_rows(limit, overlap), "k long, piece_no int, n_pieces int, start long, piece string").withColumnRenamed("k", key)
