"""Nested payloads to related flat tables, by Arrow buffers.

A batch of JSON texts is one byte buffer with row offsets.  Structure is found
on the whole buffer at once (numpy over the Arrow data buffer): string spans
from the quotes, depth from a running sum of brackets, list positions from the
commas, and for every node the index of the node that holds it.  Child rows are
then emitted level by level: each level *takes* the paths of its parents by the
parent index and appends its own step, so no payload is walked row by row.

Defined results
---------------
* null, empty, blank and unreadable payloads give no row;
* a byte order mark, white space, a code fence around the payload or a JSON
  string that holds JSON are peeled off, as often as they are nested;
* of a field name repeated in one object the last value counts;
* a number, string, boolean or null gives no row; nulls in a list keep their
  position;
* any nesting depth is handled: the loop is over levels, not over rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE_SCHEMA = "k {key}, node_path string, parent_path string, node_no int, parent_no int, depth int, field string, list_index int, body string"

_FENCE = r"(?s)\A`{3,}[^\S\r\n]*[A-Za-z0-9_+.\-]*\s*(?P<body>.*?)\s*`{3,}\z"
_SPACE = " \t\r\n\f\v                 　\u0085﻿​"
_SCALAR = re.compile(rb"\A(?:true|false|null|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)\Z")
#: Payload bytes that are flattened at once.
SLICE_BYTES = 4 << 20


def _from_string(text: str) -> str | None:
    try:
        inner = json.loads(text)
    except ValueError:
        return None
    return inner if isinstance(inner, str) else None


def unwrapped(texts: pa.Array) -> pa.Array:
    """The JSON texts of a batch of payloads without wrapping, null where nothing is left; each round peels all rows that still have one."""
    texts = pc.utf8_trim(texts.cast(pa.string()), characters=_SPACE)
    while True:
        fenced, quoted = (pc.fill_null(pc.starts_with(texts, x), False) for x in ("```", '"'))
        if not pc.any(pc.or_(fenced, quoted)).as_py():
            return pc.if_else(pc.equal(texts, ""), pa.scalar(None, pa.string()), texts)
        if pc.any(fenced).as_py():
            inner = pc.extract_regex(texts, _FENCE)
            body = pc.struct_field(inner, "body") if len(inner) else pa.array([], pa.string())
            texts = pc.if_else(fenced, body, texts)
        if pc.any(quoted).as_py():
            # a string's own escapes are its content's: only these rows are decoded one by one
            texts = pc.replace_with_mask(texts, quoted, pa.array([_from_string(t) for t in texts.filter(quoted).to_pylist()], pa.string()))
        texts = pc.utf8_trim(texts, characters=_SPACE)


def _classes() -> np.ndarray:
    c = np.zeros(256, np.uint8)
    for i, ch in enumerate(b"{}[],:"):
        c[ch] = i + 1
    return c


_CLASS = _classes()
_OPEN_OBJ, _CLOSE_OBJ, _OPEN_ARR, _CLOSE_ARR, _COMMA, _COLON = 1, 2, 3, 4, 5, 6
_STR, _SCAL = 7, 8
_ESCAPED, _HEX = np.zeros(256, bool), np.zeros(256, bool)
_ESCAPED[list(b'"\\/bfnrt')] = True
_HEX[list(b"0123456789abcdefABCDEF")] = True


def _string_mask(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unescaped quote positions, mask of bytes inside strings incl. the opening quote)."""
    slash = buf == 0x5C
    quote = buf == 0x22
    if slash.any():
        # a quote is escaped where an odd run of backslashes ends right before it
        idx = np.flatnonzero(slash)
        start = np.r_[True, np.diff(idx) > 1]
        run_no = np.cumsum(start) - 1
        first = idx[start]
        length_so_far = idx - first[run_no] + 1
        odd_end = np.zeros(len(buf) + 1, bool)
        odd_end[idx + 1] = length_so_far % 2 == 1
        # only the last backslash of a run stands right before another byte
        odd_end[:-1] &= ~slash
        quote &= ~odd_end[:-1]
    q = np.flatnonzero(quote)
    parity = np.cumsum(quote, dtype=np.int64) & 1
    return q, parity.astype(bool)


def _gathered(raw: np.ndarray, start: np.ndarray, end: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The byte ranges of a buffer as one Arrow array."""
    count = (end - start).astype(np.int64)
    offsets = np.r_[0, np.cumsum(count)]
    at = np.repeat(start - offsets[:-1], count) + np.arange(offsets[-1])
    return pa.Array.from_buffers(kind, len(start), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw[at])])


def _bad_escapes(buf: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Places of backslashes in strings that begin no escape of JSON."""
    idx = np.flatnonzero((buf == 0x5C) & inside)
    if not len(idx):
        return idx
    start = np.r_[True, np.diff(idx) > 1]
    first = idx[start][np.cumsum(start) - 1]
    idx = idx[(idx - first) % 2 == 0]  # the others are escaped themselves
    padded = np.r_[buf, np.zeros(6, np.uint8)]
    after = padded[idx + 1]
    ok = _ESCAPED[after]
    u = after == ord("u")
    if u.any():
        ok[u] = np.logical_and.reduce([_HEX[padded[idx[u] + j]] for j in range(2, 6)])
    return idx[~ok]


def _flatten(joined: pa.StringArray) -> tuple[dict[str, np.ndarray | list], np.ndarray]:
    """Nodes of all texts of a batch, and which texts are not valid JSON.

    Each text is followed by one newline, so tokens never run into each other.
    """
    n = len(joined)
    offsets = np.frombuffer(joined.buffers()[1], np.int32)[joined.offset : joined.offset + n + 1].astype(np.int64)
    starts = offsets[:-1] - offsets[0]
    buf = np.frombuffer(joined.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    bad = np.zeros(n, bool)

    # strings must close within their row: check parity per row
    quotes, inside = _string_mask(buf)
    row_of = lambda pos: np.searchsorted(starts, pos, side="right") - 1
    per_row = np.bincount(row_of(quotes), minlength=n) if len(quotes) else np.zeros(n, np.int64)
    if (per_row & 1).any():
        odd = (per_row & 1).astype(bool)
        bad |= odd
        return {}, bad
    # control characters inside strings are not allowed
    ctrl = np.flatnonzero((buf < 0x20) & inside)
    if len(ctrl):
        bad[row_of(ctrl)] = True

    kind = np.where(inside, 0, _CLASS[buf])
    struct_pos = np.flatnonzero(kind)
    open_q, close_q = quotes[0::2], quotes[1::2]
    blank = (buf == 0x20) | (buf == 0x0A) | (buf == 0x0D) | (buf == 0x09)
    loose = ~inside & ~blank & (kind == 0)
    loose[close_q] = False
    edge = np.diff(np.r_[False, loose, False].astype(np.int8))
    sc_start, sc_end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)

    pos = np.concatenate([struct_pos, open_q, sc_start])
    end = np.concatenate([struct_pos + 1, close_q + 1, sc_end])
    tok = np.concatenate([kind[struct_pos], np.full(len(open_q), _STR, np.uint8), np.full(len(sc_start), _SCAL, np.uint8)])
    order = np.argsort(pos, kind="stable")
    pos, end, tok = pos[order], end[order], tok[order]
    row = row_of(pos)
    m = len(pos)

    is_open = (tok == _OPEN_OBJ) | (tok == _OPEN_ARR)
    is_close = (tok == _CLOSE_OBJ) | (tok == _CLOSE_ARR)
    step = is_open.astype(np.int64) - is_close
    depth_after = np.cumsum(step)
    first = np.r_[True, row[1:] != row[:-1]] if m else np.zeros(0, bool)
    base = np.zeros(n, np.int64)
    seen = np.zeros(n, bool)
    if m:
        base[row[first]] = (depth_after - step)[first]
        seen[row] = True
    bad |= ~seen
    depth_after = depth_after - base[row]
    depth_in = np.where(is_open, depth_after - 1, np.where(is_close, depth_after, depth_after))  # depth of the place the token stands in
    low = np.zeros(n, bool)
    low[row[depth_after < 0]] = True
    last = np.r_[first[1:], True] if m else first
    low[row[last & (depth_after != 0)]] = True
    if low.any():  # unbalanced rows shift the depths of the rows behind them no further: base is per row
        bad |= low

    # the opener that holds each token: the last opener before it whose inside is the token's place
    holder = np.full(m, -1, np.int64)
    if m:
        top = int(depth_after.max(initial=0))
        for d in range(1, top + 1):
            openers = np.flatnonzero(is_open & (depth_after == d))
            inner = np.flatnonzero(depth_in == d) if d else np.zeros(0, np.int64)
            if len(openers) and len(inner):
                at = np.searchsorted(openers, inner, side="left") - 1
                ok = at >= 0
                holder[inner[ok]] = openers[at[ok]]
                same = row[holder[inner[ok]]] == row[inner[ok]]
                holder[inner[ok][~same]] = -1
    closer_holder = np.full(m, -1, np.int64)
    if m:
        for d in range(1, top + 1):
            openers = np.flatnonzero(is_open & (depth_after == d))
            closers = np.flatnonzero(is_close & (depth_after == d - 1))
            if len(openers) and len(closers):
                at = np.searchsorted(openers, closers, side="left") - 1
                ok = at >= 0
                closer_holder[closers[ok]] = openers[at[ok]]
    # grammar by pairs of neighbours
    prev_tok = np.r_[np.uint8(0), tok[:-1]] if m else tok
    prev_tok = np.where(first, 0, prev_tok)
    holder_kind = np.where(holder >= 0, tok[np.maximum(holder, 0)], 0)
    in_obj, in_arr, at_root = holder_kind == _OPEN_OBJ, holder_kind == _OPEN_ARR, holder < 0
    is_value = (tok == _STR) | (tok == _SCAL) | is_open
    prev_value_end = (prev_tok == _STR) | (prev_tok == _SCAL) | (prev_tok == _CLOSE_OBJ) | (prev_tok == _CLOSE_ARR)
    is_key = in_obj & (tok == _STR) & ((prev_tok == _OPEN_OBJ) | (prev_tok == _COMMA))
    prev_is_key = np.r_[False, is_key[:-1]] if m else is_key
    ok = np.zeros(m, bool)
    ok |= is_value & at_root & first
    ok |= is_value & in_arr & ((prev_tok == _OPEN_ARR) | (prev_tok == _COMMA))
    ok |= is_value & in_obj & (prev_tok == _COLON)
    ok |= is_key
    ok |= (tok == _COLON) & in_obj & prev_is_key
    ok |= (tok == _COMMA) & (in_obj | in_arr) & prev_value_end & ~prev_is_key
    opener_kind = np.where(closer_holder >= 0, tok[np.maximum(closer_holder, 0)], 0)
    ok |= (tok == _CLOSE_OBJ) & (opener_kind == _OPEN_OBJ) & ((prev_tok == _OPEN_OBJ) | (prev_value_end & ~prev_is_key))
    ok |= (tok == _CLOSE_ARR) & (opener_kind == _OPEN_ARR) & ((prev_tok == _OPEN_ARR) | prev_value_end)
    if m:
        bad[row[~ok]] = True
    # a string right after a comma in an object is a key: `prev_is_key` covers it; scalars are matched by their spelling
    sc = np.flatnonzero(tok == _SCAL)
    if len(sc):
        spelt = _gathered(buf, pos[sc], end[sc], pa.binary()).dictionary_encode()
        good = np.array([bool(_SCALAR.match(x)) for x in spelt.dictionary.to_pylist()])
        bad[row[sc[~good[spelt.indices.to_numpy()]]]] = True
    bad[row_of(_bad_escapes(buf, inside))] = True
    if bad.any():
        return {}, bad

    # list positions: commas before the token in its holder
    commas = np.flatnonzero((tok == _COMMA) & in_arr)
    comma_holder = holder[commas]
    by = np.lexsort((commas, comma_holder))
    commas, comma_holder = commas[by], comma_holder[by]
    objects = np.flatnonzero(is_open)
    obj_holder = holder[objects]
    stride = np.int64(m + 1)
    place = np.searchsorted(comma_holder * stride + commas, obj_holder * stride + objects)
    first_of = np.searchsorted(comma_holder * stride + commas, obj_holder * stride)
    index = (place - first_of).astype(np.int64)
    key_tok = objects - 2  # key, colon, value
    return {"raw": buf, "tok": tok, "pos": pos, "end": end, "row": row, "openers": objects, "holder": obj_holder, "index": index, "key_tok": key_tok, "closers": np.flatnonzero(is_close), "closer_holder": closer_holder, "in_obj": in_obj[objects], "in_arr": in_arr[objects]}, bad


def _keys(raw: np.ndarray, pos: np.ndarray, end: np.ndarray, toks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, names): the names of key tokens; each different spelling is decoded once, equal names have one code."""
    spelt = _gathered(raw, pos[toks], end[toks], pa.binary()).dictionary_encode()
    names = np.array([json.loads(x) for x in spelt.dictionary.to_pylist()], object)
    number: dict[str, int] = {}
    code = np.array([number.setdefault(x, len(number)) for x in names], np.int64)
    at = spelt.indices.to_numpy()
    return (code[at], names[at]) if len(names) else (np.zeros(0, np.int64), names)


def flatten_batch(ids: pa.Array, payloads: pa.Array, with_body: bool = True) -> pa.RecordBatch | None:
    """The node rows of one Arrow batch of payloads; None where there is no row."""
    texts = unwrapped(payloads)
    first = pc.utf8_slice_codeunits(texts, 0, 1)
    owner_a = np.flatnonzero(pc.fill_null(pc.or_(pc.equal(first, "{"), pc.equal(first, "[")), False).to_numpy(zero_copy_only=False))
    kept = pc.binary_join_element_wise(texts.take(pa.array(owner_a)), "\n", "")
    while len(kept):
        nodes, bad = _flatten(kept)
        if not bad.any():
            break
        keep = np.flatnonzero(~bad)
        kept, owner_a = kept.take(pa.array(keep)), owner_a[keep]
    if not len(kept):
        return None
    tok, pos, end, row, openers = nodes["tok"], nodes["pos"], nodes["end"], nodes["row"], nodes["openers"]
    raw, holder, index = nodes["raw"], nodes["holder"], nodes["index"]
    number = np.full(len(tok), -1, np.int64)
    number[openers] = np.arange(len(openers))
    parent = np.where(holder >= 0, number[np.maximum(holder, 0)], -1)  # parent index: container to container
    close_of = np.full(len(tok), -1, np.int64)
    close_of[nodes["closer_holder"][nodes["closers"]]] = nodes["closers"]
    is_object = tok[openers] == _OPEN_OBJ
    key = np.array([None] * len(openers), object)
    named = np.flatnonzero(nodes["in_obj"])
    key[named] = _keys(raw, pos, end, nodes["key_tok"][named])[1]

    # of repeated names in one object the last counts: drop the earlier one and what it holds
    dead = np.zeros(len(openers), bool)
    all_keys = np.flatnonzero((tok == _STR) & np.r_[tok[1:] == _COLON, False])
    if len(all_keys):
        depth_holder = _key_holders(nodes, all_keys)
        code, _ = _keys(raw, pos, end, all_keys)
        by = np.lexsort((all_keys, code, depth_holder))
        again = (depth_holder[by][1:] == depth_holder[by][:-1]) & (code[by][1:] == code[by][:-1])
        if again.any():
            earlier = all_keys[by[:-1][again]]
            dead[named] = np.isin(nodes["key_tok"][named], earlier)

    # level by level: take the parent's path, append the own step
    level = np.full(len(openers), -1, np.int64)
    roots = np.flatnonzero(parent < 0)
    level[roots] = 0
    path = np.array([""] * len(openers), object)
    object_above = np.full(len(openers), -1, np.int64)
    frontier, depth = roots, 0
    order = np.argsort(parent, kind="stable")
    sorted_parent = parent[order]
    while len(frontier):
        lo, hi = np.searchsorted(sorted_parent, frontier, "left"), np.searchsorted(sorted_parent, frontier, "right")
        count = hi - lo
        if not count.sum():
            break
        take = np.repeat(lo, count) + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
        child = order[take]
        up = parent[child]
        depth += 1
        level[child] = depth
        dead[child] |= dead[up]
        base = pa.array(path[up], pa.string())
        names = pa.array(key[child], pa.string())
        dot = pc.if_else(pc.equal(base, ""), "", ".")
        by_name = pc.binary_join_element_wise(base, dot, names, "")
        by_pos = pc.binary_join_element_wise(base, "[", pc.cast(pa.array(index[child]), pa.string()), "]", "")
        path[child] = pc.if_else(pa.array(nodes["in_arr"][child]), by_pos, by_name).to_numpy(zero_copy_only=False)
        object_above[child] = np.where(is_object[up] & (parent[up] >= 0), up, object_above[up])
        frontier = child
    out = np.flatnonzero(is_object & (parent >= 0) & ~dead)
    if not len(out):
        return None
    up = object_above[out]
    parent_path = np.where(up >= 0, path[np.maximum(up, 0)], "")
    # numbers of the rows within their payload, the root is 0
    row_out = row[openers[out]]
    first_of_row = np.searchsorted(row_out, row_out, "left")
    node_no = np.arange(len(out)) - first_of_row + 1
    number_of = np.zeros(len(openers), np.int64)
    number_of[out] = node_no
    body = _gathered(raw, pos[openers[out]], end[close_of[openers[out]]], pa.string()) if with_body else pa.nulls(len(out), pa.string())
    return pa.RecordBatch.from_arrays(
        [
            pc.take(ids, pa.array(owner_a[row_out])),
            pa.array(path[out], pa.string()),
            pa.array(parent_path, pa.string()),
            pa.array(node_no, pa.int32()),
            pa.array(np.where(up >= 0, number_of[np.maximum(up, 0)], 0), pa.int32()),
            pa.array(level[out], pa.int32()),
            pa.array(key[out], pa.string()),
            pa.array(np.where(nodes["in_arr"][out], index[out], -1), pa.int32(), mask=~nodes["in_arr"][out]),
            body,
        ],
        names=["k", "node_path", "parent_path", "node_no", "parent_no", "depth", "field", "list_index", "body"],
    )


def _key_holders(nodes: dict, toks: np.ndarray) -> np.ndarray:
    """The opener that directly holds each key token."""
    tok = nodes["tok"]
    openers, closers = nodes["openers"], nodes["closers"]
    step = np.zeros(len(tok), np.int64)
    step[openers] = 1
    step[closers] = -1
    depth = np.cumsum(step)
    out = np.full(len(toks), -1, np.int64)
    for d in np.unique(depth[toks]):
        ops = openers[depth[openers] == d]
        mine = np.flatnonzero(depth[toks] == d)
        out[mine] = ops[np.searchsorted(ops, toks[mine], "left") - 1]
    return out


def _slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most ``SLICE_BYTES`` of payload, or of one row: the working arrays are many times as large."""
    part = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy().astype(np.int64)) // SLICE_BYTES
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
    for lo, hi in zip(edges, edges[1:], strict=False):
        if hi > lo:
            yield b.slice(lo, hi - lo)


def flatten_nested(df: DataFrame, key: str | Column, payload: str | Column, key_name: str = "output_id", with_body: bool = True, carried: tuple[str, ...] = ()) -> DataFrame:
    """One row for each JSON object below the root of ``payload``.

    Columns: ``key_name``, node_path, parent_path, node_no and parent_no (numbers
    within the payload, 0 the root: the link to the parent row), depth, field,
    list_index and the object's own text ``body`` (null without ``with_body``),
    then the ``carried`` columns of the payload's row.
    No shuffle; only the named columns are read.
    """
    key = F.col(key) if isinstance(key, str) else key
    payload = F.col(payload) if isinstance(payload, str) else payload
    row = F.struct(key.cast("long").alias("_key"), *[F.col(f"`{c}`") for c in carried])
    slim = df.select(row.alias("k"), payload.cast("string").alias("p")).where(payload.isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _slices(b):
                out = flatten_batch(part.column(0), part.column(1), with_body)
                if out is not None:
                    yield out

    nodes = slim.mapInArrow(run, NODE_SCHEMA.format(key=slim.schema["k"].dataType.simpleString()))
    return nodes.select(F.col("k._key").alias(key_name), *nodes.columns[1:], *[F.col(f"k.`{c}`").alias(c) for c in carried])


def child_table(nodes: DataFrame, fields: dict[str, str], where: Column, key_name: str = "output_id") -> DataFrame:
    """A flat table of one kind of node: its link columns and the named JSON fields as text."""
    picked = [F.get_json_object("body", path).alias(name) for name, path in fields.items()]
    return nodes.where(where).select(key_name, "node_no", "parent_no", "node_path", *picked)
