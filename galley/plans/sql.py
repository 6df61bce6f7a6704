"""Fragments of DuckDB SQL for the oracles."""

from __future__ import annotations

_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def any_of(x: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(p)})" for p in phrases) + ")"


def hits(x: str, phrases) -> str:
    return "(" + " + ".join(f"contains({x}, {q(p)})::INT" for p in phrases) + ")"


def truncated(x: str, limit: int) -> str:
    s = strip(f"coalesce({x}, '')")
    return f"CASE WHEN length({s}) > {limit} THEN left({s}, {limit - 1}) || '…' ELSE {s} END"


COMBINED = f"lower(concat_ws(' ', nullif({strip('heading')}, ''), nullif({strip('text')}, '')))"
BOTH = "lower(concat_ws(' ', nullif(heading, ''), nullif(text, '')))"
HTTPS = f"list_filter(list_transform(coalesce(links, []), lambda x: {strip('x')}), lambda u: starts_with(u, 'https://'))"
# Ordered distinct of a list expression named l.
DISTINCT = "list_filter(l, lambda x, i: list_position(l, x) = i)"


def peeled(levels: int = 5) -> str:
    """CTEs that take the wrapping off the payloads of the log, as ``log`` with column j."""
    sp = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
    bare = lambda x: f"regexp_replace({x}, '^{sp}+|{sp}+$', '', 'g')"
    out = ["j0 AS (SELECT *, payload AS p FROM agent_outputs)"]
    for i in range(levels):
        out.append(f"s{i} AS (SELECT * EXCLUDE p, {bare('p')} AS p FROM j{i})")
        fence = bare(r"regexp_extract(p, '(?s)^```+[ \t]*[A-Za-z0-9_+.-]*(.*?)```+$', 1)")
        out.append(f"""j{i + 1} AS (SELECT * EXCLUDE p, CASE WHEN starts_with(p, '```') THEN {fence} WHEN starts_with(p, '"') AND json_valid(p) THEN json_extract_string(p, '$') ELSE p END AS p FROM s{i})""")
    out.append(f"log AS (SELECT * EXCLUDE p, CASE WHEN json_valid(p) THEN p END AS j FROM j{levels})")
    return ", ".join(out)
