"""The model boundary: a scorer as a typed function with validation and one retry.

A scorer is ``(prompt, attempt, error) -> text``; it is called once per row and
once more, with the error, when its answer does not validate.  Score only rows
that rules and caches left over, and materialise the result before branching.

Defined results: null prompts are not scored; a scorer that raises, or answers
twice in a form that does not validate, gives a null value and its error.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Scorer = Callable[[str, int, str | None], str]
Check = Callable[[dict], list[str]]


def unfenced(text: str) -> str:
    """An answer without the code fence around it."""
    t = text.strip()
    if t.startswith("```") and t.endswith("```") and len(t) > 6:
        t = t[3:-3]
        head, _, rest = t.partition("\n")
        t = rest if head.strip().isalnum() or not head.strip() else t.removeprefix("json")
    return t.strip()


def answer(scorer: Scorer, check: Check, prompt: str) -> tuple[str | None, str | None, int]:
    """(value as JSON, error, attempts)."""
    error = None
    for attempt in (1, 2):
        try:
            value = json.loads(unfenced(scorer(prompt, attempt, error)))
            problems = check(value) if isinstance(value, dict) else ["not an object"]
        except Exception as e:  # the scorer's own failures become the row's error
            problems = [f"{type(e).__name__}: {e}"]
            value = None
        if not problems:
            return json.dumps(value, ensure_ascii=False, sort_keys=True), None, attempt
        error = "; ".join(problems)
    return None, error, 2


def scored(df: DataFrame, key: str, prompt: str, scorer: Scorer, check: Check) -> DataFrame:
    """``key``, value (JSON), error and attempts of every row with a prompt."""
    slim = df.select(key, prompt).where(F.col(prompt).isNotNull())
    schema = f"{key} {dict(df.dtypes)[key]}, value string, error string, attempts int"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [answer(scorer, check, p) for p in f[prompt]]
            yield pd.DataFrame({key: f[key], "value": [r[0] for r in rows], "error": [r[1] for r in rows], "attempts": [r[2] for r in rows]})

    return slim.mapInPandas(run, schema)


def residual(df: DataFrame, cached: DataFrame, keys: list[str]) -> DataFrame:
    """The rows without a cached answer: what a scorer has to see."""
    return df.join(cached.select(keys).distinct(), keys, "left_anti")


def link_errors(urls: Column, allowed: Column) -> Column:
    """ARRAY of what is wrong with the links of an answer: not https, or not among the allowed ones."""
    u = F.coalesce(urls, F.array().cast("array<string>"))
    return F.array_compact(F.array(F.when(F.exists(u, lambda x: ~x.startswith("https://")), "not_https"), F.when(F.size(F.array_except(u, F.coalesce(allowed, F.array().cast("array<string>")))) > 0, "outside_allowlist")))


def numbered(urls: Column) -> Column:
    """Candidate links as numbered lines."""
    return F.array_join(F.transform(urls, lambda u, i: F.concat((i + 1).cast("string"), F.lit(". "), u)), "\n")


def prompt_text(subject: Column, heading: Column, text: Column, urls: Column) -> Column:
    """Subject, heading, candidates and text as the blocks of a prompt; empty blocks are left out."""
    block = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{label}: "), c))
    return F.concat_ws("\n\n", block("Subject", subject), block("Heading", heading), F.when(F.size(urls) > 0, F.concat(F.lit("Links:\n"), numbered(urls))), block("Text", text))
