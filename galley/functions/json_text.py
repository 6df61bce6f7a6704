"""JSON in the two spellings hashes are taken of."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def outline_digest(items: pd.Series) -> pd.Series:
    """The first 16 hex digits of the sha256 of an outline's sorted JSON, ASCII only, with blanks behind separators."""
    keys = ("section_key", "heading", "char_count", "snippet_len")
    out = []
    for text in items:
        body = [{k: x.get(k) for k in keys} for x in json.loads(text or "[]")]
        out.append(hashlib.sha256(json.dumps(body, sort_keys=True, ensure_ascii=True).encode()).hexdigest()[:16])
    return pd.Series(out)
