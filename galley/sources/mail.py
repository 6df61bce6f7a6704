"""Mail listing and bodies as tables."""

from __future__ import annotations

import base64
import binascii
import html
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from galley.operators.timestamps import sender_address


def sender_matches(sender: Column, specs: list[str]) -> Column:
    """True where the sender is one of the addresses, or of one of the ``@domain`` specs (a part of its domain)."""
    tests = []
    address = sender_address(sender)
    for raw in specs:
        spec = raw.strip().lower()
        if not spec:
            continue
        if spec.startswith("@"):
            if not re.fullmatch(r"@[a-z0-9.\-]+", spec):
                raise ValueError(f"not a domain: {raw!r}")
            tests.append(F.contains(F.substring_index(address, "@", -1), F.lit(spec[1:])))
        else:
            tests.append(address == spec)
    if not tests:
        raise ValueError("no sender is given")
    return F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False))


def recent(messages: DataFrame, specs: list[str], time: str, now: Column, days: int, exclude_labels: list[str]) -> DataFrame:
    """Messages of the senders in the last ``days`` days without one of the labels; plain predicates that reach the scan."""
    if days <= 0:
        raise ValueError("days must be above 0")
    none = F.array().cast("array<string>")
    labels = F.coalesce("label_ids", none)
    fresh = F.col(time) > now - F.make_dt_interval(F.lit(days))
    out = messages.where(fresh).where(sender_matches(F.col("sender"), specs))
    return out.where(~F.arrays_overlap(labels, F.array(*map(F.lit, exclude_labels)))) if exclude_labels else out


def listing(messages: DataFrame, page_size: int, after: str | None = None) -> DataFrame:
    """One page of distinct message ids in order, behind the token ``after``."""
    ids = messages.select("message_id").where("message_id is not null").distinct()
    ids = ids.where(F.col("message_id") > after) if after is not None else ids
    return ids.orderBy("message_id").limit(page_size)


def pages(messages: DataFrame, page_size: int, most: int | None = None) -> DataFrame:
    """page (from 0) and message_id of all pages of the distinct ids in order, spam and trash left out, the ``most`` first ids at most.

    Ids are numbered within ranges: a range is what ids with the same first bytes
    of their hash-free order share, so no task orders all of them.
    """
    from galley.operators.state import numbered

    labels = F.coalesce("label_ids", F.array().cast("array<string>"))
    fine = messages.where(F.col("message_id").isNotNull() & ~F.arrays_overlap(labels, F.array(F.lit("SPAM"), F.lit("TRASH"))))
    x = numbered(fine.select("message_id").distinct(), "message_id")
    x = x.where(F.col("n") < most) if most is not None else x
    return x.select(F.floor(F.col("n") / page_size).alias("page"), "message_id")


def headers(c: Column, name: str) -> Column:
    """The value of a header in ARRAY<STRUCT(name, value)>, whatever the case of its name."""
    return F.get(F.filter(c, lambda h: F.lower(h["name"]) == name.lower()), F.lit(0))["value"]


def decoded(data: str | None) -> str:
    """Text of base64url data with or without padding; broken data is empty."""
    try:
        raw = base64.urlsafe_b64decode((data or "") + "=" * (-len(data or "") % 4))
    except (binascii.Error, ValueError):
        return ""
    return raw.decode("utf-8", "replace")


def body_of(part: dict | None) -> str:
    """HTML of a nested part: the first text/html depth-first, else text/plain in an escaped ``<pre>``, else empty."""
    found: dict[str, str] = {}
    todo = [part or {}]
    while todo:
        p = todo.pop()
        mime = (p.get("mime") or "").lower()
        if mime in ("text/html", "text/plain") and p.get("data"):
            found.setdefault(mime, decoded(p["data"]))
        todo += reversed(p.get("parts") or [])
    if "text/html" in found:
        return found["text/html"]
    return f"<pre>{html.escape(found['text/plain'])}</pre>" if "text/plain" in found else ""


@F.pandas_udf(StringType())
def body_html(parts: pd.Series) -> pd.Series:
    """``body_of`` over JSON texts of nested parts."""
    import json

    return parts.map(lambda t: body_of(json.loads(t)) if t else "")


def missing_labels(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """Labels to create: wanted ones that are not there."""
    return wanted.select("label").distinct().join(existing.select("label"), "label", "left_anti")


def label_actions(emails: DataFrame, add: Column, remove: Column) -> DataFrame:
    """message_id, add and remove of the emails for which there is something to do."""
    return emails.select("message_id", add.alias("add"), remove.alias("remove")).where((F.size("add") > 0) | (F.size("remove") > 0))


def header_of(messages: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """message_id and the value of a header (null where it is missing) of the listed messages (headers: ARRAY<STRUCT(name, value)>)."""
    return messages.join(ids.select("message_id").distinct(), "message_id", "left_semi").select("message_id", headers(F.col("headers"), name).alias("value"))


def body_by_id(messages: DataFrame, ids: DataFrame) -> DataFrame:
    """message_id and html of the listed messages (payload: JSON of nested parts)."""
    return messages.join(ids.select("message_id").distinct(), "message_id", "left_semi").select("message_id", body_html(F.col("payload")).alias("html"))
