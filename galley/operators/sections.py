"""Section normalisation, hashing, merging, chunking and packing.

Defined results: null texts count as empty; ties are broken towards the
earlier section; empty input gives no row (one empty chunk where stated).
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from galley.functions import rules
from galley.functions.predicates import strip, text_of

SEPARATOR = "\n\n---\n\n"
NO_HEADING = "(no heading)"


def truncated(text: Column, limit: int = rules.SECTION_CHARS) -> Column:
    """Stripped text of at most ``limit`` characters, with an ellipsis as the last one where it was cut."""
    t = strip(F.coalesce(text, F.lit("")))
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit - 1), F.lit("…"))).otherwise(t)


@F.pandas_udf(StringType())
def content_hash(text: pd.Series, links: pd.Series) -> pd.Series:
    """sha256 of the compact sorted JSON of links and cut text; the exact spelling of control characters needs Python."""
    out = []
    for t, ls in zip(text, links, strict=True):
        body = json.dumps({"links": [] if ls is None else [str(x) for x in ls], "text": t or ""}, separators=(",", ":"), ensure_ascii=False, sort_keys=True)
        out.append(hashlib.sha256(body.encode("utf-8", "surrogatepass")).hexdigest())
    return pd.Series(out)


def content_hash_builtin(text: Column, links: Column) -> Column:
    """The same hash without Python, for texts without control characters other than tab and line breaks."""
    return F.sha2(F.to_json(F.struct(F.coalesce(links, F.array().cast("array<string>")).alias("links"), truncated(text).alias("text"))), 256)


def merged_pairs(sections: DataFrame) -> DataFrame:
    """Each section merged with the next one of its email: text, heading, links, images and order of the pair."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("email_id").orderBy("order_index", "id")
    nxt = lambda c: F.lead(c).over(w)
    pair = sections.select(
        "email_id", "id", nxt("id").alias("next_id"), "order_index", nxt("order_index").alias("next_order"), "heading", nxt("heading").alias("next_heading"),
        "text", nxt("text").alias("next_text"), "links", nxt("links").alias("next_links"), "image_urls", nxt("image_urls").alias("next_images"),
    ).where("next_id is not null")
    a, b = truncated(F.col("text")), truncated(F.col("next_text"))
    return pair.select(
        "email_id",
        F.col("id").alias("left_id"),
        F.col("next_id").alias("right_id"),
        F.least("order_index", "next_order").alias("order_index"),
        F.when(F.coalesce("heading", F.lit("")) != "", F.col("heading")).otherwise(F.col("next_heading")).alias("heading"),
        truncated(F.concat_ws("\n\n", F.when(a != "", a), F.when(b != "", b))).alias("text"),
        F.array_distinct(F.concat("links", "next_links")).alias("links"),
        F.array_distinct(F.concat("image_urls", "next_images")).alias("image_urls"),
    )


def block_of(heading: Column, text: Column) -> Column:
    h = strip(F.coalesce(heading, F.lit("")))
    return F.concat(F.lit("## "), F.when(h != "", h).otherwise(NO_HEADING), F.lit("\n\n"), strip(F.coalesce(text, F.lit(""))))


def _ordered(sections: DataFrame) -> DataFrame:
    """One row per email: its sections in order, with their blocks."""
    item = F.struct(F.col("order_index").alias("o"), F.col("id").alias("i"), F.col("section_key").alias("key"), F.col("heading").alias("heading"), block_of(F.col("heading"), F.col("text")).alias("block"))
    return sections.groupBy("email_id").agg(F.array_sort(F.collect_list(item)).alias("s"))


def plaintext(sections: DataFrame) -> DataFrame:
    """email_id and the blocks of its sections in order, with separators."""
    return _ordered(sections).select("email_id", F.array_join(F.transform("s", lambda x: x["block"]), SEPARATOR).alias("text"))


def packed(sections: DataFrame, target: int = rules.CHUNK_CHARS) -> DataFrame:
    """email_id, chunk_index, section_keys, text: greedy packing in order by a fold; an oversized section stands alone."""
    if target < 1:
        raise ValueError("target must be at least 1")
    group = "struct<keys:array<string>,headings:array<string>,text:string,alone:boolean>"
    start = F.array().cast(f"array<{group}>")
    one = lambda x, alone: F.struct(F.array(x["key"]).alias("keys"), F.array(x["heading"]).alias("headings"), x["block"].alias("text"), alone.alias("alone"))

    def step(groups: Column, x: Column) -> Column:
        last = F.try_element_at(groups, F.lit(-1))
        n, big = F.size(groups), F.length(x["block"]) > target
        fits = (n > 0) & ~F.coalesce(last["alone"], F.lit(True)) & ~big & (F.length(last["text"]) + len(SEPARATOR) + F.length(x["block"]) <= target)
        joined = F.struct(F.concat(last["keys"], F.array(x["key"])).alias("keys"), F.concat(last["headings"], F.array(x["heading"])).alias("headings"), F.concat(last["text"], F.lit(SEPARATOR), x["block"]).alias("text"), F.lit(False).alias("alone"))
        return F.when(fits, F.concat(F.slice(groups, 1, F.greatest(n - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(groups, F.array(one(x, big))))

    folded = _ordered(sections).select("email_id", F.posexplode(F.aggregate("s", start, step)).alias("chunk_index", "g"))
    return folded.select("email_id", "chunk_index", F.col("g.keys").alias("section_keys"), F.col("g.headings").alias("headings"), F.col("g.text").alias("text"))


def merge_smallest(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Spans [first, last) after merging the adjacent pair of the smallest summed size until ``most`` are left; the first minimum wins."""
    spans = [(i, i + 1) for i in range(len(sizes))]
    sizes = list(sizes)
    while len(spans) > most:
        at = min(range(len(sizes) - 1), key=lambda i: sizes[i] + sizes[i + 1])
        spans[at : at + 2] = [(spans[at][0], spans[at + 1][1])]
        sizes[at : at + 2] = [sizes[at] + sizes[at + 1]]
    return spans


def capped(chunks: DataFrame, most: int = rules.CHUNKS_PER_EMAIL) -> DataFrame:
    """Chunks of an email merged until at most ``most`` are left; emails within the cap never reach Python."""
    if most < 1:
        raise ValueError("most must be at least 1")

    @F.pandas_udf("array<array<int>>")
    def spans(sizes: pd.Series) -> pd.Series:
        return sizes.map(lambda x: [list(p) for p in merge_smallest(list(x), most)])

    block_chars = F.length("text") - (F.size("section_keys") - 1) * len(SEPARATOR)
    per = chunks.groupBy("email_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "section_keys", "headings", "text", block_chars.alias("n")))).alias("c"))
    many = per.where(F.size("c") > most).withColumn("spans", spans(F.transform("c", lambda x: x["n"])))
    merged = many.select("email_id", "c", F.posexplode("spans").alias("chunk_index", "p"))
    first, last = F.get("p", F.lit(0)), F.get("p", F.lit(1))
    part = F.slice(F.col("c"), first + 1, last - first)
    merged = merged.select("email_id", "chunk_index", F.flatten(F.transform(part, lambda x: x["section_keys"])).alias("section_keys"), F.flatten(F.transform(part, lambda x: x["headings"])).alias("headings"), F.array_join(F.transform(part, lambda x: x["text"]), SEPARATOR).alias("text"))
    few = per.where(F.size("c") <= most).select("email_id", F.explode("c").alias("x")).select("email_id", "x.chunk_index", "x.section_keys", "x.headings", "x.text")
    return few.unionByName(merged)


def chunk_paragraphs(text: str | None, limit: int) -> list[str]:
    """Greedy chunks on blank-line seams; a paragraph above the limit is wrapped at its last blank beyond 60 % of it."""
    if limit <= 0 or not (text or "").strip():
        return []
    seams = [p.strip() for p in text.strip().split("\n\n") if p.strip()]
    out: list[str] = []
    open_ = ""
    for p in seams:
        joined = f"{open_}\n\n{p}" if open_ else p
        if len(joined) <= limit:
            open_ = joined
            continue
        if open_:
            out.append(open_)
        open_ = p if len(p) <= limit else ""
        while not open_ and p:
            if len(p) <= limit:
                out.append(p)
                break
            at = p.rfind(" ", 0, limit)
            piece = p[: at if at * 10 > limit * 6 else limit].rstrip() or p[:limit]
            out.append(piece.strip())
            p = p[len(piece) :].strip()
    return [c for c in [*out, open_] if c]


def paragraph_chunks(df: DataFrame, key: str, text: str, limit: int) -> DataFrame:
    """``key``, chunk_index, chunk: texts within the limit stay on the JVM side, the others are cut in Arrow batches."""
    stripped = df.select(F.col(key), strip(text_of(text)).alias("t")).where(F.col("t") != "")
    if limit <= 0:
        return stripped.limit(0).select(key, F.lit(0).alias("chunk_index"), F.col("t").alias("chunk"))
    schema = f"{key} {dict(df.dtypes)[key]}, chunk_index int, chunk string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, i, c) for k, t in zip(f[key], f["t"], strict=True) for i, c in enumerate(chunk_paragraphs(t, limit))]
            yield pd.DataFrame(rows, columns=[key, "chunk_index", "chunk"])

    # a text with a wider seam than one blank line is rejoined even when it is short
    plain = (F.length("t") <= limit) & ~F.col("t").rlike(r"(?U)\n\n\s|\s\n\n")
    short = stripped.where(plain).select(key, F.lit(0).alias("chunk_index"), F.col("t").alias("chunk"))
    return short.unionByName(stripped.where(~plain).mapInPandas(run, schema))


def _join_texts(a: str, b: str) -> str:
    text = "\n\n".join(p for p in (a, b) if p).strip()
    return text if len(text) <= rules.SECTION_CHARS else text[: rules.SECTION_CHARS - 1] + "…"


def routing_spans(texts: list[str], most: int = rules.SECTIONS_PER_EMAIL, least: int = rules.SHORT_SECTION_CHARS) -> tuple[list[tuple[int, int]], list[str]]:
    """Spans of adjacent sections and their texts: first down to ``most`` sections, then the short ones into the shorter neighbour."""
    spans = [(i, i + 1) for i in range(len(texts))]
    texts = list(texts)

    def merge(at: int) -> None:
        spans[at : at + 2] = [(spans[at][0], spans[at + 1][1])]
        texts[at : at + 2] = [_join_texts(texts[at], texts[at + 1])]

    while len(spans) > most:
        merge(min(range(len(texts) - 1), key=lambda i: len(texts[i]) + len(texts[i + 1])))
    while len(spans) > 1:
        short = next((i for i, t in enumerate(texts) if len(t) < least), None)
        if short is None:
            break
        last = short == len(texts) - 1
        left = short > 0 and (last or len(texts[short - 1]) <= len(texts[short + 1]))
        merge(short - 1 if left else short)
    return spans, texts


def for_routing(sections: DataFrame, most: int = rules.SECTIONS_PER_EMAIL, least: int = rules.SHORT_SECTION_CHARS, pathological: int = rules.PATHOLOGICAL_SECTIONS) -> DataFrame:
    """email_id, section_key, order_index, heading, text, links, image_urls after capping and merging.

    An email with ``pathological`` sections or more becomes one envelope of all
    of them.  The merging of a text depends on the texts merged before, so it
    runs in Python, over Arrow batches of emails.
    """

    def one(texts: list[str]) -> tuple[list[list[int]], list[str]]:
        if len(texts) >= pathological:
            whole = "\n\n".join(t for t in texts if t).strip()
            return [[0, len(texts)]], [whole if len(whole) <= rules.SECTION_CHARS else whole[: rules.SECTION_CHARS - 1] + "…"]
        spans, out = routing_spans(texts, most, least)
        return [list(p) for p in spans], out

    @F.pandas_udf("spans array<array<int>>, texts array<string>")
    def merged(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(list(t)) for t in texts], columns=["spans", "texts"])

    empty = F.array().cast("array<string>")
    item = F.struct(F.col("order_index").alias("o"), F.col("id").alias("i"), F.col("heading").alias("heading"), F.coalesce("links", empty).alias("links"), F.coalesce("image_urls", empty).alias("images"), truncated(F.col("text")).alias("text"))
    per = sections.groupBy("email_id").agg(F.array_sort(F.collect_list(item)).alias("s"))
    x = per.select("email_id", "s", merged(F.transform("s", lambda x: x["text"])).alias("m"))
    x = x.select("email_id", "s", F.posexplode(F.arrays_zip(F.col("m.spans").alias("span"), F.col("m.texts").alias("text"))).alias("order_index", "m"))
    first, last = F.get("m.span", F.lit(0)), F.get("m.span", F.lit(1))
    part = F.slice(F.col("s"), first + 1, last - first)
    heads = F.filter(F.transform(part, lambda x: x["heading"]), lambda h: h.isNotNull() & (h != ""))
    envelope = F.size("s") >= pathological
    return x.select(
        "email_id",
        F.concat(F.lit("s"), F.col("order_index")).alias("section_key"),
        "order_index",
        F.when(~envelope, F.get(heads, F.lit(0))).alias("heading"),
        F.col("m.text").alias("text"),
        F.array_distinct(F.flatten(F.transform(part, lambda x: x["links"]))).alias("links"),
        F.array_distinct(F.flatten(F.transform(part, lambda x: x["images"]))).alias("image_urls"),
    )


def with_envelopes(sections: DataFrame, mails: DataFrame) -> DataFrame:
    """The sections, and for each mail without any one envelope of its whole text, links and images.

    ``sections``: email_id, section_key, order_index, heading, text, links,
    image_urls; ``mails``: email_id, text, links, image_urls.
    """
    none = F.array().cast("array<string>")
    lost = mails.join(sections.select("email_id").distinct(), "email_id", "left_anti")
    one = lost.select("email_id", F.lit("s0").alias("section_key"), F.lit(0).alias("order_index"), F.lit(None).cast("string").alias("heading"), truncated(F.col("text")).alias("text"), F.coalesce("links", none).alias("links"), F.coalesce("image_urls", none).alias("image_urls"))
    return sections.select(one.columns).unionByName(one)


def or_empty_chunk(chunks: DataFrame, mails: DataFrame) -> DataFrame:
    """The chunks, and one empty chunk for each mail (email_id) without any."""
    none = F.array().cast("array<string>")
    lost = mails.select("email_id").distinct().join(chunks.select("email_id").distinct(), "email_id", "left_anti")
    empty = lost.select("email_id", F.lit(0).alias("chunk_index"), none.alias("section_keys"), none.alias("headings"), F.lit("").alias("text"))
    return chunks.select(empty.columns).unionByName(empty)
