"""Typed outputs: payloads unwrapped, validated, and shaped into the rows of a page.

Defined results: a payload in white space, a byte order mark, a code fence or a
JSON string counts as its content, up to ``predicates.LEVELS`` of them; unreadable payloads
have no rows and the one error ``payload:unreadable``; an object in place of a list
is a list of one; a list item that is no object has null fields; of a field
repeated in an object the first counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.functions import rules
from galley.functions.predicates import bound, escaped, https, is_image_url, strip, unwrapped
from galley.operators.compose import coerced_category, kind_category

CATEGORIES = ("TECHNOLOGY", "RADAR", "LEADERSHIP", "COURSES")

# What the lists of a page are made of, by kind, with the headings of their parts.
ESSAY_PARTS = (("leadership_signals", "Leadership signals"), ("author_action_items", "Author's actions"), ("senior_engineer_actions", "Senior engineer's actions"), ("notable_examples", "Notable examples"))
LONGFORM_PARTS = (("key_technical_insights", "Key technical insights"), ("architecture_or_workflow_insights", "Architecture / workflow"), ("tradeoffs_or_disagreements", "Tradeoffs / disagreements"), ("practical_takeaways", "Practical takeaways"))
CARD_PARTS = (("key_points", "Key points"), ("why_it_matters", "Why it matters"), ("watchouts", "Watchouts"))
FORMATS = ("interview", "essay", "transcript", "other")
#: Lists of a page in order, with their headings.
LISTS = {"technical_index": "Technical Index", "ai_radar_top_story": "Top Story", "ai_radar_recap": "Recap", "ai_radar": "AI Radar", "leadership_signals": "Leadership Signals", "leadership_essays": "Leadership Essays", "courses": "Courses"}


def with_json(log: DataFrame) -> DataFrame:
    """Adds ``json``: the unwrapped payload where it is readable JSON, else null; no payload is parsed twice for that."""
    return log.withColumn("json", unwrapped(F.col("payload"))).withColumn("json", F.when(F.get_json_object("json", "$").isNotNull(), F.col("json")))


def text_at(json: Column, name: str) -> Column:
    return F.get_json_object(json, f"$.{name}")


def list_at(json: Column, name: str, item: str) -> Column:
    """A field as an array of ``item``; an object alone is a list of one, anything else none."""
    listed = bound(text_at(json, name), lambda t: F.from_json(F.when(t.startswith("{"), F.concat(F.lit("["), t, F.lit("]"))).when(t.startswith("["), t), f"array<{item}>"))
    return F.coalesce(listed, F.array().cast(f"array<{item}>"))


def strings_at(json: Column, name: str) -> Column:
    return list_at(json, name, "string")


def blank(c: Column) -> Column:
    return strip(F.coalesce(c, F.lit(""))) == ""


def _text_errors(json: Column, name: str, most: int) -> list[Column]:
    t = text_at(json, name)
    return [F.when(F.coalesce(t, F.lit("")) == "", f"{name}:missing"), F.when(F.length(t) > most, f"{name}:too_long")]


def _url_errors(json: Column, allowed: Column) -> list[Column]:
    u = strip(text_at(json, "original_url"))
    fine = u.isNull() | (u == "")
    return [F.when(~fine & ~u.startswith("https://"), "original_url:not_https"), F.when(~fine & u.startswith("https://") & ~F.array_contains(allowed, u), "original_url:not_allowed")]


def _any_missing(items: Column, *names: str) -> Column:
    return F.exists(items, lambda x: reduce(lambda a, b: a | b, [x.isNull() | x[n].isNull() for n in names]))


SIGNAL = "struct<theme:string,insight:string,actionable_item:string,link:string>"
ITEM = "struct<entity:string,impact_or_action:string,url:string>"
ACTION = "struct<label:string,url:string>"
BLOCK = "struct<text:string,cta:string>"
CARD = "struct<role:string,title:string,tldr:string,key_points:string,why_it_matters:string,watchouts:string>"
DIAGRAM = "struct<title:string,diagram_type:string,content:string>"


def course_summary(json: Column) -> Column:
    """The summary; of an old entry that has only a reason, the reason on one line."""
    old = text_at(json, "summary").isNull() & text_at(json, "actions").isNull() & text_at(json, "reason").isNotNull()
    flat = strip(F.regexp_replace(text_at(json, "reason"), r"(?U)\s+", " "))
    return F.when(old, F.when(flat == "", "Legacy noise entry (no summary).").otherwise(flat)).otherwise(F.coalesce(text_at(json, "summary"), F.lit("")))


def promo_blocks(json: Column) -> Column:
    return F.transform(list_at(json, "promo_blocks", BLOCK), lambda b: F.struct(b["text"].alias("text"), F.from_json(b["cta"], ACTION).alias("cta")))


def _lines(text: Column) -> Column:
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def kind_errors(kind: str, json: Column, allowed: Column) -> list[Column]:
    """The errors of a payload of a kind, each null where it does not hold, in the order they are reported."""
    if kind in ("router", "classifier"):
        c = F.get_json_object(json, "$.confidence").try_cast("double")
        return [F.when(~F.coalesce(coerced_category(text_at(json, "category")).isin(*CATEGORIES), F.lit(False)), "category:invalid"), F.when(~F.coalesce(c.between(0, 1), F.lit(False)), "confidence:invalid")]
    if kind == "technology":
        return [*_text_errors(json, "title", 500), *_text_errors(json, "core_pain_point", 240), *_url_errors(json, allowed)]
    if kind == "radar":
        return [F.when(_any_missing(list_at(json, "items", ITEM), "entity", "impact_or_action"), "items:missing_field")]
    if kind == "leadership":
        s = list_at(json, "signals", SIGNAL)
        outside = F.exists(s, lambda x: ~blank(x["link"]) & ~F.array_contains(allowed, strip(x["link"])))
        return [F.when(_any_missing(s, "theme", "insight", "actionable_item"), "signals:missing_field"), F.when((F.size(s) == 0) & blank(text_at(json, "summary")), "empty"), F.when(outside, "signals:not_allowed")]
    if kind in ("courses", "noise"):
        a, b, s = list_at(json, "actions", ACTION), promo_blocks(json), course_summary(json)
        urls = F.concat(F.transform(a, lambda x: strip(x["url"])), F.transform(b, lambda x: strip(x["cta"]["url"])))
        urls = F.filter(urls, lambda u: u.isNotNull())
        return [
            F.when(F.length(s) > 4000, "summary:too_long"),
            F.when(_any_missing(a, "label", "url"), "actions:missing_field"),
            F.when(F.exists(b, lambda x: x.isNull() | x["text"].isNull() | x["cta"]["label"].isNull() | x["cta"]["url"].isNull()), "promo_blocks:missing_field"),
            F.when(F.exists(a, lambda x: F.length(x["label"]) > 200) | F.exists(b, lambda x: F.length(x["cta"]["label"]) > 200), "label:too_long"),
            F.when(F.exists(b, lambda x: F.length(x["text"]) > 2000), "promo_blocks:too_long"),
            F.when(F.exists(urls, lambda u: ~u.startswith("https://")), "url:not_https"),
            F.when(blank(s) & (F.size(a) == 0) & (F.size(b) == 0), "empty"),
            F.when(F.size(F.array_except(urls, allowed)) > 0, "url:not_allowed"),
        ]
    if kind in ("leadership_essay", "technical_longform"):
        parts, main = (ESSAY_PARTS, "core_thesis") if kind == "leadership_essay" else (LONGFORM_PARTS, "central_topic")
        none = reduce(lambda a, b: a & b, [F.size(strings_at(json, p)) == 0 for p, _ in parts])
        shape = [] if kind == "leadership_essay" else [F.when(~F.coalesce(text_at(json, "format").isin(*FORMATS), F.lit(False)), "format:invalid")]
        return [*_text_errors(json, "title", 500), *shape, *_text_errors(json, main, 800), F.when(none, "empty"), *_url_errors(json, allowed)]
    if kind == "ainews_radar_digest":
        c = list_at(json, "cards", CARD)
        more = lambda n, most: F.when(F.exists(c, lambda x: F.size(_lines(x[n])) > most), f"{n}:too_many")
        over = [more(n, most) for n, most in (("key_points", 7), ("why_it_matters", 3), ("watchouts", 3))]
        role = lambda x: F.coalesce(x["role"], F.lit("recap"))
        return [
            F.when(_any_missing(c, "title", "tldr"), "cards:missing_field"),
            F.when(F.exists(c, lambda x: ~role(x).isin("top_story", "recap")), "role:invalid"),
            *over,
            F.when(F.size(c) == 0, "cards:empty"),
            F.when(F.size(c) > 3, "cards:too_many"),
            F.when(F.size(F.filter(c, lambda x: role(x) == "top_story")) > 1, "top_story:too_many"),
        ]
    raise ValueError(f"no such kind: {kind}")


CHECKED = ("router", "classifier", "technology", "radar", "leadership", "courses", "noise", "leadership_essay", "technical_longform", "ainews_radar_digest")


def validated(log: DataFrame, allowed: Column) -> DataFrame:
    """The rows of ``log`` (with ``json``) and ``errors``: what is wrong with each payload of a known kind, an empty array where nothing is."""
    out = None
    for kind in CHECKED:
        of = log.where(F.col("kind") == kind)
        errors = F.when(F.col("json").isNull(), F.array(F.lit("payload:unreadable"))).otherwise(F.array_compact(F.array(*kind_errors(kind, F.col("json"), allowed))))
        of = of.withColumn("errors", errors)
        out = of if out is None else out.unionByName(of)
    return out


def allowed_links(links: Column, articles: bool = False) -> Column:
    """The links an output may name: https ones, once each; of articles those that are no image."""
    u = F.array_distinct(https(links))
    return F.filter(u, lambda x: ~is_image_url(x)) if articles else u


_PART = "struct<label:string,text:string,url:string>"


def _part(label: Column, text: Column, url: Column | None = None) -> Column:
    return F.struct(label.cast("string").alias("label"), text.cast("string").alias("text"), (F.lit(None) if url is None else url).cast("string").alias("url"))


def _grouped(json: Column, parts) -> Column:
    labelled = lambda name, label: F.transform(strings_at(json, name), lambda t: _part(F.lit(label), t))
    return F.concat(*[labelled(name, label) for name, label in parts])


def shaped(rows: DataFrame) -> DataFrame:
    """Rows of the lists of a page: the columns of ``rows`` and list, card_no, title, url, body, note, parts.

    ``rows``: outputs with ``json``; only those whose category is that of their
    kind are shown, unreadable ones are not.
    """
    x = rows.where(F.col("json").isNotNull() & F.coalesce(coerced_category(F.col("category")) == kind_category(F.col("kind")), F.lit(False)))
    j, none = F.col("json"), F.lit(None).cast("string")
    url = lambda: F.when(~blank(text_at(j, "original_url")), strip(text_at(j, "original_url")))

    def of(kinds: tuple[str, ...], name: str, title: Column, link: Column, body: Column, note: Column, parts: Column) -> DataFrame:
        return x.where(F.col("kind").isin(*kinds)).select(*rows.columns, F.lit(name).alias("list"), F.lit(0).alias("card_no"), title.alias("title"), link.alias("url"), body.alias("body"), note.alias("note"), parts.cast(f"array<{_PART}>").alias("parts"))

    signals = F.transform(list_at(j, "signals", SIGNAL), lambda s: _part(s["theme"], F.concat_ws(" — ", s["insight"], s["actionable_item"]), s["link"]))
    items = F.transform(list_at(j, "items", ITEM), lambda i: _part(i["entity"], i["impact_or_action"], i["url"]))
    diagrams = F.transform(list_at(j, "diagrams", DIAGRAM), lambda d: _part(d["diagram_type"], F.concat_ws("\n\n", d["title"], d["content"])))
    actions = F.transform(list_at(j, "actions", ACTION), lambda a: _part(a["label"], none, a["url"]))
    promos = F.transform(promo_blocks(j), lambda b: _part(b["cta"]["label"], b["text"], b["cta"]["url"]))
    out = [
        of(("technology",), "technical_index", text_at(j, "title"), url(), text_at(j, "core_pain_point"), none, diagrams),
        of(("technical_longform",), "technical_index", text_at(j, "title"), url(), text_at(j, "central_topic"), text_at(j, "format"), _grouped(j, LONGFORM_PARTS)),
        of(("radar",), "ai_radar", none, none, text_at(j, "summary"), none, items),
        of(("leadership",), "leadership_signals", none, none, text_at(j, "summary"), none, signals),
        of(("leadership_essay",), "leadership_essays", text_at(j, "title"), url(), text_at(j, "core_thesis"), none, _grouped(j, ESSAY_PARTS)),
        of(("courses", "noise"), "courses", none, none, course_summary(j), none, F.concat(actions, promos)),
    ]
    cards = x.where("kind = 'ainews_radar_digest'").select(*rows.columns, F.posexplode(list_at(j, "cards", CARD)).alias("card_no", "c"))
    name = F.when(F.coalesce("c.role", F.lit("recap")) == "top_story", "ai_radar_top_story").otherwise("ai_radar_recap")
    # of the key points five are shown
    lines = lambda n: F.slice(_lines(F.col(f"c.{n}")), 1, rules.SHOWN_KEY_POINTS) if n == "key_points" else _lines(F.col(f"c.{n}"))
    labelled = lambda n, label: F.transform(lines(n), lambda t: _part(F.lit(label), t))
    parts = F.concat(*[labelled(n, label) for n, label in CARD_PARTS])
    out.append(cards.select(*rows.columns, name.alias("list"), "card_no", F.col("c.title").alias("title"), none.alias("url"), F.col("c.tldr").alias("body"), none.alias("note"), parts.cast(f"array<{_PART}>").alias("parts")))
    return reduce(lambda a, b: a.unionByName(b), out)


def row_html(subject: Column, sender: Column, heading: Column) -> Column:
    """The markup of one shaped row, every value escaped."""
    div = lambda c, css="": F.concat(F.lit(f"<div{css}>"), c, F.lit("</div>"))
    when = lambda c, html: F.when(F.coalesce(c, F.lit("")) != "", html).otherwise("")
    linked = lambda text, link: F.when(F.coalesce(link, F.lit("")) != "", F.concat(F.lit('<a href="'), escaped(link), F.lit('">'), escaped(text), F.lit("</a>"))).otherwise(escaped(text))
    entry = lambda p: F.concat(F.lit("<li><strong>"), linked(p["label"], p["url"]), F.lit("</strong> "), escaped(p["text"]), F.lit("</li>"))
    parts = F.when(F.size("parts") > 0, F.concat(F.lit("<ul>"), F.array_join(F.transform("parts", entry), ""), F.lit("</ul>"))).otherwise("")
    return F.concat(
        F.lit('<div class="item">'),
        when(heading, div(F.concat(F.lit("<strong>"), escaped(heading), F.lit("</strong>")), ' class="sub"')),
        div(F.concat(F.lit("<strong>"), escaped(subject), F.lit("</strong>"))),
        when(sender, div(F.concat(F.lit("From: "), escaped(sender)), ' class="sub"')),
        when(F.col("title"), div(linked(F.col("title"), F.col("url")))),
        when(F.col("body"), div(escaped(F.col("body")))),
        when(F.col("note"), div(F.concat(F.lit("Format: "), escaped(F.col("note"))), ' class="sub"')),
        parts,
        F.lit("</div>"),
    )


def pages(rows: DataFrame, by: str, title: str, notes: Column | None = None) -> DataFrame:
    """``by`` and html: a page of all seven lists from rows (``by``, list, place, html); empty lists say so.

    A page is bounded by what one digest holds; its rows are ordered by ``place``.
    """
    per = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("list", "place", "html"))).alias("s"), (F.first(notes) if notes is not None else F.first(F.lit(""))).alias("notes"))
    part = lambda name: F.array_join(F.transform(F.filter("s", lambda r: r["list"] == name), lambda r: r["html"]), "")
    lists = [F.concat(F.lit(f"<h2>{head}</h2>"), bound(part(name), lambda t: F.when(t == "", '<p class="sub">No items in this section.</p>').otherwise(t))) for name, head in LISTS.items()]
    note = F.when(F.coalesce("notes", F.lit("")) != "", F.concat(F.lit('<p class="sub">'), escaped(F.col("notes")), F.lit("</p>"))).otherwise("")
    return per.select(by, F.concat(F.lit(f"<html><body><h1>{title}</h1>"), note, *lists, F.lit("</body></html>")).alias("html"))
