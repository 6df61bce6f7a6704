"""Processors behind the scorer: candidate links, prompts, dispatch by category, and the repair of links.

Everything but the scorer's own call is Column logic.  Sections (or units, read
as sections) carry: id, subject, heading, text, links, page_links (all links of
the mail) and original_url.  Null texts and link lists count as empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.functions.predicates import https, is_image_url, strip, text_of
from galley.operators.outputs import kind_errors
from galley.operators.scorer import Scorer, scored

# The kind of output of each category.
KIND_OF = {"TECHNOLOGY": "technology", "RADAR": "radar", "LEADERSHIP": "leadership", "COURSES": "courses"}

_NONE = lambda: F.array().cast("array<string>")


def _links(c: Column) -> Column:
    return F.coalesce(c, _NONE())


def _first(url: Column, links: Column) -> Column:
    """``links`` with ``url`` put first where it is an https link that is not among them."""
    u = strip(F.coalesce(url, F.lit("")))
    return F.when(u.startswith("https://") & ~F.array_contains(links, u), F.concat(F.array(u), links)).otherwise(links)


def article_candidates(links: Column, page_links: Column, original_url: Column) -> Column:
    """Links an article's own address may be copied from: those of the section, then of the mail, no images; the original first."""
    own = F.filter(_links(links), lambda u: ~is_image_url(u))
    page = F.filter(_links(page_links), lambda u: ~is_image_url(u))
    more = F.filter(F.array_distinct(page), lambda u: ~F.array_contains(own, u))
    return _first(original_url, F.concat(own, more))


def action_candidates(links: Column, page_links: Column, original_url: Column) -> Column:
    """Links an action may name: https ones of the section and of the mail, once each; the original first."""
    return _first(original_url, F.array_distinct(F.concat(https(links), https(page_links))))


def repaired_url(found: Column, links: Column, page_links: Column, original_url: Column) -> Column:
    """The link of a technology output: as found where it is a candidate, else the only candidate, else the first article link of the mail that is one."""
    oh = strip(F.coalesce(original_url, F.lit("")))
    cand = article_candidates(links, page_links, original_url)
    cand = F.when(oh.startswith("https://"), F.concat(F.array(oh), F.filter(cand, lambda u: u != oh))).otherwise(cand)
    more = F.filter(F.array_distinct(https(links)), lambda u: ~F.array_contains(cand, u))
    cand = F.concat(cand, more)
    page = F.filter(_links(page_links), lambda u: ~is_image_url(u) & F.array_contains(cand, u))
    only = F.when(F.size(cand) == 1, F.get(cand, F.lit(0)))
    return F.when(F.coalesce(F.array_contains(cand, found), F.lit(False)), found).otherwise(F.coalesce(only, F.get(page, F.lit(0)), found))


def single_url(found: Column, candidates: Column) -> Column:
    """The link of an essay or longform output: where it is no candidate and there is just one, that one."""
    hit = F.coalesce(F.array_contains(candidates, found), F.lit(False))
    return F.when(~hit & (F.size(candidates) == 1), F.get(candidates, F.lit(0))).otherwise(found)


# --- prompts ---------------------------------------------------------------------------------------------


def _block(label: str, c: Column, stripped: bool = False) -> Column:
    t = strip(F.coalesce(c, F.lit(""))) if stripped else F.coalesce(c, F.lit(""))
    return F.when(t != "", F.concat(F.lit(label), t))


def numbered_links(links: Column) -> Column:
    lines = F.array_join(F.transform(links, lambda u, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), u)), "\n")
    return F.when(lines == "", "  (none)").otherwise(lines)


def _joined(*blocks: Column) -> Column:
    return F.concat_ws("\n\n", *blocks)


def router_prompt(subject: Column, heading: Column, text: Column) -> Column:
    return _joined(_block("Email subject (optional): ", subject, True), _block("Section heading: ", heading, True), F.concat(F.lit("Section plain text (this slice only):\n"), text_of(text)))


def unit_prompt(subject: Column, title: Column, headings: Column, text: Column, links: Column) -> Column:
    heads = F.filter(F.coalesce(headings, _NONE()), lambda h: h.isNotNull() & (h != ""))
    listed = F.when(F.size(F.coalesce(headings, _NONE())) > 0, F.concat(F.lit("Section headings in this unit:\n"), F.array_join(F.transform(heads, lambda h: F.concat(F.lit("- "), h)), "\n")))
    return _joined(_block("Email subject (optional): ", subject, True), _block("Content unit title: ", title, True), listed, F.concat(F.lit("Candidate HTTPS links:\n"), numbered_links(F.array_distinct(https(links)))), F.concat(F.lit("Content unit plain text:\n"), text_of(text)))


def plain_prompt(subject: Column, heading: Column, text: Column) -> Column:
    return _joined(_block("Subject: ", subject, True), _block("Section heading: ", heading, True), F.concat(F.lit("Section plain text (this slice only):\n"), text_of(text)))


def newsletter_prompt(subject: Column, text: Column) -> Column:
    return _joined(_block("Subject: ", subject), F.concat(F.lit("Plain text:\n"), text_of(text)))


def candidates_prompt(subject: Column, heading: Column, text: Column, links: Column, original_url: Column, title: str) -> Column:
    listed = numbered_links(_first(original_url, F.array_distinct(https(links))))
    return _joined(_block("Subject: ", subject), _block("Section heading: ", heading), F.concat(F.lit(title + "\n"), listed), F.concat(F.lit("Section plain text (this slice only):\n"), text_of(text)))


def page_prompt(subject: Column, text: Column, links: Column, original_url: Column, title: str) -> Column:
    original = strip(F.coalesce(original_url, F.lit("")))
    listed = numbered_links(_first(original_url, F.array_distinct(https(links))))
    return _joined(_block("Subject: ", subject), F.when(original.startswith("https://"), F.concat(F.lit("Original URL (hint): "), original)), F.concat(F.lit(title + "\n"), listed), F.concat(F.lit("Plain text:\n"), text_of(text)))


def _quoted(c: Column) -> Column:
    """A text in single quotes, in double ones where it holds a single quote only; line breaks and backslashes are spelt out."""
    t = c
    for a, b in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        t = F.replace(t, F.lit(a), F.lit(b))
    single, double = F.contains(c, F.lit("'")), F.contains(c, F.lit('"'))
    return F.when(single & ~double, F.concat(F.lit('"'), t, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(t, F.lit("'"), F.lit("\\'")), F.lit("'")))


def boundary_prompts(outline: DataFrame, guesses: DataFrame, mails: DataFrame) -> DataFrame:
    """email_id and prompt of every mail of ``outline``: what a boundary scorer is asked.

    ``outline``: as by ``grouping.outline``; ``guesses``: email_id,
    content_unit_key, section_keys; ``mails``: email_id, sender, subject,
    original_url, hard_keys, reasons (arrays).
    """
    head = F.when(F.coalesce("heading", F.lit("")) != "", _quoted(F.col("heading"))).otherwise("(no heading)")
    line = F.concat(F.lit("["), "section_key", F.lit("] "), head, F.lit(" — "), F.col("char_count").cast("string"), F.lit(" chars, "), F.col("link_count").cast("string"), F.lit(" links"))
    more = F.concat(F.when(F.size("primary_links") > 0, F.concat(F.lit("\n   Links: "), F.array_join("primary_links", ", "))).otherwise(""), F.when(F.col("snippet") != "", F.concat(F.lit("\n   Snippet: "), _quoted(F.col("snippet")))).otherwise(""))
    per = outline.groupBy("email_id").agg(F.array_sort(F.collect_list(F.struct("order_index", "id", line.alias("line"), more.alias("more")))).alias("s"))
    lines = F.array_join(F.transform("s", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["line"], x["more"])), "\n")
    guess = F.concat(F.lit("  - unit "), "content_unit_key", F.lit(": sections ["), F.array_join(F.transform("section_keys", lambda k: F.concat(F.lit("'"), k, F.lit("'"))), ", "), F.lit("]"))
    number = F.regexp_extract("content_unit_key", r"(\d+)$", 1).try_cast("int")
    known = guesses.groupBy("email_id").agg(F.array_sort(F.collect_list(F.struct(number.alias("n"), guess.alias("g")))).alias("u"))
    x = per.join(known, "email_id", "left").join(mails, "email_id", "left")
    original = F.coalesce("original_url", F.lit(""))
    meta = F.array_compact(F.array(_block("- Sender: ", F.col("sender"), True), _block("- Subject: ", F.col("subject"), True), F.when(original.startswith("https://"), F.concat(F.lit("- Original URL: "), strip(original))), F.when(F.size("hard_keys") > 0, F.concat(F.lit("- Hard boundary sections (do not merge across): "), F.array_join("hard_keys", ", ")))))
    prompt = _joined(
        F.when(F.size(meta) > 0, F.concat(F.lit("Email metadata:\n"), F.array_join(meta, "\n"))),
        F.concat(F.lit("Structural outline ("), F.size("s").cast("string"), F.lit(" sections):\n"), lines),
        F.when(F.size("u") > 0, F.concat(F.lit("Deterministic grouping guess:\n"), F.array_join(F.transform("u", lambda g: g["g"]), "\n"))),
        F.when(F.size("reasons") > 0, F.concat(F.lit("Ambiguity reasons: "), F.array_join("reasons", ", "))),
    )
    return x.select("email_id", prompt.alias("prompt"))


_ARTICLES = "Candidate article / original HTTPS URLs (`original_url` must copy exactly one URL from here):"
_SIGNALS = "Candidate HTTPS links (`LeadershipSignal.link` must match one entry when populated):"
_ACTIONS = "Candidate HTTPS links (`actions` / promo CTAs — copy verbatim):"


def processor_prompt(kind: str) -> Column:
    """The prompt of a kind over the columns of a section."""
    subject, heading, text, links, page, original = (F.col(c) for c in ("subject", "heading", "text", "links", "page_links", "original_url"))
    shown = F.when(F.size(_links(links)) > 0, links).otherwise(action_candidates(links, page, original))
    return {
        "technology": lambda: candidates_prompt(subject, heading, text, links, original, _ARTICLES),
        "radar": lambda: plain_prompt(subject, heading, text),
        "leadership": lambda: candidates_prompt(subject, heading, text, shown, original, _SIGNALS),
        "courses": lambda: candidates_prompt(subject, heading, text, shown, original, _ACTIONS),
        "leadership_essay": lambda: unit_prompt(subject, heading, F.array_compact(F.array(heading)), text, links),
        "technical_longform": lambda: unit_prompt(subject, heading, F.array_compact(F.array(heading)), text, links),
    }[kind]()


def candidates_of(kind: str) -> Column:
    columns = [F.col(c) for c in ("links", "page_links", "original_url")]
    return article_candidates(*columns) if kind in ("technology", "leadership_essay", "technical_longform") else action_candidates(*columns)


def dispatched(sections: DataFrame) -> DataFrame:
    """Sections with a category: kind, prompt and candidates of the processor that takes them; other categories are refused by a null kind."""
    out = []
    for category, kind in KIND_OF.items():
        of = sections.where(F.col("category") == category)
        out.append(of.select("*", F.lit(kind).alias("kind"), processor_prompt(kind).alias("prompt"), candidates_of(kind).alias("candidates")))
    other = sections.where(~F.coalesce(F.col("category").isin(*KIND_OF), F.lit(False)))
    out.append(other.select("*", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("prompt"), _NONE().alias("candidates")))
    return reduce(lambda a, b: a.unionByName(b), out)


def units_as_sections(units: DataFrame) -> DataFrame:
    """Units (email_id, content_unit_key, unit_text, headings, links) in the form of sections: the first heading, the unit's key as id."""
    return units.withColumns({"section_key": F.col("content_unit_key"), "heading": F.get("headings", F.lit(0)), "text": F.col("unit_text")})


def processed(work: DataFrame, key: str, scorer: Scorer) -> DataFrame:
    """``key``, kind, value (JSON, link repaired), error and attempts: each row of ``dispatched`` scored once, all kinds in one pass.

    The scorer's answer has to be an object; what is wrong with it by the rules
    of its kind becomes ``error``, and the value stays beside it.
    """
    asked = work.where("kind is not null")
    done = scored(asked, key, "prompt", scorer, lambda value: []).join(asked.select(key, "kind", "candidates", "links", "page_links", "original_url"), key)
    found = F.get_json_object("value", "$.original_url")
    columns = [F.col(c) for c in ("links", "page_links", "original_url")]
    fixed = F.when(F.col("kind") == "technology", repaired_url(found, *columns)).when(F.col("kind").isin("leadership_essay", "technical_longform"), single_url(found, F.col("candidates")))
    # the answer's own object with the one field replaced
    value = F.when(fixed.isNotNull() & ~fixed.eqNullSafe(found), F.to_json(F.map_concat(F.map_filter(F.from_json("value", "map<string,string>"), lambda k, v: k != "original_url"), F.create_map(F.lit("original_url"), fixed)))).otherwise(F.col("value"))
    done = done.withColumn("value", value)
    kinds = [*KIND_OF.values(), "leadership_essay", "technical_longform"]
    errors = reduce(lambda w, k: w.when(F.col("kind") == k, F.array_join(F.array_compact(F.array(*kind_errors(k, F.col("value"), F.col("candidates")))), "; ")), kinds[1:], F.when(F.col("kind") == kinds[0], F.array_join(F.array_compact(F.array(*kind_errors(kinds[0], F.col("value"), F.col("candidates")))), "; ")))
    return done.select(key, "kind", "value", F.coalesce("error", F.when(errors != "", errors)).alias("error"), "attempts")


BOUNDARIES = "struct<confidence:double,units:array<struct<section_keys:array<string>>>>"


def boundary_proposals(prompts: DataFrame, scorer: Scorer) -> DataFrame:
    """email_id, error, confidence and units (arrays of section keys) of every prompt; the scorer is asked once for each, once more if its answer is no object."""
    x = scored(prompts, "email_id", "prompt", scorer, lambda v: [] if isinstance(v.get("units"), list) and isinstance(v.get("confidence"), (int, float)) else ["not a proposal"])
    return x.withColumn("p", F.from_json("value", BOUNDARIES)).select("email_id", "error", F.col("p.confidence").alias("confidence"), F.col("p.units").alias("units"))
