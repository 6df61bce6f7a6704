"""Column builders: text and URL predicates that stay inside whole-stage code generation."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from galley.functions import rules

# Fixed value: the characters that count as white space at the ends of a text.
BLANK = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends (a plain ``trim`` knows only blanks)."""
    return F.btrim(c, F.lit(BLANK))


def any_of(c: Column, phrases: Iterable[str]) -> Column:
    """True where one of the phrases stands anywhere in ``c``."""
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(p)) for p in phrases])


def hits(c: Column, phrases: Iterable[str]) -> Column:
    """How many of the phrases stand in ``c``."""
    return reduce(lambda a, b: a + b, [F.contains(c, F.lit(p)).cast("int") for p in phrases])


def bound(c: Column, f) -> Column:
    """``f`` of the value of ``c``, which is computed once however often ``f`` uses it, in filters too."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def lowered() -> Column:
    """Heading and text as they are, in lower case, joined by a blank."""
    h, t = text_of("heading"), text_of("text")
    return F.lower(F.concat_ws(" ", F.when(h != "", h), F.when(t != "", t)))


def text_of(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def combined(heading: str = "heading", text: str = "text") -> Column:
    """Heading and text in lower case, joined by one blank, blank parts left out."""
    parts = F.transform(F.array(text_of(heading), text_of(text)), strip)
    return F.lower(F.array_join(F.filter(parts, lambda p: p != ""), " "))


def lowered_heading(heading: str = "heading") -> Column:
    return F.lower(strip(text_of(heading)))


def https(links: Column) -> Column:
    """The stripped https links, in order."""
    return F.filter(F.transform(F.coalesce(links, F.array().cast("array<string>")), strip), lambda u: u.startswith("https://"))


def is_promo(keywords=rules.PROMO_KEYWORDS, least: int = 2) -> Column:
    """At least ``least`` of the keywords stand in heading and text (joined as they are)."""
    return bound(lowered(), lambda t: hits(t, keywords) >= least)


def interrupt_parts(text: Column, head: Column, footer=rules.FOOTER_PHRASES, navigation=rules.NAVIGATION_PHRASES, subscription=rules.SUBSCRIPTION_PHRASES, promo=rules.PROMO_KEYWORDS) -> dict[str, Column]:
    """What the interrupt rules need of heading, text and links: ``sure`` (a rule that comes first, or null),
    ``light`` (short and with two links, which counts at the bottom) and ``rest`` (the rule of all others).

    ``text`` and ``head`` are columns of ``combined()`` and ``lowered_heading()``.  None of it needs the section's place, so a
    window over places need not carry texts.
    """
    n = F.length(text_of("text"))
    raw = F.coalesce(F.col("links"), F.array().cast("array<string>"))
    n_https = F.size(F.filter(raw, lambda u: u.startswith("https://")))
    found = hits(text, promo)
    sure = F.when(any_of(text, footer), "footer:unsubscribe_phrase").when(text.rlike(rules.COPYRIGHT_PATTERN), "footer:copyright")
    rest = (
        F.when((n < 200) & ((n_https >= 1) | (n < 120)) & any_of(text, navigation), "navigation:phrase_match")
        .when((n <= 600) & (F.exists(raw, lambda u: F.contains(u, F.lit("substack.com"))) | (n < 350)) & any_of(text, subscription), "subscription_cta:phrase_match")
        .when(any_of(head, rules.PROMO_HEADINGS), "promo:strong_heading_marker")
        .when(any_of(text, rules.PROMO_BODIES), "promo:body_marker")
        .when(any_of(head, rules.SPONSOR_FRAGMENTS), "promo:sponsor_class_substring")
        .when(found == 1, "unknown_interrupt:single_promo_keyword")
        .when(found >= 2, "unknown_interrupt:multi_promo_keyword")
        .when((n < 80) & (n_https >= 2), "unknown_interrupt:short_link_heavy")
        .otherwise("normal_content:default")
    )
    return {"sure": sure, "light": (n < 400) & (n_https >= 2), "rest": rest}


def interrupt_rule(sure: Column, light: Column, rest: Column, index: Column, total: Column) -> Column:
    """The first rule that holds, in the order footer, navigation, subscription, promo, unknown, normal."""
    bottom = (total > 0) & (index >= F.floor(total * F.lit(0.9))) & light
    return F.when(sure.isNotNull(), sure).when(bottom, "footer:bottom_tenth_link_heavy").otherwise(rest)


def role_of(rule: Column) -> Column:
    return F.substring_index(rule, ":", 1)


def is_strippable(role: Column) -> Column:
    return role.isin("promo", "navigation", "footer", "subscription_cta")


def is_recap_heading(heading: Column, exact=rules.RECAP_EXACT, parts=rules.RECAP_PARTS) -> Column:
    h = strip(F.regexp_replace(F.lower(F.coalesce(heading, F.lit(""))), r"(?U)\s+", " "))
    return (h != "") & (h.isin(*exact) | any_of(h, parts) | h.rlike(rules.RECAP_PATTERN) | (h.endswith(" recap") & (F.length(h) <= 40)))


def is_teaser(phrases=rules.TEASER_PHRASES, keywords=rules.PROMO_KEYWORDS) -> Column:
    """A teaser phrase, or a promotional section below 600 characters."""
    short = F.length(text_of("text")) < 600
    return bound(lowered(), lambda t: any_of(t, phrases) | ((hits(t, keywords) >= 2) & short))


def url_part(url: Column, part: str) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit(part)), F.lit(""))


def _query_names(query: Column) -> Column:
    return F.transform(F.filter(F.split(F.lower(query), "&"), lambda p: p != ""), lambda p: F.substring_index(p, "=", 1))


def _is_tracking_name(name: Column) -> Column:
    return name.isin(*rules.TRACKING_NAMES) | reduce(lambda a, b: a | b, [name.startswith(p) for p in rules.TRACKING_PREFIXES])


def has_tracking_query(url: Column) -> Column:
    """All parameters are tracking ones, and there are at least two."""
    names = _query_names(url_part(url, "QUERY"))
    n_all, n_bad = F.size(names), F.size(F.filter(names, _is_tracking_name))
    return (n_all > 0) & (n_bad >= F.greatest(F.lit(2), n_all))


def without_tracking(url: Column) -> Column:
    """The URL without its tracking parameters and without a slash at the end of its path; fragments go."""
    base = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"/+$", "")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~_is_tracking_name(F.lower(F.substring_index(p, "=", 1)))), "&")
    return F.when(query == "", url).when(kept == "", base).otherwise(F.concat(base, F.lit("?"), kept))


def is_social(url: Column) -> Column:
    return any_of(F.lower(url), rules.SOCIAL_FRAGMENTS)


def is_tracking_host(url: Column) -> Column:
    u = F.lower(url)
    return any_of(F.concat(url_part(u, "HOST"), url_part(u, "PATH")), rules.TRACKING_HOSTS)


def is_unsubscribe(url: Column, anchor: Column) -> Column:
    """A path that names leaving; of mail links one by its anchor text alone; else a query token or the anchor text."""
    u = F.lower(url)
    named = F.lower(strip(anchor)).isin(*rules.UNSUBSCRIBE_ANCHORS)
    other = F.when(F.contains(u, F.lit("mailto:")), named).otherwise(any_of(url_part(u, "QUERY"), rules.UNSUBSCRIBE_QUERIES) | named)
    return any_of(url_part(u, "PATH"), rules.UNSUBSCRIBE_PATHS) | other


def is_noise_link(url: Column, anchor: Column | None = None) -> Column:
    return is_unsubscribe(url, anchor if anchor is not None else F.lit("")) | is_tracking_host(url) | is_social(url)


def is_image_url(url: Column) -> Column:
    path = url_part(F.lower(url), "PATH")
    return reduce(lambda a, b: a | b, [path.endswith(s) for s in rules.IMAGE_SUFFIXES])


def article_links(links: Column) -> Column:
    """The links, in order, that are no image."""
    return F.filter(F.coalesce(links, F.array().cast("array<string>")), lambda u: ~is_image_url(u))


def story_path(url: Column, hosts: Iterable[str] | None = None, excluded: Iterable[str] = (), patterns: Iterable[str] = (r"^/[^/]+/[^/]+$",)) -> Column:
    """host + path of a story link: allowed host, no excluded prefix, a path of one of the patterns; else null."""
    u = without_tracking(url)
    host, path = F.lower(url_part(u, "HOST")), F.regexp_replace(F.lower(url_part(u, "PATH")), r"/+$", "")
    ok = (path != "") & reduce(lambda a, b: a | b, [path.rlike(p) for p in patterns])
    if hosts is not None:
        ok &= host.isin(*hosts)
    for p in excluded:
        ok &= ~path.startswith(p)
    return F.when(ok & (host != ""), F.concat(host, path))


def story_paths(links: Column, hosts: Iterable[str] | None = None, excluded: Iterable[str] = (), patterns: Iterable[str] = (r"^/[^/]+/[^/]+$",)) -> Column:
    """``story_path`` of each link of an array, in stages: every part of a link is taken out once."""
    clean = F.transform(F.coalesce(links, F.array().cast("array<string>")), without_tracking)
    parts = F.transform(clean, lambda u: F.struct(F.lower(url_part(u, "HOST")).alias("h"), F.regexp_replace(F.lower(url_part(u, "PATH")), r"/+$", "").alias("p")))

    def path(x: Column) -> Column:
        ok = (x["h"] != "") & (x["p"] != "") & reduce(lambda a, b: a | b, [x["p"].rlike(p) for p in patterns])
        if hosts is not None:
            ok &= x["h"].isin(*hosts)
        for e in excluded:
            ok &= ~x["p"].startswith(e)
        return F.when(ok, F.concat(x["h"], x["p"]))

    return F.transform(parts, path)


#: Path markers before the target, and query keys that hold one, where a tracker's rule names none.
PATH_MARKERS, QUERY_KEYS = ("/cl0/", "/cl1/"), ("url", "redirect", "u")


def unwrapped_link(url: Column, hosts: Iterable[str] | dict[str, Iterable[str]], keys: Iterable[str] = QUERY_KEYS, by_query: Iterable[str] = ()) -> Column:
    """The target inside a click tracker's link, percent-decoded; else the link itself.

    ``hosts``: the trackers' hosts, each with its path markers (without a mapping
    the usual ones): the target is what stands in the path behind the first marker
    that has one.  Hosts that hold one of ``by_query`` carry it in one of ``keys``.
    """
    rules_of = {h: tuple(m) for h, m in hosts.items()} if isinstance(hosts, dict) else dict.fromkeys(hosts, PATH_MARKERS)
    u = F.coalesce(strip(url), F.lit(""))
    host = F.lower(url_part(u, "HOST"))
    path = F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    decoded = lambda c: strip(F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), F.lit("")))
    target = lambda c: bound(decoded(c), lambda t: F.when(t.rlike("^https?://"), t))
    found = []
    for h, markers in rules_of.items():
        for m in markers:
            at = F.locate(m, F.lower(path))
            found.append(F.when((host == h) & (at > 0), target(F.substr(path, at + len(m)))))
    for part in by_query:
        for k in keys:
            # of a query's value a plus is a blank; the value read is decoded like a path once more
            value = F.try_url_decode(F.regexp_extract(u, rf"[?&]{k}=([^&#]+)", 1))
            found.append(F.when(F.contains(host, F.lit(part)), target(value)))
    return F.coalesce(*found, u) if found else u


def confidence_band(confidence: Column) -> Column:
    return F.when(confidence < rules.CONFIDENCE_MIN, "fail").when(confidence < rules.CONFIDENCE_PROCESS, "warn").otherwise("process")


def warned(warnings: Column, confidence: Column) -> Column:
    """The warnings, with one more where the confidence is in the middle band; each once."""
    w = F.coalesce(warnings, F.array().cast("array<string>"))
    low = F.lit("classification_low_confidence")
    return F.when((confidence_band(confidence) == "warn") & ~F.array_contains(w, low), F.concat(w, F.array(low))).otherwise(w)


def html_problems(html: Column, least: int = 120) -> Column:
    """ARRAY of the problems of a rendered page, in the order they are checked."""
    low = F.lower(html)
    return F.array_compact(
        F.array(
            F.when(F.contains(html, F.lit("\x00")), "nul_byte"),
            F.when(F.contains(low, F.lit("<script")), "forbidden_script_tag"),
            F.when(~F.contains(low, F.lit("<html")), "missing_html_root"),
            F.when(~F.contains(low, F.lit("</html>")), "missing_html_close"),
            F.when(F.length(strip(html)) < least, "body_too_short"),
            F.when(F.contains(html, F.lit("{{")) | F.contains(html, F.lit("{%")), "unrendered_template_markup"),
        )
    )


def repaired_html(html: Column, problems: Column) -> Column:
    """The page with each listed problem mended, in the order of the checks."""
    has = lambda p: F.array_contains(problems, p)
    out = F.when(has("forbidden_script_tag"), F.regexp_replace(html, r"(?is)<script\b.*?(?:</script\s*>|$)", "")).otherwise(html)
    out = F.when(has("missing_html_root"), F.concat(F.lit("<html><body>"), out)).otherwise(out)
    out = F.when(has("missing_html_close"), F.concat(out, F.lit("</body></html>"))).otherwise(out)
    filler = "<p>" + "This page was filled up to its least length. " * 8 + "</p>"
    out = F.when(has("body_too_short"), F.when(F.lower(out).contains("</body>"), F.regexp_replace(out, r"(?is)^(.*)(</body>)", "$1" + filler + "$2")).otherwise(F.concat(out, F.lit(filler)))).otherwise(out)
    out = F.when(has("nul_byte"), F.replace(out, F.lit("\x00"), F.lit(""))).otherwise(out)
    for a, b in (("{{", "("), ("}}", ")"), ("{%", "(%"), ("%}", "%)")):
        out = F.when(has("unrendered_template_markup"), F.replace(out, F.lit(a), F.lit(b))).otherwise(out)
    return out


def escaped(c: Column) -> Column:
    """HTML-escaped text; null is empty."""
    out = F.coalesce(c.cast("string"), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def without_fence(c: Column) -> Column:
    """The content of a code fence around a model's answer; without one, the stripped text."""
    s = strip(c)
    inner = F.regexp_extract(s, r"(?s)^```[A-Za-z0-9]*\s*(.*?)\s*```$", 1)
    return F.when(s.rlike(r"(?s)^```[A-Za-z0-9]*\s*.*?\s*```$"), inner).otherwise(s)


#: Wrappings that are taken off a payload.
LEVELS = 8


def unwrapped(payload: Column, levels: int = LEVELS) -> Column:
    """The JSON text of a payload without what is wrapped around it."""
    blank = BLANK + "﻿​"

    def peel(c: Column, _: Column) -> Column:
        s = F.btrim(c, F.lit(blank))
        fence = F.btrim(F.regexp_extract(s, r"(?s)^```+[ \t]*[A-Za-z0-9_+.-]*(.*?)```+$", 1), F.lit(blank))
        text = F.get_json_object(F.concat(F.lit('{"v":'), s, F.lit("}")), "$.v")
        return F.when(s.startswith("```"), fence).when(s.startswith('"'), F.coalesce(text, s)).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(levels)), payload.cast("string"), peel)
