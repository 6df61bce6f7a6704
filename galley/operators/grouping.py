"""Grouping of ordered sections into content units: islands, links, shapes, profiles, boundary proposals.

All of it is windows and aggregates within one email; an email's sections are
few, so its arrays are bounded by the mail itself.  Ordering is by
(order_index, id), which has no ties.  Null headings, texts and link lists
count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from galley.functions import rules
from galley.functions.predicates import combined, https, interrupt_parts, interrupt_rule, is_promo, is_recap_heading, is_strippable, is_teaser, lowered_heading, role_of, story_paths, strip, text_of


def _by_email():
    return Window.partitionBy("email_id").orderBy("order_index", "id")


def _so_far():
    return _by_email().rowsBetween(Window.unboundedPreceding, 0)


def _whole():
    return Window.partitionBy("email_id")


def positioned(sections: DataFrame) -> DataFrame:
    """Adds ``position`` (from 0) and ``n_sections`` of the email."""
    return sections.withColumn("position", F.row_number().over(_by_email()) - 1).withColumn("n_sections", F.count(F.lit(1)).over(_whole()))


def with_roles(sections: DataFrame, **phrases) -> DataFrame:
    """Adds position, n_sections, role and rule of every section; texts are looked at before the window, not in it."""
    y = sections.withColumns({"_text": combined(), "_head": lowered_heading()})
    parts = interrupt_parts(F.col("_text"), F.col("_head"), **phrases)
    x = positioned(y.withColumns({f"_{k}": c for k, c in parts.items()}).drop("_text", "_head"))
    x = x.withColumn("rule", interrupt_rule(F.col("_sure"), F.col("_light"), F.col("_rest"), F.col("position"), F.col("n_sections")))
    return x.withColumn("role", role_of(F.col("rule"))).drop("_sure", "_light", "_rest")


def recap_split(sections: DataFrame, **phrases) -> DataFrame:
    """Adds ``part`` (hero or recap) and the email's ``boundary_heading``; without a boundary all is hero."""
    x = sections.withColumn("_b", is_recap_heading(F.col("heading"), **phrases))
    x = x.withColumn("part", F.when(F.max("_b").over(_so_far()), "recap").otherwise("hero"))
    first = F.min(F.when(F.col("_b"), F.struct("order_index", "id", "heading"))).over(_whole())
    return x.withColumn("boundary_heading", first["heading"]).drop("_b")


def runs(sections: DataFrame, keywords=rules.PROMO_KEYWORDS) -> DataFrame:
    """The sections that are not promotional, with the number of their contiguous run (from 0)."""
    x = sections.withColumn("_p", is_promo(keywords)).withColumn("_n", F.sum(F.col("_p").cast("int")).over(_so_far()))
    kept = x.where(~F.col("_p"))
    return kept.withColumn("run_no", F.dense_rank().over(Window.partitionBy("email_id").orderBy("_n")) - 1).drop("_p", "_n")


def grouping_decision(sections: DataFrame, keywords=rules.PROMO_KEYWORDS) -> DataFrame:
    """Per email: n_plain (not promotional), n_urls, n_chars, numbered, ambiguous and the reasons."""
    head = strip(text_of("heading"))
    x = sections.select("email_id", (~is_promo(keywords)).alias("plain"), F.length(text_of("text")).alias("n"), head.alias("head"), F.array_distinct(https(F.col("links"))).alias("urls"))
    plain, head = F.col("plain"), F.col("head")
    per = x.groupBy("email_id").agg(
        F.sum(plain.cast("int")).alias("n_plain"),
        F.sum(F.when(plain, F.col("n")).otherwise(0)).alias("n_chars"),
        F.sum((plain & head.rlike(rules.NUMBERED_PATTERN)).cast("int")).alias("n_numbered"),
        F.count(F.when(plain & (F.length(head) > 3), head)).alias("n_heads"),
        F.count_distinct(F.when(plain & (F.length(head) > 3), head)).alias("n_heads_distinct"),
    )
    urls = x.select("email_id", F.explode_outer(F.when(plain, F.col("urls"))).alias("u")).groupBy("email_id").agg(F.count_distinct("u").alias("n_urls"))
    y = per.join(urls, "email_id")
    lo, hi = rules.GRAY_ZONE
    long_form = (F.col("n_plain") <= hi) & (F.col("n_chars") >= rules.LONG_FORM_CHARS) & (F.col("n_urls") <= 1)
    numbered_all = F.col("n_numbered") >= 2
    ambiguous = (F.col("n_plain") > 1) & ~numbered_all & (F.col("n_urls") < rules.SPLIT_URLS) & ~long_form & F.col("n_plain").between(lo, hi)
    mixed = (F.col("n_heads") >= 3) & (F.col("n_heads_distinct") >= 3)
    reasons = F.array_compact(F.array(F.lit("section_count_gray_zone"), F.when(mixed, "mixed_heading_pattern"), F.when(F.col("n_urls").between(1, 2), "ambiguous_url_count")))
    return y.select("email_id", "n_plain", "n_urls", "n_chars", numbered_all.alias("numbered"), ambiguous.alias("ambiguous"), F.when(ambiguous, F.array_join(reasons, ",")).otherwise("").alias("reasons"))


def final_groups(sections: DataFrame, keywords=rules.PROMO_KEYWORDS) -> DataFrame:
    """Adds ``group_no`` in reading order: promotional sections alone, the others by run, or one each where the email has many links."""
    decided = grouping_decision(sections, keywords).select("email_id", (F.col("n_urls") >= rules.SPLIT_URLS).alias("_each"))
    x = sections.withColumn("_p", is_promo(keywords)).join(decided, "email_id")
    starts = F.col("_p") | F.col("_each") | F.coalesce(F.lag("_p").over(_by_email()), F.lit(True))
    return x.withColumn("_start", starts.cast("int")).withColumn("group_no", F.sum("_start").over(_so_far()) - 1).drop("_p", "_each", "_start")


def units(grouped: DataFrame, group: str = "group_no") -> DataFrame:
    """One row per unit: email_id, content_unit_key, unit_text, headings, links, section_keys."""
    item = F.struct("order_index", "id", F.col("heading").alias("heading"), text_of("text").alias("text"), https(F.col("links")).alias("links"), strip(F.col("section_key")).alias("key"))
    per = grouped.groupBy("email_id", group).agg(F.array_sort(F.collect_list(item)).alias("s"))
    texts = F.filter(F.transform("s", lambda x: x["text"]), lambda t: strip(t) != "")
    return per.select(
        "email_id",
        F.concat(F.lit("u"), F.dense_rank().over(Window.partitionBy("email_id").orderBy(group)) - 1).alias("content_unit_key"),
        F.array_join(texts, "\n\n").alias("unit_text"),
        F.filter(F.transform("s", lambda x: x["heading"]), lambda h: h.isNotNull() & (h != "")).alias("headings"),
        F.array_distinct(F.flatten(F.transform("s", lambda x: x["links"]))).alias("links"),
        F.transform("s", lambda x: x["key"]).alias("section_keys"),
    )


def boundary_errors(proposed: DataFrame, sections: DataFrame, keywords=rules.PROMO_KEYWORDS) -> DataFrame:
    """Of proposed groups (email_id, group_no, section_key): each section that a group skips, with the error.

    A range join within the email: position between the group's first and last.
    """
    pos = positioned(sections).select("email_id", "section_key", "position", is_promo(keywords).alias("hard"))
    placed = proposed.join(pos, ["email_id", "section_key"])
    span = placed.groupBy("email_id", "group_no").agg(F.min("position").alias("lo"), F.max("position").alias("hi"), F.count(F.lit(1)).alias("n")).where("n > 1")
    between = span.join(pos, "email_id").where("position between lo and hi").select("email_id", "group_no", "section_key", "hard")
    skipped = between.join(placed.select("email_id", "group_no", "section_key"), ["email_id", "group_no", "section_key"], "left_anti")
    return skipped.select("email_id", "group_no", "section_key", F.when(F.col("hard"), "spans_hard_boundary").otherwise("non_contiguous_group").alias("error"))


def coverage_errors(proposed: DataFrame, wanted: DataFrame) -> DataFrame:
    """Keys (email_id, section_key) that are proposed twice, missing or invented."""
    count = proposed.groupBy("email_id", "section_key").agg(F.count(F.lit(1)).alias("n"))
    twice = count.where("n > 1").select("email_id", "section_key", F.lit("duplicate_section_key").alias("error"))
    missing = wanted.select("email_id", "section_key").join(count, ["email_id", "section_key"], "left_anti").withColumn("error", F.lit("missing_section_key"))
    invented = count.select("email_id", "section_key").join(wanted, ["email_id", "section_key"], "left_anti").withColumn("error", F.lit("invented_section_key"))
    return twice.unionByName(missing).unionByName(invented)


def overlap_errors(proposed: DataFrame, sections: DataFrame) -> DataFrame:
    """Groups whose span begins before the span of the group before them ends."""
    pos = positioned(sections).select("email_id", "section_key", "position")
    span = proposed.join(pos, ["email_id", "section_key"]).groupBy("email_id", "group_no").agg(F.min("position").alias("lo"), F.max("position").alias("hi"))
    w = Window.partitionBy("email_id").orderBy("lo", "group_no")
    return span.withColumn("before", F.lag("hi").over(w)).where("lo <= before").select("email_id", "group_no", "lo", "before", F.lit("overlapping_units").alias("error"))


def profile_merge(sections: DataFrame, article_min: int = rules.ARTICLE_CHARS, promo_share: float = 0.5, **phrases) -> DataFrame:
    """Per email the merged article of its body sections, the keys hidden from it, and the evidence against the merge."""
    x = with_roles(sections, **phrases)
    hide = is_strippable(F.col("role"))
    item = F.struct("order_index", "id", text_of("text").alias("text"), strip(F.col("section_key")).alias("key"), hide.alias("hide"))
    per = x.groupBy("email_id").agg(
        F.array_sort(F.collect_list(item)).alias("s"),
        F.sum(F.length(text_of("text"))).alias("total_chars"),
        F.sum(F.when(hide, F.length(text_of("text"))).otherwise(0)).alias("hidden_chars"),
    )
    kept = F.filter("s", lambda i: ~i["hide"])
    text = F.array_join(F.filter(F.transform(kept, lambda i: i["text"]), lambda t: strip(t) != ""), "\n\n")
    y = per.select("email_id", text.alias("article_text"), F.transform(kept, lambda i: i["key"]).alias("section_keys"), F.transform(F.filter("s", lambda i: i["hide"]), lambda i: i["key"]).alias("hidden_keys"), "total_chars", "hidden_chars")
    y = y.withColumn("article_chars", F.length(strip(F.col("article_text"))))
    against = F.when(F.col("article_chars") < article_min, "empty_body").when((F.col("total_chars") > 0) & (F.col("hidden_chars") / F.col("total_chars") > promo_share), "promo_dominated")
    return y.withColumn("counter_evidence", against)


def merged_hash(sections: DataFrame, strategy: str = "single_article", unit: str = "u0", **phrases) -> DataFrame:
    """Per email a hash over the content hashes of its body sections in order; their keys do not enter it."""
    x = with_roles(sections, **phrases).where(~is_strippable(F.col("role")))
    per = x.groupBy("email_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("order_index", "id", F.coalesce("content_hash", F.lit("")).alias("h")))), lambda i: i["h"]).alias("section_content_hashes"))
    body = F.to_json(F.struct(F.lit(unit).alias("content_unit_key"), F.col("section_content_hashes"), F.lit(strategy).alias("strategy")))
    return per.select("email_id", F.sha2(body, 256).alias("merged_hash"))


def outline(sections: DataFrame, snippet: int = 280) -> DataFrame:
    """What a boundary scorer sees of each section: heading, snippet, counts and the first three https links."""
    links = https(F.col("links"))
    return sections.select("email_id", "id", "order_index", strip(F.col("section_key")).alias("section_key"), "heading", F.substring(text_of("text"), 1, snippet).alias("snippet"), F.length(text_of("text")).alias("char_count"), F.size(links).alias("link_count"), F.slice(links, 1, 3).alias("primary_links"))


def outline_hashes(sections: DataFrame, snippet: int = 280) -> DataFrame:
    """Per email the first 16 hex digits of the hash of its outline, in JSON with blanks behind separators and ASCII escapes."""
    from galley.functions.json_text import outline_digest

    item = F.struct("order_index", "id", "section_key", "heading", "char_count", F.length("snippet").alias("snippet_len"))
    per = outline(sections, snippet).groupBy("email_id").agg(F.array_sort(F.collect_list(item)).alias("s"))
    return per.select("email_id", outline_digest(F.to_json("s")).alias("outline_hash"))


def composite_hash(hashes: Column) -> Column:
    """One hash of several: the hash itself if there is one, else that of all joined by ``|``."""
    return F.when(F.size(hashes) == 1, F.get(hashes, F.lit(0))).otherwise(F.substring(F.sha2(F.array_join(hashes, "|"), 256), 1, 16))


def story_links(sections: DataFrame, **paths) -> DataFrame:
    """email_id, id, place, path: the story path of each link that has one."""
    x = sections.select("email_id", "id", F.posexplode(story_paths(F.col("links"), **paths)).alias("place", "path"))
    return x.where("path is not null")


def dominant(links: DataFrame, canonical: DataFrame | None = None) -> DataFrame:
    """email_id, id, path: the path that at least half of a section's story links have, the first one on ties; else the mail's own story, if the section links to it.

    ``canonical``: email_id, canonical.
    """
    n = links.groupBy("email_id", "id", "path").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("place"))
    if canonical is None:
        n = n.withColumn("_own", F.lit(False))
    else:
        n = n.join(canonical, "email_id", "left").withColumn("_own", F.coalesce(F.col("path") == F.col("canonical"), F.lit(False)))
    per = n.groupBy("email_id", "id").agg(F.sum("n").alias("total"), F.max(F.struct("n", (-F.col("place")).alias("first"), "path")).alias("best"), F.max(F.when(F.col("_own"), F.col("path"))).alias("own"))
    path = F.when(F.col("best.n") * 2 >= F.col("total"), F.col("best.path")).otherwise(F.col("own"))
    return per.select("email_id", "id", path.alias("path")).where("path is not null")


def dominant_paths(sections: DataFrame, **paths) -> DataFrame:
    """``dominant`` over the story links of sections."""
    return dominant(story_links(sections, **paths))


def shapes(sections: DataFrame, substantive: int = rules.SUBSTANTIVE_CHARS, least_stories: int = 2, keywords=rules.PROMO_KEYWORDS, teasers=rules.TEASER_PHRASES, **paths) -> DataFrame:
    """Per email: article_chars, n_stories and shape (teaser_paywall, multi_story or single_article)."""
    flagged = sections.select("email_id", "id", F.length(text_of("text")).alias("n"), (~is_promo(keywords) & ~is_teaser(teasers, keywords)).alias("body"))
    links = story_links(sections, **paths)
    chars = flagged.where("body").groupBy("email_id").agg(F.sum("n").alias("chars"))
    stories = links.select("email_id", "path").distinct()
    blocks = dominant(links).join(flagged.where("body").select("id", "n"), "id").groupBy("email_id", "path").agg(F.sum("n").alias("n"))
    strong = stories.join(blocks, ["email_id", "path"], "left").groupBy("email_id").agg(F.count(F.lit(1)).alias("n_stories"), F.bool_and(F.coalesce(F.col("n") >= substantive, F.lit(False))).alias("strong"))
    x = sections.select("email_id").distinct().join(chars, "email_id", "left").join(strong, "email_id", "left")
    article, n = F.coalesce("chars", F.lit(0)), F.coalesce("n_stories", F.lit(0))
    shape = F.when(article < substantive, "teaser_paywall").when((n >= least_stories) & F.col("strong"), "multi_story").otherwise("single_article")
    return x.select("email_id", article.alias("article_chars"), n.alias("n_stories"), shape.alias("shape"))


def story_units(sections: DataFrame, keywords=rules.PROMO_KEYWORDS, teasers=rules.TEASER_PHRASES, **paths) -> DataFrame:
    """Units of one story each: body sections by their dominant path, units in order of the path; others are left out."""
    body = sections.where(~is_promo(keywords) & ~is_teaser(teasers, keywords))
    placed = body.join(dominant_paths(body, **paths).select("id", "path"), "id")
    return units(placed, "path")


def excluded_keys(sections: DataFrame, keywords=rules.PROMO_KEYWORDS, teasers=rules.TEASER_PHRASES) -> DataFrame:
    """email_id and section_keys, in order, of the sections that are no article body: teasers and promotional ones."""
    x = sections.where(is_promo(keywords) | is_teaser(teasers, keywords)).select("email_id", F.struct("order_index", "id", strip(F.col("section_key")).alias("key")).alias("s"))
    return x.groupBy("email_id").agg(F.transform(F.array_sort(F.collect_list("s")), lambda i: i["key"]).alias("section_keys"))


def article_units(sections: DataFrame, keywords=rules.PROMO_KEYWORDS, teasers=rules.TEASER_PHRASES) -> DataFrame:
    """One unit per email of all its body sections; an email without any has none."""
    return units(sections.where(~is_promo(keywords) & ~is_teaser(teasers, keywords)).withColumn("group_no", F.lit(0)))


def grouped_units(sections: DataFrame, profiles: DataFrame, keywords=rules.PROMO_KEYWORDS, teasers=rules.TEASER_PHRASES, **paths) -> DataFrame:
    """The units of every email, with ``way``: by runs and links, or by the shape of the emails in ``profiles`` (email_id).

    An email with a profile has one unit if it is a single article, one per
    story if it is several, none if it is a teaser.
    """
    listed = profiles.select("email_id").distinct()
    plain = sections.join(listed, "email_id", "left_anti").select(sections.columns)
    known = sections.join(listed, "email_id", "left_semi").select(sections.columns)
    # an email of promotional sections only has no units
    some = plain.where(~is_promo(keywords)).select("email_id").distinct()
    generic = units(final_groups(plain.join(some, "email_id", "left_semi").select(sections.columns), keywords)).withColumn("way", F.lit("generic"))
    shape = shapes(known, keywords=keywords, teasers=teasers, **paths).select("email_id", "shape")
    of = lambda name: known.join(shape.where(F.col("shape") == name), "email_id", "left_semi").select(sections.columns)
    single = article_units(of("single_article"), keywords, teasers).withColumn("way", F.lit("single_article"))
    multi = story_units(of("multi_story"), keywords, teasers, **paths).withColumn("way", F.lit("multi_story"))
    return generic.unionByName(single).unionByName(multi)


def profile_plans(sections: DataFrame, profiles: DataFrame, **how) -> DataFrame:
    """email_id, kind, section_keys and merged_hash of the emails with a profile (email_id, kind) whose sections say nothing against the merge.

    ``how``: the phrases of the interrupt rules.
    """
    known = sections.join(profiles.select("email_id").distinct(), "email_id", "left_semi").select(sections.columns)
    plan = profile_merge(known, **how).where("counter_evidence is null").select("email_id", "section_keys")
    return plan.join(profiles.select("email_id", "kind"), "email_id").join(merged_hash(known, **how), "email_id").select("email_id", "kind", "section_keys", "merged_hash")


def proposal_errors(proposed: DataFrame, sections: DataFrame, wanted: DataFrame, keywords=rules.PROMO_KEYWORDS) -> DataFrame:
    """All that is wrong with proposed groups (email_id, group_no, section_key; a null key is an empty group): email_id, group_no, section_key, error.

    ``wanted``: the keys (email_id, section_key) of the run.  Keys that are in
    the email but not in the run are told from invented ones.
    """
    none = F.lit(None)
    keyed = proposed.where("section_key is not null")
    empty = proposed.groupBy("email_id", "group_no").agg(F.count("section_key").alias("n")).where("n = 0").select("email_id", "group_no", none.cast("string").alias("section_key"), F.lit("empty_unit").alias("error"))
    known = sections.select("email_id", strip(F.col("section_key")).alias("section_key")).distinct().withColumn("_known", F.lit(True))
    coverage = coverage_errors(keyed, wanted).join(known, ["email_id", "section_key"], "left")
    outside = F.when((F.col("error") == "invented_section_key") & F.col("_known"), "section_outside_run").otherwise(F.col("error"))
    coverage = coverage.select("email_id", none.cast("int").alias("group_no"), "section_key", outside.alias("error"))
    overlap = overlap_errors(keyed, sections).select("email_id", "group_no", none.cast("string").alias("section_key"), "error")
    return empty.unionByName(coverage).unionByName(boundary_errors(keyed, sections, keywords)).unionByName(overlap)


def accepted_groups(sections: DataFrame, proposed: DataFrame, errors: DataFrame) -> DataFrame:
    """``sections`` with ``group_no``: the proposed groups with the promotional sections between them, in reading order.

    A proposal with an error is refused for its email: there every section stands alone.
    """
    placed = positioned(sections).withColumn("_k", strip(F.col("section_key")))
    bad = errors.select("email_id").distinct().withColumn("_bad", F.lit(True))
    x = placed.join(proposed.select("email_id", F.col("group_no").alias("_g"), F.col("section_key").alias("_k")), ["email_id", "_k"], "left").join(bad, "email_id", "left")
    first = F.min("position").over(Window.partitionBy("email_id", "_g"))
    start = F.when(F.col("_g").isNull() | F.coalesce("_bad", F.lit(False)), F.col("position")).otherwise(first)
    x = x.withColumn("_s", start).withColumn("group_no", F.dense_rank().over(Window.partitionBy("email_id").orderBy("_s")) - 1)
    return x.select(*sections.columns, "group_no")
