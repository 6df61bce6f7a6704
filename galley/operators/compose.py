"""Composition: from the output log to digest rows, warnings, cards and a rendered page.

Unreadable payloads are set apart by a null struct, not an exception; nested
lists may be null, a single object, or missing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.functions import rules
from galley.functions.predicates import strip, unwrapped

LAST = 2147483647
DIGEST = "ainews_radar_digest"

# Rank and category of each kind of output that is shown.
KINDS = {
    "technology": (10, "TECHNOLOGY"),
    DIGEST: (15, "RADAR"),
    "radar": (20, "RADAR"),
    "leadership": (30, "LEADERSHIP"),
    "leadership_essay": (31, "LEADERSHIP"),
    "technical_longform": (32, "TECHNOLOGY"),
    "courses": (40, "COURSES"),
    "noise": (41, "COURSES"),
}
_when = lambda pairs, c, other: reduce(lambda w, kv: w.when(c == kv[0], kv[1]), pairs[1:], F.when(c == pairs[0][0], pairs[0][1])).otherwise(other)


def kind_rank(kind: Column) -> Column:
    return _when([(k, r) for k, (r, _) in KINDS.items()], kind, 99)


def kind_category(kind: Column) -> Column:
    return _when([(k, c) for k, (_, c) in KINDS.items()], kind, F.lit(None).cast("string"))


def coerced_category(category: Column) -> Column:
    """Old names of categories as the present ones."""
    return F.when(category.isin("EVERY_BUNDLE", "MULTI_BUNDLE"), "TECHNOLOGY").when(category == "NOISE", "COURSES").otherwise(category)


def shown_rows(outputs: DataFrame) -> DataFrame:
    """The outputs that are composed, with ``place`` in reading order of their email.

    A row needs a section or a unit; emails with a digest output show only that
    one; a unit needs a classifier output; emails with a profile show the
    profile's unit only.
    """
    digest = outputs.where((F.col("kind") == DIGEST) & F.col("email_section_id").isNull()).select("email_id").distinct()
    classified = outputs.where((F.col("kind") == "classifier") & F.col("content_unit_key").isNotNull())
    keys = classified.select("email_id", "content_unit_key").distinct()
    profile = classified.where(F.get_json_object(unwrapped(F.col("payload")), "$.routing_source") == "sender_profile")
    profile = profile.groupBy("email_id").agg(F.max_by("content_unit_key", "id").alias("profile_unit"))
    rows = outputs.where(F.col("kind").isin(*KINDS) & (F.col("email_section_id").isNotNull() | F.col("content_unit_key").isNotNull()))
    rows = rows.join(digest, "email_id", "left_anti").join(profile, "email_id", "left")
    rows = rows.where(F.col("content_unit_key").isNull() | F.col("profile_unit").isNull() | (F.col("content_unit_key") == F.col("profile_unit"))).drop("profile_unit")
    with_unit = rows.where("content_unit_key is not null").join(keys, ["email_id", "content_unit_key"], "left_semi").select(rows.columns)
    return rows.where("content_unit_key is null").unionByName(with_unit)


def display_order(rows: DataFrame) -> DataFrame:
    """Adds the sort key of reading order as columns: section_place, unit_place, kind_place."""
    return rows.withColumns({"section_place": F.coalesce("section_order", F.lit(LAST)), "unit_place": F.coalesce("content_unit_key", F.lit("")), "kind_place": kind_rank(F.col("kind"))})


def warnings(outputs: DataFrame) -> DataFrame:
    """id, email_id, kind and warning of the outputs that are left out or do not fit."""
    x = outputs.where(F.col("kind").isin(*KINDS))
    classified = outputs.where((F.col("kind") == "classifier") & F.col("content_unit_key").isNotNull()).select("email_id", "content_unit_key").distinct()
    legacy = x.where(F.col("email_section_id").isNull() & F.col("content_unit_key").isNull() & (F.col("kind") != DIGEST)).withColumn("warning", F.lit("legacy_email_level_processor"))
    orphan = x.where("content_unit_key is not null").join(classified, ["email_id", "content_unit_key"], "left_anti").withColumn("warning", F.lit("unit_processor_without_classifier"))
    category = coerced_category(F.col("category"))
    known = category.isin("TECHNOLOGY", "RADAR", "LEADERSHIP", "COURSES")
    unfit = x.withColumn("warning", F.when(~F.coalesce(known, F.lit(False)), "invalid_category").when(category != kind_category(F.col("kind")), "category_kind_mismatch")).where("warning is not null")
    cols = ["id", "email_id", "kind", "warning"]
    return legacy.select(cols).unionByName(orphan.select(cols)).unionByName(unfit.select(cols))


def labels(emails: DataFrame) -> DataFrame:
    """email_id, subject with its fallback and sender (null where blank)."""
    sender = strip(F.col("sender"))
    return emails.select(F.col("id").alias("email_id"), F.when(F.coalesce("subject", F.lit("")) != "", F.col("subject")).otherwise(F.concat(F.lit("Email #"), F.col("id"))).alias("subject"), F.when(sender != "", sender).alias("sender"))


def cards(outputs: DataFrame) -> DataFrame:
    """id, email_id, card_no, role, title, key_points of the digest outputs; roles split top story from recap."""
    schema = "struct<cards:array<struct<role:string,title:string,tldr:string,key_points:array<string>>>>"
    x = outputs.where(F.col("kind") == DIGEST).select("id", "email_id", F.from_json(unwrapped(F.col("payload")), schema).alias("p"))
    y = x.select("id", "email_id", F.posexplode("p.cards").alias("card_no", "c"))
    return y.select("id", "email_id", "card_no", "c.role", "c.title", "c.tldr", F.coalesce("c.key_points", F.array().cast("array<string>")).alias("key_points"))


def kept_cards(c: DataFrame, total: int = rules.MAX_CARDS, recap: int = rules.MAX_RECAP_CARDS) -> DataFrame:
    """At most ``total`` cards of an output, of them at most ``recap`` recaps; later top stories become recaps."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("id").orderBy("card_no")
    x = c.withColumn("role", F.when((F.col("role") == "top_story") & (F.sum((F.col("role") == "top_story").cast("int")).over(w) == 1), "top_story").otherwise("recap"))
    x = x.withColumn("_r", F.sum((F.col("role") == "recap").cast("int")).over(w)).where((F.col("role") == "top_story") | (F.col("_r") <= recap))
    return x.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= total).drop("_r", "_n")


def ranked_facts(facts: DataFrame, key: str, most: int = rules.MAX_FACTS, noise: str = rules.FACT_NOISE_PATTERN) -> DataFrame:
    """Facts above importance 2 that are no advert, the ``most`` first of each key by (-importance, entity, place)."""
    from pyspark.sql.window import Window

    fine = (F.col("importance") > 2) & ~F.concat_ws(" ", F.coalesce("entity", F.lit("")), F.coalesce("fact", F.lit(""))).rlike(noise)
    w = Window.partitionBy(key).orderBy(F.col("importance").desc(), "entity", "place")
    return facts.where(F.coalesce(fine, F.lit(False))).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def fallback_facts(facts: DataFrame, key: str, kept: DataFrame, most: int = rules.FALLBACK_FACTS) -> DataFrame:
    """For keys of which no fact was kept, the ``most`` first by importance and place."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(key).orderBy(F.col("importance").desc(), "place")
    return facts.join(kept.select(key).distinct(), key, "left_anti").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
