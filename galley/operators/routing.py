"""From units to categories and outputs: registries, cascades, boundary proposals, reuse, map phase.

Scorers see only what rules and caches leave over.  Registries are tables and
small by nature, but are joined by key, never sent whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from galley.functions import rules
from galley.functions.predicates import hits, https, unwrapped, url_part
from galley.operators.scorer import Check, Scorer, scored
from galley.operators.state import latest
from galley.operators.timestamps import sender_address
from galley.session import materialize


def registry_entry(emails: DataFrame, registry: DataFrame) -> DataFrame:
    """email_id and entry: the registry's entry for the sender, by address first, then by domain; the smallest rank on ties.

    ``registry``: entry, rank, address (or null), domain (or null).
    """
    e = emails.select(F.col("id").alias("email_id"), sender_address(F.col("sender")).alias("address")).where("address is not null")
    e = e.withColumn("domain", F.substring_index("address", "@", -1))
    keys = e.select("email_id", F.explode(F.array(F.struct(F.lit(0).alias("by"), F.col("address").alias("key")), F.struct(F.lit(1).alias("by"), F.col("domain").alias("key")))).alias("k")).select("email_id", "k.by", "k.key")
    r = registry.select("entry", "rank", F.explode(F.array(F.struct(F.lit(0).alias("by"), F.lower("address").alias("key")), F.struct(F.lit(1).alias("by"), F.lower("domain").alias("key")))).alias("k")).select("entry", "rank", "k.by", "k.key").where("key is not null")
    found = keys.join(r, ["by", "key"])
    return found.groupBy("email_id").agg(F.min(F.struct("by", "rank", "entry")).alias("m")).select("email_id", F.col("m.entry").alias("entry"))


def distinct_stories(stories: DataFrame, canonical: DataFrame) -> DataFrame:
    """email_id, path: the story paths of an email, those of its own story (same path or same last part) put on the canonical one.

    ``stories``: email_id, path; ``canonical``: email_id, canonical.  An email
    without story paths has its canonical one.
    """
    slug = lambda c: F.element_at(F.split(c, "/"), -1)
    x = stories.join(canonical, "email_id", "left")
    same = (F.col("path") == F.col("canonical")) | ((slug(F.col("path")) != "") & (slug(F.col("path")) == slug(F.col("canonical"))))
    own = x.select("email_id", F.when(F.coalesce(same, F.lit(False)), F.col("canonical")).otherwise(F.col("path")).alias("path")).distinct()
    alone = canonical.where("canonical is not null").join(stories.select("email_id").distinct(), "email_id", "left_anti").select("email_id", F.col("canonical").alias("path"))
    return own.unionByName(alone)


def evidence(headings: Column, text: Column) -> Column:
    """Up to three headings, else the first 240 characters of the text."""
    h = F.slice(F.filter(headings, lambda x: x.isNotNull() & (x != "")), 1, 3)
    return F.when(F.size(h) > 0, h).when(F.coalesce(text, F.lit("")) != "", F.array(F.substring(text, 1, 240))).otherwise(F.array().cast("array<string>"))


def ruled_categories(units: DataFrame, priors: DataFrame, keywords=rules.PROMO_KEYWORDS_SHORT) -> DataFrame:
    """Units with category, confidence, source and evidence by rules; category is null where a scorer has to be asked.

    ``priors``: email_id, category of trusted senders.
    """
    x = units.join(priors.select("email_id", F.col("category").alias("_prior")), "email_id", "left")
    low = F.lower(F.concat_ws(" ", F.array_join("headings", " "), "unit_text"))
    promo = hits(low, keywords) >= 2
    source = F.when(F.col("_prior").isNotNull(), "sender_prior").when(promo, "heuristic")
    category = F.when(F.col("_prior").isNotNull(), F.col("_prior")).when(promo, "COURSES")
    confidence = F.when(F.col("_prior").isNotNull(), 0.9).when(promo, 0.85)
    return x.select("email_id", "content_unit_key", category.alias("category"), confidence.alias("confidence"), source.alias("source"), evidence(F.col("headings"), F.col("unit_text")).alias("evidence"))


def categorised(units: DataFrame, priors: DataFrame, scorer: Scorer, check: Check, keywords=rules.PROMO_KEYWORDS_SHORT) -> DataFrame:
    """Rules first, the scorer for the rest: email_id, content_unit_key, category, confidence, source, error."""
    ruled = materialize(ruled_categories(units, priors, keywords).drop("evidence"), "ruled")
    rest = units.join(ruled.where("category is null").select("email_id", "content_unit_key"), ["email_id", "content_unit_key"])
    rest = rest.select(F.concat_ws("/", "email_id", "content_unit_key").alias("k"), "unit_text")
    answered = materialize(scored(rest, "k", "unit_text", scorer, check), "scored")
    got = F.from_json("value", "struct<category:string,confidence:double>")
    a = answered.select(F.split("k", "/")[0].cast("long").alias("email_id"), F.split("k", "/")[1].alias("content_unit_key"), got["category"].alias("category"), got["confidence"].alias("confidence"), F.lit("scorer").alias("source"), "error")
    done = ruled.where("category is not null").withColumn("error", F.lit(None).cast("string"))
    return done.unionByName(a)


def scoped(units: DataFrame, run: DataFrame) -> DataFrame:
    """Units all of whose sections are in a run; ``run``: email_id, section_keys."""
    x = units.join(run.select("email_id", F.col("section_keys").alias("_run")), "email_id")
    return x.where((F.size("section_keys") > 0) & (F.size(F.array_except("section_keys", "_run")) == 0)).drop("_run")


def run_status(n_sections: Column, enabled: Column, error: Column, problems: Column, confidence: Column, most: int = 12, least: float = rules.CONFIDENCE_PROCESS) -> Column:
    """What becomes of a boundary proposal for one run; all but ``accepted`` fall back to one unit per section."""
    return (
        F.when(~enabled, "disabled")
        .when(n_sections > most, "too_many_sections")
        .when(error.isNotNull(), "scorer_error")
        .when(problems > 0, "validation_failed")
        .when(confidence < least, "low_confidence")
        .otherwise("accepted")
    )


def resolved_groups(proposed: DataFrame, runs: DataFrame, status: DataFrame) -> DataFrame:
    """Final groups of every run: the proposal where it is accepted, else one per section.

    ``proposed``: email_id, run_no, group_no, section_key; ``runs``: email_id,
    run_no, section_key, position; ``status``: email_id, run_no, status.
    """
    x = runs.join(status, ["email_id", "run_no"]).join(proposed, ["email_id", "run_no", "section_key"], "left")
    first = F.min("position").over(Window.partitionBy("email_id", "run_no", "group_no"))
    start = F.when(F.col("status") == "accepted", first).otherwise(F.col("position"))
    return x.withColumn("_s", start).select("email_id", "run_no", "section_key", "position", (F.dense_rank().over(Window.partitionBy("email_id").orderBy("_s")) - 1).alias("group_no"), "status")


def reuse(log: DataFrame, complete: DataFrame, digest_kind: str) -> DataFrame:
    """email_id and reuse: what of an email need not be made again (digest, sections or nothing)."""
    digest = log.where((F.col("kind") == digest_kind) & F.col("email_section_id").isNull()).select("email_id").distinct().withColumn("_d", F.lit(True))
    x = complete.join(digest, "email_id", "left")
    return x.select("email_id", F.when(F.coalesce("_d", F.lit(False)), "digest").when(F.col("complete"), "sections").otherwise("nothing").alias("reuse"))


def map_phase(chunks: DataFrame, scorer: Scorer, check: Check) -> DataFrame:
    """email_id, place, entity, fact, importance: facts of all chunks, each chunk scored once, in order of chunk and fact."""
    keyed = chunks.select(F.concat_ws("/", "email_id", "chunk_index").alias("k"), "text")
    got = F.from_json("value", "struct<facts:array<struct<entity:string,fact:string,importance_score:int>>>")["facts"]
    x = scored(keyed, "k", "text", scorer, check).select(F.split("k", "/")[0].cast("long").alias("email_id"), F.split("k", "/")[1].cast("int").alias("chunk_index"), F.posexplode(got).alias("n", "f"))
    place = F.row_number().over(Window.partitionBy("email_id").orderBy("chunk_index", "n")) - 1
    return x.select("email_id", place.alias("place"), "f.entity", "f.fact", F.coalesce("f.importance_score", F.lit(3)).alias("importance"))


def unit_hash_cache(units: DataFrame, log: DataFrame, kind: str) -> DataFrame:
    """Units whose latest output of a kind is of the same text: email_id, content_unit_key, cached."""
    top = latest(log.where(F.col("kind") == kind).where("content_unit_key is not null"), ["email_id", "content_unit_key"])
    top = top.select("email_id", "content_unit_key", F.get_json_object(unwrapped(F.col("payload")), "$.content_hash").alias("_h"))
    x = units.join(top, ["email_id", "content_unit_key"], "left")
    return x.select("email_id", "content_unit_key", F.coalesce(F.col("_h") == F.sha2("unit_text", 256), F.lit(False)).alias("cached"))


def with_original(found: DataFrame, mails: DataFrame, opted: DataFrame) -> DataFrame:
    """email_id and entry: the entries found by sender, and for the other mails that of the host of their original address.

    ``mails``: email_id, original_url; ``opted``: entry, rank, host of the entries that may be found so; the smallest rank on ties.
    """
    left = mails.join(found.select("email_id"), "email_id", "left_anti").select("email_id", F.lower(url_part(F.col("original_url"), "HOST")).alias("host"))
    by = left.join(opted.select("entry", "rank", F.lower("host").alias("host")), "host").groupBy("email_id").agg(F.min(F.struct("rank", "entry")).alias("m"))
    return found.select("email_id", "entry").unionByName(by.select("email_id", F.col("m.entry").alias("entry")))


def primary_url_counts(sections: DataFrame, stories: DataFrame, profiled: DataFrame) -> DataFrame:
    """email_id and n_urls: of mails with a profile their distinct stories (email_id, path), of others their distinct https links."""
    mails = sections.select("email_id").distinct().join(profiled.select("email_id").distinct().withColumn("_known", F.lit(True)), "email_id", "left")
    urls = sections.select("email_id", F.explode(https(F.col("links"))).alias("u")).groupBy("email_id").agg(F.count_distinct("u").alias("n_links"))
    told = stories.groupBy("email_id").agg(F.count_distinct("path").alias("n_stories"))
    x = mails.join(urls, "email_id", "left").join(told, "email_id", "left")
    return x.select("email_id", F.coalesce(F.when(F.col("_known"), F.col("n_stories")).otherwise(F.col("n_links")), F.lit(0)).cast("long").alias("n_urls"))


def trusted_priors(senders: DataFrame) -> DataFrame:
    """email_id and category of the senders that are trusted (tier, whatever its case, or is_trust) and name a known category (category, else default_category)."""
    tier = F.lower(F.trim(F.coalesce("tier", F.lit("")))) == "trust"
    known = lambda c: F.when(F.trim(F.col(c)).isin("TECHNOLOGY", "RADAR", "LEADERSHIP", "COURSES"), F.trim(F.col(c)))
    x = senders.where(tier | F.coalesce("is_trust", F.lit(False)))
    return x.select("email_id", F.coalesce(known("category"), known("default_category")).alias("category")).where("category is not null")
