"""Relational state over snapshots: upsert, keyed replace, append-only log, latest per key, cascades.

A snapshot is a table; an operator returns the next one.  ``publish`` writes it
to a new folder and adds a pointer through the file system of that folder, so readers never see half a snapshot.
Null keys group together; "latest" is the greatest id, never the newest time.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from galley.functions.predicates import unwrapped
from galley.session import materialize


def upsert_emails(emails: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """Messages merged into emails by message_id: texts overwritten, a missing time kept, status pending, error and retries cleared.

    Of a message listed twice the one with most labels counts (then the greatest
    thread id); new ids go on from the greatest one.
    """
    n_labels = F.size(F.coalesce("label_ids", F.array().cast("array<string>"))) if "label_ids" in incoming.columns else F.lit(0)
    order = F.struct(n_labels, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("thread_id", "subject", "sender", "snippet", "received_at") if c in incoming.columns])
    one = incoming.where("message_id is not null").groupBy("message_id").agg(F.max_by(F.struct("subject", "sender", "snippet", "received_at"), order).alias("m"))
    both = emails.alias("e").join(one.alias("i"), F.col("e.message_id") == F.col("i.message_id"), "full")
    hit = F.col("i.message_id").isNotNull()
    pick = lambda new, old: F.when(hit, F.col(new)).otherwise(F.col(old))
    x = both.select(
        F.col("e.id").alias("id"),
        F.coalesce("e.message_id", "i.message_id").alias("message_id"),
        pick("i.m.subject", "e.subject").alias("subject"),
        pick("i.m.sender", "e.sender").alias("sender"),
        pick("i.m.snippet", "e.body_preview").alias("body_preview"),
        F.when(hit, "pending").otherwise(F.col("e.status")).alias("status"),
        F.when(hit, 0).otherwise(F.col("e.retry_count")).cast("int").alias("retry_count"),
        F.when(~hit, F.col("e.error_message")).alias("error_message"),
        F.when(hit, F.coalesce("i.m.received_at", "e.received_at")).otherwise(F.col("e.received_at")).alias("received_at"),
        F.coalesce("e.created_at", now).alias("created_at"),
        F.when(hit, now).otherwise(F.col("e.updated_at")).alias("updated_at"),
    )
    return with_new_ids(x, "id", emails, F.col("message_id"))


def with_new_ids(x: DataFrame, key: str, current: DataFrame, order: Column, buckets: int = 256) -> DataFrame:
    """Fills null keys with the numbers behind the greatest one of ``current``, by bucket (a hash of ``order``) and ``order``.

    Rows are numbered within their bucket and the buckets offset by a running
    count, so no task orders all new rows; equal input gives equal numbers.
    """
    # read three times below: computed once, kept in the shared scratch folder
    x = materialize(x, "unnumbered")
    fresh = x.where(F.col(key).isNull()).withColumn("_b", F.conv(F.substring(F.md5(order.cast("string")), 1, 2), 16, 10).cast("int") % buckets)
    counts = fresh.groupBy("_b").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("_b", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    top = current.agg(F.coalesce(F.max(key), F.lit(0))).scalar()
    numbered = fresh.withColumn("_n", F.row_number().over(Window.partitionBy("_b").orderBy(order))).join(F.broadcast(before), "_b")
    filled = numbered.withColumn(key, (top + F.col("_before") + F.col("_n")).cast("long")).select(x.columns)
    return x.where(F.col(key).isNotNull()).unionByName(filled)


def numbered(x: DataFrame, order: str, width: int = 2) -> DataFrame:
    """``x`` with ``n``, the place of each row by the text ``order`` (from 0), without one task that orders all rows.

    Rows are numbered within the prefix of ``width`` more characters than all
    values share; the prefixes, a bounded number of rows, are offset by a running count.
    """
    ends = x.agg(F.min(order).alias("lo"), F.max(order).alias("hi")).first()
    lo, hi = ends["lo"] or "", ends["hi"] or ""
    shared = next((i for i, (a, b) in enumerate(zip(lo, hi, strict=False)) if a != b), min(len(lo), len(hi)))
    y = x.withColumn("_p", F.substring(order, 1, shared + width))
    counts = y.groupBy("_p").agg(F.count(F.lit(1)).alias("m"))
    before = counts.select("_p", F.coalesce(F.sum("m").over(Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    y = y.withColumn("_n", F.row_number().over(Window.partitionBy("_p").orderBy(order)) - 1).join(before, "_p")
    return y.withColumn("n", F.col("_before") + F.col("_n")).select(*x.columns, "n")


def latest(log: DataFrame, keys: list[str], order: str = "id") -> DataFrame:
    """The row of the greatest ``order`` of each key; null keys are keys."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return log.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def positioned_listing(sections: DataFrame) -> DataFrame:
    """The sections of each email in order: email_id, section_id, section_key, position."""
    w = Window.partitionBy("email_id").orderBy("order_index", "id")
    return sections.select("email_id", F.col("id").alias("section_id"), "section_key", (F.row_number().over(w) - 1).alias("position"))


def latest_outputs(log: DataFrame, sections: DataFrame) -> DataFrame:
    """Latest output per (email, section, unit, kind) with its section's key, order and heading."""
    top = latest(log, ["email_id", "email_section_id", "content_unit_key", "kind"])
    s = sections.select(F.col("id").alias("email_section_id"), "section_key", F.col("order_index").alias("section_order"), F.col("heading").alias("section_heading"))
    return top.join(s, "email_section_id", "left")


def replace_sections(current: DataFrame, parsed: DataFrame) -> DataFrame:
    """Keyed replace of the sections of the emails in ``parsed``: same (email, key, hash) keeps its id, the rest is new or gone.

    Adds ``change``: kept, inserted or untouched (emails not in ``parsed``).
    """
    touched = parsed.select("email_id").distinct()
    others = current.join(touched, "email_id", "left_anti").withColumn("change", F.lit("untouched"))
    old = current.select("email_id", "section_key", "content_hash", F.col("id").alias("id"), "created_at")
    # of a key parsed twice the first section in order counts, the smaller hash on ties
    first = Window.partitionBy("email_id", "section_key").orderBy("order_index", "content_hash")
    new = parsed.drop("id", "created_at").withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    joined = new.join(old, ["email_id", "section_key", "content_hash"], "left").withColumn("change", F.when(F.col("id").isNull(), "inserted").otherwise("kept"))
    numbered = with_new_ids(joined, "id", current, F.concat_ws("-", F.lpad(F.col("email_id").cast("string"), 20, "0"), "section_key"))
    return others.unionByName(numbered.select(others.columns))


def cascade(log: DataFrame, sections: DataFrame) -> DataFrame:
    """Outputs whose section is still there; those without a section stay."""
    ids = sections.select(F.col("id").alias("email_section_id"))
    tied = log.where("email_section_id is not null").join(ids, "email_section_id", "left_semi").select(log.columns)
    return log.where("email_section_id is null").unionByName(tied)


def without(log: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition does not hold; a null is no match."""
    return log.where(~F.coalesce(condition, F.lit(False)))


def append_checked(log: DataFrame, rows: DataFrame, sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(next log, refused rows): an output of a section must belong to that section's email; ids go on from the greatest.

    A router's category has to be that of its payload, and is taken from there
    where it is null; an unreadable payload of a router is refused.  Blank unit
    keys count as null.
    """
    s = sections.select(F.col("id").alias("email_section_id"), F.col("email_id").alias("_owner"))
    x = rows.join(s, "email_section_id", "left")
    router, named = F.col("kind") == "router", F.get_json_object(unwrapped(F.col("payload")), "$.category")
    key = F.trim(F.col("content_unit_key"))
    x = x.withColumn("_named", F.when(router, named)).withColumn("content_unit_key", F.when(key != "", key))
    fine = F.col("email_section_id").isNull() | (F.col("_owner") == F.col("email_id"))
    fine = fine & (~router | (F.col("_named").isNotNull() & F.coalesce(F.col("category") == F.col("_named"), F.lit(True))))
    x = x.withColumn("_fine", F.coalesce(fine, F.lit(False))).withColumn("category", F.when(router & F.col("_fine"), F.col("_named")).otherwise(F.col("category")))
    good = x.where("_fine").drop("_owner", "_named", "_fine")
    bad = x.where("not _fine").drop("_owner", "_named", "_fine")
    order = F.concat_ws("-", F.lpad(F.col("email_id").cast("string"), 20, "0"), F.coalesce("content_unit_key", F.lit("")), "kind", F.md5(F.coalesce("payload", F.lit(""))))
    numbered = with_new_ids(good.withColumn("id", F.lit(None).cast("long")), "id", log, order)
    return log.unionByName(numbered.select(log.columns)), bad


def complete_emails(log: DataFrame, sections: DataFrame, first: str, others: Column) -> DataFrame:
    """email_id and complete: every section has an output of kind ``first`` and one for which ``others`` holds."""
    top = latest(log.where("email_section_id is not null"), ["email_id", "email_section_id", "kind"])
    by = top.groupBy("email_section_id").agg(F.bool_or(F.col("kind") == first).alias("a"), F.bool_or(others).alias("b"))
    x = sections.select("email_id", F.col("id").alias("email_section_id")).join(by, "email_section_id", "left")
    return x.groupBy("email_id").agg(F.bool_and(F.coalesce(F.col("a") & F.col("b"), F.lit(False))).alias("complete"))


def category_sets(log: DataFrame, sections: DataFrame, kind: str = "router") -> DataFrame:
    """email_id and its sorted categories, null where a section has none."""
    top = latest(log.where(F.col("kind") == kind), ["email_id", "email_section_id"]).where("email_section_id is not null")
    x = sections.select("email_id", F.col("id").alias("email_section_id")).join(top.select("email_section_id", "category"), "email_section_id", "left")
    per = x.groupBy("email_id").agg(F.array_sort(F.collect_set("category")).alias("c"), F.bool_and(F.col("category").isNotNull()).alias("all"))
    return per.select("email_id", F.when(F.col("all"), F.array_join("c", ",")).alias("categories"))


def attach(pairs: DataFrame, new: DataFrame) -> DataFrame:
    """Insert-or-ignore of pairs."""
    return pairs.unionByName(new).distinct()


def candidates(emails: DataFrame, attached: DataFrame, retries: int) -> DataFrame:
    """Pending emails and failed ones below the cap, each once, with the smallest digest they hang on."""
    d = attached.groupBy("email_id").agg(F.min("digest_id").alias("digest_id"))
    x = emails.where((F.col("status") == "pending") | ((F.col("status") == "failed") & (F.col("retry_count") < retries)))
    return x.join(d, F.col("id") == F.col("email_id"), "left").select("id", "status", "retry_count", "digest_id", F.when(F.col("status") == "pending", 0).otherwise(1).alias("turn"))


def newest_in_day(digests: DataFrame, day: str | None = None) -> DataFrame:
    """Per UTC day (or of one day) the digest created last; the greatest id on ties."""
    x = digests.withColumn("day", F.to_date("created_at"))
    if day is not None:
        start = F.lit(day).cast("timestamp")
        x = digests.where((F.col("created_at") >= start) & (F.col("created_at") < start + F.expr("interval 1 day"))).withColumn("day", F.to_date("created_at"))
    w = Window.partitionBy("day").orderBy(F.col("created_at").desc(), F.col("id").desc())
    return x.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def with_status(rows: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Rows with new status, error (kept where none is given) and retry count of ``changes`` (id, status, error_message, retry)."""
    c = changes.select(F.col("id").alias("_id"), F.col("status").alias("_s"), F.col("error_message").alias("_e"), F.col("retry").alias("_t"))
    x = rows.join(c, F.col("id") == F.col("_id"), "left")
    hit = F.col("_id").isNotNull()
    x = x.withColumn("status", F.when(hit, F.col("_s")).otherwise(F.col("status"))).withColumn("error_message", F.coalesce("_e", "error_message"))
    if "retry_count" in rows.columns:
        x = x.withColumn("retry_count", (F.col("retry_count") + F.when(hit & F.coalesce("_t", F.lit(False)), 1).otherwise(0)).cast("int"))
    return x.withColumn("updated_at", F.when(hit, now).otherwise(F.col("updated_at"))).select(rows.columns)


def created_digests(digests: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Digests with new rows (title, body_html; status draft where none is given): ids go on from the greatest, no error, both times now."""
    rows = new.select(F.lit(None).cast("long").alias("id"), F.coalesce("status", F.lit("draft")).alias("status"), "title", "body_html", F.lit(None).cast("string").alias("error_message"), now.alias("created_at"), now.alias("updated_at"))
    numbered = with_new_ids(rows, "id", digests, F.concat_ws("-", F.coalesce("title", F.lit("")), F.md5(F.coalesce("body_html", F.lit("")))))
    return digests.unionByName(numbered.select(digests.columns))


def with_bodies(digests: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Digests with the body of ``changes`` (id, body_html, title); a title is kept where none is given."""
    c = changes.select(F.col("id").alias("_id"), F.col("body_html").alias("_b"), F.col("title").alias("_t"))
    x = digests.join(c, F.col("id") == F.col("_id"), "left")
    hit = F.col("_id").isNotNull()
    x = x.withColumn("body_html", F.when(hit, F.col("_b")).otherwise(F.col("body_html"))).withColumn("title", F.coalesce("_t", "title"))
    return x.withColumn("updated_at", F.when(hit, now).otherwise(F.col("updated_at"))).select(digests.columns)


def shape_decisions(shapes: DataFrame, excluded: DataFrame, stories: DataFrame, merged: DataFrame) -> DataFrame:
    """email_id and payload (JSON) of the decision on the shape of each email: a row of the log of kind ``shape_classifier``.

    ``shapes``: email_id, profile_id, shape, article_chars; ``excluded`` and
    ``merged``: email_id, section_keys; ``stories``: email_id, path.
    """
    none = F.array().cast("array<string>")
    urls = stories.groupBy("email_id").agg(F.array_sort(F.collect_set("path")).alias("urls"))
    x = shapes.join(excluded.withColumnRenamed("section_keys", "gone"), "email_id", "left").join(urls, "email_id", "left").join(merged.withColumnRenamed("section_keys", "kept"), "email_id", "left")
    body = F.struct(F.col("profile_id").alias("shape_profile_id"), F.col("shape").alias("digest_shape"), F.coalesce("gone", none).alias("digest_excluded_section_keys"), F.coalesce("urls", none).alias("distinct_canonical_story_urls"), F.col("article_chars").alias("substantive_article_chars"), F.coalesce("kept", none).alias("merged_section_keys"))
    return x.select("email_id", F.to_json(body).alias("payload"))


def reusable_plans(plans: DataFrame, log: DataFrame, unit: str = "u0") -> DataFrame:
    """The plans (email_id, kind, merged_hash) whose outputs stand in the log: the latest classifier names them by profile, hash and kind, and the processor's row is there."""
    of_unit = log.where(F.col("content_unit_key") == unit)
    top = latest(of_unit.where("kind = 'classifier'"), ["email_id"]).select("email_id", unwrapped(F.col("payload")).alias("j"))
    said = top.select("email_id", F.get_json_object("j", "$.routing_source").alias("_s"), F.get_json_object("j", "$.merged_content_hash").alias("_h"), F.get_json_object("j", "$.processor_kind").alias("_k"))
    there = of_unit.select("email_id", "kind").distinct()
    x = plans.join(said, "email_id").where((F.col("_s") == "sender_profile") & (F.col("_h") == F.col("merged_hash")) & (F.col("_k") == F.col("kind")))
    return x.join(there, ["email_id", "kind"], "left_semi").select(plans.columns)


def evolve(df: DataFrame, renamed: dict[str, str], added: dict[str, str]) -> DataFrame:
    """Additive migration: renames where the old column is there, adds missing columns as nulls of a type."""
    out = reduce(lambda d, kv: d.withColumnRenamed(*kv) if kv[0] in d.columns else d, renamed.items(), df)
    return reduce(lambda d, kv: d if kv[0] in d.columns else d.withColumn(kv[0], F.lit(None).cast(kv[1])), added.items(), out)


def _files(spark: SparkSession, folder: str):
    """(file system, path) of a folder, whatever its scheme."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _pointers(spark: SparkSession, folder: str) -> list[int]:
    fs, path = _files(spark, f"{folder.rstrip('/')}/current")
    if not fs.exists(path):
        return []
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(path) if f.getPath().getName().isdigit())


def publish(df: DataFrame, folder: str) -> str:
    """Writes a snapshot beside the others and names it in the next pointer, an empty folder made in one step by the file system.

    The pointer of number n is the folder ``current/n`` and holds one folder
    of the snapshot's name; it is put in place by a rename, which gives it to one
    writer only, so two writers never share a number.
    """
    spark = df.sparkSession
    name = f"v-{uuid.uuid4().hex}"
    path = f"{folder.rstrip('/')}/{name}"
    df.write.parquet(path)
    root = folder.rstrip("/")
    fs, current = _files(spark, f"{root}/current")
    fs.mkdirs(current)
    while True:
        made = _files(spark, f"{root}/.{uuid.uuid4().hex}")[1]
        fs.mkdirs(_files(spark, f"{made}/{name}")[1])
        target = _files(spark, f"{root}/current/{(_pointers(spark, folder) or [-1])[-1] + 1}")[1]
        # a rename onto a folder that came up meanwhile puts ours inside it or fails: then the next number is tried
        if not fs.exists(target) and fs.rename(made, target) and [f.getPath().getName() for f in fs.listStatus(target)] == [name]:
            return path


def has_snapshot(spark: SparkSession, folder: str) -> bool:
    return bool(_pointers(spark, folder))


def snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """The snapshot the last pointer names."""
    fs, path = _files(spark, f"{folder.rstrip('/')}/current/{_pointers(spark, folder)[-1]}")
    name = next(f.getPath().getName() for f in fs.listStatus(path) if f.getPath().getName().startswith("v-"))
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}")
