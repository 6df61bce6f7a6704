"""Queries over HTML: digest pages as stored, and mails rebuilt as pages from their sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from galley.functions.html_parse import parse_pages
from galley.functions.predicates import combined, escaped, html_problems, interrupt_parts, interrupt_rule, is_strippable, lowered_heading, repaired_html, role_of
from galley.session import table


def mail_pages(spark, root):
    """email_id, html: a page per email with heading, lines, links and images of each section, and a footer."""
    s = table(spark, root, "email_sections")
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))
    lines = F.array_join(F.transform(F.split("text", "\n"), lambda x: tag("p", escaped(x))), "")
    links = F.array_join(F.transform("links", lambda u: F.concat(F.lit('<a href="'), escaped(u), F.lit('">more</a>'))), "")
    images = F.array_join(F.transform("image_urls", lambda u: F.concat(F.lit('<img width="640" height="360" src="'), escaped(u), F.lit('">'))), "")
    head = F.when(F.coalesce("heading", F.lit("")) != "", tag("h2", escaped(F.col("heading")))).otherwise(F.lit(""))
    part = F.concat(head, lines, links, images)
    per = s.groupBy("email_id").agg(F.array_sort(F.collect_list(F.struct("order_index", "id", part.alias("p")))).alias("s"))
    body = F.array_join(F.transform("s", lambda x: x["p"]), "")
    footer = '<div class="footer"><a href="https://mail.example/unsubscribe">Unsubscribe</a></div><script>var a = 1;</script>'
    return per.select("email_id", F.concat(F.lit('<html><head><base href="https://mail.example/"></head><body>'), body, F.lit(footer + "</body></html>")).alias("html"))


def p01_parse(spark, root):
    """Pages parsed: sizes, number of sections, first link, original address."""
    x = parse_pages(mail_pages(spark, root), "email_id", "html")
    return x.select("email_id", "plain_text_chars", F.size("sections").alias("n_sections"), F.size("links").alias("n_links"), F.size("image_urls").alias("n_images"), "original_url")


def p08_sections(spark, root):
    """The sections of the parsed pages."""
    x = parse_pages(mail_pages(spark, root), "email_id", "html").select("email_id", F.explode("sections").alias("s"))
    return x.select("email_id", "s.section_key", "s.order_index", "s.heading", F.length("s.text").alias("n_chars"), F.size("s.links").alias("n_links"), F.size("s.image_urls").alias("n_images"))


def p01_digests(spark, root):
    """The stored digest pages parsed."""
    x = parse_pages(table(spark, root, "digests").where("body_html is not null"), "id", "body_html")
    return x.select(F.col("id").alias("digest_id"), "plain_text_chars", F.size("sections").alias("n_sections"), F.size("links").alias("n_links"), F.md5("plain_text").alias("text_md5"))


def entry_audit(spark, root):
    """Pages to sections to interrupt roles to one row per email: the audit, from source to aggregate."""
    x = parse_pages(mail_pages(spark, root), "email_id", "html")
    # the number of an email's sections is the size of its array: no window is needed
    s = x.select("email_id", F.size("sections").alias("n"), F.explode("sections").alias("s")).select("email_id", "n", "s.*")
    s = s.withColumns({"_text": combined(), "_head": lowered_heading()})
    p = interrupt_parts(F.col("_text"), F.col("_head"))
    d = s.withColumn("role", role_of(interrupt_rule(p["sure"], p["light"], p["rest"], F.col("order_index"), F.col("n"))))
    hide, chars = is_strippable(F.col("role")), F.length("text")
    per = d.groupBy("email_id").agg(F.count(F.lit(1)).alias("n_sections"), F.sum(F.when(hide, 0).otherwise(chars)).alias("article_chars"), F.sum(F.when(hide, chars).otherwise(0)).alias("hidden_chars"))
    against = F.when(F.col("article_chars") < 200, "empty_body").when(F.col("hidden_chars") > F.col("article_chars"), "promo_dominated")
    return per.withColumn("counter_evidence", against)


def d23_gate(spark, root):
    """Problems of every digest page, a missing one counted as empty."""
    x = table(spark, root, "digests").select(F.col("id").alias("digest_id"), F.coalesce("body_html", F.lit("")).alias("html"))
    return x.select("digest_id", F.array_join(html_problems(F.col("html")), ",").alias("problems"))


def d24_repair(spark, root):
    """Pages broken in three ways, then repaired: the problems left."""
    x = table(spark, root, "digests").select(F.col("id").alias("digest_id"), F.concat(F.lit("{{ name }}<SCRIPT>alert(1)</SCRIPT>"), F.coalesce("body_html", F.lit(""))).alias("html"))
    y = x.withColumn("before", html_problems(F.col("html"))).withColumn("fixed", repaired_html(F.col("html"), F.col("before")))
    return y.select("digest_id", F.array_join("before", ",").alias("problems_before"), F.array_join(html_problems(F.col("fixed")), ",").alias("problems_after"))


QUERIES = {f"q_{f.__name__}": f for f in (p01_parse, p08_sections, p01_digests, entry_audit, d23_gate, d24_repair)}

_PROBLEMS = """concat_ws(',', CASE WHEN contains(lower(html), '<script') THEN 'forbidden_script_tag' END, CASE WHEN NOT contains(lower(html), '<html') THEN 'missing_html_root' END,
    CASE WHEN NOT contains(lower(html), '</html>') THEN 'missing_html_close' END, CASE WHEN length(trim(html)) < 120 THEN 'body_too_short' END, CASE WHEN contains(html, '{{') OR contains(html, '{%') THEN 'unrendered_template_markup' END)"""
ORACLE = {
    "q_d23_gate": f"SELECT id AS digest_id, {_PROBLEMS} AS problems FROM (SELECT id, coalesce(body_html, '') AS html FROM digests)",
    "q_d24_repair": f"SELECT id AS digest_id, {_PROBLEMS} AS problems_before, '' AS problems_after FROM (SELECT id, '{{{{ name }}}}<SCRIPT>alert(1)</SCRIPT>' || coalesce(body_html, '') AS html FROM digests)",
}
