"""Queries of routing and delivery over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from galley.functions import predicates as P
from galley.functions import rules
from galley.operators import delivery as D
from galley.operators import grouping as G
from galley.operators import routing as T
from galley.operators import sections as N
from galley.operators import state as R
from galley.plans import sql as SQL
from galley.plans.section_queries import _BLOCK, _DOM, _PROMO, _ROLES, _STRIPPABLE, NAVIGATION, PROMO, STORY
from galley.plans.section_queries import ORACLE as SECTION_ORACLE
from galley.session import table


def _sections(spark, root):
    return table(spark, root, "email_sections")


def _registry(spark, root):
    """The sender registry, and an entry by address for the address that heads a domain."""
    r = table(spark, root, "sender_registry")
    none = F.lit(None).cast("string")
    by_domain = r.select(F.col("category").alias("entry"), F.lit(1).alias("rank"), none.alias("address"), "domain")
    by_address = r.where("category = 'RADAR'").select(F.lit("EDITOR").alias("entry"), F.lit(0).alias("rank"), F.concat(F.lit("editor@"), F.col("domain")).alias("address"), none.alias("domain"))
    return by_domain.unionByName(by_address)


def d16_registry(spark, root):
    return T.registry_entry(table(spark, root, "emails"), _registry(spark, root))


def d14_stories(spark, root):
    s = _sections(spark, root)
    links = G.story_links(s, **STORY)
    first = links.groupBy("email_id").agg(F.min("path").alias("canonical"))
    return T.distinct_stories(links.select("email_id", "path"), first)


def _units(spark, root):
    return G.units(G.final_groups(_sections(spark, root), PROMO))


def _priors(spark, root):
    return d16_registry(spark, root).where("entry in ('LEADERSHIP', 'COURSES')").select("email_id", F.col("entry").alias("category"))


def d21_cascade(spark, root):
    x = T.ruled_categories(_units(spark, root), _priors(spark, root), ("comments", "log in", "share", "app", "issue"))
    return x.select("email_id", "content_unit_key", "category", "confidence", "source", F.array_join("evidence", "|").alias("evidence"))


def c05_units_scored(spark, root):
    """Every unit categorised: rules, then a deterministic scorer for the rest."""
    import json

    def scorer(prompt, attempt, error):
        return json.dumps({"category": "TECHNOLOGY" if len(prompt) > 800 else "RADAR", "confidence": 0.8 if attempt == 1 else 0.6})

    x = T.categorised(_units(spark, root), _priors(spark, root), scorer, lambda v: [] if v.get("category") else ["none"])
    return x.groupBy("category", "source").agg(F.count(F.lit(1)).alias("n_units"), F.count("error").alias("n_errors"))


def g10_scoped(spark, root):
    run = G.runs(_sections(spark, root), PROMO).where("run_no = 0").groupBy("email_id").agg(F.collect_list(P.strip(F.col("section_key"))).alias("section_keys"))
    return T.scoped(_units(spark, root), run).select("email_id", "content_unit_key", F.array_join("section_keys", ",").alias("section_keys"))


def g22_resolved(spark, root):
    """Runs with a proposal of pairs; whether it is taken depends on the run's size and a confidence by its length."""
    runs = G.runs(_sections(spark, root), PROMO)
    pos = G.positioned(_sections(spark, root)).select("id", "position")
    r = runs.join(pos, "id").select("email_id", "run_no", "section_key", "position")
    proposed = r.select("email_id", "run_no", F.floor(F.col("position") / 2).alias("group_no"), "section_key")
    n = r.groupBy("email_id", "run_no").agg(F.count(F.lit(1)).alias("n"))
    status = n.select("email_id", "run_no", T.run_status(F.col("n"), F.lit(True), F.lit(None).cast("string"), F.when(F.col("n") == 3, 1).otherwise(0), F.col("n") / 5).alias("status"))
    return T.resolved_groups(proposed, r, status).select("email_id", "run_no", "section_key", "group_no", "status")


def r05_listing(spark, root):
    return R.positioned_listing(_sections(spark, root))


def r15_reuse(spark, root):
    log = table(spark, root, "agent_outputs")
    complete = R.complete_emails(log, _sections(spark, root), "router", F.col("kind").isNotNull())
    return T.reuse(log, complete, "ainews_radar_digest")


def c12_map_phase(spark, root):
    """Facts of packed chunks by a deterministic scorer: one per heading line."""
    import json

    def scorer(prompt, attempt, error):
        heads = [x[3:] for x in prompt.split("\n") if x.startswith("## ")]
        return json.dumps({"facts": [{"entity": h, "fact": h, "importance_score": 1 + len(h) % 5} for h in heads]})

    chunks = N.packed(_sections(spark, root), 4000)
    return T.map_phase(chunks, scorer, lambda v: [] if "facts" in v else ["no facts"]).select("email_id", "place", "entity", "importance")


def o10_composed(spark, root):
    """Every digest's page with faults put in, gated and repaired: what was wrong before, and the page after."""
    html = F.coalesce("body_html", F.lit(""))
    faulty = F.when(F.col("id") % 3 == 0, F.concat(html, F.lit("<script>x</script>{{ a }}"))).when(F.col("id") % 3 == 1, F.replace(html, F.lit("</html>"), F.lit(""))).otherwise(html)
    pages = table(spark, root, "digests").select(F.col("id").alias("digest_id"), faulty.alias("html"))
    before = pages.select("digest_id", F.array_join(P.html_problems(F.col("html")), ",").alias("problems_before"))
    x = D.composed(pages, "digest_id").join(before, "digest_id")
    return x.select("digest_id", "problems_before", F.array_join("problems", ",").alias("problems_after"), F.length("html").cast("long").alias("n_chars"), F.contains("html", F.lit("<script")).alias("has_script"))


def k07_reports(spark, root):
    x = G.with_roles(_sections(spark, root), navigation=NAVIGATION, promo=PROMO)
    a = x.select("email_id", "position", "section_key", F.when(P.is_strippable(F.col("role")), "hidden").otherwise("article").alias("disposition"), "rule", F.length(P.text_of("text")).alias("n_chars"), F.substring(P.text_of("text"), 1, 60).alias("preview"))
    return D.audit_report(a).select("email_id", F.md5("report").alias("report_md5"))


QUERIES = {f"q_{f.__name__}": f for f in (d16_registry, d14_stories, d21_cascade, c05_units_scored, g10_scoped, g22_resolved, r05_listing, r15_reuse, c12_map_phase, o10_composed, k07_reports)}

_UNITS = SECTION_ORACLE["q_g05_units"].rpartition("SELECT email_id, 'u'")[0]
_ADDR = r"coalesce(nullif(regexp_extract(lower(sender), '<\s*([^<>\s]+@[^<>\s]+)\s*>', 1), ''), nullif(regexp_extract(lower(sender), '([^\s<>\"''(),;:]+@[^\s<>\"''(),;:]+)', 1), ''))"
_ENTRY = f"""ent AS (SELECT a.email_id, CASE WHEN r.category = 'RADAR' AND a.addr = 'editor@' || lower(r.domain) THEN 'EDITOR' ELSE r.category END AS entry
    FROM (SELECT id AS email_id, {_ADDR} AS addr FROM emails) a JOIN sender_registry r ON lower(r.domain) = split_part(a.addr, '@', -1))"""
# What a page is filled up with, by length only.
_FILLER = "<p>" + "This page was filled up to its least length. " * 8 + "</p>"
ORACLE = {
    "q_c12_map_phase": f"""WITH b AS (SELECT email_id, order_index, id, unnest(string_split({_BLOCK}, chr(10))) AS line, generate_subscripts(string_split({_BLOCK}, chr(10)), 1) AS n FROM email_sections)
        SELECT email_id, (row_number() OVER (PARTITION BY email_id ORDER BY order_index, id, n) - 1)::INT AS place, substr(line, 4) AS entity, (1 + length(substr(line, 4)) % 5)::INT AS importance FROM b WHERE starts_with(line, '## ')""",
    "q_c05_units_scored": f"""{_UNITS}, {_ENTRY}, p AS (SELECT email_id, entry FROM ent WHERE entry IN ('LEADERSHIP', 'COURSES')), yy AS (SELECT z.*, entry, {SQL.hits("lower(concat_ws(' ', replace(h, '|', ' '), t))", rules.PROMO_KEYWORDS_SHORT)} >= 2 AS promo FROM z LEFT JOIN p USING (email_id))
        SELECT CASE WHEN entry IS NOT NULL THEN entry WHEN promo THEN 'COURSES' WHEN length(t) > 800 THEN 'TECHNOLOGY' ELSE 'RADAR' END AS category, CASE WHEN entry IS NOT NULL THEN 'sender_prior' WHEN promo THEN 'heuristic' ELSE 'scorer' END AS source, count(*) AS n_units, 0::BIGINT AS n_errors FROM yy GROUP BY 1, 2""",
    "q_d16_registry": f"WITH {_ENTRY} SELECT email_id, entry FROM ent",
    "q_d14_stories": f"""WITH {_DOM}, s AS (SELECT email_id, path FROM story WHERE path IS NOT NULL), c AS (SELECT email_id, min(path) AS canon FROM s GROUP BY 1)
        SELECT DISTINCT email_id, CASE WHEN path = canon OR (split_part(path, '/', -1) <> '' AND split_part(path, '/', -1) = split_part(canon, '/', -1)) THEN canon ELSE path END AS path FROM s JOIN c USING (email_id)""",
    "q_d21_cascade": f"""{_UNITS}, u AS (SELECT email_id, 'u' || (row_number() OVER (PARTITION BY email_id ORDER BY g) - 1) AS content_unit_key, t, h FROM z), {_ENTRY},
        p AS (SELECT email_id, entry FROM ent WHERE entry IN ('LEADERSHIP', 'COURSES')),
        ruled AS (SELECT u.*, entry, (SELECT sum(contains(lower(concat_ws(' ', replace(h, '|', ' '), t)), k)::INT) FROM (VALUES ('comments'), ('log in'), ('share'), ('app'), ('issue')) v(k)) >= 2 AS promo FROM u LEFT JOIN p USING (email_id))
        SELECT email_id, content_unit_key, CASE WHEN entry IS NOT NULL THEN entry WHEN promo THEN 'COURSES' END AS category, CASE WHEN entry IS NOT NULL THEN 0.9 WHEN promo THEN 0.85 END::DOUBLE AS confidence, CASE WHEN entry IS NOT NULL THEN 'sender_prior' WHEN promo THEN 'heuristic' END AS source,
            CASE WHEN h <> '' THEN array_to_string(string_split(h, '|')[1:3], '|') ELSE left(t, 240) END AS evidence FROM ruled""",
    "q_r05_listing": "SELECT email_id, id AS section_id, section_key, (row_number() OVER (PARTITION BY email_id ORDER BY order_index, id) - 1)::INT AS position FROM email_sections",
    "q_r15_reuse": """WITH o AS (SELECT email_section_id, bool_or(kind = 'router') AS a FROM agent_outputs WHERE email_section_id IS NOT NULL GROUP BY 1), c AS (SELECT s.email_id, bool_and(coalesce(a, false)) AS complete FROM email_sections s LEFT JOIN o ON o.email_section_id = s.id GROUP BY 1)
        SELECT email_id, CASE WHEN email_id IN (SELECT email_id FROM agent_outputs WHERE kind = 'ainews_radar_digest' AND email_section_id IS NULL) THEN 'digest' WHEN complete THEN 'sections' ELSE 'nothing' END AS reuse FROM c""",
    "q_o10_composed": rf"""WITH d AS (SELECT id, CASE id % 3 WHEN 0 THEN coalesce(body_html, '') || '<script>x</script>{{{{ a }}}}' WHEN 1 THEN replace(coalesce(body_html, ''), '</html>', '') ELSE coalesce(body_html, '') END AS h FROM digests),
        c AS (SELECT *, contains(lower(h), '<script') AS s, NOT contains(lower(h), '<html') AS r, NOT contains(lower(h), '</html>') AS e, length({SQL.strip('h')}) < 120 AS b, contains(h, '{{{{') OR contains(h, '{{%') AS m FROM d),
        f AS (SELECT *, CASE WHEN s THEN regexp_replace(h, '(?is)<script\b.*?(?:</script\s*>|$)', '', 'g') ELSE h END AS h1 FROM c), g AS (SELECT *, CASE WHEN r THEN '<html><body>' ELSE '' END || h1 || CASE WHEN e THEN '</body></html>' ELSE '' END AS h2 FROM f)
        SELECT id AS digest_id, concat_ws(',', CASE WHEN s THEN 'forbidden_script_tag' END, CASE WHEN r THEN 'missing_html_root' END, CASE WHEN e THEN 'missing_html_close' END, CASE WHEN b THEN 'body_too_short' END, CASE WHEN m THEN 'unrendered_template_markup' END) AS problems_before, '' AS problems_after,
            length(CASE WHEN m THEN replace(replace(replace(replace(h2, '{{{{', '('), '}}}}', ')'), '{{%', '(%'), '%}}', '%)') ELSE h2 END) + CASE WHEN b THEN {len(_FILLER)} ELSE 0 END AS n_chars, false AS has_script FROM g""",
    "q_k07_reports": rf"""{_ROLES} SELECT email_id, md5(string_agg(concat_ws(' | ', section_key, CASE WHEN {_STRIPPABLE} THEN 'hidden' ELSE 'article' END, rule, n::VARCHAR, regexp_replace(left(coalesce(text, ''), 60), '[ \t\n\x0b\f\r]+', ' ', 'g')), chr(10) ORDER BY position)) AS report_md5 FROM roles GROUP BY 1""",
    "q_g22_resolved": f"""WITH x AS (SELECT id, email_id, section_key, order_index, {_PROMO} AS p, row_number() OVER (PARTITION BY email_id ORDER BY order_index, id) - 1 AS position FROM email_sections),
        y AS (SELECT *, sum(p::INT) OVER (PARTITION BY email_id ORDER BY order_index, id) AS k FROM x), r AS (SELECT email_id, section_key, position, dense_rank() OVER (PARTITION BY email_id ORDER BY k) - 1 AS run_no FROM y WHERE NOT p),
        n AS (SELECT *, count(*) OVER (PARTITION BY email_id, run_no) AS n FROM r), s AS (SELECT *, CASE WHEN n > 12 THEN 'too_many_sections' WHEN n = 3 THEN 'validation_failed' WHEN n / 5.0 < 0.75 THEN 'low_confidence' ELSE 'accepted' END AS status FROM n),
        g AS (SELECT *, CASE WHEN status = 'accepted' THEN min(position) OVER (PARTITION BY email_id, run_no, position // 2) ELSE position END AS st FROM s)
        SELECT email_id, run_no::INT AS run_no, section_key, (dense_rank() OVER (PARTITION BY email_id ORDER BY st) - 1)::INT AS group_no, status FROM g""",
    "q_g10_scoped": f"""{_UNITS}, u AS (SELECT email_id, 'u' || (row_number() OVER (PARTITION BY email_id ORDER BY g) - 1) AS content_unit_key, k FROM z),
        a AS (SELECT id, email_id, section_key, order_index, {_PROMO} AS pr FROM email_sections), b AS (SELECT *, sum(pr::INT) OVER (PARTITION BY email_id ORDER BY order_index, id) AS n FROM a),
        run AS (SELECT email_id, list(section_key) AS keys FROM (SELECT *, dense_rank() OVER (PARTITION BY email_id ORDER BY n) AS rn FROM b WHERE NOT pr) WHERE rn = 1 GROUP BY 1)
        SELECT email_id, content_unit_key, k AS section_keys FROM u JOIN run USING (email_id) WHERE len(list_filter(string_split(k, ','), lambda x: NOT list_contains(keys, x))) = 0""",
}
