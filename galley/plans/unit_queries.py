"""Queries of the choice between ways of grouping, of plans, proposals and decisions."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from galley.functions import predicates as P
from galley.functions import rules
from galley.operators import grouping as G
from galley.operators import processors as W
from galley.operators import routing as T
from galley.operators import sections as N
from galley.operators import state as R
from galley.operators.compose import labels
from galley.plans import sql as SQL
from galley.plans.routing_queries import _ENTRY, _registry
from galley.plans.section_queries import _BODY, _DOM, _PROMO, _TEASER, NAVIGATION, PROMO, STORY, TEASERS
from galley.plans.section_queries import ORACLE as SECTION_ORACLE
from galley.session import table

NOW = "2025-01-01T00:00:00Z"


def _sections(spark, root):
    return table(spark, root, "email_sections")


def _profiled(spark, root):
    """Emails whose sender's entry in the registry is of radar: those with a profile."""
    return T.registry_entry(table(spark, root, "emails"), _registry(spark, root)).where("entry in ('RADAR', 'EDITOR')").select("email_id")


def g11_units(spark, root):
    """The units of every email, by runs and links or by the shape of its profile."""
    u = G.grouped_units(_sections(spark, root), _profiled(spark, root), PROMO, TEASERS, **STORY)
    return u.select("email_id", "content_unit_key", F.array_join("section_keys", ",").alias("section_keys"), "way")


def g12_article_units(spark, root):
    u = G.article_units(_sections(spark, root), PROMO, TEASERS)
    return u.select("email_id", "content_unit_key", F.md5("unit_text").alias("text_md5"), F.array_join("section_keys", ",").alias("section_keys"))


def d18_excluded(spark, root):
    return G.excluded_keys(_sections(spark, root), PROMO, TEASERS).select("email_id", F.array_join("section_keys", ",").alias("section_keys"))


def g18_plans(spark, root):
    profiles = _profiled(spark, root).withColumn("kind", F.lit("technical_longform"))
    x = G.profile_plans(_sections(spark, root), profiles, navigation=NAVIGATION, promo=PROMO)
    return x.select("email_id", "kind", F.array_join("section_keys", ",").alias("section_keys"), "merged_hash")


def _paired(spark, root):
    """A proposal for every email: its plain sections in pairs, which at times stand on two sides of a promotional one."""
    s = G.positioned(_sections(spark, root)).where(~P.is_promo(PROMO))
    rank = F.row_number().over(Window.partitionBy("email_id").orderBy("position")) - 1
    return s.select("email_id", F.floor(rank / 2).cast("int").alias("group_no"), P.strip(F.col("section_key")).alias("section_key"))


def g08_groups(spark, root):
    s, proposed = _sections(spark, root), _paired(spark, root)
    wanted = proposed.select("email_id", "section_key")
    x = G.accepted_groups(s, proposed, G.proposal_errors(proposed, s, wanted, PROMO))
    return x.select(F.col("id").alias("section_id"), "email_id", "group_no")


def g20_errors(spark, root):
    """A proposal with one fault of each kind, against the plain sections of each email."""
    s, pairs = _sections(spark, root), _paired(spark, root)
    faults = [
        pairs.where("group_no <> 1"),  # keys of the second group are missing
        pairs.where("group_no = 0").withColumn("group_no", F.lit(107)),  # and those of the first come twice
        pairs.select("email_id").distinct().select("email_id", F.lit(108).alias("group_no"), F.lit("no-such-key").alias("section_key")),
        pairs.select("email_id").distinct().select("email_id", F.lit(109).alias("group_no"), F.lit(None).cast("string").alias("section_key")),
        s.where(P.is_promo(PROMO)).select("email_id", F.lit(110).alias("group_no"), P.strip(F.col("section_key")).alias("section_key")),
    ]
    proposed = faults[0].unionByName(faults[1]).unionByName(faults[2]).unionByName(faults[3]).unionByName(faults[4])
    x = G.proposal_errors(proposed, s, pairs.select("email_id", "section_key"), PROMO)
    return x.where("error not in ('overlapping_units', 'non_contiguous_group', 'spans_hard_boundary')").select("email_id", "section_key", "error").distinct()


def r16_digests(spark, root):
    """Digests with a new one for every failed one, and the body of the sent ones replaced."""
    d = table(spark, root, "digests")
    now = F.lit(NOW).cast("timestamp")
    new = d.where("status = 'failed'").select(F.lit(None).cast("string").alias("status"), "title", F.concat(F.lit("again "), F.col("id")).alias("body_html"))
    changes = d.where("status = 'sent'").select("id", F.concat(F.lit("sent "), F.col("id")).alias("body_html"), F.when(F.col("title").isNull(), F.lit("Untitled")).alias("title"))
    x = R.created_digests(R.with_bodies(d, changes, now), new, now)
    top = d.agg(F.max("id")).scalar()
    return x.select(F.when(F.col("id") <= top, F.col("id")).alias("id"), (F.col("id") > top).alias("fresh"), "status", "title", F.md5("body_html").alias("body_md5"), "error_message", (F.col("updated_at") == now).alias("touched"))


def r26_decisions(spark, root):
    """The decision on the shape of every email with a profile, as the log keeps it."""
    s = _sections(spark, root).join(_profiled(spark, root), "email_id", "left_semi")
    shapes = G.shapes(s, keywords=PROMO, teasers=TEASERS, **STORY).withColumn("profile_id", F.lit("radar"))
    stories = G.story_links(s, **STORY).select("email_id", "path")
    merged = G.article_units(s, PROMO, TEASERS).join(shapes.where("shape = 'single_article'"), "email_id", "left_semi").select("email_id", "section_keys")
    return R.shape_decisions(shapes, G.excluded_keys(s, PROMO, TEASERS), stories, merged)


def proposing(prompt: str, attempt: int, error: str | None) -> str:
    """A boundary scorer for queries: all sections of the outline in pairs, sure of itself where there are few."""
    keys = re.findall(r"^\d+\. \[([^\]]*)\]", prompt, re.M)
    return json.dumps({"confidence": 0.9 if len(keys) < 8 else 0.6, "units": [{"section_keys": keys[i : i + 2]} for i in range(0, len(keys), 2)]})


def c06_boundaries(spark, root):
    """Every ambiguous email asked for its boundaries, the answer checked, and taken or refused."""
    s = _sections(spark, root)
    ask = G.grouping_decision(s, PROMO).where("ambiguous").select("email_id", F.split("reasons", ",").alias("reasons"))
    some = s.join(ask, "email_id", "left_semi").select(s.columns)
    hard = some.where(P.is_promo(PROMO)).groupBy("email_id").agg(F.array_sort(F.collect_list(P.strip(F.col("section_key")))).alias("hard_keys"))
    mails = labels(table(spark, root, "emails")).join(ask, "email_id").join(hard, "email_id", "left").withColumn("original_url", F.lit(None).cast("string"))
    prompts = W.boundary_prompts(G.outline(some), G.units(G.final_groups(some, PROMO)), mails)
    answers = W.boundary_proposals(prompts, proposing)
    proposed = answers.select("email_id", F.posexplode("units").alias("group_no", "u")).select("email_id", "group_no", F.explode("u.section_keys").alias("section_key"))
    errors = G.proposal_errors(proposed, some, some.select("email_id", P.strip(F.col("section_key")).alias("section_key")), PROMO)
    n_errors = errors.groupBy("email_id").agg(F.count(F.lit(1)).alias("n_errors"))
    n = some.groupBy("email_id").agg(F.count(F.lit(1)).alias("n"))
    x = n.join(answers, "email_id").join(n_errors, "email_id", "left")
    status = T.run_status(F.col("n"), F.lit(True), F.col("error"), F.coalesce("n_errors", F.lit(0)), F.coalesce("confidence", F.lit(0.0)))
    return x.select("email_id", F.col("n").alias("n_sections"), "confidence", status.alias("status"))


def d15_primary(spark, root):
    """How many primary addresses each mail has: stories where it has a profile, https links elsewhere."""
    s = _sections(spark, root)
    return T.primary_url_counts(s, G.story_links(s, **STORY).select("email_id", "path"), _profiled(spark, root))


def d16_original(spark, root):
    """The registry's entry of every mail, for senders it does not know by the host of the mail's first link."""
    s = _sections(spark, root)
    mails = s.groupBy("email_id").agg(F.min_by(F.get("links", F.lit(0)), F.struct("order_index", "id")).alias("original_url"))
    hosts = G.story_links(s, **STORY).select(F.substring_index("path", "/", 1).alias("host")).distinct().select(F.lit("STORY").alias("entry"), F.lit(5).alias("rank"), "host")
    return T.with_original(T.registry_entry(table(spark, root, "emails"), _registry(spark, root)), mails, hosts)


def d13_with_own(spark, root):
    """The dominant path of every section, the mail's own story where none is."""
    links = G.story_links(_sections(spark, root), **STORY)
    own = links.groupBy("email_id").agg(F.max("path").alias("canonical"))
    return G.dominant(links, own).select(F.col("id").alias("section_id"), "path")


def n05_envelopes(spark, root):
    """Sections of all mails, an envelope of the preview where a mail has none."""
    e = table(spark, root, "emails").select(F.col("id").alias("email_id"), F.col("body_preview").alias("text"), F.lit(None).cast("array<string>").alias("links"), F.lit(None).cast("array<string>").alias("image_urls"))
    x = N.with_envelopes(_sections(spark, root), e)
    return x.select("email_id", "section_key", "order_index", F.length("text").cast("long").alias("n_chars"), F.size(F.coalesce("links", F.array().cast("array<string>"))).cast("long").alias("n_links"))


def n10_chunks(spark, root):
    """Chunks of all mails, an empty one where there is nothing to pack."""
    e = table(spark, root, "emails").select(F.col("id").alias("email_id"))
    x = N.or_empty_chunk(N.packed(_sections(spark, root), 4000), e)
    return x.select("email_id", "chunk_index", F.array_join("section_keys", ",").alias("section_keys"), F.length("text").alias("n_chars"))


def p21_articles(spark, root):
    return _sections(spark, root).select(F.col("id").alias("section_id"), F.array_join(P.article_links(F.col("links")), "|").alias("links"))


QUERIES = {f"q_{f.__name__}": f for f in (d15_primary, d16_original, d13_with_own, n05_envelopes, n10_chunks, p21_articles, g11_units, g12_article_units, d18_excluded, g18_plans, g08_groups, g20_errors, r16_digests, r26_decisions, c06_boundaries)}

_KEY = SQL.strip("section_key")
_PROFILED = f"{_ENTRY}, prof AS (SELECT email_id FROM ent WHERE entry IN ('RADAR', 'EDITOR'))"
_ARTICLE = f"art AS (SELECT email_id, string_agg({_KEY}, ',' ORDER BY order_index, id) AS k, list({_KEY} ORDER BY order_index, id) AS ks, coalesce(string_agg(CASE WHEN {SQL.strip('text')} <> '' THEN text END, chr(10) || chr(10) ORDER BY order_index, id), '') AS t FROM body GROUP BY 1)"
_OUT = f"({_PROMO} OR {_TEASER})"
_PAIRED = f"""pos AS (SELECT id, email_id, {_KEY} AS section_key, {_PROMO} AS hard, row_number() OVER (PARTITION BY email_id ORDER BY order_index, id) - 1 AS position FROM email_sections),
    pairs AS (SELECT *, (row_number() OVER (PARTITION BY email_id ORDER BY position) - 1) // 2 AS group_no FROM pos WHERE NOT hard)"""

_IMAGES = "(" + " OR ".join(f"ends_with(lower(regexp_replace(regexp_replace(x, '[?#].*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*', '')), '{s}')" for s in rules.IMAGE_SUFFIXES) + ")"
ORACLE = {
    "q_d15_primary": f"""WITH {_PROFILED}, {_DOM}, u AS (SELECT email_id, count(DISTINCT l) AS n FROM (SELECT email_id, unnest({SQL.HTTPS}) AS l FROM email_sections) GROUP BY 1), st AS (SELECT email_id, count(DISTINCT path) AS n FROM story WHERE path IS NOT NULL GROUP BY 1)
        SELECT m.email_id, CASE WHEN m.email_id IN (SELECT email_id FROM prof) THEN coalesce(st.n, 0) ELSE coalesce(u.n, 0) END AS n_urls FROM (SELECT DISTINCT email_id FROM email_sections) m LEFT JOIN u USING (email_id) LEFT JOIN st USING (email_id)""",
    "q_d16_original": f"""WITH {_ENTRY}, {_DOM}, h AS (SELECT DISTINCT split_part(path, '/', 1) AS host FROM story WHERE path IS NOT NULL), m AS (SELECT email_id, lower(regexp_extract(first(links[1] ORDER BY order_index, id), '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1)) AS host FROM email_sections GROUP BY 1)
        SELECT email_id, entry FROM ent UNION ALL SELECT email_id, 'STORY' FROM m JOIN h USING (host) WHERE email_id NOT IN (SELECT email_id FROM ent)""",
    "q_d13_with_own": f"""WITH {_DOM}, own AS (SELECT email_id, max(path) AS canon FROM story WHERE path IS NOT NULL GROUP BY 1), alone AS (SELECT DISTINCT s.section_id, canon FROM story s JOIN own USING (email_id) WHERE s.path = canon AND s.section_id NOT IN (SELECT section_id FROM dom))
        SELECT section_id, path FROM dom UNION ALL SELECT section_id, canon FROM alone""",
    "q_n05_envelopes": f"""SELECT email_id, section_key, order_index, length(text) AS n_chars, len(coalesce(links, [])) AS n_links FROM email_sections
        UNION ALL SELECT id, 's0', 0, length({SQL.truncated('body_preview', 8000)}), 0 FROM emails WHERE id NOT IN (SELECT email_id FROM email_sections WHERE email_id IS NOT NULL)""",
    "q_n10_chunks": f"WITH pk AS ({SECTION_ORACLE['q_n08_pack']}) SELECT email_id, chunk_index, section_keys, n_chars FROM pk UNION ALL SELECT id, 0, '', 0 FROM emails WHERE id NOT IN (SELECT email_id FROM pk)",
    "q_p21_articles": f"SELECT id AS section_id, array_to_string(list_filter(coalesce(links, []), lambda x: NOT {_IMAGES}), '|') AS links FROM email_sections",
    "q_g12_article_units": f"WITH {_BODY}, {_ARTICLE} SELECT email_id, 'u0' AS content_unit_key, md5(t) AS text_md5, k AS section_keys FROM art",
    "q_d18_excluded": f"SELECT email_id, string_agg({_KEY}, ',' ORDER BY order_index, id) AS section_keys FROM email_sections WHERE {_OUT} GROUP BY 1",
    "q_g11_units": f"""WITH {_PROFILED}, {_BODY}, {_ARTICLE}, g AS ({SECTION_ORACLE['q_g05_units']}), m AS ({SECTION_ORACLE['q_g13_story_units']}), sh AS ({SECTION_ORACLE['q_d19_shapes']})
        SELECT email_id, content_unit_key, section_keys, 'generic' AS way FROM g WHERE email_id NOT IN (SELECT email_id FROM prof) AND email_id IN (SELECT email_id FROM email_sections WHERE NOT {_PROMO})
        UNION ALL SELECT email_id, 'u0', k, 'single_article' FROM art JOIN sh USING (email_id) WHERE shape = 'single_article' AND email_id IN (SELECT email_id FROM prof)
        UNION ALL SELECT email_id, content_unit_key, section_keys, 'multi_story' FROM m JOIN sh USING (email_id) WHERE shape = 'multi_story' AND email_id IN (SELECT email_id FROM prof)""",
    "q_g18_plans": f"WITH {_PROFILED}, a AS ({SECTION_ORACLE['q_g15_profiles']}), h AS ({SECTION_ORACLE['q_g17_merged_hash']}) SELECT email_id, 'technical_longform' AS kind, section_keys, merged_hash FROM a JOIN h USING (email_id) JOIN prof USING (email_id) WHERE counter_evidence IS NULL",
    "q_g08_groups": f"""WITH {_PAIRED}, bad AS (SELECT DISTINCT email_id FROM (SELECT email_id, group_no, max(position) - min(position) AS d, count(*) AS n FROM pairs GROUP BY 1, 2) WHERE d > n - 1),
        st AS (SELECT p.id, p.email_id, CASE WHEN q.group_no IS NULL OR p.email_id IN (SELECT email_id FROM bad) THEN p.position ELSE min(q.position) OVER (PARTITION BY p.email_id, q.group_no) END AS s FROM pos p LEFT JOIN pairs q USING (id))
        SELECT id AS section_id, email_id, (dense_rank() OVER (PARTITION BY email_id ORDER BY s) - 1)::INT AS group_no FROM st""",
    "q_g20_errors": f"""WITH {_PAIRED}, mails AS (SELECT DISTINCT email_id FROM pairs)
        SELECT email_id, section_key, 'missing_section_key' AS error FROM pairs WHERE group_no = 1 UNION SELECT email_id, section_key, 'duplicate_section_key' FROM pairs WHERE group_no = 0
        UNION SELECT email_id, 'no-such-key', 'invented_section_key' FROM mails UNION SELECT email_id, NULL, 'empty_unit' FROM mails UNION SELECT email_id, section_key, 'section_outside_run' FROM pos WHERE hard""",
    "q_r16_digests": """SELECT id, false AS fresh, status, CASE WHEN status = 'sent' THEN coalesce(title, 'Untitled') ELSE title END AS title, md5(CASE WHEN status = 'sent' THEN 'sent ' || id ELSE body_html END) AS body_md5, error_message, coalesce(status = 'sent', false) OR updated_at = TIMESTAMPTZ '2025-01-01 00:00:00+00' AS touched FROM digests
        UNION ALL SELECT NULL, true, 'draft', title, md5('again ' || id), NULL, true FROM digests WHERE status = 'failed'""",
    "q_r26_decisions": f"""WITH {_PROFILED}, {_BODY}, {_ARTICLE}, {_DOM}, sh AS ({SECTION_ORACLE['q_d19_shapes']}), gone AS (SELECT email_id, list({_KEY} ORDER BY order_index, id) AS ks FROM email_sections WHERE {_OUT} GROUP BY 1), u AS (SELECT email_id, list_sort(list(DISTINCT path)) AS urls FROM story WHERE path IS NOT NULL GROUP BY 1)
        SELECT email_id, CAST(to_json({{'shape_profile_id': 'radar', 'digest_shape': shape, 'digest_excluded_section_keys': coalesce(gone.ks, []), 'distinct_canonical_story_urls': coalesce(urls, []), 'substantive_article_chars': article_chars, 'merged_section_keys': CASE WHEN shape = 'single_article' THEN coalesce(art.ks, []) ELSE [] END}}) AS VARCHAR) AS payload
        FROM sh JOIN prof USING (email_id) LEFT JOIN gone USING (email_id) LEFT JOIN u USING (email_id) LEFT JOIN art USING (email_id)""",
}
