"""Queries over the sections of mails: normalisation, packing, predicates, grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.functions import predicates as P
from galley.functions import rules as R
from galley.operators import grouping as G
from galley.operators import sections as N
from galley.operators.timestamps import sender_address
from galley.plans import sql as S
from galley.session import table

# Phrases that occur in the test tables, beside the default ones (see the survey's note on empty results).
PROMO = tuple(dict.fromkeys((*R.PROMO_KEYWORDS, "workshop", "roadmap", "benchmark", "lecture")))
RECAP_PARTS = (*R.RECAP_PARTS, "most read", "related work")
TEASERS = (*R.TEASER_PHRASES, "forward this issue", "partner links")
NAVIGATION = (*R.NAVIGATION_PHRASES, "on the web", "skip to")
STORY = {"patterns": (r"^/(p|a|read|posts)/[^/]+$",), "excluded": ("/account", "/subscribe")}


def _sections(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "email_sections")


def n01_truncate(spark, root):
    t = N.truncated(F.col("text"), 600)
    return _sections(spark, root).select(F.col("id").alias("section_id"), t.alias("text_cut"), F.length(t).cast("long").alias("n_chars"))


def n02_hash(spark, root):
    s = _sections(spark, root)
    h = N.content_hash_builtin(F.col("text"), F.col("links"))
    return s.select(F.col("id").alias("section_id"), h.alias("hash"), F.when(F.coalesce("content_hash", F.lit("")) == "", "missing").when(F.col("content_hash") == h, "valid").otherwise("stale").alias("state"))


def n02_hash_exact(spark, root):
    s = _sections(spark, root)
    return s.select(F.col("id").alias("section_id"), N.content_hash(N.truncated(F.col("text")), F.col("links")).alias("hash"))


def n03_merge(spark, root):
    m = N.merged_pairs(_sections(spark, root))
    return m.select("left_id", "right_id", "order_index", "heading", F.md5("text").alias("text_md5"), F.array_join("links", "|").alias("links"), F.size("image_urls").cast("long").alias("n_images"))


def n04_routing(spark, root):
    r = N.for_routing(_sections(spark, root))
    return r.select("email_id", "section_key", "order_index", "heading", F.length("text").alias("n_chars"), F.size("links").alias("n_links"), F.size("image_urls").alias("n_images"))


def n07_chunks(spark, root):
    c = N.paragraph_chunks(table(spark, root, "documents"), "doc_id", "text", 700)
    return c.select("doc_id", "chunk_index", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("chunk_md5"))


def n08_pack(spark, root):
    p = N.packed(_sections(spark, root), 4000)
    return p.select("email_id", "chunk_index", F.array_join("section_keys", ",").alias("section_keys"), F.length("text").alias("n_chars"))


def n09_capped(spark, root):
    p = N.capped(N.packed(_sections(spark, root), 4000), 3)
    return p.select("email_id", "chunk_index", F.array_join("section_keys", ",").alias("section_keys"), F.length("text").alias("n_chars"))


def n11_plaintext(spark, root):
    return N.plaintext(_sections(spark, root)).select("email_id", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n_chars"))


def d01_senders(spark, root):
    return table(spark, root, "emails").select(F.col("id").alias("email_id"), sender_address(F.col("sender")).alias("address"))


def d02_allowlist(spark, root):
    reg = table(spark, root, "sender_registry").where("category = 'RADAR'").select(F.lower("domain").alias("domain"))
    x = d01_senders(spark, root).where("address is not null").withColumn("domain", F.substring_index("address", "@", -1))
    return x.join(reg, "domain", "left_semi").select("email_id", "domain")


def d03_promo(spark, root):
    return _sections(spark, root).select(F.col("id").alias("section_id"), P.bound(P.lowered(), lambda t: P.hits(t, PROMO)).cast("long").alias("hits"), P.is_promo(PROMO).alias("promo"))


def d04_roles(spark, root):
    x = G.with_roles(_sections(spark, root), navigation=NAVIGATION, promo=PROMO)
    return x.select(F.col("id").alias("section_id"), "email_id", "position", "n_sections", "role", "rule")


def d06_roles_by_sender(spark, root):
    x = G.with_roles(_sections(spark, root), navigation=NAVIGATION, promo=PROMO).select("email_id", "role", F.length(P.text_of("text")).alias("n"), P.is_strippable(F.col("role")).alias("strip"))
    e = d01_senders(spark, root)
    y = x.join(e, "email_id").groupBy(F.coalesce("address", F.lit("")).alias("address"), "role")
    return y.agg(F.count(F.lit(1)).alias("n_sections"), F.sum("n").alias("n_chars"), F.bool_or("strip").alias("strippable"))


def d08_recap(spark, root):
    x = G.recap_split(_sections(spark, root), parts=RECAP_PARTS)
    return x.select(F.col("id").alias("section_id"), "email_id", "part", "boundary_heading")


def _links(spark, root):
    return _sections(spark, root).select(F.col("id").alias("section_id"), F.posexplode("links").alias("place", "link"))


def d10_links(spark, root):
    u = F.col("link")
    return _links(spark, root).select("section_id", "place", P.without_tracking(u).alias("clean"), P.has_tracking_query(u).alias("tracking"), P.is_social(u).alias("social"), P.is_image_url(u).alias("image"), P.is_tracking_host(u).alias("tracking_host"), P.story_path(u, **STORY).alias("story"))


def p14_noise_links(spark, root):
    u = F.col("link")
    x = _links(spark, root).select(P.is_noise_link(u).alias("noise"), P.has_tracking_query(u).alias("tracking"), F.lower(P.url_part(u, "HOST")).alias("host"))
    return x.groupBy("host").agg(F.count(F.lit(1)).alias("n_links"), F.sum(F.col("noise").cast("long")).alias("n_noise"), F.sum(F.col("tracking").cast("long")).alias("n_tracking"))


def d09_unwrap(spark, root):
    x = _links(spark, root)
    wrapped = F.concat(F.lit("https://click.letters.example/c/"), F.replace(F.replace(F.col("link"), F.lit("://"), F.lit("%3A%2F%2F")), F.lit("?"), F.lit("%3F")))
    return x.select("section_id", "place", P.unwrapped_link(wrapped, {"click.letters.example": ("/x/", "/c/")}).alias("target"))


def d13_dominant(spark, root):
    return G.dominant_paths(_sections(spark, root), **STORY).select(F.col("id").alias("section_id"), "path")


def d15_urls(spark, root):
    u = _sections(spark, root).select("email_id", F.explode_outer(P.https(F.col("links"))).alias("u"))
    return u.groupBy("email_id").agg(F.count_distinct("u").alias("n_urls"))


def d17_teaser(spark, root):
    return _sections(spark, root).select(F.col("id").alias("section_id"), P.is_teaser(TEASERS, PROMO).alias("teaser"))


def d19_shapes(spark, root):
    return G.shapes(_sections(spark, root), keywords=PROMO, teasers=TEASERS, **STORY)


def g01_runs(spark, root):
    return G.runs(_sections(spark, root), PROMO).select(F.col("id").alias("section_id"), "email_id", "run_no")


def g02_decision(spark, root):
    return G.grouping_decision(_sections(spark, root), PROMO)


def g05_units(spark, root):
    u = G.units(G.final_groups(_sections(spark, root), PROMO))
    return u.select("email_id", "content_unit_key", F.md5("unit_text").alias("text_md5"), F.array_join("headings", "|").alias("headings"), F.size("links").cast("long").alias("n_links"), F.array_join("section_keys", ",").alias("section_keys"))


def _proposed(spark, root):
    """A proposal with faults: sections by parity of their order, those without a heading left out."""
    s = _sections(spark, root)
    return s.where("heading is not null").select("email_id", (F.col("order_index") % 2).alias("group_no"), "section_key")


def g06_boundaries(spark, root):
    return G.boundary_errors(_proposed(spark, root), _sections(spark, root), PROMO)


def g07_coverage(spark, root):
    return G.coverage_errors(_proposed(spark, root), _sections(spark, root))


def g20_overlaps(spark, root):
    return G.overlap_errors(_proposed(spark, root), _sections(spark, root)).select("email_id", "group_no", "lo", "before", "error")


def g13_story_units(spark, root):
    u = G.story_units(_sections(spark, root), PROMO, TEASERS, **STORY)
    return u.select("email_id", "content_unit_key", F.array_join("section_keys", ",").alias("section_keys"))


def g15_profiles(spark, root):
    x = G.profile_merge(_sections(spark, root), navigation=NAVIGATION, promo=PROMO)
    return x.select("email_id", F.md5("article_text").alias("article_md5"), F.array_join("section_keys", ",").alias("section_keys"), F.array_join("hidden_keys", ",").alias("hidden_keys"), "total_chars", "hidden_chars", F.col("article_chars").cast("long").alias("article_chars"), "counter_evidence")


def g17_merged_hash(spark, root):
    return G.merged_hash(_sections(spark, root), navigation=NAVIGATION, promo=PROMO)


def g19_outline(spark, root):
    o = G.outline(_sections(spark, root))
    return o.select(F.col("id").alias("section_id"), "snippet", F.col("char_count").cast("long").alias("char_count"), F.col("link_count").cast("long").alias("link_count"), F.array_join("primary_links", "|").alias("primary_links"))


def g21_hashes(spark, root):
    return G.outline_hashes(_sections(spark, root))


def o12_audit(spark, root):
    x = G.with_roles(_sections(spark, root), navigation=NAVIGATION, promo=PROMO)
    return x.select(F.col("id").alias("section_id"), F.when(P.is_strippable(F.col("role")), "hidden").otherwise("article").alias("disposition"), "rule", F.length(P.text_of("text")).cast("long").alias("n_chars"), F.substring(P.text_of("text"), 1, 200).alias("preview"))


QUERIES = {f"q_{f.__name__}": f for f in (n01_truncate, n02_hash, n02_hash_exact, n03_merge, n04_routing, n07_chunks, n08_pack, n09_capped, n11_plaintext, d01_senders, d02_allowlist, d03_promo, d04_roles, d06_roles_by_sender, d08_recap, d09_unwrap, d10_links, p14_noise_links, d13_dominant, d15_urls, d17_teaser, d19_shapes, g01_runs, g02_decision, g05_units, g06_boundaries, g07_coverage, g13_story_units, g15_profiles, g17_merged_hash, g19_outline, g20_overlaps, g21_hashes, o12_audit)}

# --- the same in SQL -------------------------------------------------------------------------------------

_ADDRESS = r"""CASE WHEN regexp_extract(lower(sender), '<\s*([^<>\s]+@[^<>\s]+)\s*>', 1) <> '' THEN regexp_extract(lower(sender), '<\s*([^<>\s]+@[^<>\s]+)\s*>', 1)
    ELSE nullif(regexp_extract(lower(sender), '([^\s<>"''(),;:]+@[^\s<>"''(),;:]+)', 1), '') END"""
_PROMO = f"({S.hits(S.BOTH, PROMO)} >= 2)"
_TEASER = f"({S.any_of(S.BOTH, TEASERS)} OR ({_PROMO} AND length(coalesce(text, '')) < 600))"
_HEAD = f"lower({S.strip('''coalesce(heading, '')''')})"
_N = "length(coalesce(text, ''))"
_RAW_HTTPS = "len(list_filter(coalesce(links, []), lambda u: starts_with(u, 'https://')))"
_STRONG = f"({S.any_of('head', R.PROMO_HEADINGS)} OR {S.any_of('comb', R.PROMO_BODIES)} OR {S.any_of('head', R.SPONSOR_FRAGMENTS)})"
_RULE = f"""CASE WHEN {S.any_of('comb', R.FOOTER_PHRASES)} THEN 'footer:unsubscribe_phrase'
    WHEN regexp_matches(comb, '{R.COPYRIGHT_PATTERN}') THEN 'footer:copyright'
    WHEN position >= CAST(floor(n_sections * 0.9::DOUBLE) AS BIGINT) AND n < 400 AND nh >= 2 THEN 'footer:bottom_tenth_link_heavy'
    WHEN {S.any_of('comb', NAVIGATION)} AND n < 200 AND (nh >= 1 OR n < 120) THEN 'navigation:phrase_match'
    WHEN {S.any_of('comb', R.SUBSCRIPTION_PHRASES)} AND n <= 600 AND (len(list_filter(links, lambda u: contains(u, 'substack.com'))) > 0 OR n < 350) THEN 'subscription_cta:phrase_match'
    WHEN {S.any_of('head', R.PROMO_HEADINGS)} THEN 'promo:strong_heading_marker'
    WHEN {S.any_of('comb', R.PROMO_BODIES)} THEN 'promo:body_marker'
    WHEN {S.any_of('head', R.SPONSOR_FRAGMENTS)} THEN 'promo:sponsor_class_substring'
    WHEN {S.hits('comb', PROMO)} = 1 THEN 'unknown_interrupt:single_promo_keyword'
    WHEN {S.hits('comb', PROMO)} >= 2 AND NOT {_STRONG} THEN 'unknown_interrupt:multi_promo_keyword'
    WHEN n < 80 AND nh >= 2 THEN 'unknown_interrupt:short_link_heavy' ELSE 'normal_content:default' END"""
_ROLES = f"""WITH pos AS (SELECT *, row_number() OVER (PARTITION BY email_id ORDER BY order_index, id) - 1 AS position, count(*) OVER (PARTITION BY email_id) AS n_sections,
        {S.COMBINED} AS comb, {_HEAD} AS head, {_N} AS n, {_RAW_HTTPS} AS nh FROM email_sections),
    roles AS (SELECT *, {_RULE} AS rule, split_part({_RULE}, ':', 1) AS role FROM pos)"""
_STRIPPABLE = "role IN ('promo', 'navigation', 'footer', 'subscription_cta')"
_RECAP_H = f"{S.strip('''regexp_replace(lower(coalesce(heading, '')), ''' + S.q(S._SPACE + '+') + ''', ' ', 'g')''')}"
_RECAP = f"""(h <> '' AND (h IN ({', '.join(map(S.q, R.RECAP_EXACT))}) OR {S.any_of('h', RECAP_PARTS)} OR regexp_matches(h, '{R.RECAP_PATTERN}') OR (ends_with(h, ' recap') AND length(h) <= 40)))"""
_LINKS = "(SELECT id AS section_id, email_id, unnest(links) AS link, generate_subscripts(links, 1) - 1 AS place FROM email_sections)"
_HOST = r"lower(regexp_extract(link, '^[a-zA-Z]+://([^/?#]*)', 1))"
_PATH = r"lower(regexp_extract(link, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1))"
_QUERY = r"regexp_extract(link, '\?([^#]*)', 1)"
_BAD = lambda x: f"({x} IN ({', '.join(map(S.q, R.TRACKING_NAMES))}) OR {' OR '.join(f'starts_with({x}, {S.q(p)})' for p in R.TRACKING_PREFIXES)})"
_PARAMS = f"list_filter(string_split({_QUERY}, '&'), lambda p: p <> '')"
_KEPT = f"array_to_string(list_filter({_PARAMS}, lambda p: NOT {_BAD('''lower(split_part(p, '=', 1))''')}), '&')"
_BASE = r"regexp_replace(regexp_replace(link, '[?#].*$', ''), '/+$', '')"
_CLEAN = f"CASE WHEN {_QUERY} = '' THEN link WHEN {_KEPT} = '' THEN {_BASE} ELSE {_BASE} || '?' || {_KEPT} END"
_NBAD = f"len(list_filter({_PARAMS}, lambda p: {_BAD('''lower(split_part(p, '=', 1))''')}))"
_TRACKING = f"(len({_PARAMS}) > 0 AND {_NBAD} >= greatest(2, len({_PARAMS})))"
_STORY_PATH = rf"regexp_replace({_PATH}, '/+$', '')"
_STORY = rf"CASE WHEN {_HOST} <> '' AND regexp_matches({_STORY_PATH}, '^/(p|a|read|posts)/[^/]+$') AND NOT starts_with({_STORY_PATH}, '/account') AND NOT starts_with({_STORY_PATH}, '/subscribe') THEN {_HOST} || {_STORY_PATH} END"
_SOCIAL = S.any_of("lower(link)", R.SOCIAL_FRAGMENTS)
_THOST = S.any_of(f"{_HOST} || {_PATH}", R.TRACKING_HOSTS)
_UNSUB = f"({S.any_of(_PATH, R.UNSUBSCRIBE_PATHS)} OR {S.any_of('lower(' + _QUERY + ')', R.UNSUBSCRIBE_QUERIES)})"
_BLOCK = f"'## ' || CASE WHEN {S.strip('''coalesce(heading, '')''')} <> '' THEN {S.strip('''coalesce(heading, '')''')} ELSE '(no heading)' END || chr(10) || chr(10) || {S.strip('''coalesce(text, '')''')}"
_SEP = "chr(10) || chr(10) || '---' || chr(10) || chr(10)"
_DOM = f"""story AS (SELECT section_id, email_id, place, {_STORY} AS path FROM {_LINKS}),
    cnt AS (SELECT section_id, email_id, path, count(*) AS n, min(place) AS place FROM story WHERE path IS NOT NULL GROUP BY ALL),
    dom AS (SELECT section_id, email_id, path FROM (SELECT *, sum(n) OVER (PARTITION BY section_id) AS total, row_number() OVER (PARTITION BY section_id ORDER BY n DESC, place) AS r FROM cnt) WHERE r = 1 AND n * 2 >= total)"""
_BODY = f"body AS (SELECT * FROM email_sections WHERE NOT {_PROMO} AND NOT {_TEASER})"
_PAIR = "lead({0}) OVER (PARTITION BY email_id ORDER BY order_index, id)"
_TC = lambda x: S.truncated(x, R.SECTION_CHARS)
_PROPOSED = "proposed AS (SELECT email_id, order_index % 2 AS group_no, section_key FROM email_sections WHERE heading IS NOT NULL)"
_POS = f"pos AS (SELECT email_id, section_key, row_number() OVER (PARTITION BY email_id ORDER BY order_index, id) - 1 AS position, {_PROMO} AS hard FROM email_sections)"

ORACLE = {
    "q_n01_truncate": f"SELECT id AS section_id, {S.truncated('text', 600)} AS text_cut, length({S.truncated('text', 600)}) AS n_chars FROM email_sections",
    "q_n02_hash": f"""WITH h AS (SELECT id, content_hash, sha256(CAST(to_json({{'links': coalesce(links, []), 'text': {_TC('text')}}}) AS VARCHAR)) AS hash FROM email_sections)
        SELECT id AS section_id, hash, CASE WHEN coalesce(content_hash, '') = '' THEN 'missing' WHEN content_hash = hash THEN 'valid' ELSE 'stale' END AS state FROM h""",
    "q_n03_merge": f"""WITH p AS (SELECT id AS left_id, {_PAIR.format('id')} AS right_id, order_index, {_PAIR.format('order_index')} AS no, heading, {_PAIR.format('heading')} AS nh, {_TC('text')} AS a, {_PAIR.format(_TC('text'))} AS b,
            links || {_PAIR.format('links')} AS l, image_urls || {_PAIR.format('image_urls')} AS im FROM email_sections)
        SELECT left_id, right_id, least(order_index, no) AS order_index, CASE WHEN coalesce(heading, '') <> '' THEN heading ELSE nh END AS heading,
            md5({_TC("concat_ws(chr(10) || chr(10), nullif(a, ''), nullif(b, ''))")}) AS text_md5, array_to_string({S.DISTINCT}, '|') AS links, len(list_distinct(im)) AS n_images FROM p WHERE right_id IS NOT NULL""",
    "q_n11_plaintext": f"WITH b AS (SELECT email_id, string_agg({_BLOCK}, {_SEP} ORDER BY order_index, id) AS t FROM email_sections GROUP BY email_id) SELECT email_id, md5(t) AS text_md5, length(t) AS n_chars FROM b",
    "q_d01_senders": f"SELECT id AS email_id, {_ADDRESS} AS address FROM emails",
    "q_d02_allowlist": f"WITH a AS (SELECT id AS email_id, split_part({_ADDRESS}, '@', 2) AS domain FROM emails) SELECT email_id, domain FROM a WHERE domain IN (SELECT lower(domain) FROM sender_registry WHERE category = 'RADAR')",
    "q_d03_promo": f"SELECT id AS section_id, {S.hits(S.BOTH, PROMO)}::BIGINT AS hits, {_PROMO} AS promo FROM email_sections",
    "q_d04_roles": f"{_ROLES} SELECT id AS section_id, email_id, position::INT AS position, n_sections, role, rule FROM roles",
    "q_d06_roles_by_sender": f"{_ROLES}, a AS (SELECT id AS email_id, {_ADDRESS} AS address FROM emails) SELECT coalesce(address, '') AS address, role, count(*) AS n_sections, sum(n)::BIGINT AS n_chars, bool_or({_STRIPPABLE}) AS strippable FROM roles JOIN a USING (email_id) GROUP BY 1, 2",
    "q_d08_recap": f"""WITH x AS (SELECT id, email_id, order_index, heading, {_RECAP_H} AS h FROM email_sections), y AS (SELECT *, {_RECAP} AS b FROM x)
        SELECT id AS section_id, email_id, CASE WHEN bool_or(b) OVER (PARTITION BY email_id ORDER BY order_index, id) THEN 'recap' ELSE 'hero' END AS part,
            first_value(heading) OVER (PARTITION BY email_id ORDER BY b DESC, order_index, id) AS bh FROM y""",
    "q_d09_unwrap": f"SELECT section_id, place::INT AS place, regexp_replace({S.strip('link')}, '#.*$', '') AS target FROM {_LINKS}",
    "q_d10_links": f"SELECT section_id, place::INT AS place, {_CLEAN} AS clean, {_TRACKING} AS tracking, {_SOCIAL} AS social, regexp_matches({_PATH}, '\\.(png|jpg|jpeg|gif|webp|svg|ico|avif)$') AS image, {_THOST} AS tracking_host, {_STORY} AS story FROM {_LINKS}",
    "q_p14_noise_links": f"SELECT {_HOST} AS host, count(*) AS n_links, sum(({_UNSUB} OR {_THOST} OR {_SOCIAL})::INT)::BIGINT AS n_noise, sum({_TRACKING}::INT)::BIGINT AS n_tracking FROM {_LINKS} GROUP BY 1",
    "q_d13_dominant": f"WITH {_DOM} SELECT section_id, path FROM dom",
    "q_d15_urls": f"SELECT email_id, count(DISTINCT u) AS n_urls FROM (SELECT email_id, unnest(CASE WHEN len({S.HTTPS}) = 0 THEN [NULL] ELSE {S.HTTPS} END) AS u FROM email_sections) GROUP BY 1",
    "q_d17_teaser": f"SELECT id AS section_id, {_TEASER} AS teaser FROM email_sections",
    "q_d19_shapes": f"""WITH {_DOM}, {_BODY}, chars AS (SELECT email_id, sum({_N}) AS c FROM body GROUP BY 1),
        stories AS (SELECT DISTINCT email_id, path FROM story WHERE path IS NOT NULL),
        blocks AS (SELECT d.email_id, d.path, sum({_N}) AS n FROM dom d JOIN body b ON b.id = d.section_id GROUP BY 1, 2),
        strong AS (SELECT email_id, count(*) AS n_stories, bool_and(coalesce(n >= {R.SUBSTANTIVE_CHARS}, false)) AS strong FROM stories LEFT JOIN blocks USING (email_id, path) GROUP BY 1)
        SELECT e.email_id, coalesce(c, 0)::BIGINT AS article_chars, coalesce(n_stories, 0) AS n_stories, CASE WHEN coalesce(c, 0) < {R.SUBSTANTIVE_CHARS} THEN 'teaser_paywall' WHEN coalesce(n_stories, 0) >= 2 AND strong THEN 'multi_story' ELSE 'single_article' END AS shape
        FROM (SELECT DISTINCT email_id FROM email_sections) e LEFT JOIN chars USING (email_id) LEFT JOIN strong USING (email_id)""",
    "q_g01_runs": f"""WITH x AS (SELECT id, email_id, order_index, {_PROMO} AS p FROM email_sections), y AS (SELECT *, sum(p::INT) OVER (PARTITION BY email_id ORDER BY order_index, id) AS n FROM x)
        SELECT id AS section_id, email_id, (dense_rank() OVER (PARTITION BY email_id ORDER BY n) - 1)::INT AS run_no FROM y WHERE NOT p""",
    "q_g02_decision": f"""WITH x AS (SELECT email_id, NOT {_PROMO} AS plain, {_N} AS n, {S.strip('heading')} AS h, {S.HTTPS} AS u FROM email_sections),
        urls AS (SELECT email_id, count(DISTINCT l) AS n_urls FROM (SELECT email_id, unnest(CASE WHEN plain AND len(u) > 0 THEN u ELSE [NULL] END) AS l FROM x) GROUP BY 1),
        per AS (SELECT email_id, sum(plain::INT)::BIGINT AS n_plain, sum(CASE WHEN plain THEN n ELSE 0 END)::BIGINT AS n_chars, sum((plain AND coalesce(regexp_matches(h, '{R.NUMBERED_PATTERN}'), false))::INT) AS nn,
            count(CASE WHEN plain AND length(h) > 3 THEN h END) AS nhead, count(DISTINCT CASE WHEN plain AND length(h) > 3 THEN h END) AS nd FROM x GROUP BY 1),
        d AS (SELECT *, n_plain > 1 AND nn < 2 AND n_urls < 3 AND NOT (n_plain <= 8 AND n_chars >= {R.LONG_FORM_CHARS} AND n_urls <= 1) AND n_plain BETWEEN 3 AND 8 AS amb FROM per JOIN urls USING (email_id))
        SELECT email_id, n_plain, n_urls, n_chars, nn >= 2 AS numbered, amb AS ambiguous, CASE WHEN amb THEN concat_ws(',', 'section_count_gray_zone', CASE WHEN nhead >= 3 AND nd >= 3 THEN 'mixed_heading_pattern' END, CASE WHEN n_urls BETWEEN 1 AND 2 THEN 'ambiguous_url_count' END) ELSE '' END AS reasons FROM d""",
    "q_g05_units": f"""WITH x AS (SELECT *, {_PROMO} AS p, {S.HTTPS} AS u FROM email_sections),
        e AS (SELECT email_id, count(DISTINCT l) >= 3 AS each FROM (SELECT email_id, unnest(CASE WHEN NOT p AND len(u) > 0 THEN u ELSE [NULL] END) AS l FROM x) GROUP BY 1),
        f AS (SELECT x.*, each, coalesce(lag(p) OVER (PARTITION BY email_id ORDER BY order_index, id), true) AS after_p FROM x JOIN e USING (email_id)),
        y AS (SELECT *, sum((p OR each OR after_p)::INT) OVER (PARTITION BY email_id ORDER BY order_index, id) AS g FROM f),
        z AS (SELECT email_id, g, coalesce(string_agg(CASE WHEN {S.strip('text')} <> '' THEN text END, chr(10) || chr(10) ORDER BY order_index, id), '') AS t, coalesce(string_agg(nullif(heading, ''), '|' ORDER BY order_index, id), '') AS h,
            len(list_distinct(flatten(list(u)))) AS n_links, string_agg({S.strip('section_key')}, ',' ORDER BY order_index, id) AS k FROM y GROUP BY 1, 2)
        SELECT email_id, 'u' || (row_number() OVER (PARTITION BY email_id ORDER BY g) - 1) AS content_unit_key, md5(t) AS text_md5, h AS headings, n_links, k AS section_keys FROM z""",
    "q_g06_boundaries": f"""WITH {_PROPOSED}, {_POS}, placed AS (SELECT * FROM proposed JOIN pos USING (email_id, section_key)),
        span AS (SELECT email_id, group_no, min(position) AS lo, max(position) AS hi FROM placed GROUP BY 1, 2 HAVING count(*) > 1)
        SELECT s.email_id, s.group_no, p.section_key, CASE WHEN p.hard THEN 'spans_hard_boundary' ELSE 'non_contiguous_group' END AS error FROM span s JOIN pos p ON p.email_id = s.email_id AND p.position BETWEEN s.lo AND s.hi
        WHERE NOT EXISTS (SELECT 1 FROM placed q WHERE q.email_id = s.email_id AND q.group_no = s.group_no AND q.section_key = p.section_key)""",
    "q_g07_coverage": f"WITH {_PROPOSED} SELECT email_id, section_key, 'missing_section_key' AS error FROM email_sections s WHERE NOT EXISTS (SELECT 1 FROM proposed p WHERE p.email_id = s.email_id AND p.section_key = s.section_key)",
    "q_g20_overlaps": f"""WITH {_PROPOSED}, {_POS}, span AS (SELECT email_id, group_no, min(position) AS lo, max(position) AS hi FROM proposed JOIN pos USING (email_id, section_key) GROUP BY 1, 2),
        b AS (SELECT *, lag(hi) OVER (PARTITION BY email_id ORDER BY lo, group_no) AS before FROM span) SELECT email_id, group_no, lo::INT AS lo, before::INT AS before, 'overlapping_units' AS error FROM b WHERE lo <= before""",
    "q_g13_story_units": f"""WITH {_BODY}, story AS (SELECT section_id, email_id, place, {_STORY} AS path FROM {_LINKS}), cnt AS (SELECT section_id, email_id, path, count(*) AS n, min(place) AS place FROM story WHERE path IS NOT NULL GROUP BY ALL),
        dom AS (SELECT section_id, path FROM (SELECT *, sum(n) OVER (PARTITION BY section_id) AS total, row_number() OVER (PARTITION BY section_id ORDER BY n DESC, place) AS r FROM cnt) WHERE r = 1 AND n * 2 >= total),
        z AS (SELECT b.email_id, path, string_agg({S.strip('section_key')}, ',' ORDER BY order_index, id) AS k FROM body b JOIN dom d ON d.section_id = b.id GROUP BY 1, 2)
        SELECT email_id, 'u' || (row_number() OVER (PARTITION BY email_id ORDER BY path) - 1) AS content_unit_key, k AS section_keys FROM z""",
    "q_g15_profiles": f"""{_ROLES}, per AS (SELECT email_id, coalesce(string_agg(CASE WHEN NOT ({_STRIPPABLE}) AND {S.strip('text')} <> '' THEN text END, chr(10) || chr(10) ORDER BY order_index, id), '') AS t,
            coalesce(string_agg(CASE WHEN NOT ({_STRIPPABLE}) THEN section_key END, ',' ORDER BY order_index, id), '') AS k, coalesce(string_agg(CASE WHEN {_STRIPPABLE} THEN section_key END, ',' ORDER BY order_index, id), '') AS hk,
            sum(n)::BIGINT AS total_chars, sum(CASE WHEN {_STRIPPABLE} THEN n ELSE 0 END)::BIGINT AS hidden_chars FROM roles GROUP BY 1)
        SELECT email_id, md5(t) AS article_md5, k AS section_keys, hk AS hidden_keys, total_chars, hidden_chars, length({S.strip('t')}) AS article_chars,
            CASE WHEN length({S.strip('t')}) < 200 THEN 'empty_body' WHEN total_chars > 0 AND hidden_chars / total_chars > 0.5 THEN 'promo_dominated' END AS counter_evidence FROM per""",
    "q_g17_merged_hash": f"""{_ROLES}, per AS (SELECT email_id, list(coalesce(content_hash, '') ORDER BY order_index, id) AS h FROM roles WHERE NOT ({_STRIPPABLE}) GROUP BY 1)
        SELECT email_id, sha256(CAST(to_json({{'content_unit_key': 'u0', 'section_content_hashes': h, 'strategy': 'single_article'}}) AS VARCHAR)) AS merged_hash FROM per""",
    "q_g19_outline": f"SELECT id AS section_id, left(coalesce(text, ''), 280) AS snippet, {_N} AS char_count, len({S.HTTPS}) AS link_count, array_to_string({S.HTTPS}[1:3], '|') AS primary_links FROM email_sections",
    "q_o12_audit": f"{_ROLES} SELECT id AS section_id, CASE WHEN {_STRIPPABLE} THEN 'hidden' ELSE 'article' END AS disposition, rule, n AS n_chars, left(coalesce(text, ''), 200) AS preview FROM roles",
}
ORACLE["q_d08_recap"] = ORACLE["q_d08_recap"].replace("AS bh FROM y", "AS bh, bool_or(b) OVER (PARTITION BY email_id) AS any_b FROM y")
ORACLE["q_d08_recap"] = f"SELECT section_id, email_id, part, CASE WHEN any_b THEN bh END AS boundary_heading FROM ({ORACLE['q_d08_recap']})"
ORACLE["q_n08_pack"] = f"""WITH RECURSIVE b AS (SELECT email_id, row_number() OVER (PARTITION BY email_id ORDER BY order_index, id) AS p, section_key, length({_BLOCK}) AS n FROM email_sections),
    r AS (SELECT email_id, p, 0 AS ci, n AS len, n > 4000 AS alone FROM b WHERE p = 1
        UNION ALL SELECT b.email_id, b.p, CASE WHEN NOT alone AND b.n <= 4000 AND len + 7 + b.n <= 4000 THEN ci ELSE ci + 1 END, CASE WHEN NOT alone AND b.n <= 4000 AND len + 7 + b.n <= 4000 THEN len + 7 + b.n ELSE b.n END, b.n > 4000 FROM r JOIN b ON b.email_id = r.email_id AND b.p = r.p + 1)
    SELECT email_id, ci AS chunk_index, string_agg(section_key, ',' ORDER BY p) AS section_keys, max(len)::INT AS n_chars FROM r JOIN b USING (email_id, p) GROUP BY 1, 2"""
ORACLE["q_n09_capped"] = f"""WITH RECURSIVE pk AS ({ORACLE["q_n08_pack"]}),
    m AS (SELECT email_id, list(section_keys ORDER BY chunk_index) AS ks, list((n_chars - (len(string_split(section_keys, ',')) - 1) * 7)::BIGINT ORDER BY chunk_index) AS sz FROM pk GROUP BY 1
        UNION ALL SELECT email_id, list_concat(list_concat(ks[:p - 1], [ks[p] || ',' || ks[p + 1]]), ks[p + 2:]), list_concat(list_concat(sz[:p - 1], [sz[p] + sz[p + 1]]), sz[p + 2:])
            FROM (SELECT *, list_position(pair, list_min(pair)) AS p FROM (SELECT *, list_transform(range(1, len(sz)), lambda i: sz[i] + sz[i + 1]) AS pair FROM m WHERE len(sz) > 3))),
    u AS (SELECT email_id, unnest(ks) AS section_keys, unnest(sz) AS n, generate_subscripts(ks, 1) - 1 AS chunk_index FROM m WHERE len(sz) <= 3)
    SELECT email_id, chunk_index::INT AS chunk_index, section_keys, (n + (len(string_split(section_keys, ',')) - 1) * 7)::INT AS n_chars FROM u"""
_CUT = lambda x: f"CASE WHEN length({x}) > {R.SECTION_CHARS} THEN left({x}, {R.SECTION_CHARS - 1}) || '…' ELSE {x} END"
ORACLE["q_n04_routing"] = f"""WITH RECURSIVE b AS (SELECT email_id, list({S.truncated('text', R.SECTION_CHARS)} ORDER BY order_index, id) AS ts, list(heading ORDER BY order_index, id) AS hs, list(coalesce(links, []) ORDER BY order_index, id) AS lk, list(coalesce(image_urls, []) ORDER BY order_index, id) AS im FROM email_sections GROUP BY 1),
    e AS (SELECT *, {S.strip("array_to_string(list_filter(ts, lambda t: t <> ''), chr(10) || chr(10))")} AS whole, len(ts) >= {R.PATHOLOGICAL_SECTIONS} AS env FROM b),
    r AS (SELECT email_id, env, CASE WHEN env THEN [1::BIGINT] ELSE range(1, len(ts) + 1) END AS f, CASE WHEN env THEN [len(ts)] ELSE range(1, len(ts) + 1) END AS l, CASE WHEN env THEN [{_CUT('whole')}] ELSE ts END AS t FROM e
        UNION ALL SELECT email_id, env, list_concat(f[:p], f[p + 2:]), list_concat(l[:p - 1], l[p + 1:]), list_concat(list_concat(t[:p - 1], [{_CUT('j')}]), t[p + 2:])
            FROM (SELECT *, {S.strip("concat_ws(chr(10) || chr(10), nullif(t[p], ''), nullif(t[p + 1], ''))")} AS j
                FROM (SELECT *, CASE WHEN len(t) > {R.SECTIONS_PER_EMAIL} THEN list_position(pair, list_min(pair)) WHEN i > 1 AND (i = len(t) OR length(t[i - 1]) <= length(t[i + 1])) THEN i - 1 ELSE i END AS p
                    FROM (SELECT *, list_transform(range(1, len(t)), lambda k: length(t[k]) + length(t[k + 1])) AS pair, list_position(list_transform(t, lambda x: length(x) < {R.SHORT_SECTION_CHARS}), true) AS i FROM r)
                    WHERE len(t) > {R.SECTIONS_PER_EMAIL} OR (len(t) > 1 AND i > 0)))),
    d AS (SELECT *, list_position(list_transform(t, lambda x: length(x) < {R.SHORT_SECTION_CHARS}), true) AS i FROM r), z AS (SELECT * FROM d WHERE len(t) <= {R.SECTIONS_PER_EMAIL} AND (len(t) = 1 OR coalesce(i, 0) = 0)),
    u AS (SELECT email_id, env, unnest(f) AS f, unnest(l) AS l, unnest(t) AS t, generate_subscripts(t, 1) - 1 AS o FROM z)
    SELECT u.email_id, 's' || o AS section_key, o::INT AS order_index, CASE WHEN NOT u.env THEN list_filter(hs[f:l], lambda h: h IS NOT NULL AND h <> '')[1] END AS heading, length(t)::INT AS n_chars, len(list_distinct(flatten(lk[f:l])))::INT AS n_links, len(list_distinct(flatten(im[f:l])))::INT AS n_images FROM u JOIN e USING (email_id)"""
