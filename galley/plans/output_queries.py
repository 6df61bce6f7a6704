"""Queries over typed outputs: validation, rows of a page, pages, processors, dispatch, link repair, prompts."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from galley.functions import rules
from galley.functions.predicates import unwrapped
from galley.operators import compose as O
from galley.operators import outputs as T
from galley.operators import processors as P
from galley.operators import state as R
from galley.operators.scorer import residual
from galley.plans import sql as SQL
from galley.session import table


def _log(spark, root):
    return T.with_json(table(spark, root, "agent_outputs"))


def _sections(spark, root):
    return table(spark, root, "email_sections")


def c03_errors(spark, root):
    """What is wrong with each payload: the whole log against the links of its sections."""
    links = _sections(spark, root).select(F.col("id").alias("email_section_id"), T.allowed_links(F.col("links")).alias("allowed"))
    x = _log(spark, root).join(links, "email_section_id", "left").withColumn("allowed", F.coalesce("allowed", F.array().cast("array<string>")))
    return T.validated(x, F.col("allowed")).select("id", "kind", F.array_join("errors", ",").alias("errors"))


def c02_unwrapped(spark, root):
    """The JSON of every payload without its wrapping, null where it is unreadable."""
    return _log(spark, root).select("id", F.md5("json").alias("json_md5"))


def _shown(spark, root):
    x = O.display_order(O.shown_rows(R.latest_outputs(table(spark, root, "agent_outputs"), _sections(spark, root))))
    return T.with_json(x)


def _latest_json(spark, root):
    return T.with_json(R.latest_outputs(table(spark, root, "agent_outputs"), _sections(spark, root)))


def _shaped(kinds: tuple[str, ...]):
    def query(spark, root):
        rows = _latest_json(spark, root).where(F.col("kind").isin(*kinds))
        x = T.shaped(rows)
        lines = F.array_join(F.transform("parts", lambda p: F.concat_ws("|", F.coalesce(p["label"], F.lit("-")), F.coalesce(p["text"], F.lit("-")), F.coalesce(p["url"], F.lit("-")))), "\n")
        return x.select("id", "email_id", "list", F.col("card_no").cast("int").alias("card_no"), "section_heading", "title", "url", F.md5("body").alias("body_md5"), "note", F.size("parts").cast("long").alias("n_parts"), F.md5(lines).alias("parts_md5"))

    query.__doc__ = f"The rows of a page from the outputs of kind {' and '.join(kinds)}."
    return query


o07_technology, o07_longform, o07_radar, o07_leadership = (_shaped((k,)) for k in ("technology", "technical_longform", "radar", "leadership"))
o07_essay, o07_courses, o07_cards = _shaped(("leadership_essay",)), _shaped(("courses", "noise")), _shaped(("ainews_radar_digest",))


def _page_rows(spark, root, by):
    """The rendered rows of every email, with their place."""
    shown = T.shaped(_shown(spark, root)).join(O.labels(table(spark, root, "emails")), "email_id")
    place = F.struct("email_id", "section_place", "unit_place", "kind_place", "id", "card_no")
    return shown.select("email_id", "list", place.alias("place"), T.row_html(F.col("subject"), F.col("sender"), F.col("section_heading")).alias("html"))


def k01_pages(spark, root):
    """The page of every digest from the shown outputs of its emails."""
    d = table(spark, root, "digest_emails").distinct()
    rows = _page_rows(spark, root, "digest_id").join(d, "email_id")
    return T.pages(rows, "digest_id", "Daily digest").select("digest_id", F.md5("html").alias("html_md5"), F.length("html").cast("long").alias("n_chars"))


def _work(spark, root):
    """Sections with the latest category of their router, and what the processors need of their mail."""
    s = _sections(spark, root)
    top = R.latest(table(spark, root, "agent_outputs").where("kind = 'router' and email_section_id is not null"), ["email_section_id"])
    category = F.coalesce("category", T.text_at(unwrapped(F.col("payload")), "category"))
    top = top.select(F.col("email_section_id").alias("id"), O.coerced_category(category).alias("category"))
    first = F.struct("order_index", "id")
    mail = s.groupBy("email_id").agg(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("order_index", "id", "links"))), lambda x: F.coalesce(x["links"], F.array().cast("array<string>"))))).alias("page_links"), F.min_by(F.get("links", F.lit(0)), first).alias("original_url"))
    return s.join(top, "id").join(mail, "email_id").join(O.labels(table(spark, root, "emails")).select("email_id", "subject"), "email_id").select("id", "email_id", "category", "subject", "heading", "text", "links", "page_links", "original_url")


def c10_dispatch(spark, root):
    """The processor, prompt and candidate links of every section with a category."""
    x = P.dispatched(_work(spark, root))
    return x.select("id", "category", "kind", F.md5("prompt").alias("prompt_md5"), F.size("candidates").cast("long").alias("n_candidates"), F.md5(F.array_join("candidates", "\n")).alias("candidates_md5"))


def c08_repair(spark, root):
    """The link of every technology and longform output, repaired from the links of its section and mail."""
    outs = _log(spark, root).where("kind in ('technology', 'technical_longform') and json is not null and email_section_id is not null")
    w = _work(spark, root).select(F.col("id").alias("email_section_id"), "links", "page_links", "original_url")
    x = outs.select("id", "kind", "email_section_id", F.coalesce(T.text_at(F.col("json"), "original_url"), F.get_json_object("json", "$.stories[0].article_url")).alias("found")).join(w, "email_section_id")
    columns = [F.col(c) for c in ("links", "page_links", "original_url")]
    fixed = F.when(F.col("kind") == "technology", P.repaired_url(F.col("found"), *columns)).otherwise(P.single_url(F.col("found"), P.article_candidates(*columns)))
    return x.select("id", "kind", "found", fixed.alias("url"))


def answering(prompt: str, attempt: int, error: str | None) -> str:
    """A scorer for tests and queries: an answer that fits no rule or all of them, by the hash of the prompt."""
    h = hashlib.md5(prompt.encode("utf-8", "replace")).hexdigest()
    if h[0] in "012" and attempt == 1:
        return "not json"
    body = {"title": f"t{h[:4]}", "core_pain_point": "p", "original_url": f"https://a.example/{h[:2]}", "summary": "s" if h[1] < "8" else "", "items": [{"entity": "e", "impact_or_action": "i"}]}
    return json.dumps(body)


def c07_processed(spark, root):
    """Every section with a category and no processor output yet, scored by the processor of its category, link repaired, rules checked."""
    done = table(spark, root, "agent_outputs").where("kind in ('technology', 'radar', 'leadership', 'courses') and email_section_id is not null").select(F.col("email_section_id").alias("id"))
    x = P.processed(P.dispatched(residual(_work(spark, root), done, ["id"])), "id", answering)
    return x.select("id", "kind", F.get_json_object("value", "$.title").alias("title"), F.get_json_object("value", "$.original_url").alias("original_url"), "error", F.col("attempts").cast("int").alias("attempts"))


def c11_router_prompts(spark, root):
    s = _work(spark, root)
    return s.select("id", F.md5(P.router_prompt(F.col("subject"), F.col("heading"), F.col("text"))).alias("router_md5"), F.md5(P.newsletter_prompt(F.col("subject"), F.col("text"))).alias("newsletter_md5"), F.md5(P.page_prompt(F.col("subject"), F.col("text"), F.col("page_links"), F.col("original_url"), "Links:")).alias("page_md5"))


def c11_unit_prompts(spark, root):
    s = _work(spark, root)
    p = P.unit_prompt(F.col("subject"), F.col("heading"), F.array("heading", F.lit("More")), F.col("text"), F.col("links"))
    return s.select("id", F.md5(p).alias("prompt_md5"))


QUERIES = {f"q_{n}": f for n, f in {
    "c02_unwrapped": c02_unwrapped, "c03_errors": c03_errors, "o07_technology": o07_technology, "o07_longform": o07_longform, "o07_radar": o07_radar, "o07_leadership": o07_leadership, "o07_essay": o07_essay, "o07_courses": o07_courses, "o07_cards": o07_cards,
    "k01_pages": k01_pages, "c07_processed": c07_processed, "c08_repair": c08_repair, "c10_dispatch": c10_dispatch, "c11_router_prompts": c11_router_prompts, "c11_unit_prompts": c11_unit_prompts,
}.items()}

# --- the same in SQL -------------------------------------------------------------------------------------


_X = lambda name, j="j": f"json_extract_string({j}, '$.{name}')"


def _list(t: str) -> str:
    return f"CASE WHEN {t} IS NULL THEN []::JSON[] WHEN json_valid({t}) AND json_type({t}) = 'ARRAY' THEN json_extract({t}, '$[*]') WHEN json_valid({t}) AND json_type({t}) = 'OBJECT' THEN [CAST({t} AS JSON)] ELSE []::JSON[] END"


_ALLOWED = f"list_distinct({SQL.HTTPS})"
_BLANK = lambda x: f"({SQL.strip(f'''coalesce({x}, '')''')} = '')"
_LOST = lambda l, *names: f"len(list_filter({l}, lambda x: {' OR '.join(_X(n, 'x') + ' IS NULL' for n in names)})) > 0"
_TEXT = lambda n, most: f"CASE WHEN coalesce({_X(n)}, '') = '' THEN '{n}:missing' END, CASE WHEN length({_X(n)}) > {most} THEN '{n}:too_long' END"
_URL = "CASE WHEN u <> '' AND NOT starts_with(u, 'https://') THEN 'original_url:not_https' END, CASE WHEN starts_with(u, 'https://') AND NOT list_contains(allowed, u) THEN 'original_url:not_allowed' END"
_OLD = f"({_X('summary')} IS NULL AND {_X('actions')} IS NULL AND {_X('reason')} IS NOT NULL)"
_FLAT = SQL.strip(f"regexp_replace({_X('reason')}, '{SQL._SPACE}+', ' ', 'g')")
_SUMMARY = f"CASE WHEN {_OLD} THEN CASE WHEN {_FLAT} = '' THEN 'Legacy noise entry (no summary).' ELSE {_FLAT} END ELSE coalesce({_X('summary')}, '') END"
_CTA = lambda f, x="x": f"json_extract_string(CASE WHEN json_valid(json_extract_string({x}, '$.cta')) THEN json_extract_string({x}, '$.cta') END, '$.{f}')"
_CATS = "('TECHNOLOGY', 'RADAR', 'LEADERSHIP', 'COURSES')"
_COERCED = lambda c: f"CASE WHEN {c} IN ('EVERY_BUNDLE', 'MULTI_BUNDLE') THEN 'TECHNOLOGY' WHEN {c} = 'NOISE' THEN 'COURSES' ELSE {c} END"
_ROLE = lambda x: f"coalesce({_X('role', x)}, 'recap')"


def _parts_none(parts) -> str:
    return " AND ".join(f"len({_list(_X(n))}) = 0" for n, _ in parts)


def _errors() -> str:
    conf = f"TRY_CAST({_X('confidence')} AS DOUBLE)"
    signals, items, cards = (_list(_X(n)) for n in ("signals", "items", "cards"))
    by_kind = {
        "'router', 'classifier'": f"CASE WHEN NOT coalesce({_COERCED(_X('category'))} IN {_CATS}, false) THEN 'category:invalid' END, CASE WHEN NOT coalesce({conf} BETWEEN 0 AND 1, false) THEN 'confidence:invalid' END",
        "'technology'": f"{_TEXT('title', 500)}, {_TEXT('core_pain_point', 240)}, {_URL}",
        "'radar'": f"CASE WHEN {_LOST(items, 'entity', 'impact_or_action')} THEN 'items:missing_field' END",
        "'leadership'": f"CASE WHEN {_LOST(signals, 'theme', 'insight', 'actionable_item')} THEN 'signals:missing_field' END, CASE WHEN len({signals}) = 0 AND {_BLANK(_X('summary'))} THEN 'empty' END, CASE WHEN len(list_filter({signals}, lambda x: NOT {_BLANK(_X('link', 'x'))} AND NOT list_contains(allowed, {SQL.strip(_X('link', 'x'))}))) > 0 THEN 'signals:not_allowed' END",
        "'courses', 'noise'": f"""CASE WHEN length(summary) > 4000 THEN 'summary:too_long' END, CASE WHEN {_LOST('acts', 'label', 'url')} THEN 'actions:missing_field' END, CASE WHEN len(list_filter(blocks, lambda x: {_X('text', 'x')} IS NULL OR {_CTA('label')} IS NULL OR {_CTA('url')} IS NULL)) > 0 THEN 'promo_blocks:missing_field' END,
            CASE WHEN len(list_filter(acts, lambda x: length({_X('label', 'x')}) > 200)) + len(list_filter(blocks, lambda x: length({_CTA('label')}) > 200)) > 0 THEN 'label:too_long' END, CASE WHEN len(list_filter(blocks, lambda x: length({_X('text', 'x')}) > 2000)) > 0 THEN 'promo_blocks:too_long' END,
            CASE WHEN len(list_filter(urls, lambda x: NOT starts_with(x, 'https://'))) > 0 THEN 'url:not_https' END, CASE WHEN {_BLANK('summary')} AND len(acts) = 0 AND len(blocks) = 0 THEN 'empty' END, CASE WHEN len(list_filter(urls, lambda x: NOT list_contains(allowed, x))) > 0 THEN 'url:not_allowed' END""",
        "'leadership_essay'": f"{_TEXT('title', 500)}, {_TEXT('core_thesis', 800)}, CASE WHEN {_parts_none(T.ESSAY_PARTS)} THEN 'empty' END, {_URL}",
        "'technical_longform'": f"{_TEXT('title', 500)}, CASE WHEN NOT coalesce({_X('format')} IN {T.FORMATS}, false) THEN 'format:invalid' END, {_TEXT('central_topic', 800)}, CASE WHEN {_parts_none(T.LONGFORM_PARTS)} THEN 'empty' END, {_URL}",
        "'ainews_radar_digest'": f"CASE WHEN {_LOST(cards, 'title', 'tldr')} THEN 'cards:missing_field' END, CASE WHEN len(list_filter({cards}, lambda x: {_ROLE('x')} NOT IN ('top_story', 'recap'))) > 0 THEN 'role:invalid' END, "
        + ", ".join(f"CASE WHEN len(list_filter({cards}, lambda x: len({_list(_X(n, 'x'))}) > {m})) > 0 THEN '{n}:too_many' END" for n, m in (("key_points", 7), ("why_it_matters", 3), ("watchouts", 3)))
        + f", CASE WHEN len({cards}) = 0 THEN 'cards:empty' END, CASE WHEN len({cards}) > 3 THEN 'cards:too_many' END, CASE WHEN len(list_filter({cards}, lambda x: {_ROLE('x')} = 'top_story')) > 1 THEN 'top_story:too_many' END",
    }
    whens = " ".join(f"WHEN kind IN ({k}) THEN [{v}]" for k, v in by_kind.items())
    return f"""WITH {SQL.peeled()}, l AS (SELECT log.*, coalesce({_ALLOWED}, []) AS allowed, {SQL.strip(f"coalesce({_X('original_url')}, '')")} AS u, {_SUMMARY} AS summary, {_list(_X('actions'))} AS acts, {_list(_X('promo_blocks'))} AS blocks FROM log LEFT JOIN email_sections s ON s.id = email_section_id),
        e AS (SELECT *, list_filter(list_concat(list_transform(acts, lambda x: {SQL.strip(_X('url', 'x'))}), list_transform(blocks, lambda x: {SQL.strip(_CTA('url'))})), lambda x: x IS NOT NULL) AS urls FROM l)
        SELECT id, kind, CASE WHEN j IS NULL THEN 'payload:unreadable' ELSE array_to_string(list_filter(CASE {whens} END, lambda x: x IS NOT NULL), ',') END AS errors FROM e WHERE kind IN {T.CHECKED}"""


_PART = lambda label, text, url: f"concat_ws('|', coalesce({label}, '-'), coalesce({text}, '-'), coalesce({url}, '-'))"
_GROUP = lambda parts, j="j", cut=False: "list_concat(" + ", ".join(f"list_transform({_list(_X(n, j))}{'[:%d]' % rules.SHOWN_KEY_POINTS if cut and n == 'key_points' else ''}, lambda x: {_PART(SQL.q(label), '''json_extract_string(x, '$')''', 'NULL')})" for n, label in parts) + ")"
_TOPLOG = "(SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY email_id, email_section_id, content_unit_key, kind ORDER BY id DESC) AS r FROM log) WHERE r = 1)"
_FITS = "(CASE kind " + " ".join(f"WHEN '{k}' THEN '{c}'" for k, (_, c) in O.KINDS.items()) + " END) = " + _COERCED("category")


def _rows(kinds: tuple[str, ...]) -> str:
    """SELECT of the shaped rows of kinds, over a relation ``t`` (outputs with j): list, card_no, title, url, body, note, parts (texts)."""
    link = f"CASE WHEN NOT {_BLANK(_X('original_url'))} THEN {SQL.strip(_X('original_url'))} END"
    cat = lambda l: l.replace("list_transform", "list_transform")
    diagrams = f"list_transform({_list(_X('diagrams'))}, lambda x: {_PART(_X('diagram_type', 'x'), 'concat_ws(chr(10) || chr(10), ' + _X('title', 'x') + ', ' + _X('content', 'x') + ')', 'NULL')})"
    items = f"list_transform({_list(_X('items'))}, lambda x: {_PART(_X('entity', 'x'), _X('impact_or_action', 'x'), _X('url', 'x'))})"
    signals = f"list_transform({_list(_X('signals'))}, lambda x: {_PART(_X('theme', 'x'), '''concat_ws(' — ', ''' + _X('insight', 'x') + ', ' + _X('actionable_item', 'x') + ')', _X('link', 'x'))})"
    courses = f"list_concat(list_transform({_list(_X('actions'))}, lambda x: {_PART(_X('label', 'x'), 'NULL', _X('url', 'x'))}), list_transform({_list(_X('promo_blocks'))}, lambda x: {_PART(_CTA('label'), _X('text', 'x'), _CTA('url'))}))"
    fields = {
        "technology": ("'technical_index'", _X("title"), link, _X("core_pain_point"), "NULL", diagrams),
        "technical_longform": ("'technical_index'", _X("title"), link, _X("central_topic"), _X("format"), _GROUP(T.LONGFORM_PARTS)),
        "radar": ("'ai_radar'", "NULL", "NULL", _X("summary"), "NULL", items),
        "leadership": ("'leadership_signals'", "NULL", "NULL", _X("summary"), "NULL", signals),
        "leadership_essay": ("'leadership_essays'", _X("title"), link, _X("core_thesis"), "NULL", _GROUP(T.ESSAY_PARTS)),
        "courses": ("'courses'", "NULL", "NULL", _SUMMARY, "NULL", courses),
    }
    fields["noise"] = fields["courses"]
    fine = f"j IS NOT NULL AND coalesce({_FITS}, false)"
    if kinds == ("ainews_radar_digest",):
        return f"""SELECT t.* EXCLUDE (c, card_no), CASE WHEN {_ROLE('c')} = 'top_story' THEN 'ai_radar_top_story' ELSE 'ai_radar_recap' END AS list, CAST(card_no AS INT) AS card_no, {_X('title', 'c')} AS title, CAST(NULL AS VARCHAR) AS url, {_X('tldr', 'c')} AS body, CAST(NULL AS VARCHAR) AS note, {cat(_GROUP(T.CARD_PARTS, 'c', True))} AS parts
            FROM (SELECT *, unnest({_list(_X('cards'))}) AS c, generate_subscripts({_list(_X('cards'))}, 1) - 1 AS card_no FROM t WHERE kind = 'ainews_radar_digest' AND {fine}) t"""
    out = []
    for k in kinds:
        name, title, url, body, note, parts = fields[k]
        out.append(f"SELECT t.*, {name} AS list, 0 AS card_no, CAST({title} AS VARCHAR) AS title, CAST({url} AS VARCHAR) AS url, {body} AS body, CAST({note} AS VARCHAR) AS note, {parts} AS parts FROM t WHERE kind = '{k}' AND {fine}")
    return " UNION ALL ".join(out)


def _shaped_sql(*kinds: str) -> str:
    return f"""WITH {SQL.peeled()}, t AS (SELECT o.*, s.heading AS section_heading FROM {_TOPLOG} o LEFT JOIN email_sections s ON s.id = o.email_section_id), x AS ({_rows(kinds)})
        SELECT id, email_id, list, card_no, section_heading, title, url, md5(body) AS body_md5, note, len(parts) AS n_parts, md5(array_to_string(parts, chr(10))) AS parts_md5 FROM x"""


_LABELS = r"SELECT id AS email_id, CASE WHEN coalesce(subject, '') <> '' THEN subject ELSE 'Email #' || id END AS subject, sender FROM emails"
_IMAGES = "(" + " OR ".join(f"ends_with(lower(regexp_replace(regexp_replace(x, '[?#].*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*', '')), '{s}')" for s in rules.IMAGE_SUFFIXES) + ")"
_UNIQUE = lambda l: f"list_filter({l}, lambda y, i: list_position({l}, y) = i)"
_STRIPPED = lambda l: f"list_filter(list_transform(coalesce({l}, []), lambda x: {SQL.strip('x')}), lambda x: starts_with(x, 'https://'))"
_LEAD = lambda u, l: f"CASE WHEN starts_with({u}, 'https://') AND NOT list_contains({l}, {u}) THEN list_prepend({u}, {l}) ELSE {l} END"

# work: the sections with a category, as ``_work``; cand_a and cand_x the article and action candidates.
_WORK = f"""{SQL.peeled()}, top AS (SELECT email_section_id AS id, {_COERCED("coalesce(category, " + _X('category') + ")")} AS category FROM (SELECT *, row_number() OVER (PARTITION BY email_section_id ORDER BY id DESC) AS r FROM log WHERE kind = 'router' AND email_section_id IS NOT NULL) WHERE r = 1),
    mail0 AS (SELECT email_id, flatten(list(coalesce(links, []) ORDER BY order_index, id)) AS l, first(links[1] ORDER BY order_index, id) AS original_url FROM email_sections GROUP BY 1), mail AS (SELECT email_id, {SQL.DISTINCT} AS page_links, original_url FROM mail0),
    w0 AS (SELECT s.id, s.email_id, top.category, b.subject, s.heading, s.text, s.links, m.page_links, m.original_url, {SQL.strip("coalesce(m.original_url, '')")} AS oh FROM email_sections s JOIN top USING (id) JOIN mail m USING (email_id) JOIN ({_LABELS}) b USING (email_id)),
    w1 AS (SELECT *, list_filter(coalesce(links, []), lambda x: NOT {_IMAGES}) AS own, list_filter(page_links, lambda x: NOT {_IMAGES}) AS pg, list_concat({_STRIPPED('links')}, {_STRIPPED('page_links')}) AS l, {_STRIPPED('links')} AS hl FROM w0),
    w2 AS (SELECT *, list_concat(own, list_filter(pg, lambda x: NOT list_contains(own, x))) AS a0, {SQL.DISTINCT} AS x0, {_UNIQUE('hl')} AS hl1 FROM w1),
    w3 AS (SELECT *, {_LEAD('oh', 'a0')} AS cand_a, {_LEAD('oh', 'x0')} AS cand_x, {_LEAD('oh', 'hl1')} AS shown FROM w2),
    work AS (SELECT *, CASE WHEN len(coalesce(links, [])) > 0 THEN shown ELSE cand_x END AS shown_x FROM w3)"""
_NUM = lambda l: f"CASE WHEN len({l}) = 0 THEN '  (none)' ELSE array_to_string(list_transform({l}, lambda u, i: '  ' || i || '. ' || u), chr(10)) END"
_NL = "chr(10) || chr(10)"
_LISTED = lambda title, l: f"concat_ws({_NL}, 'Subject: ' || nullif(subject, ''), 'Section heading: ' || nullif(heading, ''), {SQL.q(title)} || chr(10) || {_NUM(l)}, 'Section plain text (this slice only):' || chr(10) || coalesce(text, ''))"
_BARE = lambda c: f"nullif({SQL.strip(f'''coalesce({c}, '')''')}, '')"
_SLICE = "'Section plain text (this slice only):' || chr(10) || coalesce(text, '')"
_KIND = "CASE category WHEN 'TECHNOLOGY' THEN 'technology' WHEN 'RADAR' THEN 'radar' WHEN 'LEADERSHIP' THEN 'leadership' WHEN 'COURSES' THEN 'courses' END"
_PROMPT = f"CASE category WHEN 'TECHNOLOGY' THEN {_LISTED(P._ARTICLES, 'shown')} WHEN 'RADAR' THEN concat_ws({_NL}, 'Subject: ' || {_BARE('subject')}, 'Section heading: ' || {_BARE('heading')}, {_SLICE}) WHEN 'LEADERSHIP' THEN {_LISTED(P._SIGNALS, 'shown_x')} WHEN 'COURSES' THEN {_LISTED(P._ACTIONS, 'shown_x')} END"
_PROMPT = _PROMPT.replace("shown_x ELSE", "shown_x ELSE")
_CAND = f"CASE category WHEN 'TECHNOLOGY' THEN cand_a WHEN 'RADAR' THEN cand_x WHEN 'LEADERSHIP' THEN cand_x WHEN 'COURSES' THEN cand_x ELSE [] END"
# the candidates of a repair: the original first, then the others, then the section's own links
_REPAIR = "r0 AS (SELECT *, list_concat(CASE WHEN starts_with(oh, 'https://') THEN list_prepend(oh, list_filter(cand_a, lambda x: x <> oh)) ELSE cand_a END, []) AS c0 FROM work), r1 AS (SELECT *, list_concat(c0, list_filter(hl1, lambda x: NOT list_contains(c0, x))) AS c1 FROM r0), rep AS (SELECT *, list_filter(pg, lambda x: list_contains(c1, x))[1] AS on_page FROM r1)"
_FIXED = "CASE WHEN coalesce(list_contains(c1, found), false) THEN found WHEN len(c1) = 1 THEN c1[1] ELSE coalesce(on_page, found) END"
_SINGLE = "CASE WHEN NOT coalesce(list_contains(cand_a, found), false) AND len(cand_a) = 1 THEN cand_a[1] ELSE found END"


def _pages_sql() -> str:
    esc = lambda c: f"replace(replace(replace(replace(replace(coalesce({c}, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&#34;'), '''', '&#39;')"
    when = lambda c, h: f"CASE WHEN coalesce({c}, '') <> '' THEN {h} ELSE '' END"
    linked = lambda t, u: f"CASE WHEN coalesce({u}, '') <> '' THEN '<a href=\"' || {esc(u)} || '\">' || {esc(t)} || '</a>' ELSE {esc(t)} END"
    # parts as lists of [label, text, url]
    kinds = [("technology",), ("technical_longform",), ("radar",), ("leadership",), ("leadership_essay",), ("courses", "noise"), ("ainews_radar_digest",)]
    rows = " UNION ALL BY NAME ".join(f"({_rows(k)})" for k in kinds)
    global _PART
    entry = f"'<li><strong>' || {linked('p[1]', 'p[3]')} || '</strong> ' || {esc('p[2]')} || '</li>'"
    html = f"""'<div class="item">' || {when('section_heading', f"'<div class=\"sub\"><strong>' || {esc('section_heading')} || '</strong></div>'")} || '<div><strong>' || {esc('subject')} || '</strong></div>' || {when('sender', f"'<div class=\"sub\">From: ' || {esc('sender')} || '</div>'")}
        || {when('title', f"'<div>' || {linked('title', 'url')} || '</div>'")} || {when('body', f"'<div>' || {esc('body')} || '</div>'")} || {when('note', f"'<div class=\"sub\">Format: ' || {esc('note')} || '</div>'")} || CASE WHEN len(parts) > 0 THEN '<ul>' || array_to_string(list_transform(parts, lambda p: {entry}), '') || '</ul>' ELSE '' END || '</div>'"""
    lists = " || ".join(f"'<h2>{h}</h2>' || coalesce(string_agg(html, '' ORDER BY email_id, section_place, unit_place, kind_place, id, card_no) FILTER (WHERE list = '{n}'), '<p class=\"sub\">No items in this section.</p>')" for n, h in T.LISTS.items())
    rank = "CASE kind " + " ".join(f"WHEN '{k}' THEN {r}" for k, (r, _) in O.KINDS.items()) + " ELSE 99 END"
    shown = f"""lt AS {_TOPLOG}, dg AS (SELECT DISTINCT email_id FROM lt WHERE kind = 'ainews_radar_digest' AND email_section_id IS NULL), k AS (SELECT DISTINCT email_id, content_unit_key FROM lt WHERE kind = 'classifier' AND content_unit_key IS NOT NULL),
        pr AS (SELECT email_id, arg_max(content_unit_key, id) AS pu FROM lt WHERE kind = 'classifier' AND content_unit_key IS NOT NULL AND coalesce(json_extract_string(j, '$.routing_source') = 'sender_profile', false) GROUP BY 1),
        t AS (SELECT o.*, s.heading AS section_heading, coalesce(s.order_index, {O.LAST}) AS section_place, coalesce(o.content_unit_key, '') AS unit_place, {rank} AS kind_place FROM lt o LEFT JOIN email_sections s ON s.id = o.email_section_id LEFT JOIN pr ON pr.email_id = o.email_id
            WHERE (o.email_section_id IS NOT NULL OR o.content_unit_key IS NOT NULL) AND o.email_id NOT IN (SELECT email_id FROM dg) AND (o.content_unit_key IS NULL OR EXISTS (SELECT 1 FROM k WHERE k.email_id = o.email_id AND k.content_unit_key = o.content_unit_key)) AND (o.content_unit_key IS NULL OR pu IS NULL OR pu = o.content_unit_key))"""
    labels = f"SELECT id AS email_id, CASE WHEN coalesce(subject, '') <> '' THEN subject ELSE 'Email #' || id END AS subject, nullif({SQL.strip('sender')}, '') AS sender FROM emails"
    return f"""WITH {SQL.peeled()}, {shown}, x AS ({rows}), h AS (SELECT x.*, {html} AS html FROM x JOIN ({labels}) b USING (email_id)), d AS (SELECT DISTINCT digest_id, email_id FROM digest_emails),
        p AS (SELECT digest_id, '<html><body><h1>Daily digest</h1>' || {lists} || '</body></html>' AS page FROM h JOIN d USING (email_id) GROUP BY 1)
        SELECT digest_id, md5(page) AS html_md5, length(page) AS n_chars FROM p"""


def _with_triples(build) -> str:
    """``build()`` with the parts of rows as lists of label, text and url in place of joined texts."""
    global _PART
    kept = _PART
    _PART = lambda label, text, url: f"[CAST({label} AS VARCHAR), CAST({text} AS VARCHAR), CAST({url} AS VARCHAR)]"
    try:
        return build()
    finally:
        _PART = kept


ORACLE = {
    "q_c02_unwrapped": f"WITH {SQL.peeled()} SELECT id, md5(j) AS json_md5 FROM log",
    "q_c03_errors": _errors(),
    "q_o07_technology": _shaped_sql("technology"),
    "q_o07_longform": _shaped_sql("technical_longform"),
    "q_o07_radar": _shaped_sql("radar"),
    "q_o07_leadership": _shaped_sql("leadership"),
    "q_o07_essay": _shaped_sql("leadership_essay"),
    "q_o07_courses": _shaped_sql("courses", "noise"),
    "q_o07_cards": _shaped_sql("ainews_radar_digest"),
    "q_k01_pages": _with_triples(_pages_sql),
    "q_c08_repair": f"WITH {_WORK}, {_REPAIR}, o AS (SELECT id, kind, email_section_id, coalesce({_X('original_url')}, json_extract_string(j, '$.stories[0].article_url')) AS found FROM log WHERE kind IN ('technology', 'technical_longform') AND j IS NOT NULL AND email_section_id IS NOT NULL) SELECT o.id, o.kind, found, CASE WHEN o.kind = 'technology' THEN {_FIXED} ELSE {_SINGLE} END AS url FROM o JOIN rep ON rep.id = o.email_section_id",
    "q_c10_dispatch": f"WITH {_WORK}, y AS (SELECT id, category, {_KIND} AS kind, {_PROMPT} AS prompt, {_CAND} AS cand FROM work) SELECT id, category, kind, md5(prompt) AS prompt_md5, len(cand) AS n_candidates, md5(array_to_string(cand, chr(10))) AS candidates_md5 FROM y",
    "q_c07_processed": f"""WITH {_WORK}, {_REPAIR}, y AS (SELECT *, {_KIND} AS kind, md5({_PROMPT}) AS h, {_CAND} AS cand FROM rep WHERE {_KIND} IS NOT NULL AND id NOT IN (SELECT email_section_id FROM agent_outputs WHERE kind IN ('technology', 'radar', 'leadership', 'courses') AND email_section_id IS NOT NULL)),
        z AS (SELECT *, 'https://a.example/' || h[:2] AS found FROM y), f AS (SELECT *, CASE WHEN kind = 'technology' THEN {_FIXED} ELSE found END AS url FROM z)
        SELECT id, kind, 't' || h[:4] AS title, url AS original_url, CASE kind WHEN 'technology' THEN CASE WHEN NOT list_contains(cand, url) THEN 'original_url:not_allowed' END WHEN 'radar' THEN NULL ELSE CASE WHEN h[2] >= '8' THEN 'empty' END END AS error, CASE WHEN h[1] IN ('0', '1', '2') THEN 2 ELSE 1 END AS attempts FROM f""",
    "q_c11_router_prompts": f"""WITH {_WORK}, pl AS (SELECT * EXCLUDE l, {_STRIPPED('page_links')} AS l FROM work), q AS (SELECT * EXCLUDE l, {SQL.DISTINCT} AS pu FROM pl), v AS (SELECT *, {_LEAD('oh', 'pu')} AS ps FROM q)
        SELECT id, md5(concat_ws({_NL}, 'Email subject (optional): ' || {_BARE('subject')}, 'Section heading: ' || {_BARE('heading')}, {_SLICE})) AS router_md5, md5(concat_ws({_NL}, 'Subject: ' || nullif(subject, ''), 'Plain text:' || chr(10) || coalesce(text, ''))) AS newsletter_md5,
            md5(concat_ws({_NL}, 'Subject: ' || nullif(subject, ''), CASE WHEN starts_with(oh, 'https://') THEN 'Original URL (hint): ' || oh END, 'Links:' || chr(10) || {_NUM('ps')}, 'Plain text:' || chr(10) || coalesce(text, ''))) AS page_md5 FROM v""",
    "q_c11_unit_prompts": f"""WITH {_WORK} SELECT id, md5(concat_ws({_NL}, 'Email subject (optional): ' || {_BARE('subject')}, 'Content unit title: ' || {_BARE('heading')}, 'Section headings in this unit:' || chr(10) || concat_ws(chr(10), '- ' || nullif(heading, ''), '- More'), 'Candidate HTTPS links:' || chr(10) || {_NUM('hl1')}, 'Content unit plain text:' || chr(10) || coalesce(text, ''))) AS prompt_md5 FROM work""",
}
