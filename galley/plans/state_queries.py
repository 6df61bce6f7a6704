"""Queries over the state tables: upsert, log, latest per key, cascades, lookups, composition."""

from __future__ import annotations

from pyspark.sql import functions as F

from galley.functions import rules
from galley.functions.predicates import confidence_band, unwrapped
from galley.operators import compose as O
from galley.operators import scorer as C
from galley.operators import state as R
from galley.operators.sections import content_hash_builtin
from galley.plans import sql as SQL
from galley.session import table
from galley.sources import mail as S

SPECS = ["team@brabedell-notes.example", "@letter.example", "@post.example", "@brafemet-post.example"]
NOW = "2025-01-01T00:00:00Z"


def _log(spark, root):
    return table(spark, root, "agent_outputs")


def _sections(spark, root):
    return table(spark, root, "email_sections")


def s01_recent(spark, root):
    e = table(spark, root, "emails")
    taken = e.groupBy("message_id").agg(F.min("created_at").alias("taken_at"))
    m = table(spark, root, "messages").join(taken, "message_id")
    x = S.recent(m, SPECS, "taken_at", F.lit(NOW).cast("timestamp"), 365, ["digest-done"])
    return x.select("message_id", "sender").distinct()


def s03_listing(spark, root):
    """All pages of the listing: page number and message id."""
    return S.pages(table(spark, root, "messages"), 100)


def k03_missing_labels(spark, root):
    m = table(spark, root, "messages")
    wanted = m.select(F.explode("label_ids").alias("label"))
    existing = wanted.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * 2 >= m.select(F.count(F.lit(1))).scalar())
    return S.missing_labels(wanted, existing)


def k04_label_actions(spark, root):
    e = table(spark, root, "emails")
    none = F.array().cast("array<string>")
    done = F.when(F.col("status") == "archived", F.array(F.lit("digest-done"))).when(F.col("status") == "failed", F.array(F.lit("digest-error"))).otherwise(none)
    gone = F.when(F.col("status") == "archived", F.array(F.lit("INBOX"))).otherwise(none)
    return S.label_actions(e, done, gone).select("message_id", F.array_join("add", ",").alias("add"), F.array_join("remove", ",").alias("remove"))


def r01_upsert(spark, root):
    x = R.upsert_emails(table(spark, root, "emails"), table(spark, root, "messages"), F.lit(NOW).cast("timestamp"))
    return x.select("id", "message_id", "subject", "sender", "status", "retry_count", "error_message", "received_at")


def r02_append(spark, root):
    log, s = _log(spark, root), _sections(spark, root)
    # with faults: every second row names the next email, every third a category of its own
    rows = log.where("kind = 'router'").withColumns({"email_id": F.col("email_id") + F.when(F.col("id") % 2 == 0, 1).otherwise(0), "category": F.when(F.col("id") % 3 == 0, "RADAR").otherwise(F.col("category"))})
    after, refused = R.append_checked(log, rows, s)
    a = after.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("n_ids"), F.max("id").alias("max_id")).withColumn("part", F.lit("log"))
    b = refused.agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("n_ids"), F.lit(0).cast("long").alias("max_id")).withColumn("part", F.lit("refused"))
    return a.unionByName(b)


def r03_replace(spark, root):
    """Sections parsed again: those without a heading are gone, and stale or missing hashes are right now."""
    s = _sections(spark, root)
    parsed = s.where("heading is not null").withColumn("content_hash", content_hash_builtin(F.col("text"), F.col("links")))
    x = R.replace_sections(s, parsed)
    return x.groupBy("email_id", "change").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("n_ids"))


def r04_cascade(spark, root):
    x = R.cascade(_log(spark, root), _sections(spark, root).where("content_hash <> ''"))
    return x.select("id", "email_id", "email_section_id", "kind")


def r06_latest_by_section(spark, root):
    return R.latest(_log(spark, root).where("email_section_id is not null"), ["email_id", "email_section_id", "kind"]).select("id", "email_id", "email_section_id", "kind", "category")


def r07_latest_by_unit(spark, root):
    return R.latest(_log(spark, root).where("content_unit_key is not null"), ["email_id", "content_unit_key", "kind"]).select("id", "email_id", "content_unit_key", "kind", "category")


def r08_latest(spark, root):
    x = R.latest_outputs(_log(spark, root), _sections(spark, root))
    return x.select("id", "email_id", "email_section_id", "content_unit_key", "kind", "section_key", "section_order", "section_heading")


def r09_delete(spark, root):
    gone = (F.col("kind") == "classifier") & (F.col("content_unit_key") != "u0")
    return R.without(_log(spark, root), gone).select("id", "email_id", "content_unit_key", "kind")


def r10_profile_cache(spark, root):
    log = _log(spark, root)
    top = R.latest(log.where("kind = 'classifier'"), ["email_id", "content_unit_key"])
    profile = top.where(F.get_json_object(unwrapped(F.col("payload")), "$.routing_source") == "sender_profile")
    done = log.where("kind in ('technology', 'leadership', 'technical_longform')").select("email_id", "content_unit_key").distinct()
    return profile.where("content_unit_key is not null").join(done, ["email_id", "content_unit_key"], "left_semi").select("email_id", "content_unit_key")


def r13_complete(spark, root):
    return R.complete_emails(_log(spark, root), _sections(spark, root), "router", F.col("kind").isin(*O.KINDS))


def r14_categories(spark, root):
    return R.category_sets(_log(spark, root), _sections(spark, root).select("id", "email_id"))


def r17_attach(spark, root):
    p = table(spark, root, "digest_emails")
    return R.attach(p, p.select((F.col("digest_id") + 1).alias("digest_id"), "email_id"))


def r18_status(spark, root):
    e = table(spark, root, "emails")
    late = F.col("received_at").isNull()
    c = e.where(late | F.col("sender").isNull()).select("id", F.lit("failed").alias("status"), F.when(late, "no time").alias("error_message"), late.alias("retry"))
    return R.with_status(e, c, F.lit(NOW).cast("timestamp")).select("id", "status", "error_message", "retry_count")


def r19_candidates(spark, root):
    return R.candidates(table(spark, root, "emails"), table(spark, root, "digest_emails"), 3)


def r20_newest(spark, root):
    return R.newest_in_day(table(spark, root, "digests")).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "id", "status")


def r23_lookup(spark, root):
    return O.labels(table(spark, root, "emails"))


def r24_card_caps(spark, root):
    top = R.latest(_log(spark, root).where("kind in ('technology', 'leadership', 'technical_longform')"), ["email_id", "email_section_id", "content_unit_key", "kind"])
    return top.groupBy("email_id", "kind").agg(F.count(F.lit(1)).alias("n")).where("n > 1")






def c11_prompts(spark, root):
    s = _sections(spark, root).join(O.labels(table(spark, root, "emails")).select("email_id", "subject"), "email_id")
    p = C.prompt_text(F.col("subject"), F.col("heading"), F.col("text"), F.col("links"))
    return s.select(F.col("id").alias("section_id"), F.md5(p).alias("prompt_md5"), F.length(p).cast("long").alias("n_chars"))


def c01_scored(spark, root):
    """Residual sections scored by a deterministic scorer that answers wrongly at first for a part of them."""
    import hashlib
    import json

    def scorer(prompt: str, attempt: int, error: str | None) -> str:
        h = hashlib.md5(prompt.encode("utf-8", "replace")).digest()
        if attempt == 1 and h[0] % 5 == 0:
            return "not json"
        body = json.dumps({"category": ("TECHNOLOGY", "RADAR", "LEADERSHIP", "COURSES")[h[1] % 4], "confidence": round(h[2] / 255, 2)})
        return f"```json\n{body}\n```" if h[3] % 2 else body

    def check(value: dict) -> list[str]:
        return [] if value.get("category") in ("TECHNOLOGY", "RADAR", "LEADERSHIP", "COURSES") and 0 <= value.get("confidence", -1) <= 1 else ["bad answer"]

    s = _sections(spark, root).select("id", "text")
    cached = _log(spark, root).where("kind = 'router' and email_section_id is not null").select(F.col("email_section_id").alias("id"))
    x = C.scored(C.residual(s, cached, ["id"]), "id", "text", scorer, check)
    got = F.from_json("value", "struct<category:string,confidence:double>")
    return x.select(F.col("id").alias("section_id"), got["category"].alias("category"), confidence_band(got["confidence"]).alias("band"), "attempts", "error")


def d20_bands(spark, root):
    x = _log(spark, root).where("kind in ('classifier', 'router')").select("id", F.try_to_number(F.get_json_object(unwrapped(F.col("payload")), "$.confidence"), F.lit("9.99")).cast("double").alias("c"))
    return x.where("c is not null").select("id", confidence_band(F.col("c")).alias("band"))


def _facts(spark, root):
    schema = "struct<cards:array<struct<facts:array<struct<entity:string,fact:string,importance_score:string>>>>>"
    x = _log(spark, root).where("kind = 'ainews_radar_digest'").select("id", F.from_json(unwrapped(F.col("payload")), schema)["cards"].alias("cards"))
    f = x.select("id", F.posexplode(F.flatten(F.transform("cards", lambda c: F.coalesce(c["facts"], F.array().cast("array<struct<entity:string,fact:string,importance_score:string>>"))))).alias("place", "f"))
    return f.select("id", "place", "f.entity", "f.fact", F.coalesce(F.try_to_number("f.importance_score", F.lit("9")).cast("int"), F.lit(3)).alias("importance"))


def c13_facts(spark, root):
    return O.ranked_facts(_facts(spark, root), "id", 3).select("id", "place", "entity", "importance", "rank")


def c14_fallback(spark, root):
    facts = _facts(spark, root)
    return O.fallback_facts(facts, "id", O.ranked_facts(facts, "id", noise="(?i)a"), 2).select("id", "place", "entity", "importance", "rank")


def c15_cards(spark, root):
    return O.kept_cards(O.cards(_log(spark, root))).select("id", "card_no", "role", "title")


def o03_shown(spark, root):
    x = O.shown_rows(R.latest_outputs(_log(spark, root), _sections(spark, root)))
    return O.display_order(x).select("id", "email_id", "kind", "section_place", "unit_place", "kind_place")


def o04_warnings(spark, root):
    return O.warnings(R.latest_outputs(_log(spark, root), _sections(spark, root)))




def o08_card_split(spark, root):
    return O.cards(_log(spark, root)).groupBy("id").agg(F.sum((F.col("role") == "top_story").cast("long")).alias("n_top"), F.sum((F.col("role") == "recap").cast("long")).alias("n_recap"))




QUERIES = {f"q_{f.__name__}": f for f in (s01_recent, s03_listing, k03_missing_labels, k04_label_actions, r01_upsert, r02_append, r03_replace, r04_cascade, r06_latest_by_section, r07_latest_by_unit, r08_latest, r09_delete, r10_profile_cache, r13_complete, r14_categories, r17_attach, r18_status, r19_candidates, r20_newest, r23_lookup, r24_card_caps, c01_scored, c11_prompts, d20_bands, c13_facts, c14_fallback, c15_cards, o03_shown, o04_warnings, o08_card_split)}

# --- the same in SQL -------------------------------------------------------------------------------------

_LATEST = "(SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY {1} ORDER BY id DESC) AS r FROM agent_outputs WHERE {0}) WHERE r = 1)"
_TOP = _LATEST.format("true", "email_id, email_section_id, content_unit_key, kind")
_ADDRESS = r"coalesce(nullif(regexp_extract(lower(sender), '<\s*([^<>\s]+@[^<>\s]+)\s*>', 1), ''), nullif(regexp_extract(lower(sender), '([^\s<>\"''(),;:]+@[^\s<>\"''(),;:]+)', 1), ''))"
_TOPLOG = _TOP.replace("FROM agent_outputs", "FROM log")
_KINDS = ", ".join(f"'{k}'" for k in O.KINDS)
_RANK = "CASE kind " + " ".join(f"WHEN '{k}' THEN {r}" for k, (r, _) in O.KINDS.items()) + " ELSE 99 END"
_OF = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{c}'" for k, (_, c) in O.KINDS.items()) + " END"
_CAT = "CASE WHEN category IN ('EVERY_BUNDLE', 'MULTI_BUNDLE') THEN 'TECHNOLOGY' WHEN category = 'NOISE' THEN 'COURSES' ELSE category END"
_LABELS = r"SELECT id AS email_id, CASE WHEN coalesce(subject, '') <> '' THEN subject ELSE 'Email #' || id END AS subject, nullif(regexp_replace(sender, '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g'), '') AS sender FROM emails"

_FACTS = """fl AS (SELECT id, flatten(list_transform(CASE WHEN json_type(j, '$.cards') = 'ARRAY' THEN json_extract(j, '$.cards[*]') ELSE [] END, lambda c: CASE WHEN json_type(c, '$.facts') = 'ARRAY' THEN json_extract(c, '$.facts[*]') ELSE [] END)) AS l FROM log WHERE kind = 'ainews_radar_digest' AND j IS NOT NULL),
    fx AS (SELECT id, unnest(l) AS v, (generate_subscripts(l, 1) - 1)::INT AS place FROM fl), facts AS (SELECT id, place, json_extract_string(v, '$.entity') AS entity, json_extract_string(v, '$.fact') AS fact, coalesce(TRY_CAST(json_extract_string(v, '$.importance_score') AS INT), 3) AS importance FROM fx)"""

ORACLE = {
    "q_k03_missing_labels": "SELECT DISTINCT l AS label FROM (SELECT unnest(label_ids) AS l FROM messages) WHERE l NOT IN (SELECT l FROM (SELECT unnest(label_ids) AS l FROM messages) GROUP BY 1 HAVING count(*) * 2 >= (SELECT count(*) FROM messages))",
    "q_k04_label_actions": "SELECT message_id, CASE status WHEN 'archived' THEN 'digest-done' WHEN 'failed' THEN 'digest-error' ELSE '' END AS \"add\", CASE status WHEN 'archived' THEN 'INBOX' ELSE '' END AS remove FROM emails WHERE status IN ('archived', 'failed')",
    "q_s01_recent": f"""WITH t AS (SELECT message_id, min(created_at) AS taken_at FROM emails GROUP BY 1), m AS (SELECT m.*, {_ADDRESS} AS a, split_part({_ADDRESS}, '@', -1) AS dom FROM messages m JOIN t USING (message_id) WHERE taken_at > TIMESTAMPTZ '2025-01-01 00:00:00+00' - INTERVAL 365 DAY)
        SELECT DISTINCT message_id, sender FROM m WHERE (a = 'team@brabedell-notes.example' OR contains(dom, 'letter.example') OR contains(dom, 'post.example') OR contains(dom, 'brafemet-post.example')) AND NOT list_contains(coalesce(label_ids, []), 'digest-done')""",
    "q_s03_listing": "SELECT (row_number() OVER (ORDER BY message_id) - 1) // 100 AS page, message_id FROM (SELECT DISTINCT message_id FROM messages WHERE message_id IS NOT NULL AND NOT list_has_any(coalesce(label_ids, []), ['SPAM', 'TRASH']))",
    "q_r01_upsert": """WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY len(coalesce(label_ids, [])) DESC, coalesce(thread_id, '') DESC, coalesce(subject, '') DESC, coalesce(sender, '') DESC, coalesce(snippet, '') DESC, coalesce(received_at, '') DESC) AS r FROM messages WHERE message_id IS NOT NULL),
            one AS (SELECT * FROM ranked WHERE r = 1), b AS (SELECT e.id, coalesce(e.message_id, i.message_id) AS message_id, i.message_id IS NOT NULL AS hit, e.subject AS es, i.subject AS isb, e.sender AS esd, i.sender AS isd, e.status, e.retry_count, e.error_message, e.received_at AS er, i.received_at AS ir FROM emails e FULL JOIN one i ON e.message_id = i.message_id),
            n AS (SELECT message_id, row_number() OVER (ORDER BY substr(md5(message_id), 1, 2), message_id) + (SELECT max(id) FROM emails) AS nid FROM b WHERE id IS NULL)
        SELECT coalesce(b.id, n.nid) AS id, b.message_id, CASE WHEN hit THEN isb ELSE es END AS subject, CASE WHEN hit THEN isd ELSE esd END AS sender, CASE WHEN hit THEN 'pending' ELSE status END AS status, CASE WHEN hit THEN 0 ELSE retry_count END AS retry_count,
            CASE WHEN hit THEN NULL ELSE error_message END AS error_message, CASE WHEN hit THEN coalesce(ir, er) ELSE er END AS received_at FROM b LEFT JOIN n USING (message_id)""",
    "q_r02_append": f"""WITH {SQL.peeled()}, rows AS (SELECT CASE WHEN id % 2 = 0 THEN email_id + 1 ELSE email_id END AS email_id, email_section_id, CASE WHEN id % 3 = 0 THEN 'RADAR' ELSE category END AS category, json_extract_string(j, '$.category') AS named FROM log WHERE kind = 'router'),
            c AS (SELECT coalesce((r.email_section_id IS NULL OR s.email_id = r.email_id) AND named IS NOT NULL AND coalesce(category = named, true), false) AS fine FROM rows r LEFT JOIN email_sections s ON s.id = r.email_section_id)
        SELECT 'log' AS part, (SELECT count(*) FROM agent_outputs) + (SELECT count(*) FROM c WHERE fine) AS n, (SELECT count(*) FROM agent_outputs) + (SELECT count(*) FROM c WHERE fine) AS n_ids, (SELECT max(id) FROM agent_outputs) + (SELECT count(*) FROM c WHERE fine) AS max_id
        UNION ALL SELECT 'refused', (SELECT count(*) FROM c WHERE NOT fine), 0, 0""",
    "q_r03_replace": f"""WITH parsed AS (SELECT email_id, section_key, sha256(CAST(to_json({{'links': coalesce(links, []), 'text': {SQL.truncated('text', 8000)}}}) AS VARCHAR)) AS h FROM email_sections WHERE heading IS NOT NULL),
            ch AS (SELECT p.email_id, CASE WHEN s.id IS NULL THEN 'inserted' ELSE 'kept' END AS change FROM parsed p LEFT JOIN email_sections s ON s.email_id = p.email_id AND s.section_key = p.section_key AND s.content_hash = p.h)
        SELECT email_id, change, count(*) AS n, count(*) AS n_ids FROM ch GROUP BY 1, 2 UNION ALL SELECT email_id, 'untouched', count(*), count(DISTINCT id) FROM email_sections WHERE email_id NOT IN (SELECT email_id FROM parsed) GROUP BY 1""",
    "q_r04_cascade": "SELECT id, email_id, email_section_id, kind FROM agent_outputs WHERE email_section_id IS NULL OR email_section_id IN (SELECT id FROM email_sections WHERE content_hash <> '')",
    "q_r06_latest_by_section": f"SELECT id, email_id, email_section_id, kind, category FROM {_LATEST.format('email_section_id IS NOT NULL', 'email_id, email_section_id, kind')}",
    "q_r07_latest_by_unit": f"SELECT id, email_id, content_unit_key, kind, category FROM {_LATEST.format('content_unit_key IS NOT NULL', 'email_id, content_unit_key, kind')}",
    "q_r08_latest": f"SELECT t.id, t.email_id, email_section_id, content_unit_key, kind, section_key, order_index AS section_order, heading AS section_heading FROM {_TOP} t LEFT JOIN email_sections s ON s.id = t.email_section_id",
    "q_r09_delete": "SELECT id, email_id, content_unit_key, kind FROM agent_outputs WHERE NOT coalesce(kind = 'classifier' AND content_unit_key <> 'u0', false)",
    "q_r13_complete": f"""WITH s AS (SELECT id, email_id FROM email_sections), o AS (SELECT email_section_id, bool_or(kind = 'router') AS a, bool_or(kind IN ({_KINDS})) AS b FROM agent_outputs WHERE email_section_id IS NOT NULL GROUP BY 1)
        SELECT email_id, bool_and(coalesce(a AND b, false)) AS complete FROM s LEFT JOIN o ON o.email_section_id = s.id GROUP BY 1""",
    "q_r14_categories": f"""WITH s AS (SELECT id, email_id FROM email_sections),
            t AS {_LATEST.format("kind = 'router' AND email_section_id IS NOT NULL", 'email_id, email_section_id')}
        SELECT s.email_id, CASE WHEN bool_and(category IS NOT NULL) THEN array_to_string(list_sort(list_distinct(list(category))), ',') END AS categories FROM s LEFT JOIN t ON t.email_section_id = s.id GROUP BY 1""",
    "q_r17_attach": "SELECT digest_id, email_id FROM digest_emails UNION SELECT digest_id + 1, email_id FROM digest_emails",
    "q_r18_status": "SELECT id, CASE WHEN received_at IS NULL OR sender IS NULL THEN 'failed' ELSE status END AS status, CASE WHEN received_at IS NULL THEN 'no time' ELSE error_message END AS error_message, retry_count + CASE WHEN received_at IS NULL THEN 1 ELSE 0 END AS retry_count FROM emails",
    "q_r19_candidates": "SELECT id, status, retry_count, (SELECT min(digest_id) FROM digest_emails d WHERE d.email_id = e.id) AS digest_id, CASE WHEN status = 'pending' THEN 0 ELSE 1 END AS turn FROM emails e WHERE status = 'pending' OR (status = 'failed' AND retry_count < 3)",
    "q_r20_newest": "SELECT strftime(created_at AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, id, status FROM (SELECT *, row_number() OVER (PARTITION BY strftime(created_at AT TIME ZONE 'UTC', '%Y-%m-%d') ORDER BY created_at DESC, id DESC) AS r FROM digests) WHERE r = 1",
    "q_r23_lookup": _LABELS,
    "q_r24_card_caps": f"SELECT email_id, kind, count(*) AS n FROM {_LATEST.format('''kind IN ('technology', 'leadership', 'technical_longform')''', 'email_id, email_section_id, content_unit_key, kind')} GROUP BY 1, 2 HAVING count(*) > 1",
    "q_c11_prompts": f"""WITH l AS ({_LABELS}), p AS (SELECT s.id AS section_id, concat_ws(chr(10) || chr(10), 'Subject: ' || l.subject, 'Heading: ' || nullif(heading, ''), CASE WHEN len(links) > 0 THEN 'Links:' || chr(10) || array_to_string(list_transform(links, lambda u, i: i || '. ' || u), chr(10)) END, 'Text: ' || nullif(text, '')) AS t FROM email_sections s JOIN l USING (email_id))
        SELECT section_id, md5(t) AS prompt_md5, length(t) AS n_chars FROM p""",
    "q_o03_shown": f"""WITH {SQL.peeled()}, t AS {_TOPLOG}, dg AS (SELECT DISTINCT email_id FROM t WHERE kind = 'ainews_radar_digest' AND email_section_id IS NULL), k AS (SELECT DISTINCT email_id, content_unit_key FROM t WHERE kind = 'classifier' AND content_unit_key IS NOT NULL),
            pr AS (SELECT email_id, arg_max(content_unit_key, id) AS pu FROM t WHERE kind = 'classifier' AND content_unit_key IS NOT NULL AND coalesce(json_extract_string(j, '$.routing_source') = 'sender_profile', false) GROUP BY 1)
        SELECT t.id, t.email_id, t.kind, coalesce(s.order_index, {O.LAST}) AS section_place, coalesce(t.content_unit_key, '') AS unit_place, {_RANK} AS kind_place FROM t LEFT JOIN email_sections s ON s.id = t.email_section_id LEFT JOIN pr ON pr.email_id = t.email_id
        WHERE kind IN ({_KINDS}) AND (t.email_section_id IS NOT NULL OR t.content_unit_key IS NOT NULL) AND t.email_id NOT IN (SELECT email_id FROM dg) AND (t.content_unit_key IS NULL OR EXISTS (SELECT 1 FROM k WHERE k.email_id = t.email_id AND k.content_unit_key = t.content_unit_key))
            AND (t.content_unit_key IS NULL OR pu IS NULL OR pu = t.content_unit_key)""",
    "q_o04_warnings": f"""WITH t AS {_TOP}, x AS (SELECT *, {_CAT} AS cat FROM t WHERE kind IN ({_KINDS})), k AS (SELECT DISTINCT email_id, content_unit_key FROM t WHERE kind = 'classifier' AND content_unit_key IS NOT NULL)
        SELECT id, email_id, kind, 'legacy_email_level_processor' AS warning FROM x WHERE email_section_id IS NULL AND content_unit_key IS NULL AND kind <> 'ainews_radar_digest'
        UNION ALL SELECT id, email_id, kind, 'unit_processor_without_classifier' FROM x WHERE content_unit_key IS NOT NULL AND NOT EXISTS (SELECT 1 FROM k WHERE k.email_id = x.email_id AND k.content_unit_key = x.content_unit_key)
        UNION ALL SELECT id, email_id, kind, CASE WHEN coalesce(cat, '') NOT IN ('TECHNOLOGY', 'RADAR', 'LEADERSHIP', 'COURSES') THEN 'invalid_category' ELSE 'category_kind_mismatch' END FROM x WHERE coalesce(cat, '') NOT IN ('TECHNOLOGY', 'RADAR', 'LEADERSHIP', 'COURSES') OR cat <> {_OF}""",
    "q_c01_scored": """WITH x AS (SELECT id, md5(text) AS h FROM email_sections WHERE text IS NOT NULL AND id NOT IN (SELECT email_section_id FROM agent_outputs WHERE kind = 'router' AND email_section_id IS NOT NULL)),
            y AS (SELECT id, CAST('0x' || h[1:2] AS INT) AS a, CAST('0x' || h[3:4] AS INT) AS b, round(CAST('0x' || h[5:6] AS INT) / 255.0, 2) AS c FROM x)
        SELECT id AS section_id, ['TECHNOLOGY', 'RADAR', 'LEADERSHIP', 'COURSES'][b % 4 + 1] AS category, CASE WHEN c < 0.55 THEN 'fail' WHEN c < 0.75 THEN 'warn' ELSE 'process' END AS band, CASE WHEN a % 5 = 0 THEN 2 ELSE 1 END AS attempts, CAST(NULL AS VARCHAR) AS error FROM y""",
    "q_c13_facts": f"""WITH {SQL.peeled()}, {_FACTS}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY importance DESC, entity NULLS FIRST, place) AS rank FROM facts WHERE importance > 2 AND NOT regexp_matches(concat_ws(' ', coalesce(entity, ''), coalesce(fact, '')), {SQL.q(rules.FACT_NOISE_PATTERN)}))
        SELECT id, place, entity, importance, rank::INT AS rank FROM r WHERE rank <= 3""",
    "q_c14_fallback": f"""WITH {SQL.peeled()}, {_FACTS}, kept AS (SELECT DISTINCT id FROM facts WHERE importance > 2 AND NOT regexp_matches(concat_ws(' ', coalesce(entity, ''), coalesce(fact, '')), '(?i)a')),
            r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY importance DESC, place) AS rank FROM facts WHERE id NOT IN (SELECT id FROM kept)) SELECT id, place, entity, importance, rank::INT AS rank FROM r WHERE rank <= 2""",
    "q_o08_card_split": f"""WITH {SQL.peeled()}, i AS (SELECT id, CASE WHEN json_type(j, '$.cards') = 'ARRAY' THEN json_extract(j, '$.cards[*]') ELSE [] END AS l FROM log WHERE kind = 'ainews_radar_digest' AND j IS NOT NULL),
            x AS (SELECT id, json_extract_string(unnest(l), '$.role') AS role FROM i) SELECT id, sum((role = 'top_story')::INT)::BIGINT AS n_top, sum((role = 'recap')::INT)::BIGINT AS n_recap FROM x GROUP BY 1""",
    "q_c15_cards": f"""WITH {SQL.peeled()}, i AS (SELECT id, CASE WHEN json_type(j, '$.cards') = 'ARRAY' THEN json_extract(j, '$.cards[*]') ELSE [] END AS l FROM log WHERE kind = 'ainews_radar_digest' AND j IS NOT NULL),
            x AS (SELECT id, unnest(l) AS v, (generate_subscripts(l, 1) - 1)::INT AS card_no FROM i), y AS (SELECT id, card_no, json_extract_string(v, '$.role') AS r, json_extract_string(v, '$.title') AS title FROM x),
            z AS (SELECT *, CASE WHEN r = 'top_story' AND sum((r = 'top_story')::INT) OVER w = 1 THEN 'top_story' ELSE 'recap' END AS role FROM y WINDOW w AS (PARTITION BY id ORDER BY card_no)),
            q AS (SELECT *, sum((role = 'recap')::INT) OVER (PARTITION BY id ORDER BY card_no) AS rr FROM z), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY card_no) AS n FROM q WHERE role = 'top_story' OR rr <= 2)
        SELECT id, card_no, role, title FROM k WHERE n <= 3""",
    "q_r10_profile_cache": f"""WITH {SQL.peeled()}, q AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY email_id, content_unit_key ORDER BY id DESC) AS r FROM log WHERE kind = 'classifier') WHERE r = 1)
        SELECT email_id, content_unit_key FROM q WHERE content_unit_key IS NOT NULL AND json_extract_string(j, '$.routing_source') = 'sender_profile'
            AND EXISTS (SELECT 1 FROM agent_outputs o WHERE o.email_id = q.email_id AND o.content_unit_key = q.content_unit_key AND o.kind IN ('technology', 'leadership', 'technical_longform'))""",
    "q_d20_bands": f"WITH {SQL.peeled()} SELECT id, CASE WHEN c < 0.55 THEN 'fail' WHEN c < 0.75 THEN 'warn' ELSE 'process' END AS band FROM (SELECT id, TRY_CAST(json_extract_string(j, '$.confidence') AS DOUBLE) AS c FROM log WHERE kind IN ('classifier', 'router') AND j IS NOT NULL) WHERE c IS NOT NULL",
}
