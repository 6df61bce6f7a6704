"""Typed outputs, processors, proposals and plans on small fixtures."""

import base64
import email
import json

import pytest
from pyspark.sql import functions as F

from galley.functions.predicates import is_unsubscribe, unwrapped, warned
from galley.operators import delivery as D
from galley.operators import grouping as G
from galley.operators import outputs as T
from galley.operators import processors as P
from galley.operators import routing as R2
from galley.operators import sections as N
from galley.operators import state as R
from galley.sources import mail as S

LOG = "id long, email_id long, kind string, category string, payload string"


def test_unwrapped(spark):
    fence = "`" * 3
    twice = json.dumps(json.dumps({"a": 1}))
    cases = [(" {\"a\": 1}\n", '{"a": 1}'), (f"{fence}json\n{{\"a\": 1}}\n{fence}", '{"a": 1}'), (f"{fence}json{{}}{fence}", "{}"), (twice, '{"a": 1}'), (json.dumps(f"{fence}\n[1]\n{fence}"), "[1]"), ("﻿{}", "{}"), ('"open', '"open'), (None, None), ("", ""), ("x", "x")]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "id long, p string")
    got = {r.id: r.u for r in df.select("id", unwrapped(F.col("p")).alias("u")).collect()}
    assert got == {i: w for i, (_, w) in enumerate(cases)}


def test_errors_of_each_kind(spark):
    long = "x" * 501
    cases = [
        ("technology", {"title": "t", "core_pain_point": "p", "original_url": " "}, ""),
        ("technology", {"title": long, "original_url": "http://a"}, "title:too_long,core_pain_point:missing,original_url:not_https"),
        ("technology", {"title": "t", "core_pain_point": "p", "original_url": "https://b"}, "original_url:not_allowed"),
        ("radar", {"items": {"entity": "e", "impact_or_action": "i"}}, ""),
        ("radar", {"items": [{"entity": "e"}, None]}, "items:missing_field"),
        ("leadership", {"signals": [], "summary": " "}, "empty"),
        ("leadership", {"signals": [{"theme": "t", "insight": "i", "actionable_item": "a", "link": "https://b"}]}, "signals:not_allowed"),
        ("noise", {"reason": " a\n b "}, ""),
        ("courses", {"summary": "", "actions": [{"label": "l", "url": "http://a"}]}, "url:not_https,url:not_allowed"),
        ("courses", {}, "empty"),
        ("leadership_essay", {"title": "t", "core_thesis": "c", "notable_examples": ["x"], "original_url": "https://a"}, ""),
        ("leadership_essay", {"title": "t", "core_thesis": "c"}, "empty"),
        ("technical_longform", {"title": "t", "central_topic": "c", "format": "poem", "practical_takeaways": ["x"]}, "format:invalid"),
        ("ainews_radar_digest", {"cards": [{"role": "top_story", "title": "t", "tldr": "d"}] * 2}, "top_story:too_many"),
        ("ainews_radar_digest", {"cards": [{"title": "t", "tldr": "d", "key_points": ["k"] * 8}] * 4}, "key_points:too_many,cards:too_many"),
        ("router", {"category": "NOISE", "confidence": 0.5}, ""),
        ("router", {"category": "X", "confidence": 2}, "category:invalid,confidence:invalid"),
    ]
    rows = [(i, 1, k, None, json.dumps(p)) for i, (k, p, _) in enumerate(cases)] + [(90, 1, "radar", None, "not json"), (91, 1, "radar", None, None), (92, 1, "other", None, "{}")]
    log = T.with_json(spark.createDataFrame(rows, LOG))
    got = {r.id: ",".join(r.errors) for r in T.validated(log, F.array(F.lit("https://a"))).collect()}
    assert got == {**{i: w for i, (_, _, w) in enumerate(cases)}, 90: "payload:unreadable", 91: "payload:unreadable"}


def test_rows_and_page(spark):
    fence = "`" * 3
    rows = [
        (1, 1, "technology", "TECHNOLOGY", json.dumps({"title": "a<b", "core_pain_point": "p", "original_url": "https://a", "diagrams": [{"title": "d", "diagram_type": "ascii", "content": "+"}]})),
        (2, 1, "radar", "RADAR", f"{fence}json\n" + json.dumps({"items": [{"entity": "e", "impact_or_action": "i", "url": None}]}) + f"\n{fence}"),
        (3, 1, "ainews_radar_digest", "RADAR", json.dumps({"cards": [{"role": "top_story", "title": "t", "tldr": "d", "key_points": list("abcdefg")}, {"title": "u", "tldr": "v"}]})),
        (4, 1, "noise", "NOISE", json.dumps({"reason": "r"})),
        (5, 1, "radar", "TECHNOLOGY", json.dumps({"items": []})),  # category and kind do not fit
        (6, 1, "radar", "RADAR", "{broken"),
    ]
    x = T.shaped(T.with_json(spark.createDataFrame(rows, LOG)))
    got = {(r.id, r.card_no): r for r in x.collect()}
    assert {k: r.list for k, r in got.items()} == {(1, 0): "technical_index", (2, 0): "ai_radar", (3, 0): "ai_radar_top_story", (3, 1): "ai_radar_recap", (4, 0): "courses"}
    assert len(got[3, 0].parts) == 5 and got[4, 0].body == "r" and got[2, 0].parts[0].label == "e"
    html = x.select("email_id", "list", F.struct("id", "card_no").alias("place"), T.row_html(F.lit("S&"), F.lit(None).cast("string"), F.lit("")).alias("html"))
    page = T.pages(html, "email_id", "T").first().html
    assert "a&lt;b" in page and "S&amp;" in page and page.count("No items in this section.") == 2 and "<script" not in page
    assert T.pages(html.limit(0), "email_id", "T").count() == 0


WORK = "id long, category string, subject string, heading string, text string, links array<string>, page_links array<string>, original_url string"


def test_links_and_dispatch(spark):
    rows = [
        (1, "TECHNOLOGY", "s", "h", "t", ["https://a", "https://i.example/x.png", "http://n"], ["https://b", "https://a"], "https://o"),
        (2, "RADAR", None, None, None, None, None, None),
        (3, "OTHER", "s", "h", "t", [], [], None),
        (4, "TECHNOLOGY", "s", "h", "t", ["https://one"], [], None),
    ]
    df = spark.createDataFrame(rows, WORK)
    got = {r.id: r for r in P.dispatched(df).collect()}
    assert got[1].candidates == ["https://o", "https://a", "http://n", "https://b"] and got[1].kind == "technology" and "  1. https://o\n  2. https://a" in got[1].prompt
    assert got[2].prompt == "Section plain text (this slice only):\n" and got[3].kind is None
    fixed = {r.id: r.u for r in df.select("id", P.repaired_url(F.lit("https://x"), F.col("links"), F.col("page_links"), F.col("original_url")).alias("u")).collect()}
    assert fixed == {1: "https://b", 2: "https://x", 3: "https://x", 4: "https://one"}

    def scorer(prompt, attempt, error):
        return json.dumps({"title": "t", "core_pain_point": "p", "original_url": "https://x"}) if "Candidate" in prompt else "broken"

    done = {r.id: r for r in P.processed(P.dispatched(df), "id", scorer).collect()}
    assert json.loads(done[4].value)["original_url"] == "https://one" and done[4].error is None and set(done) == {1, 2, 4}
    assert done[2].value is None and done[2].attempts == 2 and "JSON" in done[2].error


def test_boundaries(spark):
    s = spark.createDataFrame([(i, 1, f"s{i}", i, f"it's {i}" if i else None, "text\nof it", ["https://a"], []) for i in range(3)], "id long, email_id long, section_key string, order_index int, heading string, text string, links array<string>, image_urls array<string>")
    mails = spark.createDataFrame([(1, "a@b", "sub", None, ["s2"], ["why"])], "email_id long, sender string, subject string, original_url string, hard_keys array<string>, reasons array<string>")
    prompt = P.boundary_prompts(G.outline(s), G.units(s.withColumn("group_no", F.lit(0))), mails).first().prompt
    assert prompt.startswith("Email metadata:\n- Sender: a@b\n- Subject: sub\n- Hard boundary sections (do not merge across): s2\n\nStructural outline (3 sections):\n1. [s0] (no heading) — 10 chars, 1 links\n   Links: https://a\n   Snippet: 'text\\nof it'\n2. [s1] \"it's 1\"")
    assert prompt.endswith("Deterministic grouping guess:\n  - unit u0: sections ['s0', 's1', 's2']\n\nAmbiguity reasons: why")
    proposed = spark.createDataFrame([(1, 0, "s0"), (1, 0, "s2"), (1, 1, "s1"), (1, 2, None)], "email_id long, group_no int, section_key string")
    wanted = s.select("email_id", "section_key")
    errors = {(r.group_no, r.section_key, r.error) for r in G.proposal_errors(proposed, s, wanted).collect()}
    assert errors == {(2, None, "empty_unit"), (0, "s1", "non_contiguous_group"), (1, None, "overlapping_units")}
    refused = G.accepted_groups(s, proposed.where("section_key is not null"), G.proposal_errors(proposed, s, wanted))
    assert [r.group_no for r in refused.orderBy("id").collect()] == [0, 1, 2]
    good = spark.createDataFrame([(1, 4, "s0"), (1, 4, "s1"), (1, 2, "s2")], "email_id long, group_no int, section_key string")
    taken = G.accepted_groups(s, good, G.proposal_errors(good, s, wanted))
    assert [r.group_no for r in taken.orderBy("id").collect()] == [0, 0, 1]


def test_reuse_of_plans(spark):
    plans = spark.createDataFrame([(1, "technical_longform", ["s0"], "h1"), (2, "technical_longform", ["s0"], "h2"), (3, "technical_longform", ["s0"], "h3")], "email_id long, kind string, section_keys array<string>, merged_hash string")
    said = lambda h: json.dumps({"routing_source": "sender_profile", "merged_content_hash": h, "processor_kind": "technical_longform"})
    log = spark.createDataFrame([(1, 1, "u0", "classifier", said("h1")), (2, 1, "u0", "technical_longform", "{}"), (3, 2, "u0", "classifier", said("h2")), (4, 3, "u0", "classifier", said("h3")), (5, 3, "u0", "classifier", said("other")), (6, 3, "u0", "technical_longform", "{}")], "id long, email_id long, content_unit_key string, kind string, payload string")
    assert [r.email_id for r in R.reusable_plans(plans, log).collect()] == [1]


def test_lookups_and_pages(spark):
    m = spark.createDataFrame([("m1", [("From", "a"), ("SUBJECT", "x")], json.dumps({"mime": "text/plain", "data": "aGk"})), ("m2", [], None)], "message_id string, headers array<struct<name:string,value:string>>, payload string")
    ids = spark.createDataFrame([("m1",), ("m1",), ("m9",)], "message_id string")
    assert [tuple(r) for r in S.header_of(m, ids, "subject").collect()] == [("m1", "x")]
    assert [tuple(r) for r in S.body_by_id(m, ids).collect()] == [("m1", "<pre>hi</pre>")]
    rows = [(f"{i:05d}", ["INBOX"]) for i in range(25)] + [("00000", ["A"]), ("spam", ["SPAM"]), (None, []), ("zz", None)]
    x = S.pages(spark.createDataFrame(rows, "message_id string, label_ids array<string>").repartition(5), 10)
    want = sorted([f"{i:05d}" for i in range(25)] + ["zz"])
    assert sorted((r.page, r.message_id) for r in x.collect()) == [(i // 10, v) for i, v in enumerate(want)]
    assert S.pages(spark.createDataFrame([], "message_id string, label_ids array<string>"), 10).count() == 0


def test_mail_and_sending(spark):
    raw = D.encoded_mail("a@b", "c@d", "Ü", "<p>é</p>", "é")
    mail = email.message_from_bytes(base64.urlsafe_b64decode(raw))
    assert mail["To"] == "c@d" and [p.get_content_type() for p in mail.walk()] == ["multipart/alternative", "text/plain", "text/html"]
    assert [p.get_payload(decode=True).decode() for p in mail.get_payload()] == ["é", "<p>é</p>"]
    for bad in (("", "t", "s", "h"), ("f", " ", "s", "h"), ("f", "t", None, "h"), ("f", "t", "s", "")):
        with pytest.raises(ValueError):
            D.encoded_mail(*bad)
    df = spark.createDataFrame([(1, "a", "b", "s", "h"), (2, "a", "b", "s", " "), (3, "a", "b", None, "h")], "k long, f string, t string, s string, h string")
    x = df.select("k", D.raw_mail("f", "t", "s", "h").alias("raw"))

    def send(raw):
        return {"id": 7} if raw else {}

    assert [tuple(r) for r in D.sent(x, "k", send).collect()] == [(1, "7", None)]
    assert [r.error for r in D.sent(x, "k", lambda raw: {}).collect()] == ["the response has no id"]


def test_priors_warnings_and_leaving(spark):
    rows = [(1, " Trust", None, "RADAR", None), (2, "other", None, "RADAR", None), (3, None, True, "nonsense", "COURSES"), (4, "trust", None, None, " "), (5, None, None, None, None)]
    s = spark.createDataFrame(rows, "email_id long, tier string, is_trust boolean, category string, default_category string")
    assert sorted(map(tuple, R2.trusted_priors(s).collect())) == [(1, "RADAR"), (3, "COURSES")]
    w = spark.createDataFrame([(0.5, None), (0.6, None), (0.6, ["classification_low_confidence"]), (0.9, ["x"])], "c double, w array<string>")
    low = "classification_low_confidence"
    assert [r[0] for r in w.select(warned(F.col("w"), F.col("c"))).collect()] == [[], [low], [low], ["x"]]
    u = spark.createDataFrame([("mailto:x@y?subject=unsubscribe", "Unsubscribe"), ("mailto:x@y", "write us"), ("https://a.example/unsubscribe/1", "")], "u string, a string")
    assert [r[0] for r in u.select(is_unsubscribe(F.col("u"), F.col("a"))).collect()] == [True, False, True]


def test_envelopes_and_empty_chunks(spark):
    s = spark.createDataFrame([(1, "s0", 0, "h", "t", ["l"], ["i"])], "email_id long, section_key string, order_index int, heading string, text string, links array<string>, image_urls array<string>")
    m = spark.createDataFrame([(1, "x", None, None), (2, " whole ", ["https://a"], None), (3, None, None, None)], "email_id long, text string, links array<string>, image_urls array<string>")
    got = {r.email_id: (r.section_key, r.text, r.links) for r in N.with_envelopes(s, m).collect()}
    assert got == {1: ("s0", "t", ["l"]), 2: ("s0", "whole", ["https://a"]), 3: ("s0", "", [])}
    c = spark.createDataFrame([(1, 0, ["s0"], ["h"], "t")], "email_id long, chunk_index int, section_keys array<string>, headings array<string>, text string")
    assert {(r.email_id, r.text, len(r.section_keys)) for r in N.or_empty_chunk(c, m).collect()} == {(1, "t", 1), (2, "", 0), (3, "", 0)}
