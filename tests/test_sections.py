"""Section operators against plain Python."""

import hashlib
import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from galley.functions import predicates as P
from galley.functions import rules as R
from galley.operators import grouping as G
from galley.operators import sections as N

SCHEMA = "id long, email_id long, section_key string, order_index int, heading string, text string, links array<string>, image_urls array<string>, content_hash string"


def rows(spark, items, email=1):
    return spark.createDataFrame([(i, email, f"s{i}", i, h, t, ln, [], "") for i, (h, t, ln) in enumerate(items)], SCHEMA)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n", max_size=120), st.integers(1, 40))
def test_paragraph_chunks_keep_all_words(text, limit):
    chunks = N.chunk_paragraphs(text, limit)
    assert all(0 < len(c) <= limit for c in chunks)
    assert "".join("".join(chunks).split()) == "".join(text.split())


def test_paragraph_chunks_spark(spark):
    texts = ["a\n\nb", "one two three four five six", None, "", "x" * 30, "p\n\n\n\nq", "short"]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    got = {}
    for r in N.paragraph_chunks(df, "k", "t", 12).orderBy("k", "chunk_index").collect():
        got.setdefault(r.k, []).append(r.chunk)
    assert got == {i: c for i, t in enumerate(texts) if (c := N.chunk_paragraphs(t, 12))}
    assert N.paragraph_chunks(df, "k", "t", 0).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=12), st.integers(1, 6))
def test_merge_smallest(sizes, most):
    spans = N.merge_smallest(sizes, most)
    assert spans[0][0] == 0 and spans[-1][1] == len(sizes) and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False)) and len(spans) == min(most, len(sizes))


def test_merge_smallest_takes_the_first_minimum():
    assert N.merge_smallest([1, 1, 1], 2) == [(0, 2), (2, 3)]


def test_routing(spark):
    spans, texts = N.routing_spans(["a" * 400] * 12)
    assert len(spans) == 8 and sum(b - a for a, b in spans) == 12 and all(len(t) >= 300 for t in texts)
    assert N.routing_spans(["x", "y" * 400])[0] == [(0, 2)]
    assert N.routing_spans(["x"])[0] == [(0, 1)]
    df = rows(spark, [("h", "a" * 400, ["https://a"]), (None, "b", ["https://a", "https://b"]), ("z", "c" * 500, None)])
    out = N.for_routing(df).orderBy("order_index").collect()
    assert [(r.section_key, r.heading, len(r.text), r.links) for r in out] == [("s0", "h", 403, ["https://a", "https://b"]), ("s1", "z", 500, [])]
    many = rows(spark, [(f"h{i}", "t" * 400, []) for i in range(48)])
    one = N.for_routing(many).collect()
    assert len(one) == 1 and one[0].heading is None and len(one[0].text) == R.SECTION_CHARS
    assert N.for_routing(df.limit(0)).count() == 0


def test_truncate_and_hash(spark):
    texts = ["plain", "   pad\n", "é\u0001\u001f\"\\", "x" * 9000, None]
    df = spark.createDataFrame([(t, ["https://a", "https://b"]) for t in texts], "text string, links array<string>")
    got = df.select("text", N.truncated(F.col("text")).alias("cut"), N.content_hash(N.truncated(F.col("text")), F.col("links")).alias("h")).collect()
    for r in got:
        t = (r.text or "").strip()
        t = t if len(t) <= 8000 else t[:7999] + "…"
        assert r.cut == t
        assert r.h == hashlib.sha256(json.dumps({"links": ["https://a", "https://b"], "text": t}, separators=(",", ":"), ensure_ascii=False, sort_keys=True).encode()).hexdigest()


def test_packing(spark):
    df = rows(spark, [("h", "x" * n, []) for n in (10, 10, 200, 10, 10)])
    got = N.packed(df, 60).orderBy("chunk_index").collect()
    assert [r.section_keys for r in got] == [["s0", "s1"], ["s2"], ["s3", "s4"]]
    assert got[0].text == "## h\n\n" + "x" * 10 + N.SEPARATOR + "## h\n\n" + "x" * 10
    capped = N.capped(N.packed(df, 60), 2).orderBy("chunk_index").collect()
    assert [r.section_keys for r in capped] == [["s0", "s1", "s2"], ["s3", "s4"]]


def test_interrupt_roles(spark):
    items = [
        ("Story", "t" * 300, []),
        ("x", "Click to unsubscribe", []),
        ("y", "© 2024 House", []),
        ("z", "view in browser", ["https://a"]),
        ("z", "please subscribe now", []),
        ("(Sponsored) tool", "body " * 200, []),
        ("w", "a webinar for you " + "t" * 400, []),
        ("w", "a webinar and a workshop " + "t" * 400, []),
        ("w", "see", ["https://a", "https://b"]),
        (None, None, None),
    ]
    got = [r.rule for r in G.with_roles(rows(spark, [*items, ("end", "t" * 500, [])])).orderBy("id").collect()]
    assert got[:10] == ["normal_content:default", "footer:unsubscribe_phrase", "footer:copyright", "navigation:phrase_match", "subscription_cta:phrase_match", "promo:strong_heading_marker", "unknown_interrupt:single_promo_keyword", "unknown_interrupt:multi_promo_keyword", "unknown_interrupt:short_link_heavy", "normal_content:default"]
    only = G.with_roles(rows(spark, [("h", "short", ["https://a", "https://b"])])).first()
    assert only.rule == "footer:bottom_tenth_link_heavy"


def test_recap_headings(spark):
    heads = ["Recap", "AI Twitter Recap", "weekly recap", "Links", "Quick hits today", "A very long heading about many things that ends in recap", None, "Story"]
    df = spark.createDataFrame([(h,) for h in heads], "h string")
    assert [r[0] for r in df.select(P.is_recap_heading(F.col("h"))).collect()] == [True, True, True, True, True, False, False, False]


def test_groups_and_units(spark):
    promo = "register for the webinar"
    df = rows(spark, [("a", "one", ["https://x"]), ("b", "two", []), ("p", promo, []), ("c", "", ["https://x"])])
    u = {r.content_unit_key: r for r in G.units(G.final_groups(df)).collect()}
    assert [u[k].section_keys for k in ("u0", "u1", "u2")] == [["s0", "s1"], ["s2"], ["s3"]]
    assert u["u0"].unit_text == "one\n\ntwo" and u["u0"].headings == ["a", "b"] and u["u0"].links == ["https://x"] and u["u2"].unit_text == ""
    each = rows(spark, [("a", "t", [f"https://{i}"]) for i in range(4)])
    assert G.units(G.final_groups(each)).count() == 4
    d = G.grouping_decision(rows(spark, [("1. a", "t", []), ("2. b", "t", []), ("c", "t", [])])).first()
    assert d.numbered and not d.ambiguous
    d = G.grouping_decision(rows(spark, [("alpha", "t", ["https://x"]), ("beta", "t", []), ("gamma", "t", [])])).first()
    assert d.ambiguous and d.reasons == "section_count_gray_zone,mixed_heading_pattern,ambiguous_url_count"


def test_merged_hash_ignores_interrupts(spark):
    body = [("a", "first " * 50, []), ("b", "second " * 50, [])]
    with_ad = [body[0], ("(sponsored)", "ad", []), body[1]]
    h = lambda items: G.merged_hash(rows(spark, items).withColumn("content_hash", F.md5("text"))).first().merged_hash
    assert h(body) == h(with_ad) != h(body[::-1])


def test_profile_evidence(spark):
    x = G.profile_merge(rows(spark, [("a", "short", []), ("(sponsored)", "y" * 900, [])])).first()
    assert x.counter_evidence == "empty_body" and x.hidden_keys == ["s1"]
    x = G.profile_merge(rows(spark, [("a", "z" * 300, []), ("(sponsored)", "y" * 900, [])])).first()
    assert x.counter_evidence == "promo_dominated"
    x = G.profile_merge(rows(spark, [("a", "z" * 300, []), ("(sponsored)", "y" * 300, [])])).first()
    assert x.counter_evidence is None


def test_proposals(spark):
    s = rows(spark, [("a", "one", []), ("p", "register for the webinar", []), ("b", "two", []), ("c", "three", [])])
    p = spark.createDataFrame([(1, 0, "s0"), (1, 0, "s2"), (1, 1, "s2"), (1, 1, "zz")], "email_id long, group_no int, section_key string")
    assert [(r.section_key, r.error) for r in G.boundary_errors(p, s).collect()] == [("s1", "spans_hard_boundary")]
    assert sorted((r.section_key, r.error) for r in G.coverage_errors(p, s).collect()) == [("s1", "missing_section_key"), ("s2", "duplicate_section_key"), ("s3", "missing_section_key"), ("zz", "invented_section_key")]
    assert [r.group_no for r in G.overlap_errors(p, s).collect()] == [1]


def test_url_columns(spark):
    df = spark.createDataFrame([("https://a.example/p/x/?utm_source=1&b=2#f",), ("https://a.example/p/x?utm_source=1&ref=2",), ("https://click.example/c/https%3A%2F%2Fb.example%2Fp%2Fa+b",), ("not a url",), (None,)], "u string")
    got = df.select(P.without_tracking(F.col("u")).alias("w"), P.has_tracking_query(F.col("u")).alias("t"), P.unwrapped_link(F.col("u"), {"click.example": ("/c/",)}).alias("x"), P.story_path(F.col("u"), ["a.example"], (), (r"^/p/[^/]+$",)).alias("s")).collect()
    assert got[0].w == "https://a.example/p/x?b=2" and not got[0].t and got[0].s == "a.example/p/x"
    assert got[1].w == "https://a.example/p/x" and got[1].t
    assert got[2].x == "https://b.example/p/a+b"
    assert got[3].s is None and got[4].s is None and got[4].x == ""
    more = spark.createDataFrame([("https://T.example/x/CL0/https:%2F%2Fb.example%2Fa/1",), ("https://t.example/cl1/nothing",), ("https://other.example/cl0/https:%2F%2Fb.example",), ("https://link.beehiiv.com/v?x=1&url=https%3A%2F%2Fc.example%2Fp%3Fq",), ("https://t.example/cl1/a/cl0/https://d.example",)], "u string")
    assert [r[0] for r in more.select(P.unwrapped_link(F.col("u"), ["t.example"], by_query=["beehiiv.com"])).collect()] == ["https://b.example/a/1", "https://t.example/cl1/nothing", "https://other.example/cl0/https:%2F%2Fb.example", "https://c.example/p?q", "https://d.example"]


def test_gate_and_repair(spark):
    df = spark.createDataFrame([("<p>x {{ a }}</p><script>1</script>\x00",), ("<html><body>" + "y" * 200 + "</body></html>",)], "h string")
    x = df.select(P.html_problems(F.col("h")).alias("p"), "h").select("p", P.html_problems(P.repaired_html(F.col("h"), F.col("p"))).alias("q")).collect()
    assert x[0].p == ["nul_byte", "forbidden_script_tag", "missing_html_root", "missing_html_close", "body_too_short", "unrendered_template_markup"] and x[0].q == [] and x[1].p == []
    fence = spark.createDataFrame([("```json\n{}\n```",), ("{}",), (" ```\nx```",)], "t string")
    assert [r[0] for r in fence.select(P.without_fence(F.col("t"))).collect()] == ["{}", "{}", "x"]
