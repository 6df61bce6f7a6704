"""Registries, cascades, proposals, reuse, delivery."""

import json

from pyspark.sql import functions as F

from galley.operators import delivery as D
from galley.operators import routing as T

UNIT = "email_id long, content_unit_key string, unit_text string, headings array<string>, section_keys array<string>"


def test_registry_prefers_addresses(spark):
    e = spark.createDataFrame([(1, "A <a@x.example>"), (2, "b@x.example"), (3, "c@y.example"), (4, None)], "id long, sender string")
    r = spark.createDataFrame([("dom", 1, None, "X.example"), ("addr", 9, "A@x.example", None), ("low", 5, None, "x.example")], "entry string, rank int, address string, domain string")
    assert {x.email_id: x.entry for x in T.registry_entry(e, r).collect()} == {1: "addr", 2: "dom"}


def test_distinct_stories(spark):
    s = spark.createDataFrame([(1, "w.example/p/a"), (1, "example/q/a"), (1, "example/p/b")], "email_id long, path string")
    c = spark.createDataFrame([(1, "example/p/a"), (2, "example/p/z"), (3, None)], "email_id long, canonical string")
    assert sorted(map(tuple, T.distinct_stories(s, c).collect())) == [(1, "example/p/a"), (1, "example/p/b"), (2, "example/p/z")]


def test_cascade_asks_the_scorer_for_the_rest_only(spark):
    units = spark.createDataFrame([(1, "u0", "text", ["h"], ["s0"]), (2, "u0", "register for the webinar", [], ["s0"]), (3, "u0", "other", [None], ["s0"]), (4, "u0", "bad", [], ["s0"])], UNIT)
    priors = spark.createDataFrame([(1, "RADAR")], "email_id long, category string")

    def scorer(prompt, attempt, error):
        if prompt in ("text", "register for the webinar"):
            raise AssertionError("a ruled unit was asked for")
        return json.dumps({"category": "TECHNOLOGY" if prompt == "other" else None, "confidence": 0.7})

    got = {r.email_id: (r.category, r.source, r.error) for r in T.categorised(units, priors, scorer, lambda v: [] if v["category"] else ["no category"]).collect()}
    assert got == {1: ("RADAR", "sender_prior", None), 2: ("COURSES", "heuristic", None), 3: ("TECHNOLOGY", "scorer", None), 4: (None, "scorer", "no category")}
    e = {r.email_id: r.evidence for r in T.ruled_categories(units, priors).collect()}
    assert e[1] == ["h"] and e[3] == ["other"]


def test_scoped_and_resolved(spark):
    units = spark.createDataFrame([(1, "u0", "", [], ["s0", "s1"]), (1, "u1", "", [], ["s1", "s2"]), (1, "u2", "", [], [])], UNIT)
    run = spark.createDataFrame([(1, ["s0", "s1"])], "email_id long, section_keys array<string>")
    assert [r.content_unit_key for r in T.scoped(units, run).collect()] == ["u0"]
    runs = spark.createDataFrame([(1, 0, "s0", 0), (1, 0, "s1", 1), (1, 1, "s3", 3), (1, 1, "s4", 4)], "email_id long, run_no int, section_key string, position int")
    proposed = spark.createDataFrame([(1, 0, 0, "s0"), (1, 0, 0, "s1"), (1, 1, 0, "s3"), (1, 1, 0, "s4")], "email_id long, run_no int, group_no int, section_key string")
    status = spark.createDataFrame([(1, 0, "accepted"), (1, 1, "low_confidence")], "email_id long, run_no int, status string")
    assert [r.group_no for r in T.resolved_groups(proposed, runs, status).orderBy("position").collect()] == [0, 0, 1, 2]
    df = spark.createDataFrame([(13, True, None, 0, 0.9), (3, False, None, 0, 0.9), (3, True, "e", 0, 0.9), (3, True, None, 2, 0.9), (3, True, None, 0, 0.74), (3, True, None, 0, 0.75)], "n int, on boolean, e string, p int, c double")
    assert [r[0] for r in df.select(T.run_status(*map(F.col, ("n", "on", "e", "p", "c")))).collect()] == ["too_many_sections", "disabled", "scorer_error", "validation_failed", "low_confidence", "accepted"]


def test_map_phase_and_cache(spark):
    chunks = spark.createDataFrame([(1, 1, "b"), (1, 0, "a"), (2, 0, "fail")], "email_id long, chunk_index int, text string")

    def scorer(prompt, attempt, error):
        if prompt == "fail":
            raise RuntimeError("down")
        return json.dumps({"facts": [{"entity": prompt, "fact": "f"}, {"entity": prompt * 2, "fact": "g", "importance_score": 5}]})

    got = T.map_phase(chunks, scorer, lambda v: []).orderBy("place").collect()
    assert [(r.entity, r.importance) for r in got] == [("a", 3), ("aa", 5), ("b", 3), ("bb", 5)]
    units = spark.createDataFrame([(1, "u0", "text", [], []), (1, "u1", "new", [], [])], UNIT)
    import hashlib

    log = spark.createDataFrame([(1, 1, "u0", "k", json.dumps({"content_hash": hashlib.sha256(b"text").hexdigest()})), (2, 1, "u1", "k", "broken")], "id long, email_id long, content_unit_key string, kind string, payload string")
    assert {r.content_unit_key: r.cached for r in T.unit_hash_cache(units, log, "k").collect()} == {"u0": True, "u1": False}


def test_delivery(spark, tmp_path):
    pages = spark.createDataFrame([(1, "<p>{{ x }}</p>"), (2, None)], "id long, html string")
    assert all(not r.problems for r in D.composed(pages, "id").collect())
    a = {r.id: r.missing for r in D.send_actions(pages, F.lit("s"), "a@b.example", "c@d.example").collect()}
    assert a == {1: [], 2: ["html"]}
    d = spark.createDataFrame([("<html>x</html>",)], "body_html string")
    out = tmp_path / "p.html"
    assert D.preview(d, str(out)) == 0 and out.read_text() == "<html>x</html>"
    seen = []
    assert D.preview(d, None, seen.append) == 0 and seen and D.preview(d.limit(0)) == 1
    au = spark.createDataFrame([(1, 1, "s1", "hidden", "r", 3, "a\nb"), (1, 0, "s0", "article", "n", 2, "x")], "email_id long, position int, section_key string, disposition string, rule string, n_chars int, preview string")
    assert D.audit_report(au).first().report == "s0 | article | n | 2 | x\ns1 | hidden | r | 3 | a b"
