"""State, composition, scorer, mail and settings."""

import base64
import json
import os

import pytest
from pyspark.sql import functions as F

from galley.operators import compose as O
from galley.operators import scorer as C
from galley.operators import state as R
from galley.sources import mail as S
from galley.sources.settings import Settings
from galley.streaming.ingest import EMAIL_SCHEMA, MESSAGE_SCHEMA, ingest_stream

LOG = "id long, email_id long, email_section_id long, content_unit_key string, kind string, category string, payload string, created_at timestamp"


def log(spark, rows):
    return spark.createDataFrame([(*r, None) for r in rows], LOG)


def test_upsert(spark):
    now = F.lit("2024-01-01").cast("timestamp")
    old = spark.createDataFrame([(7, "a", "old", "s", "p", "archived", 2, "e", "t0", None, None), (8, "b", None, None, None, "failed", 1, "e", None, None, None)], EMAIL_SCHEMA)
    new = spark.createDataFrame([("a", "a", "x", "new", "snip", None, ["I"]), ("a", "a", "y", "newer", "snip", None, ["I", "J"]), ("c", "c", "z", "c", None, "t1", None), (None, None, None, None, None, None, None)], MESSAGE_SCHEMA)
    got = {r.message_id: r for r in R.upsert_emails(old, new, now).collect()}
    assert set(got) == {"a", "b", "c"}
    a = got["a"]
    assert (a.id, a.subject, a.status, a.retry_count, a.error_message, a.received_at) == (7, "newer", "pending", 0, None, "t0")
    assert (got["b"].status, got["b"].error_message) == ("failed", "e") and got["c"].id == 9
    assert R.upsert_emails(old.limit(0), new.limit(0), now).count() == 0


def test_latest_and_cascade(spark):
    x = log(spark, [(1, 1, 5, None, "r", "A", "1"), (3, 1, 5, None, "r", "B", "2"), (2, 1, None, None, "r", "C", "3"), (4, 1, None, "u0", "r", None, "4")])
    assert sorted(r.id for r in R.latest(x, ["email_id", "email_section_id", "content_unit_key", "kind"]).collect()) == [2, 3, 4]
    s = spark.createDataFrame([(6,)], "id long")
    assert sorted(r.id for r in R.cascade(x, s).collect()) == [2, 4]
    assert sorted(r.id for r in R.without(x, F.col("content_unit_key") != "zz").collect()) == [1, 2, 3]


def test_replace_keeps_ids(spark):
    schema = "id long, email_id long, section_key string, order_index int, content_hash string, created_at timestamp"
    old = spark.createDataFrame([(1, 1, "s0", 0, "h0", None), (2, 1, "s1", 1, "h1", None), (3, 2, "s0", 0, "h", None)], schema)
    new = spark.createDataFrame([(None, 1, "s0", 0, "h0", None), (None, 1, "s1", 1, "changed", None), (None, 1, "s2", 2, "h2", None)], schema)
    got = {(r.email_id, r.section_key): (r.id, r.change) for r in R.replace_sections(old, new).collect()}
    assert got[1, "s0"] == (1, "kept") and got[2, "s0"] == (3, "untouched")
    assert {got[1, "s1"][0], got[1, "s2"][0]} == {4, 5} and got[1, "s1"][1] == "inserted" and len(got) == 4


def test_publish_snapshots(spark, tmp_path):
    R.publish(spark.range(3).toDF("x"), str(tmp_path))
    first = R.snapshot(spark, str(tmp_path))
    R.publish(first.union(first), str(tmp_path))
    assert R.snapshot(spark, str(tmp_path)).count() == 6 and first.count() == 3
    assert R.evolve(first, {"x": "y"}, {"z": "string"}).columns == ["y", "z"]


def test_completeness(spark):
    s = spark.createDataFrame([(1, 10), (1, 11), (2, 12), (3, 13)], "email_id long, id long")
    x = log(spark, [(1, 1, 10, None, "router", "A", ""), (2, 1, 10, None, "radar", "A", ""), (3, 1, 11, None, "router", "B", ""), (4, 2, 12, None, "router", "A", ""), (5, 2, 12, None, "noise", "A", "")])
    got = {r.email_id: r.complete for r in R.complete_emails(x, s, "router", F.col("kind").isin("radar", "noise")).collect()}
    assert got == {1: False, 2: True, 3: False}
    assert {r.email_id: r.categories for r in R.category_sets(x, s).collect()} == {1: "A,B", 2: "A", 3: None}


def test_shown_rows(spark):
    clf = json.dumps({"routing_source": "sender_profile"})
    x = log(spark, [
        (1, 1, 5, None, "radar", "RADAR", ""), (2, 1, None, "u0", "technology", "TECHNOLOGY", ""), (3, 1, None, "u0", "classifier", None, "{}"), (4, 1, None, "u1", "radar", "RADAR", ""),
        (5, 2, None, None, O.DIGEST, "RADAR", ""), (6, 2, 7, None, "radar", "RADAR", ""), (7, 3, None, None, "courses", "COURSES", ""),
        (8, 4, None, "u0", "classifier", None, clf), (9, 4, None, "u0", "technology", "TECHNOLOGY", ""), (10, 4, None, "u1", "classifier", None, "broken"), (11, 4, None, "u1", "technology", "TECHNOLOGY", ""), (12, 1, 5, None, "noise", "RADAR", ""),
    ])
    assert sorted(r.id for r in O.shown_rows(x).collect()) == [1, 2, 9, 12]
    assert {(r.id, r.warning) for r in O.warnings(x).collect()} == {(4, "unit_processor_without_classifier"), (7, "legacy_email_level_processor"), (12, "category_kind_mismatch")}


def test_facts_and_cards(spark):
    f = spark.createDataFrame([(1, 0, "b", "x", 5), (1, 1, "a", "x", 5), (1, 2, "a", "sponsored", 5), (1, 3, "c", "x", 2), (2, 0, "q", "x", 1)], "id long, place int, entity string, fact string, importance int")
    kept = O.ranked_facts(f, "id", 2)
    assert [(r.entity, r.rank) for r in kept.orderBy("rank").collect()] == [("a", 1), ("b", 2)]
    assert [r.entity for r in O.fallback_facts(f, "id", kept).collect()] == ["q"]
    c = spark.createDataFrame([(1, 0, "recap"), (1, 1, "top_story"), (1, 2, "top_story"), (1, 3, "recap")], "id long, card_no int, role string")
    assert [(r.card_no, r.role) for r in O.kept_cards(c).orderBy("card_no").collect()] == [(0, "recap"), (1, "top_story"), (2, "recap")]


def test_scorer(spark):
    def scorer(prompt, attempt, error):
        if prompt == "boom":
            raise RuntimeError("down")
        if prompt == "late" and attempt == 1:
            return "oops"
        return "```json\n{\"x\": 1}\n```" if prompt != "bad" else "{}"

    df = spark.createDataFrame([(1, "ok"), (2, "late"), (3, "bad"), (4, "boom"), (5, None)], "k long, p string")
    got = {r.k: r for r in C.scored(df, "k", "p", scorer, lambda v: [] if "x" in v else ["no x"]).collect()}
    assert set(got) == {1, 2, 3, 4} and [got[k].attempts for k in (1, 2, 3, 4)] == [1, 2, 2, 2]
    assert got[2].value == '{"x": 1}' and got[3].error == "no x" and "down" in got[4].error
    e = spark.createDataFrame([(["https://a"], ["https://a"]), (["http://a"], ["http://a"]), (["https://b"], None), (None, None)], "u array<string>, a array<string>")
    assert [r[0] for r in e.select(C.link_errors(F.col("u"), F.col("a"))).collect()] == [[], ["not_https"], ["outside_allowlist"], []]


def test_mail(spark):
    b = base64.urlsafe_b64encode("<p>é</p>".encode()).decode().rstrip("=")
    t = base64.urlsafe_b64encode(b"a<b").decode()
    assert S.body_of({"mime": "multipart/mixed", "parts": [{"mime": "text/plain", "data": t}, {"mime": "multipart/alternative", "parts": [{"mime": "text/html", "data": b}]}]}) == "<p>é</p>"
    assert S.body_of({"mime": "text/plain", "data": t}) == "<pre>a&lt;b</pre>" and S.body_of(None) == "" and S.decoded("é") == ""
    m = spark.createDataFrame([("A <a@b.example>", ["X"]), ("q@sub.c.example", []), (None, None)], "sender string, label_ids array<string>").withColumn("t", F.lit("2024-01-02").cast("timestamp"))
    now = F.lit("2024-01-03").cast("timestamp")
    assert S.recent(m, ["a@b.example", "@c.example"], "t", now, 3, []).count() == 2
    assert S.recent(m, ["a@b.example"], "t", now, 3, ["X"]).count() == 0
    for bad in ([], ["@b ad"], ["  "]):
        with pytest.raises(ValueError):
            S.recent(m, bad, "t", now, 3, [])
    with pytest.raises(ValueError):
        S.recent(m, ["a@b.example"], "t", now, 0, [])
    h = spark.createDataFrame([([("FROM", "x"), ("Date", "y")],)], "h array<struct<name:string,value:string>>")
    assert h.select(S.headers(F.col("h"), "from")).first()[0] == "x"
    assert h.limit(1).select(S.body_html(F.lit(json.dumps({"mime": "text/html", "data": b})))).first()[0] == "<p>é</p>"


def test_settings():
    s = Settings.load({"GALLEY_SENDERS": " a@b , ,c ", "GALLEY_API_KEY": "sk-123456789", "GALLEY_MAX_CHUNKS": "4"})
    assert s.senders == ("a@b", "c") and s.max_chunks == 4 and s.summary()["api_key"] == "sk-…" and s.summary()["senders"] == "a@b,c"
    with pytest.raises(ValueError):
        Settings(max_chunks=33)


def test_streaming_ingest(spark, tmp_path):
    src, target, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    spark.createDataFrame([("a", "a", "s", "x", None, None, [])], MESSAGE_SCHEMA).write.parquet(src)
    ingest_stream(spark, src, target, check).awaitTermination()
    spark.createDataFrame([("a", "a", "s", "y", None, None, []), ("b", "b", "s", "z", None, None, [])], MESSAGE_SCHEMA).write.mode("append").parquet(src)
    ingest_stream(spark, src, target, check).awaitTermination()
    assert {(r.message_id, r.subject) for r in R.snapshot(spark, target).collect()} == {("a", "y"), ("b", "z")}


def test_scratch_tables_are_dropped(spark):
    from galley.session import discard, materialize, scratch

    with scratch(spark) as root:
        a = materialize(spark.range(3).toDF("x"), "a")
        b = materialize(a.where("x > 0"), "b")
        assert a._scratch.startswith(root)
        discard(a, b.where("x > 1"))
        assert b.count() == 2 and not os.path.exists(a._scratch.removeprefix("file://"))
        kept = b._scratch.removeprefix("file://")
        assert os.path.exists(kept)
    assert not os.path.exists(kept)
