"""Formats, zones, clock changes and the choice of day or month first."""

from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from galley.operators.timestamps import normalize, sender_address

REG = [("us.example", "America/New_York", "MDY"), ("de.example", "Europe/Berlin", "DMY"), ("np.example", "Asia/Kathmandu", "DMY")]


def us(*a, offset_min=0):
    return int(datetime(*a, tzinfo=UTC).timestamp() * 1_000_000) - offset_min * 60_000_000


CASES = [
    ("2024-01-03T19:07:34+00:00", "us", us(2024, 1, 3, 19, 7, 34)),
    ("2024-01-12T10:01:14.874129697Z", "us", us(2024, 1, 12, 10, 1, 14, 874129)),
    ("2024-01-06 05:16:02,735 +0100", "us", us(2024, 1, 6, 4, 16, 2, 735000)),
    ("2024-01-20T08:52-05:00", "de", us(2024, 1, 20, 13, 52)),
    ("2024-01-06 19:14:34", "de", us(2024, 1, 6, 18, 14, 34)),
    ("2024-01-06 19:14:34", "other", us(2024, 1, 6, 19, 14, 34)),
    ("20240106T165356Z", "us", us(2024, 1, 6, 16, 53, 56)),
    ("1704501991", "us", 1704501991_000000),
    ("1705796648492", "us", 1705796648492_000),
    ("1753137999050982", "us", 1753137999050982),
    ("Fri, 05 Jan 2024 09:58:49 +0545", "us", us(2024, 1, 5, 9, 58, 49, offset_min=345)),
    ("Thu, 08 Feb 2024 19:33:11 MST", "de", us(2024, 2, 9, 2, 33, 11)),
    ("Mon, 3 Mar 2025 23:30:03 +0200 (local)", "us", us(2025, 3, 3, 21, 30, 3)),
    ("Tue, 27 Feb 24 01:32 +0000", "us", us(2024, 2, 27, 1, 32)),
    ("Thu, 19 Jun 2025 09:03:07", "us", us(2025, 6, 19, 13, 3, 7)),
    ("12. März 2024 09:40:10", "de", us(2024, 3, 12, 8, 40, 10)),
    ("Jan 9, 2024 6:26 PM", "us", us(2024, 1, 9, 23, 26)),
    ("Jan 16, 2024 12:21:43 AM", "other", us(2024, 1, 16, 0, 21, 43)),
    ("2024-02-18 04:22:51 America/New_York", "de", us(2024, 2, 18, 9, 22, 51)),
    ("2024-02-26T16:31:04-05:00[America/New_York]", "de", us(2024, 2, 26, 21, 31, 4)),
    ("05/01/2024 07:45:40", "de", us(2024, 1, 5, 6, 45, 40)),
    ("05/01/2024 07:45:40", "us", us(2024, 5, 1, 11, 45, 40)),
    (" \t2024-01-03T19:07:34Z\n", "us", us(2024, 1, 3, 19, 7, 34)),
    # skipped hour: offset before the change (-5); doubled hour: the earlier offset (-4 and +2)
    ("2024-03-10 02:30:00", "us", us(2024, 3, 10, 7, 30)),
    ("2024-11-03 01:30:00", "us", us(2024, 11, 3, 5, 30)),
    ("2024-03-31 02:30:00", "de", us(2024, 3, 31, 1, 30)),
    ("2024-10-27 02:30:00", "de", us(2024, 10, 27, 0, 30)),
    *((t, "us", None) for t in (None, "", "   ", "n/a", "yesterday", "0000-00-00 00:00:00", "2025-02-30 10:10:00", "2025-13-11T25:61:00Z", "2024-01-01", "2024-01-01 24:00:00", "2024-01-01 10:00:60", "Thu, 37 Foo 2025 10:00:00 +0000", "2024-01-01 10:00:00 Nowhere/City", "16/16/2024 10:00:00", "x" * 100_000)),
]


@pytest.fixture(scope="module")
def registry(spark):
    return spark.createDataFrame(REG, "domain string, tz string, date_order string")


def test_every_format(spark, registry):
    rows = [(i, t, f"A <a@{d}.example>", None, -1) for i, (t, d, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, received_at string, sender string, _text string, utc_us int")
    got = {r.i: r for r in normalize(df, "received_at", "sender", registry).collect()}
    assert len(got) == len(CASES)
    wrong = [(CASES[i][0], r.utc_us, CASES[i][2]) for i, r in got.items() if r.utc_us != CASES[i][2]]
    assert not wrong


def test_unlisted_sources_learn_their_order(spark, registry):
    rows = [("a@new.example", f"{d:02d}/03/2024 10:00:00") for d in range(13, 29)] + [("a@new.example", "04/05/2024 10:00:00")]
    rows += [("b@mid.example", "04/05/2024 10:00:00"), (None, "04/05/2024 10:00:00")]
    df = spark.createDataFrame(rows, "sender string, received_at string")
    got = {(r.sender, r.received_at): r for r in normalize(df, "received_at", "sender", registry).collect()}
    learnt = got["a@new.example", "04/05/2024 10:00:00"]
    assert learnt.utc_us == us(2024, 5, 4, 10) and learnt.reading == "dmy" and not learnt.ambiguous
    assert got["b@mid.example", "04/05/2024 10:00:00"].ambiguous


def test_taken_at_settles_single_values(spark, registry):
    df = spark.createDataFrame([("b@mid.example", "04/05/2024 10:00:00", "2024-04-05 12:00:00")], "sender string, received_at string, t string")
    df = df.withColumn("t", F.col("t").cast("timestamp"))
    r = normalize(df, "received_at", "sender", registry, "t").first()
    assert r.utc_us == us(2024, 4, 5, 10) and not r.ambiguous


def test_empty_and_senders(spark, registry):
    empty = spark.createDataFrame([], "received_at string, sender string")
    assert normalize(empty, "received_at", "sender", registry).count() == 0
    senders = [("Ann <A@B.example>", "a@b.example"), ("a@b.example", "a@b.example"), ('"X, Y" <x@y.example>', "x@y.example"), ("  ", None), ("no address", None), (None, None)]
    df = spark.createDataFrame(senders, "s string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", sender_address(F.col("s"))).collect())


def test_ambiguous_zones_and_centuries(spark):
    """An abbreviation of two zones is marked where its source says nothing, and settled where the delays of its mails do."""
    rows = [("a@x", "Tue, 2 Jan 2024 10:00:00 CST", None)]
    # sent at 10:00 of the other zone, taken in two hours later: by the usual one that is before it was sent
    rows += [("b@y", f"Tue, 2 Jan 2024 10:{i:02d}:00 CST", "2024-01-02 04:00:00") for i in range(30)]
    rows += [("d@z", f"Tue, 2 Jan 2024 10:{i:02d}:00 +0000", "2024-01-02 12:00:00") for i in range(59)]
    rows += [("e@v", "2 Jan 70 10:00:00 GMT", "2024-01-02 12:00:00")]
    df = spark.createDataFrame(rows, "sender string, text string, taken string").withColumn("taken", F.col("taken").cast("timestamp"))
    reg = spark.createDataFrame([], "domain string, tz string, date_order string")
    got = normalize(df, "text", "sender", reg, "taken").collect()
    a = next(r for r in got if r.sender == "a@x")
    assert a.ambiguous and a.utc_us == 1704211200 * 10**6
    b = [r for r in got if r.sender == "b@y"]
    assert not any(r.ambiguous for r in b) and min(r.utc_us for r in b) == 1704160800 * 10**6
    e = next(r for r in got if r.sender == "e@v")
    assert e.utc_us == 122400 * 10**6 and not e.ambiguous
