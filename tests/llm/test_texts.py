"""Splitting, repeated lines, page furniture and residue on small fixtures."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from galley.llm import boilerplate as B
from galley.llm.repeated_lines import repeated_blocks, repeated_lines, standing_lines, without_lines
from galley.llm.residue import ResidueIndex, residue
from galley.llm.splitting import cut_place, split_oversized, split_text


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab .\n草́ ?"), max_size=600))
def test_split_rules(text):
    limit, overlap = 80, 20
    pieces = split_text(text, limit, overlap)
    whole = text.strip()
    assert all(len(p) <= limit for p in pieces)
    assert pieces[0] + "".join(b[min(overlap, len(whole)) :] for b in pieces[1:]) == whole
    assert all(b[:overlap] == a[-overlap:] for a, b in zip(pieces, pieces[1:], strict=False))


def test_split_prefers_strong_boundaries():
    text = "a" * 40 + ". " + "b" * 20 + "\n\n" + "c" * 30 + "\n" + "d" * 40
    assert text[: cut_place(text, 0, len(text), 5)].endswith("\n\n")
    assert text.replace("\n\n", "\n")[: cut_place(text.replace("\n\n", "\n"), 0, len(text) - 1, 5)].endswith("\n")
    one = "word " * 60
    assert all(not p.startswith("ord") for p in split_text(one, 80, 20)[:1]) and one[: cut_place(one, 0, len(one), 5)].endswith(" ")


def test_split_spark(spark):
    pad = " \n\t 　"
    rows = [(1, None), (2, ""), (3, pad * 3000), (4, "x" * 8000), (5, pad + "x" * 8000 + pad), (6, "x" * 8001), (7, "é" * 30_000), (8, "y " * 200_000), (6, "z" * 9000)]
    df = spark.createDataFrame(rows, "id long, text string").selectExpr("*", "1 as k", "'p' as piece", "2 as start")
    out = split_oversized(df, "id", "text", 8000).collect()
    assert sorted({r.id for r in out}) == [6, 7, 8]
    eight = sorted((r.piece_no, r.start, r.piece) for r in out if r.id == 8)
    assert len(eight) == next(r.n_pieces for r in out if r.id == 8) and all(len(p) <= 8000 for _, _, p in eight)
    assert all(a[2][-200:] == b[2][:200] for a, b in zip(eight, eight[1:], strict=False))
    assert split_oversized(df.limit(0), "id", "text", 8000).count() == 0
    with pytest.raises(ValueError):
        split_oversized(df, "id", "text", 100)


LINES = "id long, email_id long, text string"


def test_repeated_lines(spark):
    sig = "Written by Ann for 7 the desk"
    rows = [(i, i, f"story {'abcdefgh'[i]} one two\n{sig.upper() if i % 2 else sig.replace('7', '99')}\nok") for i in range(5)]
    rows += [(20, 5, "only here four words\nwritten by ann for the desk"), (21, 5, "written by ann, for the desk!"), (22, 6, "Written by Ann for the desk"), (30, 90, sig), (31, 91, sig), (40, None, sig), (41, 5, None), (42, 5, "")]
    df = spark.createDataFrame(rows, LINES).selectExpr("*", "1 as k", "'x' as doc", "2 as line_no")
    src = spark.createDataFrame([(i, "a@x") for i in range(6)] + [(6, "b@x"), (90, None)], "doc long, src string")
    got = {(r.id, r.line_no): r.n_documents for r in repeated_lines(df, "id", "email_id", "text", src).collect()}
    assert got == {**{(i, 1): 6 for i in range(5)}, (20, 1): 6, (21, 0): 6}
    clean = {r.id: r.text for r in without_lines(df.select("id", "text"), "id", "text", repeated_lines(df, "id", "email_id", "text", src)).collect()}
    assert clean[0] == "story a one two\nok" and clean[21] == "" and clean[22] == "Written by Ann for the desk" and clean[41] is None
    assert repeated_lines(df.limit(0), "id", "email_id", "text", src).count() == 0


def test_repeated_blocks(spark):
    rows = [(i, i, f"own line {'abcdefgh'[i]}\nfirst of block\nsecond of block\nthird of it\nfourth of it") for i in range(6)]
    src = spark.createDataFrame([(i, "a@x") for i in range(6)], "doc long, src string")
    got = {(r.id, r.line_no): (r.n_lines, r.n_documents) for r in repeated_blocks(spark.createDataFrame(rows, LINES), "id", "email_id", "text", src).collect()}
    assert got[0, 1] == (4, 6) and got[0, 2] == (3, 6) and got[0, 4] == (1, 6) and (0, 0) not in got


def test_blocks_against_brute_force(spark):
    """The exact length of the longest repeated block of every line, over texts of few different lines."""
    rng = random.Random(3)
    words = ["alpha", "beta gamma", "delta epsilon zeta", "eta theta iota kappa", "lambda"]
    texts = [[rng.choice(words[: 2 + i % 4]) for _ in range(rng.randint(1, 14))] for i in range(60)]
    texts += [[words[i % 5] for i in range(11)]] * 3 + [[words[i % 5] for i in range(13)]] * 2
    rows = [(i, i // 2, "\n".join(t)) for i, t in enumerate(texts)]
    src = [(i // 2, "ab"[i // 2 % 2]) for i in range(len(texts))]
    docs: dict = {}
    for i, t in enumerate(texts):
        for a in range(len(t)):
            for b in range(a + 1, len(t) + 1):
                docs.setdefault((i // 2 % 2, *t[a:b]), set()).add(i // 2)
    want = {}
    for i, t in enumerate(texts):
        for a in range(len(t)):
            n = max((b - a for b in range(a + 1, len(t) + 1) if len(docs[i // 2 % 2, *t[a:b]]) >= 4), default=0)
            if n:
                want[i, a] = (n, len(docs[i // 2 % 2, *t[a : a + n]]))
    df = spark.createDataFrame(rows, LINES)
    sources = spark.createDataFrame(src, "doc long, src string")
    got = {(r.id, r.line_no): (r.n_lines, r.n_documents) for r in repeated_blocks(df, "id", "email_id", "text", sources).collect()}
    assert got == want and max(n for n, _ in want.values()) > 4
    gone = set()
    for (i, a), (n, _) in want.items():
        if sum(len(x.split()) for x in texts[i][a : a + n]) >= 4:
            gone |= {(i, x) for x in range(a, a + n)}
    assert {(r.id, r.line_no) for r in standing_lines(df, "id", "email_id", "text", sources).collect()} == gone


def test_long_block_has_its_exact_length(spark):
    block = [f"line {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} of it" for i in range(5000)]
    rows = [(i, i, "\n".join([f"own {'abcd'[i]}", *block, f"end {'abcd'[i]}"])) for i in range(4)] * 2
    src = spark.createDataFrame([(i, "a@x") for i in range(4)], "doc long, src string")
    got = {(r.id, r.line_no): r.n_lines for r in repeated_blocks(spark.createDataFrame(rows, LINES), "id", "email_id", "text", src).collect()}
    assert got[0, 1] == 5000 and got[3, 4999] == 2 and got[2, 1234] == 5001 - 1234 and (0, 0) not in got


def test_hot_line_of_one_sender(spark):
    rows = [(i, i, "the same line for all\nx" if i % 3 == 0 else f"other {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyz'[i // 100]} line of this one") for i in range(300)]
    src = spark.createDataFrame([(i, "a@x") for i in range(300)], "doc long, src string")
    assert repeated_lines(spark.createDataFrame(rows, LINES), "id", "email_id", "text", src).count() == 100


COMMON = "report day people part team story road house paper light river stone hand voice table window market letter garden street number morning".split()
NAMES = ["Alvar", "Borin", "Cedra", "Dunna", "Elvor", "Fenna", "Garri", "Holla", "Ivori", "Jarro", "Kelda", "Lomir"]


def test_page_furniture(spark):
    sections, emails = [], []
    for i, n in enumerate(NAMES):
        emails.append((i, f"{n} Post <news@{n.lower()}-post.example>"))
        rng = random.Random(i)
        pick = lambda k: " ".join(rng.choice(COMMON) for _ in range(k))
        story = f"In {n} the {pick(9)}.\nThen {pick(12)} of {n}!"
        sections.append((i, i, f"How {n} did it", f"Skip to {n}x content\nHome · About · {n}y · Search\nHow {n} did it\n{story}\nMost read\n1. Why {n} left\n2. The road of {n}\nWe keep {n}q files on your machine for {n}z always.\n© 20{10 + i} {n} Post Media"))
    df = spark.createDataFrame(sections, "id long, email_id long, heading string, text string").selectExpr("*", "1 as k", "2 as host", "3 as frames")
    em = spark.createDataFrame(emails, "id long, sender string")
    got = {}
    for r in B.furniture_lines(df, em).collect():
        got.setdefault(r.id, set()).add(r.line_no)
    assert got == {i: {0, 1, 5, 6, 7, 8, 9} for i in range(len(NAMES))}


def test_page_furniture_of_one_host(spark):
    """What one host repeats is found by repetition alone, in small and large corpora, and by distinct mails."""
    notice, short = "Every reader of ours gets a paper kite in spring.", "Paper kites"
    own = lambda i: " ".join(random.Random(i).sample(COMMON, 12)) + "."
    for others in (0, 400):
        rows = [(i, i, None, f"{own(i)}\n{short}\n{notice}") for i in range(5)]
        rows += [(10 + i, 10 + i, None, f"{own(10 + i)}\nA line that one mail has often." + "\nA line that one mail has often." * 5 * (i == 0)) for i in range(3)]
        rows += [(100 + i, 100 + i, None, own(100 + i)) for i in range(others)]
        em = spark.createDataFrame([(r[0], "a@kite.example" if r[0] < 5 else "b@other.example" if r[0] < 100 else f"c@h{r[0] % 40}.example") for r in rows], "id long, sender string")
        df = spark.createDataFrame(rows, "id long, email_id long, heading string, text string")
        assert sorted((r.id, r.line_no) for r in B.furniture_lines(df, em).collect()) == [(i, no) for i in range(5) for no in (1, 2)]


@pytest.mark.parametrize("n_hosts", [1, 3, 6])
def test_page_furniture_with_ever_new_names(spark, n_hosts):
    """A notice that every page holds with another name is found, on one host as on many, beside many other pages."""
    syllables = ["ba", "do", "ku", "mi", "ra", "so", "ze", "fu"]
    name = lambda i: "".join(syllables[i // 8**j % 8] for j in range(5))
    own = lambda i: " ".join(random.Random(i).sample(COMMON, 12)) + "."
    rows = [(i, i, None, f"{own(i)}\nWritten by {name(i)} for the paper house\n{own(9000 + i)}") for i in range(60)]
    rows += [(1000 + i, 1000 + i, None, f"{own(1000 + i)}\nThe {own(5000 + i)} was written for and by all") for i in range(300)]
    em = spark.createDataFrame([(r[0], f"a@h{r[0] % n_hosts}.example" if r[0] < 1000 else f"c@o{r[0] % 40}.example") for r in rows], "id long, sender string")
    df = spark.createDataFrame(rows, "id long, email_id long, heading string, text string")
    assert sorted((r.id, r.line_no) for r in B.furniture_lines(df, em).collect()) == [(i, 1) for i in range(60)]


def test_page_furniture_dirt(spark):
    rows = [(1, 1, None, None), (2, 1, None, ""), (3, None, "Menu", "Menu\nHome\nAbout"), (4, 9, "", "One story line that is told here and nowhere else."), (5, 1, None, "x " * 100_000), (6, 1, None, "\n\r\n \n"), (3, None, "Menu", "Menu\nHome\nAbout")]
    df = spark.createDataFrame(rows, "id long, email_id long, heading string, text string")
    em = spark.createDataFrame([(1, None), (9, "a@b.example"), (9, "a@b.example")], "id long, sender string")
    assert sorted((r.id, r.line_no) for r in B.furniture_lines(df, em).collect()) == sorted([(3, 0), (3, 1), (3, 2)] * 2)
    assert B.furniture_lines(df.limit(0), em).count() == 0


CASES = [
    ("marker", "Hi {{ first_name }},\nA real line of the story stands here."),
    ("marker", "A real line with %%sender_name%% inside it, as it was sent."),
    ("marker", "<h1><%= AUTHOR %></h1>"),
    ("marker", "Best,\nTODO: add company\nThe Post"),
    (None, "Example:\n```\n<h1>{{ topic }}</h1>\n```\nA real line follows the code here."),
    (None, "A marker such as `[[PLAN]]` is filled when the mail is sent."),
    (None, 'The text "{{city}}" is a marker that the guide explains.'),
    (None, "Run it with `export X=${HOME}/a` and compare the sets {x | x > 5} and {a: 0}."),
    (None, "def __init__(self): the __name__ of a module is a string."),
    ("empty", "Hello None, your Daily Post digest for None is ready."),
    ("empty", "You have [object Object] unread stories."),
    (None, "The value was undefined in the old driver, so the team returned NaN and fixed it."),
    ("filler", "A real title\n\nLorem ipsum dolor sit amet, consectetur adipiscing elit sed.\n\nA real line of the story is here."),
    ("filler", "asdf qwer foo bla test asdf xxx"),
    ("filler", "Texto de relleno. Texto de relleno. Texto de relleno."),
    (None, "Designers at the house dropped lorem ipsum for real stories, because dummy text hides flaws."),
    ("error", "404\nThe page you asked for is not here. It may have moved. Back to The Post."),
    ("error", "Menu Login\nIt looks like JS is switched off. The Post can't load without it."),
    ("error", "HTTP Error 502. The server could not finish the request. Reference 2ebd403a."),
    ("error", "VEUILLEZ ACTIVER LES SCRIPTS POUR AFFICHER THE POST."),
    ("error", "page not found " * 170),
    ("error", "Gateway timed out\nThe upstream server gave no response."),
    ("error", "This document has been withdrawn and can no longer be displayed here."),
    (None, "The editors said that this document of the archive was withdrawn by its author in spring."),
    ("filler", "Our team met in the house on Monday and lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt before the road was shut for the day again."),
    ("marker", "Hi {{#user.first_name}}, hello"),
    (None, "The sets {a} and {b} meet in {{ }} and the price is ${}."),
    (None, '"Page not found" is the message the old policy showed; today it reads "Why it moved".'),
    (None, "Access denied\nThe real story is long and goes on about the case of the day for a while."),
    (None, "Please enable the weekly camera before you test the maintenance cache, says the team."),
    (None, ""), (None, "  \n"), (None, "ok"), (None, "草案数字が草案に提案記事。"), (None, "word " * 50_000), (None, None),
]


def test_residue(spark):
    rows = [(i, t, "x") for i, (_, t) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string").selectExpr("*", "1 as k", "'z' as t")
    got = {r.doc_id: r.kind for r in residue(df).collect()}
    assert {i: got.get(i) for i in range(len(CASES))} == {i: k for i, (k, _) in enumerate(CASES)}
    assert residue(df.limit(0)).count() == 0
    assert ResidueIndex({}, 0).classify("Loading…")[0] == "error"


def test_notice_among_furniture(spark):
    """The lines around a notice are furniture where other documents repeat them, and the page's own otherwise."""
    menu = "Home\nKites\nBoats\nSails\n"
    rows = [(i, menu + f"A real text about {w} stands below the menu, with words enough to be one.") for i, w in enumerate(["rain", "wind", "sand", "salt"])]
    rows += [(10, menu + "Page not found"), (11, "Home\nRoses\nTulips\nLilies\nPage not found"), (12, "Page not found\nKites Boats Sails Home\nOne title\nTwo titles")]
    got = {r.doc_id: r.kind for r in residue(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {10: "error", 12: "error"}
