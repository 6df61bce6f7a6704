"""Main body of pages: what many pages repeat is furniture, the unique runs are the story.

Every page is a stream of line tokens, and every line a stream of word tokens in
which the uncommon words (names, as every copy of a piece of furniture has its
own) and the words of the sender's own name are masked; masked lines are called
*frames* below.  The streams of a host are searched for substrings that several
distinct pages share, by suffix groups: round 0 of the doubling groups the
suffixes that share one line token, round 1 those that share two, and a group is
kept where it spans ``MIN_PAGES`` distinct mails of the host, whatever the size of
the corpus.  Long substrings count, so of a host

* lines of ``MIN_WORDS`` words and more that stand there word for word;
* shorter ones together with the line before or behind them;
* frames with ever new fillings.

What hosts share (they use the same mail services and page builders) is found the
same way over the streams of all hosts, on ``MIN_HOSTS`` hosts and ``MIN_PAGES``
pages, again fixed numbers:

* frames with ever new fillings; a copied story is one frame with the same names;
* short lines (menu words, prompts, list heads); the same before a colon;
* such a short line is the *head of a side list* if most of its copies stand
  right above a title.

A line that is the heading of its section is the story's until shown otherwise:
it is left out of the counts, and groups that are headings at least as often as not
are no furniture.  A last pass over each page removes what is covered, keeps the
unique runs, and settles what stands between: entries below a list head, menus made
of menu words and names, short lines inside a menu, headings above furniture.

No list of words or phrases decides anything here.

Bounds: the common words hold at least ``WORD_SHARE`` of all pages each, so there
are at most (words of a page / WORD_SHARE) of them, whatever the number of pages;
where there are more than ``MAX_WORDS`` only the most frequent are unmasked.
Repeated groups are joined back by salted joins and never gathered.

Defined results: lines are the parts between ``\\n``, counted from 0; blank
lines are never furniture; null and empty texts give no row; sections without a
sender form one host; sections without a mail are mails of their own; equal rows
give equal rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.llm.repeated_lines import keep_groups, repeated_groups
from galley.operators.timestamps import sender_domain
from galley.session import materialize

WORD_SHARE = 0.003
#: Distinct mails or pages, and hosts, that a repeated substring stands on; words from which a line alone is a long substring.
MIN_PAGES, MIN_HOSTS, MIN_WORDS = 4, 4, 4
#: Different fillings asked for, as a share of the hosts a frame stands on; copies of a list head that stand above a title.
VARIETY, HEAD_SHARE = 0.4, 0.5
MAX_WORDS = 200_000

_WORD = re.compile(r"[^\W\d_]+")
_BULLET = re.compile(r"^\s*(?:[-*•·–—»>]+|\(?\d{1,3}[.)])\s+")
_SENTENCE_END = re.compile(r"[.!?…。！？]['\"”’)\]]*(?:\s*\[\d+\])?\s*$")
_SEPARATOR = re.compile(r"\s*[·|/»›>•]\s*|\s{3,}")

BLANK, PARTS, NEXT_TITLE, BULLET, SENTENCE, MASKED, NAMED_LABEL, HEADING = (1 << i for i in range(8))
#: Classes of hits: repeated, repeated word for word by many hosts (furniture only among furniture), short line, list head, label, menu word.
REPEATED, CONSTANT, SHORT, LIST_HEAD, LABEL, MENU_WORD = range(6)


def frame_of(line_words: list[str], common: set[str], own: set[str]) -> str:
    """The frame of a line: runs of uncommon words and of the sender's own words become ``~``."""
    out: list[str] = []
    for w in line_words:
        if w in common and w not in own:
            out.append(w)
        elif not out or out[-1] != "~":
            out.append("~")
    return " ".join(out)


def _hash(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


class LineReader:
    """The tokens of a page: per line its words, its frame, its label (what stands before a colon), flags and sizes."""

    def __init__(self, common: set[str]):
        self.common = common

    def read(self, text: str, heading: str | None, own: set[str]) -> tuple[list[int], ...]:
        """raws, frames, labels, flags, sizes, plain (unmasked words), after (next line that isn't blank), and the words that may be menu words with their lines."""
        head = " ".join(_WORD.findall(unicodedata.normalize("NFC", heading.lower()))) if heading else ""
        raws, frames, labels, flags, sizes, plain, menu_line, menu_word = [], [], [], [], [], [], [], []
        for no, line in enumerate(text.split("\n")):
            bare = line.strip()
            if not bare:
                for x, v in zip((raws, frames, labels, flags, sizes, plain), (0, 0, 0, BLANK, 0, 0), strict=True):
                    x.append(v)
                continue
            words = _WORD.findall(bare.lower())
            w, frame = " ".join(words), frame_of(words, self.common, own)
            shown = [x for x in frame.split() if x != "~"]
            flag = MASKED if "~" in frame else 0
            label = 0
            before, colon, behind = bare.partition(":")
            if colon and behind.strip() and not behind.startswith("//"):
                name = frame_of(_WORD.findall(before.lower()), self.common, own)
                if name and name != "~":
                    label = _hash(name)
                    flag |= NAMED_LABEL if "~" in name and len(name.split()) > 2 else 0
            if _BULLET.match(line):
                flag |= BULLET
            told = bare.split(" | ")[0]  # an entry with columns behind it is read by its first one
            if len(words) >= 4 and _SENTENCE_END.search(told):
                flag |= SENTENCE
            if head and w == head:
                flag |= HEADING
            if len(words) >= 3 and shown and not flag & SENTENCE:
                parts = [p for p in _SEPARATOR.split(bare) if p.strip()]
                if len(parts) >= 3 and all(len(p.split()) <= 3 for p in parts):
                    flag |= PARTS
                for x in dict.fromkeys(shown):
                    menu_line.append(no), menu_word.append(_hash(x))
            raws.append(_hash(w) if words else 1)
            frames.append(_hash(frame) if words else 1)
            labels.append(label)
            flags.append(flag)
            sizes.append(min(len(words), 1000))
            plain.append(min(len(set(shown)), 1000))
        lines = [i for i, f in enumerate(flags) if not f & BLANK]
        after = [-1] * len(flags)
        for i, j in zip(lines, lines[1:], strict=False):
            after[i] = j
            if sizes[j] >= MIN_WORDS and not flags[j] & (SENTENCE | HEADING):
                flags[i] |= NEXT_TITLE
        return raws, frames, labels, flags, sizes, plain, after, menu_line, menu_word


_READ = "k long, doc long, host long, raws array<long>, frames array<long>, labels array<long>, flags array<int>, sizes array<int>, plain array<int>, after array<int>, menu_line array<int>, menu_word array<long>"
_TYPES = (np.int64, np.int64, np.int64, np.int32, np.int32, np.int32, np.int32, np.int32, np.int64)


def _lists(rows: list[list[int]], dtype) -> pa.ListArray:
    flat = np.fromiter((v for r in rows for v in r), dtype)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(flat))


def _read_pages(common: set[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = LineReader(common)
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                d = part.to_pydict()
                rows = [reader.read(t, h, set(o or ())) for t, h, o in zip(d["t"], d["heading"], d["own"], strict=True)]
                yield pa.RecordBatch.from_arrays([*(pa.array(d[c], pa.int64()) for c in ("k", "doc", "host")), *(_lists([r[i] for r in rows], t) for i, t in enumerate(_TYPES))], names=re.findall(r"(\w+) (?:long|array)", _READ))

    return run


def judge(flags: list[int], sizes: list[int], plain: list[int], hits: set[tuple[int, int]], menu: dict[int, int]) -> list[int]:
    """The numbers of the furniture lines of one page; ``hits``: (line, class), ``menu``: how many words of a line are menu words."""
    n = len(flags)
    known = [bool({(i, SHORT), (i, LIST_HEAD), (i, LABEL)} & hits) for i in range(n)]

    def is_menu(i: int) -> bool:
        m = menu.get(i, 0)
        return m > 0 and ((m == plain[i] and sizes[i] > MIN_WORDS - 1 and bool(flags[i] & MASKED)) or bool(flags[i] & PARTS) or (m > 1 and 2 * m >= sizes[i]))

    bad = [not flags[i] & BLANK and (known[i] or (i, REPEATED) in hits or is_menu(i)) for i in range(n)]
    lines = [i for i, f in enumerate(flags) if not f & BLANK]
    # entries of a side list: title-like lines below its head, up to the first sentence
    open_list = False
    for i in lines:
        f = flags[i]
        if (i, LIST_HEAD) in hits:
            open_list = True
        elif open_list:
            if f & SENTENCE and sizes[i] > 4 and not bad[i]:
                open_list = False
            elif f & HEADING:
                open_list = False
            else:
                bad[i] = True
    # runs of names and short furniture are menus: one known entry, or two names on their own, make one
    run: list[int] = []
    for i in [*lines, -1]:
        name = i >= 0 and plain[i] == 0 and 1 <= sizes[i] <= 3 and not flags[i] & (SENTENCE | HEADING)
        if name or (i >= 0 and bad[i] and sizes[i] <= MIN_WORDS):
            run.append(i)
            continue
        if len(run) > 1:
            for j in run:
                bad[j] = True
        run = []
    # short lines inside a menu, and what all hosts word alike inside furniture
    for at, i in enumerate(lines):
        if bad[i] or flags[i] & (SENTENCE | HEADING):
            continue
        near = [lines[j] for j in (at - 1, at + 1) if 0 <= j < len(lines)]
        if near and all(bad[j] for j in near) and ((i, CONSTANT) in hits or (sizes[i] <= 3 and all(sizes[j] <= MIN_WORDS for j in near))):
            bad[i] = True
    # a heading stands or falls with what it is above; only a story line behind it keeps it
    story = [i for i in lines if not bad[i]]
    for at, i in enumerate(lines):
        f = flags[i]
        is_head = sizes[i] <= 12 and not f & (SENTENCE | BULLET)
        if is_head and (f & HEADING or at == 0):
            after = lines[at + 1 : at + 2]
            if bad[i] and f & HEADING and not known[i] and after and not bad[after[0]]:
                bad[i] = False
            elif not bad[i] and after and not any(j > i for j in story):
                bad[i] = True
    return [i for i in range(n) if bad[i] and not flags[i] & BLANK]


def _judge_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        d = b.to_pydict()
        ks, nos = [], []
        for k, fl, sz, pl, coded in zip(d["k"], d["flags"], d["sizes"], d["plain"], d["hits"], strict=True):
            hits, menu = set(), {}
            for h in coded or ():
                i, c = divmod(h, 8)
                if c == MENU_WORD:
                    menu[i] = menu.get(i, 0) + 1
                else:
                    hits.add((i, c))
            for no in judge(fl, sz, pl, hits, menu):
                ks.append(k)
                nos.append(no)
        yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int64()), pa.array(nos, pa.int32())], names=["k", "line_no"])


def common_words(pages: DataFrame, n_pages: int) -> set[str]:
    """The words that stand on at least ``WORD_SHARE`` of all pages, the ``MAX_WORDS`` most frequent at most."""
    words = pages.select(F.explode(F.array_distinct(F.split(F.lower("t"), r"[^\p{L}]+"))).alias("w"))
    kept = words.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(3, WORD_SHARE * n_pages))
    return {r["w"] for r in kept.orderBy(F.col("n").desc(), "w").limit(MAX_WORDS).collect()}


def own_words(emails: DataFrame) -> DataFrame:
    """Per sender domain the words of its name: of the domain itself, and of the display names it uses often."""
    x = emails.select(sender_domain(F.col("sender")).alias("domain"), F.lower(F.regexp_replace("sender", r"<[^>]*>|[^\s<]*@[^\s>]*", " ")).alias("name")).where("domain is not null")
    words = x.select("domain", F.explode(F.array_union(F.array_distinct(F.split("name", r"[^\p{L}]+")), F.array(F.lit("")))).alias("w"))
    counted = words.groupBy("domain", "w").agg(F.count(F.lit(1)).alias("n"))
    total = counted.where("w = ''").select("domain", F.col("n").alias("total"))
    often = counted.where("w <> '' and w not in ('from', 'the', 'of', 'and', 'at', 'by')").join(total, "domain").where("n >= 2 and n >= 0.02 * total")
    per = often.groupBy("domain").agg(F.collect_set("w").alias("names"))
    of_domain = F.filter(F.split(F.regexp_replace("domain", r"\.[^.]*$", ""), r"[^\p{L}]+"), lambda w: w != "")
    return total.select("domain").join(per, "domain", "left").select("domain", F.array_union(of_domain, F.coalesce("names", F.array().cast("array<string>"))).alias("own"))


def _flag(bit: int):
    return F.col("flag").bitwiseAND(bit) != 0


def _coded(line, kind: int):
    return (8 * line.cast("long") + kind).alias("hit")


_LINE, _FRAME, _PAIR, _SHORT, _NAMED = range(5)


def _entries(*pairs) -> Column:
    """One struct (sort, group, extra) for each condition that holds."""
    return F.array_compact(F.array(*[F.when(c, F.struct(F.lit(sort).alias("sort"), group.alias("group"), extra.cast("long").alias("extra"))) for c, sort, group, extra in pairs]))


def _host_hits(lines: DataFrame) -> DataFrame:
    """k and hit of the lines that substrings repeated in MIN_PAGES distinct mails of one host cover.

    * round 0: lines of MIN_WORDS words word for word, and frames with as many different fillings;
    * round 1: shorter lines with the line before or behind them, if most of their mails on the host have both.

    All substrings are grouped in one pass; only the positions of repeated ones are kept.
    """
    body, none = ~_flag(HEADING), F.lit(0)
    short = F.when(F.col("size") <= F.col("next_size"), F.col("raw")).otherwise(F.col("next_raw"))
    pair = (F.col("after") >= 0) & (F.least("size", "next_size") > 0) & (F.least("size", "next_size") < MIN_WORDS) & (F.col("size") + F.col("next_size") >= MIN_WORDS)
    entries = _entries(
        ((F.col("size") >= MIN_WORDS) & body, _LINE, F.xxhash64(F.lit(_LINE), "host", "raw"), none),
        (_flag(MASKED) & body & (F.col("plain") > 1), _FRAME, F.xxhash64(F.lit(_FRAME), "host", "frame"), F.col("raw")),
        (pair, _PAIR, F.xxhash64(F.lit(_PAIR), "host", "raw", "next_raw"), F.xxhash64("host", short)),
    )
    x = lines.select("k", "doc", "line_no", "after", F.explode(entries).alias("e")).select("k", "doc", "line_no", "after", "e.sort", "e.group", "e.extra")
    kept = materialize(keep_groups(x, repeated_groups(x, MIN_PAGES)).drop("doc"), "host")
    of = lambda sort: kept.where(F.col("sort") == sort)

    filled = of(_FRAME).select("group", "extra", "n_docs").distinct().groupBy("group").agg(F.count(F.lit(1)).alias("fillings"), F.max("n_docs").alias("n_docs"))
    filled = filled.where((F.col("fillings") >= MIN_PAGES) & (F.col("fillings") >= VARIETY * F.col("n_docs")))
    framed = keep_groups(of(_FRAME).select("k", "line_no", "group"), filled).select("k", "line_no")

    alone = lines.where((F.col("size") > 0) & (F.col("size") < MIN_WORDS)).select("doc", F.xxhash64("host", "raw").alias("extra")).distinct().groupBy("extra").agg(F.count(F.lit(1)).alias("n"))
    pairs = of(_PAIR).select("group", "extra", "n_docs").distinct().join(alone, "extra").where("2 * n_docs > n").select("group", "n_docs")
    two = keep_groups(of(_PAIR).select("k", F.array("line_no", "after").alias("nos"), "group"), pairs).select("k", F.explode("nos").alias("line_no"))

    return of(_LINE).select("k", "line_no").unionByName(framed).unionByName(two).select("k", _coded(F.col("line_no"), REPEATED))


def _shared_hits(read: DataFrame, lines: DataFrame) -> DataFrame:
    """k and hit of what MIN_HOSTS hosts share on MIN_PAGES pages: frames, short lines, labels with a masked place; and of labels and words that are such short lines.

    Two steps, both pre-aggregated: rows per group first, as nearly all groups
    stand once; distinct pages, hosts and fillings of the few that are left.
    """
    is_short = ~_flag(MASKED) & F.col("size").between(1, MIN_WORDS - 1)
    is_frame = (_flag(MASKED) & (F.col("plain") > 0)) | (~_flag(MASKED) & ~_flag(SENTENCE) & (F.col("size") >= MIN_WORDS))
    keyed = lambda sort, value: F.xxhash64(F.lit(sort), value)
    entries = _entries((is_frame, _FRAME, keyed(_FRAME, "frame"), F.lit(0)), (is_short, _SHORT, keyed(_SHORT, "raw"), F.lit(0)), (_flag(NAMED_LABEL) & ~_flag(SENTENCE), _NAMED, keyed(_NAMED, "label"), F.lit(0)))
    x = lines.select("k", "line_no", "host", "raw", _flag(HEADING).alias("head"), _flag(MASKED).alias("masked"), _flag(NEXT_TITLE).alias("titled"), F.explode(entries).alias("e")).select("*", "e.sort", "e.group").drop("e")
    body = ~F.col("head")
    counted = x.groupBy("group").agg(F.sum(body.cast("int")).alias("n"), F.sum(F.col("head").cast("int")).alias("n_head"), F.sum((body & F.col("titled")).cast("int")).alias("n_titled"), F.max("masked").alias("masked"))
    counted = counted.where((F.col("n") >= MIN_PAGES) & (F.col("n") > F.col("n_head")))
    often = F.struct("n", "n_titled", "masked").alias("n_docs")
    rest = materialize(keep_groups(x.select("k", "line_no", "host", "raw", "head", "sort", "group"), counted.select("group", often)).select("*", "n_docs.*").drop("n_docs"), "often")

    told = rest.where(body).select("k", "host", "raw", "group", "n", "n_titled", "masked").distinct()
    per_host = told.groupBy("group", "host", "raw", "n", "n_titled", "masked").agg(F.count(F.lit(1)).alias("rows"))
    hosts = per_host.select("group", "host").distinct().groupBy("group").agg(F.count(F.lit(1)).alias("hosts"))
    fillings = per_host.select("group", "raw", "n", "n_titled", "masked").distinct().groupBy("group", "n", "n_titled", "masked").agg(F.count(F.lit(1)).alias("fillings"))
    pages = told.select("group", "k").distinct().groupBy("group").agg(F.count(F.lit(1)).alias("pages"))
    y = fillings.join(hosts, "group").join(pages, "group").where((F.col("hosts") >= MIN_HOSTS) & (F.col("pages") >= MIN_PAGES))
    varied = F.col("masked") & (F.col("fillings") >= F.greatest(F.lit(MIN_HOSTS), VARIETY * F.col("hosts")))
    groups = materialize(y.select("group", F.struct(varied.alias("varied"), (F.col("n_titled") >= HEAD_SHARE * F.col("n")).alias("opens")).alias("n_docs")), "shared")

    found = keep_groups(rest.select("k", "line_no", "head", "sort", "group"), groups)
    kind = (
        F.when((F.col("sort") == _FRAME) & body, F.when(F.col("n_docs.varied"), REPEATED).otherwise(CONSTANT))
        .when(F.col("sort") == _SHORT, F.when(F.col("n_docs.opens"), LIST_HEAD).otherwise(SHORT))
        .when((F.col("sort") == _NAMED) & F.col("n_docs.varied"), LABEL)
    )
    found = found.select("k", (8 * F.col("line_no").cast("long") + kind).alias("hit")).where("hit is not null")

    labels = lines.where("label <> 0").select("k", "line_no", F.lit(LABEL).alias("kind"), keyed(_SHORT, "label").alias("group"))
    words = read.select("k", F.explode(F.arrays_zip("menu_line", "menu_word")).alias("m")).select("k", F.col("m.menu_line").alias("line_no"), F.lit(MENU_WORD).alias("kind"), keyed(_SHORT, "m.menu_word").alias("group"))
    looked = keep_groups(labels.unionByName(words), groups).select("k", (8 * F.col("line_no").cast("long") + F.col("kind")).alias("hit"))
    return found.union(looked)


def furniture_lines(sections: DataFrame, emails: DataFrame, key: str = "id") -> DataFrame:
    """``key`` and line_no of every line that is not part of the story.

    ``sections``: ``key``, email_id, heading, text; ``emails``: id, sender.
    """
    host = emails.groupBy(F.col("id").alias("email_id")).agg(F.min("sender").alias("sender")).select("email_id", sender_domain(F.col("sender")).alias("domain"))
    host = host.join(own_words(emails), "domain", "left").select("email_id", F.xxhash64("domain").alias("host"), "own")
    pages = sections.select(F.col(key).cast("long").alias("k"), "email_id", F.coalesce(F.col("email_id").cast("long"), -1 - F.col(key).cast("long")).alias("doc"), "heading", F.col("text").cast("string").alias("t")).where("t is not null and t <> ''")
    common = common_words(pages, pages.count())
    placed = pages.join(host, "email_id", "left").select("k", "doc", F.coalesce("host", F.lit(0)).alias("host"), "own", "heading", "t")
    read = materialize(placed.mapInArrow(_read_pages(common), _READ), "lines")

    at = F.posexplode(F.arrays_zip("raws", "frames", "labels", "flags", "sizes", "plain", "after")).alias("line_no", "l")
    lines = read.select("k", "doc", "host", "raws", "sizes", at).where(F.col("l.flags").bitwiseAND(BLANK) == 0)
    next_raw, next_size = (F.get(c, F.col("l.after")) for c in ("raws", "sizes"))
    fields = [F.col(f"l.{a}").alias(b) for a, b in (("raws", "raw"), ("frames", "frame"), ("labels", "label"), ("flags", "flag"), ("sizes", "size"), ("plain", "plain"), ("after", "after"))]
    lines = lines.select("k", "doc", "host", "line_no", *fields, next_raw.alias("next_raw"), next_size.alias("next_size"))
    hits = _host_hits(lines).union(_shared_hits(read, lines))
    per_page = hits.groupBy("k").agg(F.collect_list("hit").alias("hits"))
    out = read.select("k", "flags", "sizes", "plain").join(per_page, "k", "left").mapInArrow(_judge_pages, "k long, line_no int")
    return out.withColumnRenamed("k", key)
