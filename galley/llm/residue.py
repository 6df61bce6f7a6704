"""Template residue and error-page text.

Labelled exemplars (below, plainly) stand in an inverted index by their rarest
words.  A text looks up the exemplars that share one of those words, and windows
slide over its words: TF-IDF containment, with document frequencies of the whole
corpus, tells how much of the exemplar a window holds (short exemplars), or how
much of the window the exemplar holds (filler paragraphs, whose words come in any
order).  What the windows cover of a passage (a line or a sentence) decides:

* ``marker``: an unfilled placeholder stands in the running text: exemplars of
  signs with the name masked, posted under their opening sign;
* ``empty``: a program's empty value stands where a value should be;
* ``filler``: a passage is filler or dummy text, or a long run inside one is, even
  among real ones;
* ``error``: notices cover the text but for a title and page furniture.  Furniture
  are the short lines that many documents repeat, counted over the corpus.

Code in fences, inline code and quoted markers are shown, not residue, and are
left out before anything is looked at.  Texts without a key of the index never
reach Python.

Defined results: null, empty, blank and very short texts are never excluded;
a text has one row, with the first kind above that holds; very long texts and
passages are read whole; equal rows give equal rows.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galley.functions.predicates import bound
from galley.session import materialize

CONTAINMENT = 0.8
#: Lines beside a notice that are no furniture; words of the text's own for each word of a notice; documents that repeat a line of furniture.
MAX_TITLES, STORY_SHARE, MIN_DOCUMENTS = 2, 0.5, 4
#: Words of a window of filler, and different ones among them; words of a covered run that is filler inside a longer passage.
FILLER_WINDOW, FILLER_DISTINCT, FILLER_RUN = 6, 5, 12

# Labelled exemplars; ~ is a place for a name, a number or a date.
ERRORS = """
page not found
~ not found
the page you asked for is not here it may have moved back to ~ ~
nothing was found at this address
the link you followed is broken or the letter was taken down reason ~
~ bad gateway
http error ~ the server could not finish the request reference ~
service temporarily unavailable
service temporarily unavailable ~ pool is full ~ waiting
internal server error
access denied
forbidden
status message forbidden trace ~
you don t have permission to open this letter ref ~
this post was removed by its author or is only for paying members of ~ ~ error ~
your session has expired sign in again to go on reading ~ ~
we could not verify your browser tick the box to show you are no robot token ~
checking that you are a human before opening ~ ~ this takes ~ seconds
too many requests from your network wait ~ seconds trace ~
oops something went wrong on our end try again in a few minutes ~
we are down for maintenance until ~ sorry for the trouble the ~ ~ team
this site can t be reached ~ example took too long to answer
error establishing a link to the archive of ~ ~
error establishing a database connection
warning cannot connect to the story database on line ~ query failed table ~ is gone
uncaught exception in block ~ cannot read field ~ ~ of null
templateerror no such block ~ ~ at line ~ of ~ ~ html
in render
in send issue
loading
loading please wait
loading if nothing appears allow javascript for ~ example and disable blockers
please turn on javascript to read ~ ~
please enable javascript to continue
this page works only with javascript enable it and reload ~ ~
you need scripts enabled in your browser to run this app ~
you need to enable javascript to run this app
it looks like js is switched off ~ ~ can t load without it
your browser is too old or blocks scripts so ~ ~ cannot be shown update it or allow scripts for this site
noscript the ~ reader cannot start because scripting is off in this window
seite nicht gefunden der artikel ~ wurde verschoben oder gelöscht
die verbindung wurde zurückgesetzt bitte laden sie ~ ~ neu code ~
bitte aktivieren sie javascript um ~ ~ zu lesen
ohne aktivierte skripte lässt sich ~ ~ nicht anzeigen
página no encontrada el enlace ~ ya no existe
acceso restringido inicie sesión para continuar ref ~
para continuar habilite javascript y las cookies en ~ ~
activa los scripts del navegador para ver esta edición de ~ ~
erreur ~ la page de ~ ~ est introuvable ou indisponible
veuillez activer les scripts pour afficher ~ ~
gateway timed out
~ gateway timeout the server did not answer in time
the upstream server gave no response
bad request your browser sent a request that this server could not understand
service unavailable the server cannot handle the request right now
the server encountered an internal error and was unable to complete your request
this document has been withdrawn and can no longer be displayed
this content is no longer available
this article was deleted or moved
the requested page does not exist
sorry we could not find the page you were looking for
this page is temporarily unavailable please come back later
an unexpected error occurred please try again later
something went wrong please refresh the page
your connection was reset check your network and reload
you are offline check your internet connection
you must be logged in to view this page
please log in to continue reading
you are not authorized to access this resource
access to this page has been blocked
your request was blocked by the security rules of this site
please verify that you are human
please wait while we check your browser
redirecting you to the page please wait
rate limit exceeded please slow down
this site requires javascript turn it on in the settings of your browser
javascript is disabled enable it to use this site
cookies must be enabled to use this site
your browser is not supported please upgrade
undefined method call to a member function on null in line ~
stack trace exception in thread main at line ~
syntax error unexpected token in line ~
connection to the database failed
"""
FILLERS = """
this is dummy content used to preview the ~ layout of ~ ~
this is dummy content used to preview the ~ layout of ~ ~ final copy pending
final copy pending
content coming soon
text for this block will follow
paragraph text
placeholder text
lorem ipsum
texto de relleno
blindtext für den umbruch
faux texte
two lines about the story
short teaser of the story
teaser text
story title ~
section title ~
headline ~
"""
# Paragraphs that fill a place, in Latin and typed on a keyboard; their words come in any order.
PARAGRAPHS = """
lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt in culpa qui officia deserunt mollit anim id est laborum
asdf qwer qwerty foo bar baz bla blah test xxx aaa zzz abc hjkl yxcv dummy
"""
EMPTIES = """
hello emptyvalue your ~ ~ digest for emptyvalue is ready
you have emptyvalue unread stories
dear emptyvalue
hi emptyvalue
hello emptyvalue
welcome back emptyvalue
"""
# Labelled exemplars of signs: ~ between blanks is a name of several words, else of one.
SIGNS = """
{{ ~ }}
{{{ ~ }}}
{{# ~ }}
{{/ ~ }}
{{& ~ }}
{{^ ~ }}
{{> ~ }}
${~}
${ ~ }
#{~}
<% ~ %>
<%= ~ %>
<%- ~ %>
{% ~ %}
{%- ~ -%}
%%~%%
*|~|*
[[ ~ ]]
<< ~ >>
@@~@@
__~__
%(~)s
%(~)d
[insert ~ ]
[your ~ here]
todo: add ~
{~}
"""
_DUNDER = re.compile(r"__(?:init|main|name|str|repr|call|file|doc|all|class|dict|len|iter|next|enter|exit|version|future|new|del|eq|hash)__")
_FENCE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)", re.S)
_INLINE = re.compile(r"`[^`\n]*`")
_EMPTY = re.compile(r"\[object Object\]|\b(?:None|NaN|undefined|null|NONE|NAN|UNDEFINED|NULL|none|nan)\b|\[OBJECT OBJECT\]")
_OBJECT = re.compile(r"(?<![\"“'‘])\[object Object\](?![\"”'’])", re.I)
_RUN = re.compile(r"[^\W_]+")
_SENTENCES = re.compile(r"(?<=[.!?…])\s+")
_SENTENCE_END = re.compile(r"[.!?…。！？]['\"”’)\]]*\s*$")


def _lines(text: str) -> list[str]:
    return text.strip("\n").split("\n")


def words_of(text: str) -> list[str]:
    """The words of a text in lower case: runs of letters; runs with digits are numbers and codes."""
    return [w for w in _RUN.findall(text.lower()) if w.isalpha()]


def exemplars() -> list[tuple[str, list[str], int]]:
    """(kind, words, places) of every labelled exemplar of words."""
    labelled = (("error", ERRORS), ("filler", FILLERS), ("paragraph", PARAGRAPHS), ("empty", EMPTIES))
    return [(kind, [w for w in line.split() if w != "~"], line.split().count("~")) for kind, lines in labelled for line in _lines(lines)]


def vocabulary() -> list[str]:
    return sorted({w for _, words, _ in exemplars() for w in words})


def openers() -> list[str]:
    """The opening signs: what stands before the name in an exemplar of signs."""
    return sorted({line.partition("~")[0].strip() for line in _lines(SIGNS)}, key=lambda x: (-len(x), x))


def sign_pattern() -> re.Pattern:
    """The exemplars of signs with their masked names, as one pattern.  Openings of one sign, or of a sign that words hold, need a boundary before them."""
    out = []
    for line in _lines(SIGNS):
        before, _, behind = line.partition("~")
        name = r"[A-Za-z][\w.\-]*(?: [\w.\-]+){0,6}" if before.endswith(" ") and not before[0].isalpha() else r"[A-Za-z]\w*"
        start, end = re.escape(before.strip()), re.escape(behind.strip())
        weak = len(before.strip()) == 1 or before[0] in "_$#"
        blank = r"\s*" if before.endswith(" ") else ""
        if before == "{":
            name = r"[A-Za-z]{3,}(?:_[A-Za-z]+)*"
        tail = r"(?!\})" if behind == "}" and before == "{" else r"(?!\w)" if before[0] == "_" else ""
        out.append((r"(?<![\w\\${#%])" if weak else r"(?<!\w)" if before[0].isalpha() else "") + f"(?i:{start}){blank}{name}{blank}{end}{tail}")
    return re.compile("|".join(sorted(out, key=len, reverse=True)))


class ResidueIndex:
    """The inverted index over the exemplars, with weights from the corpus."""

    def __init__(self, document_frequency: dict[str, int], n_documents: int, labelled: list[tuple[str, list[str], int]] | None = None):
        labelled = exemplars() if labelled is None else labelled
        idf = lambda w: math.log((n_documents + 1) / (document_frequency.get(w, 0) + 1)) + 0.1
        self.unknown = math.log(n_documents + 1) + 0.1
        self.entries = []
        self.index: dict[str, list[int]] = defaultdict(list)
        for kind, words, places in labelled:
            weight = {w: idf(w) for w in words}
            total = sum(weight.values())
            self.entries.append((kind, weight, total, places, len(words)))
            # posted under the rarest words: what holds CONTAINMENT of the weight, or so many different words of a paragraph, holds one of them
            e, left = len(self.entries) - 1, (1 - CONTAINMENT) * total
            rarest = sorted(weight, key=lambda w: (-weight[w], w))
            if self._bag(e):
                rarest = rarest[: len(rarest) - self._least(e) + 1]
            for w in rarest:
                self.index[w].append(e)
                left -= weight[w]
                if left < 0 and not self._bag(e):
                    break
        self.signs, self.openers = sign_pattern(), openers()

    def _bag(self, e: int) -> bool:
        return self.entries[e][0] == "paragraph"

    def _least(self, e: int) -> int:
        """Different words of a paragraph of filler that a window has to hold."""
        return FILLER_DISTINCT if len(self.entries[e][1]) > 20 else 2

    def _short_windows(self, words: list[str], e: int) -> list[tuple[int, int]]:
        """Spans that hold CONTAINMENT of an exemplar within its length and places."""
        _, weight, total, places, size = self.entries[e]
        need, width = CONTAINMENT * total, size + 2 * places + 2
        out, open_, seen, have = [], [], {}, 0.0
        for i, w in enumerate(words):
            if w not in weight:
                continue
            open_.append(i)
            seen[w] = seen.get(w, 0) + 1
            have += weight[w] if seen[w] == 1 else 0.0
            while open_ and (i - open_[0] >= width or seen[words[open_[0]]] > 1):
                first = words[open_.pop(0)]
                seen[first] -= 1
                have -= weight[first] if not seen[first] else 0.0
            if have >= need - 1e-9:
                if out and open_[0] <= out[-1][1]:
                    out[-1] = (out[-1][0], i + 1)
                else:
                    out.append((open_[0], i + 1))
        return out

    def _bag_windows(self, words: list[str], e: int) -> list[tuple[int, int]]:
        """Spans that a paragraph of filler holds by CONTAINMENT of their weight."""
        weight = self.entries[e][1]
        n = min(FILLER_WINDOW, max(4, len(words)))
        out: list[tuple[int, int]] = []
        for lo in range(len(words) - n + 1):
            part = words[lo : lo + n]
            inside = [w for w in part if w in weight]
            if len(inside) < n // 2 or len(set(inside)) < min(self._least(e), n):
                continue
            got = sum(weight[w] for w in inside)
            if got >= CONTAINMENT * (got + self.unknown * (n - len(inside))):
                if out and lo <= out[-1][1]:
                    out[-1] = (out[-1][0], lo + n)
                else:
                    out.append((lo, lo + n))
        return out

    def passage(self, words: list[str]) -> tuple[str | None, int]:
        """The kind of a passage and the words of it that windows cover; filler also where a long run of it is inside."""
        found = {e for w in set(words) if w in self.index for e in self.index[w]}
        if not found:
            return None, 0
        by_kind: dict[str, set[int]] = defaultdict(set)
        slack: dict[str, int] = defaultdict(int)
        for e in found:
            kind, _, _, places, size = self.entries[e]
            bag, kind = self._bag(e), "filler" if self._bag(e) else kind
            for lo, hi in self._bag_windows(words, e) if bag else self._short_windows(words, e):
                by_kind[kind].update(range(lo, hi))
                slack[kind] = max(slack[kind], 2 * places + (1 if size > 4 else 0))
                if bag and hi - lo >= FILLER_RUN:
                    return "filler", hi - lo
        for kind in sorted(by_kind, key=lambda k: (-len(by_kind[k]), k)):
            covered = by_kind[kind]
            rest = {w for i, w in enumerate(words) if i not in covered}
            if len(rest) <= slack[kind] or len(covered) >= CONTAINMENT * len(words):
                return kind, len(covered)
        return None, 0

    def kind_of(self, text: str, words: list[str], valueless: bool) -> tuple[str | None, int]:
        """The kind of a line or sentence, with its covered words."""
        kind, n = self.passage(words)
        if kind is None and valueless and _EMPTY.search(text):
            kind, n = self.passage(words_of(_EMPTY.sub(" emptyvalue ", text)))
        return kind, n

    def classify(self, text: str) -> tuple[str | None, list[list[str]]]:
        """The kind of residue of a text, None for a real one; and, of an error page, the lines of it that may be furniture as (line, words)."""
        shown = _FENCE.sub("\n", text) if "```" in text or "~~~" in text else text
        if "`" in shown:
            shown = _INLINE.sub(" ", shown)
        low = shown.lower()
        if any(x in low for x in self.openers):
            for m in self.signs.finditer(shown):
                quoted = shown[: m.start()].rstrip()[-1:] in set("\"“'‘") and shown[m.end() :].lstrip()[:1] in set("\"”'’")
                if not quoted and not _DUNDER.fullmatch(m.group()):
                    return "marker", []
        if "[object object]" in low and _OBJECT.search(shown):
            return "empty", []
        valueless = bool(_EMPTY.search(shown))
        found: set[str] = set()
        notice = story = 0
        titles: list[list[str]] = []
        for line in shown.split("\n"):
            bare = line.strip()
            words = words_of(bare) if bare else []
            if not words or bare.startswith("©"):
                continue
            ends = bool(_SENTENCE_END.search(bare))
            kind, n = self.kind_of(bare, words, valueless)
            if kind == "error":
                notice += len(words)
                continue
            if kind:
                found.add(kind)
                continue
            parts = [p for p in _SENTENCES.split(bare) if p.strip()] if ends or len(words) > 12 else [bare]
            for p in parts:
                w = words_of(p) if len(parts) > 1 else words
                k, n = self.kind_of(p, w, valueless) if len(parts) > 1 else (None, 0)
                if k == "error":
                    notice += len(w)
                elif k:
                    found.add(k)
                elif w and len(w) <= 14 and len(parts) == 1 and not ends:
                    titles.append([" ".join(w), *w])
                else:
                    story += len(w)
        for kind in ("empty", "filler"):
            if kind in found:
                return kind, []
        if notice and story <= STORY_SHARE * notice:
            return "error", titles if len(titles) > MAX_TITLES else []
        return None, []


def _classify(document_frequency: dict[str, int], n_documents: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ResidueIndex(document_frequency, n_documents)
        for b in batches:
            ks, kinds, titles = [], [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                kind, lines = index.classify(t)
                if kind:
                    ks.append(k)
                    kinds.append(kind)
                    titles.append(lines)
            yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int64()), pa.array(kinds, pa.string()), pa.array(titles, pa.list_(pa.list_(pa.string())))], names=["k", "kind", "titles"])

    return run


def _words(text: str):
    return F.array_distinct(F.split(F.lower(text), r"[^\p{L}]+"))


def _furniture_words(slim: DataFrame) -> DataFrame:
    """The words of the short lines that MIN_DOCUMENTS documents repeat, one line a row."""
    lines = slim.select("k", F.explode(F.split("t", r"\n")).alias("line")).where(F.length("line") <= 60)
    lines = lines.select("k", F.btrim(F.regexp_replace(F.lower("line"), r"[^\p{L}]+", " ")).alias("w")).where((F.col("w") != "") & (F.length("w") - F.length(F.translate("w", " ", "")) < 3))
    return lines.distinct().groupBy("w").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_DOCUMENTS).select("w")


def residue(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and kind of every text that is residue."""
    slim = df.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t")).where(F.col(text).isNotNull())
    # document frequencies over the whole corpus, of the words of the exemplars only: a bounded table
    found = slim.select(F.explode(F.array_intersect(_words("t"), F.array(*map(F.lit, vocabulary())))).alias("w"))
    frequency = {r["w"]: r["n"] for r in found.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_documents = slim.count()
    # an empty value is a word too
    keys = sorted({*ResidueIndex(frequency, n_documents).index, "none", "nan", "undefined", "null"})

    def looked_up(low):
        signs = reduce(lambda x, y: x | y, [F.contains(low, F.lit(x)) for x in [*openers(), "[object object]"]])
        return signs | F.arrays_overlap(F.split(low, r"[^\p{L}]+"), F.array(*map(F.lit, keys)))

    may = slim.where(bound(F.lower("t"), looked_up))
    got = materialize(may.mapInArrow(_classify(frequency, n_documents), "k long, kind string, titles array<array<string>>"), "residue")
    sure = got.where(F.size("titles") == 0).select("k", "kind")
    # error pages among many lines: the lines have to be furniture, or made of its words
    open_ = got.where(F.size("titles") > 0)
    if open_.isEmpty():
        return sure.withColumnRenamed("k", key)
    lines = open_.select("k", F.posexplode("titles").alias("no", "words"))
    each = lines.select("k", "no", (F.size("words") - 1).alias("n"), F.posexplode("words").alias("at", "w"))
    hit = each.join(_furniture_words(slim).withColumn("hit", F.lit(1)), "w", "left")
    per = hit.groupBy("k", "no", "n").agg(F.max(F.when(F.col("at") == 0, F.col("hit"))).alias("whole"), F.sum(F.when(F.col("at") > 0, F.col("hit"))).alias("parts"))
    own = per.groupBy("k").agg(F.sum((F.col("whole").isNull() & (F.coalesce("parts", F.lit(0)) < F.col("n"))).cast("int")).alias("own"))
    late = open_.select("k", "kind").join(own.where(F.col("own") <= MAX_TITLES).select("k"), "k", "left_semi")
    return sure.unionByName(late).withColumnRenamed("k", key)
