"""Newsletter HTML to text, sections, links and images: one parse, one walk per result.

Defined results: null and empty pages give one empty section; a page without
headings is one section; broken nesting is read as the tree builder reads it.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import parse_qsl, urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galley.functions import rules
from galley.functions.html_tree import COMMENT, TEXT, Document

SECTION = "struct<section_key:string,order_index:int,heading:string,text:string,links:array<string>,image_urls:array<string>>"
PAGE = f"struct<plain_text:string,plain_text_chars:int,links:array<string>,image_urls:array<string>,original_url:string,sections:array<{SECTION}>>"


def absolute(base: str, href: str | None) -> str | None:
    """The http(s) address a reference means, or None."""
    h = (href or "").strip()
    if not h or h[0] == "#":
        return None
    try:
        url = urljoin(base, h)
        return url.strip() if urlsplit(url).scheme in ("http", "https") else None
    except ValueError:
        return None


def _parts(url: str) -> tuple[str, str, str]:
    try:
        u = urlsplit(url)
    except ValueError:
        return "", "", ""
    return u.netloc.lower(), u.path.lower(), u.query.lower()


def _has(text: str, needles) -> bool:
    return any(n in text for n in needles)


def tracking_query(url: str) -> bool:
    pairs = parse_qsl(_parts(url)[2], keep_blank_values=True)
    bad = sum(k in rules.TRACKING_NAMES or k.startswith(rules.TRACKING_PREFIXES) for k, _ in pairs)
    return bool(pairs) and bad >= max(2, len(pairs))


def noise_link(url: str, anchor: str) -> bool:
    host, path, query = _parts(url)
    return (
        _has(path, rules.UNSUBSCRIBE_PATHS)
        or _has(query, rules.UNSUBSCRIBE_QUERIES)
        or anchor.strip().lower() in rules.UNSUBSCRIBE_ANCHORS
        or _has(host + path, rules.TRACKING_HOSTS)
        or _has(url.lower(), rules.SOCIAL_FRAGMENTS)
    )


def dimension(value: str | None) -> int | None:
    """The leading number of a width or height, None for nothing or nothing above 0."""
    digits, dots = "", 0
    for c in (value or "").strip():
        if c == "." and not dots:
            dots = 1
        elif not c.isdigit():
            break
        digits += c
    try:
        n = float(digits)
    except ValueError:
        return None
    return int(n) if n > 0 else None


def widest(srcset: str) -> str | None:
    """The candidate of the greatest ``w`` in a srcset; the first one on ties."""
    best: tuple[int, str] | None = None
    for part in srcset.split(","):
        words = part.split()
        if not words:
            continue
        width = 1
        for w in words[1:]:
            if w.endswith("w") and w[:-1].lstrip("-").isdigit():
                width = int(w[:-1]) or 1
        if best is None or width > best[0]:
            best = (width, words[0])
    return best[1] if best else None


def collapse_lines(raw: str) -> list[str]:
    """Blocks of lines between blank ones, each joined by blanks."""
    out: list[str] = []
    block: list[str] = []
    for line in [*(x.strip() for x in raw.split("\n")), ""]:
        if line:
            block.append(line)
        elif block:
            out.append(" ".join(block))
            block = []
    return out


def tidy(raw: str) -> str:
    """Collapsed lines without lone tracking addresses and short lines with footer phrases."""
    kept = []
    for line in "\n".join(collapse_lines(raw)).splitlines():
        s = line.strip()
        low = s.lower()
        if not s or (low.startswith(("http://", "https://")) and tracking_query(s)) or (len(s) <= rules.LINE_CHARS and _has(low, rules.FOOTER_PHRASES)):
            continue
        kept.append(s.replace("\xa0", " ").rstrip())
    return "\n".join(kept).strip()


class Page:
    """Results over one parsed document."""

    def __init__(self, html: str, base_hint: str | None = None):
        self.doc = Document(html)
        self.base = (base_hint or "").strip() or self._own_base()

    def _own_base(self) -> str:
        d = self.doc
        for i in d.nodes():
            if d.name[i] == "base" and "href" in d.attrs[i]:
                href = d.attrs[i]["href"].strip()
                url = absolute("", href) or (absolute("https:", href) if href.startswith("//") else None)
                if url:
                    return url
        return self._canonical("") or ""

    def _canonical(self, base: str) -> str | None:
        d = self.doc
        for i in d.nodes():
            if d.name[i] == "link" and "canonical" in d.attrs[i].get("rel", "").lower().split() and d.attrs[i].get("href"):
                return absolute(base, d.attrs[i]["href"])
        return None

    def anchors(self, nodes) -> Iterator[tuple[str, str]]:
        d = self.doc
        for i in nodes:
            if d.name[i] == "a" and "href" in d.attrs[i]:
                yield d.attrs[i]["href"], d.visible(i)

    def original_url(self) -> str | None:
        if (c := self._canonical(self.base)) is not None:
            return c
        anchors = list(self.anchors(self.doc.nodes()))
        for href, text in anchors:
            if _has(text.casefold(), [p.casefold() for p in rules.VIEW_IN_BROWSER_PHRASES]):
                if (url := absolute(self.base, href)) is not None:
                    return url
                break
        for href, text in anchors:
            url = absolute(self.base, href)
            if url and not noise_link(url, text) and not tracking_query(url):
                return url
        return None

    def links(self, nodes) -> list[str]:
        found = (absolute(self.base, h) and (absolute(self.base, h), t) for h, t in self.anchors(nodes))
        return list(dict.fromkeys(u for u, t in filter(None, found) if not noise_link(u, t)))

    def images(self, nodes) -> list[str]:
        d, ranked = self.doc, []
        for i in nodes:
            if d.name[i] != "img":
                continue
            a = d.attrs[i]
            w, h = dimension(a.get("width")), dimension(a.get("height"))
            known = w is not None and h is not None
            if known and (max(w, h) <= rules.MAX_PIXEL_EDGE or (min(w, h) < rules.MIN_IMAGE_EDGE and max(w, h) < 6 * rules.MIN_IMAGE_EDGE)):
                continue
            for raw in filter(None, (a.get("src", "").strip(), widest(a.get("srcset", "")))):
                url = absolute(self.base, raw)
                if url is None:
                    continue
                low = url.lower()
                if _has(low, rules.SOCIAL_FRAGMENTS) or _has(f"{low} {a.get('alt', '').lower()}", rules.LOGO_FRAGMENTS) or _has(low.replace("×", "x"), rules.PIXEL_FRAGMENTS):
                    continue
                ranked.append((-(max(1, w * h) if known else rules.DEFAULT_IMAGE_AREA), url))
        return list(dict.fromkeys(u for _, u in sorted(ranked)))

    def prune(self) -> None:
        """Takes comments, code, sponsors and footers out."""
        d = self.doc
        for i in d.nodes():
            name = d.name[i]
            if name in (COMMENT, "script", "style", "noscript", "meta"):
                d.drop(i)
            elif name != "link" and not name.startswith("#"):
                a = d.attrs[i]
                blob = " ".join((name, *d.classes(i), a.get("id", "").lower(), a.get("role", "").lower()))
                footer = a.get("role", "").strip().lower() == "contentinfo" or _has(blob, rules.FOOTER_FRAGMENTS) or _has(blob, rules.SPONSOR_FRAGMENTS)
                if footer or (name == "a" and "mailto:list-unsubscribe" in a.get("href", "").lower()):
                    d.drop(i)

    def plain_text(self) -> str:
        """The pruned page as text: alternative texts of images, ``- `` before list items."""
        d = self.doc
        lines: list[str] = []
        skip = 0
        for i in d.nodes():
            if i < skip:
                continue
            name = d.name[i]
            if name == TEXT:
                piece = d.text[i].strip()
            elif name == "img":
                piece = d.attrs[i].get("alt", "").strip()
            elif name == "a":
                piece, skip = self._inline(i), d.end[i]
            elif name == "li":
                piece, skip = f"- {self._inline(i)}", d.end[i]
            else:
                continue
            if piece:
                lines.append(piece)
        return tidy("\n".join(lines))

    def _inline(self, node: int) -> str:
        d = self.doc
        parts = []
        for i in d.nodes(node, d.end[node]):
            piece = d.text[i] if d.name[i] == TEXT else d.attrs[i].get("alt", "") if d.name[i] == "img" else ""
            if piece.strip():
                parts.append(piece.strip())
        return " ".join(" ".join(parts).split())

    def is_heading(self, i: int) -> bool:
        d, name = self.doc, self.doc.name[i]
        if name.startswith("#"):
            return False
        if (len(name) == 2 and name[0] == "h" and name[1] in "123456") or (len(name) == 5 and name.startswith("md-h") and name[4].isdigit()):
            return True
        role = d.attrs[i].get("role", "").lower() == "heading" and len(d.visible(i).replace(" ", "")) >= 3
        return role or _has(" ".join(d.classes(i)), rules.HEADING_CLASSES)

    def sections(self) -> list[dict]:
        """The slices between headings of the pruned page, a preamble before the first if it has text."""
        d = self.doc
        body = next((i for i in d.nodes() if d.name[i] == "body"), -1)
        heads = [i for i in d.nodes(body + 1) if self.is_heading(i) and len(d.visible(i)) >= 2]
        if not heads:
            nodes = list(d.nodes())
            return [{"section_key": "s0", "order_index": 0, "heading": None, "text": self.plain_text(), "links": self.links(nodes), "image_urls": self.images(nodes)}]
        out = []
        for at, (first, last) in enumerate(zip([body + 1, *heads], [*heads, len(d.name)], strict=True)):
            nodes = list(d.nodes(first, last))
            text = tidy("\n".join(p for i in nodes if d.name[i] == TEXT and (p := d.text[i].strip())))
            if at or text:
                out.append({"section_key": f"s{len(out)}", "order_index": len(out), "heading": d.visible(first) if at else None, "text": text, "links": self.links(nodes), "image_urls": self.images(nodes)})
        return out


def parse_page(html: str | None, base_hint: str | None = None) -> dict:
    """All results of one page."""
    page = Page(html or "", base_hint)
    whole = list(page.doc.nodes())
    out = {"original_url": page.original_url(), "links": page.links(whole), "image_urls": page.images(whole)}
    page.prune()
    text = page.plain_text()
    return out | {"plain_text": text, "plain_text_chars": len(text), "sections": page.sections()}


def parse_pages(df: DataFrame, key: str, html: str, base_hint: str | None = None) -> DataFrame:
    """``key`` and the struct ``page`` of every row: one Python boundary, one parse per page."""
    slim = df.select(F.col(key), F.col(html).alias("_html"), (F.col(base_hint) if base_hint else F.lit(None).cast("string")).alias("_base"))
    schema = f"{key} {dict(df.dtypes)[key]}, plain_text string, plain_text_chars int, links array<string>, image_urls array<string>, original_url string, sections array<{SECTION}>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["plain_text", "plain_text_chars", "links", "image_urls", "original_url", "sections"]
        for f in frames:
            rows = [parse_page(h if isinstance(h, str) else "", b if isinstance(b, str) else None) for h, b in zip(f["_html"], f["_base"], strict=True)]
            yield pd.DataFrame({key: f[key], **{n: [r[n] for r in rows] for n in names}})

    return slim.mapInPandas(run, schema)
