"""Main text of web pages by composite text density.

Each page becomes a tree of its elements.  Elements that name themselves as something else than the article (menus, headers,
footers, sidebars, notices, adverts, forms, comments, by tag, role, class or id) are cut off first.  Of every other node:

    density = C / T x log(C / LC x T / LT) / log(b),    b = ln(C x LC / (C - LC) + C x LCb / Cb + e), but e at least

with its characters C and tags T, those of its links LC and LT (each 1 at least), and the page's own LCb and Cb: characters
a tag, less where links hold them.  Where a page has no links it is C / T.  b's bound keeps texts beside few links from being
blown up.  A run of text between elements counts as a node of one tag.  A node's sum is that of its children's densities.

The node of the greatest sum (the first of equals) is the article's.  The least density on the path from it to the body is
the threshold: what else stands under the path's nodes and is at least as dense is article too, if it lies under the same
parent (other than the body) or its sum is a tenth of the article's or more.  Where <article> or <main> hold a fifth of the
text or more, the node is sought in them, and the one around it is taken whole.  If no title is in it, headings that stand
before it, beside the path, are its titles.

The text is that of the chosen nodes in page order: character references decoded, a space where a block or a line ends, white
space runs made one space, trimmed.  Nothing is cut by length.

Defined results: a null or empty html, or one without text, has the empty text.  Broken markup is read as browsers do:
unclosed paragraphs, cells and list items end where the next begins, unclosed elements at their parent's end, an unclosed
script at the end of the page.  Repeated rows each give a row; null ids and urls stay null; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from math import e, log

import pandas as pd
from pyspark.sql import DataFrame

from gleaner.llm.common import small_batches

MARKUP = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</(?![a-zA-Z])[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^=>]++|=\s*+"[^"]*"|=\s*+'[^']*'|=)*+)(?:>|\Z)""", re.S
)
CUES = re.compile(r"""(?:^|[\s"'/])(class|id|role|itemprop|itemtype)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

# Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What a start tag ends, and the elements beyond which it doesn't look for that.
ENDS = (
    {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
    | dict.fromkeys(("tbody", "thead", "tfoot"), ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}))
    | dict.fromkeys(BLOCKS - {"li", "dt", "dd", "option", "tr", "td", "th", "tbody", "thead", "tfoot", "body", "head", "html", "legend", "optgroup"}, ({"p"}, {"td", "th", "table", "button", "caption"}))
)

# What names an element as something else than the article.
CUT_TAGS = frozenset("nav footer aside form dialog noscript button select label svg canvas audio video object applet template datalist".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
CUT_WORDS = frozenset(
    """nav navbar navigation navi menu menubar submenu breadcrumb breadcrumbs pagination pager masthead topbar header footer colophon copyright sidebar sidenav
    cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay newsletter subscribe subscription signup login paywall
    ad ads adv advert adverts advertisement advertisements advertising adsense adslot adbox adunit banner sponsor sponsored sponsors promo promos promotion promoted
    share sharing social related recommended recommendations trending search searchbox
    comment comments disqus respond responses replies discussion""".split()
)
COMMENT_WORDS = frozenset("comment comments disqus respond responses replies discussion".split())
#: Words that stand first in names of an article's own parts, and words that speak of a neighbour.
OWN_WORDS, SPEAKING_WORDS = frozenset("article post entry story content page section".split()), frozenset("with has no without category tag".split())


def cue(attributes: str, inside: bool) -> str:
    """'comments' or 'other' if the attributes name the element as something else than the article, else ''."""
    found = ""
    for name, *values in CUES.findall(attributes):
        value = unescape("".join(values))
        if name.lower() == "role" and value.strip().lower() in CUT_ROLES:
            found = found or "other"
        elif name.lower() in ("itemprop", "itemtype"):
            if value.lower().rstrip("/").endswith("comment"):
                return "comments"
        elif name.lower() in ("class", "id"):
            for token in value.split():
                words = [w.lower() for w in PIECES.findall(token)]
                if not words or SPEAKING_WORDS & set(words):
                    continue
                ends = {words[0], words[-1]} | ({"sidebar"} if words[:2] == ["side", "bar"] else set())
                if "header" in ends and (inside or words[0] in OWN_WORDS):
                    ends.discard("header")
                if COMMENT_WORDS & ends:
                    return "comments"
                if CUT_WORDS & ends:
                    found = "other"
    return found


class Page:
    """Elements in page order: parent, tag, and the texts and breaks under each; cut ones are marked."""

    def __init__(self, html: str) -> None:
        self.parent, self.tag, self.cues = [-1], ["body"], [""]
        self.pieces: list[tuple[int, str]] = []  # (element, text or a space where something ends)
        self._read(html)

    def _read(self, html: str) -> None:
        open_, count, at, whole = [0], {}, 0, len(html)
        inside = 0  # depth in article or main

        def close(to: int) -> None:
            nonlocal inside
            while len(open_) > to:
                tag = self.tag[open_.pop()]
                count[tag] -= 1
                inside -= tag in ("article", "main")
                if tag in BLOCKS:
                    self.pieces.append((open_[-1], " "))

        while at < whole:
            m = MARKUP.search(html, at)
            text = html[at : m.start() if m else whole]
            if text:
                self.pieces.append((open_[-1], unescape(text)))
            if not m:
                break
            at, tag = m.end(), (m[2] or "").lower()
            if not tag or tag in ("html", "head", "body"):
                continue
            if m[1]:
                if count.get(tag):
                    for i in range(len(open_) - 1, 0, -1):
                        up = self.tag[open_[i]]
                        if up == tag:
                            close(i)
                            break
                        if (up in ("td", "th") and tag not in ("tr", "table", "tbody", "thead", "tfoot")) or (up in BLOCKS and tag not in BLOCKS):
                            break
                if tag == "br":
                    self.pieces.append((open_[-1], " "))
                continue
            if tag in RAW:
                over = re.compile(rf"</{tag}(?![^\s/>])[^>]*>", re.I).search(html, at)
                at = over.end() if over else whole
                continue
            ends, beyond = ENDS.get(tag, ((), ()))
            if any(count.get(x) for x in ends):
                for i in range(len(open_) - 1, 0, -1):
                    up = self.tag[open_[i]]
                    if up in beyond:
                        break
                    if up in ends:
                        close(i)
                        if tag not in ("tr", "tbody", "thead", "tfoot"):
                            break
            if tag in BLOCKS or tag == "br":
                self.pieces.append((open_[-1], " "))
            self.parent.append(open_[-1])
            self.tag.append(tag)
            cut = "other" if tag in CUT_TAGS or (tag == "header" and not inside) else ""
            self.cues.append(cue(m[3], inside > 0) or cut if m[3] else cut)
            if tag not in VOID and not (m[3].endswith("/") and tag in ("svg", "path", "use")):
                open_.append(len(self.tag) - 1)
                count[tag] = count.get(tag, 0) + 1
                inside += tag in ("article", "main")

    def cut(self) -> list[bool]:
        """Which elements are no article's.  One stays in spite of its names if it holds an article or main, a title, or the most of a page that has neither."""
        n, articles = len(self.tag), self.tag.count("article")
        holds, titled, prose, paragraphs = [0] * n, [0] * n, [0] * n, [0] * n
        for i, text in self.pieces:
            prose[i] += len(text) * (self.tag[i] != "a")
        for i in range(n - 1, 0, -1):
            up = self.parent[i]
            holds[up] += holds[i] + (not self.cues[i] and self.tag[i] in ("article", "main"))
            titled[up] += titled[i] + (self.tag[i] == "h1")
            prose[up], paragraphs[up] = prose[up] + prose[i], paragraphs[up] + paragraphs[i] + (self.tag[i] == "p")
        gone = [False] * n
        for i in range(1, n):
            gone[i] = gone[self.parent[i]]
            if self.cues[i] and not gone[i] and self.tag[i] != "main":
                tag, comments = self.tag[i], self.cues[i] == "comments"
                most = 2 * prose[i] > prose[0] and paragraphs[i] > 2 and not holds[0] and not comments
                if tag == "article":
                    gone[i] = articles > 1
                elif tag in CUT_TAGS and tag != "form":
                    gone[i] = not holds[i]
                elif tag == "header":
                    gone[i] = not (holds[i] or most)
                else:
                    gone[i] = not (holds[i] or most or (titled[i] and not comments))
        return gone

    def text(self) -> str:
        gone, n = self.cut(), len(self.tag)
        chars, linked, tags, links = [0] * n, [0] * n, [0] * n, [0] * n
        page_chars = page_linked = 0
        in_link, runs = [False] * n, [[] for _ in range(n)]
        for i in range(1, n):
            in_link[i] = in_link[self.parent[i]] or self.tag[i] == "a"
        for i, text in self.pieces:
            size = len(" ".join(text.split()))
            page_chars += size
            page_linked += size * in_link[i]
            if size and not gone[i]:
                chars[i] += size
                linked[i] += size * in_link[i]
                runs[i].append(size)
        for i in range(n - 1, 0, -1):
            if not gone[i]:
                up = self.parent[i]
                chars[up], linked[up] = chars[up] + chars[i], linked[up] + linked[i]
                tags[up], links[up] = tags[up] + tags[i] + 1, links[up] + links[i] + (self.tag[i] == "a")

        def density(c: int, lc: int, t: int, lt: int) -> float:
            if not c or not page_linked:
                return c / max(1, t)
            base = max(e, log(c * lc / max(1, c - lc) + c * page_linked / page_chars + e))
            return c / max(1, t) * max(0.0, log(c / max(1, lc) * max(1, t) / max(1, lt))) / log(base)

        dense = [density(*x) if not gone[i] else 0.0 for i, x in enumerate(zip(chars, linked, tags, links, strict=True))]
        own = [sum(density(c, c * in_link[i], 1, int(in_link[i])) for c in runs[i]) for i in range(n)]
        sums = own.copy()
        for i in range(1, n):
            sums[self.parent[i]] += dense[i]
        if not chars[0]:
            return ""
        marked = [False] * n  # lies in an article or main
        for i in range(1, n):
            marked[i] = not gone[i] and (marked[self.parent[i]] or self.tag[i] in ("article", "main"))
        share = sum(size for i in range(n) if marked[i] for size in runs[i])
        found = max(range(n), key=lambda i: (sums[i] if not gone[i] and (marked[i] or 5 * share < chars[0]) else -1.0, -i))
        return self._joined(self._chosen(found, gone, dense, sums, own))

    def _chosen(self, found: int, gone: list[bool], dense: list[float], sums: list[float], own: list[float]) -> list[bool]:
        """Which elements' own texts make up the article."""
        n, path = len(self.tag), [found]
        while path[-1]:
            path.append(self.parent[path[-1]])
        threshold, on_path, near = min(dense[i] for i in path), set(path), {self.parent[found]} - {0, -1}
        enclosing = [i for i in path if self.tag[i] == "article"] or [i for i in path if self.tag[i] == "main"]
        root, kept = enclosing[-1] if enclosing else found, [False] * n
        kept[root] = True
        for i in range(1, n):
            up = self.parent[i]
            beside = not enclosing and i not in on_path and dense[i] >= threshold and (up in near or sums[i] >= sums[found] / 10)
            kept[i] = not gone[i] and (kept[i] or kept[up] or beside)
        if not any(k and t == "h1" for k, t in zip(kept, self.tag, strict=True)):
            for i in range(1, root):
                up = self.parent[i]
                beside = up in on_path or self.parent[up] in on_path
                kept[i] = kept[i] or kept[up] or (not gone[i] and beside and self.tag[i] in (HEADINGS if up else {"h1"}))
        if not enclosing:
            for i in path:  # texts that stand in the path's nodes themselves
                kept[i] = kept[i] or own[i] >= max(threshold, sums[found] / 10)
        return kept

    def _joined(self, kept: list[bool]) -> str:
        return " ".join("".join(text if kept[i] else " " for i, text in self.pieces).split())


def main_text(html: str | None) -> str:
    return Page(html).text() if html else ""


def main_texts(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars) for each row of pages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            text = [main_text(h) for h in rows[html]]
            yield pd.DataFrame({key: rows[key], url: rows[url], "text": text, "n_chars": [len(t) for t in text]})

    small_batches(pages.sparkSession)
    kinds = dict(pages.dtypes)
    plain = pages.select(pages[key].cast("string"), pages[url].cast("string"), pages[html].cast("string"))
    found = plain.mapInPandas(run, f"`{key}` string, `{url}` string, text string, n_chars long")
    return found.withColumn(key, found[key].cast(kinds[key]))
