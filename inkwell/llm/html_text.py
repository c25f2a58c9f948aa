"""Operator 7: main text of web pages by line-block distribution."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

# Elements whose content is never main text.
NOT_TEXT = frozenset("head script style noscript template svg iframe object button select textarea option".split())
# Elements of side matter, unless they hold most of the text or an article: whole pages stand in a form, a nav may never be closed.
ASIDE = frozenset("form nav header footer aside dialog menu".split())
# Elements that begin a new line; all others run on within it.
BLOCK = (
    NOT_TEXT
    | ASIDE
    | frozenset(
        "html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th thead tbody tfoot caption"
        " blockquote pre br hr address details summary figure figcaption center fieldset".split()
    )
)
VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
# Words by which an element names itself a notice, an advert, comments or navigation.
SIDE = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr"
    " notice popup modal newsletter subscribe subscription share sharing social related recommended recommendations sidebar"
    " nav navbar navigation menu breadcrumb breadcrumbs footer header masthead login signup search widget pagination pager"
    " toolbar skip".split()
)
COMMENTS = frozenset("comment comments commentlist respond replies disqus reactions".split())
CONTENT = frozenset("article content post entry story main body text section chapter title heading headline editor paragraph".split())
# Words that an article's own parts are named by as well.
EITHER = frozenset("header masthead widget search notice".split())
# A name that says that such a thing is there or not, as in has-sidebar, names no side matter.
STATES = frozenset("has have no not with without is hide show".split())

_QUOTED = r"""(?:"[^"]*+"|'[^']*+')(?=\s|/?>|\Z)"""
# An attribute's value: in quotes if the closing one ends it, else up to white space or the tag's end, quotes included.
_VALUE = rf"(?:{_QUOTED}|[^\s>]*+)"
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    rf"""|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"'=]++|=\s*+{_VALUE}|["'])*+)(?:>|\Z)""",
    re.S,
)
_ATTR = re.compile(rf"(?:^|[\s/\"'])(class|id|role|style|hidden|aria-hidden)(?=[\s=/>]|\Z)(?:\s*+=\s*+({_VALUE}))?", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_RAW = {n: re.compile(rf"</{n}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for n in ("script", "style", "textarea", "template", "title")}


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'") for k, v in reversed(_ATTR.findall(raw))} if raw.strip(" /") else {}


_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_A-Za-z]+")


def named_parts(value: str) -> list[list[str]]:
    """The words of each name in a class, id or role: parted by hyphens, underscores, digits and capitals within a name."""
    return [[p.lower() for p in _PARTS.findall(name)] for name in value.split()]


def names_side(value: str) -> bool:
    """Whether a class, id or role names side matter: by any word of a name, or by all of them as one word.

    An article's header or a text widget is none, nor is a name that says whether side matter is there.
    """
    for parts in named_parts(value):
        if not parts or parts[0] in STATES:
            continue
        found = {*parts, "".join(parts)} & (SIDE | COMMENTS)
        if found - EITHER or (found and not CONTENT.intersection(parts)):
            return True
    return False


def _hidden(a: dict[str, str]) -> bool:
    return "hidden" in a or a.get("aria-hidden", "").lower() == "true" or bool(_HIDDEN.search(a.get("style", "")))


class Lines:
    """A page as lines between block elements: each a list of (piece of text, in a link, in an article, innermost side element or -1)."""

    def __init__(self, page: str):
        self.lines: list[list[tuple[str, bool, bool, int]]] = [[]]
        # of each element that may be side matter: the one around it, whether it names itself comments, whether it holds an article
        self.parent: list[int] = []
        self.comments: list[bool] = []
        self.wraps: list[bool] = []
        self._read(page)

    def _read(self, page: str) -> None:
        # open elements: (name, whether it is block, the side element around it if it is one, never main text)
        stack: list[tuple[str, bool, int | None, bool]] = []
        around = -1
        never = inside = at = 0
        in_link = False

        def add(piece: str) -> None:
            if piece and not never:
                self.lines[-1].append((piece, in_link, inside > 0, around))

        while m := _TAG.search(page, at):
            add(page[at : m.start()])
            at = m.end()
            if not m[2]:
                continue
            name, closing = m[2].lower(), bool(m[1])
            block = name in BLOCK
            if block:
                if self.lines[-1]:
                    self.lines.append([])
                in_link = False
            if name in _RAW and not closing:
                after = _RAW[name].search(page, at)
                at = after.end() if after else len(page)
                continue
            if name == "a":
                in_link = not closing
            if name in VOID or m[3].endswith("/"):
                continue
            if closing:
                if any(n == name for n, *_ in stack):
                    while True:
                        n, _, outer, out = stack.pop()
                        never -= out
                        inside -= n in ("article", "main")
                        if outer is not None:
                            around = outer
                        if n == name:
                            break
                continue
            a = _attributes(m[3])
            out = name in NOT_TEXT or (_hidden(a) and name not in ("html", "body"))
            names = [a.get(k, "") for k in ("class", "id", "role")]
            side = not out and name not in ("html", "body", "main") and ((name in ASIDE and not (name == "header" and inside)) or any(map(names_side, names)))
            outer = around if side else None
            if side:
                self.parent.append(around)
                self.comments.append(any(COMMENTS.intersection(parts) for v in names for parts in named_parts(v)))
                self.wraps.append(False)
                around = len(self.parent) - 1
            if block or out or side or (stack and not stack[-1][1]):
                if name in ("article", "main"):
                    inside += 1
                    if around >= 0:
                        self.wraps[around] = True
                never += out
                stack.append((name, block, outer, out))
        add(page[at:])

    def side(self) -> list[bool]:
        """Which of the elements that may be side matter are, or lie in one that is.

        None is that holds an article element, or most of the articles' text, or of the page's where there is no article. Text
        in links doesn't count, unless there is no other: a menu may be longer than the article. Comments may hold more than the article does.
        """
        n = len(self.parent)
        total, own = [[0, 0], [0, 0]], [[[0, 0], [0, 0]] for _ in range(n)]  # without and with links: outside and inside articles
        for pieces in self.lines:
            for piece, link, inside, i in pieces:
                size = len(piece.strip())
                for sums in (total, *([own[i]] if i >= 0 else [])):
                    sums[1][inside] += size
                    sums[0][inside] += size * (not link)
        for i in range(n - 1, -1, -1):  # what lies within comes after what is around it
            if (p := self.parent[i]) >= 0:
                self.wraps[p] |= self.wraps[i]
                own[p] = [[x + y for x, y in zip(a, b, strict=True)] for a, b in zip(own[p], own[i], strict=True)]
        k = int(not any(total[0]))
        place = int(bool(total[k][1]))
        out: list[bool] = []
        for i in range(n):
            most = own[i][k][place] > (0.9 if self.comments[i] else 0.5) * total[k][place]
            out.append((self.parent[i] >= 0 and out[self.parent[i]]) or not (most or self.wraps[i]))
        return out

    def blocks(self) -> list[tuple[str, float, bool]]:
        """(text, share of it in links, lies in an article) of each line with text; side matter between lines is one empty line."""
        side, out = self.side(), []
        for pieces in self.lines:
            kept = [p for p in pieces if p[3] < 0 or not side[p[3]]]
            text = " ".join(html.unescape("".join(p[0] for p in kept)).split())
            if text:
                size = sum(len(p[0].strip()) for p in kept)
                out.append((text, sum(len(p[0].strip()) for p in kept if p[1]) / max(1, size), any(p[2] for p in kept)))
            elif len(kept) < len(pieces) and out and out[-1][0]:
                out.append(("", 0.0, False))
        return out


_SENTENCE = re.compile(r"[.!?…。！？؟।][\"'”’»)\]]*$")


def main_blocks(lines: list[tuple[str, float, bool]], window: int = 3, surge: int = 40) -> list[str]:
    """The lines between surge and dive of the text lengths summed over sliding windows.

    Lines that are mostly links count as length 0, side matter is an empty line. A run of positive window sums that
    reaches ``surge``, or holds a line that ends as a sentence does, is a text region: it begins where the sums leave 0 and ends where they fall back to it, and all
    lines in it are kept, linked ones too. Where there is none, the run of the largest sum is taken, so short
    articles stay. An article or main element that holds most of the text is the region itself, whole.
    """
    size = [len(t) if links <= 0.5 else 0 for t, links, _ in lines]
    own = [t for t, _, inside in lines if t and inside]
    if 2 * sum(map(len, own)) >= sum(size) and own:
        return own
    if not any(size):
        return own
    width = np.ones(window, int)
    sums = np.convolve(size, width)[window - 1 :]  # of this line and the next ones
    live = np.flatnonzero(sums > 0)
    runs = np.split(live, np.flatnonzero(np.diff(live) > 1) + 1)
    peaks = [sums[r].max() for r in runs]
    least = min(surge, max(peaks))
    keep = {i for i, (t, _, inside) in enumerate(lines) if t and inside}
    for r, p in zip(runs, peaks, strict=True):
        text = [i for i in r.tolist() if size[i]]
        if p >= least or any(_SENTENCE.search(lines[i][0]) for i in text):
            keep.update(i for i in range(text[0], text[-1] + 1) if lines[i][0])
    return [lines[i][0] for i in sorted(keep)]


def extract(page: str | None, window: int = 3, surge: int = 40) -> str:
    return " ".join(main_blocks(Lines(page).blocks(), window, surge)) if page else ""


def html_extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", window: int = 3, surge: int = 40) -> DataFrame:
    """Rows (id, url, text, n_chars) for every page.

    Null or empty html gives an empty text. Character references are decoded, white space in a block becomes one
    space, blocks are joined by one space. Repeated rows give repeated rows; other columns are not read; an empty table
    gives an empty one. The whole page is read, however long.
    """
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [extract(x.as_py(), window, surge) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(F.col(id_col), F.col(url_col).cast("string"), F.col(html_col).cast("string")).mapInArrow(run, f"{id_col} {kind}, {url_col} string, text string, n_chars long")
