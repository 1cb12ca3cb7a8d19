"""A small tolerant HTML tree and its layout-aware text.

The tree builder closes elements that HTML lets authors leave open; the renderer walks the tree without recursion
and writes what a reader would see: blocks on lines of their own with blank lines between paragraphs, list marks,
tables with aligned cells, and nothing of hidden elements.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

#: Fixed values of the HTML standard: elements without content, elements whose content isn't shown, blocks,
#: blocks with blank lines around them, and which start tags close an open element.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
UNSEEN = set("head script style noscript template svg canvas iframe object select option button title textarea".split())
BLOCK = set("address article aside blockquote body dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody tfoot thead tr ul".split())
SPACED = set("p blockquote h1 h2 h3 h4 h5 h6 ul ol dl table pre figure article section".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}, "option": {"option"},
}
HOLDS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}
ENDS_P = BLOCK - {"body", "html", "li", "tr", "tbody", "thead", "tfoot", "dd", "dt"}

_markup = re.compile(r"</?(?:p|div|span|a|br|li|ul|ol|table|tr|td|h[1-6]|html|body|article|section|nav|b|i|em|strong)\b[^<>]*>", re.I)
_hidden = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_space = re.compile(r"\s+")


#: Elements around what isn't the main body of a page.
ASIDE = {"nav", "footer", "aside", "header", "form", "menu"}


class Text(str):
    """A text of the tree with the number of the source line it begins in."""

    line = 0


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None):
        self.tag, self.attrs, self.parent = tag, attrs or {}, parent
        self.children: list[Node | str] = []

    def walk(self):
        """This node and all below it in document order."""
        stack: list[Node] = [self]
        while stack:
            n = stack.pop()
            yield n
            stack += [c for c in reversed(n.children) if isinstance(c, Node)]

    def text(self) -> str:
        """All text below, as it stands."""
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            else:
                stack += reversed(n.children)
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root")

    def _close(self, tags: set[str], until: set[str]) -> None:
        n = self.at
        while n.parent is not None and n.tag not in until:
            if n.tag in tags:
                self.at = n.parent
                return
            n = n.parent

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES:
            for _ in range(3):
                self._close(CLOSES[tag], HOLDS[tag] - CLOSES[tag])
        if tag in ENDS_P:
            self._close({"p"}, {"table", "td", "th", "li", "div", "section", "article", "blockquote"})
        n = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(n)
        if tag not in VOID:
            self.at = n

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.at = self.at.parent

    def handle_endtag(self, tag):
        n = self.at
        while n.parent is not None:
            if n.tag == tag:
                self.at = n.parent
                return
            n = n.parent

    def handle_data(self, data):
        text = Text(data)
        text.line = self.getpos()[0] - 1
        self.at.children.append(text)


def parse(source: str) -> Node:
    b = _Builder()
    try:
        b.feed(source)
        b.close()
    except (AssertionError, ValueError):  # the standard parser gives up on some broken declarations
        b.at.children.append(_space.sub(" ", re.sub(r"<[^<>]*>", " ", source)))
    return b.root


def has_markup(text: str) -> bool:
    """Whether a text is marked up at all: at least two tags of HTML."""
    return "<" in text and len(_markup.findall(text, 0)) >= 2


def visible(n: Node) -> bool:
    a = n.attrs
    return n.tag not in UNSEEN and "hidden" not in a and a.get("aria-hidden") != "true" and not _hidden.search(a.get("style", ""))


def _table(n: Node) -> list[tuple[str, list[int]]]:
    """The rows of a table, cells aligned, with their source lines."""
    rows, of = [], []
    for r in n.walk():
        if r.tag == "tr" and visible(r):
            cells = [render_lines(c, False) for c in r.children if isinstance(c, Node) and c.tag in ("td", "th") and visible(c)]
            rows.append([_space.sub(" ", " ".join(x.text for x in c)).strip() for c in cells])
            of.append([i for c in cells for x in c for i in x])
    width = [max((len(r[i]) for r in rows if i < len(r)), default=0) for i in range(max(map(len, rows), default=0))]
    return [("  ".join(c.ljust(w) for c, w in zip(r, width)).rstrip(), x) for r, x in zip(rows, of)]


class Line(list):
    """A visible line: its source lines, with the text and whether it stands in an element of ASIDE."""

    text = ""
    aside = False


def _sources(text: str) -> list[int]:
    first = getattr(text, "line", 0)
    return [first + i for i, part in enumerate(text.split("\n")) if part and not part.isspace()]


def render_lines(top: Node, tables: bool = True) -> list[Line]:
    """The visible lines of a node, blank ones between spaced blocks. Cells of a table inside a cell run on."""
    lines: list[Line] = []
    text, sources, gap, aside = "", [], False, 0

    def end(blank: bool) -> None:
        nonlocal text, sources, gap
        if text.strip():
            if gap and lines:
                lines.append(Line())
            row = Line(sorted(set(sources)))
            row.text, row.aside = text.strip(), aside > 0
            lines.append(row)
            gap = False
        text, sources = "", []
        gap |= blank

    stack: list[tuple[int, Node | str]] = [(0, top)]
    counts: list[int] = []
    while stack:
        done, n = stack.pop()
        if isinstance(n, str):
            s = _space.sub(" ", n)
            text += s if text and not text.endswith(" ") else s.lstrip()
            sources += _sources(n)
            continue
        if done:
            if n.tag in ("ol", "ul"):
                counts.pop()
            if n.tag in BLOCK:
                end(n.tag in SPACED)
            aside -= n.tag in ASIDE
            continue
        if not visible(n):
            continue
        if n.tag == "br":
            end(False)
            continue
        if n.tag in BLOCK or n.tag in ASIDE:
            if n.tag in BLOCK:
                end(n.tag in SPACED)
            aside += n.tag in ASIDE
            stack.append((1, n))
        if n.tag == "table" and tables:
            for row, of in _table(n):
                text, sources = row, of
                end(False)
            continue
        if n.tag == "pre":
            for t in (c for m in n.walk() for c in m.children if isinstance(c, str)):
                for i, row in enumerate(t.split("\n")):
                    text, sources = row, [getattr(t, "line", 0) + i]
                    end(False)
            continue
        if n.tag in ("ol", "ul"):
            counts.append(0 if n.tag == "ol" else -1)
        elif n.tag == "li":
            if counts and counts[-1] >= 0:
                counts[-1] += 1
            text = f"{counts[-1]}. " if counts and counts[-1] > 0 else "- "
        elif n.tag in ("td", "th") and text:
            text += " "
        stack += [(0, c) for c in reversed(n.children)]
    end(False)
    return lines


def render_node(top: Node, tables: bool = True) -> str:
    return "\n".join(x.text for x in render_lines(top, tables))


def render(source: str) -> str:
    """The visible text of a page."""
    return render_node(parse(source))
