"""A small, forgiving HTML parser: the tree of block elements and the text in them.

Inline elements belong to the block that holds them. Implied ends follow the HTML
standard's rules for paragraphs, list items, table parts and options.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right

#: An attribute as browsers read it: the name runs to white space, a slash, = or >; a value
#: without quotes to white space or >, whatever quotes are in it.
_VALUE = r"""(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))?)?"""
_ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*)" + _VALUE)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[\s/]|[^\s/>][^\s/>=]*" + _VALUE.replace("([^", "(?:[^") + ")*+)>?", re.S)
_HINTS = frozenset(("class", "id", "role", "hidden", "aria-hidden", "style"))
_RAW = {n: re.compile(rf"</{n}\b[^>]*>?", re.I) for n in ("script", "style", "textarea", "title", "iframe")}
#: Elements whose text stays and is set off from the words around it.
_APART = frozenset("noscript template svg select option optgroup math object canvas video audio".split())

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "html head body main article section nav aside header footer hgroup address div p pre blockquote center figure figcaption details summary dialog "
    "h1 h2 h3 h4 h5 h6 ul ol li dl dt dd menu table caption thead tbody tfoot tr td th form fieldset legend".split()
)
_CLOSES_P = BLOCK - {"html", "head", "body", "td", "th", "tr", "caption", "thead", "tbody", "tfoot"} | {"hr"}
#: An opening tag ends the open element of one of these tags, up to a border.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "body": ({"head"}, {"html"})}


def _hints(attributes: str) -> str:
    """What the attributes of a block say about it."""
    out = []
    for m in _ATTRIBUTE.finditer(attributes):
        if (name := m[1].lower()) in _HINTS and (name != "style" or "none" in m[0]):
            value = m[2] or m[3] or m[4] or ""
            out.append(f"{m[1]} {value}" if name in ("role", "hidden", "aria-hidden") else value)
    return " ".join(out)


#: Blocks nested deeper than this hang beside each other, as in browsers; no text is lost.
DEEPEST = 512


class Page:
    """Blocks in page order, as parallel lists; block 0 is the root. The time to read a page
    grows with its length, however deep its elements are nested."""

    __slots__ = ("depth", "hints", "linked", "parent", "pieces", "tag")

    def __init__(self, source: str) -> None:
        self.parent, self.depth, self.tag, self.hints = [-1], [0], ["html"], [""]
        self.linked = [0]  #: characters of text inside links
        self.pieces: list[tuple[int, str]] = []  #: (block, text) in page order
        self._read(source)

    def _read(self, source: str) -> None:
        open_tags, open_blocks = ["html"], [0]
        blocks = [0]
        places = [0]  # of the open blocks in open_tags
        where: dict[str, list[int]] = {"html": [0]}  # of each open tag
        last = lambda names: max((where[x][-1] for x in names if where.get(x)), default=0)
        links, at, n = 0, 0, len(source)
        parent, depth, tags, hints, linked, pieces = self.parent, self.depth, self.tag, self.hints, self.linked, self.pieces
        run: list[str] = []

        def end_run() -> None:
            if run:
                text = "".join(run)
                if not text.isspace():
                    pieces.append((blocks[-1], text))
                run.clear()

        def pop_to(k: int) -> None:
            nonlocal links
            for name, block in zip(open_tags[k:], open_blocks[k:], strict=True):
                where[name].pop()
                if block >= 0:
                    end_run()
                    blocks.pop()
                    places.pop()
                if name == "a":
                    links -= 1
            del open_tags[k:], open_blocks[k:]

        while at < n:
            token = _TOKEN.search(source, at)
            stop = token.start() if token else n
            if stop > at:
                text = source[at:stop]
                if "&" in text:
                    text = html.unescape(text)
                run.append(text)
                if links:
                    linked[blocks[-1]] += len(text.strip())
            if token is None:
                break
            at = token.end()
            name = token[2]
            if name is None:
                continue
            name = name.lower()
            if name in _APART:
                run.append(" ")
            if token[1]:
                k = last([name])
                # an inline end tag does not close a block
                if k and (name in BLOCK or places[-1] < k):
                    pop_to(k)
                continue
            if name in _RAW:
                if token[0].endswith("/>") and last(("svg", "math")):
                    continue  # in foreign content it has no text
                found = _RAW[name].search(source, at)
                at = found.end() if found else n
                run.append(" ")
                continue
            if name in VOID:
                if name == "hr":
                    end_run()
                else:
                    run.append(" " if name == "br" else "")
                continue
            if name in _CLOSES_P and (k := last(["p"])) > last(("td", "th", "table")):
                pop_to(k)
            if name in _ENDS:
                ends, border = _ENDS[name]
                edge = last(border)
                first = [where[x][k] for x in ends if x in where and (k := bisect_right(where[x], edge)) < len(where[x])]
                if first:
                    pop_to(min(first))
            if name in BLOCK:
                if name == "html":
                    continue
                end_run()
                above = blocks[-1] if depth[blocks[-1]] < DEEPEST else parent[blocks[-1]]
                parent.append(above)
                depth.append(depth[above] + 1)
                tags.append(name)
                linked.append(0)
                hints.append(_hints(token[3]))
                blocks.append(len(tags) - 1)
                places.append(len(open_tags))
                where.setdefault(name, []).append(len(open_tags))
                open_tags.append(name)
                open_blocks.append(len(tags) - 1)
            elif not token[0].endswith("/>"):
                if name == "a":
                    links += 1
                where.setdefault(name, []).append(len(open_tags))
                open_tags.append(name)
                open_blocks.append(-1)
        end_run()
