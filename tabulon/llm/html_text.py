"""Operator 1: the visible text of HTML pages, laid out.

A tokeniser feeds a tree builder that supplies implied tags (``html``,
``body``, end tags of paragraphs, list items, cells, rows, options).  The page's
style sheets are cascaded over the tree, for display and visibility alone, and
what is not visible is taken out.  A renderer walks the rest and keeps block
spacing, list markers, preformatted text and tables with aligned columns.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

_TOKEN = re.compile(
    r"<!--(?:>|->|(?P<comment>.*?)(?:-->|--!>|\Z))"
    r"|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)"
    r"|<[!?](?P<bogus>[^>]*)>?"
    r"|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*>?"
    r"|</[^a-zA-Z>][^>]*>?|</>"
    r"|<(?P<start>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)>?",
    re.S,
)
_ATTR = re.compile(r"""([^\s"'>/=][^\s>/=]*)(?:\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s>]+)))?""")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_STOP = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|[{};]", re.S)
_SCREEN = re.compile(r"(?:only\s+)?(?:all|screen)", re.I)
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_COMPOUND = re.compile(r"(\*|[a-z][a-z0-9-]*)?((?:\.[\w-]+|#[\w-]+|\[\s*[\w-]+\s*(?:=\s*(?:\"[^\"]*\"|'[^']*'|[\w-]+)\s*)?\])*)", re.I)
_SIMPLE = re.compile(r"\.([\w-]+)|#([\w-]+)|\[\s*([\w-]+)\s*(=)?\s*(?:\"([^\"]*)\"|'([^']*)'|([\w-]*))\s*\]")
_DECLARED = re.compile(r"(?:^|;)\s*(display|visibility|content-visibility)\s*:\s*([a-z-]+)[^;!]*(!\s*important)?", re.I)

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
ESCAPABLE = frozenset("title textarea".split())
NOT_SHOWN = frozenset("head script style template title iframe noembed noframes datalist object audio video canvas annotation annotation-xml".split())
#: What an svg element does not draw where it stands.
SVG_ASIDE = frozenset("defs symbol desc metadata clippath mask pattern marker".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre search section summary table ul li dd dt".split()
)
BLOCK = CLOSES_P | frozenset("html body tr caption legend optgroup option".split())
#: What makes a table one of layout, when it is in a cell.
BLOCK_IN_CELL = frozenset("p div h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre form section article".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dl blockquote pre figure hr table fieldset".split())
HEAD_ONLY = frozenset("base basefont bgsound link meta title style script noscript template head".split())
#: A start tag ends the open elements named first, found above the scopes named second.
IMPLIED_ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist")),
    "optgroup": (("option", "optgroup"), ("select",)),
    "td": (("td", "th"), ("table",)),
    "th": (("td", "th"), ("table",)),
    "tr": (("td", "th", "tr", "caption"), ("table",)),
    "tbody": (("td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"), ("table",)),
    "thead": (("td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"), ("table",)),
    "tfoot": (("td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"), ("table",)),
    "caption": (("caption",), ("table",)),
}
#: Elements that a paragraph's implied end is not looked for beyond.
P_SCOPE = frozenset("td th table caption html button object template".split())
#: Elements that only format; their end tags leave blocks opened within them open.
FORMATS = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd mark nobr q s samp small span strike strong sub sup tt u var".split())
# The spans of cells that the HTML standard allows, and the depth at which browsers stop nesting (deeper elements become siblings).
COLSPAN, ROWSPAN, DEPTH = 1000, 65534, 512
#: Columns of text at which a cell of a table is broken into lines.
WRAP = 80


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def parse(html: str) -> Node:
    """The tree of a page.  Any input gives a tree; nothing raises."""
    root = Node("html", {})
    body: Node | None = None
    stack = [root]

    def close(tags: tuple[str, ...], scope: tuple[str, ...]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            tag = stack[k].tag
            if tag in scope:
                return
            if tag in tags:
                del stack[k:]
                # a further match may be open: a cell's row, a row's section
                return close(tags, scope)

    def in_body() -> None:
        nonlocal body
        if stack[-1].tag == "head":
            stack.pop()
        if body is None:
            body = Node("body", {})
            root.children.append(body)
        if len(stack) == 1:
            stack.append(body)

    def text(data: str) -> None:
        if data:
            if len(stack) == 1 or stack[-1].tag == "head":
                if not _SPACE.sub("", data):
                    return
                in_body()
            stack[-1].children.append(data)

    at, n = 0, len(html)
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            text(unescape(html[at:]))
            break
        m = _TOKEN.match(html, lt)
        if m is None:  # a stray "<" is text
            nxt = html.find("<", lt + 1)
            nxt = n if nxt < 0 else nxt
            text(unescape(html[at:nxt]))
            at = nxt
            continue
        if lt > at:
            text(unescape(html[at:lt]))
        at = m.end()
        kind = m.lastgroup
        if kind == "cdata":
            text(m["cdata"])
        elif m["end"] is not None:
            tag = m["end"].lower()
            if tag in ("html", "body"):
                continue
            if tag == "p" and not any(x.tag == "p" for x in stack):
                in_body()
                stack[-1].children.append(Node("p", {}))
                continue
            if tag == "br":
                stack[-1].children.append(Node("br", {}))
                continue
            scope = ("table",) if tag not in ("table",) else ()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    if tag in FORMATS and any(x.tag in CLOSES_P for x in stack[k + 1 :]):
                        del stack[k]
                    else:
                        del stack[k:]
                    break
                if stack[k].tag in scope and tag not in ("tr", "td", "th"):
                    break
                if stack[k].tag == "body":
                    break
            if not stack:
                stack.append(root)
        elif m["start"] is not None:
            tag = m["start"].lower()
            given = m["attrs"]
            attrs = {}
            if "=" in given or (given and not given.isspace() and given != "/"):
                for name, a, b, c in _ATTR.findall(given):
                    attrs.setdefault(name.lower(), unescape(a or b or c))
            if tag == "html":
                root.attrs = attrs | root.attrs
                continue
            if tag == "head":
                if body is None and len(stack) == 1:
                    node = Node("head", attrs)
                    root.children.append(node)
                    stack.append(node)
                continue
            if tag == "body":
                in_body()
                body.attrs = attrs | body.attrs
                continue
            if body is None and tag in HEAD_ONLY:
                parent = stack[-1]
            else:
                in_body()
                if tag in CLOSES_P:
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k].tag == "p":
                            del stack[k:]
                            break
                        if stack[k].tag in P_SCOPE:
                            break
                if tag in IMPLIED_ENDS:
                    close(*IMPLIED_ENDS[tag])
                    if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
                        row = Node("tr", {})
                        stack[-1].children.append(row)
                        stack.append(row)
                in_body()
                parent = stack[-1]
            node = Node(tag, attrs)
            parent.children.append(node)
            if tag in VOID or (given.endswith("/") and any(x.tag in ("svg", "math") for x in (*stack, node))):
                continue
            if tag in RAW or tag in ESCAPABLE:
                end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>?", re.I).search(html, at)
                stop, after = (end.start(), end.end()) if end else (n, n)
                inner = html[at:stop]
                if inner:
                    node.children.append(unescape(inner) if tag in ESCAPABLE else inner)
                at = after
                continue
            if tag == "plaintext":
                node.children.append(html[at:])
                break
            if len(stack) < DEPTH:
                stack.append(node)
    return root


def on_screen(media: str) -> bool:
    """Whether a list of media holds for every screen; conditions on its size do not count as holding."""
    return not media.strip() or any(_SCREEN.fullmatch(x.strip()) for x in media.split(","))


def declared(css: str) -> Iterator[tuple[str, str, bool]]:
    """(property, value, important) of the declarations that count here."""
    for name, value, important in _DECLARED.findall(css):
        yield name.lower(), value.lower(), bool(important)


class Sheet:
    """What a page's own style sheets say of display and visibility.

    Selectors of tags, classes, ids and attributes, with descendants and
    children.  A rule with any other selector (states, siblings) does not count.
    """

    def __init__(self, root: Node):
        #: by what the last compound needs: (compounds from the last one with what joins them, specificity, order, declarations)
        self.rules: dict[str, list[tuple]] = {}
        self.order = 0
        todo = [root]
        while todo:
            node = todo.pop()
            for x in node.children:
                if isinstance(x, Node):
                    if x.tag == "style":
                        if on_screen(x.attrs.get("media", "")):
                            self.read("".join(c for c in x.children if isinstance(c, str)))
                    else:
                        todo.append(x)

    def read(self, css: str) -> None:
        css = _COMMENT.sub("", css)
        head = at = 0
        while stop := _STOP.search(css, at):
            at = stop.end()
            if stop[0] not in "{};":
                continue
            selectors = css[head : stop.start()].strip()
            head = at
            if stop[0] != "{":
                continue
            if selectors[:1] == "@":
                name, _, given = selectors[1:].partition(" ")
                if name.lower() == "layer" or (name.lower() == "media" and on_screen(given)):
                    continue  # what is in it holds; its end is passed like any stray brace
            body, at = self.block(css, at)
            head = at
            if selectors[:1] != "@" and (said := list(declared(body))):
                self.order += 1
                for one in selectors.split(","):
                    self.add(one.strip(), said)

    @staticmethod
    def block(css: str, at: int) -> tuple[str, int]:
        """What a block that starts at ``at`` declares itself, and where it ends; nested blocks are left out."""
        depth, parts, last = 1, [], at
        while stop := _STOP.search(css, at):
            at = stop.end()
            if stop[0] == "{":
                if depth == 1:  # what stands before the brace is a selector
                    parts.append(css[last : css.rfind(";", last, stop.start()) + 1])
                depth += 1
            elif stop[0] == "}":
                depth -= 1
                if not depth:
                    parts.append(css[last : stop.start()])
                    return ";".join(parts), at
                last = at
        parts.append(css[last:] if depth == 1 else "")
        return ";".join(parts), len(css)

    def add(self, selector: str, said: list[tuple[str, str, bool]]) -> None:
        parts = re.sub(r"\s*>\s*", " > ", re.sub(r"\[[^\]]*\]", lambda m: m[0].replace(" ", ""), selector)).split()
        chain, joined, weight = [], " ", [0, 0, 0]
        for part in parts:
            if part == ">":
                joined = part
                continue
            m = _COMPOUND.fullmatch(part)
            if m is None or not part:
                return
            simple = _SIMPLE.findall(m[2] or "")
            tag = None if m[1] in (None, "*") else m[1].lower()
            classes, ids = [x[0] for x in simple if x[0]], [x[1] for x in simple if x[1]]
            attrs = [(x[2].lower(), (x[4] or x[5] or x[6]) if x[3] else None) for x in simple if x[2]]
            weight = [weight[0] + len(ids), weight[1] + len(classes) + len(attrs), weight[2] + (tag is not None)]
            chain.append((joined, tag, classes, ids, attrs))
            joined = " "
        if not chain:
            return
        _, tag, classes, ids, _ = chain[-1]
        need = f"#{ids[0]}" if ids else f".{classes[0]}" if classes else tag or "*"
        self.rules.setdefault(need, []).append((chain[::-1], tuple(weight), self.order, said))

    @staticmethod
    def fits(node: Node, compound: tuple) -> bool:
        _, tag, classes, ids, attrs = compound
        a = node.attrs
        return (
            (tag is None or tag == node.tag)
            and (not classes or set(classes) <= set(a.get("class", "").split()))
            and all(i == a.get("id") for i in ids)
            and all(k in a and (v is None or a[k] == v) for k, v in attrs)
        )

    def holds(self, node: Node, path: list[Node], chain: list[tuple], at: int = 0) -> bool:
        """Whether the compounds from ``at`` on fit ``node`` and the elements above it."""
        if not self.fits(node, chain[at]):
            return False
        if at + 1 == len(chain):
            return True
        above = path[-1:] if chain[at][0] == ">" else path
        return any(self.holds(x, path[: path.index(x)], chain, at + 1) for x in reversed(above))

    def style(self, node: Node, path: list[Node]) -> dict[str, str]:
        """The values that win for an element: important, then the more specific, then the later ones."""
        a = node.attrs
        won: dict[str, tuple] = {}
        if "hidden" in a or (node.tag == "dialog" and "open" not in a):
            won["display"] = ((False, (-1,), 0), "none")
        if self.rules:
            needs = ["*", node.tag, *(f".{c}" for c in a.get("class", "").split())]
            needs += [f"#{a['id']}"] if "id" in a else []
            for chain, weight, order, said in (r for n in needs for r in self.rules.get(n, ())):
                if self.holds(node, path, chain):
                    for name, value, important in said:
                        rank = (important, weight, order)
                        if name not in won or rank >= won[name][0]:
                            won[name] = (rank, value)
        if "style" in a:
            for name, value, important in declared(a["style"]):
                rank = (important, (9, 9, 9), 1 << 30)
                if name not in won or rank >= won[name][0]:
                    won[name] = (rank, value)
        return {k: v for k, (_, v) in won.items()}


def prune(node: Node, sheet: Sheet, path: list[Node], visible: bool) -> bool:
    """Takes out of ``node`` what cannot be seen; whether anything is left to see.

    Hidden elements stay as far as visible ones are in them, and cells stay
    as they hold their column.
    """
    kept: list = []
    some = False
    path.append(node)
    for x in node.children:
        if isinstance(x, str):
            if visible:
                kept.append(x)
                some = some or not x.isspace()
            continue
        if x.tag in NOT_SHOWN or (x.tag == "input" and x.attrs.get("type", "").lower() == "hidden"):
            continue
        own = sheet.style(x, path) if sheet.rules or x.attrs or x.tag == "dialog" else {}
        if own.get("display") == "none":
            continue
        seen = {"hidden": False, "collapse": False, "visible": True, "initial": True}.get(own.get("visibility"), visible)
        if own.get("content-visibility") == "hidden":
            x.children = []
        inner = prune(x, sheet, path, seen)
        if seen or inner or x.tag in ("td", "th"):
            kept.append(x)
            some = some or seen or inner
    path.pop()
    node.children = kept
    return some


class Lines:
    """Text under construction: lines, the open line, and the gap before the next."""

    __slots__ = ("done", "open", "gap", "space")

    def __init__(self) -> None:
        self.done: list[str] = []
        self.open: list[str] = []
        self.gap = 0
        self.space = False

    def flow(self, text: str) -> None:
        text = _SPACE.sub(" ", text)
        if text[0] == " ":
            self.space = True
            text = text[1:]
            if not text:
                return
        if self.space and self.open:
            self.open.append(" ")
        self.space = text[-1] == " "
        self.open.append(text[:-1] if self.space else text)

    def end_line(self, forced: bool = False) -> None:
        if self.open or forced:
            if self.done and self.gap > 1:
                self.done.append("")
            self.gap = 0
            self.done.append("".join(self.open).replace("\xa0", " ").rstrip())
            self.open = []
        self.space = False

    def block(self, gap: int) -> None:
        self.end_line()
        self.gap = max(self.gap, gap)

    def put(self, lines: list[str], first: str = "", rest: str = "") -> None:
        """Finished lines, with what stands before the first and the others."""
        self.end_line()
        for k, line in enumerate(lines):
            self.open = [((first if k == 0 else rest) + line).rstrip()]
            self.end_line(True)


def _into(node: Node, out: Lines, depth: int) -> None:
    for x in node.children:
        if isinstance(x, str):
            out.flow(x)
            continue
        tag = x.tag
        if tag == "br":
            out.end_line(True)
        elif tag == "wbr":
            pass
        elif tag == "input":
            out.space = True
            if label := _label(x.attrs):
                out.flow(label)
            out.space = True
        elif tag == "svg":  # each label stands for itself
            for label in _labels(x):
                out.space = True
                _into(label, out, depth)
                out.space = True
        elif tag == "hr":
            out.block(2)
        elif tag in ("ul", "ol", "menu", "dir"):
            out.block(1 if depth else 2)
            _list(x, out, depth)
            out.block(1 if depth else 2)
        elif tag == "li":  # outside any list
            out.block(1)
            out.put(_lines(x, depth + 1), "- ", "  ")
            out.block(1)
        elif tag == "dd":
            out.block(1)
            out.put(_lines(x, depth), "  ", "  ")
            out.block(1)
        elif tag == "blockquote":
            out.block(2)
            out.put(_lines(x, depth), "> ", "> ")
            out.block(2)
        elif tag in ("pre", "xmp", "listing", "textarea"):
            out.block(2 if tag != "textarea" else 1)
            raw = _plain(x)
            out.put((raw[1:] if raw[:1] == "\n" else raw).replace("\r", "").rstrip("\n").split("\n") if raw else [])
            out.block(2 if tag != "textarea" else 1)
        elif tag == "table":
            out.block(2)
            _table(x, out, depth)
            out.block(2)
        elif tag == "select":
            options = list(_descend(x, "option"))
            chosen = [o for o in options if "selected" in o.attrs] or ([] if "multiple" in x.attrs else options[:1])
            for o in options if "multiple" in x.attrs else chosen:
                out.space = True
                _into(o, out, depth)
                out.space = True
        elif tag == "details" and "open" not in x.attrs:
            out.block(1)
            for s in x.children:
                if isinstance(s, Node) and s.tag == "summary":
                    _into(s, out, depth)
                    break
            out.block(1)
        elif tag in BLOCK:
            gap = 2 if tag in SPACED else 1
            out.block(gap)
            _into(x, out, depth)
            out.block(gap)
        else:
            _into(x, out, depth)


def _label(attrs: dict[str, str]) -> str:
    """The text that a form field shows."""
    kind = attrs.get("type", "text").lower()
    if kind in ("submit", "reset"):
        return attrs.get("value", kind.capitalize())
    if kind in ("password", "checkbox", "radio", "file", "image", "color", "range"):
        return ""
    return attrs.get("value", "") or attrs.get("placeholder", "")


def _lines(node: Node, depth: int) -> list[str]:
    out = Lines()
    _into(node, out, depth)
    out.end_line()
    return out.done


def _plain(node: Node) -> str:
    parts: list[str] = []
    for x in node.children:
        if isinstance(x, str):
            parts.append(x)
        else:
            if x.tag == "svg":
                parts.append(" ".join(_plain(label) for label in _labels(x)))
            else:
                parts.append("\n" if x.tag == "br" else _plain(x))
    return "".join(parts)


def _labels(node: Node) -> Iterator[Node]:
    """The text labels of an svg element."""
    for x in node.children:
        if isinstance(x, Node) and x.tag not in SVG_ASIDE:
            if x.tag in ("text", "foreignobject"):
                yield x
            else:
                yield from _labels(x)


def _descend(node: Node, tag: str) -> Iterator[Node]:
    for x in node.children:
        if isinstance(x, Node):
            if x.tag == tag:
                yield x
            else:
                yield from _descend(x, tag)


def _number(value: str | None, other: int) -> int:
    m = re.match(r"\s*([+-]?\d{1,9})", value or "")
    return int(m[1]) if m else other


def _list(node: Node, out: Lines, depth: int) -> None:
    step = -1 if "reversed" in node.attrs else 1
    items = sum(isinstance(x, Node) and x.tag == "li" for x in node.children)
    number = _number(node.attrs.get("start"), items if step < 0 else 1)
    for x in node.children:
        if isinstance(x, str):
            out.flow(x)
        elif x.tag == "li":
            mark = "- "
            if node.tag == "ol":
                number = _number(x.attrs.get("value"), number)
                mark = f"{number}. "
                number += step
            out.block(1)
            out.put(_lines(x, depth + 1) or [""], mark, " " * len(mark))
            out.block(1)
        else:
            inner = Node("div", {})
            inner.children.append(x)
            out.put(_lines(inner, depth + 1), "  ", "  ")


def _holds(node: Node, tags: tuple[str, ...]) -> bool:
    """Whether one of ``tags`` is below ``node``, but for those of a table within."""
    return any(isinstance(x, Node) and x.tag != "table" and (x.tag in tags or _holds(x, tags)) for x in node.children)


def _cells(row: Node, stray: list) -> Iterator[Node]:
    """The cells of a row, also those in wrappers; what else there is goes to ``stray``."""
    for x in row.children:
        if isinstance(x, str):
            stray.append(x)
        elif x.tag in ("td", "th"):
            yield x
        elif x.tag != "table" and _holds(x, ("td", "th")):
            yield from _cells(x, stray)
        else:
            stray.append(x)


def _rows(node: Node, stray: list) -> Iterator[list[Node]]:
    """The cells of each row of a table; what is in no cell goes to ``stray``."""
    for x in node.children:
        if isinstance(x, str):
            stray.append(x)
        elif x.tag in ("caption", "colgroup", "col"):
            continue
        elif x.tag == "tr":
            yield list(_cells(x, stray))
        elif x.tag in ("thead", "tbody", "tfoot") or (x.tag != "table" and _holds(x, ("tr",))):
            yield from _rows(x, stray)
        elif x.tag in ("td", "th"):
            yield [x]
        elif x.tag != "table" and _holds(x, ("td", "th")):
            yield list(_cells(x, stray))
        else:
            stray.append(x)


def _holds_table(node: Node) -> bool:
    return any(isinstance(x, Node) and (x.tag == "table" or _holds_table(x)) for x in node.children)


def _wrapped(line: str) -> list[str]:
    """A line broken between words at ``WRAP``; a longer word stands alone."""
    out, at = [], 0
    while len(line) - at > WRAP:
        cut = line.rfind(" ", at, at + WRAP + 1)
        cut = cut if cut > at else line.find(" ", at + WRAP)
        if cut < 0:
            break
        out.append(line[at:cut])
        at = cut + 1
    return [*out, line[at:]]


def _table(node: Node, out: Lines, depth: int) -> None:
    stray: list[str | Node] = []
    rows = list(_rows(node, stray))
    # captions and what does not belong in a table come first
    for x in [*stray, *(c for c in node.children if isinstance(c, Node) and c.tag == "caption")]:
        if isinstance(x, str):
            out.flow(x)
            continue
        out.block(1)
        if x.tag == "caption":
            _into(x, out, depth)
        else:
            outer = Node("div", {})
            outer.children.append(x)
            _into(outer, out, depth)
        out.block(1)
    grid: list[dict[int, tuple[int, list[str]]]] = []
    layout = False
    below: dict[int, int] = {}  # columns that a cell from above still covers
    for row in rows:
        cells: dict[int, tuple[int, list[str]]] = {}
        covered = {c for c, k in below.items() if k > 0}
        below = {c: k - 1 for c, k in below.items() if k > 1}
        col = 0
        for x in row:
            while col in covered:
                col += 1
            wide = min(max(_number(x.attrs.get("colspan"), 1), 1), COLSPAN)
            tall = min(max(_number(x.attrs.get("rowspan"), 1), 1), ROWSPAN)
            layout = layout or _holds(x, tuple(BLOCK_IN_CELL)) or _holds_table(x)
            cells[col] = (wide, _lines(x, depth))
            for c in range(col, col + wide):
                if tall > 1:
                    below[c] = tall - 1
            col += wide
        grid.append(cells)
    columns = max((c + w for cells in grid for c, (w, _) in cells.items()), default=0)
    # a table of one column, or with blocks in its cells, is layout: its cells follow each other
    if columns == 1 or layout:
        for cells in grid:
            for c in sorted(cells):
                out.block(1)
                out.put(cells[c][1])
        return
    grid = [{c: (w, [part for line in lines for part in _wrapped(line)]) for c, (w, lines) in cells.items()} for cells in grid]
    widths: dict[int, int] = {}
    for cells in grid:
        for c, (wide, lines) in cells.items():
            if wide == 1:
                widths[c] = max(widths.get(c, 0), max((len(x) for x in lines if len(x) <= WRAP), default=0))
    at = [0]
    for c in range(columns):
        at.append(at[-1] + widths.get(c, 0) + 2)
    for cells in grid:
        for k in range(max((len(lines) for _, lines in cells.values()), default=0)):
            line = ""
            for c in sorted(cells):
                lines = cells[c][1]
                if k < len(lines) and lines[k]:
                    line = line.ljust(at[c]) + ("  " if len(line) > at[c] else "") + lines[k]
            out.put([line])


def visible_text(html: str | None) -> str | None:
    """The laid-out visible text of a page; null for null, empty for no visible text."""
    if html is None:
        return None
    root = parse(html)
    page, sheet = Node("", {}), Sheet(root)
    page.children.append(root)
    prune(page, sheet, [], True)
    lines = _lines(page, 0)
    while lines and not lines[-1]:
        lines.pop()
    while lines and not lines[0]:
        lines.pop(0)
    return "\n".join(lines)


def extract(pages: DataFrame, column: str = "html", to: str = "text") -> DataFrame:
    """``pages`` with the visible text of ``column`` in ``to``.

    Row by row: ties, repeated rows and other columns (kept, but for one that
    is already named ``to``, which is replaced) have no influence.  A null page
    gives null, an empty one empty text; a long one is read whole; an empty
    table gives no rows.
    """
    kept = [c for c in pages.columns if c not in (column, to)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 20 * DEPTH))
        for batch in batches:
            # long pages: a few rows at a time
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [visible_text(x) for x in part.column(column).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(texts, pa.string())], names=[*kept, to])

    fields = [pages.schema[c] for c in kept]
    schema = type(pages.schema)(fields).add(to, "string")
    return pages.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{column}`").cast("string").alias(column)).mapInArrow(run, schema)


def op1_html_text(spark, sf_dir: str) -> DataFrame:
    pages = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
