"""HTML to text by layout.

A tree builder with implied tags turns the markup into boxes, visibility rules take out
what a browser would not show, and a renderer lays the rest out as plain text: blocks
apart by blank lines where they have margins, list items with bullets or numbers and
indents, table cells padded so that columns line up, preformatted text as it stands.

Unlike an extractor of the main article it keeps all visible text: navigation, asides
and footers too.

Defined cases: null markup gives null; empty markup gives an empty text; broken markup
never raises (unknown end tags are passed over, open elements end with their parent);
very long pages are rendered whole; elements nested beyond 512 become siblings, and lists
and quotations nested beyond 24 are indented no further; lines beyond 80 letters widen no
column, and a table with more than four times its text in padding is not aligned, so that
the text is at most a small multiple of the page; repeated rows are rendered alike;
an empty table gives an empty one; a column named like ``into`` (case aside) is replaced,
other columns come along untouched.
"""

from __future__ import annotations

import bisect
import html
import itertools
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.text import scalar_struct

# Element names of the HTML standard, by what they mean here.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
UNSEEN = {"head", "title", "script", "style", "template", "noscript", "iframe", "noembed", "noframes", "object", "audio", "video", "canvas", "datalist", "map", "rp"}
MARGIN = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "figure", "dl", "ul", "ol", "table", "fieldset", "menu", "dir"}
PLAIN = {"html", "body", "div", "article", "section", "nav", "aside", "header", "footer", "main", "address", "form", "li", "dt", "dd", "figcaption", "details", "summary", "dialog", "legend", "center", "hgroup", "search", "caption", "tr", "thead", "tbody", "tfoot", "optgroup", "option"}
BLOCK = MARGIN | PLAIN
CELLS = {"td", "th"}
#: What a head can hold; any other start tag or text ends it.
HEAD = {"base", "basefont", "bgsound", "link", "meta", "noframes", "noscript", "script", "style", "template", "title"}
#: Elements that hold rows or cells only. Other content moves in front of the table.
TABLE = {"table", "thead", "tbody", "tfoot", "tr"}
#: How far a start tag inside a table takes it back.
_GROUPS = {"table", "thead", "tbody", "tfoot"}
TABLE_PARTS = dict.fromkeys(("thead", "tbody", "tfoot", "caption", "colgroup"), {"table"}) | {"tr": _GROUPS} | dict.fromkeys(CELLS, TABLE)
#: Drawings and formulas: what leads back to HTML inside them, what ends them, what they don't show.
INTEGRATION = {"foreignobject", "desc", "title", "mi", "mo", "mn", "ms", "mtext"}
BREAKOUT = {"b", "big", "blockquote", "body", "br", "center", "code", "dd", "div", "dl", "dt", "em", "embed", "h1", "h2", "h3", "h4", "h5", "h6", "head", "hr", "i", "img", "li", "listing", "menu", "meta", "nobr", "ol", "p", "pre", "ruby", "s", "small", "span", "strong", "strike", "sub", "sup", "table", "tt", "u", "ul", "var"}
UNDRAWN = {"defs", "symbol", "desc", "metadata", "clippath", "mask", "marker", "pattern", "annotation", "annotation-xml"}
#: A start tag ends these open elements, looking no further out than the bounds.
_CELL = (CELLS, {"tr", "table"})
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "table"}),
    "dt": ({"dt", "dd"}, {"dl", "table"}),
    "dd": ({"dt", "dd"}, {"dl", "table"}),
    "tr": ({"tr"}, {"table"}),
    "td": _CELL,
    "th": _CELL,
    "option": ({"option"}, {"select", "datalist"}),
    "body": ({"head"}, {"html"}),
}
#: Elements that end an open paragraph.
ENDS_P = (BLOCK | {"hr"}) - {"html", "body", "caption", "tr", "thead", "tbody", "tfoot", "option", "optgroup", "legend", "summary"}
#: What an end tag, or the search for an open paragraph, does not reach beyond.
SCOPE = {"table", "td", "th", "caption", "html", "template", "button", "object"}

TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/)?(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)(?:>|\Z|[\"'][^>]*(?:>|\Z))|</[^>]*(?:>|\Z)",
    re.S,
)
ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
HIDING = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
#: Unlike display, visibility can be taken back further in.
VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(hidden|collapse|visible|initial)", re.I)
SPACES = re.compile(r"[ \t\n\r\f]+")
#: The end of a tag that closes itself; a slash in a bare value is part of it.
CLOSED = re.compile(r"(?<!=)(?:^|[\s\"']|(?:^|\s)[^\s=\"']+)/\Z")


#: Elements nested deeper than this become siblings, as in browsers; no text is lost.
MOST_DEPTH = 512


class Node:
    __slots__ = ("name", "attrs", "kids", "hidden", "foreign", "drawn", "veiled")

    def __init__(self, name: str, attrs: dict[str, str], hidden: bool, foreign: bool = False, drawn: bool = False, veiled: bool = False):
        """foreign: in a drawing or formula; drawn: in a drawing, outside its texts;
        veiled: its own texts don't show, elements inside may."""
        self.name, self.attrs, self.kids, self.hidden, self.foreign, self.drawn, self.veiled = name, attrs, [], hidden, foreign, drawn, veiled


def _attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in ATTR.finditer(source):
        value = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or ""
        found.setdefault(m[1].lower(), html.unescape(value) if "&" in value else value)
    return found


def _hidden(name: str, attrs: dict[str, str], parent: Node) -> bool:
    if name in UNSEEN or "hidden" in attrs or (parent.foreign and name in UNDRAWN):
        return True
    if name == "dialog" and "open" not in attrs:
        return True
    if parent.name == "details" and "open" not in parent.attrs and name != "summary":
        return True
    return "style" in attrs and bool(HIDING.search(attrs["style"]))


def _veiled(attrs: dict[str, str], parent: Node) -> bool:
    said = VISIBILITY.findall(attrs["style"]) if "style" in attrs else []
    return said[-1].lower() in ("hidden", "collapse") if said else parent.veiled


def build(markup: str) -> Node:
    """The tree of a page. Text nodes are strings among a node's kids."""
    root = Node("html", {}, False)
    stack = [root]
    at, n = 0, len(markup)

    def table_at() -> int:
        """The place of the innermost open table, 0 for none."""
        return next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name == "table"), 0)

    def put(kid: str | Node, at: int) -> None:
        """Into the open element, or in front of the table at a place of the stack."""
        kids = stack[at - 1].kids if at else stack[-1].kids
        if at and kids and kids[-1] is stack[at]:
            kids.insert(len(kids) - 1, kid)
        else:
            kids.append(kid)

    def text(part: str, plain: bool = False) -> None:
        if not part or stack[-1].drawn:
            return
        fostered = 0
        if stack[-1].name in ("head", "colgroup") or stack[-1].name in TABLE:
            if SPACES.fullmatch(part) is None:
                if stack[-1].name == "head" or (stack[-1].name == "colgroup" and table_at()):
                    stack.pop()
                fostered = table_at() if stack[-1].name in TABLE else 0
        put(part if plain or "&" not in part else html.unescape(part), fostered)

    def close(names: set[str], bounds: set[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in names:
                del stack[i:]
                return
            if stack[i].name in bounds:
                return

    while at < n:
        m = TOKEN.search(markup, at)
        if m is None:
            text(markup[at:])
            break
        text(markup[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            if stack[-1].foreign and m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>"), plain=True)
            continue
        name = name.lower()
        if m["end"]:
            if name == "p" and not any(x.name == "p" for x in stack):
                stack[-1].kids.append(Node("p", {}, stack[-1].hidden))
            elif name == "br":
                if stack[-1].name == "head":
                    stack.pop()
                put(Node("br", {}, False), table_at() if stack[-1].name in TABLE else 0)
            elif name in CELLS or name in ("tr", "thead", "tbody", "tfoot", "caption"):
                close({name}, {"table"})
            elif name == "table":
                close({name}, {"template"})
            else:
                close({name}, SCOPE - {name})
            continue
        if name in ("html", "body") and len(stack) >= 1:
            if name == "html":
                root.attrs = _attributes(m["attrs"]) | root.attrs
                continue
            if len(stack) > 1 and stack[1].name == "body":
                continue
        attrs = _attributes(m["attrs"]) if m["attrs"].strip("/ \n\t") else {}
        if stack[-1].name == "head" and name not in HEAD:
            stack.pop()
        if name in BREAKOUT:
            while stack[-1].foreign:
                stack.pop()
        if stack[-1].name == "colgroup" and name not in ("col", "template") and table_at():
            stack.pop()
        if name in ENDS_P:
            close({"p"}, SCOPE)
        table = table_at() if name in TABLE_PARTS or stack[-1].name in TABLE else 0
        if table and name in TABLE_PARTS:
            while stack[-1].name not in TABLE_PARTS[name]:
                stack.pop()
        elif name in IMPLIED:
            close(*IMPLIED[name])
        fostered = 0
        if table and stack[-1].name in TABLE and name not in TABLE_PARTS:
            if name == "table":
                del stack[table:]
            elif name == "form":
                stack[-1].kids.append(Node("form", attrs, stack[-1].hidden))
                continue
            elif name not in ("col", "script", "style", "template"):
                fostered = table
        if name in ("h1", "h2", "h3", "h4", "h5", "h6") and stack[-1].name in ("h1", "h2", "h3", "h4", "h5", "h6"):
            stack.pop()
        if name in CELLS and stack[-1].name in ("table", "thead", "tbody", "tfoot"):
            row = Node("tr", {}, stack[-1].hidden, veiled=stack[-1].veiled)
            stack[-1].kids.append(row)
            stack.append(row)
        parent = stack[fostered - 1] if fostered else stack[-1]
        foreign = name in ("svg", "math") or (parent.foreign and name not in INTEGRATION)
        drawn = name == "svg" or (parent.drawn and name not in ("text", "foreignobject"))
        node = Node(name, attrs, parent.hidden or _hidden(name, attrs, parent), foreign, drawn, _veiled(attrs, parent))
        put(node, fostered)
        if name in VOID or ((foreign or parent.foreign) and CLOSED.search(m["attrs"])):
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(markup, at)
            body = markup[at : end.start() if end else n]
            if name in ("textarea", "title"):
                body = html.unescape(body)
            node.kids.append(body)
            at = end.end() if end else n
            continue
        if len(stack) >= MOST_DEPTH:
            stack.pop()
        stack.append(node)
    return root


class Canvas:
    """Lines of text under construction: inline text joins the open line, blocks end it."""

    def __init__(self, depth: int = 0) -> None:
        """depth: of lists and quotations around."""
        self.depth = depth
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = 0
        self.space = False
        self.mark = ""

    def write(self, part: str) -> None:
        words = SPACES.sub(" ", part)
        if words == " " or not words:
            self.space = self.space or bool(words)
            return
        lead, tail = words[0] == " ", words[-1] == " "
        if self.line and (self.space or lead):
            self.line.append(" ")
        self.line.append(words.strip(" "))
        self.space = tail

    def verbatim(self, part: str) -> None:
        first, *rest = part.replace("\r\n", "\n").split("\n")
        self.line.append(first)
        for x in rest:
            self.end(keep=True)
            self.line.append(x)
        self.space = False

    def end(self, keep: bool = False) -> None:
        """Ends the open line. keep: even an empty one."""
        line = "".join(self.line)
        self.line, self.space = [], False
        if line.strip() or keep:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = 0
            self.lines.append((self.mark + line).rstrip())
            self.mark = ""

    def block(self, margin: bool) -> None:
        self.end()
        if margin:
            self.gap = 1

    def done(self) -> list[str]:
        self.end()
        if self.mark.strip():
            self.lines.append(self.mark.rstrip())
            self.mark = ""
        return self.lines


def _number(text: str | None, otherwise: int) -> int:
    try:
        return int(text or "")
    except ValueError:
        return otherwise


def _rows(table: Node) -> tuple[list[Node], list[list[Node]]]:
    """(captions, rows of cells) of a table; rows lie in it or in its row groups."""
    captions, head, rows, foot = [], [], [], []
    for kid in table.kids:
        if isinstance(kid, str) or kid.hidden:
            continue
        if kid.name == "caption":
            captions.append(kid)
        elif kid.name == "tr":
            rows.append(kid)
        elif kid.name in ("thead", "tbody", "tfoot"):
            (head if kid.name == "thead" else foot if kid.name == "tfoot" else rows).extend(x for x in kid.kids if not isinstance(x, str) and x.name == "tr" and not x.hidden)
    return captions, [[c for c in r.kids if not isinstance(c, str) and c.name in CELLS and not c.hidden] for r in head + rows + foot]


def _placed(cells: list[list[tuple[list[str], int, int]]]) -> list[list[tuple[int, int, list[str]]]]:
    """Each row's cells as (first column, column behind the last, lines), beside the cells of
    earlier rows that reach down into it."""
    out, above = [], []  # above: (row behind the last, from, to)
    for y, row in enumerate(cells):
        above = [a for a in above if a[0] > y]
        held, x, line = sorted((a, b) for _, a, b in above), 0, []
        for lines, wide, high in row:
            while held and held[0][0] <= x:
                x = max(x, held.pop(0)[1])
            line.append((x, x + wide, lines))
            if high > 1:
                above.append((y + high, x, x + wide))
            x += wide
        out.append(line)
    return out


def _grid(cells: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Rows of (lines, columns, rows taken) as aligned text, two spaces between columns.

    A column is as wide as its lines of up to MOST_WIDTH letters; what is longer runs on and
    pushes the rest of its own row. A table whose padding would come to more than four times
    its text is not aligned: its cells stand two spaces apart."""
    placed = _placed(cells)
    edges = sorted({x for line in placed for x, _, _ in line})
    number, width = {x: i for i, x in enumerate(edges)}, [0] * len(edges)
    fitting = lambda lines: max([0, *(len(x) for x in lines if len(x) <= MOST_WIDTH)])
    spans = []
    for line in placed:
        for x, to, lines in line:
            first, last = number[x], bisect.bisect_left(edges, to)
            if last == first + 1:
                width[first] = max(width[first], fitting(lines))
            else:
                spans.append((first, last, fitting(lines)))
    before, grown = [0, *itertools.accumulate(width)], [0] * len(edges)
    for first, last, size in spans:
        short = size - (before[last] - before[first]) - 2 * (last - first - 1)
        if short > 0:
            grown[last - 1] = max(grown[last - 1], short)
    width = [w + g for w, g in zip(width, grown)]
    starts = [0, *itertools.accumulate(w + 2 for w in width)]
    text = sum(len(x) for line in placed for _, _, lines in line for x in lines)
    padded = sum(starts[number[line[-1][0]]] * max(len(lines) for _, _, lines in line) for line in placed if line)
    if padded > 4 * text + MOST_PADDING:
        starts = [0] * len(starts)
    out = []
    for line in placed:
        for k in range(max([1, *(len(lines) for _, _, lines in line)]) if line else 0):
            parts, at = [], 0
            for x, _, lines in line:
                if k < len(lines):
                    pad = max(starts[number[x]] - at, 2 if at else 0)
                    parts += [" " * pad, lines[k]]
                    at += pad + len(lines[k])
            out.append("".join(parts).rstrip())
    return out


#: Letters up to which a line widens its column, and letters of padding that any table may have.
MOST_WIDTH, MOST_PADDING = 80, 4000
#: Columns and rows that one cell may take, as browsers bound them.
MOST_SPAN = 1000
#: Lists and quotations further in are indented no further, or lines would grow with depth.
MOST_INDENT = 24


def _shown_options(select: Node) -> list[Node]:
    """The options that a select shows: all of a list box, else the chosen one."""
    options, todo = [], list(reversed(select.kids))
    while todo:
        kid = todo.pop()
        if isinstance(kid, str) or kid.hidden:
            continue
        if kid.name == "option":
            options.append(kid)
        else:
            todo.extend(reversed(kid.kids))
    if "multiple" in select.attrs or _number(select.attrs.get("size"), 1) > 1:
        return options
    chosen = [x for x in options if "selected" in x.attrs][-1:]
    return chosen or [x for x in options if "disabled" not in x.attrs][:1]


def render(root: Node) -> list[str]:
    """The lines of a tree. Works off a stack of steps; a table's cells, a list item's and
    a quotation's content each get a canvas of their own, which their end merges."""
    page = Canvas()
    steps: list[tuple] = [("kids", root, page, False)]
    while steps:
        kind, node, canvas, pre = steps.pop()
        if kind == "call":
            node()
            continue
        if kind == "kids":
            steps.extend(("node", kid, canvas, pre) for kid in reversed(node.kids) if not (node.veiled and isinstance(kid, str)))
            continue
        if isinstance(node, str):
            if pre:
                canvas.verbatim(node)
            else:
                canvas.write(node)
            continue
        if node.hidden:
            continue
        name = node.name
        if name == "br":
            canvas.end(keep=True)
        elif name == "hr":
            canvas.block(False)
            canvas.line.append("---")
            canvas.block(False)
        elif name == "q":
            steps += [("call", lambda c=canvas: c.line.append("”"), None, None), ("kids", node, canvas, pre), ("call", lambda c=canvas: c.write("“"), None, None)]
        elif name == "select":
            shown = _shown_options(node)
            for option in reversed(shown):
                steps += [("call", lambda c=canvas, b=len(shown) > 1: c.block(False) if b else c.write(" "), None, None), ("kids", option, canvas, pre)]
            canvas.write(" ")
        elif name == "table":
            canvas.block(True)
            captions, rows = _rows(node)
            grid = [[(c, Canvas(canvas.depth)) for c in row] for row in rows]

            def lay(canvas=canvas, grid=grid):
                cells = [[(k.done(), min(MOST_SPAN, max(1, _number(c.attrs.get("colspan"), 1))), min(MOST_SPAN, max(1, _number(c.attrs.get("rowspan"), 1)))) for c, k in row] for row in grid]
                for line in _grid(cells):
                    if line:
                        canvas.line.append(line)
                        canvas.end()
                canvas.block(True)

            steps.append(("call", lay, None, None))
            steps.extend(("kids", c, k, pre) for row in reversed(grid) for c, k in reversed(row))
            for caption in reversed(captions):
                steps += [("call", lambda c=canvas: c.block(False), None, None), ("kids", caption, canvas, pre)]
        elif name in ("ul", "ol", "menu", "dir"):
            canvas.block(True)
            steps.append(("call", lambda c=canvas: c.block(True), None, None))
            down = "reversed" in node.attrs
            at = _number(node.attrs.get("start"), sum(not isinstance(k, str) and k.name == "li" and not k.hidden for k in node.kids) if down else 1)
            items = []
            for kid in node.kids:
                if not isinstance(kid, str) and kid.name == "li" and not kid.hidden:
                    if name == "ol":
                        at = _number(kid.attrs.get("value"), at)
                        items.append((kid, f"{at}. "))
                        at += -1 if down else 1
                    else:
                        items.append((kid, "- "))
                else:
                    items.append((kid, ""))
            for kid, mark in reversed(items):
                if not mark:
                    steps.append(("node", kid, canvas, pre))
                    continue
                if canvas.depth >= MOST_INDENT:
                    steps += [("call", lambda c=canvas: c.block(False), None, None), ("kids", kid, canvas, pre), ("call", lambda c=canvas, m=mark: (c.block(False), c.write(m)), None, None)]
                    continue
                inner = Canvas(canvas.depth + 1)

                def item(canvas=canvas, inner=inner, mark=mark):
                    lines = [x for i, x in enumerate(inner.done()) if x or i]
                    canvas.end()
                    for i, x in enumerate(lines or [""]):
                        canvas.line.append((mark if not i else " " * len(mark)) + x)
                        canvas.end(keep=True)

                steps += [("call", item, None, None), ("kids", kid, inner, pre)]
        elif name in ("blockquote", "dd") and canvas.depth < MOST_INDENT:
            inner = Canvas(canvas.depth + 1)

            def quote(canvas=canvas, inner=inner, margin=name == "blockquote"):
                canvas.block(margin)
                for x in inner.done():
                    canvas.line.append(f"  {x}")
                    canvas.end(keep=True)
                canvas.block(margin)

            steps += [("call", quote, None, None), ("kids", node, inner, pre)]
        elif name in CELLS or (name == "text" and node.foreign):  # outside a table
            steps += [("call", lambda c=canvas: c.write(" "), None, None), ("kids", node, canvas, pre)]
        elif name in BLOCK:
            margin = name in MARGIN
            canvas.block(margin)
            steps += [("call", lambda c=canvas, m=margin: c.block(m), None, None), ("kids", node, canvas, pre or name == "pre")]
        elif name == "textarea":
            if not node.veiled:
                canvas.verbatim("".join(x for x in node.kids if isinstance(x, str)))
        elif name == "input":
            if node.attrs.get("type", "").lower() in ("submit", "button", "reset") and not node.veiled:
                canvas.write(node.attrs.get("value", ""))
        else:
            steps.append(("kids", node, canvas, pre))
    return page.done()


def to_text(markup: str) -> str:
    return "\n".join(render(build(markup))).strip("\n")


def _texts(pages: list[bytes | None]) -> list[list]:
    out = [None if p is None else to_text(p.decode("utf-8", "replace")) for p in pages]
    return [out, [None if t is None else len(t) for t in out]]


def extract(pages: DataFrame, *, markup: str = "html", into: str = "rendered") -> DataFrame:
    """pages with a struct ``into``: text and n_chars (code points)."""
    return pages.withColumn(into, scalar_struct(_texts, "struct<text:string,n_chars:bigint>")(F.col(markup)))
