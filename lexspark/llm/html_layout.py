"""Visible text of web pages with their layout: a tree with implied tags, visibility rules, a renderer."""

from __future__ import annotations

import html
import re
import sys
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</?([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|</?[A-Za-z][^>]*>?", re.S
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
#: Elements that are never shown.
UNSEEN = frozenset("head script style template noscript iframe noembed noframes object audio video canvas svg math datalist title meta link base".split())
#: Elements that start on a new line; those of MARGIN leave a blank line around them.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul xmp".split()
)
MARGIN = frozenset("p h1 h2 h3 h4 h5 h6 blockquote ul ol dl pre table figure hr menu xmp".split())
#: Start tags that close an open p, and what closes its own kind up to a boundary.
CLOSES_P = BLOCKS - {"body", "html", "li", "dd", "dt", "legend", "optgroup", "option"}
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
}
SCOPE = frozenset("table td th caption html button object template".split())
#: What an end tag of a table's parts does not reach beyond; open cells and rows within end with it.
TABLE_SCOPE = {"table": frozenset(["html", "template"])} | dict.fromkeys("tr td th tbody thead tfoot caption".split(), frozenset("html table template".split()))

#: Columns and rows that a cell spans, at most (fixed values of the format).
COLUMNS, ROWS = 1000, 65534
#: Calls on the stack for each level of a page, at most.
FRAMES = 4


class Node:
    __slots__ = ("attrs", "children", "depth", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None) -> None:
        self.tag, self.attrs, self.children = tag, attrs or {}, []
        self.depth = 0  # of a root: the most elements open at once


def attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(source):
        found.setdefault(name.lower(), html.unescape(a or b or c))
    return found


def build(source: str) -> Node:
    """The tree of a page. Missing end tags and table rows are implied, stray end tags ignored."""
    root = Node("html")
    open_: list[Node] = [root]
    places: defaultdict[str, list[int]] = defaultdict(list, html=[0])  # of the open elements, by tag
    root.depth = 1

    def close(at: int) -> None:
        for n in open_[at:]:
            places[n.tag].pop()
        del open_[at:]

    def last(tags: set[str] | frozenset[str]) -> int:
        """The place of the innermost open element of tags but the root; 0 without one."""
        return max((own[-1] for t in tags if (own := places.get(t))), default=0)

    def text(value: str) -> None:
        if value:
            open_[-1].children.append(value)

    def pop_to(tags: set[str] | frozenset[str], stop: set[str] | frozenset[str]) -> None:
        at = last(tags)
        if at and at >= last(stop):
            close(at)

    def start(tag: str, attrs: dict[str, str], empty: bool) -> None:
        if tag in CLOSES_P and places["p"]:
            pop_to({"p"}, SCOPE)
        if tag[0] == "h" and tag[1:].isdigit() and open_[-1].tag[0] == "h" and open_[-1].tag[1:].isdigit():
            close(-1)
        if tag in SIBLINGS:
            own, stop = SIBLINGS[tag]
            while last(own) > last(stop):
                pop_to(own, stop)
        if tag in ("td", "th") and open_[-1].tag in ("table", "tbody", "thead", "tfoot"):
            start("tr", {}, False)
        if tag == "tr" and open_[-1].tag == "table":
            start("tbody", {}, False)
        node = Node(tag, attrs)
        open_[-1].children.append(node)
        if not empty:
            places[tag].append(len(open_))
            open_.append(node)
            root.depth = max(root.depth, len(open_))

    at, size = 0, len(source)
    while at < size:
        m = MARK.search(source, at)
        if not m:
            text(source[at:])
            break
        text(source[at : m.start()])
        at = m.end()
        if m.group().startswith("<![CDATA["):
            text(html.escape(m.group()[9:].removesuffix("]]>"), quote=False))
            continue
        if not m[1]:
            continue
        tag = m[1].lower()
        if source[m.start() + 1] == "/":
            if tag == "br":
                open_[-1].children.append(Node("br"))
            elif tag == "p" and not places["p"]:
                open_[-1].children.append(Node("p"))
            elif tag not in ("html", "body"):
                pop_to({tag}, TABLE_SCOPE.get(tag, SCOPE - {tag}))
            continue
        if tag in ("html", "body"):
            if tag == "body":
                pop_to({"head"}, set())
                root.attrs |= attributes(m[2])
            continue
        if open_[-1].tag == "head" and tag not in UNSEEN:
            close(-1)
        start(tag, attributes(m[2]) if m[2] else {}, tag in VOID)
        if tag in RAW and open_[-1].tag == tag:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(source, at)
            text(source[at : end.start() if end else size])
            at = end.end() if end else size
            close(-1)
    return root


def shown(node: Node, seen: bool) -> bool | None:
    """None: neither the element nor anything in it is rendered; else whether its own text is visible."""
    if node.tag in UNSEEN:
        return None
    attrs = node.attrs
    if not attrs:
        return seen
    if "hidden" in attrs and attrs["hidden"].lower() != "until-found" or node.tag == "dialog" and "open" not in attrs:
        return None
    style = attrs.get("style", "").lower().replace(" ", "")
    if style:
        if re.search(r"(?:^|;)display:none(?:!important)?(?:;|$)", style):
            return None
        if m := re.search(r"(?:^|;)visibility:(\w+)", style):
            return m[1] not in ("hidden", "collapse")
    return seen


class Lines:
    """Lines of text under construction; margin: a blank line is due before the next line."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.margin = False

    def inline(self, text: str) -> None:
        text = re.sub(r"[ \t\n\r\f]+", " ", text)
        if text.startswith(" ") and (not self.now or self.now[-1].endswith(" ")):
            text = text[1:]
        if text:
            self.now.append(text)

    def flush(self) -> None:
        line = "".join(self.now).rstrip(" ")
        self.now = []
        if line:
            self.put([line])

    def put(self, lines: list[str]) -> None:
        if self.margin and self.lines:
            self.lines.append("")
        self.margin = False
        self.lines += lines

    def line_break(self) -> None:
        if self.now:
            self.flush()
        elif self.lines and self.lines[-1]:
            self.lines.append("")

    def block(self, margin: bool) -> None:
        self.flush()
        self.margin |= margin


def render_children(node: Node, out: Lines, seen: bool, pre: bool = False) -> None:
    number = None
    for child in node.children:
        if isinstance(child, str):
            if seen:
                value = child if node.tag in ("xmp",) else html.unescape(child)
                if pre:
                    first, *rest = value.split("\n")
                    out.now.append(first)
                    for line in rest:
                        out.put(["".join(out.now)])
                        out.now = [line]
                else:
                    out.inline(value.replace("\xa0", " ") if "\xa0" in value else value)
            continue
        own = shown(child, seen)
        if own is None:
            continue
        tag = child.tag
        if tag == "br":
            out.line_break()
        elif tag == "hr":
            out.block(True)
            if own:
                out.put(["---"])
            out.margin = True
        elif tag in ("li",):
            if number is None:
                start = node.attrs.get("start", "1")
                number = int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1
            if re.fullmatch(r"-?[0-9]{1,9}", child.attrs.get("value", "")):
                number = int(child.attrs["value"])
            lead = f"{number}. " if node.tag == "ol" else "- "
            number += 1
            out.block(False)
            indented(child, out, own, lead)
        elif tag == "dd":
            out.block(False)
            indented(child, out, own, "  ")
        elif tag == "blockquote":
            out.block(True)
            indented(child, out, own, "> ", "> ")
            out.margin = True
        elif tag == "table":
            out.block(True)
            table(child, out, own)
            out.block(True)
        elif tag == "select":
            chosen = [o for o in options(child) if "selected" in o.attrs] or options(child)[:1]
            for o in chosen:
                render_children(o, out, own)
        elif tag == "input":
            if own and child.attrs.get("type", "text").lower() in ("text", "search", "submit", "button", "reset", "email", "tel", "url", "number"):
                out.inline(f" {child.attrs.get('value', '')} ")
        elif tag == "details" and "open" not in child.attrs:
            out.block(False)
            for c in child.children:
                if isinstance(c, Node) and c.tag == "summary":
                    render_children(c, out, own)
                    break
            out.block(False)
        elif tag in BLOCKS:
            out.block(tag in MARGIN)
            if tag in ("pre", "xmp") or "white-space:pre" in child.attrs.get("style", "").replace(" ", ""):
                sub = Lines()
                if child.children and isinstance(child.children[0], str):
                    child.children[0] = child.children[0].removeprefix("\r").removeprefix("\n")
                render_children(child, sub, own, pre=True)
                sub.put(["".join(sub.now)] if sub.now else [])
                while sub.lines and not sub.lines[-1].strip():
                    sub.lines.pop()
                if sub.lines:
                    out.put(sub.lines)
            else:
                render_children(child, out, own, pre)
            out.block(tag in MARGIN)
        else:
            render_children(child, out, own, pre)


def indented(node: Node, out: Lines, seen: bool, lead: str, rest: str | None = None) -> None:
    sub = Lines()
    render_children(node, sub, seen)
    sub.flush()
    pad = " " * len(lead) if rest is None else rest
    if sub.lines:
        out.put([((lead if k == 0 else pad) + line).rstrip() for k, line in enumerate(sub.lines)])


def options(node: Node) -> list[Node]:
    found = []
    for child in node.children:
        if isinstance(child, Node):
            found += [child] if child.tag == "option" else options(child)
    return found


def table_rows(node: Node, seen: bool, loose: list[Node]) -> list[tuple[Node, bool]]:
    """The rows of a table, head first and foot last; what lies outside rows and text outside cells is added to loose."""
    parts: dict[str, list[tuple[Node, bool]]] = {"thead": [], "tbody": [], "tfoot": []}

    def stray(value: str, own: bool) -> None:
        if own and value.strip():
            holder = Node("div")
            holder.children.append(value)
            loose.append(holder)

    def visit(at: Node, part: str, own: bool) -> None:
        for child in at.children:
            if isinstance(child, str):
                stray(child, own)
                continue
            vis = shown(child, own)
            if vis is None:
                continue
            if child.tag == "tr":
                parts[part].append((child, vis))
                for value in child.children:
                    if isinstance(value, str):
                        stray(value, vis)
            elif child.tag in parts:
                visit(child, child.tag, vis)
            elif child.tag not in ("colgroup", "col"):
                loose.append(child)

    visit(node, "tbody", seen)
    return parts["thead"] + parts["tbody"] + parts["tfoot"]


def spanned(cell: Node, name: str, most: int) -> int:
    """How many columns or rows a cell spans, as its attribute says, most at most; 1 if it does not say."""
    value = cell.attrs.get(name, "1")
    return min(max(1, int(value)), most) if value.isascii() and value.isdigit() and len(value) < 20 else 1


def table(node: Node, out: Lines, seen: bool) -> None:
    """Cells padded to their column's width, two blanks between columns; a cell may have several lines.

    A column is where a cell begins; what spans cover besides has no width. Columns are as wide as their cells of a
    span of one."""
    loose: list[Node] = []
    rows = table_rows(node, seen, loose)
    for child in loose:
        holder = Node("div")
        holder.children.append(child)
        render_children(holder, out, seen)
        out.block(False)
    grid: list[list[tuple[int, int, list[str]]]] = []
    above: list[list[int]] = []  # runs of columns that cells of earlier rows cover: first, last + 1, row in which they end
    for number, (row, own) in enumerate(rows):
        cells: list[tuple[int, int, list[str]]] = []
        fresh: list[list[int]] = []
        above = [run for run in above if run[2] > number]
        column = covered = 0
        for cell in row.children:
            if not isinstance(cell, Node) or (vis := shown(cell, own)) is None:
                continue
            while covered < len(above) and above[covered][0] <= column:
                column = max(column, above[covered][1])
                covered += 1
            sub = Lines()
            render_children(cell, sub, vis)
            sub.flush()
            span, deep = spanned(cell, "colspan", COLUMNS), spanned(cell, "rowspan", ROWS)
            cells.append((column, span, sub.lines))
            if deep > 1:
                if fresh and fresh[-1][1:] == [column, number + deep]:
                    fresh[-1][1] += span
                else:
                    fresh.append([column, column + span, number + deep])
            column += span
        if fresh:
            above = sorted(above + fresh)
        grid.append(cells)
    width: dict[int, int] = {}
    for cells in grid:
        for c, span, lines in cells:
            width[c] = max(width.get(c, 0), *map(len, lines), 0) if span == 1 and lines else width.get(c, 0)
    start, at = {}, 0
    for c in sorted(width):
        start[c] = at
        at += width[c] + 2
    made = []
    for cells in grid:
        for k in range(max((len(lines) for _, _, lines in cells), default=0)):
            parts, size = [], 0
            for c, _, lines in cells:
                gap = max(start[c] - size, 2 if parts else 0)
                word = lines[k] if k < len(lines) else ""
                parts += [" " * gap, word]
                size += gap + len(word)
            made.append("".join(parts).rstrip())
    if any(made):
        out.put(made)


def visible_text(source: str | None) -> str:
    """The visible text of a page; empty for null and empty pages."""
    if not source:
        return ""
    root, out = build(source), Lines()
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, limit + FRAMES * root.depth))
    try:
        if (own := shown(root, True)) is not None:
            render_children(root, out, own)
    finally:
        sys.setrecursionlimit(limit)
    out.flush()
    return "\n".join(out.lines).strip("\n")


def extract_text(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """pages with the visible text of html_col in text_col (replaced if it is there).

    Null and empty pages give an empty text, plain text stays as it is but for its blanks, and markup of
    any length, nesting or brokenness gives a text. Rows are independent of each other; nothing is shuffled.
    """

    @F.pandas_udf("string")
    def text(pages: pd.Series) -> pd.Series:
        return pd.Series([visible_text(p) for p in pages], dtype=object)

    return pages.withColumn(text_col, text(F.col(html_col)))


def _count(pattern: str) -> F.Column:
    return F.size(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).cast("long")


def page_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_lines, n_blocks, n_items and text_sha256 of all pages.

    Null and empty pages have an empty text and zeros; repeated rows each get a row, null ids and addresses stay null;
    an empty table gives no rows; other columns are not read."""
    rows = extract_text(pages.select("page_id", "url", "html")).select("page_id", "url", "text")
    blank = F.col("text") == ""
    return rows.select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"),
        F.when(blank, 0).otherwise(_count("\n") + 1).cast("long").alias("n_lines"),
        F.when(blank, 0).otherwise(_count("\n\n+") + 1).cast("long").alias("n_blocks"),
        _count("(?m)^ *(?:- |[0-9]+[.] )").alias("n_items"),
        F.sha2("text", 256).alias("text_sha256"),
    )
