"""Sections, table fields and board lists of web pages, as table functions over a tree of elements.

The functions can be used from SQL, too, after ``register``: SELECT s.* FROM pages, LATERAL page_sections(html) s.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.text import post_date
from corvane.sources.html import FRAME, VOID, mapped

#: What an opening tag closes, if it is open within the nearest of the elements named after it.
CLOSES = {
    "p": ({"p"}, {"td", "th", "li", "div", "table", "body"}), "li": ({"li"}, {"ul", "ol"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), **{t: ({"p"}, {"td", "th", "li", "div", "body"}) for t in ("h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "table", "div")},
}
# Heading levels by class, before those by tag; sizes of titles; where a page's content is.
CLASS_LEVELS = ((2, ("tit-h2", "content-title")), (3, ("tit-h3", "sub-title")), (4, ("tit-h4",)), (5, ("tit-h5",)))
TAG_LEVELS = {"h2": 2, "h3": 3, "h4": 4, "h5": 5}
LONE_LEVEL, LONE_CHARS, TITLE_CHARS = 4, 30, 80
CONTENT_IDS, CONTENT_CLASS = ("content", "wrap"), re.compile(r"(?i)content|sub.?content|body.?content")
NO_TITLE, WHOLE, ITEM, UNNAMED = "안내", "내용", "항목_{}", "내용_{}"


class Node:
    """An element: its tag and attributes, the elements and texts in it, and where it stands."""

    __slots__ = ("attrs", "inside", "parent", "place", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent, self.inside = tag, attrs, parent, []
        self.place = len(parent.inside) if parent else 0
        if parent:
            parent.inside.append(self)

    def elements(self) -> Iterator[Node]:
        """Those below, in the order of the page."""
        left = [x for x in self.inside[::-1] if type(x) is Node]
        while left:
            node = left.pop()
            yield node
            if node.inside and (len(node.inside) > 1 or type(node.inside[0]) is Node):
                left += [x for x in node.inside[::-1] if type(x) is Node]

    def text(self, between: str = "") -> str:
        """The texts below, stripped and joined, without blank ones."""
        if len(self.inside) == 1 and type(self.inside[0]) is str:
            return self.inside[0].strip()
        parts, left = [], list(reversed(self.inside))
        while left:
            x = left.pop()
            if isinstance(x, Node):
                left += reversed(x.inside)
            elif x.strip():
                parts.append(x.strip())
        return between.join(parts)

    def first(self, *tags: str) -> Node | None:
        return next((x for x in self.elements() if x.tag in tags), None)

    def with_class(self, tag: str, name: str) -> Node | None:
        return next((x for x in self.elements() if x.tag == tag and name in x.attrs.get("class", "").split()), None)

    def after(self) -> Iterator[Node]:
        """The elements beside it that follow."""
        return (x for x in self.parent.inside[self.place + 1 :] if isinstance(x, Node)) if self.parent else iter(())


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)
        self.open: list[Node] = []  #: from the root to ``at``, without the root

    def _up(self, to: int) -> None:
        del self.open[to:]
        self.at = self.open[-1] if self.open else self.root

    def handle_starttag(self, tag: str, attrs: list) -> None:
        closed, within = CLOSES.get(tag, ((), ()))
        lowest = len(self.open)
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].tag in within and self.open[i].tag not in closed:
                break
            if self.open[i].tag in closed:
                lowest = i
        self._up(lowest)
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        if tag not in VOID:
            self.open.append(node)
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        Node(tag, {k: v or "" for k, v in attrs}, self.at)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].tag == tag:
                return self._up(i)

    def handle_data(self, data: str) -> None:
        self.at.inside.append(data)


#: A start tag with quoted attributes, an end tag, or a text; elements whose content may be read otherwise are left to the library.
_PIECE = re.compile(r"""<([A-Za-z][A-Za-z0-9]*)((?:[ \t\n]+[A-Za-z_-]+=(?:"(?:[^"<>&]|&amp;)*"|'(?:[^'<>&]|&amp;)*'))*)[ \t\n]*>|</([A-Za-z][A-Za-z0-9]*)>|([^<&]+)""")
_ATTRIBUTE = re.compile(r"""([A-Za-z_-]+)=(?:"([^"]*)"|'([^']*)')""")
_RAW = frozenset({"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "noscript", "xmp", "plaintext"})


def _plain(html: str) -> Node | None:
    """The elements of a page that has nothing but plain tags and texts, as the library's parser would give them, without its cost; else null."""
    builder, at = _Builder(), 0
    for piece in _PIECE.finditer(html) if "<!" not in html else ():
        if piece.start() != at:
            return None
        at = piece.end()
        start, attrs, end, text = piece.groups()
        if text is not None:
            builder.handle_data(text)
        elif end is not None:
            builder.handle_endtag(end.lower())
        elif (tag := start.lower()) in _RAW:
            return None
        else:
            builder.handle_starttag(tag, [(k.lower(), (a or b).replace("&amp;", "&")) for k, a, b in _ATTRIBUTE.findall(attrs)] if attrs else [])
    return builder.root if at == len(html) else None


def tree(html: str, without: frozenset[str] = frozenset()) -> Node:
    """The page's elements; those of the tags ``without`` are left out with all in them."""
    root = _plain(html)
    if root is None:
        builder = _Builder()
        builder.feed(html)
        builder.close()
        root = builder.root
    low = html.lower() if without else ""
    for node in [root, *root.elements()] if any(f"<{t}" in low for t in without) else []:
        kept = [x for x in node.inside if not (isinstance(x, Node) and x.tag in without)]
        if len(kept) < len(node.inside):
            node.inside = kept
            for i, x in enumerate(kept):
                if isinstance(x, Node):
                    x.place = i
    return root


def level_of(node: Node) -> int | None:
    """The level of a heading: by its class, else its tag; a short bold line that is all its parent has counts as level 4."""
    classes = " ".join(node.attrs.get("class", "").split())
    for level, names in CLASS_LEVELS:
        if any(n in classes for n in names):
            return level
    if node.tag in ("strong", "b"):
        own = node.text()
        return LONE_LEVEL if 0 < len(own) <= LONE_CHARS and node.parent and node.parent.text() == own else None
    return TAG_LEVELS.get(node.tag)


def is_heading(node: Node) -> bool:
    return level_of(node) is not None and 0 < len(node.text()) <= TITLE_CHARS


class Fields:
    """Values by name in order; a name that comes again is numbered."""

    def __init__(self) -> None:
        self.values: dict[str, str] = {}
        self.times: dict[str, int] = {}

    def add(self, name: str, value: str) -> None:
        if value := value.strip():
            self.times[name] = self.times.get(name, 0) + 1
            self.values[name if self.times[name] == 1 else f"{name}_{self.times[name]}"] = value


def table_fields(table: Node) -> dict[str, str]:
    """A table's values by name: by the names above if the first of several rows only has names (two or more); else by the
    name that begins a row, equal names' values joined by " / "; rows without a name are numbered."""
    rows = [[c for c in r.elements() if c.tag in ("th", "td")] for r in table.elements() if r.tag == "tr"]
    if not rows:
        return {}
    if len(rows) > 1 and len(rows[0]) > 1 and all(c.tag == "th" for c in rows[0]):
        fields = Fields()
        names = [c.text() for c in rows[0]]
        for row in rows[1:]:
            for name, cell in zip(names, row, strict=False):
                if name:
                    fields.add(name, cell.text(" "))
        return fields.values
    found: dict[str, str] = {}
    unnamed = 0
    for row in rows:
        names, value = [c.text() for c in row if c.tag == "th"], " ".join(c.text(" ") for c in row if c.tag == "td").strip()
        if not any(c.tag == "td" for c in row):
            continue
        if not names:
            unnamed += 1
        name = names[0] if names else UNNAMED.format(unnamed)
        if name and value:
            found[name] = f"{found[name]} / {value}" if name in found else value
    return found


def _content(heading: Node) -> tuple[dict[str, str], str]:
    """What stands beside a heading, up to the next one: fields of tables and lists, and texts."""
    fields, texts = Fields(), []
    for node in heading.after():
        if is_heading(node):
            break
        if node.tag == "table":
            for name, value in table_fields(node).items():
                fields.add(name, value)
        elif node.tag in ("ul", "ol"):
            for i, item in enumerate((x for x in node.elements() if x.tag == "li"), 1):
                fields.add(ITEM.format(i), item.text(" "))
        elif node.tag in ("p", "div", "span"):
            texts.append(node.text(" "))
    return fields.values, "\n".join(t for t in texts if t)


def sections(html: str) -> Iterator[tuple[int | None, str, str, dict[str, str]]]:
    """(level, title, text, fields) of the page's sections that have something in them.

    A title from level 4 on comes after the last one of level 3, until a title of level 2. A page without headings is one section.
    """
    root = tree(html, FRAME)
    nodes = list(root.elements())
    by_id = [next((x for x in nodes if x.attrs.get("id") == i), None) for i in CONTENT_IDS]
    by_class = next((x for x in nodes if any(CONTENT_CLASS.search(c) for c in x.attrs.get("class", "").split())), None)
    area = next((x for x in (*by_id, by_class, root.first("body")) if x), root)
    headings = [x for x in area.elements() if is_heading(x)]
    if not headings:
        title, text = root.first("title"), area.text("\n")
        if text:
            yield None, title.text() if title else NO_TITLE, text, {WHOLE: text}
        return
    above = ""
    for heading in headings:
        level, title = level_of(heading), heading.text()
        above = "" if level == 2 else title if level == 3 else above
        shown = f"{above} > {title}" if level > 3 and above and above not in title else title
        fields, text = _content(heading)
        if fields or text:
            yield level, shown, text, fields


def board_posts(html: str, base: str = "", board: str = "") -> Iterator[tuple[str, str, str | None, bool]]:
    """(url, title, date as written, pinned) of a board's list: rows with a linked subject whose address has ``board`` in it. A row
    without a number in its number cell is pinned."""
    root = tree(html)
    nodes = list(root.elements())
    homes = [x for x in nodes if x.tag == "div" and "tbl_wrap" in x.attrs.get("class", "").split()] + [x for x in nodes if x.attrs.get("id") == "bo_list"] + [root]
    bodies = (b for home in homes for t in home.elements() if t.tag == "table" and (b := t.first("tbody")))
    body = next(bodies, None)
    for row in (x for x in body.elements() if x.tag == "tr") if body else ():
        subject = row.with_class("td", "td_subject")
        link = next((x for x in subject.elements() if x.tag == "a" and "href" in x.attrs), None) if subject else None
        if link is None or not link.text():
            continue
        number, day = row.with_class("td", "td_num"), row.with_class("td", "td_date") or row.with_class("td", "td_datetime")
        url = urljoin(base, link.attrs["href"])
        if board in url:
            yield url, link.text(), day.text() if day else None, not (number and number.text().isdigit())


FIELDS = "array<struct<name: string, value: string>>"


def _section_rows(html: str) -> Iterator[tuple]:
    for i, (level, title, text, fields) in enumerate(sections(html)):
        yield i, level, title, text, [{"name": k, "value": v} for k, v in fields.items()]


def _field_rows(html: str) -> Iterator[tuple]:
    for i, table in enumerate(x for x in tree(html, FRAME).elements() if x.tag == "table"):
        for j, (name, value) in enumerate(table_fields(table).items()):
            yield i, j, name, value


def _post_rows(html: str, base: str, board: str) -> Iterator[tuple]:
    for i, post in enumerate(board_posts(html, base, board)):
        yield i, *post


class _Sections:
    def eval(self, html: str):
        for *row, fields in _section_rows(html or ""):
            yield *row, [tuple(f.values()) for f in fields]


class _Tables:
    def eval(self, html: str):
        yield from _field_rows(html or "")


class _Posts:
    def eval(self, html: str, base: str, board: str):
        yield from _post_rows(html or "", base or "", board or "")


page_sections_udtf = F.udtf(_Sections, returnType=f"seq int, level int, title string, text string, fields {FIELDS}")
page_fields_udtf = F.udtf(_Tables, returnType="table int, seq int, name string, value string")
board_posts_udtf = F.udtf(_Posts, returnType="seq int, url string, title string, posted string, pinned boolean")


def register(spark: SparkSession) -> None:
    """Make page_sections(html), page_fields(html) and board_posts(html, base, board) usable in SQL."""
    for name, f in (("page_sections", page_sections_udtf), ("page_fields", page_fields_udtf), ("board_posts", board_posts_udtf)):
        spark.udtf.register(name, f)


# Over a table of pages the same rows are made batch by batch: calling a table function for each page costs more than a small page's parsing.
_INT, _TEXT = ("int", pa.int32()), ("string", pa.string())
_SECTION = {"seq": _INT, "level": _INT, "title": _TEXT, "text": _TEXT, "fields": (FIELDS, pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())])))}
_FIELD = {"table": _INT, "seq": _INT, "name": _TEXT, "value": _TEXT}
_POST = {"seq": _INT, "url": _TEXT, "title": _TEXT, "posted": _TEXT, "pinned": ("boolean", pa.bool_())}


def page_sections(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, seq, level, title, text, fields) of each page; null html has none."""
    return mapped(pages, key, html, _SECTION, _section_rows)


def page_fields(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, table, seq, name, value) of each page's tables."""
    return mapped(pages, key, html, _FIELD, _field_rows)


def list_posts(pages: DataFrame, term_start: Column, key: str = "page_id", html: str = "html", base: str = "", board: str = "") -> DataFrame:
    """(key, seq, url, title, posted, pinned) of board lists, posts before the term's start only if pinned, and none after the first
    numbered post that is older."""
    posts = mapped(pages, key, html, _POST, lambda h: _post_rows(h, base, board)).withColumn("posted", post_date(F.col("posted")))
    old = ~F.col("pinned") & F.coalesce(F.col("posted") < term_start, F.lit(False)) & F.col(key).isNotNull()
    stop = F.min(F.when(old, F.col("seq"))).over(Window.partitionBy(key))  # pages are read once
    return posts.withColumn("_stop", stop).where(F.col("_stop").isNull() | (F.col("seq") < F.col("_stop"))).drop("_stop")
