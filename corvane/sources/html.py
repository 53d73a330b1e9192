"""The text of web pages. Parsing is Python, batch by batch; what follows is columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HIDDEN = frozenset({"script", "style", "noscript"})
FRAME = HIDDEN | {"nav", "header", "footer"}
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"})

#: Bytes of a batch of pages, about, and pages that are objects at a time.
BATCH_BYTES, AT_ONCE = 4 << 20, 64
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


class _Reader(HTMLParser):
    """Pieces of text outside hidden elements."""

    def __init__(self, hidden: frozenset[str]) -> None:
        super().__init__(convert_charrefs=True)
        self.hidden, self.depth = hidden, 0
        self.pieces: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.depth += tag in self.hidden

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        """An element closed at once hides nothing."""

    def handle_endtag(self, tag: str) -> None:
        if tag in self.hidden:
            self.depth = max(0, self.depth - 1)

    def handle_data(self, data: str) -> None:
        if not self.depth:
            self.pieces.append(data)


def read(html: str, hidden: frozenset[str]) -> _Reader:
    reader = _Reader(hidden)
    reader.feed(html or "")
    reader.close()
    return reader


def text_of(html: str, hidden: frozenset[str] = HIDDEN) -> str:
    """The visible lines, stripped, without blank ones; every element ends a line."""
    lines = (line.strip() for piece in read(html, hidden).pieces for line in piece.splitlines())
    return "\n".join(line for line in lines if line)


def mapped(pages: DataFrame, key: str, html: str, columns: dict[str, tuple[str, pa.DataType]], rows_of: Callable[[str], Iterable[tuple]]) -> DataFrame:
    """(key, *columns): the rows of each page. A task holds a batch of ``BATCH_BYTES``, and ``AT_ONCE`` pages of it as objects."""
    spark = pages.sparkSession
    if int(spark.conf.get(_BATCH, str(1 << 30)).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(start, AT_ONCE)
                of: list[int] = []
                rows: list[tuple] = []
                for i, page in enumerate(part.column(1)):
                    found = list(rows_of(page.as_py() or ""))
                    of += [i] * len(found)
                    rows += found
                values = zip(*rows, strict=True) if rows else [()] * len(columns)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of, pa.int64())), *(pa.array(v, t) for v, (_, t) in zip(values, columns.values(), strict=True))], [key, *columns])

    return pages.select(key, html).mapInArrow(run, ", ".join([f"`{key}` {pages.schema[key].dataType.simpleString()}", *(f"`{c}` {kind}" for c, (kind, _) in columns.items())]))


def page_texts(pages: DataFrame, key: str = "page_id", html: str = "html", main_only: bool = False) -> DataFrame:
    """(key, text); main_only leaves navigation, headers and footers out. Null html is an empty text."""
    return mapped(pages, key, html, {"text": ("string", pa.string())}, lambda h: [(text_of(h, FRAME if main_only else HIDDEN),)])


def within_term(posted: Column, pinned: Column, term_start: Column) -> Column:
    """Whether a board's post is still to be read: those of before the term only if pinned."""
    return pinned | (posted >= term_start)
