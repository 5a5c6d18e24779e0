"""Readable text of HTML pages."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.sources.files import decoded, one_page

# Elements dropped with all they contain; elements that never have content.
JUNK = {"script", "style", "meta", "noscript", "svg", "nav", "footer", "header", "form"}
HIDDEN = {"template"}
VOID = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
}


class _Reader(HTMLParser):
    """Collects text nodes outside junk elements; an unclosed element ends with its parent."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.dropped, self.node, self.nodes = [], 0, [], []

    def boundary(self):
        if self.node:
            self.nodes.append("".join(self.node))
            self.node = []

    def handle_starttag(self, tag, attrs):
        self.boundary()
        if tag not in VOID:
            self.open.append(tag)
            self.dropped += tag in JUNK or tag in HIDDEN

    def handle_startendtag(self, tag, attrs):
        self.boundary()

    def handle_endtag(self, tag):
        self.boundary()
        if tag in self.open:
            while True:
                closed = self.open.pop()
                self.dropped -= closed in JUNK or closed in HIDDEN
                if closed == tag:
                    break

    def handle_data(self, data):
        if not self.dropped:
            self.node.append(data)

    def handle_comment(self, data):
        self.boundary()

    def handle_decl(self, decl):
        self.boundary()

    def handle_pi(self, data):
        self.boundary()


def readable_text(html: str) -> str:
    reader = _Reader()
    reader.feed(html)
    reader.close()
    reader.boundary()
    stripped = (line.strip() for node in reader.nodes for line in node.splitlines())
    return "\n".join(line for line in stripped if line)


def readable(html: str | None) -> str | None:
    """The text of a page; null for one whose declarations the parser rejects, so that only its file fails."""
    try:
        return None if html is None else readable_text(html)
    except AssertionError:
        return None


@F.arrow_udf(T.StringType())
def html_text(pages: pa.Array) -> pa.Array:
    return pa.array([readable(p) for p in pages.to_pylist()], pa.string())


def load_html(files: DataFrame) -> DataFrame:
    loaded = files.withColumn("_text", html_text(decoded(F.col("content"))))
    message = F.concat(F.lit("extraction failed: "), F.col("filename"), F.lit(" produced no readable text."))
    return (
        loaded.withColumn("pages", one_page(F.col("_text"), "html.parser"))
        .withColumn("error", F.when(F.col("pages").isNull(), message))
        .drop("_text")
    )
