"""Documents of several formats as sections ``(paper_id, section_no, heading, text)``."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions.text import strip

SECTIONS = "array<struct<heading:string,text:string>>"


def fold_lines(lines: DataFrame, joiner: str, with_page: bool = False) -> DataFrame:
    """Sections from lines ``(paper_id, pos, line, is_heading[, page])``.

    A heading starts a section; the heading carries on until the next one. A heading without a line
    below it is dropped.
    """
    w = Window.partitionBy("paper_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    run = lines.withColumn("run", F.sum(F.col("is_heading").cast("int")).over(w))
    heads = F.max(F.when(F.col("is_heading"), F.col("line"))).alias("heading")
    body = F.sort_array(F.collect_list(F.when(~F.col("is_heading"), F.struct("pos", "line"))))
    extra = [F.min_by("page", "pos").alias("page")] if with_page else []
    out = run.groupBy("paper_id", "run").agg(heads, body.alias("body"), *extra).where(F.size("body") > 0)
    order = Window.partitionBy("paper_id").orderBy("run")
    text = F.array_join(F.transform("body", lambda x: x["line"]), joiner)
    return out.select("paper_id", (F.row_number().over(order) - 1).cast("long").alias("section_no"), "heading", text.alias("text"), *(["page"] if with_page else []))


def parse_txt(files: DataFrame) -> DataFrame:
    """One section without a heading for each text ``(paper_id, text)`` that is not blank."""
    return files.select("paper_id", F.lit(0).cast("long").alias("section_no"), F.lit(None).cast("string").alias("heading"), strip("text").alias("text")).where("text <> ''")


def parse_markdown(files: DataFrame) -> DataFrame:
    """Sections of ``(paper_id, text)``: lines of one to six ``#`` and white space start one; blank lines go."""
    lines = files.select("paper_id", F.posexplode(F.split("text", r"\r\n|[\n\r\u000B\u000C\u001C-\u001E\u0085  ]")).alias("pos", "raw"))
    mark = F.regexp_extract("raw", r"^#{1,6}\s+(.*)$", 1)
    is_heading = F.col("raw").rlike(r"^#{1,6}\s+(.*)$")
    lines = lines.select("paper_id", "pos", F.when(is_heading, strip(mark)).otherwise(F.col("raw")).alias("line"), is_heading.alias("is_heading"))
    lines = lines.where(F.col("is_heading") | F.col("line").rlike(r"\S"))
    out = fold_lines(lines, "\n").withColumn("text", strip("text"))
    return out.where("text <> ''")


def layout_sections(lines: DataFrame) -> DataFrame:
    """Sections of laid-out lines ``(paper_id, pos, page, line, size)``.

    The body size is the most frequent size of a paper, the first seen at a tie. Short lines that do
    not trail off and are 15 % larger are headings. A section's page is that of its first line.
    """
    counted = lines.groupBy("paper_id", "size").agg(F.count("*").alias("n"), F.min("pos").alias("seen"))
    body = counted.groupBy("paper_id").agg(F.min_by("size", F.struct((-F.col("n")).alias("n"), "seen")).alias("body"))
    heading = (F.length("line") > 0) & (F.length("line") <= 80) & ~F.col("line").rlike("[.,;]$") & (F.col("body") > 0) & (F.col("size") >= F.col("body") * 1.15)
    return fold_lines(lines.join(body, "paper_id").withColumn("is_heading", heading), " ", with_page=True)


class _Blocks(HTMLParser):
    """Text of headings and blocks in document order; script and style are left out.

    Every open element collects the text inside it, nested or not, so a block within a block gives
    its text twice; an element that is never closed ends with its parent.
    """

    HEADS = ("h1", "h2", "h3", "h4", "h5", "h6")
    KINDS = (*HEADS, "p", "li", "td", "th", "blockquote", "pre")
    VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, list[str] | None]] = []
        self.found: list[tuple[str, list[str]]] = []
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        if tag in self.VOID:
            return
        parts: list[str] | None = None
        if tag in self.KINDS and not self.skip:
            parts = []
            self.found.append((tag, parts))
        self.skip += tag in ("script", "style")
        self.open.append((tag, parts))

    def handle_startendtag(self, tag, attrs):
        """Nothing is inside."""

    def handle_endtag(self, tag):
        if tag in [t for t, _ in self.open]:
            while True:
                last, _ = self.open.pop()
                self.skip -= last in ("script", "style")
                if last == tag:
                    break

    def handle_data(self, data):
        text = data.strip()
        if text and not self.skip:
            for _, parts in self.open:
                if parts is not None:
                    parts.append(text)


def html_sections(html: str) -> list[dict]:
    blocks = _Blocks()
    blocks.feed(html)
    blocks.close()
    return grouped((tag in _Blocks.HEADS, "".join(parts)) for tag, parts in blocks.found)


def grouped(parts) -> list[dict]:
    """Sections of ``(is_heading, text)`` in order; empty texts and headings without text below go."""
    out: list[dict] = []
    heading, held = None, []
    for is_heading, text in parts:
        if not text:
            continue
        if is_heading:
            if held:
                out.append({"heading": heading, "text": "\n".join(held)})
            heading, held = text, []
        else:
            held.append(text)
    if held:
        out.append({"heading": heading, "text": "\n".join(held)})
    return out


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_sections(content: bytes) -> list[dict]:
    """Paragraphs and tables of a word-processor file in body order; ``Heading`` styles start sections."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{_W}body")
        names = {}
        if "word/styles.xml" in archive.namelist():
            for style in ElementTree.fromstring(archive.read("word/styles.xml")).iter(f"{_W}style"):
                name = style.find(f"{_W}name")
                names[style.get(f"{_W}styleId")] = name.get(f"{_W}val", "") if name is not None else ""

    def text_of(element) -> str:
        return "".join(t.text or "" for t in element.iter(f"{_W}t")).strip()

    def parts():
        for element in body if body is not None else ():
            if element.tag == f"{_W}p":
                style = element.find(f"{_W}pPr/{_W}pStyle")
                style_id = style.get(f"{_W}val", "") if style is not None else ""
                yield names.get(style_id, style_id).lower().startswith("heading"), text_of(element)
            elif element.tag == f"{_W}tbl":
                rows = [" | ".join(text_of(cell) for cell in row.findall(f"{_W}tc")) for row in element.findall(f"{_W}tr")]
                yield False, "\n".join(r for r in rows if r.strip())

    return grouped(parts())


def sections_by(parser: Callable[[object], list[dict]]) -> Callable[[DataFrame, str], DataFrame]:
    """A parser of one value as a DataFrame operator on ``(paper_id, <column>)``."""

    def apply(files: DataFrame, column: str) -> DataFrame:
        @F.pandas_udf(SECTIONS)
        def run(values: pd.Series) -> pd.Series:
            return values.map(lambda v: parser(v) if v is not None else [])

        return files.select("paper_id", F.posexplode(run(column)).alias("section_no", "s")).select("paper_id", F.col("section_no").cast("long").alias("section_no"), "s.heading", "s.text")

    return apply


parse_html = sections_by(html_sections)
parse_docx = sections_by(docx_sections)

#: Parsers by extension; callers may add their own.
EXTENSIONS = {".pdf": "pdf", ".docx": "docx", ".txt": "txt", ".md": "markdown", ".markdown": "markdown", ".html": "html", ".htm": "html"}


def parser_name(filename: Column) -> Column:
    """The parser that a file name asks for, by its extension in any case; null if there is none."""
    extension = F.lower(F.regexp_extract(filename, r"(\.[^./\\]*)$", 1))
    routes = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.try_element_at(routes, extension)


def atom_entry(entry: Column) -> dict[str, Column]:
    """Columns of one Atom entry (XML text): id without version, title, abstract, date, PDF address."""
    squeeze = lambda c: strip(F.regexp_replace(c, r"\s+", " "))
    get = lambda path: F.xpath_string(entry, F.lit(path))
    return {
        "arxiv_id": F.split(F.regexp_extract(get("entry/id"), r"([^/]*)$", 1), "v")[0],
        "title": squeeze(get("entry/title")),
        "abstract": squeeze(get("entry/summary")),
        "authors": F.array_join(F.transform(F.xpath(entry, F.lit("entry/author/name/text()")), strip), ";"),
        "category": F.array_join(F.xpath(entry, F.lit("entry/category/@term")), ";"),
        "published_date": F.to_date(F.try_to_timestamp(F.substring(get("entry/published"), 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))),
        "pdf_url": get("entry/link[@title='pdf']/@href"),
    }
