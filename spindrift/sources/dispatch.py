"""Files of any kind to sections: a table function that sends each file to the parser that its name asks for."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from spindrift.sources.parsers import EXTENSIONS, docx_sections, grouped, html_sections

HEADING = re.compile(r"#{1,6}\s+(.*)$")


def text_of(content: bytes) -> str:
    return content.decode("utf-8", "replace")


def plain_sections(content: bytes) -> list[dict]:
    text = text_of(content).strip()
    return [{"heading": None, "text": text}] if text else []


def markdown_sections(content: bytes) -> list[dict]:
    """A heading starts a section; blank lines go, and sections without text."""
    parts = []
    for line in text_of(content).splitlines():
        heading = HEADING.match(line)
        if heading or line.strip():
            parts.append((bool(heading), heading[1].strip() if heading else line))
    found = grouped(parts)
    return [s | {"text": s["text"].strip()} for s in found if s["text"].strip()]


#: Parsers by name; a name that is not here is known, but cannot be read.
PARSERS: dict[str, Callable[[bytes], list[dict]]] = {
    "txt": plain_sections,
    "markdown": markdown_sections,
    "html": lambda content: html_sections(text_of(content)),
    "docx": docx_sections,
}


@udtf(returnType="parser string, status string, section_no long, heading string, text string")
class ParseFile:
    """Rows of a file: its sections, or one row that says why there are none.

    ``status`` is ``parsed``, ``empty``, ``unsupported`` (no parser for the name, or none that can be had), or
    ``error: <what the parser said>``.
    """

    def eval(self, path: str, content: bytes) -> Iterator[tuple]:
        extension = re.search(r"(\.[^./\\]*)$", path or "")
        name = EXTENSIONS.get(extension[1].lower()) if extension else None
        if name not in PARSERS:
            yield name, "unsupported", None, None, None
            return
        try:
            sections = PARSERS[name](bytes(content or b""))
        except Exception as e:  # one file that cannot be read does not end the others
            yield name, f"error: {type(e).__name__}", None, None, None
            return
        if not sections:
            yield name, "empty", None, None, None
        for i, s in enumerate(sections):
            yield name, "parsed", i, s["heading"], s["text"]


def parse_files(files: DataFrame) -> DataFrame:
    """``(path, parser, status, section_no, heading, text)`` of files ``(path, content)``, as a binary file scan gives them."""
    held = files.select("path", "content")
    return held.lateralJoin(ParseFile(F.col("path").outer(), F.col("content").outer())).drop("content")


def scan_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """The files below a folder whose names match, each with its content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
