"""Word reports: their paragraphs as rows, and as markdown.

A file is a zip of markup.  Its body's paragraphs come in order with the names of their styles; what stands in tables is not read, but tables are counted.  A file that cannot be
read gives one row that says why, and the others are read all the same.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as X

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Namespaces and parts of the format.
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_REL = "{http://schemas.openxmlformats.org/package/2006/relationships}Relationship"
PARAGRAPHS = "rel_path string, pos int, style string, text string, links array<string>, tables int, error string"


def _text(node: X.Element) -> str:
    """What runs say: texts, tabs and breaks; text that is deleted or that a field's code holds is not said."""
    out = []
    for x in node.iter():
        if x.tag == f"{_W}t":
            out.append(x.text or "")
        elif x.tag == f"{_W}tab":
            out.append("\t")
        elif x.tag in (f"{_W}br", f"{_W}cr"):
            out.append("\n")
    return "".join(out)


def _paragraphs(content: bytes) -> Iterator[tuple[str, str, list[str], int]]:
    """style, text, link targets and number of tables of each paragraph of the body."""
    with zipfile.ZipFile(io.BytesIO(content)) as package:
        names = set(package.namelist())
        body = X.fromstring(package.read("word/document.xml")).find(f"{_W}body")
        if body is None:
            raise ValueError("it has no body")
        styles, targets = {}, {}
        if "word/styles.xml" in names:
            for s in X.fromstring(package.read("word/styles.xml")).iter(f"{_W}style"):
                name = s.find(f"{_W}name")
                styles[s.get(f"{_W}styleId")] = name.get(f"{_W}val") if name is not None else ""
        if "word/_rels/document.xml.rels" in names:
            targets = {r.get("Id"): r.get("Target") for r in X.fromstring(package.read("word/_rels/document.xml.rels")).iter(_REL)}
    tables = len(body.findall(f"{_W}tbl"))
    for p in body.findall(f"{_W}p"):
        kind = p.find(f"{_W}pPr/{_W}pStyle")
        style = kind.get(f"{_W}val") if kind is not None else ""
        links = [targets.get(h.get(f"{_R}id")) for h in p.iter(f"{_W}hyperlink")]
        yield styles.get(style, style) or "", _text(p).strip(), [x for x in links if x], tables


def word_paragraphs(files: DataFrame) -> DataFrame:
    """rel_path, pos, style, text, links, tables, error of files (rel_path, content)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["rel_path", "pos", "style", "text", "links", "tables", "error"]
        for pdf in frames:
            for path, content in zip(pdf["rel_path"], pdf["content"]):
                try:
                    rows = [(path, i, *p, None) for i, p in enumerate(_paragraphs(bytes(content or b"")))]
                except Exception as error:  # whatever is wrong with a file is said of that file
                    rows = [(path, 0, "", "", [], 0, f"{type(error).__name__}: {error}")]
                yield pd.DataFrame(rows, columns=columns)

    return files.select("rel_path", "content").mapInPandas(run, PARAGRAPHS)


def word_markdown(paragraphs: DataFrame) -> DataFrame:
    """rel_path, text, note, error: titles and headings as marks of their level, list paragraphs as items, links behind the words they stand under where those do not say them."""
    level = F.regexp_extract(F.trim("style"), r"(?i)^heading ([1-9])$", 1)
    apart = F.filter("links", lambda t: ~F.contains(F.col("text"), t))
    said = F.trim(F.concat("text", F.when(F.size(apart) > 0, F.concat(F.lit(" ("), F.array_join(apart, ", "), F.lit(")"))).otherwise("")))
    line = F.when(said == "", "").when(F.lower(F.trim("style")) == "title", F.concat(F.lit("# "), said)).when(level != "", F.concat(F.repeat(F.lit("#"), level.cast("int")), F.lit(" "), said)).when(F.contains(F.lower("style"), F.lit("list")), F.concat(F.lit("- "), said)).otherwise(said)
    whole = paragraphs.groupBy("rel_path").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("ls"), F.max("tables").alias("tables"), F.max("error").alias("error"))
    text = F.concat(F.array_join(F.transform("ls", lambda x: x["line"]), "\n"), F.lit("\n"))
    note = F.when(F.col("tables") > 0, F.concat(F.lit("tables that were not read: "), F.col("tables").cast("string")))
    return whole.select("rel_path", F.when(F.col("error").isNull(), text).alias("text"), note.alias("note"), "error")
