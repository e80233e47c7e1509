"""Documents and artifacts as files: word-processor documents, JSON and CSV, and which file counts."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.text import csv_guard

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
PARTS = re.compile(r"word/(document|header\d*|footer\d*)\.xml\Z")
#: Characters that XML can't hold.
BAD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")
DOCX = "path string, part string, kind string, idx int, row int, text string"


def paragraph_text(p: ET.Element) -> str:
    """Text of a paragraph's runs, tabs and breaks as characters, content controls included."""
    out = []
    for x in p.iter():
        if x.tag == f"{W}t":
            out.append(x.text or "")
        elif x.tag == f"{W}tab":
            out.append("\t")
        elif x.tag in (f"{W}br", f"{W}cr"):
            out.append("\n")
    return "".join(out)


def blocks(root: ET.Element) -> Iterator[tuple[str, int, int, str]]:
    """(kind, place, row, text) of a part in order: paragraphs, and table rows with their cells joined by tabs. A cell that goes on a merged one above is empty."""
    body = root.find(f"{W}body")
    for idx, x in enumerate(c for c in (root if body is None else body) if c.tag in (f"{W}p", f"{W}tbl", f"{W}sdt")):
        if x.tag == f"{W}tbl":
            for row, tr in enumerate(x.iter(f"{W}tr")):
                cells = ["\n".join(paragraph_text(p) for p in tc.iter(f"{W}p")) for tc in tr.findall(f"{W}tc")]
                yield "row", idx, row, "\t".join(cells)
        elif x.tag == f"{W}sdt":
            for p in x.iter(f"{W}p"):
                yield "paragraph", idx, 0, paragraph_text(p)
        else:
            yield "paragraph", idx, 0, paragraph_text(x)


def scan_docx(files: DataFrame) -> DataFrame:
    """(path, content) to (path, part, kind, idx, row, text): body, headers and footers. A file that isn't such a document gives one row of the kind ``unreadable``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in DOCX.split(", ")]
        types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content.as_py() or b"")) as z:
                        for name in sorted(n for n in z.namelist() if PARTS.match(n)):
                            rows += [(path, PARTS.match(name)[1], *b) for b in blocks(ET.fromstring(z.read(name)))]
                except (zipfile.BadZipFile, ET.ParseError, KeyError):
                    rows = [(path, "document", "unreadable", 0, 0, None)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types], names)

    return files.select("path", "content").mapInArrow(run, DOCX)


def read_docx(spark: SparkSession, where: str) -> DataFrame:
    return scan_docx(spark.read.format("binaryFile").load(where))


def docx_bytes(lines: list[str], header: str = "") -> bytes:
    """A small document: lines with tabs become table rows, others paragraphs."""
    run = lambda t: f"<w:r><w:t xml:space='preserve'>{escape(BAD.sub('', t))}</w:t></w:r>"
    par = lambda t: f"<w:p>{run(t)}</w:p>"
    body = "".join("<w:tbl><w:tr>" + "".join(f"<w:tc>{par(c)}</w:tc>" for c in t.split("\t")) + "</w:tr></w:tbl>" if "\t" in t else par(t) for t in lines)
    ns = f"xmlns:w='{W[1:-1]}'"
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
        if header:
            z.writestr("word/header1.xml", f"<w:hdr {ns}>{par(header)}</w:hdr>")
    return buffer.getvalue()


def write_docx(docs: DataFrame, header: str) -> DataFrame:
    """(doc_id, text) to (path, content): one document file a row, as a column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths = [f"doc-{i}.docx" for i in b.column("doc_id").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array([docx_bytes((t or "").split("\n"), header) for t in b.column("text").to_pylist()], pa.binary())], ["path", "content"])

    return docs.select("doc_id", "text").mapInArrow(run, "path string, content binary")


def guarded(df: DataFrame) -> DataFrame:
    """Text cells that a spreadsheet can't run."""
    return df.select(*(csv_guard(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes))


def write_csv(df: DataFrame, where: str) -> None:
    guarded(df).write.option("header", True).option("escape", '"').option("quoteAll", True).csv(where)


def content_rows(entries: DataFrame) -> DataFrame:
    """Entries without headers and breaks."""
    return entries.filter(~F.col("element_type").isin("header", "break"))


def resolve(paths: DataFrame, uid: Column, key: str) -> DataFrame:
    """uid, path: the first file in name order whose prefix is the uid, ended by something that is no letter or digit. One aggregate over the listing."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    ok = F.startswith(name, uid) & ~F.regexp_like(F.substr(name, F.length(uid) + 1, F.lit(1)), F.lit("[A-Za-z0-9]")) & name.contains(key)
    return paths.filter(ok).groupBy(uid.alias("uid")).agg(F.min("path").alias("path"))
