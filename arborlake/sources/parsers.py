"""Parsers: documents in, nodes out. Plain text, code, tables and page JSON are built-in expressions; only the tokenising of markup and of containers is Python."""

from __future__ import annotations

import functools
import io
import json
import math
import re
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from decimal import Decimal
from itertools import chain, islice
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import headings as H
from ..functions.text import extension, file_name, trim, word_count
from ..operators.tree import MAX_LEVEL, NODE_COLUMNS, line_events, with_paths, with_roots

# --- Fixed values: types and languages by file extension, and MIME types. ---
DOC_TYPES = {"md": "markdown", "markdown": "markdown", "txt": "plain_text", "text": "plain_text", "log": "plain_text", "pdf": "pdf", "docx": "word", "csv": "csv", "xlsx": "spreadsheet", "xls": "spreadsheet", "ods": "spreadsheet"}
LANGUAGES = {
    "rs": "rust", "py": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "mts": "typescript", "jsx": "jsx", "tsx": "tsx", "go": "go", "java": "java", "c": "c", "h": "c",
    "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "cs": "csharp", "rb": "ruby", "php": "php", "swift": "swift", "kt": "kotlin", "kts": "kotlin", "sql": "sql", "sh": "shell", "bash": "shell", "zsh": "shell",
    "toml": "toml", "yaml": "yaml", "yml": "yaml", "json": "json", "xml": "xml", "html": "html", "htm": "html", "css": "css", "scss": "css", "sass": "css", "less": "css",
}
MIME_TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "svg": "image/svg+xml", "tiff": "image/tiff", "tif": "image/tiff", "webp": "image/webp", "emf": "image/emf", "wmf": "image/wmf"}
EMPTY_PDF = "This PDF contains scanned images or no extractable text. Use a vision-capable provider to describe image content."


def _lookup(key: Column, values: dict[str, str], default: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key), F.lit(default))


def doc_type(path: Column) -> Column:
    return _lookup(extension(path), DOC_TYPES | dict.fromkeys(LANGUAGES, "code"), "plain_text")


def language(path: Column) -> Column:
    return _lookup(extension(path), LANGUAGES, "text")


def mime_type(ext: Column) -> Column:
    return _lookup(F.lower(ext), MIME_TYPES, "application/octet-stream")


def validate_path(path: str) -> Path:
    """A file that may be read; ValueError for an empty path, one with .., or none that exists."""
    if not path.strip():
        raise ValueError("File path is required.")
    if ".." in path:
        raise ValueError("File path must not contain '..' traversal.")
    p = Path(path)
    if not p.is_file():
        raise ValueError(f"Not a file: {path}" if p.exists() else f"File does not exist: {path}")
    return p


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the path), name, doc_type, text of whole files."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))
    return rows.select("doc_id", file_name(F.col("doc_id")).alias("name"), doc_type(F.col("doc_id")).alias("doc_type"), "text")


def read_binaries(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.format("binaryFile").load(path)
    return rows.select(F.col("path").alias("doc_id"), file_name(F.col("path")).alias("name"), doc_type(F.col("path")).alias("doc_type"), F.col("content").alias("data"))


def _roots(docs: DataFrame) -> DataFrame:
    name = F.col("name") if "name" in docs.columns else F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    return docs.select("doc_id", name.alias("name"))


def _tree(events: DataFrame, docs: DataFrame, levels: int = MAX_LEVEL) -> DataFrame:
    """Nodes of events (doc_id, idx, node_type, level, content) under their documents' roots."""
    return with_roots(with_paths(events, levels=levels), _roots(docs))


def parse_plain(docs: DataFrame) -> DataFrame:
    """Paragraphs between blank lines."""
    parts = docs.select("doc_id", F.posexplode(F.split("text", "\n\n")).alias("idx", "content")).withColumn("content", trim(F.col("content"))).filter("content <> ''")
    return _tree(parts.select("doc_id", "idx", F.lit("paragraph").alias("node_type"), F.lit(None).cast("int").alias("level"), "content"), docs)


def code_blocks(docs: DataFrame, size: int = fixed.LINES_PER_BLOCK) -> DataFrame:
    """doc_id, block, content, line_start, line_end, word_count of runs of 60 lines; line_end is that of a full run. Blank runs drop out."""
    rows = docs.select("doc_id", F.split("text", "\r?\n").alias("x"))
    rows = rows.withColumn("x", F.when(F.element_at("x", -1) == "", F.slice("x", F.lit(1), F.size("x") - 1)).otherwise(F.col("x")))
    starts = F.sequence(F.lit(1), F.greatest(F.size("x"), F.lit(1)), F.lit(size))
    rows = rows.select("doc_id", "x", F.posexplode(starts).alias("block", "line_start")).withColumn("content", F.array_join(F.slice("x", F.col("line_start"), F.lit(size)), "\n"))
    return rows.filter(trim(F.col("content")) != "").select("doc_id", "block", "content", "line_start", ((F.col("block") + 1) * size).alias("line_end"), word_count(F.col("content")).alias("word_count"))


def parse_code(docs: DataFrame) -> DataFrame:
    blocks = code_blocks(docs)
    return _tree(blocks.select("doc_id", F.col("block").alias("idx"), F.lit("code_block").alias("node_type"), F.lit(None).cast("int").alias("level"), "content"), docs)


def page_texts(docs: DataFrame) -> DataFrame:
    """doc_id, page, text of page JSON: [{page, text}] or {pages: [...]}; a missing page is its place, blank texts drop out, bad JSON has none."""
    kind = "array<struct<page:int,text:string>>"
    bare = F.from_json("text", kind)
    wrapped = F.from_json("text", f"struct<pages:{kind}>").getField("pages")
    pages = F.when(F.ltrim("text").startswith("["), bare).otherwise(wrapped)
    rows = docs.select("doc_id", F.posexplode(pages).alias("k", "p")).select("doc_id", F.coalesce("p.page", F.col("k") + 1).alias("page"), "p.text")
    return rows.filter(trim(F.coalesce("text", F.lit(""))) != "")


def _cut_lines(pages: DataFrame) -> DataFrame:
    """pages (page, text and others) as lines, without headings that they are fused with: the line's place in the page is k, k2, k3."""
    kept = [c for c in pages.columns if c != "text"]
    rows = pages.select(*kept, F.posexplode(F.split("text", "\n")).alias("k", "line")).withColumn("line", trim(F.col("line")))
    rows = rows.select(*kept, "k", F.posexplode(H.split_fused("line")).alias("k2", "line"))
    return rows.select(*kept, "k", "k2", F.posexplode(H.split_leading(F.col("line"))).alias("k3", "line"))


def page_lines(pages: DataFrame, split: bool = True) -> DataFrame:
    """doc_id, page, idx, line, level of pages' lines; split cuts headings out of lines they are fused with."""
    if split:
        rows = _cut_lines(pages.select("doc_id", "page", "text"))
    else:
        rows = pages.select("doc_id", "page", F.posexplode(F.split("text", "\n")).alias("k", "line")).withColumn("line", trim(F.col("line"))).withColumns({"k2": F.lit(0), "k3": F.lit(0)})
    idx = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "k", "k2", "k3"))
    return rows.select("doc_id", "page", idx.alias("idx"), "line", H.heading_level(F.col("line")).alias("level"))


def parse_pdf_text(docs: DataFrame) -> DataFrame:
    """Extracted text with form feeds between pages: a section for each of several pages, headings by rule, paragraphs between; a text without any gets a notice.

    Pages and whether there are several are parts of a line's place, so that lines are parsed and dealt by document once.
    """
    text = F.when(trim(F.coalesce("text", F.lit(""))) == "", F.lit(EMPTY_PDF)).otherwise(F.col("text"))
    texts = docs.select("doc_id", F.split(text, "\f").alias("texts")).withColumn("several", F.size("texts") > 1)
    pages = texts.select("doc_id", "several", F.posexplode("texts").alias("page", "text"))
    place = F.struct("page", "k", "k2", "k3", "several").alias("idx")
    lines = _cut_lines(pages).withColumn("level", H.heading_level(F.col("line")))
    # below a page's section; their own levels come back at the end
    lines = lines.select("doc_id", place, "line", (F.col("level") + F.col("several").cast("int")).alias("level"), F.lit(False).alias("apart"))
    heads = texts.filter("several").select("doc_id", "several", F.explode(F.sequence(F.lit(0), F.size("texts") - 1)).alias("page")).withColumns({"k": F.lit(-1), "k2": F.lit(0), "k3": F.lit(0)})
    heads = heads.select("doc_id", place, F.concat(F.lit("Page "), F.col("page") + 1).alias("line"), F.lit(1).alias("level"), F.lit(True).alias("apart"))
    nodes = with_paths(line_events(lines.unionByName(heads)), levels=5)
    page = (F.col("depth") == 1) & (F.col("node_type") == "section")
    own = F.when(F.col("idx.several"), F.when(~page, F.col("level") - 1)).otherwise(F.col("level"))
    return with_roots(nodes.withColumn("level", own), _roots(docs))


def parse_page_json(docs: DataFrame) -> DataFrame:
    """Page JSON: headings by rule without page sections, lines as they are, titles cut at 80 bytes without a mark."""
    lines = page_lines(page_texts(docs), split=False)
    events = line_events(lines.select("doc_id", "idx", "line", "level"))
    cut = F.when(F.col("node_type") == "section", H.title(F.col("content"), "")).otherwise(F.col("content"))
    return _tree(events.withColumn("content", cut), docs)


# --- markup ---
_EVENTS = "doc_id {}, idx int, node_type string, level int, content string, detail string"
_NAMES = ["doc_id", "idx", "node_type", "level", "content", "detail"]
_HEADING = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})\s*([^`\s]*)")
_ITEM = re.compile(r"^\s*(?:[-*+]|\d{1,9}[.)])\s+(.*)$")
_IMAGE = re.compile(r"!\[([^\]]*)\]\(\s*<?([^)\s>]+)[^)]*\)")
_LINK = re.compile(r"\[([^\]]*)\]\([^)]*\)")
_MARKS = re.compile(r"(?<!\w)(\*\*|__|\*|_)(?=\S)(.+?)(?<=\S)\1(?!\w)")


def _inline(text: str) -> str:
    return _MARKS.sub(r"\2", _LINK.sub(r"\1", text)).strip()


def markdown_events(text: str) -> list[tuple]:
    """(node_type, level, content, detail) in order: sections, paragraphs, code blocks (detail: language), list items, images (detail: address)."""
    out, para, lines, i = [], [], (text or "").split("\n"), 0

    def flush() -> None:
        joined = "\n".join(para)
        for m in _IMAGE.finditer(joined):
            out.append(("image", None, m[1], m[2]))
        if rest := _inline(_IMAGE.sub("", joined)):
            out.append(("paragraph", None, rest, None))
        para.clear()

    while i < len(lines):
        line = lines[i].rstrip("\r")
        if m := _FENCE.match(line):
            flush()
            body, i = [], i + 1
            while i < len(lines) and not lines[i].strip().startswith(m[1]):
                body.append(lines[i])
                i += 1
            out.append(("code_block", None, "\n".join(body).strip("\n"), m[2] or None))
        elif m := _HEADING.match(line):
            flush()
            out.append(("section", len(m[1]), _inline(m[2] or ""), None))
        elif para and re.match(r"^ {0,3}(=+|-+)\s*$", line):
            title = _inline(" ".join(para))
            para.clear()
            out.append(("section", 1 if "=" in line else 2, title, None))
        elif m := _ITEM.match(line):
            flush()
            item = [m[1]]
            while i + 1 < len(lines) and lines[i + 1].startswith("  ") and lines[i + 1].strip() and not _ITEM.match(lines[i + 1]):
                i += 1
                item.append(lines[i].strip())
            out.append(("list_item", None, _inline("\n".join(item)), None))
        elif not para and line.startswith("    ") and line.strip():
            body = [line[4:]]
            while i + 1 < len(lines) and (lines[i + 1].startswith("    ") or not lines[i + 1].strip()):
                i += 1
                body.append(lines[i][4:])
            out.append(("code_block", None, "\n".join(body).rstrip(), None))
        elif not line.strip():
            flush()
        else:
            para.append(line.strip())
        i += 1
    flush()
    return out


def _event_batches(batches: Iterable[pa.RecordBatch], read, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """What read(value) finds in the rows (doc_id, value) of batches, handed on when it exceeds most bytes."""
    for b in batches:
        types = [b.schema.field(0).type, pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string()]
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=_NAMES)  # noqa: B023, E731
        rows, held = [], 0
        for d, v in zip(b.column(0), b.column(1), strict=True):
            doc = d.as_py()
            for i, e in enumerate(read(v.as_py())):
                rows.append((doc, i, *e))
                held += 100 + len(e[2] or "") + len(e[3] or "")
                if held > most:
                    yield made(rows)
                    rows, held = [], 0
        if rows:
            yield made(rows)


def _container_events(docs: DataFrame, column: str, read) -> DataFrame:
    """Events that read(value) finds in each document; a document that cannot be read has none. A task holds one batch, which Spark bounds by bytes, one document's events, and 4 MB of others'."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", column).mapInArrow(lambda batches: _event_batches(batches, read), _EVENTS.format(kind))


def parse_markdown(docs: DataFrame) -> DataFrame:
    return _tree(_container_events(docs, "text", markdown_events), docs)


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _xml_text(p: ET.Element) -> str:
    return "".join(t.text or "" for t in p.iter(f"{_W}t")).strip()


def docx_events(data: bytes) -> list[tuple]:
    """Sections from heading styles (level: the last digit of the style, else 1), paragraphs, tables with rows (cells between bars)."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    except (zipfile.BadZipFile, KeyError, ET.ParseError):
        return []
    out = []
    for x in body if body is not None else []:
        if x.tag == f"{_W}p" and (text := _xml_text(x)):
            style = x.find(f"{_W}pPr/{_W}pStyle")
            name = (style.get(f"{_W}val") if style is not None else "") or ""
            if name.lower().startswith("heading"):
                digits = re.findall("[0-9]", name)
                out.append(("section", int(digits[-1]) if digits else 1, text, None))
            else:
                out.append(("paragraph", None, text, None))
        elif x.tag == f"{_W}tbl":
            out.append(("table", None, "Table", None))
            out += [("table_row", None, " | ".join(_xml_text(c) for c in r.iter(f"{_W}tc")), None) for r in x.iter(f"{_W}tr")]
    return out


def _under_tables(nodes: DataFrame) -> DataFrame:
    """Rows go below the table before them, which takes the place of their section in path and parent."""
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    at = F.last(F.when(F.col("node_type") == "table", F.col("pos")), ignorenulls=True).over(before)
    rows, row = nodes.withColumn("_t", at), (F.col("node_type") == "table_row") & F.col("_t").isNotNull()
    path = F.concat(F.slice("path", F.lit(1), F.size("path") - 1), F.array("_t", "pos"))
    rows = rows.withColumn("path", F.when(row, path).otherwise(F.col("path"))).withColumn("parent_pos", F.when(row, F.col("_t")).otherwise(F.col("parent_pos"))).withColumn("depth", F.size("path") - 1)
    ordinal = F.row_number().over(Window.partitionBy("doc_id", "parent_pos").orderBy("pos")).cast("int") - 1
    return rows.withColumn("ordinal", ordinal).select(*NODE_COLUMNS)


def parse_docx(docs: DataFrame) -> DataFrame:
    return _under_tables(_tree(_container_events(docs, "data", docx_events), docs))


# --- tables ---
def _table_events(header: list[str], rows: Iterable[list[str]], n: int) -> Iterator[tuple]:
    """A table whose content is its size and whose detail is JSON of its columns and schema, the header row, and its n rows as keyed text."""
    rows = iter(rows)
    begin = list(islice(rows, 3))
    samples = [f"{h} (e.g. {', '.join(v)})" if (v := [r[k] for r in begin if r[k]]) else h for k, h in enumerate(header)]
    schema = f"Columns: {', '.join(header)}\nSchema:\n" + "\n".join(samples)
    yield "table", None, f"{n} rows × {len(header)} columns", json.dumps({"columns": header, "schema": schema})
    yield "table_row", None, " | ".join(header), "header"
    for r in chain(begin, rows):
        pairs = [f"{h}: {v}" for h, v in zip(header, r, strict=True) if v]
        yield "table_row", None, " | ".join(pairs) or " | ".join(r), None


def csv_events(text: str) -> list[tuple]:
    """A table with its header and first 500 rows as keyed text; a row of another length than the header among them is an error, and the file has none. What follows is not read."""
    import csv

    csv.field_size_limit(max(csv.field_size_limit(), len(text or "") + 1))
    records = (r for r in csv.reader(io.StringIO(text or "")) if r)
    header = next(records, None)
    rows = list(islice(records, fixed.ROWS_PER_FILE))
    if header is None or any(len(r) != len(header) for r in rows):
        return []
    return list(_table_events(header, rows, len(rows)))


def table_details(docs: DataFrame, column: str = "text", read=csv_events) -> DataFrame:
    """doc_id, pos, columns, header_text, summary of each table of parse_csv() or, with column="data", read=whole_sheet_events, of parse_sheets(); what operators.tree.table_headers takes."""
    events = _container_events(docs, column, read).filter("node_type = 'table'")
    made = events.withColumn("d", F.from_json("detail", "struct<columns:array<string>,schema:string,size:string>"))
    return made.select("doc_id", (F.col("idx") + 1).alias("pos"), "d.columns", F.lit(None).cast("string").alias("header_text"), F.concat(F.coalesce("d.size", "content"), F.lit("\n"), "d.schema").alias("summary"))


def parse_csv(docs: DataFrame) -> DataFrame:
    """The root's content is the file's name and the table's size."""
    events = _container_events(docs, "text", csv_events)
    size = events.filter("node_type = 'table'").select("doc_id", F.col("content").alias("size"))
    named = _roots(docs).join(size, "doc_id", "left").select("doc_id", F.concat_ws(" — ", "name", "size").alias("name"))
    return _under_tables(_tree(events, named))


def csv_rows(spark: SparkSession, path: str, most: int = fixed.ROWS_PER_FILE) -> DataFrame:
    """The native way for large tables with one schema: every value a string, the first rows of each file, as keyed text."""
    from ..functions.text import keyed_row

    table = spark.read.csv(path, header=True, inferSchema=False)
    rank = F.row_number().over(Window.partitionBy("_file").orderBy("_k"))
    rows = table.withColumn("_file", F.col("_metadata.file_path")).withColumn("_k", F.monotonically_increasing_id()).withColumn("_rn", rank).filter(F.col("_rn") <= most)
    return rows.select(F.col("_file").alias("doc_id"), (F.col("_rn") - 1).alias("row_index"), keyed_row(table.columns, [F.col(f"`{c}`") for c in table.columns]).alias("row_text"))


_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


# --- Fixed values: names of a sheet's errors. ---
CELL_ERRORS = {"#DIV/0!": "Div0", "#N/A": "NA", "#NAME?": "Name", "#NULL!": "Null", "#NUM!": "Num", "#REF!": "Ref", "#VALUE!": "Value", "#GETTING_DATA": "GettingData"}


def _number(text: str) -> str:
    """A number without exponent: 1.0 as 1, 1e-7 as 0.0000001; what is none stays."""
    try:
        x = float(text)
    except ValueError:
        return text
    if not math.isfinite(x):
        return text
    return str(int(x)) if x == int(x) else format(Decimal(repr(x)), "f")


class _Sheet:
    """A sheet's range of cells in use, and its rows, the first `most` of them where given, the header among them. Runs of rows stay runs until their events are read; what is beyond `most` is only counted."""

    def __init__(self, name: str, most: int | None) -> None:
        self.name, self.most = name, most
        self.first, self.last, self.left, self.right, self.runs = None, -1, None, -1, {}

    def add(self, at: int, n: int, cells: dict[int, str]) -> None:
        """n equal rows from place at on, with their cells in use by column."""
        if cells:
            self.first = at if self.first is None else self.first
            self.last, self.right = at + n - 1, max(self.right, *cells)
            self.left = min(cells) if self.left is None else min(self.left, *cells)
            if self.most is None or at < self.first + self.most:
                self.runs[at] = n, cells

    def copy(self) -> _Sheet:
        out = _Sheet(self.name, self.most)
        out.first, out.last, out.left, out.right, out.runs = self.first, self.last, self.left, self.right, dict(self.runs)
        return out

    def _shown(self, n: int) -> Iterator[list[str]]:
        """The first n rows of the range; those between runs are blank."""
        columns = range(self.left or 0, self.right + 1)
        at = self.first or 0
        end = at + n
        for start, (times, cells) in sorted(self.runs.items(), key=lambda run: run[0]):
            if at <= start < end:
                yield from ([""] * len(columns) for _ in range(start - at))
                at = min(start + times, end)
                row = [cells.get(c, "") for c in columns]
                yield from (row for _ in range(at - start))
        yield from ([""] * len(columns) for _ in range(end - at))

    def events(self) -> Iterator[tuple]:
        """A section and a table, both named `name (rows × cols)`, and the rows; a sheet without cells has an empty header."""
        height, width = 0 if self.first is None else self.last - self.first + 1, self.right + 1 - (self.left or 0)
        n = max(height if self.most is None else min(height, self.most), 0)
        label = f"{self.name} ({height} rows × {width} cols)"
        rows = self._shown(n)
        made = _table_events(next(rows, []), rows, max(n - 1, 0))
        detail = json.loads(next(made)[3]) | {"size": f"{max(n - 1, 0)} rows × {width} cols"}
        yield "section", 1, label, None
        yield "table", None, label, json.dumps(detail)
        yield from made


#: Bytes of a part up to which its tree is made at once; a stream of events costs several times that for each element.
_WHOLE = 1 << 20


def _xlsx_rows(z: zipfile.ZipFile, name: str, strings: list[str]) -> Iterator[tuple[int, dict[int, str]]]:
    """Place and cells in use of the rows of a worksheet; of a large one a row is in memory at a time."""
    if z.getinfo(name).file_size <= _WHOLE:
        yield from _row_cells(ET.fromstring(z.read(name)).iter(f"{_S}row"), strings)
    else:
        with z.open(name) as page:
            yield from _row_cells((r for _, r in ET.iterparse(page) if r.tag == f"{_S}row"), strings)


def _row_cells(rows: Iterable[ET.Element], strings: list[str]) -> Iterator[tuple[int, dict[int, str]]]:
    at = -1
    for r in rows:
        at, cells, col = int(r.get("r") or at + 2) - 1, {}, -1
        for c in r.iter(f"{_S}c"):
            ref, col = c.get("r"), col + 1
            if ref and (letters := re.match("[A-Z]*", ref)[0]):
                col = functools.reduce(lambda n, ch: n * 26 + ord(ch) - 64, letters, 0) - 1
            v, kind = c.find(f"{_S}v"), c.get("t")
            raw = (v.text or "") if v is not None else "".join(t.text or "" for t in c.iter(f"{_S}t"))
            if kind == "s" and raw:
                text = strings[int(raw)] if int(raw) < len(strings) else ""
            elif kind == "b":
                text = {"1": "true", "0": "false"}.get(raw, raw)
            elif kind == "e":
                text = f"#ERR:{CELL_ERRORS.get(raw, raw)}"
            else:
                text = _number(raw) if kind in (None, "n") else raw
            if text:
                cells[col] = text
        r.clear()
        yield at, cells


def _xlsx_sheets(data: bytes, z: zipfile.ZipFile | None, most: int | None) -> list[_Sheet]:
    try:
        z = z or zipfile.ZipFile(io.BytesIO(data))
        book = ET.fromstring(z.read("xl/workbook.xml"))
        links = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        strings = ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
    except (zipfile.BadZipFile, KeyError, ET.ParseError):
        return []
    out = []
    for sheet in book.iter(f"{_S}sheet"):
        try:
            made = _Sheet(sheet.get("name") or "", most)
            for at, cells in _xlsx_rows(z, "xl/" + links[sheet.get(f"{_R}id")].removeprefix("/xl/"), strings):
                made.add(at, 1, cells)
            out.append(made)
        except (KeyError, ValueError, ET.ParseError, zipfile.BadZipFile, zlib.error):
            continue
    return out


def xlsx_events(data: bytes, z: zipfile.ZipFile | None = None) -> list[tuple]:
    """Events of each sheet of an XLSX file, z if it is open, with 500 rows. A sheet that cannot be read is passed over, a file that cannot be has none."""
    return [e for s in _xlsx_sheets(data, z, fixed.ROWS_PER_FILE) for e in s.events()]


_TABLE = "{urn:oasis:names:tc:opendocument:xmlns:table:1.0}"
_OFFICE = "{urn:oasis:names:tc:opendocument:xmlns:office:1.0}"
_TEXT = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"


def _ods_text(p: ET.Element) -> str:
    """A paragraph's text, with blanks and tabs that stand as elements."""
    own = {f"{_TEXT}s": " " * int(p.get(f"{_TEXT}c") or 1), f"{_TEXT}tab": "\t", f"{_TEXT}line-break": "\n"}.get(p.tag, p.text or "")
    return own + "".join(_ods_text(x) + (x.tail or "") for x in p)


def _ods_cell(c: ET.Element) -> str:
    """What a cell holds by its type; texts of several paragraphs on lines of their own."""
    kind = c.get(f"{_OFFICE}value-type")
    if kind in ("float", "percentage", "currency"):
        return _number(c.get(f"{_OFFICE}value") or "")
    if kind in ("boolean", "date", "time"):
        return c.get(f"{_OFFICE}{kind}-value") or ""
    return c.get(f"{_OFFICE}string-value") or "\n".join(_ods_text(p) for p in c.findall(f"{_TEXT}p"))


def _ods_steps(z: zipfile.ZipFile, name: str) -> Iterator[tuple[str, ET.Element]]:
    """Starts and ends of tables and ends of rows of a part; of a large one, or one with tables in tables, as it is read."""
    table, row = f"{_TABLE}table", f"{_TABLE}table-row"
    if z.getinfo(name).file_size <= _WHOLE:
        tables = list(ET.fromstring(z.read(name)).iter(table))
        if all(sum(1 for _ in t.iter(table)) == 1 for t in tables):
            for t in tables:
                yield "start", t
                yield from (("end", r) for r in t.iter(row))
                yield "end", t
            return
    with z.open(name) as content:
        for event, x in ET.iterparse(content, ("start", "end")):
            if x.tag == table or event == "end" and x.tag == row:
                yield event, x


def _ods_sheets(data: bytes, z: zipfile.ZipFile | None, most: int | None) -> list[_Sheet]:
    out, made, at = [], _Sheet("", most), 0
    try:
        for event, x in _ods_steps(z or zipfile.ZipFile(io.BytesIO(data)), "content.xml"):
            if x.tag == f"{_TABLE}table-row":
                cells, col = {}, 0
                for c in x:
                    if c.tag in (f"{_TABLE}table-cell", f"{_TABLE}covered-table-cell"):
                        n, text = int(c.get(f"{_TABLE}number-columns-repeated") or 1), _ods_cell(c)
                        cells |= dict.fromkeys(range(col, col + n), text) if text else {}
                        col += n
                n = int(x.get(f"{_TABLE}number-rows-repeated") or 1)
                made.add(at, n, cells)
                at += n
                x.clear()
            elif event == "start":
                made, at = _Sheet(x.get(f"{_TABLE}name") or "", most), 0
            else:
                out.append(made.copy())  # what a row of an outer table adds behind an inner one is not the inner one's
                x.clear()
    except (zipfile.BadZipFile, KeyError, ValueError, ET.ParseError, zlib.error):
        return []
    return out


def ods_events(data: bytes, z: zipfile.ZipFile | None = None) -> list[tuple]:
    """Events of each sheet of an ODS file, z if it is open, with 500 rows. Runs of rows stay runs, and of runs of cells only those in use are expanded, so padding to a sheet's end costs nothing. A file that cannot be read has none."""
    return [e for s in _ods_sheets(data, z, fixed.ROWS_PER_FILE) for e in s.events()]


def whole_sheet_events(data: bytes, most: int | None = None) -> Iterator[tuple]:
    """Events of a spreadsheet by what its container holds, all rows of its sheets: ODS by content.xml, else XLSX. Null, damaged and other files, the binary XLS of old among them, have none."""
    try:
        with zipfile.ZipFile(io.BytesIO(data or b"")) as z:
            sheets = (_ods_sheets if "content.xml" in z.namelist() else _xlsx_sheets)(data, z, most)
    except zipfile.BadZipFile:
        return
    for s in sheets:
        yield from s.events()


def sheet_events(data: bytes) -> list[tuple]:
    """The same with the first 500 rows of each sheet, as the original shows them."""
    return list(whole_sheet_events(data, fixed.ROWS_PER_FILE))


def parse_sheets(docs: DataFrame) -> DataFrame:
    """Nodes of XLSX and ODS files (doc_id, data): a section and a table for each sheet, all its rows below the table. A file is the unit of memory; of its sheets one row at a time is parsed, and runs of equal rows are handed on in batches."""
    return _under_tables(_tree(_container_events(docs, "data", whole_sheet_events), docs, levels=1))


def parse(docs: DataFrame, kind: str) -> DataFrame:
    """Nodes of documents of one type; docs has doc_id, text or data, and may have name."""
    return {"markdown": parse_markdown, "plain_text": parse_plain, "code": parse_code, "pdf": parse_pdf_text, "word": parse_docx, "csv": parse_csv, "spreadsheet": parse_sheets}.get(kind, parse_plain)(docs)


# --- images ---
def jpeg_size(data: bytes) -> tuple[int, int] | None:
    """Width and height from the frame header."""
    i = 2
    while data[:2] == b"\xff\xd8" and i + 9 < len(data):
        if data[i] != 0xFF:
            return None
        kind, n = data[i + 1], int.from_bytes(data[i + 2 : i + 4], "big")
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(data[i + 7 : i + 9], "big"), int.from_bytes(data[i + 5 : i + 7], "big")
        i += 2 + n
    return None


IMAGES = "doc_id string, path string, mime_type string, data binary, width int, height int"


def docx_images(docs: DataFrame) -> DataFrame:
    """IMAGES of the media of DOCX files (doc_id, data)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, data in zip(b["doc_id"], b["data"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        for name in z.namelist():
                            mime = MIME_TYPES.get(name.rpartition(".")[2].lower(), "")
                            if name.startswith("word/media/") and mime:
                                raw = z.read(name)
                                rows.append((doc, name, mime, raw, *(jpeg_size(raw) or (None, None))))
                except zipfile.BadZipFile:
                    continue
            yield pd.DataFrame(rows, columns=["doc_id", "path", "mime_type", "data", "width", "height"]).astype({"width": "Int32", "height": "Int32"})

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "data").mapInPandas(run, IMAGES)
