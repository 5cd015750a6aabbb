"""Pages of binary files by an extractor that the caller brings: PDF libraries, OCR, external tools."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: From a file's bytes to the texts of its pages, in order. It runs in tasks, so it must be importable there or picklable.
Extractor = Callable[[bytes], Iterable[str | None]]

PAGES = "doc_id string, page int, text string, error string"


def read_files(spark: SparkSession, path: str, glob: str = "*.pdf", most_bytes: int | None = None) -> DataFrame:
    """doc_id (the path), content of files below path; with most_bytes, only of files up to that size: others have a null content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    content = F.col("content") if most_bytes is None else F.when(F.col("length") <= most_bytes, F.col("content"))
    return files.select(F.col("path").alias("doc_id"), content.alias("content"))


def extract_pages(files: DataFrame, extractor: Extractor) -> DataFrame:
    """PAGES of files (doc_id, content): a row for each page, from 1 on; a file that can't be read has one row with its error, and the pages read before it stay.

    A null content is an error too; a file without pages has a row of page 0 without text, so none is lost. A null page is an empty text. Rows that repeat are read as often. A task holds one
    file and gives its pages as they come. Other columns are ignored.
    """
    schema = pa.schema([("doc_id", pa.string()), ("page", pa.int32()), ("text", pa.string()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                page, held, size, error = 0, [], 0, None
                try:
                    if not content.is_valid:
                        raise ValueError("no content")
                    for page, text in enumerate(extractor(content.as_py()), 1):
                        held.append((name, page, text or "", None))
                        size += len(text or "")
                        if size > 1_000_000:
                            yield _rows(held, schema)
                            held, size = [], 0
                except Exception as e:  # whatever a foreign library raises becomes this file's row
                    error = f"{type(e).__name__}: {e}"
                if error is not None or not page:
                    held.append((name, 0 if not page else page + 1, None, error))
                if held:
                    yield _rows(held, schema)

    return files.select(F.col("doc_id").cast("string").alias("doc_id"), "content").mapInArrow(run, PAGES)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def form_feed_pages(content: bytes) -> list[str]:
    """An extractor for text in the place of PDF: pages end with form feeds."""
    return content.decode("utf-8").split("\f")


def paged_text(pages: DataFrame) -> DataFrame:
    """doc_id, text of files whose pages all could be read: pages joined by form feeds, as parse_pdf_text takes them."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("text")))), lambda p: p.text), "\f")
    return pages.groupBy("doc_id").agg(joined.alias("text"), F.count("error").alias("errors")).filter("errors = 0").drop("errors")
