"""Images of documents: found by file type, stored once by content, described by a vision model, and the descriptions put back on their nodes."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import extension
from ..operators.durable import stored
from ..operators.store import describe_image
from ..plans import models
from ..streaming.sinks import read_batches, save_batch
from .parsers import IMAGES, docx_images

#: From MIME type and bytes of an image to what it shows. It runs in tasks, so it must be importable there or picklable.
Vision = Callable[[str, bytes], str]

CONTENT = "image_id string, mime_type string, bytes long, width int, height int, data binary"
PLACES = "doc_id string, path string, image_id string"
DESCRIPTIONS = "image_id string, description string, error string"

# --- Fixed values: the instruction and the question that go with an image. ---
SYSTEM = "You are a document analysis assistant. Describe images concisely and accurately."
QUESTION = "Describe what is shown in this image in 1-3 sentences. Focus on the content relevant to a document (charts, diagrams, tables, figures). Be specific about data or labels visible."


def images_of(files: DataFrame, pdf: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """IMAGES of files (doc_id, name, data) by extension, whatever its case: media of docx, what the caller's pdf makes of PDF (doc_id, data), none of others."""
    kind = extension(F.col("name"))
    out = docx_images(files.filter(kind == "docx"))
    return out if pdf is None else out.unionByName(pdf(files.filter(kind == "pdf").select("doc_id", "data")).select(*out.columns))


def image_type(data: Column) -> Column:
    """The MIME type by an image's first bytes; null for what is none of the known kinds, as damaged or empty data."""
    head = F.hex(F.substring(data, 1, 12))
    png, jpeg, gif = (head.startswith(x) for x in ("89504E470D0A1A0A", "FFD8FF", "47494638"))
    webp = head.startswith("52494646") & head.endswith("57454250")
    return F.when(png, "image/png").when(jpeg, "image/jpeg").when(gif, "image/gif").when(webp, "image/webp").when(head.startswith("424D"), "image/bmp")


def image_id(data: Column) -> Column:
    """SHA-256 of the bytes; null for null."""
    return F.sha2(data, 256)


def _one_each(rows: DataFrame) -> DataFrame:
    """image_id, data and the least mime_type, width and height, where rows have them, of each image. Copies are combined in their task, then by groups of tasks, so an image that every task has seen does not meet in one as often as there are tasks."""
    part = rows.withColumn("_task", F.spark_partition_id() % 64)
    names = [c for c in ("mime_type", "width", "height") if c in rows.columns]
    firsts = part.groupBy("image_id", "_task").agg(F.any_value("data", True).alias("data"), *(F.min(c).alias(c) for c in names))
    return firsts.groupBy("image_id").agg(F.any_value("data", True).alias("data"), *(F.min(c).alias(c) for c in names))


def save_images(images: DataFrame, sink: str, batch: int) -> bool:
    """Save a batch of IMAGES as two tables together, or nothing if it is committed: CONTENT, which has each image once over all batches, and PLACES, where they occur.

    An image is known by its bytes, so a task or batch that runs again writes no second copy, and copies of one image are combined before the shuffle, however many documents share it. Images
    without data have no content and no place; places that repeat are kept once. Of the sizes and types given to copies the least are kept. Extra columns are ignored. One writer at a time.
    """
    spark = images.sparkSession
    rows = images.filter("data IS NOT NULL").withColumn("image_id", image_id(F.col("data")))
    known = read_batches(spark, sink, "content", CONTENT).select("image_id")
    new = _one_each(rows.join(known, "image_id", "left_anti")).withColumn("bytes", F.octet_length("data").cast("long"))
    places = rows.select(F.col("doc_id").cast("string").alias("doc_id"), "path", "image_id").distinct()
    return save_batch(sink, batch, {"content": new.select("image_id", "mime_type", "bytes", "width", "height", "data"), "places": places})


def read_images(spark: SparkSession, sink: str) -> tuple[DataFrame, DataFrame]:
    """CONTENT and PLACES of all committed batches; a place saved by several batches is there once."""
    return read_batches(spark, sink, "content", CONTENT), read_batches(spark, sink, "places", PLACES).distinct()


def image_message(mime_type: str, data: bytes) -> dict:
    """A user message of an image, as a data address, and the question."""
    url = f"data:{mime_type};base64,{base64.b64encode(data).decode('ascii')}"
    return {"role": "user", "content": [{"type": "image_url", "image_url": {"url": url}}, {"type": "text", "text": QUESTION}]}


def vision_model(name: str, **options) -> Vision:
    """A Vision that asks a registered provider; ValueError for one that takes no images."""
    if name in models.CAPABILITIES and not models.CAPABILITIES[name].vision:
        raise ValueError(f"{name} takes no images")
    model = models.provider(name, **options)
    return lambda mime_type, data: model.chat([{"role": "system", "content": SYSTEM}, image_message(mime_type, data)]).content


def describe(content: DataFrame, vision: Vision, most_bytes: int = 20_000_000, unique: bool = False) -> DataFrame:
    """DESCRIPTIONS of images (image_id, data): each distinct id is asked for once; one that can't be described has its error instead.

    Null data, data of no known kind, and images above most_bytes have an error without being asked for; so has an image at which the model fails, and the others go on. A row with a null id is
    described as well. Ids that repeat stand for equal bytes; unique says that none does, as in what read_images() gives, so that no image is shuffled. A task holds an Arrow batch of images and one address: set spark.sql.execution.arrow.maxBytesPerBatch to what it may hold.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said, errors = [], []
            for kind, data in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                try:
                    said.append((vision(kind, data.as_py()) or "").strip())
                    errors.append(None)
                except Exception as e:  # whatever a model raises becomes this image's row
                    said.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), pa.array(said, pa.string()), pa.array(errors, pa.string())], names=["image_id", "description", "error"])

    one = content.select("image_id", "data")
    one = one if unique else _one_each(one)
    size = F.octet_length("data")
    problem = F.when(F.col("data").isNull(), "no data").when(size > most_bytes, F.concat(F.lit("too large: "), size.cast("string"), F.lit(" bytes"))).when(image_type(F.col("data")).isNull(), "not an image")
    seen = one.select("image_id", image_type(F.col("data")).alias("mime_type"), "data", problem.alias("error"))
    asked = seen.filter("error IS NULL").select("image_id", "mime_type", "data").mapInArrow(run, DESCRIPTIONS)
    return asked.unionByName(seen.filter("error IS NOT NULL").select("image_id", F.lit(None).cast("string").alias("description"), "error"))


def described_nodes(nodes: DataFrame, shown: DataFrame, places: DataFrame, descriptions: DataFrame) -> DataFrame:
    """nodes with the summaries of the images that they show and whether they are described; shown (doc_id, pos, path) tells which node shows which image of its document.

    Images without a description leave their nodes as they are. A node that shows several has the least of their texts. Ids are compared as strings, nulls with nothing. Descriptions are
    stored before they are joined, so that a lost executor does not ask the model again.
    """
    said = stored(descriptions.filter("description IS NOT NULL"), "described").select("image_id", "description")
    text = F.col("doc_id").cast("string")
    at = shown.select(text.alias("_d"), "doc_id", "pos", "path").join(places.select(text.alias("_d"), "path", "image_id"), ["_d", "path"])
    return describe_image(nodes, at.join(said, "image_id").select("doc_id", "pos", "description"))
