"""WARC archives: written and read as chunked record tables, with digests carried from chunk to chunk.

A payload above chunk_bytes becomes rows of a record identifier and a chunk number. Its digests are carried over the sorted rows, one chunk at a time, and each chunk is written as a
segment of its record (`WARC-Segment-Number`, `continuation`), so neither side ever builds a whole record of such a payload. What a row holds within chunk_bytes is digested in
its row. The archives are real WARC 1.1 files, one for each partition, written by Spark's text writer with CRLF as its line end, so its commit protocol protects them; the
reader splits files at the line that opens a record, anywhere in a file. No segment holds that line: where a payload does, a segment ends inside it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, drop_tables, quoted, read_table, stored, table_path

OPENS = "WARC/1.1\r\n"
_BREAK = "\r\n\r\n" + OPENS
#: Between W and the rest of an opening line behind a blank line, a segment's start or at its end; the header's blank line stands before the start, the record's behind the end.
_CUT = r"(?<=(?:\A|\A\r\n|\r\n\r\n)W)(?=ARC/1\.1(?:\r\n|\z))"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _segments(payload: Column, size: Column, chunk_bytes: int) -> Column:
    """The payload (binary) in chunks, which are cut again where they would open a record."""

    def pieces(chunk: Column) -> Column:
        text = F.split(F.decode(chunk, "ISO-8859-1"), _CUT)  # a character for each byte
        return F.when(F.contains(chunk, F.lit("ARC/1.1").cast("binary")), F.transform(text, lambda t: F.encode(t, "ISO-8859-1"))).otherwise(F.array(chunk))

    starts = F.sequence(F.lit(0), (F.greatest(size - 1, F.lit(0)) / chunk_bytes).cast("int"))
    cut = lambda data: F.transform(starts, lambda k: F.substring(data, k * chunk_bytes + 1, F.lit(chunk_bytes)))
    # the array of one binds the payload to a variable, so that it is not cast again for every chunk
    chunks = F.when(size <= chunk_bytes, F.array(payload)).otherwise(F.flatten(F.transform(F.array(payload), cut)))
    return F.flatten(F.transform(chunks, pieces))


_DIGESTS = "record_id string, payload_bytes long, sha1 binary, sha256 binary"


def chunk_digests(chunks: DataFrame) -> DataFrame:
    """record_id, payload_bytes, sha1, sha256 of payloads in rows (record_id, chunk, data), carried from row to row in order of chunk: a task holds one batch of chunks and two digests.

    A null data counts as empty. Rows that repeat a record and a chunk count one after the other. Other columns are ignored; an empty table gives no rows.
    """
    schema = pa.schema([("record_id", pa.string()), ("payload_bytes", pa.int64()), ("sha1", pa.binary()), ("sha256", pa.binary())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, size, one, two = None, 0, hashlib.sha1(), hashlib.sha256()
        for b in batches:
            done = []
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if name != now:
                    if now is not None:
                        done.append((now, size, one.digest(), two.digest()))
                    now, size, one, two = name, 0, hashlib.sha1(), hashlib.sha256()
                if data.is_valid:
                    part = memoryview(data.as_buffer())
                    size += len(part)
                    one.update(part)
                    two.update(part)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((now, size, one.digest(), two.digest()), schema, strict=True)], schema=schema)

    return chunks.select("record_id", "data", "chunk").repartition("record_id").sortWithinPartitions("record_id", "chunk").select("record_id", "data").mapInArrow(scan, _DIGESTS)


def _header(name: str, value: Column) -> Column:
    """A line, or null where there is no value."""
    return F.concat(F.lit(f"{name}: "), value.cast("string"))


def _record(first: Column, response: Column) -> Column:
    """A segment of a record as WARC text: of id, url, best, rid, own, segment, segments, payload_bytes, sha1 and data."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(F.when(first, http).otherwise(F.lit("")), F.when(response, F.col("data")).otherwise(F.lit(b"")).cast("string"))
    several = response & (F.col("segments") > 1)
    lines = F.concat_ws(
        "\r\n", F.lit("WARC/1.1"), _header("WARC-Type", F.when(~first, "continuation").when(response, "response").otherwise("revisit")), _header("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), F.when(first, F.col("rid")).otherwise(F.col("own")), F.lit(">"))),
        _header("WARC-Date", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")), _header("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7F]+", "%20")),
        _header("WARC-Payload-Digest", F.when(first, F.concat(F.lit("sha1:"), F.lower(F.hex("sha1"))))), _header("WARC-Profile", F.when(~response, F.lit(_PROFILE))),
        _header("WARC-Segment-Number", F.when(several, F.col("segment"))), _header("WARC-Segment-Origin-ID", F.when(~first, F.concat(F.lit("<urn:uuid:"), F.col("rid"), F.lit(">")))),
        _header("WARC-Segment-Total-Length", F.when(several & (F.col("segment") == F.col("segments")), F.octet_length(http) + F.col("payload_bytes"))),
        _header("Arborlake-Id", F.when(first, F.url_encode(F.col("id").cast("string")))), _header("Arborlake-Refers-To-Id", F.when(~response, F.url_encode(F.col("best").cast("string")))),
        _header("Content-Type", F.when(first, "application/http;msgtype=response").otherwise("application/octet-stream")), _header("Content-Length", F.octet_length(block)),
    )
    return F.concat(lines, F.lit("\r\n\r\n"), block, F.lit("\r\n")).alias("value")


def write_warc(records: DataFrame, path: str, id_col: str = "page_id", url_col: str | None = "url", payload_col: str = "html", least: int = 1000, chunk_bytes: int = 1 << 20, compression: str = "none") -> None:
    """Write a record for each row below path. Of records with equal payloads of at least least bytes the one with the largest id is a response, the others revisit it; all
    smaller ones are responses. Payloads are equal if size, SHA-1 and SHA-256 are.

    A null payload is empty; a null id is below all others and left out of the header; a null url too. Rows that repeat an id and a payload are of one kind: no id is
    larger. Control characters and blanks of an url become %20. Payloads may be as long as a row allows; ids may be of any type that has an order and casts from text. Other columns are ignored, whatever
    their names. An empty table gives an archive without records. compression is that of Spark's text writer (gzip, zstd, none); compressed files can't be split.
    """
    spark = records.sparkSession
    payload = F.coalesce(quoted(payload_col).cast("binary"), F.lit(b""))
    rows = records.select(quoted(id_col).alias("id"), (quoted(url_col) if url_col else F.lit(None)).cast("string").alias("url"), payload.alias("data")).withColumn("payload_bytes", F.octet_length("data").cast("long"))
    small, large = rows.filter(F.col("payload_bytes") <= chunk_bytes), rows.filter(F.col("payload_bytes") > chunk_bytes)
    cut = lambda df: df.select("*", F.size("parts").alias("segments"), F.posexplode("parts").alias("at", "part")).select("*", (F.col("at") + 1).alias("segment")).drop("parts", "at", "data").withColumnRenamed("part", "data").withColumn("own", F.expr("uuid()"))
    parts = _segments(F.col("data"), F.col("payload_bytes"), chunk_bytes).alias("parts")
    chunks, chunks_path = stored(cut(large.select("id", "url", "payload_bytes", F.expr("uuid()").alias("rid"), parts)).withColumnRenamed("rid", "record_id"), "chunks")
    digests, digests_path = stored(chunk_digests(chunks.withColumnRenamed("segment", "chunk")).drop("payload_bytes"), "digests")
    heads = chunks.filter("segment = 1").select("record_id", "id", "payload_bytes").join(digests, "record_id")

    small = small.withColumn("sha1", F.unhex(F.sha1("data"))).withColumn("sha256", F.unhex(F.sha2("data", 256)))
    key = ["payload_bytes", "sha1", "sha256"]
    known = small.select("id", *key).unionByName(heads.select("id", *key)).filter(F.col("payload_bytes") >= least)
    classes, classes_path = stored(known.groupBy(*key).agg(F.max("id").alias("best"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "classes")
    few = classes.count() <= BROADCAST_KEYS
    named = lambda df: df.join(F.broadcast(classes) if few else classes, key, "left")

    first, response = F.col("segment") == 1, F.col("best").isNull() | F.col("id").eqNullSafe(F.col("best"))
    whole = cut(named(small).select("id", "url", "best", "payload_bytes", "sha1", F.expr("uuid()").alias("rid"), parts))
    many = chunks.join(named(heads).select("record_id", "best", "sha1"), "record_id").withColumnRenamed("record_id", "rid")
    lines = whole.unionByName(many).filter(first | response).select(_record(first, response))
    lines.write.option("lineSep", "\r\n").option("compression", compression).text(path)
    drop_tables(spark, [chunks_path, digests_path, classes_path])


def read_segments(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """The archives below path as a chunked record table: record_id, chunk (from 1), several (whether the record has more), type, id, url, refers_to, payload_bytes, digest, data.

    type, id, url, refers_to, payload_bytes and digest (as the headers state them) are null in continuations; a revisit has no data. A record shorter than its Content-Length raises.
    """
    value = F.col("value")
    rows = spark.read.option("lineSep", _BREAK).text(path).select(F.when(value.startswith(OPENS), F.substr(value, F.lit(len(OPENS) + 1))).otherwise(value).alias("value")).filter("value <> ''")
    rows = rows.withColumn("head", F.substring_index("value", "\r\n\r\n", 1))
    field = lambda name, text="head": F.nullif(F.regexp_extract(text, rf"(?mi)^{name}: *([^\r\n]*)", 1), F.lit(""))
    length = field("Content-Length").cast("int")
    block = F.substring(F.col("value").cast("binary"), F.octet_length("head") + 5, length)
    rows = rows.select("head", length.alias("length"), block.alias("block"))
    whole = F.when(F.octet_length("block") == F.col("length"), F.col("block")).otherwise(F.raise_error(F.concat(F.lit("a record is shorter than it states: "), "head")).cast("binary"))
    rows = rows.withColumn("block", whole).withColumn("type", field("WARC-Type"))
    is_first = F.col("type").isin("response", "revisit")
    http = F.when(is_first, F.substring_index(F.col("block").cast("string"), "\r\n\r\n", 1))
    rows = rows.filter(is_first | (F.col("type") == "continuation")).withColumn("http", http)
    data = F.when(is_first, F.substring("block", F.octet_length("http") + 5, F.col("length"))).otherwise(F.col("block"))
    number = field("WARC-Segment-Number").cast("int")
    return rows.select(
        F.coalesce(field("WARC-Segment-Origin-ID"), field("WARC-Record-ID")).alias("record_id"), F.coalesce(number, F.lit(1)).alias("chunk"), number.isNotNull().alias("several"), F.when(is_first, F.col("type")).alias("type"),
        F.url_decode(field("Arborlake-Id")).cast(id_type).alias("id"), F.when(is_first, field("WARC-Target-URI")).alias("url"), F.url_decode(field("Arborlake-Refers-To-Id")).cast(id_type).alias("refers_to"),
        field("Content-Length", "http").cast("long").alias("payload_bytes"), F.lower(F.regexp_extract("head", r"(?mi)^WARC-Payload-Digest: *sha1:([0-9a-f]+)", 1)).alias("digest"), F.when(F.col("type") == "revisit", F.lit(b"")).otherwise(data).alias("data"),
    )


def read_warc(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """A row for each record of write_warc's archives below path: id, url, payload_bytes, payload_digest, record_type, refers_to, intact.

    Sizes and digests are those of the payload as read, chunk after chunk; of a revisit, which holds none, those it states. intact tells whether what was read agrees with the headers. A record whose
    first segment is missing has null for what that segment states.
    """
    rows = read_segments(spark, path, id_type)
    own = ["id", "url", "type", "refers_to", "payload_bytes", "digest"]
    one = rows.filter("NOT several").select(*own, F.octet_length("data").cast("long").alias("size"), F.when(F.col("type") == "response", F.sha1("data")).alias("sha1"))
    more = rows.filter("several")
    heads = more.filter("chunk = 1").select("record_id", *own)
    many = chunk_digests(more).select("record_id", F.col("payload_bytes").alias("size"), F.lower(F.hex("sha1")).alias("sha1")).join(heads, "record_id", "left")
    read = F.coalesce(F.col("type"), F.lit("response")) == "response"
    return one.unionByName(many.select(*own, "size", "sha1")).select(
        "id", "url", F.when(read, F.col("size")).otherwise(F.col("payload_bytes")).alias("payload_bytes"), F.when(read, F.col("sha1")).otherwise(F.col("digest")).alias("payload_digest"),
        F.coalesce("type", F.lit("response")).alias("record_type"), "refers_to", (~read | ((F.col("size") == F.col("payload_bytes")) & (F.col("sha1") == F.col("digest")))).alias("intact"),
    )


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = table_path(spark, "warc")
    write_warc(read_table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP13_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), b AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS best FROM p)
SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN strlen(html) < 1000 OR page_id = best OR best IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN strlen(html) >= 1000 AND page_id IS DISTINCT FROM best THEN best END AS refers_to
FROM b
"""
