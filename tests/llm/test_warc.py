"""WARC archives against a plain version, and payloads that look like archives."""

import gzip
import hashlib
import pathlib
import re

import duckdb
import pytest

from arborlake.llm import warc
from verify import rows_of

MARK = "\r\n\r\nWARC/1.1\r\n"


def plain(rows, least=1000):
    """id, bytes, digest, type, refers_to by a dictionary."""
    data = [(i, (h or "").encode() if not isinstance(h, bytes) else h) for i, h in rows]
    best = {}
    for i, d in data:
        if len(d) >= least:
            best[d] = i if best.get(d) is None else max(best[d], i if i is not None else best[d])
    out = []
    for i, d in data:
        own = len(d) < least or best[d] == i
        out.append((i, len(d), hashlib.sha1(d).hexdigest(), "response" if own else "revisit", None if own else best[d]))
    return out


def result(spark, path):
    rows = warc.read_warc(spark, path)
    assert all(r.intact for r in rows.select("intact").collect())
    return sorted((tuple(r) for r in rows.select("id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


ODD = [
    (1, "http://a/1", "x" * 1000), (2, None, "x" * 1000), (3, "http://a/3", "x" * 999), (4, "http://a/4", "x" * 999), (5, "u\r\nEvil: 1", None), (6, "http://a/6", ""), (None, "http://a/n", "x" * 1000), (None, None, None), (7, "http://ä/7", "漢字😀" * 500),
    (8, "m", MARK), (9, "m", "WARC/1.1\r\n"), (10, "m", "WARC/1.1"), (11, "m", "a" + MARK + MARK + "\r\nWARC/1.1\r\n\r\nWARC/1.1"), (12, "m", "\r\n\r\n"), (13, "m", "\r\n"), (14, "m", MARK * 40), (15, "m", MARK * 40), (16, "m", "y" * 77 + "\r\n\r\nWARC/1.1"),
    (17, "m", "".join(chr(33 + i % 90) for i in range(5000))), (18, "m", "".join(chr(33 + i % 90) for i in range(5000))), (18, "m", "".join(chr(33 + i % 90) for i in range(5000))), (19, "m", "Content-Length: 5\r\n\r\nab"),
]


@pytest.mark.parametrize("chunk", [7, 64, 1000, 1 << 20])
def test_odd_rows(spark, tmp_path, chunk):
    df = spark.createDataFrame([(i, u, h, "clash", 3) for i, u, h in ODD], "page_id long, url string, html string, record_id string, segment int")
    path = f"{tmp_path}/a"
    warc.write_warc(df, path, chunk_bytes=chunk)
    assert result(spark, path) == sorted(plain([(i, h) for i, _, h in ODD]), key=str)
    segments = warc.read_segments(spark, path).collect()
    assert all(len(s.data) <= chunk or chunk == 1 << 20 for s in segments)
    whole = {}
    for s in sorted(segments, key=lambda s: s.chunk):
        whole.setdefault(s.record_id, []).append(bytes(s.data))
    kept = sorted(b"".join(v) for v in whole.values())
    assert kept == sorted([(h or "").encode() for (i, u, h), p in zip(ODD, plain([(i, h) for i, _, h in ODD]), strict=True) if p[3] == "response"] + [b""] * sum(p[3] == "revisit" for p in plain([(i, h) for i, _, h in ODD])))


def test_splits_anywhere(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", f"{i}" + MARK * (i % 5) + "z" * (i % 97)) for i in range(400)], "page_id long, url string, html string").coalesce(1)
    warc.write_warc(df, f"{tmp_path}/a", chunk_bytes=50)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("211b", "997b", "10007b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1b")
            assert warc.read_warc(spark, f"{tmp_path}/a").filter("intact").count() == 400
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def records(raw):
    """A plain reader, led by Content-Length."""
    at = 0
    while at < len(raw):
        stop = raw.index(b"\r\n\r\n", at)
        head = raw[at:stop].decode()
        n = int(re.search(r"(?m)^Content-Length: (\d+)", head)[1])
        assert head.startswith("WARC/1.1\r\n") and raw[stop + 4 + n : stop + 8 + n] == b"\r\n\r\n"
        yield head, raw[stop + 4 : stop + 4 + n]
        at = stop + 8 + n


def test_files_are_archives(spark, tmp_path):
    df = spark.createDataFrame(ODD, "page_id long, url string, html string")
    for compression, end, opened in (("none", ".txt", open), ("gzip", ".gz", gzip.open)):
        path = tmp_path / compression
        warc.write_warc(df, str(path), chunk_bytes=500, compression=compression)
        found = []
        for f in pathlib.Path(path).glob(f"part-*{end}"):
            with opened(f, "rb") as raw:
                found += list(records(raw.read()))
        kinds = [re.search(r"(?m)^WARC-Type: (\S+)", h)[1] for h, _ in found]
        assert kinds.count("response") + kinds.count("revisit") == len(ODD) and "continuation" in kinds
        ids = [re.search(r"(?m)^WARC-Record-ID: (\S+)", h)[1] for h, _ in found]
        assert len(set(ids)) == len(ids)
        assert result(spark, str(path)) == sorted(plain([(i, h) for i, _, h in ODD]), key=str)


def test_empty_binary_and_text_ids(spark, tmp_path):
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), f"{tmp_path}/e")
    assert result(spark, f"{tmp_path}/e") == []
    rows = [("a b", bytes(range(256)) * 8), ("ä\n", bytes(range(256)) * 8), ("z", b"\xff")]
    warc.write_warc(spark.createDataFrame(rows, "`my.id` string, body binary"), f"{tmp_path}/b", id_col="my.id", url_col=None, payload_col="body", chunk_bytes=300)
    got = warc.read_warc(spark, f"{tmp_path}/b", id_type="string").select("id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(tuple, got.collect())) == sorted(plain(rows))


def test_damaged(spark, tmp_path):
    warc.write_warc(spark.createDataFrame([(1, "u", "hello")], "page_id long, url string, html string"), f"{tmp_path}/a")
    lines = [r.value for r in spark.read.option("lineSep", "\r\n\r\nWARC/1.1\r\n").text(f"{tmp_path}/a").collect() if r.value]
    spark.createDataFrame([(lines[0].replace("hello", "hellO"),)], "value string").write.option("lineSep", "\r\n").text(f"{tmp_path}/wrong")
    assert not warc.read_warc(spark, f"{tmp_path}/wrong").first().intact
    spark.createDataFrame([(lines[0][:-12],)], "value string").write.option("lineSep", "\r\n").text(f"{tmp_path}/short")
    with pytest.raises(Exception, match="shorter"):
        warc.read_warc(spark, f"{tmp_path}/short").collect()


def test_query(spark, sf):
    df = warc.op13_warc(spark, sf)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    rel = con.sql(warc.OP13_SQL)
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(rel.columns, rel.fetchall())
