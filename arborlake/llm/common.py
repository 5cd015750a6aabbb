"""What the operators of this subpackage share: session settings, durable tables and small column helpers."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Keys are broadcast up to this many (tens of MB), and joined by a shuffle beyond.
BROADCAST_KEYS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; a temporary one in local mode only, if that is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="arborlake-")
    atexit.register(shutil.rmtree, path, True)
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written as a Parquet table in the shared folder and read back, which cuts its lineage and survives lost executors; and the table's path."""
    path = table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables of stored() that nothing reads any more."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> Column:
    """The column of that name, whatever signs it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def numbered(df: DataFrame, *names: str) -> tuple[DataFrame, list[Column]]:
    """df with its columns as c0, c1, ..., so that no name clashes with what an operator adds, and the columns of the given names."""
    at = [c.lower() for c in df.columns]
    return df.toDF(*(f"c{i}" for i in range(len(at)))), [F.col(f"c{at.index(n.lower())}") for n in names]


def text_of(col: Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(col.cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else; lower() does just that, and faster, if every character is ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def crc_fold(doc_id: Column, m: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(m))


def row_key(doc_id: Column, text: Column) -> Column:
    """16 bytes that stand for an id and a text, either of which may be null."""
    part = lambda c: F.when(c.isNull(), F.lit("n")).otherwise(F.concat(F.lit("="), F.char_length(c).cast("string"), F.lit(":"), c))
    return F.unhex(F.md5(F.concat(part(doc_id.cast("string")), part(text)).cast("binary")))


def without_rows(docs: DataFrame, key: Column, marks: DataFrame, names: list[str]) -> DataFrame:
    """The rows of numbered docs that marks leave, under their names again. marks: key, gone, once for each key. A key that is marked but not gone leaves one of
    its rows, the first by its columns as JSON; keys without a mark leave all of theirs. Only docs with very many marked keys are shuffled."""
    marks, _ = stored(marks.select("key", "gone"), "marks")
    sizes = {r["gone"]: r["n"] for r in marks.groupBy("gone").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows at most
    if not sizes:
        return docs.toDF(*names)
    few = sum(sizes.values()) <= BROADCAST_KEYS
    joined = docs.withColumn("key", key).join(F.broadcast(marks) if few else marks, "key", "left")
    out = joined.filter(F.col("gone").isNull()).select(*docs.columns)
    if sizes.get(False):
        row = F.struct(*docs.columns)
        out = out.union(joined.filter("NOT gone").groupBy("key").agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*"))
    return out.toDF(*names)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of finished queries now; otherwise they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()
