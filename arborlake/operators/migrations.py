"""The store as catalog tables, and the ordered migrations that bring an older one to the last version.

Every migration looks at what is there before it changes anything, so one that was interrupted is run again from where it stopped; versions are recorded one by one, after their migration.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of version 0.
TABLES = {
    "conversations": "id STRING, title STRING, doc_id STRING, created_at STRING, updated_at STRING",
    "messages": "id STRING, conv_id STRING, role STRING, content STRING, created_at STRING",
    "traces": "id STRING, conv_id STRING, provider_name STRING, total_tokens BIGINT, total_cost DOUBLE, total_latency_ms BIGINT, steps_count BIGINT, created_at STRING",
    "exploration_steps": "id STRING, msg_id STRING, step_number INT, tool_name STRING, input_json STRING, output_json STRING, tokens_used BIGINT, latency_ms BIGINT",
    "bookmarks": "id STRING, doc_id STRING, node_id STRING, label STRING, created_at STRING",
    "cross_doc_relations": "id STRING, source_doc_id STRING, source_node_id STRING, target_doc_id STRING, target_node_id STRING, relation_type STRING, confidence DOUBLE, description STRING, created_at STRING",
}
#: Columns that queries look rows up by; writers cluster their files by them.
LOOKUPS = {"messages": "conv_id", "traces": "conv_id", "exploration_steps": "msg_id", "bookmarks": "doc_id", "cross_doc_relations": "source_doc_id,target_doc_id"}
LOOKUP = "arborlake.lookup"


def has_columns(spark: SparkSession, table: str, *columns: str) -> bool:
    """Whether a table has columns, asked of the catalog: no row is read."""
    return set(map(str.lower, columns)) <= {c.name.lower() for c in spark.catalog.listColumns(table)}


def has_table(spark: SparkSession, db: str, table: str) -> bool:
    return spark.catalog.tableExists(f"{db}.{table}")


def _create(spark: SparkSession, db: str, table: str, ddl: str) -> None:
    spark.sql(f"CREATE TABLE IF NOT EXISTS {db}.{table} ({ddl}) USING parquet")


def version(spark: SparkSession, db: str) -> int:
    """The last recorded version, 0 if there is none."""
    if not has_table(spark, db, "schema_version"):
        return 0
    return spark.table(f"{db}.schema_version").agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]


def _token_columns(spark: SparkSession, db: str) -> None:
    for column in ("input_tokens", "output_tokens"):
        if not has_columns(spark, f"{db}.traces", column):
            spark.sql(f"ALTER TABLE {db}.traces ADD COLUMNS ({column} BIGINT DEFAULT 0)")  # rows that are there read 0


def _lookups(spark: SparkSession, db: str) -> None:
    for table, columns in LOOKUPS.items():
        spark.sql(f"ALTER TABLE {db}.{table} SET TBLPROPERTIES ('{LOOKUP}' = '{columns}')")


def _conversation_documents(spark: SparkSession, db: str) -> None:
    _create(spark, db, "conversation_documents", "conv_id STRING, doc_id STRING, added_at STRING")
    spark.sql(f"ALTER TABLE {db}.conversation_documents SET TBLPROPERTIES ('{LOOKUP}' = 'conv_id,doc_id')")
    keys = ["conv_id", "doc_id"]
    held = spark.table(f"{db}.conversations").filter("doc_id IS NOT NULL AND doc_id <> ''").select(F.col("id").alias("conv_id"), "doc_id", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("added_at"))
    new = held.dropDuplicates(keys).join(spark.table(f"{db}.conversation_documents").select(*keys), keys, "left_anti")
    insert(new, db, "conversation_documents")


#: The migration at k leads from version k to k + 1.
MIGRATIONS: list[Callable[[SparkSession, str], None]] = [_token_columns, _lookups, _conversation_documents]


def insert(rows: DataFrame, db: str, table: str) -> None:
    """Append rows, clustered by the columns that the table is looked up by."""
    spark = rows.sparkSession
    columns = [c.name for c in spark.catalog.listColumns(f"{db}.{table}")]
    found = spark.sql(f"SHOW TBLPROPERTIES {db}.{table}").filter(F.col("key") == LOOKUP).collect()
    rows = rows.select(*columns)
    if found:
        rows = rows.repartition(*found[0]["value"].split(",")).sortWithinPartitions(*found[0]["value"].split(","))
    rows.write.insertInto(f"{db}.{table}")


def migrate(spark: SparkSession, db: str, to: int | None = None) -> int:
    """Run the migrations that a store has not had, in order; the version it has then. A store at the last version is left as it is."""
    to = len(MIGRATIONS) if to is None else to
    _create(spark, db, "schema_version", "version INT")
    for k in range(version(spark, db), to):
        MIGRATIONS[k](spark, db)
        spark.createDataFrame([(k + 1,)], "version int").write.insertInto(f"{db}.schema_version")
    return version(spark, db)


def create(spark: SparkSession, db: str, location: str | None = None) -> None:
    """Make the database and tables that do not exist, those of version 0."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {db}" + (f" LOCATION '{location}'" if location else ""))
    for table, ddl in TABLES.items():
        _create(spark, db, table, ddl)


def initialize(spark: SparkSession, db: str, location: str | None = None) -> int:
    """Make what does not exist, and bring it to the last version."""
    create(spark, db, location)
    return migrate(spark, db)


def catalog_counts(spark: SparkSession, db: str) -> DataFrame:
    """kind, n: tables, and the columns they are looked up by, as the catalog has them."""
    tables = [t.name for t in spark.catalog.listTables(db)]
    lookups = sum(len(r["value"].split(",")) for t in tables for r in spark.sql(f"SHOW TBLPROPERTIES {db}.{t}").filter(F.col("key") == LOOKUP).collect())
    return spark.createDataFrame([("tables", len(tables)), ("lookups", lookups)], "kind string, n int")
