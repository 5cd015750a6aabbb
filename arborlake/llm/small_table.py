"""Small tables of driver values."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def small_table(spark: SparkSession, schema: str, *columns: list) -> DataFrame:
    """Columns of driver values as a table. A list of rows would pass through an RDD, for which each executor starts a second set of workers."""
    kind = StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow), kind)
