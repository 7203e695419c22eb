"""Small tables that the plan itself holds."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def small_table(spark: SparkSession, rows: list[dict], schema: StructType | str) -> DataFrame:
    """rows as a local relation: reading it needs no job."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return spark.createDataFrame(pa.Table.from_pylist(rows, to_arrow_schema(schema)), schema)
