"""Small literal frames built inside the JVM."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def literal_rows(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A frame of constants as a projection, without a Python worker."""
    fields = [part.strip().split(" ", 1) for part in schema.split(",")]
    structs = [
        F.struct(*[F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(row, fields)]) for row in rows
    ]
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*structs)))
