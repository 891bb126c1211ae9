"""Reading feature tables and writing results: Spark's own readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_features(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A CSV (with header) or Parquet table. A CSV without a schema is read twice to infer one."""
    if path.rstrip("/").endswith((".csv", ".csv.gz")):
        reader = spark.read.option("header", True)
        return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    return spark.read.parquet(path)


def write_result(df: DataFrame, path: str, form: str = "parquet") -> None:
    df.write.mode("overwrite").options(**({"header": True} if form == "csv" else {})).format(form).save(path)
