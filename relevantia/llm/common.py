"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_own_dir: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (as in tests) a temporary
    folder stands in for it; a cluster without one is refused, since no executor could
    read what another wrote to its own disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="relevantia-"))
    return _own_dir[0]


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder (in folders ``by`` a column's values) and read it back.

    Cuts the lineage at replicated storage: a lost executor costs the tasks it ran,
    not the table. The owner of the shared folder clears it.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path, partitionBy=by)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def payload(df: DataFrame, **named: Column) -> DataFrame:
    """Pack each whole row into one struct ``row`` beside the named columns, so that no name of ours clashes."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(k) for k, c in named.items()])


def unpack(df: DataFrame, names: list[str], results: list[str]) -> DataFrame:
    """Undo payload(); a result replaces an input column of the same name."""
    taken = {r.lower() for r in results}
    return df.select(*[F.col(f"row.`{c}`") for c in names if c.lower() not in taken], *results)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, nothing else. Texts without other letters take the faster way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def text_of(df: DataFrame, text_col: str) -> Column:
    """The text; null is empty."""
    return F.coalesce(df[text_col].cast("string"), F.lit(""))
