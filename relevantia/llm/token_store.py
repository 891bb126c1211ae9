"""Token ids as Parquet list columns that can be read in part.

Texts are range-partitioned by id, sorted, encoded and written by Spark's own writer,
so that a lost executor costs a task attempt and never a half-written file. One row
holds ``part`` (the file's number in id order), ``doc_id``, ``first`` (ids before it
in its file), ``n_tokens`` and ``tokens``. Token ids are dictionary-encoded (the
vocabulary fits one dictionary page), the numeric columns delta-encoded; row groups and
pages are small, so that a reader of some documents skips by column index to their
pages, and a reader of the metadata never touches the tokens. ``index`` holds where each
file starts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .bpe import id_lists, loaded, slices, word_file
from .common import shared_path, table, text_of

END_ID = 2
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 128 << 10
PAGE_ROWS = 1000
#: Words that a worker keeps: twice those of the encoder with digests, since here words and ids lie in arrays.
KEPT_WORDS = 400_000


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe, part, first = loaded(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for start, texts in slices(batch, "text"):
                tokens = id_lists(bpe, texts, end_id, library=True, keep=KEPT_WORDS)
                at = tokens.offsets.to_numpy().astype(np.int64)
                n = len(texts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), batch.column(0).slice(start, n), pa.array(first + at[:-1]), pa.array(np.diff(at)), tokens], ["part", "doc_id", "first", "n_tokens", "tokens"])
                first += int(at[-1])

    return run


def write_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, tokenizer: str | None = None) -> None:
    """Encode df's texts, an end id after each, into ``path``/tokens in ascending id order, and ``path``/index.

    A null text is empty: its end id alone. Null ids come first; rows that repeat an id
    stand in the order of a hash of their texts. Other columns are not written. An
    empty table writes empty tables.
    """
    ship(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(df[id_col].alias("doc_id"), text_of(df, text_col).alias("text"))
    rows = rows.repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    out = rows.mapInArrow(_encode(tokenizer or word_file(), end_id), f"part int, doc_id {kind}, first long, n_tokens long, tokens array<int>")
    options = {
        "parquet.writer.version": "PARQUET_2_0", "parquet.block.size": ROW_GROUP_BYTES, "parquet.page.size": PAGE_BYTES, "parquet.page.row.count.limit": PAGE_ROWS, "compression": "zstd",
        "parquet.enable.dictionary": "true", **{f"parquet.enable.dictionary#{c}": "false" for c in ("doc_id", "first", "n_tokens")},
    }
    out.write.options(**{k: str(v) for k, v in options.items()}).parquet(f"{path}/tokens")
    files = out.sparkSession.read.schema(out.schema).parquet(f"{path}/tokens").groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # One row per file: the running sum over them is small however many documents there are.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")).write.parquet(f"{path}/index")


def read_tokens(spark: SparkSession, path: str, columns=("doc_id", "start", "n_tokens", "tokens"), ids: tuple | None = None) -> DataFrame:
    """The stored rows; without ``tokens`` among the columns only metadata is read, with an ids range (first, last) only its pages."""
    rows = spark.read.parquet(f"{path}/tokens")
    if ids is not None:
        rows = rows.where(F.col("doc_id").between(*ids))
    # The index has one row per file, as many as shuffle partitions at most: its broadcast is bounded.
    index = F.broadcast(spark.read.parquet(f"{path}/index"))
    return rows.join(index, "part").withColumn("start", F.col("base") + F.col("first")).select(*columns)


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        at = lists.offsets.to_numpy()
        ids = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False)).astype("<u4").view(np.uint8).data
        crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], [*batch.schema.names[:3], "ids_crc32"])


def token_digests(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of the ids as little-endian unsigned 32-bit integers) of read_tokens()."""
    ship(rows.sparkSession)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "start", "n_tokens", "tokens").mapInArrow(_crc, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return token_digests(read_tokens(spark, path))
