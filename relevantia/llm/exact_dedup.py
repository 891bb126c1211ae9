"""Exact duplicates by two-pass Bloom filtering (native plan).

Pass one folds the hash of every normalised text into a blocked Bloom filter that
keeps the bits which at least two different insertions set. Pass two probes each
row: a row whose bits are not all there can have no equal and passes straight
through, without a shuffle; the possibly repeated rest is grouped by SHA-256.

A row's three bits lie in one 64-bit word. The bits grow with the rows, but no filter is
larger than ``max_filter_words``: a larger table is judged in slices of the hash, each with
a filter of its own, so that the share of rows that pass straight does not depend on size.
exact_dedup() decides on hashes and ids; no text reaches an exchange there.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, payload, staged, table, text_of

RESULTS = ["keep_id", "group_size", "kept", "text_sha256"]
#: 2**22 words of 8 bytes: no filter is larger than 32 MB.
MAX_FILTER_WORDS = 1 << 22
BITS_PER_ROW = 16
PAGE = 1024


def _word(h: Column, words: int) -> Column:
    return h.bitwiseAND(F.lit(words - 1))


def _mask(h: Column) -> Column:
    """Three of 64 bits, from other bits of the hash than the word's number."""
    bit = [F.expr("1L") for _ in range(3)]
    at = [F.shiftrightunsigned(h, s).bitwiseAND(F.lit(63)).cast("int") for s in (40, 46, 52)]
    one, two, three = (F.call_function("shiftleft", b, a) for b, a in zip(bit, at))
    return one.bitwiseOR(two).bitwiseOR(three)


def repeated_filter(hashes: DataFrame, words: int) -> DataFrame:
    """One row: ``bits``, an array of ``words`` longs with the bits that two insertions share.

    ``hashes`` has one column ``h``. Equal hashes meet map-side first, so that a hot
    text is one row per task.
    """
    counted = hashes.groupBy(_word(F.col("h"), words).alias("w"), _mask(F.col("h")).alias("m")).agg(F.count("*").alias("n"))
    step = """aggregate(ms, named_struct('o', 0L, 't', 0L),
        (a, x) -> named_struct('o', a.o | x.m, 't', a.t | (a.o & x.m) | if(x.n > 1, x.m, 0L)), a -> a.t)"""
    twice = counted.groupBy("w").agg(F.collect_list(F.struct("m", "n")).alias("ms")).select("w", F.expr(step).alias("b")).where("b != 0")
    empty = hashes.sparkSession.range(words).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("b"))
    dense = twice.union(empty).groupBy("w").agg(F.bit_or("b").alias("b"))
    pages = dense.groupBy((F.col("w") / PAGE).cast("long").alias("page")).agg(F.array_sort(F.collect_list(F.struct("w", "b"))).alias("ws"))
    pages = pages.select("page", F.transform("ws", lambda x: x["b"]).alias("ws"))
    return pages.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("page", "ws"))), lambda x: x["ws"])).alias("bits"))


def filter_shape(n: int, bits_per_row: int, most: int) -> tuple[int, int]:
    """(slices, words of each slice's filter, a power of two) for n rows."""
    slices = max(1, math.ceil(n * bits_per_row / (64 * most)))
    return slices, max(PAGE, 1 << max(0, math.ceil(n * bits_per_row / (64 * slices)) - 1).bit_length())


def _slice(h: Column, slices: int) -> Column:
    """By a hash of the hash: the filter's bits stay independent of it."""
    return F.pmod(F.xxhash64(h), F.lit(slices)).cast("int")


def _probed(part: DataFrame, words: int) -> Column:
    """Whether a row of part (h) is possibly repeated there."""
    bits = staged(repeated_filter(part.select("h"), words), "dedup-filter").scalar()
    return F.get(bits, _word(F.col("h"), words).cast("int")).bitwiseAND(_mask(F.col("h"))) == _mask(F.col("h"))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = BITS_PER_ROW, max_filter_words: int = MAX_FILTER_WORDS, carry: list[str] | None = None) -> DataFrame:
    """df's columns but the text (or ``carry``) with ``keep_id, group_size, kept, text_sha256``; of equal texts the row with the largest id stays.

    Equal: identical after lower-casing A-Z. A null text is empty, and empty texts
    are equal to each other. Null ids come before all others. Of rows that repeat
    the id as well, exactly one is kept. An empty table gives an empty result.
    Input columns named like a result are replaced; other columns are carried along.
    """
    names = [c for c in df.columns if c != text_col] if carry is None else carry
    norm = ascii_lower(text_of(df, text_col))
    # A column of a staged table is worked out once: each text is normalised and hashed in one scan, and written as 40 bytes.
    row = F.struct(F.lit(0).alias("none"), *[df[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(names)])
    rows = df.select(row.alias("row"), df[id_col].alias("id"), norm.alias("norm"), F.monotonically_increasing_id().alias("nth"))
    rows = staged(rows.where("nth >= 0").select("row", "id", "nth", F.xxhash64("norm").alias("h"), F.unhex(F.sha2("norm", 256)).alias("sha")), "dedup-hashes")
    slices, words = filter_shape(rows.count(), bits_per_row, max_filter_words)
    probed = None
    for s in range(slices):
        part = rows.where(_slice(F.col("h"), slices) == s) if slices > 1 else rows
        one = staged(part.withColumn("again", _probed(part, words)).drop("h"), "dedup-probed")
        probed = one if probed is None else probed.unionByName(one)
    again = probed.where("again")
    # Written, so that the join has a plain exchange on either side: then a hot group's rows can be split over tasks.
    groups = staged(again.groupBy("sha").agg(F.max(F.struct("id", "nth")).alias("keep"), F.count("*").alias("group_size")), "dedup-groups")
    judged = again.join(groups, "sha").select("row", F.col("keep.id").alias("keep_id"), "group_size", (F.col("nth") == F.col("keep.nth")).alias("kept"), "sha")
    alone = probed.where("NOT again").select("row", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    out = alone.unionByName(judged)
    return out.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(names) if c.lower() not in RESULTS], "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def _one_of_each(part: DataFrame, words: int) -> DataFrame:
    """``row`` of the rows of part (row, id, nth, norm, h) that stay."""
    maybe = _probed(part, words)
    alone = part.where(~maybe & (F.col("nth") >= 0)).select("row")
    again = staged(part.where(maybe & (F.col("nth") >= 0)).select("row", "id", F.unhex(F.sha2("norm", 256)).alias("sha")), "dedup-maybe")
    named = again.groupBy("sha", "id").agg(F.count("*").alias("n")).groupBy("sha").agg(F.max(F.struct("id", "n")).alias("keep"))
    named = staged(named.select(F.col("sha").alias("of"), "keep"), "dedup-groups")
    stay = again.join(named, (F.col("sha") == F.col("of")) & F.col("id").eqNullSafe(F.col("keep.id"))).select("row", "sha", "keep.n")
    # Of whole repeats any one: they meet map-side first.
    repeats = stay.where("n > 1").groupBy("sha").agg(F.first("row").alias("row"))
    return alone.unionByName(stay.where("n = 1").select("row")).unionByName(repeats.select("row"))


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = BITS_PER_ROW, max_filter_words: int = MAX_FILTER_WORDS) -> DataFrame:
    """One row of each group of equal texts, with df's columns: cases as in exact_dedup(). Of texts only possibly repeated ones move.

    Where one filter does not do, rows are written by slice once, so that each slice is read with its filter alone.
    """
    slices, words = filter_shape(df.count(), bits_per_row, max_filter_words)
    rows = payload(df, id=df[id_col], norm=ascii_lower(text_of(df, text_col)), nth=F.monotonically_increasing_id()).withColumn("h", F.xxhash64("norm"))
    if slices == 1:
        return _one_of_each(rows, words).select("row.*")
    rows = staged(rows.withColumn("slice", _slice(F.col("h"), slices)), "dedup-slices", by="slice")
    kept = None
    for s in range(slices):
        one = staged(_one_of_each(rows.where(F.col("slice") == s), words), "dedup-kept")
        kept = one if kept is None else kept.unionByName(one)
    return kept.select("row.*")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs)


ORACLE = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t
"""
