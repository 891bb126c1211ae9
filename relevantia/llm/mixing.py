"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree (native plan).

Within a source, documents stand in a pseudo-random order (MD5 of seed and id) that
is cut into blocks. A target above the source's size takes whole passes over the
source plus the head of the order, a smaller one the head only; so every source has
an exact number of blocks to hand out, its quota. The splitting tree deals all
quotas to the output shards: at each node the quota vector is split between the two
halves of the node's shards by a multivariate hypergeometric draw, which is what
dealing the node's blocks out blindly would give. A shard's count of a source then
takes the next blocks of that source's own permutation, and rows are shuffled within
their shard. A document is taken as often as shards were dealt to its blocks.

Only one row per source and the tree (an entry for each source that a node has blocks of,
so at each level no more than there are blocks) are small tables; documents are read, never
sorted as a whole: the cut through a source's order lies in one of the hash buckets, and only
that bucket is ordered. Shards, blocks and buckets grow with the words of the table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, payload, staged, table, text_of, unpack

WEIGHTS = (1, 2, 3)
#: No source is repeated more than this.
MAX_REPEAT = 3
#: Up to so many sources and blocks (about 100 and 4 bytes each) the plan is broadcast; beyond, it is joined by source.
BROADCAST_ENTRIES = 250_000
#: Shards grow with the mixture: about so many words each, so many shards at least, and so many blocks for each.
WORDS_PER_SHARD, LEAST_SHARDS, BLOCKS_PER_SHARD = 64_000_000, 64, 16
RESULTS = ["size", "source_size", "target", "taken", "shards"]


def _key(source: Column) -> Column:
    """Sources as a column that joins: null is a source of its own."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def _order(seed: int, doc: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc.cast("string"), F.lit(""))))


def bucket_digits(n_shards: int) -> int:
    """Hexadecimal digits of the hash order that name a bucket: at least as many buckets as all shards have blocks."""
    return max(3, math.ceil(math.log(n_shards * BLOCKS_PER_SHARD, 16)))


def _bucket(h: Column, digits: int) -> Column:
    return F.conv(F.substring(h, 1, digits), 16, 10).cast("int")


def source_targets(sizes: DataFrame, weights=WEIGHTS) -> DataFrame:
    """From (skey, source, size) one row per source with ``source_size, weight, target``.

    Sources by code point, null last, weigh as listed, over and over. Targets share
    the sum of all sizes by weight, none above MAX_REPEAT times its source: in order
    of cap over weight a source is capped if the level at its cap needs no more than all.
    """
    src = sizes.groupBy("skey", "source").agg(F.sum("size").alias("source_size"))
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    src = src.withColumn("sid", nth).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int")))
    src = src.withColumn("cap", MAX_REPEAT * F.col("source_size")).withColumn("rho", F.col("cap").cast("double") / F.col("weight"))
    every, upto = Window.partitionBy(), Window.orderBy("rho", "sid").rowsBetween(Window.unboundedPreceding, 0)
    src = src.select("*", F.sum("source_size").over(every).alias("total"), F.sum("weight").over(every).alias("all_w"), F.sum("cap").over(upto).alias("cap_to"), F.sum("weight").over(upto).alias("w_to"))
    src = src.withColumn("capped", F.col("cap_to") + F.col("rho") * (F.col("all_w") - F.col("w_to")) <= F.col("total"))
    src = src.select("*", F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(every).alias("capped_sum"), F.sum(F.when(F.col("capped"), 0).otherwise(F.col("weight"))).over(every).alias("free_w"))
    share = (F.col("total") - F.col("capped_sum")).cast("double") * F.col("weight") / F.col("free_w")
    return src.select("skey", "source", "sid", "weight", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def source_cuts(sizes: DataFrame, targets: DataFrame, digits: int) -> DataFrame:
    """targets with ``passes`` (whole passes) and the end of the head that one more pass takes: all orders below ``cut_floor``, and up to ``cut`` (order, id).

    A document belongs to the head if its middle word does.
    """
    t = targets.select("skey", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MAX_REPEAT))).otherwise(0).cast("int").alias("passes"), "target", "source_size")
    t = t.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    sizes = sizes.withColumn("bucket", _bucket(F.col("h"), digits))
    buckets = sizes.groupBy("skey", "bucket").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # The head ends in the last bucket that begins at or before the rest, or in one without words after it.
    at = buckets.join(t, "skey").where((F.col("base") <= F.col("rest")) & (F.col("rest") > 0))
    at = at.groupBy("skey").agg(F.max(F.struct("bucket", "base", "rest")).alias("at")).select("skey", "at.*")
    held = sizes.join(at, ["skey", "bucket"])
    run = Window.partitionBy("skey", "bucket").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("middle", F.col("base") + F.coalesce(F.sum("size").over(run), F.lit(0)) + F.col("size") / 2.0)
    ends = held.where(F.col("middle") <= F.col("rest")).groupBy("skey").agg(F.max(F.struct("h", "id")).alias("cut"))
    # All before that bucket belongs to the head, and perhaps nothing of the bucket.
    floor = at.select("skey", F.lower(F.lpad(F.conv(F.col("bucket").cast("string"), 10, 16), digits, "0")).alias("cut_floor"))
    return targets.join(t.select("skey", "passes"), "skey").join(ends, "skey", "left").join(floor, "skey", "left")


def _split(level: int, seed: int) -> str:
    """The draw of one node, as SQL: of its ``q`` the share of the left half, by selection sampling without replacement."""
    u = f"(pmod(xxhash64({seed}, {level}, node, x.sid, j), 9007199254740992L) / 9007199254740992D)"
    hit = f"if({u} * b.t < b.l, 1, 0)"
    inner = f"""aggregate(sequence(1, x.n), named_struct('t', a.t, 'l', a.l, 'g', 0),
        (b, j) -> named_struct('t', b.t - 1, 'l', b.l - {hit}, 'g', b.g + {hit}))"""
    return f"""aggregate(q, named_struct('t', total, 'l', left_total, 'out', cast(array() as array<int>)),
        (a, x) -> transform(array({inner}), r -> named_struct('t', r.t, 'l', r.l, 'out', concat(a.out, array(r.g))))[0], a -> a.out)"""


def split_quotas(quotas: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """From (sid, blocks) of each source (shard, sid, n): how many blocks of it each shard gets, where it gets any.

    Shard totals differ by rounding only. One level of the tree per doubling of shards.
    """
    row = quotas.where("blocks > 0").agg(F.array_sort(F.collect_list(F.struct(F.col("sid").cast("int").alias("sid"), F.col("blocks").cast("int").alias("n")))).alias("q"))
    tree = row.select(F.lit(0).alias("node"), F.lit(0).alias("first"), F.lit(n_shards).alias("width"), "q")
    some = lambda q: F.filter(q, lambda x: x["n"] > 0)
    for level in range(math.ceil(math.log2(n_shards))):
        tree = tree.withColumn("total", F.aggregate("q", F.lit(0), lambda a, x: a + x["n"])).withColumn("left_width", F.expr("cast(ceil(width / 2) as int)"))
        tree = tree.withColumn("left_total", F.expr("cast(round(total * left_width / width) as int)")).withColumn("lq", F.when(F.col("width") > 1, F.expr(_split(level, seed))).otherwise(F.transform("q", lambda x: x["n"])))
        own = some(F.zip_with("q", "lq", lambda x, n: F.struct(x["sid"].alias("sid"), n.alias("n"))))
        rest = some(F.zip_with("q", "lq", lambda x, n: F.struct(x["sid"].alias("sid"), (x["n"] - n).alias("n"))))
        left = F.struct((F.col("node") * 2).alias("node"), "first", F.col("left_width").alias("width"), own.alias("q"))
        right = F.struct((F.col("node") * 2 + 1).alias("node"), (F.col("first") + F.col("left_width")).alias("first"), (F.col("width") - F.col("left_width")).alias("width"), rest.alias("q"))
        tree = tree.select(F.explode(F.when(F.col("width") > 1, F.array(left, right)).otherwise(F.array(left))).alias("x")).select("x.*")
    return tree.select(F.col("first").alias("shard"), F.explode("q").alias("x")).select("shard", "x.*")


def source_plan(sizes: DataFrame, n_shards: int = LEAST_SHARDS, seed: int = 7, weights=WEIGHTS) -> DataFrame:
    """All that is decided per source: ``source_size, target, passes, cut, per_pass`` (blocks) and ``dealt``, each block's shard."""
    digits = bucket_digits(n_shards)
    cuts = staged(source_cuts(sizes, source_targets(sizes, weights), digits), "mix-cuts")
    block = F.sum("target").over(Window.partitionBy()) / (n_shards * BLOCKS_PER_SHARD)
    cuts = cuts.withColumn("per_pass", F.greatest(F.lit(1), F.least(F.lit(16**digits), F.round(F.col("source_size") / F.when(block > 0, block).otherwise(1)).cast("int"))))
    head = F.when(F.col("cut").isNotNull() | F.col("cut_floor").isNotNull(), 1 + _part(_bucket(F.coalesce("cut.h", "cut_floor"), digits), F.col("per_pass"), digits)).otherwise(0)
    cuts = cuts.withColumn("blocks", F.col("passes") * F.col("per_pass") + head)
    counts = staged(split_quotas(cuts.select("sid", "blocks"), n_shards, seed), "mix-tree")
    upto = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("hi", F.sum("n").over(upto)).select("sid", "shard", F.explode(F.expr("sequence(hi - n, hi - 1)")).alias("rank"))
    blocks = cuts.where("blocks > 0").select("sid", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"))
    drawn = Window.partitionBy("sid").orderBy(F.xxhash64(F.lit(seed), "sid", "block"), "block")
    blocks = blocks.withColumn("rank", (F.row_number().over(drawn) - 1).cast("long"))
    # A block that the tree did not deal has no shard, and nothing of it is taken.
    dealt = blocks.join(counts, ["sid", "rank"], "left").groupBy("sid").agg(F.transform(F.array_sort(F.collect_list(F.struct("block", "shard"))), lambda x: x["shard"]).alias("dealt"))
    return staged(cuts.join(dealt, "sid", "left").drop("source", "sid", "weight", "blocks"), "mix-plan")


def _part(bucket: Column, parts: Column, digits: int) -> Column:
    """Which of so many equal parts of the hash order a bucket lies in."""
    return F.floor(bucket.cast("long") * parts / F.lit(16**digits)).cast("int")


def _with_plan(rows: DataFrame, plan: DataFrame, n_shards: int) -> DataFrame:
    """rows (skey, id, h) with ``shards``, the shard of each copy that the tree dealt out."""
    digits = bucket_digits(n_shards)
    small = n_shards * BLOCKS_PER_SHARD + plan.count() <= BROADCAST_ENTRIES
    out = rows.join(F.broadcast(plan) if small else plan, "skey")
    last = F.col("id").isNull() | F.col("id").eqNullSafe(F.col("cut.id")) | (F.col("id") <= F.col("cut.id"))
    head = F.coalesce(F.col("h") < F.col("cut_floor"), F.lit(False)) | F.coalesce((F.col("h") < F.col("cut.h")) | ((F.col("h") == F.col("cut.h")) & last), F.lit(False))
    out = out.withColumn("copies", F.col("passes") + head.cast("int"))
    at = F.sequence(F.lit(0), F.col("copies") - 1)
    shard = F.transform(at, lambda p: F.get(F.col("dealt"), p * F.col("per_pass") + _part(_bucket(F.col("h"), digits), F.col("per_pass"), digits)))
    return out.withColumn("shards", F.when(F.col("copies") > 0, F.filter(shard, lambda s: s.isNotNull())).otherwise(F.array().cast("array<int>")))


def _sizes(df: DataFrame, id_col: str, source_col: str, text_col: str, seed: int) -> DataFrame:
    t = df.select(df[id_col].alias("id"), df[source_col].cast("string").alias("source"), F.regexp_count(text_of(df, text_col), F.lit(WORD)).cast("long").alias("size"))
    h = _order(seed, F.col("id"))
    return staged(t.select("id", "source", _key(F.col("source")).alias("skey"), "size", h.alias("h")), "mix-sizes")


def shards_for(sizes: DataFrame) -> int:
    """How many shards a mixture of these sizes is dealt to; its words are as many as the input's."""
    words = sizes.agg(F.sum("size")).first()[0] or 0
    return max(LEAST_SHARDS, words // WORDS_PER_SHARD)


def mix_report(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", n_shards: int | None = None, seed: int = 7, weights=WEIGHTS) -> DataFrame:
    """One row per row of df: id, ``size`` in words, ``source_size, target, taken`` (words, repeats counted) and ``shards`` of its copies.

    A null text has size 0; a null source is a source of its own; null ids are
    ordered as empty strings. Rows that repeat an id stand together in the order and are
    taken alike. A source without words has target 0. An empty table gives an empty
    result. Other columns of df are not carried. Without n_shards see shards_for().
    """
    sizes = _sizes(df, id_col, source_col, text_col, seed)
    n_shards = n_shards or shards_for(sizes)
    out = _with_plan(sizes, source_plan(sizes, n_shards, seed, weights), n_shards)
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"), "shards")


def mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", n_shards: int | None = None, seed: int = 7, weights=WEIGHTS) -> DataFrame:
    """The mixture itself: df's rows with df's columns, each as often as it is taken, dealt to shards and shuffled within them.

    Each shard is one output partition. Cases as in mix_report().
    """
    sizes = _sizes(df, id_col, source_col, text_col, seed)
    n_shards = n_shards or shards_for(sizes)
    plan = source_plan(sizes, n_shards, seed, weights)
    rows = payload(df, id=df[id_col], skey=_key(df[source_col]), h=_order(seed, df[id_col]))
    out = _with_plan(rows, plan, n_shards).select("row", "h", F.posexplode("shards").alias("nth", "shard"))
    # By its number, not by a hash of it: two shards in one task would undo the even deal.
    out = out.repartitionById(n_shards, "shard").sortWithinPartitions("shard", F.xxhash64(F.lit(seed), "h", "nth"))
    return out.select("row.*")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("shards")


ORACLE = """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
                  md5('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM s0),
s2 AS (SELECT *, 1 + sid % 3 AS weight, 3 * source_size AS cap, (3 * source_size)::DOUBLE / (1 + sid % 3) AS rho FROM s1),
s3 AS (SELECT *, sum(source_size) OVER ()::BIGINT AS total, sum(weight) OVER () AS all_w,
              sum(cap) OVER (ORDER BY rho, sid ROWS UNBOUNDED PRECEDING) AS cap_to,
              sum(weight) OVER (ORDER BY rho, sid ROWS UNBOUNDED PRECEDING) AS w_to FROM s2),
s4 AS (SELECT *, cap_to::DOUBLE + rho * (all_w - w_to)::DOUBLE <= total AS capped FROM s3),
s5 AS (SELECT *, sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()::BIGINT AS capped_sum,
              sum(CASE WHEN capped THEN 0 ELSE weight END) OVER ()::BIGINT AS free_w FROM s4),
s6 AS (SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE (total - capped_sum)::DOUBLE * weight / free_w END AS target FROM s5),
s7 AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END::BIGINT AS passes FROM s6),
j AS (SELECT d.*, s7.source_size, s7.target, s7.passes,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2.0 AS middle
      FROM d JOIN s7 ON d.source IS NOT DISTINCT FROM s7.source)
SELECT doc_id, size, source_size, target,
       (size * (passes + CASE WHEN target - passes * source_size > 0 AND middle <= target - passes * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM j
"""
