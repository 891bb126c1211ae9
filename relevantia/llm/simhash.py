"""SimHash near-duplicates with vantage-point trees.

Two fingerprints with at most three differing bits have at most one in one of their
32-bit halves. So there is one tree for each half, searched with radius one. A tree is
fitted on a sample of the distinct fingerprints: each inner node has a vantage point and a
distance M; points at M or nearer go left, points at M - radius + 1 or farther go right,
and the band between goes to both: by the triangle inequality no linked pair is parted.
Where points share a half, so that its distances part nothing, the node takes those of the whole
fingerprint with radius three. A leaf is a shard; all distinct fingerprints are routed, and
each shard finds its exact pairs, with inner vantage points where it is large. The shards
grow in number with the fingerprints (shard_size()), and the sample with the shards.

Equal fingerprints are one point (their documents are linked anyway, and a hot group
meets map-side). A shard returns a forest that spans its links, fewer rows than points,
never all pairs; the components of all forests are then found by alternating large and
small stars, each round written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .common import payload, staged, table, text_of, unpack

RADIUS = 3
SHINGLE = 3
SEED = 42
#: The trees are fitted on SAMPLE distinct fingerprints, or on POINTS for each shard if those are more (all, if there are fewer);
#: every fingerprint is routed and compared.
SAMPLE, POINTS = 65_536, 32
#: Distinct fingerprints that a shard should have about: the least, and from LARGE_SHARD * SPREAD fingerprints on the most.
SHARD, LARGE_SHARD, SPREAD = 2048, 65_536, 512
#: Edges that a task of a round of stars writes at least, where the session's tasks at once could write more files.
EDGES = 65_536
_HALVES = (0, 32)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint: a bit is set if over half the shingles' hashes have it; no words: 0."""
    words = text.encode("utf-8").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate([len(w) + 1 for w in words]))
    starts = [0, *ends[:-1]]
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[k - 1 :])], "<u8")
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        counts += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(h), bitorder="little").tobytes(), "little")


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], [batch.schema.names[0], "fp"])

    return run


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """id and ``fp`` (long). A null text is empty."""
    ship(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(df[id_col].alias("id"), text_of(df, text_col).alias("text"))
    return rows.mapInArrow(_fingerprints(shingle), f"id {kind}, fp long")


# Vantage-point trees


def _distances(points: np.ndarray, pivot) -> np.ndarray:
    return np.bitwise_count(points ^ pivot)


def _best_split(points: np.ndarray, radius: int, tries: int = 4):
    """Of a few vantage points the one with the smallest larger side: (larger side, pivot, M)."""
    best = None
    for k in range(tries):
        pivot = points[k * len(points) // tries]
        d = _distances(points, pivot)
        counts = np.bincount(d, minlength=65)
        upto = np.cumsum(counts)
        left = upto[radius - 1 :] if radius > 1 else upto
        m = np.arange(radius - 1, len(counts))
        right = len(points) - np.concatenate([[0], upto])[m - radius + 1]
        worst = np.maximum(left, right)
        at = int(np.argmin(worst))
        if best is None or worst[at] < best[0]:
            best = (int(worst[at]), pivot, int(m[at]))
    return best


def shard_size(n: int) -> int:
    """Of n distinct fingerprints about so many make a shard: n / this is what grows without end."""
    return min(max(SHARD, n // SPREAD), LARGE_SHARD)


def build_tree(points: np.ndarray, shift: int, leaf: float, radius: int = RADIUS) -> np.ndarray:
    """Nodes (pivot, m, left, right, whole) over fingerprints by their half at ``shift``, a leaf having left 0; the root first.

    A node is split while it has more than ``leaf`` sample points: by distances of halves
    with radius one, or, if those part little, of whole fingerprints with ``radius``.
    """
    nodes: list = [(0, 0, 0, 0, False)]
    work = [(0, points)]
    while work:
        at, own = work.pop()
        if len(own) <= max(leaf, 16):
            continue
        for whole in (False, True):
            x, r = (own, max(radius, 1)) if whole else ((own >> np.uint64(shift)).astype(np.uint32), 1)
            worst, pivot, m = _best_split(x, r)
            if worst <= 0.9 * len(own):
                break
        else:
            continue
        d = _distances(x, pivot)
        nodes[at] = (int(pivot), m, len(nodes), len(nodes) + 1, whole)
        work += [(len(nodes), own[d <= m]), (len(nodes) + 1, own[d >= m - r + 1])]
        nodes += [(0, 0, 0, 0, False)] * 2
    return np.array(nodes, [("pivot", "<u8"), ("m", "<i4"), ("left", "<i4"), ("right", "<i4"), ("whole", "?")])


def route(nodes: np.ndarray, points: np.ndarray, shift: int, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(positions, leaves): each fingerprint with every leaf that it must be compared in."""
    at, leaves = [], []
    halves = (points >> np.uint64(shift)).astype(np.uint32)
    work = [(0, np.arange(len(points)))]
    while work:
        node, own = work.pop()
        if not len(own):
            continue
        pivot, m, left, right, whole = nodes[node].item()
        if not left:
            at.append(own)
            leaves.append(np.full(len(own), node, np.int32))
            continue
        d = _distances(points[own], np.uint64(pivot)) if whole else _distances(halves[own], np.uint32(pivot))
        work += [(left, own[d <= m]), (right, own[d >= m - (max(radius, 1) if whole else 1) + 1])]
    return (np.concatenate(at), np.concatenate(leaves)) if at else (np.empty(0, np.int64), np.empty(0, np.int32))


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give linked points the smallest label of their component, in place."""
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        low = np.minimum(la, lb)
        np.minimum.at(label, np.maximum(la, lb), low)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label[:] = jumped


def forest(points: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For distinct points the position of the first point of each one's component under links of at most ``radius`` bits.

    Inner vantage points part large sets; a set that none parts (a dense cluster) is
    walked from point to point, each step against what is not yet reached, which a
    dense cluster leaves little of.
    """
    label = np.arange(len(points))
    work = [np.arange(len(points))]
    while work:
        own = work.pop()
        x = points[own]
        if len(own) <= SHARD:
            for i in range(0, len(own), 512):
                r, c = np.nonzero(np.bitwise_count(x[i : i + 512, None] ^ x[None, i:]) <= radius)
                off = c > r
                _joined(label, own[r[off] + i], own[c[off] + i])
            continue
        worst, pivot, m = _best_split(x, radius)
        if worst <= 0.85 * len(own):
            d = _distances(x, pivot)
            work += [own[d <= m], own[d >= m - radius + 1]]
            continue
        left = np.arange(len(own))
        while len(left):
            frontier, left = [left[0]], left[1:]
            while frontier:
                p = frontier.pop()
                near = np.bitwise_count(x[left] ^ x[p]) <= radius
                got = left[near]
                if len(got):
                    _joined(label, np.full(len(got), own[p]), own[got])
                    frontier.extend(got.tolist())
                    left = left[~near]
    return label


def _routed(trees: list[np.ndarray], radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            points = fp.view(np.uint64)
            for k, (shift, nodes) in enumerate(zip(_HALVES, trees)):
                at, leaf = route(nodes, points, shift, radius)
                yield pa.RecordBatch.from_arrays([pa.array(leaf * 2 + k), pa.array(fp[at])], ["shard", "fp"])

    return run


def _shard_forest(radius: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        fp = np.sort(pdf["fp"].to_numpy())
        first = forest(fp.view(np.uint64), radius)
        linked = first != np.arange(len(fp))
        return pd.DataFrame({"u": fp[linked], "v": fp[first[linked]]})

    return run


def links(distinct: DataFrame, radius: int = RADIUS, sample: int = SAMPLE) -> DataFrame:
    """Edges (u, v) that connect exactly the fingerprints connected by links of at most ``radius`` <= 3 bits."""
    ship(distinct.sparkSession)
    if not 0 <= radius <= 3:
        raise ValueError("two halves searched with radius one find pairs of at most three bits")
    n = distinct.count()
    sample = max(sample, POINTS * n // shard_size(n))
    # Drawn by hash below a bound, so that no task sends more than its share of the sample.
    some = distinct.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 32)) < (1 << 32) * sample // n) if n > sample else distinct
    drawn = np.sort(np.array([r[0] for r in some.select("fp").collect()], np.int64)).view(np.uint64)
    drawn = np.random.default_rng(SEED).permutation(drawn)
    leaf = shard_size(n) * len(drawn) / max(n, 1)
    trees = [build_tree(drawn, s, leaf, radius) for s in _HALVES]
    shards = distinct.select("fp").mapInArrow(_routed(trees, radius), "shard int, fp long")
    return shards.groupBy("shard").applyInPandas(_shard_forest(radius), "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of edges (u, v): root is the smallest node of the component. Alternating large and small stars.

    A round is written by as many tasks as its edges need, not by one for each shuffle
    partition: few edges in hundreds of files cost each executor a writer and processes a file.
    """
    now = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = state
        tasks = max(now.sparkSession.sparkContext.defaultParallelism, state[0] // EDGES)
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = staged(small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct().coalesce(tasks), "edges")


def _classes(fps: DataFrame, radius: int) -> DataFrame:
    """(fp, component_id) of each distinct fingerprint of fps (id, fp)."""
    points = staged(fps.groupBy("fp").agg(F.min("id").alias("first")), "simhash-points")
    roots = staged(components(links(points, radius)), "simhash-roots")
    own = points.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = own.groupBy("root").agg(F.min("first").alias("component_id"))
    return own.join(smallest, "root").select("fp", "component_id")


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of df: id, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest id reachable by links.

    A text of fewer words than a shingle is one shingle; null, empty and blank texts have
    fingerprint zero, which links like any other. Rows that repeat an id share its
    component; null ids never name one unless all are null. An empty table gives an empty
    result. Other columns are not carried.
    """
    fps = staged(fingerprints(df, id_col, text_col, shingle), "simhash-fps")
    out = fps.join(_classes(fps, radius), "fp")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """df with one row of each component: the smallest id, of rows that repeat it the one whose text hashes lowest, of whole repeats any one.

    Nulls as in simhash_components(). The decision is made on (id, fingerprint) alone; texts
    move once, in the join with the ids that go, and once more only where ids and texts repeat.
    """
    keyed = df.select(text_of(df, text_col).alias("text"), df[id_col].alias("own"))
    ids = staged(fingerprints(keyed.select(F.struct("own", F.xxhash64("text").alias("h")).alias("id"), "text"), "id", "text", shingle), "simhash-fps")
    winners = _classes(ids, radius).select(F.col("component_id").alias("id")).distinct()
    counted = ids.groupBy("id").agg(F.count("*").alias("n"))
    marked = counted.join(winners.withColumn("wins", F.lit(True)), counted["id"].eqNullSafe(winners["id"]), "left").where("wins IS NULL OR n > 1")
    marked = staged(marked.select(counted["id"]["own"].alias("own"), counted["id"]["h"].alias("h"), F.col("wins").isNotNull().alias("wins")), "simhash-goes")
    rows = payload(df, own=df[id_col], h=F.xxhash64(text_of(df, text_col)))
    same = lambda other: rows["own"].eqNullSafe(other["own"]) & (rows["h"] == other["h"])
    kept = unpack(rows.join(marked, same(marked), "left_anti"), df.columns, [])
    repeats = marked.where("wins")
    if repeats.isEmpty():
        return kept
    once = rows.join(repeats, same(repeats), "left_semi").groupBy("own", "h").agg(F.first("row").alias("row"))
    return kept.unionByName(unpack(once, df.columns, []))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
