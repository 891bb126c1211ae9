"""Quality rules by repetition coverage.

A batch of texts is one byte array. Prefix sums of two rolling hashes give every word and
line its hash: one modulo 2**64, one modulo a prime, since some different strings (of the
Thue-Morse kind) agree modulo any power of two. They are worked out block by block and kept at
the edges of words and lines alone, so that a long text takes memory by its words. Sums over
neighbouring word hashes, rolled with another base, give every n-gram its own. Texts never
mix, since the text's number enters the hash. Sorting brings equal n-grams together; the
characters of words that lie inside any of them are the coverage. An n-gram is repeated only
where its first SHORTEST words are, so all longer lengths look only there. Hashes are mixed to 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .common import table, text_of

SHORTEST = 5
#: Greatest share of word characters inside repeated n-grams, in percent, by n.
COVERAGE = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
#: Greatest share of repeated lines, and of word characters in them, in percent.
DUP_LINES, DUP_LINE_CHARS = 30, 20
#: Most symbols for 100 words.
SYMBOLS = 10
MIN_WORDS, BASE_N, BASE_PERCENT = 20, 8, 30
FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "dup_line_chars", *[f"dup_chars_{n}" for n in COVERAGE]]
_BASE, _WORD_BASE = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1
_PRIME, _PRIME_BASE = (1 << 31) - 1, 1_234_567_891
_TABLE = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)
_PRIME_TABLE = np.random.default_rng(6).integers(1, _PRIME, 256, dtype=np.uint64)
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
#: Texts are taken together up to so many bytes; a longer text is a batch of its own.
BATCH_BYTES = 2_000_000
BLOCK = 1 << 20


@lru_cache(maxsize=64)
def _powers(base: int, modulus: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64 or a prime below 2**32."""
    out, k = np.ones(n, np.uint64), 1
    while k < n:
        out[k : 2 * k] = out[: min(k, n - k)] * np.uint64(pow(base, k, modulus))
        if modulus < 1 << 32:
            out[k : 2 * k] %= np.uint64(modulus)
        k *= 2
    return out


def _at(base: int, modulus: int, exponent: np.ndarray, most: int) -> np.ndarray:
    """base**exponent by a table for the places in a block and one for the blocks."""
    low = _powers(base, modulus, BLOCK)[exponent % BLOCK]
    if most < BLOCK:
        return low
    high = _powers(pow(base, BLOCK, modulus), modulus, 1 << (most // BLOCK).bit_length())[exponent // BLOCK]
    return low * high if modulus > 1 << 32 else low * high % np.uint64(modulus)


def _prefixes(buf: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At ascending marks, of all bytes before: both rolling hashes and the number of code points."""
    h, q, points = np.zeros(len(marks), np.uint64), np.zeros(len(marks), np.uint32), np.zeros(len(marks), np.int32)
    sums = [0, 0, 0]
    for b in range(0, len(buf), BLOCK):
        own = buf[b : b + BLOCK]
        lo, hi = np.searchsorted(marks, [b, b + len(own)], "right")
        at = marks[lo:hi] - b - 1
        x = np.cumsum(_TABLE[own] * _powers(_BASE, 1 << 64, BLOCK)[: len(own)]) * np.uint64(pow(_BASE, b, 1 << 64)) + np.uint64(sums[0])
        h[lo:hi], sums[0] = x[at], int(x[-1])
        x = np.cumsum(_PRIME_TABLE[own] * _powers(_PRIME_BASE, _PRIME, BLOCK)[: len(own)] % np.uint64(_PRIME))
        x = (x % np.uint64(_PRIME) * np.uint64(pow(_PRIME_BASE, b, _PRIME)) + np.uint64(sums[1])) % np.uint64(_PRIME)
        q[lo:hi], sums[1] = x[at], int(x[-1])
        x = np.cumsum((own & 0xC0) != 0x80) + sums[2]
        points[lo:hi], sums[2] = x[at], int(x[-1])
    return h, q, points


def _hashed(buf: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each stretch between a mark and the next (marks in pairs) its hash and its code points."""
    h, q, points = _prefixes(buf, marks)
    start, size = marks[::2], marks[1::2] - marks[::2]
    h = (h[1::2] - h[::2]) * _at(pow(_BASE, -1, 1 << 64), 1 << 64, start, len(buf))
    p = np.uint64(_PRIME)
    q = (q[1::2] + p - q[::2]) % p * _at(pow(_PRIME_BASE, -1, _PRIME), _PRIME, start, len(buf)) % p
    return _mixed(_mixed(h + size.astype(np.uint64)) + q), points[1::2] - points[::2]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.argsort(keys)
    s = keys[order]
    same = s[1:] == s[:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _later(keys: np.ndarray) -> np.ndarray:
    """Which keys equal an earlier one."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    out = np.zeros(len(keys), bool)
    out[order[1:][s[1:] == s[:-1]]] = True
    return out


def _sums(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Sum of integer values by group number."""
    return np.bincount(group, weights=values, minlength=n).astype(np.int64)


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    """FIELDS of UTF-8 texts."""
    n = len(texts)
    buf = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    size = np.array([len(t) + 1 for t in texts], np.int64)
    text_end = np.cumsum(size)
    space = _SPACE[buf]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    doc = np.searchsorted(text_end, start, "right")
    salt = _mixed(np.arange(1, n + 1, dtype=np.uint64))
    words, chars = _hashed(buf, edge)
    out = {"n_words": np.bincount(doc, minlength=n), "word_chars": _sums(chars, doc, n)}
    out["n_symbols"] = np.bincount(np.searchsorted(text_end, np.flatnonzero(_SYMBOL[buf]), "right"), minlength=n)

    # Lines: each ends at a line feed, the last of a text at the one that was added to it.
    line_end = np.flatnonzero(buf == 10)
    line_start = np.concatenate([[0], line_end[:-1] + 1]) if len(line_end) else line_end
    line_doc = np.searchsorted(text_end, line_start, "right")
    in_line = np.searchsorted(line_end, start)
    line_words, line_chars = np.bincount(in_line, minlength=len(line_end)), _sums(chars, in_line, len(line_end))
    real = line_words > 0
    keys = _hashed(buf, np.stack([line_start, line_end], axis=1).ravel())[0] ^ salt[line_doc]
    again = _later(keys[real])
    d = line_doc[real]
    out["n_dup_lines"] = np.bincount(d[again], minlength=n)
    out["dup_line_chars"] = _sums(line_chars[real][again], d[again], n)
    n_lines = np.bincount(d, minlength=n)

    # n-grams: where the shortest are repeated, longer ones may be.
    at = np.arange(max(0, len(words) - SHORTEST + 1))
    for k in COVERAGE:
        at = at[at + k <= len(words)]
        at = at[doc[at] == doc[at + k - 1]]
        keys = salt[doc[at]].copy()
        for j, p in enumerate(_powers(_WORD_BASE, 1 << 64, k)):
            keys += words[at + j] * p
        twice = at[_repeated(_mixed(keys))]
        if k == SHORTEST:
            at = twice
        step = np.bincount(twice, minlength=len(words) + 1).astype(np.int64)
        step -= np.bincount(twice + k, minlength=len(words) + 1).astype(np.int64)[: len(step)] if len(twice) else 0
        inside = np.cumsum(step)[: len(words)] > 0
        out[f"dup_chars_{k}"] = _sums(chars[inside], doc[inside], n)
        if k == BASE_N:
            out["n_repeat_words"] = np.bincount(doc[inside], minlength=n)
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > BASE_PERCENT * out["n_words"])
    bad = out["base_failed"] | (100 * out["n_symbols"] > SYMBOLS * out["n_words"])
    bad |= (100 * out["n_dup_lines"] > DUP_LINES * n_lines) | (100 * out["dup_line_chars"] > DUP_LINE_CHARS * out["word_chars"])
    for k, percent in COVERAGE.items():
        bad |= 100 * out[f"dup_chars_{k}"] > percent * out["word_chars"]
    out["kept"] = ~bad
    return out


def batches_of(texts: list[bytes]) -> Iterator[list[bytes]]:
    own, size = [], 0
    for t in texts:
        if own and size + len(t) > BATCH_BYTES:
            yield own
            own, size = [], 0
        own.append(t)
        size += len(t) + 1
    if own:
        yield own


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        start = 0
        for texts in batches_of(batch.column(1).cast(pa.binary()).to_pylist()):
            found = measure(texts)
            cols = [pa.array(found[f], pa.bool_() if f in ("base_failed", "kept") else pa.int64()) for f in FIELDS]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), *cols], [batch.schema.names[0], *FIELDS])
            start += len(texts)


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of df its id and FIELDS; ``kept`` is the verdict.

    A null or empty text has no words and fails. Rows that repeat an id are measured
    each. An empty table gives an empty result. Other columns are not carried: see
    quality_filter().
    """
    ship(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(df[id_col].alias("id"), text_of(df, text_col).alias("text"))
    types = ", ".join(f"{f} {'boolean' if f in ('base_failed', 'kept') else 'long'}" for f in FIELDS)
    return rows.mapInArrow(_run, f"id {kind}, {types}").withColumnRenamed("id", id_col)


def quality_filter(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of df whose text is kept, with df's columns; one pass over df, no shuffle."""
    ship(df.sparkSession)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(at).cast(pa.binary()).to_pylist()]
            kept = [k for own in batches_of(texts) for k in measure(own)["kept"].tolist()]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return df.mapInArrow(run, df.schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents").select("doc_id", "text"))


_GRAMS = "".join(
    f""",
g{n} AS (SELECT doc_id, i, list_aggregate(list_slice(words, i, i + {n - 1}), 'string_agg', ' ') AS g
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - {n - 2})) AS i FROM w)),
r{n} AS (SELECT DISTINCT doc_id, unnest(range(i, i + {n})) AS i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g{n}) WHERE c > 1),
c{n} AS (SELECT r{n}.doc_id, sum(length(words[i])) AS dup_chars_{n}, count(*) AS dup_words_{n} FROM r{n} JOIN w USING (doc_id) GROUP BY r{n}.doc_id)"""
    for n in COVERAGE
)
ORACLE = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM t){_GRAMS},
l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t),
l1 AS (SELECT doc_id, line, count(*) AS c, sum(length(array_to_string(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+'), ''))) AS s
       FROM l0 WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id, line),
l AS (SELECT doc_id, sum(c) AS n_lines, sum(c - 1) AS n_dup_lines, sum(s * (c - 1) / c) AS dup_line_chars FROM l1 GROUP BY doc_id),
b AS (SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
             coalesce(dup_words_{BASE_N}, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
             coalesce(round(dup_line_chars), 0)::BIGINT AS dup_line_chars, {", ".join(f"coalesce(dup_chars_{n}, 0)::BIGINT AS dup_chars_{n}" for n in COVERAGE)}
      FROM w LEFT JOIN l USING (doc_id) {" ".join(f"LEFT JOIN c{n} USING (doc_id)" for n in COVERAGE)}),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {BASE_PERCENT} * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > {SYMBOLS} * n_words OR 100 * n_dup_lines > {DUP_LINES} * n_lines
            OR 100 * dup_line_chars > {DUP_LINE_CHARS} * word_chars OR {" OR ".join(f"100 * dup_chars_{n} > {p} * word_chars" for n, p in COVERAGE.items())}) AS kept,
       dup_line_chars, {", ".join(f"dup_chars_{n}" for n in COVERAGE)}
FROM f
"""
