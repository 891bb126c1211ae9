"""Secret scans: three fixed patterns, and the token-efficiency test.

A byte-pair vocabulary learnt from ordinary text writes ordinary strings with few
tokens and random ones with many. A candidate is a run of at least MIN_RANDOM key-like
characters; it is a secret (kind ``random``) if it has at most MAX_CHARS_PER_TOKEN
characters for each token of the vocabulary, unless it has the form of a known digest
(hexadecimal of a digest's length) or identifier (UUID, dates, numbers with a unit, paths
and words joined by dashes), or overlaps a span found already. Names and paths before a
secret are ordinary words and would hide it, so that where a run is no secret its parts
of that length are tested too: between '=', between '/', and what is left of those between
parts that are ordinary words.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .common import table, text_of

KINDS = ("assign", "access", "hex", "random")
MAX_CHARS_PER_TOKEN = 2.0
MIN_RANDOM = 20
_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_HINT = re.compile(r"(?i)passw|secret|token|api_?key", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_RANDOM},}}")
_DIGEST_LENGTHS = {32, 40, 48, 56, 64, 96, 128}
_HEX_ONLY = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)\Z")
_IDENTIFIER = re.compile(r"(?i:[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})\Z|[0-9_/=+-]+\Z")
_WORDS = re.compile(r"(?:[A-Za-z]+|[0-9]+)(?:[-_/](?:[A-Za-z]+|[0-9]+))+\Z")
#: Where a run is cut, coarsest first; the last cut is of words only, joined by dashes or not.
_CUTS = tuple(map(re.compile, ("[^=]+", "[^=/]+", "[^=/_]+", "[^=/_-]+")))


def rank_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def _counter(path: str):
    """How many tokens a string takes under a rank file."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda s: len(encode(s))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start, then kind as listed."""
    out = []
    if _HINT.search(text):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def _known(s: str) -> bool:
    return bool(_IDENTIFIER.match(s)) or (len(s) in _DIGEST_LENGTHS and bool(_HEX_ONLY.match(s)))


def _stretches(s: str, cut: re.Pattern, count) -> Iterator[tuple[int, int]]:
    """The longest stretches of parts that are neither ordinary words nor of a known form."""
    start = end = None
    for m in cut.finditer(s):
        if len(m[0]) > MAX_CHARS_PER_TOKEN * count(m[0]) or _known(m[0]):
            if start is not None:
                yield start, end
            start = None
        else:
            start, end = m.start() if start is None else start, m.end()
    if start is not None:
        yield start, end


def _random_parts(s: str, count, level: int = 0) -> Iterator[tuple[int, int]]:
    """The (start, end) of a run, or else of its parts from a cut on, that pass the token-efficiency test."""
    if len(s) < MIN_RANDOM or _known(s):
        return
    if not _WORDS.match(s) and len(s) <= MAX_CHARS_PER_TOKEN * count(s):
        yield 0, len(s)
    elif level < len(_CUTS):
        cut = _CUTS[level]
        parts = [m.span() for m in cut.finditer(s)]
        if level == 2 and not _WORDS.match(s):
            parts = _stretches(s, cut, count)
        for a, b in parts:
            for x, y in _random_parts(s[a:b], count, level + 1):
                yield a + x, a + y


def random_spans(text: str, count, taken: list[tuple[int, int, str]] = ()) -> list[tuple[int, int, str]]:
    """The spans that the token-efficiency test adds to those taken."""
    out = []
    starts, ends = [], []
    for x, y, _ in sorted(taken):
        if starts and x < ends[-1]:
            ends[-1] = max(ends[-1], y)
        else:
            starts.append(x)
            ends.append(y)
    for m in _CANDIDATE.finditer(text):
        for a, b in _random_parts(m[0], count):
            a, b = a + m.start(), b + m.start()
            # Of stretches apart from each other, only the last that begins before b can meet it.
            k = bisect_left(starts, b) - 1
            if k < 0 or ends[k] <= a:
                out.append((a, b, "random"))
    return out


def _shown(spans) -> str:
    return ",".join([f"{k}:{a}:{b}" for a, b, k in spans])


def _run(path: str):
    schema = pa.schema([*[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(path)
        for batch in batches:
            rows = []
            for t in batch.column(1):
                text = t.as_py()
                base = base_spans(text)
                added = random_spans(text, count, base)
                every = sorted(base + added, key=lambda x: (x[0], KINDS.index(x[2]))) if added else base
                kinds = [k for *_, k in every]
                rows.append((*[kinds.count(k) for k in KINDS], hashlib.sha256(_shown(base).encode()).hexdigest(), _shown(every)))
            cols = [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], [batch.schema.names[0], *schema.names])

    return run


def secret_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Per row of df its id, the number of spans of each kind, ``base_sha256`` and ``spans`` (kind:start:end, in code points).

    A null or empty text has no spans. "Either case" means A-Z and a-z: a long s or a Kelvin sign is no letter of a name. Rows that repeat an id are scanned each. An empty
    table gives an empty result. Other columns are not carried.
    """
    ship(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(df[id_col].alias("id"), text_of(df, text_col).alias("text"))
    types = ", ".join(f"n_{k} long" for k in KINDS)
    return rows.mapInArrow(_run(path or rank_file()), f"id {kind}, {types}, base_sha256 string, spans string").withColumnRenamed("id", id_col)


def redact_secrets(df: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """df with each secret in the text column replaced by [SECRET]; null stays null. Overlapping spans are one."""
    ship(df.sparkSession)
    file = path or rank_file()

    def clean(text):
        if text is None:
            return None
        base = base_spans(text)
        out, at = [], 0
        for a, b, _ in sorted(base + random_spans(text, _counter(file), base)):
            if a >= at:
                out += [text[at:a], "[SECRET]"]
            at = max(at, b)
        return "".join([*out, text[at:]])

    @F.pandas_udf("string")
    def cleaned(s):
        return s.map(clean)

    return df.withColumn(text_col, cleaned(df[text_col].cast("string")))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
