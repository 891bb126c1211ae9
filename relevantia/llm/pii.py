"""Personal data: candidate spans chosen by gradient-boosted trees (native plan).

Base kinds (email, ip, card, phone) are patterns with a check; their spans stay.
High-recall generators propose more spans, which may overlap: looser e-mail, phone,
social-security, account and date-of-birth forms. Boosted trees score every proposal
by its format and by the words before it; a proposal is redacted from its kind's
threshold on, which is calibrated on held-out rows to at least PRECISION. Selected
proposals are taken from the best-scored on, each that overlaps none taken before and no base span.

The trees are fitted on the driver, by a few dozen lines of Python, on a labelled table
of TRAIN_ROWS rows (the bound) that example_rows() makes up; they are then a plain SQL
expression, so that scoring is part of the scan.

Positions come from two regular-expression passes for each kind: the matches, and the
pieces between them; their lengths, summed along the text, place every match. Patterns
are written so that no run of characters is tried from each of its positions.
"""

from __future__ import annotations

import math
import random
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of

BASE = ("email", "ip", "card", "phone")
_MAIL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    # A run is tried from its start, or from the end of the last match inside it.
    "email": rf"(?:(?<!{_MAIL})|\G){_MAIL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
HINTS = {"email": "@", "ip": ".", "phone": "+"}
PROBES = {"email_spelt": r"[\[({](?:at|AT)[\])}]", "phone_local": "[0-9]{3}[\\x20.-][0-9]{4}", "ssn": "[0-9]{2}[-\\x20][0-9]{4}", "iban": "[A-Z]{2}[0-9]{2}", "birth": "[0-9][./-][0-9]{1,2}[./-][0-9]"}
PROPOSALS = {
    "email_spelt": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++\x20?[\[({](?:at|AT)[\])}]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[({](?:dot|DOT)[\])}])\x20?[A-Za-z0-9-]++)++",
    "phone_local": r"(?<![0-9A-Za-z+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}[-\x20][0-9]{2}[-\x20][0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "birth": r"(?<![0-9A-Za-z./-])(?:[0-9]{4}[./-][0-9]{1,2}[./-][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4})(?![0-9A-Za-z/-])",
}
KINDS = (*BASE, *PROPOSALS)
#: Characters before a proposal that its features look at; those after it do not count.
CONTEXT = 32
PRECISION, TRAIN_ROWS, ROUNDS, DEPTH, RATE = 0.99, 3000, 24, 3, 0.4
_FOR = {
    "email_spelt": r"mail|contact|write|reach|@",
    "phone_local": r"phone|tel|call|cell|mobile|fax|sms|contact",
    "ssn": r"ssn|social|security|tax",
    "iban": r"iban|account|bank|konto|transfer",
    "birth": r"born|birth|dob|geburt|nacid|naiss",
}
_AGAINST = r"order|invoice|version|isbn|serial|build|part|release|item|ticket|page|published|updated|deadline|no\.|nr\.|#"
FEATURES = ("digits", "letters", "others", "distinct", "for_words", "against_words", "is_spelt", "is_phone", "is_ssn", "is_iban", "is_birth", "checks")


# The model


def example_rows(n: int = TRAIN_ROWS, seed: int = 11) -> list[tuple[str, str, str, int]]:
    """Labelled proposals (kind, match, context, label), made up: personal data in fitting and in neutral words, and look-alikes."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    words = "the of and with from was paper number value table group water result station".split()
    fit = {"email_spelt": ["mail", "contact", "write to"], "phone_local": ["phone", "call", "tel.", "mobile"], "ssn": ["SSN", "social security"], "iban": ["IBAN", "account", "bank"], "birth": ["born", "date of birth", "DOB"]}
    off = ["order", "invoice", "version", "serial", "build", "part", "ticket", "released"]
    rows = []
    for _ in range(n):
        kind = r.choice(list(PROPOSALS))
        if kind == "email_spelt":
            m, valid = f"{r.choice(words)}{d(1)} [at] {r.choice(words)} [dot] {r.choice(['com', 'org', 'de'])}", 1
        elif kind == "phone_local":
            a, valid = r.choice("23456789") + d(2), 1
            m = r.choice([f"({a}) {d(3)}-{d(4)}", f"{a}-{d(3)}-{d(4)}", f"{a}.{d(3)}.{d(4)}"])
        elif kind == "ssn":
            valid = int(r.random() < 0.8)
            m = f"{r.choice('12345678') + d(2) if valid else r.choice(['000', '666', '9' + d(2)])}-{r.randint(10, 99)}-{r.randint(1000, 9999)}"
        elif kind == "iban":
            body, valid = d(18), int(r.random() < 0.7)
            m = f"DE{(98 - int(body + '131400') % 97):02d}{body}"
            if not valid:
                m = f"DE{(int(m[2:4]) + 7) % 100:02d}{body}"
        else:
            m, valid = f"{r.randint(1930, 2024)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", 1
        p = r.random()
        own, other = r.choice(fit[kind]), r.choice(off)
        lead = own if p < 0.45 else other if p < 0.75 else r.choice(words)
        context = f"{r.choice(words)} {r.choice(words)} {lead} "
        neutral = kind in ("email_spelt", "iban", "ssn")
        label = int(bool(valid) and (p < 0.45 or (p >= 0.75 and neutral)))
        rows.append((kind, m, context, label))
    return rows


def features(kind: str, match: str, context: str) -> list[float]:
    """FEATURES of a proposal; feature_columns() is the same in Spark."""
    import re

    digits = [c for c in match if c in "0123456789"]
    letters = sum(c.isascii() and c.isalpha() for c in match)
    low = context.lower()
    checks = 1
    if kind == "iban":
        s = match.replace(" ", "")
        checks = int(int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1)
    elif kind == "ssn":
        checks = int(not re.match(r"000|666|9", match))
    return [len(digits), letters, len(match) - len(digits) - letters, len(set(digits)), int(bool(re.search(_FOR[kind], low))), int(bool(re.search(_AGAINST, low))), *[int(kind == k) for k in PROPOSALS], checks]


def _best_leaf(rows, g, h):
    total_g, total_h = sum(g[i] for i in rows), sum(h[i] for i in rows)
    return total_g / (total_h + 1.0)


def _grow(x, rows, g, h, depth):
    """A regression tree on gradients: (feature, threshold, left, right), or a leaf's value."""
    best = None
    total_g, total_h = sum(g[i] for i in rows), sum(h[i] for i in rows)
    if depth:
        for f in range(len(x[0])):
            order = sorted(rows, key=lambda i: x[i][f])
            gl = hl = 0.0
            for a, b in zip(order, order[1:]):
                gl, hl = gl + g[a], hl + h[a]
                if x[a][f] < x[b][f]:
                    gain = gl * gl / (hl + 1) + (total_g - gl) ** 2 / (total_h - hl + 1) - total_g**2 / (total_h + 1)
                    if best is None or gain > best[0] + 1e-12:
                        best = (gain, f, (x[a][f] + x[b][f]) / 2)
    if best is None or best[0] < 1e-6:
        return RATE * _best_leaf(rows, g, h)
    _, f, t = best
    return (f, t, _grow(x, [i for i in rows if x[i][f] <= t], g, h, depth - 1), _grow(x, [i for i in rows if x[i][f] > t], g, h, depth - 1))


def tree_value(tree, x: list[float]) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


@lru_cache(maxsize=1)
def model() -> tuple[list, dict[str, float]]:
    """(trees, threshold by kind): logistic boosting on two thirds of example_rows(), thresholds on the rest."""
    rows = example_rows()
    x, y = [features(k, m, c) for k, m, c, _ in rows], [label for *_, label in rows]
    cut = len(rows) * 2 // 3
    score, trees, train = [0.0] * cut, [], list(range(cut))
    for _ in range(ROUNDS):
        p = [1 / (1 + math.exp(-s)) for s in score]
        tree = _grow(x, train, [a - b for a, b in zip(y, p)], [b * (1 - b) for b in p], DEPTH)
        trees.append(tree)
        score = [s + tree_value(tree, v) for s, v in zip(score, x)]
    thresholds = {}
    for kind in PROPOSALS:
        held = sorted(((sum(tree_value(t, x[i]) for t in trees), y[i]) for i in range(cut, len(rows)) if rows[i][0] == kind), reverse=True)
        hits, best = 0, math.inf
        for n, (s, label) in enumerate(held, 1):
            hits += label
            if hits >= PRECISION * n and (n == len(held) or held[n][0] < s):
                best = s - 1e-9
        thresholds[kind] = best
    return trees, thresholds


# The plan


def _let(value: Column, body) -> Column:
    """body(value), the value being worked out once: a lambda variable, unlike a repeated expression, is bound."""
    return F.transform(F.array(value), body)[0]


def _starts(xs: Column) -> Column:
    """Sums of all before each entry."""
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(xs, begin, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))["out"]


def _running(sizes: Column) -> Column:
    """_starts() of a bound array: within blocks of 256, then over blocks, so that long arrays stay cheap."""
    block, zero = 256, F.lit(0)
    firsts = F.when(F.size(sizes) > 0, F.sequence(F.lit(1), F.size(sizes), F.lit(block))).otherwise(F.array().cast("array<int>"))

    def summed(blocks: Column) -> Column:
        bases = _starts(F.transform(blocks, lambda b: F.aggregate(b, zero, lambda a, x: a + x)))
        return F.flatten(F.zip_with(blocks, bases, lambda b, base: F.transform(_starts(b), lambda s: s + base)))

    return _let(F.transform(firsts, lambda i: F.slice(sizes, i, block)), summed)


def _matches(text: Column, kind: str, pattern: str) -> Column:
    """All matches as (start, end, kind, match), in code points."""

    def placed(x: Column) -> Column:
        steps = F.zip_with(x["found"], F.slice(x["pieces"], F.lit(1), F.size(x["found"])), lambda m, p: F.struct(m.alias("m"), F.char_length(p).alias("gap"), F.char_length(m).alias("size")))
        return _let(steps, lambda ys: _let(F.transform(ys, lambda y: y["gap"] + y["size"]), lambda sizes: F.zip_with(ys, _running(sizes), lambda y, at: F.struct((at + y["gap"]).alias("start"), (at + y["gap"] + y["size"]).alias("end"), F.lit(kind).alias("kind"), y["m"].alias("match")))))

    spans = _let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern).alias("pieces")), placed)
    none = F.array().cast("array<struct<start:int,end:int,kind:string,match:string>>")
    hint = F.contains(text, F.lit(HINTS[kind])) if kind in HINTS else text.rlike(PROBES.get(kind, "[0-9]"))
    return F.when(hint, spans).otherwise(none)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    sum_of = lambda d: F.aggregate(F.sequence(F.lit(1), F.char_length(d)), F.lit(0), lambda a, i: a + _luhn_digit(F.substr(d, i, F.lit(1)).cast("int"), i))
    return _let(F.reverse(_digits(m)), sum_of) % 10 == 0


def _luhn_digit(v: Column, i: Column) -> Column:
    return F.when(i % 2 == 1, v).when(v > 4, v * 2 - 9).otherwise(v * 2)


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.char_length(F.ltrim(p, F.lit("0"))).between(0, 3) & (F.coalesce(p.try_cast("int"), F.lit(256)) <= 255))
    if kind == "card":
        return F.when(F.char_length(_digits(m)).between(12, 19), luhn(m)).otherwise(False)
    if kind == "phone":
        return F.char_length(_digits(m)).between(9, 15)
    return F.lit(True)


def _check(kind: str):
    return lambda s: _valid(kind, s["match"])


def _is(kind: str):
    return lambda s: s["kind"] == kind


def feature_columns(kind: str, match: Column, context: Column) -> dict[str, Column]:
    digits, letters = F.char_length(_digits(match)), F.char_length(F.regexp_replace(match, "[^A-Za-z]", ""))
    distinct = F.size(F.array_distinct(F.filter(F.split(_digits(match), ""), lambda c: c != "")))
    low = F.lower(context)
    checks = F.lit(1)
    if kind == "iban":
        s = F.replace(match, F.lit(" "), F.lit(""))
        turned = F.filter(F.split(F.concat(F.substr(s, F.lit(5)), F.substr(s, F.lit(1), F.lit(4))), ""), lambda c: c != "")
        value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
        checks = (F.aggregate(turned, F.lit(0), lambda a, c: (a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97) == 1).cast("int")
    elif kind == "ssn":
        checks = (~match.rlike(r"^(?:000|666|9)")).cast("int")
    columns = [digits, letters, F.char_length(match) - digits - letters, distinct, low.rlike(_FOR[kind]).cast("int"), low.rlike(_AGAINST).cast("int"), *[F.lit(int(kind == k)) for k in PROPOSALS], checks]
    return dict(zip(FEATURES, columns))


def _complete(tree, depth: int = DEPTH) -> tuple[list, list, list]:
    """A tree as arrays (feature, threshold by inner node; value by leaf), level by level, all leaves at ``depth``."""
    level, f, t = [tree], [], []
    for _ in range(depth):
        below = []
        for node in level:
            own = node if isinstance(node, tuple) else (0, 0.0, node, node)
            f.append(own[0])
            t.append(own[1])
            below += own[2:]
        level = below
    return f, t, level


def _score(x: Column) -> Column:
    """The sum of all trees for an array of FEATURES."""
    array = lambda values: f"array({', '.join(f'{float(v)!r}D' for v in values)})"
    parts = [_complete(tree) for tree in model()[0]]
    trees = F.expr("array(" + ", ".join(f"named_struct('f', array({', '.join(map(str, f))}), 't', {array(t)}, 'v', {array(v)})" for f, t, v in parts) + ")")
    below = lambda t: lambda i: i * 2 + F.when(F.get(x, F.get(t["f"], i)) <= F.get(t["t"], i), 1).otherwise(2)

    def value(t: Column) -> Column:
        at = F.lit(0)
        for _ in range(DEPTH):
            at = _let(at, below(t))
        return F.get(t["v"], at - (2**DEPTH - 1))

    return F.aggregate(trees, F.lit(0.0), lambda a, t: a + value(t))


def proposed(text: Column, kind: str) -> Column:
    """The proposals of a kind that its threshold selects, as (start, end, kind, match, score)."""

    def judged(s: Column) -> Column:
        before = F.substr(text, F.greatest(s["start"] - CONTEXT + 1, F.lit(1)), F.least(s["start"], F.lit(CONTEXT)))
        x = F.array(*[c.cast("double") for c in feature_columns(kind, s["match"], before).values()])
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["match"].alias("match"), _let(x, _score).alias("score"))

    return F.filter(F.transform(_matches(text, kind, PROPOSALS[kind]), judged), lambda s: s["score"] >= F.lit(float(model()[1][kind])))


def _rank(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS)), kind).cast("int")


def _shown(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def with_spans(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with ``base`` and ``spans``: arrays of (start, rank, end, kind) by start, then kind as listed, in code points."""
    text = text_of(df, text_col)
    out = df.withColumns({f"{k}_found": F.filter(_matches(text, k, PATTERNS[k]), _check(k)) for k in BASE})
    out = out.withColumns({f"{k}_found": proposed(text, k) for k in PROPOSALS})
    slim = lambda xs: F.transform(xs, lambda s: F.struct(s["start"].alias("start"), _rank(s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    out = out.withColumn("base", F.array_sort(F.concat(*[slim(F.col(f"{k}_found")) for k in BASE])))
    every = F.concat(*[F.col(f"{k}_found") for k in PROPOSALS])
    out = out.withColumn("more", every)
    meets = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    # From the best-scored on, each that meets none taken before: what is dropped always meets a span that stays.
    best = F.array_sort(F.transform(F.filter("more", lambda s: ~F.exists("base", lambda b: meets(s, b))), lambda s: F.struct((-s["score"]).alias("less"), s["start"].alias("start"), _rank(s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    free = F.aggregate(best, F.filter(best, lambda s: F.lit(False)), lambda taken, s: F.when(F.exists(taken, lambda o: meets(s, o)), taken).otherwise(F.concat(taken, F.array(s))))
    out = out.withColumn("spans", F.when(F.size("more") > 0, F.array_sort(F.concat(F.col("base"), slim(free)))).otherwise(F.col("base")))
    return out.drop(*[f"{k}_found" for k in KINDS], "more")


def pii_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of df its id, ``n_email, n_ip, n_card, n_phone`` of base spans, ``n_spans`` of all, ``base_sha256`` and ``spans``, kind:start:end joined by commas.

    A null or empty text has no spans. Rows that repeat an id are scanned each. An empty
    table gives an empty result. Other columns are not carried: see redact_pii().
    """
    rows = with_spans(df.select(df[id_col].alias("id"), text_of(df, text_col).alias("text")))
    counts = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return rows.select(F.col("id").alias(id_col), *counts, F.size("spans").cast("long").alias("n_spans"), F.sha2(_shown(F.col("base")), 256).alias("base_sha256"), _shown(F.col("spans")).alias("spans"))


def redact_pii(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with every span of its text column replaced by [KIND]; of overlapping spans the first names all. Null becomes empty."""
    rows = with_spans(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), text_of(df, text_col).alias("text")))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda a, s: F.when(s["start"] >= a["at"], F.struct(s["end"].alias("at"), F.concat(a["out"], F.substr(F.col("text"), a["at"] + 1, s["start"] - a["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out"))).otherwise(F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out")))
    clean = F.aggregate("spans", start, step, lambda a: F.concat(a["out"], F.substr(F.col("text"), a["at"] + 1)))
    return rows.select(*[(clean.alias(c) if c == text_col else F.col(f"row.`{c}`")) for c in df.columns])


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
