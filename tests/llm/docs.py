"""Small tables that the operators' tests share."""

ODD = [
    (1, "The quick brown fox jumps over the lazy dog.\nA second line.", "a"),
    (2, "THE QUICK BROWN FOX jumps over the lazy dog.\nA second line.", "a"),
    (3, None, "b"),
    (4, "", None),
    (5, " \t\n ", "b"),
    (6, "naïve café ÀÉ Ünïcode — déjà vu 𝔘𝔫𝔦 <|endoftext|> it's 123", "c"),
    (7, "The quick brown fox jumps over the lazy dog.\nA second line.", "a"),
    (8, "word " * 30_000, "c"),
    (None, "no id at all", "b"),
    (9, "tie", "d"),
    (9, "tie", "d"),
]


def odd(spark, rows=ODD):
    """documents with nulls, empty, blank and long texts, copies and repeated rows, and columns named like results."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.withColumns({c: F.lit(c) for c in ("row", "id", "h", "size", "kept", "license", "nth")})


def empty(spark):
    return odd(spark, [])
