"""Nulls, empty and long texts, ties, repeated rows, clashing names and empty tables."""

from collections import Counter

from pyspark.sql import functions as F

import docs
from relevantia.llm import bpe, exact_dedup, licenses, mixing, pii, quality, secrets, simhash, token_store, common


def test_each_operator_takes_odd_and_empty_tables(spark):
    one_to_one = [mixing.mix_report, quality.quality, simhash.simhash_components, exact_dedup.exact_dedup, secrets.secret_spans, pii.pii_spans, bpe.bpe_digests]
    for operator in one_to_one:
        assert operator(docs.odd(spark)).count() == len(docs.ODD), operator
        assert operator(docs.empty(spark)).count() == 0, operator


def test_filters_keep_columns(spark):
    df = docs.odd(spark)
    for operator in (exact_dedup.drop_exact_duplicates, simhash.drop_near_duplicates, quality.quality_filter, mixing.mix, pii.redact_pii, secrets.redact_secrets):
        assert operator(df).columns == df.columns, operator
        assert operator(docs.empty(spark)).count() == 0, operator


def test_exact_dedup_keeps_one_of_each(spark):
    kept = exact_dedup.drop_exact_duplicates(docs.odd(spark)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept if r["doc_id"] is not None) == [(False, i) for i in (4, 5, 6, 7, 8, 9)]
    assert len(kept) == 7


def test_exact_dedup_in_slices(spark, small):
    """Filters too small for the table make slices, never other results; no text reaches an exchange."""
    assert exact_dedup.filter_shape(100, 16, 1 << 22) == (1, 1024) and exact_dedup.filter_shape(10**9, 16, 1 << 22) == (60, 1 << 22)
    df = common.table(spark, small, "documents")
    df = df.unionByName(df.where("doc_id % 7 = 0"))
    tiny = {"bits_per_row": 4000, "max_filter_words": 4096}
    assert exact_dedup.filter_shape(df.count(), 4000, 4096)[0] > 1
    rows = lambda d: sorted(d.collect(), key=str)
    want, got = exact_dedup.exact_dedup(df.select("doc_id", "text")), exact_dedup.exact_dedup(df.select("doc_id", "text"), **tiny)
    assert rows(want) == rows(got)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "text#" not in plan and "norm" not in plan
    once = exact_dedup.drop_exact_duplicates(df)
    assert rows(once) == rows(exact_dedup.drop_exact_duplicates(df, **tiny)) and once.columns == df.columns
    assert sorted(r["doc_id"] for r in once.collect()) == sorted(r["doc_id"] for r in want.where("kept").collect())


def test_near_dedup_keeps_one_of_each(spark):
    kept = sorted(r["doc_id"] for r in simhash.drop_near_duplicates(docs.odd(spark)).collect() if r["doc_id"] is not None)
    assert 1 in kept and 2 not in kept and 7 not in kept and 3 in kept and 4 not in kept and kept.count(9) == 1


def test_token_store_takes_odd_tables(spark):
    path = common.shared_path(spark, "odd")
    token_store.write_tokens(docs.odd(spark), path)
    rows = token_store.read_tokens(spark, path).orderBy("start").collect()
    assert len(rows) == len(docs.ODD) and rows[0]["doc_id"] is None and rows[0]["start"] == 0
    token_store.write_tokens(docs.empty(spark), path + "-none")
    assert token_store.read_tokens(spark, path + "-none").count() == 0


def test_mix_is_near_its_targets_and_agrees_with_itself(spark, small):
    df = common.table(spark, small, "documents")
    rows = mixing.mix_report(df).collect()
    assert rows == mixing.mix_report(df.repartition(7)).orderBy("doc_id").collect() or sorted(rows) == sorted(mixing.mix_report(df.repartition(7)).collect())
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    largest = max(r["size"] for r in rows)
    for target in {r["target"] for r in rows}:
        own = [r for r in rows if r["target"] == target]
        assert abs(sum(r["taken"] for r in own) - target * len({r["source_size"] for r in own})) <= largest * len(own)
    out = mixing.mix(df, n_shards=8)
    assert out.count() == sum(len(r["shards"]) for r in mixing.mix_report(df, n_shards=8).collect())
    want = Counter(s for r in mixing.mix_report(df, n_shards=8).collect() for s in r["shards"])
    got = [r["n"] for r in out.select(F.spark_partition_id().alias("p")).groupBy("p").agg(F.count("*").alias("n")).orderBy("p").collect()]
    assert got == [want[s] for s in range(8)]


def test_tree_meets_quotas_and_deals_evenly(spark):
    """Every source's quota is dealt whole, shard totals differ by rounding, and each source is spread as blind dealing would."""
    for quotas, n in (((100, 300, 624), 64), ((1, 0, 5, 4000), 7), ((3,), 1), ((2, 1), 16)):
        rows = spark.createDataFrame(list(enumerate(quotas)), "sid int, blocks int")
        got = [tuple(r) for r in mixing.split_quotas(rows, n, 7).select("shard", "sid", "n").collect()]
        assert all(sum(k for _, s, k in got if s == sid) == q for sid, q in enumerate(quotas))
        totals = [sum(k for s, _, k in got if s == shard) for shard in range(n)]
        assert max(totals) - min(totals) <= max(1, n.bit_length()) and all(k > 0 for *_, k in got)
        if n == 64:
            assert set(totals) == {16} and max(k for _, sid, k in got if sid == 0) <= 8


def test_what_the_tree_loses_is_not_taken(spark, small, monkeypatch):
    """taken comes from the shards that the tree deals: without one shard it falls short of what the whole tree gives."""
    df = common.table(spark, small, "documents")
    whole = mixing.mix_report(df).agg(F.sum("taken")).first()[0]
    deal = mixing.split_quotas
    monkeypatch.setattr(mixing, "split_quotas", lambda *a: deal(*a).where("shard <> 5"))
    assert mixing.mix_report(df).agg(F.sum("taken")).first()[0] < whole


def test_many_sources_and_texts_without_words(spark):
    """More sources than shards, joined by key; sources without words have target 0."""
    df = spark.range(1200).select(F.col("id").alias("doc_id"), (F.col("id") % 400).cast("string").alias("source"), F.when(F.col("id") % 400 > 3, F.repeat(F.lit("w "), (F.col("id") % 7 + 1).cast("int"))).alias("text"))
    rows = mixing.mix_report(df, n_shards=16).collect()
    assert len(rows) == 1200 and sum(r["taken"] for r in rows) > 0
    assert all(r["taken"] <= 3 * r["size"] and len(r["shards"]) <= 3 for r in rows) and all(r["target"] == 0 for r in rows if r["source_size"] == 0)
    assert sum(r["taken"] for r in mixing.mix_report(df.withColumn("text", F.lit(None).cast("string"))).collect()) == 0


def test_licenses_are_inherited_from_the_nearest_directory(spark):
    rows = [("a/LICENSE", "Released under the MIT License."), ("a/b/c.txt", "no"), ("a/b/COPYING", "Licensed under the Apache License, Version 2.0."), ("a/x.txt", None), ("a/y.txt", "x\nThis work is licensed under the GNU General Public License, version 3.\ny"), ("z/q.txt", "license plates"), (None, ""), ("a/x.txt", None)]
    df = spark.createDataFrame(rows, "path string, text string").selectExpr("*", "1 AS license", "2 AS own")
    out = licenses.license_scan(df)
    got = sorted((r["path"] or "", r["license"], r["license_from"]) for r in out.collect())
    assert got == [("", None, "none"), ("a/LICENSE", "MIT", "own"), ("a/b/COPYING", "Apache-2.0", "own"), ("a/b/c.txt", "Apache-2.0", "directory"), ("a/x.txt", "MIT", "directory"), ("a/x.txt", "MIT", "directory"), ("a/y.txt", "GPL-3.0", "own"), ("z/q.txt", None, "none")]
    assert licenses.license_scan(df.limit(0)).count() == 0


def test_short_names_and_families_of_licenses(spark):
    """Names without the word license are scored too, and each family has its own name."""
    want = {
        "CC BY-NC 4.0": "CC-BY-NC-4.0", "CC BY 4.0": "CC-BY-4.0", "# CC BY-SA 4.0": "CC-BY-SA-4.0",
        "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0",
        "SPDX-License-Identifier: LGPL-3.0": "LGPL-3.0", "SPDX-License-Identifier: BSD-2-Clause": "BSD-2-Clause", "// SPDX-License-Identifier: MPL-2.0": "MPL-2.0",
        "This is free and unencumbered software released into the public domain.": "Unlicense",
        "He works by day and this is 4.0 times the work of a person.": None, "Mit der Zeit": None,
    }
    rows = [(f"s/{i}.c", f"first line\n{line}\nlast line") for i, line in enumerate(want)]
    got = {r["path"]: r["license"] for r in licenses.license_scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {path: name for (path, _), name in zip(rows, want.values())}


def test_wrapped_headers_and_whole_license_texts(spark):
    """Headers in comments over several lines, and license texts on one line, are paragraphs of their own family."""
    import textwrap

    T = licenses.TEMPLATES
    wrap = lambda text, lead, width=70: "\n".join(lead + line for line in textwrap.wrap(text, width))
    cases = {
        "MIT": [wrap(T["MIT"][-1], ""), T["MIT"][-1], wrap(T["MIT"][4], " * ", 40)],
        "GPL-3.0": [wrap("This file is part of Thing. " + T["GPL-3.0"][1], "# "), T["GPL-3.0"][1]],
        "GPL-2.0": [wrap(T["GPL-2.0"][1], "// ", 50)],
        "LGPL-2.1": [wrap(T["LGPL-2.1"][1], "")],
        "Apache-2.0": [wrap(T["Apache-2.0"][4], " * ", 60), wrap(T["Apache-2.0"][2], "# ", 45), "Copyright 2020\n\n" + wrap(T["Apache-2.0"][3], "   ")],
        "BSD-3-Clause": [wrap(T["BSD-3-Clause"][-1], "")],
        "BSD-2-Clause": [wrap(T["BSD-2-Clause"][-1], "")],
        "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
        None: ["He may use the work of others in any form that is permitted to the public.", "Software is sold with support.\nThe rights of others are respected in all of our work with them."],
    }
    rows = [(f"s/{name}-{i}.c", f"int x = 1;\n\n{text}\n *\nint y;") for name, texts in cases.items() for i, text in enumerate(texts)]
    got = {r["path"]: r["license"] for r in licenses.license_scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {f"s/{name}-{i}.c": name for name, texts in cases.items() for i in range(len(texts))}


def test_licenses_are_scored_by_term_frequencies(spark):
    """Against plain TF-IDF cosines: a term weighs as often as it occurs, in templates and in texts."""
    import math
    import re
    from collections import Counter

    T = licenses.TEMPLATES
    terms = lambda text: Counter(t for t in re.split(r"[^a-z0-9]+", text.lower()) if t)
    texts = ["The MIT License (MIT)", "MIT MIT MIT MIT one two three four five six seven eight", "Released under the MIT License, alpha alpha alpha alpha alpha alpha", T["Apache-2.0"][2], T["Apache-2.0"][3], T["MIT"][4], T["BSD-2-Clause"][2]]
    known = [(name, terms(t)) for name, ts in T.items() for t in ts]
    vocabulary = set().union(*(t for _, t in known))
    own = [terms(t) for t in texts]
    collection = [t for t in own if len(t.keys() & vocabulary) >= licenses.THRESHOLD**2 * len(t)] + [t for _, t in known]
    df = Counter(t for c in collection for t in c)
    idf = lambda t: math.log((1 + len(collection)) / (1 + (df[t] if t in vocabulary else 1))) + 1
    norm = lambda c: math.sqrt(sum((n * idf(t)) ** 2 for t, n in c.items()))
    want = []
    for c in own:
        score, name = max((round(sum(n * k[t] * idf(t) ** 2 for t, n in c.items()) / norm(c) / norm(k), 9), name) for name, k in known)
        want.append((name, score) if score >= licenses.THRESHOLD else (None, None))
    assert want[1][0] == "MIT" and want[2][0] is None and len({n for n, _ in want}) == 4
    rows = licenses.license_scan(spark.createDataFrame([(f"{i}/x.c", t) for i, t in enumerate(texts)], "path string, text string")).orderBy("path").collect()
    assert [r["license"] for r in rows] == [n for n, _ in want]
    assert all(s is None or math.isclose(r["license_score"], s, abs_tol=2e-9) for r, (_, s) in zip(rows, want))


def test_licenses_of_long_texts(spark):
    rows = [("a/b/c/d.txt", "word " * 400_000 + "\nReleased under the MIT License.\n" + "x\n" * 100_000), ("LICENSE", "Licensed under CC BY 4.0."), ("a/b/x.txt", "word " * 10)]
    got = {r["path"]: (r["license"], r["license_from"]) for r in licenses.license_scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {"a/b/c/d.txt": ("MIT", "own"), "LICENSE": ("CC-BY-4.0", "own"), "a/b/x.txt": ("CC-BY-4.0", "directory")}
