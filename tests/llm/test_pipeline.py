"""The pipeline against a version that works row by row."""

import hashlib
from collections import Counter

import corpus_pipeline
from relevantia.llm import bpe, common, mixing, quality
from test_brute import slow_components, slow_fingerprint, LOWER


def test_pipeline_equals_a_slow_version(spark, small):
    rows = common.table(spark, small, "documents").collect()
    rows = [r for r in rows if quality.measure([(r["text"] or "").encode()])["kept"][0]]
    last = {}
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        last[r["text"].translate(LOWER)] = r
    rows = list(last.values())
    root = slow_components({r["doc_id"]: slow_fingerprint(r["text"]) for r in rows})
    rows = [r for r in rows if root[r["doc_id"]] == r["doc_id"]]
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix_report(spark.createDataFrame(rows)).collect()}
    own = bpe.loaded(bpe.word_file())
    want = Counter()
    for r in rows:
        ids = own.encode(r["text"])
        want[r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()] += taken[r["doc_id"]]
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, small).collect())
    assert got == +want


def test_stages_keep_the_columns(spark, small):
    docs = common.table(spark, small, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, small).columns == docs.columns
