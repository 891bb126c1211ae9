"""Queries without SQL against straightforward versions over the same tables."""

import hashlib
import random
import re
import string
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash

import docs
from relevantia.llm import bpe, chat, common, pii, quality, queries, secrets, simhash, token_store

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def texts(spark, small):
    return {r["doc_id"]: r["text"] or "" for r in common.table(spark, small, "documents").select("doc_id", "text").collect()}


def by_id(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(prints):
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 3:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in prints}


def test_simhash(spark, small, texts):
    got = by_id(queries()["op3_simhash"](spark, small))
    prints = {i: slow_fingerprint(t) for i, t in texts.items()}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r["component_id"] for i, r in got.items()} == slow_components(prints)


def test_links_of_a_dense_and_a_spread_set(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    flips = [np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False))) for _ in range(900)]
    fps = np.unique(np.concatenate([base, base[rng.integers(0, 300, 900)] ^ np.array(flips, np.uint64), np.arange(600, dtype=np.uint64)]))
    want = slow_components({int(f): int(f) for f in fps})
    # A small sample and radius-one halves: the trees must part nothing that is linked.
    edges = simhash.links(spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long"), sample=200)
    root = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    groups, own = {}, {}
    for f in fps:
        s = int(np.uint64(f).view(np.int64))
        groups.setdefault(want[int(f)], set()).add(s)
        own.setdefault(root.get(s, s), set()).add(s)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, own.values()))


def test_shards_stay_bounded(monkeypatch):
    """Shards grow in number with the fingerprints, also where all share a half; no linked pair is parted."""
    monkeypatch.setattr(simhash, "SHARD", 64)
    monkeypatch.setattr(simhash, "LARGE_SHARD", 64)
    assert [simhash.shard_size(n) for n in (10, 10**6, 10**9)] == [64, 64, 64]
    rng = np.random.default_rng(2)
    spread = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    shared = np.uint64(0xABCD1234) << np.uint64(32) | rng.integers(0, 1 << 32, 4000, dtype=np.uint64)
    for points in (spread, np.unique(shared)):
        near = np.unique(np.concatenate([points, points[:500] ^ np.uint64(0b101), points[500:900] ^ np.uint64(1 << 63 | 3)]))
        sides = [simhash.route(simhash.build_tree(near, s, 64), near, s) for s in (0, 32)]
        together = set()
        for at, leaf in sides:
            for x in np.unique(leaf):
                own = at[leaf == x]
                assert len(own) < len(near) / 4
                r, c = np.nonzero(np.bitwise_count(near[own][:, None] ^ near[own][None]) <= 3)
                together |= set(zip(own[r].tolist(), own[c].tolist()))
        r, c = np.nonzero(np.bitwise_count(near[:, None] ^ near[None]) <= 3)
        assert together == set(zip(r.tolist(), c.tolist()))


def test_rounds_of_few_edges_write_few_files(spark, monkeypatch):
    """However many shuffle partitions there are; the components stay those of all edges."""
    written = []

    def counted(df, name):
        written.append(common.staged(df, name))
        return written[-1]

    monkeypatch.setattr(simhash, "staged", counted)
    rng = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 3000, (2500, 2))] + [(0, i) for i in range(5000, 6000)] + [(i, i + 1) for i in range(7000, 7050)]
    held = {"spark.sql.shuffle.partitions": "61", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    root = {i: i for p in pairs for i in p}
    for _ in root:
        new = dict(root)
        for a, b in pairs:
            new[a] = new[b] = min(new[a], new[b])
        if new == root:
            break
        root = new
    assert got == {i: r for i, r in root.items() if any(i in p and p[0] != p[1] for p in pairs)}
    assert len(written) > 3 and all(len(df.inputFiles()) <= spark.sparkContext.defaultParallelism for df in written[1:])


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.word_file())
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_equals_the_library(spark, small, texts):
    t = library()
    for i, r in by_id(queries()["op10_bpe"](spark, small)).items():
        ids = t.encode(texts[i], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def by_both(own, texts):
    """The ids of each text by the trie and by the library's words."""
    out = []
    for path in (False, True):
        cut, (ids,) = own.table(bpe.packed, library=path).take(texts)
        out.append([np.frombuffer(b"".join(map(ids.__getitem__, c)), "<i4").tolist() for c in cut])
    return zip(*out)


def test_words_with_odd_characters():
    own, t = bpe.loaded(bpe.word_file()), library()
    cases = ["", "it's we'll 'sx !'s", "ÅÅ éé İI ǅ", "日本語 テスト 123", "<|endoftext|>a<|startoftext|>", "x" * 5000, "   ​", "👩‍👩‍👧 ok", "a\u0000b", "\u0130\u0331", "<|ENDOFTEXT|>", "ſK"]
    for text, (trie, words) in zip(cases, by_both(own, cases)):
        want = t.encode(text, add_special_tokens=False).ids
        assert trie == words == want == own.encode(text), text
        assert own.decode(want) == t.decode(want, skip_special_tokens=False)


def test_many_random_texts_by_both_encoders():
    """20,000 texts of letters, marks that compose, digits, signs, spaces and special strings: no id differs from the library's."""
    own, t, r = bpe.loaded(bpe.word_file()), library(), random.Random(20)
    some = [*map(chr, range(32, 127)), *"\t\n\x0b\x85\xa0\u2028\u3000", *map(chr, range(0xA1, 0x250)), *map(chr, range(0x300, 0x340)), *map(chr, range(0x391, 0x3D0)), *"İıſKÅΩßẞǅǆﬁ", *"日本語テ한글한", *"👩‍🔬️", "<|endoftext|>", "<|startoftext|>", "the ", "tion", "'s", "'LL"]
    texts = ["".join(r.choices(some if k % 2 else some[:140], k=r.randint(0, 30))) for k in range(20_000)]
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    for text, ids, (trie, words) in zip(texts, want, by_both(own, texts)):
        assert trie == ids and words == ids, ascii(text)


def test_words_kept_do_not_change_results(texts, monkeypatch):
    own = bpe.WordBpe(bpe.word_file())
    some = list(texts.values())[:60]
    want = [own.encode(t) for t in some]
    monkeypatch.setattr(bpe, "KEPT_WINDOWS", 100)
    monkeypatch.setattr(bpe, "KEPT_PAIRS", 100)
    fresh = bpe.WordBpe(bpe.word_file()).table(list, keep=50)
    got = []
    for k in range(0, 60, 7):
        cut, (ids,) = fresh.take(some[k : k + 7])
        got += [[i for piece in c for i in ids[piece]] for c in cut]
    assert got == want


def test_ids_as_rows_and_back(spark, texts):
    """encode() and decode(): ids of every row, the library's decoded text, null and unknown ids."""
    t = library()
    rows = bpe.encode(spark.createDataFrame([*texts.items(), (None, None), (7, "İ\u0331")], "doc_id long, text string"))
    out = bpe.decode(rows).collect()
    assert len(out) == len(texts) + 2
    known = {**texts, None: ""}
    for r in out:
        text = known[r["doc_id"]]
        if t.encode(text, add_special_tokens=False).ids != r["ids"]:
            text = "İ\u0331"
        assert r["ids"] == t.encode(text, add_special_tokens=False).ids and r["decoded"] == t.decode(r["ids"], skip_special_tokens=False)
    odd = bpe.decode(spark.createDataFrame([(None,), ([],), ([10**6, 320],)], "ids array<int>")).collect()
    assert [r["decoded"] for r in odd] == [None, "", t.decode([320], skip_special_tokens=False)]


def test_lists_of_ids_cut_plain_texts_all_at_once(monkeypatch):
    """Texts in a row give each text's own pieces and the library's ids, at any size of the table; only texts that are not plain are cut one by one."""
    own, t, r = bpe.WordBpe(bpe.word_file()), library(), random.Random(4)
    plain = [*bpe._CHARS, *"''stmdrevlSTMDREVL    \n<>"]
    odd = [*plain, *"İſŉ\u0301日😀\x00\x1c\x85\xa0\u200bΣςÅﬁ•→\xadß", "<|endoftext|>", "<|"]
    texts = ["", "it's we'll 'sx !'s ''s 'S'", "'", "s", "", "12½³ x'REason l'l", "’s — €5 „a“", "a\u0301", "x" * 5000, "é<|endoftext|>'d", ""]
    texts += ["".join(r.choices(odd if k % 3 == 2 else plain, k=r.choice([0, 1, 2, 3, 5, 40]))) for k in range(3000)]
    want, each, one, called = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)], list(map(own.pieces, texts)), own.pieces, []
    monkeypatch.setattr(own, "pieces", lambda text: called.append(text) or one(text))
    batch = pa.record_batch([pa.array([None, *texts])], ["text"]).slice(1)
    for size in (1, 300, 1 << 20):
        at = 0
        for start, some in bpe.slices(batch, "text", size):
            words, first = own.all_pieces(some)
            assert start == at and [words[a:b].to_pylist() for a, b in zip(first[:-1].tolist(), first[1:].tolist())] == each[at : at + len(some)]
            at += len(some)
        assert at == len(texts)
    assert called and not [x for x in called if bpe._PLAIN.fullmatch(x) and "<|" not in x]
    for way in ({"library": True}, {"library": True, "keep": 40}, {"library": False}, {"library": False, "keep": 40}):
        got = [ids for _, some in bpe.slices(batch, "text", 300) for ids in bpe.id_lists(own, some, 2, **way).to_pylist()]
        assert got == [[*ids, 2] for ids in want], way
    monkeypatch.setattr(bpe, "KEPT_BYTES", 100)
    got = [ids for _, some in bpe.slices(batch, "text", 300) for ids in bpe.id_lists(own, some, library=True, keep=10**6).to_pylist()]
    assert got == want
    assert bpe.id_lists(own, pa.array([None, ""], pa.string()).fill_null(""), 2, library=True).to_pylist() == [[2], [2]]
    assert list(bpe.slices(batch.slice(0, 0), "text")) == []


def test_token_store(spark, small, texts):
    t, start = library(), 0
    got = by_id(queries()["op4_token_store"](spark, small))
    for i in sorted(texts):
        ids = [*t.encode(texts[i], add_special_tokens=False).ids, 2]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert got[i] == {"doc_id": i, "start": start, "n_tokens": len(ids), "ids_crc32": crc}
        start += len(ids)


def test_token_store_reads_in_part(spark, small):
    path = common.shared_path(spark, "tokens-test")
    token_store.write_tokens(common.table(spark, small, "documents"), path)
    meta = token_store.read_tokens(spark, path, ("doc_id", "n_tokens"))
    assert ",tokens:" not in meta._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1][:200]
    assert {r["doc_id"] for r in token_store.read_tokens(spark, path, ids=(10, 12)).collect()} == {10, 11, 12}
    import pyarrow.parquet as pq
    from pathlib import Path

    column = pq.ParquetFile(next(Path(path, "tokens").glob("*.parquet"))).metadata.row_group(0)
    encodings = {column.column(c).path_in_schema.split(".")[0]: column.column(c).encodings for c in range(column.num_columns)}
    assert "RLE_DICTIONARY" in encodings["tokens"] and "DELTA_BINARY_PACKED" in encodings["doc_id"]


def shown(spans):
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def base_secrets(text):
    found = [(m.start(), m.end(), "assign") for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    found += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found, key=lambda x: (x[0], secrets.KINDS.index(x[2])))


def test_secrets(spark, small, texts):
    for i, r in by_id(queries()["op8_secrets"](spark, small)).items():
        want = base_secrets(texts[i])
        assert r["base_sha256"] == hashlib.sha256(shown(want).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == x for *_, x in want) for k in ("assign", "access", "hex")]
        assert set(shown(want).split(",")) <= set(r["spans"].split(","))


def test_random_strings_are_secrets_and_known_forms_are_not():
    count = secrets._counter(secrets.rank_file())
    found = lambda s: bool(secrets.random_spans(s, count))
    assert found("key q8Zr4TnX0vKp2LmW7yBd9HsJ end")
    for known in ("internationalization2communication", "550e8400-e29b-41d4-a716-446655440000", hashlib.sha256(b"x").hexdigest().upper(), "2024-01-02/2024-01-03-000000", "the-long-and-winding-road-24"):
        assert not found(f"see {known} there"), known


def test_secrets_behind_names_and_paths():
    """Strings of 20 random letters and digits, or letters alone, also where '=', '/' or '_' joins them to ordinary words."""
    count, r = secrets._counter(secrets.rank_file()), random.Random(3)
    for lead in ("", "connection_string=", "/services/account/notifications/", "services/account/", "database_credential_production=", "database_credential_production_"):
        for letters in (string.ascii_letters + string.digits, string.ascii_letters):
            for _ in range(50):
                s = "".join(r.choices(letters, k=20))
                text = f"see {lead}{s} there"
                assert any(a <= 4 + len(lead) and b == len(text) - 6 for a, b, _ in secrets.random_spans(text, count)), text
    for ordinary in ("internationalization", "/services/account/notifications/production", "database_credential_production_settings", "550e8400-e29b-41d4-a716-446655440000", "=" * 40):
        assert not secrets.random_spans(f"see {ordinary} there", count), ordinary


def test_random_strings_recall_and_precision(texts):
    """Planted keys of several alphabets and lengths, and ordinary long strings: at least 95 % of the first, at most 2 % of the second."""
    count, r = secrets._counter(secrets.rank_file()), random.Random(9)
    alphabets = (string.ascii_letters + string.digits, string.ascii_letters, string.ascii_lowercase + string.digits, string.ascii_letters + string.digits + "+/")
    keys = ["".join(r.choices(a, k=r.randint(20, 64))) for a in alphabets for _ in range(250)]
    caught = sum(any(a < 4 + len(k) and b > 4 for a, b, _ in secrets.random_spans(f"key {k} end", count)) for k in keys)
    words = sorted({w.lower() for t in texts.values() for w in re.findall("[A-Za-z]{4,12}", t)})
    ordinary = [r.choice("-_/").join(r.choices(words, k=r.randint(3, 6))) for _ in range(300)] + [str(r.randint(10**21, 10**22)) for _ in range(50)]
    ordinary += [hashlib.sha1(str(k).encode()).hexdigest().upper() for k in range(50)]
    flagged = sum(bool(secrets.random_spans(f"see {w} there", count)) for w in ordinary)
    assert caught >= 0.95 * len(keys) and flagged <= 0.02 * len(ordinary), (caught, flagged, len(ordinary))


def test_spans_taken_are_not_found_again():
    count, r = secrets._counter(secrets.rank_file()), random.Random(10)
    parts = ["".join(r.choices(string.ascii_letters + string.digits, k=24)) for _ in range(200)]
    text = " ".join(f"token={p}" if k % 3 == 0 else p for k, p in enumerate(parts))
    base = secrets.base_spans(text)
    every = secrets.random_spans(text, count)
    assert secrets.random_spans(text, count, base) == [s for s in every if not any(x < s[1] and s[0] < y for x, y, _ in base)]
    assert secrets.base_spans("\u017fecret = abcdefgh to\u212aen: abcdefgh") == []


def slow_repetition(text):
    """Of op2's base columns n_words, word_chars, n_dup_lines, n_repeat_words."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    many = {g for g, n in Counter(grams).items() if n > 1}
    inside = {i + k for i, g in enumerate(grams) if g in many for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return [len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(inside)]


def test_rolling_hashes(monkeypatch):
    """Against brute force, also where blocks end inside words and lines, and for lines that agree modulo any power of two."""
    morse = lambda n, a, b: "".join(b if i.bit_count() % 2 else a for i in range(n))
    r = random.Random(4)
    cases = ["", " \n", morse(2048, "a", "b") + "\n" + morse(2048, "b", "a"), "x" * 5000 + "\n" + "x" * 5000 + "\n" + "x" * 4999]
    cases += ["".join(r.choices(["é", "a ", "b ", "c\n", "𝔘", "line of words here\n", "  "], k=r.randint(1, 300))) for _ in range(60)]
    cases += [" ".join(r.choices("abc", k=400)) for _ in range(10)]
    for block in (quality.BLOCK, 64, 7):
        monkeypatch.setattr(quality, "BLOCK", block)
        found = quality.measure([c.encode() for c in cases])
        for i, c in enumerate(cases):
            assert [int(found[f][i]) for f in ("n_words", "word_chars", "n_dup_lines", "n_repeat_words")] == slow_repetition(c), c[:80]


def test_very_long_texts_take_memory_by_their_words():
    import tracemalloc

    r = random.Random(5)
    text = " ".join(["".join(r.choices("abcdefgh", k=6)) for _ in range(20_000)] * 60).encode()
    quality.measure([b"warm"])
    tracemalloc.start()
    found = quality.measure([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found["n_words"][0] == 1_200_000 == found["n_repeat_words"][0] and peak < 25 * len(text), peak / len(text)


def luhn(digits):
    total = 0
    for n, c in enumerate(reversed(digits)):
        v = int(c) * (1 + n % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_pii(text):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    found = []
    for kind, p in patterns.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                found.append((m.start(), m.end(), kind))
    return sorted(found, key=lambda x: (x[0], pii.KINDS.index(x[2])))


HARD = [
    "a@b.c.d@e.f x@y x@y.z@w.v .@-.-", "1.2.3.4.5.6.7.8 256.1.1.1 1.1.1.256 00000255.1.1.1 1..2.3.4", "4111 1111 1111 1111 and 4111-1111-1111-1112 41111111111111111111",
    "+1 (555) 010-9999 +49 30 1234567 +1 23 ++12345678901 +1234567890123456", "٠١ é@ü.de caféx@y.de 𝔘1.2.3.4", "9" * 400 + " " + "1 " * 300 + "a@" * 200,
]


def test_personal_data(spark, small, texts):
    for i, r in by_id(queries()["op9_pii"](spark, small)).items():
        want = base_pii(texts[i])
        assert r["base_sha256"] == hashlib.sha256(shown(want).encode()).hexdigest(), i
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(k == x for *_, x in want) for k in pii.BASE]
        assert set(shown(want).split(",")) <= set(r["spans"].split(","))


def test_personal_data_in_hard_texts(spark):
    df = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string")
    for r in pii.pii_spans(df).collect():
        assert r["base_sha256"] == hashlib.sha256(shown(base_pii(HARD[r["doc_id"]])).encode()).hexdigest(), HARD[r["doc_id"]]


def test_overlapping_proposals(spark):
    """A selected proposal is dropped only where a span that stays overlaps it; spelt addresses have no bounds."""
    long = "x" * 90 + " [at] " + "y" * 70 + ".a.b.c.d.e.org"
    rows = [f"write to {long} or a [at] x [dot] org", "phone 415-555-0100 SSN 123-45-6789 IBAN DE89370400440532013000", ""]
    out = [r["spans"] for r in pii.pii_spans(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert out[0].split(",")[0] == f"email_spelt:9:{9 + len(long)}" and out[0].count("email_spelt") == 2
    for spans in out:
        at = sorted(tuple(map(int, s.split(":")[1:])) for s in spans.split(",") if s)
        assert all(a[1] <= b[0] for a, b in zip(at, at[1:]))
    redacted = [r["text"] for r in pii.redact_pii(spark.createDataFrame([(0, None), (1, ""), (2, rows[0])], "doc_id long, text string")).orderBy("doc_id").collect()]
    assert redacted == ["", "", "write to [EMAIL_SPELT] or [EMAIL_SPELT]"]
    clean = secrets.redact_secrets(spark.createDataFrame([(0, None), (1, ""), (2, "token=abcdefgh x")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["text"] for r in clean] == [None, "", "[SECRET] x"]


def test_boosted_trees_on_rows_held_out(spark):
    trees, thresholds = pii.model()
    rows = pii.example_rows(1500, seed=99)
    hits = [(label, sum(pii.tree_value(t, pii.features(k, m, c)) for t in trees) >= thresholds[k]) for k, m, c, label in rows]
    picked = [label for label, said in hits if said]
    assert sum(picked) >= 0.97 * len(picked)
    assert sum(picked) >= 0.9 * sum(label for label, _ in hits)
    df = spark.createDataFrame([(0, "born 1980-02-03, order 1999-02-03, SSN 123-45-6789")], "doc_id long, text string")
    assert pii.pii_spans(df).first()["spans"].startswith("birth:5:15")
    assert pii.redact_pii(df).first()["text"].startswith("born [BIRTH], order 1999-02-03")


def test_chat_round_trip_and_reply_trees(spark):
    hard = "</s>[INST] &amp; <|im_end|>\n<|im_start|>user\n&lt;|"
    nodes = [("t", 1, None, "user", hard, 0.0), ("t", 2, 1, "assistant", "poor", 0.1), ("t", 3, 1, "assistant", "good\n" + hard, 0.9), ("t", 4, 3, "user", None, 0.9), (None, 1, 7, "assistant", "", 0.0)]
    df = spark.createDataFrame(nodes, "tree string, node long, parent long, role string, text string, score double")
    best = {r["tree"]: r for r in chat.format_paths(df).withColumn("turns", chat.parsed(__import__("pyspark.sql.functions").sql.functions.col("formatted"))).collect()}
    assert [(t["role"], t["text"]) for t in best["t"]["turns"]] == [("user", hard), ("assistant", "good\n" + hard), ("user", "")]
    assert len(best["t"]["loss_spans"]) == 1 and best[None]["n_turns"] == 1
    assert chat.format_paths(df, per_tree=None).count() == 3
    assert chat.format_paths(df.limit(0)).count() == 0


def slow_paths(nodes, per_tree):
    """(tree, rank, nodes from the root) of the best leaves, walked parent by parent."""
    of = {(t, n): (p, s) for t, n, p, s in nodes}
    parents = {(t, p) for t, _, p, _ in nodes}
    found = {}
    for t, n, _, _ in nodes:
        if (t, n) in parents:
            continue
        path, at = [], n
        while (t, at) in of and at not in path:
            path.append(at)
            at = of[t, at][0]
        if (t, at) not in of:
            found.setdefault(t, []).append(path)
    out = set()
    for t, paths in found.items():
        paths.sort(key=lambda p: (-round(sum(of[t, n][1] for n in p) / len(p), 9), -len(p), p[0]))
        out |= {(t, k + 1, tuple(reversed(p))) for k, p in enumerate(paths[:per_tree])}
    return out


def test_reply_trees_against_walks(spark):
    """Random trees, a long spine with many leaves, parents that are missing, and cycles; only chosen paths are enumerated."""
    r = random.Random(8)
    nodes = [(f"t{k % 5}", k, r.choice([None, 9999, *range(k % 5, k, 5)][-12:]) if k > 5 else None, r.randint(0, 9) / 8) for k in range(300)]
    nodes += [("spine", k, k - 1 if k else None, 0.5) for k in range(70)] + [("spine", 1000 + k, k, k % 3 / 2) for k in range(70)]
    nodes += [("cycle", 1, 2, 0.0), ("cycle", 2, 1, 0.0), ("cycle", 3, 2, 9.0), ("cycle", 4, None, 0.0), ("self", 1, 1, 1.0)]
    df = spark.createDataFrame(nodes, "tree string, node long, parent long, score double")
    for per_tree in (1, 3, None):
        rows = chat.root_to_leaf_paths(df, per_tree).collect()
        got = {}
        for x in rows:
            got.setdefault((x["tree"], x["path_rank"]), []).append((-x["up"], x["node"]))
        want = slow_paths(nodes, per_tree)
        assert {(t, k, tuple(n for _, n in sorted(p))) for (t, k), p in got.items()} == want
        assert len(rows) == sum(len(p) for *_, p in want)


def test_conversations_with_nulls_ties_and_long_texts(spark):
    long = "<|im_end|>&" * 200_000
    rows = [(None, 1, "user", "a"), (None, None, "assistant", "b"), (1, None, "user", "first"), (1, 0, None, None), (1, 0, "assistant", long), (1, 0, "assistant", long), (2, 5, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").selectExpr("*", "'x' AS tree", "7 AS node", "1.0 AS score")
    out = {r["tree"]: r for r in chat.chat_digests(chat.format_paths(chat.chains(df))).collect()}
    digest = lambda turns: hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
    assert out[None]["turns_sha256"] == digest([("assistant", "b"), ("user", "a")])
    assert out[1]["turns_sha256"] == digest([("user", "first"), ("", ""), ("assistant", long), ("assistant", long)]) and out[1]["loss_chars"] == 2 * len(long)
    assert out[2]["n_turns"] == 1 and len(out) == 3
    assert chat.chains(df.limit(0)).count() == 0


def test_fingerprint_of_odd_texts():
    for _, text, _ in docs.ODD[:8]:
        if text is not None and len(text) < 1000:
            assert simhash.fingerprint(text) == slow_fingerprint(text)
