"""The dedup operators against brute force on small tables with nulls, ties, repeats and long texts."""

import hashlib
import random
import re
from bisect import bisect_right
from collections import Counter

import numpy as np
import pytest
import xxhash

from paperloom.llm import exactdedup, shared, simhash, substring, suffixarray

SCHEMA = "doc_id long, text string, lang string, key string, hash string, n long"


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "Delta", "éta", "iota", "nu", "pi"]) + str(rng.randrange(9)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    passage, long_passage = words(rng, 40), words(rng, 120)
    found = [None, "", " ", "one", "one", "one  two\n", "one two ", "ab" * 900, "ab" * 900, "x" * 450]
    for _ in range(30):
        found.append(words(rng, rng.randrange(1, 60)) + " " + rng.choice([passage, long_passage, ""]) + " " + words(rng, rng.randrange(1, 60)))
    copy = words(rng, 200)
    found += [copy] * 9 + [copy.replace("nu", "mu", 1), copy + " end", words(rng, 4000)]
    return found


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(7 * i % 101, t, "en", "k", "h", 1) for i, t in enumerate(texts)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def by_id(texts):
    return {7 * i % 101: t or "" for i, t in enumerate(texts)}


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, by_id):
    groups = {}
    for i, t in by_id.items():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), []).append(i)
    expected = {i: (min(g), len(g), i == min(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    found = exactdedup.duplicates(docs, capacity=4).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, bytes(r.digest).hex()) for r in found} == expected


def test_directory_splits_until_buckets_fit(spark):
    hot = 12345
    rows = [((k << 55) - (1 << 63), k) for k in range(500)] + [(hot, k) for k in range(40)] + [(hot + k % 2 + 2, k) for k in range(60)]
    buckets = exactdedup.directory(spark.createDataFrame(rows, "key long, entry long"), capacity=8)
    starts = [p << (64 - d) for p, d in buckets]
    assert sum(2.0**-d for _, d in buckets) == 1.0 and starts == sorted(starts) and starts[0] == 0
    held = Counter()
    keys = {}
    for key, _ in rows:
        b = bisect_right(starts, key % 2**64) - 1
        held[b] += 1
        keys.setdefault(b, set()).add(key)
    assert all(n <= 8 or len(keys[b]) == 1 for b, n in held.items()) and max(d for _, d in buckets) >= 62
    assert exactdedup.directory(spark.createDataFrame([], "key long, entry long")) == [(0, 0)]


def test_chains_tell_colliding_texts_apart(spark):
    rows = [(1, 10, b"a"), (1, 11, b"b"), (1, 12, b"a"), (2, 13, b"a")]
    found = exactdedup.chains(spark.createDataFrame(rows, "key long, entry long, text binary")).collect()
    assert {r.entry: r.first for r in found} == {10: 10, 11: 11, 12: 10, 13: 13}


def components_of(ids, linked):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


@pytest.mark.parametrize("hot", [2048, 2])
def test_simhash(docs, by_id, hot, monkeypatch):
    monkeypatch.setattr(simhash.links, "__defaults__", (hot,))
    prints = {}
    for i, t in by_id.items():
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), t.encode()))
        shingles = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    pairs = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    expected = components_of(prints, pairs)
    found = simhash.near_duplicates(docs, words=3, bits=3).collect()
    assert {r.doc_id: r.fp % (1 << 64) for r in found} == prints
    assert {r.doc_id: r.component_id for r in found} == expected


def test_wide_simhash_finds_what_is_alike(spark):
    rng = random.Random(2)
    base = [str(rng.randrange(10**6)) for _ in range(400)]
    near = [*base]
    near[200] = "changed"
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(reversed(base)))]
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=5, bits=82, width=8).collect()
    assert {r.doc_id: r.component_id for r in found} == {1: 1, 2: 1, 3: 3}


def naive_suffixes(symbols):
    return sorted(range(len(symbols)), key=lambda i: list(symbols[i:]))


def test_suffix_array_on_small_alphabets():
    rng = random.Random(0)
    for _ in range(1500):
        symbols = np.array([rng.randrange(rng.randint(1, 4)) for _ in range(rng.randrange(15))], np.int64)
        assert suffixarray.suffix_array(symbols).tolist() == naive_suffixes(symbols)
    for text in (b"banana" * 30, b"a" * 200, bytes(rng.randrange(256) for _ in range(500))):
        symbols = np.frombuffer(text, np.uint8).astype(np.int64)
        assert suffixarray.suffix_array(symbols).tolist() == naive_suffixes(symbols)


def repeats_of(by_id, length):
    data = {i: t.encode() for i, t in by_id.items()}
    counts = Counter(t[k : k + length] for t in data.values() for k in range(len(t) - length + 1))
    out = {}
    for i, t in data.items():
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if counts[t[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out[i] = (len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), kept)
    return out


@pytest.mark.parametrize("hot", [20_000, 1])
def test_suffix_array_dedup(docs, by_id, hot, monkeypatch):
    monkeypatch.setattr(suffixarray.repeats, "__defaults__", (200, 48, hot))
    expected = repeats_of(by_id, 200)
    found = suffixarray.trimmed(docs).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.digest).hex()) for r in found} == {i: x[:4] for i, x in expected.items()}


def test_suffix_array_dedup_leaves_and_shuffles_no_more_than_it_needs(spark, docs, tmp_path, monkeypatch):
    jvm, context = spark.sparkContext._jvm, spark.sparkContext._jsc.sc()
    shuffled, write = {}, shared.written

    def records():
        context.listenerBus().waitUntilEmpty(30_000)
        stages = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}

    def written(df, folder, name):
        before = records()
        out = write(df, folder, name)
        shuffled[name] = sum(n for stage, n in records().items() if stage not in before)
        return out

    monkeypatch.setattr(shared, "written", written)
    suffixarray.repeats(docs, f"file://{tmp_path}")
    assert {p.name for p in tmp_path.iterdir()} == {"sizes", "spans"}
    # No anchor is hot, so no surrounding has to be dealt out by window.
    assert shuffled["sorted"] > 0 and shuffled["single"] == 0


def test_suffix_array_rewrite_keeps_rows_and_columns(docs, by_id):
    expected = repeats_of(by_id, 200)
    found = suffixarray.rewritten(docs)
    assert found.columns == docs.columns
    assert {r.doc_id: r.text or "" for r in found.collect()} == {i: x[4].decode("utf-8", "ignore") for i, x in expected.items()}


@pytest.mark.parametrize("hot", [20_000, 1])
def test_substring_dedup(docs, by_id, hot, monkeypatch):
    monkeypatch.setattr(substring.repeats, "__defaults__", (hot,))
    tokens = {i: re.findall(r"[^\x20\x09-\x0D]+", t) for i, t in by_id.items()}
    first = {}
    for i in sorted(tokens):
        for k in range(len(tokens[i]) - 12):
            first.setdefault(tuple(tokens[i][k : k + 13]), i)
    expected = {}
    for i, w in tokens.items():
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        expected[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    found = substring.trimmed(docs).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, bytes(r.digest).hex()) for r in found} == expected


@pytest.mark.parametrize("operator", [exactdedup.duplicates, simhash.near_duplicates, suffixarray.trimmed, substring.trimmed])
def test_empty_tables_and_repeated_rows(spark, operator):
    assert operator(empty(spark)).count() == 0
    twice = spark.createDataFrame([(1, "some words here"), (1, "some words here"), (2, None)], "doc_id long, text string")
    assert {r.doc_id for r in operator(twice).collect()} == {1, 2}


def test_components_of_a_chain_a_hub_and_a_ring(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 202), (202, 200)]
    found = shared.components(spark.createDataFrame(edges, "a long, b long"), shared.work_folder(spark), "c")
    label = {r.node: r.component for r in found.collect()}
    assert label == components_of({x for e in edges for x in e}, edges)


def test_filters_lose_nothing(spark):
    rows, wanted = spark.range(1000).toDF("k"), spark.range(0, 1000, 7).toDF("k")
    assert {r.k for r in shared.perhaps(rows, wanted, "k", bits=12).collect()} >= set(range(0, 1000, 7))
    assert {r.k for r in shared.without(rows, wanted, "k", bits=12).collect()} == set(range(1000)) - set(range(0, 1000, 7))
