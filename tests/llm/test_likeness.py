"""The pipeline's near-dedup against exact Jaccard likeness of five-word shingle sets."""

import random

import numpy as np
import pytest

from paperloom.llm import simhash

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def kept(spark, texts):
    schema = "doc_id long, text string, lang string, source string, n_chars int"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], schema).repartition(3)
    return {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}


def shingles(text):
    w = text.lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def likeness(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def pair(rng, n, changed):
    """A text and a copy with ``changed`` words replaced, far from each other; each takes five shingles along."""
    base = [str(rng.randrange(10**9)) for _ in range(n)]
    copy = [*base]
    for k in range(changed):
        copy[4 + 9 * k] = "x" + str(rng.randrange(10**9))
    return " ".join(base), " ".join(copy)


def test_pairs_link_exactly_from_likeness_0_8(spark):
    rng = random.Random(11)
    near = [pair(rng, 319, 7) for _ in range(150)]
    small = [(" ".join(w[:8]), " ".join(w)) for w in ([str(rng.randrange(10**9)) for _ in range(9)] for _ in range(100))]
    apart = [pair(rng, 319, 8) for _ in range(150)]
    assert all(0.8 <= likeness(*p) < 0.802 for p in near) and all(likeness(*p) == 0.8 for p in small) and all(0.77 < likeness(*p) < 0.8 for p in apart)
    found = kept(spark, [t for p in near + small + apart for t in p])
    linked = [2 * k + 1 not in found for k in range(len(near + small + apart))]
    assert all(2 * k in found for k in range(len(linked)))
    assert linked == [True] * len(near + small) + [False] * len(apart)


def test_frequent_lines_and_near_misses_link_nothing(spark):
    rng = random.Random(12)
    line = " ".join(str(rng.randrange(10**9)) for _ in range(19))
    rest = lambda: " ".join(str(rng.randrange(10**9)) for _ in range(304))
    texts = [" ".join([*[line] * 20, rest()]) for _ in range(40)]
    assert max(likeness(texts[0], t) for t in texts[1:]) < 0.15
    assert kept(spark, texts) == set(range(40))


@pytest.mark.parametrize("part", [1 << 20, 300])
def test_groups_compare_every_two_sets(spark, part):
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(6):
        base = rng.integers(0, 2**63, 100)
        sets += [np.unique(np.concatenate([base[int(rng.integers(0, 25)) :], rng.integers(0, 2**63, int(rng.integers(0, 20)))])).astype(np.uint64) for _ in range(12)]
    rows = [(i, i % 2, s.tobytes()) for i, s in enumerate(sets)]
    edges = simhash.alike_links(spark.createDataFrame(rows, "node long, group long, shingles binary"), 0.8, part).collect()
    expected = [(i, j) for i in range(len(sets)) for j in range(i) if i % 2 == j % 2 and len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))]
    assert partition(len(sets), [(r.a, r.b) for r in edges]) == partition(len(sets), expected)


def partition(n, edges):
    label = list(range(n))
    for a, b in edges:
        low, high = sorted((label[a], label[b]))
        label = [low if x == high else x for x in label]
    return label
