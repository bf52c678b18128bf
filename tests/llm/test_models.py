"""Classifiers, packing, revisits, vectors and pieces on small tables."""

import random
import zlib
from bisect import bisect_left, insort
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest

from paperloom.llm import packing, pieces, queries, resampling, toxicity, vectors, warc

DATA = "/root/testdata/sf0.01"


def test_toxicity_learns_words_and_scores_every_text(spark):
    rng = random.Random(3)
    calm = ["the", "garden", "was", "green", "and", "we", "sat", "there", "long"]
    rows = [(i, " ".join(rng.choices(calm, k=30)) + (" vile " if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(400)]
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in rows] + [(900, None, "s"), (901, "", "s"), (902, "Vile!", "s")], "doc_id long, text string, y string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(0, 1), (1, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    score = {r.doc_id: r.score for r in toxicity.scores(docs, model).collect()}
    assert len(score) == 403 and all(score[i] > 0.7 for i, _, y in rows if y) and all(score[i] < 0.5 for i, _, y in rows if not y)
    assert score[900] == score[901] < 0.5 < score[902]
    kept = toxicity.accepted(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, s in score.items() if s < 0.7}


def test_toxicity_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.scores(docs, model).head().score == 0.5
    assert toxicity.scores(docs.limit(0), model).count() == 0


def test_toxicity_on_held_out_rows(spark):
    import duckdb

    queries.op3_toxicity(spark, DATA).createOrReplaceTempView("scored")
    labels = dict(duckdb.connect().sql(f"SELECT doc_id, toxic FROM '{DATA}/labels.parquet'").fetchall())
    rows = [(r.score, labels[r.doc_id]) for r in spark.table("scored").where("held_out").collect() if r.doc_id in labels]
    bad, fine = [s for s, y in rows if y], [s for s, y in rows if not y]
    assert np.mean([a > b for a in bad for b in fine]) > 0.85


def test_importance_resampling_prefers_the_target(spark):
    rng = random.Random(4)
    good, junk = ["river", "stone", "bridge", "morning"], ["$$$", "win!!!", "click", "%%%"]
    rows = [(i, " ".join(rng.choices(good if i % 2 else junk, k=40))) for i in range(200)] + [(500, None), (501, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    target = spark.createDataFrame([(i,) for i in range(1, 60, 2)], "doc_id long")
    found = resampling.resampled(docs, target, 0.5).collect()
    kept = {r.doc_id for r in found if r.kept}
    assert len(kept) == 101 and {i for i in range(200) if i % 2} <= kept
    assert resampling.resampled(docs.limit(0), target, 0.5).count() == 0
    assert not any(r.kept for r in resampling.resampled(docs, target, 0.0).collect())
    twice = docs.where("doc_id = 1").union(docs.where("doc_id = 1")).union(docs.where("doc_id = 0"))
    assert sum(r.kept for r in resampling.resampled(twice, target, 1 / 3).collect()) == 1


def test_radix_selection_finds_the_kth(spark):
    values = np.random.default_rng(0).normal(size=300) * 1e3
    keys = resampling.ordered(values)
    assert (np.argsort(keys) == np.argsort(values)).all()
    rows = spark.createDataFrame([(int(k),) for k in keys], "rank_key long")
    for k in (1, 17, 300):
        assert resampling.kth_largest(rows, k)[0] == sorted(keys.tolist(), reverse=True)[k - 1]


def test_packing_fills_without_gaps(spark):
    tokenizer = pytest.importorskip("tokenizers").Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    rng = random.Random(1)
    texts = [None, "", " \n", "Héllo wörld, it's", "  x y", "<|endoftext|> b", "long " * 9000] + [" ".join(rng.choices(["sea", "Sand!", "été", "42"], k=rng.randrange(900))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = packing.packed(docs, queries.vocabulary("word_bpe_49k.json"), keep_ids=True).collect()
    expected = {}
    for i, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            expected[i, k // 4096] = (k, ids[k : k + 4096])
    assert {(r.doc_id, r.piece): (r.start, list(r.ids)) for r in found} == expected
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in found)
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in sequences.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:k]) for k in range(len(held))] and sum(n for _, n in held) <= 4096
    assert len(sequences) <= -(-sum(r.length for r in found) // 4096) + 1
    assert packing.packed(docs.limit(0), queries.vocabulary("word_bpe_49k.json")).count() == 0


def best_fit_decreasing(lengths, size):
    """One piece after another, by brute force: how many sequences."""
    gaps = []
    for length in sorted(lengths, reverse=True):
        at = bisect_left(gaps, length)
        insort(gaps, (gaps.pop(at) if at < len(gaps) else size) - length)
    return len(gaps)


@pytest.mark.parametrize("low, high, size, n", [(1, 64, 64, 200), (16, 39, 64, 2000), (1000, 2500, 4096, 5000), (1300, 1500, 4096, 5000), (1, 4096, 4096, 5000), (3, 3, 64, 100)])
def test_sweeps_are_best_fit_decreasing_and_place_every_piece_once(low, high, size, n):
    lengths = np.random.default_rng(8).integers(low, high + 1, n)
    counts = Counter(lengths.tolist())
    plan = packing.sweeps(counts, size)
    length = np.repeat(*np.array(sorted(counts.items())).T)
    rank = np.concatenate([np.arange(c) for _, c in sorted(counts.items())])
    sequence, offset = packing.placed(plan, length, rank)
    order = np.lexsort((offset, sequence))
    sequence, offset, length = sequence[order], offset[order], length[order]
    first = np.append(True, sequence[1:] != sequence[:-1])
    assert (offset[first] == 0).all() and (offset[1:] == (offset + length)[:-1])[~first[1:]].all() and (offset + length).max() <= size
    assert len(set(sequence.tolist())) == best_fit_decreasing(lengths.tolist(), size)


def record(spark, rows):
    return spark.createDataFrame(rows, "record_id long, url string, date timestamp, status int, headers map<string,string>, digest string, extra string")


def test_revisits(spark):
    t = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    full = lambda i, h, url="http://a.org/x", tag='"1"', **more: (i, url, t(h), 200, {"ETag": tag, "Content-Length": "9", "X": "old", **more}, f"d{i}", "e")
    rows = [
        full(1, 0), full(2, 30), full(3, 50, tag='"2"'), full(4, 31, url="http://b.org/?utm_source=z&q=1"),
        (10, "HTTP://A.org:80/x/#top", t(29), 304, {"etag": 'W/"1"', "content-length": "0", "x": "new"}, None, "e"),
        (11, "http://a.org/x", t(30), 304, {"ETag": '"1"'}, None, "e"),
        (12, "http://a.org/x", t(60), 304, {"ETag": '"1"'}, None, "e"),
        (13, "http://a.org/x", t(-1), 304, {"ETag": '"1"'}, None, "e"),
        (14, "http://b.org?q=1", t(90), 304, None, "d4", "e"),
        (15, None, t(90), 304, {}, None, "e"), (16, "nonsense", t(90), 304, {"A": "1", "a": "2"}, None, "e"), (17, "http://a.org/x", None, 304, {}, None, "e"),
    ]
    found = {r.record_id: r for r in warc.resolved(record(spark, rows), span_seconds=7200).collect()}
    shown = {i: (r.response_id, r.verdict) for i, r in found.items()}
    none = (None, "no_earlier_response")
    assert shown == {10: (1, "resolved"), 11: (1, "resolved"), 12: (3, "validators_differ"), 13: none, 14: (4, "resolved"), 15: none, 16: none, 17: none}
    assert found[10].headers == {"etag": 'W/"1"', "content-length": "9", "x": "new"} and found[10].digest == "d1" and found[12].headers is None
    assert warc.resolved(record(spark, [])).count() == 0


@pytest.mark.parametrize("part", [24_000 * 64, 40 * 16])
def test_vectors(spark, part):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(120, 16))
    near = base[:60] + rng.normal(size=(60, 16)) * 0.15
    rows = [[float(x) for x in v] for v in np.float32(np.concatenate([base, near, np.repeat(base[:1], 90, 0)]))]
    rows += [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1.0] * 4]
    table = spark.createDataFrame([(i, v, 0) for i, v in enumerate(rows)], "vec_id long, embedding array<float>, label int").repartition(3)
    unit = np.array(rows[:270], np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    label = np.arange(270)
    while True:
        low = np.where(linked, label[None, :], 999).min(axis=1)
        if (low == label).all():
            break
        label = low
    expected = {i: (int(linked[i].sum()) - 1, int(label[i])) for i in range(270)} | {i: (0, i) for i in range(270, len(rows))}
    found = vectors.near_duplicates(table, 0.9, part=part).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in found} == expected
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)
    assert vectors.near_duplicates(table.limit(0)).count() == 0


def test_pieces_equal_the_library(spark):
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=queries.vocabulary("piece_bpe_32k.model"))
    rng = random.Random(1)
    texts = ["", " ", "  a  b ", "▁x ▁", "héllo\tworld\n\nñ 😀 一二 ", "a" * 40, "\0 x", "á"] + ["".join(rng.choice("abcdeth in  éè\n▁9.") for _ in range(rng.randint(1, 40))) for _ in range(800)]
    machine = pieces.Transducer(queries.vocabulary("piece_bpe_32k.model"))
    assert [machine.encode(t) for t in texts] == library.encode(texts)
    assert [machine.decode(library.encode(t)) for t in texts] == [library.decode(library.encode(t)) for t in texts]
    docs = spark.createDataFrame([(1, None), (2, "two words"), (2, "two words")], "doc_id long, text string")
    encoded = pieces.encoded(docs, queries.vocabulary("piece_bpe_32k.model"))
    assert sorted((r.doc_id, list(r.ids)) for r in encoded.collect()) == [(1, []), (2, library.encode("two words")), (2, library.encode("two words"))]
    assert sorted(r.text for r in pieces.decoded(encoded, queries.vocabulary("piece_bpe_32k.model")).collect()) == ["", "two words", "two words"]
    assert pieces.round_trip(docs.limit(0), queries.vocabulary("piece_bpe_32k.model")).count() == 0


def test_pieces_of_random_unicode_and_the_odd_table(spark):
    path = queries.vocabulary("piece_bpe_32k.model")
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=path)
    rng = random.Random(2)
    texts = ["".join(chr(rng.choice([rng.randint(1, 0x2FF), rng.randint(0x400, 0x30FF), rng.randint(0x10000, 0x1FFFF)])) for _ in range(rng.randint(0, 30))) for _ in range(500)]
    texts += ["\n", " ", "▁", "a▁b", "word " * 60_000, "x" * 20_000]
    rows = [(i % 300, t, "kept") for i, t in enumerate(texts)] + [(7, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    expected = sorted((i, len(library.encode(t or "")), library.decode(library.encode(t or "")) == (t or "")) for i, t, _ in rows)
    assert sorted((r.doc_id, r.n_ids, r.restored) for r in pieces.round_trip(docs, path).collect()) == expected
    assert sorted((r.doc_id, list(r.ids)) for r in pieces.encoded(docs, path).collect()) == sorted((i, library.encode(t or "")) for i, t, _ in rows)


@pytest.mark.parametrize("squeeze", [True, False])
def test_normaliser_equals_the_library(squeeze):
    library = pytest.importorskip("sentencepiece")
    other = library.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=squeeze)
    spec = next(v for n, v in pieces.fields(other.serialized_model_proto()) if n == 3)
    ours = pieces.Normaliser(dict(pieces.fields(spec)))
    rng = random.Random(4)
    texts = ["", "ａｂｃ  Ⅳ ﬁ  é é", "  x　y "] + ["".join(chr(rng.choice([rng.randint(1, 0x2FF), rng.randint(0x2000, 0x33FF), rng.randint(0xFF00, 0xFFEF)])) for _ in range(20)) for _ in range(500)]
    assert [ours(t) for t in texts] == [other.normalize(t) for t in texts]


@pytest.mark.parametrize("name", list(queries.SQL))
def test_sql(spark, name):
    import duckdb

    connection = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "labels"):
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '/root/testdata/sf0.001/{table}.parquet'")
    frame = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    columns = ", ".join(frame.columns)
    expected = connection.sql(f"SELECT {columns} FROM ({queries.SQL[name]})").fetchall()
    assert sorted(map(str, map(tuple, frame.collect()))) == sorted(map(str, expected))


def test_resampling_against_brute_force(spark):
    """Odd columns and rows; the k kept have the k largest keys."""
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices(["sun", "rain", "wind", "$$", "buy"], k=rng.randint(0, 30))), "x", 1) for i in range(120)] + [(200, None, None, None), (201, "word " * 30_000, "y", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, bucket int").repartition(3)
    target = spark.createDataFrame([(i,) for i in range(0, 60, 3)], "doc_id long")
    found = resampling.resampled(docs, target, 0.25).collect()
    assert len(found) == len(rows)
    kept = [r for r in found if r.kept]
    assert len(kept) == round(0.25 * len(rows)) and {r.doc_id for r in found} == {r[0] for r in rows}
    # Weights by plain counting, and the k largest keys.
    def buckets(text):
        data = np.frombuffer((text or "").encode(), np.uint8)
        return resampling.grams(data, np.array([0, len(data)]), resampling.BITS)[1].tolist()

    held = {r[0]: buckets(r[1]) for r in rows}
    raw, wanted = Counter(b for x in held.values() for b in x), Counter(b for i in range(0, 60, 3) for b in held[i])
    size, total, seen = 1 << resampling.BITS, sum(raw.values()), sum(wanted.values())

    def ratio(b):
        base = (raw[b] + 1) / (total + size)
        return np.log((wanted[b] + resampling.PRIOR * base) / (seen + resampling.PRIOR)) - np.log(base)

    for r in found:
        assert r.log_weight == pytest.approx(sum(ratio(b) for b in held[r.doc_id]), rel=1e-9, abs=1e-9)
    assert {r.doc_id for r in kept} == {r.doc_id for r in sorted(found, key=lambda r: -r.gumbel_key)[: len(kept)]}


def test_ftrl_equals_its_plain_form(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(["a", "b", "c", "d", "vile"], k=rng.randint(0, 12)))) for i in range(150)]
    label = {i: int("vile" in t) for i, t in rows}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame(list(label.items()), "doc_id long, toxic int")
    alpha, beta, l1, l2, bits, epochs = 0.5, 1.0, 0.3, 1.0, 14, 3
    model = toxicity.train(docs, labels, bits=bits, epochs=epochs, batch=1, alpha=alpha, beta=beta, l1=l1, l2=l2)
    seen = {}
    for i, t in rows:
        data = np.frombuffer(t.encode(), np.uint8)
        seen[i] = sorted(set(toxicity.features(data, np.array([0, len(data)]), bits)[1].tolist()))
    z, n, bad = Counter(), Counter(), sum(label.values())
    bias, bias_n = float(np.log((bad + 1) / (len(rows) - bad + 1))), 0.0
    weight = lambda f: 0.0 if abs(z[f]) <= l1 else -(z[f] - np.sign(z[f]) * l1) / ((beta + np.sqrt(n[f])) / alpha + l2)
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)).tolist():
            error = 1 / (1 + np.exp(-(bias + sum(weight(f) for f in seen[i])))) - label[i]
            for f in seen[i]:
                w, step = weight(f), (np.sqrt(n[f] + error**2) - np.sqrt(n[f])) / alpha
                z[f] += error - step * w
                n[f] += error**2
            bias_n += error**2
            bias -= alpha / (beta + np.sqrt(bias_n)) * error
    expected = {f: weight(f) for f in z if weight(f)}
    assert dict(zip(model.index.tolist(), model.weight.tolist(), strict=True)) == pytest.approx(expected) and model.bias == pytest.approx(bias)
