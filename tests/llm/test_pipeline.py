"""The pipeline's stages against brute force, each on its predecessor's output."""

from collections import Counter, defaultdict

import pytest

from paperloom.llm import exactdedup, packing, queries, shared, toxicity

corpus_pipeline = pytest.importorskip("corpus_pipeline")

DATA = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage's input and output as ``{doc_id: row}``."""
    docs, found = spark.read.parquet(f"{DATA}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, DATA)
        assert out.schema == docs.schema, name
        rows = out.collect()
        found[name] = before, {r.doc_id: r for r in rows}
        assert len(rows) == len(found[name][1]) < len(before) or name == "suffix-array dedup", name
        docs = spark.createDataFrame(rows, docs.schema)
    found["best-fit packing"] = {r.doc_id: r for r in docs.collect()}, STAGES["best-fit packing"](spark, docs, DATA).collect()
    return found


def test_toxicity_keeps_what_scores_low(spark, stages):
    before, after = stages["toxicity"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"), "toxic", ~queries.held_out())
    score = {r.doc_id: r.score for r in toxicity.scores(docs, model).collect()}
    assert after == {i: r for i, r in before.items() if score[i] < 0.7}


def test_exact_dedup_keeps_the_first_of_equal_texts(stages):
    before, after = stages["exact dedup"]
    groups = defaultdict(list)
    for i, r in before.items():
        groups[exactdedup.normalised((r.text or "").encode())].append(i)
    assert after == {min(g): before[min(g)] for g in groups.values()}


def test_near_dedup_keeps_the_first_of_like_sets(stages):
    before, after = stages["SimHash near-dedup"]
    sets = {}
    for i, r in before.items():
        words = "".join(c.lower() if c.isascii() else c for c in r.text or "").split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    label = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and label[i] != label[j] and (sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                low, high = sorted((label[i], label[j]))
                label = {k: low if x == high else x for k, x in label.items()}
    assert set(after) == {i for i, x in label.items() if i == x} and all(after[i] == before[i] for i in after)


def test_repeats_of_200_bytes_are_cut_out(stages):
    before, after = stages["suffix-array dedup"]
    texts = {i: (r.text or "").encode() for i, r in before.items()}
    seen = Counter(t[k : k + 200] for t in texts.values() for k in range(len(t) - 199))
    for i, t in texts.items():
        keep = [True] * len(t)
        for k in range(len(t) - 199):
            if seen[t[k : k + 200]] > 1:
                keep[k : k + 200] = [False] * 200
        left = bytes(b for b, k in zip(t, keep, strict=True) if k).decode("utf-8", "ignore")
        assert (after[i].text or "") == left and (after[i].lang, after[i].source) == (before[i].lang, before[i].source), i
        assert after[i].n_chars == (before[i].n_chars if all(keep) else len(left))
    assert set(after) == set(before) and any(after[i].text != before[i].text for i in after)


def test_packing_has_every_token_once(stages):
    tokenizer = pytest.importorskip("tokenizers").Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    docs, rows = stages["best-fit packing"]
    held = defaultdict(list)
    for r in rows:
        held[r.doc_id].append(r.length)
    assert {i: sum(n) for i, n in held.items()} == {i: len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for i, r in docs.items()}
    plan = packing.sweeps(Counter(r.length for r in rows))
    assert len({r.sequence_id for r in rows}) == max(row[2] + -(-1 // row[4]) for row in plan.tolist())


CLASHES = ["filter_word", "filter_set", "cut_spans", "n", "key", "entry", "row", "order", "digest", "keep_id", "kept", "score", "spans", "a.b"]


@pytest.mark.parametrize("name", list(STAGES))
def test_every_stage_takes_odd_tables(spark, name):
    stage, base = STAGES[name], "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(1, None, None, None, None), (1, None, None, None, None), (2, "", "en", "s", 0), (3, "Sole text.", "en", "s", 10), (5, "wörd " * 60_000, "en", "s", 300_000)]
    more = ", ".join(f"`{c}` int" for c in CLASHES) + ", tags map<string,int>, nested struct<x:array<string>>"
    rows = [(*r, *range(len(CLASHES)), {"k": r[0]}, (["y"],)) for r in odd]
    docs = spark.createDataFrame(rows, f"{base}, {more}").repartition(2)
    assert stage(spark, docs.limit(0), DATA).count() == 0
    found = stage(spark, docs, DATA).collect()
    assert {r.doc_id for r in found} >= {1, 3, 5}
    if name != "best-fit packing":
        for r in found:
            assert [r[c] for c in CLASHES] == list(range(len(CLASHES))) and r.tags == {"k": r.doc_id} and r.nested.x == ["y"]


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(300)], [(0, i) for i in range(1, 30_000)], [(i, (i * 7919) % 997) for i in range(1000)]])
def test_components_of_chains_and_hubs(spark, tmp_path, edges):
    table = spark.createDataFrame(edges, "a long, b long") if edges else spark.createDataFrame([], "a long, b long")
    label = {x: x for e in edges if e[0] != e[1] for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a != b and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    found = shared.components(table, f"file://{tmp_path}", "c").collect()
    assert {r.node: r.component for r in found} == label and len(found) == len(label)
