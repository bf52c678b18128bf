"""Survey, layout, tables, rendering, identities, sources and streams on fixture texts."""

import hashlib

import pytest
from pyspark.sql import functions as F

from paperloom.functions import engines, identity, text
from paperloom.operators import layout, planner, reconcile, render, routing, state, survey, tables
from paperloom.sources import corpus, pdf
from paperloom.streaming import deltas


def pages(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_blocks(spark):
    found = layout.text_blocks(pages(spark, "A wrapped line\ncontinues to its end.\nNEXT HEADING\nFinal text.", "Intro text.\n- first item\n2) second item", "A hy-\nphen\r\n\r\nnew", "1)\nfoo", None, ""))
    shown = {}
    for r in found.orderBy("doc_id", "ordinal").collect():
        shown.setdefault(r.doc_id, []).append((r.kind, r.text))
    assert shown[0] == [("paragraph", "A wrapped line continues to its end."), ("heading", "NEXT HEADING"), ("paragraph", "Final text.")]
    assert shown[1] == [("paragraph", "Intro text."), ("list_item", "- first item"), ("list_item", "2) second item")]
    assert shown[2] == [("paragraph", "A hy-phen"), ("paragraph", "new")]
    assert 4 not in shown and 5 not in shown


def test_renders(spark):
    blocks = layout.block_arrays(pages(spark, "TOP <1>\nOne & two.\n- item"))
    assert {r.markdown for r in render.markdown(layout.block_arrays(pages(spark, None, "", " \n"))).collect()} == {"\n"}
    assert render.markdown(blocks).head().markdown == "# TOP <1>\n\nOne & two.\n\n- - item\n"
    assert '<section data-page="1">\n<h1>TOP &lt;1&gt;</h1>\n<p>One &amp; two.</p>\n<li>- item</li>\n</section>' in render.html(blocks).head().html
    assert '"kind":"heading"' in render.render(blocks, "evidence_json").head().json
    with pytest.raises(ValueError):
        render.render(blocks, "docx")
    two = spark.createDataFrame([(1, 1, "b\n"), (1, 0, "a\n")], "d int, i int, m string")
    assert render.joined_pages(two, "d", "i", "m").head().markdown == "a\n\n---\n\nb\n"


def test_cycles(spark):
    edges = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (2, 0, 1), (2, 1, 0), (3, 5, 5)], "doc_id long, before int, after int")
    assert {r.doc_id for r in layout.cyclic_pages(edges).collect()} == {2, 3}


def test_tables(spark):
    sources = pages(spark, "A | B\n1 | 2 | 3", "A | B\n1 | ", "Ω | 名\r\n1 | 值", "| a | b |\n\n| c | d |", "no table", "a | b")
    found = {r.doc_id: r for r in tables.tables(sources, "doc_id").collect()}
    assert set(found) == {2, 3} and (found[2].rows, found[2].columns) == (2, 2)
    assert [(c.text, c.start, c.end) for c in found[2].cells[0]] == [("Ω", 0, 2), ("名", 5, 8)]
    fragment = tables.name_description(pages(spark, "Name Description CTRL_A Controls the whole device.", "Name Description X short.", "Name Description Y has | a pipe in it here."), "doc_id").collect()
    assert [(r.name, r.description, r.description_start) for r in fragment] == [("CTRL_A", "Controls the whole device.", 24)]


def test_survey_features(spark):
    got = {r.doc_id: r for r in survey.page_features(pages(spark, "Ωmega and x = 1\ta", "  \n ", None, "日本 и")).collect()}
    assert got[0].candidate_kinds == "formula,table" and got[0].script_hints == "greek,latin" and got[0].native_characters == 12
    assert got[1].content_hint == got[2].content_hint == "blank" and got[3].script_hints == "cyrillic,han"
    hint = survey.content_hint(*[F.col(c) for c in "abcd"])
    rows = spark.createDataFrame([(1, 1, 0, 0), (0, 1, 0, 0), (0, 0, 1, 0), (0, 0, 0, 0)], "a int, b int, c int, d int")
    assert [r[0] for r in rows.select(hint).collect()] == ["hybrid", "scanned", "other_content", "blank"]


def test_sketch_against_its_definition(spark):
    body = "One two two, Three! drei vier 5"
    weights = [0] * 64
    for token in ["one", "two", "two", "three", "drei", "vier", "5"]:
        bits = int.from_bytes(hashlib.sha256(token.encode()).digest()[:8], "big")
        for b in range(64):
            weights[b] += 1 if bits >> b & 1 else -1
    expected = sum(1 << b for b in range(64) if weights[b] >= 0)
    assert survey.token_simhash(pages(spark, body)).head().simhash == f"{expected:016x}"
    assert [r.simhash for r in survey.token_simhash(pages(spark, None, " -- ")).collect()] == [None, None]


def test_identities(spark):
    one = spark.range(1)
    raw = hashlib.sha256(b"page\0" + (2).to_bytes(8, "big") + b"ab").hexdigest()
    assert one.select(identity.derived_id("page", F.lit("ab"))).head()[0] == f"page_{raw}"
    sizes = {"1 KiB": 1024, "1.5 KB": 1500, "0.3 B": None, "-1": None, "3": 3, "1.0000000001 GB": None}
    rows = spark.createDataFrame([(s,) for s in sizes], "s string")
    assert {r.s: r.b and int(r.b) for r in rows.select("s", identity.parsed_bytes(F.col("s")).alias("b")).collect()} == sizes
    shown = spark.createDataFrame([(0,), (1536,), (2048,), (7,)], "n long").select(identity.shown_bytes(F.col("n"))).collect()
    assert [r[0] for r in shown] == ["0 B", "1536 B", "2 KiB", "7 B"]
    paths = {"a/b": True, "/a": False, "a/../b": False, "a//b": False, "": False, "c:x": False}
    assert {r.s: r.f for r in spark.createDataFrame([(p,) for p in paths], "s string").select("s", identity.is_relative_path(F.col("s")).alias("f")).collect()} == paths
    with pytest.raises(ValueError):
        identity.derived_id("other", F.lit("x"))


def test_normalised_text_and_latex(spark):
    rows = spark.createDataFrame([("é  ﬁ x", r"\frac{a1}{b}+ 2")], "t string, l string")
    got = rows.select(text.normalized_text("t").alias("t"), text.latex_tokens("l").alias("l")).head()
    assert got.t == "é fi x" and got.l == ["\\frac", "a1", "b", "+", "2"]


def test_reconciled_view(spark):
    long = "word " * 40
    view = reconcile.selected(pages(spark, long, "abc", "", None, "abc"), pages(spark, long + "x", "abc def", "only", None, "other"))
    got = {r.doc_id: (r.selected_stages, r.reason, r.disagree, r.text) for r in view.collect()}
    assert got == {0: ("native", "native_quality", True, long.strip()), 1: ("ocr", "reconciled", True, "abc def"), 2: ("ocr", "native_absent", False, "only"), 3: ("", None, False, None), 4: ("native+ocr", "reconciled", True, "abc\nother")}
    assert reconcile.summary(view).head().pages == 5


def test_pdfs_round_trip(spark, tmp_path):
    cases = corpus.generated(spark, 4, 7)
    assert cases.exceptAll(corpus.generated(spark, 4, 7)).count() == 0
    files = corpus.as_pdfs(cases)
    for r in files.collect():
        (tmp_path / r.path).write_bytes(bytes(r.content))
    (tmp_path / "bad.pdf").write_bytes(b"not one")
    read = pdf.read(spark, str(tmp_path))
    found = {r.path.rsplit("/", 1)[1]: r for r in pdf.inspect(read).collect()}
    truth = {f"{r.case_id}.pdf": r.text for r in cases.collect()}
    assert {p: r.text for p, r in found.items() if r.status == "fine"} == truth and found["bad.pdf"].status == "invalid_input"
    assert found[next(iter(truth))].width == 595
    manifest = files.select("path", "digest", "bytes")
    local = read.withColumn("path", F.regexp_extract("path", "[^/]*$", 0))
    assert [tuple(r) for r in state.verified(local, manifest).collect()] == [("bad.pdf", "unlisted")]
    wrong = manifest.withColumn("digest", F.lit("0" * 64))
    assert state.verified(local, wrong).where("violation = 'digest_differs'").count() == 4
    with pytest.raises(Exception, match="limit_exceeded"):
        pdf.read(spark, str(tmp_path), most=5).collect()
    bad = spark.createDataFrame([("../x", "0" * 64, 1), ("a", "zz", 1)], "path string, digest string, bytes long")
    assert {r.violation for r in corpus.manifest_violations(bad).collect()} == {"path_not_relative", "digest_malformed"}
    assert corpus.noisy(b"\0" * 500, 3, 100) == corpus.noisy(b"\0" * 500, 3, 100) != b"\0" * 500


def test_engines_keep_their_contract(spark):
    registry = engines.standard()
    for engine in registry.engines.values():
        assert engines.violations(engine, pages(spark, "A | B\n1 | 2", "Some text."), "doc_id") == []
    assert [e.engine_id for e in registry.able("text")] == ["mock"]
    with pytest.raises(ValueError):
        registry.register(registry.engines["mock"])


def test_plans(spark):
    choices = spark.createDataFrame([(g, f"{g}{k}") for g in "ab" for k in range(9)], "goal string, choice string")
    with pytest.raises(ValueError, match="81"):
        planner.combinations(choices, ["a", "b"])
    few = choices.where("choice in ('a0', 'a1', 'b0')")
    assert planner.combinations(few, ["a", "b"]).count() == 2
    rows = spark.createDataFrame([("g", 1, 1, 5, 1), ("g", 2, 2, 5, 2), ("g", 3, 1, 5, 3), ("g", 4, None, 9, 4), ("g", 5, 1, 6, 5)], "grp string, id int, cost int, quality int, x int")
    assert {r.id for r in planner.frontier(rows.drop("x"), ["grp"], ["cost"], ["quality"], "id").collect()} == {4, 5}


def test_states_don_t_depend_on_order(spark, tmp_path):
    rows = [(d, s, f"e{d}{s}", f"e{d}{s}" if s % 2 else None) for d in range(3) for s in range(6)]
    log = spark.createDataFrame(rows, deltas.SCHEMA)
    whole = state.materialized(log.limit(0), log, ["doc"], "seq")
    checkpoint = state.materialized(log.limit(0), log.where("seq < 3"), ["doc"], "seq")
    assert state.from_checkpoint(checkpoint, log.where("seq >= 3"), ["doc"], "seq").exceptAll(whole).count() == 0
    ids = state.state_id(state.delta_ids(log, deltas.PARTS), ["doc"])
    assert state.state_id(state.delta_ids(log.orderBy(F.desc("seq")).union(log), deltas.PARTS), ["doc"]).exceptAll(ids).count() == 0
    source, stored = str(tmp_path / "in"), str(tmp_path / "log")
    for part in (log.where("seq % 2 = 1"), log.where("seq < 4"), log):
        part.coalesce(1).write.mode("append").parquet(source)
        deltas.follow(spark, source, stored, str(tmp_path / "checkpoint")).awaitTermination()
    assert spark.read.parquet(stored).count() == 18
    assert deltas.current(spark, stored).exceptAll(whole).count() == 0
    assert {r.due for r in deltas.batches_of(log, 6).collect()} == {True}
    assert state.conflicts(log, ["doc"]).count() == 3


def test_cache_and_goals(spark):
    store = spark.createDataFrame([("k1", "v", hashlib.sha256(b"v").hexdigest()), ("k2", "v", "bad")], "key string, value string, digest string")
    asked = spark.createDataFrame([("k1",), ("k2",), ("k3",)], "key string")
    assert {r.key: r.hit for r in state.cached(asked, store).collect()} == {"k1": True, "k2": False, "k3": False}
    calls = spark.createDataFrame([(1, "ocr", None), (1, "ocr", 2), (1, "table", 2)], "doc int, capability string, page int")
    assert state.subsumed(calls).count() == 2


def test_routes(spark):
    rows = spark.createDataFrame([(None, 5, True), (9, 5, True), (1, 5, True), (1, 5, False)], "c long, t long, f boolean")
    assert [r[0] for r in rows.select(routing.stump_route(*[F.col(x) for x in "ctf"])).collect()] == ["native", "native", "ocr", "native"]
    ledger = spark.createDataFrame([("a", 1, "complete"), ("a", 2, "failed"), ("a", 3, "pending"), ("a", 4, "pending")], "e string, n int, status string")
    assert {r.n: r.admitted for r in routing.admitted(ledger, ["e"], ["n"], 3).collect()} == {3: True, 4: False}
