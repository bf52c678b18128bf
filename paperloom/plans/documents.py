"""Queries over page texts: survey, layout, rendering, tables, identities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity, text
from ..operators import layout, reconcile, render, survey, tables
from .tables import read

NATIVE = "regexp_replace(replace(coalesce(text, ''), chr(0), ''), '^\\s+|\\s+$', '', 'g')"
#: Non-space characters of the native text.
INK = f"length(regexp_replace({NATIVE}, '\\s', '', 'g'))"

#: Lines, their kinds and where blocks start, as the survey's recipe cuts them.
BLOCKS = r"""
    WITH raw AS (SELECT doc_id, generate_subscripts(a, 1) AS no, unnest(a) AS r FROM (SELECT doc_id, regexp_split_to_array(text, '\r?\n') AS a FROM documents)),
    line AS (SELECT doc_id, no, regexp_replace(r, '^\s+|\s+$', '', 'g') AS line FROM raw),
    kind AS (SELECT *, CASE WHEN line = '' THEN 'b' WHEN strlen(line) <= 160 AND regexp_matches(line, '\p{L}') AND NOT regexp_matches(line, '[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]') THEN 'h'
        WHEN regexp_matches(line, '^([-*•] |[0-9]+[.)] )') THEN 'i' ELSE 't' END AS k FROM line),
    prev AS (SELECT *, lag(k) OVER w AS pk, lag(line) OVER w AS pl FROM kind WINDOW w AS (PARTITION BY doc_id ORDER BY no)),
    start AS (SELECT *, k IN ('h', 'i') OR pk IS NULL OR pk <> 't' OR regexp_matches(pl, '[.!?]$') AS s FROM prev WHERE k <> 'b'),
    piece AS (SELECT *, sum(s::INT) OVER (PARTITION BY doc_id ORDER BY no) - 1 AS ordinal, CASE WHEN s OR pl LIKE '%-' THEN line ELSE ' ' || line END AS p FROM start),
    body AS (SELECT doc_id, ordinal::INT AS ordinal, string_agg(p, '' ORDER BY no) AS text FROM piece GROUP BY doc_id, ordinal),
    block AS (SELECT doc_id, ordinal, CASE WHEN strlen(text) <= 160 AND regexp_matches(text, '\p{L}') AND NOT regexp_matches(text, '[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]') THEN 'heading'
        WHEN regexp_matches(text, '^([-*•] |[0-9]+[.)] )') THEN 'list_item' ELSE 'paragraph' END AS kind, text FROM body)"""

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return register


@query(f"""SELECT doc_id, {INK} AS native_characters, {INK} / (595.0::DOUBLE * 842.0::DOUBLE) AS characters_per_square_point,
    CASE WHEN {INK} > 0 THEN 'born_digital' ELSE 'blank' END AS content_hint, false AS high_value_candidate, {INK} < 80 AS needs_ocr,
    CASE WHEN {NATIVE} <> '' THEN sha256({NATIVE}) END AS native_text_sha256 FROM documents""")
def survey_page_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survey.page_features(read(spark, sf_dir, "documents")).drop("candidate_kinds", "script_hints")


@query(f"""SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches({NATIVE}, '[=∑∫√]') THEN 'formula' END, CASE WHEN regexp_matches({NATIVE}, '[|\\t]') THEN 'table' END], lambda x: x IS NOT NULL), ',') AS candidate_kinds,
    CASE WHEN regexp_matches({NATIVE}, '\\p{{L}}') THEN 'latin' ELSE '' END AS script_hints FROM documents""")
def survey_kinds_and_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survey.page_features(read(spark, sf_dir, "documents")).select("doc_id", "candidate_kinds", "script_hints")


#: Counts of content operators by rule: pictures, paths, text operators.
COUNTS = ("CASE WHEN doc_id % 3 = 0 THEN doc_id % 7 ELSE 0 END", "CASE WHEN doc_id % 4 = 1 THEN doc_id % 90 ELSE 0 END", "doc_id % 5")


@query(f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 6 < 2 THEN '' ELSE {NATIVE} END AS native, {COUNTS[0]} AS x, {COUNTS[1]} AS p, {COUNTS[2]} AS t FROM documents), c AS (SELECT *, length(regexp_replace(native, '\\s', '', 'g')) AS n FROM d)
    SELECT doc_id, n AS native_characters, CASE WHEN n > 0 AND x > 0 THEN 'hybrid' WHEN n > 0 THEN 'born_digital' WHEN x > 0 THEN 'scanned' WHEN p > 0 OR t > 0 THEN 'other_content' ELSE 'blank' END AS content_hint,
        x > 0 OR (n = 0 AND (p > 0 OR t > 0)) AS high_value_candidate, round(x / (595.0::DOUBLE * 842.0::DOUBLE), 12) AS xobjects_per_square_point, round(p / (595.0::DOUBLE * 842.0::DOUBLE), 12) AS paths_per_square_point,
        array_to_string(list_filter([CASE WHEN x > 0 THEN 'figure' END, CASE WHEN regexp_matches(native, '[=∑∫√]') THEN 'formula' END, CASE WHEN regexp_matches(native, '[|\\t]') THEN 'table' END, CASE WHEN p > 0 THEN 'vector_graphic' END], lambda x: x IS NOT NULL), ',') AS candidate_kinds FROM c""")
def survey_content_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with pictures and paths, a third of them without native text."""
    pages = read(spark, sf_dir, "documents").withColumn("text", F.when(F.col("doc_id") % 6 < 2, "").otherwise(F.col("text")))
    found = survey.page_features(pages, "doc_id", *[F.expr(c) for c in COUNTS])
    return found.select("doc_id", "native_characters", "content_hint", "high_value_candidate", *[F.round(f"{c}_per_square_point", 12).alias(f"{c}_per_square_point") for c in ("xobjects", "paths")], "candidate_kinds")


@query(f"""WITH f AS (SELECT doc_id, {INK} AS n FROM documents), s AS (SELECT doc_id, n, unnest([0, 1, 2, 3]) AS ordinal FROM f)
    SELECT doc_id, ordinal::INT AS ordinal, ['pdf.inspect', 'native.extract', 'layout.rulebased', 'ocr'][ordinal + 1] AS stage,
        CASE WHEN ordinal < 2 THEN 'selected' WHEN ordinal = 2 THEN CASE WHEN n > 0 THEN 'selected' ELSE 'rejected' END ELSE CASE WHEN n < 80 THEN 'unavailable' ELSE 'rejected' END END AS status,
        CASE ordinal WHEN 0 THEN 'bounded parsing is required for this PDF' WHEN 1 THEN 'recovered ' || n || ' non-whitespace characters' WHEN 2 THEN CASE WHEN n > 0 THEN 'native text will be segmented deterministically' ELSE 'no native text is available for rule-based segmentation' END
            ELSE CASE WHEN n < 80 THEN 'native evidence is below the 80 character threshold; configured OCR engine is not ready' ELSE 'native evidence meets the configured threshold' END END AS reason FROM s""")
def page_stage_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survey.stage_plan(survey.page_features(read(spark, sf_dir, "documents")))


@query(f"SELECT source, string_agg(DISTINCT CASE WHEN regexp_matches({NATIVE}, '\\p{{L}}') THEN 'latin' END, ',') AS script_hints FROM documents GROUP BY source HAVING count(*) FILTER (WHERE regexp_matches({NATIVE}, '\\p{{L}}')) > 0")
def family_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "documents")
    return survey.merged_scripts(pages.select("doc_id", "source").join(survey.page_features(pages).select("doc_id", "script_hints"), "doc_id"), ["source"])


@query("SELECT sha256(coalesce(text, '')) AS text_sha256, count(*) AS pages, min(doc_id) AS first_page FROM documents GROUP BY 1 HAVING count(*) > 1")
def text_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survey.exact_duplicates(read(spark, sf_dir, "documents"))


@query(
    r"""WITH token AS (SELECT doc_id, t, count(*) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS t FROM documents) WHERE t <> '' GROUP BY 1, 2),
    half AS (SELECT doc_id, n, ('0x' || substr(sha256(t), 1, 8))::BIGINT AS high, ('0x' || substr(sha256(t), 9, 8))::BIGINT AS low FROM token)
    SELECT doc_id, """
    + " || ".join(
        "lpad(printf('%x', "
        + " + ".join(f"CASE WHEN sum(CASE WHEN ({side} >> {bit}) & 1 = 1 THEN n ELSE -n END) >= 0 THEN {1 << bit}::BIGINT ELSE 0 END" for bit in range(32))
        + "), 8, '0')"
        for side in ("high", "low")
    )
    + " AS simhash FROM half GROUP BY doc_id UNION ALL SELECT doc_id, NULL FROM documents WHERE NOT coalesce(regexp_matches(text, '[\\p{L}\\p{N}]'), false)"
)
def text_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survey.token_simhash(read(spark, sf_dir, "documents"))


@query(f"""WITH f AS (SELECT source, CASE WHEN {INK} > 0 THEN 'born_digital' ELSE 'blank' END AS hint FROM documents),
    s AS (SELECT source, count(*) AS pages, list(DISTINCT 'content:' || hint) AS hints FROM f GROUP BY source)
    SELECT source, array_to_string(list_sort(list_concat(['page-size:595x842', 'pages:' || pages], hints)), ';') AS features FROM s""")
def family_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    return survey.family_features(documents, survey.page_features(documents))


@query(r"""WITH l AS (SELECT source, doc_id, list_filter(list_transform(regexp_split_to_array(text, '\r?\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS a FROM documents),
    e AS (SELECT source, doc_id, 'first_native_line' AS position, a[1] AS line FROM l WHERE len(a) > 0 UNION ALL SELECT source, doc_id, 'last_native_line', a[-1] FROM l WHERE len(a) > 0 AND a[-1] <> a[1])
    SELECT source, position, sha256(line) AS text_sha256, count(*) AS pages, min(doc_id) AS first_page, max(doc_id) AS last_page FROM e GROUP BY source, position, line HAVING count(*) > 1""")
def repeated_margin_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survey.repeated_margins(read(spark, sf_dir, "documents"))


@query(BLOCKS + " SELECT * FROM block")
def layout_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.text_blocks(read(spark, sf_dir, "documents"))


@query(BLOCKS + """, sized AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM block)
    SELECT doc_id, ordinal, kind, 0.0::DOUBLE AS x, round(ordinal * (842.0::DOUBLE / n), 6) AS y, 595.0::DOUBLE AS width,
        round(CASE WHEN ordinal = n - 1 THEN 842.0::DOUBLE - ordinal * (842.0::DOUBLE / n) ELSE 842.0::DOUBLE / n END, 6) AS height FROM sized""")
def layout_block_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = layout.band_geometry(layout.block_arrays(read(spark, sf_dir, "documents")))
    return bands.withColumn("y", F.round("y", 6)).withColumn("height", F.round("height", 6))


@query(BLOCKS + " SELECT kind, count(*) AS regions, count(DISTINCT doc_id) AS documents, sum(strlen(text))::BIGINT AS bytes FROM block GROUP BY kind")
def region_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = layout.text_blocks(read(spark, sf_dir, "documents"))
    # Documents are counted by their first region of a kind: no distinct count, so one exchange less.
    per = blocks.groupBy("kind", "doc_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b"))
    return per.groupBy("kind").agg(F.sum("n").alias("regions"), F.count("*").alias("documents"), F.sum("b").alias("bytes"))


@query("SELECT * FROM (SELECT conv_id, turn AS before, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS after FROM conversations) WHERE after IS NOT NULL")
def reading_order_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("ordinal"))
    return layout.reading_edges(turns, "conv_id")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT conv_id, turn AS a, (turn * 3 + conv_id) % 5 AS b FROM conversations),
    r AS (SELECT conv_id, a, b FROM e UNION SELECT r.conv_id, r.a, e.b FROM r JOIN e ON r.conv_id = e.conv_id AND r.b = e.a)
    SELECT DISTINCT conv_id FROM r WHERE a = b""")
def reading_order_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    edges = turns.select("conv_id", F.col("turn").alias("before"), ((F.col("turn") * 3 + F.col("conv_id")) % 5).alias("after"))
    return layout.cyclic_pages(edges, "conv_id")


@query(BLOCKS + r""" SELECT doc_id, sha256(regexp_replace(string_agg(CASE kind WHEN 'heading' THEN '# ' WHEN 'list_item' THEN '- ' ELSE '' END || text, e'\n\n' ORDER BY ordinal), '\s+$', '') || e'\n') AS markdown_sha256,
    strlen(regexp_replace(string_agg(CASE kind WHEN 'heading' THEN '# ' WHEN 'list_item' THEN '- ' ELSE '' END || text, e'\n\n' ORDER BY ordinal), '\s+$', '') || e'\n')::INT AS bytes FROM block GROUP BY doc_id
    UNION ALL SELECT doc_id, sha256(chr(10)), 1 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM block)""")
def render_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = render.markdown(layout.block_arrays(read(spark, sf_dir, "documents")))
    return shown.select("doc_id", F.sha2("markdown", 256).alias("markdown_sha256"), F.octet_length("markdown").alias("bytes"))


ESCAPED = "replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"


@query(BLOCKS + f""" SELECT doc_id, sha256(e'<!doctype html>\\n<html><body>\\n<section data-page="1">\\n' || string_agg(CASE kind WHEN 'heading' THEN '<h1>' WHEN 'list_item' THEN '<li>' ELSE '<p>' END || {ESCAPED}
    || CASE kind WHEN 'heading' THEN e'</h1>\\n' WHEN 'list_item' THEN e'</li>\\n' ELSE e'</p>\\n' END, '' ORDER BY ordinal) || e'</section>\\n</body></html>\\n') AS html_sha256 FROM block GROUP BY doc_id
    UNION ALL SELECT doc_id, sha256(e'<!doctype html>\\n<html><body>\\n<section data-page="1">\\n</section>\\n</body></html>\\n') FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM block)""")
def render_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.html(layout.block_arrays(read(spark, sf_dir, "documents"))).select("doc_id", F.sha2("html", 256).alias("html_sha256"))


@query(r"""WITH raw AS (SELECT doc_id, generate_subscripts(a, 1) - 1 AS line_no, unnest(a) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)),
    part AS (SELECT doc_id, line_no, line, generate_subscripts(a, 1) AS i, unnest(a) AS r, len(a) AS n, a FROM (SELECT *, string_split(line, '|') AS a FROM raw WHERE contains(line, '|'))),
    cell AS (SELECT *, coalesce(list_sum(list_transform(a[1:i - 1], lambda x: strlen(x) + 1)), 0) AS skip, regexp_replace(r, '^\s+|\s+$', '', 'g') AS text FROM part WHERE NOT (i IN (1, n) AND r = '')),
    fine AS (SELECT doc_id, line_no FROM cell GROUP BY 1, 2 HAVING count(*) BETWEEN 2 AND 256 AND bool_and(text <> ''))
    SELECT doc_id, line_no::INT AS line_no, (row_number() OVER (PARTITION BY doc_id, line_no ORDER BY i) - 1)::INT AS col, text, (skip + strlen(r) - strlen(regexp_replace(r, '^\s+', '')))::INT AS start,
        (skip + strlen(r) - strlen(regexp_replace(r, '^\s+', '')) + strlen(text))::INT AS "end" FROM cell SEMI JOIN fine USING (doc_id, line_no)""")
def pipe_table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return tables.row_cells(lines, ["doc_id", "line_no"])


@query("""SELECT r_regionkey, count(*) + 1 AS rows, 3::BIGINT AS columns FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey""")
def pipe_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables written out of nations, a region each, and found again."""
    nations = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    line = F.concat_ws(" | ", F.col("n_nationkey").cast("string"), "n_name", "r_name")
    written = nations.groupBy("r_regionkey").agg(F.concat(F.lit("key | nation | region\n"), F.array_join(F.array_sort(F.collect_list(line)), "\n")).alias("text"))
    return tables.tables(written, "r_regionkey").select("r_regionkey", "rows", "columns")


@query("""WITH s AS (SELECT p_partkey, p_brand AS name, 'The ' || p_type || ' of size ' || p_size || '.' AS description FROM part WHERE p_partkey % 4 <> 0)
    SELECT p_partkey, replace(name, '#', '-') AS name, description, (17 + strlen(name) + 1)::INT AS description_start, (17 + strlen(name) + 1 + strlen(description))::INT AS description_end FROM s WHERE strlen(description) >= 16""")
def name_description_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    name, end = F.replace("p_brand", F.lit("#"), F.lit("-")), F.when(F.col("p_partkey") % 4 == 0, "").otherwise(".")
    body = F.concat(F.lit("Name Description "), name, F.lit(" The "), "p_type", F.lit(" of size "), F.col("p_size").cast("string"), end)
    return tables.name_description(p.select("p_partkey", body.alias("text")), "p_partkey")


FRAME = lambda part: f"unhex(lpad(printf('%x', octet_length({part})), 16, '0')) || ({part})"


@query(f"""WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS body, unhex(sha256(coalesce(text, ''))) AS raw FROM documents),
    a AS (SELECT *, 'doc_' || sha256(encode('doc') || unhex('00') || {FRAME("raw")}) AS document_id FROM d)
    SELECT doc_id, document_id, 'page_' || sha256(encode('page') || unhex('00') || {FRAME("encode(document_id)")} || {FRAME("unhex('00000000')")}) AS page_id,
        'evidence_' || sha256(encode('evidence') || unhex('00') || {FRAME("raw")} || {FRAME("unhex('00000000')")} || {FRAME("unhex('0000000000000000')")} || {FRAME("body")}) AS evidence_id FROM a""")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survey.stable_ids(read(spark, sf_dir, "documents"))


@query("""SELECT n_nationkey, sha256('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}') AS cache_key FROM nation""")
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").select("n_nationkey", identity.digest_of_json(F.col("n_nationkey"), F.col("n_name"), F.col("n_regionkey")).alias("cache_key"))


@query("""WITH size AS (SELECT p_partkey, p_size || CASE p_partkey % 5 WHEN 0 THEN ' KiB' WHEN 1 THEN ' MB' WHEN 2 THEN '' WHEN 3 THEN '.5 KiB' ELSE '.5' END AS shown, p_size AS n FROM part)
    SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN n * 1024 WHEN 1 THEN n * 1000000 WHEN 2 THEN n WHEN 3 THEN n * 1024 + 512 END::DECIMAL(20, 0) AS bytes FROM size""")
def parsed_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey") % 5
    unit = F.when(p == 0, " KiB").when(p == 1, " MB").when(p == 2, "").when(p == 3, ".5 KiB").otherwise(".5")
    return read(spark, sf_dir, "part").select("p_partkey", identity.parsed_bytes(F.concat(F.col("p_size").cast("string"), unit)).alias("bytes"))


READINGS = f"""WITH p AS (SELECT doc_id, source, CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 5 < 3 THEN regexp_replace(substr({NATIVE}, 1, 60), '\\s+$', '') ELSE {NATIVE} END AS native,
        CASE WHEN doc_id % 4 = 0 THEN '' ELSE (CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE substr({NATIVE}, 1, 90) END) || CASE WHEN doc_id % 3 = 0 THEN ' more' ELSE '' END END AS ocr FROM documents),
    r AS (SELECT *, length(regexp_replace(native, '\\s', '', 'g')) >= 80 AS enough, native <> '' AND NOT contains(ocr, native) AS kept FROM p),
    v AS (SELECT *, CASE WHEN enough THEN 'native' ELSE array_to_string(list_filter([CASE WHEN kept THEN 'native' END, CASE WHEN ocr <> '' THEN 'ocr' END], lambda x: x IS NOT NULL), '+') END AS selected_stages FROM r)"""


def readings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Native texts, some missing or short, and a second reading that lacks every fourth page and adds to every third."""
    d = read(spark, sf_dir, "documents").select("doc_id", text.normalized_native_text(F.coalesce("text", F.lit(""))).alias("text"))
    i = F.col("doc_id")
    native = F.when(i % 5 == 0, "").when(i % 5 < 3, F.substring("text", 1, 60)).otherwise(F.col("text"))
    again = F.concat(F.when(i % 7 == 0, "x").otherwise(F.substring("text", 1, 90)), F.when(i % 3 == 0, " more").otherwise(""))
    return d.withColumn("text", native), d.where(i % 4 != 0).withColumn("text", again)


@query(READINGS + r""" SELECT doc_id, selected_stages, CASE WHEN enough THEN 'native_quality' WHEN native = '' AND ocr <> '' THEN 'native_absent' WHEN native <> '' THEN 'reconciled' END AS reason,
        native <> '' AND regexp_replace(ocr, '^\s+|\s+$', '', 'g') <> '' AND native <> regexp_replace(ocr, '^\s+|\s+$', '', 'g') AS disagree,
        sha256(CASE selected_stages WHEN 'native' THEN native WHEN 'ocr' THEN ocr WHEN 'native+ocr' THEN native || chr(10) || ocr END) AS text_sha256 FROM v""".replace("\\\\", "\\"))
def reconcile_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.selected(*readings(spark, sf_dir)).withColumn("text_sha256", F.sha2("text", 256)).drop("text")


@query(READINGS + """ SELECT count(*) AS pages, count(*) FILTER (WHERE selected_stages <> '') AS nonblank, count(*) FILTER (WHERE contains(selected_stages, 'ocr')) AS ocr, count(*) FILTER (WHERE contains(selected_stages, 'native')) AS native,
    count(*) FILTER (WHERE selected_stages <> '' AND NOT (selected_stages = 'ocr' AND trim(ocr) = '')) AS searchable, count(*) FILTER (WHERE native <> '' AND trim(ocr) <> '' AND native <> regexp_replace(ocr, '^\\s+|\\s+$', '', 'g')) AS disagreeing FROM v""")
def baseline_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.summary(reconcile.selected(*readings(spark, sf_dir))).drop("bytes_per_page")


@query(READINGS + """, p2 AS (SELECT source AS document, lpad(doc_id::VARCHAR, 9, '0') AS page_id, unnest([{'c': 'text_extract', 'ok': native <> ''}, {'c': 'ocr_page', 'ok': ocr <> ''}, {'c': 'layout_detect', 'ok': native || ocr <> ''}, {'c': 'reading_order_detect', 'ok': native || ocr <> ''}]) AS s, native || ocr = '' AS blank FROM v)
    SELECT document, s.c AS capability, CASE WHEN s.ok OR blank THEN 'complete' ELSE 'candidate' END AS status, string_agg(page_id, ',' ORDER BY page_id) AS page_ids FROM p2 GROUP BY 1, 2, 3
    UNION ALL SELECT DISTINCT source, 'document_open', 'complete', '' FROM documents""")
def baseline_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as documents, documents as their pages."""
    native, again = readings(spark, sf_dir)
    rows = native.join(again.withColumnRenamed("text", "ocr"), "doc_id", "left").join(read(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    has = {"has_native": F.col("text") != "", "has_ocr": F.coalesce(F.col("ocr") != "", F.lit(False))}
    pages = rows.select(F.col("source").alias("document"), F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("page_id"), *[c.alias(n) for n, c in has.items()])
    return reconcile.coverage(pages.withColumn("has_region", F.col("has_native") | F.col("has_ocr")).withColumn("blank", ~F.col("has_region")))
