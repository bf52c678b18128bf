"""Queries of the evidence model: orders are pages, their lines regions with evidence, some of it broken by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import evidence
from .documents import BLOCKS, FRAME
from .tables import read

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return register


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evidence.indexes(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("page_id")), "doc", ["page_id"])
    k = F.col("page_id")
    return rows.select("doc", "page_id", F.when(k % 97 == 0, 0).otherwise(F.col("idx")).alias("idx"), F.when(k % 89 == 0, 99).when(k % 97 == 0, 0).otherwise(F.col("idx")).alias("bounds_idx"), F.lit(100).alias("width"), F.lit(400).alias("height"), F.when(F.col("doc") % 211 == 0, 2).otherwise(1).alias("schema_major"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in bands; ``n`` is a line's place, as line numbers repeat."""
    rows = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
    rows = rows.select("doc", F.col("l_orderkey").alias("page_id"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), "l_linenumber", "l_extendedprice")
    rows = evidence.indexes(rows, "page_id", ["l_linenumber", "part", "supp", "l_extendedprice"]).withColumnRenamed("idx", "n")
    part = F.col("part")
    rect = geometry.rect(F.lit(0), F.col("n") * 20, F.when(part % 53 == 0, 120).otherwise(100), F.lit(16))
    return rows.select("doc", "page_id", F.when(part % 101 == 0, 0).otherwise(F.col("n")).alias("region_id"), rect.alias("rect"), "n", "part", "supp")


def found_evidence(lines: DataFrame) -> DataFrame:
    part, supp = F.col("part"), F.col("supp")
    quality = F.when(part % 5 == 0, "page_only").when(part % 5 < 3, "line").otherwise("unknown")
    wide = geometry.rect(F.lit(0), F.lit(0), F.lit(100), F.lit(400))
    rect = F.when((part % 5 == 0) & (part % 4 == 0), wide).when(part % 6 != 0, F.col("rect"))
    return lines.select(
        "doc", "page_id", F.col("n").alias("region_id"), (F.col("n") * 10 + F.when(supp % 61 == 0, 0).otherwise(F.col("n") % 2)).alias("evidence_id"), F.when(supp % 47 == 0, "other").otherwise("native").alias("layer_id"),
        F.when(part % 8 == 0, "image").otherwise("text").alias("kind"), F.concat(F.lit("wörd "), part.cast("string")).alias("text"), rect.alias("rect"), quality.alias("quality"), F.when(part % 8 == 0, "image").otherwise("pdf").alias("space"), (supp % 3).alias("artifact_id"),
    )


def layers(lines: DataFrame) -> DataFrame:
    return lines.select("doc", "page_id", F.lit("native").alias("layer_id")).distinct()


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pictures of a page, one of them of unknown size on every third page."""
    p = pages(spark, sf_dir).select("doc", "page_id", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("artifact_id"))
    tall = F.when((F.col("artifact_id") == 1) & (F.col("page_id") % 3 == 0), None).otherwise(60 + F.col("artifact_id") * 40)
    return p.withColumn("pixel_width", F.lit(100)).withColumn("pixel_height", tall)


GRAPH = """
    WITH pg AS (SELECT o_custkey AS doc, o_orderkey AS page_id, CASE WHEN o_orderkey % 97 = 0 THEN 0 ELSE row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 END AS idx FROM orders),
    ln AS (SELECT o_custkey AS doc, l_orderkey AS page_id, l_partkey AS part, l_suppkey AS supp, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    ev AS (SELECT *, n * 10 + CASE WHEN supp % 61 = 0 THEN 0 ELSE n % 2 END AS evidence_id, CASE WHEN part % 53 = 0 THEN 120 ELSE 100 END AS w, (part % 5 = 0 AND part % 4 = 0) AS wide, (part % 5 = 0 AND part % 4 = 0) OR part % 6 <> 0 AS placed, part % 8 = 0 AS image FROM ln)"""


@query(GRAPH + """ SELECT DISTINCT doc, 'unsupported_schema' AS violation, doc::VARCHAR AS "at" FROM pg WHERE doc % 211 = 0
    UNION ALL SELECT doc, 'duplicate_page_index', idx::VARCHAR FROM pg GROUP BY doc, idx HAVING count(*) > 1
    UNION ALL SELECT doc, 'bounds_of_other_page', page_id::VARCHAR FROM pg WHERE page_id % 89 = 0 AND idx <> 99""")
def page_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.page_violations(pages(spark, sf_dir))


@query(GRAPH + """, r AS (SELECT *, CASE WHEN part % 101 = 0 THEN 0 ELSE n END AS region_id FROM ln) SELECT doc, 'duplicate_region' AS violation, region_id::VARCHAR AS "at" FROM r GROUP BY doc, page_id, region_id HAVING count(*) > 1
    UNION ALL SELECT doc, 'region_outside_page', region_id::VARCHAR FROM r WHERE part % 53 = 0 OR n * 20 + 16 > 400""")
def region_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.region_violations(pages(spark, sf_dir), regions(spark, sf_dir))


@query(GRAPH + """ SELECT doc, 'duplicate_evidence' AS violation, evidence_id::VARCHAR AS "at" FROM ev GROUP BY doc, page_id, evidence_id HAVING count(*) > 1
    UNION ALL SELECT doc, 'unknown_layer', evidence_id::VARCHAR FROM ev WHERE supp % 47 = 0 UNION ALL SELECT doc, 'unknown_artifact', evidence_id::VARCHAR FROM ev WHERE image AND supp % 3 = 2
    UNION ALL SELECT doc, CASE WHEN part % 5 = 0 THEN CASE WHEN placed THEN 'page_only_differs_from_bounds' ELSE 'page_only_without_bounds' END ELSE 'precise_without_geometry' END, evidence_id::VARCHAR FROM ev WHERE (part % 5 = 0 AND NOT wide) OR (part % 5 IN (1, 2) AND NOT placed)
    UNION ALL SELECT doc, 'evidence_outside_page', evidence_id::VARCHAR FROM ev WHERE NOT image AND placed AND NOT wide AND (w > 100 OR n * 20 + 16 > 400)
    UNION ALL SELECT doc, 'evidence_outside_artifacts', evidence_id::VARCHAR FROM ev WHERE image AND placed AND NOT EXISTS (SELECT 1 FROM ev o WHERE o.doc = ev.doc AND o.evidence_id = ev.evidence_id AND o.image AND o.placed AND NOT o.wide AND o.w <= 100 AND o.n * 20 + 16 <= CASE WHEN o.page_id % 3 = 0 THEN 60 ELSE 100 END)""")
def evidence_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = regions(spark, sf_dir)
    return evidence.evidence_violations(pages(spark, sf_dir), layers(lines), artifacts(spark, sf_dir), found_evidence(lines))


@query(GRAPH + """ SELECT doc, 'empty_selection' AS violation, n::VARCHAR AS "at" FROM ln WHERE part % 41 = 0 UNION ALL SELECT doc, 'selected_evidence_missing', n::VARCHAR FROM ev WHERE part % 41 <> 0 AND (part % 43 = 0 OR evidence_id <> n * 10 + n % 2)""")
def selection_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = regions(spark, sf_dir)
    own = F.col("n") * 10 + F.col("n") % 2
    named = F.when(F.col("part") % 41 == 0, F.array().cast("array<int>")).otherwise(F.array(F.when(F.col("part") % 43 == 0, own + 1000).otherwise(own)))
    return evidence.selection_violations(lines.select("doc", "page_id", F.col("n").alias("region_id"), named.alias("evidence_ids")), found_evidence(lines))


@query(GRAPH + """, e AS (SELECT doc, page_id, n AS a, CASE WHEN part % 37 = 0 THEN n ELSE n + 1 END AS b FROM ln)
    SELECT doc, 'edge_to_itself' AS violation, a::VARCHAR AS "at" FROM e WHERE a = b
    UNION ALL SELECT doc, 'edge_to_unknown_region', b::VARCHAR FROM (SELECT DISTINCT doc, page_id, b FROM e) x WHERE NOT EXISTS (SELECT 1 FROM ln WHERE ln.page_id = x.page_id AND ln.n = x.b)""")
def edge_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line and the next, which the last one hasn't."""
    lines = regions(spark, sf_dir)
    edges = lines.select("doc", "page_id", F.col("n").alias("before"), F.when(F.col("part") % 37 == 0, F.col("n")).otherwise(F.col("n") + 1).alias("after"))
    return evidence.edge_violations(lines.select("doc", "page_id", F.col("n").alias("region_id")), edges)


@query(GRAPH + """, c AS (SELECT DISTINCT ON (doc, page_id, evidence_id) * FROM ev WHERE supp % 61 <> 0 AND part % 8 <> 0 ORDER BY doc, page_id, evidence_id)
    SELECT doc, 'cell_outside_grid' AS violation, n::VARCHAR AS "at" FROM c WHERE part % 4 + 1 + (CASE WHEN part % 9 = 0 THEN 2 ELSE 1 END) > 5 OR part % 33 = 0
    UNION ALL SELECT doc, 'span_missing_or_reversed', n::VARCHAR FROM c WHERE part % 3 = 0 AND part % 31 = 0
    UNION ALL SELECT doc, 'cell_differs_from_spans', n::VARCHAR FROM c WHERE part % 3 = 0 AND part % 31 <> 0 AND (part % 29 = 0 OR part % 21 = 0) UNION ALL SELECT doc, 'cell_without_span', n::VARCHAR FROM c WHERE part % 3 <> 0""")
def cell_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cell of each line's text: its number, behind a word of six bytes and a space."""
    lines = regions(spark, sf_dir).where("supp % 61 <> 0 and part % 8 <> 0")
    part, number = F.col("part"), F.col("part").cast("string")
    cells = lines.select("doc", "page_id", F.col("n").alias("cell_id"), (F.col("n") * 10 + F.col("n") % 2).alias("evidence_id"), part, (part % 4 + 1).alias("row"), F.lit(0).alias("col"), F.when(part % 9 == 0, 2).otherwise(1).alias("row_span"), F.when(part % 33 == 0, 0).otherwise(1).alias("col_span"), F.lit(5).alias("rows"), F.lit(1).alias("columns"), F.when(part % 29 == 0, F.concat(number, F.lit("?"))).otherwise(number).alias("text"))
    end = F.octet_length(number) + 6
    halves = F.array(F.struct(F.lit(0).alias("ordinal"), F.lit(6).alias("start"), F.lit(7).alias("stop")), F.struct(F.lit(1).alias("ordinal"), F.lit(7).alias("start"), F.when(part % 31 == 0, 2).when(part % 21 == 0, end + 9).otherwise(end).alias("stop")))
    spans = cells.where(part % 3 == 0).select("doc", "page_id", "cell_id", "evidence_id", F.explode(halves).alias("s")).select("doc", "page_id", "cell_id", "evidence_id", "s.*")
    return evidence.cell_violations(cells, spans, found_evidence(regions(spark, sf_dir).where("supp % 61 <> 0")), evidence_grade=True)


@query("""WITH d AS (SELECT o_custkey AS doc, o_orderkey AS k FROM orders) SELECT doc, 'unsupported_delta_schema' AS violation, k::VARCHAR AS "at" FROM d WHERE k % 83 = 0 UNION ALL SELECT doc, 'blank_producer_or_stage', k::VARCHAR FROM d WHERE k % 71 = 0 OR k % 59 = 0
    UNION ALL SELECT doc, 'duplicate_page_addition', k::VARCHAR FROM d WHERE k % 2 = k % 3 OR k % 3 = k % 5 OR k % 2 = k % 5""")
def envelope_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), k.alias("delta_id"), F.when(k % 83 == 0, "v0").otherwise("v1").alias("delta_schema"), F.when(k % 71 == 0, " ").otherwise("p").alias("producer"), F.when(k % 59 != 0, "ocr").alias("stage"), F.array(k % 2, k % 3, k % 5).alias("page_ids"))
    return evidence.envelope_violations(rows, "v1")


@query("""WITH p AS (SELECT o_custkey AS doc, o_orderkey AS k FROM orders) SELECT doc, 'pin_of_other_state' AS violation, k::VARCHAR AS "at" FROM p WHERE k % 17 = 0
    UNION ALL SELECT doc, 'pinned_evidence_missing', k::VARCHAR FROM p WHERE k % 13 = 0 OR NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = k) UNION ALL SELECT doc, 'stale_base_state', k::VARCHAR FROM p WHERE k % 17 = 0 UNION ALL SELECT doc, 'target_missing', k::VARCHAR FROM p WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = k AND l_linenumber = 1)""")
def pin_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pins of an order on its lines, and refinements of its first line."""
    k = F.col("o_orderkey")
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), k.alias("pin_id"), k.alias("page_id"), k.cast("string").alias("region_id"), F.when(k % 17 == 0, "old").otherwise("now").alias("state_id"))
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").join(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), k.alias("l_orderkey")), "l_orderkey")
    pins = orders.withColumn("evidence_ids", F.when(F.col("pin_id") % 13 == 0, F.array(F.col("pin_id"), F.lit(-1))).otherwise(F.array("pin_id")))
    states = orders.select("doc").distinct().withColumn("state_id", F.lit("now"))
    owned = lines.select("doc", F.col("l_orderkey").alias("evidence_id"))
    targets = orders.select("doc", "state_id", "page_id", "region_id")
    first = lines.where("l_linenumber = 1").select("doc", F.col("l_orderkey").alias("page_id"), F.col("l_orderkey").cast("string").alias("region_id"))
    return evidence.pin_violations(pins, states, owned).unionByName(evidence.refinement_violations(targets, states, first))


@query(BLOCKS + f""", d AS (SELECT doc_id, unhex(sha256(coalesce(text, ''))) AS raw FROM documents), j AS (SELECT block.*, raw, unhex(lpad(printf('%x', ordinal), 16, '0')) AS place, encode(text) AS body FROM block JOIN d USING (doc_id))
    SELECT doc_id, ordinal, kind, 'region_' || sha256(encode('region') || unhex('00') || {FRAME("raw")} || {FRAME("unhex('00000000')")} || {FRAME("place")}) AS region_id,
        'evidence_' || sha256(encode('evidence') || unhex('00') || {FRAME("raw")} || {FRAME("unhex('00000000')")} || {FRAME("place")} || {FRAME("body")}) AS evidence_id, text, 'native_quality' AS reason FROM j""")
def converted_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.converted(read(spark, sf_dir, "documents"))


@query("""WITH s AS (SELECT conv_id, turn, role, text FROM conversations) SELECT conv_id, string_agg(text, chr(10) ORDER BY turn DESC) AS text FROM s WHERE role <> 'system' GROUP BY conv_id""")
def selected_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as evidence, selected last to first; what the system says is no text."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("evidence_id"), F.when(F.col("role") == "system", "image").otherwise("text").alias("kind"), "text")
    picked = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("evidence_id"), asc=False).alias("evidence_ids"))
    return evidence.selected_text(picked, turns, ["conv_id"]).select("conv_id", F.array_join("texts", "\n").alias("text"))


@query("""SELECT source, count(*) AS records, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY source HAVING count(*) > 30 OR sum(strlen(text)) > 60000""")
def bounded_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.bounded_sources(read(spark, sf_dir, "documents"), ["source"], 30, 60_000)


@query("""SELECT user_id AS doc, min_by(event_type, {'ts': ts, 'id': event_id}) FILTER (WHERE event_type <> 'view') AS model_digest FROM events GROUP BY user_id""")
def first_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), "ts", "event_id", F.when(F.col("event_type") != "view", F.col("event_type")).alias("model_digest"))
    return evidence.first_model(rows, ["doc"], ["ts", "event_id"])


@query("""SELECT DISTINCT p_brand AS goal, CASE WHEN p_size % 3 > 0 THEN (p_size % 5)::VARCHAR END AS page, CASE WHEN p_size % 3 = 2 THEN (p_partkey % 7)::VARCHAR END AS region,
    CASE p_size % 3 WHEN 0 THEN 'document' WHEN 1 THEN 'page ' || (p_size % 5) ELSE 'region ' || (p_partkey % 7) || ' on page ' || (p_size % 5) END AS label FROM part""")
def atomic_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, page = F.col("p_size") % 3, (F.col("p_size") % 5).cast("string")
    kind = F.when(size == 0, "document").when(size == 1, "pages").otherwise("regions")
    scopes = read(spark, sf_dir, "part").select(F.col("p_brand").alias("goal"), kind.alias("kind"), F.array(page, page).alias("page_ids"), F.array(F.struct(page.alias("page"), (F.col("p_partkey") % 7).cast("string").alias("region"))).alias("regions"))
    rows = evidence.atomic_scopes(scopes, ["goal"])
    return rows.withColumn("label", evidence.scope_label(F.col("page"), F.col("region")))
