"""Queries of the evaluator: accounting, matching, scores, comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry, text
from ..operators import evaluate
from .tables import CASES_SQL, boxes, cases, read

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return register


#: Control codes for the letters beyond ASCII that the tables have.
BYTES = "".join(chr(c) for c in (*range(1, 9), *range(14, 27)))
THRESHOLDS = {"table": 0.5, "paragraph": 0.4, "heading": 0.3}

BOXES = """
    WITH truth AS (SELECT l_orderkey AS case_id, l_linenumber AS idx, CASE l_returnflag WHEN 'A' THEN 'table' WHEN 'N' THEN 'paragraph' ELSE 'heading' END AS kind,
        l_partkey % 12 * 8 AS x, l_suppkey % 5 * 12 AS y, 20 + l_quantity::INT % 20 AS w, 15 + l_linenumber * 3 AS h FROM lineitem),
    pred AS (SELECT l_orderkey AS case_id, l_linenumber AS idx, CASE WHEN (l_partkey + l_linenumber) % 11 = 0 THEN 'formula' ELSE CASE l_returnflag WHEN 'A' THEN 'table' WHEN 'N' THEN 'paragraph' ELSE 'heading' END END AS kind,
        l_partkey % 12 * 8 + l_partkey % 5 AS x, l_suppkey % 5 * 12 + l_suppkey % 3 AS y, 20 + l_quantity::INT % 20 AS w, 15 + l_linenumber * 3 AS h FROM lineitem),
    both_ AS (SELECT t.case_id, t.idx AS truth_idx, p.idx AS pred_idx, t.kind, (least(t.x + t.w, p.x + p.w) - greatest(t.x, p.x)) * (least(t.y + t.h, p.y + p.h) - greatest(t.y, p.y)) AS common, t.w * t.h + p.w * p.h AS area
        FROM truth t JOIN pred p ON t.case_id = p.case_id AND t.x < p.x + p.w AND p.x < t.x + t.w AND t.y < p.y + p.h AND p.y < t.y + t.h),
    pair AS (SELECT case_id, truth_idx, pred_idx, kind, common::DOUBLE / (area - common) AS iou FROM both_ WHERE common::DOUBLE / (area - common) >= CASE kind WHEN 'table' THEN 0.5::DOUBLE WHEN 'paragraph' THEN 0.4::DOUBLE ELSE 0.3::DOUBLE END)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    thresholds = spark.createDataFrame(list(THRESHOLDS.items()), "kind string, threshold double")
    return evaluate.region_pairs(boxes(spark, sf_dir, False), boxes(spark, sf_dir, True), thresholds)


@query(BOXES + " SELECT case_id, truth_idx, pred_idx, kind, round(iou, 9) AS iou FROM pair")
def spatial_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).withColumn("iou", F.round("iou", 9))


@query()
def region_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A largest matching; no SQL, see tests/test_evaluate.py."""
    return evaluate.assignment(pairs(spark, sf_dir))


@query(BOXES + """, lone AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY case_id, truth_idx) AS a, count(*) OVER (PARTITION BY case_id, pred_idx) AS b FROM pair) WHERE a = 1 AND b = 1)
    SELECT case_id, truth_idx, pred_idx, round(iou, 9) AS iou FROM lone""")
def region_assignment_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matching where each side has one partner at most, so that there is but one."""
    found = pairs(spark, sf_dir)
    rows = found.withColumn("a", F.count("*").over(Window.partitionBy("case_id", "truth_idx"))).withColumn("b", F.count("*").over(Window.partitionBy("case_id", "pred_idx")))
    return evaluate.assignment(rows.where("a = 1 and b = 1").drop("a", "b")).withColumn("iou", F.round("iou", 9))


@query("""WITH t AS (SELECT l_orderkey AS case_id, l_linenumber AS a, l_linenumber + 1 AS b FROM lineitem), p AS (SELECT DISTINCT l_orderkey AS case_id, l_linenumber AS a, l_linenumber + 1 + l_suppkey % 3 AS b FROM lineitem),
    e AS (SELECT coalesce(t.case_id, p.case_id) AS case_id, t.a IS NOT NULL AS in_t, p.a IS NOT NULL AS in_p FROM (SELECT DISTINCT * FROM t) t FULL JOIN p ON t.case_id = p.case_id AND t.a = p.a AND t.b = p.b),
    s AS (SELECT case_id, count(*) FILTER (WHERE in_t AND in_p) AS tp, count(*) FILTER (WHERE NOT in_t) AS fp, count(*) FILTER (WHERE NOT in_p) AS fn FROM e GROUP BY case_id)
    SELECT case_id, tp, fp, fn, round(CASE WHEN tp = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END, 9)::DOUBLE AS f1 FROM s""")
def edge_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem")
    before = F.col("l_linenumber")
    truth = rows.select(F.col("l_orderkey").alias("case_id"), before.alias("before"), (before + 1).cast("long").alias("after"))
    predicted = rows.select(F.col("l_orderkey").alias("case_id"), before.alias("before"), (before + 1 + F.col("l_suppkey") % 3).alias("after"))
    return evaluate.edge_scores(truth, predicted).withColumn("f1", F.round("f1", 9))


def evaluated_sides(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Orders as cases.  A line is a region in a band of its own, so that but one prediction can match it.

    Predictions are numbered backwards; every seventh is missing, some are shifted too far, some
    have another kind, text, or next region.
    """
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = read(spark, sf_dir, "lineitem").withColumn("n", F.count("*").over(Window.partitionBy("l_orderkey"))).withColumn("line", F.row_number().over(order))
    part, supp, line = F.col("l_partkey"), F.col("l_suppkey"), F.col("line")
    kind = F.when(F.col("l_returnflag") == "A", "table").when(F.col("l_returnflag") == "N", "paragraph").otherwise("formula")
    word = F.concat(F.lit("w"), line.cast("string"), F.lit("."), part.cast("string"))
    rows = rows.select(F.col("l_orderkey").alias("case_id"), line.alias("idx"), kind.alias("kind"), word.alias("text"), "n", part.alias("part"), supp.alias("supp"), F.col("l_quantity").cast("int").alias("quantity"))
    band = lambda x: geometry.rect(x, F.col("idx") * 20, F.lit(100), F.lit(16))
    truth = rows.withColumn("rect", band(F.lit(0)))
    seen = rows.where("part % 7 <> 0").select("case_id", F.col("idx").alias("line"), (F.lit(50) - F.col("idx")).alias("idx"), F.when(F.col("part") % 11 == 0, "heading").otherwise(F.col("kind")).alias("kind"), F.when(F.col("supp") % 3 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")).alias("text"), "part", "supp", "quantity")
    seen = seen.withColumn("rect", geometry.rect(F.when(F.col("part") % 10 > 6, F.col("part") % 10 * 8).otherwise(0), F.col("line") * 20, F.lit(100), F.lit(16)))
    cells = lambda a, b: F.array(F.array(F.col("part").cast("string"), F.col("supp").cast("string")), F.array(a, b))
    tokens = lambda *more: F.array(F.lit("x"), F.lit("+"), F.col("part").cast("string"), *more)
    joined = lambda d, order: d.groupBy("case_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda r: r["text"]), " ").alias("text"))
    quantity = F.col("quantity").cast("string")
    sides = (
        {"cases": joined(truth, "idx"), "regions": truth.select("case_id", "idx", "kind", "text", "rect"), "edges": truth.where("idx < n").select("case_id", F.col("idx").alias("before"), (F.col("idx") + 1).alias("after"))},
        {"cases": joined(seen, "line"), "regions": seen.select("case_id", "idx", "kind", "text", "rect"), "edges": seen.select("case_id", F.col("idx").alias("before"), (F.col("idx") - 1 - F.when(F.col("supp") % 5 == 0, 1).otherwise(0)).cast("int").alias("after"))},
    )
    sides[0]["tables"] = truth.where("kind = 'table'").select("case_id", "idx", cells(quantity, F.lit("end")).alias("cells"))
    sides[1]["tables"] = seen.where("kind = 'table'").select("case_id", "idx", F.when(F.col("supp") % 4 == 0, F.slice(cells(quantity, F.lit("end")), 1, 1)).otherwise(cells(F.concat(quantity, F.lit("0")), F.lit("end"))).alias("cells"))
    sides[0]["formulas"] = truth.where("kind = 'formula'").select("case_id", "idx", tokens(F.lit("=")).alias("tokens"))
    sides[1]["formulas"] = seen.where("kind = 'formula'").select("case_id", "idx", F.when(F.col("supp") % 2 == 0, tokens(F.lit("="))).otherwise(tokens()).alias("tokens"))
    return sides


def evaluation_thresholds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("table", 0.5), ("paragraph", 0.4), ("heading", 0.3), ("formula", 0.5)], "kind string, threshold double")


#: The same sides in SQL; a truth and its prediction are one row, as no band meets another.
SIDES = """
    WITH r AS (SELECT l_orderkey AS case_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS idx, CASE l_returnflag WHEN 'A' THEN 'table' WHEN 'N' THEN 'paragraph' ELSE 'formula' END AS kind, 'w' || idx || '.' || l_partkey AS text,
        l_partkey AS part, l_suppkey AS supp, l_quantity::INT AS quantity, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
    s AS (SELECT *, part % 7 <> 0 AS seen, CASE WHEN part % 10 > 6 THEN part % 10 * 8 ELSE 0 END AS shift, CASE WHEN part % 11 = 0 THEN 'heading' ELSE kind END AS pred_kind, CASE WHEN supp % 3 = 0 THEN text || 'x' ELSE text END AS pred_text FROM r),
    o AS (SELECT *, (100.0::DOUBLE - shift) / (100 + shift) AS over_ FROM s),
    j AS (SELECT *, seen AND over_ >= CASE kind WHEN 'paragraph' THEN 0.4::DOUBLE ELSE 0.5::DOUBLE END AS met FROM o),
    jj AS (SELECT *, CASE WHEN met THEN over_ END AS iou FROM j),
    reg AS (SELECT case_id, count(*) AS truth_regions, count(*) FILTER (WHERE seen) AS predicted_regions, count(*) FILTER (WHERE met) AS matched_regions, count(*) FILTER (WHERE met AND pred_kind = kind) AS classification_correct, coalesce(avg(iou), 0) AS mean_iou FROM jj GROUP BY case_id),
    cat AS (SELECT case_id, kind, count(*) AS truth_regions, count(*) FILTER (WHERE met AND pred_kind = kind) AS correct_matches, coalesce(sum(iou) FILTER (WHERE met AND pred_kind = kind), 0) / count(*) AS mean_iou,
        coalesce(sum(1 - levenshtein(text, pred_text)::DOUBLE / greatest(length(text), length(pred_text))) FILTER (WHERE met AND pred_kind = kind), 0) / count(*) AS text_similarity FROM jj GROUP BY case_id, kind),
    te AS (SELECT case_id, idx AS a, idx + 1 AS b FROM r WHERE idx < n),
    pe AS (SELECT DISTINCT x.case_id, x.idx AS a, y.idx AS b FROM jj x JOIN jj y ON x.case_id = y.case_id AND y.idx = x.idx + 1 + (CASE WHEN x.supp % 5 = 0 THEN 1 ELSE 0 END) WHERE x.met AND y.met),
    ec AS (SELECT coalesce(te.case_id, pe.case_id) AS case_id, count(*) FILTER (WHERE te.a IS NOT NULL AND pe.a IS NOT NULL) AS tp, count(*) FILTER (WHERE te.a IS NULL) AS fp, count(*) FILTER (WHERE pe.a IS NULL) AS fn FROM te FULL JOIN pe ON te.case_id = pe.case_id AND te.a = pe.a AND te.b = pe.b GROUP BY 1),
    cs AS (SELECT case_id, string_agg(text, ' ' ORDER BY idx) AS text, string_agg(pred_text, ' ' ORDER BY idx) FILTER (WHERE seen) AS pred_text, count(*) FILTER (WHERE NOT seen OR supp % 3 = 0) AS word_errors, count(*) AS words FROM s GROUP BY case_id HAVING count(*) FILTER (WHERE seen) > 0),
    edge AS (SELECT case_id, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn, CASE WHEN coalesce(tp + fp + fn, 0) = 0 THEN 1 WHEN tp = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END AS f1 FROM cs LEFT JOIN ec USING (case_id)),
    cell AS (SELECT case_id, part, supp, quantity, met AND pred_kind = 'table' AS known FROM jj WHERE kind = 'table'),
    tab AS (SELECT case_id, count(*) AS truth_tables, count(*) FILTER (WHERE known) AS associated_tables, coalesce(sum(CASE WHEN supp % 4 = 0 THEN 0.5::DOUBLE ELSE 1 END) FILTER (WHERE known), 0) / count(*) AS structure_similarity,
        coalesce(sum(CASE WHEN supp % 4 = 0 THEN 0.5::DOUBLE ELSE (3 + length(quantity::VARCHAR)::DOUBLE / (length(quantity::VARCHAR) + 1)) / 4 END) FILTER (WHERE known), 0) / count(*) AS semantic_similarity FROM cell GROUP BY case_id),
    form AS (SELECT case_id, count(*) AS truth_formulas, count(*) FILTER (WHERE met AND pred_kind = 'formula') AS associated_formulas, coalesce(sum(CASE WHEN supp % 2 = 0 THEN 1 ELSE 0.75::DOUBLE END) FILTER (WHERE met AND pred_kind = 'formula'), 0) / count(*) AS token_similarity FROM jj WHERE kind = 'formula' GROUP BY case_id),
    flaw AS (SELECT case_id, bool_and(coalesce(met, false) AND pred_kind = kind AND pred_text = text AND shift = 0 AND kind = 'paragraph') AS fine FROM jj GROUP BY case_id)"""


@query(SIDES + " SELECT case_id, truth_regions, predicted_regions, matched_regions, classification_correct, round(mean_iou, 9) AS mean_iou FROM reg")
def region_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the assignment of all regions."""
    truth, seen = evaluated_sides(spark, sf_dir)
    matched = evaluate.assignment(evaluate.region_pairs(truth["regions"], seen["regions"], evaluation_thresholds(spark)))
    joined = evaluate.joined_regions(truth["regions"], seen["regions"], matched)
    return rounded(evaluate.region_scores(truth["regions"], seen["regions"], joined), "mean_iou")


@query(SIDES + " SELECT case_id, kind, truth_regions, correct_matches, round(mean_iou, 9) AS mean_iou, round(text_similarity, 9) AS text_similarity, round((correct_matches / truth_regions + mean_iou + text_similarity) / 3, 9) AS quality FROM cat")
def category_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth, seen = evaluated_sides(spark, sf_dir)
    matched = evaluate.assignment(evaluate.region_pairs(truth["regions"], seen["regions"], evaluation_thresholds(spark)))
    found = evaluate.category_metrics(evaluate.joined_regions(truth["regions"], seen["regions"], matched))
    return rounded(found, "mean_iou", "text_similarity", "quality")


@query(SIDES + " SELECT case_id, tp, fp, fn, round(f1, 9)::DOUBLE AS f1 FROM edge")
def mapped_edge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted order through the assignment, against the truth's."""
    truth, seen = evaluated_sides(spark, sf_dir)
    matched = evaluate.assignment(evaluate.region_pairs(truth["regions"], seen["regions"], evaluation_thresholds(spark)))
    cases = truth["cases"].join(seen["cases"].select("case_id"), "case_id")
    return rounded(evaluate.edge_scores(truth["edges"], evaluate.mapped_edges(seen["edges"], matched), "case_id", cases), "f1")


METRICS = ("cer", "wer", "reading_order", "mean_iou", "structure_similarity", "semantic_similarity", "token_similarity", "quality")


@query(SIDES + """, m AS (SELECT case_id, levenshtein(text, pred_text)::DOUBLE / length(text) AS cer, word_errors::DOUBLE / words AS wer, f1 AS reading_order, truth_regions, predicted_regions, matched_regions, classification_correct, mean_iou,
        truth_tables, associated_tables, structure_similarity, semantic_similarity, truth_formulas, associated_formulas, token_similarity, fine AND f1 = 1 AS exact
        FROM cs JOIN edge USING (case_id) JOIN reg USING (case_id) LEFT JOIN tab USING (case_id) LEFT JOIN form USING (case_id) JOIN flaw USING (case_id)),
    q AS (SELECT *, list_filter([greatest(0, 1 - cer), greatest(0, 1 - wer), reading_order, classification_correct / truth_regions, mean_iou, structure_similarity, semantic_similarity, token_similarity, CASE WHEN case_id % 2 = 0 THEN exact::INT::DOUBLE END], lambda x: x IS NOT NULL) AS parts FROM m)
    SELECT * EXCLUDE (parts) REPLACE (round(cer, 9) AS cer, round(wer, 9) AS wer, round(reading_order, 9)::DOUBLE AS reading_order, round(mean_iou, 9) AS mean_iou, round(structure_similarity, 9) AS structure_similarity, round(semantic_similarity, 9) AS semantic_similarity, round(token_similarity, 9) AS token_similarity),
        round(list_sum(parts) / len(parts), 9) AS quality FROM q""")
def evaluate_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluator as a whole; exactness counts for orders of even number."""
    found = evaluate.evaluated(*evaluated_sides(spark, sf_dir), evaluation_thresholds(spark), exact_cases=F.col("case_id") % 2 == 0)
    return rounded(found, *METRICS)


@query(CASES_SQL)
def case_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.accounted(*cases(spark, sf_dir))


@query("SELECT doc_id AS case_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = cases(spark, sf_dir)
    return documents.join(labels, "case_id", "left_anti")


@query("SELECT doc_id * 2 AS case_id FROM labels WHERE doc_id * 2 NOT IN (SELECT doc_id FROM documents)")
def extra_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = cases(spark, sf_dir)
    return evaluate.extra_predictions(documents, labels.select((F.col("case_id") * 2).alias("case_id")))


SUITE = """count(*) AS cases, count(*) FILTER (WHERE status = 'success') AS succeeded, count(*) FILTER (WHERE status = 'failure') AS failed, count(*) FILTER (WHERE status = 'skipped') AS skipped,
    round(coalesce(sum(quality) FILTER (WHERE status <> 'skipped') / nullif(count(*) FILTER (WHERE status <> 'skipped'), 0), 0), 9)::DOUBLE AS quality,
    round(coalesce(count(*) FILTER (WHERE status = 'failure') / nullif(count(*) FILTER (WHERE status <> 'skipped'), 0), 0), 9)::DOUBLE AS failure_rate"""


def rounded(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumns({c: F.round(c, 9) for c in columns})


@query(f"SELECT {SUITE} FROM ({CASES_SQL})")
def suite_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.suite(evaluate.accounted(*cases(spark, sf_dir))), "quality", "failure_rate")


@query(f"SELECT lang, {SUITE} FROM ({CASES_SQL}) GROUP BY lang")
def suite_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.suite(evaluate.accounted(*cases(spark, sf_dir)), "lang"), "quality", "failure_rate")


@query("""SELECT o_orderpriority, CASE WHEN count(v) = count(*) THEN max(v) END AS most, CASE WHEN count(v) = count(*) THEN sum(v) END::BIGINT AS total,
    CASE WHEN count(big) = count(*) THEN least(sum(big), 18446744073709551615::DECIMAL(38, 0)) END::DECIMAL(20, 0) AS saturated
    FROM (SELECT o_orderpriority, CASE WHEN o_orderpriority LIKE '1%' AND o_orderkey % 100 = 0 THEN NULL ELSE o_orderkey END AS v, CASE WHEN o_orderpriority LIKE '2%' AND o_orderkey % 100 = 0 THEN NULL ELSE o_orderkey::DECIMAL(38, 0) * 1000000000000 END AS big FROM orders)
    GROUP BY o_orderpriority""")
def unknown_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maxima and sums of groups, some with an unknown value; the saturating sum overflows."""
    o = read(spark, sf_dir, "orders")
    known = lambda digit, value: F.when(~(F.col("o_orderpriority").startswith(digit) & (F.col("o_orderkey") % 100 == 0)), value)
    rows = o.select("o_orderpriority", known("1", F.col("o_orderkey")).alias("v"), known("2", F.col("o_orderkey").cast("decimal(20,0)") * F.lit(10**12).cast("decimal(14,0)")).alias("big"))
    return rows.groupBy("o_orderpriority").agg(evaluate.known_max(F.col("v")).alias("most"), evaluate.known_sum(F.col("v")).alias("total"), evaluate.saturating_sum(F.col("big")).alias("saturated"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
    SELECT user_id, round(min(value) FILTER (WHERE n = 1), 6) AS cold, nullif(count(*) FILTER (WHERE n > 1), 0) AS warm_n, round(min(value) FILTER (WHERE n > 1), 6) AS warm_min, round(avg(value) FILTER (WHERE n > 1), 6) AS warm_mean,
        round(max(value) FILTER (WHERE n > 1), 6) AS warm_max, round(stddev_pop(value) FILTER (WHERE n > 1), 6) AS warm_stddev FROM r GROUP BY user_id""")
def cold_warm_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluate.summary(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value")
    return found.withColumns({c: F.round(c, 6) for c in ("cold", "warm_min", "warm_mean", "warm_max", "warm_stddev")})


@query("""WITH m AS (SELECT item_id, translate(text, 'ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü', 'CODES') AS text FROM benchmark), p AS (SELECT a.item_id, a.text AS t, b.text AS u FROM m a JOIN m b ON b.item_id = a.item_id + 1)
    SELECT item_id, levenshtein(t, u)::INT AS edits, round(levenshtein(t, u) / greatest(length(t), 1), 9)::DOUBLE AS cer, round(greatest(0, 1 - levenshtein(t, u) / greatest(length(t), 1)), 9)::DOUBLE AS similarity FROM p""".replace("CODES", BYTES))
def character_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark text against the next.  In SQL, which counts bytes, other letters first become one byte each."""
    b = read(spark, sf_dir, "benchmark")
    both = b.select("item_id", F.col("text").alias("t")).join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("u")), "item_id")
    rows = both.withColumn("edits", F.levenshtein("t", "u")).withColumn("cer", text.error_rate(F.col("edits"), F.length("t")))
    return rounded(rows.select("item_id", "edits", "cer", text.similarity_from_error(F.col("cer")).alias("similarity")), "cer", "similarity")


@query()
def word_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark text against the next by words; no SQL, see tests/test_evaluate.py."""
    b = read(spark, sf_dir, "benchmark").select("item_id", F.split(F.trim("text"), r"\s+").alias("w"))
    both = b.join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("w").alias("v")), "item_id")
    return both.select("item_id", text.distance_of_lists(F.col("w"), F.col("v")).alias("edits"), F.size("w").alias("words"))


@query("""WITH t AS (SELECT p_brand AS k, p_size AS a, p_partkey % 40 AS b, p_name AS x, p_type AS y FROM part)
    SELECT k, count(*) AS n, round(avg(CASE WHEN greatest(a, b) = 0 THEN 1 ELSE least(a, b)::DOUBLE / greatest(a, b) END), 9) AS dimension, round(avg(1 - levenshtein(x, y)::DOUBLE / greatest(length(x), length(y), 1)), 9) AS cell FROM t GROUP BY k""")
def table_similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part")
    dimension = text.dimension_similarity(F.col("p_size").cast("double"), (F.col("p_partkey") % 40).cast("double"))
    cell = text.sequence_similarity(F.levenshtein("p_name", "p_type"), F.length("p_name"), F.length("p_type"))
    return rounded(rows.groupBy(F.col("p_brand").alias("k")).agg(F.count("*").alias("n"), F.avg(dimension).alias("dimension"), F.avg(cell).alias("cell")), "dimension", "cell")


REPORTS_SQL = """
    WITH b AS (SELECT doc_id AS case_id, source, 'success' AS status, quality::DOUBLE AS quality FROM documents JOIN labels USING (doc_id)),
    c AS (SELECT case_id, source, CASE WHEN case_id % 41 = 0 THEN 'failure' ELSE 'success' END AS status, case_id % 41 = 0 AS missing, CASE WHEN case_id % 41 = 0 THEN 0 WHEN case_id % 9 = 0 THEN quality / 2 WHEN case_id % 10 = 0 AND length(source) % 2 = 0 THEN 1 ELSE quality END AS quality FROM b),
    s AS (SELECT source, avg(c.quality) - avg(b.quality) AS q, avg((c.status = 'failure')::INT) AS f, bool_or(c.missing) AS lost FROM b JOIN c USING (case_id, source) GROUP BY source)"""


def reports(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Labelled documents as a baseline's cases; a candidate that lacks some, spoils some and mends some."""
    rows = read(spark, sf_dir, "documents").select("doc_id", "source").join(read(spark, sf_dir, "labels"), "doc_id")
    baseline = rows.select(F.col("doc_id").alias("case_id"), "source", F.lit("success").alias("status"), F.lit(None).cast("string").alias("reason"), F.col("quality").cast("double").alias("quality"))
    case = F.col("case_id")
    mended = F.when(case % 9 == 0, F.col("quality") / 2).when((case % 10 == 0) & (F.length("source") % 2 == 0), 1.0).otherwise(F.col("quality"))
    predictions = baseline.where(case % 41 != 0).select("case_id", "status", mended.alias("quality"))
    return baseline, evaluate.accounted(baseline.select("case_id", "source"), predictions)


@query(REPORTS_SQL + """ SELECT source, round(q, 9) AS delta_quality, round(-f, 9) + 0 AS delta_failure_rate, CASE WHEN q > 0.01 AND NOT (q < -0.01 OR f > 0.5 OR lost) THEN 'candidate_dominates' WHEN (q < -0.01 OR f > 0.5 OR lost) AND NOT q > 0.01 THEN 'baseline_dominates'
        WHEN q > 0.01 THEN 'tradeoff' ELSE 'equal' END AS verdict FROM s""")
def compare_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate against a baseline by source of documents: a success left out counts for the baseline."""
    baseline, candidate = reports(spark, sf_dir)
    sides = [evaluate.suite(r, "source") for r in (baseline, candidate)]
    found = evaluate.compared(*sides, {"quality": 0.01, "failure_rate": 0.5}, "source", evaluate.omitted_successes(baseline, candidate, ["source"]))
    return rounded(found, "delta_quality", "delta_failure_rate").withColumn("delta_failure_rate", F.col("delta_failure_rate") + 0.0)


@query(REPORTS_SQL + " SELECT case_id, b.status AS baseline_status, c.status AS candidate_status, c.quality - b.quality AS quality_delta FROM b JOIN c USING (case_id)")
def report_case_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.case_deltas(*reports(spark, sf_dir))


@query("""SELECT coalesce(a.case_id, b.case_id) AS case_id, CASE WHEN a.case_id IS NULL THEN 'candidate' ELSE 'baseline' END AS only_in FROM (SELECT doc_id AS case_id FROM documents WHERE doc_id % 5 <> 1) a FULL JOIN (SELECT doc_id AS case_id FROM labels) b ON a.case_id = b.case_id WHERE a.case_id IS NULL OR b.case_id IS NULL""")
def case_set_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases of one report only: an error wherever reports are compared."""
    id_ = F.col("doc_id").alias("case_id")
    return evaluate.case_sets(read(spark, sf_dir, "documents").where("doc_id % 5 <> 1").select(id_), read(spark, sf_dir, "labels").select(id_))


@query(f"""WITH s AS (SELECT lang, {SUITE} FROM ({CASES_SQL}) GROUP BY lang) SELECT lang, unnest(list_filter([CASE WHEN length(lang) + failed <> failed + 2 THEN 'failed' END, CASE WHEN lang IN ('de', 'en') THEN 'skipped' END, CASE WHEN lang = 'fr' THEN 'quality' END], lambda x: x IS NOT NULL)) AS wrong FROM s""")
def report_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report whose summary was altered for some languages, recounted from its cases."""
    report = evaluate.accounted(*cases(spark, sf_dir))
    claimed = evaluate.suite(report, "lang").withColumn("skipped", F.col("skipped") + F.when(F.col("lang").isin("de", "en"), 1).otherwise(0)).withColumn("quality", F.col("quality") + F.when(F.col("lang") == "fr", 1e-6).otherwise(1e-14))
    return evaluate.checked_report(report, claimed, ["lang"])


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) SELECT user_id, printf('baseline %s warm wall n=%d mean=%.3fms stddev=%.3fms', user_id::VARCHAR, count(*), avg(value), stddev_pop(value)) AS note FROM r WHERE n > 1 GROUP BY user_id""")
def variance_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.variance_notes(read(spark, sf_dir, "events"), "baseline", ["user_id"], ["ts", "event_id"], "value")


@query("SELECT text, count(*) AS rows FROM documents GROUP BY text HAVING count(*) > 1")
def repeated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.repeated(read(spark, sf_dir, "documents"), "text")
