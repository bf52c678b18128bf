"""The evaluator: case accounting, region matching, scores and comparison of reports.

What is unknown stays unknown: an aggregate over an unknown value is unknown, never less.
Failures count as zero, skipped cases not at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry, text


def known_max(value: Column) -> Column:
    return F.when(F.count(value) == F.count("*"), F.max(value))


def known_sum(value: Column) -> Column:
    return F.when(F.count(value) == F.count("*"), F.sum(value))


def saturating_sum(value: Column) -> Column:
    """Sum up to the largest unsigned 64-bit number; unknown if any part is."""
    total = F.least(F.sum(value.cast("decimal(38,0)")), F.lit("18446744073709551615").cast("decimal(38,0)"))
    return F.when(F.count(value) == F.count("*"), total.cast("decimal(20,0)"))


def accounted(cases: DataFrame, predictions: DataFrame, key: str = "case_id") -> DataFrame:
    """Every case with its prediction's status; a case without one is a failure."""
    joined = cases.join(predictions.select(key, "status", "quality"), key, "left")
    status = F.coalesce("status", F.lit("failure"))
    reason = F.when(F.col("status").isNull(), "missing_prediction")
    return joined.select(*cases.columns, status.alias("status"), reason.alias("reason"), F.when(status == "success", F.col("quality")).when(status == "failure", 0.0).alias("quality"))


def extra_predictions(cases: DataFrame, predictions: DataFrame, key: str = "case_id") -> DataFrame:
    return predictions.join(cases.select(key), key, "left_anti")


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that several rows have: a violation wherever keys must be unique."""
    return rows.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def suite(results: DataFrame, *by: str) -> DataFrame:
    """Counts, quality and failure rate over success and failure; skipped cases are left out."""
    counted = F.col("status") != "skipped"
    n = F.count_if(counted)
    return results.groupBy(*by).agg(
        F.count("*").alias("cases"),
        F.count_if(F.col("status") == "success").alias("succeeded"),
        F.count_if(F.col("status") == "failure").alias("failed"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.when(n > 0, F.sum(F.when(counted, F.col("quality"))) / n).otherwise(0.0).alias("quality"),
        F.when(n > 0, F.count_if(F.col("status") == "failure") / n).otherwise(0.0).alias("failure_rate"),
    )


def timing(results: DataFrame, *by: str, millis: str = "cold_millis") -> DataFrame:
    """Cases a second and total latency, if every case was timed."""
    total = known_sum(F.col(millis))
    return results.groupBy(*by).agg(F.when(total > 0, F.count("*") * 1000.0 / total).alias("cases_per_second"), total.alias("latency_millis"))


def summary(samples: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """The first sample as cold, the rest as warm: count, least, mean, most and population deviation."""
    first = F.min_by(value, F.struct(*order))
    gathered = samples.groupBy(*by).agg(first.alias("cold"), F.count("*").alias("n"), F.sum(value).alias("s"), F.min_by(F.struct(*order), F.struct(*order)).alias("at"))
    warm = samples.join(gathered.select(*by, "at"), by).where(F.struct(*order) != F.col("at"))
    spread = warm.groupBy(*by).agg(F.count("*").alias("warm_n"), F.min(value).alias("warm_min"), F.avg(value).alias("warm_mean"), F.max(value).alias("warm_max"), F.stddev_pop(value).alias("warm_stddev"))
    return gathered.select(*by, "cold").join(spread, by, "left")


def region_pairs(truth: DataFrame, predicted: DataFrame, thresholds: DataFrame, key: str = "case_id") -> DataFrame:
    """Pairs of a case's regions that overlap enough for the truth's kind.

    Corners and areas are columns before the join, so that the join computes one product; the
    division comes after it, for pairs that are kept.
    """

    def corners(side: str) -> list[Column]:
        r = F.col("rect")
        made = {"x1": r["x"], "y1": r["y"], "x2": geometry.right(r), "y2": geometry.bottom(r), "area": geometry.area(r)}
        return [c.alias(f"{side}_{n}") for n, c in made.items()]

    # A threshold for each kind of region: a few rows.
    t = truth.join(F.broadcast(thresholds), "kind").select(key, F.col("idx").alias("truth_idx"), "kind", "threshold", *corners("t"))
    p = predicted.select(F.col(key).alias("p_key"), F.col("idx").alias("pred_idx"), *corners("p"))
    width = F.least("t_x2", "p_x2") - F.greatest("t_x1", "p_x1")
    height = F.least("t_y2", "p_y2") - F.greatest("t_y1", "p_y1")
    common, area = width * height, F.col("t_area") + F.col("p_area")
    near = (width > 0) & (height > 0) & (common >= F.col("threshold") * (area - common) * (1 - 1e-12))
    pairs = t.join(p, (F.col(key) == F.col("p_key")) & near).withColumn("iou", F.try_divide(common, area - common))
    return pairs.where("iou >= threshold").select(key, "truth_idx", "pred_idx", "kind", "iou")


def assignment(pairs: DataFrame, key: str = "case_id") -> DataFrame:
    """A largest one-to-one matching of each case's pairs.

    Truth in order of index looks for a free partner, largest overlap first, and moves those
    matched before along alternating paths.  A case's pairs are few and meet in one task.
    """
    kind = dict(pairs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in (key, "truth_idx", "pred_idx", "iou")), strict=True))
        out: list[tuple] = []
        for case, group in groupby(rows, key=itemgetter(0)):
            out += [(case, *found) for found in matching([r[1:] for r in group])]
            if len(out) > 10_000:
                yield batch_of(out)
                out = []
        yield batch_of(out)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        kinds = (None, pa.int32(), pa.int32(), pa.float64())
        columns = [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]
        columns[0] = columns[0].cast(arrow_kind)
        return pa.RecordBatch.from_arrays(columns, [key, "truth_idx", "pred_idx", "iou"])

    arrow_kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    dealt = pairs.select(key, "truth_idx", "pred_idx", "iou").repartition(key).sortWithinPartitions(key, "truth_idx", F.col("iou").desc(), "pred_idx")
    return dealt.mapInArrow(run, f"{key} {kind}, truth_idx int, pred_idx int, iou double")


def matching(pairs: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """The matching of one case; pairs come by truth, then by overlap from the largest, then by index."""
    options: dict[int, list[int]] = {}
    overlap = {}
    for truth, predicted, iou in pairs:
        options.setdefault(truth, []).append(predicted)
        overlap[truth, predicted] = iou
    owner: dict[int, int] = {}
    for start in options:
        # Depth first without recursion: a stack of truths, each with the options not tried.
        tried: set[int] = set()
        path: list[tuple[int, int]] = []
        stack = [(start, iter(options[start]))]
        while stack:
            truth, rest = stack[-1]
            chosen = next((p for p in rest if p not in tried), None)
            if chosen is None:
                stack.pop()
                if path:
                    path.pop()
                continue
            tried.add(chosen)
            path.append((truth, chosen))
            if chosen not in owner:
                owner.update({p: t for t, p in path})
                break
            stack.append((owner[chosen], iter(options[owner[chosen]])))
    return [(t, p, overlap[t, p]) for t, p in sorted((t, p) for p, t in owner.items())]


def block_kind(region_kind: Column) -> Column:
    """The evaluator's four kinds: headers are headings, cells tables, and the rest paragraphs."""
    return F.when(region_kind.isin("heading", "header"), "heading").when(region_kind.isin("table", "table_cell"), "table").when(region_kind == "formula", "formula").otherwise("paragraph")


def variance_notes(samples: DataFrame, label: str, by: list[str], order: list[str], value: str) -> DataFrame:
    """A note on the spread of every case that has warm samples."""
    rows = summary(samples, by, order, value).where("warm_n > 0")
    note = F.format_string("%s %s warm wall n=%d mean=%.3fms stddev=%.3fms", F.lit(label), F.concat_ws("/", *[F.col(b).cast("string") for b in by]), F.col("warm_n"), F.col("warm_mean"), F.col("warm_stddev"))
    return rows.select(*by, note.alias("note"))


def joined_regions(truth: DataFrame, predicted: DataFrame, matched: DataFrame, key: str = "case_id") -> DataFrame:
    """Every truth region with the prediction assigned to it, null without one.

    Regions are rows of ``idx, kind, text, rect``; the truth's other columns stay, the
    prediction's go by ``pred_``.
    """
    p = predicted.select(key, *[F.col(c).alias(f"pred_{c}") for c in predicted.columns if c != key])
    rows = truth.join(matched.withColumnRenamed("truth_idx", "idx"), [key, "idx"], "left")
    return rows.join(p, [key, "pred_idx"], "left")


def region_scores(truth: DataFrame, predicted: DataFrame, joined: DataFrame, key: str = "case_id") -> DataFrame:
    """By case: regions on either side and matched, kinds that agree, mean overlap of the matched ones."""
    counts = predicted.groupBy(key).agg(F.count("*").alias("predicted_regions"))
    sums = joined.groupBy(key).agg(
        F.count("*").alias("truth_regions"),
        F.count("iou").alias("matched_regions"),
        F.count_if(F.col("pred_kind") == F.col("kind")).alias("classification_correct"),
        F.coalesce(F.avg("iou"), F.lit(0.0)).alias("mean_iou"),
    )
    return sums.join(counts, key, "left").withColumn("predicted_regions", F.coalesce("predicted_regions", F.lit(0)).cast("long"))


def category_metrics(joined: DataFrame, key: str = "case_id") -> DataFrame:
    """By case and kind of truth, over all regions of the kind: what is matched with its kind, its overlap and likeness of text."""
    right = F.coalesce(F.col("pred_kind") == F.col("kind"), F.lit(False))
    likeness = text.sequence_similarity(F.levenshtein("text", "pred_text"), F.char_length("text"), F.char_length("pred_text"))
    n = F.count("*")
    found = joined.groupBy(key, "kind").agg(
        n.alias("truth_regions"), F.count_if(right).alias("correct_matches"), (F.sum(F.when(right, F.col("iou")).otherwise(0.0)) / n).alias("mean_iou"), (F.sum(F.when(right, likeness).otherwise(0.0)) / n).alias("text_similarity")
    )
    return found.withColumn("quality", (F.col("correct_matches") / F.col("truth_regions") + F.col("mean_iou") + F.col("text_similarity")) / 3.0)


def mapped_edges(edges: DataFrame, matched: DataFrame, key: str = "case_id") -> DataFrame:
    """Predicted edges as edges of truth regions; those with an end that matches nothing are left out."""
    ends = matched.select(key, "truth_idx", "pred_idx")
    for end in ("before", "after"):
        edges = edges.join(ends.withColumnsRenamed({"pred_idx": end, "truth_idx": f"truth_{end}"}), [key, end])
    return edges.select(key, F.col("truth_before").alias("before"), F.col("truth_after").alias("after")).distinct()


def edge_scores(truth: DataFrame, predicted: DataFrame, key: str = "case_id", cases: DataFrame | None = None) -> DataFrame:
    """Directed edges found, invented and lost, and F1; given all ``cases``, 1 for one that has none on both sides."""
    sides = truth.select(key, "before", "after").distinct().withColumn("t", F.lit(1)).unionByName(predicted.select(key, "before", "after").distinct().withColumn("t", F.lit(2)))
    edges = sides.groupBy(key, "before", "after").agg(F.sum("t").alias("sides"))
    sums = edges.groupBy(key).agg(F.count_if(F.col("sides") == 3).alias("tp"), F.count_if(F.col("sides") == 2).alias("fp"), F.count_if(F.col("sides") == 1).alias("fn"))
    if cases is not None:
        sums = cases.select(key).join(sums, key, "left").na.fill(0, ["tp", "fp", "fn"])
    n = F.col("tp") + F.col("fp") + F.col("fn")
    return sums.withColumn("f1", F.when(n == 0, 1.0).when(F.col("tp") == 0, 0.0).otherwise(2.0 * F.col("tp") / (F.col("tp") + n)))


def table_scores(joined: DataFrame, truth: DataFrame, predicted: DataFrame, key: str = "case_id") -> DataFrame:
    """By case with tables: likeness of sizes, and of cells in order, of tables whose regions are matched.

    Tables are rows of ``idx, cells`` (array of rows).  A table without a partner adds nothing to
    the sums; cells beyond the shorter side are unlike.
    """
    p = predicted.select(key, F.col("idx").alias("pred_idx"), F.col("cells").alias("pred_cells"))
    # A truth table of no region counts too.
    rows = truth.select(key, "idx", "cells").join(joined.select(key, "idx", "pred_idx"), [key, "idx"], "left").join(p, [key, "pred_idx"], "left")
    size = lambda c: F.size(c).cast("double")
    width = lambda c: F.coalesce(F.size(F.get(c, 0)), F.lit(0)).cast("double")
    alike = text.dimension_similarity(size("cells"), size("pred_cells")) * text.dimension_similarity(width(F.col("cells")), width(F.col("pred_cells")))
    cell = lambda z: F.when(z["a"].isNull() | z["b"].isNull(), 0.0).otherwise(text.sequence_similarity(F.levenshtein(z["a"], z["b"]), F.char_length(z["a"]), F.char_length(z["b"])))
    both = F.arrays_zip(F.flatten("cells").alias("a"), F.flatten("pred_cells").alias("b"))
    means = F.aggregate(F.transform(both, cell), F.lit(0.0), lambda x, y: x + y) / F.greatest(F.size(both), F.lit(1))
    known = F.col("pred_cells").isNotNull()
    rows = rows.select(key, known.alias("known"), F.when(known, alike).alias("structure"), F.when(known, means).alias("semantic"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0)) / F.count("*")
    return rows.groupBy(key).agg(F.count("*").alias("truth_tables"), F.count_if("known").alias("associated_tables"), total("structure").alias("structure_similarity"), total("semantic").alias("semantic_similarity"))


def formula_scores(joined: DataFrame, truth: DataFrame, predicted: DataFrame, key: str = "case_id") -> DataFrame:
    """By case with formulas: mean likeness of tokens, nothing for a formula without a partner.

    Formulas are rows of ``idx, tokens``, see ``text.latex_tokens``.
    """
    p = predicted.select(key, F.col("idx").alias("pred_idx"), F.col("tokens").alias("pred_tokens"))
    rows = truth.select(key, "idx", "tokens").join(joined.select(key, "idx", "pred_idx"), [key, "idx"], "left").join(p, [key, "pred_idx"], "left")
    likeness = text.sequence_similarity(text.distance_of_lists(F.col("tokens"), F.col("pred_tokens")), F.size("tokens"), F.size("pred_tokens"))
    found = F.when(F.col("pred_tokens").isNotNull(), likeness)
    return rows.groupBy(key).agg(F.count("*").alias("truth_formulas"), F.count("pred_tokens").alias("associated_formulas"), (F.coalesce(F.sum(found), F.lit(0.0)) / F.count("*")).alias("token_similarity"))


def gathered(rows: DataFrame, *columns: str, key: str = "case_id") -> DataFrame:
    """What a case has of a table, as a sorted array that compares whole."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("held"))


def unequal(truth: DataFrame, predicted: DataFrame, *columns: str, key: str = "case_id") -> DataFrame:
    """Cases whose tables, or formulas, are not the same on both sides."""
    sides = gathered(truth, *columns, key=key).join(gathered(predicted, *columns, key=key).withColumnRenamed("held", "other"), key, "full_outer")
    return sides.where(~F.col("held").eqNullSafe(F.col("other"))).select(key)


def exact(cases: DataFrame, joined: DataFrame, regions: DataFrame, edges: DataFrame, differing: list[DataFrame], key: str = "case_id") -> DataFrame:
    """Whether a case is right in everything: text, regions one by one, order, and no row of ``differing``."""
    same = (F.col("pred_kind") == F.col("kind")) & (F.col("pred_text") == F.col("text")) & (F.col("pred_rect") == F.col("rect"))
    whole = joined.groupBy(key).agg(F.bool_and(F.coalesce(same, F.lit(False))).alias("regions_equal"))
    rows = cases.select(key, (F.col("text") == F.col("pred_text")).alias("text_equal")).join(whole, key, "left")
    rows = rows.join(regions.select(key, (F.col("truth_regions") == F.col("predicted_regions")).alias("counts_equal")), key, "left").join(edges.select(key, (F.col("f1") == 1.0).alias("order_equal")), key, "left")
    fine = F.lit(True)
    for name in ("text_equal", "regions_equal", "counts_equal", "order_equal"):
        fine = fine & F.coalesce(F.col(name), F.lit(name == "regions_equal" or name == "counts_equal"))
    rows = rows.select(key, fine.alias("exact"))
    for some in differing:
        rows = rows.join(some.select(key).distinct().withColumn("differs", F.lit(True)), key, "left").select(key, (F.col("exact") & F.col("differs").isNull()).alias("exact"))
    return rows


def evaluated(truth: dict[str, DataFrame], predicted: dict[str, DataFrame], thresholds: DataFrame, key: str = "case_id", exact_cases: Column | None = None) -> DataFrame:
    """The metrics of every case that has a prediction, and their mean as its quality.

    Both sides: ``cases`` (text), ``regions`` (idx, kind, text, rect), ``edges`` (before, after),
    ``tables`` (idx, cells), ``formulas`` (idx, tokens).  Texts are normalised already, see
    ``text.normalized_text``.  The mean has five parts, two more with tables, one with formulas,
    and one where ``exact_cases`` asks whether everything is right.
    """
    pairs = region_pairs(truth["regions"], predicted["regions"], thresholds, key)
    matched = assignment(pairs, key)
    joined = joined_regions(truth["regions"], predicted["regions"], matched, key)
    cases = truth["cases"].join(predicted["cases"].select(key, F.col("text").alias("pred_text")), key)
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    cer = text.error_rate(F.levenshtein("text", "pred_text"), F.char_length("text"))
    wer = text.error_rate(text.distance_of_lists(words(F.col("text")), words(F.col("pred_text"))), F.size(words(F.col("text"))))
    rates = cases.select(key, cer.alias("cer"), wer.alias("wer"))
    regions = region_scores(truth["regions"], predicted["regions"], joined, key)
    edges = edge_scores(truth["edges"], mapped_edges(predicted["edges"], matched, key), key, cases)
    tables = table_scores(joined, truth["tables"], predicted["tables"], key)
    formulas = formula_scores(joined, truth["formulas"], predicted["formulas"], key)
    differing = [unequal(truth["tables"], predicted["tables"], "idx", "cells", key=key), unequal(truth["formulas"], predicted["formulas"], "idx", "tokens", key=key)]
    right = exact(cases, joined, regions, edges, differing, key)
    rows = rates.join(edges.select(key, F.col("f1").alias("reading_order")), key).join(regions, key, "left").join(tables, key, "left").join(formulas, key, "left").join(right, key)
    rows = rows.na.fill(0, ["truth_regions", "predicted_regions", "matched_regions", "classification_correct"]).na.fill(0.0, ["mean_iou"])
    agreeing = text.ratio(F.col("classification_correct"), F.greatest("truth_regions", F.lit(1)))
    asked = F.lit(False) if exact_cases is None else exact_cases
    parts = [text.similarity_from_error(F.col("cer")), text.similarity_from_error(F.col("wer")), F.col("reading_order"), agreeing, F.col("mean_iou"), F.col("structure_similarity"), F.col("semantic_similarity"), F.col("token_similarity"), F.when(asked, F.col("exact").cast("double"))]
    return rows.withColumn("quality", case_quality(parts))


#: Dimensions of a comparison that are better when lower.
LOWER_IS_BETTER = ("failure_rate", "latency_millis", "cost", "memory_bytes")


def case_sets(baseline: DataFrame, candidate: DataFrame, key: str = "case_id") -> DataFrame:
    """Cases that only one of two reports has: reports with any can't be compared."""
    sides = [r.select(key).distinct().withColumn("side", F.lit(s)) for r, s in ((baseline, "baseline"), (candidate, "candidate"))]
    return sides[0].unionByName(sides[1]).groupBy(key).agg(F.count("*").alias("n"), F.min("side").alias("only_in")).where("n = 1").drop("n")


def omitted_successes(baseline: DataFrame, candidate: DataFrame, by: list[str], key: str = "case_id") -> DataFrame:
    """Groups in which the candidate has no prediction for a case that the baseline got right."""
    lost = candidate.where("reason = 'missing_prediction'").select(*by, key).join(baseline.where("status = 'success'").select(*by, key), [*by, key], "left_semi")
    return lost.select(*by).distinct()


def compared(baseline: DataFrame, candidate: DataFrame, dimensions: dict[str, float], key: str, omitted: DataFrame | None = None) -> DataFrame:
    """The verdict between two reports by tolerance of each dimension.

    One side dominates if it is nowhere worse and somewhere better; a success that the candidate
    left out makes the baseline better; one unknown dimension makes all indeterminate.
    """
    b = baseline.select(key, *[F.col(d).cast("double").alias(f"b_{d}") for d in dimensions])
    c = candidate.select(key, *[F.col(d).cast("double").alias(f"c_{d}") for d in dimensions])
    rows = b.join(c, key, "full_outer")
    deltas = [((F.col(f"c_{d}") - F.col(f"b_{d}")) * (-1 if d in LOWER_IS_BETTER else 1)).alias(f"delta_{d}") for d in dimensions]
    rows = rows.select(key, *deltas)
    unknown = F.lit(False)
    better, worse = F.lit(False), F.lit(False)
    for d, tolerance in dimensions.items():
        unknown = unknown | F.col(f"delta_{d}").isNull()
        better = better | F.coalesce(F.col(f"delta_{d}") > tolerance, F.lit(False))
        worse = worse | F.coalesce(F.col(f"delta_{d}") < -tolerance, F.lit(False))
    if omitted is not None:
        rows = rows.join(omitted.select(key).distinct().withColumn("_lost", F.lit(True)), key, "left")
        worse = worse | F.col("_lost").isNotNull()
    verdict = F.when(unknown, "indeterminate").when(better & ~worse, "candidate_dominates").when(worse & ~better, "baseline_dominates").when(better & worse, "tradeoff").otherwise("equal")
    return rows.withColumn("verdict", verdict).drop("_lost")


def case_deltas(baseline: DataFrame, candidate: DataFrame, key: str = "case_id") -> DataFrame:
    """Each case's change of quality, where both sides have one, and both states."""
    b = baseline.select(key, F.col("status").alias("baseline_status"), F.col("quality").alias("b"))
    rows = candidate.select(key, F.col("status").alias("candidate_status"), F.col("quality").alias("c")).join(b, key)
    return rows.select(key, "baseline_status", "candidate_status", (F.col("c") - F.col("b")).alias("quality_delta"))


def checked_report(report: DataFrame, claimed: DataFrame, by: list[str]) -> DataFrame:
    """What a report's summary says that its cases don't: a row for each wrong count or quality."""
    rows = suite(report, *by).join(claimed.select(*by, *[F.col(c).alias(f"claimed_{c}") for c in ("succeeded", "failed", "skipped", "quality")]), by, "full_outer")
    wrong = [F.when(~F.col(c).eqNullSafe(F.col(f"claimed_{c}")), F.lit(c)) for c in ("succeeded", "failed", "skipped")]
    wrong.append(F.when(F.coalesce(F.abs(F.col("quality") - F.col("claimed_quality")) > 1e-12, F.lit(True)), F.lit("quality")))
    return rows.select(*by, F.explode(F.array_compact(F.array(*wrong))).alias("wrong"))


def threshold_violations(thresholds: DataFrame, kinds: list[str]) -> DataFrame:
    """Kinds without a threshold, and thresholds outside [0, 1] or not finite."""
    wanted = thresholds.sparkSession.createDataFrame([(k,) for k in kinds], "kind string")
    rows = wanted.join(thresholds, "kind", "left")
    why = F.when(F.col("threshold").isNull(), "missing").when(F.isnan("threshold") | ~F.col("threshold").between(0, 1), "out_of_range")
    return rows.select("kind", why.alias("violation")).where("violation is not null")


def case_quality(components: list[Column]) -> Column:
    """Mean of those components that a case has."""
    found = F.array_compact(F.array(*components))
    return F.when(F.size(found) > 0, F.aggregate(found, F.lit(0.0), lambda a, x: a + x) / F.size(found))


def oracle_predictions(truth: DataFrame) -> DataFrame:
    """Predictions that repeat the truth; held-out cases are refused."""
    refused = F.when(F.col("partition") == "held_out", F.raise_error(F.lit("held-out truth is not for predictions")).cast("string"))
    return truth.withColumn("partition", F.coalesce(refused, "partition")).withColumn("status", F.lit("success"))
