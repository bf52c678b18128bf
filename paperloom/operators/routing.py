"""Routing between native text and recognition, the stump that learns it, and the experiment ledger."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identity


def stump_route(characters: Column, threshold: Column, native_if_at_least: Column) -> Column:
    """An unknown feature routes to native."""
    return F.when(characters.isNull() | ((characters >= threshold) == native_if_at_least), "native").otherwise("ocr")


def baseline_routes(characters: Column, scanned: Column, images: Column, minimum: int = 32) -> dict[str, Column]:
    enough = F.coalesce(characters >= minimum, F.lit(False))
    some = F.coalesce(characters > 0, F.lit(False))
    looks_scanned = F.coalesce(scanned >= 0.5, F.lit(False))
    native = lambda c: F.when(c, "native").otherwise("ocr")
    return {
        "always_native": F.lit("native"),
        "native_threshold": native(enough),
        "page_type_rules": native(~looks_scanned & enough),
        "profile_accurate": native(~F.coalesce(images >= 0.5, F.lit(False))),
        "profile_fast": native(some),
        "profile_balanced": native(enough),
    }


def objective(routed: DataFrame, by: list[str], failure_penalty: float = 1.0, latency_penalty: float = 0.001) -> DataFrame:
    """Mean quality, failure rate, latency if every one is known, and the objective of them."""
    latency = F.when(F.count("millis") == F.count("*"), F.avg("millis"))
    rows = routed.groupBy(*by).agg(F.count("*").alias("cases"), F.avg(F.coalesce("quality", F.lit(0.0))).alias("quality"), F.avg(F.when(F.coalesce("failed", F.lit(True)), 1.0).otherwise(0.0)).alias("failure_rate"), latency.alias("millis"))
    value = F.col("quality") - failure_penalty * F.col("failure_rate") - latency_penalty * F.coalesce(F.col("millis") / 1000.0, F.lit(0.0))
    return rows.withColumn("objective", value)


def stump_objectives(records: DataFrame, failure_penalty: float = 1.0, latency_penalty: float = 0.001) -> DataFrame:
    """The objective of every stump on the training records, without joining stumps to records.

    Records are summed by number of characters; what lies at or above a threshold is a running
    sum over those, what lies below the rest.  ``records``: characters, native_quality,
    native_failed, native_millis and the same of ocr.
    """
    measures = [f"{r}_{m}" for r in ("native", "ocr") for m in ("quality", "failed", "millis")]
    value = lambda m: F.coalesce(F.col(m).cast("double"), F.lit(1.0 if m.endswith("failed") else 0.0))
    unknown = records.where("characters is null").agg(F.count("*").alias("u_n"), *[F.sum(value(f"native_{m}")).alias(f"u_{m}") for m in ("quality", "failed", "millis")])
    sums = records.where("characters is not null").groupBy("characters").agg(F.count("*").alias("n"), *[F.sum(value(m)).alias(m) for m in measures])
    zero = sums.sparkSession.range(1).select(F.lit(0).cast("long").alias("characters"), F.lit(0).cast("long").alias("n"), *[F.lit(0.0).alias(m) for m in measures])
    sums = sums.unionByName(zero).groupBy("characters").agg(F.sum("n").alias("n"), *[F.sum(m).alias(m) for m in measures])
    # One row for each different number of characters: bounded by the longest page.
    above = Window.orderBy(F.col("characters").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = sums.select(F.col("characters").alias("threshold"), *[F.sum(m).over(above).alias(f"a_{m}") for m in measures], F.sum("n").over(above).alias("a_n"))
    total = sums.agg(F.sum("n").alias("t_n"), *[F.sum(m).alias(f"t_{m}") for m in measures])
    rows = rows.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(unknown))
    both = rows.select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("native_if_at_least"))

    def mixed(m: str) -> Column:
        high = F.when(F.col("native_if_at_least"), F.col(f"a_native_{m}")).otherwise(F.col(f"a_ocr_{m}"))
        low = F.when(F.col("native_if_at_least"), F.col(f"t_ocr_{m}") - F.col(f"a_ocr_{m}")).otherwise(F.col(f"t_native_{m}") - F.col(f"a_native_{m}"))
        return (high + low + F.coalesce(F.col(f"u_{m}"), F.lit(0.0))) / (F.col("t_n") + F.col("u_n"))

    made = mixed("quality") - failure_penalty * mixed("failed") - latency_penalty * mixed("millis") / 1000.0
    return both.select("threshold", "native_if_at_least", made.alias("objective"))


def best_stump(objectives: DataFrame) -> DataFrame:
    """Of the best the smallest threshold, and of its two the false one; rounding makes ties ties."""
    return objectives.withColumn("objective", F.round("objective", 9)).orderBy(F.col("objective").desc(), "threshold", "native_if_at_least").limit(1)


def guarded(decisions: DataFrame) -> DataFrame:
    """The model's route if it qualified, is confident, has its feature, and the planner accepts it."""
    use = F.col("qualified") & (F.col("confidence") >= F.col("floor")) & F.col("characters").isNotNull() & F.array_contains("accepted", F.col("recommended"))
    fallback = F.coalesce(F.try_element_at(F.filter("fallback", lambda e: F.array_contains(F.col("accepted"), e)), F.lit(1)), F.array_min("accepted"))
    return decisions.withColumn("route", F.when(F.coalesce(use, F.lit(False)), F.col("recommended")).otherwise(fallback)).withColumn("by", F.when(F.coalesce(use, F.lit(False)), "model").otherwise("fallback"))


def common_engine(outcomes: DataFrame) -> DataFrame:
    """Routes that have more than one engine: none may."""
    return outcomes.groupBy("route").agg(F.count_distinct("engine_id").alias("engines")).where("engines <> 1")


def family_conflicts(records: DataFrame) -> DataFrame:
    """Families that lie in more than one partition."""
    return records.groupBy("family_id").agg(F.count_distinct("partition").alias("partitions")).where("partitions > 1")


def admitted(ledger: DataFrame, by: list[str], order: list[str], budget: int) -> DataFrame:
    """Pending trials that still fit: complete and failed ones have used up their share."""
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    spent = F.count_if(F.col("status").isin("complete", "failed")).over(Window.partitionBy(*by))
    rows = ledger.withColumn("place", spent + F.count_if(F.col("status") == "pending").over(before))
    return rows.where("status = 'pending'").withColumn("admitted", F.col("place") <= budget)


def leases(events: DataFrame, by: list[str], order: list[str], capacity: int) -> DataFrame:
    """Units held after each acquisition and release, and where they exceed what there is."""
    held = F.sum("delta").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return events.withColumn("held", held).withColumn("exceeded", F.col("held") > capacity)


def partition_counts(records: DataFrame) -> DataFrame:
    """Records of each partition, and those whose feature was observed."""
    return records.groupBy("partition").agg(F.count("*").alias("records"), F.count("characters").alias("observed"))


BASELINES = ("always_native", "native_threshold", "page_type_rules", "profile_balanced")


def qualified(records: DataFrame, features: dict[str, Column], floor: float = 0.5, improvement: float = 0.001) -> tuple[DataFrame, DataFrame]:
    """The stump learnt on the training records against the baselines on the held-out ones.

    Returns each policy's evaluation, and one row that says whether the stump qualifies: it must
    have seen its feature often enough and beat the best baseline by the improvement asked for.
    """
    training, held_out = records.where("partition = 'train'"), records.where("partition = 'held_out'")
    best = best_stump(stump_objectives(training)).select(F.col("threshold").alias("best_threshold"), F.col("native_if_at_least").alias("best_side"))
    routes = baseline_routes(F.col("characters"), features["scanned"], features["images"])
    policies = [F.struct(F.lit(n).alias("policy"), routes[n].alias("route")) for n in BASELINES]
    policies.append(F.struct(F.lit("stump").alias("policy"), stump_route(F.col("characters"), F.col("best_threshold"), F.col("best_side")).alias("route")))
    # One stump, one row.
    routed = held_out.crossJoin(F.broadcast(best)).select("*", F.explode(F.array(*policies)).alias("p"))
    taken = [F.when(F.col("p.route") == "native", F.col(f"native_{m}")).otherwise(F.col(f"ocr_{m}")).alias(m) for m in ("quality", "millis")]
    failed = (F.when(F.col("p.route") == "native", F.col("native_failed")).otherwise(F.col("ocr_failed")) > 0).alias("failed")
    found = objective(routed.select("p.policy", *taken, failed), ["policy"])
    coverage = training.agg((F.count("characters") / F.count("*")).alias("confidence"))
    sides = found.agg(F.max(F.when(F.col("policy") == "stump", F.col("objective"))).alias("objective"), F.max(F.when(F.col("policy") != "stump", F.col("objective"))).alias("best_baseline"))
    low, beaten = F.col("confidence") < floor, F.col("objective") <= F.col("best_baseline") + improvement
    why = F.when(low, "training feature coverage is below the declared confidence floor").when(beaten, "model did not beat deterministic baselines on identical held-out cases")
    return found, coverage.crossJoin(F.broadcast(sides)).select("*", (~low & ~beaten).alias("qualified"), why.alias("reason"))


def outcome_violations(outcomes: DataFrame, report: DataFrame) -> DataFrame:
    """Outcomes that differ from the report they were copied from, or can't be outcomes of their case."""
    wrong = [
        F.when((F.col("outcome_case_id") != F.col("case_id")) | (F.col("engine_id") == ""), F.lit("outcome_of_other_case")),
        F.when(F.isnan("quality") | ~F.col("quality").between(0, 1), F.lit("quality_out_of_range")),
        F.when(F.col("reported").isNull(), F.lit("absent_from_report")),
        F.when(F.col("reported") != F.col("quality"), F.lit("differs_from_report")),
    ]
    rows = outcomes.join(report.select(F.col("case_id").alias("outcome_case_id"), F.col("quality").alias("reported")), "outcome_case_id", "left")
    return rows.select("case_id", F.explode(F.array_compact(F.array(*wrong))).alias("violation"))


def record_violations(records: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Cases without an identity, of one case several, or without outcomes, and features that are no probabilities."""
    again = records.groupBy("case_id").agg(F.count("*").alias("n"))
    rows = records.join(again, "case_id").join(outcomes.select("case_id").distinct().withColumn("seen", F.lit(True)), "case_id", "left")
    odd = lambda c: F.coalesce(F.isnan(c) | ~F.col(c).between(0, 1), F.lit(False))
    wrong = [F.when((F.col("case_id") == "") | (F.col("family_id") == ""), F.lit("empty_identity")), F.when(F.col("n") > 1, F.lit("duplicate_case")), F.when(F.col("seen").isNull(), F.lit("no_outcomes")), F.when(odd("image_coverage") | odd("scanned_likelihood"), F.lit("feature_out_of_range"))]
    return rows.select("case_id", F.explode(F.array_compact(F.array(*wrong))).alias("violation")).distinct()


def ledger_counts(trials: DataFrame, by: list[str], order: list[str], wall_budget: int) -> DataFrame:
    """Trials by state, and the pending ones that start before the budget of wall time is spent."""
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    pending = F.col("status") == "pending"
    spent = F.coalesce(F.sum(F.when(~pending, F.col("wall_ms"))).over(Window.partitionBy(*by)), F.lit(0.0))
    rows = trials.withColumn("spent", spent + F.coalesce(F.sum(F.when(pending, F.col("wall_ms")).otherwise(0.0)).over(before), F.lit(0.0)))
    return rows.groupBy(*by).agg(F.count_if(F.col("status") == "complete").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(pending).alias("pending"), F.count_if(pending & (F.col("spent") < wall_budget)).alias("runnable"))


def experiment_violations(trials: DataFrame, protected: DataFrame, ledger: DataFrame) -> DataFrame:
    """What an experiment must not have: trials twice, outputs over protected files, no truth or evaluator, a ledger of other trials.

    ``trials``: spec, trial_id, raw_report; ``protected``: spec, path, role; ``ledger``: spec, trial_id.
    """
    found = lambda rows, violation, at: rows.select("spec", F.lit(violation).alias("violation"), F.col(at).alias("at"))
    again = trials.groupBy("spec", "trial_id").agg(F.count("*").alias("n"))
    paths = protected.select("spec", F.col("path").alias("raw_report"))
    twice = protected.groupBy("spec", "path").agg(F.count("*").alias("n"))
    roles = trials.select("spec").distinct().join(protected.groupBy("spec").agg(F.collect_set("role").alias("roles")), "spec", "left")
    lacking = ~F.coalesce(F.array_contains("roles", "benchmark_truth") & F.arrays_overlap("roles", F.array(F.lit("metric_code"), F.lit("evaluator_binary"))), F.lit(False))
    rows = [
        found(again.where("n > 1"), "duplicate_trial", "trial_id"),
        found(trials.where(F.coalesce("trial_id", F.lit("")) == ""), "empty_trial", "trial_id"),
        found(trials.where(~identity.is_relative_path(F.col("raw_report"))), "path_not_relative", "raw_report"),
        found(trials.join(paths.distinct(), ["spec", "raw_report"], "left_semi"), "output_aliases_protected", "raw_report"),
        found(twice.where("n > 1"), "duplicate_protected_path", "path"),
        found(protected.where("role = ''"), "empty_role", "path"),
        found(roles.where(lacking), "no_truth_or_evaluator", "spec"),
        found(ledger.join(trials.select("spec", "trial_id").distinct(), ["spec", "trial_id"], "left_anti"), "no_such_trial", "trial_id"),
    ]
    return reduce(DataFrame.unionByName, rows)


def changed_artifacts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Protected files whose digest is another after a run than before, or that came or went."""
    rows = before.select("path", F.col("digest").alias("b")).join(after.select("path", F.col("digest").alias("a")), "path", "full_outer")
    return rows.where(~F.col("a").eqNullSafe(F.col("b"))).select("path")
