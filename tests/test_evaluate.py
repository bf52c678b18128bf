"""Scores, matching and comparison on small cases."""

import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom.functions import geometry, text
from paperloom.operators import evaluate


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_word_distance(spark):
    rng = random.Random(1)
    pairs = [([rng.choice("abc") for _ in range(rng.randrange(7))], [rng.choice("abc") for _ in range(rng.randrange(7))]) for _ in range(60)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<string>, b array<string>")
    found = {r.i: r.d for r in rows.select("i", text.distance_of_lists(F.col("a"), F.col("b")).alias("d")).collect()}
    assert found == {i: edit_distance(a, b) for i, (a, b) in enumerate(pairs)}


@given(st.sets(st.tuples(st.integers(0, 5), st.integers(0, 5)), max_size=14))
@settings(max_examples=150, deadline=None)
def test_matching_is_largest(edges):
    pairs = sorted(((t, p, round(1 / (1 + (t * 7 + p * 3) % 5), 3)) for t, p in edges), key=lambda r: (r[0], -r[2], r[1]))
    found = evaluate.matching(pairs)
    assert len({t for t, _, _ in found}) == len(found) == len({p for _, p, _ in found})
    assert all((t, p) in edges for t, p, _ in found)
    most = next((k for k in range(min(len(edges), 6), 0, -1) for c in itertools.combinations(edges, k) if len({t for t, _ in c}) == k == len({p for _, p in c})), 0)
    assert len(found) == most


def test_two_truths_and_one_prediction_match_once(spark):
    pairs = spark.createDataFrame([(1, 0, 0, 0.9), (1, 1, 0, 0.8), (2, 0, 0, 0.6), (2, 0, 1, 0.7), (2, 1, 1, 0.9)], "case_id long, truth_idx int, pred_idx int, iou double")
    found = [tuple(r) for r in evaluate.assignment(pairs).orderBy("case_id", "truth_idx").collect()]
    assert found == [(1, 0, 0, 0.9), (2, 0, 0, 0.6), (2, 1, 1, 0.9)]


def test_unknown_is_not_zero(spark):
    rows = spark.createDataFrame([("a", 1), ("a", None), ("b", 2), ("b", 3)], "k string, v long")
    found = {r.k: (r.m, r.s) for r in rows.groupBy("k").agg(evaluate.known_max(F.col("v")).alias("m"), evaluate.known_sum(F.col("v")).alias("s")).collect()}
    assert found == {"a": (None, None), "b": (3, 5)}


def test_skipped_cases_are_left_out(spark):
    rows = spark.createDataFrame([("success", 0.5), ("failure", 0.0), ("skipped", None)], "status string, quality double")
    got = evaluate.suite(rows).head()
    assert (got.cases, got.quality, got.failure_rate) == (3, 0.25, 0.5)
    assert evaluate.suite(rows.where("status = 'skipped'")).head().quality == 0.0


def test_comparison_verdicts(spark):
    reports = lambda rows: spark.createDataFrame(rows, "k string, quality double, cost double")
    base = reports([("a", 0.5, 3.0), ("b", 0.5, 3.0), ("c", 0.5, None), ("d", 0.5, 3.0), ("e", 0.5, 3.0)])
    new = reports([("a", 0.6, 3.0), ("b", 0.6, 4.0), ("c", 0.9, 1.0), ("d", 0.5, 3.0), ("e", 0.5, 5.0)])
    found = {r.k: r.verdict for r in evaluate.compared(base, new, {"quality": 0.0, "cost": 0.0}, "k").collect()}
    assert found == {"a": "candidate_dominates", "b": "tradeoff", "c": "indeterminate", "d": "equal", "e": "baseline_dominates"}
    lost = spark.createDataFrame([("a",)], "k string")
    assert evaluate.compared(base, new, {"quality": 0.0}, "k", lost).where("k = 'a'").head().verdict == "tradeoff"  # better, but a success is left out
    equal = spark.createDataFrame([("e", 0.5)], "k string, quality double")
    assert evaluate.compared(equal, equal, {"quality": 0.0}, "k", equal).head().verdict == "baseline_dominates"


def test_held_out_truth_makes_no_predictions(spark):
    rows = spark.createDataFrame([("c", "held_out")], "case_id string, partition string")
    with pytest.raises(Exception, match="held-out"):
        evaluate.oracle_predictions(rows).collect()


boxes = st.tuples(*[st.integers(0, 30)] * 2, *[st.integers(1, 20)] * 2)


def test_rectangles(spark):
    rng = random.Random(9)
    made = [tuple(rng.randrange(30) for _ in range(2)) + tuple(rng.randrange(1, 20) for _ in range(2)) for _ in range(80)]
    rows = spark.createDataFrame([(*a, *b) for a, b in zip(made, made[::-1], strict=True)], "a int, b int, c int, d int, e int, f int, g int, h int")
    left, right = geometry.rect(*[F.col(c) for c in "abcd"]), geometry.rect(*[F.col(c) for c in "efgh"])
    got = rows.select("*", geometry.iou(left, right).alias("x"), geometry.iou(right, left).alias("y"), geometry.contains(geometry.expanded(left, F.lit(1)), left).alias("z"), geometry.iou(left, left).alias("w")).collect()
    for r in got:
        cells = lambda x, y, w, h: {(i, j) for i in range(x, x + w) for j in range(y, y + h)}
        p, q = cells(r.a, r.b, r.c, r.d), cells(r.e, r.f, r.g, r.h)
        assert abs(r.x - len(p & q) / len(p | q)) < 1e-12 and r.x == r.y and r.z and r.w == 1.0
