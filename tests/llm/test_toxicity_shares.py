"""Toxicity where the bounded sample takes more of one class than of the other."""

import numpy as np

from paperloom.llm import toxicity


def test_scores_stand_for_all_labelled_documents(spark):
    docs = spark.createDataFrame([(i, "") for i in range(4000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 20 == 0)) for i in range(4000)], "doc_id long, toxic int")
    odds = lambda **bounds: np.log(1 / (1 / toxicity.scores(docs.limit(1), toxicity.train(docs, labels, **bounds)).head().score - 1))
    truth = np.log(1 / 19)
    assert abs(odds() - truth) < 0.7
    assert abs(odds(positives=200, negatives=200) - truth) < 0.7
    assert abs(odds(positives=50, negatives=3800) - truth) < 0.7


def test_long_texts_are_bounded_by_features(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join([*rng.choice(["sun", "rain", "wind", "sea"], 40), *["vile"] * (i % 3 == 0)]), int(i % 3 == 0)) for i in range(90)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, most_features=2_500, l1=0.5)
    scores = {r.doc_id: r.score for r in toxicity.scores(docs, model).collect()}
    assert min(scores[i] for i, _, y in rows if y) > max(scores[i] for i, _, y in rows if not y)
    assert toxicity.train(docs, labels, most_features=0).bias == 0.0
