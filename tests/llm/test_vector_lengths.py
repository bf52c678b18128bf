"""Vectors of several lengths in one table: each length is compared with its own."""

import numpy as np

from paperloom.llm import vectors


def test_every_length_links_among_its_own(spark):
    rng = np.random.default_rng(6)
    rows = []
    for dim in (1, 2, 3, 5, 16):
        base = rng.normal(size=(12, dim))
        rows += [(v + rng.normal(scale=0.15, size=dim)).astype(np.float32) for v in base for _ in range(3)]
    table = [(i, v.tolist()) for i, v in enumerate(rows)] + [(900, [float("nan")] * 20), (901, []), (902, None)]
    units = [v.astype(float) / np.sqrt((v.astype(float) ** 2).sum()) for v in rows]
    links = {i: sum(i != j and len(a) == len(b) and (a * b).sum() >= 0.9 for j, b in enumerate(units)) for i, a in enumerate(units)}
    found = vectors.near_duplicates(spark.createDataFrame(table, "vec_id long, embedding array<float>"), 0.9).collect()
    assert {r.vec_id: r.n_links for r in found} == links | {900: 0, 901: 0, 902: 0} and sum(links.values()) > 60


def test_doubles_repeated_ids_and_a_large_near_group(spark):
    rng = np.random.default_rng(7)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(200, 24)))]
    centre = rng.normal(size=24)
    rows += [(1000 + i, (centre + rng.normal(size=24) * 0.2).tolist()) for i in range(900)]
    # Cosine 0.9 by a hair only in double precision; the same vec_id twice; no vec_id.
    near = np.zeros((2, 24))
    near[0, 0], near[1, :2] = 1.0, (0.9 + 1e-12, np.sqrt(1 - (0.9 + 1e-12) ** 2))
    rows += [(3000, near[0].tolist()), (3001, near[1].tolist()), (5, (centre * 2).tolist()), (None, centre.tolist())]
    rng.shuffle(rows)
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, node string").repartition(5)
    units = np.array([v for i, v in rows if i is not None])
    ids = np.array([i for i, _ in rows if i is not None])
    units /= np.sqrt((units * units).sum(axis=1, keepdims=True))
    links = (units @ units.T >= 0.9) & ~np.eye(len(ids), dtype=bool)
    expected = sorted((int(i), int(n)) for i, n in zip(ids, links.sum(axis=1)))
    for part in (vectors.PART, 100 * 24):
        found = vectors.near_duplicates(table, 0.9, part=part).collect()
        assert sorted((r.vec_id, r.n_links) for r in found if r.vec_id is not None) == expected
        assert [(r.n_links, r.component_id, r.kept) for r in found if r.vec_id is None] == [(0, None, True)]
        assert {r.component_id for r in found if r.vec_id is not None and r.vec_id >= 1000 and r.n_links > 100} == {5}
    assert dict(expected)[3000] == 1
