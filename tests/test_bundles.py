"""Neighbours by bundles of cells: how often a vector travels, ties, and tables without rows."""

import numpy as np
import pandas as pd

from seriesloom.operators import similarity


def test_a_vector_travels_once_for_each_bundle():
    v = np.random.default_rng(8).normal(size=(300, 8))
    cells, bundle = [{"cell": c, "radius": 9.0} for c in range(12)], np.repeat([0, 1, 2], 4)
    rows = pd.DataFrame({"id": range(300), "v": list(v), "cell": np.arange(300) % 12})
    once = pd.concat(similarity._visits(rows, v[:12], cells, similarity._FixedReach(9.0), bundle))
    assert len(once) == 300 * 3 and not once.duplicated(["id", "bundle"]).any()
    ahead = pd.concat(similarity._visits(rows, v[:12], cells, similarity._FixedReach(9.0), bundle, ahead=True))
    assert len(ahead) == 100 * 3 + 100 * 2 + 100 and (ahead["bundle"] >= bundle[ahead["cell"]]).all()


def test_bundles_hold_every_cell_and_are_bounded():
    pivots = np.random.default_rng(9).normal(size=(40, 4))
    cells = [{"cell": c, "held": 1 + c % 7} for c in range(40) if c % 5]
    bundle = similarity._bundles(cells, pivots, 20)
    held = np.bincount(bundle[[c["cell"] for c in cells]], [c["held"] for c in cells])
    assert held.max() <= 20 and held.sum() == sum(c["held"] for c in cells) and (bundle[::5] == -1).all()


def test_equal_scores_go_to_the_smaller_id_across_bundles(spark, monkeypatch):
    for name, value in (("CHUNK", 8), ("SLICE", 5), ("BUNDLE", 3)):
        monkeypatch.setattr(similarity, name, value)
    ids = np.random.default_rng(10).permutation(200)
    items = spark.createDataFrame([(int(i), np.eye(4)[i % 4].tolist()) for i in ids], "id long, v array<double>").repartition(3)
    got = {(r["id"], r["rank"]): (r["other"], r["score"]) for r in similarity.top_matches(items, 3).collect()}
    alike = {i: [j for j in range(200) if j % 4 == i % 4 and j != i] for i in range(200)}
    assert got == {(i, k + 1): (alike[i][k], 1.0) for i in range(200) for k in range(3)}
    pairs = sorted((r["id"], r["other"]) for r in similarity.similar_pairs(items, 0.9).collect())
    assert pairs == [(i, j) for i in range(200) for j in alike[i] if i < j]
    assert similarity.top_matches(items.where("id < 0"), 3).count() == 0 and similarity.similar_pairs(items.where("id < 0"), 0.9).count() == 0
