"""Hard negatives against a loop over all rows, and the coordinate ranges against all cosines."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank string, anchor boolean, v int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, "clash", "clash", False, 1) for i, v, label in rows], SCHEMA).repartition(3)


def plain(rows, is_anchor, positives=5, most=10):
    fit = [
        (i, label, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, label in rows
        if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for i, label, v in {(i, label, tuple(v)) for i, label, v in fit if is_anchor(i)}:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in fit if j != i and len(w) == len(v))
        for ps, j, _ in [x for x in scored if x[2] == label][:positives]:
            near = [x for x in scored if x[2] != label and 30 * -ps <= 100 * -x[0] <= 90 * -ps][:most]
            out += [(i, j, rank, n, -ps, -s) for rank, (s, n, _) in enumerate(near, 1)]
    return sorted(out)


def same(spark, rows, every=10):
    got = negatives.hard_negatives(table(spark, rows), F.col("vec_id") % every == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == plain(rows, lambda i: i % every == 0)


def vectors(rng, n, dim, centres=8, spread=0.2):
    mid = rng.normal(size=(centres, dim))
    return (mid[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, dim))) * rng.choice([0.3, 1, 4], (n, 1))


def test_nulls_lengths_ties_and_repeated_rows(spark):
    r, rng = random.Random(3), np.random.default_rng(3)
    rows = [(i, [float(x) for x in v], r.choice([0, 1, 2])) for i, v in enumerate(vectors(rng, 150, 6))]
    rows += [(200 + i, list(rows[r.randrange(60)][1]), r.choice([0, 1])) for i in range(40)]  # copies: ties
    rows += [rows[10], rows[20], (10, rows[11][1], 0), (10, rows[12][1], 1)]  # repeated anchors, and two of one id
    rows += [(300, None, 1), (310, [], 1), (320, [1.0, None, 1.0], 1), (330, [float("nan")] * 6, 1), (340, [float("inf")] * 6, 0)]
    rows += [(350, [0.0] * 6, 0), (360, [1.0, 2.0], 0), (361, [1.0, 2.5], 0), (362, [0.6, 0.9], 1), (370, [1.0] * 6, None), (None, [1.0] * 6, 1)]
    same(spark, rows)


def test_rounds_tiles_and_buckets_lose_nothing(spark, monkeypatch):
    for name, value in (("SEED", 32), ("STEP", 2), ("TILE", 64)):
        monkeypatch.setattr(negatives, name, value)
    rng = np.random.default_rng(4)
    labels = np.where(rng.random(700) < 0.4, 0, rng.integers(1, 6, 700))
    rows = [(i, [float(x) for x in v], int(label)) for i, (v, label) in enumerate(zip(vectors(rng, 700, 5), labels))]
    same(spark, rows, every=3)


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in v], i % 2) for i, v in enumerate(rng.normal(size=(60, 4)) * 2.0**21)]
    same(spark, rows)
    huge = [(i, [float(s) * 3e38, 1.0], i % 2) for i, s in enumerate(rng.choice([-1, 1], 30))]
    assert negatives.hard_negatives(table(spark, huge), F.col("vec_id") % 10 == 0).count() >= 0


def test_empty_tables(spark):
    assert negatives.hard_negatives(table(spark, []), F.lit(True)).collect() == []
    assert negatives.hard_negatives(table(spark, [(1, [1.0], 0)]), F.lit(True)).collect() == []


@pytest.mark.parametrize("spread, dim", [(0.05, 6), (0.3, 12), (1.0, 3)])
def test_candidates_hold_all_that_reach_the_score(spread, dim):
    rng = np.random.default_rng(6)
    x, q = vectors(rng, 900, dim, spread=spread), vectors(rng, 60, dim, spread=spread)
    s = q @ x.T
    least = np.sort(s, 1)[:, -8] * rng.choice([1.0, 0.999, -1.0], 60)
    seen = {}
    for some, rows in negatives.candidates(x, q, least):
        for a in some:
            seen[int(a)] = set(rows.tolist())
    for a in range(60):
        assert set(np.flatnonzero(s[a] >= least[a]).tolist()) <= seen.get(a, set())


def test_ranges_rule_out_most_rows_of_clustered_vectors():
    x = vectors(np.random.default_rng(7), 900, 6, centres=30, spread=0.05)
    x /= np.sqrt((x * x).sum(1))[:, None]
    least = np.sort(x[:60] @ x.T, 1)[:, -8]
    assert sum(len(some) * len(rows) for some, rows in negatives.candidates(x, x[:60], least)) < 0.1 * 60 * 900
