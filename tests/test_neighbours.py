"""Neighbour regression against brute force over all pairs."""

import random

import pytest

from tessera.operators import neighbours


def brute(rows, q, most):
    labels = [y for _, y in sorted((sum((a - b) ** 2 for a, b in zip(r[:-1], q)), r[-1]) for r in rows)][:most]
    return [sum(labels[:k]) / min(k, len(labels)) for k in range(1, most + 1)]


def clusters(rnd, n):
    centres = [(rnd.uniform(-50, 50), rnd.uniform(-50, 50)) for _ in range(12)]
    return [(*(c + rnd.gauss(0, 1) for c in rnd.choice(centres)), float(rnd.randint(0, 9))) for _ in range(n)]


@pytest.mark.parametrize("kind", ["clusters", "grid", "one point"])
def test_all_k_equal_brute_force(spark, kind, monkeypatch):
    rnd = random.Random(kind)
    monkeypatch.setattr(neighbours, "QUERIES", 7)
    if kind == "clusters":
        rows = clusters(rnd, 900)
    elif kind == "grid":  # ties everywhere
        rows = [(float(rnd.randint(0, 4)), float(rnd.randint(0, 4)), float(rnd.randint(0, 3))) for _ in range(400)]
    else:  # a third of all rows alike
        rows = clusters(rnd, 200) + [(1.0, 1.0, 5.0)] * 100
    asked = [(i, *rnd.choice(rows)[:2]) for i in range(30)] + [(100, 0.5, 1000.0)]
    train = spark.createDataFrame(rows + [(None, 1.0, 1.0), (float("nan"), 1.0, 1.0), (1.0, 1.0, None)], "a double, b double, y double")
    queries = spark.createDataFrame(asked + [(200, None, 1.0)], "id int, a double, b double")
    got = {r.id: r for r in neighbours.nearest(train, queries, ["a", "b"], "y", "id", 30, pivots=16, rows_at_once=50).collect()}
    curve = {r.id: r.predictions for r in neighbours.knn_curve(train, queries, ["a", "b"], "y", "id", 30, pivots=16).collect()}
    assert set(got) == set(curve) == {q[0] for q in asked}
    for i, *q in asked:
        assert curve[i] == pytest.approx(brute(rows, q, 30), abs=1e-12), i
        assert len(got[i].labels) == 30
    if kind == "clusters":  # most cells are ruled out
        assert sum(r.compared for r in got.values()) < 0.5 * len(asked) * len(set(rows))


def test_fewer_rows_than_neighbours_and_none(spark):
    train = spark.createDataFrame([(0.0, 1.0), (1.0, 3.0)], "x double, y double")
    asked = spark.createDataFrame([("q", 0.1)], "id string, x double")
    assert neighbours.knn_curve(train, asked, ["x"], "y", "id", 4).first().predictions == [1.0, 2.0, 2.0, 2.0]
    assert neighbours.knn_predict(train, asked, ["x"], "y", "id", 2).first().prediction == 2.0
    assert neighbours.knn_curve(train.limit(0), asked, ["x"], "y", "id", 4).count() == 0
    assert neighbours.knn_curve(train, asked.limit(0), ["x"], "y", "id", 4).count() == 0


def test_best_k_over_folds(spark):
    rnd = random.Random(5)
    rows = [(i, i % 3, x := rnd.uniform(0, 10), 2 * x + rnd.gauss(0, 2)) for i in range(150)]
    df = spark.createDataFrame(rows, "id int, fold int, x double, y double")
    k, errors = neighbours.best_k(df, ["x"], "y", "id", "fold", 12)
    want = []
    for n in range(1, 13):
        total = 0.0
        for _, fold, x, y in rows:
            total += (brute([(r[2], r[3]) for r in rows if r[1] != fold], (x,), 12)[n - 1] - y) ** 2
        want.append(total / len(rows))
    assert errors == pytest.approx(want) and k == 1 + want.index(min(want)) and k > 2


def test_rows_and_queries_at_one_point_are_compared_once(spark, monkeypatch):
    rnd, routed, cut = random.Random(3), [], neighbours.cut
    rows = [(float(i % 3), float(rnd.randint(0, 10**6))) for i in range(600)]
    monkeypatch.setattr(neighbours, "cut", lambda df: routed.append(cut(df)) or routed[-1])
    got = neighbours.nearest(spark.createDataFrame(rows, "a double, y double"), spark.createDataFrame([(i, float(i % 4)) for i in range(200)], "id int, a double"), ["a"], "y", "id", 5).collect()
    assert len(got) == 200 and all(r.compared <= 15 for r in got)
    for r in got:
        want = sorted((abs(a - r.id % 4), y) for a, y in rows)[:5]
        assert r.labels == [y for _, y in want]
    assert all(df.count() <= 15 for df in routed)  # neither all rows nor all queries move
