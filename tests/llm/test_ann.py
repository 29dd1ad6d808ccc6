import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann

BY = lambda n: F.col("vec_id") % n == 0


def brute(ids, x, asked, k=10):
    out = {}
    for i in asked:
        d = np.sqrt(((x[ids.index(i)] - x) ** 2).sum(1))
        out[i] = sorted((float(s), j) for s, j in zip(d, ids) if j != i)[:k]
    return out


def compare(got, want, least):
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert by.keys() == want.keys()
    hits = 0
    for i, found in by.items():
        assert [r.rank for r in sorted((r for r in got if r.query_id == i), key=lambda r: r.rank)] == list(range(1, len(want[i]) + 1))
        assert found == sorted(found)
        hits += len({j for _, j in found} & {j for _, j in want[i]})
    assert hits >= least * sum(map(len, want.values())), hits


def test_recall_on_the_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    data = rows.collect()
    ids, x = [r.vec_id for r in data], np.array([r.embedding for r in data], float)
    compare(ann.search(rows, BY(25)).collect(), brute(ids, x, [i for i in ids if i % 25 == 0]), 0.9)


def test_clustered_rows_search_few_parts(spark):
    rng = np.random.default_rng(1)
    x = (rng.standard_normal((40, 16)) * 4)[rng.integers(0, 40, 3000)] + rng.standard_normal((3000, 16))
    assert ann.learn(x)[2] <= 6
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    compare(ann.search(rows, BY(30), sample=2000).collect(), brute(list(range(3000)), x, range(0, 3000, 30)), 0.9)


@pytest.mark.parametrize("n,parts", [(256, 8), (300, 16), (97, 2)])
def test_parts_are_balanced(n, parts):
    x = np.random.default_rng(0).standard_normal((n, 5))
    sizes = np.bincount(ann.balanced_parts(ann.neighbour_graph(x, 6), parts), minlength=parts)
    assert len(sizes) == parts and sizes.max() - sizes.min() <= 4


def test_parts_grow_with_the_table(monkeypatch):
    assert [ann.parts_for(n) for n in (0, 10, 16 * 8192, 16 * 8192 + 1, 10**6, 10**9)] == [16, 16, 16, 32, 128, 512]
    rng = np.random.default_rng(4)
    monkeypatch.setattr(ann, "PART_ROWS", 256)
    shares = []
    for n in (2000, 32_000):  # the more rows, the smaller a share of them is searched
        x = (rng.standard_normal((60, 16)) * 4)[rng.integers(0, 60, n)] + rng.standard_normal((n, 16))
        _, parts, probes = ann.learn(x[: max(1024, 32 * ann.parts_for(n))], ann.parts_for(n))
        shares.append(probes / parts)
    assert shares[1] < shares[0] < 0.5


def test_very_large_components(spark):
    rows = spark.createDataFrame([(0, [1e200, 0.0]), (1, [1e200, 3e199]), (2, [-1e200, 0.0])], "vec_id bigint, embedding array<double>")
    got = [(r.vec_id, r.score) for r in sorted(ann.search(rows, BY(100)).collect(), key=lambda r: r.rank)]
    assert [i for i, _ in got] == [1, 2] and abs(got[0][1] / 3e199 - 1) < 1e-9 and abs(got[1][1] / 2e200 - 1) < 1e-9


def test_blocks_do_not_change_results(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.standard_normal((150, 4)), np.ones((150, 4))])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    want = brute(list(range(300)), x, range(0, 300, 10))
    monkeypatch.setattr(ann, "ROW_BLOCK", 20)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 3)
    got = ann.search(rows, BY(10), recall=2).collect()
    compare(got, want, 1.0)


def test_left_out_rows_ties_and_few_candidates(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [1.0, None]), (7, [inf, 0.0]), (None, [1.0, 1.0]), (8, []), (9, [1.0, 2.0, 3.0]), (100, [0.0, 3.0]), (100, [0.0, 3.0])]
    got = ann.search(spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<double>, score string"), BY(100)).collect()
    told = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in got)
    assert told[:5] == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (0, 3, 2, 0.0), (0, 4, 100, 3.162278), (0, 5, 100, 3.162278)]
    assert [(q, v) for q, _, v, _ in told[5:]] == [(100, 0), (100, 1), (100, 2), (100, 2)]
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<double>")
    assert ann.search(empty, BY(100)).count() == 0
