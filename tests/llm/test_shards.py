import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import shards as S


def test_matrix_has_its_margins_and_is_fair():
    counts, sizes = np.array([5, 0, 17, 3, 9]), np.array([10, 10, 7, 7])
    seen = []
    for seed in range(400):
        matrix = np.array([S.matrix_row(counts, sizes, i, seed) for i in range(5)])
        assert (matrix.sum(0) == sizes).all() and (matrix.sum(1) == counts).all() and (matrix >= 0).all()
        seen.append(matrix)
    mean = np.mean(seen, axis=0)
    assert np.abs(mean - np.outer(counts, sizes) / 34).max() < 0.35
    want = 17 * (10 / 34) * (24 / 34) * (17 / 33)  # variance of a hypergeometric entry
    assert abs(np.var([m[2, 0] for m in seen]) - want) < 0.5


def test_draw_beyond_the_limit_of_numpy():
    rng = np.random.default_rng(0)
    good, bad, n = 3 * 10**9, 5 * 10**9, 10**6
    x = np.array([S._draw(rng, good, bad, n) for _ in range(600)])
    mean, sd = n * 3 / 8, (n * 3 / 8 * 5 / 8) ** 0.5
    assert abs(x.mean() - mean) < sd / 4 and 0.85 < x.std() / sd < 1.15
    split = S._split(rng, np.array([2 * 10**9, 10**9, 0]), 10**9)
    assert split.sum() == 10**9 and split[2] == 0 and abs(split[0] / 10**9 - 2 / 3) < 1e-3


@pytest.mark.parametrize("bins", [{}, {"bin_rows": 3}, {"bin_bytes": 5000}])
def test_exact_sizes_and_gapless_slots(spark, sf, bins):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(5)
    placed = S.shuffle(docs, **bins)
    assert placed.columns == [*docs.columns, "shard", "slot"]
    assert sorted(map(tuple, placed.drop("shard", "slot").collect())) == sorted(map(tuple, docs.collect()))
    rows = S.summary(placed).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    by = [[r.slot for r in rows if r.shard == s] for s in range(24)]
    assert all(sorted(x) == list(range(len(x))) for x in by) and max(map(len, by)) - min(map(len, by)) <= 1
    assert all((r.size, r.text_crc32) == (len(b := texts[r.doc_id].encode()) + 8, zlib.crc32(b)) for r in rows)


def test_shuffle_is_repeatable_and_uniform(spark):
    docs = spark.range(4800).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    one, two, other = (sorted(map(tuple, S.summary(S.shuffle(docs, seed=s)).collect())) for s in (1, 1, 2))
    assert one == two != other
    halves = np.zeros(24)
    for doc_id, _, _, shard, _ in one:
        halves[shard] += doc_id < 2400
    assert ((halves - 100) ** 2 / 50).sum() < 60  # chi square with 23 degrees of freedom
    slots = np.array([s for i, _, _, _, s in one if i < 2400])
    assert abs(slots.mean() - 99.5) < 6


def test_nulls_repeats_clashes_and_empty(spark):
    docs = spark.createDataFrame([(1, None, 9), (None, "é", 9), (2, "", 9), (2, "", 9)], "doc_id bigint, text string, shard int")
    got = S.summary(S.shuffle(docs, shards=2)).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == [("1", 8, 0), ("2", 8, 0), ("2", 8, 0), ("None", 10, zlib.crc32("é".encode()))]
    assert sorted((r.shard, r.slot) for r in got) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert S.shuffle(docs.limit(0)).count() == 0


def test_shards_are_written_in_slot_order(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    S.write(docs, f"{tmp_path}/out", shards=4)
    back = spark.read.parquet(f"{tmp_path}/out").orderBy("shard", "slot").collect()
    assert sorted(r.text for r in back) == sorted(r.text for r in docs.collect()) and {r.shard for r in back} == {0, 1, 2, 3}


def test_files_hold_bins_in_slot_order(spark, tmp_path):
    import pyarrow.parquet as pq

    df = spark.createDataFrame([(i, "x" * (i % 50)) for i in range(1000)], "doc_id bigint, text string").repartition(5)
    S.write(df, f"{tmp_path}/out", shards=3, bin_rows=60)
    back, sizes = [], []
    for shard in range(3):
        files = [pq.ParquetFile(f).read() for f in sorted((tmp_path / "out" / f"shard={shard}").glob("*.parquet"))]
        slots = [f.column("slot").to_pylist() for f in files]
        assert all(s == list(range(s[0], s[0] + len(s))) for s in slots) and sorted(x for s in slots for x in s) == list(range(333 + (shard < 1)))
        sizes += map(len, slots)
        back += [i for f in files for i in f.column("doc_id").to_pylist()]
    assert sorted(back) == list(range(1000)) and max(sizes) <= 60 and len(sizes) == 18
    S.write(df.limit(0), f"{tmp_path}/none", shards=3)
