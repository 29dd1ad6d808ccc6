import zlib
from collections import Counter

import numpy as np

from tessera.llm import queries


def test_op3_places_every_row_in_even_shards_without_gaps(spark, sf):
    rows = queries.op3_hypergeometric_sharding(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    raw = lambda d: (d.text or "").encode()
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in rows) == sorted((d.doc_id, len(raw(d)) + 8, zlib.crc32(raw(d))) for d in docs)
    assert all(r.law == "rows" and r.grown_shard is None for r in rows)
    held = Counter(r.shard for r in rows)
    counts = [held[s] for s in range(24)]
    assert set(held) <= set(range(24)) and max(counts) - min(counts) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(held[s])) for s in held)


def test_op4_asks_the_hundredth_rows_and_finds_the_nearest(spark, sf):
    rows = queries.op4_learned_partition_ann(spark, sf).collect()
    table = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in table]), np.array([r.embedding for r in table], np.float64)
    asked = {int(i) for i in ids if i % 100 == 0}
    assert {r.query_id for r in rows} == asked and len(rows) == 10 * len(asked)
    met = 0
    for q in asked:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        want = [int(ids[i]) for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        mine = sorted((r for r in rows if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11))
        assert all(abs(r.score - d[ids == r.vec_id][0]) < 1e-9 for r in mine)
        met += len(set(want) & {r.vec_id for r in mine})
    assert met >= 0.9 * 10 * len(asked)
