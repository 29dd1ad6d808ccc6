import re
from collections import Counter

import pytest
import xxhash

from tessera.llm import simhash


def slow_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_components(prints):
    ids = list(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one TWO", "a b c", "a b c d e É", "x " * 70_000])
def test_fingerprint_of_a_text(text):
    assert simhash.text_fingerprint(text) == slow_print(text)


@pytest.mark.parametrize("bound", [simhash.LIST_BOUND, 8])
def test_documents_match_brute_force(spark, sf, bound):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    prints = {r.doc_id: slow_print(r.text) for r in docs.collect()}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs, bound).collect()}
    roots = slow_components(prints)
    assert got == {i: (f"{prints[i]:016x}", roots[i]) for i in prints}


@pytest.mark.parametrize("bound", [1024, 8])
def test_dense_cluster_at_every_level_of_the_index(spark, bound):
    import random

    rng = random.Random(3)
    centre = rng.getrandbits(64)
    values = {centre}
    for _ in range(60):
        x = centre
        for b in rng.sample(range(24), rng.randint(1, 5)):
            x ^= 1 << b
        values.add(x)
    values |= {rng.getrandbits(64) for _ in range(40)}
    signed = [x - (1 << 64) if x >> 63 else x for x in sorted(values)]
    frame = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    roots = {r.node: r.root for r in simhash.components(simhash.links(frame, bound)).collect()}
    want = slow_components({x: x & (2**64 - 1) for x in signed})
    assert {x: roots.get(x, x) for x in signed} == want


def test_long_chain_of_links(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "u bigint, v bigint")
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    assert roots == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_nulls_repeats_clashing_columns_and_empty_tables(spark):
    schema = "doc_id bigint, text string, fp string, component_id string, k int"
    rows = [(5, None, "x", "y", 1), (3, "", "x", "y", 1), (7, "a b c d", "x", "y", 1), (7, "a b c d", "x", "y", 1), (None, "a b c d", "x", "y", 1), (None, "zz yy xx ww", "x", "y", 1)]
    docs = spark.createDataFrame(rows, schema)
    got = Counter((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == Counter({(5, 3): 1, (3, 3): 1, (7, 7): 2, (None, 7): 1, (None, None): 1})
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_a_bound_that_would_lose_links_is_refused(spark):
    frame = spark.createDataFrame([(x,) for x in range(64)], "fp bigint")
    with pytest.raises(ValueError):
        simhash.links(frame, 4)


def test_a_star_of_many_edges(spark):
    edges = spark.createDataFrame([(i, 5000) for i in range(1, 400)] + [(5000, 0), (9000, 9001)], "u bigint, v bigint")
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    assert roots == {i: 0 for i in range(400)} | {5000: 0, 9000: 9000, 9001: 9000}
