import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import decontaminate as D


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def slow_nearest(item, text):
    """Least distance of the item to any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        row, last = [i], row
        for j, y in enumerate(text, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return min(row)


def slow_matches(text, items, similarity=0.8):
    w, out = D.words(text), {}
    for name, item in items:
        v = D.words(item)
        d = slow_nearest(v, w)
        if v and d <= D.allowed(len(v), similarity):
            out[name] = d
    return out


def test_edit_distance():
    rng = random.Random(0)
    for _ in range(400):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(n, 12))] for n in (1, 0))
        assert D._distances(a, b, False)[-1] == slow_distance(a, b)
        d, at = D.nearest(a, b)
        assert d == slow_nearest(a, b) and min(slow_distance(a, b[at:e]) for e in range(at, len(b) + 1)) == d


def test_words():
    texts = [None, "", " -- ", "It's 3 ÉTÉ, z\u3000y", "a"]
    assert [D.words(t) for t in texts] == [[], [], [], [b"it", b"s", b"3", "été".encode(), "z\u3000y".encode()], [b"a"]]
    distinct, place, begin = D.coded(pa.array(texts))
    assert [[distinct[i] for i in place[a:b]] for a, b in zip(begin, begin[1:])] == [D.words(t) for t in texts]


def test_embedding_keeps_near_texts_near():
    rng = np.random.default_rng(0)
    x = rng.integers(1, 500, (200, 40)).astype(np.int32)
    y = x.copy()
    y[:, 20] = 0
    every = list(range(80))
    same = (D.embed(x, 3, every) == D.embed(y, 3, every)).mean()
    other = (D.embed(x, 3, every) == D.embed(rng.permutation(x), 3, every)).mean()
    assert same > 0.75 and other < 0.3


def edited(rng, item, n, kinds=3):
    w = item.split()
    for _ in range(n):
        kind, at = (1 if kinds == 1 else rng.randrange(kinds)), rng.randrange(len(w))
        w[at : at + (kind != 0)] = [] if kind == 1 else ["zz%d" % rng.randrange(99)]
    return " ".join(w)


@pytest.mark.parametrize("kinds,least,most", [(3, 4, 40), (1, 6, 40), (3, 150, 220), (1, 150, 220)])
def test_matches_of_edited_passages_against_brute_force(kinds, least, most):
    rng = random.Random(7)
    vocabulary = ["w%d" % i for i in range(300)] + ["the", "of", "and"] * 40
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randrange(least, most))) for i in range(30 if most < 100 else 6)]
    index = D.Index(items)
    docs = []
    for i in range(120 if most < 100 else 40):
        item = rng.choice(items)[1]
        n = rng.randrange(0, 2 + len(item.split()) // 5) if most < 100 else len(item.split()) // 5 - rng.randrange(2)
        around = [text(rng.randrange(30)), text(rng.randrange(30))] if i % 3 else ["", ""]
        docs.append(f"{around[0]} {edited(rng, item, n, kinds).upper()}!! {around[1]}")
    docs += [text(80) for _ in range(15)] + ["", None]
    got = index.match(pa.array(docs))
    want = [slow_matches(t, items) for t in docs]
    pairs = sum(map(len, want))
    hit = sum(i in g for g, x in zip(got, want) for i in x)
    assert pairs >= 40 and hit >= 0.98 * pairs, (hit, pairs, {n: k and len(k) for n, k in index.keys.items()})
    for g, x in zip(got, want):
        assert g.keys() <= x.keys() and all(g[i][1] >= x[i] for i in g)


def test_lengths_that_keys_do_not_reach_are_searched_without(monkeypatch):
    rng = random.Random(1)
    item = " ".join("w%d" % rng.randrange(900) for _ in range(700))
    monkeypatch.setattr(D, "MOST_REPETITIONS", 3)
    index = D.Index([(1, item)])
    assert index.keys[700] is None
    doc = edited(rng, item, 139)
    assert index.match(pa.array([doc, "w1 w2 w3"])) == [{1: (700, slow_nearest(D.words(item), D.words(doc)), 0)}, {}]


@pytest.mark.parametrize("similarity", [0.4, 0.5, 1.0])
def test_other_similarities(similarity):
    rng = random.Random(3)
    text = lambda n: " ".join("w%d" % rng.randrange(60) for _ in range(n))
    items = [(i, text(10)) for i in range(5)]
    docs = [f"{text(9)} {edited(rng, rng.choice(items)[1], rng.randrange(5))} {text(9)}" for _ in range(40)]
    got, want = D.Index(items, similarity).match(pa.array(docs)), [slow_matches(t, items, similarity) for t in docs]
    assert sum(map(len, got)) >= 0.97 * sum(map(len, want)) and all(g.keys() <= x.keys() for g, x in zip(got, want))


@pytest.mark.parametrize("limit", [D.BLOCK_CHARS, 2000])
def test_documents_hold_the_verbatim_items(spark, sf, monkeypatch, limit):
    monkeypatch.setattr(D, "BLOCK_CHARS", limit)
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    items = [(r.item_id, D.words(r.text)) for r in bench.collect()]
    joined = {r.doc_id: b" ".join(D.words(r.text)) for r in docs.collect()}
    want = {(d, i) for d, t in joined.items() for i, w in items if b" " + b" ".join(w) + b" " in b" " + t + b" "}
    got = {(r.doc_id, r.item_id): r.distance for r in D.find(docs, bench).collect()}
    assert want and {k for k, d in got.items() if d == 0} == want
    kept = {r.doc_id for r in D.drop_contaminated(docs, bench).collect()}
    assert kept == set(joined) - {d for d, _ in got}


def test_nulls_repeats_and_empty(spark):
    item = "one two three four five six"
    bench = spark.createDataFrame([(2, item, 1), (1, item.title() + "?", 1), (3, None, 1), (None, "a b c d e f", 1), (4, "so short", 1), (5, "...", 1)], "item_id bigint, text string, doc_id int")
    docs = spark.createDataFrame([(1, None, 1), (None, "x ONE, two three four five six", 1), (5, "a b c d e f so short", 1), (7, "so long", 1), (6, item, 1), (6, item, 1)], "doc_id bigint, text string, item_id int")
    got = sorted((str(r.doc_id), r.item_id, r.n_words, r.distance, r.start) for r in D.find(docs, bench).collect())
    assert got == [("5", 4, 2, 0, 6), ("6", 1, 6, 0, 0), ("6", 1, 6, 0, 0), ("None", 1, 6, 0, 1)]
    assert D.find(docs.limit(0), bench).count() == 0 and D.find(docs, bench.limit(0)).count() == 0
    assert D.drop_contaminated(docs, bench.limit(0)).count() == 6 and D.drop_contaminated(docs, bench).columns == docs.columns
