import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import ngram_lm as M


def slow_tokens(text):
    low = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [""]


def slow_scores(texts):
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i in texts}
    c = Counter(w for i, t in texts.items() if not held[i] for w in slow_tokens(t))
    n, v = sum(c.values()), len(c)
    out = {}
    for i, t in texts.items():
        w = slow_tokens(t)
        out[i] = (held[i], len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
    return out


def slow_interpolated(texts, held):
    """The same model with exact counts of words and pairs."""
    words, pairs = Counter(), Counter()
    for i, t in texts.items():
        if not held[i]:
            w = slow_tokens(t)
            words.update(w)
            pairs.update(zip(["", *w], w))
    n, v, out = sum(words.values()), len(words), {}
    for i, t in texts.items():
        w, told = slow_tokens(t), []
        for x, y in zip(["", *w], w):
            alone, weight = (words[y] + 0.5) / (n + 0.5 * (v + 1)), M.PAIR_WEIGHT if words[x] else 0.0
            told.append(math.log10(weight * min(1.0, pairs[x, y] / words[x] if words[x] else 0.0) + (1 - weight) * alone))
        out[i] = sum(told)
    return out


@pytest.mark.parametrize("block,part", [(M.BLOCK_BYTES, M.PART_TOKENS), (60_000, 9000)])
def test_documents_match_brute_force(spark, sf, monkeypatch, block, part):
    monkeypatch.setattr(M, "BLOCK_BYTES", block)
    monkeypatch.setattr(M, "PART_TOKENS", part)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = dict(docs.select("doc_id", "text").collect())
    want = slow_scores(texts)
    exact = slow_interpolated(texts, {i: x[0] for i, x in want.items()})
    got = {r.doc_id: r for r in M.score(docs).collect()}
    assert got.keys() == want.keys()
    for i, (held_out, n, known, total, base) in want.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held_out, n, known, total)
        assert abs(r.base_score - base) < 1e-6 * abs(base) and r.score < 0
        # a level is off by a quarter of a power of two at most, for a pair and for the word before it
        assert abs(r.score - exact[i]) < (0.16 * n if n < 50 else 0.06 * n), (i, n, r.score, exact[i])
    # pairs tell more than words alone
    assert np.mean([r.score - r.base_score for r in got.values() if r.held_out and r.n_tokens > 50]) > 0


def test_words_of_a_block():
    texts = [None, "", " ", "A  b\ta", "b", " \u00c9t\u00e9 ", "a\x1cb\x85c", "x" * 300, "  "]
    block = M.Block.of(pa.array(texts))
    names = {M.word_key(w.encode()): w for t in texts for w in slow_tokens(t)}
    told = [names[k] for k in block.keys[block.place].tolist()]
    assert [told[a : a + n] for a, n in zip(block.start, block.size)] == [slow_tokens(t) for t in texts]
    read = M.Block(*(M._of_planes(M._planes(x), x.dtype) for x in (block.keys, block.place, block.size)))
    assert (read.keys[read.before()] == np.array([M.word_key(w.encode()) for t in texts for w in ["", *slow_tokens(t)][:-1]])).all()


def test_filter_gives_back_levels():
    rng = np.random.default_rng(0)
    keys, q = rng.integers(-(2**62), 2**62, 5000), rng.integers(1, 12, 5000)
    bloom = M.Bloom(int(q.sum()))
    for level in range(1, 12):
        some = keys[q >= level]
        for place in bloom.places(some, np.full(len(some), level)):
            np.bitwise_or.at(bloom.bits, (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
    found = bloom.level(keys)
    assert (found >= q).all() and (found == q).mean() > 0.98
    assert (bloom.level(rng.integers(-(2**62), 2**62, 5000)) > 0).mean() < 0.02


def test_levels_are_logarithms_of_counts():
    assert M.levels(np.array([10.0, 14.1, 14.2, 20.0, 40.0]), 10).tolist() == [1, 1, 2, 3, 5]


def test_probabilities_sum_to_about_one():
    texts = ["the cat sat on the mat", "the dog sat on the cat"] * 20
    block = M.Block.of(pa.array(texts))
    row = {"held": [False] * 40} | {c: M._planes(x) for c, x in (("size", block.size), ("keys", block.keys), ("place", block.place))}
    part = M.Part()
    for cell in M._counted(row, 1, 40).to_pylist():
        part.add(cell)
    assert len(part.close().words) == 7 and part.n.sum() == 280
    bloom, vocabulary = part.bloom, ["the", "cat", "sat", "on", "mat", "dog"]
    for before in ("the", "sat"):
        block = M.Block.of(pa.array([f"{before} {w}" for w in vocabulary] + [before]))
        pairs, at = block.pairs(40)
        p = 10 ** M.Model(280, 7).log10(block, bloom.level(block.keys), bloom.level(M._apart(pairs)), at)
        assert 0.8 < p[block.start + 1].sum() < 1.25


def test_nulls_repeats_and_empty(spark):
    docs = spark.createDataFrame([(1, None, "x"), (None, "a", "x"), (3, "a b", "x"), (3, "a b", "x")], "doc_id bigint, text string, score string")
    got = sorted((str(r.doc_id), r.n_tokens) for r in M.score(docs).collect())
    assert got == [("1", 1), ("3", 3), ("3", 3), ("None", 2)]
    assert M.score(docs.limit(0)).count() == 0


def test_rare_pairs_count_whatever_the_size_of_the_corpus(spark, monkeypatch):
    monkeypatch.setattr(M, "PART_TOKENS", 20_000)  # several parts
    monkeypatch.setattr(M, "BLOCK_BYTES", 400_000)
    monkeypatch.setattr(M, "SPARE_BITS", 24)
    common = " ".join(["so", "it", "goes", "on"] * 500)
    rows = [(2 * i, common) for i in range(150)] + [(1001, "rare pair"), (1003, "rare pair"), (2001, "rare pair"), (2003, "pair rare")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in M.score(docs, training=docs["doc_id"] < 2000).collect()}
    assert got[2001].train_tokens > 200_000 and got[2001].n_known == 3
    # both words occur twice in more than 300,000 tokens, and the one always after the other
    assert got[2001].score - got[2001].base_score > 3 and got[2001].score > got[2003].score + 3
    assert abs(got[2001].base_score - got[2003].base_score) < 1e-9


def test_keys_and_counts_come_back_from_parts():
    rng = np.random.default_rng(0)
    keys, counts = np.unique(rng.integers(-(2**63), 2**63 - 1, 4000).view(np.uint64)).view(np.int64), rng.integers(1, 900, 4000)
    assert (M._unpacked(M._packed(keys)) == keys).all() and (M._of_planes(M._planes(counts)) == counts).all()
    at = M._bounds(keys, 5, 64)
    assert at[0] == 0 and at[-1] == 4000 and (np.diff(at) > 700).all()
    small = np.sort(rng.integers(0, 2**20, 4000)).view(np.int64)
    assert (np.diff(M._bounds(small, 5, 20)) > 700).all()
    assert len(M._unpacked(M._packed(keys[:0]))) == 0
