import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from tessera.llm import importance, queries
from tessera.llm.common import lower_words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def runs(text, longest):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute(docs, wanted, longest=1, buckets=10_000, seed="2024", percent=10, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in runs(x, longest)) for texts in ([d[1] for d in docs], wanted))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    rows = []
    for key, text in docs:
        f = runs(text, longest)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append((key, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text))))
    fits = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[2], r[1]))
    most = len(fits) * percent // 100
    drawn = Counter()
    ranks = {}
    for n, r in enumerate(fits[:most], 1):
        ranks.setdefault(r, []).append(n)
    out = []
    for r in rows:
        left = ranks.get(r, [])
        out.append((*r[:4], left[drawn[r]] if drawn[r] < len(left) else None))
        drawn[r] += 1
    return out


def plain(rows):
    return sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in rows), key=repr)


def test_words_of_slices():
    texts = [None, "", "Don't STOP", "ab", "cd", "Éa-ß9 　x_y", "\x7fZ\x80"]
    distinct, place, starts = lower_words(pa.array(texts))
    got = [[distinct[int(i)].as_py().decode() for i in place[a:b]] for a, b in zip(starts, starts[1:])]
    assert got == [words(t) for t in texts]


@pytest.mark.parametrize("longest", [1, 3])
@pytest.mark.parametrize("nodes", [importance.MOST_NODES, 5])
def test_random_texts_equal_brute_force(spark, longest, nodes, monkeypatch):
    monkeypatch.setattr(importance, "MOST_NODES", nodes)
    monkeypatch.setattr(importance, "SLICE", 500)
    rnd = random.Random(longest)
    vocabulary = ["alpha", "Beta", "γ", "d9", "e", "don't", "été", "x" * 50]
    docs = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 60)))) for i in range(120)]
    docs += [(500, None), (501, ""), (None, "alpha " * 30), (502, "beta " * 40), (502, "beta " * 40), (503, "!!! ...")]
    wanted = ["alpha beta", "alpha alpha", None, ""]
    d = spark.createDataFrame([(k, x, "clash", 7) for k, x in docs], "doc_id bigint, text string, score string, rank int").repartition(3)
    t = spark.createDataFrame([(x,) for x in wanted], "text string")
    got = importance.resample(d, t, longest, buckets=50, percent=30)
    assert plain(got.collect()) == plain(dict(zip(("doc_id", "n_features", "weight", "score", "rank"), r)) for r in brute(docs, wanted, longest, 50, percent=30))


def test_trie_carries_the_checksum_of_a_run():
    trie = importance.Trie()
    distinct, place, starts = lower_words(pa.array(["the quick brown", "the quick", None]))
    for length, (nodes, text) in enumerate(trie.walk(distinct.to_pylist(), place, starts, 3), 1):
        names = [" ".join(w[i : i + length]) for w in (["the", "quick", "brown"], ["the", "quick"]) for i in range(len(w) - length + 1)]
        assert [trie.state[n] for n in nodes] == [zlib.crc32(n.encode()) for n in names]
    assert len(trie.state) == 1 + 3 + 2 + 1  # the two texts share paths


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    some = spark.createDataFrame([(1, "a b " * 20)], "doc_id bigint, text string")
    assert importance.resample(none, some).count() == 0
    r = importance.resample(some, none).first()
    assert r.n_features == 40 and r["rank"] is None
    assert importance.resample(some, none, percent=100).first()["rank"] == 1


def test_a_very_long_text(spark):
    text = "Lorem ipsum " * 300_000
    docs = [(1, text), (2, "ipsum " * 25)]
    got = importance.resample(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([("ipsum",)], "text string"), percent=100)
    assert plain(got.collect()) == plain(dict(zip(("doc_id", "n_features", "weight", "score", "rank"), r)) for r in brute(docs, ["ipsum"], percent=100))


def test_the_registered_query(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    wanted = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = queries.op11_importance_resampling(spark, sf)
    assert got.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    assert plain(got.collect()) == plain(dict(zip(got.columns, r)) for r in brute(docs, wanted))
