import base64
import random
import zlib
from collections import Counter

import numpy as np

from tessera.llm import langid as L


def test_held_out_accuracy_and_folds(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = L.fit(docs)
    truth = {r.doc_id: (r.lang, r.text) for r in docs.collect()}
    got = {r.doc_id: r for r in L.identify(docs, model).collect()}
    assert got.keys() == truth.keys()
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    right = np.mean([got[i].lang_pred == truth[i][0] for i in held if L.has_letter(truth[i][1])])
    assert right >= 0.97, right
    assert sum(r.rejected for r in got.values()) <= 0.01 * len(got)
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = {r.doc_id for r in L.keep_identified(docs, model).collect()}
    assert kept == {i for i, r in got.items() if not r.rejected}


PYTHON = """import os, sys
def walk(root, depth=0):
    for name in sorted(os.listdir(root)):
        path = os.path.join(root, name)
        if os.path.isdir(path): walk(path, depth + 1)
        else: print("%s%s" % (" " * depth, name), file=sys.stderr)
if __name__ == "__main__": walk(sys.argv[1])
"""
C = """static int cmp(const void *a, const void *b) { return *(int *)a - *(int *)b; }
int main(int argc, char **argv) { int n = atoi(argv[1]), *x = malloc(n * sizeof(int)); for (int i = 0; i < n; i++) x[i] = rand() % n; qsort(x, n, sizeof *x, cmp); return x[0]; }"""


def test_what_is_no_learned_language_is_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = L.fit(docs)
    rng = random.Random(11)
    alphabet = lambda chars, n=300: "".join(rng.choice(chars) + (" " if rng.random() < 0.2 else "") for _ in range(n))
    foreign = ["Съешь же ещё этих мягких французских булок, да выпей чаю", "いろはにほへと ちりぬるを わかよたれそ つねならむ", "Η γρήγορη αλεπού πηδάει πάνω από το τεμπέλικο σκυλί", "السلام عليكم ورحمة الله وبركاته", "天地玄黃宇宙洪荒日月盈昃辰宿列張"]
    others = [*foreign, *(t * 20 for t in foreign), PYTHON, C, PYTHON * 5, C * 5]
    others += [alphabet("bcdfghjklmnpqrstvwxz") for _ in range(40)] + [alphabet("abcdefghijklmnopqrstuvwxyz") for _ in range(40)]
    others += [base64.b64encode(rng.randbytes(300)).decode() for _ in range(40)] + [rng.randbytes(200).hex() for _ in range(20)]
    rejected = [model.kept(t) is None for t in others]
    assert np.mean(rejected) >= 0.95, [o[:30] for o, r in zip(others, rejected) if not r]
    for t in foreign:
        assert model.kept(t) is None, t


def test_the_sample_is_bounded_in_rows_and_all_labels_are_learned(spark, monkeypatch):
    monkeypatch.setattr(L, "PER_LANG", 30)
    seen = []
    monkeypatch.setattr(L, "train", lambda rows: seen.append(rows))
    docs = spark.createDataFrame([(7, "the same text", "en")] * 3000 + [(None, f"der text {i}", "de") for i in range(50)] + [(8, "und so", "und")], "doc_id bigint, text string, lang string")
    L.fit(docs, fold=None)
    count = Counter(r[0] for r in seen[0])
    assert count["en"] == 30 and count["de"] == 30 and count["und"] == 61


def test_scores_do_not_depend_on_pieces(monkeypatch):
    rng = np.random.default_rng(0)
    model = L.Model(["a", "b"], rng.standard_normal((L.BUCKETS, 3)).astype(np.float32), np.zeros(3), 0.1)
    text = "some words, ünd môre " * 50
    whole = model.predict(text)
    monkeypatch.setattr(L, "_PIECE", 64)
    again = model.predict(text)
    assert whole[0] == again[0] and abs(whole[1] - again[1]) < 1e-6


def test_nulls_no_letters_clashes_and_empty(spark):
    rows = [(i, w * 30, l, "x") for i, (w, l) in enumerate([("the of and ", "en"), ("der und die ", "de")] * 20)]
    rows += [(100, None, "en", "x"), (101, "12 34 !?", None, "x"), (102, "", "de", "x"), (104, "½ ² 3", "de", "x"), (None, "the and", None, "x"), (103, "the", None, "x"), (103, "the", None, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, lang_pred string")
    model = L.fit(docs)
    assert model.langs == ["de", "en"]
    got = [(r.doc_id, r.lang_pred, r.rejected) for r in L.identify(docs, model).collect()]
    by = {g[0]: g for g in got}
    assert len(got) == len(rows)
    assert all(by[i][1:] == ("und", True) for i in (100, 101, 102, 104))
    assert by[None][1] == "en" and by[103][1] == "en"
    assert L.identify(docs.limit(0), model).count() == 0
    nothing = L.fit(docs.limit(0))
    assert L.identify(docs.filter("doc_id = 103"), nothing).first().lang_pred == "und"
    kept = L.keep_identified(docs.withColumnRenamed("lang_pred", "told"), model)
    assert kept.columns == ["doc_id", "text", "lang", "told"] and {r.lang for r in kept.filter("doc_id is null").collect()} == {"en"}
