import random
import re

import pyarrow as pa
import pytest

from tessera.llm import licenses as L
from tessera.llm import queries
from tessera.llm.license_templates import PHRASES, TEMPLATES, Template


def brute(text):
    """Counts and labels by regular expressions over the words joined by spaces."""
    w = L.words_of(text or "")
    joined = "".join(f" {x}" for x in w)
    places = sorted((i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
    base = {label for _, label in places}
    sure = {x for t in TEMPLATES if re.search(f"(?:{L.expression(L.parse(t.markup))})(?: |$)", joined) for x in (t.label, t.family) if x}
    starts, labels = [i for i, _ in places], sorted(base | sure)
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(labels), len(sure) / len(labels) if labels else 0.0


COLUMNS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def filled(rnd, parts):
    """A text that a template accepts."""
    out = []
    for p in parts:
        if isinstance(p, str):
            out.append(rnd.choice([p, p.upper(), p.title()]))
        elif isinstance(p, L.Gap):
            out += ["w%d" % rnd.randrange(9) for _ in range(rnd.randint(p.least, 12 if p.most is None else p.most))]
        else:
            out += filled(rnd, rnd.choice(p.among))
    return out


def spoilt(rnd, text):
    at = rnd.randrange(len(text))
    return text[:at] + rnd.choice([[], ["other"], [text[at], text[at]]]) + text[at + 1 :]


def test_every_template_accepts_its_texts_and_equals_a_regular_expression(spark):
    rnd, rows = random.Random(1), []
    for t in TEMPLATES:
        parts = L.parse(t.markup)
        for _ in range(4):
            good = filled(rnd, parts)
            rows += [good, spoilt(rnd, good), ["before", *good, "after", *good[:3]], spoilt(rnd, spoilt(rnd, good))]
    texts = [rnd.choice([" ", "\n * ", "-", ", "]).join(r) for r in rows]
    told = L.Scanner(TEMPLATES, PHRASES)(pa.array(texts))
    for n, t in enumerate(TEMPLATES):
        assert all(n in {x for x, _, _ in told[16 * n + k]["found"]} for k in (0, 2, 4, 6, 8, 10, 12, 14) if k % 4 in (0, 2)), t.label
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in L.summary(docs).collect():
        assert tuple(r[c] for c in COLUMNS) == brute(texts[r.doc_id]), texts[r.doc_id][:200]


def test_regions_of_templates():
    markup = 'a <<beginOptional>>b <<beginOptional>>c<<endOptional>><<endOptional>> d <<var;name="x";original="y";match=".{1,2}">> e <<var;name="z";original="q";match="f|g h">>'
    scan = L.Scanner([Template("t", None, markup)], {})
    right = ["a d x e f", "A b d x y e g h", "a b c d d e f", "a d e e f"]
    wrong = ["a c d x e f", "a d e f", "a d x y z e f", "a d x e h", "b d x e f", ""]
    assert [bool(r["found"]) for r in scan(pa.array(right + wrong))] == [True] * 4 + [False] * 6
    (told,) = scan(pa.array(["zz a d x e f a d x e f"]))
    assert told["found"] == [(0, 1, 6), (0, 6, 11)]
    (open_ended,) = L.Scanner([Template("t", None, 'a <<var;name="x";original="y";match=".+">> b')], {})(pa.array(["a b b c b x"]))
    assert open_ended["found"] == [(0, 0, 5)]  # the leftmost, the longest
    for bad in ('<<var;name="x";match=".*">> a', "<<beginOptional>> a", "a <<endOptional>>", 'a <<var;name="x">>', "<<beginOptional>>a<<endOptional>>"):
        with pytest.raises(ValueError):
            L.Scanner([Template("t", None, bad)], {})


def test_defined_results(spark):
    rows = [(1, None), (2, ""), (3, "MIT License, mit license"), (3, "MIT License, mit license"), (None, "Apache\tLICENSE"), (5, "mit-license general public license"), (6, "mit licenses"), (7, "the mit " * 200_000 + "license")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, labels string, score int")
    got = sorted((tuple(r) for r in L.summary(df).collect()), key=repr)
    assert got == sorted(((k, *brute(t)) for k, t in rows), key=repr)
    assert L.summary(df.limit(0)).count() == 0 and L.scan(df.limit(0)).count() == 0
    spans = {(r.doc_id, r.label, r.kind, r.first_word, r.end_word) for r in L.scan(df.filter("doc_id in (3, 7)")).collect()}
    assert spans == {(3, "mit", "base", 0, 2), (3, "mit", "base", 2, 4), (7, "mit", "base", 399_999, 400_001)}


def test_time_is_linear_where_a_gap_is_open():
    import time

    scan = L.Scanner([Template("t", None, 'go <<var;name="x";original="y";match=".+">> never')], {})
    took = []
    for n in (20_000, 80_000):
        began = time.process_time()
        scan(pa.array(["go on " * n]))
        took.append(time.process_time() - began)
    assert took[1] < 12 * max(took[0], 0.05)


def test_the_registered_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op12_license_scan(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r[c] for c in COLUMNS) == brute(texts[r.doc_id])
    assert any("apache-2.0" in r.labels for r in got) and any(r.n_base for r in got)
