"""Registered queries over the smallest tables, against brute force made here."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import xxhash

from tessera.llm import queries

SPACE = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def lowered(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def fingerprint(text):
    words = re.findall(SPACE, lowered(text))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_op1(spark, sf, docs):
    prints = {i: fingerprint(t) for i, t in docs.items()}
    ids = sorted(docs)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in queries.op1_simhash_near_dedup(spark, sf).collect()}
    assert got == {(i, f"{prints[i]:016x}", find(i)) for i in ids}


def test_op2(spark, sf, docs):
    kinds = (
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    )
    rows = queries.op2_secret_scan(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        spans = [(m.start(), k, m.end(), kind) for k, (kind, p, fits) in enumerate(kinds) for m in p.finditer(docs[r.doc_id] or "") if fits(m)]
        said = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(spans))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[1] == k for s in spans) for k in range(3))
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest() and set(said.split(",")) - {""} <= set(r.spans.split(","))


def test_op5(spark, sf, docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    for r in queries.op5_sentencepiece(spark, sf).collect():
        ids = sp.encode(docs[r.doc_id] or "")
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<i4").tobytes()))
        assert r.text_crc32 == zlib.crc32(sp.decode(ids).encode())


def test_op6(spark, sf, docs):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id) for r in queries.op6_benchmark_decontamination(spark, sf).collect()}
    words = {i: " ".join(re.findall(SPACE, lowered(t))) for i, t in docs.items()}
    verbatim = {(d, i) for d, t in words.items() for i, x in items.items() if (w := " ".join(re.findall(SPACE, lowered(x)))) and f" {w} " in f" {t} "}
    assert verbatim and verbatim <= got


def test_op7(spark, sf, docs):
    from tokenizers import Tokenizer

    whole, at = Tokenizer.from_file(P.path("byte_bpe_50k.json")), 0
    want = []
    for i in sorted(docs):
        ids = [*whole.encode(docs[i] or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in queries.op7_token_codes(spark, sf).collect()) == want


def test_op8(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = queries.op8_html_main_text(spark, sf).collect()
    assert sorted(r.page_id for r in rows) == sorted(pages)
    for r in rows:
        assert r.url == pages[r.page_id].url and r.n_chars == len(r.text) and r.text == r.text.strip() and "\n\n\n" not in r.text


def test_op9(spark, sf, docs):
    rows = queries.op9_language_id(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in docs[r.doc_id] or ""))


def test_op10(spark, sf, docs):
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in docs}
    tokens = {i: [*re.findall(SPACE, lowered(t)), None] for i, t in docs.items()}
    count = Counter(x for i, ts in tokens.items() if not held[i] for x in ts)
    n, v = sum(count.values()), len(count)
    for r in queries.op10_bloom_lm_scores(spark, sf).collect():
        ts = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(ts), sum(count[x] > 0 for x in ts), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in ts), rel=1e-9)
        assert r.score < 0
