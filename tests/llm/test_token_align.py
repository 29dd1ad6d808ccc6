import hashlib
import random
from collections import Counter

import pytest
import public_tokenizers as P

from tessera.llm import queries, token_align

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
COLUMNS = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()


def ends(parts):
    at, out = 0, []
    for p in parts:
        at += len(p)
        out.append(at)
    return out


def brute(docs):
    """By both libraries over whole texts, and counts over all pairs of occurrences."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    level = {c: bytes([n]) for n, c in ((n, byte_char(n)) for n in range(256))}
    spelled_a = lambda i: b"".join(level[c] for c in a.id_to_token(i))
    spelled_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    rows, held = [], Counter()
    for key, text in docs:
        groups = []
        if text:
            ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            bytes_a, bytes_b = list(map(spelled_a, ids_a)), list(map(spelled_b, ids_b))
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
                ends_a, ends_b = ends(bytes_a), ends(bytes_b)
                last = 0
                for both in sorted(set(ends_a) & set(ends_b)):
                    groups.append(([i for i, e in zip(ids_a, ends_a) if last < e <= both], [i for i, e in zip(ids_b, ends_b) if last < e <= both]))
                    last = both
        links = [(x, y) for g, h in groups for x in g for y in h]
        held.update(set(links))
        rows.append((key, groups, links))
    most = Counter()
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    said = lambda groups: ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
    return [
        (key, sum(len(g) for g, _ in groups), sum(len(h) for _, h in groups), len(groups), len(links), sum(held[x] == most[x[0]] for x in links), sum(held[x] for x in links), hashlib.sha256(said(groups).encode()).hexdigest() if groups else "")
        for key, groups, links in rows
    ]


def byte_char(n):
    """The character that stands for a byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return chr(n) if n in plain else chr(256 + [x for x in range(256) if x not in plain].index(n))


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


PARTS = ["a", "the", "Licht", " ", " ", " ", "  ", "\n", "\t", "  ", " 　", " ", "é", "日本語", "😀", "▁", "<0x0A>", "<s>", "</s>", "<|endoftext|>", "'s", "'LL", "2024", "...", "==", "\x00", "\x1c", "\u0085", "​", "é", "zq" * 30, "ab1" * 40]


@pytest.mark.parametrize("size", [token_align.SLICE, 300])
def test_random_strings_equal_brute_force(spark, size, monkeypatch):
    monkeypatch.setattr(token_align, "SLICE", size)
    monkeypatch.setattr(token_align, "TOGETHER", 100)
    rnd = random.Random(size)
    docs = [(i, "".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 25)))) for i in range(500)]
    docs += [(600, None), (601, ""), (602, " "), (603, "same text "), (603, "same text "), (None, "no id"), (604, "x" * 4000)]
    df = spark.createDataFrame([(*d, "c", 1) for d in docs], "doc_id bigint, text string, block string, pairs int").repartition(3)
    assert found(token_align.align(df, A, B)) == sorted(brute(docs), key=repr)


def test_groups_of_many_tokens_count_by_distinct_ids():
    keys, times = token_align.links(token_align.np.array([5, 5, 6]), token_align.np.array([9, 8, 9, 9]))
    assert dict(zip(keys.tolist(), times.tolist())) == {5 << 32 | 8: 2, 5 << 32 | 9: 6, 6 << 32 | 8: 1, 6 << 32 | 9: 3}


def test_the_vocabulary_is_encoded_by_ranks_as_the_library_does(spark):
    from tokenizers import Tokenizer

    encode, spelled = token_align.byte_level(A)
    whole = Tokenizer.from_file(A)
    whole.encode_special_tokens = True
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()][:60] + ["<|endoftext|> x", "".join(PARTS)]
    ids = encode(texts)
    assert ids == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert [b"".join(spelled[i] for i in x).decode() for x in ids] == texts


def test_empty_table_and_a_very_long_text(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert token_align.align(none, A, B).count() == 0
    docs = [(1, "Lorem ipsum dolor, sit amet. " * 20_000 + "ab" * 50_000), (2, "ipsum")]
    r = {x.doc_id: x for x in token_align.align(spark.createDataFrame(docs, "doc_id bigint, text string"), A, B).collect()}
    assert r[1].n_a > 150_000 and 0 < r[1].n_best <= r[1].n_links
    assert r[2].count_sum >= r[2].n_links > 0


def test_the_registered_query(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op13_tokenizer_alignment(spark, sf)
    assert got.columns[:8] == COLUMNS and dict(got.dtypes)["groups_sha256"] == "string"
    assert found(got) == sorted(brute(docs), key=repr)
