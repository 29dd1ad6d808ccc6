import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tessera.llm import token_codes as C

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("ids", [[], [0], [255, 256, 65535, 65536, 2**32 - 1], list(range(0, 70_000, 7)), [50256] * 1025])
def test_codes_give_back_every_id(ids):
    ids = np.array(ids, np.uint32)
    codes = C.Codes(C.pack(ids))
    assert len(codes) == len(ids) and (codes.all() == ids).all()
    assert all(codes[i] == ids[i] for i in {*range(0, len(ids), max(1, len(ids) // 300)), *([len(ids) - 1] if len(ids) else [])})


def library(specials):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = not specials
    return t


LIBRARY = {x: library(x) for x in (True, False)}


def plain(text, specials=True):
    return LIBRARY[specials].encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize(
    "text",
    [None, "", " ", "a", " a", "a ", "a  b", "it's  a\n b\t c \n\n d", "x y z", "a \x1c b \x85 c", "<|endoftext|> a <|endoftext|>", "don't 've 12 3a b!! é ü 日本 語", "　 a  b", "ab " * 30_000],
)
@pytest.mark.parametrize("specials", [True, False])
def test_units_encode_as_whole_texts(text, specials):
    encoder = C.Encoder(PATH, specials)
    assert encoded(encoder, ["b a c", text, text, " d"]) == [plain(t, specials) for t in ("b a c", text, text, " d")]
    assert encoded(encoder, [text]) == [plain(text, specials)]


def encoded(encoder, texts):
    ids, starts = encoder(pa.array(texts, pa.string()))
    with_end, ends = encoder(pa.array(texts, pa.string()), 2)
    out = [ids[a:b].tolist() for a, b in zip(starts, starts[1:])]
    assert [with_end[a:b].tolist() for a, b in zip(ends, ends[1:])] == [[*x, 2] for x in out]
    return out


def test_units_of_random_strings_of_spaces_marks_and_letters():
    rng, some = random.Random(5), "ab' .,;:!?\n\t\r\x0b\x1c\x85\xa0\u1680\u2003\u2028\u202f\u205f\u3000éÉ\u4e2d\U0001f600017"
    texts = ["".join(rng.choice(some) for _ in range(rng.randrange(12))) for _ in range(3000)]
    assert encoded(C.Encoder(PATH), texts) == [plain(t) for t in texts]


def test_ids_do_not_depend_on_the_units_kept(monkeypatch):
    monkeypatch.setattr(C, "CACHED_UNITS", 6)
    encoder = C.Encoder(PATH)
    for text in ("one two, three two. four", "five six! seven; two, eight x1. ?? a.b", "one nine: ten, nine"):
        assert encoded(encoder, [text, text]) == [plain(text)] * 2


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(4)
    texts = dict(docs.select("doc_id", "text").collect())
    got = {r.doc_id: r for r in C.round_trip(docs, PATH, file_tokens=20_000).collect()}
    start = 0
    assert got.keys() == texts.keys()
    for i in sorted(texts):
        ids = np.array([*plain(texts[i]), 2], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_random_access_in_a_file():
    docs = [np.array(plain(t) + [2], np.uint32) for t in ("one two", "", "three thousand words")]
    file = C.TokenFile(C.to_file([3, None, 9], np.concatenate(docs), np.cumsum([0, *map(len, docs)])))
    assert file.doc_ids == [3, None, 9]
    assert all(file.token(d, i) == x for d, ids in enumerate(docs) for i, x in enumerate(ids))


def test_nulls_repeats_and_empty(spark):
    many = spark.createDataFrame([(7, f"a <|endoftext|> {i % 3}") for i in range(500)], "doc_id bigint, text string")
    got = sorted((r.start, r.n_tokens, r.doc_id) for r in C.round_trip(many.repartition(8), PATH, file_tokens=100).collect())
    n = len(plain("a <|endoftext|> 0")) + 1
    assert got == [(n * i, n, 7) for i in range(500)]
    docs = spark.createDataFrame([(5, None, 1), (None, "a", 1), (2, "b c", 1), (2, "b c", 1)], "doc_id bigint, text string, start int")
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.start, r.n_tokens) for r in C.round_trip(docs, PATH).collect())
    assert got == [(-1, 0, 2), (2, 2, 3), (2, 5, 3), (5, 8, 1)]
    assert C.round_trip(docs.limit(0), PATH).count() == 0
