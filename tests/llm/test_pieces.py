import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from tessera.llm import pieces as P

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def encoder():
    return P.Encoder(PATH)


@pytest.mark.parametrize("text", [None, "", " ", "   ", "a", " a", "a ", "a  b", "  a\n\nb \t c", "a▁b ▁▁ c", "日本 語 😀 é é ﬁ", "\0 x", "aaaaaaaa aaa aa", "x" * 20_000, "ab" * 5000, "      six", "tabs\t\tand\r\n", "<s> </s> <0x0A> <unk>"])
def test_ids_are_those_of_the_library(library, encoder, text):
    ids = encoder.lists([text])[0].tolist()
    assert ids == library.encode(text or "")
    if "▁" not in (text or ""):
        assert encoder.decode(ids) == (text or "")


def test_random_words(library, encoder):
    rng = random.Random(5)
    stems = [rng.choice(library.id_to_piece(rng.randrange(259, 32000)).replace("▁", "") or "x") + "".join(library.id_to_piece(rng.randrange(259, 32000)).replace("▁", "") for _ in range(rng.randrange(1, 4))) for _ in range(6000)]
    texts = [" ".join(stems[i : i + 50]) for i in range(0, 6000, 50)]
    assert [x.tolist() for x in encoder.lists(texts)] == library.encode(texts)
    letters = ["".join(rng.choice("abeinst") for _ in range(rng.randrange(1, 14))) for _ in range(6000)]
    assert [x.tolist() for x in encoder.lists(letters)] == library.encode(letters)


def test_words_are_cut_where_no_piece_reaches(library):
    encoder = P.Encoder(PATH)
    encoder.words.clear()
    text = "stone, stone. stone; stone$$$ (stone)"
    assert encoder.lists([text])[0].tolist() == library.encode(text)
    assert [w for w in encoder.words if b"stone" in w and len(w) > 6] == []  # one word, whatever stands after it
    joined, plain = encoder.model.joined, [t.encode() for t in encoder.model.ids]
    assert all(joined[a, b] for t in plain for a, b in zip(t, t[1:]))
    assert not joined[ord("e"), ord(" ")] and not joined.all()


def test_pieces_are_not_looked_for_by_length():
    class Counted(dict):
        asked = 0

        def get(self, key, default=None):
            Counted.asked += 1
            return super().get(key, default)

        def __contains__(self, key):
            Counted.asked += 1
            return super().__contains__(key)

    encoder = P.Encoder(PATH)
    for table in ("ids", "scores"):
        setattr(encoder.model, table, Counted(getattr(encoder.model, table)))
    encoder.ending = Counted(encoder.ending)
    rng = random.Random(2)
    words = sorted({" " + "".join(rng.choice("abeinst") for _ in range(12)) for _ in range(3000)})
    list(encoder._walk(words))  # pairs of pieces are known after it
    Counted.asked = 0
    list(encoder._walk(words))
    assert Counted.asked < 3 * sum(map(len, words))


@pytest.mark.parametrize("size", [P.SLICE, 50])
def test_glued_pieces_and_characters(library, encoder, monkeypatch, size):
    monkeypatch.setattr(P, "SLICE", size)
    rng = random.Random(3)
    pieces = [library.id_to_piece(i).replace("▁", " ") for i in range(259, 32000)]
    letters = sorted(set("".join(pieces)))
    texts = ["".join(rng.choice(kind) for _ in range(rng.randrange(1, 30))) for kind in (pieces, letters, ".,;:!?#$%*-_=/()'\" \n\tab01", "é日本😀ßñ .,a") for _ in range(2000)]
    assert [x.tolist() for x in encoder.lists(texts)] == library.encode(texts)


def test_unigram_path_is_the_best_path(monkeypatch):
    encoder = P.Encoder(PATH)
    rng = random.Random(1)
    pieces = ["a", "b", "ab", "ba", "aab", "bb", "▁", "▁a", "▁ab"]
    model = encoder.model
    model.ids, model.scores = {p: i for i, p in enumerate(pieces)}, {p: -rng.random() * 5 for p in pieces}
    model.merges, model.longest, model.floor = False, 3, -50.0

    def best(word):
        if not word:
            return 0.0
        return max(model.scores[word[:n]] + best(word[n:]) for n in range(1, min(3, len(word)) + 1) if word[:n] in model.scores)

    words = sorted({"▁" + "".join(rng.choice("ab") for _ in range(rng.randrange(1, 9))) for _ in range(200)})
    for word, found in encoder._walk(words):
        assert "".join(found) == word and abs(sum(model.scores[p] for p in found) - best(word)) < 1e-9


def test_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = dict(docs.select("doc_id", "text").collect())
    got = {r.doc_id: r for r in P.round_trip(docs, PATH).collect()}
    assert got.keys() == texts.keys()
    for i, ids in zip(texts, library.encode(list(texts.values()))):
        assert (got[i].n_tokens, got[i].ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<i4").tobytes()))
        assert got[i].text_crc32 == zlib.crc32(texts[i].encode())
    some = docs.filter("doc_id < 50")
    assert dict(P.decode(P.encode(some, PATH), PATH).collect()) == {i: t for i, t in texts.items() if i < 50}


def test_nulls_repeats_clashes_and_empty(spark):
    docs = spark.createDataFrame([(1, None, "x"), (None, "a b", "x"), (2, "", "x"), (2, "", "x")], "doc_id bigint, text string, ids string")
    got = sorted((str(r.doc_id), len(r.ids)) for r in P.encode(docs, PATH).collect())
    assert got == [("1", 0), ("2", 0), ("2", 0), ("None", 2)]
    assert P.round_trip(docs.limit(0), PATH).count() == 0


def test_a_model_that_changes_texts_is_refused(monkeypatch):
    class Folding(P.Model):
        def __init__(self, path):
            super().__init__(path)
            plain = self.library
            self.library = type("", (), {"encode": lambda self, texts: plain.encode([" ".join(t.split()) for t in texts])})()

    monkeypatch.setattr(P, "Model", Folding)
    with pytest.raises(ValueError):
        P.Encoder(PATH)
