"""SentencePiece encoding and decoding by a shared-prefix forward pass.

A text is cut into words between any two characters that stand side by side in
no piece of the model (mostly before marks of space and around punctuation). No
piece reaches over such a cut, so words encode apart. The distinct words of
a batch are sorted, which is a depth-first walk of their trie, and the forward
states of a word's prefixes are kept for the next word as far as their common
prefix goes.

For a unigram model the state of a prefix is its best score and last piece
(Viterbi). For a model of ranked merges the best segmentation isn't the one of
largest sum: the encoding of a prefix is that of a shorter one and one more
piece, where the last two pieces stay apart when they are merged alone, and
exactly one piece fits. So the state is the last piece, and no score is summed.
Beside it stands the longest end of the prefix that begins a piece; a table
gives the pieces that end there, so none is looked for by its length.
Both give the ids of the sentencepiece library for models that take texts as
they are; a model that normalises texts first, or has other rules for white
space, is refused when it is loaded.

Words already seen by a worker are kept, up to a bound. Nothing is shuffled.

Defined results: a null text counts as empty and has no ids; characters without
a piece become their bytes (or the unknown id); decoding drops one leading space
and turns marks into spaces, so a mark that stood in the text comes back as a
space; invalid bytes decode to U+FFFD; repeated rows are encoded one by one; texts of
any length are encoded whole; an empty table gives an empty result; columns other than doc_id and text are
ignored.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import by_bytes, held, parts_between, text_bytes

MARK = "▁"
SLICE = 3_000_000  # bytes of text encoded together
CACHED_WORDS = 200_000
CACHED_PAIRS = 200_000
PROBES = ("a", " a  b ", "\tx\ny", "\ufb01 \u00bd \u2460 \uff21 e\u0301 \u3000 \u00a0 \u200b", "<s> </s> <unk> <0x0A>", "Zz\U0001f600\u4e2d")


class Model:
    """Pieces, scores and kinds of a SentencePiece model file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        self.text = [sp.id_to_piece(i).replace(MARK, " ") for i in ids]  # no piece holds a space itself
        plain = [i for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {self.text[i]: i for i in plain}
        self.scores = {self.text[i]: sp.get_score(i) for i in plain}
        self.bytes = {int(self.text[i][3:5], 16): i for i in ids if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.longest = max(map(len, self.ids), default=1)
        usual = sorted(s for s in self.scores.values() if s > -1e8)
        self.merges = all(s == round(s) for s in usual)  # ranks, not log probabilities
        self.floor = (usual[0] if usual else 0) - 10
        self.spelled = [t.encode() for t in self.text]
        for value, i in self.bytes.items():
            self.spelled[i] = bytes([value])
        for i in ids:
            if sp.is_control(i):
                self.spelled[i] = b""
        data, ends = text_bytes(pa.array(list(self.ids), pa.large_string()))
        side_by_side = np.ones(max(len(data) - 1, 0), bool)
        side_by_side[ends[1:-1] - 1] = False
        self.joined = np.zeros((256, 256), bool)  # bytes between which a text isn't cut
        self.joined[:, 0x80:0xC0] = True  # these go on with a character
        self.joined[data[:-1][side_by_side], data[1:][side_by_side]] = True


class Packed(dict):
    """The ids of a piece, or of a character without one, as bytes."""

    def __init__(self, model: Model):
        super().__init__((t, array("i", [i]).tobytes()) for t, i in model.ids.items())
        self.model = model

    def __missing__(self, piece: str) -> bytes:
        model = self.model
        ids = [model.bytes[b] for b in piece.encode("utf-8", "surrogatepass")] if model.bytes else [model.unknown]
        return array("i", ids).tobytes()


class Encoder:
    def __init__(self, path: str):
        self.model = Model(path)
        self.words: dict[bytes, bytes] = {}
        self.packed = Packed(self.model)
        self.pairs = 0  # held in the tables of self.ending
        self.ending = self._ending() if self.model.merges else {}
        self.spelled = pa.array(self.model.spelled, pa.large_binary())
        if [x.tolist() for x in self.lists(list(PROBES))] != self.model.library.encode(list(PROBES)):
            raise ValueError("the model changes texts before it cuts them, which isn't built")

    def _merged(self, text: str) -> list[str]:
        """Pieces by merging the best pair, the leftmost of equals, until none is a piece."""
        parts, scores = list(text), self.model.scores
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _ending(self) -> dict[str, tuple[tuple[str, int, dict[str, bool]], ...]]:
        """For each beginning of a piece: the pieces of several characters that end it, longest first, their lengths, and whether they can follow others."""
        ids = self.model.ids
        entries = {t: (t, len(t), {}) for t in ids if len(t) > 1}
        begun = {t[:n] for t in ids for n in range(len(t) + 1)}
        return {t: tuple(entries[e] for at in range(len(t) - 1) if (e := t[at:]) in entries) for t in begun}

    def _stays(self, before: str, piece: str, after: dict[str, bool]) -> bool:
        """Whether the piece can follow: merged together, both stay as they are."""
        stays = self._merged(before + piece) == ([before, piece] if before else [piece])
        if self.pairs < CACHED_PAIRS:  # those met first stay
            after[before] = stays
            self.pairs += 1
        return stays

    def _walk(self, words: Iterable[str]) -> Iterator[tuple[str, list[str]]]:
        """The pieces of each of the sorted words."""
        model, ending, previous = self.model, self.ending, ""
        scores, longest = model.scores, model.longest
        last = [""]  # for each prefix: its last piece
        begun = [""]  # its longest end that begins a piece (ranked merges)
        total = [0.0]  # the score of its best path (unigram)
        for word in words:
            same = 0
            for a, b in zip(word, previous):
                if a != b:
                    break
                same += 1
            del last[same + 1 :], begun[same + 1 :], total[same + 1 :]
            if model.merges:
                state, end = begun[same], same
                for letter in word[same:]:
                    end += 1
                    state += letter
                    while (fitting := ending.get(state)) is None:
                        state = state[1:]
                    for piece, length, after in fitting:
                        before = last[end - length]
                        if (stays := after.get(before)) is None:
                            stays = self._stays(before, piece, after)
                        if stays:
                            break
                    else:
                        piece = letter
                    last.append(piece)
                    begun.append(state)
            else:
                for end in range(same + 1, len(word) + 1):
                    best, chosen = None, word[end - 1]
                    for start in range(max(0, end - longest), end):
                        piece = word[start:end]
                        score = scores.get(piece, model.floor if start == end - 1 else None)
                        if score is not None and (best is None or total[start] + score > best):
                            best, chosen = total[start] + score, piece
                    last.append(chosen)
                    total.append(best)
            pieces, at = [], len(word)
            while at:
                pieces.append(piece := last[at])
                at -= len(piece)
            pieces.reverse()
            yield word, pieces
            previous = word

    def _distinct(self, units: list[bytes]) -> list[bytes]:
        """Ids of the distinct words."""
        words, packed = self.words, self.packed.__getitem__
        new = sorted(u for u in units if u not in words)
        found = self._walk(u.decode("utf-8", "surrogatepass") for u in new)
        fresh = {u: b"".join(map(packed, pieces)) for u, (_, pieces) in zip(new, found)}
        if len(words) + len(fresh) <= CACHED_WORDS:  # the words met first stay; others are encoded each time
            words.update(fresh)
            return list(map(words.__getitem__, units))
        known = words.get
        return [fresh[u] if (x := known(u)) is None else x for u in units]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's begin and the last end."""
        texts = pc.replace_substring(texts.cast(pa.large_string()), MARK, " ")  # both are marks
        data, ends = text_bytes(texts)
        filled = np.flatnonzero(np.diff(ends))
        data = np.insert(data, ends[filled], 32)  # a text begins with a mark, unless it is empty
        ends = ends + np.concatenate([[0], np.cumsum(np.diff(ends) > 0)])
        cut = np.ones(len(data) + 1, bool)
        for at in range(0, len(data) - 1, SLICE):  # a text may be longer
            some = data[at : at + SLICE + 1]
            cut[at + 1 : at + len(some)] = ~self.model.joined[some[:-1], some[1:]]
        cut[ends] = True
        units = np.flatnonzero(cut)
        distinct, place = parts_between(data, units)
        ids = self._distinct(distinct.to_pylist())
        flat, size = np.frombuffer(b"".join(ids), np.int32), np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        length = size[place]
        total = np.concatenate([[0], np.cumsum(length)])
        from_ = np.repeat((np.cumsum(size) - size)[place] - total[:-1], length)
        return flat[from_ + np.arange(len(from_))], total[np.searchsorted(units, ends)]

    def lists(self, texts: list[str | None]) -> list[np.ndarray]:
        ids, starts = self(pa.array(texts, pa.string()))
        return [ids[a:b] for a, b in zip(starts, starts[1:])]

    def decode_all(self, ids: np.ndarray, starts: np.ndarray) -> list[str]:
        """Text of each stretch of ids."""
        data, ends = text_bytes(self.spelled.take(pa.array(ids)))
        whole, at = data.tobytes(), ends[starts].tolist()
        texts = (whole[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:]))
        return [t[1:] if t.startswith(" ") else t for t in texts]

    def decode(self, ids) -> str:
        return self.decode_all(np.asarray(ids, np.int32), np.array([0, len(ids)]))[0]


def _encoder(path: str) -> Encoder:
    """One encoder for a worker, so that later tasks find its words."""
    return held(("pieces", path), lambda: Encoder(path))


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and ids of each text."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model)
        for part in by_bytes(batches, "text", SLICE):
            ids, starts = encoder(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.ListArray.from_arrays(starts.astype(np.int32), pa.array(ids))], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text of each row of ids; the text of null ids is null."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [None if ids is None else encoder.decode(ids) for ids in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(texts, pa.string())], schema=schema)

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 of the ids (little-endian int32) and text_crc32 of what they decode to."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("text_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model)
        for part in by_bytes(batches, "text", SLICE):
            ids, starts = encoder(part.column("text"))
            at, raw = starts.tolist(), ids.astype("<i4")
            sums = [zlib.crc32(raw[a:b].tobytes()) for a, b in zip(at, at[1:])]
            texts = [zlib.crc32(t.encode()) for t in encoder.decode_all(ids, starts)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(np.diff(starts)), *(pa.array(c, pa.int64()) for c in (sums, texts))], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_crc32 bigint, text_crc32 bigint")
