"""Language identification by averaged hashed subword embeddings.

A text is the mean of the embeddings of its byte 3- and 4-grams, hashed into
``BUCKETS`` rows; a linear softmax over the mean gives the language. Both
layers are trained by stochastic gradient descent in numpy on a bounded,
stratified sample of labelled rows: of each of the ``LANGS`` most frequent
languages the ``PER_LANG`` rows with the smallest hashes of id and text, fewer
if there are so many languages that this would exceed ``SAMPLE`` rows. As both
layers are linear, a prediction only averages rows of one small table.

Rejection is learned. One more class stands for what is no learned language; it
is shown texts made from the sample: its letters in random order, random letters
of other scripts, random characters as in encoded data, and the sample's words
in the form of program code. Rows labelled ``und`` belong to it too. Each sample
row also gives a short stretch of itself, so short texts keep their share. A
part of the sample is kept back to set the temperature of the softmax and the
score below which a text is rejected: the ``REJECT`` quantile of the scores of
kept-back texts in a learned language, at most one half; for a text of fewer
than ``ENOUGH`` bytes it is lower in proportion.

Defined results: a null text, or one without a letter, is ``und`` with score 0
and is rejected; so is every text if there is nothing to learn from; a rejected
text with letters still names its likeliest language; of two equally likely
languages the first by name is told; repeated rows are predicted one by one; a
null doc_id counts as an empty text where folds are dealt, and such rows can be
learned from; texts of any length are read whole, in bounded pieces; an empty
table gives an empty result; the language, source and id of a document are
never inputs of its prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import give_back, free_name, in_fold, map_rows

BUCKETS = 1 << 16
DIMENSIONS = 16
PER_LANG = 250
SAMPLE = 4000
SPARE = 4
LANGS = 256
ENOUGH = 80  # bytes of text that are held against the whole threshold
STRETCH = 60  # characters of a short stretch
MADE = 1500  # most characters of a made text
REJECT = 0.001
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
# letters stay, and the marks that prose has few of; digits are alike
_SPACED = bytes(c if c > 127 or chr(c).isalpha() or chr(c) in "{}()[]=<>_;/\\|&*+#@$%^~`" else 48 if chr(c).isdigit() else 32 for c in range(256))
# fixed values: where the letters of some scripts begin and end
SCRIPTS = ((0x370, 0x400), (0x400, 0x530), (0x531, 0x588), (0x5D0, 0x5EB), (0x620, 0x64B), (0x904, 0x93A), (0x985, 0x9BA), (0xB85, 0xBBA), (0xE01, 0xE31), (0x10D0, 0x10FB), (0x1200, 0x1358), (0x3041, 0x3097), (0x30A1, 0x30FB), (0x4E00, 0x9FA6), (0xAC00, 0xD7A4))
# fixed values: words and line ends that are common in program code
CODE = "def return if else for while import from class public static void int char const var let function new null true false self this try except catch throw print len range string struct include lambda".split()
ENDS = (";", " {", "}", "()", "):", " = ", " == ", "[0]", " => ", ", ", " += ", "->", " && ", "//", "#")
_PIECE = 1 << 20


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def buckets(text: str):
    """Arrays of the hashed byte n-grams of a text, a bounded piece at a time."""
    data = np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass").translate(_SPACED) + b"   ", np.uint8)
    for at in range(0, len(data) - 3, _PIECE):
        b = data[at : at + _PIECE + 3].astype(np.uint32)
        three = b[:-3] | b[1:-2] << 8 | b[2:-1] << 16
        yield (three * np.uint32(2654435761)) >> 16
        yield ((three | b[3:] << 24) * np.uint32(2246822519)) >> 16


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their shares."""
    counts = sum(np.bincount(h, minlength=BUCKETS) for h in buckets(text))
    at = np.flatnonzero(counts)
    return at, counts[at] / counts.sum()


def made_text(text: str, rng: np.random.Generator, kind: int) -> str:
    """A text in no language, of about the length of ``text``: of kind 0 to 4."""
    text = text[:MADE]
    n, letters = max(20, len(text)), [c for c in text if not c.isspace()]
    spaced = lambda some: "".join(c + (" " if x < 0.18 else "") for c, x in zip(some, rng.random(len(some))))
    pick = lambda some, n: [some[i] for i in rng.integers(0, len(some), n)]
    if kind == 0:
        return spaced([letters[i] for i in rng.permutation(len(letters))])
    if kind == 1:
        return spaced(pick([c for c in map(chr, range(97, 123))], n))
    if kind == 2:
        low, high = SCRIPTS[rng.integers(0, len(SCRIPTS))]
        return spaced(pick([chr(c) for c in rng.integers(low, high, 60).tolist()], n))
    if kind == 3:
        some = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/"
        return "".join(pick(some[: 64 if rng.random() < 0.6 else 16], n))
    words, out = [w for w in ("".join(c for c in w if c.isalpha()) for w in text.split()) if w] or ["x"], []
    for word in pick(words, max(3, n // 12)):
        name = word.lower() + ("_" if rng.random() < 0.5 else "") + pick(words, 1)[0].title() if rng.random() < 0.5 else word.lower()
        out += [pick(CODE, 1)[0], " ", name, pick(ENDS, 1)[0], "(" if rng.random() < 0.4 else " ", str(rng.integers(0, 99)) if rng.random() < 0.3 else "", ")" if rng.random() < 0.4 else "", "\n    " if rng.random() < 0.4 else " "]
    return "".join(out)


def examples(lang: str, text: str) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(language, buckets, shares) of what is learned from a row: it, a short stretch of it, and a made text."""
    rng = np.random.default_rng(np.frombuffer(text.encode("utf-8", "surrogatepass")[:64].ljust(64), np.uint32))
    yield lang, *features(text)
    if len(text) > 2 * STRETCH:
        at = int(rng.integers(0, len(text) - STRETCH))
        if has_letter(part := text[at : at + STRETCH]):
            yield lang, *features(part)
    made = made_text(text, rng, int(rng.integers(0, 5)))
    yield UNKNOWN, *features(made if rng.random() < 0.7 else made[: 2 * STRETCH])


@dataclass
class Model:
    langs: list[str]  # the class of what is none of them comes after them in the table
    table: np.ndarray  # score of each bucket for each language
    bias: np.ndarray
    threshold: float

    def probabilities(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.bias)), 0
        for h in buckets(text):
            total += self.table[h].sum(axis=0, dtype=np.float64)
            n += len(h)
        return _softmax(total / n + self.bias)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not has_letter(text):
            return UNKNOWN, 0.0
        p = self.probabilities(text)[: len(self.langs)]
        return self.langs[int(p.argmax())], float(p.max())

    def rejects(self, text: str | None, lang: str, score: float) -> bool:
        """Whether a text with this prediction is rejected; the less text there is, the less its score has to reach."""
        return lang == UNKNOWN or score < self.threshold and score < self.threshold * len(text.encode("utf-8", "surrogatepass")) / ENOUGH

    def kept(self, text: str | None) -> str | None:
        """The language of a text that isn't rejected."""
        told = self.predict(text)
        return None if self.rejects(text, *told) else told[0]


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=-1, keepdims=True))
    return z / z.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], rounds: int = 6, seed: int = 0) -> Model:
    """Model from (language, buckets, shares) of sample texts; those of language ``und`` are in none."""
    langs = sorted({r[0] for r in rows} - {UNKNOWN})
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0)
    rng, classes = np.random.default_rng(seed), [*langs, UNKNOWN]
    inner = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS))
    outer, bias = rng.standard_normal((DIMENSIONS, len(classes))) * 0.5, np.zeros(len(classes))
    number = {c: i for i, c in enumerate(classes)}
    label = np.array([number[r[0]] for r in rows])
    order = rng.permutation(len(rows))
    kept, fit = (order[: len(rows) // 5], order[len(rows) // 5 :]) if len(rows) >= 20 else (order, order)
    share = np.bincount(label[fit], minlength=len(classes)) + 1e-9
    weight = share.sum() / len(classes) / share  # classes count alike
    for turn in range(rounds):
        rate = 1 - turn / rounds
        for i in rng.permutation(fit):
            at, x = rows[i][1], rows[i][2]
            mean = x @ inner[at]
            d = _softmax(mean @ outer + bias)
            d[label[i]] -= 1
            d *= min(weight[label[i]], 10)
            back = outer @ d
            outer -= 0.5 * rate * np.outer(mean, d)
            bias -= 0.05 * rate * d
            inner[at] -= (20 * rate * x)[:, None] * back[None, :]
    table = inner @ outer
    logits = np.array([rows[i][2] @ table[rows[i][1]] for i in kept]) + bias
    truth = label[kept]
    loss = lambda t: -np.log(_softmax(logits * t)[np.arange(len(truth)), truth] + 1e-12).mean()
    heat = min((0.25, 0.35, 0.5, 0.7, 1, 1.4, 2, 2.8, 4), key=loss)
    scores = _softmax(logits * heat)[:, : len(langs)].max(axis=1)[truth < len(langs)]
    threshold = float(min(0.5, np.quantile(scores, REJECT))) if len(scores) else 0.5
    return Model(langs, (table * heat).astype(np.float32), bias * heat, threshold)


def fit(docs: DataFrame, fold: int | None = 0) -> Model:
    """Model learned from labelled rows of ``docs``, without those of the given fold.

    At most ``SAMPLE`` rows reach the driver, as buckets and shares.
    """
    labelled = docs.select("doc_id", "lang", "text").filter("lang is not null and text is not null")
    if fold is not None:
        labelled = labelled.filter(~in_fold(F.col("doc_id"), fold))
    hashed = labelled.select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    common = hashed.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("h").alias("several")).orderBy(F.desc("n"), "lang").limit(LANGS)
    common = [(r.lang, r.several) for r in common.collect()]  # LANGS rows at most
    if not common:
        return train([])
    room = min(PER_LANG, max(1, SAMPLE // len(common)))
    bounds = docs.sparkSession.createDataFrame(common, "lang string, several bigint")
    # a language's sample has its smallest hashes, so all but some SPARE samples' worth of rows leave before they are ranked
    near = hashed.join(F.broadcast(bounds), "lang").filter((F.col("h") / 2.0**64 + 0.5) * F.col("several") < SPARE * room)
    nth = F.row_number().over(W.partitionBy("lang").orderBy("h"))
    drawn = near.select("lang", "text", "h", nth.alias("nth")).filter(F.col("nth") <= room).select("lang", "text", "h")
    packed = lambda at, share: (at.astype(np.uint16).tobytes(), share.astype(np.float32).tobytes())
    made = map_rows(drawn, "h bigint, lang string, at binary, share binary", lambda: lambda rows: [(h, x[0], *packed(*x[1:])) for lang, t, h in rows if has_letter(t) for x in ([(UNKNOWN, *features(t))] if lang == UNKNOWN else examples(lang, t))], rows=16)
    rows = made.toArrow().sort_by([("lang", "ascending"), ("h", "ascending"), ("at", "ascending")])
    model = train([(x["lang"], np.frombuffer(x["at"], np.uint16), np.frombuffer(x["share"], np.float32)) for x in rows.to_pylist()])
    del rows
    give_back()  # the driver's share, too
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and rejected for each row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows at most LANGS wide

    def make():
        m = sent.value
        return lambda rows: [(i, *(p := m.predict(t)), m.rejects(t, *p)) for i, t in rows]

    return map_rows(docs.select("doc_id", "text"), "doc_id bigint, lang_pred string, score double, rejected boolean", make)


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model doesn't reject; a null ``lang``, if there is one, becomes the predicted language."""
    from pyspark.sql.types import StringType

    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(StringType())
    def told(texts):
        m = sent.value
        return texts.map(m.kept).astype(object)

    # told once: as a deterministic function the filter would call it again
    name, told = free_name(docs, "told"), told.asNondeterministic()
    kept = docs.withColumn(name, told("text")).filter(F.col(name).isNotNull())
    if "lang" in docs.columns:
        kept = kept.withColumn("lang", F.coalesce("lang", name))
    return kept.select(*docs.columns)
