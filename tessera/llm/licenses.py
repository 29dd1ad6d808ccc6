"""Licence scans by templates compiled to token automata.

A template is a licence's wording with two kinds of markup: what stands between
``<<beginOptional>>`` and ``<<endOptional>>`` may be left out, and
``<<var;name="..";original="..";match="..">>`` may be replaced. ``match`` says by what:
``.+``, ``.*`` or ``.{m,n}`` are numbers of words, anything else is a list of
wordings, divided by ``|``. All other wording is mandatory. Case, punctuation,
markup and white space don't count, as words alone are compared.

All templates are compiled into one automaton over words. A text is walked
once: each state keeps the earliest word at which its match began, and the walk
skips to the next word that can begin a template whenever no state is alive. So
time is linear in the text for a given set of templates, wherever a replaceable
region ends.

Beside the templates stand base phrases, whose words are counted wherever they
stand consecutively.

Score: the share of a text's labels that a whole template confirms (a template's
``family`` is confirmed with it); 0 without labels.

Defined results: a null text counts as empty: no words, no labels, score 0 and
no first or last word; repeated rows are scanned one by one; texts of any length
are walked whole; an empty table gives an empty result; columns other than
doc_id and text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_bytes, held, lower_words
from .license_templates import PHRASES, TEMPLATES, Template

SLICE = 4_000_000  # bytes of text walked together
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_MARKUP = re.compile(r"<<(beginOptional|endOptional|var)((?:[^>]|>(?!>))*)>>")
_COUNT = re.compile(r"\.(?:([+*])|\{(\d+),(\d+)\})")


def words_of(text: str) -> list[str]:
    return _WORD.findall("".join(c.lower() if c.isascii() else c for c in text))


@dataclass
class Gap:
    """``least`` to ``most`` words of any kind; no bound above where ``most`` is None."""

    least: int
    most: int | None


@dataclass
class Choice:
    """One of several sequences."""

    among: list[list]


def parse(markup: str) -> list:
    """A template as a sequence of words, ``Gap`` and ``Choice``."""
    stack, at = [[]], 0
    for m in _MARKUP.finditer(markup):
        stack[-1] += words_of(markup[at : m.start()])
        at = m.end()
        if m[1] == "beginOptional":
            stack.append([])
        elif m[1] == "endOptional":
            if len(stack) == 1:
                raise ValueError("endOptional without beginOptional")
            inside = stack.pop()
            stack[-1].append(Choice([inside, []]))
        else:
            rule = re.search(r'match="([^"]*)"', m[2])
            if rule is None:
                raise ValueError("a replaceable region needs match")
            if count := _COUNT.fullmatch(rule[1]):
                stack[-1].append(Gap(int(count[1] == "+"), None) if count[1] else Gap(int(count[2]), int(count[3])))
            else:
                stack[-1].append(Choice([words_of(x) for x in rule[1].split("|")]))
    if len(stack) > 1:
        raise ValueError("beginOptional without endOptional")
    return stack[0] + words_of(markup[at:])


def expression(parts: list) -> str:
    """The same template as a regular expression over words that are each led by a space."""
    out = []
    for p in parts:
        if isinstance(p, str):
            out.append(f" {p}")
        elif isinstance(p, Gap):
            out.append(f"(?: [^ ]+){{{p.least},{'' if p.most is None else p.most}}}")
        else:
            out.append("(?:" + "|".join(map(expression, p.among)) + ")")
    return "".join(out)


@dataclass
class Automaton:
    """States over words; ``step[s]`` maps a word to the states after it, ``other[s]`` is for words without an entry."""

    templates: list[Template]
    empty: list[list[int]] = field(default_factory=list)
    by_word: list[dict[str, list[int]]] = field(default_factory=list)
    by_any: list[list[int]] = field(default_factory=list)
    accepts: dict[int, int] = field(default_factory=dict)

    def __post_init__(self):
        first = self._state()
        for nth, t in enumerate(self.templates):
            begin = self._state()
            self.empty[first].append(begin)
            self.accepts[self._add(parse(t.markup), begin)] = nth
        start = self._closure(first)
        if any(self.by_any[s] or s in self.accepts for s in start):
            raise ValueError("a template must begin with mandatory wording")
        near = [self._closure(s) for s in range(len(self.empty))]
        reach = lambda states: tuple(sorted({t for s in states for t in near[s]}))
        self.other = [reach(x) for x in self.by_any]
        self.step = [{w: reach([*to, *self.by_any[s]]) for w, to in edges.items()} for s, edges in enumerate(self.by_word)]
        self.begins: dict[str, tuple[int, ...]] = {}
        for w in {w for s in start for w in self.by_word[s]}:
            self.begins[w] = tuple(sorted({t for s in start for t in self.step[s].get(w, ())}))
        self.vocabulary = sorted({w for edges in self.by_word for w in edges})

    def _state(self) -> int:
        for table in (self.empty, self.by_any):
            table.append([])
        self.by_word.append({})
        return len(self.empty) - 1

    def _add(self, parts: list, at: int) -> int:
        """The state after the parts, which are walked from state ``at``."""
        for p in parts:
            if isinstance(p, str):
                to = self._state()
                self.by_word[at].setdefault(p, []).append(to)
            elif isinstance(p, Choice):
                to = self._state()
                for way in p.among:
                    self.empty[self._add(way, self._branch(at))].append(to)
            else:
                for _ in range(p.least):
                    self.by_any[at].append(at := self._state())
                to = self._state()
                self.empty[at].append(to)
                if p.most is None:
                    self.by_any[to].append(to)
                for _ in range(0 if p.most is None else p.most - p.least):
                    self.by_any[at].append(at := self._state())
                    self.empty[at].append(to)
            at = to
        return at

    def _branch(self, at: int) -> int:
        new = self._state()
        self.empty[at].append(new)
        return new

    def _closure(self, state: int) -> set[int]:
        seen, todo = {state}, [state]
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return seen

    def find(self, words: list[str | None], starts: list[int]) -> list[tuple[int, int, int]]:
        """(template, first word, word after the last) of the leftmost longest matches of each template that don't overlap.

        ``words`` may hold None for words without an entry; ``starts`` are the places, in order, of words that begin a template.
        """
        met: dict[tuple[int, int], int] = {}
        alive: dict[int, int] = {}
        at = nth = 0
        while at < len(words):
            if not alive:
                while nth < len(starts) and starts[nth] < at:
                    nth += 1
                if nth == len(starts):
                    break
                at = starts[nth]
            word, new = words[at], {}
            for s, began in alive.items():
                for t in self.step[s].get(word, self.other[s]):
                    if new.get(t, began) >= began:
                        new[t] = began
            for t in self.begins.get(word, ()):
                new.setdefault(t, at)
            at += 1
            for s in new.keys() & self.accepts.keys():
                met[self.accepts[s], new[s]] = at
            alive = new
        out, last = [], {}
        for (nth, began), end in sorted(met.items()):
            if began >= last.get(nth, 0):
                out.append((nth, began, end))
                last[nth] = end
        return out


class Scanner:
    """Base phrases and templates over slices of texts."""

    def __init__(self, templates: list[Template], phrases: dict[str, str]):
        self.automaton, self.templates = Automaton(templates), templates
        self.phrases = [(words_of(p), label) for p, label in phrases.items()]
        self.vocabulary = sorted({*self.automaton.vocabulary, *(w for p, _ in self.phrases for w in p)})
        self.number = {w.encode(): i for i, w in enumerate(self.vocabulary, 1)}  # 0: other words
        self.named = [None, *self.vocabulary]
        self.begins = np.array([w in self.automaton.begins for w in self.named])

    def __call__(self, texts: pa.Array) -> list[dict]:
        """One dict a text: n_words, ``base`` (start, label) and ``found`` (template, start, end)."""
        distinct, place, edges = lower_words(texts)
        words = np.array([self.number.get(w, 0) for w in distinct.to_pylist()], np.int32)[place]
        text = np.repeat(np.arange(len(texts)), np.diff(edges))
        out = [{"n_words": n, "base": [], "found": []} for n in np.diff(edges).tolist()]
        for phrase, label in self.phrases:
            here = np.ones(max(0, len(words) - len(phrase) + 1), bool)
            for k, w in enumerate(phrase):
                here &= words[k : k + len(here)] == self.number[w.encode()]
            here &= text[: len(here)] == text[len(phrase) - 1 :][: len(here)]
            for i in np.flatnonzero(here).tolist():
                out[text[i]]["base"].append((i - int(edges[text[i]]), label))
        starts = np.flatnonzero(self.begins[words])
        cuts = np.searchsorted(starts, edges)
        for d in np.flatnonzero(np.diff(cuts)).tolist():
            first, end = int(edges[d]), int(edges[d + 1])
            own = (starts[cuts[d] : cuts[d + 1]] - first).tolist()
            out[d]["found"] = self.automaton.find([self.named[w] for w in words[first:end].tolist()], own)
        return out


def _scanner() -> Scanner:
    return held("licenses", lambda: Scanner(TEMPLATES, PHRASES))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, label, kind (base or template), first_word and end_word of each place and each match."""
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.string()), ("kind", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner()
        length = {label: len(p) for p, label in scanner.phrases}
        for part in by_bytes(batches, "text", SLICE):
            rows = []
            for key, told in zip(part.column("doc_id").to_pylist(), scanner(part.column("text"))):
                rows += [(key, label, "base", at, at + length[label]) for at, label in told["base"]]
                rows += [(key, TEMPLATES[t].label, "template", a, b) for t, a, b in told["found"]]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, label string, kind string, first_word bigint, end_word bigint")


SUMMARY = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"


def summary(docs: DataFrame) -> DataFrame:
    """One row a text: words, base places, labels and score."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(SUMMARY))

    def row(key: int | None, told: dict) -> tuple:
        base = {label for _, label in told["base"]}
        sure = {x for t, _, _ in told["found"] for x in (TEMPLATES[t].label, TEMPLATES[t].family) if x}
        places, labels = [at for at, _ in told["base"]], sorted(base | sure)
        score = len(sure) / len(labels) if labels else 0.0
        return key, told["n_words"], len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(labels), score

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner()
        for part in by_bytes(batches, "text", SLICE):
            rows = [row(*x) for x in zip(part.column("doc_id").to_pylist(), scanner(part.column("text")))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, SUMMARY)
