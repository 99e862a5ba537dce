"""Language identification by string kernels.

The kernel of two texts is the blended spectrum of character n-grams: how many different
n-grams of 1 to 3 characters they share, over the root of the product of their numbers.
N-grams are those of the landmarks, ``LANDMARKS`` training texts of each language; letters
are lower-cased and each is a symbol, everything else is one. The Nyström method turns the kernel with the
landmarks into features, on which one ridge regression for each language, against the rest,
is solved. A text is scored by matrix products in batches: its presence of n-grams, times
the landmarks' presence, times the solved weights; the last two are multiplied beforehand.

Labels come from at most ``PER_LANGUAGE`` texts of each language and ``labelled.MAX_BYTES``
of text in all. Defined results: NULL texts
and texts without a letter are ``und`` with score 0; repeated rows agree; without any label
all are ``und``; equal values go to the first language by code point; an empty table gives an
empty result. Only the id, the text and, for training rows, the language are read.
"""

from __future__ import annotations

import sys
import unicodedata

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.llm.arrow import map_batches
from plenum.llm.labelled import held_out, sample_by_class

FOLDS, FOLD = 3, 1
LANDMARKS = 60
PER_LANGUAGE = 300
SLOT_BITS = 22
SPREAD = np.uint64(0x9E3779B97F4A7C15)
RIDGE = 1e-2
UNKNOWN = "und"
PIECE = 1 << 20
BLOCK = 64

_LETTERS = None


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(sys.maxunicode + 1)), bool)
    return _LETTERS


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Spectrum:
    """N-grams of 1 to 3 symbols, numbered. Every letter of the landmarks is a symbol of its
    own; letters that none of them has are one, and so is everything else."""

    def __init__(self, texts: list[str]):
        seen = [points(t.lower()) for t in texts]
        self.symbols = np.unique(np.concatenate([x[letters()[x]] for x in seen] or [np.zeros(0, np.uint32)]))
        self.number()
        self.kept = np.unique(np.concatenate([np.unique(self.grams(x)) for x in seen]))
        self.prepare()

    def __getstate__(self):
        return {"symbols": self.symbols, "kept": self.kept}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.number()
        self.prepare()

    def number(self):
        table = np.zeros(sys.maxunicode + 1, np.uint64)
        table[letters()] = len(self.symbols) + 1
        table[self.symbols] = np.arange(1, len(self.symbols) + 1)
        self.table = table

    def prepare(self):
        """A table of slots that holds one n-gram each; n-grams that share the slot of an
        earlier one are found in a sorted list."""
        self.size = len(self.kept)
        slots, first = np.unique(self.slots(self.kept), return_index=True)
        self.held = np.full(1 << SLOT_BITS, self.size, np.uint32)
        self.held[slots] = first
        late = np.ones(self.size, bool)
        late[first] = False
        self.late = np.flatnonzero(late)
        self.crowded = np.zeros(1 << SLOT_BITS, bool)
        self.crowded[self.slots(self.kept[late])] = True
        self.codes = np.append(self.kept, np.uint64(0))  # no n-gram has code 0

    @staticmethod
    def slots(codes: np.ndarray) -> np.ndarray:
        return (codes * SPREAD) >> np.uint64(64 - SLOT_BITS)

    def grams(self, x: np.ndarray) -> np.ndarray:
        """Codes of all n-grams: 21 bits for a symbol, counted from 1, so that codes of
        different lengths differ."""
        s = self.table[x] + np.uint64(1)
        two = (s[:-1] << np.uint64(21)) | s[1:]
        return np.concatenate([s, two, (two[:-1] << np.uint64(21)) | s[2:]])

    def places(self, codes: np.ndarray) -> np.ndarray:
        """The number of each n-gram, or ``size`` where no landmark has it."""
        slots = self.slots(codes)
        place = self.held[slots]
        place[self.codes[place] != codes] = self.size
        open_ = np.flatnonzero((place == self.size) & self.crowded[slots]) if len(self.late) else ()
        if len(open_):
            late = self.kept[self.late]  # sorted, as all of them
            at = np.minimum(np.searchsorted(late, codes[open_]), len(late) - 1)
            hit = late[at] == codes[open_]
            place[open_[hit]] = self.late[at[hit]]
        return place

    def presence(self, text: str, row: np.ndarray) -> None:
        """Set the n-grams of a text in a row of ``size + 1`` numbers; the last one takes
        those that no landmark has."""
        for at in range(0, max(len(text), 1), PIECE):
            x = points(text[at : at + PIECE + 2].lower())
            row[self.places(self.grams(x))] = 1
        row[-1] = 0


class Kernel:
    """Weights on n-grams that give the ridge regressions' values."""

    def __init__(self, texts: list[str], langs: list[str], first: list[bool]):
        self.langs = sorted(set(langs))
        self.spectrum = Spectrum([t for t, f in zip(texts, first) if f])
        rows = self.rows(texts)
        norm = 1 / np.sqrt(np.maximum(rows.sum(axis=1), 1))
        marks = rows[np.array(first)]
        own = norm[np.array(first)]
        kernel = (marks @ marks.T) * np.outer(own, own)
        values, vectors = np.linalg.eigh(kernel.astype(float))
        good = values > 1e-8 * max(values.max(), 1e-30)
        root = vectors[:, good] / np.sqrt(values[good])
        z = ((rows @ marks.T) * np.outer(norm, own)) @ root
        target = np.where(np.array(langs)[:, None] == np.array(self.langs)[None, :], 1.0, -1.0)
        self.bias = target.mean(axis=0)
        solved = np.linalg.solve(z.T @ z + RIDGE * np.eye(z.shape[1]), z.T @ (target - self.bias))
        weights = (marks * own[:, None]).T @ (root @ solved)
        self.weights = weights.astype(np.float32)

    def rows(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.spectrum.size + 1), np.float32)
        for row, text in zip(out, texts):
            self.spectrum.presence(text, row)
        return out[:, :-1]

    def values(self, texts: list[str]) -> np.ndarray:
        rows = self.rows(texts)
        return (rows @ self.weights) / np.sqrt(np.maximum(rows.sum(axis=1), 1))[:, None] + self.bias


def fit(docs: DataFrame, lang="lang", id_="doc_id", text="text", per_language=PER_LANGUAGE, landmarks=LANDMARKS):
    """The kernel machine, or None without a labelled text."""
    rows = sample_by_class(docs, None, lang, per_language, ~held_out(id_, FOLDS, FOLD), id_, text)
    got = rows.select("_label", "_place", "_text").toPandas().sort_values(["_label", "_place", "_text"])
    got = got[got["_text"].map(has_letter)] if len(got) else got
    if not len(got):
        return None
    first = got.groupby("_label").cumcount() < landmarks
    return Kernel(list(got["_text"]), list(got["_label"].astype(str)), list(first))


def has_letter(text: str) -> bool:
    return any(bool(letters()[points(text[at : at + PIECE])].any()) for at in range(0, len(text), PIECE))


def identify(docs: DataFrame, lang="lang", id_="doc_id", text="text", **options) -> DataFrame:
    """Per row: the id, ``held_out``, ``lang_pred``, ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, lang, id_, text, **options))

    def run(batch):
        model, column = shared.value, batch.column(text)
        names, scores = [], []
        for at in range(0, len(column), BLOCK):
            texts = [t or "" for t in column.slice(at, BLOCK).to_pylist()]
            known = [model is not None and has_letter(t) for t in texts]
            if model is not None:
                values = model.values(texts)
                soft = np.exp(4 * (values - values.max(axis=1, keepdims=True)))
                best, top = values.argmax(axis=1), 1 / soft.sum(axis=1)
            names += [model.langs[best[k]] if ok else UNKNOWN for k, ok in enumerate(known)]
            scores += [float(top[k]) if ok else 0.0 for k, ok in enumerate(known)]
        yield {id_: batch.column(id_), "lang_pred": names, "score": scores}

    kind = docs.schema[id_].dataType.simpleString()
    found = map_batches(docs.select(id_, text), run, f"`{id_}` {kind}, lang_pred string, score double")
    return found.select(id_, held_out(id_, FOLDS, FOLD).alias("held_out"), "lang_pred", "score")
