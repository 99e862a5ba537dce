"""A gated recurrent language model with a class-factored output, beside unigram counts.

Tokens are lower-cased words and an end mark. Counts come from all training documents. The
``HEAD`` most frequent words fall into classes, by group (which frequent words precede
them, clustered) and by frequency within the group; the other words share one class and the
end mark is one of its own. The model gives ``P(class | history) * P(word | class, history)``:
a gated recurrent unit reads the text, a softmax over classes follows its state, and so does a
softmax over the words of each class. Words outside the head have their counts' share of their
class, and a word without a count has the share of one count.

Training is truncated backpropagation over windows of ``WINDOW`` steps, through all training
documents. Every task trains on its own documents and Spark averages the weights by tokens. A
first round over the documents whose hash falls into a ``1 / WARM`` part gives the tasks one
model to start from; the second reads them all. Longer texts are learned from in stretches of
``STRETCH`` steps, each from a fresh state, so that lanes are even. Texts are scored whole: the state is carried
from window to window and reset between documents.

Words are known by a 64-bit hash. Counts of head words (``HEAD`` at most) go to every task;
other words are joined with their counts. Defined results: NULL and empty texts are the end
mark alone; rows with a NULL id are training rows; repeated rows count each; without training
documents the counts are 0 and the model is uniform over its two classes; an empty table gives
an empty result. Only the id and the text are read.
"""

from __future__ import annotations

import bisect
import functools
import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.llm.arrow import map_batches, slices, word_hashes, word_spans
from plenum.llm.labelled import held_out
from plenum.session import materialize

FOLDS, FOLD = 7, 2
HEAD = 1 << 16
OWN_INPUT = 4096  # words with an input vector of their own; others use that of their class
GUIDES = 32  # the most frequent words, whose company groups the others
GROUPS, BINS = 6, 16
HIDDEN = 16
WINDOW = 32
LANES = 128
TRAIN_LANES = 256
WARM = 16
STRETCH = 1024
RATE = 0.01
CELLS = 3 << 14  # of a table of states by words of a class; small enough for a core's cache
STEPS = 1 << 14  # scored at once
BUCKET_BITS = 18  # leading bits of a hash by which head words are looked up


@dataclass
class Vocabulary:
    """Head words in order of their hash, with what the model knows of each."""

    hashes: np.ndarray
    counts: np.ndarray
    total: int  # training tokens
    distinct: int
    ends: int
    rank: np.ndarray = field(default=None)  # by frequency
    classes: np.ndarray = field(default=None)
    within: np.ndarray = field(default=None)  # log share in the class
    slot: np.ndarray = field(default=None)  # place in order of class
    starts: np.ndarray = field(default=None)  # first slot of each class, and the end
    priors: np.ndarray = field(default=None)  # log share of each class
    buckets: np.ndarray = field(default=None)  # first place of each run of leading bits, and the end

    @property
    def rare(self) -> int:
        return len(self.priors) - 2

    @property
    def end(self) -> int:
        return len(self.priors) - 1

    @property
    def rare_norm(self) -> float:
        """Counts outside the head, one for each word there and one for unseen ones."""
        known = len(self.hashes)
        words = self.distinct - (self.ends > 0)
        return float(self.total - self.ends - self.counts.sum() + (words - known) + 1)

    def place(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each word in the head, or -1."""
        found = np.full(len(hashes), -1)
        if not len(self.hashes):
            return found
        shift = np.uint64(64 - BUCKET_BITS)
        if self.buckets is None:
            self.buckets = np.searchsorted(self.hashes >> shift, np.arange((1 << BUCKET_BITS) + 1, dtype=np.uint64))
        lead = (hashes >> shift).astype(np.int64)
        at, end = self.buckets[lead], self.buckets[lead + 1]
        left = np.flatnonzero(at < end)
        while len(left):
            own = at[left]
            hit = self.hashes[own] == hashes[left]
            found[left[hit]] = own[hit]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < end[left]]
        return found

    def arrange(self, groups: np.ndarray) -> None:
        """Classes of like frequency inside each group; a class's share of the roots of the
        counts is even, which keeps both the classes and the words in one few."""
        order = np.lexsort((self.hashes, -self.counts))
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        self.classes = np.zeros(len(order), np.int64)
        number = 0
        for g in np.unique(groups):
            own = order[groups[order] == g]
            root = np.sqrt(self.counts[own])
            part = np.minimum(BINS * (np.cumsum(root) - root / 2) / root.sum(), BINS - 1).astype(int)
            _, part = np.unique(part, return_inverse=True)
            self.classes[own] = number + part
            number += int(part.max()) + 1
        mass = np.bincount(self.classes, self.counts, minlength=number) if len(order) else np.zeros(0)
        self.within = np.log(self.counts / mass[self.classes]) if len(order) else np.zeros(0)
        by_class = np.lexsort((self.rank, self.classes))
        self.slot = np.empty(len(order), np.int64)
        self.slot[by_class] = np.arange(len(order))
        self.starts = np.searchsorted(self.classes[by_class], np.arange(number + 1))
        all_mass = np.concatenate([mass, [self.rare_norm, self.ends + 1]])
        self.priors = np.log(all_mass / all_mass.sum())


@dataclass
class Tokens:
    """The words of a batch of texts."""

    owner: np.ndarray  # text of each word, rising
    place: np.ndarray  # in the head, or -1
    rest: tuple  # (text, hash, count) of words outside the head
    texts: int


def tokens(column, vocabulary: Vocabulary) -> Tokens:
    owners, places, texts, hashes, counts = [], [], [], [], []
    for part in slices(column):
        starts, ends, owner = word_spans(part)
        hashed = word_hashes(part.data, starts, ends, True)
        place = vocabulary.place(hashed)
        owners.append(owner + part.first)
        places.append(place)
        out = place < 0
        unique, which = np.unique(hashed[out], return_inverse=True)
        pair, n = np.unique((owner[out] + part.first) * max(len(unique), 1) + which, return_counts=True)
        texts.append(pair // max(len(unique), 1))
        hashes.append(unique[pair % max(len(unique), 1)])
        counts.append(n)
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    rest = join(texts, np.int64), join(hashes, np.uint64), join(counts, np.int64)
    return Tokens(join(owners, np.int64), join(places, np.int64), rest, len(column))


def count_words(docs: DataFrame, text: str) -> DataFrame:
    """(word, n) over all rows; each task adds up its batches first."""

    def run(batch):
        found, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for part in slices(batch.column(text)):
            starts, ends, _ = word_spans(part)
            unique, n = np.unique(word_hashes(part.data, starts, ends, True), return_counts=True)
            found.append(unique)
            counts.append(n)
        unique, which = np.unique(np.concatenate(found), return_inverse=True)
        yield {"word": unique.view(np.int64), "n": np.bincount(which, np.concatenate(counts), len(unique)).astype(np.int64)}

    return map_batches(docs.select(text), run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


# The recurrent unit. Inputs are rows of a table that holds the gates' values for each input
# symbol, so a step needs one matrix product.

Weights = dict[str, np.ndarray]


def start_weights(voc: Vocabulary, hidden: int = HIDDEN) -> Weights:
    """Small random gates; both softmaxes begin at the shares of the counts."""
    rng = np.random.default_rng(3)
    share = np.zeros(len(voc.hashes), np.float32)
    share[voc.slot] = voc.within
    return {
        "table": rng.normal(0, 0.1, (OWN_INPUT + len(voc.priors), 3 * hidden)).astype(np.float32),
        "state": rng.normal(0, 0.2, (hidden, 3 * hidden)).astype(np.float32),
        "out": np.zeros((hidden, len(voc.priors)), np.float32),
        "bias": voc.priors.astype(np.float32),
        "words": np.zeros((len(voc.hashes), hidden), np.float32),
        "share": share,
    }


def by_class(slots: np.ndarray, starts: np.ndarray):
    """The steps whose word lies in the head, in order of class, and for each class among
    them where its steps begin and end in that order, and its first slot and end."""
    known = np.flatnonzero(slots >= 0)
    own = np.searchsorted(starts, slots[known], side="right") - 1
    order = np.argsort(own.astype(np.int16), kind="stable")
    count = np.bincount(own)
    found = np.flatnonzero(count)
    count = count[found]
    to = np.cumsum(count)
    return known[order], list(zip((to - count).tolist(), to.tolist(), starts[found].tolist(), starts[found + 1].tolist()))


def pieces(first: int, end: int, width: int):
    """Cuts of a range of steps that keep a table of them by ``width`` words below ``CELLS``."""
    rows = max(1, CELLS // width)
    return ((at, min(at + rows, end)) for at in range(first, end, rows))


@functools.cache
def ones_of(count: int, kind: np.dtype) -> np.ndarray:
    return np.ones(count, kind)


def exponentials(states: np.ndarray, weights: np.ndarray, goal: np.ndarray) -> tuple:
    """The softmax of ``states @ weights`` before division: exponentials, their sums by row,
    the goal's place in the flat table and the log of its share. States are within 1 and
    weights small, so that the largest value of a row is taken out only where sums would
    leave single precision."""
    place = np.arange(len(states)) * weights.shape[1] + goal
    ones = ones_of(weights.shape[1], weights.dtype)
    for shift in (False, True):
        table = states @ weights
        if shift:
            table -= table.max(axis=1, keepdims=True)
        hit = table.ravel()[place]
        np.exp(table, out=table)
        sums = table @ ones
        logs = np.log(sums)
        if shift or np.abs(logs).max() < 34:
            return table, sums, place, hit - logs


def with_one(states: np.ndarray) -> np.ndarray:
    """Rows of states with a 1 at the end, which the bias is multiplied by."""
    return np.concatenate([states, np.ones((len(states), 1), states.dtype)], axis=1)


def class_log_odds(weights: Weights, states: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The log probability of each step's class; states end with a 1."""
    value, out = np.zeros(len(states)), np.concatenate([weights["out"], weights["bias"][None]])
    for a, b in pieces(0, len(states), out.shape[1]):
        value[a:b] = exponentials(states[a:b], out, target[a:b])[3]
    return value


def word_log_odds(weights: Weights, states: np.ndarray, slots: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The log probability of each step's word in its class; 0 for words outside the head.
    States end with a 1."""
    value = np.zeros(len(slots))
    order, classes = by_class(slots, starts)
    sorted_states, sorted_slots, found = states[order], slots[order], np.empty(len(order))
    for low, high, first, end in classes:
        words = np.concatenate([weights["words"][first:end].T, weights["share"][None, first:end]])
        for a, b in pieces(low, high, end - first):
            found[a:b] = exponentials(sorted_states[a:b], words, sorted_slots[a:b] - first)[3]
    value[order] = found
    return value


def by_feature(x: np.ndarray) -> np.ndarray:
    """The same array of (step, lane, feature), with the lanes of a feature next to each other."""
    return np.ascontiguousarray(x.transpose(0, 2, 1)).transpose(0, 2, 1)


def _step(x: np.ndarray, h: np.ndarray, state: np.ndarray) -> tuple:
    """One step of all lanes; fastest where the lanes of a feature lie next to each other."""
    k = h.shape[1]
    a = (state.T @ h.T).T
    gates = x[:, : 2 * k] + a[:, : 2 * k]
    np.negative(gates, out=gates)
    np.exp(gates, out=gates)
    gates += 1
    np.reciprocal(gates, out=gates)
    z, r = gates[:, :k], gates[:, k:]
    n = np.tanh(x[:, 2 * k :] + r * a[:, 2 * k :])
    return n + z * (h - n), z, r, n, a[:, 2 * k :]


def lanes(lengths: np.ndarray, count: int) -> list[np.ndarray]:
    """Deal sequences to lanes of about equal length, the longest first."""
    order = np.argsort(-lengths, kind="stable")
    load = np.zeros(count, np.int64)
    own: list[list[int]] = [[] for _ in range(count)]
    for k in order.tolist():
        lane = int(load.argmin())
        own[lane].append(k)
        load[lane] += lengths[k]
    return [np.array(x, np.int64) for x in own]


def spread(sequences: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``sequences`` by (step, lane), -1 beyond a lane's end, and whether a
    sequence begins there."""
    lengths = np.diff(bounds)
    count = max(1, min(width, int(-(-lengths.sum() // max(int(lengths.max(initial=1)), 1)))))
    dealt = lanes(lengths, count)
    steps = max(int(lengths[x].sum()) for x in dealt)
    place = np.full((steps, count), -1, np.int64)
    begins = np.zeros((steps, count), bool)
    for lane, own in enumerate(dealt):
        at = np.cumsum(lengths[own]) - lengths[own]
        n = int(lengths[own].sum())
        place[:n, lane] = np.repeat(bounds[own] - at, lengths[own]) + np.arange(n)
        begins[at, lane] = True
    return place, begins


def stretches(bounds: np.ndarray, longest: int = STRETCH) -> np.ndarray:
    """Bounds of the same steps in sequences of at most ``longest``."""
    parts = [np.arange(a, b, longest) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
    return np.concatenate([*parts, bounds[-1:]])


def sequences(toks: Tokens, voc: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Input symbol, class and slot of the word to predict (-1 outside the head) at each step
    of all texts, and where texts begin. Each text starts from the end mark and ends with it."""
    cls = np.where(toks.place >= 0, voc.classes[toks.place] if len(voc.hashes) else voc.rare, voc.rare)
    symbol = OWN_INPUT + cls
    if len(voc.hashes):
        rank = voc.rank[toks.place]
        symbol = np.where((toks.place >= 0) & (rank < OWN_INPUT), rank, symbol)
    n = np.bincount(toks.owner, minlength=toks.texts)
    bounds = np.concatenate([[0], np.cumsum(n + 1)])
    where = np.arange(len(cls)) + toks.owner
    inputs = np.full(int(bounds[-1]), OWN_INPUT + voc.end, np.int64)
    target = np.full(int(bounds[-1]), voc.end, np.int64)
    slots = np.full(int(bounds[-1]), -1, np.int64)
    inputs[where + 1] = symbol
    target[where] = cls
    if len(voc.hashes):
        slots[where] = np.where(toks.place >= 0, voc.slot[toks.place], -1)
    inputs[bounds[:-1]] = OWN_INPUT + voc.end
    return inputs, target, slots, bounds


@np.errstate(over="ignore", divide="ignore", invalid="ignore")  # see exponentials
def log_odds(weights: Weights, starts: np.ndarray, inputs, target, slots, bounds) -> np.ndarray:
    """The log10 probability of each text's classes and of its head words in these; the state
    runs through whole texts."""
    total = np.zeros(len(bounds) - 1)
    if not len(inputs):
        return total
    place, begins = spread(inputs, bounds, LANES)
    h = np.zeros((HIDDEN, place.shape[1]), np.float32).T
    chunk = STEPS // place.shape[1] + 1
    value = np.zeros(len(inputs))
    for at in range(0, len(place), chunk):
        own, new = place[at : at + chunk], begins[at : at + chunk]
        x = by_feature(weights["table"][inputs[np.maximum(own, 0)]])
        states = np.empty((len(own), *h.T.shape), np.float32)
        starting = new.any(axis=1).tolist()
        for t in range(len(own)):
            if starting[t]:
                h = h * ~new[t][:, None]
            h = _step(x[t], h, weights["state"])[0]
            states[t] = h.T
        live = own >= 0
        seen, steps = with_one(states.transpose(0, 2, 1)[live]), own[live]
        value[steps] = class_log_odds(weights, seen, target[steps]) + word_log_odds(weights, seen, slots[steps], starts)
    text = np.repeat(np.arange(len(total)), np.diff(bounds))
    return np.bincount(text, value, len(total)) / np.log(10)


def soft_slopes(states: np.ndarray, weights: np.ndarray, goal: np.ndarray, scale: float) -> tuple:
    """Loss of a softmax and its slopes by state and by weight; states end with a 1. Rows of
    the table are divided by their sums only after the products."""
    table, sums, place, share = exponentials(states, weights, goal)
    table.ravel()[place] -= sums
    each = (scale / sums)[:, None].astype(states.dtype)
    return -float(share.sum()), (table @ weights[:-1].T) * each, (states * each).T @ table


class Trainer:
    """Adam on the loss of classes and words, by truncated backpropagation through windows.
    The words of a class share one second moment and have no first."""

    def __init__(self, weights: Weights, starts: np.ndarray):
        self.starts = starts
        self.w = {k: v.copy() for k, v in weights.items() if k not in ("words", "share")}
        self.m = {k: np.zeros_like(v) for k, v in self.w.items()}
        self.v = {k: np.zeros_like(v) for k, v in self.w.items()}
        # The share is the weight of the 1 at the end of a state.
        inner = np.concatenate([weights["words"].T, weights["share"][None]])
        # Rows a power of two apart would share few places of the caches.
        self.inner = np.pad(inner, ((0, 0), (0, 1040)))[:, : inner.shape[1]]
        self.w |= {"words": self.inner[:-1].T, "share": self.inner[-1]}
        self.spread = {"words": [0.0] * len(starts), "share": [0.0] * len(starts)}
        self.times = [0] * len(starts)
        self.firsts = starts.tolist()
        self.steps = 0

    def run(self, inputs: np.ndarray, target: np.ndarray, slots: np.ndarray, bounds: np.ndarray, width: int = TRAIN_LANES) -> float:
        """One pass; the mean loss of a step."""
        place, begins = spread(inputs, stretches(bounds), width)
        h = np.zeros((HIDDEN, place.shape[1]), np.float32).T
        loss = 0.0
        for at in range(0, len(place), WINDOW):
            own, new = place[at : at + WINDOW], begins[at : at + WINDOW]
            h, part = self.window(inputs, target, slots, own, new, h)
            loss += part
        return loss / max(len(inputs), 1)

    @np.errstate(over="ignore", divide="ignore", invalid="ignore")  # see exponentials
    def window(self, inputs, target, slots, own, new, h):
        w, k = self.w, HIDDEN
        symbols = inputs[np.maximum(own, 0)]
        x = by_feature(w["table"][symbols])
        kept = []
        starting = new.any(axis=1).tolist()
        for t in range(len(own)):
            before = h * ~new[t][:, None] if starting[t] else h
            h, z, r, n, a = _step(x[t], before, w["state"])
            kept.append((before.T, z.T, r.T, n.T, a.T, h.T))
        earlier, z, r, n, a, states = (np.stack(part) for part in zip(*kept))  # (step, feature, lane)
        live = own >= 0
        seen, steps = with_one(states.transpose(0, 2, 1)[live]), own[live]
        scale = 1 / max(len(steps), 1)
        grads, down, loss = self.classes(seen, target[steps], scale)
        inner, lost = self.words(seen, slots[steps], scale)
        loss += lost
        slope = np.zeros((*own.shape, k), seen.dtype)
        slope[live] = down + inner
        slope = np.ascontiguousarray(slope.transpose(0, 2, 1))
        # How a state's slope passes to the gates, and through them to the state before.
        to_n = (1 - z) * (1 - n * n)
        to_r = to_n * r
        passes = np.concatenate([(earlier - n) * z * (1 - z), to_r * a * (1 - r), to_r], axis=1)
        through = np.empty_like(passes)
        back = np.zeros_like(slope[0])
        for t in range(len(own) - 1, -1, -1):
            slope[t] += back
            d = slope[t]
            np.multiply(passes[t].reshape(3, k, -1), d, out=through[t].reshape(3, k, -1))
            back = w["state"] @ through[t]
            back += d * z[t]
            if starting[t]:
                back *= ~new[t]
        grads["state"] = (earlier @ through.transpose(0, 2, 1)).sum(axis=0)
        through[:, 2 * k :] = slope * to_n
        read = symbols[live]
        times = np.bincount(read, minlength=len(w["table"]))
        used = np.flatnonzero(times)
        times[used] = np.arange(len(used)) * 3 * k
        cells = times[read][:, None] + np.arange(3 * k)
        rows = np.bincount(cells.ravel(), through.transpose(0, 2, 1)[live].ravel(), len(used) * 3 * k)
        self.update(grads, used, rows.reshape(-1, 3 * k).astype(through.dtype))
        return h, loss

    def classes(self, states, target, scale):
        """Slopes of the class weights, slope by state, and loss of the classes."""
        out = np.concatenate([self.w["out"], self.w["bias"][None]])
        slopes, down, loss = np.zeros_like(out), np.empty((len(states), HIDDEN), states.dtype), 0.0
        for a, b in pieces(0, len(states), out.shape[1]):
            lost, down[a:b], grad = soft_slopes(states[a:b], out, target[a:b], scale)
            loss += lost
            slopes += grad
        return {"out": slopes[:-1], "bias": slopes[-1]}, down, loss

    def words(self, states, slots, scale):
        """Slope by state of the words in their classes, and their loss; moves their weights."""
        order, classes = by_class(slots, self.starts)
        down = np.zeros((len(slots), HIDDEN), states.dtype)
        states, slots = states[order], slots[order]
        found, loss = np.empty((len(order), HIDDEN), states.dtype), 0.0
        for low, high, first, end in classes:
            words, slopes = self.inner[:, first:end], 0
            for a, b in pieces(low, high, end - first):
                lost, found[a:b], grad = soft_slopes(states[a:b], words, slots[a:b] - first, scale)
                loss += lost
                slopes = slopes + grad if a > low else grad
            self.update_words(first, end, {"words": slopes[:-1].T, "share": slopes[-1]})
        down[order] = found
        return down, loss

    def update_words(self, first, end, grads):
        c = bisect.bisect_left(self.firsts, first)
        self.times[c] += 1
        for name, g in grads.items():
            # The largest slope of a row, not the mean: most words of a class are absent.
            largest = max(float(g.max()), -float(g.min()))
            self.spread[name][c] += 0.01 * (largest * largest - self.spread[name][c])
            size = math.sqrt(self.spread[name][c] / (1 - 0.99 ** self.times[c])) + 1e-12
            self.w[name][first:end] -= np.float32(RATE / size) * g

    def update(self, grads, used, rows):
        self.steps += 1
        rate = RATE * np.sqrt(1 - 0.999**self.steps) / (1 - 0.9**self.steps)
        for name, g in grads.items():
            m, v = self.m[name], self.v[name]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            self.w[name] -= rate * m / (np.sqrt(v) + 1e-8)
        m, v = self.m["table"][used], self.v["table"][used]  # only rows that were read
        m += 0.1 * (rows - m)
        v += 0.001 * (rows * rows - v)
        self.m["table"][used], self.v["table"][used] = m, v
        self.w["table"][used] -= rate * m / (np.sqrt(v) + 1e-8)


def flat(weights: Weights) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in sorted(weights)])


def unflat(values: np.ndarray, like: Weights) -> Weights:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = values[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def guides(toks: Tokens, voc: Vocabulary) -> np.ndarray:
    """How often each head word follows each guide, as counts by (word, guide); a word
    follows the last guide of its text before it."""
    rank = np.where(toks.place >= 0, voc.rank[toks.place], len(voc.hashes))
    at = np.where(rank < GUIDES, np.arange(len(rank)), -1)
    last = np.maximum.accumulate(at) if len(at) else at
    last = np.concatenate([[-1], last[:-1]]) if len(last) else last
    good = (last >= 0) & (toks.place >= 0)
    good &= toks.owner[np.maximum(last, 0)] == toks.owner
    return np.bincount(toks.place[good] * GUIDES + rank[last[good]], minlength=len(voc.hashes) * GUIDES)


def cluster(profiles: np.ndarray, count: int = GROUPS, rounds: int = 15) -> np.ndarray:
    """k-means of profiles on the sphere; the first centres are the farthest apart among the
    fullest profiles. Rows without a profile join the first group."""
    weight = profiles.sum(axis=1)
    x = np.sqrt(profiles / np.maximum(weight, 1)[:, None])
    full = np.argsort(-weight, kind="stable")[:512]
    if not len(full) or weight[full[0]] == 0:
        return np.zeros(len(profiles), np.int64)
    centres = [x[full[0]]]
    while len(centres) < min(count, len(full)):
        nearest = np.max(x[full] @ np.array(centres).T, axis=1)
        centres.append(x[full[int(np.argmin(nearest))]])
    centres = np.array(centres)
    for _ in range(rounds):
        group = np.argmax(x @ centres.T, axis=1)
        for g in range(len(centres)):
            mean = (x[group == g] * weight[group == g, None]).sum(axis=0)
            if np.linalg.norm(mean) > 0:
                centres[g] = mean / np.linalg.norm(mean)
    return np.argmax(x @ centres.T, axis=1)


def build(counts: DataFrame, ends: int, learn: DataFrame, id_: str, text: str, warm: int = WARM, head: int = HEAD) -> tuple:
    """Vocabulary and weights from stored counts and the rows to train on."""
    spark = learn.sparkSession
    first = learn.filter(F.pmod(F.xxhash64(F.col(id_).cast("string")), F.lit(warm)) == 0)
    sums = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    top = counts.orderBy(F.desc("n"), "word").limit(head).toPandas()
    words = top["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(words)
    voc = Vocabulary(
        words[order], top["n"].to_numpy(np.int64)[order], int(sums["n"] or 0) + ends, int(sums["v"]) + (ends > 0), ends
    )
    voc.arrange(np.zeros(len(words), np.int64))
    shared = spark.sparkContext.broadcast(voc)

    def company(batch):
        found = guides(tokens(batch.column(text), shared.value), shared.value) if len(shared.value.hashes) else np.zeros(0, np.int64)
        cell = np.flatnonzero(found)
        yield {"cell": cell.astype(np.int32), "n": found[cell]}

    # At most HEAD * GUIDES cells, whatever the input.
    cells = map_batches(learn.select(text), company, "cell int, n bigint").groupBy("cell").agg(F.sum("n").cast("float").alias("n"))
    profiles = np.zeros(len(words) * GUIDES, np.float32)
    got = cells.toArrow()
    profiles[got["cell"].to_numpy()] = got["n"].to_numpy()
    voc.arrange(cluster(profiles.reshape(-1, GUIDES)))
    del got, profiles
    weights = start_weights(voc)
    for rows in (first, learn):
        weights = _train_round(rows, text, voc, weights)
    return voc, weights


def _train_round(rows: DataFrame, text: str, voc: Vocabulary, weights: Weights) -> Weights:
    """One model from those of all tasks. A task's weights travel in pieces of ``step``
    numbers; whoever gets a piece adds up arrays, so nothing is exploded into rows and no
    task holds more than one model."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((voc, weights))
    step = 8192

    def train(batches):
        vocabulary, start = shared.value
        trainer, seen = Trainer(start, vocabulary.starts), 0
        for batch in batches:
            inputs, target, slots, bounds = sequences(tokens(batch.column(0), vocabulary), vocabulary)
            if len(inputs):
                trainer.run(inputs, target, slots, bounds)
                seen += len(inputs)
        if seen:
            values = flat(trainer.w)
            for number, k in enumerate(range(0, len(values), step)):
                yield piece(number, values[k : k + step], seen)

    def add(batches):
        sums, seen = {}, {}
        for batch in batches:
            offsets = batch.column(1).offsets.to_numpy()
            values = batch.column(1).values.to_numpy()
            for k, (number, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                own = values[offsets[k] : offsets[k + 1]].astype(np.float64) * n
                sums[number] = sums[number] + own if number in sums else own
                seen[number] = seen.get(number, 0) + n
        for number in sums:
            yield piece(number, sums[number] / seen[number], seen[number])

    schema = "part int, weights array<float>, seen bigint"
    trained = rows.select(text).mapInArrow(train, schema)
    # One model of fixed size comes to the driver.
    means = trained.repartition("part").mapInArrow(add, schema).toArrow()
    if not means.num_rows:
        return weights
    values = flat(weights)
    for number, own in zip(means["part"].to_pylist(), means["weights"]):
        values[number * step : number * step + len(own)] = own.values.to_numpy()
    return unflat(values, weights)


def piece(number: int, values: np.ndarray, seen: int) -> pa.RecordBatch:
    own = pa.array([values.astype(np.float32)], pa.list_(pa.float32()))
    return pa.RecordBatch.from_arrays(
        [pa.array([number], pa.int32()), own, pa.array([seen], pa.int64())], ["part", "weights", "seen"]
    )


def score(docs: DataFrame, id_: str = "doc_id", text: str = "text", warm: int = WARM, head: int = HEAD) -> DataFrame:
    """Per row: the id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score``, ``score``."""
    docs = docs.select(id_, text)
    out = held_out(id_, FOLDS, FOLD)
    learn = docs.filter(~out)
    counts = materialize(count_words(learn, text), "counts")
    ends = learn.count()
    voc, weights = build(counts, ends, learn, id_, text, warm, head)
    shared = docs.sparkSession.sparkContext.broadcast((voc, weights))

    def run(batch):
        voc, weights = shared.value
        column = batch.column(text)
        toks = tokens(column, voc)
        n = np.bincount(toks.owner, minlength=toks.texts)
        known = toks.place >= 0
        heads = np.bincount(toks.owner[known], minlength=toks.texts)
        base = np.bincount(toks.owner[known], np.log10(voc.counts[toks.place[known]] + 1.0), toks.texts)
        model = log_odds(weights, voc.starts, *sequences(toks, voc)) - (n - heads) * np.log10(voc.rare_norm)
        base = base + np.log10(voc.ends + 1.0) - (n + 1) * np.log10(voc.total + voc.distinct + 1.0)
        text_of, hashes, times = toks.rest
        cut = np.searchsorted(text_of[np.argsort(text_of, kind="stable")], np.arange(toks.texts + 1))
        order = np.argsort(text_of, kind="stable")
        hashes, times = hashes[order].view(np.int64), times[order]
        yield {
            id_: batch.column(id_),
            "n_tokens": n + 1,
            "known": heads + (voc.ends > 0),
            "base": base,
            "model": model,
            "words": [hashes[a:b] for a, b in zip(cut[:-1], cut[1:])],
            "times": [times[a:b] for a, b in zip(cut[:-1], cut[1:])],
        }

    kind = docs.schema[id_].dataType.simpleString()
    schema = (
        f"`{id_}` {kind}, n_tokens bigint, known bigint, base double, model double, words array<bigint>, times array<bigint>"
    )
    rows = map_batches(docs, run, schema).withColumn("_row", F.monotonically_increasing_id())
    rows = materialize(rows, "scored")
    pairs = rows.select("_row", F.explode(F.arrays_zip("words", "times")).alias("p"))
    pairs = pairs.select("_row", F.col("p.words").alias("word"), F.col("p.times").alias("times"))
    count = F.coalesce(F.col("n"), F.lit(0))
    sums = (
        pairs.join(counts, "word", "left")
        .groupBy("_row")
        .agg(
            F.sum(F.col("times") * F.log10(count + 1.0)).alias("rest"),
            F.sum(F.when(count > 0, F.col("times")).otherwise(0)).alias("rest_known"),
        )
    )
    done = rows.drop("words", "times").join(sums, "_row", "left")
    rest = F.coalesce(F.col("rest"), F.lit(0.0))
    return done.select(
        id_,
        held_out(id_, FOLDS, FOLD).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce(F.col("rest_known"), F.lit(0))).alias("n_known"),
        F.lit(voc.total).cast("bigint").alias("train_tokens"),
        (F.col("base") + rest).alias("base_score"),
        (F.col("model") + rest).alias("score"),
    )
