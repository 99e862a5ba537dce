"""Toxicity by averaged subword embeddings under a linear softmax.

A word is the mean of the vectors of its character n-grams (3 to 6 bytes of the lower-cased
word between two marks) and of the word itself; a text is the mean of its words; a linear
softmax over two classes scores it. Vectors and softmax are trained jointly, by gradient
descent in numpy, so words never seen share the vectors of their parts. The model is linear
after the averages, so each subword counts with one number when texts are scored.

Labels come from at most ``PER_CLASS`` rows of each class. A quarter of them, set apart,
places the score: ``THRESHOLD`` is where F1 is best on it. Defined results: NULL and empty
texts and texts of white space score like a text of average words; repeated rows score the
same; without rows of both classes every score is 0; an empty table gives an empty result.
Only the id and the text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.llm.arrow import BYTE_CODES, LOWER, Slice, map_batches, mix, powers, slices, word_hashes, word_spans
from plenum.llm.labelled import held_out, sample_by_class

PER_CLASS = 1200
FOLDS, FOLD = 3, 1
BUCKETS = 1 << 17
SIZES = (3, 4, 5, 6)
DIM = 8
GAIN = 40.0  # on the averages, which are small in long texts
SUBWORDS = 2048
LEAST_TEXTS = 5
TRAIN_SLICE = 256 << 10
DECAY = 1e-4
STEPS = 60
RATE = 0.05
THRESHOLD = 0.7


def unique_words(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of one place of each different word, which word stands at each place,
    and the text of each place."""
    starts, ends, owner = word_spans(part)
    hashes = word_hashes(part.data, starts, ends, True)
    _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    return starts[first], ends[first], which, owner


def subwords(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The subword numbers of some words, and the word each belongs to."""
    size = ends - starts + 2
    upto = np.cumsum(size)
    begin = upto - size
    marked = np.full(int(upto[-1]) if len(upto) else 0, ord("<"), np.uint8)
    inner = np.repeat(starts - begin - 1, size) + np.arange(len(marked))
    inside = np.ones(len(marked), bool)
    inside[begin] = False
    inside[upto - 1] = False
    marked[inside] = LOWER[data[inner[inside]]]
    marked[upto - 1] = ord(">")
    codes = BYTE_CODES[marked]
    owner = np.repeat(np.arange(len(size)), size)
    left = np.repeat(upto, size) - np.arange(len(marked))  # bytes from here to the word's end
    ids, of = [], []
    weights = powers(max(SIZES))
    for n in SIZES:
        total = np.zeros(len(marked), np.uint64)
        for k in range(n):
            total[: len(marked) - k] += codes[k:] * weights[k]
        whole = left >= n
        ids.append(mix(total[whole] + np.uint64(n)) & np.uint64(BUCKETS - 1))
        of.append(owner[whole])
    if len(size):
        place = np.arange(len(marked)) - np.repeat(begin, size)
        whole = np.add.reduceat(codes * powers(int(size.max()))[place], begin)
        ids.append(mix(whole) & np.uint64(BUCKETS - 1))
        of.append(np.arange(len(size)))
    return np.concatenate(ids).astype(np.int64), np.concatenate(of)


def _entries(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, subword, weight) of a slice: the means over words of the means over subwords.
    A text cut into several slices has weights for each of them."""
    starts, ends, which, owner = unique_words(part)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    pair, count = np.unique(owner * len(starts) + which, return_counts=True)
    text, word = pair // len(starts), pair % len(starts)
    ids, of = subwords(part.data, starts, ends)
    ids = ids[np.argsort(of, kind="stable")]
    size = np.bincount(of, minlength=len(starts))
    begin = np.cumsum(size) - size
    each = size[word]
    upto = np.cumsum(each)
    places = np.repeat(begin[word] - (upto - each), each) + np.arange(int(upto[-1]))
    weight = count / np.bincount(owner, minlength=len(part.offsets) - 1)[text] / each
    return np.repeat(text, each) + part.first, ids[places], np.repeat(weight, each)


def telling(texts: pa.Array, y: np.ndarray, count: int = SUBWORDS, least: int = LEAST_TEXTS) -> np.ndarray:
    """The ``count`` subwords of ``least`` texts or more whose share of texts differs most
    between the classes, in standard errors."""
    seen = np.zeros((2, BUCKETS))
    for part in slices(texts, TRAIN_SLICE):
        text, ids, _ = _entries(part)
        pair = np.unique(text * BUCKETS + ids)
        np.add.at(seen, (y[pair // BUCKETS], pair % BUCKETS), 1)
    total = np.bincount(y, minlength=2)[:, None]
    share = seen.sum(axis=0) / total.sum()
    error = np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / total).sum())
    gap = np.abs(seen[1] / total[1] - seen[0] / total[0]) / error
    gap[seen.sum(axis=0) < least] = -1
    best = np.argsort(-gap, kind="stable")[:count]
    return np.sort(best[gap[best] > 0])


def train(texts: pa.Array, y: np.ndarray, steps: int = STEPS, seed: int = 5) -> tuple[np.ndarray, float]:
    """One number per subword and a bias: the log odds of a text are the mean over its
    words of the mean over their subwords, plus the bias."""
    used = telling(texts, y)
    place = np.full(BUCKETS, -1)
    place[used] = np.arange(len(used))
    bags = np.zeros((len(texts), len(used)), np.float32)
    for part in slices(texts, TRAIN_SLICE):
        text, ids, weight = _entries(part)
        kept = place[ids] >= 0
        rows = len(part.offsets) - 1
        flat = (text[kept] - part.first) * len(used) + place[ids[kept]]
        own = np.bincount(flat, weight[kept], minlength=rows * len(used)).reshape(rows, len(used))
        bags[part.first : part.first + rows] += own
    bags *= GAIN
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (len(used), DIM)).astype(np.float32)
    out = rng.normal(0, 0.1, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    target = np.eye(2, dtype=np.float32)[y]
    share = np.bincount(y, minlength=2)
    weight = (1 / (2 * share[y]))[:, None].astype(np.float32)  # both classes count alike
    state = [[p, np.zeros_like(p), np.zeros_like(p)] for p in (vectors, out, bias)]
    for step in range(1, steps + 1):
        hidden = bags @ vectors
        logits = hidden @ out + bias
        logits -= logits.max(axis=1, keepdims=True)
        soft = np.exp(logits)
        soft /= soft.sum(axis=1, keepdims=True)
        slope = (soft - target) * weight
        back = bags.T @ (slope @ out.T)
        for (p, m, v), g in zip(state, (back, hidden.T @ slope, slope.sum(axis=0))):
            g = g + DECAY * p
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    table = np.zeros(BUCKETS, np.float32)
    table[used] = GAIN * (vectors @ (out[:, 1] - out[:, 0]))
    return table, float(bias[1] - bias[0])


def log_odds(texts: pa.Array, table: np.ndarray, bias: float) -> np.ndarray:
    total, count = np.zeros(len(texts)), np.zeros(len(texts))
    for part in slices(texts):
        starts, ends, which, owner = unique_words(part)
        if not len(starts):
            continue
        ids, of = subwords(part.data, starts, ends)
        word = np.bincount(of, table[ids], minlength=len(starts)) / np.bincount(of, minlength=len(starts))
        rows = len(part.offsets) - 1
        total[part.first : part.first + rows] += np.bincount(owner, word[which], minlength=rows)
        count[part.first : part.first + rows] += np.bincount(owner, minlength=rows)
    return total / np.maximum(count, 1) + bias


def best_cut(odds: np.ndarray, y: np.ndarray) -> float:
    """The middle of the gap between neighbouring values at which F1 is best."""
    order = np.argsort(-odds, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    k = int(np.argmax(f1))
    return float((odds[order[k]] + odds[order[min(k + 1, len(y) - 1)]]) / 2)


def fit(docs: DataFrame, labels: DataFrame, label="toxic", id_="doc_id", text="text", per_class=PER_CLASS):
    """(number per subword, bias, cut, slope), or None without both classes."""
    rows = sample_by_class(docs, labels, label, per_class, ~held_out(id_, FOLDS, FOLD), id_, text)
    got = rows.select("_place", F.col("_label").cast("int").alias("_label"), "_text").toArrow()
    if got.num_rows == 0:
        return None
    got = got.sort_by([("_place", "ascending"), ("_label", "ascending"), ("_text", "ascending")]).combine_chunks()
    y, place = got["_label"].to_numpy(), got["_place"].to_numpy()
    texts = got["_text"].combine_chunks()
    if not (y == 1).any() or not (y == 0).any():
        return None
    aside = place % 4 == 0
    if not ((y == 1) & aside).any() or not ((y == 0) & aside).any():
        aside = np.zeros(len(y), bool)
    learn = ~aside
    table, bias = train(texts.filter(pa.array(learn)), y[learn].astype(np.int64))
    check = aside if aside.any() else learn
    odds = log_odds(texts.filter(pa.array(check)), table, bias)
    cut = best_cut(odds, y[check])
    return table, bias, cut, 4 / max(float(np.std(odds)), 1e-6)


def score(docs: DataFrame, labels: DataFrame, id_="doc_id", text="text", per_class=PER_CLASS) -> DataFrame:
    """Per row: the id, ``held_out``, ``score``, ``predicted``."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_=id_, text=text, per_class=per_class))
    shift = float(np.log(THRESHOLD / (1 - THRESHOLD)))

    def run(batch):
        texts = batch.column(text)
        if shared.value is None:
            scores = np.zeros(len(texts))
        else:
            table, bias, cut, slope = shared.value
            odds = (log_odds(texts, table, bias) - cut) * slope + shift
            scores = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        yield {id_: batch.column(id_), "score": scores, "predicted": (scores >= THRESHOLD).astype(np.int32)}

    kind = docs.schema[id_].dataType.simpleString()
    scored = map_batches(docs.select(id_, text), run, f"`{id_}` {kind}, score double, predicted int")
    return scored.select(id_, held_out(id_, FOLDS, FOLD).alias("held_out"), "score", "predicted")
