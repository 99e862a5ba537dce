import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from plenum.llm import language_model as lm
from plenum.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def check_base(rows, docs):
    counts = Counter()
    for i, t in docs:
        if not held(i):
            counts.update(words(t))
            counts[None] += 1
    total, distinct = sum(counts.values()), len(counts)
    expected = []
    for i, t in docs:
        own = [*words(t), None]
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in own)
        expected.append((str(i), held(i), len(own), sum(counts[w] > 0 for w in own), total, base))
    got = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows]
    for a, b in zip(sorted(got), sorted(expected)):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9)
    assert len(got) == len(expected)


@pytest.mark.parametrize("head", [1, 3, 1 << 16])
def test_score_awkward(spark, documents, head):
    texts = [None, "", " \n", "one", "The the cat sat on THE mat", "the the cat É é", "a b " * 9000, "the\x0bcat"]
    df = documents(texts * 3)
    rows = lm.score(df, warm=2, head=head).collect()
    check_base(rows, [(r.doc_id, r.text) for r in df.collect()])
    assert all(r.score <= 0 for r in rows)


def test_empty(spark, documents):
    assert lm.score(documents().limit(0)).count() == 0


def test_registered_scores(spark):
    rows = QUERIES["op5_lm_scoring"](spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    check_base(rows, [(r.doc_id, r.text) for r in docs])


def vocabulary():
    hashes = np.arange(10, 18, dtype=np.uint64)
    voc = lm.Vocabulary(hashes, np.array([90, 40, 30, 20, 10, 5, 3, 2]), 260, 20, 20)
    voc.arrange(np.array([0, 0, 0, 0, 1, 1, 1, 1]))
    return voc


def test_shares_sum_to_one():
    voc = vocabulary()
    mass = np.bincount(voc.classes, np.exp(voc.within))
    assert mass == pytest.approx(np.ones(len(mass)))
    assert np.exp(voc.priors).sum() == pytest.approx(1)


def test_state_is_carried_through_whole_texts():
    """Scores in lanes equal those of one text after another, step by step."""
    voc = vocabulary()
    rng = np.random.default_rng(0)
    weights = {k: (v + rng.normal(0, 0.3, v.shape)).astype(np.float32) for k, v in lm.start_weights(voc).items()}
    owner = np.repeat([0, 2, 3, 4], [5, 9000, 1, 40])
    toks = lm.Tokens(owner, rng.integers(-1, 8, len(owner)), None, 5)
    inputs, target, slots, bounds = lm.sequences(toks, voc)
    got = lm.log_odds(weights, voc.starts, inputs, target, slots, bounds)
    for k in range(5):
        h, total = np.zeros((1, lm.HIDDEN), np.float32), 0.0
        for t in range(bounds[k], bounds[k + 1]):
            h = lm._step(weights["table"][inputs[t]][None], h, weights["state"])[0]
            logits = (h @ weights["out"] + weights["bias"])[0].astype(float)
            total += logits[target[t]] - np.log(np.exp(logits).sum())
            if slots[t] >= 0:
                own = np.flatnonzero(np.searchsorted(voc.starts, np.arange(8), side="right") - 1 == target[t])
                inner = (weights["words"][own] @ h[0] + weights["share"][own]).astype(float)
                total += inner[own.tolist().index(slots[t])] - np.log(np.exp(inner).sum())
        assert got[k] == pytest.approx(total / math.log(10), rel=1e-4)


def test_gradient():
    """Backpropagation against finite differences, in one window."""
    voc = vocabulary()
    rng = np.random.default_rng(1)
    weights = {k: v + rng.normal(0, 0.3, v.shape).astype(np.float32) for k, v in lm.start_weights(voc).items()}
    toks = lm.Tokens(np.repeat([0, 1], [6, 9]), rng.integers(-1, 8, 15), None, 2)
    inputs, target, slots, bounds = lm.sequences(toks, voc)
    found = {}

    class Spy(lm.Trainer):
        def update(self, grads, used, rows):
            found.update(grads, used=used, rows=rows)

        def update_words(self, first, end, grads):
            for name, g in grads.items():
                whole = found.setdefault(name, np.zeros_like(self.w[name]))
                whole[first:end] += g

    class Still(lm.Trainer):
        def update_words(self, first, end, grads):
            pass

    place, begins = lm.spread(inputs, bounds, 2)
    h = np.zeros((place.shape[1], lm.HIDDEN), np.float32)

    def loss(w):
        return Still(w, voc.starts).window(inputs, target, slots, place, begins, h)[1] / len(inputs)

    Spy(weights, voc.starts).window(inputs, target, slots, place, begins, h)
    for name, at in [("words", (2, 3)), ("words", (6, 1)), ("share", (1,)), ("out", (3, 2)), ("bias", (1,)), ("state", (2, 5)), ("state", (4, 20)), ("state", (1, 40))]:
        up, down = ({k: v.astype(np.float64) for k, v in weights.items()} for _ in range(2))
        up[name][at] += 1e-3
        down[name][at] -= 1e-3
        assert found[name][at] == pytest.approx((loss(up) - loss(down)) / 2e-3, abs=2e-4)


def test_training_learns_what_follows():
    """Two kinds of texts with words of their own: classes become predictable."""
    voc = vocabulary()
    rng = np.random.default_rng(2)
    place = np.concatenate([rng.integers(0, 4, 30) if k % 2 else rng.integers(4, 8, 30) for k in range(200)])
    toks = lm.Tokens(np.repeat(np.arange(200), 30), place, None, 200)
    inputs, target, slots, bounds = lm.sequences(toks, voc)
    trainer = lm.Trainer(lm.start_weights(voc), voc.starts)
    first = trainer.run(inputs, target, slots, bounds, 64)
    for _ in range(10):
        last = trainer.run(inputs, target, slots, bounds, 64)
    assert last < 0.8 * first


def test_words_are_found():
    part = pa.array(["a b A", None, "c a"])
    voc = vocabulary()
    toks = lm.tokens(part, voc)
    assert toks.owner.tolist() == [0, 0, 0, 2, 2] and set(toks.place) == {-1}
    assert sorted(zip(toks.rest[0].tolist(), toks.rest[2].tolist())) == [(0, 1), (0, 2), (2, 1), (2, 1)]


def test_words_with_equal_leading_bits_are_found():
    voc = vocabulary()
    asked = np.array([9, 10, 13, 17, 18, 1 << 63, 13], np.uint64)
    assert voc.place(asked).tolist() == [-1, 0, 3, 7, -1, -1, 3]


@pytest.mark.parametrize("size", [1, 200])
def test_softmax_of_any_size(size):
    """Also where exponentials leave single precision."""
    rng = np.random.default_rng(4)
    states, goal = rng.uniform(-1, 1, (30, 17)).astype(np.float32), rng.integers(0, 50, 30)
    weights = (size * rng.normal(0, 1, (17, 50))).astype(np.float32)
    with np.errstate(over="ignore"):
        loss, down, slopes = lm.soft_slopes(states, weights, goal, 0.5)
    logits = states.astype(float) @ weights.astype(float)
    logits -= logits.max(axis=1, keepdims=True)
    share = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
    hit = logits[np.arange(30), goal] - np.log(np.exp(logits).sum(axis=1))
    share[np.arange(30), goal] -= 1
    assert loss == pytest.approx(-hit.sum(), rel=1e-4)
    assert down == pytest.approx(0.5 * share @ weights[:-1].T, abs=1e-4 * size)
    assert slopes == pytest.approx(0.5 * states.T @ share, abs=1e-4)


def test_weights_do_not_depend_on_pieces(monkeypatch):
    """A class whose steps are worked on in several pieces is moved once a window."""
    voc = vocabulary()
    voc.arrange(np.zeros(8, np.int64))
    voc.classes[:], voc.starts, voc.slot = 0, np.array([0, 8]), np.arange(8)
    voc.priors = np.log(np.array([0.8, 0.1, 0.1]))
    toks = lm.Tokens(np.repeat([0, 1], [60, 90]), np.random.default_rng(5).integers(-1, 8, 150), None, 2)
    found = []
    for cells in (1 << 15, 24):
        monkeypatch.setattr(lm, "CELLS", cells)
        trainer = lm.Trainer(lm.start_weights(voc), voc.starts)
        trainer.run(*lm.sequences(toks, voc))
        found.append(lm.flat(trainer.w))
    assert found[0] == pytest.approx(found[1], abs=1e-3)
