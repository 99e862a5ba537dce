import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from plenum.llm import ngram_join as nj
from plenum.llm.components import components, joined_components
from plenum.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = WORD.findall((text or "").translate(UPPER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)))


def brute(rows):
    """(id, size, smallest id of the component) by comparing all pairs that share a shingle."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    where = defaultdict(list)
    for k, s in enumerate(sets):
        for g in s:
            where[g].append(k)
    for k, s in enumerate(sets):
        for j, n in Counter(j for g in s for j in where[g] if j < k).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                parent[find(k)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if sets[k] and i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return Counter((i, len(sets[k]), least.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(rows))


def got(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def edited(rng, words, share):
    words = list(words)
    for k in np.flatnonzero(rng.random(len(words)) < share):
        words[k] = f"new{rng.integers(1 << 30)}"
    return " ".join(words)


def near_texts(seed, groups=6, copies=25):
    """Groups of near copies of many sizes, a common passage, and chains."""
    rng = np.random.default_rng(seed)
    passage = " ".join(f"p{k}" for k in range(12))
    texts = []
    for g in range(groups):
        words = [f"g{g}w{rng.integers(900)}" for _ in range(int(rng.integers(6, 300)))]
        texts += [edited(rng, words, s) for s in rng.choice([0.005, 0.02, 0.04, 0.06], copies)]
    texts += [passage + " " + " ".join(f"u{rng.integers(9999)}" for _ in range(int(n))) for n in rng.integers(0, 40, 60)]
    texts += [" ".join(f"c{k}" for k in range(a, a + 60)) for a in range(0, 60, 4)]
    return texts


@pytest.mark.parametrize("seed, heavy", [(0, 8), (1, 3), (2, 1)])
def test_links_are_those_of_all_pairs(spark, documents, seed, heavy):
    """Also where most buckets are dear, so that representatives must find the links."""
    df = documents(near_texts(seed))
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert got(nj.near_duplicates(df, heavy=heavy)) == brute(rows)


def test_awkward(spark, documents):
    df = documents()
    assert got(nj.near_duplicates(df)) == brute([(r.doc_id, r.text) for r in df.collect()])
    assert nj.near_duplicates(df.limit(0)).count() == 0
    kept = nj.one_of_each(df)
    assert kept.columns == df.columns
    texts = [shingles(r.text) for r in kept.collect()]
    assert len([t for t in texts if t]) == len({t for t in texts if t})


def test_thin_sets_are_found(spark, documents, monkeypatch):
    """With so few segments that sets lack units, sets of near size are compared."""
    monkeypatch.setattr(nj, "segments", lambda last: np.maximum(last * 0 + 2, 1))
    df = documents(near_texts(3, groups=2, copies=6), extra=False)
    assert got(nj.near_duplicates(df)) == brute([(r.doc_id, r.text) for r in df.collect()])


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.integers(0, 40), st.integers(0, 40), st.integers(0, 2**31))
def test_similar_sets_share_a_signature(common, left, right, seed):
    rng = np.random.default_rng(seed)
    shared, a, b = (rng.integers(0, 1 << 62, n).astype(np.uint64) for n in (common, left, right))
    x, y = np.unique(np.concatenate([shared, a])), np.unique(np.concatenate([shared, b]))
    both = len(np.intersect1d(x, y))
    owner, n = np.repeat([0, 1], [len(x), len(y)]), np.array([len(x), len(y)])
    (of, sig, info), units, needed = nj.signatures(owner, np.concatenate([x, y]), n)
    if 100 * both >= 75 * (len(x) + len(y) - both):
        assert set(sig[of == 0].tolist()) & set(sig[of == 1].tolist())
    for (e, d), need in zip(units, needed):
        assert (e + d >= need).all()


def test_bands_reach_every_partner():
    first = nj.band_table(3000)
    band = np.searchsorted(first, np.arange(1, 3000), "right") - 1
    for n in range(1, 2000):
        assert band[n * 4 // 3 - 1] <= band[n - 1] + 1


def test_shingle_sets_of_slices():
    texts = ["a b c d e f", None, "A b", "x " * 30, "long " * 10 + "y"]
    owner, shingle = nj.shingle_sets(pa.array(texts))
    assert np.bincount(owner, minlength=5).tolist() == [len(shingles(t)) for t in texts]


def test_very_long_texts(spark, documents):
    """More shingles than 16 bits count, in one segment group and in all."""
    long = " ".join(f"w{k}" for k in range(2_500_000))
    df = documents([long, long + " and a few words more", "w1 w2 w3 w4 w5 w6"], extra=False, ids=[3, 4, 5])
    found = got(nj.near_duplicates(df))
    assert found == Counter([(3, 2_499_996, 3), (4, 2_500_001, 3), (5, 2, 5)])


def test_joined_components(spark):
    labels = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (6, 5), (9, 9), (10, 9)], "node bigint, component bigint")
    links = spark.createDataFrame([(2, 6), (6, 20), (21, 22)], "a bigint, b bigint")
    found = dict(map(tuple, joined_components(labels, links).collect()))
    assert found == {1: 1, 2: 1, 5: 1, 6: 1, 20: 1, 9: 9, 10: 9, 21: 21, 22: 21}
    assert joined_components(labels, links.limit(0)).count() == 6


def test_components(spark):
    links = [(k, k + 1) for k in range(50)] + [(100, 101), (103, 101), (7, 7), (200, 199)]
    df = spark.createDataFrame(links, "a bigint, b bigint")
    got = dict((r.node, r.component) for r in components(df).collect())
    assert got == {**{k: 0 for k in range(51)}, 100: 100, 101: 100, 103: 100, 199: 199, 200: 199}
    assert components(df.limit(0)).count() == 0


def test_registered_join(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got(QUERIES["op1_ngram_jaccard_join"](spark, SF)) == brute(rows)
