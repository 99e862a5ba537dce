import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from plenum.llm import exact_dedup, mixing, sharding
from plenum.llm.queries import QUERIES

SPACE = re.compile(r"[\x20\x09-\x0D]+")


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000), st.integers(0, 3000))
def test_fingerprints_combine(data, cut):
    make = exact_dedup.Fingerprints()
    left, right = data[:cut], data[cut:]
    whole = make.combine(make.whole(left), make.whole(right))
    assert make.whole(data) == whole
    h = 0
    for b in data:
        h = (h * make.bases[0] + b) % make.moduli[0]
    assert whole[0][0] == h and whole[1] == len(data)


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="ab \t\n\x0b\ré ", max_size=60))
def test_normalised(text):
    assert exact_dedup.normalised(text.encode()) == SPACE.sub(" ", text).encode()


def expected(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[SPACE.sub(" ", t or "")].append(i)
    out = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, keep, len(ids), i == keep, sha) for i in ids]
    return Counter(out)


@pytest.mark.parametrize("primes", [exact_dedup.PRIMES, (3, 5)])
def test_exact_duplicates(spark, documents, primes):
    """Also with primes so small that different texts collide."""
    df = documents()
    got = exact_dedup.exact_duplicates(df, primes=primes)
    assert Counter(map(tuple, got.collect())) == expected([(r.doc_id, r.text) for r in df.collect()])
    assert exact_dedup.exact_duplicates(df.limit(0)).count() == 0


def test_chunks_are_compared(spark, documents):
    a, b = "x" * 200_000, "x" * 199_999 + "y"
    df = documents([a, b, a], extra=False)
    got = exact_dedup.exact_duplicates(df, primes=(1, 1))
    assert sorted((r.doc_id, r.keep_id) for r in got.collect()) == [(10, 10), (11, 11), (12, 10)]


def test_drop_exact_duplicates(spark, documents):
    df = documents()
    got = exact_dedup.drop_exact_duplicates(df)
    assert got.columns == df.columns
    rows = got.collect()
    norm = [SPACE.sub(" ", r.text or "") for r in rows]
    assert len(norm) == len(set(norm)) == len({SPACE.sub(" ", r.text or "") for r in df.collect()})


def test_targets_are_the_fixed_point(spark):
    rng = np.random.default_rng(1)
    sizes = [0, 3, 10, 500, 4, 1000, 7, 90, 12]
    for _ in range(3):
        names = [f"s{i:02d}" for i in range(len(sizes))]
        df = spark.createDataFrame([(n, int(s)) for n, s in zip(names, sizes)], "source string, source_size bigint")
        got = {r.source: r.target for r in mixing.targets(df).collect()}
        weights = {n: (5, 2, 1)[k % 3] for k, n in enumerate(names)}
        cap = {n: 3 * s for n, s in zip(names, sizes)}
        target, fixed, left = {}, set(), sum(sizes)
        while True:
            open_ = [n for n in names if n not in fixed]
            share = {n: left * weights[n] / sum(weights[m] for m in open_) for n in open_}
            over = [n for n in open_ if share[n] >= cap[n]]
            if not over:
                target.update(share)
                break
            for n in over:
                fixed.add(n)
                target[n] = cap[n]
                left -= cap[n]
        assert got == pytest.approx(target)
        sizes = rng.integers(0, 2000, len(sizes)).tolist()


def test_mixing(spark, documents):
    df = documents([" ".join(["w"] * n) for n in np.random.default_rng(2).integers(0, 60, 300)])
    rows = mixing.mixed(df, bits=(3, 2)).collect()
    assert len(rows) == df.count()
    taken, target = Counter(), {}
    for r in rows:
        assert r.taken == r.times * r.size and r.times <= 3
        taken[r.source] += r.taken
        target[r.source] = r.target
    for source in target:
        assert abs(taken[source] - target[source]) <= 60
    assert sorted(map(str, mixing.mixed(df, bits=(12, 12)).collect())) == sorted(map(str, rows))
    assert mixing.mixed(df.limit(0)).count() == 0
    copies = Counter((r.doc_id, r.text, r.source) for r in mixing.mix_documents(df, bits=(3, 2)).collect())
    wanted = Counter()
    for r in rows:
        wanted[r.doc_id, r.source] += r.times
    for (i, _, s), n in copies.items():
        wanted[i, s] -= n
    assert not any(wanted.values())


def test_mixing_null_source_and_awkward_texts(spark, documents):
    got = mixing.mixed(documents())
    assert got.count() == documents().count()
    assert sum(r.taken for r in got.collect()) > 0


def test_sharding(spark, documents):
    rng = np.random.default_rng(3)
    texts = ["same text"] * 150 + ["x" * int(n) for n in rng.integers(0, 200, 400)]
    df = documents(texts)
    rows = sharding.kd_shards(df, 8, buckets=16).collect()
    assert len(rows) == df.count()
    size, slots, groups = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        size[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        groups[r.text_crc32].add(r.shard)
    assert set(size) == set(range(8))
    assert max(size.values()) - min(size.values()) <= 900
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    # Only groups at a split point are cut: seven splits, one group each at most.
    assert sum(len(s) > 1 for s in groups.values()) <= 7


def test_sharding_awkward(spark, documents):
    rows = sharding.kd_shards(documents(), 3).collect()
    assert len(rows) == documents().count()
    assert sharding.kd_shards(documents().limit(0), 8).count() == 0
    assert {r.shard for r in sharding.kd_shards(documents(["a"] * 4, extra=False), target_bytes=4).collect()} <= {0, 1}


def test_registered_shards_are_even(spark):
    rows = QUERIES["op7_sharding"](spark, "/root/testdata/sf0.001").collect()
    size = Counter()
    for r in rows:
        size[r.shard] += r["size"]
    assert max(size.values()) < 1.2 * min(size.values())
