import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from plenum.llm import packing, quality
from plenum.llm.arrow import slices, word_hashes, word_spans
from plenum.llm.queries import QUERIES, tokenizer_path
from tokenizers import Tokenizer

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXT = st.text(alphabet="aAb'sé́# ſΣ1, \t\n\x0b", max_size=80)
SPECIAL = st.lists(st.sampled_from(["<|startoftext|>", "<|endoftext|>", "<|STARTOFTEXT|>", "<|", "a", "B ", " ", "\n", "|>"]), max_size=9)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6), st.sampled_from([3, 17, 1 << 20]))
def test_words_of_slices(texts, limit):
    found = defaultdict(list)
    for part in slices(pa.array(texts, pa.string()), limit):
        for a, b, k in zip(*word_spans(part)):
            found[part.first + k].append(part.data[a:b].tobytes().decode())
    assert [found[k] for k in range(len(texts))] == [WORD.findall(t or "") for t in texts]


def test_word_hashes_follow_the_bytes():
    part = next(slices(pa.array(["Cat cat dog Cat", "dog cAT"])))
    starts, ends, _ = word_spans(part)
    h = word_hashes(part.data, starts, ends, False)
    assert h[0] == h[3] != h[1] and h[2] == h[4]
    low = word_hashes(part.data, starts, ends, True)
    assert low[0] == low[1] == low[5]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(TEXT, SPECIAL.map("".join)), min_size=1, max_size=5))
def test_ids_are_those_of_whole_texts(texts):
    plain = Tokenizer.from_file(tokenizer_path())
    got = [x.tolist() for x in packing.document_ids(pa.array(texts), tokenizer_path())]
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_encoder_forgets():
    enc = packing.WordEncoder(tokenizer_path(), limit=600)
    first = enc.encode([b"aa", b"bb", b"cc"])
    assert enc.encode([b"dd", b"aa", b"bb"])[1:] == first[:2]
    assert set(enc.known) == {b"dd", b"aa", b"bb"}


def test_new_words_are_encoded_together():
    enc = packing.WordEncoder(tokenizer_path())
    given_texts, plain = [], enc._ids
    enc._ids = lambda texts: given_texts.extend(texts) or plain(texts)
    words = [f"word{k}x" for k in range(3000)] + ["A", "A'S", "''", "<|endoftext|>", "a<|endoftext|>b", "<|ENDOFTEXT|>", "\x00", "\x1f", "\u0301x", "\u00a0", "\u0130"]
    got = enc.encode([w.encode() for w in words] + [b"a\xe2\x82", b"\xff"])
    assert len(given_texts) < 20
    whole = enc.tokenizer.encode_batch([*words, "a\ufffd", "\ufffd"], add_special_tokens=False)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [e.ids for e in whole]


def test_known_words_are_not_encoded_again():
    enc = packing.WordEncoder(tokenizer_path())
    plain, asked = enc.encode, []
    enc.encode = lambda words: asked.extend(words) or plain(words)
    texts = pa.array([" ".join(f"w{k}x" for k in range(a, a + 9000)) for a in (0, 9000, 18_000, 0, 9000, 18_000)])
    parts = [packing.slice_ids(part, enc) for part in slices(texts, 80_000)]
    assert len(asked) == len(set(asked)) == 27_000
    assert sum(x.nbytes for x in (enc.store.hashes, enc.store.begin, enc.store.length, enc.store.ids)) < 50 * 27_000
    for k in range(3):
        assert parts[k][0].tolist() == parts[k + 3][0].tolist()
        assert parts[k][0].tolist() == enc.tokenizer.encode(texts[k].as_py(), add_special_tokens=False).ids
    enc.store.limit = 1
    assert [packing.slice_ids(part, enc)[0].tolist() for part in slices(texts, 80_000)] == [x.tolist() for x, _ in parts]


def test_words_that_letters_do_not_tell_apart_are_encoded_each():
    words = [b"aa", b"bb", b"cc"]
    whole = packing.WordEncoder(tokenizer_path()).encode(words)
    for letters in (0, 1, 7):
        other = packing.WordEncoder(tokenizer_path())
        other.letters[:] = letters
        assert other.encode(words) == whole


@pytest.mark.parametrize("n", [1, 2, 3, 2047, 2048, 2049, 5000, 8192])
def test_binary_lengths(n):
    lengths = packing.binary_lengths(n)
    assert sum(lengths) == n and lengths == sorted(lengths, reverse=True)
    assert all(x & (x - 1) == 0 and x <= 2048 for x in lengths)
    assert len(set(x for x in lengths if x < 2048)) == sum(x < 2048 for x in lengths)


def test_pack(spark, documents):
    plain = Tokenizer.from_file(tokenizer_path())
    df = documents()
    rows = packing.pack(df, tokenizer_path()).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    got, texts = Counter(), Counter()
    whole = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.sequence_id):
        whole[r.doc_id].append(r)
        assert len(r.ids) == 4 * r.length and r.offset == 0
    for i, pieces in whole.items():
        ids, begin = [], 0
        for r in pieces:
            begin = begin if r.start else len(ids)  # several rows may have this id
            assert r.start == len(ids) - begin
            ids += np.frombuffer(r.ids, "<u4").tolist()
        got[i] = ids
    for r in df.collect():
        texts[r.doc_id] = texts.get(r.doc_id) or []
        texts[r.doc_id] += [*plain.encode(r.text or "", add_special_tokens=False).ids, 1]
    for i, ids in got.items():
        assert Counter(ids) == Counter(texts[i])
    assert packing.pack(df.limit(0), tokenizer_path()).count() == 0


def test_registered_packing_against_brute_force(spark):
    plain = Tokenizer.from_file(tokenizer_path())
    rows = QUERIES["op2_packing"](spark, SF_DIR).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    assert set(pieces) == set(docs)
    for i, text in docs.items():
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            at += r.length
            assert r.ids_crc32 == zlib.crc32(ids[r.start : at].tobytes())
        assert at == len(ids)


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(5)}
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)), len(covered),
    )


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é#|\n\t", max_size=120)), min_size=1, max_size=5))
def test_statistics(texts):
    got = quality.statistics(pa.array(texts, pa.string()))
    assert [tuple(r[:5]) for r in got] == [brute(t) for t in texts]


LINE = st.builds(
    "{}{}{}".format,
    st.sampled_from(["Item: ", "Items ", "é"]),
    st.sampled_from(["apple", "grape", "lemon", "lemom", "  "]),
    st.sampled_from(["", " ", "\r"]),
)


@settings(max_examples=120, deadline=None)
@given(st.lists(st.lists(LINE, max_size=12).map("\n".join), min_size=1, max_size=4))
def test_lines_that_begin_alike(texts):
    got = quality.statistics(pa.array(texts, pa.string()))
    assert [tuple(r[:5]) for r in got] == [brute(t) for t in texts]


def test_lines_of_equal_hash_are_compared(monkeypatch):
    monkeypatch.setattr(quality, "mix", lambda x: x * np.uint64(0))
    got = quality.statistics(pa.array(["one a\ntwo b\none a\nsix c", "x\ny\nx"]))
    assert got[:, 3].tolist() == [1, 1]


def test_statistics_of_long_texts(documents):
    long = "\n".join(["a line of some words"] * 3 + [f"{i} x{i}" for i in range(300_000)])
    got = quality.statistics(pa.array(["x", long, "y"]))
    assert tuple(got[1][:5]) == brute(long)


def test_forest_isolates():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(0, 1, (2000, 4)), rng.normal(6, 1, (60, 4))
    forest = quality.IsolationForest.fit(good, bad)
    a, b = forest.score(good), forest.score(bad)
    assert (b > quality.calibrated(a, b)).mean() > 0.9 and (a > quality.calibrated(a, b)).mean() <= 0.002


def test_judge(spark, documents):
    df = documents()
    labels = spark.createDataFrame([(10, 1), (10, 0), (None, 1), (17, 1)], "doc_id bigint, quality int")
    rows = quality.judge(df, labels).collect()
    texts = Counter(brute(r.text) for r in df.collect())
    assert Counter(tuple(r[1:6]) for r in rows) == texts
    for r in rows:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality.keep_good(df, labels).columns == df.columns
    assert quality.keep_good(df, labels).count() == sum(r.kept for r in rows)
    assert quality.judge(df.limit(0), labels).count() == 0
    assert quality.judge(df, labels.limit(0)).count() == df.count()


def test_fit_counts_every_labelled_row(spark):
    words = "concat_ws(' ', transform(sequence(0, 11 + id % 50), k -> concat('w', id * 100 + k, repeat('X', int(id * 7 % 13)))))"
    docs = spark.range(13_500).selectExpr("id AS doc_id", f"concat({words}, repeat(' 42!', int(id / 13000) * 4)) AS text")
    labels = docs.selectExpr("doc_id", "IF(doc_id < 13000, 1, 0) AS quality")
    stats = quality.rule_statistics(docs, "doc_id", "text").cache()
    rows = quality.labelled_rows(stats, labels, "doc_id", "quality").collect()
    forest, threshold, ranges = quality.fit(stats, labels)
    good, bad = (np.array([r["_x"] for r in rows if r["_label"] == k]) for k in (1, 0))
    assert (len(good), len(bad)) == (13_000, 500)
    ends = np.quantile(good, [quality.OUTSIDE, 1 - quality.OUTSIDE], axis=0)
    assert np.allclose(ranges[:2], ends)
    scores = [forest.score(quality.outside(x, ranges)) for x in (good, bad)]
    assert threshold == quality.calibrated(*scores)
    stats.unpersist()


def test_order_statistics_of_repeated_and_uneven_values(spark):
    rng = np.random.default_rng(1)
    x = np.stack([rng.choice([0.0, 1e-9, 3.0, 1e12], 400), rng.exponential(1, 400) ** 9], axis=1)
    n = rng.integers(1, 50, 400)
    rows = spark.createDataFrame([(r.tolist(), int(k)) for r, k in zip(x, n)], "_x array<double>, _n bigint").repartition(3)
    whole = np.sort(np.repeat(x, n, axis=0), axis=0)
    places = [(c, p) for c in (0, 1) for p in (0, 7, len(whole) // 2, len(whole) - 1)]
    assert quality.order_statistics(rows, places) == [whole[p, c] for c, p in places]


def test_registered_quality_against_labels(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in QUERIES["op4_quality_rules"](spark, sf).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for i, text in docs.items():
        assert tuple(rows[i][1:6]) == brute(text)
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    good = [rows[r.doc_id].kept for r in labels if r.quality == 1]
    bad = [rows[r.doc_id].kept for r in labels if r.quality == 0]
    assert np.mean(good) > 0.9 and np.mean(bad) < 0.2
