"""The pipeline's stages, each against plain Python on the rows that it was given."""

import random
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from plenum.llm import quality
from plenum.llm.queries import tokenizer_path
from tokenizers import Tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def shingles(text):
    words = WORD.findall((text or "").lower())
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


@pytest.fixture
def folder(spark, tmp_path):
    """Documents with NULLs, repeated rows, exact and near copies, a hot source, and columns
    whose names the operators use; labels with NULLs and ids labelled twice."""
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randrange(12, 300))) for _ in range(60)]
    texts += [t.replace(" ", " \n\t") for t in texts[:8]] + [t + " one more" for t in texts[20:32]]
    texts += [None, "", "few words", "spam spam spam spam spam " * 30, " ".join(f"v{k}" for k in range(200_000))]
    rows = [(i, t, "en", "hot" if i % 3 else f"s{i % 4}" if i % 5 else None, 1) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[40], None, "hot", None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", *[f"'c' AS `{c}`" for c in ("size", "target", "_n", "set", "kept")])
    df.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, int(i % 7 != 0), 0) for i in range(60)] + [(76, 0, 0), (75, 0, 1), (5, 1, 0), (None, 1, 0), (8, None, None)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def key(row):
    return (row.doc_id, row.text)


def test_each_stage_on_its_own_input(spark, folder):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "exact_dedup", "ngram_jaccard_join", "mixing", "packing"]
    docs = corpus_pipeline.Tables(spark, folder)("documents")
    seen, rows = {}, docs.collect()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, folder)
        assert docs.columns == before.columns
        seen[name] = (rows, rows := docs.collect())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()

    given, kept = seen["quality_rules"]
    assert not Counter(map(key, kept)) - Counter(map(key, given))
    for row in kept:
        stats = quality.statistics(pa.array([row.text]))[0]
        assert stats[0] >= 10 and 100 * stats[4] <= 20 * stats[0]
    assert sum(r.doc_id is not None and r.doc_id < 60 and r.doc_id % 7 != 0 for r in kept) >= 50

    given, kept = seen["exact_dedup"]
    groups = defaultdict(list)
    for row in given:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", row.text or "")].append(row)
    smallest = {t: min((r.doc_id for r in g if r.doc_id is not None), default=None) for t, g in groups.items()}
    assert Counter(r.doc_id for r in kept) == Counter(smallest.values())

    given, kept = seen["ngram_jaccard_join"]
    sets = [shingles(r.text) for r in given]
    parent = list(range(len(given)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for k, row in enumerate(given):
        least[find(k)] = min([x for x in (least.get(find(k)), row.doc_id) if x is not None], default=None)
    assert Counter(r.doc_id for r in kept) == Counter(least.values())
    assert len(kept) < len(given)

    given, kept = seen["mixing"]
    count = lambda rows: Counter((r.doc_id, len(WORD.findall(r.text or ""))) for r in rows)
    taken, size, source = count(kept), Counter(), Counter()
    assert all(n <= 3 * count(given)[k] for k, n in taken.items())
    for row in given:
        size[row.source] += len(WORD.findall(row.text or ""))
    for row in kept:
        source[row.source] += len(WORD.findall(row.text or ""))
    assert set(source) <= set(size) and all(source[s] <= 3 * size[s] + 1 for s in source)

    plain = Tokenizer.from_file(tokenizer_path())
    ids = Counter()
    for row in kept:
        own = np.array([*plain.encode(row.text or "", add_special_tokens=False).ids, 1], "<u4")
        ids[row.doc_id, len(own), zlib.crc32(own.tobytes())] += 1
    whole, at = Counter(), {}
    for row in sorted(packed, key=lambda r: r.sequence_id):
        at[row.doc_id] = b"" if row.start == 0 else at[row.doc_id]
        assert len(at[row.doc_id]) == 4 * row.start and len(row.ids) == 4 * row.length
        at[row.doc_id] += row.ids
        if len(at[row.doc_id]) == 4 * row.doc_tokens:
            whole[row.doc_id, row.doc_tokens, zlib.crc32(at[row.doc_id])] += 1
    assert whole == ids


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels"):
        df = spark.read.parquet(f"{folder}/{name}.parquet")
        df.limit(0).coalesce(1).write.parquet(str(tmp_path / "empty" / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0


def test_run_is_repeatable(spark, folder):
    pieces = lambda: sorted((r.doc_id or -1, r.start, r.length, zlib.crc32(r.ids)) for r in corpus_pipeline.run(spark, folder).collect())
    assert pieces() == pieces()
