"""The filter audit against applying the filters one after another."""

import re
from itertools import permutations

from plenum.llm.filter_audit import audit


def brute(docs, labels):
    marks = {}
    for i, q, t in labels:
        good, toxic = marks.get(i, (False, False))
        marks[i] = (good or q == 1, toxic or t == 1)
    fails = []
    for i, text, source in docs:
        body = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", body)
        found = set()
        if len(words) < 200:
            found.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            found.add("B")
        if 100 * len(re.findall("[A-Z]", body)) > 2 * len(body):
            found.add("C")
        if re.search(r"[#$%&*|]", body):
            found.add("D")
        if i is not None and any(j is not None and j < i and (t or "") == body for j, t, _ in docs):
            found.add("E")
        fails.append((source or "", found, marks.get(i, (False, False)) if i is not None else (False, False)))
    out = {}
    for part in {p for p, _, _ in fails}:
        removed_by = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = [(f, m) for p, f, m in fails if p == part]
            gone = []
            for step, letter in enumerate(order, 1):
                here = [(f, m) for f, m in left if letter in f]
                redundant = sum(letter in f for f, _ in gone)
                left = [(f, m) for f, m in left if letter not in f]
                gone += here
                unique = sum(f == {letter} for p, f, _ in fails if p == part)
                removed_by[letter] += len(here)
                out[part, "".join(order), step] = [
                    len(left), len(here), redundant, unique, sum(m[0] for _, m in here), sum(m[1] for _, m in here)
                ]
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(removed_by[order[step - 1]])
    return {key: tuple(counts) for key, counts in out.items()}


def test_audit_equals_filters_in_turn(spark, documents):
    docs = documents()
    labels = [(10, 1, 0), (14, 1, 1), (14, 0, 0), (15, None, 1), (17, 0, None), (None, 1, 1), (20, 1, None), (999, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    found = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in audit(docs, table).collect()}
    want = brute([(r.doc_id, r.text, r.source) for r in docs.collect()], labels)
    assert found == want
    assert len(found) % 600 == 0


def test_empty_tables(spark, documents):
    docs = documents().limit(0)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert audit(docs, labels).count() == 0
    assert audit(documents(), labels).filter("good_lost + toxic_lost > 0").count() == 0
