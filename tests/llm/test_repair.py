"""Conversation repair against a search over all edits, and against SQL."""

import hashlib
import random
import zlib

import pytest

from plenum.llm.queries import ORACLE
from plenum.llm.repair import CUT, DELETE, NEXT, cost_of, least_edits, repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def cheapest(kinds):
    """(cost, audit) by carrying every edit string along."""
    paths = {0: [(0, "")]}
    for kind in kinds:
        initial, new = kind & 3, {}
        for state, found in paths.items():
            for cost, audit in found:
                at = state
                for _ in range(3):
                    new.setdefault(at, []).append((cost + 3, audit + "D"))
                    if not kind & DELETE:
                        cut = 1 if kind & CUT else 0
                        if initial == NEXT[at] or (initial == 1 and at == 0):
                            new.setdefault(initial, []).append((cost + cut, audit + "K"))
                        new.setdefault(NEXT[at], []).append((cost + 2 + cut, audit + "R"))
                    at, cost, audit = NEXT[at], cost + 2, audit + "I"
        paths = new
    ends = {0: "", 1: "II", 2: "I", 3: ""}
    return min((c + 2 * len(ends[s]), a + ends[s]) for s, found in paths.items() for c, a in found)


def test_least_edits_of_all_short_conversations():
    rng = random.Random(5)
    for _ in range(800):
        kinds = bytes(rng.choice([0, 1, 2, 3, 2, 3]) | rng.choice([0, 0, DELETE, CUT]) for _ in range(rng.randint(0, 6)))
        audit = least_edits(kinds)
        assert (cost_of(kinds, audit), audit) == cheapest(kinds)


def expected(rows):
    """The contract, one conversation after another."""
    groups = {}
    for conv, turn, role, text in rows:
        found = groups.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        code = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if code == 0:
            continue
        text = "" if code == 1 else "".join(c for c in text if c not in ".!?") if code == 2 else text
        found += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    out = {}
    for conv, found in groups.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))
        seen, kinds, counts = set(), [], [0, 0, 0]
        for _, role, text in found:
            kind = {"s": 1, "u": 2, "a": 3}.get(role[:1], 0)
            body = text.strip(" \t\n\x0b\x0c\r")
            fault = 0 if not body else 1 if (role, text) in seen else 2 if body[-1] not in ".!?" else None
            if fault is not None:
                counts[fault] += 1
                kind |= CUT if fault == 2 else DELETE
            seen.add((role, text))
            kinds.append(kind)
        turns = {t for t, _, _ in found if t is not None}
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(found, found[1:])]
        audit = least_edits(bytes(kinds))
        state, lines, rest = 0, [], iter(found)
        for letter in audit:
            _, role, text = next(rest) if letter != "I" else (None, None, "")
            if letter == "D":
                continue
            state = "?sua".index(role[0]) if letter == "K" else NEXT[state]
            lines.append(f"{role if letter == 'K' else ['', '', 'user', 'assistant'][state]}:{text}")
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, sum(p not in ("su", "ua", "au") for p in pairs),
            cost_of(bytes(kinds), audit), audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def rows_of(count, convs, rng):
    words = ["Yes.", "No", "Why?", "  ", "", "ok \n", "Äh!", None, "end.\x0b"]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "User"]
    return [
        (rng.choice(convs), rng.choice([None, *range(40)]), rng.choice(roles), rng.choice(words)) for _ in range(count)
    ]


@pytest.fixture
def awkward():
    rng = random.Random(3)
    rows = rows_of(900, [None, *range(60)], rng)
    rows += rows[:50]  # repeated rows
    rows += [(100, i, ["user", "assistant"][i % 2], f"Turn {i}.") for i in range(30_000)]  # one long conversation
    rows += [(101, 1, "user", "word " * 400_000 + "?"), (101, 2, "assistant", "x" * 3_000_000)]
    rows += [(7, -(2**60), "user", "Far."), (7, 2**60, "assistant", "Away.")]
    return rows


def test_repair_equals_the_contract(spark, awkward):
    df = spark.createDataFrame(awkward, SCHEMA).selectExpr("*", "'x' AS conv", "'x' AS kinds", "1 AS copies", "1 AS digest")
    found = {r.conv_id: tuple(r)[1:] for r in repair(df.repartition(7)).collect()}
    assert found == expected(awkward)


def test_sql_agrees_on_awkward_rows(spark, tmp_path):
    import duckdb

    rows = rows_of(500, [None, *range(80)], random.Random(8))
    df = spark.createDataFrame(rows, SCHEMA)
    df.coalesce(1).write.parquet(str(tmp_path / "c"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/c/*.parquet')")
    want = con.execute(ORACLE["op12_conversation_repair"]).fetchall()
    assert {r[0]: tuple(r[1:]) for r in want} == expected(rows)


def test_empty_table(spark):
    assert repair(spark.createDataFrame([], SCHEMA)).collect() == []


def test_conversation_that_loses_all_rows(spark):
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:1".encode()) % 20 == 0)
    row = repair(spark.createDataFrame([(dropped, 1, "user", "Hi.")], SCHEMA)).first()
    assert tuple(row) == (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
