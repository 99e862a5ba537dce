"""Repairing the structure of conversations at least cost, by Hirschberg's method.

A sound conversation is empty or has roles ``system? (user assistant)+``. Four states say how
far such a sequence has come: nothing yet, after system, after user, after assistant. Each row
is kept (0), gets the role that its state asks for (2) or is deleted (3; blank and duplicate
rows must be); an empty turn of that role may be inserted anywhere (2); a truncated row costs
1 more unless it is deleted. Of the cheapest edits those whose initials D, I, K, R make the
ASCII-least string, the audit, are taken.

The method divides a conversation in the middle. A forward vector holds for each state the
least cost of reaching it, with the rank of its audit among the four; a backward vector holds
the least cost of what remains. Where the two meet, the cheapest crossing of lowest rank is
the state at the middle, and both halves are solved alike. A row's edits, inserts before it
included, form a prefix-free code (``I*`` and one of D, K, R), so ranks of audits over the same
rows decide the order of whole audits. Vectors, less their smallest cost, are few, so each
step is a lookup. Space is linear: one byte a row and the vectors on the path.

How it is dealt out: narrow rows (no text, but its MD5) are combined, looked up for earlier
copies and sorted by range over conversation and turn, so that a conversation with a third
of all rows lies in many tasks, each of which packs its rows into chunks of a byte a row.
Texts are shuffled once, to a task for each conversation that sorts them on disk and streams
them through SHA-256 behind the chunks; a digest has no parts that could be merged, so this
one step cannot be split. A task holds a byte a row of one conversation, as the audit does,
and no text but that at hand.

Defined results: NULL is one space, in ids and turns only for drawing the damage; a NULL id
is a conversation of its own; rows of one turn are ordered by role and MD5 of the text; a
conversation without rows after the damage has zeros, an empty audit and the hash of an empty
string; an empty table gives an empty result; other columns are not read. Roles count by
their first letter, so a role that begins with s, u or a may be kept; others never.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from plenum.llm.arrow import bounded_batches
from plenum.operators.skew import grouped_for_join
from plenum.session import materialize

FAR = 99  # above any difference of two costs in a vector
OTHER, SYSTEM, USER, ASSISTANT = range(4)  # initials; the states after them have the same numbers
DELETE, CUT = 4, 8  # flags of a row's kind, above its initial
NEXT = {0: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # what may be inserted in a state
ROLES = {USER: "user", ASSISTANT: "assistant"}
FINAL = ("", "II", "I", "")  # what completes a conversation that ends in a state
END = tuple(2 * len(f) for f in FINAL)
LEGAL = np.zeros(16, bool)  # pairs of neighbouring initials, su, ua and au
LEGAL[[SYSTEM * 4 + USER, USER * 4 + ASSISTANT, ASSISTANT * 4 + USER]] = True
NONE = r"[^\x20\x09-\x0D]"


@lru_cache(None)
def moves(kind: int) -> tuple:
    """For each state before a row, (state after, cost, edits), one for each state after."""
    initial, must, cut = kind & 3, kind & DELETE, 1 if kind & CUT else 0
    rows = []
    for first in range(4):
        best: dict[int, tuple[int, str]] = {}
        state, cost, edits = first, 0, ""
        for _ in range(3):
            found = [(state, cost + 3, edits + "D")]
            if not must:
                if NEXT[state] == initial or (initial == SYSTEM and state == 0):
                    found.append((initial, cost + cut, edits + "K"))
                found.append((NEXT[state], cost + 2 + cut, edits + "R"))
            for after, price, letters in found:
                best[after] = min(best.get(after, (FAR, "")), (price, letters))
            state, cost, edits = NEXT[state], cost + 2, edits + "I"
        rows.append(tuple((after, *best[after]) for after in sorted(best)))
    return tuple(rows)


@lru_cache(None)
def forward(vector: tuple, kind: int) -> tuple:
    """The vector (costs, ranks) after a row of this kind, costs less the smallest."""
    costs, ranks = vector
    best = [(FAR, 9, "~")] * 4
    for state, row in enumerate(moves(kind)):
        if costs[state] < FAR:
            for after, price, letters in row:
                best[after] = min(best[after], (costs[state] + price, ranks[state], letters))
    order = sorted(range(4), key=lambda s: best[s][1:])
    least = min(b[0] for b in best)
    return tuple(min(b[0] - least, FAR) if b[0] < FAR else FAR for b in best), tuple(order.index(s) for s in range(4))


@lru_cache(None)
def backward(costs: tuple, kind: int) -> tuple:
    """The least costs of what remains before a row of this kind, less the smallest."""
    found = [min((price + costs[after] for after, price, _ in row if costs[after] < FAR), default=FAR) for row in moves(kind)]
    least = min(found)
    return tuple(f - least if f < FAR else FAR for f in found)


@lru_cache(None)
def only(state: int) -> tuple:
    return tuple(0 if s == state else FAR for s in range(4))


def least_edits(kinds: bytes) -> str:
    """The audit of a conversation whose rows have these kinds."""
    out: list[str] = []
    todo = [(0, len(kinds), 0, END)]  # rows from and to, state before, costs after; halves in order
    if not kinds:
        return ""
    while todo:
        low, high, state, end = todo.pop()
        if high - low == 1:
            row = [x for x in moves(kinds[low])[state] if end[x[0]] < FAR]
            after, _, letters = min(row, key=lambda x: (x[1] + end[x[0]], x[2]))
            out.append(letters)
            if high == len(kinds):
                out.append(FINAL[after])
            continue
        middle = (low + high) // 2
        vector = (only(state), (0, 1, 2, 3))
        for kind in kinds[low:middle]:
            vector = forward(vector, kind)
        rest = end
        for at in range(high - 1, middle - 1, -1):
            rest = backward(rest, kinds[at])
        costs, ranks = vector
        crossing = min(range(4), key=lambda s: (costs[s] + rest[s], ranks[s]))
        todo.append((middle, high, crossing, end))
        todo.append((low, middle, state, only(crossing)))
    return "".join(out)


short_edits = lru_cache(1 << 16)(least_edits)


def edits_of(kinds: bytes) -> str:
    return short_edits(kinds) if len(kinds) <= 32 else least_edits(kinds)


def cost_of(kinds: bytes, audit: str) -> int:
    letters = np.frombuffer(audit.encode(), np.uint8)
    rows = letters[letters != ord("I")]
    cut = (np.frombuffer(kinds, np.uint8) & CUT) > 0
    prices = 3 * (letters == ord("D")).sum() + 2 * ((letters == ord("I")) | (letters == ord("R"))).sum()
    return int(prices + (cut & (rows != ord("D"))).sum())


class Replay:
    """Applies an audit to the rows of a conversation in turn and hashes what it gives."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.started, self.digest = audit, 0, 0, False, hashlib.sha256()

    def put(self, role: str, text: str) -> None:
        if self.started:
            self.digest.update(b"\n")
        self.started = True
        self.digest.update(f"{role}:".encode())
        self.digest.update(text.encode())

    def inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.state = NEXT[self.state]
            self.put(ROLES[self.state], "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = "?sua".index(role[0])
            self.put(role, text)
        elif letter == "R":
            self.state = NEXT[self.state]
            self.put(ROLES[self.state], text)

    def end(self) -> str:
        self.inserts()
        return self.digest.hexdigest()


def damage(rows: DataFrame, id_: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, has, turn, role, text, digest, copies): each row damaged by the CRC-32 of
    ``id:turn`` modulo 20; dropped rows have 0 copies, repeated ones 2."""
    space = F.lit(" ")
    drawn = F.concat(F.coalesce(F.col(id_).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn).cast("string"), space))
    code = F.crc32(F.encode(drawn, "UTF-8")) % 20
    rows = rows.select(
        F.col(id_).alias("conv"), F.col(turn).isNotNull().alias("has"), F.col(turn).alias("turn"),
        F.coalesce(role, space).alias("role"), F.coalesce(text, space).alias("text"), code.alias("code"),
    )
    rows = rows.select(
        "conv", "has", "turn",
        F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("code") == 0, 0).when(F.col("code") == 3, 2).otherwise(1).cast("bigint").alias("copies"),
    )
    return rows.withColumn("digest", F.unhex(F.md5(F.encode("text", "UTF-8"))))


ORDER = ["has", "turn", "role", "digest"]
CHUNK = (
    "part int, seq bigint, kinds binary, blank bigint, duplicate bigint, truncated bigint, "
    "first bigint, last bigint, turns bigint"
)
STATS = ["blank", "duplicate", "truncated"]


def faults(rows: DataFrame) -> DataFrame:
    """(conv, has, turn, role, digest, copies, blank, cut, earlier): different rows with their
    number, whether they are blank or truncated, and whether an earlier turn has them."""
    text = F.col("text")
    marked = rows.select(
        "conv", *ORDER, "copies", (~text.rlike(NONE)).alias("blank"), (~text.rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("cut")
    )
    marked = marked.groupBy("conv", *ORDER, "blank", "cut").agg(F.sum("copies").alias("copies"))
    at = F.struct("has", "turn")  # NULL turns come first
    held = marked.filter(~F.col("blank") & (F.col("copies") > 0))
    keys = ["conv", "role", "digest"]
    first = grouped_for_join(held, keys, F.min(at).alias("_first"), F.count("*").alias("_turns"))
    first = first.filter("_turns > 1").select(*[F.col(k).alias(f"_{k}") for k in keys], "_first")
    same = F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest"))
    joined = marked.join(first, same, "left")
    earlier = F.coalesce(at > F.col("_first"), F.lit(False))
    return joined.select("conv", *ORDER, "copies", "blank", "cut", earlier.alias("earlier"))


def initial(role: Column) -> Column:
    letter = F.substring(role, 1, 1)
    return F.when(letter == "s", SYSTEM).when(letter == "u", USER).when(letter == "a", ASSISTANT).otherwise(OTHER)


def chunks(found: DataFrame, kind: str) -> DataFrame:
    """(conv, CHUNK): rows in order, as bytes, in one piece for each conversation and batch."""
    narrow = found.select("conv", *ORDER, "copies", "blank", "cut", "earlier", initial(F.col("role")).alias("initial"))
    placed = narrow.repartitionByRange("conv", *ORDER).sortWithinPartitions("conv", *ORDER)
    placed = placed.select(
        F.spark_partition_id().alias("part"), "conv", "turn", "copies", "blank", "cut", "earlier", "initial"
    )
    schema = StructType.fromDDL(f"conv {kind}, {CHUNK}")
    names = schema.names

    def run(batches):
        seq = 0
        for batch in batches:
            if not len(batch):
                continue
            seq += 1
            yield pa.RecordBatch.from_pydict(packed(batch, seq), arrow).select(names)

    arrow = to_arrow_schema(schema)
    return placed.mapInArrow(run, schema)


def packed(batch: pa.RecordBatch, seq: int) -> dict:
    column = {n: batch.column(n) for n in batch.schema.names}
    flag = lambda n: column[n].to_numpy(zero_copy_only=False).astype(bool)
    copies = column["copies"].to_numpy(zero_copy_only=False).astype(np.int64)
    blank, cut, earlier = flag("blank"), flag("cut"), flag("earlier")
    first = np.cumsum(copies) - copies
    drop = np.repeat(blank | earlier, copies)
    again = np.arange(len(drop)) > np.repeat(first, copies)
    kinds = np.repeat(column["initial"].to_numpy(zero_copy_only=False), copies)
    kinds = np.where(drop | again, kinds | DELETE, np.where(np.repeat(cut, copies), kinds | CUT, kinds)).astype(np.uint8)
    # Where a conversation begins; NULL ids are equal.
    conv = column["conv"]
    key = conv.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    there = copies > 0
    counts = {
        "blank": np.where(blank, copies, 0),
        "duplicate": np.where(blank, 0, np.where(earlier, copies, copies - there)),
        "truncated": (~blank & ~earlier & there & cut).astype(np.int64),
    }
    has = column["turn"].is_valid().to_numpy(zero_copy_only=False) & there
    turn = column["turn"].fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    firsts, lasts, turns = [], [], []
    bounds = np.append(begin, len(batch))
    at = np.append(first, len(kinds))
    data = kinds.tobytes()
    for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        own = turn[low:high][has[low:high]]
        firsts.append(int(own[0]) if len(own) else None)
        lasts.append(int(own[-1]) if len(own) else None)
        turns.append(int((own[1:] != own[:-1]).sum()) + 1 if len(own) else 0)
    return {
        "conv": conv.take(pa.array(begin)),
        "part": column["part"].take(pa.array(begin)),
        "seq": [seq] * len(begin),
        "kinds": [data[at[low] : at[high]] for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist())],
        **{n: np.add.reduceat(c, begin) for n, c in counts.items()},
        "first": firsts, "last": lasts, "turns": turns,
    }


class Conversation:
    """One conversation as it streams by: first its chunks, then its rows."""

    def __init__(self, conv):
        self.conv, self.kinds, self.counts, self.replay = conv, [], dict.fromkeys(STATS, 0), None
        self.first = self.last = None
        self.turns = 0

    def chunk(self, row: dict) -> None:
        self.kinds.append(row["kinds"])
        for n in STATS:
            self.counts[n] += row[n]
        if row["turns"]:
            self.turns += row["turns"] - (self.last == row["first"])
            self.first = row["first"] if self.first is None else self.first
            self.last = row["last"]

    def solve(self) -> None:
        if self.replay is None:
            self.kinds = b"".join(self.kinds)
            self.replay = Replay(edits_of(self.kinds))

    def result(self) -> dict:
        self.solve()
        letters = np.frombuffer(self.kinds, np.uint8) & 3
        return {
            "conv": self.conv,
            "gaps": self.last - self.first + 1 - self.turns if self.turns else 0,
            **self.counts,
            "illegal": int((~LEGAL[letters[:-1] * 4 + letters[1:]]).sum()),
            "cost": cost_of(self.kinds, self.replay.audit),
            "audit": self.replay.audit,
            "repaired_sha256": self.replay.end(),
        }


RESULT = (
    "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
    "audit string, repaired_sha256 string"
)


def replayed(stream: DataFrame, kind: str) -> DataFrame:
    """One row for each conversation of a stream of chunks and rows in order."""
    schema = StructType.fromDDL(f"conv {kind}, {RESULT}")

    def run(batches):
        arrow = to_arrow_schema(schema)
        now, done = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if now is None or row["conv"] != now.conv:
                    if now is not None:
                        done.append(now.result())
                    now = Conversation(row["conv"])
                if row["kinds"] is not None:
                    now.chunk(row)
                    continue
                now.solve()
                for _ in range(row["copies"]):
                    now.replay.row(row["role"], row["text"])
            if done:
                yield pa.RecordBatch.from_pylist(done, arrow)
                done = []
        if now is not None:
            yield pa.RecordBatch.from_pylist([now.result()], arrow)

    return stream.mapInArrow(run, schema)


def repair(rows: DataFrame, id_="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """Per conversation: the id, gaps in its turns, faults, illegal neighbours, the least cost,
    the audit and the SHA-256 of the repaired conversation."""
    bounded_batches(rows.sparkSession)
    kind = rows.schema[id_].dataType.simpleString()
    damaged = damage(rows, id_, turn, role, text)
    pieces = materialize(chunks(faults(damaged), kind), "chunks")
    lines = damaged.filter("copies > 0").select("conv", *ORDER, "text", "copies")
    stream = pieces.unionByName(lines, allowMissingColumns=True)
    # A conversation's chunks, whose order columns are NULL, come before its rows.
    ordered = stream.repartition("conv").sortWithinPartitions("conv", F.col("kinds").isNull(), "part", "seq", *ORDER)
    found = replayed(ordered.select("conv", "kinds", *STATS, "first", "last", "turns", "role", "text", "copies"), kind)
    return found.withColumnRenamed("conv", id_)
