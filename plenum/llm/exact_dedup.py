"""Exact deduplication by composable polynomial fingerprints.

A text is normalised (each run of white space becomes one space) and hashed as a
polynomial of its UTF-8 bytes under two primes. The hash of a text follows from the
hashes of its chunks: ``h(a + b) = h(a) * base ** len(b) + h(b)``, so all chunks of
a text are hashed at once as one matrix product, and a huge text is hashed piece by
piece in bounded memory. Rows with one fingerprint form a group. The texts of such
groups are then compared chunk by chunk: for each group and chunk number, the
smallest and the largest chunk must be the same bytes, which Spark pre-aggregates in
each task, so a group of any size sends one row per task and chunk. Groups that fail
are split by the SHA-256 of their texts.

Defined results: NULL text is empty; empty texts are equal to each other; white space
alone becomes one space and differs from empty; a NULL ``doc_id`` counts as the
smallest of its group only if no other is there; rows repeated with their ``doc_id``
are members like others, and each is ``kept`` if its id is the group's; an empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenum.llm.arrow import SPACES, free_names, map_batches, text_bytes
from plenum.operators.skew import grouped_for_join
from plenum.session import materialize

CHUNK = 256
PIECE = 1 << 20
COMPARED = 64 << 10
PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1220703125)
FILTER_BITS = 20
_AS_SPACE = bytes.maketrans(SPACES, b" " * len(SPACES))


def normalised(text: bytes) -> bytes:
    """Each run of white space as one space."""
    text = text.translate(_AS_SPACE)
    while b"  " in text:
        text = text.replace(b"  ", b" ")
    return text


class Fingerprints:
    """Polynomial hashes modulo ``primes``, as (one hash for each prime, length)."""

    def __init__(self, primes=PRIMES, bases=BASES):
        self.primes = np.array(primes, np.uint64)
        self.bases = [b % p for b, p in zip(bases, primes)]
        self.moduli = [int(p) for p in primes]
        down = [[pow(b, CHUNK - 1 - i, p) for b, p in zip(self.bases, self.moduli)] for i in range(CHUNK)]
        self.inside = np.array(down, np.float64)
        count = PIECE // CHUNK + 1
        self.shifts = np.ones((count, len(primes)), np.uint64)
        step = np.array([pow(b, CHUNK, p) for b, p in zip(self.bases, self.moduli)], np.uint64)
        for k in range(1, count):
            self.shifts[k] = self.shifts[k - 1] * step % self.primes

    def combine(self, left: tuple, right: tuple) -> tuple:
        """The fingerprint of two neighbouring parts from their own."""
        (h, n), (g, m) = left, right
        return tuple((x * pow(b, m, p) + y) % p for x, y, b, p in zip(h, g, self.bases, self.moduli)), n + m

    def piece(self, data: bytes) -> tuple:
        """The fingerprint of at most ``PIECE`` bytes: chunk hashes by one matrix
        product, shifted by the length that follows each."""
        n = len(data)
        if not n:
            return (0,) * len(self.moduli), 0
        # The first chunk is padded in front by zero bytes, which add nothing.
        count = -(-n // CHUNK)
        block = np.zeros(count * CHUNK, np.float64)
        block[-n:] = np.frombuffer(data, np.uint8)
        chunks = (block.reshape(count, CHUNK) @ self.inside).astype(np.uint64) % self.primes
        total = (chunks * self.shifts[count - 1 :: -1] % self.primes).sum(axis=0) % self.primes
        return tuple(int(x) for x in total), n

    def whole(self, data: bytes) -> tuple:
        total = self.piece(data[:PIECE])
        for at in range(PIECE, len(data), PIECE):
            total = self.combine(total, self.piece(data[at : at + PIECE]))
        return total


def _texts(batch, text: str) -> Iterator[bytes]:
    data, offsets = text_bytes(batch.column(text))
    view = memoryview(np.ascontiguousarray(data))
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield normalised(bytes(view[a:b]))


def fingerprints(
    df: DataFrame, id_: str = "doc_id", text: str = "text", primes=PRIMES, digest: bool = True
) -> DataFrame:
    """Per row: the id, ``h1``, ``h2``, ``n_bytes`` of the normalised text, and its SHA-256."""

    def run(batch):
        make = Fingerprints(primes)
        rows, shas = [], []
        for data in _texts(batch, text):
            (h1, h2), n = make.whole(data)
            rows.append((h1, h2, n))
            shas.append(hashlib.sha256(data).hexdigest() if digest else "")
        h = np.array(rows, np.int64).reshape(len(rows), 3)
        yield {id_: batch.column(id_), "h1": h[:, 0], "h2": h[:, 1], "n_bytes": h[:, 2], "text_sha256": shas}

    kind = df.schema[id_].dataType.simpleString()
    schema = f"`{id_}` {kind}, h1 bigint, h2 bigint, n_bytes bigint, text_sha256 string"
    return map_batches(df.select(id_, text), run, schema)


KEY = ["h1", "h2", "n_bytes"]


def _slot(bits: int) -> Column:
    return F.pmod(F.col("h1").bitwiseXOR(F.shiftleft("h2", 7)).bitwiseXOR(F.col("n_bytes")), F.lit(1 << bits))


def colliding(
    df: DataFrame, marked: DataFrame, text: str = "text", primes=PRIMES, bits: int = FILTER_BITS
) -> DataFrame:
    """The fingerprints that stand for different texts, found by comparing chunks.

    Only texts whose fingerprint falls on a slot of a group are sent on. The slots are
    a table of ``2 ** bits`` bits at most, whatever the input; when it fills up, more
    texts are compared than need be, none fewer.
    """
    slots = marked.filter("_rows > 1").select(_slot(bits).cast("int").alias("slot")).distinct()
    wanted = np.zeros(1 << bits, bool)
    wanted[slots.toPandas()["slot"].to_numpy(np.int64)] = True
    shared = df.sparkSession.sparkContext.broadcast(np.packbits(wanted))

    def run(batch):
        make, flags = Fingerprints(primes), np.unpackbits(shared.value)
        out, size = [], 0
        for data in _texts(batch, text):
            (h1, h2), n = make.whole(data)
            if not flags[(h1 ^ (h2 << 7) ^ n) % (1 << bits)]:
                continue
            for at in range(0, max(n, 1), COMPARED):
                out.append((h1, h2, n, at // COMPARED, data[at : at + COMPARED]))
                size += min(COMPARED, n - at)
            if size > (4 << 20):
                yield dict(zip([*KEY, "chunk", "piece"], zip(*out)))
                out, size = [], 0
        if out:
            yield dict(zip([*KEY, "chunk", "piece"], zip(*out)))

    pieces = map_batches(df.select(text), run, "h1 bigint, h2 bigint, n_bytes bigint, chunk bigint, piece binary")
    compared = pieces.groupBy(*KEY, "chunk").agg(F.min("piece").alias("low"), F.max("piece").alias("high"))
    return compared.filter("low <> high").select(*KEY).distinct()


def exact_duplicates(
    df: DataFrame, id_: str = "doc_id", text: str = "text", primes=PRIMES, bits: int = FILTER_BITS
) -> DataFrame:
    """Per row: the id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``."""
    base = materialize(fingerprints(df, id_, text, primes), "fingerprints")
    marked = base.groupBy(*KEY).agg(F.count("*").alias("_rows"))
    broken = materialize(colliding(df, marked, text, primes, bits), "collisions")
    # A fingerprint that stands for several texts is told apart by their digests.
    if not broken.isEmpty():
        base = base.join(broken.withColumn("_split", F.lit(True)), KEY, "left")
        base = base.withColumn("_part", F.when(F.col("_split"), F.col("text_sha256")).otherwise(""))
    else:
        base = base.withColumn("_part", F.lit(""))
    keys = [*KEY, "_part"]
    groups = grouped_for_join(base, keys, F.min(id_).alias("keep_id"), F.count("*").alias("group_size"))
    kept = F.col(id_).eqNullSafe(F.col("keep_id")).alias("kept")
    return base.join(groups, keys).select(id_, "keep_id", "group_size", kept, "text_sha256")


def drop_exact_duplicates(df: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of equal texts, with all columns of ``df``. Rows repeated
    with their id and text also leave one row, the first by the other columns."""
    key, sha, digest, place = free_names(df, "_id", "_sha", "_digest", "_place")
    stay = exact_duplicates(df, id_, text).filter("kept")
    stay = stay.select(F.col(id_).alias(key), F.col("text_sha256").alias(sha)).distinct()
    plain = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")
    match = F.col(id_).eqNullSafe(F.col(key)) & (F.col(digest) == F.col(sha))
    joined = df.withColumn(digest, F.sha2(plain, 256)).join(stay, match, "left_semi")
    order = [c for c in df.columns if c not in (id_, text)] or [id_]
    first = Window.partitionBy(id_, digest).orderBy(*order)
    return joined.withColumn(place, F.row_number().over(first)).filter(F.col(place) == 1).select(*df.columns)
