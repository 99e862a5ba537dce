"""Packing by power-of-two decomposition.

A document of ``n`` tokens is cut into pieces whose lengths are the powers of two in
``n``: as many pieces of the longest length as fit, then one for each bit of the rest,
longest first. Each piece is a sequence of its own, so no sequence crosses documents and
none is padded; sequences of one length form a bucket, from which batches are drawn.

Tokens come from a public tokenizer file, applied to whole texts. The tokenizer drops
white space and never joins across it, so each different word is encoded once and its ids
are reused; the store of known words is bounded in bytes and only saves time. It knows words
by a 64-bit hash, in arrays that take an eighth of what a dictionary of them does. New words
are encoded together, as one text. Strings of the
tokenizer's special tokens hold no white space and get the ids that it gives them in texts.

No shuffle is needed: pieces are cut where their document is read, and a sequence id is
the row's place in its task. Defined results: NULL or empty text is one piece holding the
end id; NULL or repeated ids and repeated rows are packed like others; an empty table gives
no pieces. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.llm.arrow import Slice, map_batches, slices, word_hashes, word_spans

LONGEST = 2048
END_ID = 1
KNOWN_BYTES = 48 << 20
RECENT_BYTES = 1 << 20
ENTRY_BYTES = 200  # of a recent word, besides its letters and ids
ENCODED_AT_ONCE = 1_000
SLICE = 1 << 20


class Store:
    """Ids of words by their hash; forgets all when the arrays take ``limit`` bytes."""

    def __init__(self, limit: int = KNOWN_BYTES):
        self.limit = limit
        self.forget()

    def forget(self) -> None:
        self.hashes, self.begin = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.length, self.ids = np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def find(self, hashes: np.ndarray, encode: Callable[[np.ndarray], list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each word begin in ``ids``, and how many there are. Hashes rise;
        ``encode`` gives the ids of the words at the places that are not known."""
        if sum(x.nbytes for x in (self.hashes, self.begin, self.length, self.ids)) > self.limit:
            self.forget()
        at = np.searchsorted(self.hashes, hashes)
        known = np.zeros(len(hashes), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == hashes[inside]
        new = np.flatnonzero(~known)
        if len(new):
            ids = encode(new)
            length = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            begin = len(self.ids) + np.cumsum(length) - length
            self.ids = np.append(self.ids, np.frombuffer(b"".join(ids), np.uint32))
            self.hashes = np.insert(self.hashes, at[new], hashes[new])
            self.begin = np.insert(self.begin, at[new], begin)
            self.length = np.insert(self.length, at[new], length)
            at = np.searchsorted(self.hashes, hashes)
        return self.begin[at], self.length[at]


class WordEncoder:
    """Ids of words, encoded once each; forgets all when they take ``limit`` bytes."""

    def __init__(self, path: str, limit: int = RECENT_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit, self.known, self.size = limit, {}, 0
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None) or ""
        vocabulary = self.tokenizer.get_vocab()
        self.letters = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, number in vocabulary.items():
            self.letters[number] = len(token.removesuffix(suffix))
        self.store = Store()

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_each(self, texts: list[str]) -> list[bytes]:
        return [array("I", ids).tobytes() for ids in self._ids(texts)]

    def _encode_together(self, texts: list[str]) -> list[bytes]:
        """The ids of words, encoded as one text and cut where the letters of the tokens, which
        are bytes, reach the end of a word. If they miss one, each word is a text."""
        text, normalizer = " ".join(texts), self.tokenizer.normalizer
        plain = texts if text.isascii() or normalizer is None else normalizer.normalize_str(text).split(" ")
        ids = np.array(self._ids([text])[0], np.uint32)
        size = self.letters[ids]
        reached, ends = np.cumsum(size), np.cumsum([len(w.encode()) for w in plain])
        if len(plain) == len(texts) and size.all() and size.sum() == ends[-1] and np.isin(ends, reached).all():
            cuts = (4 * (np.searchsorted(reached, ends) + 1)).tolist()
            raw = ids.tobytes()
            return [raw[a:b] for a, b in zip([0, *cuts], cuts)]
        return self._encode_each(texts)

    def _encode_new(self, words: list[bytes]) -> dict[bytes, bytes]:
        texts = [w.decode("utf-8", "replace") for w in words]
        found, groups = {}, ([], [], [])
        for w, text in zip(words, texts):  # the last hold white space of other kinds
            groups[0 if text.isascii() else 1 if text.split() == [text] else 2].append((w, text))
        for group, encode in zip(groups, (self._encode_together, self._encode_together, self._encode_each)):
            if group:
                found.update(zip([w for w, _ in group], encode([text for _, text in group])))
        return found

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as unsigned 32-bit numbers."""
        if self.size > self.limit:
            self.known.clear()
            self.size = 0
        known = self.known
        new = [w for w in words if w not in known]
        for at in range(0, len(new), ENCODED_AT_ONCE):
            part = new[at : at + ENCODED_AT_ONCE]
            found = self._encode_new(part)
            known.update(found)
            self.size += ENTRY_BYTES * len(part) + sum(map(len, part)) + sum(map(len, found.values()))
        return [known[w] for w in words]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each file and worker, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def slice_ids(part: Slice, enc: WordEncoder) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words of a slice, and where each text's ids begin and end."""
    starts, ends, owner = word_spans(part)
    texts = len(part.offsets) - 1
    if not len(starts):
        return np.zeros(0, np.uint32), np.zeros(texts + 1, np.int64)
    hashes, first, which = np.unique(word_hashes(part.data, starts, ends, False), return_index=True, return_inverse=True)

    def encode(new: np.ndarray) -> list[bytes]:
        raw, at = part.data.tobytes(), first[new]
        return enc.encode([raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())])

    begin, length = enc.store.find(hashes, encode)
    each = length[which].astype(np.int64)
    upto = np.cumsum(each)
    places = np.repeat(begin[which] - (upto - each), each) + np.arange(int(upto[-1]))
    bounds = np.concatenate([[0], upto])[np.searchsorted(owner, np.arange(texts + 1))]
    return enc.store.ids[places], bounds


def document_ids(column: pa.Array, path: str) -> Iterator[np.ndarray]:
    """The ids of each text of a column, without the end id."""
    enc, held, row = encoder(path), [], 0
    for part in slices(column, SLICE):
        ids, bounds = slice_ids(part, enc)
        if held and part.first != row:
            yield np.concatenate(held)
            held, row = [], row + 1
        last = len(bounds) - 2
        for k in range(last + 1):
            held.append(ids[bounds[k] : bounds[k + 1]])
            row = part.first + k
            if k < last:
                yield np.concatenate(held)
                held = []
    if held:
        yield np.concatenate(held)


def binary_lengths(n: int, longest: int = LONGEST) -> list[int]:
    """The powers of two, at most ``longest``, that ``n`` is cut into, longest first."""
    rest = n % longest
    bits = [1 << k for k in range(longest.bit_length() - 2, -1, -1) if rest >> k & 1]
    return [longest] * (n // longest) + bits


def pack(
    df: DataFrame,
    tokenizer: str,
    id_: str = "doc_id",
    text: str = "text",
    longest: int = LONGEST,
    end_id: int = END_ID,
) -> DataFrame:
    """Per piece: the id, ``start``, ``length``, ``ids`` (unsigned little-endian 32-bit
    numbers), ``doc_tokens``, ``sequence_id``, ``offset``. ``length`` names the bucket."""

    def run(batch):
        keys = batch.column(id_)
        rows, start, length, ids, total, size = [], [], [], [], [], 0

        def columns():
            return {
                id_: keys.take(pa.array(rows, pa.int64())),
                "start": start, "length": length, "ids": ids, "doc_tokens": total,
            }

        for row, own in enumerate(document_ids(batch.column(text), tokenizer)):
            own = np.append(own, np.uint32(end_id)).astype("<u4").tobytes()
            at = 0
            for n in binary_lengths(len(own) // 4, longest):
                rows.append(row)
                start.append(at)
                length.append(n)
                ids.append(own[4 * at : 4 * (at + n)])
                total.append(len(own) // 4)
                at += n
            size += len(own)
            if size > (8 << 20):
                yield columns()
                rows, start, length, ids, total, size = [], [], [], [], [], 0
        if rows:
            yield columns()

    kind = df.schema[id_].dataType.simpleString()
    schema = f"`{id_}` {kind}, start bigint, length bigint, ids binary, doc_tokens bigint"
    pieces = map_batches(df.select(id_, text), run, schema)
    return pieces.withColumns(
        {"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("bigint")}
    )


def write_buckets(packed: DataFrame, path: str) -> None:
    """Write sequences as Parquet, one folder for each length."""
    packed.write.partitionBy("length").parquet(path)
