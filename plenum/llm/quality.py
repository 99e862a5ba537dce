"""Quality rules with an isolation forest on their statistics.

Rule statistics of every whole text (word characters, symbols, repeated lines, repeated
windows of words, and shares drawn from them) go to an isolation forest: trees that
split random statistics at random points. Rows that few splits isolate are anomalous; the
score is ``2 ** -(mean path / expected path)``. Trees are grown on labelled rows, with few
bad ones in each tree's sample so that they stand alone, and the threshold is calibrated
on labelled rows: among all thresholds that reject at most ``MAX_CLEAN_LOSS`` of the good
rows, the one that finds the most bad ones. Every labelled row that passes the fixed rules
counts for the ranges and for the threshold, which are exact order statistics found in rounds
of histograms, and may be drawn for any tree: the method grows a tree on ``SAMPLE`` rows, drawn
by a hash of their own for each tree. Nothing that grows with the input comes to the driver.

Two fixed rules come first: fewer than 10 words, or over 20 in 100 words in repeated
windows. Defined results: NULL and empty texts have no words and fail; NULL ids are never
labelled; repeated rows get the same verdict, count as often as they come, and are drawn as one;
ids labelled twice are bad if any label says
so; without labels of both kinds only the fixed rules decide; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.llm.arrow import IS_SPACE, map_batches, mix, numbers, powers, shingle_hashes, slices, word_hashes, word_spans
from plenum.operators.skew import grouped_for_join
from plenum.session import materialize

WINDOW = 5
TREES = 100
BINS = 256
SAMPLE = 256
BAD_SHARE = 0.04
MAX_CLEAN_LOSS = 0.005
OUTSIDE = 0.002
SYMBOLS = b"#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EXTRA = ["n_upper", "n_letters", "n_marks", "n_digits", "n_lines", "n_stutters"]
FEATURES = [
    "word_length", "symbol_share", "dup_line_share", "repeat_share",
    "upper_share", "mark_share", "digit_share", "stutter_share",
]

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_IS_START = (np.arange(256) & 0xC0) != 0x80  # the first byte of a code point
_IS_UPPER = np.zeros(256, bool)
_IS_UPPER[65:91] = True
_IS_LETTER = _IS_UPPER.copy()
_IS_LETTER[97:123] = True
_IS_MARK = np.zeros(256, bool)
_IS_MARK[list(b"!?")] = True
_IS_DIGIT = np.zeros(256, bool)
_IS_DIGIT[48:58] = True


def _counts(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum(flags)])
    return upto[offsets[1:]] - upto[offsets[:-1]]


def repeated_words(words: np.ndarray, size: int = WINDOW) -> int:
    """How many words stand in a window of ``size`` words that the text has twice or more."""
    windows = shingle_hashes(words, size)
    if len(windows) < 2:
        return 0
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    # Equal hashes count only if the words agree one by one.
    a, b = order[:-1][same], order[1:][same]
    span = np.arange(size)
    agree = (words[a[:, None] + span] == words[b[:, None] + span]).all(axis=1)
    twice = np.zeros(len(words) + 1, np.int64)
    for at in (a[agree], b[agree]):
        np.add.at(twice, at, 1)
        np.add.at(twice, at + size, -1)
    return int((np.cumsum(twice)[:-1] > 0).sum())


def statistics(column: pa.Array) -> np.ndarray:
    """``BASE + EXTRA`` of each text, as a matrix of integers."""
    out = np.zeros((len(column), len(BASE) + len(EXTRA)), np.int64)
    words_of: dict[int, list[np.ndarray]] = {}
    bytes_of: dict[int, list[np.ndarray]] = {}
    for part in slices(column):
        data, offsets = part.data, part.offsets
        rows = np.arange(len(offsets) - 1) + part.first
        starts, ends, owner = word_spans(part)
        space = IS_SPACE[data]
        for at, flags in (
            (1, _IS_START[data] & ~space),
            (2, _IS_SYMBOL[data]),
            (5, _IS_UPPER[data]),
            (6, _IS_LETTER[data]),
            (7, _IS_MARK[data]),
            (8, _IS_DIGIT[data]),
            (9, data == 10),
        ):
            out[rows, at] += _counts(flags, offsets)
        bounds = np.searchsorted(owner, np.arange(len(rows) + 1))
        out[rows, 0] += np.diff(bounds)
        hashes = word_hashes(data, starts, ends, False)
        lines = _lines(data, offsets, starts)
        line_bounds = np.searchsorted(lines[1], np.arange(len(rows) + 1))
        for k, row in enumerate(rows.tolist()):
            own = hashes[bounds[k] : bounds[k + 1]]
            if len(rows) == 1:  # maybe one of several slices of a long text
                words_of.setdefault(row, []).append(own)
                bytes_of.setdefault(row, []).append(data)
                continue
            out[row, 4] = repeated_words(own)
            out[row, 10] = (own[1:] == own[:-1]).sum()
            out[row, 3] = _repeated_lines(data, *(x[line_bounds[k] : line_bounds[k + 1]] for x in lines))
    for row, own in words_of.items():
        own = np.concatenate(own)
        out[row, 4] = repeated_words(own)
        out[row, 10] = (own[1:] == own[:-1]).sum()
        data = np.concatenate(bytes_of[row])
        inside = np.flatnonzero(~IS_SPACE[data])
        out[row, 3] = _repeated_lines(data, *_lines(data, np.array([0, len(data)]), inside))
    return out


_LINE_CODES = numbers(256, 23)
_LINE_POWERS = powers(4096)


def _lines(data: np.ndarray, offsets: np.ndarray, filled: np.ndarray) -> tuple[np.ndarray, ...]:
    """A hash of each line that holds a word, the text it belongs to, where it starts and where
    it ends; ``filled`` has a place in each word."""
    if not len(filled):
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    breaks = data == 10
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    cut[1:] |= breaks
    begin = np.flatnonzero(cut[:-1])  # where a line starts, its line feed included
    held = np.searchsorted(begin, filled, "right") - 1
    has_word = np.zeros(len(begin), bool)
    has_word[held] = True
    place = np.arange(len(data)) - np.repeat(begin, np.diff(np.append(begin, len(data))))
    codes = _LINE_CODES.copy()
    codes[10] = 0
    # A line's bytes as a polynomial in blocks of 4096 bytes, each block hashed anew.
    block = place >> 12
    heads = np.flatnonzero((place & 4095) == 0)
    sums = np.add.reduceat(codes[data] * _LINE_POWERS[place & 4095], heads)
    sums = mix(sums + block[heads].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    of = np.searchsorted(begin, heads, "right") - 1
    total = np.zeros(len(begin), np.uint64)
    np.add.at(total, of, sums)
    stop = np.append(begin[1:], len(data))
    stop -= breaks[stop - 1]
    line = mix(total + (stop - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    owner = np.searchsorted(offsets, begin, "right") - 1
    return tuple(x[has_word] for x in (line, owner, begin, stop))


def _repeated_lines(data: np.ndarray, hashes: np.ndarray, owner: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> int:
    """How many lines equal an earlier one. Lines of equal hash count only if their bytes agree."""
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    if not same.any():
        return 0
    shared = np.zeros(len(order), bool)
    shared[1:] |= same
    shared[:-1] |= same
    at = order[shared].tolist()
    return len(at) - len({data[begin[k] : stop[k]].tobytes() for k in at})


def features(stats: np.ndarray) -> np.ndarray:
    words, chars, symbols, dup, repeat, upper, letters, marks, digits, lines, same = np.maximum(stats.T, 0).astype(float)
    one = np.maximum(words, 1)
    return np.stack(
        [
            chars / one,
            np.log1p(100 * symbols / one),
            dup / (lines + 1),
            repeat / one,
            upper / np.maximum(letters, 1),
            np.log1p(100 * marks / one),
            digits / np.maximum(chars, 1),
            same / one,
        ],
        axis=1,
    )


def order_statistics(rows: DataFrame, places: list[tuple[int, int]]) -> list[float]:
    """The values at (column of ``_x``, place from 0) of the sorted column, each row counted
    ``_n`` times. A round counts ``BINS`` bins of the interval that holds a place and goes on
    with the bin that holds it, until all its values are one."""
    columns = sorted({c for c, _ in places})
    width = rows.select(F.size("_x")).head()[0]
    ends = rows.agg(*[f(F.col("_x")[c]).alias(f"{n}{c}") for c in columns for n, f in (("l", F.min), ("h", F.max))]).head()
    low = np.array([ends[f"l{c}"] for c, _ in places], float)
    high = np.array([ends[f"h{c}"] for c, _ in places], float)
    at, left = np.array([c for c, _ in places]), np.array([p for _, p in places])
    while len(todo := np.flatnonzero(low < high)):
        ranges = [(int(k), int(at[k]), low[k], high[k]) for k in todo]

        def count(batches, ranges=ranges):
            held = {k: (np.zeros(BINS, np.int64), np.full(BINS, np.inf), np.full(BINS, -np.inf)) for k, *_ in ranges}
            for batch in batches:
                x, n = _matrix(batch.column("_x"), width), batch.column("_n").to_numpy()
                for k, column, a, b in ranges:
                    inside = (x[:, column] >= a) & (x[:, column] <= b)
                    value = x[inside, column]
                    bin_ = np.minimum(((value - a) / (b - a) * BINS).astype(np.int64), BINS - 1)
                    np.add.at(held[k][0], bin_, n[inside])
                    np.minimum.at(held[k][1], bin_, value)
                    np.maximum.at(held[k][2], bin_, value)
            for k, (n, a, b) in held.items():
                some = np.flatnonzero(n)
                parts = [np.full(len(some), k), some, n[some], a[some], b[some]]
                yield pa.RecordBatch.from_arrays([pa.array(p) for p in parts], names=["k", "bin", "n", "low", "high"])

        counted = rows.mapInArrow(count, "k bigint, bin bigint, n bigint, low double, high double").groupBy("k", "bin")
        # At most ``BINS`` rows for each place come to the driver.
        found = counted.agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).toPandas()
        for k, bins in found.sort_values("bin").groupby("k"):
            upto = bins["n"].to_numpy().cumsum()
            j = int(np.searchsorted(upto, left[k], "right"))
            left[k] -= upto[j - 1] if j else 0
            low[k], high[k] = bins["low"].iloc[j], bins["high"].iloc[j]
    return low.tolist()


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), width)


def central(good: DataFrame, total: int) -> np.ndarray:
    """For each feature, the range that all but ``OUTSIDE`` of the ``total`` good rows keep at
    each end, and the scale of what lies beyond."""
    at = [(total - 1) * q for q in (OUTSIDE, 1 - OUTSIDE)]
    below, share = [int(a) for a in at], np.array([[a % 1] for a in at])
    places = [(c, min(b + k, total - 1)) for k in (0, 1) for b in below for c in range(len(FEATURES))]
    first, second = np.array(order_statistics(good, places)).reshape(2, 2, -1)
    low, high = first + (second - first) * share
    return np.stack([low, high, np.maximum(high - low, 0.02)])


def outside(x: np.ndarray, ranges: np.ndarray) -> np.ndarray:
    """How far each feature lies outside its range; the forest splits on this, so that rows
    no different from good ones stay together."""
    low, high, scale = ranges
    return (np.maximum(x - high, 0) - np.maximum(low - x, 0)) / scale


def base_failed(stats: np.ndarray) -> np.ndarray:
    return (stats[:, 0] < 10) | (100 * stats[:, 4] > 20 * stats[:, 0])


def expected_path(n: np.ndarray) -> np.ndarray:
    """The mean path of an unsuccessful search in a binary search tree of ``n`` rows."""
    n = np.asarray(n, float)
    many = 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, many, np.where(n == 2, 1.0, 0.0))


def per_tree(good: int, bad: int, sample: int = SAMPLE, bad_share: float = BAD_SHARE) -> tuple[int, int]:
    """How many good and bad rows a tree sees."""
    few = min(bad, max(1, int(sample * bad_share)))
    return min(good, sample - few), few


class IsolationForest:
    """Trees over random splits, as flat arrays."""

    def __init__(self, trees: list, sample: int):
        self.trees, self.sample = trees, sample

    @classmethod
    def fit(cls, good: np.ndarray, bad: np.ndarray, trees=TREES, sample=SAMPLE, bad_share=BAD_SHARE, seed=7):
        """Each tree sees ``sample`` rows, of which ``bad_share`` come from the bad ones."""
        rng = np.random.default_rng(seed)
        wanted = per_tree(len(good), len(bad), sample, bad_share)
        drawn = (
            np.concatenate([x[rng.choice(len(x), n, replace=False)] for x, n in zip((good, bad), wanted)])
            for _ in range(trees)
        )
        return cls.grown(drawn, sample, rng)

    @classmethod
    def grown(cls, drawn: Iterable[np.ndarray], sample=SAMPLE, rng=None):
        """A tree for each of the drawn sets of rows."""
        rng = rng or np.random.default_rng(7)
        depth = int(np.ceil(np.log2(sample))) + 2
        return cls([_grow(rows, depth, rng) for rows in drawn], sample)

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; the shorter the mean path, the higher."""
        total = np.zeros(len(x))
        every = np.arange(len(x))
        for column, split, left, right, path in self.trees:
            node = np.zeros(len(x), np.int64)
            while True:
                inner = left[node] >= 0
                if not inner.any():
                    break
                below = x[every, column[node]] < split[node]
                node = np.where(inner, np.where(below, left[node], right[node]), node)
            total += path[node]
        return 2.0 ** (-total / (max(1, len(self.trees)) * float(expected_path(self.sample))))


def _grow(rows: np.ndarray, depth: int, rng) -> tuple:
    column, split, left, right, path = [], [], [], [], []

    def add(part: np.ndarray, level: int) -> int:
        at = len(column)
        for x, v in ((column, 0), (split, 0.0), (left, -1), (right, -1), (path, level + float(expected_path(len(part))))):
            x.append(v)
        low, high = (part.min(axis=0), part.max(axis=0)) if len(part) else (0, 0)
        spread = np.flatnonzero(np.atleast_1d(high > low))
        if len(part) > 1 and level < depth and len(spread):
            c = int(rng.choice(spread))
            s = float(rng.uniform(low[c], high[c]))
            under = part[:, c] < s
            column[at], split[at] = c, s
            left[at] = add(part[under], level + 1)
            right[at] = add(part[~under], level + 1)
        return at

    add(rows, 0)
    return np.array(column), np.array(split), np.array(left), np.array(right), np.array(path)


def calibrated(good: np.ndarray, bad: np.ndarray, loss: float = MAX_CLEAN_LOSS) -> float:
    """The lowest threshold above which at most ``loss`` of the good scores lie, raised to
    the middle of the gap below the next bad score."""
    floor = np.sort(good)[len(good) - 1 - int(loss * len(good))]
    return _raised(floor, min(bad[bad > floor], default=None))


def _raised(floor: float, above: float | None) -> float:
    return float(np.nextafter(floor, 2)) if above is None else float((floor + above) / 2)


def rule_statistics(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """Per row: ``_id`` and the integers ``BASE + EXTRA`` in ``_stats``."""

    def run(batch):
        yield {"_id": batch.column(id_), "_stats": list(statistics(batch.column(text)))}

    kind = docs.schema[id_].dataType.simpleString()
    return map_batches(docs.select(id_, text), run, f"_id {kind}, _stats array<bigint>")


def labelled_rows(stats: DataFrame, labels: DataFrame, id_: str, label: str) -> DataFrame:
    """All labelled rows that pass the fixed rules: the label, the features ``_x``, how many
    rows of one id are alike (``_n``), and a hash of id and features. Only statistics travel
    to meet the labels."""
    known = labels.filter(F.col(id_).isNotNull() & F.col(label).isNotNull())
    known = known.select(F.col(id_).alias("_id"), F.col(label).alias("_label"))
    known = grouped_for_join(known, ["_id"], F.min("_label").cast("int").alias("_label")).filter("_label in (0, 1)")
    kind = stats.schema["_id"].dataType.simpleString()

    def run(batch):
        stats = _matrix(batch.column("_stats"), len(BASE + EXTRA))
        usable = ~base_failed(stats)
        picked = batch.filter(pa.array(usable))
        yield {"_id": picked.column("_id"), "_label": picked.column("_label"), "_x": list(features(stats[usable]))}

    rows = map_batches(stats.join(known, "_id"), run, f"_id {kind}, _label int, _x array<double>")
    alike = rows.groupBy("_id", "_label", "_x").agg(F.count("*").alias("_n"))
    return alike.select("_label", "_x", "_n", F.xxhash64("_id", "_x").alias("_key"))


def drawn_rows(rows: DataFrame, held: dict[int, int]) -> list[np.ndarray]:
    """The rows that each tree sees: of each label those of the least hashes, which differ from
    tree to tree. ``held``: how many rows each label has."""
    wanted = dict(zip((1, 0), per_tree(held[1], held[0])))
    # Hashes below these hold all that a tree wants, and few more.
    share = {k: min(1.0, (n + 6 * n**0.5 + 20) / held[k]) for k, n in wanted.items()}
    codes = numbers(TREES, 29)

    def draw(batch):
        x, label = _matrix(batch.column("_x"), len(FEATURES)), batch.column("_label").to_numpy()
        keys = batch.column("_key").to_numpy().view(np.uint64)
        below = np.where(label == 1, share[1], share[0])
        for tree, code in enumerate(codes):
            place = (mix(keys ^ code) >> np.uint64(11)).astype(np.int64)  # 53 bits
            some = np.flatnonzero(place <= below * 2.0**53)
            yield {"tree": np.full(len(some), tree), "label": label[some], "place": place[some], "x": list(x[some])}

    # About 400 rows for each tree come to the driver, however many there are.
    got = map_batches(rows, draw, "tree int, label int, place bigint, x array<double>").toArrow()
    tree, label, place = (got.column(c).to_numpy() for c in ("tree", "label", "place"))
    x = np.array(got.column("x").to_pylist(), float).reshape(got.num_rows, -1)
    order = np.lexsort((*x.T, place, label, tree))
    drawn = []
    for t in range(TREES):
        own = order[tree[order] == t]
        drawn.append(np.concatenate([x[own[label[own] == k][:n]] for k, n in wanted.items()]))
    return drawn


def fit(stats: DataFrame, labels: DataFrame, id_="doc_id", label="quality"):
    """The forest, its threshold and the ranges from all labelled rows of ``rule_statistics``,
    or None without labels of both kinds."""
    rows = materialize(labelled_rows(stats, labels, id_, label), "labelled")
    counts = {r["_label"]: r for r in rows.groupBy("_label").agg(F.count("*").alias("held"), F.sum("_n").alias("total")).collect()}
    if len(counts) < 2:
        return None
    total = counts[1]["total"]
    ranges = central(rows.filter("_label = 1"), total)
    drawn = drawn_rows(rows, {k: r["held"] for k, r in counts.items()})
    forest = IsolationForest.grown([outside(x, ranges) for x in drawn])
    shared = rows.sparkSession.sparkContext.broadcast((forest, ranges))

    def score(batch):
        forest, ranges = shared.value
        scores = forest.score(outside(_matrix(batch.column("_x"), len(FEATURES)), ranges))
        yield {"_label": batch.column("_label"), "_n": batch.column("_n"), "_x": list(scores[:, None])}

    scored = materialize(map_batches(rows, score, "_label int, _n bigint, _x array<double>"), "scored")
    floor = order_statistics(scored.filter("_label = 1"), [(0, total - 1 - int(MAX_CLEAN_LOSS * total))])[0]
    above = scored.filter((F.col("_label") == 0) & (F.col("_x")[0] > floor)).agg(F.min(F.col("_x")[0])).head()[0]
    return forest, _raised(floor, above), ranges


def verdicts(stats: np.ndarray, model) -> tuple[np.ndarray, np.ndarray]:
    """The anomaly score and whether each row is kept."""
    failed = base_failed(stats)
    if model is None:
        return np.zeros(len(stats)), ~failed
    forest, threshold, ranges = model
    scores = forest.score(outside(features(stats), ranges))
    return scores, ~failed & (scores <= threshold)


def judge(docs: DataFrame, labels: DataFrame, id_="doc_id", text="text") -> DataFrame:
    """Per row: the id, the base statistics, ``base_failed``, ``anomaly``, ``kept``. Texts are
    read once; what is fitted and judged are their stored statistics."""
    stats = materialize(rule_statistics(docs, id_, text), "statistics")
    shared = docs.sparkSession.sparkContext.broadcast(fit(stats, labels, id_))

    def run(batch):
        stats = _matrix(batch.column("_stats"), len(BASE + EXTRA))
        scores, kept = verdicts(stats, shared.value)
        yield {id_: batch.column("_id"), **dict(zip(BASE, stats.T)), "base_failed": base_failed(stats), "anomaly": scores, "kept": kept}

    kind = docs.schema[id_].dataType.simpleString()
    counts = ", ".join(f"{n} bigint" for n in BASE)
    return map_batches(stats, run, f"`{id_}` {kind}, {counts}, base_failed boolean, anomaly double, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame, id_="doc_id", text="text") -> DataFrame:
    """The rows of ``docs`` that are kept, with all columns, in one pass after the fit."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(rule_statistics(docs, id_, text), labels, id_))

    def run(batch):
        _, kept = verdicts(statistics(batch.column(text)), shared.value)
        picked = batch.filter(pa.array(kept))
        yield {n: picked.column(n) for n in picked.schema.names}

    return map_batches(docs, run, docs.schema)
