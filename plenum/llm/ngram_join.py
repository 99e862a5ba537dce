"""Near duplicates by an exact n-gram Jaccard join, with a partition of the universe.

A document's set holds its different shingles of five lower-cased words. Two sets link when
their Jaccard similarity is 0.75 or more. Sets of sizes r <= s that link differ in at most
``(r + s) / 7`` shingles. Sizes fall into bands, each reaching 4/3 of the one before, so the
larger set of a link lies in the band of the smaller one or in the next. For each band a hash
deals all shingles into m segments. By the pigeonhole principle, sets that differ in at most
H shingles agree in all but H segments; whichever H + 1 units a set spends on its segments,
one unit for segments that must agree and one more for those that may differ by one deletion,
one of them finds every partner. So a set is indexed under the subset of its shingles in each
segment that is not empty, in its own band and in the next; in bands of small sets also under
each subset less one shingle.

Allocation by cost: buckets shared by more than ``HEAVY`` sets are dear and never read. A set
that still has H + 1 units without them finds every partner; m is chosen so that most have.
A link can be missed only between two sets that are both short of units (members of large
groups of near copies, and texts that are mostly common passages). Among these, signatures
are single shingles: each set is listed under its rarest ones, one more than it may lack of a
partner's, so that two linked sets meet there and common passages, which are not rare, bring
nobody together. Lists of at most ``HEAVY`` sets are compared pair by pair. In longer ones
members are compared with representatives, those that share most with the others, unless
both are in one component already; a list is closed once all its members are in one component
or have met as representatives, whose number doubles from round to round. So a group of
near copies costs a few comparisons a member, and no link between components is lost. Sets
that agree completely are one set from the start.

Every candidate pair is verified on the whole sets. Defined results: NULL texts and texts
without words have no shingles and no links; texts of fewer than five words have one; rows
repeated with their id or with a NULL id count like others (a component takes the smallest id
it has); an empty table gives an empty result. Columns other than id and text are not read.
Sets and shingles are known by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenum.llm.arrow import map_batches, mix, numbers, shingle_hashes, slices, text_bytes, word_hashes, word_spans
from plenum.llm.components import components, joined_components
from plenum.operators.skew import grouped_for_join
from plenum.session import materialize, release

SIZE = 5
NUM, DEN = 3, 4  # the threshold
SMALL = 40  # sets up to this size are also indexed less one shingle
SMALL_SEGMENTS = 4096
SLACK, SPARE = 1.25, 12
HEAVY = 8
RARITY_BITS = 20
GROUP_ROWS = 2_000_000
SIG_BITS = 40
PIECE_BYTES = 4 << 20  # texts whose sets are in memory at once


def band_table(largest: int) -> np.ndarray:
    """First sizes of the bands, up to one beyond ``largest``."""
    first = [1]
    while first[-1] <= largest:
        first.append(first[-1] * DEN // NUM + 1)
    first.append(first[-1] * DEN // NUM + 1)
    return np.array(first)


def segments(last: np.ndarray) -> np.ndarray:
    """The number of segments of a band whose largest size is ``last``."""
    room = 2 * last * (DEN - NUM) // (DEN + NUM) + 1
    return np.where(last <= SMALL, SMALL_SEGMENTS, (SLACK * room).astype(np.int64) + SPARE)


def units_needed(size: np.ndarray, last: np.ndarray) -> np.ndarray:
    """H + 1 for partners of at least ``size`` in a band up to ``last``."""
    partner = np.minimum(last, size * DEN // NUM)
    return (size + partner) * (DEN - NUM) // (DEN + NUM) + 1


def shingle_sets(column: pa.Array, size: int = SIZE):
    """(set number of each shingle, shingle), sorted and without repeats, for all texts."""
    held: dict[int, list[np.ndarray]] = {}
    owners, found = [], []

    def add(row: int, words: np.ndarray):
        if len(words):
            shingles = shingle_hashes(words, min(size, len(words)))
            shingles = np.unique(shingles)
            owners.append(np.full(len(shingles), row))
            found.append(shingles)

    for part in slices(column):
        starts, ends, owner = word_spans(part)
        words = word_hashes(part.data, starts, ends, True)
        rows = len(part.offsets) - 1
        if rows == 1:  # maybe one of several slices of a long text
            held.setdefault(part.first, []).append(words)
            continue
        bounds = np.searchsorted(owner, np.arange(rows + 1))
        _add_rows(words, bounds, part.first, size, owners, found)
    for row, pieces in held.items():
        add(row, np.concatenate(pieces))
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    owner, shingle = np.concatenate(owners), np.concatenate(found)
    order = np.argsort(owner, kind="stable")
    return owner[order], shingle[order]


def _add_rows(words, bounds, first, size, owners, found):
    """Different shingles of several texts at once."""
    count = np.diff(bounds)
    whole = np.flatnonzero(count >= size)
    if len(whole):
        every = shingle_hashes(words, size)
        owner = np.repeat(np.arange(len(count)), count)[: len(every)]
        ends = bounds[1:][owner]
        inside = np.arange(len(every)) + size <= ends
        owner, every = owner[inside], every[inside]
        order = np.lexsort((every, owner))
        owner, every = owner[order], every[order]
        new = np.ones(len(every), bool)
        new[1:] = (every[1:] != every[:-1]) | (owner[1:] != owner[:-1])
        owners.append(owner[new] + first)
        found.append(every[new])
    for row in np.flatnonzero((count > 0) & (count < size)).tolist():
        own = words[bounds[row] : bounds[row + 1]]
        owners.append(np.array([row + first]))
        found.append(shingle_hashes(own, len(own)))


def set_ids(owner: np.ndarray, shingle: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The size of each set and its name, a hash of its shingles in any order."""
    n = np.bincount(owner, minlength=rows)
    a, b = np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
    begin = np.cumsum(n) - n
    some = n > 0
    if some.any():
        a[some] = np.add.reduceat(mix(shingle + np.uint64(5)), begin[some])
        b[some] = np.bitwise_xor.reduceat(mix(shingle ^ np.uint64(0xA5A5A5A5A5A5A5A5)), begin[some])
    return n, mix(a + mix(b) + n.astype(np.uint64))


SEGMENT_SEEDS = numbers(64, 101)


def signatures(owner: np.ndarray, shingle: np.ndarray, n: np.ndarray):
    """The index entries of some sets: (set, signature, info) and, for each set, units and
    units needed in its own band and in the next. Bit 0 of info is set in the next band, bit
    1 for a subset less one shingle."""
    bands = band_table(int(n.max(initial=1)))
    own = np.searchsorted(bands, n, "right") - 1
    out, units, needed = [], [], []
    for role in (0, 1):
        band = own + role
        last = bands[np.minimum(band + 1, len(bands) - 1)] - 1
        count = segments(last)
        seed = SEGMENT_SEEDS[band % len(SEGMENT_SEEDS)]
        mixed = mix(shingle ^ seed[owner])
        segment = (mixed % count[owner].astype(np.uint64)).astype(np.int64)
        key = owner * int(count.max(initial=1)) + segment
        order = np.argsort(key, kind="stable")
        key, value, of = key[order], mix(mixed[order]), owner[order]
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(begin, len(key)))
        total = np.add.reduceat(value, begin) if len(begin) else np.zeros(0, np.uint64)
        at = of[begin]
        salt = mix(segment[order][begin].astype(np.uint64) + (band[at].astype(np.uint64) << np.uint64(32)))
        out.append((at, mix(total ^ salt), np.full(len(at), role, np.uint8)))
        small = (last <= SMALL)[at] & (size > 1)
        if small.any():
            pick = np.repeat(small, size)
            less = np.repeat(total, size)[pick] - value[pick]
            out.append((of[pick], mix(less ^ np.repeat(salt, size)[pick]), np.full(int(pick.sum()), role | 2, np.uint8)))
        units.append((np.bincount(at, minlength=len(n)), np.bincount(at[small], minlength=len(n))))
        needed.append(units_needed(n, last))
    return [np.concatenate(x) for x in zip(*out)], units, needed


def pieces(batch: pa.RecordBatch, text: str):
    """The rows of a batch in runs of about ``PIECE_BYTES`` of text; a longer text stays whole."""
    _, offsets = text_bytes(batch.column(text))
    row = 0
    while row < len(batch):
        stop = int(np.searchsorted(offsets, offsets[row] + PIECE_BYTES, "right")) - 1
        stop = min(max(stop, row + 1), len(batch))
        yield batch.slice(row, stop - row)
        row = stop


def describe(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """Per row: the id, the size and name of its set, and its units, exact and less one, and
    units needed, in its own band and the next."""

    def run(whole):
        for batch in pieces(whole, text):
            yield described(batch)

    def described(batch):
        owner, shingle = shingle_sets(batch.column(text))
        n, name = set_ids(owner, shingle, len(batch))
        _, units, needed = signatures(owner, shingle, n)
        return {
            id_: batch.column(id_), "n": n, "set": pa.array(name.view(np.int64), pa.int64(), mask=n == 0),
            "e0": units[0][0], "d0": units[0][1], "need0": needed[0],
            "e1": units[1][0], "d1": units[1][1], "need1": needed[1],
        }

    kind = docs.schema[id_].dataType.simpleString()
    counts = ", ".join(f"{c}{k} bigint" for k in (0, 1) for c in ("e", "d", "need"))
    return map_batches(docs.select(id_, text), run, f"`{id_}` {kind}, n bigint, `set` bigint, {counts}")


def index(docs: DataFrame, text: str, groups: int) -> DataFrame:
    """Index entries dealt out by signature: for each batch and group, the sets, how many
    entries each has of each kind, and the signatures, as packed numbers."""

    def run(whole):
        for batch in pieces(whole, text):
            yield entries(batch)

    def entries(batch):
        owner, shingle = shingle_sets(batch.column(text))
        n, name = set_ids(owner, shingle, len(batch))
        # Copies within a piece are indexed once.
        _, first = np.unique(name, return_index=True)
        keep = np.zeros(len(n), bool)
        keep[first] = True
        inside = keep[owner]
        owner, shingle = owner[inside], shingle[inside]
        (of, sig, info), _, _ = signatures(owner, shingle, np.where(keep, n, 0))
        group = (sig % np.uint64(groups)).astype(np.int64)
        sig = (sig // np.uint64(groups)) & np.uint64((1 << SIG_BITS) - 1)
        order = np.lexsort((info, of, group))
        of, sig, info, group = of[order], sig[order], info[order], group[order]
        head = np.ones(len(of), bool)
        head[1:] = (of[1:] != of[:-1]) | (group[1:] != group[:-1]) | (info[1:] != info[:-1])
        begin = np.flatnonzero(head)
        size = np.diff(np.append(begin, len(of))).astype(np.uint32)
        starts = np.searchsorted(group, np.arange(groups + 1))
        blocks = np.searchsorted(begin, starts)
        packed = np.ascontiguousarray(sig.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : SIG_BITS // 8])
        rows = [g for g in range(groups) if starts[g] < starts[g + 1]]
        heads = [begin[blocks[g] : blocks[g + 1]] for g in rows]
        return {
            "part": rows,
            "sets": [name[of[b]].astype("<u8").tobytes() for b in heads],
            "infos": [info[b].tobytes() for b in heads],
            "sizes": [size[blocks[g] : blocks[g + 1]].astype("<u4").tobytes() for g in rows],
            "sigs": [packed[starts[g] : starts[g + 1]].tobytes() for g in rows],
        }

    return map_batches(docs.select(text), run, "part int, sets binary, infos binary, sizes binary, sigs binary")


def buckets(entries: DataFrame, heavy: int) -> DataFrame:
    """Rows (a, b, info, shared): pairs of sets in buckets of at most ``heavy`` sets, with how
    many they share (info is NULL), and for sets in larger ones how many of each info they
    are in (b is NULL)."""

    def work(table: pa.Table) -> pa.Table:
        sets = np.concatenate([np.frombuffer(x, "<u8") for x in table["sets"].to_pylist()])
        infos = np.concatenate([np.frombuffer(x, np.uint8) for x in table["infos"].to_pylist()])
        sizes = np.concatenate([np.frombuffer(x, "<u4") for x in table["sizes"].to_pylist()]).astype(np.int64)
        raw = np.concatenate([np.frombuffer(x, np.uint8) for x in table["sigs"].to_pylist()]).reshape(-1, SIG_BITS // 8)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, : SIG_BITS // 8] = raw
        sig = wide.view("<u8").ravel()
        order = np.argsort(sig, kind="stable")
        sig = sig[order]
        again = np.zeros(len(sig), bool)
        again[1:] = sig[1:] == sig[:-1]
        again[:-1] |= again[1:]
        sig, order = sig[again], order[again]
        entry = np.repeat(np.arange(len(sizes)), sizes)[order]
        own, info = sets[entry], infos[entry]
        # One row for each set in a bucket, with the lowest of its infos.
        order = np.lexsort((info, own, sig))
        sig, own, info = sig[order], own[order], info[order]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (own[1:] != own[:-1])
        each = ~np.concatenate([[False], (sig[1:] == sig[:-1]) & (own[1:] == own[:-1]) & (info[1:] == info[:-1])]) if len(sig) else new
        begin = np.flatnonzero(np.concatenate([[True], sig[new][1:] != sig[new][:-1]])) if len(sig) else np.zeros(0, np.int64)
        size = np.diff(np.append(begin, int(new.sum())))
        light = np.repeat((size > 1) & (size <= heavy), size)
        members, run = own[new][light], np.repeat(np.arange(len(size)), size)[light]
        probing = (info[new][light] & 1) > 0  # two sets from the band below meet in their own
        left, right = [], []
        for step in range(1, heavy):
            same = (run[step:] == run[:-step]) & ~(probing[step:] & probing[:-step])
            left.append(members[:-step][same])
            right.append(members[step:][same])
        left, right = np.concatenate(left or [own[:0]]), np.concatenate(right or [own[:0]])
        left, right = left.view(np.int64), right.view(np.int64)
        both = np.stack([np.minimum(left, right), np.maximum(left, right)], axis=1)
        pairs, shared = np.unique(both, axis=0, return_counts=True)
        large = np.isin(sig, sig[new][begin[size > heavy]]) & each
        dear, held = np.unique(np.stack([own[large], info[large].astype(np.uint64)], axis=1), axis=0, return_counts=True)
        return pa.table(
            {
                "a": pa.array(np.concatenate([pairs[:, 0], dear[:, 0].view(np.int64)])),
                "b": pa.array(np.append(pairs[:, 1], np.zeros(len(dear), np.int64)), mask=np.arange(len(pairs) + len(dear)) >= len(pairs)),
                "info": pa.array([None] * len(pairs) + dear[:, 1].tolist(), pa.int32()),
                "shared": pa.array(np.concatenate([shared, held]), pa.int64()),
            }
        )

    return entries.groupBy("part").applyInArrow(work, "a bigint, b bigint, info int, shared bigint")


FLAG_BITS = 22


def token_table(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """(set, tokens) of the named sets. Names are first checked against a table of
    ``2 ** FLAG_BITS`` bits, whatever the input, so that few other sets are sent on."""
    slot = F.pmod(F.col("set"), F.lit(1 << FLAG_BITS)).cast("int").alias("slot")
    flags = np.zeros(1 << FLAG_BITS, bool)
    flags[wanted.select(slot).distinct().toPandas()["slot"].to_numpy(np.int64)] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(flags))

    def run(batch):
        known = np.unpackbits(shared.value).astype(bool)
        owner, shingle = shingle_sets(batch.column(text))
        n, name = set_ids(owner, shingle, len(batch))
        name = name.view(np.int64)
        _, first = np.unique(name, return_index=True)
        keep = np.zeros(len(n), bool)
        keep[first] = True
        keep &= known[name % (1 << FLAG_BITS)] & (n > 0)
        bounds = np.concatenate([[0], np.cumsum(n)])
        at = np.flatnonzero(keep).tolist()
        for k in range(0, len(at), 500):
            rows = at[k : k + 500]
            yield {"set": name[rows], "tokens": [shingle[bounds[r] : bounds[r + 1]].astype("<u8").tobytes() for r in rows]}

    found = map_batches(docs.select(text), run, "`set` bigint, tokens binary")
    return found.groupBy("set").agg(F.first("tokens").alias("tokens")).join(wanted, "set", "left_semi")


def similar(pairs: DataFrame, tokens: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link."""
    left = tokens.select(F.col("set").alias("a"), F.col("tokens").alias("x"))
    right = tokens.select(F.col("set").alias("b"), F.col("tokens").alias("y"))
    sized = pairs.join(left, "a").join(right, "b")

    def run(batch):
        good = []
        for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
            x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
            both = np.concatenate([x, y])
            both.sort(kind="stable")
            shared = int((both[1:] == both[:-1]).sum())
            good.append(DEN * shared >= NUM * (len(x) + len(y) - shared))
        picked = batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))
        yield {"a": picked.column("a"), "b": picked.column("b")}

    return map_batches(sized.select("a", "b", "x", "y"), run, "a bigint, b bigint")


def linked_sets(docs: DataFrame, base: DataFrame, text: str, heavy: int = HEAVY) -> DataFrame:
    """(node, component) of the sets that link with another."""
    sets = materialize(
        base.filter("n > 0").groupBy("set").agg(*[F.first(c).alias(c) for c in base.columns if c not in (base.columns[0], "set")]),
        "sets",
    )
    total = sets.agg(F.sum("n").alias("n")).first()["n"] or 0
    groups = max(8, -(-total // GROUP_ROWS))
    found = materialize(buckets(index(docs, text, int(groups)), heavy), "buckets")
    light = found.filter("info is null").groupBy("a", "b").agg(F.sum("shared").alias("shared"))
    costs = materialize(_costs(found.filter("info is not null"), sets), "costs")
    size_a, size_b = sets.select(F.col("set").alias("a"), F.col("n").alias("na")), sets.select(F.col("set").alias("b"), F.col("n").alias("nb"))
    first = _sharing(light, sets, costs).join(size_a, "a").join(size_b, "b").filter(NEAR_IN_SIZE).select("a", "b")
    first = materialize(first.distinct(), "pairs")
    release(found)
    short = materialize(_short(sets, costs), "short")
    wanted = first.select(F.col("a").alias("set")).union(first.select("b")).union(short).distinct()
    tokens = materialize(token_table(docs, text, materialize(wanted, "wanted")), "tokens")
    labels = components(materialize(similar(first, tokens), "verified"))
    release(first, costs, sets)
    return _rest_linked(tokens.join(short, "set", "left_semi"), labels, heavy)


NEAR_IN_SIZE = f"{NUM} * greatest(na, nb) <= {DEN} * least(na, nb)"


def _costs(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """(set, role, left, need, floor): units that a set has outside dear buckets and those it
    needs, in its own band (role 0) and in the next, and how many buckets that are not dear
    it shares at least with a partner: all its segments but H agree."""
    less = F.col("info").bitwiseAND(2) > 0
    lost = rows.groupBy(F.col("a").alias("set"), F.col("info").bitwiseAND(1).alias("role")).agg(
        F.sum(F.when(less, 0).otherwise(F.col("shared"))).alias("x"), F.sum(F.when(less, F.col("shared")).otherwise(0)).alias("v")
    )
    lost = lost.join(sets, "set")
    pick = lambda c: F.when(F.col("role") == 0, F.col(f"{c}0")).otherwise(F.col(f"{c}1"))
    left = pick("e") - F.col("x")
    more = F.greatest(F.lit(0), pick("d") - F.col("v") - F.col("x"))
    return lost.select(
        "set", "role", (left + more).alias("left"), pick("need").alias("need"), (left - pick("need") + 1).alias("floor")
    )


def _short(sets: DataFrame, costs: DataFrame) -> DataFrame:
    """The sets that lack units: without dear buckets, or from the start."""
    thin = sets.filter("e0 + d0 < need0 or e1 + d1 < need1")
    return costs.filter("left < need").select("set").union(thin.select("set")).distinct()


def _rarity(tokens: DataFrame) -> np.ndarray:
    """How often shingles occur, in ``2 ** RARITY_BITS`` slots whatever the input. Any order
    of shingles finds all links; this one makes shingles rare that few sets have."""

    def run(batch):
        held = np.concatenate([np.frombuffer(x, "<u8") for x in batch.column("tokens").to_pylist()] or [np.zeros(0, "<u8")])
        slot, n = np.unique(held >> np.uint64(64 - RARITY_BITS), return_counts=True)
        yield {"slot": slot.astype(np.int32), "n": n}

    counts = map_batches(tokens.select("tokens"), run, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(1 << RARITY_BITS, np.int64)
    table[counts["slot"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
    return table


def _prefixes(tokens: DataFrame) -> DataFrame:
    """(bucket, set, n, place): the rarest shingles of each set, one more than it can lack
    of a partner's, so that linked sets share one of them."""
    shared = tokens.sparkSession.sparkContext.broadcast(_rarity(tokens))

    def run(batch):
        table = shared.value
        rows = [[], [], [], []]
        for set_, x in zip(batch.column("set").to_pylist(), batch.column("tokens").to_pylist()):
            own = np.frombuffer(x, "<u8")
            order = np.lexsort((own, table[(own >> np.uint64(64 - RARITY_BITS)).astype(np.int64)]))
            count = len(own) - -(-NUM * len(own) // DEN) + 1
            for column, value in zip(rows, (own[order[:count]].view(np.int64), np.full(count, set_), np.full(count, len(own)), np.arange(count))):
                column.append(value)
        if rows[0]:
            yield dict(zip(("bucket", "set", "n", "place"), map(np.concatenate, rows)))

    return map_batches(tokens, run, "bucket bigint, `set` bigint, n bigint, place bigint")


def _rest_linked(tokens: DataFrame, labels: DataFrame, heavy: int) -> DataFrame:
    """``labels`` joined up by the links among the sets that were short of units."""
    tokens = materialize(tokens, "short_tokens")
    entries = materialize(_prefixes(tokens), "prefixes")
    sizes = grouped_for_join(entries, ["bucket"], F.count("*").alias("size")).filter("size > 1")
    sized = materialize(entries.join(sizes, "bucket"), "prefix_buckets")
    release(entries)
    small = sized.filter(F.col("size") <= heavy).drop("size")
    other = small.select("bucket", *[F.col(c).alias(f"_{c}") for c in ("set", "n", "place")])
    met = small.join(other, "bucket").filter(F.col("set") < F.col("_set")).filter(_can_link())
    pairs = materialize(met.select(F.col("set").alias("a"), F.col("_set").alias("b")).distinct(), "pairs")
    labels = joined_components(labels, similar(pairs, tokens))
    dear = sized.filter(F.col("size") > heavy)
    weight = grouped_for_join(dear, ["set"], F.sum("size").alias("weight"))
    dear = materialize(dear.drop("size").join(weight, "set"), "dear")
    release(sized)
    pivots, tried = 1, pairs
    while True:
        named = dear.join(labels.withColumnRenamed("node", "set"), "set", "left")
        named = named.withColumn("component", F.coalesce("component", "set"))
        spread = grouped_for_join(named, ["bucket"], F.min("component").alias("lo"), F.max("component").alias("hi"))
        named = materialize(named.join(spread.filter("lo <> hi").select("bucket"), "bucket"), "named")
        release(dear)
        if named.isEmpty():
            return labels
        pairs, dear = _pivoted(named, pivots)
        pairs = materialize(pairs.distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
        dear = materialize(dear, "dear")
        release(named)
        labels = joined_components(labels, similar(pairs, tokens))
        tried = tried.union(pairs)
        pivots *= 2


def _can_link() -> Column:
    """Whether two sets of a bucket can link, if this is the first shingle that they share:
    by their sizes and by what lies behind it in each."""
    behind = F.least(F.col("n") - F.col("place"), F.col("_n") - F.col("_place"))
    fits = NUM * F.greatest("n", "_n") <= DEN * F.least("n", "_n")
    return fits & ((NUM + DEN) * behind >= NUM * (F.col("n") + F.col("_n")))


def _pivoted(named: DataFrame, pivots: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of each open bucket's pivots, its members of most weight, with members of other
    components; and the buckets without them. What the pivots have met need not meet again."""
    ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("weight"), "set")))
    best = ranked.filter(F.col("rank") <= pivots).drop("weight", "rank")
    other = best.select("bucket", *[F.col(c).alias(f"_{c}") for c in ("set", "n", "place", "component")])
    met = named.join(other, "bucket").filter("component <> _component").filter(_can_link())
    pairs = met.select(F.least("set", "_set").alias("a"), F.greatest("set", "_set").alias("b"))
    return pairs, named.drop("component").join(best.select("bucket", "set"), ["bucket", "set"], "left_anti")


def _sharing(light: DataFrame, sets: DataFrame, costs: DataFrame) -> DataFrame:
    """The pairs that share as many buckets as links must. The smaller set counts, in its own
    band or, if that shares fewer, in the next, whichever asks for less."""
    floors = sets.select(
        "set", "n", (F.col("e0") - F.col("need0") + 1).alias("f0"), (F.col("e1") - F.col("need1") + 1).alias("f1")
    )
    for role in (0, 1):
        own = costs.filter(f"role = {role}").select("set", F.col("floor").alias("_f"))
        floors = floors.join(own, "set", "left").withColumn(f"f{role}", F.coalesce("_f", f"f{role}")).drop("_f")
    floors = floors.select("set", "n", F.least("f0", "f1").alias("f"))
    for side in ("a", "b"):
        named = floors.select(F.col("set").alias(side), F.col("n").alias(f"n{side}"), F.col("f").alias(f"f{side}"))
        light = light.join(named, side)
    least = F.when(F.col("na") < F.col("nb"), F.col("fa")).when(F.col("na") > F.col("nb"), F.col("fb"))
    return light.filter(F.col("shared") >= F.coalesce(least, F.least("fa", "fb"))).select("a", "b")


def near_duplicates(docs: DataFrame, id_: str = "doc_id", text: str = "text", heavy: int = HEAVY) -> DataFrame:
    """Per row: the id, ``n_shingles`` and ``component_id``, the smallest id reachable by
    links, its own included."""
    docs = docs.select(id_, text)
    base = materialize(describe(docs, id_, text), "sets")
    labels = linked_sets(docs, base, text, heavy)
    known = labels.select(F.col("node").alias("set"), "component")
    named = base.select(id_, "n", "set").join(known, "set", "left").withColumn("component", F.coalesce("component", "set"))
    named = materialize(named, "named")
    least = grouped_for_join(named.filter("n > 0"), ["component"], F.min(id_).alias("component_id"))
    linked = named.filter("n > 0").join(least, "component").select(id_, F.col("n").alias("n_shingles"), "component_id")
    alone = named.filter("n = 0").select(id_, F.col("n").alias("n_shingles"), F.col(id_).alias("component_id"))
    return linked.unionByName(alone)


def one_of_each(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with all columns, less those of a component whose smallest id is
    another's; of rows repeated with that id, one stays, the first by all columns."""
    from plenum.llm.arrow import free_names

    key, size, place, words = free_names(docs, "_id", "_n", "_place", "_words")
    found = near_duplicates(docs, id_, text)
    stay = found.filter(F.col(id_).eqNullSafe(F.col("component_id")))
    stay = stay.select(F.col(id_).alias(key), (F.col("n_shingles") > 0).alias(size)).distinct()
    filled = docs.withColumn(words, F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    match = F.col(id_).eqNullSafe(F.col(key)) & (F.col(words) == F.col(size))
    joined = filled.join(stay, match, "left_semi")
    first = Window.partitionBy(id_, words).orderBy(*docs.columns)
    ranked = joined.withColumn(place, F.row_number().over(first))
    return ranked.filter((F.col(place) == 1) | ~F.col(words)).select(*docs.columns)
