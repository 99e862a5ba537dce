"""Mixing sources to target weights by hash-threshold histograms.

Each row has a fixed 60-bit hash of its id. A source with target ``t`` and size ``s``
takes every row ``floor(t / s)`` times, and once more the rows whose hash lies below a
threshold, chosen so that their sizes sum to the rest. Thresholds for larger budgets
contain those for smaller ones, and reruns agree. The threshold is found without
sorting: sizes are summed by source and hash bucket, the bucket in which the budget
ends is refined by the next bits of the hash, and only rows in the last boundary
bucket, a ``2 ** -bits`` share of their source, are put in order.

Defined results: NULL or empty text has size 0 and is taken 0 times; NULL source is a
source of its own, the last; sources of size 0 have target 0; rows repeated with their
id are rows of their own; equal hashes are ordered by id and size; an empty table gives
an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenum.llm.arrow import WORD, free_names
from plenum.session import materialize

WEIGHTS = (5.0, 2.0, 1.0)
REPEATS = 3
BITS = (12, 12)
HASH_BITS = 60


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def row_hash(id_: str) -> Column:
    """The first 60 bits of the MD5 of the id as text."""
    digest = F.md5(F.coalesce(F.col(id_).cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("bigint")


def targets(
    totals: DataFrame, weights: Sequence[float] = WEIGHTS, repeats: int = REPEATS
) -> DataFrame:
    """``target`` for a table of (source, source_size), one row per source.

    All sizes are shared by weight, a source gets at most ``repeats`` times its size,
    and the excess goes to the others by weight until none is above. The fixed point
    is ``min(repeats * size, level * weight)``: in order of ``repeats * size / weight``
    the first sources are full, and what they leave gives the level of the rest.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place.cast("int") + 1)
    listed = totals.withColumn("_weight", weight).withColumn("_cap", F.col("source_size") * float(repeats))
    fill = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("source").asc_nulls_last())
    earlier = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(earlier), F.lit(0.0))
    share = listed.withColumn("_level", left / F.sum("_weight").over(rest))
    full = F.col("_cap") <= F.col("_level") * F.col("_weight")
    # Past the first source that is not full, the level only falls.
    level = F.max(F.when(~full, F.col("_level"))).over(everything)
    share = share.withColumn("_open", level)
    target = F.when(full, F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_open") * F.col("_weight")))
    return share.select("source", "source_size", target.alias("target"))


def mixed(
    df: DataFrame,
    id_: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = WEIGHTS,
    repeats: int = REPEATS,
    bits: Sequence[int] = BITS,
) -> DataFrame:
    """Per row: the id, ``source``, ``size``, ``source_size``, ``target``, ``times`` the mix
    takes it, and ``taken`` words."""
    sized = df.select(
        F.col(id_), F.col(source).alias("source"), word_count(text).alias("size"), row_hash(id_).alias("_hash")
    )
    return assign(materialize(sized, "sizes"), id_, weights, repeats, bits)


def assign(sized: DataFrame, id_: str, weights=WEIGHTS, repeats=REPEATS, bits=BITS) -> DataFrame:
    """``mixed`` for a stored table of (id, source, size, ``_hash``)."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(totals, weights, repeats)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = plan.withColumn("_whole", whole.cast("bigint"))
    # What one more, partial, pass over the source may still take.
    state = materialize(
        plan.withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size"))
        .withColumn("_low", F.lit(0).cast("bigint"))
        .withColumn("_sum", F.lit(0).cast("bigint")),
        "mix",
    )
    depth = 0
    for step in bits:
        state = materialize(_refine(sized, state, depth, step), "mix")
        depth += step
    width = F.lit(1 << (HASH_BITS - depth))
    rows = _with_state(sized, state)
    border = rows.filter((F.col("_hash") >= F.col("_low")) & (F.col("_hash") < F.col("_low") + width))
    order = Window.partitionBy("source").orderBy("_hash", F.col(id_).asc_nulls_last(), "size")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = border.withColumn("_sum", F.col("_sum") + before)
    extra_inner = F.col("_sum") * 2 + F.col("size") <= F.col("_rest") * 2
    outer = rows.filter((F.col("_hash") < F.col("_low")) | (F.col("_hash") >= F.col("_low") + width))
    both = outer.withColumn("_extra", F.col("_hash") < F.col("_low")).unionByName(
        inner.withColumn("_extra", extra_inner)
    )
    times = F.col("_whole") + F.when(F.col("_extra") & (F.col("size") > 0), 1).otherwise(0)
    times = F.when(F.col("source_size") > 0, times).otherwise(0).cast("bigint")
    return both.withColumn("times", times).select(
        id_, "source", "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken")
    )


def _with_state(sized: DataFrame, state: DataFrame) -> DataFrame:
    """Each row with the state of its source; a NULL source matches a NULL one. The state
    is one row per source; Spark sends it along where it is small."""
    right = state.withColumnRenamed("source", "_source")
    return sized.join(right, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def _refine(sized: DataFrame, state: DataFrame, depth: int, step: int) -> DataFrame:
    """Move the lower end of each source's boundary bucket down one level of buckets."""
    width = 1 << (HASH_BITS - depth)
    part = width >> step
    rows = _with_state(sized, state.select("source", "_low"))
    rows = rows.filter((F.col("_hash") >= F.col("_low")) & (F.col("_hash") < F.col("_low") + width))
    bucket = ((F.col("_hash") - F.col("_low")) / F.lit(part)).cast("bigint")
    if depth + step > 52:
        raise ValueError("the hash is refined by 52 bits at most")
    sums = rows.groupBy("source", bucket.alias("_bucket")).agg(F.sum("size").alias("_size"))
    order = Window.partitionBy("source").orderBy("_bucket")
    before = F.coalesce(F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("_before", before)
    sums = sums.join(
        state.select(F.col("source").alias("_source"), "_sum", "_rest"),
        F.col("source").eqNullSafe(F.col("_source")),
    )
    # The last bucket that begins within the budget.
    begins = sums.filter(F.col("_sum") + F.col("_before") <= F.col("_rest"))
    last = begins.groupBy("source").agg(F.max_by(F.struct("_bucket", "_before"), "_bucket").alias("_b"))
    last = last.select(F.col("source").alias("_source"), "_b")
    moved = state.join(last, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    return moved.withColumns(
        {
            "_low": F.col("_low") + F.coalesce(F.col("_b._bucket"), F.lit(0)) * F.lit(part),
            "_sum": F.col("_sum") + F.coalesce(F.col("_b._before"), F.lit(0)),
        }
    ).drop("_b")


def mix_documents(df: DataFrame, id_: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mixed table: each row of ``df`` as often as the mix takes it, all columns kept.
    Rows of no size stay out. Rows that share an id share their hash and their order, so
    the plan is joined on id, source and size, each of which it gives one ``times``."""
    key, origin, words, times, rows, here, take, copy = free_names(
        df, "_id", "_source", "_words", "_times", "_rows", "_here", "_take", "_copy"
    )
    plan = mixed(df, id_, text, source, **options).filter("times > 0")
    plan = plan.groupBy(F.col(id_).alias(key), F.col("source").alias(origin), F.col("size").alias(words))
    plan = plan.agg(F.sum("times").alias(times), F.count("*").alias(rows))
    match = (
        F.col(id_).eqNullSafe(F.col(key))
        & F.col(source).eqNullSafe(F.col(origin))
        & (F.col(here) == F.col(words))
    )
    joined = df.withColumn(here, word_count(text)).join(plan, match)
    # Of rows alike in id, source and size, the first ones take what does not divide.
    others = [c for c in df.columns if c not in (id_, source)]
    order = Window.partitionBy(id_, source, here).orderBy(*(others or [id_]))
    first = F.row_number().over(order) <= F.col(times) % F.col(rows)
    counted = joined.withColumn(take, (F.floor(F.col(times) / F.col(rows)) + F.when(first, 1).otherwise(0)).cast("int"))
    repeated = counted.filter(F.col(take) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(take))))
    return repeated.select(*df.columns)
