"""How filters interact: what each removes, over every order in which they can be applied.

Five filters look at each whole text (NULL is empty; words are maximal runs of characters
other than space and the controls 9 to 13):

    A  fewer than 200 words
    B  fewer than half of the words are different
    C  over 2 % of the code points are letters A to Z
    D  holds one of ``# $ % & * |``
    E  equal to the text of a row with a smaller id, wherever that row ends up

A document's failures are a mask of five bits, and all that the audit counts depends on the
mask alone. So rows are reduced to cells (part, mask) with three weights: documents, good
ones and toxic ones. Each cell folds over the literal array of all 120 orders with
``aggregate`` and ``transform`` into 600 structs, one for each order and step; the structs
of a part's cells, 32 at most, are added element by element. All of it is SQL functions.

Filter E keeps one row a text: the smallest id by the SHA-256 of the text, combined before
the shuffle and joined back only for texts that occur more than once, so that a text which a
third of the rows share is split by AQE like any hot join key.

Defined results: NULL sources count as the empty string; rows with a NULL id have no label
and neither make others fail E nor fail it; of rows repeated with their id none is smaller
than the other; an id labelled more than once is good or toxic if any of its labels says so;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenum.operators.skew import grouped_for_join
from plenum.session import materialize

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS)
SPACES = r"[\x20\x09-\x0D]+"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MEASURES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
CELL = "struct<" + ", ".join(f"{m}: bigint" for m in MEASURES) + ">"


def own_failures(docs: DataFrame, id_: str, text: str, source: str) -> DataFrame:
    """Per row (id, part, own, digest): the failures of filters A to D as bits, and the
    SHA-256 of the text."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_).alias("id"), F.coalesce(F.col(source), F.lit("")).alias("part"), body.alias("body"))
    rows = rows.withColumn("words", F.array_remove(F.split("body", SPACES), ""))
    size = F.size("words")
    upper = F.char_length("body") - F.char_length(F.translate("body", LETTERS, ""))
    checks = [
        size < 200,
        100 * F.size(F.array_distinct("words")) < 50 * size,
        100 * upper > 2 * F.char_length("body"),
        F.col("body").rlike(r"[#$%&*|]"),
    ]
    own = sum((F.when(check, 1 << k).otherwise(0) for k, check in enumerate(checks)), F.lit(0))
    return rows.select("id", "part", own.alias("own"), F.unhex(F.sha2("body", 256)).alias("digest"))


def cells(docs: DataFrame, labels: DataFrame, id_: str, text: str, source: str, quality: str, toxic: str) -> DataFrame:
    """(part, mask, n, good, toxic): how many documents fail exactly the filters of a mask."""
    rows = materialize(own_failures(docs, id_, text, source), "audit")
    repeated = grouped_for_join(rows, ["digest"], F.min("id").alias("least"), F.count("*").alias("copies"))
    rows = rows.join(repeated.filter("copies > 1").select("digest", "least"), "digest", "left")
    later = F.coalesce(F.col("id") > F.col("least"), F.lit(False))
    rows = rows.select("id", "part", (F.col("own") + F.when(later, 1 << (STEPS - 1)).otherwise(0)).alias("mask"))
    marks = labels.filter(F.col(id_).isNotNull()).select(
        F.col(id_).alias("id"),
        F.coalesce(F.col(quality) == 1, F.lit(False)).cast("bigint").alias("good"),
        F.coalesce(F.col(toxic) == 1, F.lit(False)).cast("bigint").alias("toxic"),
    )
    marks = grouped_for_join(marks, ["id"], F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    weighed = rows.join(marks, "id", "left")
    return weighed.groupBy("part", "mask").agg(
        F.count("*").alias("n"),
        F.sum(F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"),
    )


def folded() -> Column:
    """The 600 structs of a cell, in the order of ``ORDERS`` and steps."""

    def weight(condition: Column, name: str) -> Column:
        return F.when(condition, F.col(name)).otherwise(F.lit(0).cast("bigint"))

    def step(state: Column, letter: Column) -> Column:
        gone, bit = state["gone"], F.element_at(bits, letter)
        fails = F.col("mask").bitwiseAND(bit) != 0
        here = fails & ~gone
        counts = F.struct(
            weight(~gone & ~fails, "n").alias("kept"),
            weight(here, "n").alias("removed"),
            weight(fails & gone, "n").alias("redundant"),
            weight(F.col("mask") == bit, "n").alias("unique_fails"),
            weight(here, "good").alias("good_lost"),
            weight(here, "toxic").alias("toxic_lost"),
        )
        return F.struct((gone | fails).alias("gone"), F.concat(state["steps"], F.array(counts)).alias("steps"))

    bits = F.create_map(*[F.lit(x) for k, f in enumerate(FILTERS) for x in (f, 1 << k)])
    start = F.struct(F.lit(False).alias("gone"), F.array().cast(f"array<{CELL}>").alias("steps"))
    orders = F.array(*[F.lit(o) for o in ORDERS])
    return F.flatten(F.transform(orders, lambda o: F.aggregate(F.split(o, ""), start, step, lambda s: s["steps"])))


def added(left: Column, right: Column) -> Column:
    """Two arrays of structs, added element by element."""
    return F.zip_with(left, right, lambda a, b: F.struct(*[(a[m] + b[m]).alias(m) for m in MEASURES]))


def audit(
    docs: DataFrame, labels: DataFrame, id_="doc_id", text="text", source="source", quality="quality", toxic="toxic"
) -> DataFrame:
    """Per part, filter order and step: documents kept, removed, redundant, failing only this
    filter, good and toxic ones lost, and the filter's removals summed over all orders."""
    zero = F.array_repeat(F.struct(*[F.lit(0).cast("bigint").alias(m) for m in MEASURES]), len(ORDERS) * STEPS)
    folds = cells(docs, labels, id_, text, source, quality, toxic).select("part", folded().alias("fold"))
    # At most 32 cells a part.
    merged = folds.groupBy("part").agg(F.collect_list("fold").alias("folds"))
    rows = merged.select("part", F.posexplode(F.aggregate("folds", zero, added)).alias("at", "counts"))
    order = F.element_at(F.array(*[F.lit(o) for o in ORDERS]), F.floor(F.col("at") / STEPS).cast("int") + 1)
    letter = F.substring(F.lit("".join(ORDERS)), F.col("at") + 1, 1)
    # 120 rows for each part and letter, dealt by part already.
    whole = F.sum("counts.removed").over(Window.partitionBy("part", letter))
    return rows.select(
        "part",
        order.alias("filter_order"),
        (F.col("at") % STEPS + 1).cast("int").alias("step"),
        "counts.*",
        whole.alias("shapley"),
    )
