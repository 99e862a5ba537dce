"""Bounded samples of labelled rows to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_BYTES = 48 << 20


def sample_by_class(
    docs: DataFrame, labels: DataFrame | None, label: str, per_class: int, fold, id_: str = "doc_id",
    text: str = "text", max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """(label, text) of at most ``per_class`` rows of each label that lie in ``fold`` (a
    condition on the id), the first by the hash of the id, and of at most ``max_bytes`` of
    text in all. Labels come from ``labels`` (one or more rows per id, the smallest label
    counts) or from a column of ``docs``. The hash does not depend on the label or on the
    order of rows, so reruns agree."""
    order = F.xxhash64("_id")
    if labels is None:
        known = docs.filter(fold & F.col(label).isNotNull() & F.col(text).isNotNull())
        known = known.select(F.col(id_).alias("_id"), F.col(label).alias("_label"))
    else:
        known = labels.filter(fold & F.col(id_).isNotNull() & F.col(label).isNotNull())
        known = known.groupBy(F.col(id_).alias("_id")).agg(F.min(label).alias("_label"))
    place = F.row_number().over(Window.partitionBy("_label").orderBy(order, "_id"))
    chosen = known.withColumn("_place", place).filter(F.col("_place") <= per_class).select("_id", "_label", "_place")
    # At most ``per_class`` ids of each label; a label set is small.
    rows = docs.select(F.col(id_), F.col(text)).join(F.broadcast(chosen), F.col(id_) == F.col("_id"))
    rows = rows.select("_place", order.alias("_order"), F.col("_label"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    sizes = Window.orderBy("_place", "_order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("_upto", F.sum(F.octet_length("_text")).over(sizes)).filter(F.col("_upto") <= max_bytes)


def held_out(id_: str, folds: int, fold: int):
    """Whether the CRC-32 of the id as text falls into a fold; a NULL id does not."""
    return F.coalesce(F.crc32(F.col(id_).cast("string")) % folds == fold, F.lit(False))
