"""Splitting long texts into overlapping chunks and putting them back together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A long text is cut into large pieces, these into smaller ones, and the smallest into
# chunks, each level FAN to one. Cutting every chunk out of the whole text would read (or
# copy, for bytes) the whole text for each of them; so every level reads it FAN times at most.
FAN = 128
LEVELS = 2
MAX_LENGTH = 2**31 - 1


def _starts(length: Column, step: int, overlap: int) -> Column:
    """Zero-based chunk numbers: the first chunk, then one for every further
    start that brings characters the chunk before did not have."""
    last = F.greatest(F.ceil((length - overlap) / step), F.lit(1)) - 1
    return F.when(length > 0, F.sequence(F.lit(0).cast("bigint"), last.cast("bigint")))


def chunk(
    df: DataFrame,
    text: str,
    size: int,
    overlap: int = 0,
    *,
    unit: str = "chars",
    index: str = "chunk_index",
    content: str = "content",
) -> DataFrame:
    """One row per fixed-size chunk; consecutive chunks share ``overlap`` units.

    ``unit="chars"`` counts code points, so no character is cut. ``unit="bytes"``
    cuts the UTF-8 bytes and returns binary chunks. Empty and NULL texts give none.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below size")
    if unit not in ("chars", "bytes"):
        raise ValueError("unit must be 'chars' or 'bytes'")
    step = size - overlap
    keep = [c for c in df.columns if c != text]
    whole, length = (F.col(text), F.length) if unit == "chars" else (F.encode(F.col(text), "UTF-8"), F.octet_length)
    cut = df.select(*keep, F.lit(0).cast("bigint").alias("_no"), whole.alias("_body"))
    for level in range(LEVELS, -1, -1):
        count = FAN**level  # chunks in a piece
        if step * count + overlap > MAX_LENGTH:
            continue
        cut = _cut(cut, keep, length, step * count, overlap)
    return cut.select(*keep, F.col("_no").cast("int").alias(index), F.col("_body").alias(content))


def _cut(df: DataFrame, keep: list[str], length, stride: int, overlap: int) -> DataFrame:
    """Every piece of ``df`` cut into numbered ones of ``stride`` units and the overlap. All
    pieces but a text's last are full, so numbers go on by ``FAN`` from piece to piece."""
    several = F.transform(
        _starts(length("_body"), stride, overlap),
        lambda i: F.struct(
            (F.col("_no") * FAN + i).alias("no"),
            F.substring("_body", (i * stride + 1).cast("int"), F.lit(stride + overlap)).alias("body"),
        ),
    )
    whole = F.array(F.struct((F.col("_no") * FAN).alias("no"), F.col("_body").alias("body")))
    # The bytes are known without reading the text, and are at least its characters.
    parts = F.when(F.octet_length("_body").between(1, stride + overlap), whole).otherwise(several)
    return df.select(*keep, F.explode(parts).alias("_part")).select(
        *keep, F.col("_part.no").alias("_no"), F.col("_part.body").alias("_body")
    )


def reassemble(
    chunks: DataFrame,
    keys: list[str],
    index: str,
    text: str,
    *,
    separator: str = "",
    overlap: int = 0,
    part_chunks: int | None = None,
) -> DataFrame:
    """Texts rebuilt in ``index`` order, with the shared characters dropped.

    Each text is one row, however many chunks it has. With ``part_chunks`` it comes as
    numbered parts of so many chunks, whose concatenation is the whole text.
    """
    body = F.col(text)
    if overlap:
        body = F.when(F.col(index) == 0, body).otherwise(
            F.substring(body, F.lit(overlap + 1), F.length(body))
        )
    part = []
    if part_chunks:
        part = [F.floor(F.col(index) / part_chunks).cast("int").alias("part")]
    return (
        chunks.select(*keys, *part, F.col(index).alias("_at"), body.alias("_body"))
        .groupBy(*keys, *["part"][: len(part)])
        .agg(F.expr(f"listagg(_body, '{separator}') WITHIN GROUP (ORDER BY _at)").alias(text))
    )
