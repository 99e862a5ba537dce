"""Tables kept in hash buckets of a key, of which a change rewrites only those it touches.

A bucket is a partition folder, so readers prune to the buckets they want, and rewriting a
bucket also compacts it: each ends up in few files, however many changes came before. A
bucket that one key fills is written by several tasks. There is one writer at a time.

A change is first written whole to ``_pending`` inside the table and then put in place. If
the writer is lost in between, the next change (or ``recover``) puts it in place again
before anything else, so no bucket is lost half-way and a replayed change adds nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plenum.operators.windows import latest
from plenum.session import materialize, release
from plenum.sources import merge

BUCKET = "_bucket"


@dataclass(frozen=True)
class BucketedTable:
    """A Parquet table under ``path``; choose ``buckets`` so that one holds some 100 MB."""

    spark: SparkSession
    path: str
    schema: StructType
    keys: tuple[str, ...]
    buckets: int

    def read(self, only: Sequence[int] | None = None) -> DataFrame:
        """The table, or some of its buckets; a table never written is empty."""
        if not self._exists(""):
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(StructType([*self.schema.fields]).add(BUCKET, "integer")).parquet(self.path)
        return (rows if only is None else rows.filter(F.col(BUCKET).isin(list(only)))).drop(BUCKET)

    def upsert_newest(self, changes: DataFrame, order: Sequence[Column | str]) -> list[int]:
        """Keep the newest row of each key, stored or new; NULL is a key like others. ``order``
        should leave no ties between different rows."""
        return self.rewrite(changes, lambda old, new: latest(old.unionByName(new), list(self.keys), order))

    def replace(self, rows: DataFrame) -> list[int]:
        """Replace all rows of the keys that occur in ``rows`` (``merge.replace_by_key``). Rows
        without a key replace nothing, so they are added again if the same change is repeated."""
        (key,) = self.keys
        return self.rewrite(rows, lambda old, new: merge.replace_by_key(old, new, key))

    def rewrite(self, changes: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Put ``change(stored, changes)`` in place of the buckets that ``changes`` touches, and
        return these. ``change`` must not give rows of other buckets."""
        self.recover()
        changes = materialize(changes.select(*self.schema.names).withColumn(BUCKET, self._bucket()), "changes")
        # At most ``buckets`` numbers.
        touched = sorted(r[0] for r in changes.select(BUCKET).distinct().collect())
        if touched:
            rows = change(self.read(touched), changes.drop(BUCKET)).select(*self.schema.names)
            listed = self.spark.createDataFrame([(b,) for b in touched], f"{BUCKET} int")
            listed.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/_pending/touched")
            rows.withColumn(BUCKET, self._bucket()).write.mode("overwrite").parquet(f"{self.path}/_pending/rows")
            self.recover()
        release(changes)
        return touched

    def recover(self) -> None:
        """Put a pending change in place, if there is a complete one; drop half a one."""
        if self._exists("_pending/rows/_SUCCESS"):
            pending = f"{self.path}/_pending"
            rows = self.spark.read.schema(StructType([*self.schema.fields]).add(BUCKET, "integer")).parquet(f"{pending}/rows")
            touched = {r[0] for r in self.spark.read.schema(f"{BUCKET} int").parquet(f"{pending}/touched").collect()}
            self._place(rows)
            left = {r[0] for r in rows.select(BUCKET).distinct().collect()}
            for bucket in sorted(touched - left):
                self._delete(f"{BUCKET}={bucket}")
        self._delete("_pending")

    def _place(self, rows: DataFrame) -> None:
        split = rows.hint("rebalance", F.col(BUCKET))  # few files for each bucket, hot ones split
        writer = split.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(BUCKET).parquet(self.path)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _file(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        path, files = self._file(name)
        return files.exists(path)

    def _delete(self, name: str) -> None:
        path, files = self._file(name)
        files.delete(path, True)
