"""A gold table kept up to date by a stream, exactly once.

Each micro-batch writes its partial aggregates, one row a key, to a folder named by rule version and batch id. A batch that is
replayed after a failure has the same id and replaces its own folder, so nothing counts twice. Readers merge the partials of
one version; a new rule version starts from an empty folder and an own checkpoint, and replaces the old one when it has caught
up. compact() folds the batches up to an id into one base, which readers take instead of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Gold:
    """Partial aggregates by key: parts names how rows become a partial, merges how partials add up, in the same columns."""

    def __init__(self, spark: SparkSession, folder: str, version: str, keys: list[str], parts: dict[str, Column], merges: dict[str, Callable[[str], Column]]):
        self.spark, self.folder, self.keys, self.parts, self.merges = spark, f"{folder.rstrip('/')}/version={version}", keys, parts, merges

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _done(self, kind: str) -> list[int]:
        """Ids of complete folders of a kind, ascending."""
        top = self._path(f"{self.folder}/{kind}")
        fs = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(top):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(top)]
        return sorted(int(n) for n in names if n.isdigit() and fs.exists(self._path(f"{self.folder}/{kind}/{n}/_SUCCESS")))

    def merge(self, rows: DataFrame, batch_id: int) -> None:
        """For foreachBatch: the partials of a batch; a replay replaces them, and one that a base already holds is left out."""
        bases = self._done("base")
        if bases and batch_id <= bases[-1]:
            return
        partial = rows.groupBy(*self.keys).agg(*(c.alias(n) for n, c in self.parts.items()))
        partial.write.mode("overwrite").parquet(f"{self.folder}/batch/{batch_id}")

    def compact(self) -> None:
        """Fold everything so far into one base; older folders are no longer read."""
        batches = self._done("batch")
        if batches and (not (bases := self._done("base")) or batches[-1] > bases[-1]):
            self.read().write.mode("overwrite").parquet(f"{self.folder}/base/{batches[-1]}")

    def read(self) -> DataFrame | None:
        """One row a key; None before the first batch."""
        bases, batches = self._done("base"), self._done("batch")
        upto = bases[-1] if bases else -1
        paths = [f"{self.folder}/base/{upto}"] * bool(bases) + [f"{self.folder}/batch/{i}" for i in batches if i > upto]
        if not paths:
            return None
        return self.spark.read.parquet(*paths).groupBy(*self.keys).agg(*(f(n).alias(n) for n, f in self.merges.items()))

    def follow(self, stream: DataFrame) -> None:
        """Take in what is there; the checkpoint beside the table remembers how far."""
        stream.writeStream.foreachBatch(self.merge).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def by_creator(spark: SparkSession, folder: str, version: str = "v1") -> Gold:
    """Captures (orders) to creators: captures, kept ones, first and last day, total price in cents."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    parts = {"captures": F.count(F.lit(1)), "kept": F.count_if(F.col("o_orderstatus") == "F"), "first": F.min("o_orderdate"), "last": F.max("o_orderdate"), "cents": F.sum(cents)}
    return Gold(spark, folder, version, ["o_custkey"], parts, {"captures": F.sum, "kept": F.sum, "first": F.min, "last": F.max, "cents": F.sum})
