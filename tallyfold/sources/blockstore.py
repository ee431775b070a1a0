"""A stored bag of keys in sorted blocks, with sparse running digests: positions, ranges and bounds are answered from two entries and two blocks at most.

All blocks hold ``rows`` keys but the last one, so a position's block follows from its number. Each block has an entry: its least key, its count and digest, and the count and digest of all keys before it. A
range's digest is the difference of the digests up to its ends, and either is an entry's and that of a part of one block.

    keys/block=B   k, at: the keys in order, and their places from 0
    entries        block, least, n, l0..l7, before, b_l0..b_l7

Equal keys are copies, each with a place of its own; null keys are an error. The entries, one row a block, are the only table that is sorted in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from tallyfold.functions import lanes as L
from tallyfold.operators import bags

LANES = ", ".join(f"{n} long" for n in L.NAMES)
ENTRIES = f"block long, least string, n long, {LANES}, before long, {', '.join(f'b_{n} long' for n in L.NAMES)}"


@dataclass(frozen=True)
class BlockStore:
    spark: SparkSession
    folder: str
    rows: int

    @classmethod
    def create(cls, keys: DataFrame, folder: str, rows: int = 1 << 20) -> BlockStore:
        """A new store of the bag ``keys`` (k)."""
        if rows < 1:
            raise ValueError("a block has a row at least")
        store = cls(keys.sparkSession, folder.rstrip("/"), rows)
        known = F.when(F.col("k").isNotNull(), F.col("k")).otherwise(F.raise_error(F.lit("a key has 32 bytes")))
        placed = bags.ranked(keys.select(known.alias("k")), ["k"]).withColumn("block", F.call_function("div", F.col("at"), F.lit(rows)))
        placed.repartition("block").sortWithinPartitions("block", "at").write.partitionBy("block").parquet(f"{store.folder}/keys")
        digests = bags.with_lanes(store._keys()).groupBy("block").agg(F.min("k").alias("least"), F.count("*").alias("n"), *L.total())
        earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        before = [F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), *[F.pmod(F.coalesce(F.sum(n).over(earlier), F.lit(0)), F.lit(m)).alias(f"b_{n}") for n, m in zip(L.NAMES, L.MODULI, strict=True)]]
        digests.select("block", "least", "n", *L.NAMES, *before).write.parquet(f"{store.folder}/entries")
        store.spark.createDataFrame([(rows,)], "rows long").coalesce(1).write.parquet(f"{store.folder}/settings")
        return store

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> BlockStore:
        return cls(spark, folder.rstrip("/"), spark.read.parquet(f"{folder.rstrip('/')}/settings").first()["rows"])

    def _keys(self) -> DataFrame:
        return self.spark.read.schema("k string, at long, block long").parquet(f"{self.folder}/keys")

    def entries(self) -> DataFrame:
        return self.spark.read.schema(ENTRIES).parquet(f"{self.folder}/entries")

    def _last(self) -> Row | None:
        """The last entry, as one row; None of an empty store."""
        return self.entries().agg(F.max_by(F.struct(*[c for c in self.entries().columns]), "block").alias("e")).first()["e"]

    def count(self) -> int:
        last = self._last()
        return 0 if last is None else last["before"] + last["n"]

    def slice(self, start: int, end: int) -> DataFrame:
        """(k, at) of the keys at the places [start, end). Only their blocks are read."""
        start = max(0, start)
        at = F.col("at")
        return self._keys().where(F.col("block").between(start // self.rows, max(start, end - 1) // self.rows) & (at >= start) & (at < end)).select("k", "at")

    def up_to(self, position: int) -> DataFrame:
        """One row (n, l0..l7): count and digest of the first ``position`` keys, or of all, if there are fewer. One block is read at most."""
        position = max(0, min(position, self.count()))
        block = position // self.rows
        entry = self.entries().where(F.col("block") == block).select("before", *[f"b_{n}" for n in L.NAMES])
        if position and not position % self.rows:  # all of the block before: its entry is enough
            entry = self.entries().where(F.col("block") == block - 1).select((F.col("before") + F.col("n")).alias("before"), *[c.alias(f"b_{n}") for c, n in zip(L.added("", "b_"), L.NAMES, strict=True)])
            return entry.select(F.col("before").alias("n"), *[F.col(f"b_{n}").alias(n) for n in L.NAMES])
        part = bags.bag_digest(self._keys().where((F.col("block") == block) & (F.col("at") < position)).select("k"))
        none = self.spark.range(1).select(F.lit(0).alias("before"), *[F.lit(0).alias(f"b_{n}") for n in L.NAMES])
        both = part.crossJoin(entry if position else none)  # one row each
        return both.select((F.col("n") + F.col("before")).cast("long").alias("n"), *L.added("", "b_"))

    def range_digest(self, start: int, end: int) -> DataFrame:
        """One row (n, l0..l7) of the keys at the places [start, end); an empty range has the count 0 and the empty digest."""
        start = max(0, start)
        if end <= start:
            end = start
        low = self.up_to(start).select(F.col("n").alias("a_n"), *[F.col(n).alias(f"a_{n}") for n in L.NAMES])
        high = self.up_to(end).select(F.col("n").alias("z_n"), *[F.col(n).alias(f"z_{n}") for n in L.NAMES])
        return high.crossJoin(low).select((F.col("z_n") - F.col("a_n")).alias("n"), *L.subtracted("z_", "a_"))  # one row each

    def lower_bound(self, k: str) -> DataFrame:
        """One row (lower_bound): how many keys are less than ``k``. One block is read."""
        entry = self.entries().where(F.col("least") < k).agg(F.max(F.struct("block", "before")).alias("e")).first()["e"]
        if entry is None:
            return self.spark.range(1).select(F.lit(0).cast("long").alias("lower_bound"))
        own = self._keys().where((F.col("block") == entry["block"]) & (F.col("k") < k))
        return own.agg((F.count("*") + F.lit(entry["before"])).alias("lower_bound"))

    def contains(self, k: str) -> bool:
        """Whether a key is there; one block is read."""
        block = self.entries().where(F.col("least") <= k).agg(F.max("block")).first()[0]
        return block is not None and not self._keys().where((F.col("block") == block) & (F.col("k") == k)).isEmpty()
