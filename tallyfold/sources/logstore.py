"""A stored log of operations with a bounded digest index that is kept up batch by batch.

Each batch of operations is appended with its own few index rows; nothing that was written before is read again but one row, the head: how many operations there are, and the digest after them. The
index holds the digests at the last ``retained`` + 1 positions (a position is a number of operations applied). A position's digest comes from the head by taking later operations away again, so
a batch costs one sum over its operations and a running sum over the last ``retained`` of them. Positions that have left the index are still answered within one epoch: from the digest before
the batch that holds them, and that batch's operations alone.

    generation=G/ops/batch=N      pos, is_add, k: operations, numbered from 0 without gaps
    generation=G/index/batch=N    position, l0..l7: the last positions of the batch
    generation=G/heads/batch=N    one row: epoch, first, last (positions before and after the batch), b_l0.. and l0.. (the digests there)

Heads are written last, and a batch counts once its head is there; one that runs again after a lost driver is written again, or left alone if it counts. Compaction starts a generation with the last ``retained``
operations, counted from 0, and the digest before them, in the next epoch. There is one writer at a time. The driver holds batch numbers since the last compaction and single rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from tallyfold.functions import lanes as L
from tallyfold.operators import bags, oplog
from tallyfold.plans.recovery import COMPRESSION, numbered, removed, written

LANES = ", ".join(f"{n} long" for n in L.NAMES)
OPS = "pos long, is_add boolean, k string, batch int"
INDEX = f"position long, {LANES}, batch int"
HEADS = f"epoch int, first long, last long, {', '.join(f'b_{n} long' for n in L.NAMES)}, {LANES}, batch int"


def same_digest(digest: Row) -> Column:
    """Whether the lanes l0..l7 of a row are those of ``digest``."""
    same = F.lit(True)
    for n in L.NAMES:
        same = same & (F.col(n) == F.lit(digest[n]))
    return same


@dataclass(frozen=True)
class LogStore:
    spark: SparkSession
    folder: str
    retained: int = oplog.RETAINED

    @classmethod
    def create(cls, spark: SparkSession, folder: str, retained: int = oplog.RETAINED, epoch: int = 0) -> LogStore:
        """A new, empty log."""
        log = cls(spark, folder.rstrip("/"), retained)
        log._begin(spark.createDataFrame([], "pos long, is_add boolean, k string"), -1, epoch, [0] * 8)
        return log

    @classmethod
    def from_members(cls, members: DataFrame, folder: str, retained: int = oplog.RETAINED, epoch: int = 0) -> LogStore:
        """A new log of inserts of all members in key order."""
        log = cls(members.sparkSession, folder.rstrip("/"), retained)
        log.rebuild(members, epoch)
        return log

    # Reading

    def generation(self) -> int:
        """The newest one that counts; -1 if there is none."""
        return next((g for g in reversed(numbered(self.spark, self.folder, "generation", done=False)) if self._batches(g)), -1)

    def _batches(self, generation: int) -> list[int]:
        return numbered(self.spark, f"{self.folder}/generation={generation}/heads", "batch")

    def _read(self, what: str, schema: str) -> DataFrame:
        g = self.generation()
        top, done = f"{self.folder}/generation={g}/{what}", self._batches(g)
        rows = self.spark.read.option("basePath", top).schema(schema)
        return rows.parquet(*[f"{top}/batch={n}" for n in done]) if done else self.spark.createDataFrame([], schema)

    def last_batch(self) -> int:
        """The last batch that counts; -1 before the first."""
        return max(self._batches(self.generation()), default=-1)

    def head(self) -> Row:
        """One row: the epoch, the last position and the digest there."""
        return self._read("heads", HEADS).where(F.col("batch") == self.last_batch()).select("epoch", F.col("last").alias("position"), *L.NAMES).first()

    def index(self) -> DataFrame:
        """(l0..l7, position): the latest position of each digest among the last ``retained`` + 1 positions. Only batches that hold some of them are read."""
        least = self.head()["position"] - self.retained
        batch = self._batch_after(least - 1)
        return self._read("index", INDEX).where((F.col("batch") >= batch) & (F.col("position") >= least)).groupBy(*L.NAMES).agg(F.max("position").alias("position"))

    def _batch_after(self, position: int) -> int:
        """The first batch that ends after a position, or the last one."""
        found = self._read("heads", HEADS).where(F.col("last") > position).agg(F.min("batch")).first()[0]
        return self.last_batch() if found is None else found

    def digest_at(self, position: int) -> Row | None:
        """The digest (l0..l7) at any position of this epoch's log; None if there is no such position. One batch is read at most, up to the position."""
        if not 0 <= position <= self.head()["position"]:
            return None
        batch = self._batch_after(position - 1)
        before = self._read("heads", HEADS).where(F.col("batch") == batch).select("first", *[f"b_{n}" for n in L.NAMES])  # one row
        ops = self._read("ops", OPS).where((F.col("batch") == batch) & (F.col("pos") < position))
        return bags.bag_digest(ops, sign=oplog.sign()).crossJoin(before).select(*L.added("", "b_")).first()

    def resolve(self, epoch: int, position: int, digest: Row) -> int | None:
        """From which position on a replica with this epoch, position and digest (l0..l7) needs the operations; None if that can't be told. An equal digest needs none; then its own position counts, if
        the epochs agree and the digest there is equal; then the latest one of the index."""
        head = self.head()
        if all(head[n] == digest[n] for n in L.NAMES):
            return head["position"]
        if epoch == head["epoch"]:
            own = self.digest_at(position)
            if own is not None and all(own[n] == digest[n] for n in L.NAMES):
                return position
        return self.index().where(same_digest(digest)).agg(F.max("position")).first()[0]

    def tail(self, position: int) -> DataFrame:
        """(pos, is_add, k): the operations from a position on. Batches before it are not read."""
        return self._read("ops", OPS).where((F.col("batch") >= self._batch_after(position)) & (F.col("pos") >= position)).select("pos", "is_add", "k")

    # Writing

    def _begin(self, ops: DataFrame, number: int, epoch: int, base: list[int]) -> None:
        """A new generation that begins with these operations (pos from 0 without gaps)."""
        self._put(ops, self.generation() + 1, number, epoch, 0, base)

    def _put(self, ops: DataFrame, generation: int, number: int, epoch: int, first: int, base: list[int]) -> None:
        """ops: numbered from ``first`` on."""
        top = f"{self.folder}/generation={generation}"
        put = lambda rows, what: rows.write.mode("overwrite").option("compression", COMPRESSION).parquet(f"{top}/{what}/batch={number}")
        put(ops.select("pos", "is_add", "k"), "ops")
        own = self.spark.read.schema("pos long, is_add boolean, k string").parquet(f"{top}/ops/batch={number}")
        before = [F.lit(x).cast("long").alias(f"b_{n}") for n, x in zip(L.NAMES, base, strict=True)]
        head = bags.bag_digest(own, sign=oplog.sign()).select("n", *L.NAMES, *before)
        head = written(head.select((F.col("n") + first).alias("last"), *[f"b_{n}" for n in L.NAMES], *L.added("", "b_")), "head")
        last = head.first()["last"]
        # Going back from the head: the digest at a position lacks the operations from it on. At most ``retained`` rows are sorted.
        late = bags.with_lanes(own.where(F.col("pos") >= max(first, last - self.retained))).withColumn("sign", oplog.sign())
        later = Window.orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, 0)
        less = late.select(F.col("pos").alias("position"), *[F.sum(F.col(n) * F.col("sign")).over(later).alias(f"x_{n}") for n in L.NAMES])
        ends = head.select(*L.NAMES)  # one row
        less = less.crossJoin(F.broadcast(ends)).select("position", *[F.pmod(F.col(n) - F.col(f"x_{n}"), F.lit(m)).alias(n) for n, m in zip(L.NAMES, L.MODULI, strict=True)])
        put(less.unionAll(head.select("last", *L.NAMES)).coalesce(1), "index")
        put(head.select(F.lit(epoch).alias("epoch"), F.lit(first).cast("long").alias("first"), "last", *[f"b_{n}" for n in L.NAMES], *L.NAMES).coalesce(1), "heads")

    def append(self, ops: DataFrame, number: int, epoch: int | None = None) -> bool:
        """Appends operations (pos, is_add, k) in the order of ``pos``, whatever its numbers, as batch ``number``. A batch that counts already is left alone, and then this returns
        False. epoch: the epoch from now on, if it changes."""
        if number <= self.last_batch():
            return False
        head = self.head()
        ranked = bags.ranked(ops.select("pos", "is_add", "k"), ["pos", "k", "is_add"])
        rows = ranked.select((F.col("at") + head["position"]).alias("pos"), "is_add", "k")
        self._put(rows, self.generation(), number, head["epoch"] if epoch is None else epoch, head["position"], [head[n] for n in L.NAMES])
        return True

    def compact(self) -> None:
        """Keeps the last ``retained`` operations, in the next epoch."""
        head = self.head()
        cut = max(0, head["position"] - self.retained)
        base = self.digest_at(cut)
        kept = self.tail(cut).select((F.col("pos") - cut).alias("pos"), "is_add", "k").coalesce(1)  # at most ``retained`` rows
        self._begin(kept, self.last_batch(), head["epoch"] + 1, [base[n] for n in L.NAMES])

    def rebuild(self, members: DataFrame, epoch: int) -> None:
        """The log becomes inserts of all members (k) in key order."""
        self._begin(oplog.rebuilt(members), self.last_batch(), epoch, [0] * 8)

    def vacuum(self) -> int:
        """Deletes older generations, once no query still reads them. Returns how many."""
        gone = [g for g in numbered(self.spark, self.folder, "generation", done=False) if g < self.generation()]
        for g in gone:
            removed(self.spark, f"{self.folder}/generation={g}")
        return len(gone)
