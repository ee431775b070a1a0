"""Operation logs: rows (pos, is_add, k), pos rising. Replay, phantom deletes, tails and compaction."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.functions import lanes as L
from tallyfold.operators.bags import bag_digest, ranked, running_digest
from tallyfold.plans import sieve
from tallyfold.plans.recovery import written

# Fixed value.
#: How many operations a compacted log keeps; one position more is addressable.
RETAINED = 1024


def sign():
    return F.when(F.col("is_add"), 1).otherwise(-1)


def effective_operations(log: DataFrame) -> DataFrame:
    """The log without deletes of keys that aren't there at that time: per key, a running count reflected at zero.

    A key with any share of the log is walked by many tasks: the log is dealt by ranges of (k, pos), each part is walked by itself, and of the few keys that lie in several parts, at most one on each
    border, a part's sum and least running sum say where the next part begins. Only keys with deletes are walked: the inserts of any other stay as they are, and a
    bitmap (``plans/sieve.py``) tells nearly all of them apart before the shuffle."""
    rows, k = log.select("pos", "is_add", "k"), [F.col("k")]
    log, never = sieve.split(rows, k, rows.where(~F.col("is_add")).select("k"), k, always=~F.coalesce(F.col("is_add"), F.lit(False)))
    dealt = log.repartitionByRange("k", "pos").withColumn("part", F.spark_partition_id())
    dealt = written(dealt.withColumn("sign", sign()), "ranges")
    ends = dealt.groupBy("part").agg(F.min("k").alias("least"), F.max("k").alias("most"))  # one row a part
    edges = ends.select(F.explode(F.array_distinct(F.array("least", "most"))).alias("k")).groupBy("k").count().where("count > 1").select("k")
    local = Window.partitionBy("part", "k").orderBy("pos")
    walk = dealt.withColumn("s", F.sum("sign").over(local.rowsBetween(Window.unboundedPreceding, 0)))
    chunks = walk.join(F.broadcast(edges), "k", "left_semi").groupBy("part", "k").agg(F.sum("sign").alias("total"), F.min("s").alias("low"))  # two rows a part at most
    earlier = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begun = chunks.withColumn("begin", F.coalesce(F.sum("total").over(earlier), F.lit(0)))
    begun = begun.withColumn("least", F.coalesce(F.min(F.col("begin") + F.col("low")).over(earlier), F.lit(0)))
    begun = begun.select(F.col("part").alias("part2"), F.col("k").alias("k2"), "begin", "least")
    least = F.min("s").over(local.rowsBetween(Window.unboundedPreceding, -1))
    rows = walk.withColumn("low", least).join(F.broadcast(begun), (F.col("part") == F.col("part2")) & (F.col("k") == F.col("k2")), "left")
    zero = F.lit(0)
    begin = F.coalesce("begin", zero)
    held = begin + F.col("s") - F.col("sign") - F.least(zero, F.coalesce("least", zero), begin + F.coalesce("low", zero))
    return rows.where(F.col("is_add") | (held > 0)).select("pos", "is_add", "k").unionAll(never)


def last_operation_set(log: DataFrame) -> DataFrame:
    """Keys whose last operation is an insert."""
    rows = log.select(L.packed(F.col("k")).alias("k"), "is_add", "pos")
    return rows.groupBy("k").agg(F.max_by("is_add", "pos").alias("there")).where("there").select(L.unpacked(F.col("k")).alias("k"))


def apply_tail(members: DataFrame, tail: DataFrame) -> DataFrame:
    """The set after a tail: the last operation of a key decides; a key that the tail doesn't touch stays."""
    last, k = tail.groupBy("k").agg(F.max_by("is_add", "pos").alias("is_add")), [F.col("k")]
    some, never = sieve.split(members.select("k"), k, last, k)
    return never.unionAll(some.join(last, "k", "left_anti").select("k")).unionAll(last.where("is_add").select("k"))


def bulk_delete(members: DataFrame, keys: DataFrame) -> DataFrame:
    """Log entries of deleting present keys: distinct, in key order, ``at`` from 0."""
    gone = keys.select("k").distinct().join(members, "k", "left_semi")
    return ranked(gone, ["k"])


def positions(log: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """(position, l0..l7): the digest after each number of operations, position 0 being left out. base: one row l0..l7, the digest before the first operation."""
    at = running_digest(log, "pos", sign()).withColumn("position", F.col("pos") + 1)
    if base is None:
        return at
    more = base.select(*[F.col(n).alias(f"b_{n}") for n in L.NAMES])
    return at.crossJoin(F.broadcast(more)).withColumns(dict(zip(L.NAMES, L.added("", "b_"), strict=True))).drop(*[f"b_{n}" for n in L.NAMES])


def digest_index(log: DataFrame, retained: int = RETAINED, base: DataFrame | None = None) -> DataFrame:
    """(digest lanes, position): latest position of each digest among the last ``retained`` operations."""
    return recent(log, retained, base).groupBy(*L.NAMES).agg(F.max("position").alias("position"))


def recent(log: DataFrame, retained: int = RETAINED, base: DataFrame | None = None, also: DataFrame | None = None) -> DataFrame:
    """(position, l0..l7): those of :func:`positions` from ``retained`` before the last one on, the last one itself included, and the one that ``also`` (one row, ``asked``) names, if the log has it. What comes before is
    folded, so nothing but the operations after it is sorted."""
    last = log.agg(F.coalesce(F.max("pos") + 1, F.lit(0)).alias("last"))
    ends = last.select("last", F.greatest(F.col("last") - max(retained, 1), F.lit(0)).alias("cut"))
    ends = written(ends.withColumn("asked", F.lit(0).cast("long")) if also is None else ends.crossJoin(F.broadcast(also.select("asked"))), "ends")  # one row
    rows = log.select("pos", "is_add", "k").crossJoin(F.broadcast(ends))
    zero = [F.lit(0).cast("long").alias(f"b_{n}") for n in L.NAMES]
    more = ends.select("asked", "cut", "last", *zero) if base is None else ends.crossJoin(base.select(*[F.col(n).alias(f"b_{n}") for n in L.NAMES]))

    def at(which: str) -> DataFrame:
        """The digest at a position of ``ends``."""
        own = bag_digest(rows.where(F.col("pos") < F.col(which)), sign=sign()).crossJoin(more)
        return own.where((F.col(which) > 0) & (F.col(which) <= F.col("last"))).select(F.col(which).cast("long").alias("position"), *L.added("", "b_"))

    before = written(bag_digest(rows.where("pos < cut"), sign=sign()).crossJoin(more).select("cut", *L.added("", "b_")), "before")  # one row
    late = positions(rows.where("pos >= cut").select("pos", "is_add", "k"), before).select("position", *L.NAMES)
    found = late if retained < 1 else late.unionAll(before.where("cut > 0").select(F.col("cut").cast("long").alias("position"), *L.NAMES))
    return found if also is None else found.unionAll(at("asked"))


@dataclass(frozen=True)
class Node:
    """One side of a synchronisation: a log (pos from 0 without gaps, is_add, k) of a set ``members`` (k) of unique keys, the digest before
    its first operation (one row l0..l7; none is the empty one), and how often it was compacted."""

    log: DataFrame
    members: DataFrame
    base: DataFrame | None = None
    epoch: int = 0


def node(log: DataFrame, epoch: int = 0) -> Node:
    """A node from its log alone: deletes of absent keys are left out and positions counted anew."""
    log = written(log.select("pos", "is_add", "k"), "log")  # read several times, and may be costly to make
    kept = ranked(effective_operations(log), ["pos"]).select(F.col("at").alias("pos"), "is_add", "k")
    return Node(kept, last_operation_set(log), None, epoch)


def compact(n: Node, retained: int = RETAINED) -> Node:
    """The node with the last ``retained`` operations alone, positions counted from 0 anew, the digest before them carried as base, in the next epoch."""
    cut = n.log.agg(F.greatest(F.max("pos") + 1 - retained, F.lit(0)).alias("cut"))  # one row
    rows = n.log.crossJoin(F.broadcast(cut))
    gone = bag_digest(rows.where("pos < cut"), sign=sign())
    if n.base is not None:
        gone = gone.crossJoin(n.base.select(*[F.col(x).alias(f"b_{x}") for x in L.NAMES])).select(*L.added("", "b_"))
    log = rows.where("pos >= cut").select((F.col("pos") - F.col("cut")).alias("pos"), "is_add", "k")
    return Node(log, n.members, gone.select(*L.NAMES), n.epoch + 1)


def tail(log: DataFrame, position: int) -> DataFrame:
    """Operations from a position on."""
    return log.where(F.col("pos") >= position)


def compacted(log: DataFrame, retained: int = RETAINED) -> DataFrame:
    """The last ``retained`` operations."""
    last = log.agg((F.max("pos") - retained).alias("cut"))
    return log.join(F.broadcast(last)).where(F.col("pos") > F.col("cut")).select("pos", "is_add", "k")  # one row


def rebuilt(members: DataFrame) -> DataFrame:
    """A log of inserts of all members in key order."""
    return ranked(members.select("k"), ["k"]).select(F.col("at").alias("pos"), F.lit(True).alias("is_add"), "k")
