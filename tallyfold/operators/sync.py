"""Synchronisation of a replica with a primary: by the tail of the log that it lacks, or else by comparing prefixes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.functions import lanes as L
from tallyfold.functions import wire
from tallyfold.operators import oplog, trie
from tallyfold.operators.bags import bag_digest
from tallyfold.plans.recovery import written
from tallyfold.sources.keystore import KeyStore, difference
from tallyfold.sources.logstore import LogStore

# Fixed value.
ROUND_TRIP_MS = 50


def first_answer(*, primary: DataFrame, replica: DataFrame, primary_epoch: int = 0, replica_epoch: int = 0, retained: int = oplog.RETAINED) -> DataFrame:
    """One row for two logs (pos from 0 without gaps, is_add, k): start (the tail's first position; null if the replica must fall back),
    used_fallback, items_added, items_deleted, bytes_sent, bytes_received, round_trips and latency_ms.

    An equal digest needs no operations; then the replica's own position counts, if the epochs agree and the digest there is equal; then the
    latest of the last ``retained`` positions with that digest. Counted are operations, not keys. Empty logs have position 0 and the empty digest."""
    asked = replica.select("is_add", *L.lanes(F.col("k"))).agg(F.count("*").alias("asked"), *[c.alias(f"r_{n}") for c, n in zip(L.total(oplog.sign()), L.NAMES, strict=True)])
    found = resolved(oplog.recent(primary, retained, also=asked), _zero(primary), asked, primary_epoch == replica_epoch, retained)
    counted = primary.crossJoin(F.broadcast(found)).where("pos >= start").agg(F.count_if("is_add").alias("adds"), F.count_if(~F.col("is_add")).alias("deletes"))
    root = oplog.effective_operations(primary).agg(F.coalesce(F.sum(oplog.sign()), F.lit(0)).alias("held"))
    epoch, n = F.lit(primary_epoch), F.col("adds") + F.col("deletes")
    received = F.when(F.col("start").isNull(), wire.fallback_bytes(epoch, F.col("held"))).otherwise(wire.tail_bytes(epoch, n)).cast("long")
    return found.crossJoin(counted).crossJoin(root).select(  # one row each
        "start", F.col("start").isNull().alias("used_fallback"), F.col("adds").alias("items_added"), F.col("deletes").alias("items_deleted"),
        wire.request_bytes(F.lit(replica_epoch), F.col("asked")).cast("long").alias("bytes_sent"), received.alias("bytes_received"),
        F.lit(1).alias("round_trips"), F.lit(ROUND_TRIP_MS).alias("latency_ms"),
    )


def _zero(like: DataFrame) -> DataFrame:
    return like.sparkSession.range(1).select(*[F.lit(0).cast("long").alias(n) for n in L.NAMES])


def resolved(positions: DataFrame, base: DataFrame, asked: DataFrame, same_epoch: bool, retained: int) -> DataFrame:
    """One row (asked, start): from which of the primary's ``positions`` (position, l0.., of :func:`oplog.recent`) on a replica needs the operations; null if none fits. base: the digest at position 0; asked: one row, the
    replica's position and digest (asked, r_l0..)."""
    at = positions.select("position", *L.NAMES).unionAll(base.select(F.lit(0).cast("long").alias("position"), *L.NAMES))
    same = F.lit(True)
    for n in L.NAMES:
        same = same & (F.col(n) == F.col(f"r_{n}"))
    known = at.crossJoin(F.broadcast(asked)).select("position", "asked", same.alias("same"))
    found = known.agg(
        F.max("position").alias("last"), F.max("asked").alias("asked"), F.max_by("same", "position").alias("current"),
        F.bool_or(F.col("same") & (F.col("position") == F.col("asked"))).alias("own"), F.max(F.when(F.col("same"), F.col("position"))).alias("latest"),
    )
    start = (
        F.when(F.col("current"), F.col("last")).when(F.col("own") & F.lit(same_epoch), F.col("asked"))
        .when(F.col("latest") >= F.col("last") - retained, F.col("latest"))
    )
    return found.select("asked", start.alias("start"))


@dataclass(frozen=True)
class Synced:
    """The replica after a synchronisation, and what that took."""

    replica: oplog.Node
    used_fallback: bool
    round_trips: int
    bytes_sent: int
    bytes_received: int
    items_added: int
    items_deleted: int

    @property
    def latency_ms(self) -> int:
        return self.round_trips * ROUND_TRIP_MS


def synchronise(*, primary: oplog.Node, replica: oplog.Node, force_prefixes: bool = False, bits: int = 2, retained: int = oplog.RETAINED) -> Synced:
    """The whole synchronisation: the replica says its epoch, position and digest, and gets the operations that it lacks, which are applied and appended to its log; or, if the primary
    can't tell from where on (or ``force_prefixes``), both sets are compared by prefixes, ``bits`` a level, and the replica's log is built anew. It takes the primary's epoch either way.
    Operations are counted on the first way, keys on the second. What reaches the driver is a few counts."""
    held = bag_digest(replica.members).select(*[F.col(n).alias(f"r_{n}") for n in L.NAMES])
    asked = written(held.crossJoin(replica.log.agg(F.count("*").alias("asked"))), "asked")  # one row
    base = primary.base if primary.base is not None else _zero(primary.log)
    row = resolved(oplog.recent(primary.log, retained, primary.base, asked), base, asked, primary.epoch == replica.epoch, retained).first()
    start = None if force_prefixes else row["start"]
    size = lambda c: primary.log.sparkSession.range(1).select(c.cast("long")).first()[0]
    sent = size(wire.request_bytes(F.lit(replica.epoch), F.lit(row["asked"])))
    if start is not None:
        tail = written(oplog.tail(primary.log, start), "tail")
        counts = tail.agg(F.count_if("is_add").alias("adds"), F.count_if(~F.col("is_add")).alias("deletes")).first()
        received = size(wire.tail_bytes(F.lit(primary.epoch), F.lit(counts["adds"] + counts["deletes"])))
        members = written(oplog.apply_tail(replica.members, tail), "members")
        log = replica.log.select("pos", "is_add", "k").unionAll(tail.select((F.col("pos") - start + row["asked"]).alias("pos"), "is_add", "k"))
        return Synced(oplog.Node(log, members, replica.base, primary.epoch), False, 1, sent, received, counts["adds"], counts["deletes"])
    received = size(wire.fallback_bytes(F.lit(primary.epoch), F.lit(primary.members.count())))
    done = trie.reconcile(primary.members, replica.members, bits)
    members = written(trie.applied(replica.members, done.changes), "members")
    return Synced(oplog.Node(oplog.rebuilt(members), members, None, primary.epoch), True, 1 + done.round_trips, sent + done.bytes_sent, received + done.bytes_received, done.items_added, done.items_deleted)


@dataclass(frozen=True)
class StoredNode:
    """One side of a synchronisation whose log and set are stored and kept up by batches."""

    log: LogStore
    keys: KeyStore


@dataclass(frozen=True)
class Caught:
    """How a stored replica caught up, and with how many operations (by the tail) or keys (by prefixes)."""

    used_fallback: bool
    items_added: int
    items_deleted: int


def synchronise_stored(*, primary: StoredNode, replica: StoredNode, force_prefixes: bool = False) -> Caught:
    """Like :func:`synchronise` of stored nodes, in place: the replica's head row is resolved by the primary's index, and only batches of the tail are read and appended to the replica as one
    batch; or else the stored summaries are compared, and the keys under prefixes that differ, and the replica's log is built anew."""
    asked, epoch = replica.log.head(), primary.log.head()["epoch"]
    start = None if force_prefixes else primary.log.resolve(asked["epoch"], asked["position"], asked)
    number = max(replica.log.last_batch(), replica.keys.last()) + 1
    if start is not None:
        ops = written(primary.log.tail(start), "tail")
    else:
        ops = written(difference(primary.keys, replica.keys).select(F.lit(0).cast("long").alias("pos"), (F.col("op") == "add").alias("is_add"), "k"), "changes")
    counts = ops.agg(F.count_if("is_add").alias("adds"), F.count_if(~F.col("is_add")).alias("deletes")).first()
    replica.keys.apply(ops, number)
    if start is not None:
        replica.log.append(ops, number, epoch)
    else:
        replica.log.rebuild(replica.keys.members(), epoch)
    return Caught(start is None, counts["adds"], counts["deletes"])
