"""A stored set of keys that follows batches of changes, with the digests of its key prefixes.

Keys lie in Parquet folders by ``bucket``, their first ``bits`` bits, sorted inside. A batch is written beside what is there, as the changes that have an effect (an insert of an absent key, a
removal of a present one); readers merge. It also adds, at each of ``levels``, one signed row for each prefix that it touches, as digests can be subtracted: so the summaries of all
levels follow without a look at other keys. What a batch writes is in proportion to it, and what it reads are the buckets that it touches. Compaction rewrites only buckets whose changes
have grown to a share of their keys.

    keys/base/upto=U/bucket=B     k: the bucket after all batches up to U
    keys/delta/batch=N/bucket=B   k, is_add
    sums/base/upto=U/bucket=B     depth, pfx, n, l0..l7: count and digest of the keys under a prefix of ``depth`` bits
    sums/delta/batch=N/bucket=B   the same, signed
    rewritten/upto=U              bucket: which buckets the base U has, also those that are empty now

A bucket's base is the newest one that has it, and later batches apply to it. The summaries of a batch or a base are written last, and only once they are there does
either count: what a lost driver has left unfinished is not read, and a batch that runs again is written again, or left alone if it counts already. There is one writer at a time.

Keys are 64 hex digits (other lengths are an error); a null key is an error too. In one batch the last change of a key by ``pos`` decides; changes of equal ``pos`` count as a removal if any is one. The
driver holds bucket numbers (at most 2^bits) and batch numbers since the last compaction, nothing that grows with the keys.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.functions import lanes as L
from tallyfold.operators import trie
from tallyfold.operators.bags import with_lanes
from tallyfold.plans.recovery import COMPRESSION, numbered, removed, written

LANES = ", ".join(f"{n} long" for n in L.NAMES)
SCHEMAS = {"keys/base": "k string, upto int, bucket int", "keys/delta": "k string, is_add boolean, batch int, bucket int"}
SCHEMAS |= {f"sums/{kind}": f"depth int, pfx long, n long, {LANES}, {at} int, bucket int" for kind, at in (("base", "upto"), ("delta", "batch"))}
#: The deepest bucket, in bits.
MOST_BITS = 12


@dataclass(frozen=True)
class State:
    """Which files count: for each base the buckets that it is the newest one of, and the batches after any of them."""

    buckets: dict[int, list[int]]
    batches: list[int]


@dataclass(frozen=True)
class KeyStore:
    spark: SparkSession
    folder: str
    bits: int
    levels: tuple[int, ...]

    @classmethod
    def create(cls, keys: DataFrame, folder: str, bits: int = 8, levels: tuple[int, ...] = (8, 12, 16, 20)) -> KeyStore:
        """A new store of the distinct keys of ``keys`` (k). levels: rising depths, the first of which is ``bits``."""
        if not 1 <= bits <= MOST_BITS or levels[0] != bits or list(levels) != sorted(set(levels)) or levels[-1] > trie.DEEPEST:
            raise ValueError("bits are from 1 to 12, and levels rise from them to 64 at most")
        store = cls(keys.sparkSession, folder.rstrip("/"), bits, tuple(levels))
        store.spark.createDataFrame([(bits, list(levels))], "bits int, levels array<int>").coalesce(1).write.mode("overwrite").parquet(f"{store.folder}/settings")
        store._rewrite(store._dealt(keys.select("k").distinct()), None, -1, range(1 << bits))
        return store

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> KeyStore:
        row = spark.read.parquet(f"{folder.rstrip('/')}/settings").first()
        return cls(spark, folder.rstrip("/"), row["bits"], tuple(row["levels"]))

    # Reading

    def state(self) -> State:
        current: dict[int, int] = {}
        for upto in numbered(self.spark, f"{self.folder}/sums/base", "upto"):
            rows = self.spark.read.schema("bucket int").parquet(f"{self.folder}/rewritten/upto={upto}").collect()  # 2^bits at most
            current |= {r["bucket"]: upto for r in rows}
        buckets: dict[int, list[int]] = {}
        for bucket, upto in sorted(current.items()):
            buckets.setdefault(upto, []).append(bucket)
        oldest = min(buckets, default=-1)
        return State(buckets, [n for n in numbered(self.spark, f"{self.folder}/sums/delta", "batch") if n > oldest])

    def last(self) -> int:
        """The last batch that counts; -1 before the first."""
        return max([-1, *numbered(self.spark, f"{self.folder}/sums/delta", "batch"), *numbered(self.spark, f"{self.folder}/sums/base", "upto")])

    def _parts(self, what: str, state: State, buckets: list[int] | None) -> tuple[DataFrame, DataFrame]:
        """(base, delta) of ``what``, keys or sums, in these buckets. The conditions concern partition columns alone, so files of others are not even opened."""
        own = {u: sorted(set(b) if buckets is None else set(b) & set(buckets)) for u, b in state.buckets.items()}
        own = {u: b for u, b in own.items() if b}

        def read(kind: str, name: str, numbers: list[int], holds: Callable[[int], Column]) -> DataFrame:
            schema = SCHEMAS[f"{what}/{kind}"]
            if not own or not numbers:
                return self.spark.createDataFrame([], schema)
            top = f"{self.folder}/{what}/{kind}"
            rows = self.spark.read.option("basePath", top).schema(schema).parquet(*[f"{top}/{name}={n}" for n in numbers])
            return rows.where(reduce(Column.__or__, [holds(u) & F.col("bucket").isin(b) for u, b in own.items()]))

        base = read("base", "upto", list(own), lambda u: F.col("upto") == u)
        return base, read("delta", "batch", [n for n in state.batches if n > min(own, default=0)], lambda u: F.col("batch") > u)

    def members(self, buckets: list[int] | None = None, among: DataFrame | None = None) -> DataFrame:
        """(k), of some buckets only if they are given, and only those in ``among`` (k, all different) if that is given: others are left out before a shuffle."""
        base, delta = self._parts("keys", self.state(), buckets)
        if among is not None:
            if not base.inputFiles() and not delta.inputFiles():
                return base.select("k").limit(0)
            base, delta = (rows.join(among.select("k"), "k", "left_semi") for rows in (base, delta))
        # Changes that had an effect alternate, so a key's sum says what has become of it.
        net = delta.groupBy("k").agg(F.sum(F.when(F.col("is_add"), 1).otherwise(-1)).alias("n"))
        return base.select("k").join(net.where("n < 0").select("k"), "k", "left_anti").unionAll(net.where("n > 0").select("k"))

    def _sums(self, buckets: list[int] | None, depth: int | None) -> DataFrame:
        """(bucket, depth, pfx, n, l0..): base and changes added up."""
        parts = self._parts("sums", self.state(), buckets)
        rows = parts[0].drop("upto").unionByName(parts[1].drop("batch"))
        rows = rows if depth is None else rows.where(F.col("depth") == depth)
        return rows.groupBy("bucket", "depth", "pfx").agg(F.sum("n").alias("n"), *L.total()).where(F.col("n") != 0)

    def summary(self, depth: int, buckets: list[int] | None = None) -> DataFrame:
        """(pfx, n, l0..l7) of each prefix of one of the store's levels that has keys."""
        if depth not in self.levels:
            raise ValueError(f"there are summaries at the depths {self.levels}")
        return self._sums(buckets, depth).select("pfx", "n", *L.NAMES)

    def total(self) -> DataFrame:
        """One row (n, l0..l7): the whole set's count and digest, from the first level's rows alone."""
        return self.summary(self.bits).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *L.total())

    def touched(self, keys: DataFrame) -> list[int]:
        """The buckets of some keys (k), 2^bits at most."""
        return sorted(r["bucket"] for r in keys.select(self._bucket()).distinct().collect())

    # Writing

    def _bucket(self) -> Column:
        return trie.prefix(F.col("k"), self.bits).cast("int").alias("bucket")

    def _dealt(self, keys: DataFrame) -> DataFrame:
        whole = F.when(F.length("k") == 64, F.col("k")).otherwise(F.raise_error(F.lit("a key has 32 bytes")))
        return keys.withColumn("k", whole).withColumn("bucket", self._bucket())

    def _put(self, rows: DataFrame, path: str, order: str, large: bool = False) -> None:
        """large: a bucket may be more than a task should write."""
        if large:
            dealt = rows.repartitionByRange("bucket", order).sortWithinPartitions("bucket", order)
        elif order == "k":  # keys go as bytes
            dealt = rows.withColumn("k", L.packed(F.col("k"))).repartition("bucket").withColumn("k", L.unpacked(F.col("k"))).sortWithinPartitions("bucket", order)
        else:
            dealt = rows.repartition("bucket").sortWithinPartitions("bucket", order)
        dealt.write.mode("overwrite").option("compression", COMPRESSION).partitionBy("bucket").parquet(f"{self.folder}/{path}")

    def _summed(self, keys: DataFrame, sign: Column) -> DataFrame:
        """(bucket, depth, pfx, n, l0..) at all levels, of keys (k, bucket, ..): those of the deepest prefixes first, the others from them."""
        deep = self.levels[-1]
        rows = with_lanes(keys.withColumn("pfx", trie.prefix(F.col("k"), deep)))
        least = rows.groupBy("bucket", "pfx").agg(F.sum(sign).cast("long").alias("n"), *L.total(sign))
        each = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), F.shiftrightunsigned("pfx", deep - d).alias("pfx")) for d in self.levels]))
        up = least.select("bucket", each.alias("at"), "n", *L.NAMES).select("bucket", "at.depth", "at.pfx", "n", *L.NAMES)
        return up.groupBy("bucket", "depth", "pfx").agg(F.sum("n").alias("n"), *L.total())

    def _rewrite(self, keys: DataFrame, sums: DataFrame | None, upto: int, buckets) -> None:
        self._put(keys, f"keys/base/upto={upto}", "k", large=True)
        self.spark.createDataFrame([(b,) for b in buckets], "bucket int").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/rewritten/upto={upto}")
        if sums is None:
            own = self.spark.read.option("basePath", f"{self.folder}/keys/base").schema(SCHEMAS["keys/base"]).parquet(f"{self.folder}/keys/base/upto={upto}")
            sums = self._summed(own.select("k", "bucket"), F.lit(1))
        self._put(sums, f"sums/base/upto={upto}", "depth")

    def apply(self, changes: DataFrame, number: int) -> bool:
        """Applies a batch (pos, is_add, k). Batches are numbered upwards, with gaps if need be; one that counts already is left alone, and then this returns False."""
        if number <= self.last():
            return False
        top = f"{self.folder}/keys/delta/batch={number}"
        rows = changes.select(L.packed(F.col("k")).alias("k"), "pos", "is_add")
        final = rows.groupBy("k").agg(F.min_by("is_add", F.struct(-F.col("pos"), F.col("is_add"))).alias("is_add")).select(L.unpacked(F.col("k")).alias("k"), "is_add")
        final = written(self._dealt(final), "changes")
        # Written, so that Spark knows how few they are, if they are few, and need not shuffle the changes.
        held = written(self.members(self.touched(final), among=final).withColumn("present", F.lit(True)), "held")
        effective = final.join(held, "k", "left").where(F.col("is_add") != F.coalesce("present", F.lit(False))).select("k", "is_add", "bucket")
        self._put(effective, f"keys/delta/batch={number}", "k")
        own = self.spark.read.option("basePath", f"{self.folder}/keys/delta").schema(SCHEMAS["keys/delta"]).parquet(top)
        self._put(self._summed(own.select("k", "is_add", "bucket"), F.when(F.col("is_add"), 1).otherwise(-1)), f"sums/delta/batch={number}", "depth")
        return True

    def compact(self, share: float = 0.1) -> list[int]:
        """Rewrites the buckets whose changes since their base are at least this share of the base's keys; returns their numbers. No more than one compaction follows a batch."""
        last, state = self.last(), self.state()
        if last in numbered(self.spark, f"{self.folder}/sums/base", "upto"):
            return []
        base, delta = self._parts("sums", state, None)
        size = base.where(F.col("depth") == self.bits).select(F.col("bucket").alias("b2"), F.col("n").alias("keys"))
        changed = self._parts("keys", state, None)[1].groupBy("bucket").count()
        rows = changed.join(size, F.col("bucket") == F.col("b2"), "left").where(F.col("count") >= share * F.coalesce("keys", F.lit(0)))
        buckets = sorted(r["bucket"] for r in rows.select("bucket").collect())  # 2^bits at most
        if buckets:
            self._rewrite(self._dealt(self.members(buckets)), self._sums(buckets, None), last, buckets)
        return buckets

    def vacuum(self) -> int:
        """Deletes what no reader needs any more, once no query still reads it: buckets of older bases, and batches that all their buckets' bases have. Returns how many folders."""
        state, gone = self.state(), []
        newest = {b: u for u, own in state.buckets.items() for b in own}
        for upto in numbered(self.spark, f"{self.folder}/sums/base", "upto"):
            gone += [f"{what}/base/upto={upto}/bucket={b}" for what in ("sums", "keys") for b in numbered(self.spark, f"{self.folder}/{what}/base/upto={upto}", "bucket", done=False) if newest.get(b) != upto]
        for n in numbered(self.spark, f"{self.folder}/sums/delta", "batch"):
            if all(newest.get(b, -1) >= n for b in numbered(self.spark, f"{self.folder}/keys/delta/batch={n}", "bucket", done=False)) and n < self.last():
                gone += [f"{what}/delta/batch={n}" for what in ("sums", "keys")]
        for path in gone:
            removed(self.spark, f"{self.folder}/{path}")
        return len(gone)


def difference(primary: KeyStore, replica: KeyStore) -> DataFrame:
    """(op, k): keys to add to and to remove from the replica. Level by level, summaries under prefixes that differ so far are compared, and of the keys only those under
    the deepest ones that differ are read, in the buckets that differ."""
    if (primary.bits, primary.levels) != (replica.bits, replica.levels):
        raise ValueError("both stores need the same bits and levels")
    none = primary.spark.createDataFrame([], "op string, k string")
    open_, buckets, above = None, None, 0
    for depth in primary.levels:
        rows = trie.differing(trie.aligned(primary.summary(depth, buckets), replica.summary(depth, buckets)))
        if open_ is not None:
            rows = rows.withColumn("parent", F.shiftrightunsigned("pfx", depth - above)).join(open_.select(F.col("pfx").alias("parent")), "parent", "left_semi")
        open_, above = written(rows.select("pfx"), "open"), depth
        if buckets is None:
            buckets = sorted(int(r["pfx"]) for r in open_.collect())  # 2^bits at most
            if not buckets:
                return none
    under = lambda s: s.members(buckets).withColumn("pfx", trie.prefix(F.col("k"), above)).join(open_, "pfx", "left_semi")
    return trie.changes_between(under(primary), under(replica))
