"""Stored sets and logs that follow batches, and the stateful stream in front of them, against the operators over whole tables."""

import hashlib
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfold.functions import lanes as L
from tallyfold.operators import bags, oplog, trie
from tallyfold.plans.recovery import removed
from tallyfold.sources.keystore import KeyStore, difference
from tallyfold.sources.logstore import LogStore
from tallyfold.streaming import node

OPS = "pos long, is_add boolean, k string"
DRAW = random.Random(7)


def key(n) -> str:
    return hashlib.sha256(str(n).encode()).hexdigest()


def keys_of(spark, keys):
    return spark.createDataFrame([(k,) for k in keys], "k string")


def ops_of(spark, ops):
    return spark.createDataFrame(ops, OPS)


def rows(df):
    return sorted(map(tuple, df.collect()))


def size(folder):
    return sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet"))


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    """Two stores of the same 4,000 keys."""
    top = str(tmp_path_factory.mktemp("stores"))
    keys = [key(i) for i in range(4000)]
    return top, keys, [KeyStore.create(keys_of(spark, [*keys, keys[0]]), f"{top}/{n}", 4, (4, 8, 11)) for n in "pr"]


def test_a_set_follows_batches(spark, base):
    top, keys, (store, other) = base
    have, pos, whole = set(keys), 0, size(f"{top}/p/keys/base")
    for n in range(3):
        ops = []
        for _ in range(DRAW.randrange(20, 60)):
            ops.append((pos, DRAW.random() < 0.5, key(DRAW.randrange(4600))))
            pos += 1
        ops += [(pos, True, ops[0][2]), (pos + 1, False, ops[0][2])]
        pos += 2
        assert store.apply(ops_of(spark, ops), n)
        for _, add, k in ops:
            (have.add if add else have.discard)(k)
        assert not store.apply(ops_of(spark, [(0, True, key(10**6 + n))]), n)  # it counts already
        assert [r.k for r in store.members().orderBy("k").collect()] == sorted(have)
        # What a batch writes is in proportion to it: a small share of the set.
        assert size(f"{top}/p/keys/delta/batch={n}") < max(whole / 5, 60_000)
        want = keys_of(spark, sorted(have))
        for depth in (4, 11):
            assert rows(store.summary(depth)) == rows(trie.level(want, depth))
        assert rows(store.total()) == rows(bags.bag_digest(want))
        found = rows(difference(store, other))
        assert found == sorted([("add", k) for k in have - set(keys)] + [("remove", k) for k in set(keys) - have])
        if n == 0:
            assert store.compact(1.0) == []
        if n == 1:
            assert store.compact(0.0) and not store.compact(0.0) and store.vacuum()
    assert rows(KeyStore.open(spark, f"{top}/p").members()) == rows(store.members())


def test_an_unfinished_batch_does_not_count(spark, base, tmp_path):
    store = KeyStore.create(keys_of(spark, [key(i) for i in range(100)]), str(tmp_path), 2, (2, 5))
    ops = [(0, True, key(200)), (1, False, key(3)), (2, False, key(999)), (3, True, key(4))]
    assert store.apply(ops_of(spark, ops), 0)
    want = rows(store.members())
    # The driver was lost after the keys were written and before the summaries were.
    removed(spark, f"{tmp_path}/sums/delta/batch=0/_SUCCESS")
    assert store.last() == -1 and store.members().count() == 100
    assert store.apply(ops_of(spark, ops), 0) and rows(store.members()) == want and len(want) == 100
    assert store.apply(ops_of(spark, []), 1) and rows(store.members()) == want
    # Likewise for a compaction.
    assert store.apply(ops_of(spark, [(9, True, key(201))]), 5) and store.compact(0.0)
    removed(spark, f"{tmp_path}/sums/base/upto=5/_SUCCESS")
    assert store.members().count() == 101
    assert store.compact(0.0) and store.members().count() == 101 and rows(store.summary(5)) == rows(trie.level(store.members(), 5))


def test_only_open_buckets_are_read(spark, tmp_path):
    keys = [key(i) for i in range(1000)]
    a, b = (KeyStore.create(keys_of(spark, keys), f"{tmp_path}/{n}", 4, (4, 8)) for n in "ab")
    some = [k for k in keys if k[0] == "7"][:3]
    a.apply(ops_of(spark, [(i, False, k) for i, k in enumerate(some)]), 0)
    found = difference(a, b)
    plan = found._jdf.queryExecution().executedPlan().toString()
    scans = [line.partition("PartitionFilters: ")[2] for line in plan.splitlines() if "FileScan parquet [k#" in line]
    assert len(scans) >= 3 and all(re.search(r"\(bucket#\d+ = 7\)", line) for line in scans), scans
    assert rows(found) == sorted(("remove", k) for k in some)
    # Buckets that aren't touched are not rewritten.
    before = {f: os.path.getmtime(f) for d, _, names in os.walk(f"{tmp_path}/a/keys/base/upto=-1") for f in [f"{d}/{n}" for n in names]}
    assert a.compact(0.0) == [7] and os.listdir(f"{tmp_path}/a/keys/base/upto=0") and {d for d in os.listdir(f"{tmp_path}/a/keys/base/upto=0") if d.startswith("bucket")} == {"bucket=7"}
    assert before == {f: os.path.getmtime(f) for f in before} and a.members().count() == 997


def test_odd_sets(spark, tmp_path):
    none = KeyStore.create(keys_of(spark, []), f"{tmp_path}/n", 1, (1,))
    assert none.members().count() == 0 and rows(none.total()) == [(0,) * 9]
    one = KeyStore.create(keys_of(spark, [key(1)]), f"{tmp_path}/o", 1, (1,))
    assert rows(difference(one, none)) == [("add", key(1))] and rows(difference(none, one)) == [("remove", key(1))] and rows(difference(one, one)) == []
    one.apply(ops_of(spark, [(0, False, key(1))]), 7)
    one.compact(0.0)
    assert one.members().count() == 0 and one.summary(1).count() == 0 and rows(difference(one, none)) == []
    for bad in ("ab", None):
        with pytest.raises(Exception, match="32 bytes"):
            none.apply(ops_of(spark, [(0, True, bad)]), 9)
    with pytest.raises(ValueError):
        KeyStore.create(keys_of(spark, []), f"{tmp_path}/x", 4, (5, 8))
    with pytest.raises(ValueError):
        none.summary(3)


def plain_log(ops, base=(0,) * 8):
    """The digest at each position."""
    out = [tuple(base)]
    for add, k in ops:
        lanes = [int.from_bytes(bytes.fromhex(k)[4 * i : 4 * i + 4], "little") % m for i, m in enumerate(L.MODULI)]
        out.append(tuple((x + (1 if add else -1) * y) % m for x, y, m in zip(out[-1], lanes, L.MODULI, strict=True)))
    return out


def as_row(digest):
    return dict(zip(L.NAMES, digest, strict=True))


def test_a_log_with_its_index(spark, tmp_path):
    log = LogStore.create(spark, str(tmp_path), retained=20)
    ops, n = [], 0
    for count in (1, 50, 0, 4):
        batch = [(DRAW.random() < 0.6, key(DRAW.randrange(12))) for _ in range(count)]
        assert log.append(ops_of(spark, [(1000 * n + i, *x) for i, x in enumerate(batch)]), n)
        assert not log.append(ops_of(spark, [(0, True, key(5))]), n)
        ops, n = ops + batch, n + 1
        at = plain_log(ops)
        assert log.head()["position"] == len(ops) and tuple(log.head()[x] for x in L.NAMES) == at[-1]
        want = {d: p for p, d in enumerate(at) if p >= len(ops) - 20}
        assert {tuple(r[x] for x in L.NAMES): r["position"] for r in log.index().collect()} == want
    for position in (17, len(ops)):
        assert tuple(log.digest_at(position)[x] for x in L.NAMES) == at[position]
        assert [tuple(r)[1:] for r in log.tail(position).orderBy("pos").collect()] == ops[position:]
    assert log.digest_at(-1) is None and log.digest_at(len(ops) + 1) is None
    assert log.resolve(0, 3, as_row(at[3])) == (len(ops) if at[3] == at[-1] else 3)
    assert log.resolve(9, 3, as_row(at[-4])) == (len(ops) if at[-4] == at[-1] else want[at[-4]])
    assert log.resolve(0, 4, as_row((1,) * 8)) is None
    old = next(d for d in at if d not in want)
    assert log.resolve(1, at.index(old), as_row(old)) is None and log.resolve(0, at.index(old), as_row(old)) == at.index(old)
    log.compact()
    assert log.head()["epoch"] == 1 and log.head()["position"] == 20 and tuple(log.digest_at(0)[x] for x in L.NAMES) == at[-21]
    assert {tuple(r[x] for x in L.NAMES): r["position"] for r in log.index().collect()} == {d: p - len(ops) + 20 for d, p in want.items()}
    assert not log.append(ops_of(spark, []), n - 1) and log.append(ops_of(spark, [(0, True, key(77))]), n)
    assert log.head()["position"] == 21 and log.vacuum() == 1 and log.head()["position"] == 21
    # A head that was not finished: its batch does not count, and is written again.
    removed(spark, f"{tmp_path}/generation=1/heads/batch={n}/_SUCCESS")
    assert log.head()["position"] == 20 and log.append(ops_of(spark, [(0, True, key(77)), (1, False, key(77))]), n) and log.head()["position"] == 22


def test_a_log_of_members(spark, tmp_path):
    keys = [key(i) for i in range(30)]
    log = LogStore.from_members(keys_of(spark, keys), str(tmp_path), retained=5, epoch=3)
    assert [r.k for r in log.tail(0).orderBy("pos").collect()] == sorted(keys) and log.head()["epoch"] == 3
    assert log.index().count() == 6


def test_walk_of_one_key():
    for _ in range(200):
        held, kept, n = DRAW.randrange(3), [], DRAW.randrange(1, 12)
        ops = [DRAW.random() < 0.5 for _ in range(n)]
        at = held
        for add in ops:
            kept.append(add or at > 0)
            at += 1 if add else -1 if at else 0
        got, after = node.reflected(held, np.array(ops))
        assert got.tolist() == kept and after == at


def test_a_node_follows_a_stream_through_a_restart(spark, tmp_path):
    ops = [(i, DRAW.random() < 0.45, key(DRAW.randrange(25))) for i in range(400)]
    cuts, schema = [0, 3, 150, 151, 320, 400], OPS
    log, held = node.opened(spark, f"{tmp_path}/node")

    def feed(a, b):
        ops_of(spark, ops[a:b]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def follow():
        changes = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        query = node.effective_stream(changes).writeStream.foreachBatch(node.follower(log, held)).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()

    for a, b in zip(cuts[:3], cuts[1:4], strict=True):
        feed(a, b)
    follow()
    for a, b in zip(cuts[3:], cuts[4:], strict=False):
        feed(a, b)
    follow()  # a new run from the checkpoint: the counts are still there
    whole = ops_of(spark, ops)
    effective = oplog.effective_operations(whole)
    assert [tuple(r)[1:] for r in log.tail(0).orderBy("pos").collect()] == [tuple(r)[1:] for r in effective.orderBy("pos").collect()]
    assert rows(held.members()) == rows(oplog.last_operation_set(effective))
    assert tuple(log.head()[x] for x in L.NAMES) == tuple(bags.bag_digest(effective, sign=oplog.sign()).first()[x] for x in L.NAMES)
    assert held.members().where(F.length("k") != 64).count() == 0


def scanned(df):
    """The conditions on partitions of each scan of a plan."""
    return [line.partition("PartitionFilters: ")[2] for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan parquet [k#" in line]


def test_sorted_blocks(spark, tmp_path):
    from tallyfold.sources.blockstore import BlockStore

    keys = sorted([key(DRAW.randrange(300)) for _ in range(260)] + [key(1)] * 70)
    store = BlockStore.create(keys_of(spark, DRAW.sample(keys, len(keys))), str(tmp_path), 50)
    digest = plain_log([(True, k) for k in keys])
    assert store.count() == len(keys) and store.entries().count() == 7
    assert [tuple(r) for r in store.slice(95, 152).orderBy("at").collect()] == [(k, 95 + i) for i, k in enumerate(keys[95:152])]
    for start, end in ((0, 330), (49, 51), (60, 60), (7, 3), (100, 150), (325, 999), (-5, 20)):
        a, b = max(0, min(start, 330)), max(0, min(end, 330))
        want = tuple((x - y) % m for x, y, m in zip(digest[max(a, b)], digest[a], L.MODULI, strict=True))
        assert rows(store.range_digest(start, end)) == [(max(0, b - a), *want)], (start, end)
    for k in (keys[0], key(1), keys[-1], "0" * 64, "f" * 64, keys[100][:5]):
        assert rows(store.lower_bound(k)) == [(sum(x < k for x in keys),)]
        assert store.contains(k) == (k in keys)
    for plan, most in ((store.range_digest(60, 310), 2), (store.lower_bound("8"), 1), (store.slice(10, 40), 1)):
        assert len(scanned(plan)) <= most and all("block#" in x for x in scanned(plan))
    none = BlockStore.create(keys_of(spark, []), f"{tmp_path}/none", 5)
    assert none.count() == 0 and rows(none.range_digest(0, 9)) == [(0,) * 9] and rows(none.lower_bound("8")) == [(0,)] and not none.contains("8") and none.slice(0, 5).count() == 0
    assert BlockStore.open(spark, str(tmp_path)).rows == 50


def windows_form(log):
    """The operations that count, one key's log in one task."""
    from pyspark.sql import Window

    w = Window.partitionBy("k").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    walk = log.withColumn("s", F.sum(oplog.sign()).over(w)).withColumn("low", F.least(F.lit(0), F.min("s").over(w)))
    held = F.coalesce(F.lag(F.col("s") - F.col("low")).over(Window.partitionBy("k").orderBy("pos")), F.lit(0))
    return walk.withColumn("held", held).where("is_add OR held > 0").select("pos", "is_add", "k")


@pytest.mark.parametrize("names", [[0], [0, 0, 0, 0, 1, 2, 3], list(range(40))])
def test_a_log_of_few_keys_is_walked_by_many_tasks(spark, names):
    ops = [(i, DRAW.random() < 0.48, key(DRAW.choice(names))) for i in range(3000)]
    log = ops_of(spark, ops)
    assert rows(oplog.effective_operations(log)) == rows(windows_form(log))
    if len(names) == 1:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be dealt to one task
        try:
            dealt = log.repartitionByRange("k", "pos").groupBy(F.spark_partition_id()).count().collect()
            assert len(dealt) > 1 and max(r["count"] for r in dealt) < 2000
            assert rows(oplog.effective_operations(log)) == rows(windows_form(log))
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert oplog.effective_operations(log.where("false")).count() == 0


def test_folded_digests(spark):
    from tallyfold.functions.fold import folded

    data = [(key(i), i % 3 if i % 7 else None, f"g{i % 2}", (-1) ** (i % 5)) for i in range(500)] + [("ff" * 32, 1, "g", 5), ("00" * 32, 1, None, -3), (key(1), 1, "g1", 0)]
    df = spark.createDataFrame(data, "k string, a int, `b.c` string, s int")
    sign = F.col("s")
    assert rows(folded(df)) == rows(bags.bag_digest(df.withColumn("one", F.lit(1)), ["one"]).drop("one"))
    for by in (["a"], ["b.c"], ["a", "b.c"]):
        own = df.withColumnRenamed("b.c", "bc") if "b.c" not in by else df
        want = [("bc" if b == "b.c" else b) for b in by]
        got = sorted(map(repr, (tuple(r) for r in folded(own, by, sign=sign).collect())))
        assert got == sorted(map(repr, (tuple(r) for r in bags.bag_digest(own.withColumnRenamed("b.c", "bc"), want, sign=sign).collect())))
    assert rows(folded(df.where("false"))) == [(0,) * 9] and rows(folded(df.where("false"), ["a"])) == []
    for bad in ("ab", "zz" * 32):
        with pytest.raises(Exception, match="32 bytes"):
            folded(spark.createDataFrame([(bad,)], "k string")).collect()
