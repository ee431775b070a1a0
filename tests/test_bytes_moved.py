"""Keys as bytes, ranking without a second shuffle, the positions that a synchronisation looks at, and batches whose keys the store lacks."""

import hashlib

from pyspark.sql import functions as F

from tallyfold import queries as core
from tallyfold.functions import lanes as L
from tallyfold.operators import bags, oplog
from tallyfold.sources.keystore import KeyStore


def key(n):
    return hashlib.sha256(str(n).encode()).hexdigest()


def test_keys_as_bytes_and_back(spark):
    keys = [None, "", "a" * 31, "b" * 32, "c" * 33, "zz" * 32, key(1), key(2).upper(), "aa" * 16, "é" * 16, "é" * 32, "\0" * 64]
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i int, k string")
    found = df.select("i", L.packed(F.col("k")).alias("p"), "k").select("i", F.octet_length("p").alias("n"), L.unpacked(F.col("p")).alias("k")).collect()
    assert {r.i: r.k for r in found} == dict(enumerate(keys))
    assert {r.i for r in found if r.n == 32} == {6}


def test_ranking_shuffles_rows_once(spark):
    ranked = bags.ranked(spark.createDataFrame([(i * 7 % 1000, key(i)) for i in range(1000)], "o long, k string"), ["o"])
    by_part = [x for x in ranked._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning" in x]
    assert len(by_part) == 1  # of the counts, one row a part
    rows = ranked.collect()
    assert sorted((r.o, r.at) for r in rows) == [(i, i) for i in range(1000)] and {r.o: r.k for r in rows} == {i * 7 % 1000: key(i) for i in range(1000)}


def test_recent_positions_are_the_last_of_all(spark):
    log = spark.createDataFrame([(i, i % 3 != 2, key(i // 2)) for i in range(40)], "pos long, is_add boolean, k string")
    base = bags.bag_digest(spark.createDataFrame([(key("base"),)], "k string")).select(*L.NAMES)
    every = {r.position: tuple(r) for r in oplog.positions(log, base).select("position", *L.NAMES).collect()}
    for retained, asked in ((0, 3), (7, 33), (7, 41), (100, 40)):
        told = oplog.recent(log, retained, base, spark.createDataFrame([(asked,)], "asked long")).collect()
        assert {tuple(r) for r in told} == {every[p] for p in {*range(max(1, 40 - retained), 41), asked} if p in every}, (retained, asked)
    assert oplog.recent(log.where("false"), 5, None, spark.createDataFrame([(3,)], "asked long")).count() == 0


def test_batches_over_what_a_store_has(spark, tmp_path):
    store = KeyStore.create(spark.createDataFrame([(key(i),) for i in range(30)], "k string"), f"{tmp_path}/set", 4, (4, 8))
    batch = lambda *ops: spark.createDataFrame([(i, add, key(n)) for i, (add, n) in enumerate(ops)], "pos long, is_add boolean, k string")
    store.apply(batch((True, 5), (False, 6), (False, 99), (True, 40), (False, 7), (True, 7)), 0)
    store.apply(batch((False, 40), (True, 6), (False, 5), (True, 41)), 1)
    assert sorted(r.k for r in store.members().collect()) == sorted(key(n) for n in [*(i for i in range(30) if i != 5), 41])
    assert store.total().first() == bags.bag_digest(store.members()).first()


def test_orders_are_ranked_before_they_get_keys(spark):
    """What the ranking writes has the parts of a key, not the key."""
    o = core.ranked_orders(spark.read.parquet("/root/testdata/sf0.001/orders.parquet"))
    assert "sha2" in o._jdf.queryExecution().optimizedPlan().toString()
    assert [r.o_orderkey for r in o.orderBy("pos").collect()] == sorted(r.o_orderkey for r in o.collect())
