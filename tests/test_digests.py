import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tallyfold import queries as core
from tallyfold.functions import lanes as L
from tallyfold.functions import wire
from tallyfold.operators import bags, oplog, trie

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def keys(spark, names):
    return spark.createDataFrame([(hashlib.sha256(str(n).encode()).hexdigest(),) for n in names], "k string")


def digest(df):
    return bags.bag_digest(df).select(L.digest_hex().alias("d")).first().d


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as from read_parquet('{DIR}/{t}.parquet')")
    df = core.QUERIES[name](spark, DIR)
    found = c.sql(core.ORACLES[name])
    assert sorted(df.columns) == sorted(found.columns)
    expected = [tuple(dict(zip(found.columns, r, strict=True))[x] for x in df.columns) for r in found.fetchall()]
    assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(map(repr, expected))


def test_digest_of_integers(spark):
    # SHA-256 of the little-endian 32-bit integers 0 to 999.
    rows = [(hashlib.sha256(i.to_bytes(4, "little")).hexdigest(),) for i in range(1000)]
    df = spark.createDataFrame(rows, "k string")
    assert digest(df) == "78d904b8f5065bacfe5d0b57dee85e1935c274eeb3df659d4811abb6c6854fae"
    assert digest(df.repartition(7).orderBy(F.desc("k"))) == digest(df)


@pytest.mark.parametrize("k, expected", [("00" * 32, [0] * 8), ("fbffffffefffffffbfffffff9dffffff95ffffff79ffffff67ffffff47ffffff", [0] * 8), ("ff" * 32, [4, 16, 64, 98, 106, 134, 152, 184])])
def test_reduction(spark, k, expected):
    assert list(bags.with_lanes(spark.createDataFrame([(k,)], "k string")).select(*L.NAMES).first()) == expected


def test_wrong_length_is_an_error(spark):
    with pytest.raises(Exception, match="32 bytes"):
        bags.with_lanes(spark.createDataFrame([("00",)], "k string")).collect()


def test_difference_repairs(spark):
    p, r = keys(spark, [*range(200), 5, 5]), keys(spark, [*range(10, 220), 5])
    d = trie.difference(p, r)
    repaired = r.exceptAll(d.where("op = 'remove'").select("k")).unionAll(d.where("op = 'add'").select("k"))
    assert digest(repaired) == digest(p)


def test_empty_tables(spark):
    none = keys(spark, range(1)).where("k = ''")
    assert digest(none) == "0" * 64
    assert trie.difference(none, none).count() == 0
    assert bags.ranked(none, ["k"]).count() == 0


def test_log_with_insert_then_delete(spark):
    log = spark.createDataFrame([(0, False, "a" * 64), (1, True, "b" * 64), (2, False, "b" * 64), (3, True, "c" * 64)], "pos long, is_add boolean, k string")
    assert [r.pos for r in oplog.effective_operations(log).orderBy("pos").collect()] == [1, 2, 3]
    assert [r.k for r in oplog.last_operation_set(log).collect()] == ["c" * 64]


@pytest.mark.parametrize("n, size", [(0, 1), (127, 1), (128, 2), (16383, 2), (16384, 3), (2097151, 3), (2097152, 4), (268435455, 4), (268435456, 5)])
def test_varint(spark, n, size):
    assert spark.range(1).select(wire.varint_size(F.lit(n))).first()[0] == size


def test_message_sizes(spark):
    one = F.lit(0)
    row = spark.range(1).select(wire.request_bytes(one, one), wire.tail_bytes(one, F.lit(10000)), wire.fallback_bytes(F.lit(1), F.lit(1000000))).first()
    assert list(row) == [34, 321253, 36]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
