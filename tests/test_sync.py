import hashlib
import random

import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from tallyfold.functions import fasthash
from tallyfold.operators import sync, trie
from tallyfold.operators.bags import bag_digest


def key(n) -> str:
    return hashlib.sha256(str(n).encode()).hexdigest()


def log(spark, ops):
    """ops: numbers, negative for deletes."""
    return spark.createDataFrame([(i, n > 0, key(abs(n))) for i, n in enumerate(ops)], "pos long, is_add boolean, k string")


def answer(spark, primary, replica, **more):
    return sync.first_answer(primary=log(spark, primary), replica=log(spark, replica), **more).first().asDict()


def test_equal_logs_need_nothing(spark):
    ops = list(range(1, 101))
    found = answer(spark, ops, ops)
    assert (found["used_fallback"], found["items_added"], found["bytes_sent"], found["bytes_received"]) == (False, 0, 34, 2)


def test_a_replica_behind_gets_the_tail(spark):
    ops = list(range(1, 56))
    found = answer(spark, ops, ops[:50])
    assert (found["start"], found["items_added"], found["bytes_sent"], found["bytes_received"]) == (50, 5, 34, 163)


def test_deleting_and_inserting_again_sends_nothing(spark):
    ops = list(range(1, 21))
    assert answer(spark, ops + [-3, 3], ops)["bytes_received"] == 2


def test_a_lost_key_falls_back(spark):
    ops = list(range(1, 101))
    found = answer(spark, ops, [n for n in ops if n != 40])
    assert found["used_fallback"] and (found["start"], found["bytes_sent"], found["bytes_received"]) == (None, 34, 34)


def test_empty_logs(spark):
    assert answer(spark, [], [])["bytes_received"] == 2
    assert answer(spark, [1, 2], [])["items_added"] == 2


def test_other_epoch_reaches_only_the_retained_positions(spark):
    ops = list(range(1, 31))
    assert answer(spark, ops, ops[:25], primary_epoch=1, retained=5)["items_added"] == 5
    assert answer(spark, ops, ops[:24], primary_epoch=1, retained=5)["used_fallback"]


def test_three_keys_are_peeled(spark):
    table = lambda ns: spark.createDataFrame([(key(n),) for n in ns], "k string")
    found = [tuple(r)[1:] for r in trie.peel_three(table(range(60)), table(range(57)), 0).collect()]
    assert found == [tuple(sorted(key(n) for n in (57, 58, 59)))]
    assert trie.peel_three(table(range(60)), table([*range(56), 99]), 0).count() == 0


def test_fast_item_hash(spark):
    items = [b"", b"a", "é".encode(), bytes(range(256)) * 5, None]
    rows = spark.createDataFrame([(x,) for x in items], "x binary").select(F.col("x"), fasthash.xxh3_key(F.col("x")).alias("k")).collect()
    for r in rows:
        if r.x is None:
            assert r.k is None
        else:
            half = xxhash.xxh3_128_digest(bytes(r.x))
            assert bytes.fromhex(r.k)[:16] == half[::-1]
    assert rows[0].k.startswith("7f498d4624c30160d8984701d306aa99")


def test_item_hash_in_arrays():
    """Every length up to beyond the longest that is hashed in arrays, whole bytes and edges, in a sliced array with nulls, against the hash's own library."""
    draw = random.Random(4)
    items = [draw.randbytes(n) for n in range(260) for _ in range(3)] + [b"\xff" * n for n in range(245)] + [b"\0" * n for n in range(245)]
    low, high = fasthash.hashes(pa.array([b"front", *items], pa.binary()).slice(1))
    assert [int(h) << 64 | int(x) for x, h in zip(low, high, strict=True)] == [xxhash.xxh3_128_intdigest(x) for x in items]
    keys = fasthash.widened(pa.array([None, *items[:50], None], pa.binary())).to_pylist()
    assert keys[0] is None and keys[-1] is None and len(keys) == 52
    for x, k in zip(items, keys[1:51], strict=False):
        value = xxhash.xxh3_128_intdigest(x)
        a, b = value & (1 << 64) - 1, value >> 64
        assert k == b"".join(y.to_bytes(8, "little") for y in (a, b, a ^ b, (a + b) & (1 << 64) - 1))
    assert len(fasthash.widened(pa.array([], pa.binary()))) == 0 and fasthash.widened(pa.array([None], pa.binary())).to_pylist() == [None]


def test_removal_of_items(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",), (None,), ("é" * 200,)], "x string")
    whole = bag_digest(df.where("x IS NOT NULL").select(fasthash.xxh3_key(F.col("x")).alias("k")))
    left = fasthash.without_items(whole, df.where("x <> 'a' OR x IS NULL"), "x").first()
    assert left == bag_digest(spark.createDataFrame([("a",)], "x string").select(fasthash.xxh3_key(F.col("x")).alias("k"))).first()
