"""The comparison by prefixes and the whole synchronisation, against a plain simulation of the messages and against figures counted by hand."""

import hashlib
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tallyfold.functions import lanes as L
from tallyfold.functions import wire
from tallyfold.operators import bags, oplog, sync, trie
from tallyfold.plans import recovery


def key(n) -> str:
    return hashlib.sha256(str(n).encode()).hexdigest()


def table(spark, ks):
    return spark.createDataFrame([(k,) for k in ks], "k string")


def varint(n):
    return max(1, -(-n.bit_length() // 7))


def simulated(primary, replica, bits):
    """(adds, removes, round trips, bytes sent, bytes received) of sets of hex keys. Equal sets stand for equal digests."""
    held = lambda ks, p: {k for k in ks if format(int(k, 16), "0256b").startswith(p)}
    adds, removes, trips, sent, received, front = set(), set(), 0, 0, 0, [""]
    front = [] if primary == replica else front
    while front:
        leaves, expand = [], []
        for p in front:
            a, b = held(primary, p), held(replica, p)
            if not a:
                removes |= b
            elif not b or len(p) >= 64 or abs(len(a) - len(b)) <= 3:
                leaves.append((p, a, b))
            else:
                expand.append(p)
        if not leaves and not expand:
            break
        trips += 1
        for p, a, b in leaves:
            size, gap = -(-len(p) // 8), len(a) - len(b)
            if not b:
                sent, received, adds = sent + size, received + 32 * len(a), adds | a
                continue
            more, less = (a, b) if gap > 0 else (b, a)
            sent += size + 32 if gap > 0 else 0
            # Only if what one side lacks is all the difference do sums of one to three keys explain it.
            limit = {1: 10**9, 2: 512, 3: 256}.get(abs(gap), 0)
            if gap and less < more and len(more) <= limit:
                received += 32 * gap if gap > 0 else 0
                adds, removes = (adds | (a - b), removes) if gap > 0 else (adds, removes | (b - a))
            elif len(p) < 64:
                expand.append(p)
            else:
                sent, received, adds, removes = sent + size + 32 * len(b), received + 32 * len(a ^ b), adds | (a - b), removes | (b - a)
        front = []
        for p in expand:
            for c in range(1 << bits):
                child = p + format(c, f"0{bits}b")
                a, b = held(primary, child), held(replica, child)
                sent, received = sent + -(-len(child) // 8), received + varint(len(a)) + (32 if a else 0)
                front += [child] if a != b else []
    return adds, removes, trips, sent, received


def outcome(done):
    rows = done.changes.collect()
    assert (done.items_added, done.items_deleted) == (sum(r.op == "add" for r in rows), sum(r.op == "remove" for r in rows))
    return {r.k for r in rows if r.op == "add"}, {r.k for r in rows if r.op == "remove"}, done.round_trips, done.bytes_sent, done.bytes_received


def near_copies(n, lost, gained, seed):
    draw = random.Random(seed)
    both = [key(i) for i in range(n)]
    return set(both) - set(draw.sample(both, gained)), set(both) - set(draw.sample(both, lost))


@pytest.mark.parametrize(("n", "lost", "gained", "bits"), [(120, 15, 0, 2), (300, 0, 2, 1), (300, 25, 40, 4), (40, 40, 0, 2), (40, 0, 40, 2), (0, 0, 0, 2), (60, 7, 7, 8)])
def test_comparison_equals_a_simulation(spark, n, lost, gained, bits):
    primary, replica = near_copies(n, lost, gained, n + lost)
    done = trie.reconcile(table(spark, sorted(primary)), table(spark, sorted(replica)), bits)
    assert outcome(done) == simulated(primary, replica, bits)


def test_keys_alike_in_64_bits_are_exchanged(spark):
    shared = [key(i) for i in range(20)]
    deep = ["ab" * 8 + f"{i:048x}" for i in range(12)]
    primary, replica = set(shared + deep[:6]), set(shared + deep[4:])
    assert outcome(trie.reconcile(table(spark, sorted(primary)), table(spark, sorted(replica)), 16)) == simulated(primary, replica, 16)


def test_bytes_by_hand(spark):
    # Two keys against none of them: the root asks for nothing but its prefix of no bytes and gets both keys.
    done = trie.reconcile(table(spark, [key(1), key(2)]), table(spark, []))
    assert (done.round_trips, done.bytes_sent, done.bytes_received, done.items_added) == (1, 0, 64, 2)
    # One key more: the root is a leaf, the replica sends its digest, the primary peels one key.
    done = trie.reconcile(table(spark, map(key, range(9))), table(spark, map(key, range(8))))
    assert (done.round_trips, done.bytes_sent, done.bytes_received, done.items_added) == (1, 32, 32, 1)
    # One key less: the replica peels for itself; equal tables need nothing.
    done = trie.reconcile(table(spark, map(key, range(8))), table(spark, map(key, range(9))))
    assert (done.round_trips, done.bytes_sent, done.bytes_received, done.items_deleted) == (1, 0, 0, 1)
    assert outcome(trie.reconcile(table(spark, map(key, range(8))), table(spark, map(key, range(8))))) == (set(), set(), 0, 0, 0)
    with pytest.raises(ValueError):
        trie.reconcile(table(spark, []), table(spark, []), 3)


def test_copies_are_counted(spark):
    primary, replica = [key(1)] * 3 + [key(2), key(3)] * 40, [key(1)] + [key(2), key(3)] * 40 + [key(4)] * 2
    done = trie.difference(table(spark, primary), table(spark, replica))
    assert sorted((r.op, r.k) for r in done.collect()) == sorted([("add", key(1))] * 2 + [("remove", key(4))] * 2)
    found = trie.peeled(table(spark, primary).withColumn("pfx", F.lit(0).cast("long")), trie._lack(trie.mismatches(table(spark, primary), table(spark, primary[2:]), 0), "p", "r"), 2)
    assert [tuple(r)[1:] for r in found.collect()] == [(key(1), key(1))]


def test_difference_with_few_and_many_prefixes(spark):
    primary, replica = near_copies(2000, 9, 11, 3)
    for depth in (None, 0, 5, 64):
        found = trie.difference(table(spark, primary), table(spark, replica), depth).collect()
        assert {r.k for r in found if r.op == "add"} == primary - replica and {r.k for r in found if r.op == "remove"} == replica - primary and len(found) == 20


def test_prefixes(spark):
    k = "f" * 16 + "0" * 48
    row = table(spark, [k]).select(*[trie.prefix(F.col("k"), d).alias(f"d{d}") for d in (0, 1, 4, 63, 64)], trie.extended(F.lit(5), 3, 2, 2).alias("e")).first()
    assert tuple(row) == (0, 1, 15, 2**63 - 1, -1, 22)
    assert [trie.network_size(d) for d in (0, 1, 8, 9, 64)] == [0, 1, 1, 2, 8]
    for bad in (lambda: trie.prefix(F.col("k"), 65), lambda: trie.extended(F.col("k"), 63, 0, 2), lambda: trie.splits(table(spark, [k]), 60, 8)):
        with pytest.raises(ValueError):
            bad()


def test_splits_have_empty_children(spark):
    ks = ["0" * 64, "1" + "0" * 63, "c" + "0" * 63, "c" + "1" * 63]
    found = trie.splits(table(spark, ks), 0, 2).orderBy("child").collect()
    assert [tuple(r) for r in found] == [(0, 0, 0, 2), (0, 1, 2, 2), (0, 2, 2, 2), (0, 3, 2, 4)]


def log(spark, ops):
    """ops: numbers, negative for deletes."""
    return spark.createDataFrame([(i, n > 0, key(abs(n))) for i, n in enumerate(ops)], "pos long, is_add boolean, k string")


def digest(df):
    return bags.bag_digest(df).select(L.digest_hex().alias("d")).first().d


def synced(primary, replica, **more):
    done = sync.synchronise(primary=primary, replica=replica, **more)
    assert digest(done.replica.members) == digest(primary.members) and done.replica.epoch == primary.epoch
    return done


def test_catching_up_by_the_tail(spark):
    ops = [*range(1, 41), -3, -4, 3, -99]
    primary, replica = oplog.node(log(spark, ops)), oplog.node(log(spark, ops[:35]))
    done = synced(primary, replica)
    assert (done.used_fallback, done.round_trips, done.latency_ms, done.items_added, done.items_deleted) == (False, 1, 50, 6, 2)
    assert (done.bytes_sent, done.bytes_received) == (34, 1 + 1 + 1 + 8 * 32)
    again = synced(primary, done.replica)  # the tail was appended to its log
    assert (again.used_fallback, again.items_added, again.bytes_received) == (False, 0, 2)
    assert done.replica.log.count() == 43  # the delete of an absent key is no operation


def test_falling_back_after_corruption(spark):
    ops = list(range(1, 61))
    primary = oplog.node(log(spark, ops))
    broken = oplog.node(log(spark, [n for n in ops if n not in (7, 8, 9, 10, 30)] + [200, 201]))
    adds, removes, trips, sent, received = simulated({key(n) for n in ops}, {key(n) for n in ops if n not in (7, 8, 9, 10, 30)} | {key(200), key(201)}, 2)
    done = synced(primary, broken)
    assert (done.used_fallback, done.round_trips, done.items_added, done.items_deleted) == (True, 1 + trips, len(adds), len(removes))
    assert (done.bytes_sent, done.bytes_received) == (34 + sent, 34 + received)
    assert done.replica.log.count() == 60 and synced(primary, done.replica).items_added == 0


def test_forced_comparison_changes_nothing_in_equal_sets(spark):
    primary = oplog.node(log(spark, range(1, 21)))
    done = synced(primary, primary, force_prefixes=True)
    assert (done.used_fallback, done.round_trips, done.items_added) == (True, 1, 0)


def test_compaction_carries_the_digest(spark):
    ops = list(range(1, 31))
    primary = oplog.compact(oplog.node(log(spark, ops)), retained=10)
    assert primary.epoch == 1 and primary.log.count() == 10 and {r.pos for r in primary.log.collect()} == set(range(10))
    assert digest(primary.members) == digest(table(spark, map(key, ops)))
    behind = synced(primary, oplog.node(log(spark, ops[:25])), retained=10)  # found by its digest, though positions differ
    assert (behind.used_fallback, behind.items_added) == (False, 5)
    at_base = synced(primary, oplog.node(log(spark, ops[:20])), retained=10)
    assert (at_base.used_fallback, at_base.items_added) == (False, 10)
    assert synced(primary, oplog.node(log(spark, ops[:19])), retained=10).used_fallback
    twice = oplog.compact(primary, retained=3)
    assert twice.epoch == 2 and synced(twice, oplog.node(log(spark, ops[:27])), retained=3).items_added == 3


def test_digests_are_read_without_reduction(spark):
    rows = spark.createDataFrame([("ff" * 32,)], "h string")
    assert list(rows.select(*L.read_hex(F.col("h"))).first()) == [2**32 - 1] * 8
    assert list(rows.select(*L.read_binary(F.unhex("h"))).first()) == [2**32 - 1] * 8
    with pytest.raises(Exception, match="32 bytes"):
        rows.select(*L.read_hex(F.lit("00"))).collect()


def test_a_key_is_hashed_once(spark):
    df = bags.bag_digest(spark.range(10).select(L.key_hex(F.col("id")).alias("k")))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("sha2(") == 1


def test_running_digest_over_keys(spark):
    ks = sorted([key(1), key(2), key(2), key(3)])
    found = bags.running_key_digest(table(spark, ks)).orderBy("k", "copy").collect()
    for i, r in enumerate(found):
        assert r.k == ks[i] and list(bags.bag_digest(table(spark, ks[: i + 1])).select(*L.NAMES).first()) == [r[n] for n in L.NAMES]


def test_message_sizes_by_hand(spark):
    row = spark.range(1).select(wire.tail_bytes(F.lit(1), F.lit(10_000)).alias("tail"), wire.request_bytes(F.lit(0), F.lit(0)).alias("ask"), wire.fallback_bytes(F.lit(1), F.lit(1_000_000)).alias("back")).first()
    assert tuple(row) == (321_253, 34, 36)


def test_written_tables_can_be_removed(spark, tmp_path):
    kept = recovery.written(spark.range(3), "kept")
    assert kept.count() == 3
    path = kept.inputFiles()[0].removeprefix("file:")
    both = recovery.reunited([recovery.written(spark.range(2), "part"), recovery.written(spark.range(5), "part")])
    assert both.count() == 7
    import os

    assert os.path.exists(path) and recovery.clean_up(spark) >= 3 and not os.path.exists(path)


def test_leaves_of_a_level_are_peeled_in_one_table(spark, monkeypatch):
    """However many kinds of leaves a level has, it writes one table of what they gave."""
    made, write = [], trie.written
    monkeypatch.setattr(trie, "written", lambda df, tag: made.append(tag) or write(df, tag))
    done = trie.reconcile(table(spark, [key(i) for i in range(60) if i % 7]), table(spark, [key(i) for i in range(60) if i % 5]))
    assert {(r.op, r.k) for r in done.changes.collect()} == {("add", key(i)) for i in range(0, 60, 5) if i % 7} | {("remove", key(i)) for i in range(0, 60, 7) if i % 5}
    assert made.count("peels") <= made.count("nodes") and "peeled" not in made and "peels" in made
