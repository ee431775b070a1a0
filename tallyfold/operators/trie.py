"""Tables compared by digests of key prefixes: summaries a level, mismatches, peeling and the exact difference."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.functions import lanes as L
from tallyfold.functions import wire
from tallyfold.operators.bags import bag_digest, with_lanes
from tallyfold.plans.recovery import written

# Up to how many keys a leaf may differ, the deepest prefix in bits, and up to how many keys pairs and triples are looked for.
LEAF, DEEPEST, PAIRS, TRIPLES = 3, 64, 512, 256


def prefix(k: Column, depth: int) -> Column:
    """The first ``depth`` bits (0 to 64) of a hex key, as a number; all 64 bits may make it negative."""
    if not 0 <= depth <= DEEPEST:
        raise ValueError("a prefix has from 0 to 64 bits")
    if not depth:
        return F.lit(0).cast("bigint")
    return F.shiftrightunsigned(F.conv(F.substring(k, 1, 16), 16, -10).cast("bigint"), DEEPEST - depth)


def extended(pfx: Column, depth: int, value: Column | int, bits: int) -> Column:
    """A prefix of ``depth`` bits made longer by the ``bits`` bits of ``value``."""
    if depth + bits > DEEPEST:
        raise ValueError("the prefix is too deep")
    value = F.lit(value) if isinstance(value, int) else value
    return F.shiftleft(pfx, bits).bitwiseOR(value.cast("bigint"))


def network_size(depth: int) -> int:
    """Bytes of a prefix in a message; the root takes none."""
    return -(-depth // 8)


def splits(keys: DataFrame, depth: int, bits: int) -> DataFrame:
    """(pfx, child, begin, end): for each prefix of ``depth`` bits that occurs, where each of its 2^bits children, empty ones too, begins and ends among the prefix's keys."""
    if depth + bits > DEEPEST:
        raise ValueError("the prefix is too deep")
    held = keys.groupBy(prefix(F.col("k"), depth).alias("pfx"), prefix(F.col("k"), depth + bits).bitwiseAND(F.lit((1 << bits) - 1)).alias("child")).count()
    every = held.groupBy("pfx").agg(F.map_from_entries(F.collect_list(F.struct("child", "count"))).alias("counts"))  # at most 2^bits entries
    rows = every.select("pfx", "counts", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit((1 << bits) - 1).cast("bigint"))).alias("child"))
    rows = rows.select("pfx", "child", F.coalesce(F.try_element_at("counts", F.col("child")), F.lit(0).cast("bigint")).alias("n"))
    end = F.sum("n").over(Window.partitionBy("pfx").orderBy("child").rowsBetween(Window.unboundedPreceding, 0))  # at most 2^bits rows
    return rows.select("pfx", "child", (end - F.col("n")).alias("begin"), end.alias("end"))


def level(keys: DataFrame, depth: int) -> DataFrame:
    """(pfx, n, l0..l7): one row for each prefix that occurs."""
    return bag_digest(keys.withColumn("pfx", prefix(F.col("k"), depth)), ["pfx"])


def aligned(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """(pfx, pn, rn, p_l0.., r_l0..) of every prefix that either of two summaries (pfx, n, l0..l7) has."""

    def side(s: DataFrame, p: str) -> DataFrame:
        return s.select(F.col("pfx").alias(f"{p}pfx"), F.col("n").alias(f"{p}n"), *[F.col(n).alias(f"{p}_{n}") for n in L.NAMES])

    both = side(primary, "p").join(side(replica, "r"), F.col("ppfx") == F.col("rpfx"), "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return both.select(F.coalesce("ppfx", "rpfx").alias("pfx"), zero("pn"), zero("rn"), *[zero(f"{p}_{n}") for p in "pr" for n in L.NAMES])


def compared(primary: DataFrame, replica: DataFrame, depth: int) -> DataFrame:
    """(pfx, pn, rn, p_l0.., r_l0..) of every prefix that either side has."""
    return aligned(level(primary, depth), level(replica, depth))


def _differs() -> Column:
    differ = F.col("pn") != F.col("rn")
    for n in L.NAMES:
        differ = differ | (F.col(f"p_{n}") != F.col(f"r_{n}"))
    return differ


def differing(rows: DataFrame) -> DataFrame:
    """Those of :func:`compared` whose count or digest differ."""
    return rows.where(_differs())


def mismatches(primary: DataFrame, replica: DataFrame, depth: int) -> DataFrame:
    """(pfx, pn, rn, p_l0.., r_l0..) of prefixes whose count or digest differ."""
    return differing(compared(primary, replica, depth))


def classified(rows: DataFrame, depth: int) -> DataFrame:
    """What to do with each mismatch: remove all, fetch all, settle as a leaf, or expand."""
    near = F.abs(F.col("pn") - F.col("rn")).between(1, LEAF)
    action = F.when(F.col("pn") == 0, "remove").when(F.col("rn") == 0, "fetch").when(near | F.lit(depth >= DEEPEST), "leaf").otherwise("expand")
    return rows.withColumn("action", action)


def fitting_depth(n: int, bits: int = 1, keys: int = 16) -> int:
    """The depth, a multiple of ``bits``, at which a prefix holds about ``keys`` of ``n`` evenly spread keys."""
    wanted = max(0, (max(n, 1) // keys).bit_length())
    return min(-(-wanted // bits) * bits, DEEPEST // bits * bits)


def _under(keys: DataFrame, open_: DataFrame, depth: int) -> DataFrame:
    return keys.withColumn("pfx", prefix(F.col("k"), depth)).join(open_.select("pfx"), "pfx", "left_semi")


def difference(primary: DataFrame, replica: DataFrame, depth: int | None = None) -> DataFrame:
    """(op, k): keys to add to and to remove from the replica, copies counted. Only keys under differing prefixes are compared; their
    depth follows from the number of keys unless given, so that most prefixes of tables that are nearly equal are left out."""
    if depth is None:
        depth = fitting_depth(max(primary.count(), replica.count()))
    open_ = written(mismatches(primary, replica, depth).select("pfx"), "open")
    return changes_between(_under(primary, open_, depth), _under(replica, open_, depth))


def changes_between(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """(op, k) that make one bag of keys (k) the other, copies counted."""
    signed = primary.select("k", F.lit(1).alias("one")).unionAll(replica.select("k", F.lit(-1).alias("one")))
    left = signed.groupBy("k").agg(F.sum("one").alias("n")).where("n <> 0")  # one shuffle for both directions
    rows = left.select(F.when(F.col("n") > 0, "add").otherwise("remove").alias("op"), "k", F.explode(F.sequence(F.lit(1).cast("long"), F.abs("n"))).alias("copy"))
    return rows.select("op", "k")


def _lack(rows: DataFrame, mine: str, other: str) -> DataFrame:
    """(gap, n, d_l0..): a side's count, and what its digest has more."""
    gap = [F.pmod(F.col(f"{mine}_{n}") - F.col(f"{other}_{n}"), F.lit(m)).alias(f"d_{n}") for n, m in zip(L.NAMES, L.MODULI, strict=True)]
    return rows.select(F.col("pfx").alias("gap"), F.col(f"{mine}n").alias("n"), *gap)


def _equal(left: str, right: str) -> Column:
    same = F.lit(True)
    for n in L.NAMES:
        same = same & (F.col(left + n) == F.col(right + n))
    return same


def peeled(keys: DataFrame, gap: DataFrame, count: int) -> DataFrame:
    """(pfx, k1, .., k of ``count``), rising, of gaps (gap, n, d_l0..) that ``count`` (1 to 3) of their keys explain. keys: (pfx, k), a gap's keys having its prefix, with their lanes if they have been written.
    Pairs are looked for among at most ``PAIRS`` keys of a prefix and triples among ``TRIPLES``, so a prefix has a bounded number."""
    most = {1: None, 2: PAIRS, 3: TRIPLES}[count]
    gap = gap if most is None else gap.where(F.col("n") <= most)
    # Only keys of gaps are parsed, and written, so that the lanes are columns: inlined, they would outgrow a method.
    own = keys.join(gap.select("gap"), F.col("pfx") == F.col("gap")).drop("gap")
    own = own if "l0" in keys.columns else written(with_lanes(own.select("pfx", "k")), "peeled")
    if count == 1:
        return own.join(gap, (F.col("pfx") == F.col("gap")) & _equal("", "d_")).groupBy("pfx").agg(F.min("k").alias("k1"))
    rest = lambda start, *less: [F.pmod(sum((-F.col(f"{x}{n}") for x in less), F.col(f"{start}{n}")), F.lit(m)).alias(f"w_{n}") for n, m in zip(L.NAMES, L.MODULI, strict=True)]
    rows = own.withColumn("copy", F.row_number().over(Window.partitionBy("pfx", "k").orderBy("k")))  # copies are keys of their own
    other = rows.select(F.col("pfx").alias("pfx2"), F.col("k").alias("last"), F.col("copy").alias("last_copy"), *L.NAMES)
    if count == 2:
        wanted = rows.join(gap, F.col("pfx") == F.col("gap")).select("pfx", F.col("k").alias("k1"), F.col("copy").alias("c1"), *rest("d_", ""))
        same = (F.col("pfx") == F.col("pfx2")) & (F.struct("k1", "c1") < F.struct(F.col("last").alias("k1"), F.col("last_copy").alias("c1"))) & _equal("", "w_")
        return wanted.join(other, same).groupBy("pfx").agg(F.min(F.struct("k1", F.col("last").alias("k2"))).alias("m")).select("pfx", "m.*")
    a, b = rows.alias("a"), rows.select("pfx", "k", "copy", *L.NAMES).alias("b")
    pairs = a.join(gap, F.col("a.pfx") == F.col("gap")).join(b, (F.col("a.pfx") == F.col("b.pfx")) & (F.struct("a.k", "a.copy") < F.struct("b.k", "b.copy")))
    wanted = pairs.select(F.col("a.pfx").alias("pfx"), F.col("a.k").alias("k1"), F.col("b.k").alias("k2"), F.col("b.copy").alias("c2"), *rest("d_", "a.", "b."))
    same = (F.col("pfx") == F.col("pfx2")) & (F.struct("k2", "c2") < F.struct(F.col("last").alias("k2"), F.col("last_copy").alias("c2"))) & _equal("", "w_")
    return wanted.join(other, same).groupBy("pfx").agg(F.min(F.struct("k1", "k2", F.col("last").alias("k3"))).alias("m")).select("pfx", "m.*")


def _ahead(primary: DataFrame, replica: DataFrame, depth: int, count: int) -> DataFrame:
    gap = written(_lack(mismatches(primary, replica, depth).where(f"pn = rn + {count}"), "p", "r"), "gaps")
    return peeled(primary.withColumn("pfx", prefix(F.col("k"), depth)), gap, count)


def peel_one(primary: DataFrame, replica: DataFrame, depth: int) -> DataFrame:
    """(pfx, k) of prefixes where the primary has one key more and the digests' difference is that key's."""
    return _ahead(primary, replica, depth, 1).select("pfx", F.col("k1").alias("k"))


def peel_two(primary: DataFrame, replica: DataFrame, depth: int) -> DataFrame:
    """(pfx, k1, k2) of prefixes with two keys more that explain the difference."""
    return _ahead(primary, replica, depth, 2)


def peel_three(primary: DataFrame, replica: DataFrame, depth: int) -> DataFrame:
    """(pfx, k1, k2, k3) of prefixes with three keys more that explain the difference."""
    return _ahead(primary, replica, depth, 3)


def expansion_bytes(parents: DataFrame, children: DataFrame, depth: int, bits: int) -> DataFrame:
    """One row (bytes_sent, bytes_received) for expanding ``parents`` (pfx) to ``depth`` bits: all children are named, empty ones too; each answers with its count in the
    primary (``children``: pfx, pn) and a digest unless it is empty."""
    below = children.where("pn > 0").select(F.shiftrightunsigned("pfx", bits).alias("parent"), "pn").join(parents.select(F.col("pfx").alias("parent")), "parent", "left_semi")
    held = below.agg(F.count("*").alias("c"), F.coalesce(F.sum(wire.varint_size(F.col("pn"))), F.lit(0)).alias("v"))
    named = parents.agg((F.count("*") * (1 << bits)).alias("n"))
    both = held.crossJoin(named)  # one row each
    return both.select((F.col("n") * network_size(depth)).cast("long").alias("bytes_sent"), (F.col("v") + 32 * F.col("c") + F.col("n") - F.col("c")).cast("long").alias("bytes_received"))


@dataclass(frozen=True)
class Reconciled:
    """What a comparison by prefixes found, and what it took: ``changes`` (op, k), and counts."""

    changes: DataFrame
    round_trips: int
    bytes_sent: int
    bytes_received: int
    items_added: int
    items_deleted: int


#: Up to how many bits a level is small enough to be summed up from a larger one whenever it is asked for.
SMALL = 16


def _levels(summary: DataFrame, base: int, bits: int) -> Callable[[int], DataFrame]:
    """The rows of :func:`compared` at any depth from 0 to ``base`` in steps of ``bits``, from those at ``base``. Each large level is summed up from the one below it and written, so
    all together cost little more than the first."""
    sums = [c for p in "pr" for c in ((f"{p}n", None), *((f"{p}_{n}", m) for n, m in zip(L.NAMES, L.MODULI, strict=True)))]

    def up(rows: DataFrame, by: int) -> DataFrame:
        rows = rows.withColumn("pfx", F.shiftrightunsigned("pfx", by)) if by else rows
        return rows.groupBy("pfx").agg(*[(F.sum(c) if m is None else F.pmod(F.sum(F.col(c).cast("decimal(20,0)")), F.lit(m)).cast("bigint")).alias(c) for c, m in sums])

    made, depth = {base: summary}, base
    while depth - bits > SMALL:
        depth -= bits
        made[depth] = written(up(made[depth + bits], bits), "level")
    return lambda wanted: made[wanted] if wanted in made else up(made[depth], depth - wanted)


def reconcile(primary: DataFrame, replica: DataFrame, bits: int = 2) -> Reconciled:
    """The whole comparison by prefixes, level by level from the root, as the replica drives it: equal prefixes are dropped, what only one side has goes as a whole, prefixes
    whose counts differ by up to ``LEAF`` are peeled by the side that has more, and all others, as those that can't be peeled, are expanded by ``bits`` bits; at ``DEEPEST`` the keys themselves are exchanged.

    Both sides are summarised once, at a depth that follows from the number of keys; levels above are sums of that. The keys under prefixes that differ there are written once, of both sides in one table, with their
    lanes; each level below groups them once and leaves only those under prefixes that go on being expanded. A level takes three jobs, and two more for all its leaves.
    What reaches the driver is a few counts a level. Byte counts follow the messages: a leaf asks with its prefix (and
    a digest of 32 bytes where the primary peels), an expansion names all children, empty ones too, and gets their counts, with a digest unless empty."""
    if bits < 1 or DEEPEST % bits:
        raise ValueError("bits has to divide 64")
    base = fitting_depth(max(primary.count(), replica.count()), bits)
    summary = written(compared(primary, replica, base), "summary")
    level_of = _levels(summary, base, bits)
    open_ = written(differing(summary).select("pfx"), "open")
    own = [_under(df, open_, base).select("k", F.lit(s).alias("side")) for s, df in (("p", primary), ("r", replica))]
    near = written(with_lanes(own[0].unionAll(own[1])).withColumn("top", prefix(F.col("k"), DEEPEST)), "near")

    def at(rows: DataFrame, depth: int) -> DataFrame:
        return rows.withColumn("pfx", F.shiftrightunsigned("top", DEEPEST - depth) if depth else F.lit(0).cast("bigint"))

    def nodes(depth: int, parents: DataFrame | None) -> DataFrame:
        """Of ``depth``, under these parents; all keys that are near have such a parent below ``base``."""
        if depth > base:
            one = {s: F.when(F.col("side") == s, 1).otherwise(0) for s in "pr"}
            sums = [c.alias(f"{s}_{n}") for s in "pr" for c, n in zip(L.total(one[s]), L.NAMES, strict=True)]
            return at(near, depth).groupBy("pfx").agg(*[F.sum(one[s]).cast("long").alias(f"{s}n") for s in "pr"], *sums)
        rows = level_of(depth)
        return rows if parents is None else rows.withColumn("parent", F.shiftrightunsigned("pfx", bits)).join(parents.select(F.col("pfx").alias("parent")), "parent", "left_semi").drop("parent")

    def keys(side: str, depth: int, rows: DataFrame) -> DataFrame:
        return at(near.where(F.col("side") == side), depth).select("pfx", "k").join(rows.select("pfx"), "pfx", "left_semi")

    spark, depth, trips, sent, received, found, expand, named = primary.sparkSession, 0, 0, 0, 0, [], None, 0
    change = lambda op, rows: found.append(rows.select(F.lit(op).alias("op"), "k"))
    # By how much the replica is behind: of leaves alone, and of more than a leaf's keys only the sign.
    behind = F.greatest(F.least(F.col("rn") - F.col("pn"), F.lit(LEAF + 1)), F.lit(-LEAF - 1))
    while True:
        front = classified(nodes(depth, expand), depth)
        front = written(front.withColumn("action", F.when(_differs(), F.col("action")).otherwise("equal")), "nodes")
        said = F.sum(F.when(F.col("pn") > 0, wire.varint_size(F.col("pn"))).otherwise(0)).alias("said")
        counts = front.groupBy("action", F.when(F.col("action") == "leaf", behind).otherwise(0).alias("behind")).agg(F.count("*").alias("n"), F.sum("pn").alias("pn"), F.count_if(F.col("pn") > 0).alias("held"), said)
        told: dict[str, list] = {}
        for r in counts.collect():
            told.setdefault(r["action"], []).append(r)
        if named:  # what the expansion that led here has cost: all children are named, and those that hold keys answer with a digest
            held = sum(r["held"] for rows in told.values() for r in rows)
            sent, received = sent + named * network_size(depth), received + sum(r["said"] for rows in told.values() for r in rows) + 32 * held + named - held
        told.pop("equal", None)
        if not told:
            break
        size = network_size(depth)
        if "remove" in told:
            change("remove", keys("r", depth, front.where("action = 'remove'")))
        if set(told) == {"remove"}:
            break
        trips += 1
        if "fetch" in told:
            sent, received = sent + told["fetch"][0]["n"] * size, received + told["fetch"][0]["pn"] * 32
            change("add", keys("p", depth, front.where("action = 'fetch'")))
        failed, n = None, sum(r["n"] for r in told.get("expand", ()))
        if "leaf" in told:
            leaves = front.where("action = 'leaf'")
            sent += sum(r["n"] for r in told["leaf"] if r["behind"] < 0) * (size + 32)
            parts, there, peels = [], {r["behind"] for r in told["leaf"]}, 0
            for side, other, op in (("p", "r", "add"), ("r", "p", "remove")):
                for count in range(1, LEAF + 1):
                    if (-count if side == "p" else count) not in there:
                        continue
                    gap = _lack(leaves.where(F.col(f"{side}n") == F.col(f"{other}n") + count), side, other)
                    one = peeled(at(near.where(F.col("side") == side), depth).select("pfx", "k", *L.NAMES), gap, count)
                    parts.append(one.select(F.lit(op).alias("op"), F.lit(count).alias("size"), "pfx", F.array(*[f"k{i + 1}" for i in range(count)]).alias("ks")))
            if parts:
                got = written(reduce(DataFrame.unionAll, parts), "peels")  # all kinds of leaves at once, as a level's jobs cost more than its rows
                found.append(got.select("op", F.explode("ks").alias("k")))
                for r in got.groupBy("op", "size").count().collect():
                    peels += r["count"]
                    received += r["count"] * r["size"] * 32 if r["op"] == "add" else 0
            failed = leaves
            if parts:
                failed = failed.join(got.select("pfx"), "pfx", "left_anti")
            if depth >= DEEPEST:
                failed = written(failed, "failed")
                mine, theirs = keys("p", depth, failed), keys("r", depth, failed)
                last = written(difference(mine.select("k"), theirs.select("k"), 0), "exchange")
                sent += failed.count() * size + 32 * theirs.count()
                received += 32 * last.count()
                found.append(last)
                break
            n += sum(r["n"] for r in told["leaf"]) - peels
        if not n:
            break
        expand = front.where("action = 'expand'")
        expand = (expand if failed is None else expand.unionByName(failed)).select("pfx")
        if depth >= base:
            near = written(at(near, depth).join(expand, "pfx", "left_semi").drop("pfx"), "near")
        named, depth = n << bits, depth + bits
    none = spark.createDataFrame([], "op string, k string")
    changes = written(reduce(DataFrame.unionAll, found, none), "changes")
    counts = {r["op"]: r["count"] for r in changes.groupBy("op").count().collect()}
    return Reconciled(changes, trips, sent, received, counts.get("add", 0), counts.get("remove", 0))


def applied(members: DataFrame, changes: DataFrame) -> DataFrame:
    """The bag ``members`` after ``changes`` (op, k)."""
    gone = changes.where("op = 'remove'").select("k")
    return members.select("k").exceptAll(gone).unionAll(changes.where("op = 'add'").select("k"))
