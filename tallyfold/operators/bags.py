"""Digests of bags and set operations on key tables. Key tables have a column ``k``: 64 hex digits, which order as the bytes do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.functions import lanes as L
from tallyfold.functions.fold import folded
from tallyfold.plans.recovery import written


def with_lanes(keys: DataFrame, k: str = "k") -> DataFrame:
    """``keys`` with l0..l7 of each key. Columns called q0 to q3 would be replaced."""
    parsed = keys.withColumns({f"q{i}": q for i, q in enumerate(L.quarters(F.col(k)))})
    return parsed.select(*[F.col(f"`{c}`") for c in keys.columns], *L.lanes_of([F.col(f"q{i}") for i in range(4)]))


def bag_digest(keys: DataFrame, by: list[str] = (), k: str = "k", sign: Column | None = None, how: str = "groupBy") -> DataFrame:
    """(by.., n, l0..l7): partial sums on the map side, then one row a group. ``how``: groupBy, rollup or cube. A whole table is folded in arrays, a batch at a time."""
    if not by and how == "groupBy":
        return folded(keys, k=k, sign=sign)
    return getattr(with_lanes(keys, k), how)(*by).agg(F.count("*").alias("n"), *L.total(sign))


def remove_copies(keys: DataFrame, gone: DataFrame) -> DataFrame:
    """Bag difference: one copy less for each copy in ``gone``; unknown keys are skipped."""
    return keys.exceptAll(gone)


def ranked(keys: DataFrame, order: list[str]) -> DataFrame:
    """``keys`` with ``at``, the place from 0 in this order, without a single-task sort: range partitions are sorted and written with each row's place in its own, so that
    rows are shuffled once, and the running sum of the partitions' counts (one row each) is joined back. A column ``k`` goes as bytes, unless it is what orders first."""
    names, packs = keys.columns, dict(keys.dtypes).get("k") == "string" and order[0] != "k"
    rows = keys.withColumn("k", L.packed(F.col("k"))) if packs else keys
    order = [L.unpacked(F.col("k")) if packs and c == "k" else F.col(c) for c in order]
    # The number of a row in its partition, which is sorted by then, and the partition's, as one number.
    place = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    dealt = written(place, "ranges")
    part, local = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    counts = dealt.groupBy(part.alias("part")).count()
    before = counts.select(F.col("part").alias("part2"), F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = [L.unpacked(F.col("k")).alias("k") if packs and c == "k" else F.col(f"`{c}`") for c in names]
    return dealt.join(F.broadcast(before), part == F.col("part2")).select(*own, (F.col("before") + local).alias("at"))


def running_digest(rows: DataFrame, order: str, sign: Column | None = None) -> DataFrame:
    """``rows`` (k, order..) with l0..l7: the digest of all rows up to each. Two passes: totals of range partitions, then running sums inside each."""
    s = F.lit(1) if sign is None else sign
    dealt = rows.repartitionByRange(order).withColumn("part", F.spark_partition_id())
    dealt = written(with_lanes(dealt).withColumn("sign", s), "ranges")
    totals = dealt.groupBy("part").agg(*L.total(F.col("sign")))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(F.col("part").alias("part2"), *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"b_{n}") for n in L.NAMES])
    local = Window.partitionBy("part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    sums = dealt.select(*rows.columns, "part", *[F.sum(F.col(n) * F.col("sign")).over(local).alias(n) for n in L.NAMES])
    joined = sums.join(F.broadcast(before), F.col("part") == F.col("part2"))  # one row a partition
    return joined.select(*rows.columns, *[F.pmod(F.col(n) + F.col(f"b_{n}"), F.lit(m)).alias(n) for n, m in zip(L.NAMES, L.MODULI, strict=True)])


def running_key_digest(keys: DataFrame) -> DataFrame:
    """``keys`` in key order with l0..l7: the digest of all keys up to each; equal keys are copies, each with its own row, told apart by ``copy``."""
    copies = keys.groupBy("k").agg(F.count("*").alias("copies"))
    rows = copies.select("k", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    return running_digest(rows.withColumn("place", F.concat("k", F.lpad(F.col("copy").cast("string"), 19, "0"))), "place").drop("place")


def contains(keys: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` with ``present``."""
    known = keys.select(F.col("k").alias("k2")).distinct().withColumn("present", F.lit(True))
    return wanted.join(known, F.col("k") == F.col("k2"), "left").select(*wanted.columns, F.coalesce("present", F.lit(False)).alias("present"))
