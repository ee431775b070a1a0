"""Rows that may have a key of a set are told from those that surely don't, by a bitmap of bounded size, with DataFrame functions only.

The bitmap has ``BUCKETS`` rows of 32,768 bits, 8 MB in all, however many keys there are: with more keys it tells fewer rows apart, and
nothing is lost. So a large table need not be shuffled for a join that most of its rows have no part in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 2048
BITS = 32768


def _spot(key: list[Column]) -> tuple[Column, Column]:
    h = F.xxhash64(F.lit(BITS), *key)
    return F.pmod(F.shiftrightunsigned(h, 15), F.lit(BUCKETS)), h.bitwiseAND(F.lit(BITS - 1))


def apart(*tables: DataFrame) -> Callable[[str], str]:
    """Names that no column of these tables has, whatever its case: a function that makes one of a short name."""
    front, taken = "_own_", {c.lower() for t in tables for c in t.columns}
    while any(c.startswith(front) for c in taken):
        front += "_"
    return lambda name: front + name


def split(rows: DataFrame, key: list[Column], keys: DataFrame, own: list[Column], always: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(may, never): the rows whose ``key`` may be among the ``own`` of ``keys``, or for which ``always`` holds, and all others. Nulls count as values."""
    name = apart(rows)
    b, at, own_b, bits = (name(x) for x in ("bucket", "bit", "b", "map"))
    bucket, bit = _spot(own)
    # Dealt by bucket first, so that one bitmap a bucket is made rather than one a bucket and task.
    spots = keys.select(bucket.cast("int").alias(own_b), bit.alias(at)).distinct().repartition(own_b)
    maps = spots.groupBy(own_b).agg(F.bitmap_construct_agg(at).alias(bits))
    bucket, bit = _spot(key)
    seen = rows.withColumns({b: bucket.cast("int"), at: bit}).join(F.broadcast(maps), F.col(b) == F.col(own_b), "left")
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    on = F.coalesce(F.getbit(byte, F.col(at).bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))
    on = on if always is None else on | always
    return tuple(seen.where(c).drop(b, at, own_b, bits) for c in (on, ~on))


def may(rows: DataFrame, key: list[Column], keys: DataFrame, own: list[Column], always: Column | None = None) -> DataFrame:
    """The rows whose key may be among those of ``keys``, and those for which ``always`` holds."""
    return split(rows, key, keys, own, always)[0]
