"""Sharding through a permutation-filled lookup table.

Each shard has a preference order over the slots of a prime-sized table (offset and skip taken from its
name's MD5). The shards take turns, each claiming its most preferred free slot, until the table is
full; so shards differ by at most one slot and few slots move when a shard comes or goes. A row's
slot is its key's MD5 modulo the table size, and one look into the broadcast table, which has exactly
``table_size`` rows whatever the data, gives its shard.

A hot key can be dealt over ``spread`` places: those columns' hash, modulo ``fan``, joins the key.

Defined results: null key parts count as a text of their own (a lone U+0000); repeated rows get the same shard; an
empty table gives an empty result; other columns are passed over, so clashing names don't matter.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_TABLE = 1_000_003


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _number(text: str, start: int) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[start : start + 15], 16)


def fill_table(shards: list[str], table_size: int) -> list[int]:
    """The shard's index for each slot. ``table_size``: a prime up to ``MAX_TABLE`` and at least the number of shards."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names")
    if not _is_prime(table_size) or not len(shards) <= table_size <= MAX_TABLE:
        raise ValueError("the table size must be a prime, at least the number of shards and not over MAX_TABLE")
    place = [_number(s, 0) % table_size for s in shards]
    skip = [_number(s, 15) % (table_size - 1) + 1 for s in shards]
    table, free = [-1] * table_size, table_size
    while free:
        for i in range(len(shards)):
            while table[place[i]] >= 0:
                place[i] = (place[i] + skip[i]) % table_size
            table[place[i]] = i
            free -= 1
            if not free:
                break
    return table


def table_rows(spark: SparkSession, shards: list[str], table_size: int) -> DataFrame:
    """The lookup table as rows (slot, shard), made by the JVM from one literal."""
    filled = ",".join(map(str, fill_table(shards, table_size)))
    names = F.array(*[F.lit(s) for s in shards])
    rows = spark.range(1).select(F.posexplode(F.split(F.lit(filled), ",")).alias("slot", "i"))
    return rows.select("slot", F.element_at(names, F.col("i").cast("int") + 1).alias("shard"))


def slot_of(keys: list[str], table_size: int, spread: list[str] = (), fan: int = 1) -> Column:
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in keys]
    if spread and fan > 1:
        parts.append(F.pmod(F.xxhash64(*spread), F.lit(fan)).cast("string"))
    return (F.conv(F.substring(F.md5(F.concat_ws("\x1f", *parts)), 1, 15), 16, 10).cast("bigint") % table_size).cast("int")


def assign(rows: DataFrame, keys: list[str], shards: list[str], table_size: int = 6421, spread: list[str] = (), fan: int = 1) -> DataFrame:
    """One row for each input row: the key columns, slot int and shard string. If a key has such a name, the result's column gets underscores until it has one of its own."""
    slot, shard = "slot", "shard"
    while slot in keys:
        slot += "_"
    while shard in [*keys, slot]:
        shard += "_"
    own = [f"_key{i}" for i in range(len(keys))]
    placed = rows.select(*[F.col(f"`{k}`").alias(o) for k, o in zip(keys, own, strict=True)], slot_of(keys, table_size, spread, fan).alias("_slot"))
    placed = placed.join(F.broadcast(table_rows(rows.sparkSession, shards, table_size)), F.col("_slot") == F.col("slot"))
    return placed.select(*[F.col(o).alias(k) for k, o in zip(keys, own, strict=True)], F.col("slot").alias(slot), F.col("shard").alias(shard))


def oracle(shards: int, table_size: int) -> str:
    """DuckDB SQL for ``documents`` keyed by doc_id: the table is filled anew, one claim a step."""
    m, n = table_size, shards
    return f"""
    WITH RECURSIVE s AS (SELECT list(('0x' || substr(md5('shard-' || i), 1, 15))::BIGINT % {m} ORDER BY i) AS o,
                                list(('0x' || substr(md5('shard-' || i), 16, 15))::BIGINT % {m - 1} + 1 ORDER BY i) AS k FROM range({n}) t(i)),
    fill(step, slot, taken, tried) AS (
      SELECT -1::BIGINT, -1::BIGINT, repeat('0', {m})::BIT, list_transform(range({n}), lambda x: 0::BIGINT)
      UNION ALL
      SELECT step + 1, slot2, set_bit(taken, slot2::INT, 1), list_transform(tried, lambda t, i: CASE WHEN i = w + 1 THEN j ELSE t END)
      FROM (SELECT *, (o[w + 1] + j * k[w + 1]) % {m} AS slot2 FROM (
              SELECT *, list_filter(range(tried[w + 1], {m}), lambda j: get_bit(taken, ((o[w + 1] + j * k[w + 1]) % {m})::INT) = 0)[1] AS j
              FROM (SELECT fill.*, o, k, (step + 1) % {n} AS w FROM fill, s WHERE step < {m} - 1)))),
    d AS (SELECT doc_id, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, chr(0))), 1, 15))::BIGINT % {m})::INT AS slot FROM documents)
    SELECT doc_id, slot, 'shard-' || (step % {n}) AS shard FROM d JOIN fill USING (slot)"""
