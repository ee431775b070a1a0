"""Digests folded from Arrow batches: a task's keys, 32 bytes each, are summed as arrays and leave as one row a group and batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.functions import lanes as L

MODULI = np.array(L.MODULI, np.uint64)


def words(keys: pa.Array) -> np.ndarray:
    """The eight 32-bit numbers of each key of 32 bytes, not reduced."""
    keys = keys.cast(pa.binary(32))
    data = keys.buffers()[1]
    return np.frombuffer(data, "<u4", 8 * len(keys), 32 * keys.offset).reshape(-1, 8) if len(keys) else np.empty((0, 8), np.uint32)


def sums(lanes: np.ndarray, weight: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Lane sums modulo the moduli of the rows of each group, which begin at these rows. Sums of a batch's 32-bit numbers stay far below 2^63."""
    up = np.add.reduceat(lanes * np.maximum(weight, 0)[:, None].astype(np.uint64), begin, axis=0, dtype=np.uint64) % MODULI
    down = np.add.reduceat(lanes * np.maximum(-weight, 0)[:, None].astype(np.uint64), begin, axis=0, dtype=np.uint64) % MODULI
    return (up + MODULI - down) % MODULI


def folded(keys: DataFrame, by: list[str] = (), k: str = "k", sign: Column | None = None) -> DataFrame:
    """(by.., n, l0..l7): what ``bags.bag_digest`` gives for a grouping. sign: a whole number a row, 1 unless given. A key that isn't 64 hex digits is an error."""
    raw = F.when((F.length(k) == 64) & F.unhex(k).isNotNull(), F.unhex(k)).otherwise(F.raise_error(F.lit("a key has 32 bytes")))
    rows = keys.select(*[F.col(f"`{c}`").alias(f"by{i}") for i, c in enumerate(by)], raw.alias("key"), (F.lit(1) if sign is None else sign).cast("long").alias("sign"))
    names = [f"by{i}" for i in range(len(by))]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            code = np.zeros(batch.num_rows, np.int64)
            for name in names:
                column = batch.column(name).dictionary_encode(null_encoding="encode")
                code = code * len(column.dictionary) + column.indices.to_numpy(zero_copy_only=False)
                code = np.unique(code, return_inverse=True)[1]
            order = np.argsort(code, kind="stable") if names else np.arange(len(code))
            begin = np.flatnonzero(np.diff(code[order], prepend=-1))
            found = sums(words(batch.column("key"))[order], batch.column("sign").to_numpy()[order], begin)
            first = pa.array(order[begin])
            n = np.diff(np.append(begin, len(order)))
            yield pa.RecordBatch.from_arrays([batch.column(c).take(first) for c in names] + [pa.array(n)] + [pa.array(found[:, i].astype(np.int64)) for i in range(8)], [*names, "n", *L.NAMES])

    kinds = dict(rows.dtypes)
    schema = ", ".join([f"{c} {kinds[c]}" for c in names] + [f"{c} long" for c in ("n", *L.NAMES)])
    parts = rows.mapInArrow(partial, schema).groupBy(*names).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *L.total())
    return parts.select(*[F.col(f"by{i}").alias(c) for i, c in enumerate(by)], "n", *L.NAMES)
