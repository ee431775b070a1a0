"""Streams of changes (pos, is_add, k): digests that follow them, and stored sets to which they are applied.

A digest is a sum, so a streaming aggregate keeps it exactly, with a state of one row a group however long the stream is. A stored set gets each batch as changes beside its keys (see
``sources.keystore``), so a batch writes in proportion to itself, and one that runs again after a lost driver changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.functions import lanes as L
from tallyfold.operators import oplog
from tallyfold.operators.bags import with_lanes
from tallyfold.plans.recovery import numbered
from tallyfold.sources.keystore import KeyStore


def running_total(changes: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by.., n, l0..l7) of a stream: how many copies are held, and their digest, after all changes so far. For the output modes ``complete`` and ``update``."""
    sign = oplog.sign().cast("long")
    return with_lanes(changes).groupBy(*by).agg(F.coalesce(F.sum(sign), F.lit(0)).alias("n"), *L.total(sign))


def store(spark: SparkSession, folder: str, **settings) -> KeyStore:
    """The set in ``folder``; a new, empty one if there is none. settings: of :meth:`KeyStore.create`."""
    if numbered(spark, f"{folder.rstrip('/')}/sums/base", "upto"):
        return KeyStore.open(spark, folder)
    return KeyStore.create(spark.createDataFrame([], "k string"), folder, **settings)


def applier(folder: str, share: float = 0.5, **settings) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` of a stream (pos, is_add, k): applies a batch to the set in ``folder``. The last change of a key in a batch decides, by ``pos``. Buckets are rewritten when their
    changes have grown to ``share`` of their keys."""

    def apply(batch: DataFrame, number: int) -> None:
        held = store(batch.sparkSession, folder, **settings)
        held.apply(batch, number)
        held.compact(share)

    return apply
