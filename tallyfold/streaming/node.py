"""A node that follows a stream of operations (pos, is_add, k): deletes of absent keys go as they arrive, and what is left is appended to a stored log and applied to a stored set.

How many copies of a key there are is the stream's state, a count for each key that is there, so it survives a restart with the stream's checkpoint. Inside a batch the operations of a key are taken in
the order of ``pos``; a later batch's operations come after an earlier one's, whatever their ``pos``. Operations with a null ``is_add`` or ``k`` fail the stream.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyfold.sources.keystore import KeyStore
from tallyfold.sources.logstore import LogStore

OPERATIONS = "pos long, is_add boolean, k string"
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def reflected(held: int, is_add: np.ndarray) -> tuple[np.ndarray, int]:
    """Which operations of one key have an effect, and how many copies there are then: a walk that can't go below zero."""
    walk = held + np.cumsum(np.where(is_add, 1, -1))
    after = walk - np.minimum(np.minimum.accumulate(walk), 0)
    before = np.append(held, after[:-1])
    return is_add | (before > 0), int(after[-1])


class Copies(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ops = pd.concat(list(rows), ignore_index=True)
        if ops[["is_add", "k"]].isna().to_numpy().any():
            raise ValueError("an operation needs a key and a kind")
        ops = ops.sort_values(["pos", "is_add"], ascending=[True, False], ignore_index=True)
        kept, held = reflected(self.held.get()[0] if self.held.exists() else 0, ops["is_add"].to_numpy(bool))
        if held:
            self.held.update((held,))
        else:
            self.held.clear()  # a key that is gone takes no room
        yield ops.loc[kept, ["pos", "is_add", "k"]]


def effective_stream(changes: DataFrame) -> DataFrame:
    """The stream less its deletes of absent keys, as an appending stream. It sets the session's state store to the one that such state needs."""
    changes.sparkSession.conf.set(*PROVIDER)
    return changes.select("pos", "is_add", "k").groupBy("k").transformWithStateInPandas(statefulProcessor=Copies(), outputStructType=OPERATIONS, outputMode="Append", timeMode="None")


def follower(log: LogStore, keys: KeyStore | None = None, share: float = 0.5) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` of an effective stream: appends each batch to ``log`` and applies it to ``keys``, whose buckets are rewritten when their changes have grown to ``share`` of their keys. A batch
    that runs again changes nothing where it counts already."""

    def follow(batch: DataFrame, number: int) -> None:
        log.append(batch, number)
        if keys is not None:
            keys.apply(batch, number)
            keys.compact(share)

    return follow


def opened(spark: SparkSession, folder: str) -> tuple[LogStore, KeyStore]:
    """A node's log and set in ``folder``, new ones if there are none."""
    from tallyfold.streaming.changelog import store

    log = LogStore(spark, f"{folder.rstrip('/')}/log")
    log = log if log.generation() >= 0 else LogStore.create(spark, log.folder)
    return log, store(spark, f"{folder.rstrip('/')}/set")
