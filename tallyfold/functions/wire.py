"""Sizes of messages of the synchronisation protocol, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def varint_size(n: Column) -> Column:
    """Bytes of a variable-length integer: seven bits a byte; negative numbers are an error."""
    size = F.when(n < 0, F.raise_error(F.lit("a varint is not negative")).cast("int"))
    for bytes_, bits in ((1, 7), (2, 14), (3, 21), (4, 28)):
        size = size.when(n < 1 << bits, bytes_)
    return size.otherwise(5)


def request_bytes(epoch: Column, position: Column) -> Column:
    return varint_size(epoch) + varint_size(position) + 32


def tail_bytes(epoch: Column, n: Column) -> Column:
    """Epoch, count, one bit and one key an operation."""
    return varint_size(epoch) + varint_size(n) + F.ceil(n / 8) + 32 * n


def fallback_bytes(epoch: Column, root_count: Column) -> Column:
    return varint_size(epoch) + 32 + varint_size(root_count)
