"""Item hash with XXH3: 128 bits widened to a key of 256, for items that need speed and no security.

Items of up to 240 bytes, which XXH3 mixes in a few fixed steps, are hashed as arrays, all items of a length class of an Arrow batch at once; longer ones, where a call costs little beside the item, go to
the hash's own library one by one. Products of 64 bits are put together from halves, as arrays have no wider numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.functions import lanes as L

# The hash's default secret and its primes.
SECRET = bytes.fromhex(
    "b8fe6c3923a44bbe7c01812cf721ad1cded46de9839097db7240a4a4b7b3671fcb79e64eccc0e578825ad07dccff7221b8084674f743248ee03590e6813a264c"
    "3c2852bb91c300cb88d0658b1b532ea371644897a20df94e3819ef46a9deacd8a8fa763fe39c343ff9dcbbc7c70b4f1d8a51e04bcdb45931c89f7ec9d9787364"
    "eac5ac8334d3ebc3c581a0fffa1363eb170ddd51b7f0da49d316552629d4689e2b16be587d47a1fc8ff8b8d17ad031ce45cb3a8f95160428afd7fbcabb4b407e"
)
P32_1, P32_2, P32_3 = 0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D
P64_1, P64_2, P64_3, P64_4, P64_5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
PRIME_MX1, PRIME_MX2 = 0x165667919E3779F9, 0x9FB21C651E98DF25
#: The longest item that is hashed in arrays.
SHORT = 240
U = np.uint64


def _secret(at: int) -> int:
    return int.from_bytes(SECRET[at : at + 8], "little")


def _wide(a: np.ndarray, b: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Low and high half of products of 64-bit numbers."""
    b = np.asarray(b, U)
    low, shift = U(0xFFFFFFFF), U(32)
    a0, a1, b0, b1 = a & low, a >> shift, b & low, b >> shift
    mid = a1 * b0 + (a0 * b0 >> shift)
    cross = (mid & low) + a0 * b1
    return a * b, a1 * b1 + (mid >> shift) + (cross >> shift)


def _folded(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low, high = _wide(a, b)
    return low ^ high


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(37))) * U(PRIME_MX1)
    return x ^ (x >> U(32))


def _mixed_long(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * U(P64_2)
    x = (x ^ (x >> U(29))) * U(P64_3)
    return x ^ (x >> U(32))


class _Items:
    """Items of a length class: their bytes one after another, where each begins, and its length."""

    def __init__(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
        self.data, self.begin, self.size = data, begin, size  # data: the eight bytes from each place on, as a number
        self.n = size.astype(U)

    def bytes_at(self, at, count: int) -> np.ndarray:
        """Little-endian numbers of ``count`` bytes at a place of each item."""
        found = self.data[self.begin + at]
        return found if count == 8 else found & U((1 << 8 * count) - 1)

    def mix16(self, at, secret: int) -> np.ndarray:
        return _folded(self.bytes_at(at, 8) ^ U(_secret(secret)), self.bytes_at(at + 8, 8) ^ U(_secret(secret + 8)))

    def mix32(self, acc: list[np.ndarray], one, two, secret: int) -> None:
        acc[0] = (acc[0] + self.mix16(one, secret)) ^ (self.bytes_at(two, 8) + self.bytes_at(two + 8, 8))
        acc[1] = (acc[1] + self.mix16(two, secret + 16)) ^ (self.bytes_at(one, 8) + self.bytes_at(one + 8, 8))

    def ended(self, acc: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return _mixed(acc[0] + acc[1]), U(0) - _mixed(acc[0] * U(P64_1) + acc[1] * U(P64_4) + self.n * U(P64_2))


def _empty(x: _Items):
    return tuple(_mixed_long(np.full(len(x.n), _secret(a) ^ _secret(a + 8), U)) for a in (64, 80))


def _to_3(x: _Items):
    first, middle, last = x.bytes_at(0, 1), x.bytes_at(x.size >> 1, 1), x.bytes_at(x.size - 1, 1)
    low = first << U(16) | middle << U(24) | last | x.n << U(8)
    turned = low.astype(np.uint32).byteswap().astype(U)
    high = (turned << U(13) | turned >> U(19)) & U(0xFFFFFFFF)
    flips = [_secret(a) & 0xFFFFFFFF ^ _secret(a) >> 32 for a in (0, 8)]
    return _mixed_long(low ^ U(flips[0])), _mixed_long(high ^ U(flips[1]))


def _to_8(x: _Items):
    both = x.bytes_at(0, 4) + (x.bytes_at(x.size - 4, 4) << U(32))
    low, high = _wide(both ^ U(_secret(16) ^ _secret(24)), U(P64_1) + (x.n << U(2)))
    high = high + (low << U(1))
    low = low ^ (high >> U(3))
    low = (low ^ (low >> U(35))) * U(PRIME_MX2)
    return low ^ (low >> U(28)), _mixed(high)


def _to_16(x: _Items):
    one, two = x.bytes_at(0, 8), x.bytes_at(x.size - 8, 8)
    low, high = _wide(one ^ two ^ U(_secret(32) ^ _secret(40)), P64_1)
    low = low + ((x.n - U(1)) << U(54))
    two = two ^ U(_secret(48) ^ _secret(56))
    high = high + two + (two & U(0xFFFFFFFF)) * U(P32_2 - 1)
    low = low ^ high.byteswap()
    end, top = _wide(low, P64_2)
    return _mixed(end), _mixed(top + high * U(P64_2))


def _to_128(x: _Items):
    acc = [x.n * U(P64_1), np.zeros(len(x.n), U)]
    rounds = (int(x.size[0]) - 1) // 32  # the same for all items of a class
    for i in range(rounds, -1, -1):
        x.mix32(acc, 16 * i, x.size - 16 * (i + 1), 32 * i)
    return x.ended(acc)


def _to_240(x: _Items):
    acc = [x.n * U(P64_1), np.zeros(len(x.n), U)]
    for i in range(4):
        x.mix32(acc, 32 * i, 32 * i + 16, 32 * i)
    acc = [_mixed(a) for a in acc]
    for i in range(4, int(x.size[0]) // 32):
        x.mix32(acc, 32 * i, 32 * i + 16, 3 + 32 * (i - 4))
    x.mix32(acc, x.size - 16, x.size - 32, 136 - 17 - 16)
    return x.ended(acc)


#: For each way of mixing the lengths that it takes, in classes of lengths that take the same steps.
WAYS = [(_empty, 0, 0), (_to_3, 1, 3), (_to_8, 4, 8), (_to_16, 9, 16)]
WAYS += [(_to_128, max(17, 32 * i + 1), 32 * i + 32) for i in range(4)] + [(_to_240, max(129, 32 * i), min(SHORT, 32 * i + 31)) for i in range(4, 8)]


def hashes(items: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Low and high 64 bits of the hash of each item of a binary array without nulls."""
    items = items.cast(pa.large_binary())
    begin = np.frombuffer(items.buffers()[1], np.int64, len(items) + 1, 8 * items.offset) if len(items) else np.zeros(1, np.int64)
    held = items.buffers()[2] if len(items) else None
    data = np.frombuffer(held, np.uint8)[begin[0] : begin[-1]] if held is not None else np.empty(0, np.uint8)
    begin = begin - begin[0]
    size, padded = np.diff(begin), np.append(data, np.zeros(8, np.uint8))
    numbers = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    low, high = np.zeros(len(size), U), np.zeros(len(size), U)
    for way, least, most in WAYS:
        own = np.flatnonzero((size >= least) & (size <= most))
        if len(own):
            low[own], high[own] = way(_Items(numbers, begin[own], size[own]))
    for i in np.flatnonzero(size > SHORT):
        value = xxhash.xxh3_128_intdigest(data[begin[i] : begin[i + 1]])
        low[i], high[i] = value & 0xFFFFFFFFFFFFFFFF, value >> 64
    return low, high


def widened(items: pa.Array) -> pa.Array:
    """Keys of 32 bytes: low and high half of the hash, their XOR and their sum modulo 2^64, each little-endian; null items have none."""
    there = items.drop_null()
    low, high = hashes(there)
    key = np.stack([low, high, low ^ high, low + high], axis=1).astype("<u8")
    keys = pa.Array.from_buffers(pa.binary(32), len(there), [None, pa.py_buffer(key.tobytes())]).cast(pa.binary())
    if len(there) == len(items):
        return keys
    known = items.is_valid().to_numpy(zero_copy_only=False)
    return keys.take(pa.array(np.where(known, np.cumsum(known) - 1, 0), mask=~known))


def xxh3_key(item: Column) -> Column:
    """Key, as hex, of a binary or string column; null stays null. No such function is built in, so it runs on Arrow batches."""

    @F.arrow_udf("binary")
    def keys(items: pa.Array) -> pa.Array:
        return widened(items)

    return F.lower(F.hex(keys(item.cast("binary"))))


def without_items(digest: DataFrame, items: DataFrame, item: str) -> DataFrame:
    """One row (n, l0..l7): a digest (one row of the same) after its items of a column have been removed, one copy for each row; null items count for nothing."""
    from tallyfold.operators.bags import bag_digest

    gone = bag_digest(items.where(F.col(item).isNotNull()).select(xxh3_key(F.col(item)).alias("k")))
    rows = digest.select(F.col("n").alias("a_n"), *[F.col(n).alias(f"a_{n}") for n in L.NAMES]).crossJoin(gone)  # one row each
    return rows.select((F.col("a_n") - F.col("n")).alias("n"), *L.subtracted("a_", ""))
