"""Digest values: eight lanes, each a sum modulo its own prime below 2^32, as BIGINT columns l0 to l7.

A digest is commutative and invertible: union of bags adds digests, difference subtracts them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The moduli, lane 0 first.
MODULI = (4294967291, 4294967279, 4294967231, 4294967197, 4294967189, 4294967161, 4294967143, 4294967111)
NAMES = tuple(f"l{i}" for i in range(8))


def key_hex(*parts: Column) -> Column:
    """SHA-256, as hex, of a row's canonical text: each part's length and text, nulls marked, so no two rows share a text."""
    encoded = [F.coalesce(F.concat(F.length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")), F.lit("-")) for p in parts]
    return F.sha2(F.concat_ws("|", *encoded), 256)


def quarters(h: Column) -> list[Column]:
    """Columns q0 to q3: 64 bits each of a 64-digit hex key; other lengths are an error. They come first, in a select of their own, so that a key is hashed and parsed once."""
    whole = F.when(F.length(h) == 64, h).otherwise(F.raise_error(F.lit("a key has 32 bytes")))
    return [F.conv(F.substring(whole, 16 * i + 1, 16), 16, -10).cast("bigint").alias(f"q{i}") for i in range(4)]


def packed(h: Column) -> Column:
    """A key of 64 lower-case hex digits as 32 bytes, for shuffles. Any other text keeps its bytes and gets 33 more, so that it can't be taken for such a key; null stays null."""
    raw = F.unhex(h)
    return F.when((F.length(h) == 64) & (F.lower(h) == h) & raw.isNotNull(), raw).otherwise(F.concat(h.cast("binary"), F.lit(bytes(33))))


def unpacked(b: Column) -> Column:
    """The key of :func:`packed`."""
    return F.when(F.octet_length(b) == 32, F.lower(F.hex(b))).otherwise(F.substring(b, F.lit(1), F.octet_length(b) - 33).cast("string"))


def swapped(x: Column) -> Column:
    """A number of 32 bits with its four bytes in reverse order."""
    part = lambda shifted, mask: shifted.bitwiseAND(F.lit(mask))
    return part(F.shiftright(x, 24), 0xFF).bitwiseOR(part(F.shiftright(x, 8), 0xFF00)).bitwiseOR(part(F.shiftleft(x, 8), 0xFF0000)).bitwiseOR(part(F.shiftleft(x, 24), 0xFF000000))


def lanes_of(quarter: list[Column]) -> list[Column]:
    """Reduced lanes from the columns of :func:`quarters`."""
    halves = [half for q in quarter for half in (F.shiftrightunsigned(q, 32), q.bitwiseAND(F.lit(0xFFFFFFFF)))]
    return [(swapped(x) % m).alias(n) for x, m, n in zip(halves, MODULI, NAMES, strict=True)]


def lanes(h: Column) -> list[Column]:
    """Reduced lanes of a 64-digit hex key; other lengths are an error. For many rows, ``with_lanes`` parses a key once."""
    return lanes_of(quarters(h))


def read_hex(h: Column) -> list[Column]:
    """Lanes of a serialized digest as they are, without reduction; other lengths are an error."""
    halves = [half for q in quarters(h) for half in (F.shiftrightunsigned(q, 32), q.bitwiseAND(F.lit(0xFFFFFFFF)))]
    return [swapped(x).alias(n) for x, n in zip(halves, NAMES, strict=True)]


def read_binary(b: Column) -> list[Column]:
    """Lanes of a serialized digest of 32 bytes as they are, without reduction."""
    return read_hex(F.lower(F.hex(b)))


def digest_hex(prefix: str = "") -> Column:
    """Wire form of the lanes in columns ``prefix`` + l0.. as lowercase hex."""
    plain = [F.lpad(F.lower(F.hex(F.col(prefix + n))), 8, "0") for n in NAMES]
    return F.concat(*[F.concat(*[F.substring(p, at, 2) for at in (7, 5, 3, 1)]) for p in plain])


def digest_binary(prefix: str = "") -> Column:
    """Wire form of the lanes: 32 bytes."""
    return F.unhex(digest_hex(prefix))


def added(a: str, b: str) -> list[Column]:
    return [((F.col(a + n) + F.col(b + n)) % m).alias(n) for n, m in zip(NAMES, MODULI, strict=True)]


def subtracted(a: str, b: str) -> list[Column]:
    return [F.pmod(F.col(a + n) - F.col(b + n), F.lit(m)).alias(n) for n, m in zip(NAMES, MODULI, strict=True)]


def negated(a: str = "") -> list[Column]:
    return [F.pmod(-F.col(a + n), F.lit(m)).alias(n) for n, m in zip(NAMES, MODULI, strict=True)]


def is_empty(prefix: str = "") -> Column:
    out = F.lit(True)
    for n in NAMES:
        out = out & (F.col(prefix + n) == 0)
    return out


def total(sign: Column | None = None) -> list[Column]:
    """Aggregates of lane columns. Halves of 16 bits are summed apart, so 2^46 rows fit a group; one modulo follows at the end."""
    out = []
    for n, m in zip(NAMES, MODULI, strict=True):
        s = F.lit(1) if sign is None else sign
        low, high = (F.coalesce(F.sum(x * s), F.lit(0)) for x in (F.col(n).bitwiseAND(F.lit(65535)), F.shiftright(F.col(n), 16)))
        out.append(F.pmod(F.pmod(high, F.lit(m)) * 65536 + F.pmod(low, F.lit(m)), F.lit(m)).alias(n))
    return out
