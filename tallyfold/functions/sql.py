"""The digest's functions for use in SQL, as temporary functions of a session whose bodies are built-in functions, so that they are inlined into a query's plan."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tallyfold.functions.lanes import MODULI, NAMES

_BYTES = "conv(concat(" + ", ".join(f"substring(k, 8 * i + {at}, 2)" for at in (7, 5, 3, 1)) + "), 16, 10)"
_HEX = ", ".join(f"substring(lpad(lower(hex({n})), 8, '0'), {at}, 2)" for n in NAMES for at in (7, 5, 3, 1))
_VARINT = "CASE WHEN n < 0 THEN raise_error('a varint is not negative') " + " ".join(f"WHEN n < {1 << 7 * b} THEN {b}" for b in (1, 2, 3, 4)) + " ELSE 5 END"

#: Name, parameters, result and body.
FUNCTIONS = (
    ("digest_lane", "k STRING, i INT", "BIGINT", f"CASE WHEN length(k) = 64 THEN CAST({_BYTES} AS BIGINT) % element_at(array({', '.join(f'{m}L' for m in MODULI)}), i + 1) ELSE raise_error('a key has 32 bytes') END"),
    ("digest_hex", ", ".join(f"{n} BIGINT" for n in NAMES), "STRING", f"concat({_HEX})"),
    ("digest_prefix", "k STRING, depth INT", "BIGINT", "CASE WHEN depth = 0 THEN 0 WHEN depth BETWEEN 1 AND 64 THEN shiftrightunsigned(CAST(conv(substring(k, 1, 16), 16, -10) AS BIGINT), 64 - depth) ELSE raise_error('a prefix has from 0 to 64 bits') END"),
    ("varint_size", "n BIGINT", "INT", f"CAST({_VARINT} AS INT)"),
)


def register(spark: SparkSession) -> list[str]:
    """Creates ``digest_lane(k, i)``, ``digest_hex(l0, .., l7)``, ``digest_prefix(k, depth)`` and ``varint_size(n)`` in the session; returns their names.

    A table's digest is then ``digest_hex(sum(digest_lane(k, 0)) % 4294967291, ..)``."""
    for name, parameters, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return [f[0] for f in FUNCTIONS]
