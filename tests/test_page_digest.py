"""xxh3_digest at more than one size against the hash's own library."""

import struct

import duckdb
import pytest
import xxhash

from tallyfold import queries as core
from tallyfold.functions.lanes import MODULI


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_page_digest(spark, sf):
    lanes, pages = [0] * 8, duckdb.sql(f"SELECT coalesce(html, '') FROM read_parquet('/root/testdata/{sf}/pages.parquet')").fetchall()
    for (html,) in pages:
        value = xxhash.xxh3_128_intdigest(html.encode())
        a, b = value & (1 << 64) - 1, value >> 64
        key = struct.pack("<4Q", a, b, a ^ b, (a + b) & (1 << 64) - 1)
        lanes = [(x + y) % m for x, y, m in zip(lanes, struct.unpack("<8I", key), MODULI, strict=True)]
    assert tuple(core.xxh3_digest(spark, f"/root/testdata/{sf}").first()) == (len(pages), struct.pack("<8I", *lanes).hex())
