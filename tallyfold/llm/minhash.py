"""Near-duplicate documents by circulant MinHash, banding and exact verification.

A text's set is that of its distinct runs of ``shingle`` words. Two permutations make all signature coordinates: the
first spreads the shingles over a ring of 2^20 places, the second, shifted by one place for each
coordinate, ranks the places; the minimum rank over the set is the coordinate. Coordinates k of a
shingle are neighbours in the ranking, so a signature costs one contiguous slice a shingle.

Texts of equal sets are one class from the start, so copies never meet each other. Classes that share a
band are linked without listing all pairs: first each band's classes with its most popular
class; what these links join is one component; then, only in bands that still hold several
components, classes of different components with each other, passed on only if one-bit signatures of ``bits`` coordinates,
made for these classes alone, allow the similarity.
All links are confirmed on the full sets. A link that could join two components is thus lost only if no
band is shared, which at the threshold itself has a probability near 1e-6, or the one-bit estimate is off by 5 sigma; with
``bits`` 0 there is no estimate, and all pairs of different components in a band are compared on their full sets.

Defined results: null texts and texts without words have an empty set, are linked with nothing and are
kept; a text of fewer words than a shingle is one shingle; rows of the same id and text share their result, so both are
kept or neither; a null id is never the smallest. An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm import bytecut, sieve
from tallyfold.llm.components import components
from tallyfold.plans.recovery import written

RING_BITS = 20
SIGNED = "doc long, th long, n long, cls long, bands array<long>"


@dataclass(frozen=True)
class Settings:
    shingle: int = 2
    percent: int = 80
    bands: int = 44
    rows: int = 6
    bits: int = 4096
    seed: int = 7

    @property
    def banded(self) -> int:
        return self.bands * self.rows

    @property
    def most_apart(self) -> int:
        """Of the one-bit coordinates, how many differ at most at the threshold: half of 1 - similarity, and 5 sigma more."""
        p = (1 - self.percent / 100) / 2
        return int(self.bits * p + 5 * (self.bits * p * (1 - p)) ** 0.5)


def shingles(texts: pa.Array, s: Settings) -> Iterator[np.ndarray]:
    """The set of each text, as sorted hashes."""
    return (np.unique(bytecut.runs(words, s.shingle)) for words in bytecut.hashed(texts))


class Signer:
    """Signatures of ``length`` coordinates for one task: the ranking of the ring's places and the bands' multipliers."""

    def __init__(self, s: Settings, length: int) -> None:
        draw = np.random.default_rng(s.seed)
        ranks = draw.permutation(np.arange(1 << RING_BITS, dtype=np.uint32))
        self.ranks = np.lib.stride_tricks.sliding_window_view(np.concatenate([ranks, ranks[:length]]), length)
        self.s, self.length, self.times = s, length, draw.integers(1, 1 << 63, (s.bands, s.rows), np.uint64) * np.uint64(2) + np.uint64(1)
        self.spread = np.uint64(int(draw.integers(1, 1 << 63)) * 2 + 1)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        places = (shingles * self.spread) >> np.uint64(64 - RING_BITS)
        out = np.full(self.length, 0xFFFFFFFF, np.uint32)
        for at in range(0, len(places), 256):
            np.minimum(out, self.ranks[places[at : at + 256]].min(axis=0), out=out)
        return out

    def bands(self, signature: np.ndarray) -> np.ndarray:
        keys = (signature[: self.s.banded].reshape(self.s.bands, self.s.rows).astype(np.uint64) * self.times).sum(axis=1, dtype=np.uint64)
        return (keys ^ (keys >> np.uint64(31))).view(np.int64)

    def bits(self, signature: np.ndarray) -> np.ndarray:
        packed = np.packbits((signature & 1).astype(np.uint8))
        return np.concatenate([packed, np.zeros(-len(packed) % 8, np.uint8)]).view(np.int64)


def _lists(rows: list[np.ndarray | None]) -> pa.Array:
    sizes = [0 if r is None else len(r) for r in rows]
    flat = np.concatenate([np.empty(0, np.int64), *[r for r in rows if r is not None]])
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), flat)


def sign(docs: DataFrame, doc: str, text: str, s: Settings) -> DataFrame:
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(s, s.banded)
        for batch in batches:
            n, cls, bands = [], [], []
            for found in shingles(batch.column("text"), s):
                n.append(len(found))
                sig = signer.signature(found) if len(found) else None
                cls.append(None if sig is None else xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63))
                bands.append(None if sig is None else signer.bands(sig))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("th"), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), _lists(bands)],
                ["doc", "th", "n", "cls", "bands"],
            )
        bytecut.give_back()

    rows = docs.select(F.col(doc).cast("long").alias("doc"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    return rows.mapInArrow(signed, SIGNED)


def sketches(texts: DataFrame, s: Settings) -> DataFrame:
    """(cls, n, bits): set size and one-bit signature of each text. texts: (cls, text)."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(s, max(1, s.bits))
        for batch in batches:
            n, bits = [], []
            for found in shingles(batch.column("text"), s):
                n.append(len(found))
                bits.append(signer.bits(signer.signature(found)) if s.bits else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array(n, pa.int64()), _lists(bits)], ["cls", "n", "bits"])
        bytecut.give_back()

    return texts.select("cls", "text").mapInArrow(sketched, "cls long, n long, bits array<long>")


def verified(pairs: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """Those of ``pairs`` (a, b: classes) whose full sets are similar enough; texts: (cls, text)."""

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None, np.empty(0, np.uint64)
        for batch in batches:
            out, ta = [], batch.column("ta")
            pairs = zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), shingles(batch.column("tb"), s), strict=True)
            for i, (a, b, y) in enumerate(pairs):
                if before[0] != a:  # the pairs of a centre come one after the other
                    before = a, next(shingles(ta.slice(i, 1), s))
                x = before[1]
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= s.percent * (len(x) + len(y) - both):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], ["a", "b"])
        bytecut.give_back()

    at = lambda c: texts.select(F.col("cls").alias(c), F.col("text").alias(f"t{c}"))
    rows = pairs.join(at("b"), "b").join(at("a"), "a").select("a", "b", "ta", "tb")
    return rows.mapInArrow(alike, "a long, b long")


def links(signed: DataFrame, docs: DataFrame, doc: str, text: str, s: Settings) -> tuple[DataFrame, DataFrame]:
    """(classes, links): one row (cls, doc, th) for each class, doc being its smallest id, and confirmed links (a, b)."""
    first = signed.where("cls IS NOT NULL").groupBy("cls").agg(F.min(F.struct(F.coalesce("doc", F.lit((1 << 63) - 1)).alias("o"), "doc", "th")).alias("r"))
    classes = first.select("cls", "r.doc", "r.th")
    mine = F.col("c.cls").eqNullSafe(F.col("s.cls")) & F.col("c.doc").eqNullSafe(F.col("s.doc")) & F.col("c.th").eqNullSafe(F.col("s.th"))
    whole = signed.alias("s").join(classes.alias("c"), mine, "left_semi").select("cls", F.explode("bands").alias("key"))
    crowded = whole.groupBy("key").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi"), F.count("*").alias("c")).where("lo <> hi").select(F.col("key").alias("key2"), "c")
    shared = written(whole.join(crowded, F.col("key") == F.col("key2")).select("key", "cls", "c").dropDuplicates(["key", "cls"]), "bands")

    wanted = shared.select("cls").distinct().join(classes, "cls").select("cls", F.col("doc").alias("d"), F.col("th").alias("h"))
    wanted = written(wanted, "wanted")
    rows = docs.select(F.col(doc).cast("long").alias("doc"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    some = sieve.may(rows, [F.col("doc"), F.col("th")], wanted, [F.col("d"), F.col("h")])
    texts = some.join(wanted, F.col("doc").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h"))).select("cls", "text")
    # One row a class as it is written, so that nothing but exchanges stands below the joins with it and Spark can split a hot centre.
    texts = written(texts.dropDuplicates(["cls"]), "texts")

    popular = shared.groupBy("cls").agg(F.sum("c").alias("popular"))
    ranked = shared.select("key", "cls").join(popular, "cls")
    centre = ranked.groupBy("key").agg(F.max(F.struct("popular", "cls")).alias("m")).select(F.col("key").alias("key2"), F.col("m.cls").alias("a"))
    star = shared.select("key", "cls").join(centre, F.col("key") == F.col("key2")).where("cls <> a").select("a", F.col("cls").alias("b")).distinct()
    found = written(verified(written(star, "stars"), texts, s), "links")

    roots = components(found, "a", "b")
    named = shared.join(roots, F.col("cls") == F.col("node"), "left").select("key", "cls", F.coalesce("root", "cls").alias("root"))
    named = written(named, "named")
    open_keys = named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    left = written(named.join(open_keys, "key", "left_semi"), "open")
    own = left.groupBy("cls").agg(F.collect_set("key").alias("keys"))  # at most one key a band
    sketch = sketches(texts.join(own.select("cls"), "cls", "left_semi"), s)
    left = left.join(own, "cls").join(written(sketch, "sketches"), "cls")
    x, y = left.alias("x"), left.alias("y")
    apart = F.lit(0) + sum(F.bit_count(F.col("x.bits")[k].bitwiseXOR(F.col("y.bits")[k])) for k in range(-(-s.bits // 64)))
    sized = (F.col("x.n") * 100 >= F.col("y.n") * s.percent) & (F.col("y.n") * 100 >= F.col("x.n") * s.percent)
    once = F.array_min(F.array_intersect("x.keys", "y.keys")) == F.col("x.key")  # of the keys that two classes share, only the least
    cross = (F.col("x.key") == F.col("y.key")) & (F.col("x.cls") < F.col("y.cls")) & (F.col("x.root") != F.col("y.root")) & sized & (apart <= s.most_apart) & once
    more = x.join(y, cross).select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b"))
    return classes, found.unionAll(written(verified(written(more, "pairs"), texts, s), "links"))


def near_duplicates(docs: DataFrame, doc: str = "doc_id", text: str = "text", settings: Settings | None = None) -> DataFrame:
    """One row for each document: the id column, th (a hash of its text), n_shingles, component_id (the smallest id reachable, its own included) and kept."""
    s = settings or Settings()
    signed = written(sign(docs, doc, text, s), "signed")
    classes, linked = links(signed, docs, doc, text, s)
    roots = components(linked, "a", "b").select(F.col("node").alias("cls"), "root")
    named = classes.join(roots, "cls", "left").select("cls", "doc", F.coalesce("root", "cls").alias("root"))
    least = written(named.groupBy("root").agg(F.min("doc").alias("least")), "least")  # so that Spark can split a large component
    ids = named.join(least, "root").select(F.col("cls").alias("c2"), "least")
    rows = signed.select("doc", "th", "n", "cls").join(ids, F.col("cls") == F.col("c2"), "left")
    component = F.when(F.col("cls").isNull(), F.col("doc")).otherwise(F.col("least"))
    return rows.select(F.col("doc").alias(doc), "th", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col(doc).eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, doc: str = "doc_id", text: str = "text", settings: Settings | None = None) -> DataFrame:
    """``docs``, all columns, with one document of each component: that of the smallest id."""
    name = sieve.apart(docs)
    d, h = name("doc"), name("th")
    gone = near_duplicates(docs, doc, text, settings).where("NOT kept").select(F.col(doc).alias(d), F.col("th").alias(h))
    gone = written(gone, "duplicates")
    may, never = sieve.split(docs, [F.col(doc).cast("long"), F.xxhash64(F.col(text))], gone, [F.col(d).cast("long"), F.col(h)])
    return never.unionAll(may.join(gone, F.col(d).eqNullSafe(F.col(doc)) & F.col(h).eqNullSafe(F.xxhash64(F.col(text))), "left_anti"))
