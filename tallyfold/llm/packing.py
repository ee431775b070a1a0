"""Packing of tokenized documents into fixed-size sequences by minimum bin slack.

A document is cut every ``capacity`` tokens; full pieces are sequences of their own, and the rest of each
document (1 to capacity - 1 tokens) is a remainder. Only the number of remainders of each length, at
most capacity - 1 numbers, reaches the driver. There, again and again, the longest length left opens a window and a
bitset subset-sum dynamic programme over the lengths left picks the multiset that fills it closest to capacity;
backtracking gives its counts, and the pattern is used as often as the counts allow. Patterns give each
length ranges of ranks; a remainder's rank among those of its length decides its sequence and offset. Ranks
are found by groups of bounded size: a length with many remainders is dealt over groups by hash.

Defined results: a null text is empty; an empty one has the end token alone, so every row has a piece;
rows with equal ids are packed each on their own; null ids are kept. An empty table gives no pieces. Only the named columns are read.
"""

from __future__ import annotations

import array
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm import bytecut
from tallyfold.plans.recovery import written

PIECES = "doc long, row long, start long, length long, ids_crc32 long, doc_tokens long"
#: What a task remembers of pre-tokens and their ids, in bytes with the objects' own, in each of two generations; and the longest pre-token remembered.
REMEMBERED, LONGEST = 12 << 20, 40
OBJECTS = 180
#: Bytes of text cut at once; the arrays made for them take some thirty times as much.
SLICE = 1 << 20
#: Kinds of bytes. Runs of letters (A-Z, a-z and the two bytes of Latin-1 letters), single digits and runs of other marks are pre-tokens by themselves;
#: what lies between white space and holds anything else (an apostrophe may begin a contraction, < a special token) is encoded as a whole.
SPACE, LETTER, DIGIT, MARK, OTHER = range(5)
KINDS = np.full(256, OTHER, np.uint8)
KINDS[np.flatnonzero(bytecut.BLANK)] = SPACE
KINDS[0x21:0x7F] = MARK
KINDS[[0x27, 0x3C]] = OTHER
KINDS[0x30:0x3A] = DIGIT
KINDS[0x41:0x5B] = KINDS[0x61:0x7B] = LETTER


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it is visible, else the next one from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Token ids of whole texts. White space separates pre-tokens in this kind of vocabulary and is dropped, so a text's ids are those
    of its pre-tokens in turn. Texts are cut as bytes, many at once, and only the distinct pre-tokens of a slice are looked up."""

    def __init__(self, path: str, end: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism here
        from tokenizers import Tokenizer

        self.tokenizer, self.end, self.letters = Tokenizer.from_file(path), np.array([end], np.uint32), byte_letters()
        self.tokenize = self.tokenizer.model.tokenize
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.held = 0

    def _remember(self, piece: bytes, ids: bytes) -> None:
        if len(piece) <= LONGEST:
            self.known[piece] = ids
            self.held += len(piece) + len(ids) + OBJECTS
            if self.held > REMEMBERED:
                self.known, self.older, self.held = {}, self.known, 0

    def _looked_up(self, pieces: list[bytes], plain: np.ndarray) -> list[bytes]:
        """The ids of distinct pre-tokens; plain tells runs of small letters."""
        out = list(map(self.known.get, pieces))
        for i in [i for i, ids in enumerate(out) if ids is None]:
            piece = pieces[i]
            ids = self.older.get(piece)
            if ids is None and plain[i]:
                ids = array.array("I", [t.id for t in self.tokenize(piece.decode("latin-1").translate(self.letters))]).tobytes()
            elif ids is None:
                ids = array.array("I", self.tokenizer.encode(piece.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes()
            self._remember(piece, ids)
            out[i] = ids
        return out

    def _slice(self, column: pa.Array) -> Iterator[np.ndarray]:
        data, begin = bytecut.flat(column)
        kind = KINDS[data]
        lead = np.flatnonzero(data[:-1] == 0xC3)
        follow = data[lead + 1]
        lead = lead[(follow >= 0x80) & (follow <= 0xBF) & (follow != 0x97) & (follow != 0xB7)]
        kind[lead] = kind[lead + 1] = LETTER
        inside = kind != SPACE
        new = bytecut.begins(inside, begin)
        # What is encoded as a whole: stretches between spaces that hold a byte of another kind.
        whole, strange = None, np.flatnonzero(kind == OTHER)
        if len(strange):
            first, end = np.flatnonzero(new), np.flatnonzero(bytecut.begins(inside[::-1], len(data) - begin[::-1])[::-1]) + 1
            odd = np.unique(np.searchsorted(first, strange, "right") - 1)
            step = np.zeros(len(data) + 1, np.int8)
            step[first[odd]] += 1
            step[end[odd]] -= 1
            whole = np.cumsum(step[:-1], dtype=np.int8).view(bool)
        starts = kind == DIGIT
        starts[1:] |= kind[1:] != kind[:-1]
        starts &= inside
        low = bytecut.LOWER[data]
        low[(kind == LETTER) & (data >= 0x80) & (data <= 0x9E)] += 32
        if whole is not None:
            starts &= ~whole
            low = np.where(whole, data, low)
        starts |= new
        at = np.flatnonzero(starts)
        if not len(at):
            yield from (self.end for _ in range(len(column)))
            return
        offsets = np.append(np.flatnonzero(starts[inside]), np.count_nonzero(inside))
        tokens = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(low[inside])]).dictionary_encode()
        index = tokens.indices.to_numpy()
        plain = np.zeros(len(tokens.dictionary), bool)
        plain[index] = kind[at] == LETTER if whole is None else (kind[at] == LETTER) & ~whole[at]
        found = self._looked_up(tokens.dictionary.to_pylist(), plain)
        ids = np.frombuffer(b"".join(found), np.uint32)
        size = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        sizes = size[index]
        ends = np.cumsum(sizes)
        ids = ids[np.repeat((np.cumsum(size) - size)[index] - (ends - sizes), sizes) + np.arange(ends[-1])]
        cut = np.append(0, ends)[np.searchsorted(at, begin)].tolist()
        yield from (np.append(ids[a:b], self.end) for a, b in zip(cut[:-1], cut[1:], strict=True))

    def all(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of a column, in turn, with the end token."""
        for at, end in bytecut.parts(column, SLICE):
            yield from self._slice(column.slice(at, end - at))

    def __call__(self, text: str) -> np.ndarray:
        return next(self.all(pa.array([text], pa.string())))


def pieces(docs: DataFrame, doc: str, text: str, tokenizer: str, capacity: int, end: int, with_ids: bool = False) -> DataFrame:
    """One row a piece, in no order; ``row`` tells rows of equal ids apart. with_ids adds the ids themselves."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer, end)
        for batch in batches:
            out: list[list] = [[] for _ in range(6 + with_ids)]
            for d, r, ids in zip(batch.column("doc").to_pylist(), batch.column("row").to_pylist(), encode.all(batch.column("text")), strict=True):
                for at in range(0, len(ids), capacity):
                    own = ids[at : at + capacity]
                    for column, value in zip(out, (d, r, at, len(own), zlib.crc32(own.astype("<u4").tobytes()), len(ids), own), strict=False):
                        column.append(value)
            names = ["doc", "row", "start", "length", "ids_crc32", "doc_tokens"]
            arrays = [pa.array(c, pa.int64()) for c in out[:6]] + ([pa.array(out[6], pa.list_(pa.int64()))] if with_ids else [])
            yield pa.RecordBatch.from_arrays(arrays, names + ["ids"] * with_ids)
        del encode
        bytecut.give_back()

    rows = docs.select(F.col(doc).cast("long").alias("doc"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"))
    return rows.mapInArrow(cut, PIECES + ", ids array<long>" * with_ids)


def best_filling(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths, at most ``counts`` of each, with the largest sum up to ``capacity``. Bit s of a set
    is on if some multiset sums to s; sets after each length are kept for backtracking, and the search ends once the capacity is reached."""
    mask, reach, stages = (1 << capacity + 1) - 1, 1, []
    for length in sorted((x for x in counts if counts[x] and x <= capacity), reverse=True):
        before, left, part = reach, min(counts[length], capacity // length), 1
        while left:
            take = min(part, left)
            reach |= (reach << take * length) & mask
            left, part = left - take, part * 2
        stages.append((length, before))
        if reach >> capacity & 1:
            break
    total, picked = reach.bit_length() - 1, {}
    for length, before in reversed(stages):
        n = next(n for n in range(counts[length] + 1) if total >= n * length and before >> total - n * length & 1)
        if n:
            picked[length], total = n, total - n * length
    return picked


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(times, pattern) until nothing is left; each use of a pattern uses up at least one length, or as much as allows one use."""
    left, out = {k: v for k, v in counts.items() if v}, []
    while left:
        longest = max(left)
        rest = left | {longest: left[longest] - 1}
        pattern = best_filling(rest, capacity - longest)
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(left[x] // n for x, n in pattern.items())
        for x, n in pattern.items():
            left[x] -= times * n
            if not left[x]:
                del left[x]
        out.append((times, pattern))
    return out


def ranges(patterns: list[tuple[int, dict[int, int]]], first_sequence: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, how many in a sequence, first sequence, offset) for each length of each pattern."""
    used, out, sequence = {}, [], first_sequence
    for times, pattern in patterns:
        at = 0
        for length, n in sorted(pattern.items(), reverse=True):
            out.append((length, used.get(length, 0), n, sequence, at))
            used[length] = used.get(length, 0) + times * n
            at += length * n
        sequence += times
    return sorted(out)


def pack(
    docs: DataFrame, tokenizer: str, doc: str = "doc_id", text: str = "text", capacity: int = 2048, end: int = 1, with_ids: bool = False, group_rows: int = 1_000
) -> DataFrame:
    """One row for each piece: the id column, start, length, ids_crc32, doc_tokens, sequence_id and offset; ids too, if asked for."""
    cut = written(pieces(docs, doc, text, tokenizer, capacity, end, with_ids), "pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    full = counts.pop(capacity, 0)
    table = ranges(plan(counts, capacity), full)
    many = {k: -(-v // group_rows) for k, v in [*counts.items(), (capacity, full)]}
    # Groups of a length: as many as its rows need. The array has one entry for each length up to capacity.
    groups = F.element_at(F.array(*[F.lit(many.get(k, 1) or 1) for k in range(1, capacity + 1)]), F.col("length").cast("int"))
    dealt = cut.withColumn("g", F.pmod(F.xxhash64("doc", "row", "start"), groups))
    sums = dealt.groupBy("length", "g").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col("length").alias("l2"), F.col("g").alias("g2"), before.alias("before"))
    local = F.row_number().over(Window.partitionBy("length", "g").orderBy("doc", "row", "start")) - 1
    ranked = dealt.withColumn("local", local).join(sums, (F.col("length") == F.col("l2")) & (F.col("g") == F.col("g2"))).withColumn("rank", F.col("local") + F.col("before"))

    columns = np.array(table, np.int64).reshape(-1, 5)

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length, rank):
        import pandas as pd

        n, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        keys = columns[:, 0] << 44 | columns[:, 1]
        whole = n == capacity
        row = columns[np.where(whole, 0, np.searchsorted(keys, n << 44 | r, "right") - 1)] if len(columns) else np.ones((len(n), 5), np.int64)
        k = r - row[:, 1]
        return pd.DataFrame({"sequence_id": np.where(whole, r, row[:, 3] + k // row[:, 2]), "offset": np.where(whole, 0, row[:, 4] + k % row[:, 2] * n)})

    rows = ranked.withColumn("place", placed("length", "rank"))
    return rows.select(F.col("doc").alias(doc), "start", "length", "ids_crc32", "doc_tokens", "place.sequence_id", "place.offset", *["ids"] * with_ids)
