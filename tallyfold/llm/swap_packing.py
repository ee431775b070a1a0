"""Packing of tokenized documents into as few fixed-size sequences as possible, by a local search that swaps documents between sequences.

A document longer than ``capacity`` tokens is cut every ``capacity`` tokens; all others stay whole. Pieces are dealt over groups of about ``group_rows`` by hash. In a group each piece goes,
in turn, to the fullest sequence that has room (best fit). Then sequences are emptied: the emptiest one gives tokens to each underfull one, fullest first, by the exchange that moves the most
tokens that fit there: a document moved, one exchanged for a shorter one, two for one or one for two. An exchange is made only if it makes the sum of squared fills larger,
so the search ends; it goes on until the sequence is empty or no exchange with any other is left, then with the next one, and ends for the group when as few sequences as the tokens
need are left, or when a turn of all sequences has emptied none. Which lengths two sequences can exchange is read off bitsets: bit x of one tells that a sequence has a document, or two together, of x tokens. A sequence has fewer than
about ``sqrt(2 * capacity)`` distinct lengths, however many documents it holds, so an exchange takes a bounded number of steps.

What is wasted is then about one sequence a group. So the ``reopened`` emptiest sequences of each group, with half of its rows at most, take part in a next round, in new groups, until one
group is left. Where documents are so short that so many rows fill few sequences, groups are larger, about ``group_bins`` sequences each: so a group has ``group_bins * capacity`` rows
at most (a million, of one token each). No group, and nothing in the driver, grows with the table.

Defined results: a null text is empty; an empty one has the end token alone, so every row has a piece; rows with equal ids are packed each on their own; null ids are
kept. An empty table gives no pieces. Only the named columns are read, so clashing names of others don't matter.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm import packing
from tallyfold.plans.recovery import reunited, written

PLACED = "doc long, row long, start long, length long, ids_crc32 long, sequence_id long, offset long, open boolean"
#: A sequence's number holds its round, its group and its number in the group, in so many bits.
GROUP_BITS, OWN_BITS = 34, 24


class Bin:
    """A sequence under construction: documents by length, and the bitsets of the lengths of one document and of two."""

    __slots__ = ("docs", "fill", "_one", "_two")

    def __init__(self) -> None:
        self.docs: dict[int, list[int]] = {}
        self.fill = 0
        self._one = self._two = None

    def add(self, length: int, doc: int) -> None:
        self.docs.setdefault(length, []).append(doc)
        self.fill += length
        self._one = self._two = None

    def take(self, length: int) -> int:
        held = self.docs[length]
        doc = held.pop()
        if not held:
            del self.docs[length]
        self.fill -= length
        self._one = self._two = None
        return doc

    @property
    def one(self) -> int:
        if self._one is None:
            self._one = sum(1 << x for x in self.docs)
        return self._one

    @property
    def two(self) -> int:
        if self._two is None:
            bits = 0
            for x, held in self.docs.items():
                bits |= self.one << x if len(held) > 1 else (self.one ^ (1 << x)) << x
            self._two = bits
        return self._two

    def parts(self, total: int) -> tuple[int, int]:
        """Two lengths that come to ``total``."""
        return next((x, total - x) for x, held in self.docs.items() if (y := total - x) in self.docs and (x != y or len(held) > 1))


def exchange(giver: Bin, taker: Bin, capacity: int) -> bool:
    """Makes the exchange that moves the most tokens from one sequence to the other and makes the sum of squared fills larger; false if there is none."""
    room = capacity - taker.fill
    least = max(1, giver.fill - taker.fill + 1)  # d tokens less make it larger by 2d(taker - giver + d)
    if room < least:
        return False
    window = (1 << room + 1) - 1
    best, given, taken = least - 1, (), ()
    found = (giver.one & window).bit_length() - 1
    if found > best:
        best, given, taken = found, (found,), ()
    for y in taker.docs:
        if best == room:
            break
        for bits, two in ((giver.one, False), (giver.two, True)):
            found = ((bits >> y) & window).bit_length() - 1
            if found > best:
                best, given, taken = found, giver.parts(y + found) if two else (y + found,), (y,)
    if best < room:
        for x in giver.docs:
            if x <= best:
                continue
            low = max(0, x - room)
            bits = (taker.two >> low) & ((1 << x - best - low) - 1)  # sums from x - room to x - best - 1
            if bits:
                total = low + (bits & -bits).bit_length() - 1
                best, given, taken = x - total, (x,), taker.parts(total)
    if not given:
        return False
    moved = [(x, giver.take(x)) for x in given]
    back = [(y, taker.take(y)) for y in taken]
    for x, doc in moved:
        taker.add(x, doc)
    for y, doc in back:
        giver.add(y, doc)
    return True


def best_fit(lengths: list[int], capacity: int) -> list[Bin]:
    """Each document, in turn, in the fullest sequence that has room."""
    bins, rooms, at = [], [], {}  # rooms: the distinct rooms of the sequences, in order; at: the sequences with each
    for doc, length in enumerate(lengths):
        k = bisect_left(rooms, length)
        if k < len(rooms):
            held = at[rooms[k]]
            b = held.pop()
            if not held:
                del at[rooms.pop(k)]
        else:
            b = Bin()
            bins.append(b)
        b.add(length, doc)
        if room := capacity - b.fill:
            if room not in at:
                insort(rooms, room)
                at[room] = []
            at[room].append(b)
    return bins


def emptied(bins: list[Bin], capacity: int) -> list[Bin]:
    """The sequences that are left after the search."""
    needed = -(-sum(b.fill for b in bins) // capacity)
    fewer = True
    while fewer and len(bins) > needed:
        fewer = False
        for giver in sorted(bins, key=lambda b: b.fill):
            takers = sorted((b for b in bins if b is not giver and b.fill < capacity), key=lambda b: -b.fill)
            moved = giver.fill < capacity
            while moved and giver.fill:
                moved = False
                for taker in takers:
                    while giver.fill and exchange(giver, taker, capacity):
                        moved = True
            if not giver.fill:
                bins, fewer = [b for b in bins if b is not giver], True
                if len(bins) == needed:
                    break
    return bins


def packed(lengths: list[int], capacity: int) -> list[Bin]:
    """Sequences of documents, numbered by their place in ``lengths``, at most ``capacity`` each."""
    return emptied(best_fit(lengths, capacity), capacity)


def _group(rows: pd.DataFrame, number: int, capacity: int, reopened: int) -> pd.DataFrame:
    """One group's pieces with their places; those of its emptiest sequences stay open."""
    rows = rows.sort_values(["row", "start"], ignore_index=True)
    lengths, group = rows["length"].to_numpy(), int(rows["g"].iloc[0])
    whole = np.flatnonzero(lengths == capacity)
    part = np.flatnonzero(lengths < capacity)
    sequence, offset, open_ = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.zeros(len(rows), bool)
    bins = packed(lengths[part].tolist(), capacity)
    sequence[whole] = np.arange(len(whole)) + len(bins)
    emptiest, held = set(), 0
    for b in sorted(bins, key=lambda b: b.fill)[:reopened]:
        held += sum(map(len, b.docs.values()))
        if b.fill < capacity and 2 * held <= len(rows):
            emptiest.add(id(b))
    for k, b in enumerate(bins):
        at = part[[doc for _, held in sorted(b.docs.items()) for doc in held]]
        sequence[at], open_[at] = k, id(b) in emptiest
        offset[at] = np.cumsum(lengths[at]) - lengths[at]
    rows["sequence_id"] = ((number << GROUP_BITS | group) << OWN_BITS) + sequence
    rows["offset"], rows["open"] = offset, open_
    return rows.drop(columns="g")


def _round(pieces: DataFrame, number: int, groups: int, capacity: int, reopened: int) -> DataFrame:
    dealt = pieces.withColumn("g", F.pmod(F.xxhash64(F.lit(number), "row", "start"), F.lit(groups)))
    return dealt.groupBy("g").applyInPandas(lambda rows: _group(rows, number, capacity, reopened), PLACED)


def pack(docs: DataFrame, tokenizer: str, doc: str = "doc_id", text: str = "text", capacity: int = 4096, end: int = 1, group_rows: int = 4096, group_bins: int = 256, reopened: int = 8) -> DataFrame:
    """One row for each piece: the id column, piece, start, length, ids_crc32, sequence_id and offset."""
    left = written(packing.pieces(docs, doc, text, tokenizer, capacity, end).select("doc", "row", "start", "length", "ids_crc32"), "pieces")
    done, number = [], 0
    while True:
        size = left.agg(F.count("*").alias("rows"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens")).first()
        groups = max(1, min(-(-size["rows"] // group_rows), -(-size["tokens"] // (group_bins * capacity))))
        placed = written(_round(left, number, groups, capacity, reopened if groups > 1 else 0), "placed")
        done.append(placed)
        if groups == 1:
            break
        left, number = placed.where("open").select("doc", "row", "start", "length", "ids_crc32"), number + 1
    piece = F.call_function("div", F.col("start"), F.lit(capacity)).cast("int").alias("piece")
    return reunited(done).where("NOT open").select(F.col("doc").alias(doc), piece, "start", "length", "ids_crc32", "sequence_id", "offset")
