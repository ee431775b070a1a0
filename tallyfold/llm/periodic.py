"""Periodic runs: stretches of a text whose words repeat with a period, found through suffix trees, and texts without the repetitions.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and a length of at least max(``least``, 2q) that no neighbouring word extends keeping
period q. Each text has its own suffix tree, held as sorted suffixes with the lengths of what neighbours share; the trees of a slice of many texts are made together, by doubling, in which only
suffixes that are still tied are sorted again. At every inner node, of string depth q, the smaller half of the leaves is listed, and for each such leaf i the leaves i + q and i - q are looked for
in the other half: a pair of leaves q apart that part at depth q is a branching tandem repeat. Nodes with more than two children count as several of two, so each leaf is listed
log2(n) times at most. Every run ends with exactly one branching repeat of its period; rotating it to the left, word by word, as long as it repeats, gives the run's start, and repeats of
multiples of the period, which end at the same word, merge into the run.

Words are maximal stretches without ASCII white space and are compared as bytes, by exact numbers. Memory follows a slice of ``SLICE`` bytes, or one text that is longer.

Defined results: a null text counts as an empty one, and either has no runs and collapses to the empty text; repeated rows each have their own result; columns of ``docs`` are kept and not read
but for the text, so clashing names don't matter; one called ``periodic`` is replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm import bytecut

RESULT = "n_words long, runs array<struct<start:long, length:long, period:long>>, collapsed string"
#: Bytes of text whose trees are made at once; the arrays made for them take 40 times as much for prose and 160 for two words at random. How many leaves are listed at once.
SLICE, LISTED = 1 << 20, 1 << 20


@dataclass(frozen=True)
class Trees:
    """The suffix trees of some texts: ``suffixes`` in order, each one's place ``rank``, and ``shared``, how many words each has in common with the one before it."""

    suffixes: np.ndarray
    rank: np.ndarray
    shared: np.ndarray


def trees(words: np.ndarray) -> Trees:
    """words: numbers, texts one after another, no number in two texts, each text ending with a number that occurs once."""
    n = len(words)
    order = np.argsort(words)
    found = words[order]
    head = np.ones(n, bool)
    head[1:] = found[1:] != found[:-1]
    start = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = start
    made = np.where(head, 0, -1)  # at which level a suffix was told from the one before it
    levels, h = [rank], 1
    slots = np.flatnonzero(~(head & np.append(head[1:], True)))
    while len(slots):
        at = order[slots]
        key = start[slots] * n + rank[at + h]  # a tied suffix has more than h words
        by = np.argsort(key)
        at, key = at[by], key[by]
        new = np.ones(len(slots), bool)
        new[1:] = key[1:] != key[:-1]
        order[slots] = at
        made[slots[new & (made[slots] < 0)]] = len(levels)
        first = np.maximum.accumulate(np.where(new, slots, 0))
        start[slots] = first
        rank = rank.copy()
        rank[at] = first
        levels.append(rank)
        slots, h = slots[~(new & np.append(new[1:], True))], 2 * h
    # A suffix told apart at level k shares from 2^(k-1) to 2^k - 1 words; the levels below give the rest.
    shared = np.zeros(n, np.int64)
    some = np.flatnonzero(made > 0)
    size = np.left_shift(1, made[some] - 1)
    for k in range(len(levels) - 3, -1, -1):
        on = np.flatnonzero(made[some] - 2 >= k)
        there = some[on]
        on = on[levels[k][order[there] + size[on]] == levels[k][order[there - 1] + size[on]]]
        size[on] += 1 << k
    shared[some] = size
    return Trees(order, rank, shared)


def halves(shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(split, begin, end): the inner nodes, each with the places [begin, split) and [split, end) of the leaves of its two halves. Nodes of the depth 0 are left out."""
    low = np.append(shared, 0)
    split = np.flatnonzero(shared > 0)
    ends = []
    for step, behind in ((-1, False), (1, True)):
        far = np.arange(len(low)) + step
        on = split
        while len(on):
            other, own = low[far[on]], low[on]
            on = on[other >= own if behind else other > own]
            far[on] = far[far[on]]
        ends.append(far[split])
    return split, ends[0], ends[1]


def branching(t: Trees) -> tuple[np.ndarray, np.ndarray]:
    """(start, q) of all branching tandem repeats, sorted by their end and q."""
    split, begin, end = halves(t.shared)
    left = split - begin <= end - split
    first, size = np.where(left, begin, split), np.where(left, split - begin, end - split)
    low, high = np.where(left, split, begin), np.where(left, end, split)
    depth, total, n = t.shared[split], np.cumsum(size), len(t.rank)
    starts, periods, at = [], [], 0
    while at < len(split):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + LISTED, "right")))
        many = size[at:to]
        node = np.repeat(np.arange(at, to), many)
        leaf = t.suffixes[np.arange(len(node)) + np.repeat(first[at:to] - (np.cumsum(many) - many), many)]
        q, lo, hi = depth[node], low[node], high[node]
        for other, own in ((leaf + q, leaf), (leaf - q, leaf - q)):
            place = t.rank[np.clip(other, 0, n - 1)]
            found = np.flatnonzero((place >= lo) & (place < hi) & (other >= 0) & (other < n))
            starts.append(own[found])
            periods.append(q[found])
        at = to
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    i, q = np.concatenate(starts), np.concatenate(periods)
    by = np.lexsort((q, i + 2 * q))
    return i[by], q[by]


def rotated(words: np.ndarray, i: int, q: int) -> int:
    """Where the run with period ``q`` begins that has the repeat at ``i``. What lies before a text never equals a word of it."""
    width = 32
    while i:
        low = max(0, i - width)
        differ = np.flatnonzero(words[low:i] != words[low + q : i + q])
        if len(differ):
            return low + int(differ[-1]) + 1
        i, width = low, 2 * width
    return i


def maximal_runs(words: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(start, end, q) of all runs in texts as :func:`trees` takes them, by end and q."""
    out, last, reach = [], -1, 0
    starts, periods = branching(trees(words)) if len(words) else ((), ())
    for i, q in zip(map(int, starts), map(int, periods), strict=True):
        end = i + 2 * q
        if end != last:
            last, reach = end, end
        if i >= reach:
            continue  # a multiple of the period of a run that ends here
        start = rotated(words, i, q)
        reach = min(reach, start)
        if end - start >= max(least, 2 * q):
            out.append((start, end, q))
    return out


def _slice(column: pa.Array, least: int) -> pa.Array:
    data, begin = bytecut.flat(column)
    inside = ~bytecut.BLANK[data]
    new = bytecut.begins(inside, begin)
    at = np.flatnonzero(new)
    first = np.searchsorted(at, begin)  # the number of each text's first word
    texts = len(begin) - 1
    cut, rows, text_runs, dropped = np.diff(first), np.arange(texts), [[] for _ in range(texts)], []
    if len(at):
        offsets = np.append(np.flatnonzero(new[inside]), np.count_nonzero(inside))
        tokens = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]).dictionary_encode()
        many = len(tokens.dictionary) + 1
        # Each text's words, numbered apart from other texts', and after them its end.
        numbers = np.repeat(rows * many, cut + 1)
        ends = first[1:] + rows
        word = np.ones(len(numbers), bool)
        word[ends] = False
        numbers[word] += tokens.indices.to_numpy() + 1
        for start, end, q in maximal_runs(numbers, least):
            k = int(np.searchsorted(ends, start))
            base = int(first[k]) + k
            text_runs[k].append((start - base, end - start, q))
            dropped.append((start - k + q, end - k))
        for runs in text_runs:
            runs.sort(key=lambda r: (r[0], r[2]))
        stop = np.flatnonzero(bytecut.begins(inside[::-1], len(data) - begin[::-1])[::-1]) + 1
        kept = np.ones(len(at), bool)
        mask, shown = inside, data.copy()
        for a, b in dropped:
            kept[a:b] = False
            mask[at[a] : stop[b - 1]] = False
        gap = stop[kept & (stop < np.repeat(begin[1:], cut))]  # the white space after a word that stays
        mask[gap], shown[gap] = True, 0x20
        total = np.append(0, np.cumsum(mask))[begin]
        shown = shown[mask].tobytes()
        collapsed = [shown[a:b].rstrip(b" ") for a, b in zip(total[:-1].tolist(), total[1:].tolist(), strict=True)]
    else:
        collapsed = [b""] * texts
    flat = np.array([x for runs in text_runs for r in runs for x in r], np.int64).reshape(-1, 3)
    fields = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], ["start", "length", "period"])
    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, text_runs)]), pa.int32()), fields)
    return pa.StructArray.from_arrays([pa.array(cut, pa.int64()), lists, pa.array(collapsed, pa.binary()).view(pa.string())], ["n_words", "runs", "collapsed"])


def find_runs(docs: DataFrame, text: str = "text", least: int = 12) -> DataFrame:
    """``docs`` with one struct column ``periodic``: n_words, runs (start, length and period in words, by start and period) and collapsed, the text, words joined by one
    space, less the words that a run contains after its first period."""

    @F.arrow_udf(RESULT)
    def found(texts: pa.Array) -> pa.Array:
        parts = [_slice(texts.slice(a, b - a), least) for a, b in bytecut.parts(texts, SLICE)]
        return pa.concat_arrays(parts) if parts else _slice(texts, least)

    return docs.withColumn("periodic", found(F.col(text)))


def split_words(text: Column) -> Column:
    """The words of a text, as an array; none of a null one."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def planted(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(the id column, the text column): of the documents whose h = crc32 of their id as text is divisible by 10, each word from number a = g % n on is replaced by number a + (i - a) % p, g being h // 10,
    n the number of words and p = 1 + (n - a) // (3 + g % 8). Documents without words, without an id, and all others stay as they are."""
    h = F.crc32(F.col(doc).cast("string"))
    rows = docs.select(F.col(doc), F.col(text), F.floor(h / 10).alias("g"), F.when(h % 10 == 0, split_words(F.col(text))).alias("w")).withColumn("n", F.size("w"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", F.floor((F.col("n") - F.col("a")) / (F.col("g") % 8 + 3)).cast("int") + 1)
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    new = F.slice(F.concat(F.slice("w", F.lit(1), F.col("a")), F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), times))), F.lit(1), F.col("n"))
    return rows.select(doc, F.when(F.col("a").isNull(), F.col(text)).otherwise(F.array_join(new, " ")).alias(text))


def digest(found: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The contract's columns from :func:`find_runs`."""
    runs = F.col("periodic.runs")
    # The longest run, then the one that starts first, then the one with the smallest period.
    best = F.array_min(F.transform(runs, lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    rows = found.select(doc, F.size(runs).cast("long").alias("n_runs"), best.alias("b"), runs.alias("runs"), F.col("periodic.collapsed").alias("collapsed"))
    said = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    length = -F.col("b.less")
    return rows.select(
        doc, "n_runs", F.col("b.start").alias("start"), length.alias("length"), F.col("b.period").alias("period"),
        F.floor(1000 * length / F.col("b.period")).cast("long").alias("exponent_milli"), F.sha2(said, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
