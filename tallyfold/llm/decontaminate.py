"""Benchmark decontamination by winnowing, with DataFrame functions only.

A window is ``window`` consecutive words of a benchmark item; an item of fewer words is one window. A document
word is hit if it lies inside any occurrence of a window. Winnowing with ``gram`` words per hash and
``window - gram + 1`` hashes per sliding window keeps the smallest hash of each, so any shared span of at least ``window`` words shares a kept fingerprint. Document fingerprints are joined with
the benchmark's; each hit is extended to the windows around it, which are compared word for word. Windows
of shorter items go the same way with one hash per window.

A bitmap of bounded size (see sieve) tells nearly all document fingerprints apart from the benchmark's, so that one pass over the documents does, however large the
benchmark is (one more for each length of items shorter than a window, so ten at most), and documents are not shuffled: only one row for each document is, and the few words around each
fingerprint that may be the benchmark's. Whether the benchmark's side of the joins behind it is broadcast is Spark's choice by its size.

Defined results: null and empty texts have no words and no hits; null items have no windows; a null
item_id is hit but not listed; items of equal id count once; repeated document rows each keep a row of
their own; other columns are not read, so clashing names don't matter. Empty tables give empty or clean results.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm import sieve
from tallyfold.plans.recovery import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What lies between words: any ASCII character but digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words after lower-casing A-Z only; ``lower`` does that quickly where a text is pure ASCII."""
    whole = F.coalesce(text, F.lit(""))
    low = F.when(whole.rlike(r"[^\x00-\x7F]"), F.translate(whole, UPPER, LOWER)).otherwise(F.lower(whole))
    return F.array_remove(F.split(low, BETWEEN), "")


def _over(rows: DataFrame, name: str, length: int, mix: Callable[[Column, Column], Column]) -> DataFrame:
    """Replace array ``name`` by its combinations over ``length`` neighbours from each place on, in about
    log2(length) steps: ``mix`` joins two overlapping stretches. The last ``length - 1`` places stay incomplete."""
    span = 1
    while span < length:
        step = min(span, length - span)
        later = F.slice(name, step + 1, F.greatest(F.size(name) - step, F.lit(0)))
        rows, span = rows.withColumn(name, F.zip_with(name, later, mix)), span + step
    return rows


def _fingerprints(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """Adds array ``f``: for each start of a window, the smallest hash of the grams in it."""
    rows = rows.withColumn("f", F.transform("words", lambda x: F.xxhash64(x)))
    rows = _over(rows, "f", gram, lambda a, b: F.xxhash64(a, b))
    return _over(rows, "f", length - gram + 1, lambda a, b: F.least(a, b))


def benchmark_windows(benchmark: DataFrame, item: str, text: str, window: int) -> DataFrame:
    """Distinct windows: length, text, items (array)."""
    rows = benchmark.select(F.col(item).alias("item"), words_of(F.col(text)).alias("words"))
    rows = rows.select("item", "words", F.size("words").alias("n")).where("n > 0").withColumn("length", F.least("n", F.lit(window)))
    rows = rows.select("item", "words", "length", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("length"))).alias("s"))
    rows = rows.select("item", "length", F.slice("words", F.col("s") + 1, F.col("length")).alias("w"))
    return rows.groupBy("length", F.array_join("w", " ").alias("text")).agg(F.collect_set("item").alias("items"))


def _hits(docs: DataFrame, windows: DataFrame, length: int, gram: int, with_base: bool) -> DataFrame:
    """Verified occurrences (doc, th, n, s, items) of windows of one length; with_base: and one row, s = -1, for each document.

    A fingerprint stands for the run of windows that share it, from the first on; runs are cut every ``per_window``
    places, so each window starts less than ``per_window`` places after the start of its run's piece.
    """
    per_window, n, i = length - gram + 1, F.col("n"), F.col("i")
    first = -1 if with_base else 0
    rows = docs if with_base else docs.where(n >= length)
    rows = _fingerprints(rows, length, gram)
    rows = rows.select("doc", "th", "n", "words", "f", F.explode(F.sequence(F.lit(first), F.greatest(n - length, F.lit(first)))).alias("i"))
    rows = rows.select("doc", "th", "n", "words", "i", F.get("f", i).alias("own"), F.get("f", i - 1).alias("before"))
    rows = rows.where((i < 0) | (i % per_window == 0) | (F.col("own") != F.col("before")))
    prints = _fingerprints(windows.select(F.split("text", " ").alias("words")), length, gram).select(F.get("f", F.lit(0)).alias("bf")).distinct()
    prints = written(prints, "fingerprints")
    # A document's own row has a key of its own, so that all of them don't meet in one task.
    rows = rows.select("doc", "th", "n", "words", "i", F.when(i >= 0, F.col("own")).otherwise(F.xxhash64("doc", "th")).alias("own"))
    rows = sieve.may(rows, [F.col("own")], prints, [F.col("bf")], always=i < 0)
    around = F.when(i >= 0, F.slice("words", i + 1, per_window - 1 + length))
    rows = rows.select("doc", "th", "n", "i", "own", around.alias("words")).join(prints, F.col("own") == F.col("bf"), "left").where("i = -1 OR bf IS NOT NULL")
    starts = F.when(i == -1, F.array(F.lit(-1))).otherwise(F.sequence(i, F.least(i + (per_window - 1), n - length)))
    rows = rows.select("doc", "th", "n", "i", "words", F.explode(starts).alias("s"))
    span = F.when(F.col("s") >= 0, F.array_join(F.slice("words", F.col("s") - i + 1, length), " ")).otherwise(F.concat(F.lit("\n"), F.xxhash64("doc", "th").cast("string")))
    rows = rows.select("doc", "th", "n", "s", span.alias("span"))
    rows = rows.join(windows.select("text", "items"), F.col("span") == F.col("text"), "left").where("s = -1 OR text IS NOT NULL")
    return rows.select("doc", "th", "n", "s", F.lit(length).alias("length"), "items")


def contamination(
    docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    window: int = 10, gram: int = 4,
) -> DataFrame:
    """One row for each document: the id column, th (a hash of its text), n_words, spans (sorted starts and lengths of
    the windows found) and items (sorted texts of the distinct item ids)."""
    if not 0 < gram <= window:
        raise ValueError("gram has to be from 1 to window")
    windows = written(benchmark_windows(benchmark, item, item_text, window), "windows")
    lengths = {r["length"] for r in windows.select("length").distinct().collect()}  # at most ``window``
    rows = docs.select(F.col(doc).alias("doc"), F.xxhash64(text).alias("th"), words_of(F.col(text)).alias("words")).withColumn("n", F.size("words"))
    parts = []
    for length in sorted({window, *lengths}, reverse=True):
        own = windows.where(F.col("length") == length)
        parts.append(_hits(rows, own, length, gram if length == window else length, with_base=not parts))
    found = reduce(DataFrame.unionAll, parts).groupBy("doc", "th", "n").agg(
        F.array_sort(F.collect_set(F.when(F.col("s") >= 0, F.struct("s", "length")))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
        F.count_if(F.col("s") == -1).cast("int").alias("copies"),
    )
    found = found.withColumn("copies", F.explode(F.sequence(F.lit(1), "copies")))
    listed = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(F.col("doc").alias(doc), "th", F.col("n").cast("bigint").alias("n_words"), "spans", listed.alias("items"))


def digest(found: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The contract's columns from :func:`contamination`."""
    inside = F.flatten(F.transform("spans", lambda x: F.sequence(x["s"], x["s"] + x["length"] - 1)))
    rows = found.select(doc, "n_words", F.size(F.array_distinct(inside)).cast("bigint").alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return rows.withColumn("contaminated", F.col("n_hit") > 0)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """``docs``, all columns, without the documents that hold a benchmark window. The join is by id and
    text hash, of those documents alone that a bitmap of bounded size tells to be possibly contaminated."""
    name = sieve.apart(docs)
    d, h = name("doc"), name("th")
    bad = contamination(docs, benchmark, doc, text, **settings).where(F.size("spans") > 0).select(F.col(doc).alias(d), F.col("th").alias(h))
    bad = written(bad, "contaminated")
    th = F.xxhash64(F.col(text))
    may, never = sieve.split(docs, [F.col(doc), th], bad, [F.col(d), F.col(h)])
    return never.unionAll(may.join(bad, F.col(h).eqNullSafe(th) & F.col(d).eqNullSafe(F.col(doc)), "left_anti"))


def oracle(window: int = 10) -> str:
    """DuckDB SQL for :func:`digest` over ``documents`` and ``benchmark``, with every window compared."""
    split = lambda c: rf"regexp_extract_all(translate({c}, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce({split("text")}, []) AS w FROM documents),
    b AS (SELECT item_id, {split("text")} AS w FROM benchmark),
    bw AS (SELECT item_id, least(len(w), {window}) AS m, unnest(range(1, (len(w) - least(len(w), {window}) + 2)::BIGINT)) AS s, w FROM b WHERE len(w) > 0),
    win AS (SELECT DISTINCT item_id, m, array_to_string(w[s:s + m - 1], ' ') AS t FROM bw),
    dw AS (SELECT rn, m, s, array_to_string(w[s:s + m - 1], ' ') AS t
           FROM (SELECT rn, m, unnest(range(1, (len(w) - m + 2)::BIGINT)) AS s, w FROM d, (SELECT DISTINCT m FROM win) WHERE len(w) >= m)),
    hit AS (SELECT rn, dw.m, s, item_id FROM dw JOIN win USING (m, t)),
    cover AS (SELECT rn, count(DISTINCT p) AS n_hit FROM (SELECT rn, unnest(range(s, s + m)) AS p FROM hit) GROUP BY rn),
    ids AS (SELECT rn, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS l FROM hit GROUP BY rn)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
           sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN cover USING (rn) LEFT JOIN ids USING (rn)"""
