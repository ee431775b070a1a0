"""Audit of how filters interact: what each removes in every order, what only it catches, and its Shapley share, from one aggregation of signed parity sums.

Each document has a mask: bit k says whether it fails filter k. With five filters there are 32 masks, and the table is aggregated once, to 32 signed sums per part and label: sum s adds
+1 for a document whose mask shares an even number of bits with s and -1 otherwise (the Walsh-Hadamard transform of the mask counts). The transform is its own inverse up to a division by 32,
which leaves no rest, so the count of each mask comes back exactly. All else follows from the 32 counts of a part: survivors of a set of filters are a sum of counts, a step
of an order is a difference of two such sums, and a filter's removals summed over all 120 orders are, in closed form, 120 / (failures of the mask) for each of its documents, as each of the
filters that a document fails comes first in an equal share of the orders.

Whether a text is a copy is told by the SHA-256 of texts, which stands for the texts: the least id of each hash is aggregated before the shuffle, and rows, not texts, are joined with
it, on exchanges that Spark can split where one text has a great share of all rows.

Defined results: null texts count as empty ones, null parts as the empty string; a document without an id fails E if a document with an id has its text, and otherwise is a first
one; repeated rows count each, and rows of the smallest id of a text all are first ones. A document has a label if any of its rows in the label table says so; labels of null ids and of unknown ones count
for nothing. Other columns aren't read. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.periodic import split_words
from tallyfold.plans.recovery import written

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
LABELS = ("all", "good", "toxic")


def content_mask(text: Column, words: Column) -> Column:
    """Bits 0 to 3: under 200 words; under half of the words distinct; more than 2 % of the characters in A-Z; any of the marks #$%&*|. words: the array of the text's words."""
    bit = lambda k, fails: F.when(fails, 1 << k).otherwise(0)
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return bit(0, F.size(words) < 200) + bit(1, 100 * F.size(F.array_distinct(words)) < 50 * F.size(words)) + bit(2, 100 * capitals > 2 * F.length(text)) + bit(3, text.rlike(r"[#$%&*|]"))


def masks(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", part: str = "source", good: str = "quality", toxic: str = "toxic") -> DataFrame:
    """(part, mask, good, toxic): one row a document; good and toxic are booleans."""
    whole = docs.select(F.col(doc).alias("doc"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    cut = whole.withColumn("words", split_words(F.col("t")))
    rows = written(cut.select("doc", "part", F.unhex(F.sha2("t", 256)).alias("h"), content_mask(F.col("t"), F.col("words")).alias("mask")), "failures")
    copies = rows.groupBy("h").agg(F.min("doc").alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = written(copies.select(F.col("h").alias("h2"), "first"), "copies")
    said = labels.where(F.col(doc).isNotNull()).groupBy(F.col(doc).alias("labelled")).agg(F.max(F.coalesce(F.col(good) == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col(toxic) == 1, F.lit(False))).alias("toxic"))
    said = written(said.where("good OR toxic"), "labels")
    copy = F.col("first").isNotNull() & (F.col("doc").isNull() | (F.col("doc") > F.col("first")))
    found = rows.join(copies, F.col("h") == F.col("h2"), "left").select("doc", "part", (F.col("mask") + F.when(copy, 16).otherwise(0)).alias("mask"))
    no = F.lit(False)
    return found.join(said, F.col("doc") == F.col("labelled"), "left").select("part", "mask", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))


def parity_sums(rows: DataFrame) -> DataFrame:
    """(part, label, w0..w31): the signed parity sums of the rows of :func:`masks`, by part and label (all, good, toxic)."""
    label = F.explode(F.array_compact(F.array(F.lit("all"), F.when(F.col("good"), "good"), F.when(F.col("toxic"), "toxic")))).alias("label")
    sign = lambda s: 1 - 2 * (F.bit_count(F.col("mask").bitwiseAND(F.lit(s))) % 2)
    return rows.select("part", "mask", label).groupBy("part", "label").agg(*[F.sum(sign(s)).cast("long").alias(f"w{s}") for s in range(MASKS)])


def _over_masks(value) -> Column:
    """An array with the sum over all masks m of value(s, m), for each s."""
    every = F.sequence(F.lit(0), F.lit(MASKS - 1))
    return F.transform(every, lambda s: F.aggregate(every, F.lit(0).cast("long"), lambda acc, m: acc + value(s, m)))


def mask_counts(sums: DataFrame) -> DataFrame:
    """(part, label, cells): how many documents have each mask, from their parity sums."""
    held = sums.select("part", "label", F.array(*[f"w{s}" for s in range(MASKS)]).alias("w"))
    sign = lambda s, m: 1 - 2 * (F.bit_count(s.bitwiseAND(m)) % 2)
    total = _over_masks(lambda m, s: F.get("w", s) * sign(s, m))
    return held.select("part", "label", F.transform(total, lambda x: F.call_function("div", x, F.lit(MASKS))).alias("cells"))


def orders(cells: DataFrame) -> DataFrame:
    """One row a part, order and step from the rows of :func:`mask_counts`."""
    none = F.array_repeat(F.lit(0).cast("long"), MASKS)
    parts = cells.groupBy("part").agg(*[F.coalesce(F.max(F.when(F.col("label") == x, F.col("cells"))), none).alias(x) for x in LABELS])
    alive = lambda x: _over_masks(lambda s, m: F.when(s.bitwiseAND(m) == 0, F.get(x, m)).otherwise(0))
    shares = _over_masks(lambda f, m: F.when(f.bitwiseAND(m) != 0, F.get("all", m) * F.call_function("div", F.lit(120), F.greatest(F.bit_count(m), F.lit(1)))).otherwise(0))
    parts = parts.select("part", "all", *[alive(x).alias(f"s_{x}") for x in LABELS], shares.alias("shares"))
    bit = {f: 1 << k for k, f in enumerate(FILTERS)}
    steps = [f"struct('{o}' AS filter_order, {k + 1} AS step, {bit[o[k]]} AS own, {sum(bit[f] for f in o[:k])} AS past)" for o in ORDERS for k in range(len(o))]
    rows = parts.withColumn("x", F.expr(f"explode(array({', '.join(steps)}))")).select("*", "x.*")
    past, now = F.col("past"), F.col("past") + F.col("own")
    removed = lambda x: F.get(f"s_{x}", past) - F.get(f"s_{x}", now)
    failing = F.get("s_all", F.lit(0)) - F.get("s_all", F.col("own"))
    return rows.select(
        "part", "filter_order", "step", F.get("s_all", now).alias("kept"), removed("all").alias("removed"), (failing - removed("all")).alias("redundant"),
        F.get("all", F.col("own")).alias("unique_fails"), removed("good").alias("good_lost"), removed("toxic").alias("toxic_lost"), F.get("shares", F.col("own")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """Per part, order of the five filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley. columns: names as of :func:`masks`."""
    return orders(mask_counts(written(parity_sums(masks(docs, labels, **columns)), "parity-sums")))


def oracle() -> str:
    """DuckDB SQL for :func:`audit` over ``documents`` and ``labels``: each order applied to each mask."""
    listed = ", ".join(f"'{o}'" for o in ORDERS)
    return rf"""
    WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
    l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
    f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, len(ws) < 200 AS a, 100 * len(list_distinct(ws)) < 50 * len(ws) AS b,
      100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
      first IS NOT NULL AND (w.doc_id IS NULL OR w.doc_id > first) AS e FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
    m AS (SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM f GROUP BY 1, 2),
    o AS (SELECT filter_order, unnest(range(1, 6))::INT AS step FROM (SELECT unnest([{listed}]) AS filter_order)),
    s AS (SELECT filter_order, step, list_sum(list_transform(string_split(filter_order[1:step - 1], ''), lambda z: CASE z WHEN 'A' THEN 1 WHEN 'B' THEN 2 WHEN 'C' THEN 4 WHEN 'D' THEN 8 WHEN 'E' THEN 16 ELSE 0 END))::INT AS past,
      (CASE filter_order[step] WHEN 'A' THEN 1 WHEN 'B' THEN 2 WHEN 'C' THEN 4 WHEN 'D' THEN 8 ELSE 16 END)::INT AS own FROM o),
    r AS (SELECT part, filter_order, step, own, sum(n) FILTER (mask & (coalesce(past, 0) | own) = 0) AS kept, sum(n) FILTER (mask & coalesce(past, 0) = 0 AND mask & own > 0) AS removed,
      sum(n) FILTER (mask & coalesce(past, 0) > 0 AND mask & own > 0) AS redundant, sum(n) FILTER (mask = own) AS unique_fails,
      sum(g) FILTER (mask & coalesce(past, 0) = 0 AND mask & own > 0) AS good_lost, sum(x) FILTER (mask & coalesce(past, 0) = 0 AND mask & own > 0) AS toxic_lost FROM m, s GROUP BY 1, 2, 3, 4),
    z AS (SELECT part, filter_order, step, own, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
      coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost FROM r)
    SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM z"""
