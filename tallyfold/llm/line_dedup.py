"""Line deduplication through a deletion-neighbourhood join, with DataFrame functions only.

Lines are cut at line ends and trimmed; words of a line are cut at single spaces. A line goes if an earlier line, in
order of (document id, line number), is equal to it or, for lines of at least ``min_words`` words, one word edit away (a
word replaced, inserted or deleted). Blank lines stay.

Equal lines are matched by two 64-bit hashes. Of the distinct lines, only those that share their first or
last half with another can be within one edit (an edit leaves one half whole), so only they go on: each emits, as
hashed keys, itself and its variants with one word deleted, where the half that it shares leaves room for an edit. A deleted word's place is part of the key for
replacements, which are joined with deletions at the same place; for insertions a whole line is
joined with longer lines less one word. All lines that share a replacement key are within one edit of each other, and
an insertion key has one whole line, so each line needs only the earliest of a key, never all its
pairs. Partners are verified on their words. Hashes of variants come from running XORs, so a line's keys cost time in proportion to its words.

Most lines and documents have no part in all this. They are told apart by bitmaps of bounded size before anything is shuffled
(see sieve), so only lines that are repeated or near, and the texts of documents that lose a line, go through a join.

Defined results: null texts stay null, empty ones empty, with no lines; rows of equal id and text share one
decision and each keep it; null ids come last in the order of documents; lines at one number of documents with one id, or
with null ids, but different texts are told apart and ordered by the text's hash; other columns are kept as they are
and not read, so clashing names don't matter (ids have to be integers); one called ``line_dedup`` is replaced by the result. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm import sieve
from tallyfold.plans.recovery import written

LAST = (1 << 63) - 1
SEED = 0x51ED
#: Kinds of keys.
WHOLE, REPLACED, SHORTER = range(3)


def running_xor(values: Column) -> Column:
    """Running XOR of an array of bigints, in blocks of about the square root of its size, so that no array is copied for each element."""
    size = F.size(values)
    width = F.greatest(F.ceil(F.sqrt(size)).cast("int"), F.lit(1))
    grow = lambda acc, x: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0).cast("long")).bitwiseXOR(x)))
    none = F.array().cast("array<bigint>")
    blocks = F.transform(F.sequence(F.lit(0), F.ceil(size / width).cast("int") - 1), lambda k: F.aggregate(F.slice(values, k * width + 1, width), none, grow))
    ends = F.aggregate(F.transform(blocks, lambda b: F.get(b, F.size(b) - 1)), F.array(F.lit(0).cast("long")), grow)
    return F.when(size == 0, none).otherwise(F.flatten(F.zip_with(blocks, F.slice(ends, 1, F.size(blocks)), lambda b, e: F.transform(b, lambda x: x.bitwiseXOR(e)))))


def _lines(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, th, no, line): every line that isn't blank, trimmed."""
    rows = docs.select(F.coalesce(F.col(doc).cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(text).alias("th"), F.posexplode(F.split(text, "\n")).alias("no", "line"))
    return rows.select("doc", "th", "no", F.btrim("line", F.lit(" \t\r")).alias("line")).where("line <> ''")


def _place() -> Column:
    """A line's place, (doc, no, upper 31 bits of th), as one number of the same order, so that its minimum needs no sorting. Only with the
    whole of th is it a place of one text, as documents may share an id or have none."""
    low = F.shiftleft(F.col("no").cast("long"), 31).bitwiseOR(F.shiftrightunsigned("th", 33))
    return (F.col("doc").cast("decimal(20,0)") * F.lit(1 << 62).cast("decimal(19,0)") + low).cast("decimal(38,0)").alias("place")


def _hash(line: str = "line") -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(SEED), F.col(line)).alias("h2")]


def _halves(n: Column) -> Column:
    """Keys (shorter length of a pair, side, the words of that side) for pairs of equal length and those with one word more or less."""
    part = lambda m, side: F.xxhash64(m, F.lit(side), F.call_function("substring_index", F.col("line"), F.lit(" "), F.floor(m / 2).cast("int") * side))
    return F.array(part(n, 1), part(n, -1), part(n - 1, 1), part(n - 1, -1))


def _variants(lines: DataFrame) -> DataFrame:
    """(id, key, kind): the keys of each line (id, line, open). ``open`` has a bit for each half of it that a line of equal length shares (0 and 1), one for each that
    a line of a word less shares (2 and 3), and one that tells whether a line of a word more shares either (4)."""
    rows = lines.select("id", "open", F.split("line", " ").alias("w")).withColumn("n", F.size("w"))
    rows = rows.select("id", "open", "n", F.transform("w", lambda x, i: F.xxhash64(i, x)).alias("at"), F.transform("w", lambda x, i: F.xxhash64(i - 1, x)).alias("moved"))
    rows = rows.select("id", "open", "n", "at", running_xor(F.col("at")).alias("p"), running_xor(F.col("moved")).alias("q"))
    n, zero = F.col("n"), F.lit(0).cast("long")
    whole, end, shared = F.get("p", n - 1), F.get("q", n - 1), lambda k: F.getbit("open", F.lit(k)) == 1
    half, less = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")
    # Where a word may have been replaced, or put in: behind a first half that is shared, or before a last one.
    places = lambda a, b, m: F.filter(F.sequence(F.lit(0), n - 1), lambda j: (shared(a) & (j >= m)) | (shared(b) & (j < n - m)))
    key = lambda kind, value: F.struct(value.alias("key"), F.lit(kind).cast("byte").alias("kind"))
    replaced = F.transform(places(0, 1, half), lambda j: key(REPLACED, F.xxhash64(F.lit("r"), n, j, whole.bitwiseXOR(F.get("at", j)))))
    gap = lambda j: F.coalesce(F.get("p", j - 1), zero).bitwiseXOR(end).bitwiseXOR(F.get("q", j))
    shorter = F.transform(places(2, 3, less), lambda j: key(SHORTER, F.xxhash64(F.lit("i"), n - 1, gap(j))))
    own = F.when(shared(4), F.array(key(WHOLE, F.xxhash64(F.lit("i"), n, whole)))).otherwise(F.array().cast("array<struct<key:bigint,kind:tinyint>>"))
    return rows.select("id", F.explode(F.concat(own, replaced, shorter)).alias("k")).select("id", "k.key", "k.kind")


def _one_edit(a: Column, b: Column) -> Column:
    """Whether two word arrays, of equal size or ``a`` one shorter, are one edit apart: what they share in front and at the end leaves one word."""
    shared = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, e: F.struct((s["n"] + F.when(s["on"] & e, 1).otherwise(0)).alias("n"), (s["on"] & e).alias("on")))["n"]
    return F.least(shared(a, b), F.size(a)) + F.least(shared(F.reverse(a), F.reverse(b)), F.size(a)) >= F.greatest(F.size(a), F.size(b)) - 1


def near_lines(lines: DataFrame, docs: DataFrame, doc: str, text: str, min_words: int) -> DataFrame:
    """(h1, h2) of the distinct lines that are one edit from an earlier one. lines: (h1, h2, place, th, n, halves), one row a distinct line."""
    long = lines.where(F.col("n") >= min_words)
    halves = long.select("h1", "h2", "place", "th", F.posexplode("halves").alias("slot", "half"))
    # A half key tells lines of one length (slots 0 and 1), which may differ by a replacement, and lines of one word more (2 and 3).
    own = F.when(F.col("slot") < 2, F.col("h1"))
    crowded = halves.groupBy("half").agg((F.min(own) != F.max(own)).alias("same"), (F.count(own) > 0).alias("shorter"), F.bool_or(F.col("slot") >= 2).alias("longer"))
    crowded = written(crowded.select("half", F.coalesce("same", F.lit(False)).alias("same"), (F.col("shorter") & F.col("longer")).alias("grown")).where("same OR grown"), "halves")
    some = sieve.may(halves, [F.col("half")], crowded, [F.col("half")])
    bit = F.call_function("shiftleft", F.lit(1), F.col("slot"))
    open_ = F.when(F.col("slot") >= 2, F.when(F.col("grown"), bit).otherwise(0)).otherwise(F.when(F.col("same"), bit).otherwise(0) + F.when(F.col("grown"), 16).otherwise(0))
    near = some.join(crowded, "half").groupBy("h1", "h2", "place", "th").agg(F.bit_or(open_).alias("open")).where("open <> 0")
    near = written(near, "near-places")
    # Numbered in the order of places, so that one number tells lines apart and orders them.
    order = ("place", "th", "h1", "h2")
    near = written(near.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id()), "near-ids")
    # Their words, each from its first place, so no line is hot.
    at = near.select("place", "th", "id", "open")
    spot = [F.col("place"), F.col("th")]
    seen = sieve.may(_lines(docs, doc, text).select(_place(), "th", "line"), spot, at, spot)
    words = written(seen.join(at, ["place", "th"]).select("id", "open", "line").dropDuplicates(["id"]), "near-lines")

    keys = written(_variants(words), "variants")
    earliest = lambda kind, name: F.min(F.when(F.col("kind") == kind, F.col("id"))).alias(name)
    least = keys.groupBy("key").agg(earliest(WHOLE, "whole"), earliest(REPLACED, "replaced"), earliest(SHORTER, "shorter"), F.count("*").alias("c")).where("c > 1").withColumnRenamed("key", "key2")
    least = written(least, "least")
    partner = F.when(F.col("kind") == REPLACED, F.col("replaced")).when(F.col("kind") == WHOLE, F.col("shorter")).otherwise(F.col("whole"))
    some = sieve.may(keys, [F.col("key")], least, [F.col("key2")])
    pairs = some.join(least, F.col("key") == F.col("key2")).select("id", partner.alias("other")).where("other < id").distinct()
    word = F.split("line", " ")
    pairs = pairs.join(words.select("id", word.alias("w")), "id").join(words.select(F.col("id").alias("other"), word.alias("v")), "other")
    right = F.when(F.size("w") <= F.size("v"), _one_edit(F.col("w"), F.col("v"))).otherwise(_one_edit(F.col("v"), F.col("w")))
    return near.join(pairs.where(right).select("id").distinct(), "id", "left_semi").select("h1", "h2")


def dropped_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text", min_words: int = 5) -> DataFrame:
    """(doc, th, gone): for each document that loses lines, their numbers in order; th is its text's hash."""
    n = F.length(F.regexp_replace("line", "[^ ]+", "")) + 1
    rows = _lines(docs, doc, text).withColumn("n", n).select(_place(), "th", *_hash(), "n", _halves(F.col("n")).alias("halves"))
    first = rows.groupBy("h1", "h2").agg(F.min("place").alias("place"), F.min_by("th", "place").alias("th"), F.min("n").alias("n"), F.count("*").alias("c"), *[F.min(F.col("halves")[k]).alias(f"half{k}") for k in range(4)])
    lines = written(first.select("h1", "h2", "place", "th", "n", "c", F.array(*[f"half{k}" for k in range(4)]).alias("halves")), "lines")
    gone = near_lines(lines, docs, doc, text, min_words).withColumn("near", F.lit(True))
    # Of lines that occur once, only near ones go.
    known = lines.select("h1", "h2", "place", "th", "c").join(gone, ["h1", "h2"], "left").where("c > 1 OR near")
    known = written(known.select(F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("place").alias("first"), F.col("th").alias("first_th"), F.coalesce("near", F.lit(False)).alias("near")), "known-lines")
    places = _lines(docs, doc, text).select("doc", "th", "no", _place(), *_hash())
    some = sieve.may(places, [F.col("h1"), F.col("h2")], known, [F.col("a1"), F.col("a2")])
    goes = F.col("near") | (F.col("place") != F.col("first")) | (F.col("th") != F.col("first_th"))
    decided = some.join(known, (F.col("h1") == F.col("a1")) & (F.col("h2") == F.col("a2"))).where(goes)
    return decided.groupBy("doc", "th").agg(F.array_sort(F.collect_set("no")).alias("gone"))


def dedup_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text", min_words: int = 5) -> DataFrame:
    """``docs``, all columns, with ``text`` less its repeated lines, and a struct column ``line_dedup``: n_lines and n_dropped, of lines that aren't blank."""
    name = sieve.apart(docs)
    d, h, gone, flags = (name(x) for x in ("doc", "th", "gone", "flags"))
    found = written(dropped_lines(docs, doc, text, min_words).select(F.col("doc").alias(d), F.col("th").alias(h), F.col("gone").alias(gone)), "dropped-lines")
    own, th = F.coalesce(F.col(doc).cast("long"), F.lit(LAST)), F.xxhash64(F.col(text))
    may, never = sieve.split(docs, [own, th], found, [F.col(d), F.col(h)])
    lines = F.size(F.filter(F.split(F.col(text), "\n"), lambda x: F.btrim(x, F.lit(" \t\r")) != ""))
    counts = lambda n: F.struct(F.coalesce(lines, F.lit(0)).cast("long").alias("n_lines"), n.cast("long").alias("n_dropped")).alias("line_dedup")
    rows = may.join(found, (own == F.col(d)) & (th == F.col(h)), "left")
    # One byte for each line up to the last dropped one, 1 for dropped: any line is looked up in constant time.
    runs = F.transform(gone, lambda no, i: F.concat(F.repeat(F.lit("0"), no - F.coalesce(F.get(gone, i - 1), F.lit(-1)) - 1), F.lit("1")))
    rows = rows.withColumn(flags, F.array_join(runs, "").cast("binary"))
    kept = F.filter(F.split(F.col(text), "\n"), lambda x, i: F.substring(flags, i + 1, F.lit(1)) != F.lit(b"1"))
    new = F.when(F.col(gone).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")).alias(text)
    columns = lambda t: [t if c == text else F.col(f"`{c}`") for c in docs.columns if c != "line_dedup"]
    changed = rows.select(*columns(new), counts(F.coalesce(F.size(gone), F.lit(0))))
    return changed.unionAll(never.select(*columns(F.col(text)), counts(F.lit(0))))


def oracle(min_words: int = 5) -> str:
    """DuckDB SQL for the digest of :func:`dedup_lines` over ``documents``: lines that share a first or last half are compared word by word."""
    half = lambda m, side: f"hash({m}, {side}, array_to_string({'w[1:(' + m + ' // 2)]' if side > 0 else f'w[len(w) - ({m} // 2) + 1:]'}, ' '))"
    return f"""
    WITH raw AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents),
    l AS (SELECT doc_id, no, line, trim(line, ' ' || chr(9) || chr(13)) AS t FROM raw),
    d AS (SELECT t, min((doc_id, no)) AS pl, string_split(t, ' ') AS w FROM l WHERE t <> '' GROUP BY t),
    k AS (SELECT t, pl, w, len(w) AS n FROM d WHERE len(w) >= {min_words}),
    key AS (SELECT DISTINCT t, pl, w, n, unnest([{half("n", 1)}, {half("n", -1)}, {half("(n - 1)", 1)}, {half("(n - 1)", -1)}]) AS h FROM k),
    near AS (SELECT DISTINCT b.t FROM key a JOIN key b USING (h) WHERE a.pl < b.pl AND abs(a.n - b.n) <= 1 AND
      len(list_filter(range(1, least(a.n, b.n) + 1), lambda i: a.w[1:i] = b.w[1:i])) + len(list_filter(range(1, least(a.n, b.n) + 1), lambda i: a.w[a.n - i + 1:] = b.w[b.n - i + 1:])) >= greatest(a.n, b.n) - 1),
    j AS (SELECT doc_id, no, line, l.t, l.t <> '' AND (d.pl <> (doc_id, no) OR near.t IS NOT NULL) AS gone FROM l LEFT JOIN d ON l.t = d.t LEFT JOIN near ON l.t = near.t),
    g AS (SELECT doc_id, count(*) FILTER (t <> '') AS n_lines, count(*) FILTER (gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT gone), '') AS kept FROM j GROUP BY doc_id)
    SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped, CASE WHEN text IS NOT NULL THEN sha256(coalesce(kept, '')) END AS text_sha256
    FROM documents LEFT JOIN g USING (doc_id)"""
