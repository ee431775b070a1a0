"""Queries of the digest and reconciliation operators over the driver's tables, and DuckDB SQL for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.functions import fasthash, wire
from tallyfold.functions import lanes as L
from tallyfold.operators import bags, oplog, sync, trie
from tallyfold.plans.recovery import fresh_folder
from tallyfold.sources.blockstore import BlockStore
from tallyfold.sources.keystore import KeyStore, difference
from tallyfold.sources.logstore import LogStore
from tallyfold.sources.tables import dealt, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

ENC = lambda *cols: "sha256(concat_ws('|', " + ", ".join(f"coalesce(length({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in cols) + "))"
LANE = lambda h, i: f"(('0x' || substr({h}, {i * 8 + 7}, 2) || substr({h}, {i * 8 + 5}, 2) || substr({h}, {i * 8 + 3}, 2) || substr({h}, {i * 8 + 1}, 2))::UBIGINT % {L.MODULI[i]})::BIGINT"
LANES = ", ".join(f"{LANE('k', i)} AS l{i}" for i in range(8))
SUMS = ", ".join(f"(((sum(l{i}) % {m}) + {m}) % {m})::BIGINT AS l{i}" for i, m in enumerate(L.MODULI))
SIGNED = ", ".join(f"(((sum(CASE WHEN is_add THEN l{i} ELSE -l{i} END) % {m}) + {m}) % {m})::BIGINT AS l{i}" for i, m in enumerate(L.MODULI))
LIST = ", ".join(L.NAMES)
ORDERS = f"o AS (SELECT *, {ENC('o_orderkey', 'o_custkey', 'o_orderstatus', '(round(o_totalprice * 100))::BIGINT')} AS k FROM orders), ol AS (SELECT *, {LANES} FROM o)"
SETS = "p AS (SELECT k FROM o WHERE o_orderkey % 100 <> 7), r AS (SELECT k FROM o WHERE o_orderkey % 100 <> 3)"
LOG = f"g AS (SELECT event_id AS pos, event_type IN ('view', 'click', 'signup') AS is_add, {ENC('user_id')} AS k FROM events), gl AS (SELECT *, {LANES} FROM g)"


def _hex(prefix: str = "") -> str:
    part = lambda i: f"lower(lpad(hex({prefix}l{i}), 8, '0'))"
    return " || ".join(f"substr({part(i)}, {at}, 2)" for i in range(8) for at in (7, 5, 3, 1))


def query(sql: str | None):
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def orders(spark: SparkSession, d: str) -> DataFrame:
    return with_order_keys(dealt(table(spark, d, "orders")))


def with_order_keys(o: DataFrame) -> DataFrame:
    return o.withColumn("k", L.key_hex(F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus"), F.round(F.col("o_totalprice") * 100).cast("bigint")))


def ranked_orders(o: DataFrame) -> DataFrame:
    """(o_orderkey, k, pos): orders by their number. Keys, which are larger than what they are made of, are made after the ranking."""
    return with_order_keys(bags.ranked(o.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), ["o_orderkey"])).select("o_orderkey", "k", F.col("at").alias("pos"))


def lines(spark: SparkSession, d: str) -> DataFrame:
    return dealt(table(spark, d, "lineitem")).withColumn("k", L.key_hex(F.col("l_orderkey"), F.col("l_linenumber")))


def sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = orders(spark, d)
    return o.where("o_orderkey % 100 <> 7").select("k"), o.where("o_orderkey % 100 <> 3").select("k")


def log(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("pos"), F.col("event_type").isin("view", "click", "signup").alias("is_add"), L.key_hex(F.col("user_id")).alias("k"))


@query(f"WITH {ORDERS} SELECT o_orderkey, {_hex()} AS digest FROM ol")
def item_digest(spark, d):
    return bags.with_lanes(orders(spark, d)).select("o_orderkey", L.digest_hex().alias("digest"))


@query(f"WITH {ORDERS}, s AS (SELECT count(*) AS n, {SUMS} FROM ol) SELECT n, {_hex()} AS digest FROM s")
def table_digest(spark, d):
    return bags.bag_digest(orders(spark, d)).select("n", L.digest_hex().alias("digest"))


@query(f"WITH l AS (SELECT {ENC('l_orderkey', 'l_linenumber')} AS k FROM lineitem), ll AS (SELECT {LANES} FROM l), s AS (SELECT count(*) AS n, {SUMS} FROM ll) SELECT n, {_hex()} AS digest FROM s")
def table_digest_bag(spark, d):
    return bags.bag_digest(lines(spark, d)).select("n", L.digest_hex().alias("digest"))


@query(f"WITH {ORDERS} SELECT o_orderstatus, count(*) AS n, {SUMS} FROM ol GROUP BY 1")
def group_digest(spark, d):
    return bags.bag_digest(orders(spark, d), ["o_orderstatus"])


@query(f"WITH {ORDERS} SELECT o_orderstatus, o_orderpriority, count(*) AS n, {SUMS} FROM ol GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup_digest(spark, d):
    return bags.bag_digest(orders(spark, d), ["o_orderstatus", "o_orderpriority"], how="rollup")


@query(f"WITH {ORDERS} SELECT o_orderstatus, o_orderpriority, count(*) AS n, {SUMS} FROM ol GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_digest(spark, d):
    return bags.bag_digest(orders(spark, d), ["o_orderstatus", "o_orderpriority"], how="cube")


def _two(spark, d) -> DataFrame:
    """One row: digests of the primary (a_) and the replica (b_)."""
    a, b = (bags.bag_digest(x).select(*[F.col(n).alias(f"{p}{n}") for n in L.NAMES]) for p, x in zip(("a_", "b_"), sides(spark, d), strict=True))
    return a.crossJoin(b)  # one row each


TWO = f"{ORDERS}, {SETS}, pl AS (SELECT {LANES} FROM p), rl AS (SELECT {LANES} FROM r), a AS (SELECT {SUMS} FROM pl), b AS (SELECT {SUMS} FROM rl)"
ARITH = lambda op: ", ".join(f"((a.l{i} {op} b.l{i} + {m}) % {m})::BIGINT AS l{i}" for i, m in enumerate(L.MODULI))


@query(f"WITH {TWO} SELECT {ARITH('+')} FROM a, b")
def digest_add(spark, d):
    return _two(spark, d).select(*L.added("a_", "b_"))


@query(f"WITH {TWO} SELECT {ARITH('-')} FROM a, b")
def digest_sub(spark, d):
    return _two(spark, d).select(*L.subtracted("a_", "b_"))


@query("WITH " + TWO + " SELECT " + ", ".join(f"(({m} - l{i}) % {m})::BIGINT AS l{i}" for i, m in enumerate(L.MODULI)) + " FROM a")
def digest_negate(spark, d):
    return _two(spark, d).select(*L.negated("a_"))


@query(f"WITH {TWO} SELECT false AS one_empty, true AS difference_with_itself_empty, (SELECT ({LIST}) FROM a) = (SELECT ({LIST}) FROM b) AS equal")
def digest_is_empty(spark, d):
    two = _two(spark, d)
    same = two.select("*", *[c.alias(f"s_{n}") for c, n in zip(L.subtracted("a_", "a_"), L.NAMES, strict=True)])
    equal = F.struct(*[F.col(f"a_{n}") for n in L.NAMES]) == F.struct(*[F.col(f"b_{n}").alias(f"a_{n}") for n in L.NAMES])
    return same.select(L.is_empty("a_").alias("one_empty"), L.is_empty("s_").alias("difference_with_itself_empty"), equal.alias("equal"))


@query(f"WITH {ORDERS} SELECT count(*) AS n, {', '.join(f'((({m} - sum(l{i}) % {m})) % {m})::BIGINT AS l{i}' for i, m in enumerate(L.MODULI))} FROM ol WHERE o_orderstatus = 'F'")
def batch_remove(spark, d):
    return bags.bag_digest(orders(spark, d).where("o_orderstatus = 'F'"), sign=F.lit(-1))


@query(f"WITH {ORDERS}, {SETS} SELECT k, k IN (SELECT k FROM r) AS present FROM p")
def contains(spark, d):
    p, r = sides(spark, d)
    return bags.contains(r, p)


@query(f"WITH {ORDERS}, {SETS} SELECT count(*) FILTER (k < '80') AS lower_bound FROM p")
def lower_bound(spark, d):
    return sides(spark, d)[0].agg(F.count_if(F.col("k") < "80").alias("lower_bound"))


RANKED = f'''WITH {ORDERS}, {SETS}, a AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS "at" FROM p)'''


@query(f'''{RANKED} SELECT k, "at" FROM a''')
def ordered_scan(spark, d):
    return bags.ranked(sides(spark, d)[0], ["k"])


@query(f'''{RANKED} SELECT k, "at" FROM a WHERE "at" >= 100 AND "at" < 200''')
def key_slice(spark, d):
    return bags.ranked(sides(spark, d)[0], ["k"]).where("at >= 100 AND at < 200")


@query(f'''{RANKED}, s AS (SELECT {LANES} FROM a WHERE "at" >= 100 AND "at" < 2000) SELECT count(*) AS n, {SUMS} FROM s''')
def range_digest(spark, d):
    return bags.bag_digest(bags.ranked(sides(spark, d)[0], ["k"]).where("at >= 100 AND at < 2000"))


LINES = f"l AS (SELECT l_orderkey, {ENC('l_orderkey', 'l_linenumber')} AS k, {ENC('l_orderkey')} AS ok FROM lineitem)"


def line_orders(spark: SparkSession, d: str) -> DataFrame:
    """The orders of all lines, by the key of their number: a bag with a copy a line."""
    return table(spark, d, "lineitem").select(L.key_hex(F.col("l_orderkey")).alias("k"))


@query(f"WITH {LINES}, u AS (SELECT k FROM l UNION ALL SELECT ok FROM l) SELECT k, count(*) AS copies FROM u GROUP BY k")
def bag_union_all(spark, d):
    return lines(spark, d).select("k").unionAll(line_orders(spark, d)).groupBy("k").agg(F.count("*").alias("copies"))


@query(f"WITH {LINES}, o AS (SELECT {ENC('o_orderkey')} AS k FROM orders), u AS (SELECT ok AS k FROM l EXCEPT ALL SELECT k FROM o) SELECT k, count(*) AS copies FROM u GROUP BY k")
def bag_except_all(spark, d):
    """One copy less for each order: lines beyond an order's first."""
    o = table(spark, d, "orders").select(L.key_hex(F.col("o_orderkey")).alias("k"))
    return bags.remove_copies(line_orders(spark, d), o).groupBy("k").agg(F.count("*").alias("copies"))


@query(f"WITH {LINES}, u AS (SELECT k FROM l EXCEPT ALL SELECT DISTINCT k FROM l) SELECT k, count(*) AS copies FROM u GROUP BY k")
def remove_one_copy(spark, d):
    l = lines(spark, d).select("k")
    return bags.remove_copies(l, l.distinct()).groupBy("k").agg(F.count("*").alias("copies"))


RUNNING = "SELECT pos, " + ", ".join(f"(((sum(CASE WHEN is_add THEN l{i} ELSE -l{i} END) OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING) % {m}) + {m}) % {m})::BIGINT AS l{i}" for i, m in enumerate(L.MODULI)) + " FROM gl"


@query(f"WITH {LOG} {RUNNING}")
def running_digest(spark, d):
    return bags.running_digest(log(spark, d), "pos", oplog.sign()).select("pos", *L.NAMES)


WALK = """w AS (SELECT *, sum(CASE WHEN is_add THEN 1 ELSE -1 END) OVER (PARTITION BY k ORDER BY pos ROWS UNBOUNDED PRECEDING) AS s FROM g),
v AS (SELECT *, least(0, min(s) OVER (PARTITION BY k ORDER BY pos ROWS UNBOUNDED PRECEDING)) AS low FROM w),
e AS (SELECT pos, is_add, k FROM (SELECT *, coalesce(lag(s - low) OVER (PARTITION BY k ORDER BY pos), 0) AS held FROM v) WHERE is_add OR held > 0)"""


@query(f"WITH {LOG}, {WALK} SELECT * FROM e")
def phantom_filter(spark, d):
    return oplog.effective_operations(log(spark, d))


@query(f"WITH {LOG}, {WALK} SELECT k, sum(CASE WHEN is_add THEN 1 ELSE -1 END)::BIGINT AS copies FROM e GROUP BY k HAVING sum(CASE WHEN is_add THEN 1 ELSE -1 END) > 0")
def effective_bag(spark, d):
    return oplog.effective_operations(log(spark, d)).groupBy("k").agg(F.sum(oplog.sign()).alias("copies")).where("copies > 0")


@query(f"WITH {LOG} SELECT k FROM g GROUP BY k HAVING arg_max(is_add, pos)")
def effective_set_last_op(spark, d):
    return oplog.last_operation_set(log(spark, d))


@query(f"WITH {LOG}, m AS (SELECT k FROM g WHERE pos < 5000 GROUP BY k HAVING arg_max(is_add, pos)), t AS (SELECT k, arg_max(is_add, pos) AS a FROM g WHERE pos >= 5000 GROUP BY k) SELECT k FROM m WHERE k NOT IN (SELECT k FROM t) UNION ALL SELECT k FROM t WHERE a")
def apply_tail(spark, d):
    g = log(spark, d)
    return oplog.apply_tail(oplog.last_operation_set(g.where("pos < 5000")), oplog.tail(g, 5000))


@query(f'''WITH {LOG}, m AS (SELECT k FROM g GROUP BY k HAVING arg_max(is_add, pos)), x AS (SELECT DISTINCT k FROM g WHERE pos % 3 = 0 AND k IN (SELECT k FROM m)) SELECT k, row_number() OVER (ORDER BY k) - 1 AS "at" FROM x''')
def bulk_delete_log(spark, d):
    g = log(spark, d)
    return oplog.bulk_delete(oplog.last_operation_set(g), g.where("pos % 3 = 0"))


INDEX = f"WITH {LOG}, u AS ({RUNNING}), i AS (SELECT {LIST}, max(pos + 1) AS position FROM u WHERE pos + 1 >= (SELECT max(pos) + 1 - 1024 FROM u) GROUP BY {LIST})"


@query(f"{INDEX} SELECT * FROM i")
def digest_index(spark, d):
    return oplog.digest_index(log(spark, d))


@query(f"{INDEX} SELECT i.position FROM i JOIN u USING ({LIST}) WHERE u.pos = (SELECT max(pos) - 99 FROM u)")
def resolve_by_digest(spark, d):
    g = log(spark, d)
    last = g.agg((F.max("pos") - 99).alias("p"))
    asked = oplog.positions(g).join(F.broadcast(last), F.col("pos") == F.col("p")).select(*L.NAMES)  # one row
    return oplog.digest_index(g).join(F.broadcast(asked), list(L.NAMES), "left_semi").select("position")


@query(f"WITH {LOG} SELECT * FROM g WHERE pos >= 9000")
def tail_ops(spark, d):
    return oplog.tail(log(spark, d), 9000)


@query(f"WITH {LOG} SELECT * FROM g WHERE pos > (SELECT max(pos) - 1024 FROM g)")
def compacted_log(spark, d):
    return oplog.compacted(log(spark, d))


@query(f"WITH {LOG}, m AS (SELECT k FROM g GROUP BY k HAVING arg_max(is_add, pos)) SELECT row_number() OVER (ORDER BY k) - 1 AS pos, true AS is_add, k FROM m")
def rebuilt_log(spark, d):
    return oplog.rebuilt(oplog.last_operation_set(log(spark, d)))


PFX = lambda depth: f"(('0x' || substr(k, 1, {-(-depth // 4)}))::BIGINT >> {-depth % 4})"
LEVELS = lambda depth: f"{ORDERS}, {SETS}, pa AS (SELECT {PFX(depth)} AS pfx, k, {LANES} FROM p), ra AS (SELECT {PFX(depth)} AS pfx, k, {LANES} FROM r), a AS (SELECT pfx, count(*) AS n, {SUMS} FROM pa GROUP BY pfx), b AS (SELECT pfx, count(*) AS n, {SUMS} FROM ra GROUP BY pfx)"
DIFFER = "m AS (SELECT coalesce(a.pfx, b.pfx) AS pfx, coalesce(a.n, 0) AS pn, coalesce(b.n, 0) AS rn, " + ", ".join(f"coalesce({t}.l{i}, 0) AS {p}_l{i}" for p, t in (("p", "a"), ("r", "b")) for i in range(8)) + " FROM a FULL JOIN b ON a.pfx = b.pfx WHERE coalesce(a.n, 0) <> coalesce(b.n, 0) OR " + " OR ".join(f"coalesce(a.l{i}, 0) <> coalesce(b.l{i}, 0)" for i in range(8)) + ")"


@query(f"WITH {LEVELS(6)} SELECT * FROM a")
def trie_level(spark, d):
    return trie.level(sides(spark, d)[0], 6)


@query(f"WITH {LEVELS(8)}, {DIFFER} SELECT * FROM m")
def trie_mismatch(spark, d):
    return trie.mismatches(*sides(spark, d), 8)


@query(f"WITH {LEVELS(14)}, {DIFFER} SELECT pfx, pn, rn, CASE WHEN pn = 0 THEN 'remove' WHEN rn = 0 THEN 'fetch' WHEN abs(pn - rn) BETWEEN 1 AND 3 THEN 'leaf' ELSE 'expand' END AS action FROM m")
def trie_classify(spark, d):
    return trie.classified(trie.mismatches(*sides(spark, d), 14), 14).select("pfx", "pn", "rn", "action")


@query(f"WITH {LEVELS(12)}, x AS (SELECT pfx, any_value(k) AS k FROM (SELECT {PFX(12)} AS pfx, k FROM p WHERE k NOT IN (SELECT k FROM r)) GROUP BY pfx HAVING count(*) = 1) SELECT pfx, k FROM x WHERE pfx NOT IN (SELECT {PFX(12)} FROM r WHERE k NOT IN (SELECT k FROM p))")
def peel_one(spark, d):
    return trie.peel_one(*sides(spark, d), 12)


@query(f"WITH {LEVELS(12)}, x AS (SELECT pfx, min(k) AS k1, max(k) AS k2 FROM (SELECT {PFX(12)} AS pfx, k FROM p WHERE k NOT IN (SELECT k FROM r)) GROUP BY pfx HAVING count(*) = 2) SELECT pfx, k1, k2 FROM x WHERE pfx NOT IN (SELECT {PFX(12)} FROM r WHERE k NOT IN (SELECT k FROM p))")
def peel_two(spark, d):
    return trie.peel_two(*sides(spark, d), 12)


@query(f"WITH {ORDERS}, {SETS} SELECT 'add' AS op, k FROM (SELECT k FROM p EXCEPT ALL SELECT k FROM r) UNION ALL SELECT 'remove', k FROM (SELECT k FROM r EXCEPT ALL SELECT k FROM p)")
def trie_difference(spark, d):
    return trie.difference(*sides(spark, d))


@query("SELECT DISTINCT o_orderkey, CASE WHEN o_orderkey < 128 THEN 1 WHEN o_orderkey < 16384 THEN 2 WHEN o_orderkey < 2097152 THEN 3 WHEN o_orderkey < 268435456 THEN 4 ELSE 5 END::INT AS bytes FROM orders")
def varint_size(spark, d):
    return table(spark, d, "orders").select("o_orderkey", wire.varint_size(F.col("o_orderkey")).cast("int").alias("bytes")).distinct()


@query(f"WITH {ORDERS}, {SETS}, x AS (SELECT k FROM (SELECT k FROM r WHERE k NOT IN (SELECT k FROM r EXCEPT SELECT k FROM p)) UNION ALL SELECT k FROM (SELECT k FROM p EXCEPT SELECT k FROM r)), xl AS (SELECT {LANES} FROM x), s AS (SELECT count(*) AS n, {SUMS} FROM xl) SELECT n, {_hex()} AS digest FROM s")
def reconcile_fallback(spark, d):
    """The replica after a comparison by prefixes, level by level, has the primary's digest."""
    p, r = sides(spark, d)
    return bags.bag_digest(trie.applied(r, trie.reconcile(p, r).changes)).select("n", L.digest_hex().alias("digest"))


FAST = f"WITH {ORDERS}, ends AS (SELECT count(*) AS held, count(*) FILTER (o_orderkey % 50 = 0) AS gone FROM o), kept AS (SELECT {LANES} FROM o WHERE o_orderkey % 50 <> 0), s AS (SELECT count(*) AS n, {SUMS} FROM kept)"


@query(f"{FAST} SELECT n, {_hex()} AS digest, false AS used_fallback, 1 AS round_trips, 500::BIGINT AS items_added, gone AS items_deleted FROM s, ends")
def reconcile_fast(spark, d):
    """A replica that lacks the last 500 inserts and all deletes catches up in one round trip and has the primary's digest."""
    o = ranked_orders(table(spark, d, "orders"))
    n = o.count()
    gone = ranked_orders(table(spark, d, "orders").where("o_orderkey % 50 = 0")).select((F.col("pos") + n).alias("pos"), F.lit(False).alias("is_add"), "k")
    log = o.select("pos", F.lit(True).alias("is_add"), "k").unionAll(gone)
    done = sync.synchronise(primary=oplog.node(log), replica=oplog.node(log.where(F.col("pos") < n - 500)))
    said = (F.lit(x).alias(c) for x, c in ((done.used_fallback, "used_fallback"), (done.round_trips, "round_trips")))
    counts = (F.lit(x).cast("long").alias(c) for x, c in ((done.items_added, "items_added"), (done.items_deleted, "items_deleted")))
    return bags.bag_digest(done.replica.members).select("n", L.digest_hex().alias("digest"), *said, *counts)


@query(f"WITH {ORDERS}, {SETS}, c AS (SELECT {PFX(4)} AS pfx, {PFX(6)} & 3 AS child, count(*) AS n FROM p GROUP BY ALL), g AS (SELECT pfx, child, coalesce(n, 0) AS n FROM (SELECT DISTINCT pfx FROM c) CROSS JOIN (SELECT unnest(range(4)) AS child) LEFT JOIN c USING (pfx, child)), e AS (SELECT *, (sum(n) OVER (PARTITION BY pfx ORDER BY child))::BIGINT AS \"end\" FROM g) SELECT pfx, child, \"end\" - n AS \"begin\", \"end\" FROM e")
def trie_splits(spark, d):
    return trie.splits(sides(spark, d)[0], 4, 2)


@query(f"WITH {LEVELS(6)}, m AS (SELECT DISTINCT pfx >> 2 AS pfx FROM a), c AS (SELECT count(*) AS held, sum(CASE WHEN n < 128 THEN 1 WHEN n < 16384 THEN 2 WHEN n < 2097152 THEN 3 ELSE 4 END) AS v FROM a), k AS (SELECT 4 * count(*) AS named FROM m) SELECT named::BIGINT AS bytes_sent, (v + 32 * held + named - held)::BIGINT AS bytes_received FROM c, k")
def expansion_bytes(spark, d):
    """The bytes of expanding all prefixes of four bits by two."""
    p = sides(spark, d)[0]
    return trie.expansion_bytes(trie.level(p, 4), trie.level(p, 6).withColumnRenamed("n", "pn"), 6, 2)


@query(f"WITH {ORDERS}, s AS (SELECT o_custkey, {SUMS} FROM ol GROUP BY 1) SELECT o_custkey, {LIST}, {_hex()} AS digest FROM s")
def digest_hex_roundtrip(spark, d):
    """Digests written as 32 bytes and read again."""
    found = bags.bag_digest(orders(spark, d), ["o_custkey"]).select("o_custkey", L.digest_binary().alias("b"))
    return found.select("o_custkey", *L.read_binary(F.col("b")), F.lower(F.hex("b")).alias("digest"))


@query(f"WITH {ORDERS}, {SETS}, x AS (SELECT k, {LANES} FROM p) SELECT k, 1::BIGINT AS copy, " + ", ".join(f"(sum(l{i}) OVER (ORDER BY k) % {m})::BIGINT AS l{i}" for i, m in enumerate(L.MODULI)) + " FROM x")
def running_key_digest(spark, d):
    return bags.running_key_digest(sides(spark, d)[0])


@query(f"WITH {LEVELS(7)}, x AS (SELECT pfx, list(k ORDER BY k) AS ks FROM (SELECT {PFX(7)} AS pfx, k FROM p WHERE k NOT IN (SELECT k FROM r)) GROUP BY pfx HAVING count(*) = 3) SELECT pfx, ks[1] AS k1, ks[2] AS k2, ks[3] AS k3 FROM x WHERE pfx NOT IN (SELECT {PFX(7)} FROM r WHERE k NOT IN (SELECT k FROM p)) AND pfx IN (SELECT pfx FROM a WHERE n <= 256)")
def peel_three(spark, d):
    return trie.peel_three(*sides(spark, d), 7)


#: The digest of the pages at scale factor 0.01, computed apart, with the hash's own library: SQL has no such hash.
GOLDEN_PAGES = "90c71cdaaabf5a681b5b7b32f567e926f19dafec9650f70acb4a980c044a448f"


@query(f"SELECT count(*) AS n, '{GOLDEN_PAGES}' AS digest FROM pages")
def xxh3_digest(spark, d):
    """The digest of all pages by the faster item hash, a missing text being an empty one."""
    pages = dealt(table(spark, d, "pages")).select(fasthash.xxh3_key(F.coalesce("html", F.lit(""))).alias("k"))
    return bags.bag_digest(pages).select("n", L.digest_hex().alias("digest"))


@query("SELECT count(*) FILTER (page_id % 2 = 1) AS n, true AS equal FROM pages WHERE url IS NOT NULL")
def xxh3_remove(spark, d):
    """The digest of all urls, once the items of every other page have been removed from it: how many are left, and whether it equals the digest of those."""
    urls = dealt(table(spark, d, "pages")).where("url IS NOT NULL").select("page_id", "url")
    digest = lambda rows: bags.bag_digest(rows.select(fasthash.xxh3_key(F.col("url")).alias("k")))
    left = fasthash.without_items(digest(urls), urls.where("page_id % 2 = 0"), "url")
    rest = digest(urls.where("page_id % 2 = 1"))
    same = F.struct(*[F.col(f"a.{n}") for n in ("n", *L.NAMES)]) == F.struct(*[F.col(f"b.{n}") for n in ("n", *L.NAMES)])
    return left.alias("a").crossJoin(rest.alias("b")).select("a.n", same.alias("equal"))  # one row each


VARINT = lambda n: f"(CASE WHEN {n} < 128 THEN 1 WHEN {n} < 16384 THEN 2 WHEN {n} < 2097152 THEN 3 WHEN {n} < 268435456 THEN 4 ELSE 5 END)"


@query(
    "WITH g AS (SELECT event_id AS pos, event_type IN ('view', 'click', 'signup') AS is_add FROM events), "
    "c AS (SELECT count(*) FILTER (pos < 9000) AS start, count(*) FILTER (pos >= 9000 AND is_add) AS adds, count(*) FILTER (pos >= 9000 AND NOT is_add) AS deletes FROM g) "
    "SELECT start, false AS used_fallback, adds AS items_added, deletes AS items_deleted, "
    f"(1 + {VARINT('start')} + 32)::BIGINT AS bytes_sent, (1 + {VARINT('(adds + deletes)')} + (adds + deletes + 7) // 8 + 32 * (adds + deletes))::BIGINT AS bytes_received, 1::INT AS round_trips, 50::INT AS latency_ms FROM c"
)
def sync_first_answer(spark, d):
    g = log(spark, d)
    return sync.first_answer(primary=g, replica=g.where("pos < 9000"))


def changes_of_sides(spark: SparkSession, d: str) -> DataFrame:
    """(pos, is_add, k): the changes that make the primary's orders the replica's: orders with 3 go, those with 7 come."""
    o = orders(spark, d).where("o_orderkey % 100 IN (3, 7)")
    return o.select(F.col("o_orderkey").alias("pos"), (F.col("o_orderkey") % 100 == 7).alias("is_add"), "k")


@query(f"WITH {ORDERS}, {SETS}, x AS (SELECT 10 AS depth, {PFX(10)} AS pfx, k, {LANES} FROM r UNION ALL SELECT 4, {PFX(4)}, k, {LANES} FROM r) SELECT depth, pfx, count(*) AS n, {SUMS} FROM x GROUP BY 1, 2")
def summary_after_changes(spark, d):
    """The stored summaries of two levels after batches of changes, some of which are in a rewritten base: what a new summary of the changed set has."""
    store = KeyStore.create(sides(spark, d)[0], fresh_folder(spark, "set"), 4, (4, 10))
    changes = changes_of_sides(spark, d)
    for number, part in enumerate((changes.where("pos % 2 = 0"), changes.where("pos % 2 = 1"))):
        store.apply(part, number)
        if not number:
            store.compact(0.01)
    return store.summary(10).withColumn("depth", F.lit(10)).unionByName(store.summary(4).withColumn("depth", F.lit(4))).select("depth", "pfx", "n", *L.NAMES)


@query(f"WITH {ORDERS}, {SETS} SELECT 'add' AS op, k FROM (SELECT k FROM p EXCEPT ALL SELECT k FROM r) UNION ALL SELECT 'remove', k FROM (SELECT k FROM r EXCEPT ALL SELECT k FROM p)")
def stored_difference(spark, d):
    """What a set lacks of another one after changes, by their stored summaries."""
    stores = [KeyStore.create(sides(spark, d)[0], fresh_folder(spark, "set"), 4, (4, 8, 12)) for _ in range(2)]
    stores[1].apply(changes_of_sides(spark, d), 0)
    return difference(*stores)


@query(f"WITH {LOG} SELECT k FROM g GROUP BY k HAVING arg_max(is_add, pos)")
def delta_set(spark, d):
    """The set that all events leave, applied as batches of unequal size, with a compaction between."""
    g = log(spark, d)
    store = KeyStore.create(g.where("false").select("k"), fresh_folder(spark, "set"), 4, (4, 8))
    for number, part in enumerate(("pos < 100", "pos >= 100 AND pos < 7000", "pos >= 7000")):
        store.apply(g.where(part), number)
        if number == 1:
            store.compact()
    return store.members()


def stored_log(spark: SparkSession, d: str) -> LogStore:
    """A log of all events, appended as batches of unequal size."""
    g, store = log(spark, d), LogStore.create(spark, fresh_folder(spark, "log"))
    for number, part in enumerate(("pos < 100", "pos >= 100 AND pos < 9500", "pos >= 9500")):
        store.append(g.where(part), number)
    return store


@query(f"{INDEX} SELECT * FROM i")
def stored_index(spark, d):
    return stored_log(spark, d).index().where("position > 0")


@query(f"{INDEX} SELECT i.position FROM i JOIN u USING ({LIST}) WHERE u.pos = (SELECT max(pos) - 99 FROM u)")
def stored_resolve(spark, d):
    """The position that a replica's digest of 99 operations ago has in the stored index."""
    store = stored_log(spark, d)
    asked = store.digest_at(store.head()["position"] - 99)
    return spark.createDataFrame([(store.resolve(-1, 0, asked),)], "position long")


@query(f"{FAST} SELECT n, {_hex()} AS digest, false AS used_fallback, 500::BIGINT AS items_added, gone AS items_deleted FROM s, ends")
def stored_sync(spark, d):
    """A stored replica that lacks the last 500 inserts and all deletes catches up by the tail; its set has the primary's digest."""
    o = ranked_orders(table(spark, d, "orders"))
    n = o.count()
    inserts = o.select("pos", F.lit(True).alias("is_add"), "k")
    gone = o.where("o_orderkey % 50 = 0").select((F.col("pos") + n).alias("pos"), F.lit(False).alias("is_add"), "k")
    batches = (inserts.where(F.col("pos") < n - 500), inserts.where(F.col("pos") >= n - 500), gone)
    nodes = [sync.StoredNode(LogStore.create(spark, fresh_folder(spark, "log")), KeyStore.create(o.where("false").select("k"), fresh_folder(spark, "set"), 4, (4, 8))) for _ in range(2)]
    for node, own in zip(nodes, (batches, batches[:1]), strict=True):
        for number, batch in enumerate(own):
            node.log.append(batch, number)
            node.keys.apply(batch, number)
    done = sync.synchronise_stored(primary=nodes[0], replica=nodes[1])
    counts = (F.lit(x).cast("long").alias(c) for x, c in ((done.items_added, "items_added"), (done.items_deleted, "items_deleted")))
    return nodes[1].keys.total().select("n", L.digest_hex().alias("digest"), F.lit(done.used_fallback).alias("used_fallback"), *counts)


def blocks(spark: SparkSession, d: str) -> BlockStore:
    return BlockStore.create(sides(spark, d)[0], fresh_folder(spark, "blocks"), 1000)


@query(f'''{RANKED} SELECT k, "at" FROM a WHERE "at" >= 950 AND "at" < 2100''')
def block_slice(spark, d):
    return blocks(spark, d).slice(950, 2100)


@query(f'''{RANKED}, s AS (SELECT {LANES} FROM a WHERE "at" >= 100 AND "at" < 12345) SELECT count(*) AS n, {SUMS} FROM s''')
def block_range_digest(spark, d):
    return blocks(spark, d).range_digest(100, 12345)


@query(f"WITH {ORDERS}, {SETS} SELECT count(*) FILTER (k < '80') AS lower_bound FROM p")
def block_lower_bound(spark, d):
    return blocks(spark, d).lower_bound("80")


@query(f"WITH {LINES}, u AS (SELECT ok AS k FROM l INTERSECT ALL SELECT k FROM (SELECT {ENC('o_orderkey')} AS k FROM orders UNION ALL SELECT {ENC('o_orderkey')} FROM orders)) SELECT k, count(*) AS copies FROM u GROUP BY k")
def bag_intersect_all(spark, d):
    """At most two lines of each order: the bag of all lines' orders and two copies of each order have as many in common."""
    o = table(spark, d, "orders").select(L.key_hex(F.col("o_orderkey")).alias("k"))
    return line_orders(spark, d).intersectAll(o.unionAll(o)).groupBy("k").agg(F.count("*").alias("copies"))
