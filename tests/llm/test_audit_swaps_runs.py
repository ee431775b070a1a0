"""The filter audit, packing by swaps and periodic runs against SQL, plain versions and bounds, over small fixtures with odd rows."""

import hashlib
import math
import random
import zlib
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyfold.llm import filter_audit, periodic, queries, swap_packing

SMALL = "/root/testdata/sf0.001"
DRAW = random.Random(23)


def prose(n, k=3000):
    return " ".join(f"w{DRAW.randrange(k)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Documents and labels with nulls, empty texts, copies, repeated ids and rows, and clashing names."""
    folder = str(tmp_path_factory.mktemp("odd"))
    texts = [None, "", " \n", prose(300), "A B C $", prose(250, 40), "LOUD " * 250, "x " * 5000, prose(210) + "|", "ab ab ab ab ab ab ab ab ab ab ab ab ab", "Ünïcode   wörds\x00 here", "a\tb\x0bc\x0cd\re"]
    texts += [prose(30) + " " + "p q r " * 8 + "p" + prose(4), texts[3], texts[4], texts[4], ""]
    rows = [(i, t, f"s{i % 3}" if i % 5 else None) for i, t in enumerate(texts)]
    rows += [(4, "A B C $", "s1"), (4, "A B C $", "s1"), (None, "A B C $", "s1"), (None, "alone", "s2"), (None, None, None), (3, prose(10), "s0")]
    clash = "doc_id long, text string, source string, part string, mask int, h binary, doc string, first int, words string, w string, g int, n int, a int, p int, row int, length int, open boolean, periodic string"
    spark.createDataFrame([(*r, "x", 1, b"y", "z", 3, "v", "u", 4, 5, 6, 7, 8, 9, True, "t") for r in rows], clash).coalesce(2).write.parquet(f"{folder}/documents.parquet")
    labels = [(0, 1, None), (3, 1, 0), (3, 0, 1), (4, None, 1), (7, 1, 1), (7, 1, 1), (None, 1, 1), (99, 1, 1), (13, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.fixture
def empty(spark, odd, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{odd}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    return str(tmp_path)


def plain(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("where", [SMALL, "odd", "empty"])
def test_audit_equals_its_sql(spark, odd, empty, where):
    folder = {"odd": odd, "empty": empty}.get(where, where)
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet{'' if where == SMALL else '/*.parquet'}')")
    found = queries.op11_filter_audit(spark, folder)
    want = con.execute(f"SELECT {', '.join(found.columns)} FROM ({filter_audit.oracle()})").fetchall()
    assert plain(found.collect()) == plain(want)
    parts = spark.read.parquet(f"{folder}/documents.parquet").select(F.coalesce("source", F.lit(""))).distinct().count()
    assert len(want) == parts * 600


def test_audit_of_each_mask_by_hand(spark):
    """Each of the 32 masks, in unequal numbers: every order applied to every row."""
    rows = [("p" if m % 2 else "q", m, m % 3 == 0, m % 5 == 0) for m in range(32) for _ in range(m + 1)]
    df = spark.createDataFrame(rows, "part string, mask int, good boolean, toxic boolean")
    got = {(r["part"], r["filter_order"], r["step"]): r for r in filter_audit.orders(filter_audit.mask_counts(filter_audit.parity_sums(df))).collect()}
    assert len(got) == 2 * 600
    shapley = {}
    for part in "pq":
        own = [r for r in rows if r[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                bit = 1 << "ABCDE".index(f)
                gone, left = [r for r in left if r[1] & bit], [r for r in left if not r[1] & bit]
                r = got[part, order, step]
                assert (r["removed"], r["kept"]) == (len(gone), len(left))
                assert (r["good_lost"], r["toxic_lost"]) == (sum(x[2] for x in gone), sum(x[3] for x in gone))
                assert r["redundant"] == sum(1 for x in own if x[1] & bit) - len(gone)
                assert r["unique_fails"] == sum(1 for x in own if x[1] == bit)
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
    assert all(r["shapley"] == shapley[p, o[s - 1]] for (p, o, s), r in got.items())


def held(bins):
    return sorted(d for b in bins for docs in b.docs.values() for d in docs)


@pytest.mark.parametrize("capacity", [10, 64, 4096])
def test_local_search_keeps_all_and_never_adds(capacity):
    for _ in range(60):
        lengths = [DRAW.randrange(1, capacity) for _ in range(DRAW.randrange(0, 120))]
        first = swap_packing.best_fit(lengths, capacity)
        n, squares = len(first), sum(b.fill**2 for b in first)
        bins = swap_packing.emptied(first, capacity)
        assert held(bins) == list(range(len(lengths)))
        assert all(b.fill == sum(lengths[d] for docs in b.docs.values() for d in docs) <= capacity for b in bins)
        assert -(-sum(lengths) // capacity) <= len(bins) <= n and sum(b.fill**2 for b in bins) >= squares


def best(lengths, capacity):
    """The fewest sequences, by trying all ways."""
    out = len(lengths)

    def walk(i, fills):
        nonlocal out
        if len(fills) >= out:
            return
        if i == len(lengths):
            out = len(fills)
            return
        for k in {f: k for k, f in enumerate(fills)}.values():
            if fills[k] + lengths[i] <= capacity:
                walk(i + 1, [*fills[:k], fills[k] + lengths[i], *fills[k + 1 :]])
        walk(i + 1, [*fills, lengths[i]])

    walk(0, [])
    return out


def test_local_search_is_near_the_best():
    more = 0
    for _ in range(60):
        lengths = sorted((DRAW.randrange(1, 20) for _ in range(9)), reverse=True)
        DRAW.shuffle(lengths)
        more += len(swap_packing.packed(lengths, 20)) - best(lengths, 20)
    assert more <= 3


@pytest.mark.parametrize(("giver", "taker", "after"), [([3, 9], [12, 1], 7), ([5, 6], [4, 14], 9), ([2, 3, 6], [4, 13], 8), ([8, 1], [3, 4, 11], 7)])
def test_each_kind_of_exchange(giver, taker, after):
    """A move, one for one, two for one and one for two: each fills a sequence of 20 as far as can be."""
    a, b = swap_packing.Bin(), swap_packing.Bin()
    for bin_, lengths in ((a, giver), (b, taker)):
        for k, x in enumerate(lengths):
            bin_.add(x, (id(bin_), k))
    total = a.fill + b.fill
    before = b.fill
    assert swap_packing.exchange(a, b, 20)
    assert a.fill + b.fill == total and before < b.fill <= 20
    brute = max(d for d in _gains(giver, taker) if d <= 20 - before)
    assert b.fill - before == brute, after


def _gains(giver, taker):
    ways = [0, *giver, *(x - y for x in giver for y in taker)]
    pairs = lambda v: [(v[i], v[j]) for i in range(len(v)) for j in range(i)]
    return ways + [sum(p) - y for p in pairs(giver) for y in taker] + [x - sum(p) for x in giver for p in pairs(taker)]


@pytest.mark.parametrize(("where", "settings"), [(SMALL, {}), (SMALL, {"group_rows": 32, "group_bins": 4, "reopened": 2}), ("odd", {"capacity": 64, "group_rows": 4, "group_bins": 2})])
def test_packing_is_a_round_trip(spark, odd, where, settings):
    folder, capacity = odd if where == "odd" else where, settings.get("capacity", 4096)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = swap_packing.pack(docs, queries.tokenizer_path(), **settings)
    assert dict(found.dtypes) == {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"}
    got, tokenizer, want = found.collect(), Tokenizer.from_file(queries.tokenizer_path()), []
    for r in docs.select("doc_id", "text").collect():
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), capacity)):
            own = ids[at : at + capacity]
            want.append((r["doc_id"], k, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    assert plain(r[:5] for r in got) == plain(want)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    needed = -(-sum(r["length"] for r in got) // capacity)
    assert needed <= len(sequences) <= needed * 1.05 + 2
    if capacity == 4096 and not settings:
        assert len(sequences) <= needed + 1


def test_packing_of_very_short_texts(spark):
    """So many rows fill few sequences that groups by rows alone would leave every sequence open, round after round."""
    docs = spark.createDataFrame([(i, "a" * (i % 3)) for i in range(3000)], "doc_id long, text string")
    got = swap_packing.pack(docs, queries.tokenizer_path(), capacity=128, group_rows=64, group_bins=3, reopened=4).collect()
    fill = {}
    for r in got:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    needed = -(-sum(fill.values()) // 128)
    assert len(got) == 3000 and max(fill.values()) <= 128 and needed <= len(fill) <= needed + 2


def test_packing_of_nothing(spark, empty):
    assert queries.op12_swap_packing(spark, empty).count() == 0


def runs_of(words, least=12):
    """Every run, by trying all periods at all places."""
    out = []
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            e = i + q
            if e - s >= max(least, 2 * q) and all(any(words[t] != words[t + r] for t in range(s, e - r)) for r in range(1, q)):
                out.append((s, e - s, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def digest_of(doc_id, text):
    words = [w for w in (text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    h, n = (zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = runs_of(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = min(((-length, s, q) for s, length, q in runs), default=None)
    first = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
    return (doc_id, len(runs), *first, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


@pytest.mark.parametrize("where", [SMALL, "odd", "empty"])
def test_periodic_runs_equal_a_plain_search(spark, odd, empty, where):
    folder = {"odd": odd, "empty": empty}.get(where, where)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    # The plain search takes the square of the words; the longest texts of the driver's table are left to the next test.
    want = [digest_of(*r) for r in rows if len(r[1] or "") < 15000]
    kept = {r[0] for r in want}
    got = [tuple(r) for r in queries.op13_periodic_runs(spark, folder).collect() if r["doc_id"] in kept]
    assert len(got) == len(want) and plain(got) == plain(want)


def test_runs_of_random_words(spark):
    texts = []
    for _ in range(150):
        k = DRAW.choice([1, 2, 3, 6, 60])
        words = [f"v{DRAW.randrange(k)}" for _ in range(DRAW.randrange(0, 60))]
        for _ in range(DRAW.randrange(3)):
            words += ([DRAW.choice("abcxyz") for _ in range(DRAW.randrange(1, 9))] * 40)[: DRAW.randrange(0, 40)] + [DRAW.choice("abc")]
        texts.append(DRAW.choice([" ", "  ", "\n", "\t "]).join(words))
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id long, text string, periodic string").repartition(3)
    for r in periodic.find_runs(df).collect():
        words = texts[r["id"]].split()
        runs = runs_of(words)
        assert [tuple(x) for x in r["periodic"]["runs"]] == runs and r["periodic"]["n_words"] == len(words)
        dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
        assert r["periodic"]["collapsed"] == " ".join(w for i, w in enumerate(words) if i not in dropped)


def test_runs_of_very_long_texts(spark):
    """One text beyond a slice with a run of half of it, one of a single word, and one of two words at random, whose runs are checked one by one."""
    n = 90_000
    unit = [f"u{i}" for i in range(7001)]
    coins = [DRAW.choice("ab") for _ in range(n)]
    texts = [" ".join([f"x{i}" for i in range(n)] + (unit * 13)[:n]), "la " * n, " ".join(coins), prose(100)]
    got = [r["periodic"] for r in periodic.find_runs(spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)).orderBy("id").collect()]
    assert len(texts[0]) > periodic.SLICE
    assert [tuple(x) for x in got[0]["runs"]] == [(n, n, 7001)] and got[0]["collapsed"].split() == [f"x{i}" for i in range(n)] + unit
    assert [tuple(x) for x in got[1]["runs"]] == [(0, n, 1)] and got[1]["collapsed"] == "la"
    assert not got[3]["runs"] and got[3]["collapsed"] == texts[3]
    a = np.array([c == "a" for c in coins])
    for s, length, q in got[2]["runs"]:
        e = s + length
        assert length >= max(12, 2 * q) and (a[s : e - q] == a[s + q : e]).all()
        assert (s == 0 or a[s - 1] != a[s - 1 + q]) and (e == n or a[e] != a[e - q])
    # All runs of periods up to 40, from where words q apart are identical.
    for q in range(1, 41):
        same = np.append(np.insert((a[:-q] == a[q:]).astype(np.int8), 0, 0), 0)
        begin, end = np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1)
        long = end - begin + q >= max(12, 2 * q)
        wanted = {(int(s), int(e - s + q)) for s, e in zip(begin[long], end[long], strict=True) if not any((a[s : e + q - r] == a[s + r : e + q]).all() for r in range(1, q) if q % r == 0)}
        assert {(s, length) for s, length, p in got[2]["runs"] if p == q} == wanted


def test_exponent_is_a_floor(spark):
    found = periodic.digest(periodic.find_runs(spark.createDataFrame([(1, "a b c " * 4 + "a b")], "doc_id long, text string"))).first()
    assert (found["start"], found["length"], found["period"], found["exponent_milli"]) == (0, 14, 3, math.floor(1000 * 14 / 3))
