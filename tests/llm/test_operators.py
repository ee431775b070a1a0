"""Each operator against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfold.llm import ann, decontaminate, language_id, line_dedup, minhash, packing, passages, sharding, toxicity, url_filter
from tallyfold.llm.queries import RULES, tokenizer_path

SCHEMA = "doc_id long, text string, th string, n string, words string, key string"
DRAW = random.Random(3)
VOCABULARY = [f"w{i}" for i in range(400)]


def prose(n):
    return " ".join(DRAW.choice(VOCABULARY) for _ in range(n))


def changed(text, share):
    return " ".join(DRAW.choice(VOCABULARY) if DRAW.random() < share else w for w in text.split(" "))


BASE = prose(150)
TEXTS = [None, "", " ", "\n\n", "x", prose(80), BASE, BASE, changed(BASE, 0.02), changed(BASE, 0.04), changed(BASE, 0.3), prose(40) + "\n" + prose(9), "lone " * 3000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "a", "b", "c", "d") for i, t in enumerate(TEXTS)] + [(None, BASE, "a", "b", "c", "d"), (5, TEXTS[5], "a", "b", "c", "d")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("doc_id < 0")


def test_url_rules_and_terms(spark):
    rows = [(1, "http://A.example.com/en/71?x"), (2, "https://sub.example.com/en/6"), (3, "http://x.de/xxx-1"), (4, "http://x.de/xxxl"), (5, "http://x.de/poker/poker"), (6, "http://x.de/poker-bet"), (7, None), (8, "no host/xxx"), (9, "HTTP://X.DE")]
    found = {r.page_id: r for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), rules=RULES).collect()}
    assert {k: (r.rule, r.verdict) for k, r in found.items()} == {1: ("example.com/en/7", "allow"), 2: ("com/en/", "block"), 3: (None, "block"), 4: (None, "allow"), 5: (None, "allow"), 6: (None, "block"), 7: (None, "allow"), 8: (None, "block"), 9: (None, "allow")}
    assert (found[1].host, found[1].path, found[7].host, found[9].host, found[9].path) == ("a.example.com", "/en/71", "", "x.de", "")


def test_shards_are_even_and_stable(spark):
    names = [f"s{i}" for i in range(16)]
    one, less = sharding.fill_table(names, 2003), sharding.fill_table(names[:-1], 2003)
    assert max(Counter(one).values()) - min(Counter(one).values()) <= 1
    moved = sum(a != b for a, b in zip(one, less, strict=True) if a != 15)
    assert moved < 0.15 * 2003
    with pytest.raises(ValueError):
        sharding.fill_table(names, 2002)
    rows = spark.createDataFrame([(1,), (1,), (None,)], "doc_id long")
    found = sharding.assign(rows, ["doc_id"], names, 2003).collect()
    assert len(found) == 3 and len({r.shard for r in found if r.doc_id == 1}) == 1


def test_language(spark, docs, empty):
    rows = [(i, " ".join(DRAW.choice(words) for _ in range(60)), lang) for i in range(120) for lang, words in (("aa", ["the", "and", "with", "those"]), ("bb", ["der", "und", "mit", "diese"]))]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    said = language_id.identify(spark.createDataFrame([(1, "those with the and those"), (2, "und mit der diese der"), (3, None), (4, "12 %"), (5, "")], "doc_id long, text string"), model)
    assert {r.doc_id: r.language.lang_pred for r in said.collect()} == {1: "aa", 2: "bb", 3: "und", 4: "und", 5: "und"}
    assert language_id.identify(docs, model).count() == len(TEXTS) + 2
    untaught = language_id.fit(empty.withColumn("lang", F.lit("aa")))
    assert {r.language.lang_pred for r in language_id.identify(docs, untaught).collect()} == {"und"}


def test_passages(spark, docs, empty):
    shared, long = prose(70), prose(300)
    rows = [(1, long + " " + shared), (2, prose(50) + " " + changed(shared, 0.05) + " " + prose(20)), (3, prose(200)), (4, prose(30) + " " + shared), (5, None), (6, "")]
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in found} == {2, 4} and all(r.source_doc < r.doc_id and r.n_words >= 50 and r.identity >= 0.8 for r in found)
    exact = next(r for r in found if r.doc_id == 4)
    assert exact.start <= 30 and exact.start + exact.n_words >= 100
    assert {r.doc_id for r in passages.repeated_passages(docs).collect()} >= {7, 8, 9}
    assert passages.repeated_passages(empty).count() == 0


@pytest.mark.parametrize(("lines", "words"), [(2, 35), (3, 30), (4, 15)])
def test_passages_of_lines_first_seen_elsewhere(spark, lines, words):
    rows, want = [], {}
    for case in range(12):
        parts = [prose(words) for _ in range(lines)]
        first = len(rows)
        rows += [(first + i, prose(30) + " " + x + " " + prose(30)) for i, x in enumerate(parts)]
        rows += [(first + lines, prose(20) + " " + " ".join(parts) + " " + prose(20))]
        rows += [(first + lines + 1 + i, prose(30) + " " + x + " " + prose(30)) for i, x in enumerate(parts)]  # the nearest holders, each of one line
        rows += [(len(rows), prose(25) + " " + " ".join(parts) + " " + prose(20))]
        want[len(rows) - 1] = (25, 25 + lines * words)
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for doc, (start, end) in want.items():
        own = [r for r in found if r.doc_id == doc]
        assert set(range(start, end)) <= {i for r in own for i in range(r.start, r.start + r.n_words)}, doc
    assert {r.doc_id for r in found} == set(want)


def test_passages_with_inner_repetition(spark):
    line = prose(10)
    rows = [(1, prose(20) + " " + " ".join([line] * 7) + " " + prose(20)), (2, prose(30) + " " + " ".join([line] * 7)), (3, prose(9)), (4, "lone " * 300), (5, "lone " * 200)]
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    covered = {d: {i for r in found if r.doc_id == d for i in range(r.start, r.start + r.n_words)} for d in (2, 5)}
    assert covered[2] >= set(range(30, 100)) and covered[5] == set(range(200)) and {r.doc_id for r in found} == {2, 5}


@pytest.mark.parametrize("apart", [1, 30, 59, 70, 100, 300, 600])
def test_two_passages_of_one_source(spark, apart):
    one, two = prose(500), changed(prose(200), 0.04)
    rows = [(1, one + " " + prose(apart) + " " + two + " " + prose(40)), (2, prose(40) + " " + one + " " + prose(apart) + " " + changed(two, 0.04))]
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    covered = {i for r in found for i in range(r.start, r.start + r.n_words)}
    assert len(covered & set(range(40, 540))) == 500 and len(covered & set(range(540 + apart, 740 + apart))) >= 180
    assert all(r.identity >= 0.8 for r in found) and len(covered - set(range(40, 540)) - set(range(540 + apart, 740 + apart))) <= min(apart, 62)


def test_chains_look_within_the_gap():
    s = passages.Settings()
    pos = [*range(0, 500, 5), *range(600, 800, 5)]
    assert [len(c) for c in passages.chain(pos, pos, s)] == [100, 40]
    assert passages.chain([0, 40, 80], [0, 45, 80], s) == [[0, 1, 2]]


def test_only_stretches_alike_are_reported():
    s = passages.Settings()
    shared, x, y = ([w.encode() for w in prose(n).split(" ")] for n in (70, 59, 59))
    other = [b"o1", b"o2", b"o3", b"o4", b"o5"]
    a, b = other + x + shared, other + [w + b"-" for w in y] + shared
    at = [0, *range(64, 64 + 66, 5)]
    assert passages.align(a, b, at, at, s) == [(64, 134, 64, 134, 70)]


def test_chain_is_best():
    s = passages.Settings()
    assert passages.chain([1, 2, 3, 9], [5, 6, 1, 13], s)[0] == [0, 1, 3]


def test_packing_round_trip(docs, empty):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    rows = packing.pack(docs, tokenizer_path(), with_ids=True).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for own in by.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))] and sum(r.length for r in own) <= 2048
    assert sorted(by) == list(range(len(by)))
    for i, t in enumerate(TEXTS):
        if i != 5:
            own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
            ids = [x for r in own for x in r.ids]
            assert ids == whole.encode(t or "", add_special_tokens=False).ids + [1]
            assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.doc_tokens == len(ids) for r in own)
    assert packing.pack(empty, tokenizer_path()).count() == 0


def test_fillings_are_exact():
    for _ in range(60):
        counts = {DRAW.randint(1, 30): DRAW.randint(1, 3) for _ in range(6)}
        capacity = DRAW.randint(20, 90)
        reach = {0}
        for length, n in counts.items():
            reach = {r + k * length for r in reach for k in range(n + 1)}
        picked = packing.best_filling(counts, capacity)
        assert sum(k * n for k, n in picked.items()) == max(r for r in reach if r <= capacity) and all(n <= counts[k] for k, n in picked.items())


@pytest.mark.parametrize("text", ["Hello  it's\tfoo<|endoftext|>x 'S I'LL Ⅷ İ ΣΑΣ éa ́b\x1cz\r\nq", "ÉCOLE. Straße!! a,b;c don't,'s ½", "日本語 テキスト12"])
def test_encoding_by_stretches(text):
    from tokenizers import Tokenizer

    assert packing.Encoder(tokenizer_path(), 1)(text).tolist() == Tokenizer.from_file(tokenizer_path()).encode(text, add_special_tokens=False).ids + [1]


def test_contamination_edges(spark, docs, empty):
    items = spark.createDataFrame([(1, "W1 w2"), (2, None), (3, BASE), (3, BASE), (None, "w3"), (4, "")], "item_id long, text string")
    found = decontaminate.digest(decontaminate.contamination(docs, items)).collect()
    assert len(found) == len(TEXTS) + 2
    whole = next(r for r in found if r.doc_id == 6)
    assert whole.n_hit == whole.n_words == 150
    assert next(r for r in found if r.doc_id == 0).n_words == 0
    assert decontaminate.contamination(empty, items).count() == 0
    assert {r.contaminated for r in decontaminate.digest(decontaminate.contamination(docs, items.where("item_id < 0"))).collect()} == {False}
    denser = decontaminate.digest(decontaminate.contamination(docs, items, gram=10)).collect()  # every window has a fingerprint
    assert sorted(map(str, denser)) == sorted(map(str, found))


def test_lines_within_one_edit_go(spark, docs, empty):
    text = "a b c d e\n a b c d e\na b x d e\nb c d e\na b c d e f\nz z\n\nz y\na b q r e"
    rows = spark.createDataFrame([(2, text), (1, "b c d e f"), (3, None), (4, "")], "doc_id long, text string")
    found = {r.doc_id: r for r in line_dedup.dedup_lines(rows).collect()}
    assert found[2].text == "a b c d e\nb c d e\nz z\n\nz y\na b q r e" and found[2].line_dedup.n_dropped == 3
    assert found[1].text == "b c d e f" and found[3].text is None and found[4].text == ""
    assert line_dedup.dedup_lines(docs).count() == len(TEXTS) + 2
    assert line_dedup.dedup_lines(empty).count() == 0


@pytest.mark.parametrize("ids", [[None] * 6, [7] * 6, [None, 7, None, 7, 3, None]])
def test_lines_of_null_and_equal_ids_are_told_apart(spark, ids):
    texts = ["a b c d e f\nk1 l1 m1 n1 o1", "a b c d e g\nk2 l2 m2 n2 o2", "p q r s t u\nk3 l3 m3 n3 o3", "v w x y z v\nk1 l1 m1 n1 o1", "p q r s t\nk4 l4 m4 n4 o4", "h i j h i j\nk2 l2 m2 n2 zz"]
    docs = spark.createDataFrame([(i, t) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string").withColumn("th", F.xxhash64("text"))
    for rows in (docs, docs.orderBy(F.desc("text"))):
        found = line_dedup.dedup_lines(rows).collect()
        texts_of = {r.th: (2**63 if r.doc_id is None else r.doc_id, r.th % 2**64) for r in found}
        lines = sorted((texts_of[r.th][0], no, texts_of[r.th][1], line, r.th) for r in docs.collect() for no, line in enumerate(r.text.split("\n")))
        want, seen = {r.th: [] for r in found}, []
        for _, _, _, line, th in lines:
            w = line.split(" ")
            if not any(v == w or abs(len(v) - len(w)) <= 1 and one_edit(v, w) for v in seen):
                want[th].append(line)
            seen.append(w)
        assert {r.th: r.text.split("\n") if r.text else [] for r in found} == want


def one_edit(v, w):
    less = lambda x: [x[:i] + x[i + 1 :] for i in range(len(x))]
    return any(v[:i] + v[i + 1 :] == w[:i] + w[i + 1 :] for i in range(len(v))) if len(v) == len(w) else w in less(v) or v in less(w)


def test_neighbours_of_few_and_odd_vectors(spark):
    rows = [(i, [float(i % 7), 1.0, float(i)]) for i in range(60)] + [(100, None), (120, [0.0, 0.0, 0.0]), (140, [float("nan"), 1.0, 1.0]), (160, [1.0, 2.0]), (180, [1.0, None, 1.0]), (None, [1.0, 1.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = ann.neighbours(vectors, F.col("vec_id") % 20 == 0, k=5).collect()
    for q in (0, 20, 40):
        v = np.array(rows[q][1])
        want = sorted((-float(np.dot(v, np.array(x))), i) for i, x in rows[:60] if i != q)[:5]
        assert [r.vec_id for r in sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])] == [i for _, i in want]
    assert {r.query_id for r in found} == {0, 20, 40}
    assert ann.neighbours(vectors.where("vec_id < 0"), F.col("vec_id") % 20 == 0).count() == 0


def test_forest_holds_what_is_asked_for():
    draw = np.random.default_rng(5)
    x = draw.standard_normal((2000, 16))
    projections = ann.planes(32, 16, 1)
    forest, asked = ann.Forest(x, float(np.linalg.norm(x, axis=1).max()), projections), ann.strings(np.column_stack([x[:40], np.zeros(40)]), projections)
    for least in (21, 700, 2000 * 32):
        found = list(forest.candidates(asked, least))
        assert all(len(c) * 32 >= least for c in found)  # what several trees hold counts for each
    assert all(len(c) == 2000 for c in found)
    hits = [len(set(np.argsort(-(x @ q))[:20]) & set(c.tolist())) for q, c in zip(x[:40], forest.candidates(asked, 1500), strict=True)]
    assert sum(hits) / 800 >= 0.9


def test_near_duplicates_equal_brute_force(docs, empty):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return set(zip(w, w[1:], strict=False)) if len(w) > 1 else {tuple(w)} - {()}

    found = {r.doc_id: r for r in minhash.near_duplicates(docs).collect() if r.doc_id is not None}
    sets = [shingles(t) for t in TEXTS]
    root = list(range(len(TEXTS)))
    for _ in TEXTS:
        for a in range(len(TEXTS)):
            for b in range(len(TEXTS)):
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    assert {k: (r.n_shingles, r.component_id, r.kept) for k, r in found.items()} == {i: (len(sets[i]), root[i], root[i] == i) for i in range(len(TEXTS))}
    assert minhash.near_duplicates(empty).count() == 0
    exact = minhash.near_duplicates(docs, settings=minhash.Settings(bits=0)).where("doc_id IS NOT NULL").collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in exact} == {i: (len(sets[i]), root[i], root[i] == i) for i in range(len(TEXTS))}


def test_toxicity_finds_sentences(spark, docs, empty):
    texts = [prose(20) + ". " + (prose(5) + " foulword " if i % 3 == 0 else prose(6)) + ". " + prose(9) for i in range(300)]
    model = toxicity.train(texts, [int(i % 3 == 0) for i in range(300)])
    out = toxicity.score(spark.createDataFrame([(1, "w1 w2. this foulword here. w3"), (2, "w1 w2. w3"), (3, None), (4, "")], "doc_id long, text string"), model)
    found = {r.doc_id: r.toxicity for r in out.collect()}
    assert [found[k].predicted for k in (1, 2, 3, 4)] == [1, 0, 0, 0] and found[1].offending == [1] and found[3].score == 0
    assert toxicity.score(docs, toxicity.train([], [])).count() == len(TEXTS) + 2
    assert toxicity.score(empty, model).count() == 0


def test_more_sentences_never_lower_a_score():
    """Long texts too; and every toxic text names a sentence."""
    draw = random.Random(5)
    texts = [". ".join(" ".join(f"w{draw.randrange(60)}" for _ in range(6)) + (" foulword" if i % 3 == 0 and k == 1 else "") for k in range(1 + i % 9)) for i in range(300)]
    judge = toxicity.Scorer(toxicity.train(texts, [int(i % 3 == 0) for i in range(300)]))
    harmless = [". ".join(f"w{i % 60} w{(i * 7) % 60} plain{i}" for i in range(n)) for n in (1, 30, 3000)]
    for text in texts:
        score, toxic, _, offending = judge(text, 0.5)
        assert bool(toxic) == bool(offending)
        assert all(judge(f"{text}. {more}", 0.5)[0] >= score - 1e-12 for more in harmless)
    assert not any(judge(more, 0.5)[1] for more in harmless)


def test_likeliest_sentence_is_named_where_none_offends_alone():
    judge = toxicity.Scorer(toxicity.Model({"foul": 4.6}, -5.0))
    score, toxic, n, offending = judge("one foul. w. two foul", 0.5)
    assert toxic and n == 3 and offending == [0] and 0.5 <= score < 1
