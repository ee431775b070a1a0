"""Operators that SQL can't express, and the SQL of those that it can, against plain versions over small fixtures."""

import math
import random
import zlib

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from tallyfold.llm import ann, decontaminate, language_id, line_dedup, minhash, packing, passages, queries, sharding, toxicity, url_filter

SMALL = "/root/testdata/sf0.001"
DRAW = random.Random(11)
VOCABULARY = [f"w{i}" for i in range(3000)]


def prose(n):
    return [DRAW.choice(VOCABULARY) for _ in range(n)]


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def odd_tables(spark, tmp_path_factory):
    """Tables with nulls, empty texts, repeated rows, clashing names and line and window ties, as Parquet."""
    folder = tmp_path_factory.mktemp("odd")
    base = " ".join(prose(60))
    texts = [None, "", " ", "\n\n", base, base, base + "\n" + "a b c d e\na b x d e", "a b c d e\nz\na b c d e f\n b c d e", "x " * 4000, " ".join(prose(15)) + "\n" + base[:200], "A1, b2! " + base[100:300], "Straße ÉCOLE ß. ÀB cd"]
    docs = [(i, t, "en", "s", 1, "x", "y", "z") for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, slot string, language string, th string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    items = [(1, base[:150]), (2, None), (3, ""), (4, "b2"), (5, "a b c"), (5, "a b c"), (6, base[100:260])]
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    urls = [None, "", "://", "http://a.example.com/en/7", "HTTP://EXAMPLE.COM/en/7", "http://x.de/poker/bet", "http://x.de/bingo-pills", "http://x.de/sex", "http://x.de/xxx", "x.de/xxxl", "http://com/en/" + "a/" * 4000, "http://net/de/", "http://sub.net/de/8", "http://org/es?q"]
    spark.createDataFrame([(i, u, "v") for i, u in enumerate([*urls, urls[3]])], "page_id long, url string, host string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    return str(folder)


@pytest.mark.parametrize("where", [SMALL, "odd", "empty"])
@pytest.mark.parametrize("name", ["op1_url_filter", "op2_sharding", "op6_decontamination", "op7_line_dedup"])
def test_queries_equal_their_sql(spark, odd_tables, tmp_path, name, where):
    folder = SMALL if where == SMALL else odd_tables
    if where == "empty":
        for t in ("documents", "benchmark", "pages"):
            spark.read.parquet(f"{odd_tables}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
        folder = str(tmp_path)
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        part = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{part}{'' if where == SMALL else '/*.parquet'}')")
    found = con.execute(queries.oracles()[name])
    want = plain(found.fetchall(), [c[0] for c in found.description])
    df = queries.QUERIES[name](spark, folder)
    assert plain([tuple(r) for r in df.collect()], df.columns) == want


def exact_words(rows, n=50):
    """Of each document, the words inside a window of ``n`` words that an earlier document has."""
    seen, want = {}, {}
    for d, t in sorted((d, t) for d, t in rows if t):
        words = t.encode().lower().split()
        windows = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
        want[d] = {j for i, x in enumerate(windows) if seen.get(x, d) != d for j in range(i, i + n)}
        for x in windows:
            seen.setdefault(x, d)
    return want


def covered_words(found):
    got = {}
    for r in found:
        assert r.n_words >= 50 and r.identity >= 0.8 and r.source_doc < r.doc_id
        got.setdefault(r.doc_id, set()).update(range(r.start, r.start + r.n_words))
    return got


def test_every_exact_passage_is_covered(spark):
    docs = []
    for _ in range(200):  # several passages a pair, pieces from several earlier documents, repeats inside one document, whole copies
        text = prose(DRAW.randint(20, 60))
        for _ in range(DRAW.randint(0, 4)):
            if docs and DRAW.random() < 0.7:
                source = DRAW.choice(docs)
                a = DRAW.randint(0, max(0, len(source) - 60))
                text += source[a : a + DRAW.randint(30, 140)]
            text += prose(DRAW.randint(0, 90)) + (text[-60:] if DRAW.random() < 0.15 else [])
        docs.append(DRAW.choice(docs) if docs and DRAW.random() < 0.1 else text)
    rows = [(i, " ".join(t)) for i, t in enumerate(docs)]
    got = covered_words(passages.repeated_passages(spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, pos int, h int")).collect())
    assert {d: w - got.get(d, set()) for d, w in exact_words(rows).items() if w - got.get(d, set())} == {}


def test_exact_passages_of_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = covered_words(passages.repeated_passages(docs).collect())
    assert {d for d, w in exact_words(rows).items() if w - got.get(d, set())} == set()


@pytest.mark.parametrize(("share", "least"), [(0.05, 0.95), (0.1, 0.95), (0.15, 0.9)])
def test_fuzzy_passages(spark, share, least):
    rows, planted = [], {}
    for _ in range(100):
        passage = prose(DRAW.randint(60, 120))
        rows.append(prose(DRAW.randint(20, 80)) + passage + prose(40))
        for _ in range(2):
            other = [DRAW.choice(VOCABULARY) if DRAW.random() < share * 0.7 else w for w in passage]
            other = [x for w in other for x in ((w,) if DRAW.random() > share * 0.15 else ()) + ((DRAW.choice(VOCABULARY),) if DRAW.random() < share * 0.15 else ())]
            front = prose(DRAW.randint(20, 80))
            planted[len(rows)] = range(len(front), len(front) + len(other))
            rows.append(front + other + prose(30))
    got = covered_words(passages.repeated_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(rows)], "doc_id long, text string")).collect())
    assert sum(bool(got.get(d, set()) & set(p)) for d, p in planted.items()) >= least * len(planted)
    assert set(got) <= set(planted)


def test_chains_equal_all_predecessors():
    s = passages.Settings()
    for _ in range(100):
        n = DRAW.randint(2, 40)
        pos = sorted(DRAW.randint(0, 300) for _ in range(n))
        apos = [DRAW.choice((p + 7, p + 40, DRAW.randint(0, 300))) for p in pos]
        found = passages.chain(pos, apos, s)
        assert sorted(i for c in found for i in c) == list(range(n))
        parts = passages.segments(np.array(pos), np.array(apos), s)
        begin, end = [(pos[x[0]], apos[x[0]]) for x in parts], [(pos[x[-1]], apos[x[-1]]) for x in parts]
        score = {}
        for i in sorted(range(len(parts)), key=lambda i: begin[i]):  # the best of all predecessors, one by one
            near = []
            for j in score:
                gap = [b - e for b, e in zip(begin[i], end[j], strict=True)]
                cells = [b // s.cell - e // s.cell for b, e in zip(begin[i], end[j], strict=True)]
                if min(gap) > 0 and max(cells) <= 2:
                    near.append((score[j] - s.gap_cost * sum(gap), score[j]))
            score[i] = len(parts[i])
            if near:  # a link adds something, however wide the gap
                score[i] = max(len(parts[i]) + max(near)[0], max(near)[1] + 0.01)
        top = max(score.values())
        of = {int(m): i for i, part in enumerate(parts) for m in part}
        chained, total = list(dict.fromkeys(of[m] for m in found[0])), 0.0
        for before, i in zip([None, *chained], chained, strict=False):
            total = len(parts[i]) if before is None else max(total + 0.01, total + len(parts[i]) - s.gap_cost * sum(b - e for b, e in zip(begin[i], end[before], strict=True)))
        assert total == pytest.approx(top)


def test_language_equals_compressing_one_by_one(spark):
    rows = [(i, " ".join(DRAW.choice(words) + DRAW.choice(["", "s", "n"]) for _ in range(80)), lang) for i in range(60) for lang, words in (("aa", ["the", "and", "with", "those"]), ("bb", ["der", "und", "mit", "diese"]), ("hi", ["हिन्दी", "क़िताब", "कौन"]))]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = ["the with and those the ands with those and", "der und mit dieses der und diesen mit der diese", "हिन्दी क़िताब", "the der and und", "zz", None, "", "12 34", "the and " * 20_000, "the and " * 20_000]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, language string, score string")
    said = {r.doc_id: r.language for r in language_id.identify(docs, model).collect()}
    for i, t in enumerate(texts):
        body = language_id.normalised(t or "")
        if not body:
            assert tuple(said[i]) == ("und", 0.0, 0.0, True)
            continue
        sizes = {}
        for lang, content in model.content.items():
            kept = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            pack = zstandard.ZstdCompressor(level=model.level, dict_data=kept, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes[lang] = sum(len(pack.compress(body[a : a + model.block_bytes])) for a in range(0, len(body), model.block_bytes))
        best, second = sorted(sizes.values())[:2]
        assert said[i].lang_pred == min(k for k, v in sizes.items() if v == best) and said[i].margin == pytest.approx((second - best) / second) and said[i].rejected == (said[i].margin < model.min_margin)
    assert [said[k].lang_pred for k in (0, 1, 2)] == ["aa", "bb", "hi"]
    assert language_id.normalised("हिन्दी, १२ A_b1c") == "हिन्दी a b c".encode()
    same = language_id.LanguageModel({"a": b"one two", "b": b"one two"})
    tied = language_id.identify(docs, same).where("doc_id = 0").first().language
    assert (tied.lang_pred, tied.margin, tied.rejected) == ("a", 0.0, True)


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = queries.op3_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL AND lang_pred <> 'und'")
    right, n = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 100 and right >= 0.95


def test_packing_places_every_id_once(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(queries.tokenizer_path())
    texts = [None, "", " ".join(prose(30)), " ".join(prose(30)), "word " * 9000, " ".join(prose(5000)), "it's I'LL <|endoftext|> ÀÉ", "x" * 50_000, *(" ".join(prose(DRAW.randint(1, 400))) for _ in range(60))]
    rows = [*enumerate(texts), (3, texts[3]), (3, texts[2]), (None, texts[2])]
    docs = spark.createDataFrame([(*r, "a", "b") for r in rows], "doc_id long, text string, row string, length string")
    found = packing.pack(docs, queries.tokenizer_path(), with_ids=True, group_rows=5).collect()
    by = {}
    for r in found:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids)
        by.setdefault(r.sequence_id, []).append(r)
    for own in by.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))] and sum(r.length for r in own) <= 2048
    assert sorted(by) == list(range(len(by))) and len(by) <= math.ceil(sum(r.length for r in found) / 2048) + 2
    want = sorted((str(d), n, x) for d, t in rows for ids in [[*whole.encode(t or "", add_special_tokens=False).ids, 1]] for n, x in enumerate(ids))
    assert sorted((str(r.doc_id), r.start + n, x) for r in found for n, x in enumerate(r.ids)) == want


def test_neighbours_recall_and_ties(spark):
    draw = np.random.default_rng(5)
    x = np.round(draw.standard_normal((3000, 32)), 3)
    x[100:140] = x[20]  # many ids of one vector, more than are asked for
    rows = [(i, v.tolist(), "a") for i, v in enumerate(x)] + [(20, x[20].tolist(), "a")]
    found = ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string"), F.col("vec_id") % 20 == 0, segment_rows=1000, block_rows=70).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hits = 0
    for q in range(0, 3000, 20):
        score = x @ x[q]
        order = [int(i) for i in np.lexsort((np.arange(len(x)), -score)) if i != q][:20]
        assert len(got[q]) == 20 and all(s == pytest.approx(score[i], abs=1e-9) for i, s in got[q])
        assert got[q] == sorted(got[q], key=lambda p: (-p[1], p[0]))
        hits += len(set(order) & {i for i, _ in got[q]})
    assert [i for i, _ in got[20]] == list(range(100, 120))  # equal scores go to the smaller ids
    assert hits / (20 * 150) >= 0.9


def jaccard_components(texts, shingle=2, percent=80):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)} or ({tuple(w)} - {()}))
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = {}
    for i, own in enumerate(sets):
        near = {}
        for g in own:
            for j in holders.setdefault(g, []):
                near[j] = near.get(j, 0) + 1
            holders[g].append(i)
        for j, both in near.items():
            if 100 * both >= percent * (len(own) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


def test_near_duplicates_of_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    sizes, roots = jaccard_components([t for _, t in rows])
    want = {d: (n, rows[root][0]) for (d, _), n, root in zip(rows, sizes, roots, strict=True)}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op9_minhash(spark, "/root/testdata/sf0.01").collect()} == want


def test_noisy_or_slopes_and_score():
    texts = [". ".join(" ".join(DRAW.choice(VOCABULARY[:20]) for _ in range(4)) for _ in range(DRAW.randint(1, 5))) for _ in range(30)]
    y = np.array([i % 3 == 0 for i in range(30)], float)
    names = sorted({f for t in texts for w in toxicity.WORD.findall(t) for f in toxicity.features(w)})
    b = toxicity.bags(texts, {f: i for i, f in enumerate(names)})
    weights, bias = np.random.default_rng(1).standard_normal(len(names)) / 3, -0.7
    loss, slope, slope_bias = toxicity.loss_and_slopes(b, y, weights, bias, 1e-3, 2.0)
    for i in range(0, len(names), 5):
        near = weights.copy()
        near[i] += 1e-6
        assert (toxicity.loss_and_slopes(b, y, near, bias, 1e-3, 2.0)[0] - loss) / 1e-6 == pytest.approx(slope[i], abs=1e-3)
    assert (toxicity.loss_and_slopes(b, y, weights, bias + 1e-6, 1e-3, 2.0)[0] - loss) / 1e-6 == pytest.approx(slope_bias, abs=1e-3)
    model = toxicity.Model({f: float(w) for f, w in zip(names, weights, strict=True)}, bias, (0.05, 0.1, 0.2, 0.3))
    judge = toxicity.Scorer(model)
    for text in texts:
        chances = []
        for s in dict.fromkeys(toxicity.sentences(text)):
            z = bias + sum(model.weights[f] for f in {f for w in toxicity.WORD.findall(s) for f in toxicity.features(w)})
            chances.append(1 / (1 + math.exp(-z)))
        floor = {1: 0.05, 2: 0.1, 3: 0.2, 4: 0.2, 5: 0.3}[len(chances)]
        below = max([p for p in chances if p < floor], default=0.0)
        want = 1 - math.prod(1 - p for p in chances if p >= floor) * (1 - below)
        assert judge(text, 0.5)[0] == pytest.approx(want, abs=1e-9)


def test_length_alone_is_not_toxic(spark):
    clean = lambda: " ".join(DRAW.choice(VOCABULARY) for _ in range(8))
    texts = [". ".join([*(clean() for _ in range(30)), *(["you foulword there"] if i % 6 == 0 else [])]) for i in range(400)]
    labels = [int(i % 6 == 0) for i in range(400)]
    model = toxicity.train(texts, labels)
    harmless = texts[1]
    long = ". ".join([harmless] * 1000)
    planted = f"{long}. you foulword there. {harmless}"
    many = ". ".join(clean() for _ in range(20_000))
    rows = [(1, harmless), (2, long), (3, planted), (4, many), (5, None), (6, ""), (7, "..."), (7, "...")]
    found = toxicity.score(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, toxicity string"), model).collect()
    by = {r.doc_id: r.toxicity for r in found}
    assert len(found) == 8 and [by[k].predicted for k in range(1, 8)] == [0, 0, 1, 0, 0, 0, 0]
    assert by[1].score == by[2].score and by[3].offending == [30_000] and by[5].score == by[6].score == by[7].score == 0


def test_labels_of_one_kind_and_ties(spark):
    docs = spark.createDataFrame([(i, "some words here", "x") for i in range(4)] + [(9, None, "x")], "doc_id long, text string, score string")
    for label in (0, 1):
        model = toxicity.fit(docs.withColumn("toxic", F.lit(label)))
        assert [r.toxicity.predicted for r in toxicity.score(docs, model).orderBy("doc_id").collect()] == [label] * 4 + [0]
    assert toxicity.fit(docs.where("false").withColumn("toxic", F.lit(1))).weights == {}
    model = toxicity.Model({"some": 0.0}, 0.0)
    assert toxicity.score(docs, model).first().toxicity.predicted == 1  # a score of exactly one half


def test_toxicity_held_out(spark):
    where = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{where}/labels.parquet").select("doc_id", "toxic")
    found = queries.op10_toxicity(spark, where).join(labels, "doc_id").where("held_out").select("toxic", "predicted").collect()
    hits = sum(r.toxic and r.predicted for r in found)
    assert hits / sum(r.predicted for r in found) >= 0.9 and hits / sum(r.toxic for r in found) >= 0.85


def test_vocabulary_of_a_table(spark):
    rows = spark.createDataFrame([("Bad", None), ("soft", 1), ("soft", 2), ("other", 1), ("", 3), (None, 3)], "term string, weight int")
    v = url_filter.Vocabulary.of(rows)
    assert v.strict == ("bad",) and v.soft == {"other": 1, "soft": 2}
    judge = url_filter.Automaton(v)
    assert [judge.rejects(u)[0] for u in ("http://x/bad", "http://x/soft/soft", "http://x/soft/other", "http://x/badly")] == [True, False, True, False]
    one = url_filter.Automaton(url_filter.Vocabulary((), {"heavy": 9}))
    assert not one.rejects("http://x/heavy/heavy")[0]  # one soft term alone never rejects
    with pytest.raises(ValueError):
        url_filter.Vocabulary.of(rows, most=1)


def test_shards_with_clashing_keys(spark):
    rows = spark.createDataFrame([(1, "a", None), (1, "a", None), (2, None, "b")], "slot long, shard string, other string")
    found = sharding.assign(rows, ["slot", "shard"], ["s0", "s1"], 11)
    assert found.columns == ["slot", "shard", "slot_", "shard_"] and sorted(r.slot for r in found.collect()) == [1, 1, 2]
    assert sharding.assign(rows.where("false"), ["other"], ["s0", "s1"], 11).count() == 0


def test_lines_with_clashing_names(spark):
    text = "a b c d e\nk l m n o"
    rows = spark.createDataFrame([(1, text, "x"), (1, text, "x"), (2, "a b c d e", "x"), (3, "a b c d z " + "w " * 30_000, "x"), (4, None, "x")], "doc_id long, text string, line_dedup string")
    found = line_dedup.dedup_lines(rows.withColumn("line", F.lit("q"))).collect()
    assert sorted((r.doc_id, r.text is None or len(r.text), r.line_dedup.n_dropped, r.line) for r in found) == [(1, 19, 0, "q"), (1, 19, 0, "q"), (2, 0, 1, "q"), (3, 10 + 60_000, 0, "q"), (4, True, 0, "q")]


def words_of(text):
    return [w for w in decontaminate_split.split("".join(c.lower() if c < "\x7f" else c for c in text or "")) if w]


decontaminate_split = __import__("re").compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_pipeline_equals_plain_stages(spark, tmp_path):
    source = spark.read.parquet(f"{SMALL}/documents.parquet")
    extra = [(None, "the and of to in\nthe and of to in", "en", "s", 3), (10**6, None, "en", "s", 0), (10**6 + 1, "", "en", "s", 0), (10**6 + 2, "12 34 !!", None, None, 8)]
    docs = source.unionByName(spark.createDataFrame(extra, source.schema)).withColumn("language", F.lit("clash")).withColumn("th", F.lit(1))
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SMALL}/benchmark.parquet").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    where, kept = str(tmp_path), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, where)
        assert out.columns == list(corpus_pipeline.COLUMNS)
        empty = stage(spark, docs.where("false"), where)
        assert empty.count() == 0 and empty.columns == list(corpus_pipeline.COLUMNS)
        rows = {r.doc_id: r.text for r in docs.collect()}
        if name == "language ID":
            model = language_id.fit(docs.where(~queries.held_out()), order_by=F.xxhash64("doc_id"))
            judge = language_id.Judge(model)
            want = {d: t for d, t in rows.items() if not judge(t)[3]}
        elif name == "line dedup":
            want, seen = {}, {}

            def near(a, b):
                if abs(len(a) - len(b)) > 1:
                    return False
                front = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
                back = next((i for i, (x, y) in enumerate(zip(a[::-1], b[::-1], strict=False)) if x != y), min(len(a), len(b)))
                return front + back >= max(len(a), len(b)) - 1

            for d, t in sorted(rows.items(), key=lambda x: (x[0] is None, x[0])):
                left, dropped, n = [], 0, 0
                for line in (t or "").split("\n"):
                    own = line.strip(" \t\r")
                    words = tuple(own.split(" "))
                    gone = own and (words in seen.get(len(words), ()) or len(words) >= 5 and any(near(v, words) for m in (-1, 0, 1) for v in seen.get(len(words) + m, ()) if len(v) >= 5))
                    n, dropped = n + bool(own), dropped + bool(gone)
                    left += [] if gone else [line]
                    if own:
                        seen.setdefault(len(words), set()).add(words)
                if not dropped or dropped < n:
                    want[d] = "\n".join(left) if dropped else t
        elif name == "MinHash near-dedup":
            order = sorted(rows, key=lambda d: (d is None, d))
            _, roots = jaccard_components([rows[d] for d in order], shingle=5)
            want = {d: rows[d] for i, d in enumerate(order) if roots[i] == i}
        else:
            items = [words_of(r.text) for r in spark.read.parquet(f"{where}/benchmark.parquet").collect()]
            windows = {tuple(w[i : i + min(10, len(w))]) for w in items if w for i in range(len(w) - min(10, len(w)) + 1)}
            lengths = {len(w) for w in windows}
            want = {d: t for d, t in rows.items() if not any(tuple(w[i : i + n]) in windows for w in [words_of(t)] for n in lengths for i in range(len(w) - n + 1))}
        assert {r.doc_id: r.text for r in out.collect()} == want, name
        kept[name] = len(want)
        out.write.parquet(f"{tmp_path}/{name.replace(' ', '-')}")
        docs = spark.read.parquet(f"{tmp_path}/{name.replace(' ', '-')}")
    ids = packing.Encoder(queries.tokenizer_path(), 1)
    want = sorted((r.doc_id is None, r.doc_id, at, min(2048, n - at)) for r in docs.collect() for n in [len(ids(r.text or ""))] for at in range(0, n, 2048))
    packed = corpus_pipeline.run(spark, where).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.start, r.length) for r in packed) == want
    assert kept["language ID"] > 100


def test_pieces_of_the_near_duplicate_operator(spark):
    texts = [None, "", "a", "a", "a b", " ".join(prose(50))]
    rows = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)] + [(None, texts[5], "x", "y"), (None, "solo one two", "x", "y")], "doc_id long, text string, th string, kept string")
    found = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, -1 if r.component_id is None else r.component_id, r.kept) for r in minhash.near_duplicates(rows).collect())
    assert found == [(False, 0, 0, 0, True), (False, 1, 0, 1, True), (False, 2, 1, 2, True), (False, 3, 1, 2, False), (False, 4, 1, 4, True), (False, 5, 49, 5, True), (True, 0, 2, -1, True), (True, 0, 49, 5, False)]
