"""Tables whose other columns have the names that the operators use inside."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyfold.llm import ann, decontaminate, filter_audit, language_id, line_dedup, minhash, packing, passages, periodic, queries, sharding, sieve, swap_packing, toxicity

SMALL = "/root/testdata/sf0.001"
#: Names that operators use, or used, for columns of their own.
NAMES = (
    "_own_doc _own_th _own_bucket _own_bit _own_b _own_map _own_gone _own_flags _sv_b _sv_bucket _sv_bit _sv_map _ld_doc _ld_th _ld_gone _ld_flags _nd_doc _nd_th _bad_doc _bad_th doc row th text2 words n w g h k "
    "cls bands key slot shard start length ids_crc32 doc_tokens sequence_id offset spans items part mask first good toxic label language line_dedup toxicity periodic a b p q id pos at batch open"
).split()


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id < 60")
    extra = [(None, "one two three four five six", None, None, None), (0, "", "en", "s", 0), (1, None, "en", "s", 0)]
    return rows.unionByName(spark.createDataFrame(extra, rows.schema)).withColumns({n if i % 2 else n.upper(): F.lit(i) for i, n in enumerate(NAMES)})


@pytest.fixture(scope="module")
def plain(docs):
    return docs.select(*corpus_pipeline.COLUMNS)


def rows(df, columns):
    return sorted(map(repr, df.select(*columns).collect()))


def test_names_apart(spark):
    df = spark.range(1).select(F.lit(1).alias("_OWN_x"), F.lit(2).alias("_own__y"))
    assert sieve.apart(df)("x") not in ("_own_x", "_own__x")


@pytest.mark.parametrize("keep", [True, False])
def test_tables_that_lose_rows_or_lines(spark, docs, plain, keep):
    benchmark = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    for f in (lambda d: line_dedup.dedup_lines(d), lambda d: minhash.drop_near_duplicates(d), lambda d: decontaminate.drop_contaminated(d, benchmark)):
        own, want = (x if keep else x.where("false") for x in (docs, plain))
        got = f(own)
        assert {c.lower() for c in docs.columns if c.lower() != "line_dedup"} <= {c.lower() for c in got.columns}
        assert rows(got, ["doc_id", "text", "source"]) == rows(f(want), ["doc_id", "text", "source"])


def test_columns_that_are_added(docs, plain):
    model = language_id.fit(plain.where(~queries.held_out()), order_by=F.xxhash64("doc_id"))
    harm = toxicity.fit(plain.withColumn("toxic", (F.col("doc_id") % 3 == 0).cast("int")), order_by=F.xxhash64("doc_id"))
    for f, column in ((lambda d: language_id.identify(d, model), "language"), (lambda d: toxicity.score(d, harm), "toxicity"), (periodic.find_runs, "periodic")):
        assert rows(f(docs), ["doc_id", column]) == rows(f(plain), ["doc_id", column])


def test_operators_with_rows_of_their_own(spark, docs, plain):
    path, benchmark = queries.tokenizer_path(), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").withColumns({"labelled": F.lit(1), "good": F.lit(2), "part": F.lit("x")})
    for f in (
        lambda d: packing.pack(d, path), lambda d: swap_packing.pack(d, path).drop("sequence_id", "offset"), lambda d: minhash.near_duplicates(d), lambda d: passages.repeated_passages(d),
        lambda d: decontaminate.digest(decontaminate.contamination(d, benchmark)), lambda d: sharding.assign(d, ["doc_id"], ["x", "y"], 11), lambda d: filter_audit.audit(d, labels),
    ):
        got, want = f(docs), f(plain)
        columns = [c for c in want.columns if c not in ("sequence_id", "offset")]
        assert rows(got, columns) == rows(want, columns)


def test_neighbours(spark):
    vectors = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    clash = vectors.withColumns({n: F.lit(1) for n in ("query_id", "score", "rank", "segment", "id", "vec", "cls", "q", "v", "key")})
    assert rows(ann.neighbours(clash, F.col("vec_id") % 50 == 0), ["query_id", "rank", "vec_id"]) == rows(ann.neighbours(vectors, F.col("vec_id") % 50 == 0), ["query_id", "rank", "vec_id"])
