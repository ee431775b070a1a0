"""The corpus pipeline: stages that clean ``documents`` and pack what is left.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of ``documents``; other columns are left out.

Defined results: language ID drops null texts and texts without letters; rows with a null id count as last in all orders; rows
of equal id and text share their fate; an empty table gives an empty result. No SQL expresses the stages, so tests hold each against a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm import decontaminate, language_id, line_dedup, minhash, packing
from tallyfold.llm.queries import held_out, tokenizer_path
from tallyfold.plans.recovery import written
from tallyfold.sources.tables import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: SQL can't express compression, signatures or tokenization.
ORACLE_SQL = None


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is told by a clear margin; ``lang`` stays as it was."""
    model = language_id.fit(docs.where(~held_out()), order_by=F.xxhash64("doc_id"))
    return language_id.identify(docs.select(*COLUMNS), model).where(~F.col("language.rejected")).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out of ``text`` (``n_chars`` follows); documents of which nothing is left go."""
    found = line_dedup.dedup_lines(docs.select(*COLUMNS))
    rows = found.where((F.col("line_dedup.n_dropped") == 0) | (F.col("line_dedup.n_dropped") < F.col("line_dedup.n_lines")))
    changed = F.when(F.col("line_dedup.n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return rows.withColumn("n_chars", changed).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, on shingles of five words."""
    return minhash.drop_near_duplicates(docs.select(*COLUMNS), settings=minhash.Settings(shingle=5))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents without any window of a benchmark item."""
    return decontaminate.drop_contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 2048 tokens; one row for each piece."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language ID", language_stage),
    ("line dedup", line_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, from ``documents`` on."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = written(docs, f"stage-{k}") if k < len(STAGES) - 1 else docs
    return docs
