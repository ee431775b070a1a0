"""Language identification by compression.

Each language has a zstandard raw-content dictionary: the whole texts of a bounded sample of labelled rows, one after the other.
A text is normalised (lower case, runs of anything but letters and the marks that belong to them become one space), split into
blocks, and every block is compressed with each dictionary; the language whose frames are smallest
in total wins. Whole texts count, block by block, so memory doesn't follow a text's length. A win by a
relative margin below ``min_margin`` is rejected.

Defined results: null texts and texts without a letter give ``und``, score 0, rejected. With no
labelled rows every text gives ``und``. Ties go to the alphabetically first language (and are
rejected, their margin being 0). Repeated rows are judged each on their own. Input columns other
than those named are ignored, so clashing names don't matter; one called ``language`` is replaced by the result.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm import bytecut

UNDETERMINED = "und"


def _marks() -> str:
    """All combining marks, as ranges of a character class."""
    marks = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("Mn", "Mc")]
    ends = [i for i, c in enumerate(marks) if i + 1 == len(marks) or marks[i + 1] != c + 1]
    return "".join(f"\\U{marks[a]:08x}-\\U{marks[b]:08x}" for a, b in zip([0, *(i + 1 for i in ends)], ends, strict=False))


NOT_LETTERS = re.compile(rf"(?:[^\w{_marks()}]|[\d_])+")
RESULT = "lang_pred string, score double, margin double, rejected boolean"


@dataclass(frozen=True)
class LanguageModel:
    """Raw dictionary content by language."""

    content: dict[str, bytes]
    level: int = 9
    block_bytes: int = 1024
    min_margin: float = 0.002
    sharpness: float = 50.0


def normalised(text: str) -> bytes:
    return NOT_LETTERS.sub(" ", text.lower()).strip().encode("utf-8", "replace")


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", order_by: Column | None = None, sample_rows: int = 120, max_languages: int = 256, **settings) -> LanguageModel:
    """Build the dictionaries from a bounded sample: for each language, ``sample_rows`` rows, the first
    by ``order_by`` (a hash of the text unless given).

    Rows with a null language or without letters are left out. More than ``max_languages`` values
    are an error, as what reaches the driver must stay bounded.
    """
    order = F.xxhash64(F.col(text)) if order_by is None else order_by
    rows = labelled.select(F.col(lang).alias("l"), F.col(text).alias("t"), order.alias("o")).where(F.col("l").isNotNull() & F.col("t").rlike(r"\p{L}"))
    # Hashes first, so that only the texts picked are moved.
    th = F.xxhash64("t").alias("th")
    first = F.row_number().over(Window.partitionBy("l").orderBy("o", "th"))
    picked = rows.select("l", "o", th).withColumn("n", first).where(F.col("n") <= sample_rows)
    keys = picked.select("l", "o", "th", "n").limit(sample_rows * (max_languages + 1)).collect()
    if len({r["l"] for r in keys}) > max_languages:
        raise ValueError(f"more than {max_languages} languages are labelled")
    spark = labelled.sparkSession
    wanted = spark.createDataFrame([(r["l"], r["o"], r["th"]) for r in keys], f"l2 string, o2 {dict(picked.dtypes)['o']}, th2 long").distinct()
    same = (F.col("l") == F.col("l2")) & F.col("o").eqNullSafe(F.col("o2")) & (F.xxhash64("t") == F.col("th2"))
    texts = {(r["l"], r["o"], r["th"]): r["t"] for r in rows.join(F.broadcast(wanted), same).select("l", "o", th, "t").collect()}  # at most sample_rows a language
    content: dict[str, list[bytes]] = {}
    for r in sorted(keys, key=lambda r: (r["l"], r["n"])):
        content.setdefault(r["l"], []).append(normalised(texts[r["l"], r["o"], r["th"]]))
    return LanguageModel({k: b" ".join(v) for k, v in sorted(content.items())}, **settings)


class Judge:
    """Compressors for a model, made once in each task."""

    def __init__(self, model: LanguageModel) -> None:
        self.model, self.by = model, {}
        for lang, content in model.content.items():
            kept = zstandard.ZstdCompressionDict(content or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            kept.precompute_compress(level=model.level)
            self.by[lang] = zstandard.ZstdCompressor(level=model.level, dict_data=kept, write_content_size=False, write_checksum=False, write_dict_id=False)

    def sizes(self, text: str) -> dict[str, int]:
        body, step = normalised(text), self.model.block_bytes
        blocks = [body[at : at + step] for at in range(0, len(body), step)]
        return {lang: sum(len(c.compress(b)) for b in blocks) for lang, c in self.by.items()}

    def __call__(self, text: str | None) -> tuple[str, float, float, bool]:
        if text is None or not self.by or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0, 0.0, True
        size = self.sizes(text)
        best, *rest = sorted(size, key=lambda x: (size[x], x))
        least = size[best] or 1
        margin = (size[rest[0]] - size[best]) / max(1, size[rest[0]]) if rest else 1.0
        score = 1 / sum(math.exp(-self.model.sharpness * (s / least - 1)) for s in size.values())
        return best, min(1.0, score), margin, margin < self.model.min_margin


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` with one struct column ``language``: lang_pred, score (0 to 1), margin and rejected."""
    settings = (model.level, model.block_bytes, model.min_margin, model.sharpness)
    shared = docs.sparkSession.sparkContext.broadcast(model.content)

    @F.pandas_udf(RESULT)
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        judge = Judge(LanguageModel(shared.value, *settings))
        for texts in batches:
            yield pd.DataFrame([judge(t) for t in texts], columns=["lang_pred", "score", "margin", "rejected"])
        del judge
        bytecut.give_back()

    return docs.withColumn("language", judged(F.col(text)))
