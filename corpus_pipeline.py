"""From documents to packed training sequences: language ID, line dedup, near-dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.  A row may have null in any column; a
null or empty text passes the dedup stages unless a stage says otherwise, and an empty table passes all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgauge.llm.common import Workspace
from inkgauge.llm.language_id import identify
from inkgauge.llm.line_dedup import line_dedup
from inkgauge.llm.near_dedup import near_dedup
from inkgauge.llm.packing import pack


def _own(docs: DataFrame, *taken: str):
    """The other columns in a struct, whatever they are called and even if there are none."""
    return F.struct(F.lit(0).alias("__"), *[F.col(c) for c in docs.columns if c not in taken]).alias("own")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject what has no language: documents without a letter (null and empty texts, too).  All others stay.

    The table must have doc_id, text and lang; languages are learnt from its own labels.
    """
    found = identify(docs.select(_own(docs, "text"), "doc_id", "text", "lang"), keep_columns=True)
    kept = found.filter(F.col("lang_pred") != "und")
    return kept.select(*[F.col("text") if c == "text" else F.col("own").getField(c).alias(c) for c in docs.columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete later copies of runs of lines of 50 words or more; documents that are left without a word go."""
    done = line_dedup(docs.select("doc_id", "text", _own(docs, "doc_id", "text")), min_words=50)
    emptied = (F.col("n_removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    kind = docs.schema["n_chars"].dataType if "n_chars" in docs.columns else None
    new = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.char_length("text").cast(kind or "bigint")}
    return done.filter(~emptied).select(*[new[c].alias(c) if c in new else F.col("own").getField(c).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group linked by a similarity of 0.8 or more on shingles of five words."""
    return near_dedup(docs, words=5, percent=80)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of power-of-two lengths up to 4096, with their ids."""
    return pack(docs, tokenizer_path=public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [("language_id", language_id), ("line_dedup", lines), ("near_dedup", near_duplicates), ("packing", packing)]

#: A learned language ID and a BPE tokenizer are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table; what each returns is written before the next one reads it."""
    work = Workspace(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = work.save(docs, name)
    return docs
