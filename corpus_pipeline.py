"""From raw documents to packed training windows, in five stages.

Each stage takes the documents that its predecessor kept, as a written table, and all but the
last return the columns of ``documents``:

1. language ID: documents without a recognised language, or in which no language holds half of
   the text, go;
2. line dedup: lines that an earlier document holds are cut from later ones;
3. n-gram Jaccard join: one document of each group of near duplicates stays (five words, 0.8);
4. source mixing: documents are drawn with raked probabilities;
5. best-fit packing: the bin and place of every piece.

Nulls, empty texts, repeated rows and empty tables are treated as the operators' modules state.
No SQL twin: learned language scores and links by similarity cannot be written as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from razao.llm import jaccard_join, language_id, line_dedup, packing, source_mix
from razao.llm.common import stored, table

ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = line_dedup.apply_bitmaps(line_dedup.line_dedup(docs))
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def keep_one_near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_mix.mix_sources(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.best_fit(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_shared_lines),
    ("jaccard_join", keep_one_near_duplicate),
    ("source_mix", mix_sources),
    ("best_fit_packing", pack_windows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
