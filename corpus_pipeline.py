"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read again for the next.

1. quality classifier: documents that it rejects go;
2. line dedup: lines on many sites are removed from the texts (not from near copies, of which at least ``COPY_SHARE`` stands
   on other sites too: those are left for stage 3, which keeps one whole text of them);
3. n-gram Jaccard join: of each group of near duplicates the smallest doc_id stays;
4. benchmark decontamination: passages of the benchmark are cut out of the texts;
5. BPE encoding: token counts and digests of ids and decoded texts.

Each stage works on all rows that the one before kept. All but the last return the columns of ``documents``.

Defined results: null and empty texts pass stages 2 to 4 and have no tokens; repeated rows with words are near copies of
each other, so one row of an id stays; rows without an id all stay; an empty table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm import bpe, decontamination, jaccard, line_dedup, quality
from ledgerline.llm.common import table, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_quality(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.clean_lines(docs, copy_share=COPY_SHARE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_representatives(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.remove_contamination(docs, table(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


COPY_SHARE = 0.75        # the similarity from which on texts count as near copies

STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_deduplication),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("BPE encoding", bpe_encoding),
]

# A fitted classifier and byte-pair merges are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last stage's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
