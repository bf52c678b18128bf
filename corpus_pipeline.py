"""From raw documents to packed training sequences, by five of the operators in turn.

Each stage is a function of (spark, docs, sf_dir) and works on all that its predecessor kept.
All but the last return the columns of ``documents``; the last returns a row for each packed
piece.  Rows that repeat a doc_id count as one document from the second stage on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import exactdedup, packing, queries, shared, simhash, suffixarray
from paperloom.llm import toxicity as toxic

#: Bits of 512 that candidates may differ in.  Sets of likeness 0.8 differ in 78 with a standard deviation of
#: 8, the smallest (4 shingles of 5) in 96 with one of 9; this is five deviations above the latter.
NEAR_BITS = 140


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go; learnt from ``labels`` as the operator's own query is."""
    model = toxic.train(docs, queries.read(spark, sf_dir, "labels"), "toxic", ~queries.held_out())
    return toxic.accepted(docs, model, 0.7)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest doc_id stays."""
    docs = shared.one_row(docs)
    found = exactdedup.duplicates(docs)
    return shared.without(docs, found.where("not kept"), "doc_id")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the smallest doc_id; sets of five-word shingles link at Jaccard 0.8."""
    found = simhash.near_duplicates(docs, words=5, bits=NEAR_BITS, width=8, likeness=0.8)
    return shared.without(docs, found.where("doc_id <> component_id"), "doc_id")


def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that start twice are cut out of every text; n_chars follows the text.

    Bytes of a character cut in two go too, so that texts stay text.
    """
    return suffixarray.rewritten(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens."""
    return packing.packed(docs, queries.vocabulary("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("exact dedup", exact_dedup), ("SimHash near-dedup", near_dedup), ("suffix-array dedup", repeat_removal), ("best-fit packing", pack)]

#: A trained model, Hamming components and a tokenizer are not expressible; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result is written and read again."""
    folder = shared.work_folder(spark)
    docs = queries.read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = shared.written(stage(spark, docs, sf_dir), folder, f"stage-{k}")
        if k:
            shared.drop(spark, folder, f"stage-{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
