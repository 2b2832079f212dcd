"""A corpus from raw documents to packed sequences, in five stages.

Every stage takes all that the one before kept, written as Parquet and read
again. All but the last return the columns of ``documents``. The scratch tables
of a stage go when the next one begins, except what that one still reads.

Edge cases: null and empty texts are not toxic, are near duplicates of each
other (that of the least id stays, null ids last), lose nothing and are packed
as the end token alone; rows that repeat a text, with or without their id, are
near duplicates; without labels, or with labels of one kind, the share of toxic
labels is every document's score; further columns, whatever their names, come
through all stages but the last; an empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import packing, pii, recompression, simhash, toxicity
from tidemark.llm.common import forget, materialize, release, table

#: Documents are rejected from this toxicity score.
REJECT = 0.5


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long"))


def _free(name: str, docs: DataFrame) -> str:
    """name, or the next like it that is no column of docs."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below ``REJECT``, by a model of the labelled documents."""
    forget()
    labels = table(spark, sf_dir, "labels").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    model = toxicity.train(docs, labels)
    score = _free("toxicity_score", docs)
    return toxicity.score(docs, model, keep=docs.columns, score_col=score).filter(F.col(score) < REJECT).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: those that SimHash links as in op7, and those whose sets of five-word shingles are alike at 0.8."""
    release(docs)
    return simhash.drop_similar(docs, words=5, fingerprint_words=3)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 35 words or more that repeat."""
    release(docs)
    return _sized(recompression.without_repeats(docs)).select(*docs.columns)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data, and terms that disclose it, generalised."""
    release(docs)
    spans = _free("pii_spans", docs)
    found = pii.find(docs, spans_col=spans, reach=None)
    return _sized(found.withColumn("text", pii.sanitised(F.col("text"), F.col(spans)))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of neighbouring documents."""
    release(docs)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("pii", sanitise),
    ("packing", pack),
]

#: SQL cannot express the stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
