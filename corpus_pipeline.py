"""The corpus pipeline: documents of good quality, one of each group of near duplicates, without
secrets, in a mixture of sources, as tokens.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before kept, and works on all of
it. All but the last return the columns of ``documents``.

Defined cases of all stages: an empty table gives an empty one; further columns, also of names that stages use
themselves, are carried to the last stage; very long texts are worked on whole; ids are whole numbers. Ties: of
near duplicates the smallest id stays, of rows that share it the one whose text has the least hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brindle.llm import bpe, jaccard, mixing, quality, secrets
from brindle.llm.common import table
from brindle.runtime import remove, scratch


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier (op1) rejects go. A null or empty text has no feature, scores 0.5 and goes;
    ids without a label teach nothing."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of the Jaccard join (op10; five words, 0.8) the smallest id stays. Null, empty and
    blank texts are like nothing and stay, as do rows without an id; of rows that share an id one stays."""
    return jaccard.one_of_each(docs, words=5, percent=80)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets that the blob ledger's scan (op3) finds are replaced by a mark; every document stays.
    ``n_chars`` stays what it was in ``documents``; a null text stays null."""
    return secrets.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture (op2) with the smallest budget that holds every document, small sources up to 1.5 times. A
    null source is a source of its own; texts without a token are drawn as often as their source."""
    return mixing.mix(docs, max_repetition=1.5)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, source, n_tokens, ids`` of every row of the mixture (op4); null and empty texts have no ids."""
    return bpe.tokenise(docs, carry=("source",))


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_near_duplicates),
    ("secrets", without_secrets),
    ("mixing", mixed),
    ("tokens", tokenised),
]

#: Learnt weights, hashes and a tokenizer can't be said in SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again, and a stage's files go
    when the next one's are written. Those of the last but one feed the plan that is returned."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
