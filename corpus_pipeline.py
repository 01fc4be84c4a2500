"""From raw documents to token ids: five stages over the text operators.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before
kept; all but the last return the columns of ``documents``.  Null texts count
as empty and pass the filters like any other; an empty table passes through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copse.llm import exact_dedup, mixing, near_copies, sentencepiece_bpe, toxicity
from copse.llm.common import discard, scratch, table


def clean_of_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier, trained on ``labels``, does not reject."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    named = [f"c{i}" for i in range(len(docs.columns))]  # no clash with the scores' names
    scored = toxicity.score(docs.toDF(*named), model, text_col=named[docs.columns.index("text")]).where("predicted = 0")
    return scored.select(*[F.col(n).alias(c) for n, c in zip(named, docs.columns, strict=True)])


def without_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return exact_dedup.without_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (Jaccard similarity of 5-word shingles 0.8 or more) the document with the smallest id."""
    return near_copies.without_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document once for each pass of the mix that takes words of it, with the words taken; at most twice."""
    return mixing.Mix(docs).documents()


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and digests of the ids and of what they decode to."""
    model = public_tokenizers.path(sentencepiece_bpe.MODEL)
    return sentencepiece_bpe.encode_decode(docs, model, ("n_tokens", "ids", "ids_sha256", "decoded_sha256"), keep=("doc_id", "lang", "source"))


STAGES = [
    ("toxicity", clean_of_toxicity),
    ("exact_dedup", without_exact_copies),
    ("near_dedup", without_near_copies),
    ("mixing", mixed),
    ("sentencepiece", encoded),
]

#: SQL cannot express a trained classifier, components of near copies or merges by score.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder and read again, and its input there removed."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            discard(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
