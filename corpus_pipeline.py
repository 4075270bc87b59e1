"""A corpus pipeline of five stages; each is written as Parquet and reread as the next one's documents.

quality rules -> exact dedup -> MinHash near-dedup -> mixing to target weights -> SentencePiece.
The first four return the columns of ``documents``; the last one the encoded documents.

Cases, by stage. Null and empty texts have no words, so the quality rules reject them; no later stage sees one from
``run``, and called alone each takes null as empty. Very long texts are worked on whole. Repeated rows are judged alike by the
quality rules, and the exact dedup leaves one of them. Ties: of equal texts the largest doc_id stays, of near copies the smallest,
and rows of one slot are in the order of their md5. A null doc_id, lang or source is a value like another. An empty table stays empty. More columns
are carried by the first four stages, whatever their names, and not read; the last one leaves them out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimlens.llm import exact_dedup, minhash, mixing, quality, sentencepiece_bpe
from claimlens.llm.common import shared, table
from claimlens.session import ship_package


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their own language and source's thresholds."""
    return quality.keep_good(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: that with the largest doc_id."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: that with the smallest doc_id."""
    return minhash.drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of their Pfair slots."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, and the ids and digests of each text, in the order of the Pfair slots:
    reading files doesn't keep an order, so the same slots are worked out again."""
    return sentencepiece_bpe.encode_rows(mixing.mix(docs), ["doc_id", "lang", "source"], digests=True)


STAGES = [("quality rules", quality_rules), ("exact dedup", exact_copies), ("MinHash near-dedup", near_copies),
          ("mixing", mixed), ("SentencePiece", encoded)]

#: None: MinHash components and SentencePiece ids aren't expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
