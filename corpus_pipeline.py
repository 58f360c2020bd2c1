"""From raw documents to token ids: toxic documents go, one of each group of near duplicates stays, sources are
mixed to target weights, and every text is encoded.

Each stage reads all that the one before it kept, from Parquet in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnline.llm import jaccard, mixing, toxicity
from turnline.llm.common import fresh, read, ship, stored
from turnline.llm.queries import byte_bpe


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold, by weights learned from the labelled ones outside the held-out part."""
    ship(spark)
    labels = read(spark, sf_dir, "labels").where(toxicity.fold(F.col("doc_id"), 4) != 2)
    (score,) = fresh(docs.columns, "toxicity_score")
    scored = toxicity.score(docs, toxicity.train(docs, labels), docs.columns, score_column=score)
    return scored.where(F.col(score) < toxicity.TOXIC_FROM).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that shingle overlap links, the one of least id; documents without words stay."""
    ship(spark)
    return jaccard.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; sources without words go."""
    ship(spark)
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the token ids and of the decoded bytes of every whole text; null texts count as empty."""
    ship(spark)
    return byte_bpe(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: SQL can express neither the classifier nor the encoder; tests hold the stages after the first against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
