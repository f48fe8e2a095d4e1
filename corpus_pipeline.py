"""From raw documents to token ids: five stages, each of them written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import mixing, quality, sentencepiece_lattice, simhash, toxicity
from tidemark.llm.common import SAVED, remove_saved, save, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject. It is fitted on labelled rows of what it is given."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is linked by a similarity of 0.8 or more in five words."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    return mixing.mixed(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every document of the mix."""
    return sentencepiece_lattice.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", drop_poor),
    ("SimHash near-dedup", drop_copies),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: Trained models and components are beyond SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents in sf_dir.

    Null and empty texts pass the stages as empty texts: one of them stays, and the mix takes none. Very long texts
    are read whole. Of repeated rows one stays until the mix repeats it. Ties: see the operators. Empty tables give
    an empty result; columns besides those of documents are carried along, whatever their names. What a stage
    has stored on its way is removed once its result is written.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        since = len(SAVED)
        docs = save(stage(spark, docs, sf_dir), name.split()[0])
        remove_saved(spark, since, keep=1)
    return docs
