"""The corpus pipeline: each stage calls one operator on what its predecessor kept.

toxicity -> exact dedup -> SimHash near-dedup -> mixing -> packing. All stages
but the last return the columns of documents; the last returns the packed
pieces. Columns beyond these, whatever their names, are left out. Verdicts are joined back by id, nulls included; rows that share an id
share a verdict where their texts are equal, and stay if one of them stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.llm import exact_dedup as dedup
from stemma.llm import mixing, packing, simhash
from stemma.llm import toxicity as toxic
from stemma.llm.common import fresh_path, table
from stemma.plans.stages import scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _keep(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of docs whose id is among those of kept, null being an id."""
    ids = kept.select(F.col("doc_id").alias("kept_id"))
    return docs.select(*COLUMNS).join(ids, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models predict as toxic go. The models learn from the labels of the documents at hand; a row is judged by its own text, whatever its id and other columns hold. Null text counts as empty and stays; without labels everything stays; no rows give no rows."""
    model = toxic.fit(docs, table(spark, sf_dir, "labels"))
    return toxic.score(docs.select(*COLUMNS), model).where("score < 0.5").select(*COLUMNS)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts (but for ASCII white space) the longest stays, then the smallest id; null text counts as empty, a null id comes first, and rows that repeat the id that stays stay too."""
    return _keep(docs, dedup.exact_dedup(docs).where("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a Jaccard similarity of 0.8 or more over five-word shingles the one with the smallest id stays. Null and empty texts, and those without words, are one group; shorter texts are one shingle; a null id comes first; rows that repeat the id that stays stay too."""
    return _keep(docs, simhash.similar_groups(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn with the probabilities that bring source, language and topic to their target weights. Null source and language are a value of their own, null text is one token; rows that repeat an id are drawn together."""
    return _keep(docs, mixing.mix(docs).where("kept"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences, each row's by itself: null text is the end token alone, a null id is packed under null, a very long text fills sequences of its own."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", exact_duplicates),
    ("simhash_near_dedup", near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Fitted models, fingerprints and token ids are not SQL; the stages are tested against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each stage's result is written as Parquet and read again, and what the stage wrote besides goes with its end."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
