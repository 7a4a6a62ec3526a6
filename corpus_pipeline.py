"""A training corpus from ``documents`` in five stages; each is written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import mixing, packing, quality, secrets, similarity, store
from plumbline.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base and every rule of the cascade keep.

    A null or empty text has no words and goes; repeated rows are judged alike; an empty table
    stays empty; columns other than those of documents are dropped.
    """
    return quality.judge(docs.select(COLUMNS)).where("kept").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 0.8 of its five-word shingles or more: the smallest id, of repeated rows the first.

    Null and empty texts are linked with nothing and stay, as does a row without an id in a group of
    its own; an empty table stays empty. Very long texts are compared whole.
    """
    return similarity.deduplicate(docs.select(COLUMNS), k=5, num=80, den=100)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced, and n_chars of the texts that changed.

    A null text stays null; repeated rows change alike; an empty table stays empty.
    """
    docs = docs.select(COLUMNS)
    ledger = secrets.Ledger(spark, store.new_dir(spark, "secrets"))
    ledger.scan(docs)
    d = secrets.attach(docs, ledger)
    clean = secrets.redact(F.col("text"), F.col("spans"))
    d = d.withColumn("text", clean).withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return d.select(COLUMNS)


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that sources, languages and topics have their target shares of tokens.

    Null sources and languages are a value of their own; a text without words has no tokens and is
    never selected; repeated rows are drawn alike; an empty table stays empty.
    """
    return mixing.mix(docs.select(COLUMNS)).where("selected").select(COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids, packed into sequences of 4096: a row a piece.

    A null or empty text has its end id alone; repeated rows are packed each; an empty table gives no rows.
    """
    return packing.pack(docs, tokenizer_path)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("mixing", mixing_weights),
    ("packing", pack_sequences),
]

#: SQL can express neither the tokenizer nor the raking.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = store.materialize(docs, f"stage-{k}-{name}")
    return docs
