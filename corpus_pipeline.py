"""The corpus pipeline: quality rules, near-duplicates, secrets, mixing, tokens.

Each stage is one operator of ``tabulon.llm`` on all that the stage before it
kept, written as Parquet and read again.  Stages return the columns of
``documents``; the last one returns the token ids.

Defined cases: nulls, blank texts and repeated rows are handled as the
operators' docstrings say (a null or blank text has under 50 words, so the
first stage rejects it); texts of any length go through whole; an empty table gives an empty result; other columns
of the documents pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm import mixing, pieces, quality, secrets, simhash
from tabulon.llm.common import bound_batches, materialize, text_or_empty
from tabulon.llm.queries import file_bytes, tokenizer_file

#: Words in a shingle and the most differing bits of near-duplicates.
SHINGLE, RADIUS = 3, 3


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the classifier."""
    bound_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.judged(docs, labels).where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component, that of the smallest id."""
    return simhash.first_of_groups(docs, shingle=SHINGLE, radius=RADIUS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with all secrets replaced by a mark."""
    found = secrets.find_secrets(docs).withColumn("clean", F.when(
        F.size("spans") > 0, secrets.redact(F.col("text"), F.col("spans"))))
    old = F.col("row").getField
    new = {"text": F.coalesce("clean", old("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.coalesce(F.length("clean").cast(docs.schema["n_chars"].dataType), old("n_chars"))
    return found.select(*[new.get(c, old(c)).alias(c) for c in docs.columns])


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order of the mix, as often as it takes them."""
    return mixing.mixed_rows(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids (little-endian unsigned 32-bit numbers with begin and
    end), n_tokens, the ids' spans in the text's bytes, and whether decoding
    gives the text back."""
    bound_batches(spark)
    model = file_bytes(tokenizer_file("piece_bpe_32k.model"))
    text = text_or_empty("text")
    found = docs.select("doc_id", "source", text.alias("text"), pieces.encoded(text, model).alias("e"))
    return found.select("doc_id", "source", pieces.token_count(F.col("e.ids")).alias("n_tokens"),
                        F.col("e.ids").alias("ids"), F.col("e.bounds").alias("bounds"),
                        (F.col("e.decoded") == F.col("text")).alias("round_trip"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("source_mixing", source_mixing),
    ("sentencepiece", sentencepiece),
]

#: The classifier and the tokenizer have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
