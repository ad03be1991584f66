"""The training-corpus pipeline: stages over documents, each written as Parquet and read again.

toxicity (documents that it rejects go), near-dedup (one document of each group stays), substring
dedup (repeats are cut out of the texts), mixing (documents are replicated to the target weights),
packing (the result: pieces of sequences).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlark.llm import minhash, mixing, packing, queries, substring, toxicity
from meshlark.llm.common import discard, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_ordinary(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with a toxicity score under one half, as they came."""
    model = toxicity.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(*COLUMNS), model).where("score < 0.5").select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near copies, as it came."""
    return minhash.drop_near_duplicates(docs.select(*COLUMNS))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words that repeat a passage of an earlier one; n_chars follows the text."""
    cut = substring.remove_repeats(docs.select(*COLUMNS))
    return cut.withColumn("n_chars", F.when(F.size("removed") > 0, F.length("text")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's weight asks for, in a global shuffle."""
    return mixing.mix(docs.select(*COLUMNS), queries.MIX_WEIGHTS, queries.MIX_SEED).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack(docs.select("doc_id", "text"), queries.tokenizer("word_bpe_49k.json"))


STAGES = [("toxicity", keep_ordinary), ("minhash", one_of_each_group), ("substring", without_repeats), ("mixing", to_weights), ("packing", packed)]
#: The toxicity score and the tokens have no SQL; tests/llm compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
            discard(before)  # the last one stays: the result reads it
    return docs
