"""The corpus pipeline: toxicity, near-duplicates, repeated passages, benchmark passages, packing.

Each stage is ``f(spark, docs, sf_dir)`` over all rows that the stage before kept. All but the last
return the columns of documents (:data:`COLUMNS`); each stage's result is written and read again.

In every stage: rows of null or repeated ids are documents of their own unless its docstring says
otherwise; a null text is one without words and is kept (packing makes its end mark of it); other
columns may be null and pass through as they are; further columns are left out; a table without
rows gives none. A missing column of COLUMNS is an error.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.decontaminate import contamination
from tessera.llm.near_dedup import near_duplicates
from tessera.llm.packing import pack
from tessera.llm.scratch import cut
from tessera.llm.substring_dedup import remove_repeats
from tessera.llm.toxicity import fit, toxicity_scores, training_rows

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity model, learned from labelled ones, rejects go, each by its own text, whatever its id."""
    model = fit(training_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return toxicity_scores(docs, model, keep=COLUMNS).where("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at a similarity of 0.8 the smallest id stays.

    Rows that repeat an id are one document's and stay or go together; rows of a null id stay.
    """
    dropped = near_duplicates(docs, n=5, percent=80).where("not kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that a document of a smaller id has too are cut out."""
    kept = remove_repeats(docs, window=50, keep=tuple(c for c in COLUMNS if c not in ("doc_id", "text", "n_chars")))
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.char_length("kept_text").cast("bigint").alias("n_chars"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with ten consecutive words of a benchmark item go, each by its own text, whatever its id."""
    rows = cut(docs.select(*COLUMNS).withColumn("row_key", F.monotonically_increasing_id()), "keyed")
    hit = contamination(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="row_key", length=10).where("contaminated").select("row_key")
    return rows.join(hit, "row_key", "left_anti").select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), length=1024)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeats),
    ("benchmark_passages", drop_contaminated),
    ("packing", pack_sequences),
]

#: SQL can express neither a trained model nor a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, name)
    return docs
