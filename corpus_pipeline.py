"""A training-data pipeline over documents: each stage works on the rows that the stage before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import decontam, minhash, mixing, nbsvm, pii
from weftgraph.llm.common import drop_dir, shared_dir

#: SQL can't express the trained model, the edit distances and the keyed permutations; tests compare run() with a brute-force version.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fit on all labelled documents (it scores those too), drop what scores below 0.3.

    Null and empty texts get the score of the intercept, repeated rows equal scores; a score of 0.3 stays. Without labels every score is 0.5 and all rows stay.
    """
    model, ratios = nbsvm.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = nbsvm.score(docs, model, ratios, score_col="__weft_score", predicted_col="__weft_predicted")
    return scored.where("__weft_predicted = 1").drop("__weft_score", "__weft_predicted")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, similarity 0.8 or more): the smallest id, a null id last.

    Null, empty and blank texts are nobody's duplicates; of rows with equal id and text one stays.
    """
    return minhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item. Null and empty texts and items match nothing; repeated rows share their fate."""
    return decontam.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pseudonyms for personal data in text under the session's key; n_chars follows the text. Null and empty texts stay."""
    done = pii.pseudonymize(docs, pii.session_key(spark), spans=None)
    return done.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else done


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents in training order: the columns of documents and position (replacing one of that name).

    Null and empty texts have no words and are taken no times; a null source is one of its own; repeated rows are interchangeable.
    """
    return mixing.curriculum(mixing.plan(docs, out="__weft_mix"), "__weft_mix")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality), ("minhash near-dedup", near_dedup), ("benchmark decontamination", decontaminate), ("pii", private), ("mix", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES:
        path = shared_dir(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop_dir(spark, before)
        before = path
    return docs
