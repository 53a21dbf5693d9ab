"""Documents to token ids: toxic ones go, one of each group of near duplicates stays,
contaminated ones go, personal data is redacted, and what is left is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs. All but the last return the columns of
docs. A null text is kept by every filter and encoded as no ids; an empty table passes
through. Without labels of both classes to learn from nothing is toxic.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.llm import bpe, decontaminate, neardup, pii, toxicity
from loomstat.llm.common import shared_folder, table, unused


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model gives less than 0.5 or that have no word; it learns from the labelled ones outside the held-out fold."""
    labelled = toxicity.labelled_rows(docs, table(spark, sf_dir, "labels"))
    if labelled.select("toxic").distinct().count() < 2:  # no model
        return docs
    name = unused(docs, "toxic_score")
    wordless = F.col("text").isNull() | ~F.col("text").rlike(toxicity.WORD)
    return toxicity.score(docs, toxicity.fit(labelled), name).where((F.col(name) < 0.5) | wordless).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group with five-word shingles of similarity 0.8 or more."""
    return neardup.keep_one(docs, words=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover less than half of every benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data replaced by their kind; n_chars follows."""
    clean = pii.redact_text(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(docs.columns) if "n_chars" in docs.columns else clean


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids, and the digests of the ids and of the text that they decode to."""
    coded = bpe.round_trip(docs.select("doc_id", "text"), bpe.public_ranks())
    return coded.select("doc_id", "n_tokens", "token_ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("byte_bpe", encode),
]

#: The stages train models and tile strings, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
