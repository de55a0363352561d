"""The training-data pipeline over ``documents``: five stages, each written as Parquet and reread.

Every stage works on all rows its predecessor kept, and gets ``(spark, docs, sf_dir)``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.llm import decontamination, pii, quality, sentencepiece_fst, simhash
from codequarry.llm.common import own_name, shared_folder, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = quality.fit(docs)
    prefix = own_name(docs, "__quality_")
    return quality.score(docs, model, prefix=prefix).where(F.col(prefix + "score") >= quality.KEEP).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts that SimHash links (three bits or fewer, as in op 8) the one with the smallest id stays."""
    return simhash.without_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the text."""
    spans = own_name(docs, "__spans")
    out = pii.pii_spans(docs, spans=spans)
    out = out.withColumn("text", F.when(F.col("text").isNotNull(), pii.redacted("text", spans)))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds token_ids and n_tokens; the text stays for the round trip."""
    out = sentencepiece_fst.encode(docs)
    return out.withColumn("n_tokens", F.size("token_ids").cast("long"))


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("PII", redact),
    ("SentencePiece encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs


#: Hash signatures, a fitted model and a tokenizer have no SQL form; tests compare with brute force.
ORACLE_SQL = None
