"""From raw documents to token records: five stages, each an operator of paircall.llm.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last return documents, with the columns they
came with. Every stage works on all that the one before kept. Nulls, empty texts, repeated rows, empty tables and extra
columns have the results their operators define: a null text is scored like an empty one, texts without words
keep one document, a document taken twice by the mix is two rows and two records.

ORACLE_SQL is None: SQL cannot express the classifier, the fingerprints or the encoding; tests compare run() with a
plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paircall.llm import decontamination, mixing, quality, shingles, token_records
from paircall.llm.common import bounded_batches, stored

ACCEPT = 0.7  # least score of a document that stays


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is at least ACCEPT; word vectors are learned from `docs`, labels as in the query."""
    bounded_batches(spark)
    network, vectors = quality.fit(docs, quality.quality_labels(spark, sf_dir))
    return quality.score(docs, network, vectors, docs.columns).where(f"score >= {ACCEPT}").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts linked by a Jaccard similarity of at least 0.8 of their five-word shingles."""
    bounded_batches(spark)
    return shingles.one_of_each(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, within its budget of edits."""
    bounded_batches(spark)
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.repeated(docs)


def write_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token records of all documents, read back: doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    # Workers that have run the other stages have less memory left than those of a job of its own.
    bounded_batches(spark)
    return token_records.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), memo=500_000)


STAGES = [
    ("quality", accept_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("token_records", write_records),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each stored before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
