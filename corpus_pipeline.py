"""Corpus pipeline: quality rules, near duplicates, benchmark decontamination, source mixing, token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; every stage but the last
returns the columns of ``documents``.

- ``quality_rules`` drops documents that the threshold table or the base rules reject.
- ``near_duplicates`` keeps the first document of each class linked by Jaccard >= 0.8 of five-word shingles.
- ``decontaminate`` drops documents that hold ten consecutive words of a benchmark item.
- ``mixing`` repeats documents of small sources: tempered weights, no source passed more than twice, every
  document used at least once, so a row may come twice.
- ``token_ids`` writes the ids of what is left to a content-addressed store and returns what reading it gives.

Defined cases, for all five stages: an empty table gives an empty table; columns beside those of ``documents`` stay,
whatever their names, until ``token_ids``; a text of any length is read whole.

- ``quality_rules``: null and empty texts have no words and go; repeated rows are judged alike, so all stay or all go;
  ties cannot arise, a rule's bound itself passes.
- ``near_duplicates``: null, empty and blank texts have no shingles and stay; of repeated rows, and of a class, the row
  of the smallest (id, text) stays, null ids last; a similarity of exactly 0.8 links.
- ``decontaminate``: null and empty texts have no words and stay; null items of the benchmark hit nothing; repeated
  rows go or stay alike; one occurrence of a window is enough.
- ``mixing``: null and empty texts count as one token and stay; a null source is a source of its own; repeated rows are
  rows of their own; ties in the order of blocks are broken by block, of documents by key.
- ``token_ids``: null and empty texts are the end id alone; rows of one id come in the order of their texts, repeated
  rows are documents of their own with the same chunks; null ids come last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratalode.llm import decontaminate, jaccard_join, keys, mixing, quality_rules, token_store


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.drop_near_duplicates(spark, docs, n=5, percent=80)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_contaminated(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(spark, docs, repetition_limit=2.0)


def _token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_store.encode_documents(spark, docs)


STAGES = [
    ("quality_rules", _quality),
    ("near_duplicates", _near_duplicates),
    ("decontaminate", _decontaminate),
    ("mixing", _mixing),
    ("token_ids", _token_ids),
]

#: Hash-ordered mixing and the tokenizer are beyond SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = keys.stored(spark, stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
