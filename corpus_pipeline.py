"""The corpus pipeline: language ID, near duplicates, decontamination, source mixing, token files.

Each stage takes (spark, docs, sf_dir) and returns a table; ``run`` writes each as Parquet and reads it
back as the documents of the next. All but the last return the columns of documents. Every stage works on
all that its predecessor kept, handles null texts and empty tables, and keeps repeated rows apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ringfield.llm.blend import mix_sources
from ringfield.llm.common import fresh, shared_folder
from ringfield.llm.decontam import decontaminate
from ringfield.llm.langid import keep_identified
from ringfield.llm.simjoin import keep_one
from ringfield.llm.tokenfiles import token_rows


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters and documents whose language no evidence settles."""
    return keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of documents that 5-word shingles link at 0.75 or more, the smallest id stays."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which a window of 10 words of a benchmark item occurs."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents so that the sources approach their target weights; copies are rows of their own."""
    return mix_sources(docs, copy_col=fresh(docs, "copy")).select(*docs.columns)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the token files in ascending order of id and return, for each row, what is read back from them."""
    return token_rows(docs)


STAGES = [
    ("language ID", language_id),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source mix", source_mix),
    ("token files", token_files),
]

#: No SQL: language models, sketches and tokenizers are beyond it. A brute-force version checks the stages in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_folder(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
