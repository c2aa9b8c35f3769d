"""A corpus pipeline over ``documents``: each stage's rows are written and read again by the next.

STAGES: (name, function); a function takes (spark, docs, sf_dir) and returns
the documents it keeps, all their columns; the last one returns the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm import decontam, langid, line_dedup, minhash_forest, mixing
from feedloom.llm.common import read, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those the classifier rejects go."""
    return langid.recognised(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated three-line windows go, and documents of which nothing is left."""
    d = line_dedup.dedup_lines(docs).where("n_removed = 0 OR trim(BOTH ' \\t\\r\\n' FROM text) <> ''")
    new = {"text": F.col("text"), "n_chars": F.expr("CAST(length(text) AS bigint)")}
    return d.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (0.8 on five-word shingles) stays."""
    return minhash_forest.representatives(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources, with the number of copies of each document taken."""
    return mixing.mixed(docs)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates),
          ("decontaminate", decontaminate), ("mix", mix)]

#: A trained classifier and a similarity join are not SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
