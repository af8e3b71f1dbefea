"""Corpus pipeline: toxicity, near-duplicates, contamination, mixture, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet and read again as the next stage's docs.  All stages but the last
return the columns of documents, and drop whole documents only.  Every stage
judges rows, so repeated rows and null ids are rows of their own; null and empty
texts have no words.  An empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandloom.llm import decontaminate, mixing, neardup, sharding, toxicity
from strandloom.llm.runtime import passing_shuffles, read, scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, learned from the labels of these documents, does not reject; without a word they stay."""
    return toxicity.remove_toxic(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group that shares 0.8 of its five-word shingles by a chain of links.

    Rows with a null id and texts without words are in no group and stay.
    """
    return neardup.remove_near_duplicates(docs, shingle=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth stands in the benchmark verbatim; texts without words stay."""
    return decontaminate.remove_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of 0.9 of the tokens, sources, languages and topics a little flatter than the input's (token shares to the power 0.9).

    A null source or language counts as ''; rows with a null id are drawn alike.
    """
    return mixing.sampled(docs, power=0.9, budget=0.9)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the compacted shard that holds them."""
    return sharding.sharded(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
    ("sharding", shard),
]

#: SQL can express neither a learned lexicon nor chains of links found by signatures.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"stage-{name}")
        out = stage(spark, docs, sf_dir)
        with passing_shuffles(spark):
            out.write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
