"""A corpus pipeline: quality rules, exact and near duplicates, mixing, packing.

Each stage works on all rows that the one before kept, reread from a written table, and all
but the last return the columns of ``documents``. Defined results: NULL and empty texts and
those that fail the fixed rules go in the first stage; of equal texts the row with the
smallest id stays (one with a NULL id only where the group has no other), of near duplicates
the one with the smallest id; mixing may repeat a document up to three times or leave it out;
an empty table gives no sequences; without labels only the fixed rules reject.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plenum.llm import exact_dedup, mixing, ngram_join, packing, quality
from plenum.llm.queries import tokenizer_path
from plenum.plans.tables import Tables
from plenum.session import materialize, split_skewed_joins


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the isolation forest keep."""
    return quality.keep_good(docs, Tables(spark, sf_dir)("labels", "doc_id", "quality"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by n-gram similarity."""
    return ngram_join.one_of_each(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix_documents(docs)


def packing_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids, none of which crosses documents."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_duplicates),
    ("ngram_jaccard_join", near_duplicates),
    ("mixing", mixing_sources),
    ("packing", packing_sequences),
]

# The verdict of an isolation forest and the ids of a tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    split_skewed_joins(spark)
    docs = Tables(spark, sf_dir)("documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
