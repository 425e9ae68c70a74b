"""From raw documents to packed training sequences: five stages over whole tables.

Each stage takes (spark, docs, sf_dir) and returns a table, which is written as Parquet and read again
as the next one's docs. All but the last return the columns of documents.
"""

from pyspark.sql import DataFrame, SparkSession

from caseledger.llm.line_rules import cleaned
from caseledger.llm.mixing import mixed_documents
from caseledger.llm.near_duplicates import one_per_group
from caseledger.llm.packing import packed
from caseledger.llm.pairwise_quality import good_only
from caseledger.llm.shared import prepare, stored


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for label 1, as they are.

    Null and empty texts are judged like others (and have no words to speak for them), rows with null or repeated ids each for
    itself. Where the labels of the documents are not of both kinds all documents stay. An empty table stays empty.
    """
    return good_only(docs, prepare(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without the lines that fail them; n_chars follows the text.

    Null and empty texts have too few words and go, rows with null or repeated ids are judged each for itself. An empty table
    stays empty.
    """
    prepare(spark)
    return cleaned(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity of 0.8 or more), the one with the smallest id.

    Of rows with equal ids the first by text stays; rows with a null id all stay, as do documents without words. An empty table
    stays empty.
    """
    prepare(spark)
    return one_per_group(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, or as far, as the weights of their sources ask for: a row per pass over a document.

    Null and empty texts have no words to take and go. A null source and an empty one are sources of their own; rows with null or
    repeated ids are taken each for itself. An empty table stays empty.
    """
    prepare(spark)
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of at most 1024 tokens.

    Null and empty texts are the end token alone, rows with null or repeated ids are packed each for itself. An empty table gives
    no pieces.
    """
    prepare(spark)
    return packed(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("source mix", source_mix),
    ("packing", packing),
]

#: A learned classifier, signatures and a tokenizer are no SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
