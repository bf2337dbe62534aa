"""The corpus pipeline: stages that each take documents and give what the next one reads.

Every stage but the last gives the columns of documents. Stages: documents whose language isn't found go; documents of
low quality go; of each class of near copies the document of smallest id stays; documents that hold a benchmark item go;
what is left is packed into sequences.

Defined results: documents of null or empty text go with the language; a null id is a document of its own in every stage;
rows that repeat are copies, of which one stays; of ties the smallest id stays; other columns are carried along whatever
their names, up to packing, which reads none; empty tables give no rows. Labels without a document teach nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairloom.llm import decontaminate, language_id, ngram_join, packing, quality
from pairloom.llm.common import removed, table, written
from pairloom.llm.queries import tokenizer_file


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs, language_id.learn(docs))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_file(), special_as_text=False)


STAGES = [("language", identified), ("quality", good), ("near_copies", distinct), ("decontamination", decontaminated), ("packing", packed)]
#: Learnt models and MinHash can't be said in SQL: tests/llm holds the whole run against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder, each written as Parquet in the shared folder and read again.

    What a stage has read is deleted once its own rows are written.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs, path = written(docs, f"stage-{name}")
            if before:
                removed(spark, before)
            before = path
    return docs
