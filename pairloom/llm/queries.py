"""The corpus operators as queries over the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.common import pick, shared_folder, split_mod, table


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pairloom.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pairloom.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_file(), special_as_text=False)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pairloom.llm.html_extract import main_texts

    return main_texts(table(spark, sf_dir, "pages"), ["page_id", "url"])


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pairloom.llm.token_output import token_index, write_token_files

    path = shared_folder(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), path, tokenizer_file(), special_as_text=False)
    return token_index(spark, path)


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pairloom.llm.ann import nearest

    return nearest(pick(table(spark, sf_dir, "embeddings"), vec_id="vec_id", embedding="embedding"), F.col("vec_id") % 50 == 0)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pairloom.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score_documents(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select("doc_id", (split_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "worst")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pairloom.llm import language_id

    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.learn(docs), ["doc_id"])
    return found.select("doc_id", (split_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pairloom.llm import quality

    docs = table(spark, sf_dir, "documents")
    scored = quality.score_documents(docs, quality.learn(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select("doc_id", (split_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pairloom.llm.license_scan import scan

    return scan(table(spark, sf_dir, "documents"), ["doc_id"]).drop("places")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pairloom.llm.ngram_join import jaccard_classes

    return jaccard_classes(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_packing, op3_html_extraction, op4_token_output, op5_ann, op9_ngram_join, op6_toxicity, op7_language_id, op8_license_scan, op10_quality)}
SQL: dict[str, str] = {}
