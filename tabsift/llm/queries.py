"""The registered query of each operator, with its production parameters over its whole table.

Operators 11 to 13 have SQL (``sql.py``). The others have none: encoders, hashes, trained models and alignments are beyond
it, and ``tests/llm`` compares each with a brute-force version, an exact round trip or held-out labels.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fill_middle, html_text, importance, lm, packing, partenum, pii, quality, simhash, sql, token_ids, toxicity, urls
from .common import crc_mod, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.toxicity(docs, model).withColumn("held_out", F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False)))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.packed_sequences(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents"))


#: The rules of the URL query: verdict, host, path.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"), URL_RULES)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.reports(table(spark, sf_dir, "documents"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(crc_mod(F.col("doc_id"), 5) == 1, F.lit(False))
    found = lm.scores(table(spark, sf_dir, "documents").select("doc_id", "text", (~held).alias("train")), "train")
    return found.withColumn("held_out", held)


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_ids.write_token_files(table(spark, sf_dir, "documents"))
    return token_ids.read_token_files(files, keep_ids=False)


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    back = fill_middle.restored(F.col("form"), F.col("output"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(back, 256).alias("restored_sha256"))


def op13_partenum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.joined_sets(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_packing": op2_packing,
    "op3_quality": op3_quality,
    "op4_urls": op4_urls,
    "op5_decontaminate": op5_decontaminate,
    "op6_simhash": op6_simhash,
    "op7_pii": op7_pii,
    "op8_html": op8_html,
    "op9_lm": op9_lm,
    "op10_token_ids": op10_token_ids,
    "op11_importance": op11_importance,
    "op12_fill_middle": op12_fill_middle,
    "op13_partenum": op13_partenum,
}
ORACLES: dict[str, str] = {
    "op11_importance": sql.OP11,
    "op12_fill_middle": sql.OP12,
    "op13_partenum": sql.OP13,
}
