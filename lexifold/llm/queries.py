"""The registered queries of this folder's operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark, sf_dir):
    from . import toxicity

    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_pii_sanitisation(spark, sf_dir):
    from . import pii

    return pii.report(table(spark, sf_dir, "documents"))


def op3_suffix_array_dedup(spark, sf_dir):
    from . import suffix_dedup

    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def op4_chat_formatting(spark, sf_dir):
    from . import chat

    return chat.report(table(spark, sf_dir, "conversations"))


def op5_exact_top_k(spark, sf_dir):
    from . import mtree

    return mtree.top_k(table(spark, sf_dir, "embeddings"))


def op6_benchmark_decontamination(spark, sf_dir):
    from . import decontaminate

    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_best_fit_packing(spark, sf_dir):
    from . import packing

    return packing.pack(table(spark, sf_dir, "documents"))


def op8_token_output(spark, sf_dir):
    from . import token_output

    return token_output.report(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark, sf_dir):
    from . import quality

    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_ngram_jaccard_join(spark, sf_dir):
    from . import ngram_join

    return ngram_join.JaccardJoin(table(spark, sf_dir, "documents"), n=4, num=85, den=100).membership()


def op11_lm_scoring(spark, sf_dir):
    from . import bloom_lm

    return bloom_lm.report(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark, sf_dir):
    from . import hard_negatives

    return hard_negatives.mine(hard_negatives.relabelled(table(spark, sf_dir, "embeddings")))


def op13_periodic_runs(spark, sf_dir):
    from . import periodic_runs

    return periodic_runs.report(table(spark, sf_dir, "documents"))


def queries():
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql():
    from . import chat, decontaminate, hard_negatives, mtree, ngram_join, pii

    return {"op2_pii_sanitisation": pii.oracle(), "op4_chat_formatting": chat.oracle(), "op5_exact_top_k": mtree.ORACLE, "op6_benchmark_decontamination": decontaminate.ORACLE, "op10_ngram_jaccard_join": ngram_join.ORACLE, "op12_hard_negatives": hard_negatives.ORACLE}
