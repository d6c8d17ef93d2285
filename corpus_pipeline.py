"""Corpus cleaning from documents to packed sequences, one Parquet table a stage."""

from __future__ import annotations

from lexifold.llm import decontaminate, ngram_join, packing, pii, quality, textblocks
from lexifold.llm.token_output import scratch


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_filter(spark, docs, sf_dir):
    """Drops the documents that the quality classifier rejects (score below 0.7)."""
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    scored = quality.score(textblocks.set_aside(docs, ("score", "predicted")), model)
    return textblocks.put_back(scored.where("predicted = 1"), docs.columns)


def near_duplicates(spark, docs, sf_dir):
    """Keeps the smallest doc_id of each group linked by 5-word shingles at a similarity of 0.8."""
    return ngram_join.keep_one(docs, n=5, num=80, den=100)


def benchmark_decontamination(spark, docs, sf_dir):
    """Cuts every passage of the benchmark out of the texts."""
    return decontaminate.remove_hits(docs, _table(spark, sf_dir, "benchmark"))


def personal_data(spark, docs, sf_dir):
    """Replaces personal data, and terms that disclose it, by marks."""
    return pii.sanitise(docs)


def best_fit_packing(spark, docs, sf_dir):
    """Packs the ids of all documents into sequences of several lengths."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("PII", personal_data),
    ("best-fit packing", best_fit_packing),
]

#: No SQL: a fitted classifier, a packing. tests/llm holds it against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over documents; each reads what the one before has written to the shared folder."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
