"""Corpus pipeline: documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs. All but the last return the columns of documents, with the
documents' own values, whatever they are called.

Stages decide by row: null doc_ids are rows like others, different texts under one doc_id are judged one by one, and
equal rows alike, of which the near-duplicate stage keeps one. Ties there go to the smaller doc_id. Empty and null texts
fail the base rules of the first stage. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrarisk.llm import decontaminate, jaccard_join, packing, quality_rules, weak_label
from terrarisk.llm.common import marks, table, without, written

#: Near copies share four fifths of their shingles of five words; the defaults of jaccard_components are op10's contract.
NEAR_WIDTH, NEAR_PERCENT = 5, 80


def _kept(docs: DataFrame, judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows that judge keeps; the documents' other columns stand aside meanwhile, so that no new column replaces them."""
    other = [c for c in docs.columns if c not in ("doc_id", "text")]
    aside = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(f"_own{i}") for i, c in enumerate(other)])
    back = {c: F.col(f"_own{i}") for i, c in enumerate(other)} | {"doc_id": F.col("doc_id"), "text": F.col("text")}
    return judge(aside).filter("kept").select(*[back[c].alias(c) for c in docs.columns])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _kept(docs, lambda d: quality_rules.quality_rules(d, table(spark, sf_dir, "labels")))


def keep_classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _kept(docs, weak_label.weak_label_classifier)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs, NEAR_WIDTH, NEAR_PERCENT)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.find(docs, table(spark, sf_dir, "benchmark"))
    hit = found.filter("contaminated").select(F.col("ident").alias("_ident"), F.col("twin").alias("_twin")).distinct()
    keyed = docs.withColumns({f"_{k}": v for k, v in marks().items()})
    return without(keyed, hit, ["_ident", "_twin"]).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality rules", keep_quality),
    ("quality classifier", keep_classified),
    ("near duplicates", one_of_each_group),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: SQL can't express the hashed likelihoods of the first stage; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
    return docs
