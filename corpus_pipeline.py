"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again as the next one's input.

1. toxicity: documents that the classifier rejects go (it learns from the table `labels`).
2. near-dedup: one document of each class of near duplicates stays, that of the least key.
3. decontamination: passages of `benchmark` are cut out of the texts; a document that is nothing else goes.
4. secrets: each secret in a text becomes a mark; all documents stay.
5. packing: the texts' ids are laid end to end and cut into sequences; one row a piece.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from taxolith.llm import common, decontamination, near_duplicates, packing, secrets, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.deduplicated(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.cleaned(docs, common.table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", cut_benchmark),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: SQL can't express the learned classifier; tests hold run() against a plain version of each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, common.written(stage(spark, docs, sf_dir), name)
        if k:
            common.discard(before)  # the next stage's table is complete
    return docs
