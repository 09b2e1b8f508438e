"""From raw documents to packed training sequences, in stages that are each written and read again.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. Rows with nulls, empty texts and
repeated rows go through each stage as its operator's docstring says; columns other than those of documents are dropped.
Each begins with heaps that hold nothing of the one before, so that its Python workers have room beside them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import decontaminate, jaccard_join, packing, quality, secret_scan
from gridloom.llm.common import DOCUMENT_COLUMNS, collect_heaps, release, staged, table, text_key, tokenizer_path

#: Flagged rows, of two numbers and a short text, that may be broadcast.
BROADCAST_ROWS = 200_000


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose quality score is below the cut; none where the labels teach nothing."""
    collect_heaps(spark)
    docs = docs.select(*DOCUMENT_COLUMNS)
    sketch, net = quality.fit(docs, table(spark, sf_dir, "labels"))
    if not net.learned:
        return docs
    return quality.scores(docs, sketch, net).where(F.col("score") >= quality.CUT).select(*DOCUMENT_COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near copies (five words, Jaccard of 0.8 or more).

    Rows that repeat another's doc_id and text go. Of rows without a doc_id, those go that are like a row with one, or
    have the same text as another without.
    """
    collect_heaps(spark)
    docs = docs.select(*DOCUMENT_COLUMNS).withColumn("_h", text_key())
    kept = jaccard_join.classes(docs, 5, 80, 100).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_d"), F.col("h").alias("_k")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_h") == F.col("_k"))
    return docs.join(kept, same, "left_semi").dropDuplicates(["doc_id", "_h"]).select(*DOCUMENT_COLUMNS)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a copy, edited or not, of a benchmark item."""
    collect_heaps(spark)
    out = decontaminate.annotate(docs, table(spark, sf_dir, "benchmark"), list(DOCUMENT_COLUMNS))
    return out.where(F.size("matches") == 0).select(*DOCUMENT_COLUMNS)


def drop_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents in which the secret scan reports a span."""
    collect_heaps(spark)
    docs = docs.select(*DOCUMENT_COLUMNS)
    flagged = staged(secret_scan.scan(docs).where("spans <> ''").select("row").distinct(), "flagged")
    flagged = flagged if flagged.count() > BROADCAST_ROWS else F.broadcast(flagged)
    return docs.withColumn("_row", secret_scan.row_key()).join(flagged.withColumnRenamed("row", "_row"), "_row", "left_anti").select(*DOCUMENT_COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences that hold every document."""
    collect_heaps(spark)
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), end_id=2)


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_each),
    ("benchmark decontamination", drop_benchmark_copies),
    ("secret scans", drop_secrets),
    ("packing", pack),
]

#: The stages hold trained scores and tokenizers, which SQL can't express; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make() -> DataFrame:
        docs = table(spark, sf_dir, "documents")
        for i, (_, stage) in enumerate(STAGES):
            docs = release(lambda docs=docs, stage=stage: stage(spark, docs, sf_dir), f"pipeline-{i}")
        return docs

    return release(make, "pipeline")
