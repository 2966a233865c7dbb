"""A corpus pipeline: quality, near-duplicate documents, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on what the stage before it kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfeed.llm.common import materialise, table
from loomfeed.llm.jaccard_join import similarity_classes
from loomfeed.llm.packing import pack
from loomfeed.llm.quality import classify
from loomfeed.llm.substring_dedup import remove_repeats


def _free(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps, as they are; null and empty texts are kept."""
    out = _free(docs, "quality")
    return classify(docs, table(spark, sf_dir, "labels"), out_col=out).where(F.col(out)["kept"]).drop(out)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one with the smallest id.

    Near duplicates share 0.8 of their five-word shingles. Rows with a null id stay, as do
    documents without words. Of rows that repeat an id, those with equal texts count as one;
    different texts of a kept id all stay.
    """
    first = similarity_classes(docs, n=5, percent=80).where("doc_id = component_id").select("doc_id").distinct()
    key, one = _free(docs, "text_digest"), docs.where("doc_id IS NOT NULL").join(first, "doc_id", "left_semi")
    one = one.withColumn(key, F.sha2(F.coalesce("text", F.lit("")), 256)).dropDuplicates(["doc_id", key]).drop(key)
    return one.select(docs.columns).unionByName(docs.where("doc_id IS NULL"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the passages that an earlier one holds; texts that lose nothing stay as they are.

    n_chars, where there is such a column, follows the text.
    """
    out = _free(docs, "cut")
    cut = remove_repeats(docs, out_col=out)
    less, kept = F.col(out)["n_removed"] > 0, F.col(out)["kept"]
    new = {"text": F.when(less, kept).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(less, F.length(kept).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return cut.withColumns(new).drop(out)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 1024 tokens."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", jaccard_join),
    ("substring dedup", substring_dedup),
    ("best-fit packing", best_fit_packing),
]

#: No stage but the substring dedup can be written in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, "stage")
    return docs
