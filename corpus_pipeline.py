"""The corpus pipeline: each stage works on all that its predecessor kept, written as Parquet in the shared folder and read again.

1. quality rules: documents that the rules reject go, and lines above the limit leave the others; n_chars follows the text;
2. exact dedup: of equal texts the largest doc_id stays;
3. MinHash near-dedup (five words, 0.8): one document of each group stays;
4. substring dedup: repeated sentence spans leave all documents but the first that holds them; n_chars follows the text;
5. packing: the documents' tokens in sequences along the Hilbert curve, a row a piece.

Nulls, empty and very long texts, ties, repeated rows and empty tables are treated as each operator says; stages 1 to 4
keep extra columns. When a stage begins, the tables that its predecessors left in the shared folder are deleted, but for those it reads.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import common as C
from newsloom.llm import exact_dedup, minhash_dedup, packing, quality_rules, substring_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    good = quality_rules.keep_good(docs)
    return good.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else good


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_dedup.drop_near_copies(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    freed = substring_dedup.remove_repeats(docs).select(*docs.columns)
    return freed.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else freed


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.crc32_of(packing.pack(docs))


#: By application, the tables that earlier stages left in the shared folder.
_left: dict[str, list[str]] = {}


def cleaned(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, which deletes before it begins what earlier stages left, but for the tables that its docs read: their results have been written by then."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        left = _left.pop(spark.sparkContext.applicationId, [])
        files = docs.inputFiles() if left else []
        read = [p for p in left if any(p.rpartition("/")[2] in f for f in files)]
        C.delete_tables(spark, [p for p in left if p not in read])
        with C.noted() as made:
            out = stage(spark, docs, sf_dir)
        _left[spark.sparkContext.applicationId] = [*read, *made]
        return out

    return run_stage


STAGES = [(name, cleaned(f)) for name, f in (("quality rules", quality), ("exact dedup", exact), ("minhash near-dedup", near), ("substring dedup", substrings), ("packing", pack))]
#: SQL has no HyperMinHash, sentence runs or tokens; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            with C.noted() as made:
                docs = C.materialize(docs)
            _left.setdefault(spark.sparkContext.applicationId, []).extend(made)
    return docs
