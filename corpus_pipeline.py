"""A training-corpus pipeline of five stages over `documents`, each written as Parquet and read again by the next.

Quality resampling drops the documents that the classifier rejects (toxic or of low quality by the `labels`); of each group of
near copies (five words, similarity 0.8) one document stays; documents contaminated by `benchmark` go; sources are mixed to
their target weights, which repeats some documents and leaves out others; what is left is packed as token ids.

All stages but the last return the columns of documents, whatever their names and order; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.decontaminate import decontaminated
from tidemark.llm.jaccard import one_of_each
from tidemark.llm.mixing import mixed
from tidemark.llm.packing import packed_rows
from tidemark.llm.quality import resampled
from tidemark.llm.tables import saved


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the resampling chooses. Null and empty texts weigh nothing and count as the best; rows with one doc_id draw the same noise; ties stay together."""
    return resampled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, that of the smallest doc_id. Wordless texts link with nothing and stay; repeated rows leave one; rows without doc_id stay."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words are hit. Wordless texts are clean; repeated rows are judged each."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them, at most three times. A null source is a source; wordless texts have no size and come with their block or not; rows with one doc_id are drawn together."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of 2,048 token ids; null and empty texts have none, repeated documents are packed each."""
    import public_tokenizers

    return packed_rows(docs, public_tokenizers.path("piece_bpe_32k.model"), 32_000)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("packing", packing),
]

#: Hashed models, draws and packing are beyond SQL; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
