"""From raw documents to packed training sequences: quality, lines, near copies, mixture, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumen3d.functions.tables import finished_table
from lumen3d.llm.common import broadcast_if_small, shared_table
from lumen3d.llm.line_dedup import dedup_lines
from lumen3d.llm.mixing import mix_sources
from lumen3d.llm.near_dedup import near_duplicates
from lumen3d.llm.packing import pack_documents
from lumen3d.llm.quality import fit_quality, score_quality
from lumen3d.llm.queries import QUALITY, tokenizer_path

#: Decisions about up to so many documents are sent to each task, so that texts need not move; more are joined.
BROADCAST_ROWS = 1_000_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts: their whole text scores QUALITY or more."""
    network = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, network, id_col=None, name="_score").where(F.col("_score") >= QUALITY).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that are similar to an earlier one; n_chars follows the text."""
    kept = dedup_lines(docs, threshold=0.8).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    return kept.select(*docs.columns)


def by_row(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs and a column that names each row: doc_id, or, where doc_ids repeat or are null, a number in the order of doc_id and text."""
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        return docs, "doc_id"
    name, order = unused(docs, "_row"), ["doc_id", F.xxhash64("text")]
    return shared_table(docs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id()), "numbered-rows"), name


def unused(docs: DataFrame, name: str) -> str:
    while name in docs.columns:
        name += "_"
    return name


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, on shingles of five words: the one with the smallest doc_id; where doc_ids repeat or are null, the first by_row()."""
    rows, key = by_row(docs)
    dropped = shared_table(near_duplicates(rows, id_col=key, width=5, threshold=0.8).where("not kept").select(F.col("doc_id").alias(key)), "dropped-copies")
    return rows.join(broadcast_if_small(dropped, BROADCAST_ROWS), key, "left_anti").select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mixture takes it, up to three times; rows that share a doc_id, or have none, count one by one."""
    rows, key = by_row(docs)
    copies, times = unused(docs, "_copies"), unused(docs, "_times")
    other = shared_table(mix_sources(rows, id_col=key, weights=(5, 2, 1), cap=3).where("copies <> 1").select(F.col("doc_id").alias(key), F.col("copies").alias(copies)), "mixture-copies")
    taken = rows.join(broadcast_if_small(other, BROADCAST_ROWS), key, "left")
    return taken.withColumn(times, F.explode(F.sequence(F.lit(0), F.coalesce(copies, F.lit(1)).cast("int")))).where(F.col(times) > 0).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens."""
    return pack_documents(docs, tokenizer_path(), capacity=4096, end_id=1)


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("mixture", mixture), ("packing", packing)]

#: SQL has no convolutional network; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents, each written and read again before the next, and its own tables deleted by then."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = finished_table(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), spark, f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
