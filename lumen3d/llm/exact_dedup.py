"""Exact deduplication by a tree merge of sorted digest runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumen3d.llm.common import ascii_lower, shared_table, whole_text

KEY = ("sha", "n_bytes", "check")


def merged_runs(entries: DataFrame, keep: str) -> DataFrame:
    """Entries (run, KEY, best, n) of sorted runs that now share a number, merged: one for each text, told by the whole KEY.

    A run's slice of a task comes sorted by run, digest and identifier, parts of the runs before being merged by
    the sort; a window over that order sees the entries of a text as neighbours.
    """
    by_text = W.partitionBy("run", *KEY).orderBy(F.asc_nulls_last("best") if keep == "smallest" else F.desc_nulls_last("best"))
    whole = by_text.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    placed = entries.select("run", *KEY, "best", F.row_number().over(by_text).alias("place"), F.sum("n").over(whole).alias("n"))
    return placed.where("place = 1").drop("place")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", runs: int = 64) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their A-Z-lower-cased forms are; the key is SHA-256, verified by byte length and a
    second hash at every merge. Rows are dealt over `runs` runs by a hash of their identifier, and each run is
    reduced to one entry per text before anything moves. In round r, the runs whose numbers agree but for their bit
    r send their entries to the tasks of the merged run, where they are merged in the order of the digest; of equal
    neighbours in it, the entry with the identifier to keep goes on, with the sum of their sizes. Binomial rounds
    end with one run, and a text with any number of copies costs at most one entry per run in each. The surviving
    entries go back down to the runs, where rows meet them under (run, text): a hot text stays spread over all runs.

    keep: "smallest" or "largest" identifier of a group stays.
    Null text counts as empty, and all empty texts are one group. A null identifier never wins against others;
    where a whole group has none, keep_id is null and each row is kept. Rows that repeat an identifier and its
    text share their fate. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep: {keep}")
    best = F.min if keep == "smallest" else F.max
    texts = docs.select(F.col(id_col).alias("id"), ascii_lower(whole_text(text_col)).alias("norm"))
    rows = shared_table(
        texts.select(
            "id",
            F.unhex(F.sha2("norm", 256)).alias("sha"),
            F.octet_length("norm").alias("n_bytes"),
            F.xxhash64("norm").alias("check"),
            F.pmod(F.xxhash64("id"), F.lit(runs)).cast("int").alias("run"),
        ),
        "exact-digests",
    )
    level = leaves = rows.groupBy("run", *KEY).agg(best("id").alias("best"), F.count("*").alias("n"))
    for _ in range((runs - 1).bit_length()):
        level = merged_runs(level.withColumn("run", F.shiftright("run", 1)), keep)
    groups = level.where("n > 1").select(*KEY, F.col("best").alias("keep_id"), F.col("n").alias("group_size"))
    down = leaves.select("run", *KEY).join(groups, list(KEY))
    found = rows.join(down, ["run", *KEY], "left")
    keep_id = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return found.select(
        F.col("id").alias("doc_id"),
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep_id).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
