"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumen3d.llm.common import WORD, broadcast_if_small, shared_table, whole_text

#: Hex digits of an MD5 digest that make a non-negative 60-bit integer.
DIGITS = 15
SOURCE = ("named", "name")


def size_class(size: Column) -> Column:
    """Grows with size; sizes of one class differ by a thirty-second at most."""
    bits = F.length(F.bin(size))
    shift = F.greatest(bits - 6, F.lit(0))
    return (bits * 64 + F.call_function("shiftright", size, shift)).cast("int")


def digest(value: Column) -> Column:
    """60 bits of the MD5 digest of a text."""
    return F.conv(F.substring(F.md5(value.cast("binary")), 1, DIGITS), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """sizes (named, name, source_size) with target: weights repeat over the sources in code-point order.

    With sources in order of cap / weight, what each leading set of capped sources leaves to a unit of weight is
    largest for the right set, so the level that resharing converges to is a maximum over them.
    """
    by_name = W.orderBy(F.desc("named"), "name")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    with_weight = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * cap)
    by_room = W.orderBy(F.col("most") / F.col("weight"), F.desc("named"), "name")
    everything = W.partitionBy()
    before = F.coalesce(F.sum("most").over(by_room.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    onward = F.sum("weight").over(by_room.rowsBetween(W.currentRow, W.unboundedFollowing))
    level = (F.sum("source_size").over(everything) - before) / onward
    return with_weight.withColumn("level", level).withColumn("level", F.max("level").over(everything)).select(*SOURCE, "source_size", F.least("most", F.col("level") * F.col("weight")).cast("double").alias("target"))


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), cap: int = 3, seed: int = 0, rows_per_slice: int = 20_000, broadcast_rows: int = 1_000_000
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken.

    A document's expected copies are its source's target over its source's size. Their prefix sums within the
    source, in order of size class and then of a hash of identifier and text, get one random offset, drawn from
    the seed and the source; a document comes once for each integer that its interval crosses. Order by size makes
    each source's taken words differ from its target by about one long document at most. The prefix sums come from
    counts: per class of a source, per hash slice of a class and per row of a slice, so no source is ever in one
    task. Slices double in number with the rows; the order, and so the result, does not depend on them.

    Null text has size 0. A null source is a source of its own and comes last; the empty string is another. A
    source without words has target 0 and takes nothing. Rows that repeat an identifier, or have none, are sampled
    one by one. An empty table gives no rows. Other columns are ignored, whatever their
    names.
    """
    rows = shared_table(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).isNotNull().alias("named"),
            F.coalesce(F.col(source_col), F.lit("")).alias("name"),
            F.regexp_count(whole_text(text_col), F.lit(WORD)).cast("long").alias("size"),
            digest(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"), whole_text(text_col))).alias("h"),
        ).withColumn("class", size_class(F.col("size"))),
        "mixing-sizes",
    )
    bits = max(0, (-(-rows.count() // rows_per_slice) - 1).bit_length())
    rows = rows.withColumn("slice", F.shiftright("h", 4 * DIGITS - bits).cast("int") if bits else F.lit(0))
    slices = rows.groupBy(*SOURCE, "class", "slice").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    classes = slices.groupBy(*SOURCE, "class").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    targets = source_targets(classes.groupBy(*SOURCE).agg(F.sum("words").alias("source_size")), weights, cap)
    up_to = lambda w: F.sum("n").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")
    starts = classes.select(*SOURCE, "class", up_to(W.partitionBy(*SOURCE).orderBy("class")).alias("class_start"))
    places = slices.select(*SOURCE, "class", "slice", up_to(W.partitionBy(*SOURCE, "class").orderBy("slice")).alias("slice_start")).join(starts, [*SOURCE, "class"])
    key = [*SOURCE, "class", "slice"]
    rank = F.col("class_start") + F.col("slice_start") + F.row_number().over(W.partitionBy(*key).orderBy("h", "id", "size"))
    ranks = shared_table(rows.join(places, key).select("id", *SOURCE, "size", rank.alias("rank")), "mixing-ranks")
    offset = digest(F.concat(F.lit(f"{seed}:"), F.col("named").cast("string"), F.lit(":"), F.col("name"))) / F.lit(float(1 << 4 * DIGITS))
    sources = shared_table(targets.select(*SOURCE, "source_size", "target", F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)).alias("rate"), offset.alias("offset")), "mixing-sources")
    crossed = lambda k: F.floor(k * F.col("rate") + F.col("offset"))
    found = ranks.join(broadcast_if_small(sources, broadcast_rows), list(SOURCE)).withColumn("copies", F.least(crossed(F.col("rank")) - crossed(F.col("rank") - 1), F.lit(cap)).cast("long"))
    return found.select(F.col("id").alias("doc_id"), F.when(F.col("named"), F.col("name")).alias("source"), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
