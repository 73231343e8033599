"""Sharding by sampled splitters over text digests."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumen3d.llm.common import shared_table, whole_text

#: Ranges that the sampled splitters make of each shard's share; a text heavier than one range is placed by itself.
RANGES_PER_SHARD = 64
#: Sampled keys per range, in expectation.
SAMPLES_PER_RANGE = 16


def _places(cuts: np.ndarray):
    """A pandas function from keys to the number of cuts at or below them."""

    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, keys.to_numpy(np.int64), side="right").astype(np.int32))

    return place


def shard_documents(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8, rows_per_run: int = 1000) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot. Shards' sizes are near equal.

    The key is a digest of the text, so equal texts are neighbours and share a shard. Texts whose copies weigh
    more than a range are placed first, the heaviest to the emptiest shard; one that outweighs a whole shard is
    subdivided by a hash of the identifier, and its parts are weighed. There are at most 2 * n_shards * RANGES_PER_SHARD of these. Of the other
    keys a sample is drawn, each with a chance in proportion to its weight; its quantiles are the splitters of
    n_shards * RANGES_PER_SHARD ranges. The exact weight of each range tells which of them hold a shard's
    boundary; only those are overfull for their shards, and are subdivided at the exact key. Sizes then differ by
    about one light text.

    Slots number each shard's rows from 0 without gaps: by range, by hash run within a range of more than
    rows_per_run rows, by key and identifier within a run. No shard or text is ever numbered in one task.

    Null text has no bytes and counts only the overhead; null and empty texts are equal. Null identifiers sort
    first; rows that repeat an identifier and its text get a slot each. An empty table gives no rows. Other
    columns are ignored, whatever their names.
    """
    body = whole_text(text_col)
    rows = shared_table(
        docs.select(F.col(id_col).cast("long").alias("id"), (F.octet_length(body) + overhead).cast("long").alias("size"), F.xxhash64(body).alias("key"), F.crc32(body.cast("binary")).alias("crc")),
        "shard-rows",
    )
    groups = shared_table(rows.groupBy("key").agg(F.sum("size").alias("weight"), F.count("*").alias("n")), "shard-keys")
    total, n_rows = groups.agg(F.sum("weight"), F.sum("n")).first()
    total, n_rows = total or 0, n_rows or 0
    share, ranges = total / n_shards, n_shards * RANGES_PER_SHARD
    is_heavy = (F.col("weight") > total / ranges) | (F.col("n") > max(rows_per_run, n_rows / ranges))

    pick = F.pmod(F.xxhash64("id", F.lit("part")), F.lit(1 << 30))
    hot = [(key, weight, n, max(1, int(np.ceil(weight / share)))) for key, weight, n in groups.where(is_heavy).collect()]
    # what a hash of the identifier makes of the parts of a text is known only when they are weighed
    split = [(key, parts) for key, _, _, parts in hot if parts > 1]
    weighed = {}
    if split:
        kept = rows.join(F.broadcast(docs.sparkSession.createDataFrame(split, "key long, parts int")), "key")
        weighed = {(key, part): weight for key, part, weight in kept.groupBy("key", (pick % F.col("parts")).cast("int").alias("part")).agg(F.sum("size")).collect()}
    load, placed = [0.0] * n_shards, []
    for key, weight, n, parts in sorted(hot, key=lambda g: (-g[1], g[0])):
        order = sorted(range(n_shards), key=lambda s: (load[s], s))[:parts]
        pieces = sorted(((weighed.get((key, part), 0) if parts > 1 else weight), part) for part in range(parts))
        for turn, (piece, part) in enumerate(reversed(pieces)):
            load[order[turn % n_shards]] += piece
            placed.append((key, part, parts, order[turn % n_shards], max(1, -(-n // rows_per_run))))

    light = groups.where(~is_heavy).select("key", "weight")
    chance = F.pmod(F.xxhash64("key", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    sampled = sorted(k for (k,) in light.where(chance < F.col("weight") * (SAMPLES_PER_RANGE * ranges / max(total, 1))).select("key").collect())
    splitters = np.array(sampled, np.int64)[np.linspace(0, len(sampled), ranges + 1)[1:-1].astype(int)] if len(sampled) >= ranges else np.array(sampled, np.int64)
    splitters = np.unique(splitters)
    in_range = light.withColumn("range", _places(splitters)("key"))
    weights = dict(map(tuple, in_range.groupBy("range").agg(F.sum("weight")).collect()))
    cuts = _cuts(in_range, weights, load, total, n_shards)

    runs_per_range = max(1, -(-n_rows // (ranges * rows_per_run)))
    heavy = F.broadcast(docs.sparkSession.createDataFrame(placed, "key long, part int, parts int, heavy_shard int, runs int")) if placed else None
    if heavy is not None:
        parts_of = heavy.groupBy("key").agg(F.first("parts").alias("parts"), F.first("runs").alias("runs"), F.map_from_entries(F.collect_list(F.struct("part", "heavy_shard"))).alias("shards"))
        rows = rows.join(F.broadcast(parts_of), "key", "left")
        own = F.element_at("shards", (pick % F.col("parts")).cast("int"))
        heavy_run = F.pmod(F.xxhash64("id", F.lit("run")), F.col("runs"))
    else:
        own, heavy_run = F.lit(None).cast("int"), F.lit(None).cast("long")
    at = rows.withColumns({"shard": F.coalesce(own, _places(cuts)("key")), "lane": F.when(own.isNull(), _places(splitters)("key").cast("long")).otherwise(F.col("key")), "is_heavy": own.isNotNull(), "run": F.coalesce(heavy_run, F.pmod(F.xxhash64("key", F.lit("run")), F.lit(runs_per_range)))})
    at = shared_table(at.select("id", "size", "crc", "key", "shard", "is_heavy", "lane", "run"), "shard-places")
    lane = ["shard", "is_heavy", "lane", "run"]
    counts = at.groupBy(*lane).agg(F.count("*").alias("n"))
    starts = counts.select(*lane, (F.sum("n").over(W.partitionBy("shard").orderBy("is_heavy", "lane", "run").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")).alias("before"))
    slot = F.row_number().over(W.partitionBy(*lane).orderBy("key", "id", "crc")) - 1
    return at.join(starts, lane).select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("before") + slot).cast("long").alias("slot"))


def _cuts(in_range: DataFrame, weights: dict[int, int], load: list[float], total: int, n_shards: int) -> np.ndarray:
    """The n_shards - 1 keys at which one shard ends and the next begins.

    load: what heavy texts have put into each shard. The room that is left to each is filled in key order; a shard
    that they overfill gets none.
    """
    light = sum(weights.values())
    low, high = 0.0, float(total) + 1
    for _ in range(100):  # the level up to which light keys fill the shards
        level = (low + high) / 2
        low, high = (level, high) if sum(max(0.0, level - x) for x in load) < light else (low, level)
    ends = np.cumsum([max(0.0, high - x) for x in load])[:-1]
    numbers = sorted(weights)
    up_to = np.cumsum([weights[r] for r in numbers]) if numbers else np.zeros(0)
    where = np.searchsorted(up_to, ends, side="left")
    wanted = sorted({numbers[w] for w in where if w < len(numbers)})
    found = np.full(n_shards - 1, np.iinfo(np.int64).max, np.int64)
    if not wanted:
        return found
    before = {r: float(up_to[i] - weights[r]) for i, r in enumerate(numbers)}
    targets = {r: [i for i, w in enumerate(where) if w < len(numbers) and numbers[w] == r] for r in wanted}
    by_key = W.partitionBy("range").orderBy("key").rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = in_range.where(F.col("range").isin(wanted)).withColumn("sum", F.sum("weight").over(by_key))
    marks = in_range.sparkSession.createDataFrame([(r, i, float(ends[i]) - before[r]) for r in wanted for i in targets[r]], "range int, cut int, goal double")
    # the first key that lies beyond the goal opens the next shard
    for cut, key in sums.join(F.broadcast(marks), "range").where(F.col("sum") - F.col("weight") / 2 > F.col("goal")).groupBy("cut").agg(F.min("key")).collect():
        found[cut] = key
    for r in wanted:  # a goal at the very end of its range: the next range opens the shard
        for i in targets[r]:
            if found[i] == np.iinfo(np.int64).max:
                after = [x for x in numbers if x > r]
                if after:
                    found[i] = in_range.where(F.col("range") == after[0]).agg(F.min("key")).first()[0]
    return np.maximum.accumulate(found)
