"""Near-duplicate vectors by an epsilon grid order join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumen3d.llm.common import shared_table
from lumen3d.operators.graph import component_ids

#: Leading principal dimensions that make cells and boxes.
DIMS = 6
#: Children of a sequence interval in the next level of the recursion.
BRANCH = 8
#: Slack for rounding when boxes are held against epsilon; links themselves are judged by cosine alone.
SLACK = 1e-6


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def principal_axes(vectors: DataFrame, sample_rows: int) -> np.ndarray:
    """(size, DIMS): leading axes of at most sample_rows unit vectors, taken by a hash of the class."""
    sample = vectors.orderBy(F.xxhash64("digest"), "digest").limit(sample_rows).select("vector").toPandas()["vector"]
    if not len(sample):
        return np.zeros((0, DIMS))
    size = max(len(v) for v in sample)
    rows = unit_rows(np.stack([np.pad(np.asarray(v, np.float64), (0, size - len(v))) for v in sample]))
    values, axes = np.linalg.eigh(np.cov(rows.T, bias=True).reshape(size, size))
    axes = axes[:, np.argsort(values)[::-1]][:, :DIMS]
    return np.pad(axes, ((0, 0), (0, DIMS - axes.shape[1])))


def projected(vectors: DataFrame, axes: np.ndarray) -> DataFrame:
    """vectors with p0.. on the axes; vectors of another length than the axes are cut or filled up, which keeps distances from growing."""
    names = [f"p{i}" for i in range(DIMS)]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("vector")).to_pylist()
            places = np.zeros((len(lists), DIMS))
            for i, v in enumerate(lists):
                row = np.asarray(v, np.float64)
                n = min(len(row), len(axes))
                places[i] = (row / np.linalg.norm(row))[:n] @ axes[:n]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(places[:, i]) for i in range(DIMS))], names=[*batch.schema.names, *names])

    return vectors.mapInArrow(project, f"cls long, label string, size int, copies long, vector array<double>, {', '.join(f'{n} double' for n in names)}")


def in_blocks(ordered: DataFrame, rows_per_block: int) -> DataFrame:
    """Runs of the grid order as rows: label, part, block, box and the vectors of up to rows_per_block classes."""
    names = [f"p{i}" for i in range(DIMS)]

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        block = 0

        def row(rows: pd.DataFrame) -> dict:
            nonlocal block
            block += 1
            first = rows.iloc[0]
            matrix = np.stack([np.asarray(v, np.float64) for v in rows["vector"]])
            box = rows[names]
            return {"label": first["label"], "size": int(first["size"]), "part": int(first["part"]), "block": block - 1, "low": box.min().tolist(), "high": box.max().tolist(), "ids": rows["cls"].tolist(), "copies": rows["copies"].tolist(), "matrix": matrix.tobytes()}

        for frame in frames:
            held.append(frame)
            together = pd.concat(held, ignore_index=True)
            change = (together["label"].ne(together["label"].shift()) | together["size"].ne(together["size"].shift())).cumsum()
            runs = [g for _, g in together.groupby(change, sort=False)]
            out = []
            for i, run in enumerate(runs):
                whole = len(run) // rows_per_block * rows_per_block if i == len(runs) - 1 else len(run)
                out += [row(run.iloc[at : at + rows_per_block]) for at in range(0, whole, rows_per_block)]
            held = [runs[-1].iloc[len(runs[-1]) // rows_per_block * rows_per_block :]] if runs else []
            held = [h for h in held if len(h)]
            if out:
                yield pd.DataFrame(out)
        if held:
            rest = pd.concat(held, ignore_index=True)
            yield pd.DataFrame([row(rest.iloc[at : at + rows_per_block]) for at in range(0, len(rest), rows_per_block)])

    return ordered.mapInPandas(cut, "label string, size int, part int, block int, low array<double>, high array<double>, ids array<long>, copies array<long>, matrix binary")


def near(prefix_a: str, prefix_b: str, epsilon: float) -> Column:
    """Whether two boxes may hold points within epsilon."""
    total = F.lit(0.0)
    for i in range(DIMS):
        gap = F.greatest(F.lit(0.0), F.col(f"{prefix_a}_l{i}") - F.col(f"{prefix_b}_h{i}"), F.col(f"{prefix_b}_l{i}") - F.col(f"{prefix_a}_h{i}"))
        total = total + gap * gap
    return total <= (epsilon + SLACK) ** 2


def block_pairs(blocks: DataFrame, parts: int, epsilon: float) -> DataFrame:
    """(a_part, a_block, b_part, b_block, label, size): intervals of the sequence that may hold links, by recursive descent.

    The sequence of a label is one interval of parts; each level splits intervals into BRANCH, and a pair of
    intervals goes down to its children's pairs unless their boxes are further than epsilon apart.
    """
    leaf = blocks.select("label", "size", "part", "block", *[F.col("low")[i].alias(f"l{i}") for i in range(DIMS)], *[F.col("high")[i].alias(f"h{i}") for i in range(DIMS)])
    depth = 0
    while BRANCH**depth < parts:
        depth += 1
    box = [*(F.min(f"l{i}").alias(f"l{i}") for i in range(DIMS)), *(F.max(f"h{i}").alias(f"h{i}") for i in range(DIMS))]
    levels = [leaf.withColumn("node", F.floor(F.col("part") / BRANCH**d).cast("long")).groupBy("label", "size", "node").agg(*box) for d in range(depth, -1, -1)]
    names = [f"{s}{i}" for s in "lh" for i in range(DIMS)]

    def side(level: DataFrame, of: str, up: int | None) -> DataFrame:
        key = [] if up is None else [F.floor(F.col("node") / up).cast("long").alias(f"{of}_up")]
        return level.select("label", "size", *key, F.col("node").alias(f"{of}"), *[F.col(n).alias(f"{of}_{n}") for n in names])

    pairs = side(levels[0], "a", None).join(side(levels[0], "b", None), ["label", "size"]).where("a <= b").where(near("a", "b", epsilon)).select("label", "size", "a", "b")
    for level in levels[1:]:
        up = pairs.select("label", "size", F.col("a").alias("a_up"), F.col("b").alias("b_up"))
        pairs = up.join(side(level, "a", BRANCH), ["label", "size", "a_up"]).join(side(level, "b", BRANCH), ["label", "size", "b_up"]).where("a <= b").where(near("a", "b", epsilon)).select("label", "size", "a", "b")
    ends = lambda of: leaf.select("label", "size", F.col("part").cast("long").alias(of), F.col("block").alias(f"{of}_block"), *[F.col(n).alias(f"{of}_{n}") for n in names])
    found = pairs.join(ends("a"), ["label", "size", "a"]).join(ends("b"), ["label", "size", "b"])
    return found.where("a < b or a_block <= b_block").where(near("a", "b", epsilon)).select("label", "size", F.col("a").cast("int").alias("a_part"), "a_block", F.col("b").cast("int").alias("b_part"), "b_block")


def forest(a: np.ndarray, b: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Of the links a-b between 0..n-1, as few as keep their components."""
    up, kept = list(range(n)), []

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        if (p := top(x)) != (q := top(y)):
            up[max(p, q)] = min(p, q)
            kept.append((x, y))
    return kept


def linked(pairs: DataFrame, threshold: float) -> DataFrame:
    """Rows (a, b, n): of each pair of blocks, the weighted number of links n of vector a (b null), and links a-b that keep the components (n null)."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for row in range(batch.num_rows):  # matrices stay where Arrow has them
                ids = [column[f"{s}_ids"][row].values.to_numpy() for s in "ab"]
                copies = [column[f"{s}_copies"][row].values.to_numpy() for s in "ab"]
                left, right = (np.frombuffer(column[f"{s}_matrix"][row].as_buffer(), np.float64).reshape(len(i), -1) for s, i in zip("ab", ids, strict=True))
                same = all(column[f"a_{of}"][row].as_py() == column[f"b_{of}"][row].as_py() for of in ("part", "block"))
                hit = (left @ right.T) / (np.linalg.norm(left, axis=1)[:, None] * np.linalg.norm(right, axis=1)[None]) >= threshold
                if same:
                    np.fill_diagonal(hit, False)
                counts = [(ids[0], hit @ copies[1])] + ([] if same else [(ids[1], hit.T @ copies[0])])
                a, b = np.nonzero(np.triu(hit) if same else hit)
                n = len(ids[0])
                kept = forest(a, b if same else b + n, n if same else n + len(ids[1]))
                both = ids[0] if same else np.concatenate(ids)
                out_a = [x for i, c in counts for x in i[c > 0].tolist()] + [int(both[x]) for x, _ in kept]
                sums = [int(x) for _, c in counts for x in c[c > 0]]
                out_b = [None] * len(sums) + [int(both[y]) for _, y in kept]
                yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64()), pa.array(sums + [None] * len(kept), pa.int64())], names=["a", "b", "n"])

    return pairs.mapInArrow(judge, "a long, b long, n long")


def near_vectors(
    vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", sample_rows: int = 4096, rows_per_part: int = 2048, rows_per_block: int = 512
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors with equal labels are linked when their cosine in double precision is at least threshold; unit
    vectors are then at most sqrt(2 - 2 * threshold) apart, the grid's epsilon. Equal vectors of a label are one
    class with a number of copies, linked with one another. Classes are sorted by label and by the grid cells of
    their DIMS leading principal coordinates (axes from at most sample_rows vectors; any axes give the same
    links), cut into blocks, and joined by recursion over intervals of that order; blocks that are provably
    distant are skipped, the others multiplied as matrices. From each pair of blocks come link counts and a
    spanning forest, never all pairs.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, as do those whose
    label is null; label_col None compares all with all. Vectors of different lengths never link. A null
    identifier is its own component, null, and is kept. Rows that repeat an identifier count as vectors of their
    own, with links and components of their own. An empty table gives no rows. Other columns are ignored, whatever
    their names.
    """
    label = F.lit("") if label_col is None else F.col(label_col).cast("string")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("vector").isNotNull() & (F.size("vector") > 0) & finite & F.exists("vector", lambda x: x != 0) & F.col("label").isNotNull() & F.col("id").isNotNull()
    keyed = shared_table(
        rows.withColumn("usable", F.coalesce(usable, F.lit(False))).withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0))).select("id", "label", "usable", F.when(F.col("usable"), F.col("vector")).alias("vector"), F.when(F.col("usable"), F.md5(F.to_json(F.struct("vector")).cast("binary"))).alias("digest")),
        "vectors",
    )
    equal = keyed.where("usable").groupBy("label", "digest").agg(F.min("id").alias("first"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    # classes go by numbers, which hold once the table is written: several may have one smallest identifier
    classes = shared_table(equal.withColumn("cls", F.monotonically_increasing_id()), "vector-classes")
    distinct = classes.select("cls", "label", F.size("vector").alias("size"), "copies", "vector")
    n = distinct.count()
    parts = max(1, -(-n // rows_per_part))
    epsilon = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    cells = [F.floor(F.col(f"p{i}") / epsilon).alias(f"c{i}") if epsilon else F.col(f"p{i}").alias(f"c{i}") for i in range(DIMS)]
    order = ["label", "size", *[f"c{i}" for i in range(DIMS)], "p0", "cls"]
    ordered = projected(distinct, principal_axes(classes.select("digest", "vector"), sample_rows)).select("*", *cells).repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    blocks = shared_table(in_blocks(ordered, rows_per_block), "vector-blocks")
    parts = (blocks.agg(F.max("part")).first()[0] or 0) + 1
    pairs = block_pairs(blocks, parts, epsilon)
    whole = lambda of: blocks.select("label", "size", F.col("part").alias(f"{of}_part"), F.col("block").alias(f"{of}_block"), *[F.col(c).alias(f"{of}_{c}") for c in ("ids", "copies", "matrix")])
    work = pairs.join(whole("a"), ["label", "size", "a_part", "a_block"]).join(whole("b"), ["label", "size", "b_part", "b_block"])
    found = shared_table(linked(work, threshold), "vector-links")
    counts = found.where("b is null").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("others"))
    components = component_ids(found.where("b is not null")).withColumnRenamed("node", "cls")
    met = shared_table(classes.select("label", "digest", "cls", "first", "copies").join(counts, "cls", "left").join(components, "cls", "left"), "vector-classes-met")
    smallest = met.where("component is not null").groupBy("component").agg(F.min("first").alias("component_id"))
    named = met.join(smallest, "component", "left").select("label", "digest", F.lit(True).alias("usable"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "first").alias("component_id"))
    out = keyed.select("id", "label", "digest", "usable").join(named, ["label", "digest", "usable"], "left")
    component = F.when(F.col("usable"), F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
