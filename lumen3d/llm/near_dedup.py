"""Near-duplicate documents by MinHash bands, odd sketches and full-set verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumen3d.llm.common import broadcast_if_small, row_key, shared_table, whole_text
from lumen3d.llm.words import Words, by_size, distinct_by_row, mixed, rows_as_lists, trim, windows
from lumen3d.operators.graph import component_ids

#: Samples and rows of a band. A pair at the threshold 0.8 shares no band with probability (1 - 0.8 ** 4) ** 32 = 5e-8.
SAMPLES, ROWS = 128, 4
BANDS = SAMPLES // ROWS
#: Bits of an odd sketch, in 64-bit words.
SKETCH_WORDS = 4
BITS = 64 * SKETCH_WORDS
#: Candidates whose estimated similarity is this far below the threshold are not verified: about six standard deviations.
SLACK = 0.3
#: Words, at least, of the parity bitmap of a whole set, which bounds what two sets differ in from below.
PARITY_WORDS = 8
#: Entries of a band key that are compared in one task; those of a key with more meet in pairs of blocks.
BLOCK = 8192
#: Neighbours, in the order of a bucket, among which the first turn looks for a class's nearest partner.
REACH = 64

_rng = np.random.default_rng(7)
_HIGH, _LOW = (_rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32) | np.uint32(1) for _ in range(2))


def shingles_of(words: Words, values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each shingle of width words from a value of each word, with the text's number; a shorter text's words are one shingle."""
    lengths = words.counts()
    starts = np.concatenate([[0], np.cumsum(lengths)])
    found = windows(values, width)
    row = words.text[: len(found)]
    inside = np.arange(len(found)) + width <= starts[1:][row]
    hashes, rows = [found[inside]], [row[inside]]
    for n in range(1, width):  # texts of n words
        short = np.flatnonzero(lengths == n)
        hashes.append(mixed(windows(values, n)[starts[short]] + np.uint64(n)) if len(short) else found[:0])
        rows.append(short)
    return np.concatenate(hashes), np.concatenate(rows)


def shingle_sets(bodies: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct shingles of width words, A-Z lower-cased, in ascending order, with the text's number."""
    words = Words(bodies, lower=True)
    return distinct_by_row(*shingles_of(words, words.hashes, width))


def named_sets(bodies: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, list[bytes | None]]:
    """shingle_sets() and a digest of 128 bits of each text's whole set, or None.

    The digest is a cryptographic one of two independent hashes of each distinct shingle, in the order of the first.
    """
    words = Words(bodies, lower=True)
    hashes, rows = shingles_of(words, words.hashes, width)
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    first = np.ones(len(rows), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    seconds = shingles_of(words, words.checks, width)[0][order][first]
    hashes, rows = hashes[first], rows[first]
    both, ends = np.column_stack([hashes, seconds]), np.searchsorted(rows, np.arange(len(bodies) + 1)).tolist()
    return hashes, rows, [hashlib.blake2b(both[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(ends, ends[1:], strict=False)]


def min_hashes(shingles: np.ndarray, at_once: int = 1024) -> np.ndarray:
    """SAMPLES minima of multiply-add hashes of a non-empty set."""
    high, low = (shingles >> np.uint64(32)).astype(np.uint32), shingles.astype(np.uint32)
    least = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(shingles), at_once):
        np.minimum(least, (high[i : i + at_once, None] * _HIGH + low[i : i + at_once, None] * _LOW).min(axis=0), out=least)
    return least


def band_keys(samples: np.ndarray) -> np.ndarray:
    """(texts, BANDS) hashes of the rows of each band and its number."""
    parts = samples.reshape(len(samples), BANDS, ROWS).astype(np.uint64)
    total = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(samples), BANDS)).copy()
    for k in range(ROWS):
        total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return total


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """(texts, SKETCH_WORDS) parity bitmaps: each sample, with its number, flips one bit."""
    place = mixed(samples.astype(np.uint64) + (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32))) % np.uint64(BITS)
    out = np.zeros((len(samples), SKETCH_WORDS), np.uint64)
    for w in range(SKETCH_WORDS):
        bits = np.where(place // np.uint64(64) == w, np.uint64(1) << (place % np.uint64(64)), np.uint64(0))
        out[:, w] = np.bitwise_xor.reduce(bits, axis=1)
    return out


def most_differing_bits(similarity: float) -> int:
    """The population count of two sketches' difference at which similarity is the estimate.

    Sets of SAMPLES minima at similarity s differ in 2 * SAMPLES * (1 - s) places on average, and d places flip a
    bit to odd with probability (1 - (1 - 2 / BITS) ** d) / 2.
    """
    d = 2 * SAMPLES * (1 - similarity)
    return int(np.ceil(BITS * (1 - (1 - 2 / BITS) ** d) / 2))


def parity_words(sizes: np.ndarray) -> np.ndarray:
    """64-bit words of the parity bitmaps of sets of these sizes: a power of two, with a bit for each member or more."""
    words = np.maximum(-(-sizes // 64), PARITY_WORDS)
    return 1 << np.ceil(np.log2(words)).astype(np.int64)


def set_parities(shingles: np.ndarray, rows: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    """Bitmaps that say whether an odd number of a set's shingles hash to each bit. Halves of a bitmap, added up, are the bitmap of half the width."""
    widths = parity_words(sizes)
    starts = np.concatenate([[0], np.cumsum(widths)])
    place = mixed(shingles ^ np.uint64(0xD1B54A32D192ED03)) & (64 * widths[rows] - 1).astype(np.uint64)
    out = np.zeros(starts[-1], np.uint64)
    np.bitwise_xor.at(out, starts[:-1][rows] + (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(out.view(np.int64)))


def folded(bitmap: np.ndarray, words: int) -> np.ndarray:
    """A bitmap in so many words."""
    return np.bitwise_xor.reduce(bitmap.reshape(-1, words), axis=0)


class Parities:
    """The bitmaps of several sets, ready to be held against one another at the width of the narrower one."""

    def __init__(self, flat: np.ndarray, starts: np.ndarray) -> None:
        self.widths = np.diff(starts)
        self.at: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for words in np.unique(self.widths[self.widths > PARITY_WORDS]).tolist():
            held = np.flatnonzero((self.widths == words) | (self.widths == 2 * words))  # sets of more different sizes never meet
            index = np.full(len(self.widths), -1, np.int64)
            index[held] = np.arange(len(held))
            self.at[words] = index, np.stack([folded(flat[starts[i] : starts[i + 1]], words) for i in held.tolist()])

    def differing(self, a: np.ndarray, b: np.ndarray, at_once: int = 4096) -> np.ndarray:
        """Bits in which the sets a and b differ, for wide bitmaps whose widths differ by a factor of two at most; 0 for others."""
        out = np.zeros(len(a), np.int64)
        common = np.minimum(self.widths[a], self.widths[b])
        for words, (index, table) in self.at.items():
            asked = np.flatnonzero(common == words)
            asked = asked[(index[a[asked]] >= 0) & (index[b[asked]] >= 0)]
            for part in np.split(asked, range(at_once, len(asked), at_once)):
                out[part] = np.bitwise_count(table[index[a[part]]] ^ table[index[b[part]]]).sum(axis=1, dtype=np.int64)
        return out


def as_lists(table: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(table) + 1, dtype=np.int32) * table.shape[1]), pa.array(np.ascontiguousarray(table).ravel().view(np.int64)))


def features(rows: DataFrame, width: int) -> DataFrame:
    """Of each row (id, uid, body): n, the digest of its shingle set (null for an empty one), band keys, odd sketch and parities."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, 2):
            n = batch.num_rows
            shingles, row, digests = named_sets(batch.column(2), width)
            ends = np.searchsorted(row, np.arange(n + 1))
            sizes = np.diff(ends)
            samples = np.stack([min_hashes(shingles[a:b]) if b > a else np.zeros(SAMPLES, np.uint32) for a, b in zip(ends, ends[1:], strict=False)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes.astype(np.int64)), pa.array(digests, pa.binary()), as_lists(band_keys(samples)), as_lists(odd_sketches(samples)), set_parities(shingles, row, sizes)],
                names=["id", "uid", "n", "digest", "bands", "sketch", "parity"],
            )

    return rows.select("id", "uid", "body").mapInArrow(compute, "id long, uid binary, n long, digest binary, bands array<long>, sketch array<long>, parity array<long>")


def by_key(entries: DataFrame, *order: str) -> DataFrame:
    n = max(1, int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return entries.repartition(n, "key").sortWithinPartitions("key", *order)


def whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted batches again, cut where the key changes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(0).to_numpy()
        if not len(keys):
            continue
        cut = int(np.searchsorted(keys, keys[-1]))
        if held and (cut or held[-1].column(0)[0].as_py() != keys[0].item()):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)
    trim()


def shared_buckets(classes: DataFrame, broadcast_rows: int, block: int) -> DataFrame:
    """(key, side, cls, n, sketch, parity) of the band keys that two classes or more have.

    A key with more entries than a block holds is cut into blocks by a hash of the class. Each pair of blocks is a
    key of its own then, in which only entries of different sides meet (side 0 or 1); so is each block, whose
    entries all meet (side null).
    """
    pairs = classes.select(F.explode("bands").alias("key"), "cls")
    counts = shared_table(pairs.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "near-keys")
    slim = pairs.join(broadcast_if_small(counts, broadcast_rows), "key").select("key", "cls", F.ceil(F.col("m") / block).cast("int").alias("blocks"))
    whole = slim.where("blocks = 1").select("key", F.lit(None).cast("int").alias("side"), "cls")
    cut = slim.where("blocks > 1").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    met = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    ends = F.least("own", "other"), F.greatest("own", "other")
    dealt = met.select(F.xxhash64("key", *ends).alias("key"), F.when(F.col("own") != F.col("other"), (F.col("own") > F.col("other")).cast("int")).alias("side"), "cls")
    return shared_table(whole.unionByName(dealt).join(classes.select("cls", "n", "sketch", "parity"), "cls").select("key", "side", "cls", "n", "sketch", "parity"), "near-entries")


def meetings(entries: DataFrame, threshold: Fraction, every: bool, reach: int | None) -> DataFrame:
    """(cls, other, z): partners under a key that belong to different components and may reach the threshold.

    z is the population count of the sketches' difference. Without every, each entry gives its nearest partner
    only. All keys of a batch are compared at distance 1, 2 and so on of their order at once, up to reach if there
    is one; keys whose entries are all of one component are left out.
    """
    p, q = threshold.numerator, threshold.denominator
    most = most_differing_bits(max(0.0, float(threshold) - SLACK))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_keys(batches):
            key, comp = (table.column(c).to_numpy() for c in ("key", "comp"))
            firsts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = np.diff(np.append(firsts, len(key)))
            several = np.logical_or.reduceat(comp != np.repeat(comp[firsts], sizes), firsts)
            if not several.any():
                continue
            table = table.filter(pa.array(np.repeat(several, sizes))).combine_chunks()
            key, cls, n, comp = (table.column(c).to_numpy() for c in ("key", "cls", "n", "comp"))
            side = table.column("side").fill_null(-1).to_numpy()
            sketch = table.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(key), -1)
            lists = table.column("parity").combine_chunks()
            flat, starts = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
            narrow = np.stack([folded(flat[a:b], PARITY_WORDS) for a, b in zip(starts, starts[1:], strict=False)])
            wide = Parities(flat, starts)
            nearest, partner = np.full(len(key), BITS + 1, np.int64), np.full(len(key), -1, np.int64)
            found = []
            at, d = np.arange(len(key)), 0
            while len(at) and (reach is None or d < reach):
                d += 1
                at = at[at + d < len(key)]
                at = at[key[at] == key[at + d]]
                a = at[(comp[at] != comp[at + d]) & ((side[at] < 0) | (side[at] != side[at + d]))]
                b = a + d
                total = n[a] + n[b]
                able = (n[a] * q >= n[b] * p) & (n[b] * q >= n[a] * p)
                a, b, total = a[able], b[able], total[able]
                z = np.bitwise_count(sketch[a] ^ sketch[b]).sum(axis=1, dtype=np.int64)
                differ = np.bitwise_count(narrow[a] ^ narrow[b]).sum(axis=1, dtype=np.int64)
                able = (z <= most) & ((total - differ) * (p + q) >= 2 * total * p)
                a, b, z, total = a[able], b[able], z[able], total[able]
                differ = wide.differing(a, b)
                able = (total - differ) * (p + q) >= 2 * total * p
                a, b, z = a[able], b[able], z[able]
                if every:
                    found.append((cls[a], cls[b], z))
                    continue
                for own, its in ((a, b), (b, a)):
                    closer = z < nearest[own]
                    nearest[own[closer]], partner[own[closer]] = z[closer], its[closer]
            if every:
                own, its, z = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (cls[:0],) * 3
            else:
                has = partner >= 0
                own, its, z = cls[has], cls[partner[has]], nearest[has]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(its), pa.array(z)], names=["cls", "other", "z"])

    return by_key(entries.select("key", "side", "cls", "n", "comp", "sketch", "parity"), "cls").mapInArrow(compare, "cls long, other long, z long")


def verified(pairs: DataFrame, classes: DataFrame, rows: DataFrame, width: int, threshold: Fraction, broadcast_rows: int) -> DataFrame:
    """pairs (a, b) with similar, by the whole shingle sets of a row of each class."""
    p, q = threshold.numerator, threshold.denominator
    needed = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(classes.select("cls", "uid"), "cls").select("uid", "cls")
    found = rows.join(broadcast_if_small(shared_table(needed, "near-needed"), broadcast_rows), "uid")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, 1):
            shingles, row = shingle_sets(batch.column(1), width)
            yield pa.RecordBatch.from_arrays([batch.column(0), rows_as_lists(shingles, row, batch.num_rows)], names=["cls", "shingles"])

    held = shared_table(found.select("cls", "body").mapInArrow(sets, "cls long, shingles array<long>").dropDuplicates(["cls"]), "near-sets")
    both = pairs.join(held.select(F.col("cls").alias("a"), F.col("shingles").alias("sa")), "a").join(held.select(F.col("cls").alias("b"), F.col("shingles").alias("sb")), "b")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            similar = []
            for i in range(batch.num_rows):
                x, y = (batch.column(c)[i].values.to_numpy() for c in (2, 3))
                inter = len(np.intersect1d(x, y, assume_unique=True))
                similar.append(inter * q >= (len(x) + len(y) - inter) * p)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(similar, pa.bool_())], names=["a", "b", "similar"])

    return shared_table(both.select("a", "b", "sa", "sb").mapInArrow(judge, "a long, b long, similar boolean"), "near-verified")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.8, broadcast_rows: int = 1_000_000, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    A document's set holds its distinct shingles of width words (runs of anything but ASCII white space, A-Z
    lower-cased); with fewer words, the whole sequence is one shingle; without words it is empty and linked with
    nothing. Documents are linked when the Jaccard similarity of their sets is at least threshold.

    Equal sets are one class, told by their size and a cryptographic digest of the whole set. Candidates share one of
    BANDS bands of MinHash samples; a band key with more than block entries is compared in pairs of blocks. The
    samples are folded into an odd sketch; the population count of two sketches' exclusive or estimates their
    similarity and drops candidates far below the threshold, and a parity bitmap of the whole set, with a bit for
    each member or more, drops those whose sets provably differ too much, before any set moves. What is left is verified on the whole sets. Each class is first held against its nearest
    partner by sketch; then, twice, against its nearest in another component; what then still joins different
    components is verified to the last pair. Components so lose no link between candidates, and groups of near
    copies are never expanded into all pairs.

    Null text counts as empty. Null identifiers come first: a component with one has a null component_id. Rows
    that repeat an identifier share what becomes of their sets. An empty table gives no rows. Other columns are
    ignored, whatever their names.
    """
    limit = Fraction(threshold).limit_denominator(1000)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), row_key(id_col, text_col).alias("uid"), whole_text(text_col).alias("body"))
    every_row = shared_table(features(rows, width), "near-features")
    first = every_row.where("digest is not null").groupBy("digest", "n").agg(F.min(F.struct("id", "uid", "bands", "sketch", "parity")).alias("f"), F.count("*").alias("copies"))
    # numbers that hold once the table is written
    classes = shared_table(first.select(F.monotonically_increasing_id().alias("cls"), "digest", "n", "copies", "f.*"), "near-classes")
    entries = shared_buckets(classes, broadcast_rows, block)
    spark = docs.sparkSession
    tested = spark.createDataFrame([], "a long, b long")
    components = spark.createDataFrame([], "node long, component long")
    for every, reach in ((False, REACH), (False, None), (False, None), (True, None)):
        known = components.select(F.col("node").alias("cls"), F.col("component").alias("comp"))
        labelled = entries.join(known, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
        found = meetings(labelled, limit, every, reach)
        best = found.select("cls", "other") if every else found.groupBy("cls").agg(F.min(F.struct("z", "other")).alias("best")).select("cls", "best.other")
        pairs = best.select(F.least("cls", "other").alias("a"), F.greatest("cls", "other").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")
        pairs = shared_table(pairs, "near-candidates")
        if pairs.isEmpty():
            continue
        judged = verified(pairs, classes, rows, width, limit, broadcast_rows)
        tested = tested.union(judged.select("a", "b"))
        links = judged.where("similar").select("a", "b")
        if not links.isEmpty():
            stars = components.select(F.col("node").alias("a"), F.col("component").alias("b"))
            components = shared_table(component_ids(stars.union(links)), "near-components")
    members = classes.select("cls", "digest", "id", "copies").join(components.withColumnRenamed("node", "cls"), "cls", "left")
    smallest = members.where("component is not null").groupBy("component").agg(F.when(F.max(F.col("id").isNull().cast("int")) == 0, F.min("id")).alias("component_id"))
    # rows of a set that nothing else is equal or near to are their own components, and meet no table
    shared = members.where("copies > 1 or component is not null").join(smallest, "component", "left")
    named = shared_table(shared.select("digest", F.lit(True).alias("named"), F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id")), "near-named")
    out = every_row.select("id", "n", "digest").join(broadcast_if_small(named, broadcast_rows), "digest", "left")
    component = F.when(F.col("named"), F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
