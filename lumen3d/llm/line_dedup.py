"""Line deduplication by an exact set-similarity join."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumen3d.functions.tables import small_batches
from lumen3d.llm.common import broadcast_if_small, shared_table, whole_text
from lumen3d.llm.words import Words, by_size, distinct_by_row, mixed, rows_as_lists, trim

#: Bits of an order key: the power of two that its slot's count reaches, and the start of its hash.
RANK_BITS, HASH_BITS = 5, 45
KEY_BITS = RANK_BITS + HASH_BITS
#: Lines that are sorted at once; a line's number fills the rest of 64 bits.
MOST_LINES = 1 << (64 - KEY_BITS)
ENTRY = np.dtype([("cls", "<i8"), ("m1", "<u8"), ("m2", "<u8"), ("token", "<i4"), ("n", "<i4"), ("place", "<i4"), ("wanted", "?")])
#: Bits of the start of a hash that make a slot of the table of rarities, and the blocks that the table is summed in.
SLOT_BITS, BLOCKS = 19, 512


#: Lines of a text that are bits of one number.
BITS = 62
#: What lines without words are made of.
SPACES = " \t\x0b\x0c\r"


def line_words(bodies: pa.Array) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """The words of texts, the ordinal of each word's line among lines with words, and those lines' texts and numbers."""
    words = Words(bodies, lower=True)
    line = words.lines()
    new = np.ones(len(line), bool)
    new[1:] = (line[1:] != line[:-1]) | (words.text[1:] != words.text[:-1])
    firsts = np.flatnonzero(new)
    return words, np.cumsum(new) - 1, words.text[firsts], line[firsts]


def rarity_table(rows: DataFrame) -> np.ndarray:
    """The power of two that the occurrences of a slot's tokens reach, over all texts; a token's slot is the first SLOT_BITS of its hash.

    Each task counts in one vector of all slots and sends it in blocks, which are added up one after another.
    """
    per_block = (1 << SLOT_BITS) // BLOCKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, waiting = np.zeros(1 << SLOT_BITS, np.int64), [], 0
        for batch in by_size(batches, 0):
            held.append((Words(batch.column(0), lower=True).hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64))
            waiting += len(held[-1])
            if waiting >= 1 << SLOT_BITS:
                seen += np.bincount(np.concatenate(held), minlength=1 << SLOT_BITS)
                held, waiting = [], 0
        if held:
            seen += np.bincount(np.concatenate(held), minlength=1 << SLOT_BITS)
        if seen.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(BLOCKS), pa.int64()), pa.array([x.tobytes() for x in seen.reshape(BLOCKS, per_block)], pa.binary())], names=["block", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, np.zeros(per_block, np.int64)
        out = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["block", "n"])
        for batch in batches:
            for block, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if block != at:
                    if at is not None:
                        yield out()
                    at, total = block, np.zeros(per_block, np.int64)
                total = total + np.frombuffer(n, np.int64)
        if at is not None:
            yield out()

    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sums = rows.select("body").mapInArrow(count, "block long, n binary").repartition(n, "block").sortWithinPartitions("block").mapInArrow(add, "block long, n binary")
    table = np.zeros((BLOCKS, per_block), np.int64)
    with small_batches(rows.sparkSession):
        for block, n in sums.collect():  # BLOCKS rows at most
            table[block] = np.frombuffer(n, np.int64)
    return np.minimum(np.log2(np.maximum(table.ravel(), 1)), (1 << RANK_BITS) - 1).astype(np.uint64)


def prefix_size(n, numerator: int, denominator: int):
    """n - ceil(threshold * n) + 1: sets of n tokens that are similar share one of so many rarest tokens."""
    return n - (n * numerator + denominator - 1) // denominator + 1


def distinct_tokens(keys: np.ndarray, hashes: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of words with order keys (line, rank, start of the hash): lines, hashes and mixed checks of each line's distinct words, by line, rank and whole hash."""
    order = np.argsort(keys)
    sorted_keys, sorted_hashes = keys[order], hashes[order]
    if ((sorted_keys[1:] == sorted_keys[:-1]) & (sorted_hashes[1:] != sorted_hashes[:-1])).any():  # keys hold a part of the hash
        order = np.lexsort((hashes, keys))
        sorted_keys, sorted_hashes = keys[order], hashes[order]
    first = np.ones(len(order), bool)
    first[1:] = (sorted_keys[1:] != sorted_keys[:-1]) | (sorted_hashes[1:] != sorted_hashes[:-1])
    order = order[first]
    return (keys[order] >> np.uint64(KEY_BITS)).astype(np.int64), hashes[order], mixed(checks[order] + hashes[order])


def line_sets(rows: DataFrame, rarity: np.ndarray, threshold: Fraction) -> DataFrame:
    """Of each line with words: id, uid, line, a 128-bit digest of its token set, the set's size, a parity bitmap and its prefix by rarity.

    The digest sums up two values of 64 bits for each token: its hash, and one of its length and outer bytes. A bit of the bitmap says whether an odd number of tokens hash to it; two bitmaps differ in no more bits than
    their sets differ in tokens. Prefixes hold 32 bits of their tokens, which can only add candidates.
    """
    shared = rows.sparkSession.sparkContext.broadcast(rarity)
    p, q = threshold.numerator, threshold.denominator

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in by_size(batches, 2):
            words, line_of, texts, numbers = line_words(batch.column(2))
            checks = words.checks
            order_key = (table[(words.hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)] << np.uint64(HASH_BITS)) | (words.hashes >> np.uint64(64 - HASH_BITS))
            for at in range(0, len(texts), MOST_LINES):
                n = min(MOST_LINES, len(texts) - at)
                a, b = np.searchsorted(line_of, [at, at + n])
                row, hashes, spread = distinct_tokens(order_key[a:b] | ((line_of[a:b] - at).astype(np.uint64) << np.uint64(KEY_BITS)), words.hashes[a:b], checks[a:b])
                firsts = np.searchsorted(row, np.arange(n))
                sizes = np.diff(np.append(firsts, len(row)))
                digest = [np.add.reduceat(x, firsts) for x in (mixed(hashes), spread)]
                bit, second = np.uint64(1) << (spread & np.uint64(63)), (spread & np.uint64(64)) > 0
                maps = [np.bitwise_xor.reduceat(np.where(second == h, bit, np.uint64(0)), firsts) for h in (False, True)]
                kept = np.arange(len(row)) - firsts[row] < prefix_size(sizes, p, q)[row]
                tokens = (hashes[kept] & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
                prefix = pa.ListArray.from_arrays(pa.array(np.searchsorted(row[kept], np.arange(n + 1)).astype(np.int32)), pa.array(tokens))
                pick = lambda c, i=texts[at : at + n], b=batch: b.column(c).take(pa.array(i))
                yield pa.RecordBatch.from_arrays(
                    [pick(1), pick(0), pa.array(numbers[at : at + n].astype(np.int32)), *(pa.array(d.view(np.int64)) for d in digest), pa.array(sizes.astype(np.int32)), *(pa.array(m.view(np.int64)) for m in maps), prefix],
                    names=["id", "uid", "line", "h1", "h2", "n", "m1", "m2", "prefix"],
                )

    return rows.select("uid", "id", "body").mapInArrow(sets, "id long, uid long, line int, h1 long, h2 long, n int, m1 long, m2 long, prefix array<int>")


def ordered_classes(lines: DataFrame) -> DataFrame:
    """One row per token set: cls, a number in the order of first lines, and the first line that holds the set.

    Equal sets are summed up where they are before they move. The numbers follow from a range-partitioned sort
    and hold once the table is written.
    """
    first = lines.groupBy("h1", "h2", "n").agg(F.min(F.struct("id", "uid", "line", "m1", "m2", "prefix")).alias("f")).select("n", "f.*")
    n = max(1, int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return shared_table(first.repartitionByRange(n, "id", "uid", "line").sortWithinPartitions("id", "uid", "line").withColumn("cls", F.monotonically_increasing_id()), "line-classes")


def dealt_entries(classes: DataFrame, buckets: int, only: np.ndarray | None) -> DataFrame:
    """(bucket, entries): the prefix tokens (of only, if given) of classes (cls, n, m1, m2, wanted, prefix), packed by a hash of the token."""
    shared = None if only is None or not len(only) else classes.sparkSession.sparkContext.broadcast(only)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, n, m1, m2, wanted = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(5))
            lists = batch.column(5)
            sizes = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(len(cls)), sizes)
            token, place = lists.flatten().to_numpy(), np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            if shared is not None:
                known = shared.value
                asked = known[np.minimum(np.searchsorted(known, token), len(known) - 1)] == token
                row, token, place = row[asked], token[asked], place[asked]
            bucket = mixed(token.astype(np.uint64)) % np.uint64(buckets)
            order = np.argsort(bucket)
            row, bucket = row[order], bucket[order]
            entries = np.empty(len(row), ENTRY)
            entries["token"], entries["place"] = token[order], place[order]
            for name, values in (("cls", cls), ("n", n), ("m1", m1), ("m2", m2), ("wanted", wanted)):
                entries[name] = values[row]
            starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
            data, ends = entries.tobytes(), np.append(starts, len(entries)) * ENTRY.itemsize
            blobs = [data[x:y] for x, y in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[starts].astype(np.int64)), pa.array(blobs, pa.binary())], names=["bucket", "entries"])

    return classes.select("cls", "n", "m1", "m2", "wanted", "prefix").mapInArrow(deal, "bucket long, entries binary")


def compared(entries: np.ndarray, p: int, q: int, every: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Partners a, b and whether there are more; see meetings().

    Entries are sorted by token and size, so that one leaves the comparison once sizes differ too much.
    """
    order = np.argsort((entries["token"].astype(np.int64) << 32) | entries["n"])
    token, cls, n, place, m1, m2, wanted = (entries[c][order] for c in ("token", "cls", "n", "place", "m1", "m2", "wanted"))
    none = np.iinfo(np.int64).max
    best, count = np.full(len(cls), none, np.int64), np.zeros(len(cls), np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    limit = n.astype(np.int64) * q // p
    at, d = np.arange(len(token)), 0
    while len(at):
        d += 1
        at = at[at + d < len(token)]
        at = at[(token[at] == token[at + d]) & (n[at + d] <= limit[at])]
        one, two = at, at + d
        total = n[one] + n[two]
        overlap = np.minimum(place[one], place[two]) + 1 + np.minimum(n[one] - place[one], n[two] - place[two]) - 1
        near = np.flatnonzero(overlap * (p + q) >= total * p)
        one, two, total = one[near], two[near], total[near]
        differ = np.bitwise_count(m1[one] ^ m1[two]) + np.bitwise_count(m2[one] ^ m2[two]).astype(np.int32)
        near = np.flatnonzero(((total - differ) * (p + q) >= 2 * total * p) & (cls[one] != cls[two]))
        one, two = one[near], two[near]
        for first, second in ((one, two), (two, one)):  # the class that comes first is the other's partner
            turn = (cls[first] < cls[second]) & wanted[second]
            first, second = first[turn], second[turn]
            if every:
                found.append((cls[first], cls[second]))
            else:
                best[second] = np.minimum(best[second], cls[first])
                count[second] += 1
    if every:
        a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (cls[:0], cls[:0])
        return a, b, np.zeros(len(a), bool)
    b_at = np.flatnonzero(best < none)
    return best[b_at], cls[b_at], count[b_at] > 1


def meetings(classes: DataFrame, threshold: Fraction, every: bool, only: np.ndarray | None = None, entries_per_bucket: int = 250_000) -> DataFrame:
    """(a, b, more): classes a before b that share a prefix token and pass the filters.

    classes: cls, n, m1, m2, wanted, prefix. Of each class and token only the first partner is given, with more
    saying that there are others; with every, all partners of wanted classes are. only: the tokens to look at. A
    bucket of tokens holds about entries_per_bucket entries; those of a token are compared at distance 1, 2 and so
    on of their order, all tokens of a bucket at once.
    """
    p, q = threshold.numerator, threshold.denominator
    buckets = max(1, -(-(classes.agg(F.sum(F.size("prefix"))).first()[0] or 0) // entries_per_bucket))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        at = None

        def out() -> pa.RecordBatch:
            entries = np.frombuffer(b"".join(held), ENTRY)
            held.clear()
            a, b, more = compared(entries, p, q, every)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(more)], names=["a", "b", "more"])

        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if bucket != at and held:
                    yield out()
                at = bucket
                held.append(blob)
        if held:
            yield out()
        trim()

    n = max(1, int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), buckets)  # a task's buckets do not grow in number with the corpus
    met = dealt_entries(classes, buckets, only).repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, "a long, b long, more boolean")
    return met.groupBy("a", "b").agg(F.max("more").alias("more"))


def verified(pairs: DataFrame, classes: DataFrame, rows: DataFrame, threshold: Fraction, broadcast_rows: int) -> DataFrame:
    """pairs with similar, by the whole token sets of their classes' first lines."""
    p, q = threshold.numerator, threshold.denominator
    needed = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(classes.select("cls", "id", "uid", "line"), "cls").groupBy("id", "uid").agg(F.map_from_entries(F.collect_list(F.struct("line", "cls"))).alias("wanted"))
    found = rows.join(broadcast_if_small(shared_table(needed, "line-needed"), broadcast_rows), ["id", "uid"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, 0):
            words, line_of, texts, numbers = line_words(batch.column(0))
            wanted = [dict(w) for w in batch.column(1).to_pylist()]
            cls = [wanted[t].get(k) for t, k in zip(texts.tolist(), numbers.tolist(), strict=True)]
            lists = rows_as_lists(*distinct_by_row(words.hashes, line_of), len(cls))
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), lists], names=["cls", "tokens"]).filter(pa.array([c is not None for c in cls], pa.bool_()))

    tokens = shared_table(found.select("body", "wanted").mapInArrow(sets, "cls long, tokens array<long>").dropDuplicates(["cls"]), "line-tokens")
    both = pairs.join(tokens.select(F.col("cls").alias("a"), F.col("tokens").alias("ta")), "a").join(tokens.select(F.col("cls").alias("b"), F.col("tokens").alias("tb")), "b")
    overlap = F.size(F.array_intersect("ta", "tb"))
    return both.select("a", "b", "more", (overlap * q >= (F.size("ta") + F.size("tb") - overlap) * p).alias("similar"))


def later_matches(classes: DataFrame, rows: DataFrame, threshold: Fraction, broadcast_rows: int) -> DataFrame:
    """(cls): classes that are similar to one whose first line comes before theirs.

    In the first turn each class is held against the first partner that passes the filters under each of its
    prefix tokens, which settles groups of near copies without all their pairs. Classes that this leaves open and
    that have more partners are held against all of them in the second turn.
    """
    p, q = threshold.numerator, threshold.denominator
    # smaller sets are similar to equal ones only, and those are one class already
    able = classes.where(F.col("n") * (q - p) >= p)
    first = shared_table(verified(shared_table(meetings(able.withColumn("wanted", F.lit(True)), threshold, every=False), "line-candidates"), classes, rows, threshold, broadcast_rows), "line-verified")
    gone = first.where("similar").select(F.col("b").alias("cls")).distinct()
    still = first.groupBy(F.col("b").alias("cls")).agg(F.max("similar").alias("similar"), F.max("more").alias("more")).where("more and not similar").select("cls")
    still = shared_table(still, "line-open")
    if still.isEmpty():
        return gone
    # only entries of tokens that open classes have can meet one
    flagged = able.join(broadcast_if_small(still.withColumn("w", F.lit(True)), broadcast_rows), "cls", "left").withColumn("wanted", F.coalesce("w", F.lit(False)))
    tokens = shared_table(flagged.where("wanted").select(F.explode("prefix").alias("token")).distinct(), "line-open-tokens")
    only = np.sort(tokens.toPandas()["token"].to_numpy(np.int32)) if tokens.count() <= broadcast_rows else None
    second = verified(shared_table(meetings(flagged, threshold, True, only), "line-candidates"), classes, rows, threshold, broadcast_rows)
    return gone.union(second.where("similar").select(F.col("b").alias("cls"))).distinct()


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, broadcast_rows: int = 1_000_000) -> DataFrame:
    """All rows and columns of docs, the text without the lines that come later than a similar one, and n_lines and n_removed_lines.

    Lines end at \\n. A line's tokens are the distinct words between ASCII white space, A-Z lower-cased; two lines
    are similar when the Jaccard similarity of their tokens is at least threshold. Lines are ordered by
    identifier (null first), a hash of the text and the place in it. A line goes if any earlier line, kept or not,
    is similar to it. Lines without words stay.

    Equal sets are one class, counted up before anything moves. Classes are joined exactly: tokens are ordered by
    rarity over all lines, sets meet under the tokens of their prefixes, length and positional filters go first,
    and the whole sets decide.

    Null text stays null and counts as one empty line. Rows that repeat an identifier and its text keep the same
    lines. A text that loses all its lines is empty. An empty table gives no rows. Input columns that are called
    n_lines or n_removed_lines are replaced.
    """
    return _with_kept_lines(docs, id_col, text_col, Fraction(threshold).limit_denominator(1000), broadcast_rows)


def _with_kept_lines(docs: DataFrame, id_col: str, text_col: str, threshold: Fraction, broadcast_rows: int) -> DataFrame:
    # a row's name: its identifier, null as the least number, and a hash of identifier and text that tells null from all others
    name = [F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))), F.xxhash64(F.col(id_col), F.col(text_col))]
    rows = docs.select(name[0].alias("id"), name[1].alias("uid"), whole_text(text_col).alias("body"))
    classes = ordered_classes(line_sets(rows, rarity_table(rows), threshold))
    # lines as bits of numbers: those that stay are added up without lists
    bit = lambda line: F.call_function("shiftleft", F.lit(1).cast("long"), line % BITS)
    stay = classes.join(later_matches(classes, rows, threshold, broadcast_rows), "cls", "left_anti").groupBy("id", "uid", (F.col("line") / BITS).cast("int").alias("block")).agg(F.sum(bit(F.col("line"))).alias("stay"))
    # what goes is a fraction of the corpus; where it is small, texts need not move to meet it
    marks = F.transform(F.split("body", "\n", -1), lambda x, i: F.when(F.ltrim(x, F.lit(SPACES)) != "", bit(i)).otherwise(F.lit(0).cast("long")))
    blocks = F.transform(F.sequence(F.lit(0), ((F.size("marks") - 1) / BITS).cast("int")), lambda b: F.aggregate(F.slice("marks", b * BITS + 1, BITS), F.lit(0).cast("long"), lambda total, x: total + x))
    worded = rows.select("id", "uid", marks.alias("marks")).select("id", "uid", F.posexplode(blocks).alias("block", "worded")).where("worded <> 0").dropDuplicates(["id", "uid", "block"])
    gone = worded.join(stay, ["id", "uid", "block"], "left").select("id", "uid", "block", F.col("worded").bitwiseAND(F.bitwise_not(F.coalesce("stay", F.lit(0).cast("long")))).alias("gone")).where("gone <> 0")
    gone = gone.groupBy(F.col("id").alias("_id"), F.col("uid").alias("_uid")).agg(F.map_from_entries(F.collect_list(F.struct("block", "gone"))).alias("_gone"))
    gone = broadcast_if_small(shared_table(gone, "lines-gone"), broadcast_rows)
    plain = docs.drop("n_lines", "n_removed_lines")
    names = {c: f"_c{i}" for i, c in enumerate(plain.columns)}
    safe = plain.select(*[plain[c].alias(n) for c, n in names.items()], name[0].alias("_id"), name[1].alias("_uid"), F.split(whole_text(text_col), "\n", -1).alias("_lines"))
    goes = lambda i: F.coalesce(F.element_at("_gone", (i / BITS).cast("int")), F.lit(0).cast("long")).bitwiseAND(bit(i)) != 0
    found = safe.join(gone, ["_id", "_uid"], "left").withColumn("_kept", F.when(F.col("_gone").isNotNull(), F.filter("_lines", lambda x, i: ~goes(i))))
    text = F.when(F.col("_gone").isNotNull(), F.array_join("_kept", "\n")).otherwise(F.col(names[text_col]))
    columns = [(text if c == text_col else F.col(n)).alias(c) for c, n in names.items()]
    n_lines = F.size("_lines").cast("long")
    return found.select(*columns, n_lines.alias("n_lines"), F.when(F.col("_gone").isNotNull(), n_lines - F.size("_kept")).otherwise(F.lit(0)).cast("long").alias("n_removed_lines"))
