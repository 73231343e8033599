"""Removal of passages that recur, located by sharded Aho-Corasick automata."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumen3d.llm.common import broadcast_if_small, row_key, shared_table, whole_text
from lumen3d.llm.words import Words, by_size, windows

#: Words of a phrase that stands for the passages around it.
PHRASE = 16
PHRASES_PER_SHARD, TEXTS_PER_TASK = 20_000, 1000


def letters(words: np.ndarray) -> str:
    """A letter of 256 for each word: sixteen in a row tell phrases apart, and automata stay narrow."""
    return words.astype(np.uint8).tobytes().decode("latin-1")


def each_text(bodies: pa.Array, checks: bool = False) -> Iterator:
    """The word hashes of each text; with checks, pairs of these and of the second values of its words."""
    words = Words(bodies, lower=False)
    ends = np.cumsum(words.counts())
    second = words.checks if checks else None
    return ((words.hashes[a:b], second[a:b]) if checks else words.hashes[a:b] for a, b in zip(np.concatenate([[0], ends]), ends, strict=False))


def least_phrases(phrases: np.ndarray, width: int) -> np.ndarray:
    """For each window of width words, the place of the phrase in it with the least hash (the first such)."""
    per_window = width - PHRASE + 1
    if len(phrases) < per_window:
        return np.zeros(0, np.int64)
    return np.lib.stride_tricks.sliding_window_view(phrases, per_window).argmin(axis=1) + np.arange(len(phrases) - per_window + 1)


def anchors(rows: DataFrame, width: int) -> DataFrame:
    """Of each row (uid, body): a cryptographic digest of its word sequence, n words and the hashes of its anchors.

    A window's anchor is its least phrase, so equal windows have equal anchors wherever they are; a text has about
    one anchor for each ten words.
    """

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, 1):
            digests, n, found, ends = [], [], [], [0]
            for words, checks in each_text(batch.column(1), checks=True):
                digests.append(hashlib.blake2b(words.tobytes() + checks.tobytes(), digest_size=16).digest())
                n.append(len(words))
                phrases = windows(words, PHRASE)
                found.append(phrases[np.unique(least_phrases(phrases, width))])
                ends.append(ends[-1] + len(found[-1]))
            flat = np.concatenate(found) if found else np.zeros(0, np.uint64)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(n, pa.int64()), lists], names=["uid", "digest", "n", "anchors"])

    return rows.select("uid", "body").mapInArrow(compute, "uid binary, digest binary, n long, anchors array<long>")


def dealt(texts: DataFrame) -> DataFrame:
    """Rows (cls, copies, own, own_shard, shards, body) as rows of shards: the phrases that a text owns (kind 0), as letters, with their hashes in place of copies, and the text (kind 1)."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, 5):
            out: list[tuple] = []
            for words, cls, copies, own, own_shard, shards, body in zip(each_text(batch.column(5)), *(c.to_pylist() for c in batch.columns), strict=True):
                if own:
                    phrases = windows(words, PHRASE)
                    order = np.argsort(phrases, kind="stable")
                    at = order[np.searchsorted(phrases[order], np.array(own, np.int64).view(np.uint64))]
                    out += [(own_shard, 0, cls, phrase, letters(words[p : p + PHRASE])) for p, phrase in zip(at.tolist(), own, strict=True)]
                out += [(shard, 1, cls, copies, body) for shard in shards]
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["shard", "kind", "cls", "copies", "body"])

    return texts.select("cls", "copies", "own", "own_shard", "shards", "body").mapInArrow(deal, "shard long, kind int, cls long, copies long, body string")


def automaton_of(phrases: list[str]) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for phrase in phrases:
        automaton.add_word(phrase)
    automaton.make_automaton()
    return automaton


def anchored_windows(words: np.ndarray, automaton: ahocorasick.Automaton, known: np.ndarray, width: int) -> np.ndarray:
    """Starts of the windows whose least phrase the automaton holds; known are the hashes of its phrases, sorted.

    Phrases of different words may have the same letters. Hashes tell them apart, so that a window is one shard's alone
    and is counted once.
    """
    hit, phrases = np.zeros(len(words) + 1, bool), windows(words, PHRASE)
    if automaton.kind == ahocorasick.AHOCORASICK:
        at = np.fromiter((end for end, _ in automaton.iter(letters(words))), np.int64) - (PHRASE - 1)
        hit[at] = known[np.minimum(np.searchsorted(known, phrases[at]), len(known) - 1)] == phrases[at]
    return np.flatnonzero(hit[least_phrases(phrases, width)])


def located(rows: DataFrame, width: int, tasks: int) -> DataFrame:
    """(cls, sure, start, high, low, n): of each text, the ranges of words that windows seen twice in the same task cover, and the windows
    of which it has the first in the task, with 128-bit hashes (64 bits of both values of their words) and the number that the task has seen.

    Rows come sorted by shard, salt and kind: a shard's phrases are compiled when its first text comes, and texts
    are streamed through. A task holds one automaton, and the windows of TEXTS_PER_TASK texts or so.
    """

    def judged(held: list[tuple]) -> pa.RecordBatch:
        sizes = [len(h[2]) for h in held]
        high, low = (np.concatenate([h[i] for h in held]) for i in (3, 4))
        text = np.repeat(np.arange(len(held)), sizes)
        start = np.concatenate([h[2] for h in held])
        order = np.lexsort((np.arange(len(high)), low, high))
        new = np.ones(len(order), bool)
        new[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
        group = np.cumsum(new) - 1
        n = np.bincount(group, np.array([h[1] for h in held])[text[order]]).astype(np.int64)
        sure = np.zeros(len(order), bool)
        sure[order] = n[group] > 1
        first = np.sort(order[new])
        count = np.empty(len(order), np.int64)
        count[order] = n[group]
        lists = lambda values, ends: pa.ListArray.from_arrays(pa.array(np.asarray(ends, np.int32)), pa.array(values))
        firsts = np.searchsorted(text[first], np.arange(len(held) + 1))
        ranges = [covered(s[m], width) for s, m in zip(np.split(start, np.cumsum(sizes)[:-1]), np.split(sure, np.cumsum(sizes)[:-1]), strict=True)]
        return pa.RecordBatch.from_arrays(
            [pa.array([h[0] for h in held], pa.int64()), pa.array(ranges, pa.list_(pa.int64())), lists(start[first].astype(np.int32), firsts), lists(high[first].view(np.int64), firsts), lists(low[first].view(np.int64), firsts), lists(count[first], firsts)],
            names=["cls", "sure", "start", "high", "low", "n"],
        )

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, phrases, hashes, automaton, held = None, [], [], None, []
        for batch in by_size(batches, 5):
            texts = each_text(batch.column(5), checks=True)
            for (words, checks), shard, salt, kind, cls, copies, body in zip(texts, *(c.to_pylist() for c in batch.columns), strict=True):
                if (shard, salt) != at:
                    if held:
                        yield judged(held)
                    at, phrases, hashes, automaton, held = (shard, salt), [], [], None, []
                if kind == 0:
                    phrases.append(body)
                    hashes.append(copies)
                    continue
                if automaton is None:
                    automaton, known = automaton_of(phrases), np.sort(np.array(hashes, np.int64).view(np.uint64))
                    phrases, hashes = [], []
                own = anchored_windows(words, automaton, known, width)
                if len(own):
                    held.append((cls, copies, own, windows(words, width)[own], windows(checks, width)[own]))
        if held:
            yield judged(held)

    n = max(tasks, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = rows.select("shard", "salt", "kind", "cls", "copies", "body").repartition(n, "shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    return placed.mapInArrow(stream, "cls long, sure array<long>, start array<int>, high array<long>, low array<long>, n array<long>")


def covered(starts: np.ndarray, width: int) -> list[int]:
    """The words that windows at ascending starts cover: first word and end of each run."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > width)
    return np.column_stack([starts[np.concatenate([[0], cut + 1])], starts[np.concatenate([cut, [len(starts) - 1]])] + width]).ravel().tolist()


def as_ranges(found: DataFrame, width: int) -> DataFrame:
    """(cls, ranges) from (cls, sure, starts): the union of ranges and of what windows cover, as first word and end of each run."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for sure, starts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                pairs = sorted([(r[i], r[i + 1]) for r in sure or [] for i in range(0, len(r), 2)] + [(s, s + width) for s in starts or []])
                runs: list[list[int]] = []
                for a, b in pairs:
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], b)
                    else:
                        runs.append([a, b])
                out.append([x for r in runs for x in r])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], names=["cls", "ranges"])

    return found.select("cls", "sure", "starts").mapInArrow(merge, "cls long, ranges array<long>")


def recurring_ranges(docs: DataFrame, id_col: str, text_col: str, width: int, broadcast_rows: int) -> DataFrame:
    """(uid, ranges): of each row with anything to remove, the runs of words to remove."""
    rows = docs.select(row_key(id_col, text_col).alias("uid"), whole_text(text_col).alias("body"))
    every_row = shared_table(anchors(rows, width), "passage-anchors")
    first = every_row.where(F.col("n") >= width).groupBy("digest", "n").agg(F.count("*").alias("copies"), F.min(F.struct("uid", "anchors")).alias("f"))
    # numbers that hold once the table is written
    classes = shared_table(first.select(F.monotonically_increasing_id().alias("cls"), "digest", "copies", "f.*"), "passage-classes")
    # passages recur only around phrases that do: as anchors of two places or more
    seen = classes.select("cls", "copies", F.explode("anchors").alias("phrase"))
    recurring = shared_table(seen.groupBy("phrase").agg(F.sum("copies").alias("n"), F.min("cls").alias("owner")).where("n > 1").select("phrase", "owner"), "passage-phrases")
    n_phrases = recurring.count()
    shards = max(1, -(-n_phrases // PHRASES_PER_SHARD))
    hits = seen.join(broadcast_if_small(recurring, broadcast_rows), "phrase")
    shard = F.pmod(F.xxhash64("owner"), F.lit(shards))
    own = F.collect_set(F.when(F.col("owner") == F.col("cls"), F.col("phrase"))).alias("own")
    routed_rows = shared_table(hits.groupBy("cls").agg(own, F.collect_set(shard).alias("shards"), F.first("copies").alias("copies")).join(classes.select("cls", "uid"), "cls"), "passage-routes")
    routed = broadcast_if_small(routed_rows.withColumn("own_shard", F.pmod(F.xxhash64("cls"), F.lit(shards))), broadcast_rows)
    # a shard's texts are split over salts, each of which gets all of the shard's phrases
    salts = routed_rows.select(F.explode("shards").alias("shard")).groupBy("shard").agg(F.ceil(F.count("*") / F.lit(TEXTS_PER_TASK)).cast("int").alias("salts"))
    salts = shared_table(salts, "passage-salts")
    tasks = salts.agg(F.sum("salts")).first()[0] or 1
    # rows that repeat an identifier and its text have one key, and one of them is enough
    repeated = not every_row.groupBy("uid").count().where("count > 1").isEmpty()
    parts = dealt(rows.dropDuplicates(["uid"]).join(routed, "uid") if repeated else rows.join(routed, "uid")).join(broadcast_if_small(salts, broadcast_rows), "shard")
    salted = parts.withColumn("salt", F.explode(F.when(F.col("kind") == 0, F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("cls"), F.col("salts")).cast("int")))))
    found = shared_table(located(salted, width, tasks), "passage-windows")
    # windows that their task has seen once may recur in another one
    each = found.select("cls", F.explode(F.arrays_zip("start", "high", "low", "n")).alias("w")).select("cls", "w.*")
    again = each.groupBy("high", "low").agg(F.sum("n").alias("total")).where("total > 1").select("high", "low")
    late = each.where("n = 1").join(again, ["high", "low"]).groupBy("cls").agg(F.collect_list("start").alias("starts"))
    sure = found.where(F.size("sure") > 0).groupBy("cls").agg(F.collect_list("sure").alias("sure"))
    ranges = as_ranges(sure.join(late, "cls", "full_outer"), width)
    by_digest = shared_table(ranges.join(classes.select("cls", "digest"), "cls").select("digest", "ranges"), "passage-class-ranges")
    return shared_table(every_row.select("uid", "digest").distinct().join(broadcast_if_small(by_digest, broadcast_rows), "digest").select("uid", "ranges"), "passage-ranges")


def remove_recurring(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 35, broadcast_rows: int = 1_000_000) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text.

    Words are runs of anything but ASCII white space, taken as they are. A window is width consecutive words of one
    document; every word that is covered by a window whose words also start anywhere else, in the same document
    or another, is removed. Windows are judged on the input. The kept words are joined by one space.

    A window's anchor is its phrase of PHRASE words with the least hash. Anchors that occur at two places confirm a
    phrase as recurring; equal word sequences are one text with a number of copies by then. Each phrase belongs to
    the least text that has it, so that the phrases of a passage share a shard. Shards' phrases are compiled into
    Aho-Corasick automata, and each text is streamed through those of its phrases' shards, which locate every
    occurrence. The windows anchored there are counted by 128-bit hashes, first among the texts of a task, then
    over all of them.

    Null text has no words. Rows that repeat an identifier and its text are two copies and lose what they share.
    Identifiers may be null. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    if width < PHRASE:
        raise ValueError(f"width must be {PHRASE} or more")
    ranges = broadcast_if_small(recurring_ranges(docs, id_col, text_col, width, broadcast_rows), broadcast_rows)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), row_key(id_col, text_col).alias("uid"), whole_text(text_col).alias("body")).join(ranges, "uid", "left")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, 1):
            n_words, n_removed, kept = [], [], []
            for body, cut in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = body.encode().split()
                n_words.append(len(words))
                for a, b in zip(cut[-2::-2], cut[-1::-2], strict=True) if cut else ():
                    del words[a:b]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    return rows.select("id", "body", "ranges").mapInArrow(remove, "doc_id long, n_words long, n_removed long, kept_text string")
