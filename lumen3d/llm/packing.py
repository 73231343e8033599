"""Best-fit packing of tokenised documents, certified by lower bounds."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumen3d.llm.common import shared_table, whole_text
from lumen3d.llm.words import Words, by_size, caches, mixed

PIECES = "id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, round int, part long, bin int, offset long, done boolean"
NAMES = lambda schema: [x.split()[0] for x in schema.split(", ")]
#: Ids by word, for one Python worker; with this many, those not used since the last turn are forgotten.
CACHE_WORDS = 400_000
#: Slots of a worker's table of ids; it starts anew when half of them are taken.
SLOTS = 1 << 20

_tokenizers = caches.setdefault("tokenizers", {})


def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """Bytes that are ASCII letters, and ASCII marks without the apostrophe, which may begin a contraction."""
    letter, mark = np.zeros(256, bool), np.zeros(256, bool)
    letter[[c for c in range(128) if chr(c).isalpha()]] = True
    mark[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = True
    return letter, mark


LETTER, MARK = _kinds()
#: Lead bytes of the composed Latin letters U+00C0 to U+017E, and the pairs among them that are no plain letters.
LEADS, EXCLUDED = (0xC3, 0xC4, 0xC5), ((0xC3, 0x97), (0xC3, 0xB7), (0xC4, 0xB0), (0xC5, 0xBF))


def plain_letters(data: np.ndarray) -> np.ndarray:
    """Bytes of ASCII letters and of composed Latin ones, which normalisation keeps and lower-cases one by one."""
    found = LETTER[data]
    if data.size and data.max() >= 0x80:
        lead = np.isin(data, LEADS)
        for one, two in EXCLUDED:
            lead[:-1] &= ~((data[:-1] == one) & (data[1:] == two))
        found |= lead
        found[1:] |= lead[:-1]
    return found


class IdTable:
    """Ids by 64-bit key, in open addressing over arrays, so that a batch of keys is looked up at once."""

    def __init__(self) -> None:
        self.keys = np.zeros(SLOTS, np.uint64)
        self.start, self.size = np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.int32)
        self.ids, self.end, self.taken = np.zeros(1 << 20, np.uint32), 0, 0

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Where each key is, or the free slot where it belongs."""
        slot = (keys & np.uint64(SLOTS - 1)).astype(np.int64)
        left = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] != 0))
        while len(left):
            slot[left] = (slot[left] + 1) % SLOTS
            here = self.keys[slot[left]]
            left = left[(here != keys[left]) & (here != 0)]
        return slot

    def add(self, keys: np.ndarray, found: list[list[int]]) -> None:
        """Distinct keys that are not in the table, with their ids."""
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        starts = self.end + np.concatenate([[0], np.cumsum(sizes)])
        while starts[-1] > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.end : starts[-1]] = np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))
        self.end, self.taken = int(starts[-1]), self.taken + len(keys)
        left = np.arange(len(keys))
        while len(left):  # of keys that want one slot, one gets it and the others look on
            slot = self.slots(keys[left])
            _, first = np.unique(slot, return_index=True)
            at, won = slot[first], left[first]
            self.keys[at], self.start[at], self.size[at] = keys[won], starts[won], sizes[won]
            left = np.delete(left, first)


class WordTokenizer:
    """Ids of whole texts, word by word.

    No token of the vocabulary spans white space, so the ids of the words between ASCII white space are the ids of
    a text. A word of plain letters and then marks is two pieces to the pre-tokenizer, and its letters go to the
    vocabulary's model alone; all other words go to the tokenizer as they are. Pieces are found by 64-bit hashes
    in a table of the ids of those that the worker has seen.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.letters = Tokenizer(self.whole.model)
        self.letters.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.table = IdTable()

    def _slots(self, words: Words, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray, letters: bool) -> np.ndarray:
        """Table slots of pieces; pieces that are not in the table are tokenised first."""
        slot = self.table.slots(keys)
        new, first = np.unique(keys[self.table.keys[slot] == 0], return_index=True)
        if not len(new):
            return slot
        missing = np.flatnonzero(self.table.keys[slot] == 0)[first]
        texts = [words.data[a:b].tobytes().decode() for a, b in zip(starts[missing].tolist(), ends[missing].tolist(), strict=True)]
        tokenizer = self.letters if letters else self.whole
        found = tokenizer.encode_batch_fast([x.lower() for x in texts] if letters else texts, add_special_tokens=False)
        self.table.add(new, [x.ids for x in found])
        return self.table.slots(keys)

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where each text's begin and end."""
        if self.table.taken > SLOTS // 2:
            self.table = IdTable()
        # special tokens are told by case; elsewhere case makes no difference
        words = Words(column, lower=not pc.any(pc.match_substring(column, "<|")).as_py())
        letter = plain_letters(words.data)
        other = np.append(np.flatnonzero(~letter), len(words.data))
        middle = np.minimum(other[np.searchsorted(other, words.starts)], words.ends)
        marks = np.concatenate([[0], np.cumsum(MARK[words.data], dtype=np.int64)])
        simple = marks[words.ends] - marks[middle] == words.ends - middle
        slots = np.zeros((len(words.starts), 2), np.int64)
        used = np.zeros((len(words.starts), 2), bool)
        for side, chosen, starts, ends in (
            (0, np.flatnonzero(simple & (middle > words.starts)), words.starts, middle),
            (1, np.flatnonzero(simple & (words.ends > middle)), middle, words.ends),
            (0, np.flatnonzero(~simple), words.starts, words.ends),
        ):
            letters = side == 0 and len(chosen) and bool(simple[chosen[0]])
            keys = words.hashes_of(starts[chosen], ends[chosen])
            keys = np.maximum(keys if letters else mixed(keys), 1)
            slots[chosen, side] = self._slots(words, keys, starts[chosen], ends[chosen], letters)
            used[chosen, side] = True
        sizes = np.where(used, self.table.size[slots], 0).ravel().astype(np.int64)
        total = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(self.table.start[slots].ravel() - total[:-1], sizes) + np.arange(total[-1])
        return self.table.ids[at], total[2 * np.concatenate([[0], np.cumsum(words.counts())])]


def word_tokenizer(path: str) -> WordTokenizer:
    """One per Python worker."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def tokenised(docs: DataFrame, id_col: str, text_col: str, path: str, capacity: int, end_id: int) -> DataFrame:
    """The pieces of each document: id, piece, start, length and the CRC-32 of the ids."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, 1, cache="tokenizers"):
            out = []
            ids, bounds = word_tokenizer(path).ids(batch.column(1))
            for doc, a, b in zip(batch.column(0).to_pylist(), bounds.tolist(), bounds[1:].tolist(), strict=False):
                data = ids[a:b].astype("<u4").tobytes() + end
                for piece, start in enumerate(range(0, len(data), 4 * capacity)):
                    cut = data[start : start + 4 * capacity]
                    out.append((doc, piece, start // 4, len(cut) // 4, zlib.crc32(cut)))
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("body")).mapInArrow(pieces, PIECES)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins and offsets of lengths that already decrease, and the bins' fills.

    Open bins are kept by the room they have left; a bit set of the rooms in use finds the least that suffices.
    """
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    used, fills = 0, []
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, n in enumerate(lengths.tolist()):
        fitting = used >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                used ^= 1 << room
        else:
            room, b = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += n
        left = room - n
        if left:
            rooms[left].append(b)
            used |= 1 << left
    return bins, offsets, np.array(fills, np.int64)


def bin_bound(lengths: np.ndarray, capacity: int) -> int:
    """A number of bins that no packing goes below: the best of dual feasible functions.

    The identity bounds by volume. For a threshold t up to half the capacity, lengths over capacity - t count as a
    whole bin and those under t as nothing. For k, lengths are rounded by the function that maps x to
    floor((k + 1) x) / k, but x itself where (k + 1) x is whole.
    """
    if not len(lengths):
        return 0
    best = -(-int(lengths.sum()) // capacity)
    ordered = np.sort(lengths)
    below = np.concatenate([[0], np.cumsum(ordered)])
    for t in np.unique(ordered[ordered <= capacity // 2]).tolist():
        low, high = np.searchsorted(ordered, t), np.searchsorted(ordered, capacity - t, side="right")
        best = max(best, -(-int(below[high] - below[low]) // capacity) + len(ordered) - int(high))
    for k in range(1, 33):
        scaled = ordered * (k + 1)
        units = np.where(scaled % capacity == 0, ordered * k, scaled // capacity * capacity)
        best = max(best, -(-int(units.sum()) // (k * capacity)))
    return best


def packer(turn: int, last: bool, capacity: int):
    """Packs one partition of a round and says which of its bins are done."""

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        lengths = group["length"].to_numpy(np.int64)
        bins, offsets, fills = best_fit_decreasing(lengths, capacity)
        again = np.zeros(len(fills), bool)
        if not last:
            partly = np.flatnonzero(fills < capacity)
            again[partly[np.argsort(fills[partly], kind="stable")[: 1 + 2 * (len(fills) - bin_bound(lengths, capacity))]]] = True
        return group.assign(round=np.int32(turn), bin=bins.astype("int32"), offset=offsets, done=~again[bins])[NAMES(PACKED)]

    return pack


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 1, rows_per_part: int = 16_000) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document's ids end with end_id; only longer ones than capacity are cut. Partitions of about rows_per_part
    pieces are packed by best fit decreasing. Each partition's bins are held against the lower bound of its
    pieces: a bound that is met certifies them, up to the one bin that rounding leaves partly empty. The least
    filled bins, that one and two for each bin above the bound, are opened again, and their pieces meet those of
    other partitions in the next round, in partitions of rows_per_part again, until one is left. Where bounds leave
    so many bins open that a round leaves nine tenths of the pieces, the next one settles them in their partitions: no
    partition ever grows.

    Null text counts as empty and gives a piece that holds end_id alone. Identifiers may be null or repeat; each
    row has pieces of its own. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    return packed_pieces(docs, tokenizer_path, id_col, text_col, capacity, end_id, rows_per_part).select(
        F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", ((F.col("round").cast("long") * (1 << 32) + F.col("part")) * (1 << 24) + F.col("bin")).alias("sequence_id"), "offset"
    )


def packed_pieces(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, capacity: int, end_id: int, rows_per_part: int) -> DataFrame:
    rest = shared_table(tokenised(docs, id_col, text_col, tokenizer_path, capacity, end_id), "packing-pieces")
    n = rest.count()
    parts = max(1, -(-n // rows_per_part))
    rest = rest.withColumn("part", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(parts)))
    finished, last, turn = [], parts == 1, 0
    while True:
        packed = shared_table(rest.groupBy("part").applyInPandas(packer(turn, last, capacity), PACKED), f"packing-round-{turn}")
        finished.append(packed.where("done"))
        if last:
            break
        rest = packed.where("not done")
        before, n = n, rest.count()
        parts, turn = max(1, -(-n // rows_per_part)), turn + 1
        last = parts == 1 or 10 * n > 9 * before
        rest = rest.select(*NAMES(PIECES), F.pmod(F.xxhash64("part"), F.lit(parts)).alias("part"))
    out = finished[0]
    for more in finished[1:]:
        out = out.unionByName(more)
    return out
