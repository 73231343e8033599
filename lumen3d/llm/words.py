"""Words of texts as 64-bit hashes in numpy arrays."""

from __future__ import annotations

import ctypes
import functools
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim  # noqa: B018
except (OSError, AttributeError):
    _libc = None

#: Of a run of up to eight bytes, those that count in a 64-bit word.
_COUNTED = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Runs of more bytes are hashed one by one.
_LONG = 256
_ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))


def is_space(data: np.ndarray) -> np.ndarray:
    """ASCII white space: 0x20 and 0x09 to 0x0D."""
    return ((data - np.uint8(9)) < 5) | (data == 32)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z."""
    return data | (((data - np.uint8(65)) < 26).view(np.uint8) << np.uint8(5))


class Words:
    """The words of several texts as arrays: hashes, first bytes and ends, and the text that each is in.

    Words are runs of anything but ASCII white space (0x20, 0x09 to 0x0D). With lower, A-Z count as a-z in hashes.
    """

    def __init__(self, column: pa.Array, lower: bool) -> None:
        column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        base, size = (int(offsets[0]), int(offsets[-1] - offsets[0])) if len(column) else (0, 0)
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[base : base + size] if size else np.zeros(0, np.uint8)
        self.bounds = offsets - base if len(column) else np.zeros(1, np.int64)
        self.data = data
        space = np.ones(size + 2, bool)
        space[1:-1] = is_space(data)
        edges = np.flatnonzero(space[1:] != space[:-1])
        inner = np.unique(self.bounds[1:-1])
        inner = inner[(inner > 0) & (inner < size)]
        cut = inner[~space[inner + 1] & ~space[inner]]
        if len(cut):  # a word ends where its text does
            cut = np.repeat(cut, 2)
            edges = np.insert(edges, np.searchsorted(edges, cut), cut)
        self.starts, self.ends = edges[::2], edges[1::2]
        self._bytes = np.zeros(size + 8, np.uint8)
        self._bytes[:size] = lowered(data) if lower else data
        self._eight = np.ndarray(size + 1, "<u8", self._bytes, strides=(1,))
        self._counts = np.diff(np.searchsorted(self.starts, self.bounds))
        self.text = np.repeat(np.arange(len(self._counts)), self._counts)

    @functools.cached_property
    def hashes(self) -> np.ndarray:
        return self.hashes_of(self.starts, self.ends)

    @functools.cached_property
    def checks(self) -> np.ndarray:
        """64 more bits of each word: with the hash, its identity."""
        return self.hashes_of(self.starts, self.ends, second=True)

    def hashes_of(self, starts: np.ndarray, ends: np.ndarray, second: bool = False) -> np.ndarray:
        """64 bits of each run of bytes, of its length and its bytes, eight at a time; second ones do not depend on the first."""
        n = ends - starts
        short = np.minimum(n, 8)
        counted = _COUNTED[short]
        one, two = _ODD[2:] if second else _ODD[:2]
        out = mixed((self._eight[starts] & counted) * one + n.astype(np.uint64))
        out = mixed((out ^ (self._eight[ends - short] & counted)) * two)
        left = np.flatnonzero(n > 16)
        for place in range(8, _LONG, 8):  # what lies between the first and the last eight
            left = left[(n[left] > place + 8) & (n[left] <= _LONG)] if place == 8 else left[n[left] > place + 8]
            if not len(left):
                break
            out[left] = mixed((out[left] ^ self._eight[starts[left] + place]) * two + one)
        for i in np.flatnonzero(n > _LONG).tolist():
            digest = hashlib.blake2b(self._bytes[starts[i] : ends[i]], digest_size=16).digest()
            out[i] = int.from_bytes(digest[8:] if second else digest[:8], "little")
        return out

    def counts(self) -> np.ndarray:
        """Words of each text."""
        return self._counts

    def lines(self) -> np.ndarray:
        """The number of each word's line in its text."""
        newlines = np.flatnonzero(self.data == 10)
        before = np.cumsum(np.bincount(np.searchsorted(self.starts, newlines), minlength=len(self.starts) + 1))[:-1]
        return before - np.searchsorted(newlines, self.bounds[:-1])[self.text]


#: What operators keep in a Python worker between tasks, by name.
caches: dict[str, dict] = {}


def trim() -> None:
    """Gives memory that has been freed back to the system, where the libraries can: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def forget(but: str | None) -> None:
    """Empties the caches of other operators than the named one's."""
    held = [cache for name, cache in caches.items() if name != but and cache]
    for cache in held:
        cache.clear()
    if held:
        trim()


def by_size(batches, column: int, most_bytes: int = 250_000, cache: str | None = None):
    """Record batches cut into slices whose texts hold at most so many bytes, or one text; cache names what the caller keeps between tasks."""
    forget(cache)
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    trim()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose every output bit depends on every input bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(hashes: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """Hash of each run of width consecutive words: a polynomial of the mixed word hashes, mixed again."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = mixed(hashes + np.uint64(salt)) if salt else hashes
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total = total * np.uint64(0x9E3779B97F4A7C15) + x[k : k + n]
    return mixed(total)


def distinct_by_row(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values without repeats within a row, sorted by row and value; rows are numbers in ascending order."""
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    first = np.ones(len(values), bool)
    first[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    return values[first], rows[first]


def rows_as_lists(values: np.ndarray, rows: np.ndarray, n: int):
    """An Arrow list array of n rows from values that are sorted by row."""
    ends = np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64)))
