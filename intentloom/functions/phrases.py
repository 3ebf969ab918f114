"""Where phrases of a large lexicon stand in texts: hashes of all stretches of the lengths in use, tested against one bitmap.

The steps here run in tasks over Arrow batches; which stretches are phrases is decided by the join that follows (predicates.phrase_matches).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes up to which phrases are followed length by length, bits of the bitmap for each entry and as powers of two at least and at most, bytes of text hashed and stretches begun at once.
FOLLOWED, PER_ENTRY, LEAST_BITS, MOST_BITS, SLICE, STEP = 64, 16, 16, 27, 4_000_000, 1 << 18

_BYTE = np.random.default_rng(11).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(size, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return tuple(out)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class _Hashed:
    """Texts, end to end, such that the hash of any stretch takes one subtraction."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        raw = column.buffers()[2]
        self.data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        self.bounds = offsets - offsets[0]
        size = 1 << max(16, len(self.data).bit_length())
        power, self.inverse = _powers(size)
        self.total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * power[: len(self.data)], out=self.total[1:])

    def of(self, at: np.ndarray | slice, n: int) -> np.ndarray:
        """Hashes of the stretches of n bytes from `at`."""
        ends = slice(at.start + n, at.stop + n) if isinstance(at, slice) else at + n
        return (self.total[ends] - self.total[at]) * self.inverse[at]


def _entry(h: np.ndarray, n: int, whole: bool) -> np.ndarray:
    return _mixed(h + np.uint64((2 * n + whole) * 0xD1342543DE82EF95 % (1 << 64)))


def _places(entry: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(entry >> np.uint64(64 - bits)).astype(np.int64), (entry & np.uint64((1 << bits) - 1)).astype(np.int64)]


def _marked(bitmap: np.ndarray, entry: np.ndarray, bits: int) -> np.ndarray:
    """Indexes of the entries that are in the bitmap at both places."""
    bit = lambda at: bitmap[at >> 3] & (np.uint8(1) << (at & 7).astype(np.uint8))
    first = np.flatnonzero(bit((entry >> np.uint64(64 - bits)).astype(np.int64)))
    return first[bit(_places(entry[first], bits)[1]) != 0]


def bits_for(entries: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, (PER_ENTRY * entries).bit_length()))


def bitmap_words(batches: Iterator[pa.RecordBatch], lengths: list[int], bits: int) -> Iterator[pa.RecordBatch]:
    """(w, bits): the words of 64 bits that the phrases of a batch (column phrase, no empty ones) set: each as a whole, and its beginnings of the lengths up to FOLLOWED."""
    for batch in batches:
        for part in _slices(batch, "phrase"):
            texts = _Hashed(part.column("phrase"))
            begin, size, places = texts.bounds[:-1], np.diff(texts.bounds), [np.zeros(0, np.int64)]
            for n in lengths:
                for whole, which in ((True, size == n), (False, size > n)):
                    if whole or n <= FOLLOWED:
                        places += _places(_entry(texts.of(begin[which], n), n, whole), bits)
            at = np.unique(np.concatenate(places))
            first = np.flatnonzero(np.diff(at >> 6, prepend=-1))
            found = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first) if len(at) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(at[first] >> 6, pa.int64()), pa.array(found.view(np.int64), pa.int64())], names=["w", "bits"])


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + SLICE, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def stretches(batches: Iterator[pa.RecordBatch], lengths: list[int], bits: int, bitmap: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(key_, gram): of each text (key_, blob_) the distinct stretches that the bitmap has as whole phrases.

    A stretch grows through the lengths in use as long as the bitmap has it as the beginning of a longer phrase; so most end after a few, however many lengths there are.
    """
    for batch in batches:
        for part in _slices(batch, "blob_"):
            texts = _Hashed(part.column("blob_"))
            room = np.repeat(texts.bounds[1:], np.diff(texts.bounds))
            docs, begins, sizes, hashes = ([np.zeros(0, kind)] for kind in (np.int64, np.int64, np.int64, np.uint64))
            for step in range(0, len(texts.data), STEP):
                at = np.arange(step, min(step + STEP, len(texts.data)))
                for n in lengths:
                    at = at[at + n <= room[at]]
                    if not len(at):
                        break
                    h = texts.of(at, n)
                    hit = _marked(bitmap, _entry(h, n, True), bits)
                    if len(hit):
                        begins.append(at[hit])
                        hashes.append(h[hit])
                        sizes.append(np.full(len(hit), n))
                        docs.append(np.searchsorted(texts.bounds, at[hit], "right") - 1)
                    if n <= FOLLOWED:
                        at = at[_marked(bitmap, _entry(h, n, False), bits)]
            doc, begin, size, h = map(np.concatenate, (docs, begins, sizes, hashes))
            order = np.lexsort((h, doc))
            once = order[np.flatnonzero((np.diff(doc[order], prepend=-1) != 0) | (np.diff(h[order], prepend=0) != 0))] if len(order) else order
            doc, begin, size = doc[once], begin[once], size[once]
            ends = np.concatenate(([0], np.cumsum(size)))
            letters = texts.data[np.repeat(begin - ends[:-1], size) + np.arange(ends[-1])]
            grams = pa.Array.from_buffers(pa.string(), len(doc), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(letters)])
            yield pa.RecordBatch.from_arrays([part.column("key_").take(pa.array(doc)), grams], names=["key_", "gram"])
    pa.default_memory_pool().release_unused()  # workers live on after a task
