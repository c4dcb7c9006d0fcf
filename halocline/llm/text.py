"""Words of whole texts as numpy arrays, batch by batch inside tasks.

A batch of texts is one byte buffer. Words are runs of bytes of a class; since every byte of a non-ASCII
character is 0x80 or more, byte classes equal the character classes used here. Each word gets a 64-bit hash.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once; one longer text is worked on alone.
CHUNK = 2 << 20

_BYTES = np.arange(256)
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]``: digits, a-z and everything beyond ASCII.
ALNUM = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
#: ``[^\x20\x09-\x0D]``: everything but white space.
SOLID = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))
_LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = np.asarray(x, np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (2 * salt + 1)) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_CODE = mix(np.arange(256), 7)
class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as many as were asked for so far.

    The tables are not sent along with tasks: what is unpickled starts empty again.
    """

    def __init__(self, base: int):
        self.base, self.tables = base, (np.ones(1, np.uint64), np.ones(1, np.uint64))

    def __reduce__(self):
        return Powers, (self.base,)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.tables[0]) < n:
            made = []
            for base in (self.base, pow(self.base, -1, 2**64)):
                steps = np.full(max(n, 1 << 16), base, np.uint64)
                steps[0] = 1
                made.append(np.multiply.accumulate(steps))
            self.tables = tuple(made)
        return self.tables


_power = Powers(0x5851F42D4C957F2D)


class Words:
    """Words of some texts: row (index of the text), start and end in ``buf``, and hash; in order of place."""

    def __init__(self, texts: pa.Array, kind: np.ndarray, lower: bool):
        texts = pc.fill_null(texts, "")
        wide = pa.types.is_large_string(texts.type)
        at = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset: texts.offset + len(texts) + 1].astype(np.int64)
        data = texts.buffers()[2]
        buf = np.frombuffer(data, np.uint8)[at[0]: at[-1]] if data is not None else np.empty(0, np.uint8)
        at = at - at[0]
        if lower:
            buf = _LOWER[buf]
        self.buf, self.at, self.n_rows = buf, at, len(texts)
        solid = kind[buf]
        edge = np.zeros(len(buf) + 1, bool)
        edge[at] = True
        before, after = np.empty_like(solid), np.empty_like(solid)
        before[1:], after[:-1] = solid[:-1], solid[1:]
        before[:1], after[-1:] = False, False
        self.start = np.flatnonzero(solid & (~before | edge[:-1]))
        self.end = np.flatnonzero(solid & (~after | edge[1:])) + 1
        self.row = np.searchsorted(at, self.start, side="right") - 1
        p, _ = _power(len(buf) + 1)
        self._total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_CODE[buf] * p[: len(buf)], out=self._total[1:])
        self.hash = mix(self.span_hash(self.start, self.end))
        self.first = np.searchsorted(self.row, np.arange(self.n_rows + 1))  # of each text, and the end

    def __len__(self) -> int:
        return len(self.start)

    def span_hash(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Hash of the bytes low to high (exclusive), not yet mixed."""
        return (self._total[high] - self._total[low]) * _power(len(self.buf) + 1)[1][low]

    def prefixes(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words of more than n characters, and a hash of their first n characters."""
        heads = np.append(np.flatnonzero((self.buf & 0xC0) != 0x80), len(self.buf))
        begin = np.searchsorted(heads, self.start)
        stop = heads[np.minimum(begin + n, len(heads) - 1)]
        which = np.flatnonzero(stop < self.end)
        return which, mix(self.span_hash(self.start[which], stop[which]), n)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def strings(self, which: np.ndarray) -> pa.Array:
        """The words of these numbers."""
        return self.joined(which, which + 1)

    def joined(self, low: np.ndarray, high: np.ndarray) -> pa.Array:
        """For each pair, the words low to high (exclusive) with one blank between them."""
        words = spread(low, high)
        size = self.end[words] - self.start[words] + 1
        stop = np.cumsum(size)
        pick = np.repeat(self.start[words] - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)
        out = self.buf[np.minimum(pick, max(len(self.buf) - 1, 0))]
        out[stop - 1] = 0x20
        ends = np.concatenate([[0], stop])[np.concatenate([[0], np.cumsum(high - low)])]
        # drop the blank after each last word
        keep = np.ones(len(out), bool)
        full = high > low
        keep[ends[1:][full] - 1] = False
        ends = ends - np.concatenate([[0], np.cumsum(full)])
        return pa.LargeStringArray.from_buffers(len(low), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(out[keep]))


def lean(run):
    """A function over batches that gives free memory back to the system when a task has ended: Spark keeps its workers."""
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim is not None:
                trim(0)
    return wrapped


def spread(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """low[0]..high[0]-1, low[1]..high[1]-1, and so on, in one array."""
    n = high - low
    stop = np.cumsum(n)
    return np.repeat(low - (stop - n), n) + np.arange(stop[-1] if len(stop) else 0)


def pieces(batch: pa.RecordBatch, text: str, size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``size`` bytes of text."""
    column = batch.column(batch.schema.get_field_index(text))
    upto = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64) + 1)
    low = 0
    while low < batch.num_rows:
        seen = upto[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(upto, seen + size, side="right")))
        yield batch.slice(low, high - low)
        low = high


def parts(column: pa.Array, size: int, border: np.ndarray) -> Iterator[tuple[range, pa.Array, bool]]:
    """(row numbers, their texts, last) of a column of texts, about ``size`` bytes at once.

    A longer text comes alone, in parts that end after a byte of the class ``border`` (which must be ASCII); ``last`` is
    False for all but its last part. Where such bytes are further apart, a part is longer.
    """
    batch = pa.RecordBatch.from_arrays([column], names=["text"])
    row = 0
    for some in pieces(batch, "text", size):
        texts = some.column(0)
        if some.num_rows > 1 or not texts[0].is_valid or len(data := texts[0].as_buffer()) <= size:
            yield range(row, row + some.num_rows), texts, True
        else:
            buf = np.frombuffer(data, np.uint8)
            low = 0
            while low < len(buf):
                high = min(low + size, len(buf))
                while high < len(buf):
                    step = border[buf[high - 1: high - 1 + size]]
                    if step.any():
                        high += int(np.argmax(step))
                        break
                    high = min(high + size, len(buf))
                yield range(row, row + 1), pa.array([buf[low:high].tobytes().decode()], pa.large_string()), high >= len(buf)
                low = high
        row += some.num_rows


def tuple_hash(words: Words, here: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each of these, in order."""
    h = np.full(len(here), n, np.uint64)
    for i in range(n):
        h = mix(h ^ words.hash[here + i], n)
    return h


def tuples(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words that begin n words of one text, and a hash of those n words in order."""
    here = np.flatnonzero(words.row[: len(words) - n + 1] == words.row[n - 1:]) if len(words) >= n else np.empty(0, np.int64)
    return here, tuple_hash(words, here, n)


def signed(x: np.ndarray) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def text_key(words: Words) -> np.ndarray:
    """A 64-bit hash of each whole text, byte by byte after lower-casing if that was asked for."""
    length = np.diff(words.at).astype(np.uint64)
    return signed(mix(words.span_hash(words.at[:-1], words.at[1:]) + length))
