"""Subword pieces of a SentencePiece model: encoding and decoding in batched numpy.

A text is cut where a blank follows something else (no piece of the model crosses such a place, which is checked when
it is read). The distinct units of a batch are encoded once; units of equal length advance together, one step of all of
them at a time. Substrings are found by probing sorted hashes of the pieces.

A unigram model is decoded by Viterbi: for each end, the best score over all pieces that end there is kept with a back
pointer. For a merge (BPE) model the best-scoring path is not its encoding: the pieces' scores are only an order of
merges. There the same batches of equal-length units take the best merge of each unit in every step instead, which
gives the ids that the model defines. The model file says which of both it is. README has the figures.

Rules for odd input: a NULL or empty text has no pieces, and no pieces decode to an empty text (NULL stays NULL in
``text``); characters that no piece holds become byte pieces, or the unknown piece if the model has none; repeated rows
are encoded one by one; an empty table gives an empty result; other columns are kept if asked for by name.
"""

from __future__ import annotations

import functools
import heapq
import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from halocline.llm import text as T
from halocline.llm.frames import tune

BLANK = 0x2581
UNIGRAM, MERGES = 1, 2
#: Units longer than this are merged one by one with a heap, which is faster for them; the result is the same.
LONG = 256
#: Leading bits of a hash that the probes of the sorted keys start from.
INDEX = 18


def _fields(data: bytes):
    """(number, value) of each field of a serialised message: an int, 4 or 8 raw bytes, or a run of bytes."""
    at = 0

    def number():
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 0x7F) << shift
            if b < 0x80:
                return out
            shift += 7

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            value = number()
        else:
            size = {1: 8, 5: 4}[kind] if kind in (1, 5) else number()
            value = data[at: at + size]
            at += size
        yield key >> 3, value


_all_powers = T.Powers(0x9E3779B97F4A7C15)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of the base and of its inverse."""
    p, q = _all_powers(n)
    return p[:n], q[:n]


def _sums(codes: np.ndarray) -> np.ndarray:
    """Prefix sums (rows x length + 1) from which every substring's hash follows."""
    p, _ = _powers(codes.shape[1])
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    np.cumsum(T.mix(codes, 9) * p, axis=1, out=out[:, 1:])
    return out


@dataclass
class Pieces:
    """A model: kind, text and score of each id, byte pieces, and the sorted hashes of ordinary pieces."""

    kind: int
    texts: list[str]
    scores: np.ndarray
    byte_id: np.ndarray
    unknown: int
    keys: np.ndarray = field(repr=False)
    key_id: np.ndarray = field(repr=False)
    longest: int = 1

    @classmethod
    def read(cls, path: str) -> Pieces:
        with open(path, "rb") as f:
            return cls.parse(f.read())

    @classmethod
    def parse(cls, data: bytes) -> Pieces:
        texts, scores, kinds, kind, prefix, squeeze = [], [], [], UNIGRAM, True, True
        for n, value in _fields(data):
            if n == 1:
                piece = dict(_fields(value))
                texts.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                kinds.append(piece.get(3, 1))
            elif n == 2:
                kind = dict(_fields(value)).get(3, UNIGRAM)
            elif n == 3:
                rules = dict(_fields(value))
                prefix, squeeze = bool(rules.get(3, 1)), bool(rules.get(4, 1))
                if rules.get(2):
                    raise ValueError("models that rewrite characters are not supported")
        if kind not in (UNIGRAM, MERGES) or not prefix or squeeze:
            raise ValueError("only unigram and merge models that keep all blanks and put one before the text are supported")
        return cls.build(kind, texts, scores, kinds)

    @classmethod
    def build(cls, kind: int, texts: list[str], scores: list[float], kinds: list[int]) -> Pieces:
        """kinds: 1 ordinary, 2 unknown, 3 control, 4 user-defined, 5 unused, 6 byte."""
        byte_id = np.full(256, -1, np.int32)
        ordinary = []
        for i, (t, k) in enumerate(zip(texts, kinds)):
            if k == 6:
                byte_id[int(t[3:5], 16)] = i
            elif k == 4:
                raise ValueError("user-defined pieces are not supported")
            elif k == 1:
                ordinary.append(i)
                if "▁" in t.lstrip("▁"):
                    raise ValueError("a piece crosses from text to a blank")
        keys = np.empty(len(ordinary), np.uint64)
        for n in {len(texts[i]) for i in ordinary}:
            which = [j for j, i in enumerate(ordinary) if len(texts[i]) == n]
            codes = np.array([[ord(c) for c in texts[ordinary[j]]] for j in which], np.uint64)
            keys[which] = _sums(codes)[:, n]
        order = np.argsort(keys)
        unknown = kinds.index(2) if 2 in kinds else 0
        return cls(kind, texts, np.array(scores, float), byte_id, unknown, keys[order], np.array(ordinary, np.int32)[order], max((len(texts[i]) for i in ordinary), default=1))

    @functools.cached_property
    def written(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What every id stands for in UTF-8: all bytes, and where each id's begin and how many they are."""
        held = [t.replace("▁", " ").encode() for t in self.texts]
        for b, i in enumerate(self.byte_id.tolist()):
            if i >= 0:
                held[i] = bytes([b])
        size = np.array([len(b) for b in held])
        return np.frombuffer(b"".join(held), np.uint8), np.cumsum(size) - size, size

    def __post_init__(self):
        # where the keys of each leading INDEX bits begin, and the most that share them
        self._begin = np.searchsorted(self.keys, np.arange(1 << INDEX, dtype=np.uint64) << np.uint64(64 - INDEX)).astype(np.int32)
        self._most = int(np.bincount((self.keys >> np.uint64(64 - INDEX)).astype(np.int64)).max()) if len(self.keys) else 0
        self._keys = np.append(self.keys, np.zeros(self._most, np.uint64))
        self._ids = np.append(self.key_id, np.full(self._most, -1, np.int32))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Ids of ordinary pieces by hash, -1 for none: the sorted keys are probed from their leading bits on."""
        at = self._begin[(h >> np.uint64(64 - INDEX)).astype(np.int64)]
        out = np.full(len(h), -1, np.int32)
        for i in range(self._most):
            same = self._keys[at + i] == h
            out[same] = self._ids[at[same] + i]
        return out


def _viterbi(model: Pieces, sums: np.ndarray) -> np.ndarray:
    """stop[row, start]: end of the piece that begins there on the best path, else 0."""
    n, length = sums.shape[0], sums.shape[1] - 1
    _, q = _powers(length + 1)
    best = np.full((n, length + 1), -np.inf)
    best[:, 0] = 0
    back = np.ones((n, length + 1), np.int64)
    lowest = model.scores[model.key_id].min() - 10 if len(model.key_id) else -10.0
    for end in range(1, length + 1):
        for size in range(1, min(model.longest, end) + 1):
            piece = model.find((sums[:, end] - sums[:, end - size]) * q[end - size])
            gain = np.where(piece >= 0, model.scores[piece], lowest if size == 1 else -np.inf) + best[:, end - size]
            better = gain > best[:, end]
            best[better, end] = gain[better]
            back[better, end] = size
    stop = np.zeros((n, length), np.int64)
    end = np.full(n, length)
    while (end > 0).any():
        rows = np.flatnonzero(end > 0)
        start = end[rows] - back[rows, end[rows]]
        stop[rows, start] = end[rows]
        end[rows] = start
    return stop


def _merge(model: Pieces, sums: np.ndarray) -> np.ndarray:
    """stop[row, start] after all merges: in each step every unit joins its best-scoring neighbours, the leftmost of equals."""
    n, length = sums.shape[0], sums.shape[1] - 1
    _, q = _powers(length + 1)
    stop = np.tile(np.arange(1, length + 1), (n, 1))
    before = np.tile(np.arange(-1, length - 1), (n, 1))

    def value(rows, a, b):
        piece = model.find((sums[rows, b] - sums[rows, a]) * q[a])
        return np.where(piece >= 0, model.scores[piece], -np.inf)

    gain = np.full((n, length), -np.inf)
    for a in range(length - 1):
        gain[:, a] = value(np.arange(n), np.full(n, a), np.full(n, a + 2))
    live = np.arange(n)
    while len(live):
        at = gain[live].argmax(axis=1)
        good = gain[live, at] > -np.inf
        live, at = live[good], at[good]
        gone = stop[live, at]
        end = stop[live, gone]
        stop[live, at], stop[live, gone], gain[live, gone] = end, 0, -np.inf
        gain[live, at] = -np.inf
        more = end < length
        r, a, e = live[more], at[more], end[more]
        before[r, e] = a
        gain[r, a] = value(r, a, stop[r, e])
        r, a = live[at > 0], at[at > 0]
        p = before[r, a]
        gain[r, p] = value(r, p, stop[r, a])
    return stop


def _merge_long(model: Pieces, sums: np.ndarray) -> np.ndarray:
    """The same for one long unit, with the possible merges in a heap."""
    length = sums.shape[1] - 1
    _, q = _powers(length + 1)
    stop, before = np.arange(1, length + 1), np.arange(-1, length - 1)
    start = np.arange(length - 1)
    piece = model.find((sums[0, start + 2] - sums[0, start]) * q[start])
    heap = [(-model.scores[p], a, a + 1, a + 2) for a, p in zip(start.tolist(), piece.tolist()) if p >= 0]
    heapq.heapify(heap)

    def offer(a, m, e):
        p = model.find((sums[0, e: e + 1] - sums[0, a: a + 1]) * q[a: a + 1])[0]
        if p >= 0:
            heapq.heappush(heap, (-model.scores[p], a, m, e))

    while heap:
        _, a, m, e = heapq.heappop(heap)
        if stop[a] != m or stop[m] != e:
            continue
        stop[a], stop[m] = e, 0
        if e < length:
            before[e] = a
            offer(a, e, int(stop[e]))
        if a > 0:
            p = int(before[a])
            offer(p, a, e)
    return stop[None]


def _units(model: Pieces, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the units in the rows of codes, one after the other, and how many each has."""
    sums = _sums(codes)
    if model.kind == UNIGRAM:
        stop = _viterbi(model, sums)
    elif codes.shape[1] > LONG:
        stop = np.concatenate([_merge_long(model, sums[i: i + 1]) for i in range(len(sums))])
    else:
        stop = _merge(model, sums)
    _, q = _powers(codes.shape[1] + 1)
    row, start = np.nonzero(stop)
    end = stop[row, start]
    ids = model.find((sums[row, end] - sums[row, start]) * q[start])
    lost = np.flatnonzero(ids < 0)
    if not len(lost):
        return ids, np.bincount(row, minlength=len(codes))
    n = np.ones(len(ids), np.int64)
    parts = {}
    for c in np.unique(codes[row[lost], start[lost]]).tolist():
        b = model.byte_id[list(chr(c).encode("utf-8", "surrogatepass"))]
        parts[c] = b if (b >= 0).all() else np.array([model.unknown], np.int32)
    fill = [parts[c] for c in codes[row[lost], start[lost]].tolist()]
    n[lost] = [len(f) for f in fill]
    first = np.cumsum(n) - n
    out = np.zeros(int(n.sum()), np.int32)
    keep = np.ones(len(ids), bool)
    keep[lost] = False
    out[first[keep]] = ids[keep]
    out[T.spread(first[lost], first[lost] + n[lost])] = np.concatenate(fill)
    return out, np.bincount(row, weights=n, minlength=len(codes)).astype(np.int64)


def encode_batch(model: Pieces, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after the other, and the number of each."""
    lines = [f" {t}" if t else "" for t in texts]
    size = np.array([len(x) for x in lines])
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if not len(codes):
        return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
    codes[codes == 0x20] = BLANK
    blank = codes == BLANK
    at = np.cumsum(size) - size
    first = np.zeros(len(codes), bool)
    first[1:] = blank[1:] & ~blank[:-1]
    first[at[size > 0]] = True
    start = np.flatnonzero(first)
    length = np.diff(np.append(start, len(codes)))
    sums = _sums(codes[None])[0]
    _, q = _powers(len(codes) + 1)
    h = T.mix((sums[start + length] - sums[start]) * q[start] + length.astype(np.uint64))
    _, one, back = np.unique(h, return_index=True, return_inverse=True)
    flat, number, place = [], np.zeros(len(one), np.int64), np.zeros(len(one), np.int64)
    done = 0
    for n in np.unique(length[one]).tolist():
        same = np.flatnonzero(length[one] == n)
        step = max(1, (1 << 20) // n)
        for low in range(0, len(same), step):
            which = same[low: low + step]
            ids, c = _units(model, codes[start[one[which]][:, None] + np.arange(n)])
            place[which] = done + np.cumsum(c) - c
            number[which] = c
            flat.append(ids)
            done += len(ids)
    flat = np.concatenate(flat).astype(np.int32)
    out = flat[T.spread(place[back], place[back] + number[back])]
    row = np.searchsorted(np.cumsum(size), start, side="right")
    return out, np.bincount(row, weights=number[back], minlength=len(texts)).astype(np.int64)


def decode_batch(model: Pieces, ids: np.ndarray, n: np.ndarray) -> list[str]:
    """The texts of id runs of n each."""
    table, start, size = model.written
    out = table[T.spread(start[ids], start[ids] + size[ids])].tobytes()
    ends = np.concatenate([[0], np.cumsum(size[ids])])[np.concatenate([[0], np.cumsum(n)])]
    return [out[a + (out[a: a + 1] == b" "): b].decode("utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def _encode(model: Pieces, others: list[str]):
    def run(batches):
        for batch in batches:
            for part in T.pieces(batch, "text", T.CHUNK // 2):
                ids, n = encode_batch(model, part.column(part.schema.get_field_index("text")).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in others), lists], names=[*others, "ids"])
    return run


def _decode(model: Pieces, others: list[str]):
    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                lists = part.column(part.schema.get_field_index("ids")).fill_null([])
                n = np.diff(np.asarray(lists.offsets, np.int64))
                texts = decode_batch(model, np.asarray(lists.flatten(), np.int64), n)
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in others), pa.array(texts, pa.string())], names=[*others, "decoded"])
    return run


def encode(docs: DataFrame, model: Pieces, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """doc_id, the columns in ``keep`` ("text" for the text itself) and ids of every whole text, without a shuffle."""
    tune(docs.sparkSession)
    others = ["doc_id", *keep]
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), *(c for c in keep if c != "text"), F.col(text_col).cast("string").alias("text"))
    schema = ", ".join(f"`{c}` {slim.schema[c].dataType.simpleString()}" for c in others)
    return slim.mapInArrow(T.lean(_encode(model, others)), f"{schema}, ids array<int>")


def decode(encoded: DataFrame, model: Pieces) -> DataFrame:
    """All columns of a table with ``ids`` that are named below, and ``decoded``."""
    others = [c for c in encoded.columns if c != "decoded"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields if f.name in others)
    return encoded.mapInArrow(T.lean(_decode(model, others)), f"{schema}, decoded string")
