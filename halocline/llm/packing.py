"""Packing of documents into token windows by the sum-of-squares rule, online, without a shuffle.

A window is a sequence of at most ``size`` tokens. A document goes, whole, into that fill level of the partially filled
windows (or into a new window) for which the sum over levels of (number of windows at that level) squared grows least;
full windows don't count. The rule keeps all levels about equally filled, so that a window is there for any length to
come. The levels are one array of counts, and each level has a stack of its windows. Ties go to the fullest level, and
to an open window before a new one. What a document has beyond whole windows of ``size`` tokens is placed like that;
the whole ones are sequences of their own.

Each task packs the rows of its own input split in their order: no rows move, and a task that runs again makes the same
sequences, since a split has the same rows in the same order. Sequences are numbered by split and by place in it.
When the split ends, the windows still open are merged: the emptiest are cut up to fill the fullest, at most one cut for
a window that becomes full. The one that is left is cut into sequences whose lengths are powers of two, which need no
padding; so only windows that were never touched again are padded, and there are none.

A task holds the ids of its open windows, at most the ids of its split. Texts beyond ``text.CHUNK`` bytes are encoded in
parts that end at white space, which no token spans.

Rules for odd input: a NULL or empty text has no tokens but its closing id; a NULL doc_id stays NULL and its rows are
packed like others; rows that repeat a doc_id are documents of their own; an empty table gives no rows; columns beyond
id and text are not looked at. Ids of a text are what the ``tokenizers`` library gives for it, special tokens that are
written out in a text included.
"""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from halocline.llm import text as T

SIZE = 2048
#: Id that closes each document.
CLOSE = 1
#: Distinct words a task remembers the ids of (beyond that it starts anew), and words encoded in one call.
REMEMBERED, GROUP = 1 << 20, 256
#: Words whose letters stay letters when they are composed and lower-cased.
LATIN = "^[a-zA-ZÀ-ÖØ-Þß-öø-ÿ]+$"
_ENDS, _LETTER = np.isin(np.arange(256), list(b".,;:!?")), np.isin(np.arange(256) | 32, np.arange(97, 123)) & (np.arange(256) < 128)

_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Ids of whole texts under a tokenizer file that splits at white space and drops it. Every distinct word is encoded once a task.

    Words that end in a letter and one of ``.,;:!?`` are two units where the file's pattern parts them anyway, and A-Z are
    lower-cased first where the file does so; both leave fewer distinct words. New words go to the library many at a time,
    parted by blanks. Words of Latin letters alone end where an id ends a word; of others the place of each id tells. The
    file is read where the encoder is made and sent along with tasks (some MB).
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self._start(f.read())

    def _start(self, source: str) -> None:
        self.source, self._model = source, None
        parts = json.loads(source)
        self.lower = '"Lowercase"' in json.dumps(parts["normalizer"])
        pattern = json.dumps(parts["pre_tokenizer"], ensure_ascii=False)
        self.parted = all(x in pattern for x in (r"[\\p{L}]+", r"[^\\s\\p{L}\\p{N}]+"))
        self.added = [t["content"].encode() for t in parts["added_tokens"]]
        suffix = parts["model"].get("end_of_word_suffix")
        self.ends = None
        if self.parted and suffix:
            vocabulary = parts["model"]["vocab"]
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for w, i in vocabulary.items() if w.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self._words, self._ids, self._first = pa.array([], pa.large_string()), np.empty(0, np.int32), np.zeros(1, np.int64)

    def __reduce__(self):
        return _encoder, (self.source,)

    def _library(self, words: list[str], encode) -> list:
        return encode([" ".join(words[i: i + GROUP]) for i in range(0, len(words), GROUP)], add_special_tokens=False)

    def _learn(self, words: pa.Array) -> np.ndarray:
        """Encode new words and keep their ids; the numbers they have from now on."""
        if self._model is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer
            self._model = Tokenizer.from_str(self.source)
        plain = pc.match_substring_regex(words, LATIN) if self.ends is not None else pa.array(np.zeros(len(words), bool))
        some, before = words.filter(plain), len(self._words)
        if len(some):
            ids = np.concatenate([np.array(e.ids, np.int32) for e in self._library(some.to_pylist(), self._model.encode_batch_fast)])
            self._keep(some, ids, np.flatnonzero(self.ends[ids]) + 1)
        some = words.filter(pc.invert(plain))
        if len(some):
            listed = some.to_pylist()
            ids, ends, seen = [], [], 0
            for i, e in enumerate(self._library(listed, self._model.encode_batch)):
                at = np.fromiter((o[0] for o in e.offsets), np.int64, len(e.ids))
                begin = np.cumsum([len(w) + 1 for w in listed[i * GROUP: (i + 1) * GROUP]])
                ids.append(np.array(e.ids, np.int32))
                ends.append(np.searchsorted(at, begin) + seen)
                seen += len(at)
            self._keep(some, np.concatenate(ids), np.concatenate(ends))
        first = np.asarray(plain)
        return before + np.where(first, np.cumsum(first) - 1, first.sum() + np.cumsum(~first) - 1)

    def _keep(self, words: pa.Array, ids: np.ndarray, ends: np.ndarray) -> None:
        self._words = pa.concat_arrays([self._words, words])
        self._first = np.concatenate([self._first, ends + len(self._ids)])
        self._ids = np.concatenate([self._ids, ids])
        if len(self._words) != len(self._first) - 1:
            raise ValueError("the tokenizer does not part words as its file says")

    def _places(self, words: pa.Array) -> np.ndarray:
        """Numbers of these distinct words among the known ones."""
        if len(self._words) > REMEMBERED:
            self._forget()
        at = pc.index_in(words, value_set=self._words)
        new = np.asarray(pc.is_null(at))
        out = np.asarray(pc.fill_null(at, 0), np.int64).copy()
        if new.any():
            out[new] = self._learn(words.filter(pa.array(new)))
        return out

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts in order, and how many each text has."""
        words = T.Words(texts, T.SOLID, self.lower)
        if self.lower and any(a in words.buf.tobytes() for a in self.added):  # the case of added tokens counts
            words = T.Words(texts, T.SOLID, False)
        start, end, first = words.start, words.end, words.first
        if self.parted and len(words):
            two = (end - start > 1) & _ENDS[words.buf[end - 1]] & _LETTER[words.buf[end - 2]]
            more = np.cumsum(two)
            first = first + np.concatenate([[0], more])[first]
            words.start, words.end = np.insert(start, np.flatnonzero(two) + 1, end[two] - 1), np.insert(end, np.flatnonzero(two), end[two] - 1)
        coded = words.strings(np.arange(len(words.start))).dictionary_encode()
        which = np.asarray(coded.indices, np.int64)
        which = self._places(coded.dictionary)[which]
        low, high = self._first[which], self._first[which + 1]
        upto = np.concatenate([[0], np.cumsum(high - low)])[first]
        return self._ids[T.spread(low, high)], np.diff(upto)


def _encoder(source: str) -> Encoder:
    made = Encoder.__new__(Encoder)
    made._start(source)
    return made


class Packer:
    """Windows of one stream of documents. ``place`` takes one document; full windows and, after ``close``, all others come out of ``done``.

    A window is a list of pieces (document number, start, ids); the level array counts open windows by their fill.
    """

    def __init__(self, size: int = SIZE):
        self.size = size
        self.level = np.zeros(size + 1, np.int64)
        self.open: list[list] = [[] for _ in range(size)]
        self.done: list[list] = []

    def best(self, n: int) -> int:
        """Fill level where a piece of n tokens adds least to the sum of squares; 0 is a new window."""
        here = self.level[1: self.size + 1 - n]
        fresh = 2 * self.level[n] + 1
        if not len(here):
            return 0
        grown = 2 * (self.level[n + 1:] - here) + 2
        grown[-1] -= 1  # a full window leaves the sum
        grown[here == 0] = fresh + 1
        at = len(grown) - 1 - int(np.argmin(grown[::-1]))
        return at + 1 if grown[at] <= fresh else 0

    def place(self, doc: int, ids: np.ndarray) -> None:
        whole = len(ids) // self.size * self.size
        for start in range(0, whole, self.size):
            self.done.append([(doc, start, ids[start: start + self.size])])
        n = len(ids) - whole
        if not n:
            return
        at = self.best(n)
        window = self.open[at].pop() if at else []
        window.append((doc, whole, ids[whole:].copy()))
        if at:
            self.level[at] -= 1
        if at + n == self.size:
            self.done.append(window)
        else:
            self.level[at + n] += 1
            self.open[at + n].append(window)

    def close(self) -> None:
        """Fill the fullest open windows with what is cut from the emptiest; the last one ends in lengths that are powers of two."""
        left = [(fill, w) for fill in range(self.size - 1, 0, -1) for w in self.open[fill]]
        low, high = 0, len(left) - 1
        while low < high:
            fill, window = left[low]
            spare, source = left[high]
            room = self.size - fill
            doc, start, ids = source.pop()
            if len(ids) > room:
                source.append((doc, start + room, ids[room:]))
                ids = ids[:room]
            window.append((doc, start, ids))
            left[high] = (spare - len(ids), source)
            left[low] = (fill + len(ids), window)
            if left[low][0] == self.size:
                self.done.append(window)
                low += 1
            if not source:
                high -= 1
        if low == high:
            self._powers(*left[low])
        self.level[:] = 0
        self.open = [[] for _ in range(self.size)]

    def _powers(self, fill: int, window: list) -> None:
        pieces = window[::-1]
        for bit in range(fill.bit_length() - 1, -1, -1):
            if not fill >> bit & 1:
                continue
            room, out = 1 << bit, []
            while room:
                doc, start, ids = pieces.pop()
                if len(ids) > room:
                    pieces.append((doc, start + room, ids[room:]))
                    ids = ids[:room]
                out.append((doc, start, ids))
                room -= len(ids)
            self.done.append(out)


def _encoded(batches, encode: Encoder, close: int):
    """(doc_id, ids) of each row, its closing id included."""
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index("id")).to_pylist()
        held: list[np.ndarray] = []
        for rows, texts, last in T.parts(batch.column(batch.schema.get_field_index("text")), T.CHUNK, ~T.SOLID):
            found, n = encode(texts)
            edges = np.concatenate([[0], np.cumsum(n)])
            for i, row in enumerate(rows):
                held.append(found[edges[i]: edges[i + 1]])
                if last:
                    yield ids[row], np.concatenate([*held, np.array([close], np.int32)])
                    held = []


def pack(docs: DataFrame, path: str, size: int = SIZE, close: int = CLOSE, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids.

    ``path`` names a file of the ``tokenizers`` library whose tokens never span white space.
    """
    encode = Encoder(path)

    def run(batches):
        from pyspark import TaskContext
        first = TaskContext.get().partitionId() << 32
        packer, docs_, tokens, number = Packer(size), [], [], 0

        def out():
            nonlocal number
            rows = []
            for window in packer.done:
                offset = 0
                for doc, start, ids in window:
                    rows.append((docs_[doc], start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), tokens[doc], first + number, offset, ids))
                    offset += len(ids)
                number += 1
            packer.done = []
            columns = list(zip(*rows))
            arrays = [pa.array(c, pa.int64()) for c in columns[:7]]
            if with_ids:
                edges = np.concatenate([[0], np.cumsum(columns[2])]).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(columns[7]))))
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
            return pa.RecordBatch.from_arrays(arrays, names=names[: len(arrays)])

        waiting = 0
        for doc_id, ids in _encoded(batches, encode, close):
            packer.place(len(docs_), ids)
            docs_.append(doc_id)
            tokens.append(len(ids))
            waiting += len(ids)
            if waiting > 1 << 20 and packer.done:
                yield out()
                waiting = 0
        packer.close()
        if packer.done:
            yield out()

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(T.lean(run), _SCHEMA + (", ids array<int>" if with_ids else ""))


def padding(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """One row (n_sequences, n_tokens, n_padding): sequences are padded to ``size`` unless their length is a power of two."""
    filled = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    exact = F.bit_count("n") == 1
    return filled.agg(F.count("*").alias("n_sequences"), F.sum("n").alias("n_tokens"), F.sum(F.when(exact, 0).otherwise(size - F.col("n"))).alias("n_padding"))
