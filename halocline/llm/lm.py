"""Scores of texts under a Brown class model: P(word | previous) = P(class | previous class) * P(word | class).

Training counts every word of all training texts (a group-by; its result grows with the corpus), and every one of them
gets a class by exchange clustering: a word moves to the class that raises the likelihood of the class bigrams most, and
the exchange ends when a sweep over all words moves none.

* The ``CORE`` most frequent words are moved one by one in the driver, on their bigrams among themselves and with the
  classes of all other words; this table has at most (CORE + CLASSES)**2 cells.
* All other words are dealt to parts of about ``PART`` words, each with the lists of the words before and after it. The
  parts of one of ``GROUPS`` groups choose at once, each word by its exact gain as if it moved alone; the class bigrams
  are then counted anew where a word moved. Where the moves together lower the likelihood, half of them are taken back,
  and half of the rest, down to a single one, which cannot lower it. So the likelihood rises with every step and the
  exchange ends. Most sweeps look only at words that stand next to one that has moved; when such a sweep moves none, the
  next looks at all words, and only one of these can be the last.
* They start in the class whose bigrams with the core their own neighbours favour.

Ends of texts are a class of their own. Words that no training text has are the class of rare words, with those beyond
``vocabulary`` where a caller bounds it (no query does). Counts are discounted, in classes and in class bigrams, by n1 /
(n1 + 2 n2) for each word, of n1 words seen once and n2 seen twice; that part of its bigrams counts for the rare class, whose
share is dealt to as many unknown words as there are words seen once, and one.
Class bigrams are smoothed towards class frequencies, so that the probabilities of what can follow sum to one.

Texts are coded once as word numbers by falling frequency. The most frequent words travel with the tasks that do so, as
a table of fixed size; the numbers of others come by a join. What tasks hold of all words is one byte for each, its
class, and another in the exchange, whether it has moved. Words are told apart by 64-bit hashes: two of a billion
different words share one with a chance of 3 in 100, which would add up their counts.

Rules for odd input: a NULL text is an empty one (one token, its end); a NULL doc_id is in training (the remainder is
not 2); repeated rows give one result row each and count in training as often as they occur; an empty table gives an
empty result; columns beyond id and text are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from halocline.llm import text as T
from halocline.llm.frames import kept, tune
from halocline.session import release, scratch, written

CORE = 1024
#: At most so many frequent words travel with the tasks that code texts (16 bytes each); numbers of the others are joined.
COUNTED = 262_144
CLASSES = 48
MASS = 5.0
#: Words of a part, and groups of parts that move in turn; one word in so many may have moved for only its neighbours to be looked at next.
PART, GROUPS, FEW = 65_536, 4, 32
#: Bytes of text in a row of coded texts, unless one text is longer; tokens of a task whose pairs are summed at once.
CODED, TOKENS = 1 << 19, 8 << 20
#: Words looked at together, and counts up to which differences of x ln x are looked up.
BLOCK, LOOKED_UP = 8192, 64
#: Bytes of neighbours and counts up to which the driver exchanges all words: jobs of hundreds of steps would take longer.
HERE = 4 << 20


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _word_counts(batches):
    for batch in batches:
        for part in T.pieces(batch, "text"):
            h, n = np.unique(T.Words(part.column(0), T.SOLID, lower=True).hash, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(T.signed(h)), pa.array(n.astype(np.int64))], names=["h", "c"])


def _ranked(words: DataFrame) -> DataFrame:
    """h, c and rank: the words' numbers from 0 by falling count, ties by hash."""
    order = [F.desc("c"), F.asc("h")]
    placed = kept(words.repartitionByRange(*order).sortWithinPartitions(*order).select("h", "c", F.monotonically_increasing_id().alias("at")), "ranks")
    sizes = placed.groupBy(F.shiftright("at", 33).alias("slice")).agg(F.count("*").alias("n")).toPandas().sort_values("slice")  # one row for each task
    firsts = placed.sparkSession.createDataFrame([(int(s), int(x)) for s, x in zip(sizes["slice"], sizes["n"].cumsum() - sizes["n"])], "slice long, first long")
    return (placed.withColumn("slice", F.shiftright("at", 33)).join(F.broadcast(firsts), "slice")
            .select("h", "c", (F.col("first") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("rank")))


def _with_ends(words: T.Words, codes: np.ndarray, end: int) -> np.ndarray:
    """Codes of all texts in a row, each followed by its end."""
    stops = words.first[1:] + np.arange(words.n_rows)
    out = np.full(len(codes) + words.n_rows, end, codes.dtype)
    keep = np.ones(len(out), bool)
    keep[stops] = False
    out[keep] = codes
    return out


# --- texts as word numbers -----------------------------------------------------------------------------------------

_CODED = "chunk long, ids binary, has_id binary, held binary, tokens binary"


def _binary(*arrays: np.ndarray) -> list[pa.Array]:
    return [pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for a in arrays]


def _code(hashes: np.ndarray, number: np.ndarray, end: int):
    """Rows of texts with the numbers of travelling words; another word is -2 minus its place among the row's other hashes."""
    def run(batches):
        chunk = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in T.pieces(batch, "text", CODED):
                ids, held = part.column(part.schema.get_field_index("id")), part.column(part.schema.get_field_index("held"))
                words = T.Words(part.column(part.schema.get_field_index("text")), T.SOLID, lower=True)
                at = np.minimum(np.searchsorted(hashes, words.hash), max(len(hashes) - 1, 0))
                known = hashes[at] == words.hash if len(hashes) else np.zeros(len(words), bool)
                other, where = np.unique(words.hash[~known], return_inverse=True)
                code = np.empty(len(words), np.int32)
                code[known] = number[at[known]]
                code[~known] = -2 - where
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), *_binary(np.asarray(ids.fill_null(0), np.int64), np.asarray(ids.is_valid()), np.asarray(held), _with_ends(words, code, end), other)],
                                                 names=["chunk", "ids", "has_id", "held", "tokens", "other"])
                chunk += 1
    return T.lean(run)


def _others(batches):
    for batch in batches:
        for chunk, other in zip(batch.column(0).to_pylist(), batch.column(1)):
            h = np.frombuffer(other.as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), chunk)), pa.array(np.arange(len(h), dtype=np.int32)), pa.array(h)], names=["chunk", "at", "h"])


def _numbered(n_core: int):
    """Numbers in the places of other words; -1 for words that training does not have."""
    def run(batches):
        for batch in batches:
            tokens, found = batch.column(4), batch.column(5)
            for i in range(batch.num_rows):
                codes = np.frombuffer(tokens[i].as_buffer(), np.int32).copy()
                open_ = np.flatnonzero(codes < -1)
                if len(open_):
                    number = np.full(-2 - int(codes.min()) + 1, -1, np.int64)
                    if found[i].is_valid:
                        rank = np.asarray(found[i].values.field("rank"))
                        number[np.asarray(found[i].values.field("at"))] = rank + 2 * (rank >= n_core)
                    codes[open_] = number[-2 - codes[open_]]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, 1) for k in range(4)), *_binary(codes)], names=["chunk", "ids", "has_id", "held", "tokens"])
    return run


def _coded(texts: DataFrame, ranked: DataFrame, hashes: np.ndarray, n_core: int) -> DataFrame:
    """Texts (id, held, text) as rows of many: their ids and numbers of their words; hashes are those of the first ranks.

    A word's number is its rank, and two more from ``n_core`` on: those two are the rare words and the ends.
    """
    rank = np.arange(len(hashes))
    order = np.argsort(hashes)
    number = (rank + 2 * (rank >= n_core)).astype(np.int32)
    first = texts.mapInArrow(_code(hashes[order], number[order], n_core + 1), _CODED + ", other binary")
    rough = _packed(first, "rough", "zstd")
    found = (rough.select("chunk", "other").mapInArrow(_others, "chunk long, at int, h long")
             .join(ranked.filter(F.col("rank") >= len(hashes)).select("h", "rank"), "h")
             .groupBy("chunk").agg(F.collect_list(F.struct("at", "rank")).alias("found")))
    mine = written(texts.sparkSession)[-1:]
    done = _packed(rough.drop("other").join(found, "chunk", "left").mapInArrow(_numbered(n_core), _CODED), "coded", "zstd")
    release(texts.sparkSession, mine)
    return done


def _packed(df: DataFrame, name: str, codec: str, *by: str) -> DataFrame:
    """`kept` for rows of packed arrays."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", codec).partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# --- lists of neighbours -------------------------------------------------------------------------------------------

_LISTS = "part int, before_n binary, before binary, before_c binary, after_n binary, after binary, after_c binary, core binary"


def _small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint8 if not len(x) or x.max() < 256 else np.uint32)


def _array(cell, size: int) -> np.ndarray:
    """What `_small` has made of that many numbers."""
    buf = cell.as_buffer()
    return np.frombuffer(buf, np.uint8 if buf.size == size else np.uint32)


def _pairs(n_head: int, rare: int, beyond: int, parts: int):
    """Pairs of neighbours in training, summed over a task's texts: a row for each part and side (0 after the word, 1 before it, 2 both of the core)."""
    def summed(rows):
        # keys: the first word above the second
        key, n = np.unique(np.concatenate(rows), return_counts=True)
        a, b = key >> 32, key & 0xFFFFFFFF
        for side, w, x in ((0, a, b), (1, b, a), (2, a, b)):
            mine = (a < n_head) & (b < n_head) if side == 2 else w >= n_head
            at = w[mine] if side == 2 else w[mine] - n_head
            order = np.lexsort((x[mine], at, at % parts)) if side else np.argsort((at % parts), kind="stable")
            word, near, c, part = at[order] // (1 if side == 2 else parts), x[mine][order], n[mine][order], (at % parts)[order]
            cut = np.searchsorted(part, np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(cut)):
                s = slice(cut[p], cut[p + 1])
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([side], pa.int32()), *_binary(word[s].astype(np.uint32), near[s].astype(np.uint32), c[s].astype(np.uint32))],
                                                 names=["part", "side", "word", "near", "c"])

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for held, tokens in zip(batch.column(0), batch.column(1)):
                codes = np.frombuffer(tokens.as_buffer(), np.int32).astype(np.int64)
                codes[(codes < 0) | (codes >= beyond)] = rare
                before = np.concatenate([[rare + 1], codes[:-1]])
                stops = np.flatnonzero(codes == rare + 1)
                used = np.repeat(~np.frombuffer(held.as_buffer(), bool), np.diff(np.concatenate([[-1], stops])))
                rows.append((before << 32 | codes)[used])
                size += len(rows[-1])
                if size > TOKENS:
                    yield from summed(rows)
                    rows, size = [], 0
        if size:
            yield from summed(rows)
    return T.lean(run)


def _lists(parts: int, beyond: int, n_head: int):
    """All pairs of a part as lists of its words' neighbours, in order of their numbers."""
    schema = pa.schema([("part", pa.int32()), *((x, pa.binary()) for x in ("before_n", "before", "before_c", "after_n", "after", "after_c", "core"))])

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        n_words = max(0, -(-(beyond - n_head - part) // parts))
        side = np.asarray(table.column("side"))
        sums = []
        for s in (0, 1, 2):
            own = table.filter(pa.array(side == s))
            word, near, c = (np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in own.column(k)] or [np.empty(0, np.uint32)]).astype(np.int64) for k in ("word", "near", "c"))
            key = word << 32 | near
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
            sums.append((key[first] >> 32, key[first] & 0xFFFFFFFF, np.add.reduceat(c[order], first) if len(first) else c))
        cells = [pa.array([part], pa.int32())]
        for word, near, c in (sums[1], sums[0]):
            cells += _binary(np.bincount(word, minlength=n_words).astype(np.uint32), near.astype(np.uint32), _small(c))
        return pa.Table.from_arrays([*cells, *_binary(np.stack(sums[2]).astype(np.int64))], schema=schema)
    return run


class Part:
    """A part of the words: their numbers, and the words before and after each with counts, row by row."""

    def __init__(self, batch: pa.RecordBatch, i: int, n_head: int, parts: int):
        cell = lambda k: batch.column(batch.schema.get_field_index(k))[i]
        self.part = cell("part").as_py()
        self.sides = []
        for k in ("before", "after"):
            n = np.frombuffer(cell(f"{k}_n").as_buffer(), np.uint32)
            near = np.frombuffer(cell(k).as_buffer(), np.uint32)
            self.sides.append((np.concatenate([[0], np.cumsum(n, dtype=np.int64)]), near, _array(cell(f"{k}_c"), len(near))))
        self.number = n_head + self.part + parts * np.arange(len(n), dtype=np.int64)

    def rows(self, side: int, words: np.ndarray):
        """For each neighbour of these words on a side: the word's place among them, the neighbour, and the count."""
        at, near, c = self.sides[side]
        n = at[words + 1] - at[words]
        whole = len(words) and words[-1] - words[0] == len(words) - 1
        pick = slice(at[words[0]], at[words[-1] + 1]) if whole else T.spread(at[words], at[words + 1])
        return np.repeat(np.arange(len(words)), n), near[pick], c[pick]

    def classes(self, words: np.ndarray, code: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts of the classes before and after each of these words, itself left out, and how often it follows itself."""
        out, own = [], np.zeros(len(words))
        for side in (0, 1):
            row, near, c = self.rows(side, words)
            same = near == self.number[words][row]
            own[row[same]] = c[same]
            out.append(np.bincount(row * total + code[near], weights=np.where(same, 0, c), minlength=len(words) * total).reshape(len(words), total))
        return out[0], out[1], own


# --- exchange ------------------------------------------------------------------------------------------------------

def _xlogx(x):
    return x * np.log(np.maximum(x, 1))


def _likelihood(table: np.ndarray) -> float:
    return float(_xlogx(table).sum() - _xlogx(table.sum(0)).sum() - _xlogx(table.sum(1)).sum())


def _least(n: float) -> float:
    """What a move must gain in n bigrams: more than rounding can."""
    return 1e-9 + 1e-14 * float(_xlogx(np.float64(n)))

def exchange(n: np.ndarray, fixed: np.ndarray, classes: int, start: np.ndarray | None = None) -> np.ndarray:
    """Classes of words by the exchange algorithm on a bigram table n (words x words).

    fixed: class of each word that may not move, else -1. Words start by frequency rank or in the classes ``start``; a
    pass offers every word, in order of frequency, each class in turn at the class-bigram likelihood sum n(c,d) ln n(c,d)
    - 2 sum n(c) ln n(c). Passes end when one moves no word.
    """
    n = n.astype(float)
    least = _least(n.sum())
    words = len(n)
    of = np.where(fixed >= 0, fixed, np.arange(words) % classes if start is None else start)
    total = max(int(of.max()) + 1, classes)
    left, right = np.zeros((words, total)), np.zeros((words, total))  # n(class, word), n(word, class)
    for c in range(total):
        left[:, c], right[:, c] = n[of == c].sum(0), n[:, of == c].sum(1)
    table = np.zeros((total, total))
    for c in range(total):
        table[c] = right[of == c].sum(0)
    outs, ins = n.sum(1), n.sum(0)
    moved = 1
    while moved:
        moved = 0
        for w in range(words):
            if fixed[w] >= 0:
                continue
            old, own = of[w], n[w, w]
            li, ri = left[w].copy(), right[w].copy()
            li[old] -= own
            ri[old] -= own
            table[:, old] -= li
            table[old, :] -= ri
            table[old, old] -= own
            rows, cols = table.sum(1) + li, table.sum(0) + ri  # of the other words: what they stand next to includes w in any class
            # joining class c adds ri to its row, li to its column, and all three at the cell where they cross
            gain = (_xlogx(table[:classes] + ri) - _xlogx(table[:classes])).sum(1) + (_xlogx(table[:, :classes].T + li) - _xlogx(table[:, :classes].T)).sum(1)
            c = np.arange(classes)
            cross = table[c, c]
            gain += _xlogx(cross + ri[c] + li[c] + own) - _xlogx(cross + ri[c]) - _xlogx(cross + li[c]) + _xlogx(cross)
            gain -= _xlogx(rows[:classes] + outs[w]) - _xlogx(rows[:classes]) + _xlogx(cols[:classes] + ins[w]) - _xlogx(cols[:classes])
            new = int(gain.argmax())
            if gain[new] <= gain[old] + least:
                new = old
            table[:, new] += li
            table[new, :] += ri
            table[new, new] += own
            if new != old:
                moved += 1
                of[w] = new
                left[:, old] -= n[w]
                left[:, new] += n[w]
                right[:, old] -= n[:, w]
                right[:, new] += n[:, w]
    return of


class _Gains:
    """What words gain by moving alone, each to any class, on one table of class bigrams."""

    def __init__(self, table: np.ndarray, classes: int):
        self.table, self.classes, self.least = table, classes, _least(table.sum())
        self.sides = (table[:, :classes], table[:classes].T.copy())  # what a class before, or after, the word has with each class
        k = np.arange(LOOKED_UP + 1)
        self.looked_up = [_xlogx(t[:, None] + k[:, None]) - _xlogx(t[:, None]) for t in self.sides]
        self.rows, self.cols = table.sum(1)[:classes], table.sum(0)[:classes]

    def best(self, before, after, own, old, count):
        """The best class of each word, given counts of the classes next to it, how often it follows itself, its class and count."""
        t, classes, f = self.table, self.classes, _xlogx
        words = np.arange(len(old))
        gain, stay = np.zeros((len(old), classes)), np.zeros(len(old))
        for x, side, diff in ((before, *self._side(0)), (after, *self._side(1))):
            row, near = np.nonzero(x)
            k = x[row, near]
            few = k <= LOOKED_UP
            for pick, more in ((few, lambda d, k: diff[d, k.astype(np.int64)]), (~few, lambda d, k: f(side[d] + k[:, None]) - f(side[d]))):
                r = row[pick]
                if len(r):
                    first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
                    gain[r[first]] += np.add.reduceat(more(near[pick], k[pick]), first, axis=0)
            far = near != old[row]
            r, d, k = row[far], near[far], k[far]
            stay += np.bincount(r, weights=f(side[d, old[r]]) - f(side[d, old[r]] - k), minlength=len(old))
        # its own bigrams with its class are not there to be joined
        here, there = before[words, old], after[words, old]
        for x, y, cells in ((before, there, t), (after, here, t.T)):
            r, c = np.nonzero((x[:, :classes] > 0) & (y > 0)[:, None])
            v, a, b = cells[c, old[r]], x[r, c], y[r]
            gain[r, c] += f(v - a + b) - f(v - a) - f(v + b) + f(v)
        r, c = np.nonzero((before[:, :classes] > 0) & (after[:, :classes] > 0) | (own > 0)[:, None])
        v, a, b, s = t[c, c], before[r, c], after[r, c], own[r]
        gain[r, c] += f(v + a + b + s) - f(v + a) - f(v + b) + f(v)
        size, which = np.unique(count, return_inverse=True)
        gain -= (f(self.rows + size[:, None]) - f(self.rows) + f(self.cols + size[:, None]) - f(self.cols))[which]
        v = t[old, old]
        stay += f(v) - f(v - here - there - own) - f(self.rows[old]) + f(self.rows[old] - count) - f(self.cols[old]) + f(self.cols[old] - count)
        gain[words, old] = stay
        new = gain.argmax(1)
        return np.where(gain[words, new] > stay + self.least, new, old)

    def _side(self, i: int):
        return self.sides[i], self.looked_up[i]


def _moves(state, table: np.ndarray, classes: int, n_head: int, parts: int):
    """For each part: the classes its words would move to, of those that are to be looked at, if not all."""
    def run(batches):
        gains, total = _Gains(table, classes), len(table)
        code, look = state.value
        for batch in batches:
            for i in range(batch.num_rows):
                part = Part(batch, i, n_head, parts)
                new = code[part.number]
                words = np.arange(len(new)) if look is None else np.flatnonzero(look[part.number])
                for low in range(0, len(words), BLOCK):
                    some = words[low: low + BLOCK]
                    before, after, own = part.classes(some, code, total)
                    old = new[some].astype(np.int64)
                    count = after.sum(1) + own
                    # words seen once with the same neighbours' classes choose alike
                    key = np.where(count == 1, (old * total + before.argmax(1)) * total + after.argmax(1), -1 - np.arange(len(old)))
                    _, first, same = np.unique(key, return_index=True, return_inverse=True)
                    new[some] = gains.best(before[first], after[first], own[first], old[first], count[first])[same]
                yield pa.RecordBatch.from_arrays([pa.array([part.part], pa.int32()), *_binary(new)], names=["part", "code"])
    return run


def _first(state, favour: np.ndarray, n_head: int, parts: int):
    """For each part: the class of each word that its neighbours in the core favour."""
    def run(batches):
        code, total = state.value[0], favour.shape[1]
        for batch in batches:
            for i in range(batch.num_rows):
                part = Part(batch, i, n_head, parts)
                new = np.zeros(len(part.number), np.uint8)
                for low in range(0, len(new), BLOCK):
                    some = np.arange(low, min(low + BLOCK, len(new)))
                    before, after, _ = part.classes(some, code, total)
                    new[some] = (before @ favour[0] + after @ favour[1])[:, : total - 2].argmax(1)
                yield pa.RecordBatch.from_arrays([pa.array([part.part], pa.int32()), *_binary(new)], names=["part", "code"])
    return T.lean(run)


def _counts(state, total: int, n_head: int, parts: int, near_too: bool):
    """Changes of the class bigrams when words beyond the core change class (from, to): cells (class, class) of words beyond the core,
    then (core word, class after it), then (core word, class before it); then, if asked for, the neighbours of words that change
    as cells of their own. Without classes to come from, all bigrams."""
    size = total * total + 2 * n_head * total

    def run(batches):
        old, new = state.value
        out, beside = np.zeros(size, np.int64), [np.empty(0, np.int64)]
        for batch in batches:
            for i in range(batch.num_rows):
                part = Part(batch, i, n_head, parts)
                words = np.arange(len(part.number)) if old is None else np.flatnonzero(old[part.number] != new[part.number])
                for low in range(0, len(words), BLOCK):
                    some = words[low: low + BLOCK]
                    for side in (0, 1):
                        row, near, c = part.rows(side, some)
                        if near_too:
                            beside = [np.unique(np.concatenate([*beside, near[near >= n_head]]))]
                        if not side:
                            # pairs of two words that change are taken from the first one's list
                            take = near < n_head
                            if old is not None:
                                take |= old[near] == new[near]
                            row, near, c = row[take], near[take], c[take]
                        own, near = part.number[some][row], near.astype(np.int64)
                        for code, sign in ((new, 1), (old, -1)):
                            if code is not None:
                                mine, yours = code[own].astype(np.int64), code[near].astype(np.int64)
                                inner = mine * total + yours if side else yours * total + mine
                                cell = np.where(near < n_head, total * total + (near + side * n_head) * total + mine, inner)
                                out += sign * np.bincount(cell, weights=c, minlength=size).astype(np.int64)
        cell = np.flatnonzero(out)
        cell, n = np.concatenate([cell, size + beside[0]]), np.concatenate([out[cell], np.ones(len(beside[0]), np.int64)])
        if len(cell):
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n)], names=["cell", "n"])
    return run


def _soft(grid: np.ndarray, first, second, sure_first, sure_second, n, rare: int) -> None:
    """Adds bigrams of words that are of their classes with these weights, and of the rare one with the rest."""
    total = len(grid)
    for x, p in ((first, sure_first), (rare, 1 - sure_first)):
        for y, q in ((second, sure_second), (rare, 1 - sure_second)):
            grid += np.bincount(np.broadcast_to(x * total + y, n.shape), weights=n * p * q, minlength=total * total).reshape(total, total)


def _discounted(state, sure, total: int, n_head: int, parts: int):
    """Class bigrams with a discount, all but those of two core words."""
    def run(batches):
        code, grid = state.value[0], np.zeros((total, total))
        for batch in batches:
            for i in range(batch.num_rows):
                part = Part(batch, i, n_head, parts)
                mine = sure(part.number)
                for side, (at, near, c) in enumerate(part.sides):
                    own = np.repeat(np.arange(len(part.number), dtype=np.int32), np.diff(at))
                    take = np.ones(len(near), bool) if side else near < n_head
                    own, near = own[take], near[take].astype(np.int64)
                    ends = [(code[part.number[own]].astype(np.int64), mine[own]), (code[near].astype(np.int64), sure(near))]
                    (x, p), (y, q) = ends if side else ends[::-1]
                    _soft(grid, x, y, p, q, c[take].astype(float), total - 2)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total * total)), pa.array(grid.ravel())], names=["cell", "n"])
    return T.lean(run)


class _Clustering:
    """The classes of all words, and the class bigrams, while words are exchanged."""

    def __init__(self, coded: DataFrame, n_core: int, n_words: int, classes: int):
        self.spark, self.classes, self.total = coded.sparkSession, classes, classes + 2
        self.n_core, self.n_head, self.turn = n_core, n_core + 2, 0
        self.code = np.full(n_words + 2, classes, np.uint8)  # of each number; what is beyond ``n_words`` is a rare word
        self.code[n_core + 1] = classes + 1
        self.parts = GROUPS * max(1, -(-(n_words - n_core) // (GROUPS * PART)))
        pairs = coded.select("held", "tokens").mapInArrow(_pairs(self.n_head, n_core, len(self.code), self.parts), "part int, side int, word binary, near binary, c binary")
        before = set(written(self.spark))
        self.lists = _packed(pairs.groupBy("part").applyInArrow(_lists(self.parts, len(self.code), self.n_head), _LISTS), "lists", "snappy", "part")
        self.paths = [p for p in written(self.spark) if p not in before]
        self.lists = self.lists.select(*(c.split()[0] for c in _LISTS.split(", ")))
        self.core = np.zeros((self.n_head, self.n_head))
        for row in self.lists.select("part", "core").toPandas().itertuples():  # each pair of core words in one part
            word, near, c = np.frombuffer(row.core, np.int64).reshape(3, -1)
            self.core[word, near] = c
        size = self.lists.agg(F.sum(F.expr("length(before) + length(before_c) + length(after) + length(after_c)"))).first()[0]
        self.here = None
        if (size or 0) <= HERE:
            rows = [t.slice(i, 1) for t in self.lists.drop("core").toArrow().to_batches() for i in range(t.num_rows)]
            self.here = {t.column("part")[0].as_py(): t for t in rows}
        self.inner, self.after, self.before = np.zeros((self.total, self.total)), np.zeros((self.n_head, self.total)), np.zeros((self.n_head, self.total))

    def job(self, make, state, parts: np.ndarray, schema: str) -> pd.DataFrame:
        """A function over some parts, with arrays that every task gets."""
        if self.here is not None:
            done = [b.to_pandas() for b in make(SimpleNamespace(value=state))(self.here[p] for p in parts if p in self.here)]
            return pd.concat(done) if done else pd.DataFrame({x.split()[0]: [] for x in schema.split(", ")})
        sent = self.spark.sparkContext.broadcast(state)
        rows = (self.lists if len(parts) == self.parts else self.lists.filter(F.col("part").isin(parts.tolist()))).drop("core").mapInArrow(make(sent), schema)
        if schema.startswith("cell") and len(parts) > 16:
            rows = rows.groupBy("cell").agg(F.sum("n").alias("n"))  # of fewer parts the driver takes the tasks' own sums
        out = rows.toPandas()
        sent.destroy()
        return out

    def table(self, inner, after, before) -> np.ndarray:
        """Bigrams of classes, ends and rare words included."""
        of = np.eye(self.total)[self.code[: self.n_head]]
        return inner + of.T @ after + before.T @ of + of.T @ self.core @ of

    def counted(self, old, new, near_too: bool = False):
        """The three tables of counts with classes ``new``, and the neighbours of the words that have changed class."""
        parts = np.arange(self.parts) if old is None else np.unique((np.flatnonzero(old != new) - self.n_head) % self.parts)
        got = self.job(lambda sent: _counts(sent, self.total, self.n_head, self.parts, near_too), (old, new), parts, "cell long, n long")
        cell, n = got["cell"].to_numpy(np.int64), got["n"].to_numpy(float)
        size = self.inner.size + self.after.size + self.before.size
        change = np.bincount(cell[cell < size], weights=n[cell < size], minlength=size)
        i, b = self.inner.size, self.inner.size + self.before.size
        # words beyond the core that stand before a core word are in its list of words before
        after, before = change[i:b], change[b:]
        return [x + y.reshape(x.shape) for x, y in ((self.inner, change[:i]), (self.after, after), (self.before, before))], np.unique(cell[cell >= size] - size)

    def take(self, rows: pd.DataFrame, code: np.ndarray) -> np.ndarray:
        for part, cell in zip(rows["part"], rows["code"]):
            new = np.frombuffer(cell, np.uint8)
            code[self.n_head + int(part) + self.parts * np.arange(len(new))] = new
        return code

    def exchange_core(self) -> np.ndarray:
        """Moves core words one by one; returns the numbers of those that moved."""
        c, h = self.classes, self.n_head
        n = np.block([[self.core, self.after[:, :c]], [self.before[:, :c].T, self.inner[:c, :c]]])
        fixed = np.concatenate([np.full(self.n_core, -1), [c, c + 1], np.arange(c)])
        start = np.concatenate([self.code[:h], np.arange(c)]).astype(np.int64)
        if not self.core_gains():
            return np.empty(0, np.int64)
        of = exchange(n, fixed, c, start)[: self.n_core]
        moved = np.flatnonzero(of != self.code[: self.n_core])
        self.code[: self.n_core] = of
        return moved

    def core_gains(self) -> bool:
        """Whether a core word gains by moving."""
        of, words = np.eye(self.total)[self.code[: self.n_head]], np.arange(self.n_core)
        own, old = np.diag(self.core)[words], self.code[words].astype(np.int64)
        before, after = (self.before + self.core.T @ of)[words], (self.after + self.core @ of)[words]
        before[words, old] -= own
        after[words, old] -= own
        new = _Gains(self.table(self.inner, self.after, self.before), self.classes).best(before, after, own, old, after.sum(1) + own)
        return bool((new != old).any())

    def exchange_parts(self, parts: np.ndarray, look: np.ndarray | None, near_too: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Moves words of some parts at once. Numbers of those that moved, of those that still want to, and, if at most ``near_too`` moved, of their neighbours."""
        table = self.table(self.inner, self.after, self.before)
        rows = self.job(lambda sent: _moves(sent, table, self.classes, self.n_head, self.parts), (self.code, look), parts, "part int, code binary")
        wanted = self.take(rows, self.code.copy())
        movers = every = np.flatnonzero(wanted != self.code)
        beside = movers[:0]
        while len(movers):
            new = self.code.copy()
            new[movers] = wanted[movers]
            counts, beside = self.counted(self.code, new, len(movers) <= near_too)
            # one word alone cannot lower the likelihood
            if len(movers) == 1 or _likelihood(self.table(*counts)) > _likelihood(table):
                self.code, (self.inner, self.after, self.before) = new, counts
                break
            # words that change places stand in each other's way: one direction, then any half; other ones each time
            self.turn += 1
            half = movers[(wanted[movers] > self.code[movers]) == bool(self.turn & 2) if self.turn & 1 else T.mix(movers, self.turn) < np.uint64(1 << 63)]
            movers = half if 0 < len(half) < len(movers) else movers[T.mix(movers, self.turn).argsort()[: (len(movers) + 1) // 2]]
        return movers, np.setdiff1d(every, movers), beside

    def run(self) -> None:
        c, h, everyone = self.classes, self.n_head, np.arange(self.parts)
        fixed = np.concatenate([np.full(self.n_core, -1), [c, c + 1]])
        # the core by itself, as if all words beyond it were rare ones
        start, _ = self.counted(None, self.code)
        n = self.core.copy()
        n[:, h - 2] += start[1][:, c]
        n[h - 2] += start[2][:, c]
        n[h - 2, h - 2] += start[0][c, c]
        self.code[: self.n_core] = exchange(n, fixed, c)[: self.n_core]
        if len(self.code) == h:
            return
        grid = self.table(*start)
        chance = grid.sum(1, keepdims=True) * grid.sum(0, keepdims=True) / max(grid.sum(), 1)
        smooth = np.log((grid + chance + 1e-9) / (chance + 1e-9) / 2)
        favour = np.stack([smooth, smooth.T])  # before c: row of the class before; after c: row of c itself
        self.code = self.take(self.job(lambda sent: _first(sent, favour, h, self.parts), (self.code, None), everyone, "part int, code binary"), self.code.copy())
        self.inner, self.after, self.before = self.counted(None, self.code)[0]
        look = np.zeros(len(self.code), bool)
        few = (len(self.code) - h) // FEW
        while True:
            moved, many = len(self.exchange_core()), False
            for group in range(GROUPS):
                parts = everyone[group::GROUPS]
                movers, waiting, beside = self.exchange_parts(parts, None, few)
                for part in parts:
                    look[h + part:: self.parts] = False
                look[waiting], look[beside] = True, True
                moved += len(movers)
                many |= len(movers) > few
            if not moved:
                return
            while not many and look.any():
                movers, waiting, beside = self.exchange_parts(np.unique((np.flatnonzero(look) - h) % self.parts), look, few)
                look[:] = False
                look[waiting], look[beside] = True, True
                many = len(movers) > few or not len(movers)

    def discounted(self, sure) -> np.ndarray:
        """Class bigrams where words are of their classes with the weights ``sure`` of their numbers, and of the rare class with the rest."""
        got = self.job(lambda sent: _discounted(sent, sure, self.total, self.n_head, self.parts), (self.code,), np.arange(self.parts), "cell long, n double")
        grid = np.bincount(got["cell"].to_numpy(np.int64), weights=got["n"].to_numpy(float), minlength=self.total ** 2).reshape(self.total, self.total)
        first, second = np.nonzero(self.core)
        weights, code = sure(np.arange(self.n_head)), self.code[: self.n_head].astype(np.int64)
        _soft(grid, code[first], code[second], weights[first], weights[second], self.core[first, second], self.classes)
        return grid


class Counts:
    """How often training has each word, by its number: the first ones by a table, others by the places where counts change."""

    def __init__(self, counts: np.ndarray, upto: np.ndarray, n_core: int, top: int):
        self.counts, self.upto, self.n_core = counts, upto, n_core
        self.top = np.repeat(counts, np.diff(upto, prepend=0).clip(max=top))[:top]

    def __call__(self, number: np.ndarray) -> np.ndarray:
        """Of the rare words, the ends and unknown words 0."""
        rank = number - 2 * (number > self.n_core + 1)
        out = np.zeros(len(rank), np.int64)
        word = (number >= 0) & (number != self.n_core) & (number != self.n_core + 1)
        near = word & (rank < len(self.top))
        out[near] = self.top[rank[near]]
        far = word & ~near
        out[far] = self.counts[np.searchsorted(self.upto, rank[far], side="right")]
        return out


@dataclass(frozen=True)
class Model:
    """Frequent words (sorted hashes) with class and log10 P(word | class); classes of all words by number, and sums of their
    discounted counts; log10 P(class | class); counts and sizes."""

    hashes: np.ndarray
    code: np.ndarray
    emit: np.ndarray
    classes: np.ndarray
    per_class: np.ndarray
    count_of: Counts
    step: np.ndarray
    rare: int
    end: int
    end_count: int
    n: int
    v: int
    rare_n: int
    rare_v: int
    once: int
    discount: float


def _emission(code, count, rare: int, per_class: np.ndarray, discount: float, unknown: int) -> np.ndarray:
    """log10 P(word | class) of words with these classes and counts."""
    own = code != rare
    return np.where(own, np.log10(np.where(own, count - discount, 1) / np.where(own, per_class[code], 1)), np.log10((count + 1) / unknown))


def _fit(coded: DataFrame, ranked: DataFrame, top: pd.DataFrame, n_core: int, n_texts: int, vocabulary: int | None, classes: int) -> Model:
    steps = ranked.groupBy("c").agg(F.count("*").alias("n")).toPandas().sort_values("c", ascending=False)  # a row for each different count
    counts, upto = steps["c"].to_numpy(np.int64), np.cumsum(steps["n"].to_numpy(np.int64))
    count_of = Counts(counts, upto, n_core, len(top))
    v = int(upto[-1]) if len(upto) else 0
    clustered = v if vocabulary is None else min(vocabulary, v)
    words = _Clustering(coded, n_core, clustered, classes)
    words.run()
    rare, end, n_classes = classes, classes + 1, classes + 2

    own = np.diff(upto.clip(max=clustered), prepend=0)  # clustered words of each count
    once, twice = (int(own[counts == k].sum()) for k in (1, 2))
    discount = once / (once + 2 * twice + 1)
    by_rank = np.delete(words.code, [n_core, n_core + 1])
    per_class = np.zeros(n_classes)
    for low, n, c in zip(np.cumsum(own) - own, own, counts):
        per_class += (c - discount) * np.bincount(by_rank[low: low + n], minlength=n_classes)

    def sure(number):
        c = count_of(number)
        return np.where(c > 0, 1 - discount / np.maximum(c, 1), 1.0)

    grid = words.discounted(sure)
    share = (grid.sum(0) + 1) / (grid.sum() + n_classes)
    step = np.log10((grid + MASS * share) / (grid.sum(1, keepdims=True) + MASS))
    tokens = int(counts @ np.diff(upto, prepend=0))
    rare_n, rare_v = tokens - int(counts @ own), v - clustered
    hashes, order = top["h"].to_numpy(np.int64).view(np.uint64), np.argsort(top["h"].to_numpy(np.int64).view(np.uint64))
    code = np.full(len(hashes), rare, np.int32)
    code[:clustered] = by_rank[: len(hashes)]
    emit = _emission(code, top["c"].to_numpy(np.int64), rare, per_class, discount, rare_n + rare_v + once + 1)
    every = np.concatenate([words.code, np.full(v - clustered, rare, np.uint8)])
    release(coded.sparkSession, words.paths)
    return Model(hashes[order], code[order], emit[order], every, per_class, count_of, step, rare, end, n_texts, tokens + n_texts, v + (n_texts > 0), rare_n, rare_v, once, discount)


def _prepared(texts: DataFrame, words: DataFrame, core: int, counted: int):
    ranked = kept(_ranked(words), "ranked")
    top = ranked.filter(F.col("rank") < counted).toPandas().sort_values("rank")
    n_core = min(core, len(top))
    return _coded(texts, ranked, top["h"].to_numpy(np.int64).view(np.uint64), n_core), ranked, top, n_core


def fit(train: DataFrame, words: DataFrame, core: int = CORE, vocabulary: int | None = None, counted: int = COUNTED, classes: int = CLASSES) -> Model:
    """``train`` has the training texts (text), ``words`` their counts (h, c). Every word gets a class, unless ``vocabulary`` bounds them."""
    texts = train.select(F.lit(None).cast("long").alias("id"), F.lit(False).alias("held"), "text")
    coded, ranked, top, n_core = _prepared(texts, words, core, counted)
    return _fit(coded, ranked, top, n_core, train.count(), vocabulary, classes)


_ROWS = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _score(model: Model):
    """A row for each text."""
    floor = np.log10(float(model.n + model.v + 1))
    end = model.count_of.n_core + 1

    def run(batches):
        for batch in batches:
            for ids, has_id, tokens in zip(*(batch.column(k) for k in range(3))):
                number = np.frombuffer(tokens.as_buffer(), np.int32)
                stops = np.flatnonzero(number == end)
                n = np.diff(stops, prepend=-1)
                row = np.repeat(np.arange(len(stops)), n)
                count = model.count_of(number)
                code = np.where(number >= 0, model.classes[number], model.rare)
                logs = model.step[np.concatenate([[model.end], code[:-1]]), code]
                word = number != end
                logs[word] += _emission(code[word], count[word], model.rare, model.per_class, model.discount, model.rare_n + model.rare_v + model.once + 1)
                count[stops] = model.end_count
                sums = [np.bincount(row, weights=x, minlength=len(n)) for x in (count > 0, np.log10(count + 1.0), logs)]
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids.as_buffer(), np.int64), mask=~np.frombuffer(has_id.as_buffer(), bool)), pa.array(n.astype(np.int64)),
                                                  pa.array(sums[0].astype(np.int64)), pa.array(sums[1] - floor * n), pa.array(sums[2])],
                                                 names=["doc_id", "n_tokens", "n_known", "base_score", "score"])
    return T.lean(run)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", core: int = CORE, vocabulary: int | None = None, counted: int = COUNTED, classes: int = CLASSES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of every whole text."""
    tune(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("held", held_out(F.col("id")))
    train = slim.filter(~F.col("held")).select("text")
    words = kept(train.mapInArrow(_word_counts, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "words")
    coded, ranked, top, n_core = _prepared(slim, words, core, counted)
    model = _fit(coded, ranked, top, n_core, train.count(), vocabulary, classes)
    out = coded.select("ids", "has_id", "tokens").mapInArrow(_score(model), _ROWS)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score",
                      F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
