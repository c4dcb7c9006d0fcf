"""Phrases whose words stand together more often than chance has it, counted over a prefix-free parsing.

Texts are cut at punctuation into pieces, and pieces into words. A place in a piece where the hash of the next OVERLAP
words hits one of PERIOD values is a trigger: there a chunk ends and the next one begins, the first reaching OVERLAP
words into the second. What triggers is content only, so a passage that returns gives the same chunks wherever it stands,
and the distinct chunks with their frequencies (the dictionary) say all about n-grams that the texts do. A chunk owns the
n-grams that begin before its overlap; with an overlap of MOST - 1 words each n-gram of up to MOST words lies inside the
chunk that owns its first word, and is counted once there, times the chunk's frequency. A chunk's overlap is told by its
words: its last OVERLAP ones are a trigger, and do not begin it. Nothing depends on where files or tasks end.

Phrases of n words are searched level by level, as every part of a frequent phrase is as frequent: an n-gram is counted
only if both its (n - 1)-grams may be frequent, which a bit filter of fixed size tells (false hits cost rows, never
results). Words and pairs are searched by 64-bit hashes, then all phrases are counted as text, so two phrases are one only
if their hashes collide inside one task. The pass that counts words and pairs also returns the runs of three words or more whose
pairs all may be frequent, each distinct run once with its frequency; they hold every longer frequent phrase and stand in
for the chunks from there on. Each row of a pair also says how often a pair that may be frequent follows it and goes
before it, in SIDES sums by the hash of the word this adds. A phrase of three words is as frequent as the sum it is part
of at most, on either side, so it is counted only if both reach the threshold. Rows are summed up in every task and again after each shuffle; a frequent word or passage is
a few rows a task.

A candidate of n words is cut after its first k words; with a, l and r the counts of the whole, the first part and the
rest, and n all words of its language, its score is floor(1000 a n / (l r)) in decimal arithmetic of 38 digits; the
lowest cut counts. A candidate inside a longer one that is as frequent is dropped: the prefix and the suffix of the next
longer candidates suffice for that, since what lies between two equal counts is equal too.

Rules for odd input: a NULL text is empty and gives nothing; a NULL lang is ``und``, one language with texts labelled so;
a language without words or candidates gives no rows; rows that repeat count each time; a NULL doc_id is a document like
others; columns beyond lang and text are not looked at. Texts beyond ``text.CHUNK`` bytes are read in parts that end at
punctuation; a longer piece without any is read whole.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from halocline.llm import text as T
from halocline.llm.frames import FILTER_BITS, filter_words, kept, tune

MOST = 5
OVERLAP = MOST - 1
#: Chunks have about this many words.
PERIOD = 32
#: Phrases as frequent as this are candidates, and so many are returned for each language.
LEAST, TOP = 100, 2000
#: Sums a pair has for the words after it, and as many for the words before it; two sums are 32 bits each of one column.
SIDES = 16
SUMS = [f"{side}{i}" for side in ("after", "before") for i in range(SIDES // 2)]
#: A sum counts up to this from each batch, and reaches the threshold if it reaches this: no sum leaves its bits.
ENOUGH = 1 << 12
#: Distinct hashes a task holds to add up their counts before it passes them on.
HELD = 1 << 20
#: Totals of up to this many languages go to the tasks as they are: a few large languages would each be one task's work in a join by language.
LANGS = 1 << 16

_BYTES = np.arange(256)
#: Fixed value: bytes that end a piece.
BREAK = np.isin(_BYTES, list(b".,;:!?\n\v\f\r"))
BLANK = np.isin(_BYTES, list(b" \t"))
WORD = ~(BREAK | BLANK)


def _triggers(words: T.Words) -> np.ndarray:
    """Whether the OVERLAP words from here (of one row) are a trigger; one entry a word."""
    here, h = T.tuples(words, OVERLAP)
    out = np.zeros(len(words), bool)
    out[here] = h % np.uint64(PERIOD) == 0
    return out


def chunks(texts: pa.Array, langs: pa.Array) -> pa.Table:
    """Distinct chunks (lang, chunk, f) of some texts; words are lower-cased and parted by one blank."""
    words = T.Words(texts, WORD, lower=True)
    if not len(words):
        return pa.table({"lang": pa.array([], pa.string()), "chunk": pa.array([], pa.large_string()), "f": pa.array([], pa.int64())})
    breaks = np.concatenate([[0], np.cumsum(BREAK[words.buf])])[words.start]
    new = np.ones(len(words), bool)
    new[1:] = (words.row[1:] != words.row[:-1]) | (breaks[1:] != breaks[:-1])
    text_of, words.row = words.row, np.cumsum(new) - 1  # from here on, pieces are the rows
    begin = np.flatnonzero(new | _triggers(words))
    end = np.append(begin[1:], len(words))
    inside = np.append(~new[begin[1:]], False)  # ends at a trigger, not with its piece
    made = pa.table({"lang": langs.take(pa.array(text_of[begin])), "chunk": words.joined(begin, end + OVERLAP * inside)})
    return made.group_by(["lang", "chunk"], use_threads=False).aggregate([([], "count_all")]).rename_columns(["lang", "chunk", "f"])


def parse(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The dictionary of all texts: distinct chunks of each language and how often they stand in the parse."""

    def run(batches):
        for batch in batches:
            langs = batch.column(batch.schema.get_field_index("lang"))
            for rows, texts, _ in T.parts(batch.column(batch.schema.get_field_index("text")), T.CHUNK, BREAK):
                yield from chunks(texts, langs.slice(rows.start, len(rows))).cast(pa.schema([("lang", pa.string()), ("chunk", pa.string()), ("f", pa.int64())])).to_batches()

    slim = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(T.lean(run), "lang string, chunk string, f long").groupBy("lang", "chunk").agg(F.sum("f").alias("f"))


class _Chunks:
    """Words of a batch of the dictionary or of runs, with the frequency of each word's row and whether the row owns n-grams that begin there."""

    def __init__(self, batch: pa.RecordBatch):
        column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        self.words = w = T.Words(column["chunk"], ~BLANK, lower=False)
        if "over" in column:
            over = np.asarray(column["over"], np.int64)
        else:
            last = w.first[1:] - OVERLAP
            over = np.zeros(w.n_rows, np.int64)
            there = np.flatnonzero(last > w.first[:-1])
            over[there] = OVERLAP * (T.tuple_hash(w, last[there], OVERLAP) % np.uint64(PERIOD) == 0)
        self.until = w.first[1:] - over
        self.own = np.arange(len(w)) < self.until[w.row]
        self.f = np.asarray(column["f"], np.int64)[w.row]
        self.lang = column["lang"].dictionary_encode()
        salt = np.array([zlib.crc32(x.encode()) + (len(x) << 32) for x in self.lang.dictionary.to_pylist()], np.uint64)
        w.hash = T.mix(w.hash ^ T.mix(salt[np.asarray(self.lang.indices)], 90)[w.row], 91)
        self._held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def side(self, at: np.ndarray) -> np.ndarray:
        """Which of the SIDES sums of a pair beside them these words are part of."""
        return (self.words.hash[at] % np.uint64(SIDES)).astype(np.int64)

    def held(self, n: int, filters: dict[int | str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """n-grams that may be frequent, owned or not: first word and hash."""
        if n not in self._held:
            w = self.words
            here = np.flatnonzero(w.row[: len(w) - n + 1] == w.row[n - 1:]) if len(w) >= n else np.empty(0, np.int64)
            if n - 1 in filters:
                known = np.zeros(len(w) + 1, bool)
                known[self.held(n - 1, filters)[0]] = True
                here = here[known[here] & known[here + 1]]
            if n == 3 and "near" in filters:
                pair = np.zeros(len(w), np.uint64)
                at, h = self.held(2, filters)
                pair[at] = h
                keep = _holds(filters["near"], _near(pair[here], self.side(here + 2)))
                here = here[keep]
                here = here[_holds(filters["near"], _near(pair[here + 1], SIDES + self.side(here)))]
            h = T.tuple_hash(w, here, n)
            if n in filters:
                keep = _holds(filters[n], h)
                here, h = here[keep], h[keep]
            self._held[n] = here, h
        return self._held[n]

    def grams(self, n: int, filters: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Owned n-grams that may be frequent: first word, hash and frequency."""
        here, h = self.held(n, filters)
        keep = self.own[here]
        return here[keep], h[keep], self.f[here[keep]]

    def langs(self, at: np.ndarray) -> pa.Array:
        return self.lang.dictionary.take(pa.array(np.asarray(self.lang.indices)[self.words.row[at]]))

    def totals(self) -> pa.RecordBatch:
        """All owned words of each lang, as n = 0."""
        owned = np.bincount(np.asarray(self.lang.indices)[self.words.row], self.f * self.own, len(self.lang.dictionary))
        return _rows(self.lang.dictionary, np.zeros(len(owned)), pa.array([""] * len(owned), pa.string()), owned)

    def phrases(self, n: int, filters: dict[int, np.ndarray]) -> tuple[pa.RecordBatch, np.ndarray]:
        """Owned n-grams that may be frequent, as text, and their hashes."""
        here, h, f = self.grams(n, filters)
        key, first, which = np.unique(h, return_index=True, return_inverse=True)
        at = here[first]
        return _rows(self.langs(at), np.full(len(at), n), self.words.joined(at, at + n), np.bincount(which, f, len(at))), key

    def pairs(self, filters: dict[int, np.ndarray]) -> pa.RecordBatch:
        """Pairs that may be frequent, as text, and the sums of owned phrases of three words that begin or end with them, if these hold two such pairs."""
        here, h = self.held(2, filters)
        key, first, which = np.unique(h, return_index=True, return_inverse=True)
        f = self.f[here] * self.own[here]
        two = np.flatnonzero(here[1:] == here[:-1] + 1)
        added = lambda at, words: np.bincount(which[at] * SIDES + self.side(words), f[two], len(key) * SIDES).reshape(-1, SIDES)
        sums = np.minimum(np.hstack([added(two, here[two] + 2), added(two + 1, here[two])]), ENOUGH).astype(np.int64)
        c = np.bincount(which, f, len(key))
        keep = (c > 0) | sums.any(axis=1)
        at = here[first[keep]]
        return _wide(_rows(self.langs(at), np.full(len(at), 2), self.words.joined(at, at + 2), c[keep]), sums[keep, ::2] | sums[keep, 1::2] << 32)

    def runs(self, filters: dict[int, np.ndarray]) -> pa.RecordBatch:
        """Longest runs of three words or more whose pairs all may be frequent, as n = -1 less the words at the end that are not owned."""
        here, _ = self.held(2, filters)
        new = np.ones(len(here) + 1, bool)
        new[1:-1] = here[1:] != here[:-1] + 1
        low, high = here[new[:-1]], here[new[1:]] + 2
        until = self.until[self.words.row[low]]
        keep = (high > low + 2) & (low < until)
        low, high, until = low[keep], high[keep], until[keep]
        return _rows(self.langs(low), np.minimum(until - high, 0) - 1, self.words.joined(low, high), self.f[low])


def _rows(lang: pa.Array, n: np.ndarray, phrase: pa.Array, c: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([lang, pa.array(n.astype(np.int32)), phrase.cast(pa.string()), pa.array(c.astype(np.int64))], names=["lang", "n", "phrase", "c"])


def _wide(rows: pa.RecordBatch, sums: np.ndarray | None = None) -> pa.RecordBatch:
    """The rows with the sums of pairs; all others have 0."""
    zero = pa.array(np.zeros(rows.num_rows, np.int64))
    added = [zero] * len(SUMS) if sums is None else [pa.array(x) for x in np.ascontiguousarray(sums.T)]
    return pa.RecordBatch.from_arrays([*rows.columns, *added], names=[*rows.schema.names, *SUMS])


def _sums(rows: pa.RecordBatch) -> np.ndarray:
    """The sums of pairs, one column each."""
    both = np.column_stack([rows.column(rows.schema.get_field_index(x)) for x in SUMS]).astype(np.int64)
    return np.stack([both & 0xFFFFFFFF, both >> 32], axis=2).reshape(len(both), 2 * len(SUMS))


def _near(pair: np.ndarray, which: np.ndarray) -> np.ndarray:
    """A hash of a pair and the number of one of its sums."""
    return T.mix(pair ^ T.mix(which, 93), 94)


def _added(h: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key, which = np.unique(h, return_inverse=True)
    return key, np.bincount(which, f, len(key)).astype(np.int64)


def _holds(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = T.mix(h, 92) >> np.uint64(64 - FILTER_BITS)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _filter(keys: DataFrame) -> np.ndarray:
    """2**FILTER_BITS bits (2 MB) of these hashes, whatever their number; only the words that are not 0 come to the driver."""
    def run(batches):
        for batch in batches:
            at = T.mix(np.asarray(batch.column(0), np.int64).view(np.uint64), 92) >> np.uint64(64 - FILTER_BITS)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array(T.signed(np.uint64(1) << (at & np.uint64(63))))], names=["w", "b"])
    bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for r in keys.select("key").mapInArrow(T.lean(run), "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toLocalIterator():
        bits[r["w"]] = r["b"]
    return bits.view(np.uint8)


def _level(dictionary: DataFrame, n: int, filters: dict[int, np.ndarray], least: int) -> DataFrame:
    """Hashes (key) of n-grams that stand at least so often."""
    below = {k: v for k, v in filters.items() if k == n - 1}

    def run(batches):
        some, size = [], 0
        for batch in batches:
            for part in T.pieces(batch, "chunk"):
                some.append(_added(*_Chunks(part).grams(n, below)[1:]))
                size += len(some[-1][0])
                if size >= HELD:
                    yield from passed(some)
                    some, size = [], 0
        if some:
            yield from passed(some)

    def passed(some):
        key, c = _added(*(np.concatenate(x) for x in zip(*some)))
        for low in range(0, len(key), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[low: low + (1 << 16)]) for x in (T.signed(key), c)], names=["key", "c"])

    return dictionary.mapInArrow(T.lean(run), "key long, c long").groupBy("key").agg(F.sum("c").alias("c")).filter(F.col("c") >= least)


def _short(dictionary: DataFrame, filters: dict[int, np.ndarray], least: int) -> DataFrame:
    """Words and pairs (lang, n, phrase, c, SUMS) that stand at least so often, all words of each lang (n = 0) and the runs (n < 0)."""
    def run(batches):
        for batch in batches:
            for part in T.pieces(batch, "chunk"):
                some = _Chunks(part)
                yield _wide(some.totals())
                yield _wide(some.phrases(1, filters)[0])
                if 2 in filters:
                    yield _wide(some.runs(filters))
                    yield some.pairs(filters)

    made = dictionary.mapInArrow(T.lean(run), ", ".join(["lang string, n int, phrase string, c long", *(f"{x} long" for x in SUMS)]))
    return made.groupBy("lang", "n", "phrase").agg(*(F.sum(x).alias(x) for x in ["c", *SUMS])).filter((F.col("n") <= 0) | (F.col("c") >= least))


def _sides(pairs: DataFrame, least: int) -> DataFrame:
    """Hashes (key) of pairs with each of their sums that reaches the threshold."""
    def run(batches):
        for batch in batches:
            for part in T.pieces(batch, "chunk"):
                h = _Chunks(part).held(2, {})[1]  # one a row
                row, which = np.nonzero(_sums(part) >= min(least, ENOUGH))
                yield pa.RecordBatch.from_arrays([pa.array(T.signed(_near(h[row], which)))], names=["key"])

    return pairs.select("lang", F.col("phrase").alias("chunk"), F.col("c").alias("f"), F.lit(0).alias("over"), *SUMS).mapInArrow(T.lean(run), "key long")


def _longer(runs: DataFrame, n: int, filters: dict[int | str, np.ndarray], least: int) -> DataFrame:
    """Phrases (lang, n, phrase, c) of n words that stand at least so often, with their hashes (key)."""
    below = {k: v for k, v in filters.items() if k == n - 1 or n == 3 and k == "near"}

    def run(batches):
        some, size = [], 0
        for batch in batches:
            for part in T.pieces(batch, "chunk"):
                rows, key = _Chunks(part).phrases(n, below)
                some.append((rows, key))
                size += len(key)
                if size >= HELD:
                    yield from passed(some)
                    some, size = [], 0
        if some:
            yield from passed(some)

    def passed(some):
        rows, key = pa.Table.from_batches([r for r, _ in some]), np.concatenate([k for _, k in some])
        key, first, which = np.unique(key, return_index=True, return_inverse=True)
        c = np.bincount(which, np.asarray(rows.column("c")), len(key)).astype(np.int64)
        rows = rows.take(pa.array(first)).set_column(3, "c", pa.array(c)).append_column("key", pa.array(T.signed(key)))
        yield from rows.to_batches(max_chunksize=1 << 16)

    made = runs.mapInArrow(T.lean(run), "lang string, n int, phrase string, c long, key long")
    return made.groupBy("lang", "n", "phrase").agg(F.sum("c").alias("c"), F.first("key").alias("key")).filter(F.col("c") >= least)


def frequent(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Phrases (lang, n, phrase, c) of one to MOST words that stand at least ``least`` times, and all words of each lang as n = 0."""
    tune(docs.sparkSession)
    dictionary = kept(parse(docs), "chunks")
    filters: dict[int | str, np.ndarray] = {}
    for n in (1, 2):
        filters[n] = _filter(kept(_level(dictionary, n, filters, least), f"grams{n}"))
        if not filters[n].any():
            break
    made = kept(_short(dictionary, filters, least), "phrases")
    counts = made.filter("n >= 0").select("lang", "n", "phrase", "c")
    if 2 in filters and filters[2].any():
        filters["near"] = _filter(_sides(made.filter("n = 2"), least))
    runs = made.filter("n < 0").select("lang", F.col("phrase").alias("chunk"), F.col("c").alias("f"), (-1 - F.col("n")).alias("over"))
    for n in range(3, MOST + 1):
        if n - 1 not in filters or not filters[n - 1].any():
            break
        longer = kept(_longer(runs, n, filters, least), f"phrases{n}")
        filters[n] = _filter(longer)
        counts = counts.union(longer.drop("key"))
    return counts


def score(a: str, n: str, l: str, r: str):
    """floor(1000 a n / (l r)), exact up to 38 digits."""
    return F.expr(f"(cast(1000 as decimal(4, 0)) * cast({a} as decimal(17, 0)) * cast({n} as decimal(17, 0))) div (cast({l} as decimal(19, 0)) * cast({r} as decimal(19, 0)))")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases."""
    counts = frequent(docs, least)
    known = counts.filter("n > 0").select("lang", "phrase", F.col("c"))
    found = counts.filter("n > 1").select("lang", "phrase", F.col("c").alias("a"), F.col("n").alias("size"), F.split("phrase", " ").alias("w"))
    cut = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cut = cut.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"),
                     F.array_join(F.slice("w", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("rest"))
    cut = cut.join(known.select("lang", F.col("phrase").alias("first"), F.col("c").alias("l")), ["lang", "first"])
    cut = cut.join(known.select("lang", F.col("phrase").alias("rest"), F.col("c").alias("r")), ["lang", "rest"])
    totals = counts.filter("n = 0").select("lang", F.col("c").alias("n"))
    cut = cut.join(F.broadcast(totals) if totals.count() <= LANGS else totals, "lang")
    best = cut.withColumn("s", score("a", "n", "l", "r")).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("s", "k", "l", "r")).alias("b"))
    shorter = lambda from_: F.array_join(F.slice("w", F.lit(from_), F.col("size") - 1), " ")
    inside = found.filter("size > 2").select("lang", F.explode(F.array(shorter(1), shorter(2))).alias("phrase"), "a").distinct()
    left = best.join(inside, ["lang", "phrase", "a"], "left_anti").select("lang", "phrase", "a", "b.l", "b.r", "n", F.col("b.s").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return left.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
