"""Benchmark decontamination by a prefix-filtered set join.

A window is a run of an item's words (``size`` of them, or the whole item if it is shorter); a document holds
the window if its words occur there in a row. The join works on shingles of up to ``SHINGLE`` words:

1. shingles of all windows are counted in all documents (their rarity there);
2. a window's shingles are ordered by rarity. Containment asks for all of them, so the necessary prefix is one
   token long: the rarest. Only documents' shingles that are some window's prefix token become candidates;
3. candidates join windows on the token. Length and position bounds (the window must fit into the document around
   that place) come before the exact comparison of all words.

Documents are compared through a fixed-size bit filter, so no task holds the benchmark and a larger benchmark
only raises the number of candidates that the join drops. Candidates are a shuffled join, which adaptive
execution splits where one token has very many.

Rules for odd input: a NULL or empty text has no words and no hits; an item without words has no windows; a NULL
item_id does not count among items, though its windows mark words; repeated rows of documents give one result
row each; windows that occur in several items are joined once; columns beyond id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from halocline.llm import text as T
from halocline.llm.frames import kept, same_key, tune

WINDOW = 10
SHINGLE = 3
#: Bits of the filter that tasks carry: 2 MB, whatever the size of the benchmark.
BITS = 24

_WINDOWS = "item string, start int, n int, words string, tokens array<long>"
_PLACES = "id long, key long, n_words long, at int, left int, context string, token long"
KEYS = ["id", "key"]


def _shingles(words: T.Words, n: int):
    """Word numbers at which a shingle of n words begins, and its hash as a signed number."""
    here, h = T.tuples(words, n)
    return here, T.signed(h)


def _windows_of(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.pieces(batch, "text", T.CHUNK // 8):
                words = T.Words(part.column(part.schema.get_field_index("text")), T.ALNUM, lower=True)
                items = part.column(part.schema.get_field_index("item"))
                count = words.counts
                length = np.minimum(count, size)
                rows = np.repeat(np.arange(len(count)), np.where(count > 0, count - length + 1, 0))
                first = T.spread(words.first[:-1], words.first[:-1] + np.where(count > 0, count - length + 1, 0))
                n = length[rows]
                width = np.minimum(n, SHINGLE)
                table = np.zeros((SHINGLE + 1, len(words)), np.int64)
                for k in range(1, SHINGLE + 1):
                    here, h = _shingles(words, k)
                    table[k, here] = h
                tokens = table[np.repeat(width, n - width + 1), T.spread(first, first + n - width + 1)]
                ends = np.concatenate([[0], np.cumsum(n - width + 1)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [items.take(pa.array(rows)).cast(pa.string()), pa.array((first - words.first[rows]).astype(np.int32)), pa.array(n.astype(np.int32)),
                     words.joined(first, first + n).cast(pa.string()), pa.ListArray.from_arrays(pa.array(ends), pa.array(tokens))],
                    names=["item", "start", "n", "words", "tokens"])
    return run


def windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """Every window of every item: item, start, n, words (one blank between) and tokens (its shingles in order)."""
    return (benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(T.lean(_windows_of(size)), _WINDOWS))


def _bitmap(tokens: DataFrame) -> np.ndarray:
    """The bits of a column of tokens, brought to the driver: 2**BITS bits at most."""
    h = F.shiftrightunsigned("token", 64 - BITS)
    words = (tokens.select(h.alias("h")).select(F.shiftright("h", 6).alias("w"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("b"))
             .groupBy("w").agg(F.bit_or("b").alias("bits")).toPandas())
    out = np.zeros(1 << (BITS - 6), np.uint64)
    out[words["w"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def _in_bitmap(bitmap: np.ndarray, token: np.ndarray) -> np.ndarray:
    h = token.view(np.uint64) >> np.uint64(64 - BITS)
    return (bitmap[(h >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63))) & np.uint64(1) == 1


def _counts_of(bitmap, widths):
    def run(batches):
        for batch in batches:
            for part in T.pieces(batch, "text"):
                words = T.Words(part.column(0), T.ALNUM, lower=True)
                for k in widths:
                    _, h = _shingles(words, k)
                    token, n = np.unique(h[_in_bitmap(bitmap, h)], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(n.astype(np.int64))], names=["token", "n"])
    return run


def _places_of(bitmap, widths, size):
    """One row for each document (at = -1, a token of its own) and one for each place of a prefix token."""
    names = ["id", "key", "n_words", "at", "left", "context", "token"]

    def run(batches):
        for batch in batches:
            for part in T.pieces(batch, "text"):
                words = T.Words(part.column(part.schema.get_field_index("text")), T.ALNUM, lower=True)
                ids, key = part.column(part.schema.get_field_index("id")), T.text_key(words)
                none = np.full(words.n_rows, -1, np.int32)
                own = T.signed(T.mix(key.view(np.uint64) ^ T.mix(np.asarray(ids.fill_null(-1), np.int64).view(np.uint64), 11), 12))
                yield pa.RecordBatch.from_arrays([ids, pa.array(key), pa.array(words.counts.astype(np.int64)), pa.array(none), pa.array(none),
                                                  pa.array([""] * words.n_rows, pa.string()), pa.array(own)], names=names)
                for k in widths:
                    here, h = _shingles(words, k)
                    hit = _in_bitmap(bitmap, h)
                    here, h = here[hit], h[hit]
                    for low in range(0, len(here), 20000):
                        p, t = here[low: low + 20000], h[low: low + 20000]
                        row = words.row[p]
                        first = np.maximum(words.first[row], p - (size - k))
                        last = np.minimum(words.first[row + 1], p + size)
                        yield pa.RecordBatch.from_arrays(
                            [ids.take(pa.array(row)), pa.array(key[row]), pa.nulls(len(p), pa.int64()), pa.array((p - words.first[row]).astype(np.int32)),
                             pa.array((p - first).astype(np.int32)), words.joined(first, last).cast(pa.string()), pa.array(t)], names=names)
    return run


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text: str = "text", size: int = WINDOW) -> DataFrame:
    """For each document: doc_id, n_words, n_hit (words inside some window's occurrence), n_items, item_ids (sorted array), contaminated."""
    spark = tune(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    wins = kept(windows(benchmark, item_col, item_text, size), "windows")
    distinct = wins.groupBy("words", "n", "tokens").agg(F.min("start").alias("_")).drop("_")
    tokens = distinct.select("words", "n", F.posexplode("tokens").alias("off", "token"))
    widths = [r[0] for r in distinct.select(F.least("n", F.lit(SHINGLE)).alias("k")).distinct().collect()]  # at most SHINGLE numbers

    # rarity of every benchmark shingle in all documents; then each window's rarest
    asked = tokens.select("token").distinct()
    bits = _bitmap(asked)
    seen = docs.select("text").mapInArrow(T.lean(_counts_of(bits, widths)), "token long, n long").groupBy("token").agg(F.sum("n").alias("rarity"))
    rarity = asked.join(seen, "token", "left")
    prefix = (tokens.join(rarity, "token").groupBy("words", "n")
              .agg(F.min(F.struct(F.coalesce("rarity", F.lit(0)).alias("rarity"), "off", "token")).alias("p"))
              .filter("p.rarity > 0").select("words", "n", "p.off", F.col("p.token").alias("token")))
    prefix = kept(prefix, "prefix")

    places = docs.mapInArrow(T.lean(_places_of(_bitmap(prefix.select("token")), widths, size)), _PLACES)
    fits = (F.col("off") <= F.col("left")) & (F.array_join(F.slice(F.split("context", " "), F.col("left") - F.col("off") + 1, F.col("n")), " ") == F.col("words"))
    found = (places.join(prefix, "token", "left").filter((F.col("at") < 0) | fits)
             .select("id", "key", "n_words", (F.col("at") - F.col("off")).alias("start"), F.when(F.col("at") >= 0, F.col("n")).alias("n"),
                     F.when(F.col("at") >= 0, F.col("words")).alias("words")))
    found = kept(found, "found")

    base = found.filter("n IS NULL").groupBy(KEYS).agg(F.max("n_words").alias("n_words"), F.count("*").alias("copies"))
    hits = found.filter("n IS NOT NULL")
    by_place = Window.partitionBy(KEYS).orderBy("start")
    spans = hits.groupBy(*KEYS, "start").agg(F.max(F.col("start") + F.col("n")).alias("end"))
    before = F.coalesce(F.max("end").over(by_place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    covered = (spans.withColumn("new", F.greatest(F.lit(0), F.col("end") - F.greatest("start", before)))
               .groupBy(KEYS).agg(F.sum("new").cast("long").alias("n_hit")))
    members = wins.filter("item IS NOT NULL").select("words", "item").distinct()
    items = (hits.select(*KEYS, "words").distinct().join(members, "words").groupBy(KEYS)
             .agg(F.sort_array(F.collect_set("item")).alias("item_ids")))
    out = base.join(covered, same_key(base, covered, *KEYS), "left").select(base["*"], "n_hit")
    out = out.join(items, same_key(out, items, *KEYS), "left").select(out["*"], "item_ids")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    item_ids = F.coalesce("item_ids", F.expr("cast(array() as array<string>)"))
    return (out.select(F.col("id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size(item_ids).cast("long").alias("n_items"),
                       item_ids.alias("item_ids"), (n_hit > 0).alias("contaminated"), F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_"))
            .drop("_"))


def digest(result: DataFrame) -> DataFrame:
    """The item list of each document as a hash of its comma-joined text."""
    return result.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated")


def clean(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Documents without any hit, with all their columns. Rows with a NULL doc_id are judged together with others of that id."""
    bad = contamination(docs, benchmark, size=size).filter("contaminated").select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_bad"]), "left_anti")
