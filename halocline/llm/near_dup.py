"""Near-duplicates by SuperMinHash, banding, verification on full sets and connected components.

A document's set is its distinct n-word shingles. SuperMinHash gives every element its own random permutation of the
signature's slots and the values 0 + r, 1 + r, 2 + r ... in that order; a slot keeps its smallest value. Ranks within
an element are tied together, which lowers the variance against independent minima, and an element can stop as soon
as no slot can still improve. Here all elements of a batch take their step j together; a document leaves the loop once
all its slots are filled, which is when later steps can't change it.

Documents with equal sets are one class (a 128-bit sum of element hashes). Only classes are banded: at BANDS bands of
ROWS slots a pair with similarity 0.8 misses all bands with probability (1 - 0.8 ** 6) ** 48 = 5e-7. Pairs are never
listed within a bucket. Instead, in each round every bucket's members are compared with one pivot of the bucket (in the
first round, in a few bands only); links found join components, and buckets whose members all are in one component are done. What is left after the rounds,
members of different components in one bucket, is compared in full: pair by pair in small buckets, and in large ones,
as those of groups that stay just below the limit, block against block inside tasks, which return links only; members
of a bucket's largest component meet the other members there, not each other's blocks. Links are confirmed on the full sets of shingle
hashes, so no link is reported that does not hold, and every bucket's components are those of all its pairs.

Rules for odd input: a NULL or empty text, or one without words, has an empty set and is linked with nothing; a text
with fewer words than a shingle has its whole sequence as one; a NULL doc_id is linked with nothing, has a NULL
component and is kept; rows that repeat a doc_id count as one document that has all those texts, and each row is
returned; columns beyond id and text are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from halocline.llm import text as T
from halocline.llm.components import components
from halocline.llm.frames import filter_words, kept, might_hold, tune

BANDS, ROWS = 48, 6
SLOTS = BANDS * ROWS
#: Buckets of more members than this are compared in blocks of BLOCK members.
SMALL, BLOCK = 8, 256
#: Bands of the first round: they join most of a large group, so that other bands have little left to compare.
FIRST = 4
#: Pivot rounds go on while more than this many pairs a class are undecided and the last round left at most half of them.
UNDECIDED = 2
#: Shingles whose permutations, and documents whose signatures, a task holds at a time; results do not depend on them.
ELEMENTS, SIGNED = 32768, 2048


def shingles(words: T.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every distinct shingle of each text, in order of row."""
    here, h = T.tuples(words, size)
    row = words.row[here]
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    if len(short):
        first = words.first[short]
        whole = np.zeros(len(short), np.uint64)
        for i in range(size - 1):
            more = words.counts[short] > i
            whole[more] = T.mix(whole[more] ^ words.hash[first[more] + i], 40)
        whole = T.mix(whole ^ words.counts[short].astype(np.uint64), 41)
        row, h = np.concatenate([row, short]), np.concatenate([h, whole])
    order = np.argsort((row.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20)))
    row, h = row[order], h[order]
    close = (row[1:] == row[:-1]) & ((h[1:] ^ h[:-1]) < np.uint64(1 << 20)) & (h[1:] != h[:-1])
    if close.any():  # different hashes with the same 44 bits: sort by all bits
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new]


def _improve(sig: np.ndarray, owner: np.ndarray, base: np.ndarray) -> None:
    """Let elements (hash ``base``) of the rows ``owner`` lower the signatures, all of them one step at a time."""
    slots, perm = sig.shape[1], None
    below = min(56, 64 - slots.bit_length())  # bits of the random rest: those above hold any step, and more for an open slot
    flat = sig.reshape(-1)
    for j in range(slots):
        if not len(base):
            return
        draw = T.mix(base, 100 + 2 * j)
        k = j + (T.mix(base, 101 + 2 * j) % np.uint64(slots - j)).astype(np.int64)
        every = np.arange(len(base))
        if perm is None:
            slot = k
        else:
            slot = perm[every, k].astype(np.int64)
            perm[every, k] = perm[:, j]
        np.minimum.at(flat, owner * slots + slot, (np.uint64(j) << np.uint64(below)) | (draw >> np.uint64(64 - below)))
        # later steps are above every slot's value once the slots were all filled up to this step
        open_ = ((sig.max(axis=1) >> np.uint64(below)) > np.uint64(j))[owner]
        if perm is None:
            perm = np.tile(np.arange(slots, dtype=np.uint16), (int(open_.sum()), 1))
            perm[np.arange(len(perm)), k[open_]] = 0  # step 0 moved slot 0 to the place of the slot it took
        elif not open_.all():
            perm = perm[open_]
        base, owner = base[open_], owner[open_]


def superminhash(row: np.ndarray, h: np.ndarray, n_rows: int, slots: int = SLOTS) -> np.ndarray:
    """Signatures (n_rows x slots, unsigned): the step in the top bits, the random rest below. Rows without elements stay at the maximum.

    Slots keep minima, so elements may come in parts: at most ELEMENTS permutations are held at a time, however large a set is.
    """
    sig = np.full((n_rows, slots), np.uint64(2**64 - 1))
    for low in range(0, len(h), ELEMENTS):
        here, who = np.unique(row[low: low + ELEMENTS], return_inverse=True)
        part = sig[here]
        _improve(part, who, h[low: low + ELEMENTS])
        sig[here] = part
    return sig


def _bands(row: np.ndarray, h: np.ndarray, n_rows: int) -> np.ndarray:
    """Band hashes (n_rows x BANDS) of sorted rows; signatures are held for at most SIGNED rows at a time."""
    out = np.empty((n_rows, BANDS), np.uint64)
    for low in range(0, n_rows, SIGNED):
        high = min(low + SIGNED, n_rows)
        a, b = np.searchsorted(row, [low, high])
        sig = superminhash(row[a:b] - low, h[a:b], high - low).reshape(high - low, BANDS, ROWS)
        band = np.repeat(np.arange(BANDS, dtype=np.uint64)[None], high - low, 0)
        for i in range(ROWS):
            band = T.mix(band ^ sig[:, :, i], 60 + i)
        out[low:high] = band
    return out


def _signatures(size: int, kind):
    def run(batches):
        for batch in batches:
            for part in T.pieces(batch, "text", T.CHUNK // 2):
                words = T.Words(part.column(part.schema.get_field_index("text")), kind, lower=True)
                row, h = shingles(words, size)
                n_rows = words.n_rows
                del words
                n = np.bincount(row, minlength=n_rows)
                edges = np.concatenate([[0], np.cumsum(n)])
                sums = []
                for salt in (50, 51):
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(T.mix(h, salt))])
                    sums.append(T.signed(T.mix(total[edges[1:]] - total[edges[:-1]], salt)))
                    del total
                band = _bands(row, h, n_rows)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, n_rows * BANDS + 1, BANDS, dtype=np.int32)), pa.array(T.signed(band.reshape(-1))))
                out = pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("id")), pa.array(n.astype(np.int64)), pa.array(sums[0]), pa.array(sums[1]), bands],
                                                 names=["id", "n", "a", "b", "bands"])
                del row, h, edges, band, bands
                yield out
    return run


def _sets(size: int, kind):
    def run(batches):
        for batch in batches:
            for part in T.pieces(batch, "text"):
                words = T.Words(part.column(part.schema.get_field_index("text")), kind, lower=True)
                row, h = shingles(words, size)
                edges = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=words.n_rows))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("id")), pa.ListArray.from_arrays(pa.array(edges), pa.array(T.signed(h)))],
                                                 names=["id", "items"])
    return run


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (u, v) whose full sets are similar enough."""
    a, b = (sets.select(F.col("id").alias(c), F.col("items").alias(f"s{c}")) for c in "uv")
    both = F.size(F.array_intersect("su", "sv"))
    return (pairs.join(a, "u").join(b, "v").withColumn("both", both)
            .filter((100 + percent) * F.col("both") >= percent * (F.size("su") + F.size("sv"))).select(pairs.columns))


def _within(percent: int):
    """Links between members (id, items) of one or two blocks of a bucket, as few as connect what links connect."""

    def run(table: pa.Table) -> pa.Table:
        ids = np.asarray(table.column("id"), np.int64)
        lists = table.column("items").combine_chunks()
        n = np.asarray(pa.compute.list_value_length(lists), np.int64)
        values, owner = np.asarray(lists.flatten(), np.int64), np.repeat(np.arange(len(ids)), n)
        _, item, times = np.unique(values, return_inverse=True, return_counts=True)
        order = np.argsort(item)
        item, owner = item[order], owner[order]
        both = np.zeros((len(ids), len(ids)), np.float32)
        step = max(1, 8_000_000 // max(len(ids), 1))  # items at once: a matrix of at most 32 MB
        for low in range(0, len(times), step):
            a, b = np.searchsorted(item, [low, low + step])
            part = np.zeros((len(ids), min(step, len(times) - low)), np.float32)
            part[owner[a:b], item[a:b] - low] = 1
            both += part @ part.T
        link = (100 + percent) * both >= percent * (n[:, None] + n[None, :]) - 1e-3
        root = np.arange(len(ids))
        out = []
        for i, j in zip(*np.nonzero(np.triu(link, 1))):
            if root[i] != root[j]:
                out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
                root[root == root[j]] = root[i]
        u, v = zip(*out) if out else ((), ())
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def _block_links(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links inside large buckets (bucket, id, root): every two blocks that have pairs to compare are one task's group.

    Blocks 0 to o - 1 hold members outside the bucket's largest component, the m blocks after them those in it.
    """
    parts = rows.groupBy("bucket", "root").agg(F.count("*").alias("c")).groupBy("bucket").agg(
        F.max_by("root", F.struct("c", "root")).alias("main"), F.max("c").alias("c"), F.sum("c").alias("s"))
    parts = parts.select("bucket", "main", F.ceil((F.col("s") - F.col("c")) / BLOCK).cast("int").alias("o"), F.ceil(F.col("c") / BLOCK).cast("int").alias("m"))
    inside = F.col("root") == F.col("main")
    own = F.pmod(F.xxhash64("id", F.lit(-1)), F.when(inside, F.col("m")).otherwise(F.col("o"))).cast("int")
    others, mains = F.sequence(F.lit(0), F.col("o") - 1), F.sequence(F.lit(0), F.col("m") - 1)

    def met(i, j):
        return F.struct(F.least(i, j).alias("a"), F.greatest(i, j).alias("b"))

    to = F.when(inside, F.transform(others, lambda i: met(i, F.col("o") + own))).otherwise(
        F.concat(F.transform(others, lambda i: met(i, own)), F.transform(mains, lambda i: met(own, F.col("o") + i))))
    spread = rows.join(parts, "bucket").select("bucket", "id", F.explode(to).alias("g")).select("bucket", "id", "g.a", "g.b")
    return (spread.join(sets, "id").groupBy("bucket", "a", "b").applyInArrow(_within(percent), "u long, v long").filter("u != v").distinct())


def _sizes_fit(a: str, b: str, percent: int):
    """Sets of these sizes can be similar enough."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _merged(rows: DataFrame, joined: DataFrame) -> DataFrame:
    """Rows whose components (column root) are joined by the links (ru, rv) between roots."""
    root = components(joined.select(F.col("ru").alias("u"), F.col("rv").alias("v"))).select(F.col("node").alias("root"), F.col("root").alias("above"))
    return rows.join(root, "root", "left").withColumn("root", F.coalesce("above", "root")).drop("above")


def links(classes: DataFrame, sets_of, percent: int) -> DataFrame:
    """Links (u, v) between classes (id, n, bands) that connect all classes whose sets are similar enough.

    ``sets_of`` takes a table of ids and returns their full sets (id, items).
    """
    spark = classes.sparkSession
    exploded = classes.select("id", "n", F.posexplode("bands").alias("band", "h")).select("id", "n", "band", F.xxhash64("band", "h").alias("bucket"))
    shared = exploded.groupBy("bucket").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high").select("bucket")
    buckets = kept(exploded.join(shared, "bucket"), "buckets")
    members = kept(buckets.select("id").distinct(), "members")
    n = members.count()
    none = spark.createDataFrame([], "u long, v long")
    if not n:
        return none
    sets = kept(sets_of(members), "sets")
    found, tried, before, turn = none, none, None, 0
    rows = buckets.withColumn("root", F.col("id"))
    while True:
        inside = rows.groupBy("bucket", "root").agg(F.count("*").alias("c"))
        pending = kept(inside.groupBy("bucket").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q")).filter("s * s > q"), "pending")
        left = pending.agg(F.sum((F.col("s") * F.col("s") - F.col("q")) / 2)).first()[0] or 0
        if not left:
            return found
        rows = rows.join(pending.select("bucket"), "bucket")
        last = left <= UNDECIDED * n or (before is not None and 2 * left > before)
        if last:
            large = rows.join(pending.filter(F.col("s") > SMALL).select("bucket"), "bucket")
            found = found.unionByName(kept(_block_links(large, sets, percent), "links"))
            rows = rows.join(pending.filter(F.col("s") <= SMALL).select("bucket"), "bucket")
            other = rows.select("bucket", F.col("id").alias("v"), F.col("n").alias("m"), F.col("root").alias("root2"))
            pairs = rows.withColumnRenamed("id", "u").join(other, "bucket").filter("u < v AND root != root2").withColumns({"ru": F.col("root"), "rv": F.col("root2")})
        else:  # each bucket's pivot: another member by another order in every round
            some = rows.filter(F.col("band") < FIRST) if turn == 0 else rows
            order = F.xxhash64("id", F.lit(turn))
            least = some.groupBy("bucket").agg(F.min(order).alias("o"))
            pivot = some.withColumn("o", order).join(least, ["bucket", "o"]).select("bucket", F.col("id").alias("p"), F.col("n").alias("m"), F.col("root").alias("root2"))
            pairs = some.join(pivot, "bucket").filter("id != p AND root != root2").withColumns(
                {"u": F.least("id", "p"), "v": F.greatest("id", "p"), "ru": F.col("root"), "rv": F.col("root2")})
        pairs = kept(pairs.filter(_sizes_fit("n", "m", percent)).select("u", "v", "ru", "rv").dropDuplicates(["u", "v"]).join(tried, ["u", "v"], "left_anti"), "pairs")
        new = kept(_linked(pairs, sets, percent), "links")
        found = found.unionByName(new.select("u", "v"))
        if last:
            return found
        tried = tried.unionByName(pairs.select("u", "v"))
        rows = kept(_merged(rows, new), "rooted")
        before, turn = left if turn else None, turn + 1  # the first round looks at a few bands only


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, kind=T.SOLID) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links) and kept (doc_id is the component's) of each row."""
    tune(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = kept(slim.mapInArrow(T.lean(_signatures(size, kind)), "id long, n long, a long, b long, bands array<long>"), "signatures")
    classes = kept(signed.filter("n > 0 AND id IS NOT NULL").groupBy("a", "b", "n").agg(F.min("id").alias("class"), F.max("id").alias("high"), F.first("bands").alias("bands")), "classes")

    def sets_of(ids: DataFrame) -> DataFrame:
        texts = might_hold(slim.filter("id IS NOT NULL"), "id", filter_words(ids, "id"))
        return texts.mapInArrow(T.lean(_sets(size, kind)), "id long, items array<long>").filter("size(items) > 0").join(ids, "id", "left_semi")

    edges = links(classes.select(F.col("class").alias("id"), "n", "bands"), sets_of, percent)
    rows = signed.select("id", "n", "a", "b").join(classes.select("a", "b", "n", "class"), ["a", "b", "n"], "left").withColumn("class", F.when(F.col("id").isNotNull(), F.col("class")))
    # rows of one doc_id with several texts
    again = rows.filter("id IS NOT NULL").groupBy("id").agg(F.min("class").alias("u"), F.max("class").alias("v"), F.count("*").alias("c")).filter("c > 1")
    again = again.select("id", "u", "v").filter("u IS NOT NULL")
    edges = edges.unionByName(again.select("u", "v")).unionByName(again.select("u", F.col("id").alias("v")))
    root = components(edges).withColumnRenamed("node", "class")
    out = rows.join(root, "class", "left")
    component = F.coalesce("root", "class", "id")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def clean(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near-duplicates, with all its columns: the one with the smallest doc_id."""
    drop = near_duplicates(docs, size=size, percent=percent).filter("NOT kept").select(F.col("doc_id").alias("_drop")).distinct()
    return docs.join(drop, docs["doc_id"] == drop["_drop"], "left_anti")
