"""Hard negatives by Fagin's threshold algorithm: best inner products inside score windows, exact, in blocks.

Vectors become integers. A block of rows keeps one list of its rows for each dimension, sorted by that component. For an
anchor, each list is read from the end that its sign there prefers (sorted access), all lists one depth at a time; rows
met for the first time are scored in full (random access). At any depth the products of the anchor with the components
last read add up to a threshold that no row not yet met can exceed. An anchor is done with a block once the threshold is
strictly below the kth score of each of its windows, or below the window itself; strictly, as rows of equal score are
told apart by id. Depth grows by half each time.

Rows are dealt into blocks by a hash of the row, so no label or repeated vector makes one block larger. Anchors, a
stated share of all rows, meet every block in groups: a group and a block are one task's work, which returns at most k
rows for each window. Those are merged by one window function over (anchor, window), whose groups hold at most k rows of
each block. Blocks and groups have a fixed greatest size.

Inner products are taken in the narrowest arithmetic that is exact for the table's greatest component: float32 below
2**24, float64 below 2**53, Python integers beyond; a score beyond 64 bits counts as the nearest long.

Rules for odd input: rows with a NULL id, label or vector, or with a NULL or non-finite component, take no part; shorter
vectors count as 0 in the dimensions they lack; an empty vector has only scores of 0; rows that repeat an id are rows of
their own (an anchor meets the others, and rows alike in id and score are interchangeable); an anchor without another
row of its label gives no rows, as does a window that no row falls in, or an empty table; other columns are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from halocline.llm.frames import kept, tune
from halocline.session import shuffle_width

#: Most rows of a block and most anchors of a group; blocks are smaller where that gives the cluster more tasks, down to LEAST_ROWS.
ROWS, ANCHORS, LEAST_ROWS = 65536, 4096, 4096
#: Depth of the first sorted access.
FIRST = 32
#: Share of rows that are anchors, positives of an anchor, negatives of a pair, and the window in percent of the positive's score.
EVERY, POSITIVES, NEGATIVES, LOW, HIGH = 100, 5, 10, 30, 90

_ROW = "row long, vec_id long, label long, q array<long>"


def quantised(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Rows that take part: row (a number of its own), vec_id, label and q, integers floor(256 x)."""
    v = F.col(vector_col)
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull() & whole)
    return rows.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"),
                       F.transform(v, lambda x: F.floor(256 * x.cast("double"))).alias("q"))


def _matrix(lists: pa.ChunkedArray, dims: int, kind) -> np.ndarray:
    """The vectors as rows of one matrix, 0 where they are shorter."""
    lists = lists.combine_chunks()
    n = np.asarray(pa.compute.list_value_length(lists), np.int64)
    out = np.zeros((len(n), dims), kind)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    out[np.repeat(np.arange(len(n)), n), at] = np.asarray(lists.flatten(), np.int64).astype(kind)
    return out


class Lists:
    """Rows of a block with a sorted list for each dimension."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, x: np.ndarray):
        self.ids, self.rows, self.x = ids, rows, x
        self.order = np.argsort(x, axis=0, kind="stable").T.astype(np.int32)

    def best(self, q: np.ndarray, windows: list[tuple[float, float]], k: int, skip: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window (lowest and highest score, both included), the places and scores of its first k rows; ``skip`` marks rows that can't count."""
        n, seen = len(self.ids), skip.copy()
        up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        found, scores = [np.empty(0, np.int64)], [np.empty(0, self.x.dtype)]
        self.depth = 0
        while self.depth < n:
            low, self.depth = self.depth, min(n, max(FIRST, self.depth + self.depth // 2))
            fresh = np.zeros(n, bool)
            if len(up) or len(down):
                fresh[self.order[:, n - self.depth: n - low][up].reshape(-1)] = True
                fresh[self.order[:, low: self.depth][down].reshape(-1)] = True
            else:  # all products are 0
                fresh[:] = True
                self.depth = n
            fresh &= ~seen
            seen |= fresh
            new = np.flatnonzero(fresh)
            found.append(new)
            scores.append(_within_long(self.x[new] @ q))
            if self.depth < n:
                edge = self.x[self.order[up, n - self.depth], up] @ q[up] + self.x[self.order[down, self.depth - 1], down] @ q[down]
                scores = [np.concatenate(scores)]
                if all(edge < lowest or edge < _kth(scores[0], lowest, highest, k) for lowest, highest in windows):
                    break
        at, s = np.concatenate(found), np.concatenate(scores)
        out = []
        for lowest, highest in windows:
            here = np.flatnonzero((s >= lowest) & (s <= highest))
            kth = _kth(s[here], lowest, highest, k)
            here = here[s[here] >= kth]
            here = here[np.lexsort((self.rows[at[here]], self.ids[at[here]], -s[here]))[:k]]
            out.append((at[here], s[here]))
        return out


def _kth(s: np.ndarray, lowest: float, highest: float, k: int):
    """The kth highest score inside the window; below all where there are fewer."""
    s = s[(s >= lowest) & (s <= highest)]
    if len(s) < k:
        return -math.inf
    return np.sort(s)[-k] if s.dtype == object else np.partition(s, len(s) - k)[len(s) - k]


def _exact(greatest: int, dims: int):
    """The narrowest type in which inner products of such components are exact."""
    bound = greatest * greatest * max(dims, 1)
    return np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else object


def _within_long(s: np.ndarray) -> np.ndarray:
    return np.minimum(np.maximum(s, -2**63), 2**63 - 1) if s.dtype == object else s


def _columns(table: pa.Table, dims: int, kind) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return *(np.asarray(table.column(c), np.int64) for c in ("row", "vec_id", "label")), _matrix(table.column("q"), dims, kind)


def _positives(dims: int, kind, k: int):
    """First k rows of the anchor's label in a block."""

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        row, ids, label, x = _columns(rows, dims, kind)
        a_row, _, a_label, a_q = _columns(anchors, dims, kind)
        out = []
        for one in np.unique(a_label):
            same = np.flatnonzero(label == one)
            if not len(same):
                continue
            lists = Lists(ids[same], row[same], x[same])
            for a in np.flatnonzero(a_label == one):
                (at, s), = lists.best(a_q[a], [(-math.inf, math.inf)], k, lists.rows == a_row[a])
                out += zip([int(a_row[a])] * len(at), lists.rows[at].tolist(), lists.ids[at].tolist(), s.astype(np.int64).tolist())
        return pa.table({n: pa.array([r[i] for r in out], pa.int64()) for i, n in enumerate(["anchor", "row", "vec_id", "score"])})

    return run


def _negatives(dims: int, kind, k: int, low: int, high: int):
    """First k rows of other labels in a block inside the window of each positive."""

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        row, ids, label, x = _columns(rows, dims, kind)
        a_row, _, a_label, a_q = _columns(anchors, dims, kind)
        positive = anchors.column("positive_scores").to_pylist()
        lists, out = Lists(ids, row, x), []
        for a in range(len(a_row)):
            windows = [(-(-low * p // 100), high * p // 100) for p in positive[a]]
            for i, (at, s) in enumerate(lists.best(a_q[a], windows, k, label == a_label[a])):
                out += zip([int(a_row[a])] * len(at), [i + 1] * len(at), row[at].tolist(), ids[at].tolist(), s.astype(np.int64).tolist())
        return pa.table({n: pa.array([r[i] for r in out], pa.int64()) for i, n in enumerate(["anchor", "place", "row", "vec_id", "score"])})

    return run


def _first(found: DataFrame, by: list[str], k: int, name: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn(name, F.row_number().over(order)).filter(F.col(name) <= k)


def mine(rows: DataFrame, anchor=None, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for rows made by ``quantised``.

    ``anchor`` is a condition on the rows (by default one id in EVERY). Each anchor's first ``positives`` rows of its label
    are paired with the first ``negatives`` rows of other labels whose score is from ``low`` to ``high`` percent of theirs.
    """
    spark = tune(rows.sparkSession)
    rows = kept(rows, "vectors")
    anchors = kept(rows.filter(F.col("vec_id") % EVERY == 0 if anchor is None else anchor), "anchors")
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("q")).alias("dims"), F.max(F.array_max(F.transform("q", lambda x: F.greatest(F.abs(F.greatest(x, F.lit(1 - 2**63))), F.lit(0))))).alias("most")).first()
    n, dims = size["n"], size["dims"] or 0
    kind = _exact(size["most"] or 0, dims)
    blocks = max(math.ceil(n / ROWS), min(shuffle_width(spark), math.ceil(n / LEAST_ROWS)), 1)
    groups = max(1, math.ceil(anchors.count() / ANCHORS))
    dealt = rows.withColumns({"b": F.pmod(F.xxhash64("row"), F.lit(blocks)), "g": F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))}).groupBy("g", "b")

    def met(some: DataFrame):
        return some.withColumns({"g": F.pmod(F.xxhash64("row", F.lit(1)), F.lit(groups)).cast("int"), "b": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))}).groupBy("g", "b")

    near = dealt.cogroup(met(anchors)).applyInArrow(_positives(dims, kind, positives), "anchor long, row long, vec_id long, score long")
    pairs = kept(_first(near, ["anchor"], positives, "place").select("anchor", "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    scores = pairs.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "positive_score"))).alias("p"))
    asked = kept(anchors.join(scores, anchors["row"] == scores["anchor"]).select("row", "vec_id", "label", "q", F.col("p.positive_score").alias("positive_scores")), "asked")
    far = dealt.cogroup(met(asked)).applyInArrow(_negatives(dims, kind, negatives, low, high), "anchor long, place long, row long, vec_id long, score long")
    best = _first(far, ["anchor", "place"], negatives, "rank").select("anchor", "place", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    ids = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return best.join(pairs, ["anchor", "place"]).join(ids, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
