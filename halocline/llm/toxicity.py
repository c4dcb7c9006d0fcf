"""Toxic passages by maximum-scoring segments.

1. In a bounded sample of labelled texts (copies once), toxic and clean texts with each word or word beginning are
   counted. Their log-odds ratio is taken with an informative Dirichlet prior (the pooled rates), and features that stand out are
   kept: at most ``FEATURES``, by z-score. A word's score is that of its longest kept feature; all other words share
   the (negative) log-odds of the rest.
2. In every whole text a linear-time scan finds all maximal scoring segments of the word scores.
3. Extreme-value calibration: the best segment's score of clean sample texts gives the parameters of
   E = K n exp(-lambda S) for a text of n words. Segments with E below ``PASSAGE`` are toxic passages.
4. All segments of a text count: E of the r-th best is the expected number of segments as good, so r of them have the
   chance of a Poisson number of r or more. Each r has its share of the error (``ALONE`` for the best segment), the
   smallest quotient is the text's p-value, and if more of the clean sample than that has values below ``PASSAGE``, all
   are raised by this ratio. The p-value gives the Bayes factor bound -1 / (e p ln p) and, with the prior odds, the
   probability of being toxic.

The model (features and four numbers) has a fixed size; texts are scored in one pass without a shuffle.

Rules for odd input: a NULL or empty text has no words and gets the prior; labels that are NULL are not used; a
doc_id with several labels counts as toxic if one of them says so; without labels of both kinds there is no feature
and every text gets the prior; repeated rows are scored one by one; other columns are not looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from halocline.llm import text as T
from halocline.llm.frames import kept, tune

#: Labelled training texts of each kind, by order of a hash of the id: the only bounded sample.
SAMPLE = 15_000
FEATURES = 20_000
PREFIXES = (3, 4, 5, 6, 8)
Z = 3.0
ODDS = 3.0
PRIOR = 0.1
PASSAGE = 0.05
#: Share of the error that the best segment alone has; the r best together have (1 - ALONE) / (r (r - 1)), which adds up to 1.
ALONE = 0.9
REJECT = 0.7


@dataclass(frozen=True)
class Model:
    """Hashes of features (sorted) with their scores and lengths in characters (0: whole words), the score of all other words, E's parameters, and the factor of p-values."""

    hashes: np.ndarray
    scores: np.ndarray
    rest: float
    rate: float = 1.0
    log_k: float = 0.0
    raised: float = 1.0


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, size: int) -> DataFrame:
    """Texts of up to ``size`` training ids of each label. The joined side has at most 2 * size rows."""
    known = (labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic"))
             .filter("id IS NOT NULL AND toxic IN (0, 1)").filter(~held_out(F.col("id"))).groupBy("id").agg(F.max("toxic").alias("toxic")))
    part = [known.filter(F.col("toxic") == k).orderBy(F.xxhash64("id"), "id").limit(size) for k in (0, 1)]
    return docs.join(F.broadcast(part[0].unionByName(part[1])), "id").groupBy("text").agg(F.max("toxic").alias("toxic"), F.min("id").alias("id"))


def _word_counts(batches):
    for batch in batches:
        for part in T.pieces(batch, "text"):
            words = T.Words(part.column(part.schema.get_field_index("text")), T.ALNUM, lower=True)
            toxic = np.asarray(part.column(part.schema.get_field_index("toxic")), np.uint64)[words.row]
            _, once = np.unique(T.mix(words.hash ^ T.mix(words.row, 3)), return_index=True)  # each word once for each text
            _, first, n = np.unique(words.hash[once] * np.uint64(2) + toxic[once], return_index=True, return_counts=True)
            first = once[first]
            yield pa.RecordBatch.from_arrays([words.strings(first).cast(pa.string()), pa.array(toxic[first].astype(np.int32)), pa.array(n.astype(np.int64))],
                                             names=["word", "toxic", "n"])


def fit(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Model:
    """Learn features from the sample, then E's parameters from its clean texts."""
    texts = kept(sample(docs, labels, size), "toxic")
    words = (texts.select("text", "toxic").mapInArrow(T.lean(_word_counts), "word string, toxic int, n long").groupBy("word")
             .agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("c1"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c0")))
    words = kept(words, "toxic-words")
    n1, n0 = (float(x or 0) for x in words.agg(F.sum("c1"), F.sum("c0")).first())
    none = Model(np.empty(0, np.uint64), np.empty(0), -1.0)
    if not n1 or not n0:
        return none
    starts = [F.when(F.length("word") > k, F.struct(F.lit(k).alias("k"), F.substring("word", 1, k).alias("f"))) for k in PREFIXES]
    parts = F.array_compact(F.array(F.struct(F.lit(0).alias("k"), F.col("word").alias("f")), *starts))
    counts = words.select(F.explode(parts).alias("x"), "c1", "c0").groupBy("x.k", "x.f").agg(F.sum("c1").alias("c1"), F.sum("c0").alias("c0"))
    prior = 500.0 * (F.col("c1") + F.col("c0")) / (n1 + n0) + 0.5
    odds = [F.log((F.col(c) + prior) / (n + 500.0 - F.col(c) - prior)) for c, n in (("c1", n1), ("c0", n0))]
    scored = (counts.withColumn("score", odds[0] - odds[1]).withColumn("z", F.col("score") / F.sqrt(1 / (F.col("c1") + prior) + 1 / (F.col("c0") + prior)))
              .filter((F.col("z") >= Z) & (F.col("score") >= ODDS)).orderBy(F.desc("z"), "k", "f").limit(FEATURES))
    found = scored.select("k", "f", "score").toPandas()
    hashes = np.empty(len(found), np.uint64)
    if len(found):
        w = T.Words(pa.array(found["f"], pa.large_string()), T.ALNUM, lower=False)
        for k in found["k"].unique():
            which = (found["k"] == k).to_numpy()
            hashes[which] = T.mix(w.span_hash(w.start, w.end)[which], int(k))
    order = np.argsort(hashes)
    model = Model(hashes[order], found["score"].to_numpy(float)[order], -1.0)
    hit = (texts.select("id", "text", "toxic").mapInArrow(T.lean(_hits(model)), "toxic int, hits long, n long").groupBy("toxic")
           .agg(F.sum("hits").alias("h"), F.sum("n").alias("n")).toPandas().set_index("toxic"))
    rest = [math.log((hit.n[k] - hit.h[k] + 1) / (hit.n[k] + 1)) if k in hit.index else 0.0 for k in (0, 1)]
    model = Model(model.hashes, model.scores, min(rest[1] - rest[0], -0.01))
    clean = scan(texts.filter("toxic = 0").select("id", "text"), model)
    size_ = F.log(F.col("n_words") + 1.0)
    m = clean.filter("n_words > 0").agg(F.avg("best").alias("s"), F.avg(size_).alias("l"), F.var_pop("best").alias("vs"), F.var_pop(size_).alias("vl"),
                                        F.covar_pop("best", size_).alias("c")).first()
    if m.s is None:
        return model
    # the spread of S - ln(n) / rate is pi / (rate * sqrt 6); E's parameters follow, and the rate is 1 at most (scores are log-odds)
    a, b, c = m.vl - math.pi ** 2 / 6, -2 * m.c, m.vs
    roots = [r for r in ((-b + s * math.sqrt(max(b * b - 4 * a * c, 0))) / (2 * a) if abs(a) > 1e-9 else -c / b if b else 0 for s in (1, -1)) if r > 0]
    rate = min(1.0, 1 / min(roots)) if roots else 1.0
    model = replace(model, rate=rate, log_k=rate * m.s - m.l - 0.5772156649)
    low = scan(texts.filter("toxic = 0").select("id", "text"), model).agg(F.avg((F.col("p") < PASSAGE).cast("double"))).first()[0]
    return replace(model, raised=max(1.0, low / PASSAGE))


def _scores(words: T.Words, model: Model) -> np.ndarray:
    """Each word's score: that of its longest kept feature, else the rest's."""
    out = np.full(len(words), model.rest)
    if not len(model.hashes):
        return out
    every = np.arange(len(words))
    for which, h in (*(words.prefixes(k) for k in PREFIXES), (every, words.hash)):
        at = np.minimum(np.searchsorted(model.hashes, h), len(model.hashes) - 1)
        is_in = model.hashes[at] == h
        out[which[is_in]] = model.scores[at[is_in]]
    return out


def _hits(model: Model):
    def run(batches):
        for batch in batches:
            for part in T.pieces(batch, "text"):
                words = T.Words(part.column(part.schema.get_field_index("text")), T.ALNUM, lower=True)
                hit = np.bincount(words.row[_scores(words, model) > 0], minlength=words.n_rows)
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("toxic")), pa.array(hit.astype(np.int64)), pa.array(words.counts.astype(np.int64))],
                                                 names=["toxic", "hits", "n"])
    return run


def segments(place: np.ndarray, score: np.ndarray, rest: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, last word, score) of a text whose only positive scores stand at ``place``.

    One pass over the positive words with a stack of candidates: first word, last word, sum of all scores before it, sum
    up to its end, and the number of the nearest earlier candidate with a lower sum before it. Searches follow these
    numbers and so skip what no later word can join; where there is none, all candidates so far are final.
    """
    out: list[tuple[int, int, float]] = []
    stack: list[tuple[int, int, float, float, int]] = []
    total, done = 0.0, 0
    for p, s in zip(place.tolist(), score.tolist()):
        total += rest * (p - done)
        done = p + 1
        first, left = p, total
        total += s
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= total:
                break
            first, left = stack[j][0], stack[j][2]
            del stack[j:]
        if j < 0:
            out += [(a, b, r - l) for a, b, l, r, _ in stack]
            stack.clear()
        stack.append((first, p, left, total, j))
    return out + [(a, b, r - l) for a, b, l, r, _ in stack]


def _scan(model: Model):
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())]))

    def run(batches):
        for batch in batches:
            for part in T.pieces(batch, "text"):
                words = T.Words(part.column(part.schema.get_field_index("text")), T.ALNUM, lower=True)
                score = _scores(words, model)
                hit = np.flatnonzero(score > 0)
                cut = np.searchsorted(words.row[hit], np.arange(words.n_rows + 1))
                found = [[] for _ in range(words.n_rows)]
                for r in np.flatnonzero(np.diff(cut)):
                    w = hit[cut[r]: cut[r + 1]]
                    found[r] = segments(w - words.first[r], score[w], model.rest)
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index("id")), pa.array(words.counts.astype(np.int64)),
                     pa.array([max((s[2] for s in f), default=0.0) for f in found], pa.float64()),
                     pa.array([p_value([s[2] for s in f], n, model) for f, n in zip(found, words.counts.tolist())], pa.float64()),
                     pa.array([[{"first": a, "last": b, "score": s} for a, b, s in f] for f in found], kind)], names=["id", "n_words", "best", "p", "segments"])
    return run


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """Of each text: id, n_words, best (its highest segment score), p (p-value of all segments) and segments."""
    return docs.select("id", "text").mapInArrow(T.lean(_scan(model)), "id long, n_words long, best double, p double, segments array<struct<first:int,last:int,score:double>>")


def _expected(score: Column, n_words: Column, model: Model) -> Column:
    return F.exp(F.lit(model.log_k) + F.log(n_words + 1.0) - F.lit(model.rate) * score)


def _at_least(r: int, mean: float) -> float:
    """Log of the chance that a Poisson number with this mean, below r + 1, is r or more."""
    total, term, k = 1.0, 1.0, r
    while term > 1e-12 * total:
        k += 1
        term *= mean / k
        total += term
    return r * math.log(mean) - mean - math.lgamma(r + 1) + math.log(total)


def p_value(scores: list[float], n_words: int, model: Model) -> float:
    """The p-value of a text of so many words by the scores of all its segments."""
    base, low = model.log_k + math.log(n_words + 1.0), 0.0
    for r, s in enumerate(sorted(scores, reverse=True), 1):
        share = ALONE if r == 1 else (1 - ALONE) / (r * (r - 1))
        log_e = base - model.rate * s
        if log_e < math.log(r):  # else the chance is above a half or so
            low = min(low, _at_least(r, max(math.exp(max(log_e, -700.0)), 1e-300)) - math.log(share))
    return min(1.0, max(1e-300, math.exp(max(low, -690.0)) * model.raised))


def probability(p: Column, prior: float = PRIOR) -> Column:
    bayes = F.when(p < math.exp(-1), -1 / (math.e * p * F.log(p))).otherwise(1.0)
    odds = bayes * (prior / (1 - prior))
    return odds / (1 + odds)


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.lower(F.col(text_col).cast("string")).alias("text"))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = REJECT, size: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted and passages (first and last word, score) of every text."""
    tune(docs.sparkSession)
    slim = _slim(docs, id_col, text_col)
    model = fit(slim, labels, size)
    p = probability(F.col("p"))
    passages = F.filter("segments", lambda s: _expected(s["score"], F.col("n_words"), model) < PASSAGE)
    return (scan(slim, model).withColumn("score", p)
            .select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"),
                    passages.alias("passages")))


def clean(docs: DataFrame, labels: DataFrame, threshold: float = REJECT) -> DataFrame:
    """Documents that are not predicted toxic, with all their columns; each is judged by its own text, without a shuffle."""
    model = fit(_slim(docs, "doc_id", "text"), labels)
    passed = _passes(model, threshold)
    return docs.mapInArrow(T.lean(passed), docs.schema)


def _passes(model: Model, threshold: float):
    def run(batches):
        for batch in batches:
            for part in T.pieces(batch, "text"):
                lowered = pa.compute.utf8_lower(part.column(part.schema.get_field_index("text")))
                words = T.Words(lowered, T.ALNUM, lower=True)
                score = _scores(words, model)
                hit = np.flatnonzero(score > 0)
                cut = np.searchsorted(words.row[hit], np.arange(words.n_rows + 1))
                good = np.ones(words.n_rows, bool)
                for r in np.flatnonzero(np.diff(cut)):
                    w = hit[cut[r]: cut[r + 1]]
                    found = [s[2] for s in segments(w - words.first[r], score[w], model.rest)]
                    good[r] = _probability(p_value(found, int(words.counts[r]), model)) < threshold
                yield part.filter(pa.array(good))
    return run


def _probability(p: float, prior: float = PRIOR) -> float:
    """The same as :func:`probability` for one text."""
    odds = (-1 / (math.e * p * math.log(p)) if p < math.exp(-1) else 1.0) * prior / (1 - prior)
    return odds / (1 + odds)
