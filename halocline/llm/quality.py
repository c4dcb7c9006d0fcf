"""Quality rules by weak supervision.

Each rule reads a few counts of a text and votes good, bad or abstains. How accurate each rule is, and how common
good texts are, is learnt without labels: expectation-maximisation on the numbers of documents with each pattern of
votes. A text is kept if its posterior probability of being good reaches ``KEEP`` and the plain base rule holds.

The counts are taken in one pass; a table of them is written, patterns are counted by a group-by (at most 3 to the
number of rules rows, whatever the data), and the posterior is a join with that fixed-size pattern table. Texts that
fail the base rule are settled by it and are left out of the fit.

Rules for odd input: a NULL or empty text has no words, so it fails the base rule; repeated rows give one result row
each; an empty table gives an empty result; columns beyond id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from halocline.llm import text as T
from halocline.llm.frames import kept, tune

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_distinct", "n_bullets"]
KEEP = 0.5
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_ALPHA = T.ALNUM & ~((np.arange(256) >= 0x30) & (np.arange(256) <= 0x39)) | ((np.arange(256) >= 0x41) & (np.arange(256) <= 0x5A))
_HEAD = (np.arange(256) & 0xC0) != 0x80  # first byte of a code point


def _per_row(flag: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


def _repeats(row: np.ndarray, h: np.ndarray):
    """Whether each (row, hash) was there before, and whether it is there more than once."""
    order = np.lexsort((h, row))
    same = np.zeros(len(h), bool)
    same[1:] = (row[order][1:] == row[order][:-1]) & (h[order][1:] == h[order][:-1])
    again, many = np.zeros(len(h), bool), np.zeros(len(h), bool)
    again[order] = same
    twice = same.copy()
    twice[:-1] |= same[1:]
    many[order] = twice
    return again, many


_LINE = np.arange(256) != 0x0A


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in T.pieces(batch, "text"):
            texts = part.column(part.schema.get_field_index("text"))
            words = T.Words(texts, T.SOLID, lower=False)
            n, row = words.n_rows, words.row
            inside = np.zeros(len(words.buf) + 1, np.int8)
            inside[words.start] += 1
            np.subtract.at(inside, words.end, 1)
            inside = np.cumsum(inside[:-1]).astype(bool) if len(words.buf) else np.empty(0, bool)
            chars = _per_row(inside & _HEAD[words.buf], words.at)
            here, h = T.tuples(words, 3)
            _, many = _repeats(row[here], h)
            covered = np.zeros(len(words) + 3, bool)
            for i in range(3):
                covered[here[many] + i] = True
            repeated = np.bincount(row[covered[: len(words)]], minlength=n)
            again, _ = _repeats(row, words.hash)
            lines = T.Words(texts, _LINE, lower=False)  # runs without a line end: every line that has a word
            holds = np.searchsorted(words.start, lines.end) > np.searchsorted(words.start, lines.start)
            line_row, line_hash = lines.row[holds], lines.hash[holds]
            dup, _ = _repeats(line_row, line_hash)
            first = lines.buf[lines.start[holds]] if len(lines) else np.empty(0, np.uint8)
            out = {"n_words": words.counts, "word_chars": chars, "n_symbols": _per_row(_SYMBOL[words.buf], words.at),
                   "n_dup_lines": np.bincount(line_row[dup], minlength=n), "n_repeat_words": repeated,
                   "n_lines": np.bincount(line_row, minlength=n), "n_letters": _per_row(_ALPHA[words.buf] & _HEAD[words.buf], words.at),
                   "n_distinct": np.bincount(row[~again], minlength=n), "n_bullets": np.bincount(line_row[_SYMBOL[first]], minlength=n)}
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("id")), *(pa.array(out[c].astype(np.int64)) for c in COUNTS)],
                                             names=["doc_id", *COUNTS])


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the counts of each whole text, in one pass without a shuffle."""
    return (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(T.lean(_counts), "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)))


def _vote(bad: Column, good: Column | None = None) -> Column:
    return F.when(bad, -1).when(F.lit(False) if good is None else good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Each rule's vote: 1 good, -1 bad, 0 abstains. Faults that most texts lack anyway only vote bad."""
    c = {n: F.col(n).cast("double") for n in COUNTS}
    words, lines, chars = (F.greatest(c[n], F.lit(1.0)) for n in ("n_words", "n_lines", "word_chars"))
    size = c["word_chars"] / words
    return {
        "symbols": _vote(c["n_symbols"] / words > 0.1, c["n_symbols"] / words < 0.02),
        "letters": _vote(c["n_letters"] / chars < 0.9, c["n_letters"] / chars > 0.94),
        "word_size": _vote((size < 3) | (size > 10), size.between(4, 7)),
        "dup_lines": _vote(c["n_dup_lines"] / lines > 0.4),
        "repeats": _vote(c["n_repeat_words"] / words > 0.35),
        "variety": _vote(c["n_distinct"] / F.sqrt(words) < 3),
        "bullets": _vote(c["n_bullets"] / lines > 0.5),
    }


def fit(votes: np.ndarray, n: np.ndarray, prior: float = 0.8, accuracy: float = 0.8, steps: int = 500, tolerance: float = 1e-9):
    """Chance of good, and of each vote given good or bad, by EM over patterns of votes (rows) seen n times.

    Every rule starts with the same accuracy, and Dirichlet counts keep the class of good texts the one that rules
    vote for. ``steps`` is an error limit: not converged by then raises.
    """
    codes = np.stack([votes == v for v in (-1, 0, 1)], axis=-1).astype(float)  # pattern, rule, vote
    share = (codes * n[:, None, None]).sum(0) / max(n.sum(), 1)
    cast = 1 - share[:, 1]
    start = np.stack([np.stack([cast * accuracy, share[:, 1], cast * (1 - accuracy)], 1), np.stack([cast * (1 - accuracy), share[:, 1], cast * accuracy], 1)])
    pseudo = 10 * start + 0.1
    theta, pi = (pseudo / pseudo.sum(-1, keepdims=True)), prior
    for _ in range(steps):
        post = _posterior(codes, theta, pi)
        weight = np.stack([(1 - post) * n, post * n])
        new = np.einsum("cp,prv->crv", weight, codes) + pseudo
        new /= new.sum(-1, keepdims=True)
        share_good = (weight[1].sum() + 10 * prior) / (n.sum() + 10)
        moved = max(np.abs(new - theta).max(), abs(share_good - pi))
        theta, pi = new, share_good
        if moved < tolerance:
            return pi, theta
    raise ArithmeticError("rule accuracies did not converge")


def _posterior(codes, theta, pi):
    log = np.einsum("prv,crv->pc", codes, np.log(theta)) + np.log([1 - pi, pi])
    return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -700, 700)))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """Counts, votes, base_failed, the posterior probability ``p_good`` and kept, for each document."""
    spark = tune(docs.sparkSession)
    names = list(rules())
    seen = kept(features(docs, id_col, text_col), "quality")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    voted = seen.withColumns({f"vote_{n}": v for n, v in rules().items()}).withColumn("base_failed", failed)
    pattern = [f"vote_{n}" for n in names]
    table = voted.groupBy(pattern).agg(F.count_if(~F.col("base_failed")).alias("n")).orderBy(pattern).toPandas()  # at most 3 ** len(names) rows
    votes, n = table[pattern].to_numpy(int), table["n"].to_numpy(float)
    pi, theta = fit(votes, n)
    codes = np.stack([votes == v for v in (-1, 0, 1)], axis=-1).astype(float)
    good = spark.createDataFrame([(*map(int, v), float(p)) for v, p in zip(votes, _posterior(codes, theta, pi))],
                                 ", ".join(f"{p} int" for p in pattern) + ", p_good double")
    return (voted.join(F.broadcast(good), pattern, "left")
            .withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= keep))
            .select("doc_id", *COUNTS, *pattern, "base_failed", "p_good", "kept"))
