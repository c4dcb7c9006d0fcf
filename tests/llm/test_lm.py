"""Every word of the training texts has a class by exchange, wherever it is worked on, and scores are those of the model."""

import math
import zlib

import numpy as np
import pytest

from halocline.llm import lm, text as T
from tests.llm import brute as B

SIZES = {"core": 4, "classes": 5}


def texts():
    """Sixty texts in which words of a kind follow words of another, so that classes are there to be found; most words are rare."""
    rng = np.random.default_rng(11)
    out = []
    for i in range(60):
        kind, row = 0, []
        for _ in range(int(rng.integers(5, 40))):
            kind = (kind + int(rng.integers(1, 3))) % 4
            row.append(f"{'abcd'[kind]}{min(int(rng.zipf(1.4)), 60)}")
        out.append((i, " ".join(row)))
    return [*out, (None, "a1 b2 a1 a1 c1"), (5, None), (7, "unknown words here")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(texts(), "doc_id long, text string").coalesce(2)


def training():
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    return [B.solid((t or "").translate(B.LOWER)) for i, t in texts() if not held(i)]


def numbered(core):
    """Words by falling count, ties by hash, with two numbers left free after the core."""
    import pyarrow as pa
    count = {}
    for row in training():
        for w in row:
            count[w] = count.get(w, 0) + 1
    h = {w: int(T.signed(T.Words(pa.array([w]), T.SOLID, lower=True).hash)[0]) for w in count}
    order = sorted(count, key=lambda w: (-count[w], h[w]))
    return {w: r + 2 * (r >= core) for r, w in enumerate(order)}, count


def fitted(spark, docs, **sizes):
    train = docs.filter(~lm.held_out(docs.doc_id)).select("text")
    words = lm.kept(train.mapInArrow(lm._word_counts, "h long, c long").groupBy("h").agg({"c": "sum"}).withColumnRenamed("sum(c)", "c"), "w")
    return lm.fit(train, words, **(SIZES | sizes))


def bigrams(number, core):
    n = np.zeros((len(number) + 2, len(number) + 2))
    for row in training():
        line = [core + 1, *(number[w] for w in row), core + 1]
        np.add.at(n, (line[:-1], line[1:]), 1)
    return n


def likelihood(n, of):
    table = np.zeros((of.max() + 1, of.max() + 1))
    np.add.at(table, (of[:, None], of[None, :]), n)
    return lm._likelihood(table)


def test_every_word_has_a_class_that_no_move_betters(spark, docs, monkeypatch):
    monkeypatch.setattr(lm, "PART", 10)
    number, _ = numbered(SIZES["core"])
    n = bigrams(number, SIZES["core"])
    of = fitted(spark, docs).classes.astype(int)
    assert len(of) == len(number) + 2 > 100
    words = sorted(number.values())
    assert (of[words] < SIZES["classes"]).all()
    best = likelihood(n, of)
    for w in words:
        for c in range(SIZES["classes"]):
            moved = of.copy()
            moved[w] = c
            assert likelihood(n, moved) <= best + 1e-6


def test_words_that_do_not_travel_are_scored_alike(spark, docs, monkeypatch):
    monkeypatch.setattr(lm, "PART", 10)
    want = sorted(map(tuple, lm.score(docs, **SIZES).collect()), key=str)
    few = sorted(map(tuple, lm.score(docs, **SIZES, counted=6).collect()), key=str)
    monkeypatch.setattr(lm, "HERE", -1)  # by jobs instead of in the driver
    jobs = sorted(map(tuple, lm.score(docs, **SIZES).collect()), key=str)
    assert len(want) == len(texts())
    for got in (few, jobs):
        assert [r[:5] for r in got] == [r[:5] for r in want]
        assert np.array([r[5:] for r in got], float) == pytest.approx(np.array([r[5:] for r in want], float), rel=1e-9)


def test_scores_are_those_of_the_model(spark, docs):
    number, count = numbered(SIZES["core"])
    m = fitted(spark, docs)
    once, twice = (sum(c == k for c in count.values()) for k in (1, 2))
    discount = once / (once + 2 * twice + 1)
    size = {c: sum(count[w] - discount for w in number if m.classes[number[w]] == c) for c in range(SIZES["classes"])}
    assert (10 ** m.step).sum(1) == pytest.approx(np.ones(len(m.step)))
    got = {(r.doc_id, r.n_tokens): r.score for r in lm.score(docs, **SIZES).collect()}
    for i, text in texts():
        before, want, row = m.end, 0.0, B.solid((text or "").translate(B.LOWER))
        for w in row:
            c = int(m.classes[number[w]]) if w in number else m.rare
            want += m.step[before, c] + (math.log10((count[w] - discount) / size[c]) if w in number else -math.log10(once + 1))
            before = c
        assert got[i, len(row) + 1] == pytest.approx(want + m.step[before, m.end], rel=1e-9)


def test_gains_equal_brute_force():
    rng = np.random.default_rng(1)
    classes, words = 4, 20
    for t in range(20):
        n = rng.poisson(0.3, (words + 2, words + 2)) * rng.integers(1, 90 if t % 2 else 3, (words + 2, words + 2))
        n = n + n.T  # every word as often first as second
        of = np.concatenate([rng.integers(0, classes, words), [classes, classes + 1]])
        each, who, own = np.eye(classes + 2)[of], np.arange(words), np.diag(n)[:words].astype(float)
        before, after = (n.T @ each)[who], (n @ each)[who]
        before[who, of[who]] -= own
        after[who, of[who]] -= own
        table = each.T @ n @ each
        new = lm._Gains(table, classes).best(before, after, own, of[who], after.sum(1) + own)
        for w in who:
            all_ = []
            for c in range(classes):
                moved = of.copy()
                moved[w] = c
                all_.append(lm._likelihood(np.eye(classes + 2)[moved].T @ n @ np.eye(classes + 2)[moved]))
            assert all_[new[w]] == pytest.approx(max(all_), abs=1e-6)
