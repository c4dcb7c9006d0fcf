"""Phrases against counts of every n-gram, with the parsing's knobs moved."""

import re
from collections import Counter

import pyarrow as pa
import pytest

from halocline.llm import phrases, text as T
from tests.llm import brute as B


def pieces(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(B.LOWER))]


def slow(rows, least, top):
    total, count = Counter(), Counter()
    for lang, text in rows:
        for w in pieces(text):
            total[lang or "und"] += len(w)
            for n in range(1, 6):
                for i in range(len(w) - n + 1):
                    count[lang or "und", tuple(w[i: i + n])] += 1
    out = {}
    for (lang, p), a in count.items():
        if len(p) < 2 or a < least:
            continue
        longer = any(100 * b >= 100 * a and any(q[i: i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (la, q), b in count.items() if la == lang and len(q) > len(p) and b >= least)
        if not longer:
            s, _, l, r = min((1000 * a * total[lang] // (count[lang, p[:k]] * count[lang, p[k:]]), k, count[lang, p[:k]], count[lang, p[k:]]) for k in range(1, len(p)))
            out.setdefault(lang, []).append((-s, -a, " ".join(p).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for lang, some in out.items() for i, (s, a, p, l, r) in enumerate(sorted(some)[:top]))


ROWS = [("en", "the big red dog sat. the big red dog ran, the big red dog sat down! a a a a a a a a a"), ("en", "The Big Red cat\tsat;the big  red dog\n"), (None, "the big red dog sat"),
        ("und", "the big red dog sat und"), ("de", None), ("de", ""), ("fr", "é à é à é à é à. é à é à"), ("fr", "é à é à é à é à. é à é à"), ("x", "... , ;"), ("en", "b" * 4000 + " c b c b c b c")] * 2


@pytest.mark.parametrize("period, chunk, least, top", [(32, 2 << 20, 2, 2000), (1, 64, 2, 5), (2, 40, 3, 3), (10**9, 2 << 20, 1, 2000)])
def test_collocations_equal_all_counts(spark, monkeypatch, period, chunk, least, top):
    monkeypatch.setattr(phrases, "PERIOD", period)
    docs = spark.createDataFrame(ROWS, "lang string, text string").repartition(3).withColumns({c: phrases.F.lit("clash") for c in ("chunk", "f", "n", "phrase")})
    got = sorted(tuple(r) for r in phrases.collocations(docs, least, top).collect())
    assert got == slow(ROWS, least, top)


@pytest.mark.parametrize("period", [1, 3, 32])
def test_chunks_own_every_ngram_once(monkeypatch, sf, period):
    monkeypatch.setattr(phrases, "PERIOD", period)
    texts = B.documents(sf).text.tolist()[:40] + [t for _, t in ROWS]
    table = phrases.chunks(pa.array(texts), pa.array(["en"] * len(texts)))
    assert len(set(table.column("chunk").to_pylist())) == table.num_rows
    for n in (1, 3, 5):
        got = Counter()
        for batch in table.to_batches():
            some = phrases._Chunks(batch)
            here, _, f = some.grams(n, {})
            for p, c in zip(some.words.joined(here, here + n).to_pylist(), f.tolist()):
                got[p] += c
        assert got == Counter(" ".join(w[i: i + n]) for t in texts for w in pieces(t) for i in range(len(w) - n + 1))


def test_copies_share_their_chunks(spark):
    long = " ".join(f"w{i * i % 9973}" for i in range(400))
    docs = spark.createDataFrame([("en", f"{a} {long} {a}") for a in ("x", "y z", "v") * 20], "lang string, text string")
    made = phrases.parse(docs).toPandas()
    assert made.f.max() == 60 and len(made) < 40  # the inside of the passage is in the dictionary once


def test_long_texts_are_read_in_parts(monkeypatch):
    text = "one two three. " * 500 + "x" * 300 + " y, " + "é è " * 200
    for size in (64, 1 << 20):
        got = Counter()
        for _, texts, _ in T.parts(pa.array(["a, b", text, None, ""]), size, phrases.BREAK):
            for r in phrases.chunks(texts, pa.array(["en"] * len(texts))).to_pylist():
                got[r["chunk"]] += r["f"]
        assert got == (got if size == 64 else first)
        first = got


def test_scores_are_exact_beyond_64_bits(spark):
    big = [(10**13 + 7, 10**14 + 3, 3 * 10**13 + 1, 2 * 10**13 + 5), (100, 10**15, 100, 100)]
    df = spark.createDataFrame(big, "a long, n long, l long, r long")
    got = [r[0] for r in df.select(phrases.score("a", "n", "l", "r")).collect()]
    assert got == [1000 * a * n // (x * r) for a, n, x, r in big]


def test_nothing(spark, empty, awkward):
    assert phrases.collocations(empty).count() == 0
    assert sorted(tuple(r) for r in phrases.collocations(awkward, 3).collect()) == slow([(r.lang, r.text) for r in awkward.collect()], 3, 2000)


def test_levels_after_pairs_read_runs_only(spark, monkeypatch):
    """Longer phrases are counted in the distinct runs of frequent pairs, not in the whole dictionary again."""
    read, longer = [], phrases._longer

    def spy(runs, n, *more):
        read.append((n, sorted((r.chunk, r.f, r.over) for r in runs.collect())))
        return longer(runs, n, *more)

    monkeypatch.setattr(phrases, "_longer", spy)
    docs = spark.createDataFrame([("en", f"a b c d u{i}. v{i} x{i} y{i}, w{i} a b c") for i in range(6)], "lang string, text string")
    got = {(r.n, r.phrase): r.c for r in phrases.frequent(docs, 6).collect()}
    assert read == [(n, [("a b c", 6, 0), ("a b c d", 6, 0)]) for n in (3, 4, 5)]
    assert got == {(0, ""): 72, (1, "a"): 12, (1, "b"): 12, (1, "c"): 12, (1, "d"): 6, (2, "a b"): 12, (2, "b c"): 12, (2, "c d"): 6, (3, "a b c"): 12, (3, "b c d"): 6, (4, "a b c d"): 6}


def test_runs_end_where_their_chunk_owns_no_more(monkeypatch):
    """A run says how many of its last words own nothing; together the runs own each long n-gram once."""
    monkeypatch.setattr(phrases, "PERIOD", 2)
    words = [f"w{i}" for i in range(60)]
    table = phrases.chunks(pa.array([" ".join(words)]), pa.array(["en"])).combine_chunks()
    assert table.num_rows > 3
    every = phrases.np.full(1 << (phrases.FILTER_BITS - 3), 255, phrases.np.uint8)
    runs = phrases._Chunks(table.to_batches()[0]).runs({2: every})
    batch = pa.RecordBatch.from_arrays([runs["lang"], runs["phrase"], runs["c"], pa.array([-1 - n for n in runs["n"].to_pylist()])], names=["lang", "chunk", "f", "over"])
    for n in (3, 4, 5):
        assert sorted(phrases._Chunks(batch).phrases(n, {})[0]["phrase"].to_pylist()) == sorted(" ".join(words[i: i + n]) for i in range(61 - n))


def test_three_words_are_counted_where_pairs_around_them_allow(spark, monkeypatch):
    """All pairs are frequent, and only one phrase of three words is: the others make no rows."""
    made, phrases_of = [], phrases._Chunks.phrases

    def spy(self, n, filters):
        rows, key = phrases_of(self, n, filters)
        made.extend(rows["phrase"].to_pylist())
        return rows, key

    docs = spark.createDataFrame([("en", f"a b{i} c{i}. b{i} c{i} d{j}, a b{i}! c{i} d{j}; x y z") for i in range(4) for j in range(3)], "lang string, text string")
    counts = {(r.n, r.phrase): r.c for r in phrases.frequent(docs, 6).collect() if r.n > 1}
    assert counts == {(2, f"a b{i}"): 6 for i in range(4)} | {(2, f"b{i} c{i}"): 6 for i in range(4)} | {(2, "x y"): 12, (2, "y z"): 12, (3, "x y z"): 12}

    # the same rows by hand: every chunk in one batch, all pairs let through, sums as the pass over the dictionary makes them
    every = phrases.np.full(1 << (phrases.FILTER_BITS - 3), 255, phrases.np.uint8)
    table = phrases.chunks(pa.array([r.text for r in docs.collect()]), pa.array(["en"] * 12)).combine_chunks()
    some = phrases._Chunks(table.to_batches()[0])
    pairs = spark.createDataFrame(pa.Table.from_batches([some.pairs({2: every})]).to_pandas())
    near = phrases._filter(phrases._sides(pairs, 6))
    monkeypatch.setattr(phrases._Chunks, "phrases", spy)
    some.phrases(3, {2: every})
    assert len(made) == 4 + 12 + 1
    made.clear()
    phrases._Chunks(table.to_batches()[0]).phrases(3, {2: every, "near": near})
    assert made == ["x y z"]


@pytest.mark.parametrize("period", [1, 2, 32])
def test_sums_of_pairs_hold_every_phrase_of_three_words(sf, monkeypatch, period):
    """Wherever chunks end, a pair's sums add up to the phrases of three words that begin, and that end, with it."""
    monkeypatch.setattr(phrases, "PERIOD", period)
    texts = B.documents(sf).text.tolist()[:40] + [t for _, t in ROWS]
    every = phrases.np.full(1 << (phrases.FILTER_BITS - 3), 255, phrases.np.uint8)
    begin, end, seen = Counter(), Counter(), Counter()
    for batch in phrases.chunks(pa.array(texts), pa.array(["en"] * len(texts))).to_batches():
        rows = phrases._Chunks(batch).pairs({2: every})
        for p, c, sums in zip(rows["phrase"].to_pylist(), rows["c"].to_pylist(), phrases._sums(rows).tolist(), strict=True):
            seen[p] += c
            begin[p] += sum(sums[: phrases.SIDES])
            end[p] += sum(sums[phrases.SIDES:])
    threes = Counter(tuple(w[i: i + 3]) for t in texts for w in pieces(t) for i in range(len(w) - 2))
    assert seen == Counter(" ".join(w[i: i + 2]) for t in texts for w in pieces(t) for i in range(len(w) - 1))
    want = Counter(), Counter()
    for (a, b, d), c in threes.items():
        want[0][f"{a} {b}"] += c
        want[1][f"{b} {d}"] += c
    assert (+begin, +end) == want


def test_sums_that_are_large_keep_their_bits(spark):
    """A pair that stands very often in a batch, and a threshold beyond what a sum counts."""
    docs = spark.createDataFrame([("en", "a b c d. " * 6000 + "e f. g e f h")], "lang string, text string")
    for least in (5000, 6000, 6001):
        got = {(r.n, r.phrase): r.c for r in phrases.frequent(docs, least).collect() if r.n > 1}
        assert got == ({} if least > 6000 else {(n, " ".join("abcd"[i: i + n])): 6000 for n in (2, 3, 4) for i in range(5 - n)})
