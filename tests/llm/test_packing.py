"""Packing against the tokenizer library one text at a time, and the level array against a search of all placements."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from halocline.llm import packing, text as T
from halocline.llm.frames import kept, read
from halocline.llm.queries import QUERIES
from tests.llm import brute as B

PATH = "/opt/tokenizers/word_bpe_49k.json"
ODD = [None, "", " \n\t ", "x" * 5000, "a<|endoftext|>b <|startoftext|>", "A<|ENDOFTEXT|>b x.", "É é ΟΔΟΣ İ ̈x a b c\u0085d e.", "don't 'll we've 12.5€ 日本😀 end!?",
       "One, two; THREE. f.", "KK k"]


@pytest.fixture(scope="module")
def library():
    model = Tokenizer.from_file(PATH)
    return lambda text: model.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_library(library, sf, monkeypatch):
    texts = ODD + B.documents(sf).text.tolist()
    encode = packing.Encoder(PATH)
    for known in (1 << 18, 50):
        monkeypatch.setattr(packing, "REMEMBERED", known)
        ids, n = encode(pa.array(texts))
        edges = np.concatenate([[0], np.cumsum(n)])
        for i, t in enumerate(texts):
            assert ids[edges[i]: edges[i + 1]].tolist() == library(t)


def slow_best(levels, n, size):
    """Level whose choice gives the least sum of squares, by working out every sum; ties to the fullest."""
    def squares(now):
        return sum(c * c for f, c in now.items() if 0 < f < size)
    options = []
    for level in sorted(f for f, c in levels.items() if c and 0 <= size - n - f):
        now = dict(levels)
        now[level] -= 1
        now[level + n] = now.get(level + n, 0) + 1
        options.append((squares(now), -level))
    now = dict(levels)
    now[n] = now.get(n, 0) + 1
    options.append((squares(now), 0))
    return -min(options)[1]


def test_placement_is_the_least_sum_of_squares():
    rng = np.random.default_rng(3)
    packer = packing.Packer(24)
    for i in range(600):
        n = int(rng.integers(1, 30))
        if n % 24:
            levels = {f: int(c) for f, c in enumerate(packer.level) if c}
            assert packer.best(n % 24) == slow_best(levels, n % 24, 24)
        packer.place(i, np.full(n, i))
        assert all(len(w) == c for w, c in zip(packer.open, packer.level)) and packer.level[0] == packer.level[24] == 0


@pytest.mark.parametrize("lengths", [[], [1], [24], [100], [13] * 40, [23, 23, 1, 2, 3], list(range(1, 90))])
def test_every_id_lies_in_one_piece_and_only_powers_of_two_are_short(lengths):
    packer, docs = packing.Packer(24), [np.arange(n) + 1000 * i for i, n in enumerate(lengths)]
    for i, ids in enumerate(docs):
        packer.place(i, ids)
    packer.close()
    found = {i: {} for i in range(len(docs))}
    short = []
    for window in packer.done:
        n = sum(len(ids) for _, _, ids in window)
        assert 0 < n <= 24
        if n < 24:
            short.append(n)
        for doc, start, ids in window:
            found[doc][start] = ids
    assert all(n & (n - 1) == 0 for n in short) and len(set(short)) == len(short)
    for i, ids in enumerate(docs):
        assert np.concatenate([found[i][s] for s in sorted(found[i])] or [np.empty(0)]).tolist() == ids.tolist()
        assert all(s + len(found[i][s]) in found[i] or s + len(found[i][s]) == len(ids) for s in found[i])


def check(rows, texts, library, size=2048):
    """``texts``: (doc_id, text) of each row; rows of one id may come in any order."""
    want = sorted((i is not None, i or 0, zlib.crc32(np.array(library(t) + [1], "<u4").tobytes())) for i, t in texts)
    by_doc, by_sequence = {}, {}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) > 0
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert sum(r.length for r in rows) == sum(len(library(t)) + 1 for _, t in texts)
    for some in by_sequence.values():
        some.sort(key=lambda r: r.offset)
        assert [r.offset for r in some] == np.cumsum([0] + [r.length for r in some])[:-1].tolist() and sum(r.length for r in some) <= size
    got = []
    for (doc, n), some in by_doc.items():
        if len({r.start for r in some}) == len(some):  # one document
            ids = [i for r in sorted(some, key=lambda r: r.start) for i in r.ids]
            assert len(ids) == n
            got.append((doc is not None, doc or 0, zlib.crc32(np.array(ids, "<u4").tobytes())))
    return sorted(got), want


def test_packed_documents_are_whole(spark, library, awkward, empty, clashing, sf):
    texts = [(i + 100, t) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got, want = check(packing.pack(docs, PATH).collect(), texts, library)
    assert got == want
    assert packing.pack(empty, PATH).count() == 0
    plain = [(r.doc_id, r.text) for r in awkward.collect()]
    got, want = check(packing.pack(awkward, PATH, size=64).collect(), plain, library, 64)
    assert set(got) <= set(want) and len(got) == len({i for i, _ in plain}) - 1  # the repeated id 2 aside
    assert packing.pack(clashing, PATH, size=64).drop("sequence_id").exceptAll(packing.pack(awkward, PATH, size=64).drop("sequence_id")).count() == 0
    whole = [(r.doc_id, r.text) for r in read(spark, sf, "documents").collect()]
    got, want = check(packing.pack(read(spark, sf, "documents"), PATH).collect(), whole, library)
    assert got == want


def test_long_texts_are_encoded_in_parts(spark, library, monkeypatch):
    texts = [(1, "word, " * 3000 + "y" * 700 + " end"), (2, "été " * 900), (3, None), (4, "z" * 3000)]
    monkeypatch.setattr(T, "CHUNK", 512)
    held = list(packing._encoded([pa.RecordBatch.from_arrays([pa.array([i for i, _ in texts]), pa.array([t for _, t in texts])], names=["id", "text"])], packing.Encoder(PATH), 1))
    assert [(i, x.tolist()) for i, x in held] == [(i, library(t) + [1]) for i, t in texts]


def test_query_has_no_padding_and_does_not_shuffle(spark, sf):
    pieces = kept(QUERIES["op11_packing"](spark, sf), "pieces")
    stats = packing.padding(pieces).first()
    assert stats.n_padding == 0 and stats.n_tokens == pieces.groupBy().sum("length").first()[0]
    n = len(B.documents(sf))
    assert pieces.select("doc_id").distinct().count() == n and pieces.count() < 2 * n
    assert "Exchange" not in QUERIES["op11_packing"](spark, sf)._jdf.queryExecution().executedPlan().toString()
