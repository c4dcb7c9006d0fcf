"""Registered queries against SQL or brute force, the pipeline against stage-by-stage checks, and the shape of plans."""

import zlib

import duckdb
import pytest

import corpus_pipeline
from checks.compare import compare, connect
from halocline.llm import licenses, secrets, subwords
from halocline.llm.frames import kept, read
from halocline.llm.queries import ORACLES, QUERIES
from tests.llm import brute as B


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, name):
    got = compare(QUERIES[name](spark, sf).toPandas(), connect(sf).execute(ORACLES[name]).df())
    assert got.startswith("ok"), got


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_contracts(spark, sf):
    columns = {
        "op1": "doc_id n_words n_hit n_items items_sha256 contaminated", "op2": "doc_id held_out n_tokens n_known train_tokens base_score score",
        "op3": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "op5": "doc_id n_shingles component_id kept",
        "op6": "doc_id n_assign n_access n_hex base_sha256 spans", "op7": "doc_id held_out score predicted",
        "op8": "doc_id n_words n_base first_word last_word base_labels labels score", "op10": "doc_id size text_crc32 law shard slot grown_shard",
    }
    n = len(B.documents(sf))
    for name, fn in QUERIES.items():
        want = columns.get(name.split("_")[0])
        if want:
            df = kept(fn(spark, sf), "contract")
            assert set(want.split()) <= set(df.columns) and df.count() == n, name


def test_near_duplicates_equal_all_pairs(spark, sf):
    docs = B.documents(sf)
    got = {r.doc_id: r.component_id for r in QUERIES["op5_near_duplicates"](spark, sf).collect()}
    assert got == B.component_of(list(zip(docs.doc_id.tolist(), docs.text)), 2, 80)


def test_secrets_and_licences_equal_brute_force(spark, sf):
    docs = B.documents(sf).set_index("doc_id").text
    for r in secrets.digest(secrets.spans(read(spark, sf, "documents"))).collect():
        assert [s for s in r.spans.split(",") if s.split(":")[0] in secrets.BASE] == B.secret_spans(docs[r.doc_id])
    for r in QUERIES["op8_licenses"](spark, sf).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == B.licence_places(docs[r.doc_id], licenses.PHRASES)


def test_rollup_words_equal_sql(spark, sf):
    got = {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in QUERIES["op4_token_rollup"](spark, sf).filter("version = 'words-1'").collect()}
    rows = duckdb.sql(f"""SELECT source, lang, count(*), sum(len(regexp_extract_all(CASE WHEN poor THEN translate(text, '#*$%&|<>', '') ELSE text END, '[^\\x20\\x09-\\x0D]+')))
        FROM '{sf}/documents.parquet' LEFT JOIN (SELECT doc_id, bool_or(toxic = 1) AS bad, bool_or(quality = 0) AS poor FROM '{sf}/labels.parquet' GROUP BY 1) USING (doc_id)
        WHERE NOT coalesce(bad, false) GROUP BY 1, 2""").fetchall()
    assert got == {(s, la): (n, int(t)) for s, la, n, t in rows}


def test_rollup_moves_no_texts(spark, sf):
    """However large the tables are: with broadcasts by size off, no exchange of the counts holds a text."""
    import contextlib
    import io
    from halocline.llm import queries as Q
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        again = Q.recounts(read(spark, sf, "documents"), Q.poor(read(spark, sf, "labels")), {"words": Q.rollup.by_words})
        with contextlib.redirect_stdout(io.StringIO()) as said:
            again.explain("formatted")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    parts = said.getvalue().split("\n\n")
    moved = [p for p in parts if ") Exchange" in p]
    assert moved and not any("text" in p for p in moved)


def test_native_queries_have_no_python(spark, sf):
    for name in ("op6_secrets", "op8_licenses"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
        assert plan.count("Scan parquet") == 1, name


def test_pipeline_stage_by_stage(spark, sf):
    docs = read(spark, sf, "documents")
    model = subwords.Pieces.read("/opt/tokenizers/piece_bpe_32k.model")
    items = [(r.item_id, r.text) for r in read(spark, sf, "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = kept(stage(spark, docs, sf), name)
        if name != "pieces":
            assert out.dtypes == docs.dtypes, name
            after = {r.doc_id: r.text for r in out.collect()}
            assert set(after) <= set(before)
        if name == "toxicity":
            gone = set(before) - set(after)
            toxic = set(duckdb.sql(f"SELECT doc_id FROM '{sf}/labels.parquet' WHERE toxic = 1").df().doc_id)
            clean = set(duckdb.sql(f"SELECT doc_id FROM '{sf}/labels.parquet' WHERE toxic = 0").df().doc_id)
            assert not gone & clean and gone & toxic
        elif name == "near-duplicates":
            root = B.component_of(list(before.items()), 5, 80)
            assert set(after) == {i for i in before if root[i] == i}
        elif name == "decontamination":
            hit = {i for i, x in zip(before, B.leaks(before.values(), items)) if x[1]}
            assert set(after) == set(before) - hit
        elif name == "secrets":
            assert set(after) == set(before)
            assert all((after[i] == t) == (not B.secret_spans(t)) for i, t in before.items()) and not any(B.secret_spans(t) for t in after.values())
        else:
            rows = {r.doc_id: r.ids for r in out.collect()}
            ids, n = subwords.encode_batch(model, list(before.values()))
            assert {i: len(x) for i, x in rows.items()} == dict(zip(before, n.tolist()))
            assert zlib.crc32(ids.tobytes()) == zlib.crc32(b"".join(__import__("numpy").array(rows[i], "int32").tobytes() for i in before))
        docs = out
    from halocline.session import written
    before = written(spark)
    assert corpus_pipeline.run(spark, sf).count() == docs.count()
    assert len(written(spark)) == len(before) + 1  # only the last stage's table is left


def test_pipeline_of_no_documents(spark, sf, empty, tmp_path):
    """Every stage on an empty table, with the labels and items as they are."""
    docs = empty
    for name, stage in corpus_pipeline.STAGES:
        docs = kept(stage(spark, docs, sf), name)
        assert docs.count() == 0 and (name == "pieces" or docs.columns == empty.columns)
