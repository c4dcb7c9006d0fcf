"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from halocline.llm import decontam, licenses, lm, near_dup, negatives, packing, phrases, quality, rollup, secrets, sharding, subwords, toxicity
from halocline.llm.frames import filter_words, kept, might_hold, read
from halocline.session import scratch
from halocline.llm.registry import ORACLES, QUERIES, query

__all__ = ["ORACLES", "QUERIES"]

#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z are lower-cased, in SQL.
_SQL_WORDS = r"regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1_SQL = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS.format('text')} AS w FROM documents),
b AS (SELECT item_id, {_SQL_WORDS.format('text')} AS w FROM benchmark),
win AS (SELECT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
        FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
        FROM (SELECT d.*, ns.n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, pos.n, item_id FROM pos JOIN win USING (s, n)),
cov AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY 1),
its AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS l FROM hit WHERE item_id IS NOT NULL GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(l), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(l, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)"""


@query("op1_decontamination", OP1_SQL)
def op1(spark, sf_dir):
    return decontam.digest(decontam.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))


@query("op2_lm_scores")
def op2(spark, sf_dir):
    return lm.score(read(spark, sf_dir, "documents"))


@query("op3_quality_rules")
def op3(spark, sf_dir):
    out = quality.judge(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


def poor(labels):
    """doc_id of texts labelled to be of low quality but not toxic."""
    return labels.filter("quality = 0 AND (toxic = 0 OR toxic IS NULL)").select("doc_id").distinct()


def recounts(docs, ids, tokenizers):
    """Counts of these documents without their symbols. They are counted before the join: a join of whole texts would move them all."""
    texts = might_hold(docs, "doc_id", filter_words(ids, "doc_id"))
    return rollup.counts(texts.withColumn("text", F.translate("text", "#*$%&|<>", "")), tokenizers).join(ids, "doc_id", "left_semi")


@query("op4_token_rollup")
def op4(spark, sf_dir):
    """All documents are inserted; then those labelled toxic are deleted, and those of low quality are counted again
    without their symbols. One batch is delivered twice."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    tokenizers = {"words-1": rollup.by_words, "byte_bpe_50k-1": rollup.by_byte_pairs(f"{rollup.TOKENIZERS}/byte_bpe_50k.tiktoken")}
    state = rollup.Rollup(spark, scratch(spark, "rollup"))
    seq = F.lit(0).cast("long").alias("seq")
    state.apply("insert", kept(rollup.counts(docs, tokenizers), "counts").select("*", F.lit("insert").alias("op"), seq))
    version = F.explode(F.array(*map(F.lit, tokenizers))).alias("version")
    none = F.lit(None).cast("string")
    gone = labels.filter("toxic = 1").select("doc_id").distinct().select("doc_id", version, none.alias("source"), none.alias("lang"),
                                                                         F.lit(0).cast("long").alias("n_tokens"), F.lit("delete").alias("op"), seq)
    state.apply("delete-toxic", gone)
    state.apply("recount-symbols", kept(recounts(docs, poor(labels), tokenizers), "recounts").select("*", F.lit("revise").alias("op"), seq))
    state.apply("delete-toxic", gone)
    return state.totals()


@query("op5_near_duplicates")
def op5(spark, sf_dir):
    return near_dup.near_duplicates(read(spark, sf_dir, "documents"), size=2, percent=80)


@query("op6_secrets")
def op6(spark, sf_dir):
    return secrets.digest(secrets.spans(read(spark, sf_dir, "documents")))


@query("op7_toxicity")
def op7(spark, sf_dir):
    out = toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted", F.size("passages").alias("n_passages"))


@query("op8_licenses")
def op8(spark, sf_dir):
    return licenses.scan(read(spark, sf_dir, "documents")).drop("spans")


@query("op10_resharding")
def op10(spark, sf_dir):
    """Documents that lie in six shards by source move to eight of equal bytes."""
    docs = read(spark, sf_dir, "documents")
    placed = sharding.plan(docs, F.pmod(F.xxhash64("source"), F.lit(sharding.OLD_SHARDS)))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


@query("op9_subword_pieces")
def op9(spark, sf_dir):
    """Every document's pieces, a checksum of them, and whether they decode to its text again."""
    model = subwords.Pieces.read(f"{rollup.TOKENIZERS}/piece_bpe_32k.model")
    done = subwords.decode(subwords.encode(read(spark, sf_dir, "documents"), model, keep=["text"]), model)
    return done.select("doc_id", "ids", F.size("ids").cast("long").alias("n_pieces"), F.crc32(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary")).alias("ids_crc32"),
                       (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("round_trip"))


@query("op11_packing")
def op11(spark, sf_dir):
    """All documents in sequences of 2048 tokens."""
    return packing.pack(read(spark, sf_dir, "documents"), f"{rollup.TOKENIZERS}/word_bpe_49k.json", with_ids=False)


OP12_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang,
                  unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
sized AS (SELECT lang, w, unnest([1, 2, 3, 4, 5]) AS size FROM w),
placed AS (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM sized WHERE len(w) >= size),
c AS (SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase, count(*) AS f FROM placed GROUP BY ALL HAVING count(*) >= 100),
cand AS (SELECT *, string_split(phrase, ' ') AS v FROM c WHERE size > 1),
cuts AS (SELECT lang, phrase, f AS a, v, size, unnest(range(1, size)) AS k FROM cand),
scored AS (SELECT cuts.lang, cuts.phrase, a, k, l.f AS l, r.f AS r, n, ((1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f))::BIGINT AS score
           FROM cuts JOIN c l ON l.lang = cuts.lang AND l.phrase = array_to_string(v[1:k], ' ')
           JOIN c r ON r.lang = cuts.lang AND r.phrase = array_to_string(v[k + 1:], ' ') JOIN total ON total.lang = cuts.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM c longer WHERE longer.lang = b.lang AND longer.size > len(string_split(b.phrase, ' '))
           AND contains(' ' || longer.phrase || ' ', ' ' || b.phrase || ' ') AND 100 * longer.f >= 100 * b.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000"""


@query("op12_collocations", OP12_SQL)
def op12(spark, sf_dir):
    return phrases.collocations(read(spark, sf_dir, "documents"))


OP13_SQL = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
      FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
pos AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT pos.anchor_id, positive_id, (row_number() OVER (PARTITION BY pos.anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM pos JOIN s ON s.anchor_id = pos.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10"""


@query("op13_hard_negatives", OP13_SQL)
def op13(spark, sf_dir):
    """Every seventh vector has its label changed first."""
    rows = negatives.quantised(read(spark, sf_dir, "embeddings"))
    return negatives.mine(rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))
