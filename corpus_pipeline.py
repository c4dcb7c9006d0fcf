"""From raw documents to subword ids: toxic texts, near-duplicates and benchmark leaks go, secrets are masked, the rest is encoded.

Every stage takes (spark, docs, sf_dir) and returns a table; ``run`` writes it as Parquet in the shared folder and reads
it again as the next one's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from halocline.llm import decontam, near_dup, rollup, secrets, subwords, toxicity
from halocline.llm.frames import read
from halocline.session import release, scratch, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic; the model is learnt from the labelled ones among them."""
    return toxicity.clean(docs, read(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares at least 0.8 of its five-word shingles: the one with the smallest id."""
    return near_dup.clean(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of a benchmark item."""
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts."""
    return secrets.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids; every document is decoded again, and one that differs fails the run."""
    model = subwords.Pieces.read(f"{rollup.TOKENIZERS}/piece_bpe_32k.model")
    done = subwords.encode(docs, model, keep=["lang", "source", "text"])
    plain = F.translate(F.coalesce("text", F.lit("")), "▁", " ")  # the model writes blanks with this character
    checked = F.when(F.col("decoded") == plain, F.col("ids")).otherwise(F.raise_error(F.concat(F.lit("ids do not decode to document "), F.col("doc_id").cast("string"))))
    return subwords.decode(done, model).select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), checked.alias("ids"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("pieces", encode),
]

#: The toxicity model, the linked secrets and the pieces can't be told in SQL; tests use a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's table. When a stage is written, the tables it and the stage before have left are deleted."""
    docs = read(spark, sf_dir, "documents")
    mine: list[str] = []
    for name, stage in STAGES:
        before = set(written(spark)) - set(mine)
        done = stage(spark, docs, sf_dir)
        path = scratch(spark, name)
        done.write.parquet(path)
        docs = spark.read.schema(done.schema).parquet(path)
        release(spark, [p for p in written(spark) if p not in before and p != path])
        mine = [path]
    return docs
