"""Token totals by source, language and tokenizer version, kept up to date by signed deltas.

A batch is a table of changes: insert, delete or revise of one document's count under one tokenizer version. It becomes
signed ledger rows (the old contribution with a minus, the new one with a plus), and their sums become the batch's
delta of the totals. Totals are the sum of all committed deltas; nothing is read back or updated in place.

A batch's files are written to folders of its own, replacing what a failed attempt left; its commit record is written
last. Batches that are committed are skipped, so delivering one again, whole or after a crash, changes nothing.

Rules for odd input: changes without doc_id or version are dropped as unusable; of several changes of one document and
version in a batch the one with the highest ``seq`` counts (ties: revise before insert before delete, then the larger
count, then source and language); an insert of a known document replaces it, a delete or revise of an unknown one does
nothing or inserts; NULL counts are 0; a NULL source or language is a group of its own.
"""

from __future__ import annotations

import base64
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from halocline.llm import text as T
from halocline.llm.frames import filter_words, kept, might_hold

_LEDGER = "doc_id long, version string, source string, lang string, docs long, tokens long"
_CHANGE = ["op", "doc_id", "version", "source", "lang", "n_tokens", "seq"]
_TOTALS = "source string, lang string, version string, docs long, tokens long"
GROUP = ["source", "lang", "version"]
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: how the byte-level vocabulary splits text before merging.
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def by_words(texts: pa.Array) -> np.ndarray:
    """Words between white space."""
    return T.Words(texts, T.SOLID, lower=False).counts


def by_byte_pairs(path: str) -> Callable[[pa.Array], np.ndarray]:
    """Counts under a rank file; it is read here once and sent along with the function (about 1 MB)."""
    with open(path, "rb") as f:
        lines = f.read()
    held: list = []

    def count(texts: pa.Array) -> np.ndarray:
        if not held:
            import tiktoken
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines.splitlines())}
            held.append(tiktoken.Encoding("ranks", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={}))
        return np.array([len(x) for x in held[0].encode_ordinary_batch(texts.fill_null("").to_pylist(), num_threads=1)], np.int64)

    return count


def counts(docs: DataFrame, tokenizers: dict[str, Callable], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, source, lang, version, n_tokens: one row for each document and tokenizer, without a shuffle."""
    names = ["doc_id", "source", "lang", "version", "n_tokens"]

    def run(batches):
        for batch in batches:
            for part in T.pieces(batch, "text"):
                for version, count in tokenizers.items():
                    n = count(part.column(part.schema.get_field_index("text")))
                    yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in names[:3]),
                                                      pa.array([version] * part.num_rows, pa.string()), pa.array(n.astype(np.int64))], names=names)

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
                       F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(T.lean(run), "doc_id long, source string, lang string, version string, n_tokens long")


class Rollup:
    """The state in one shared folder: ``ledger``, ``totals`` and ``commits``, each with a folder for every batch."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, path: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def committed(self) -> list[str]:
        """Batch names in order of commit time."""
        if not self._exists(f"{self.path}/commits"):
            return []
        return [r[0] for r in self.spark.read.schema("name string, at timestamp").parquet(f"{self.path}/commits/*").orderBy("at", "name").collect()]

    def _read(self, kind: str, schema: str) -> DataFrame:
        names = self.committed()
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{kind}/{n}" for n in names))

    def ledger(self) -> DataFrame:
        return self._read("ledger", _LEDGER)

    def totals(self) -> DataFrame:
        """source, lang, version, n_docs, n_tokens of all groups that hold documents."""
        return (self._read("totals", _TOTALS).groupBy(GROUP).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens")).filter("n_docs != 0"))

    def apply(self, name: str, changes: DataFrame) -> bool:
        """Commit a batch of changes (op, doc_id, version, source, lang, n_tokens, seq); False if it was committed before."""
        if name in self.committed():  # a folder without a record is what a failed attempt left
            return False
        rank = F.expr("CASE op WHEN 'revise' THEN 0 WHEN 'insert' THEN 1 ELSE 2 END")
        best = Window.partitionBy("doc_id", "version").orderBy(F.desc("seq"), rank, F.desc("n_tokens"), "source", "lang")
        last = kept(changes.filter("doc_id IS NOT NULL AND version IS NOT NULL AND op IN ('insert', 'delete', 'revise')")
                    .select(*_CHANGE).withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n"), "changes")
        # Only what the ledger holds of the batch's documents is moved and summed up.
        known = might_hold(self.ledger(), "doc_id", filter_words(last, "doc_id")).join(last.select("doc_id", "version"), ["doc_id", "version"], "left_semi")
        net = known.groupBy("doc_id", "version", "source", "lang").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs != 0")
        minus = (net.select("doc_id", "version", "source", "lang", (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens")))
        plus = last.filter("op != 'delete'").select("doc_id", "version", "source", "lang", F.lit(1).cast("long").alias("docs"),
                                                    F.coalesce(F.col("n_tokens"), F.lit(0)).cast("long").alias("tokens"))
        where = f"{self.path}/ledger/{name}"
        minus.unionByName(plus).write.mode("overwrite").parquet(where)
        delta = self.spark.read.schema(_LEDGER).parquet(where).groupBy(GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        delta.select(*GROUP, "docs", "tokens").write.mode("overwrite").parquet(f"{self.path}/totals/{name}")
        self.spark.range(1).select(F.lit(name).alias("name"), F.current_timestamp().alias("at")).write.mode("overwrite").parquet(f"{self.path}/commits/{name}")
        return True
