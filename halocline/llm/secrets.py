"""Secrets in texts, with linking of credentials that come in parts; DataFrame functions only.

Certain kinds stand alone: assignments of a value to a secret's name, access ids and long hex strings. Others are weak:
a random-looking value (secret), the name of an account (ident) and a service's address (endpoint), of any length. A
weak one counts only if its complement stands within ``SCOPE`` characters: a value next to an identifier, an identifier
next to a value, an address next to both. Only characters outside of all parts are counted, so long parts do not keep
their neighbours apart. That is an interval join of the parts of one text: parts are ordered by place, and a range frame
around each looks for the others, which is linear in the number of parts and lists no pairs.

Places are found by splitting a text at a pattern: the pieces' and matches' lengths, summed up, are the places. Texts go
through this only if they hold a match. One row for each document and one for each part are shuffled, never texts.

Rules for odd input: a NULL text is an empty one without spans; repeated rows give one result row each; an empty table
gives an empty result; columns beyond id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from halocline.llm.frames import same_key, tune

#: Patterns of the kinds that stand alone, in order, with the least length of the part that counts.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # of 18 characters or more in all; shorter ones hold no longer one inside
HEX = r"[0-9a-f]{16,}"
ASSIGN_VALUE = 12
BASE = ["assign", "access", "hex"]

SECRET = r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])(?=[A-Za-z0-9+/_-]*[0-9])[A-Za-z0-9+/_-]{14,}+={0,2}(?![A-Za-z0-9+/=_-])"
#: Least length times log2 of the number of different characters of a random-looking value; 14 characters are the fewest that can reach it.
BITS = 50
IDENT = r"""(?i)(?<![A-Za-z0-9_])(?:access_?key_?id|client_?id|account|user(?:name)?|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}"""
ENDPOINT = r"(?i)(?:https?|ftp|jdbc:[a-z]+|mongodb|redis|amqp)://[A-Za-z0-9.@:_-]{4,}"
KINDS = [*BASE, "secret", "ident", "endpoint"]
SCOPE = 200
KEYS = ["id", "key"]


def _random(value: Column) -> Column:
    """Whether a value looks random: 32 or more plain characters, or runs of one class (upper, lower, digit) of four characters or fewer in the mean."""
    plain = value.rlike("^[A-Za-z0-9+/]{32}") & ~value.rlike("[_-]")
    kinds = F.regexp_replace(value, "[^A-Za-z0-9]+", "")
    runs = F.regexp_replace(F.regexp_replace(F.regexp_replace(kinds, "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "0")
    bits = F.length(value) * F.log2(F.size(F.array_distinct(F.split(value, ""))).cast("double"))
    return plain | ((bits >= BITS) & (4 * F.length(runs) >= F.length(kinds)))


def _matches(text: Column, pattern: str, kind: str, value: int = 0, gate: Column | None = None, test: Callable[[Column], Column] | None = None) -> Column:
    """array<struct<start, kind_no, end>> of the pattern's matches; ``value``: least length of group 2; ``test``: what holds for matches that count."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    size = F.transform(found, lambda m: F.length(m))
    between = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    # running sums: start and end of every match, in one pass over the matches
    both = F.zip_with(F.slice(between, F.lit(1), F.size(size)), size, lambda g, n: F.struct(g.alias("gap"), n.alias("len")))
    init = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)").alias("out"))

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + x["gap"]
        end = start + x["len"]
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end")))).alias("out"))

    spans = F.aggregate(both, init, step, lambda a: a["out"])
    if value:
        long = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
        spans = F.filter(spans, lambda s, i: F.length(F.get(long, i)) >= value)
    if test:
        spans = F.filter(spans, lambda s, i: test(F.get(found, i)))
    holds = text.rlike(pattern)
    return F.when(holds if gate is None else gate & holds, spans).otherwise(F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)"))


def _parts(text: Column) -> Column:
    sign = F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))
    base = F.concat(_matches(text, ASSIGN, "assign", ASSIGN_VALUE, sign), _matches(text, ACCESS, "access", gate=F.contains(text, F.lit("AKIA"))), _matches(text, HEX, "hex"))
    weak = F.concat(_matches(text, SECRET, "secret", test=_random), _matches(text, IDENT, "ident", gate=sign), _matches(text, ENDPOINT, "endpoint", gate=F.contains(text, F.lit("://"))))
    return F.concat(base, weak)


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """id, key (hash of the text), copies (rows with both equal), and spans of each text: array of (start, kind, end) by start, then kind."""
    tune(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = F.array(F.expr("named_struct('start', cast(null as int), 'kind', -1, 'end', cast(null as int))"))  # stands for the row itself
    parts = (docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("key"), F.concat(own, _parts(text)).alias("parts"))
             .select(*KEYS, F.explode_outer("parts").alias("p")).select(*KEYS, "p.start", "p.kind", "p.end"))
    kind = {k: F.col("kind") == i for i, k in enumerate(KINDS)}
    value, who = kind["assign"] | kind["hex"] | kind["secret"], kind["access"] | kind["ident"]
    in_order = Window.partitionBy(*KEYS).orderBy("start", "end", "kind")
    done = F.coalesce(F.max("end").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("gap", F.when(F.col("start") > done, F.col("start") - done).when(F.col("start").isNotNull(), 0).cast("long"))
    parts = parts.withColumn("place", F.sum("gap").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))  # characters before it that are in no part
    around = Window.partitionBy(*KEYS).orderBy("place").rangeBetween(-scope, scope)
    near = parts.withColumns({"n_value": F.count_if(value).over(around), "n_who": F.count_if(who).over(around)})
    linked = ((kind["secret"] & (F.col("n_who") > 0)) | (kind["ident"] & (F.col("n_value") > 0)) | (kind["endpoint"] & (F.col("n_who") > 0) & (F.col("n_value") > 0)))
    real = F.col("kind").between(0, len(BASE) - 1) | linked
    return near.groupBy(KEYS).agg(F.count_if(F.col("kind") == -1).alias("copies"), F.array_sort(F.collect_set(F.when(real, F.struct("start", "kind", "end")))).alias("spans"))


def _written(spans_: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts of the kinds that stand alone, a hash of those spans and all spans as text; one row for each row of documents."""
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))

    def count(i: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("long")

    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(BASE)]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"),
                        F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_")).drop("_")


def redact(docs: DataFrame, scope: int = SCOPE, mark: str = "[secret]") -> DataFrame:
    """All documents and columns, with a mark in place of each secret (overlapping spans become one); n_chars follows if there is such a column."""
    found = spans(docs, scope=scope).filter(F.size("spans") > 0).select(F.col("id").alias("_id"), F.col("key").alias("_key"), F.col("spans").alias("_spans"))
    both = docs["doc_id"].cast("long").eqNullSafe(found["_id"]) & (F.xxhash64(docs["text"].cast("string")) == found["_key"])
    text = F.col("text").cast("string")
    init = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        start = F.greatest(s["start"], a["at"])
        new = F.concat(a["out"], F.substring(text, a["at"] + 1, start - a["at"]), F.when(s["start"] >= a["at"], F.lit(mark)).otherwise(""))
        return F.struct(F.greatest(s["end"], a["at"]).alias("at"), new.alias("out"))

    clean = F.aggregate("_spans", init, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    out = docs.join(found, both, "left").withColumn("text", F.when(F.col("_spans").isNull(), F.col("text")).otherwise(clean))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_spans").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
