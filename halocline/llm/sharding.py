"""Resharding with the fewest bytes moved.

Rows lie in old shards. New capacities are equal shares of all bytes. How many bytes each old shard sends to each new
one is a minimum-cost flow: old shards are sources with their sizes, new shards sinks with their capacities, a byte
that stays in the shard of its number costs nothing, a byte that moves costs one (or what the caller says). The graph
has one node for each shard, so the solver's work does not depend on the data.

A flow is turned into rows by laying each old shard's rows end to end: old shards are cut into blocks by a hash of the
row, block sizes (a fixed number of them) give each block its offset, and a window inside the block gives each row its
own. The row goes to the shard whose stretch holds its middle. Rows of at least half the mean size are dealt first; the
small rest is then dealt by a second flow that fills what is left of each capacity, so that shards end up equal to
about the size of a small row.

Rules for odd input: a NULL text has 0 bytes and size 1; NULL ids are placed like others; equal rows are interchangeable
and are dealt one by one; an empty table gives an empty result; columns beyond id, text and the old shard are not looked at.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from halocline.llm.frames import kept, tune

SHARDS = 8
OLD_SHARDS = 6
#: Blocks of each shard: offsets of SHARDS * BLOCKS of them are broadcast, whatever the size of the data.
BLOCKS = 512


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Amounts sent from each source to each sink: all supply (capacities must suffice) at the least total cost.

    Successive shortest paths in the residual graph, by Bellman-Ford since returning costs are negative.
    """
    n, m = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("capacities are smaller than the supply")
    flow = [[0] * m for _ in range(n)]
    spare, room = list(supply), list(capacity)
    while any(spare):
        dist = {("s", i): 0 for i in range(n) if spare[i]}
        came: dict = {}
        for _ in range(n + m):
            for i in range(n):
                for j in range(m):
                    a, b = ("s", i), ("t", j)
                    if a in dist and dist[a] + cost[i][j] < dist.get(b, np.inf):
                        dist[b], came[b] = dist[a] + cost[i][j], a
                    if flow[i][j] and b in dist and dist[b] - cost[i][j] < dist.get(a, np.inf):
                        dist[a], came[a] = dist[b] - cost[i][j], b
        end = min((("t", j) for j in range(m) if room[j] and ("t", j) in dist), key=lambda b: dist[b])
        path, at = [], end
        while at in came:
            path.append((came[at], at))
            at = came[at]
        amount = min([spare[at[1]], room[end[1]], *(flow[b[1]][a[1]] for a, b in path if a[0] == "t")])
        for a, b in path:
            if a[0] == "s":
                flow[a[1]][b[1]] += amount
            else:
                flow[b[1]][a[1]] -= amount
        spare[at[1]] -= amount
        room[end[1]] -= amount
    return flow


def _deal(rows: DataFrame, flow: list[list[int]], sizes) -> DataFrame:
    """Adds ``shard`` to rows (old, block, size, ...) by their place in the old shard; sizes: bytes of each (old, block)."""
    spark = rows.sparkSession
    offsets, cuts, total = [], [], {}
    for old, block, b in sorted(sizes):
        offsets.append((old, block, total.get(old, 0)))
        total[old] = total.get(old, 0) + b
    for i, line in enumerate(flow):
        upto = np.cumsum(line).tolist()
        cuts.append((i, [int(x) for x in upto], max([j for j, x in enumerate(line) if x], default=i % len(line))))
    offsets = spark.createDataFrame(offsets, "old int, block int, before long")
    cuts = spark.createDataFrame(cuts, "old int, upto array<long>, last int")
    inside = Window.partitionBy("old", "block").orderBy("id", "crc", "size").rowsBetween(Window.unboundedPreceding, -1)
    middle = F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)) + F.col("size") / 2
    shard = F.least(F.col("last"), F.size(F.filter("upto", lambda x: x <= F.col("middle"))))
    return (rows.join(F.broadcast(offsets), ["old", "block"]).withColumn("middle", middle).join(F.broadcast(cuts), "old")
            .withColumn("shard", shard.cast("int")).drop("before", "middle", "upto", "last"))


def _sums(rows: DataFrame, *by: str):
    return [tuple(r) for r in rows.groupBy(*by).agg(F.sum("size").cast("long")).collect()]


def plan(docs: DataFrame, old: Column, id_col: str = "doc_id", text_col: str = "text", old_shards: int = OLD_SHARDS, shards: int = SHARDS,
         blocks: int = BLOCKS, cost: list[list[int]] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, old_shard, shard and slot (place in the shard, gapless from 0) of every row.

    ``old`` gives a row's present shard, 0 to old_shards - 1; ``cost[i][j]`` the price of a byte from old i to new j.
    """
    tune(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"),
                       old.cast("int").alias("old"))
    rows = kept(rows.withColumn("block", F.pmod(F.xxhash64("id", "crc"), F.lit(blocks)).cast("int")), "rows")
    n, total, most = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0))).first()
    cost = cost or [[int(i != j) for j in range(shards)] for i in range(old_shards)]
    share = [total // shards + (j < total % shards) for j in range(shards)]
    large = F.col("size") >= (total / n / 2 if n else 0)
    # large rows leave some room in every shard, so that the small ones can level it
    reserve = min(2 * most, sum(b for _, b in _sums(rows.filter(~large), "old")) // shards)
    dealt = None
    for part in (rows.filter(large), rows.filter(~large)):
        sizes = _sums(part, "old", "block")
        supply = [sum(b for o, _, b in sizes if o == i) for i in range(old_shards)]
        room = [c - reserve for c in share] if dealt is None else [max(0, c - got) for c, got in zip(share, (dict(_sums(dealt, "shard")).get(j, 0) for j in range(shards)))]
        over = sum(supply) - sum(room)  # a row across an edge may leave a little less room than there is to place
        room = [c + max(0, over) // shards + (max(0, over) % shards > j) for j, c in enumerate(room)]
        out = kept(_deal(part, min_cost_flow(supply, room, cost), sizes), "dealt")
        dealt = out if dealt is None else dealt.unionByName(out)
    numbers, before = [], {}
    for shard, block, c in sorted(tuple(r) for r in dealt.groupBy("shard", "block").count().collect()):
        numbers.append((shard, block, before.get(shard, 0)))
        before[shard] = before.get(shard, 0) + c
    numbers = docs.sparkSession.createDataFrame(numbers, "shard int, block int, before long")
    place = F.row_number().over(Window.partitionBy("shard", "block").orderBy("id", "crc", "size")) - 1
    return (dealt.join(F.broadcast(numbers), ["shard", "block"]).withColumn("slot", F.col("before") + place)
            .select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.col("old").alias("old_shard"), "shard", "slot"))


def transfers(placed: DataFrame) -> DataFrame:
    """Rows and bytes that each old shard sends to each new one."""
    return placed.groupBy("old_shard", "shard").agg(F.count("*").alias("n_rows"), F.sum("size").alias("bytes"))


def rewrite(docs: DataFrame, placed: DataFrame, source: str, target: str, id_col: str = "doc_id", text_col: str = "text") -> list[int]:
    """Write the shards that gain or lose rows as ``target/shard=N``; ``docs`` has its present shard in column ``source``.

    Returns the numbers written; files of the other shards stay valid as they are. Rows with equal id and text go together.
    """
    spark = docs.sparkSession
    moved = [r[0] for r in transfers(placed).filter("old_shard != shard").select(F.explode(F.array("old_shard", "shard")).alias("s")).distinct().collect()]
    key = placed.groupBy("doc_id", "text_crc32", "size").agg(F.min("shard").alias("shard")).filter(F.col("shard").isin(moved))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lookup = key.select(F.col("doc_id").alias("_id"), F.col("text_crc32").alias("_crc"), F.col("size").alias("_size"), F.col("shard").alias("_shard"))
    on = docs[id_col].eqNullSafe(lookup["_id"]) & (F.crc32(text.cast("binary")) == lookup["_crc"]) & (F.octet_length(text) + 1 == lookup["_size"])
    out = docs.filter(F.col(source).isin(moved)).join(lookup, on).drop("_id", "_crc", "_size", source).withColumnRenamed("_shard", "shard")
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        out.repartition("shard", F.pmod(F.xxhash64(id_col), F.lit(16))).write.mode("overwrite").partitionBy("shard").parquet(target)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)
    return sorted(moved)
