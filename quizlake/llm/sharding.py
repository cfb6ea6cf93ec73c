"""Sharding by balanced label propagation [native].

Documents start in a shard by hash, which is even.  In each round the documents of a group (equal texts, or the parts of
a group that is larger than a shard) propose to move to the shard that holds most of their neighbours, of those with room for the rest.  A shard admits
proposals, whole buckets of groups at a time, up to its quota: its capacity less the linked documents that stay (single ones give way at no cost).  At last the
law `rows` is made exact: every shard keeps its linked documents first and hands the surplus, single documents
before linked ones, to shards with room.  Slots are ranks inside a shard, from prefix sums over small tables of bucket counts
and a rank inside each bucket, so no task sees a whole shard.

Only counts per shard reach the driver.  A null text is an empty one; empty texts are a group like any other.  Repeated rows
of one doc_id are documents of their own, linked if their texts are equal.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import Scratch

SHARDS, ROUNDS, ADMIT, BUCKET_ROWS = 16, 5, 256, 20_000


def mod(x: Column, n: int | Column) -> Column:
    return F.pmod(x, n if isinstance(n, Column) else F.lit(n)).cast("int")


def propagate(linked: DataFrame, capacity: int, scratch: Scratch, shards: int) -> DataFrame:
    """linked (row, part, label) with labels moved towards the neighbours' shards within the quotas."""
    for _ in range(ROUNDS):
        held = {r["label"]: r["count"] for r in linked.groupBy("label").count().collect()}
        free = F.element_at(F.array(*(F.lit(capacity - held.get(s, 0)) for s in range(shards))), F.col("label") + 1)
        votes = linked.groupBy("part", "label").agg(F.count("*").alias("n")).withColumn("all", F.sum("n").over(Window.partitionBy("part")))
        best = votes.groupBy(F.col("part").alias("_part")).agg(F.max(F.struct((free >= F.col("all") - F.col("n")).alias("fits"), "n", F.xxhash64("part", "label").alias("tie"), "label"))["label"].alias("to"))
        wish = linked.join(best, F.col("part") == F.col("_part")).select("row", "part", "label", "to", mod(F.xxhash64("part", F.lit(7)), ADMIT).alias("bucket"))
        counts = wish.groupBy("label", "to").agg(F.count("*").alias("n")).collect()
        if not any(r["label"] != r["to"] for r in counts):
            break
        stay = {s: sum(r["n"] for r in counts if r["label"] == r["to"] == s) for s in range(shards)}
        room = F.element_at(F.array(*(F.lit(max(0, capacity - stay[s])) for s in range(shards))), F.col("to") + 1)
        asked = wish.where("label <> to").groupBy("to", "bucket").agg(F.count("*").alias("n"))
        admitted = asked.withColumn("run", F.sum("n").over(Window.partitionBy("to").orderBy("bucket"))).where(F.col("run") <= room).select(F.col("to").alias("_to"), F.col("bucket").alias("_bucket"), F.lit(True).alias("_in"))
        moved = wish.join(F.broadcast(admitted), (F.col("to") == F.col("_to")) & (F.col("bucket") == F.col("_bucket")), "left")  # at most SHARDS * ADMIT rows
        linked = scratch.table(moved.select("row", "part", F.when(F.col("_in"), F.col("to")).otherwise(F.col("label")).alias("label")), "linked")
    return linked


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of docs (doc_id, text)."""
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text, F.length(text)).alias("group"))
    rows = scratch.table(rows.withColumn("home", mod(F.xxhash64("row", F.lit(1)), shards)), "rows")
    total = rows.count()
    capacity, buckets = math.ceil(total / shards), max(4, math.ceil(total / shards / BUCKET_ROWS))
    groups = rows.groupBy(F.col("group").alias("_group")).agg(F.count("*").alias("members")).where("members > 1")
    pieces = F.ceil(F.col("members") / F.lit(max(1, capacity)))
    linked = rows.join(groups, F.col("group") == F.col("_group")).select("row", F.xxhash64("group", mod(F.xxhash64("row", F.lit(2)), pieces)).alias("part"), F.col("home").alias("label"), "members")
    linked = scratch.table(linked, "linked")
    moved = propagate(linked.select("row", "part", "label"), capacity, scratch, shards)
    spread = F.ceil(F.col("members") / F.lit(BUCKET_ROWS))
    after = moved.join(linked.select(F.col("row").alias("_row"), "members"), F.col("row") == F.col("_row")).select(F.col("row").alias("_row"), "part", "label", mod(F.xxhash64("part") + F.pmod(F.xxhash64("row", F.lit(3)), spread), buckets).alias("_bucket"))
    placed = rows.join(after, F.col("row") == F.col("_row"), "left").select("row", "doc_id", "size", "text_crc32", F.coalesce("label", "home").alias("label"), F.col("part").isNull().alias("single"), F.coalesce("part", "row").alias("part"), F.coalesce("_bucket", mod(F.xxhash64("row", F.lit(4)), buckets)).alias("bucket"))
    placed = scratch.table(placed, "placed")
    counts = placed.groupBy("label", "single", "bucket").agg(F.count("*").alias("n"))
    base = counts.select(F.col("label").alias("_label"), F.col("single").alias("_single"), F.col("bucket").alias("_bucket"), (F.sum("n").over(Window.partitionBy("label").orderBy("single", "bucket")) - F.col("n")).alias("base"))
    inside = F.row_number().over(Window.partitionBy("label", "single", "bucket").orderBy("part", "row")) - 1
    ranked = placed.withColumn("_inside", inside).join(base, (F.col("label") == F.col("_label")) & (F.col("single") == F.col("_single")) & (F.col("bucket") == F.col("_bucket"))).withColumn("rank", F.col("_inside") + F.col("base"))
    have = {r["label"]: r["n"] for r in counts.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    return ranked.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), *exact(have, total, shards), F.lit(None).cast("int").alias("grown_shard"))


def exact(have: dict[int, int], total: int, shards: int) -> tuple[Column, Column]:
    """shard and slot of a document with label and rank, so that counts are at most one apart."""
    cap = [total // shards + (s < total % shards) for s in range(shards)]
    n = [have.get(s, 0) for s in range(shards)]
    surplus = [max(0, n[s] - cap[s]) for s in range(shards)]
    pool = F.lit(None).cast("long")
    for s in range(shards):
        pool = F.when((F.col("label") == s) & (F.col("rank") >= cap[s]), F.col("rank") - cap[s] + sum(surplus[:s])).otherwise(pool)
    to, slot, begin = F.col("label"), F.col("rank"), 0
    for s in range(shards):
        if (room := cap[s] - n[s]) > 0:
            here = (pool >= begin) & (pool < begin + room)
            to, slot = F.when(here, F.lit(s)).otherwise(to), F.when(here, pool - begin + n[s]).otherwise(slot)
            begin += room
    return to.cast("int").alias("shard"), slot.cast("long").alias("slot")
