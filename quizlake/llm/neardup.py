"""Near duplicates by a signature-coordinate inverted join.

A document's set holds its distinct shingles of 3 words (64-bit hashes).  Documents with equal sets are one node.  A node's
signature has K MinHash coordinates; a node is posted under each (coordinate, value).  Two nodes match if at least MATCH
coordinates collide, so they share one of each other's K - MATCH + 1 rarest postings: only these (the prefix) are
merged, and postings of a single node are skipped.  Matching pairs are confirmed on the full sets:
100 * intersection >= 85 * union.

No list of postings is expanded into all its pairs.  In each of ROUNDS rounds every list compares one node, at first its
most central one, with those outside of the node's component; lists inside one component are skipped from then on.  What
then still lies in different components is joined by prefixes of the full sets in one order, rarest shingle first: sets
that are similar enough share a shingle near the beginning of both, and what stands behind the first one they share bounds
their intersection.  That bound is part of the join's condition, so a pair leaves the join only if its sets can be similar
enough by size and position; no number of collisions is asked of it.  Before two sets are fetched, their counts
over BUCKETS ranges of hashes bound the intersection once more.  None of these bounds loses a link.  What can lose one is MATCH,
for nodes that collide with no other that often: a pair of similarity 0.85 has fewer than MATCH collisions with a probability of
2e-5.  With exact=True the join by position takes all nodes, whatever they collide with, and nothing is lost.

Null, empty and wordless texts have empty sets and are linked with nothing.  Rows that repeat a doc_id are one document if
their sets are equal, and documents of their own if not; kept is true for each row whose doc_id is the least of its
component, and distinct() leaves one row of each such document.  A null doc_id sorts before all others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import U64, Scratch, fresh, grams, hasher, mix, prepare, space_words

SHINGLE, PERCENT, K, MATCH, ROUNDS = 3, 85, 32, 18, 4
PREFIX = K - MATCH + 1
BITS, BUCKETS = 1 << 26, 256


def shingles(h: np.ndarray) -> np.ndarray:
    """The sorted set of a text with these word hashes."""
    return np.unique(grams(h, min(SHINGLE, len(h)))) if len(h) else np.empty(0, U64)


def sets(batch: pa.RecordBatch, hashed) -> list[np.ndarray]:
    return [shingles(hashed(space_words(t))) for t in batch.column("text").cast(pa.binary()).to_pylist()]


def spread(s: np.ndarray) -> bytes:
    """How many hashes of a set lie in each of BUCKETS equal ranges; sets share at most the sum of the lesser counts."""
    return np.bincount((s >> U64(56)).astype(np.int64), minlength=BUCKETS).astype(np.uint32).tobytes()


def set_id(s: np.ndarray) -> bytes:
    with np.errstate(over="ignore"):
        return mix(s).sum(dtype=U64).tobytes() + np.bitwise_xor.reduce(mix(s ^ U64(0x5851F42D4C957F2D)), initial=U64(0)).tobytes()


def signer():
    rng = np.random.default_rng(20240607)
    a, b = rng.integers(1, 2**63, K, np.uint64) | U64(1), rng.integers(0, 2**63, K, np.uint64)

    def sign(s: np.ndarray) -> bytes:
        least = np.full(K, 2**32 - 1, np.uint32)
        for i in range(0, len(s), 8192):
            x = (s[i : i + 8192, None] * a + b) >> U64(32)
            least = np.minimum(least, x.min(axis=0).astype(np.uint32))
        return least.tobytes()

    return sign


def signatures(docs: DataFrame) -> DataFrame:
    def run(batches):
        hashed, sign = hasher(), signer()
        for batch in batches:
            found = sets(batch, hashed)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in found], pa.int64()), pa.array([set_id(s) for s in found], pa.binary()), pa.array([sign(s) for s in found], pa.binary())], ["doc_id", "n", "set_id", "sig"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, set_id binary, sig binary")


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """node, label for the ends of edges (a, b): the smallest node that each can reach.  Minima move along the edges and jump
    over labels; every round is written to the shared folder."""
    both = scratch.table(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "both")
    labels = scratch.table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        moved = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("_node"), F.col("label").alias("_label"))
        nxt = scratch.table(moved.join(jump, F.col("label") == F.col("_node"), "left").select("node", "was", F.least("label", F.coalesce("_label", "label")).alias("label")), "labels")
        if nxt.where("was <> label").isEmpty():
            return nxt.select("node", "label")
        labels = nxt.select("node", "label")


def coordinates(nodes: DataFrame) -> DataFrame:
    """node, key for each coordinate; the key is the hash of coordinate and value."""

    def run(batches):
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, K).astype(U64)
            keys = mix(sig + (np.arange(K, dtype=U64) << U64(32))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(batch.column("node")), K)), pa.array(keys.ravel())], ["node", "key"])

    return nodes.select("node", "sig").mapInArrow(run, "node long, key long")


def marked(ids: DataFrame, column: str) -> np.ndarray:
    """A bitmap of fixed size (8 MB) of the hashed ids; it only lets rows through that a join then decides on."""
    bit = F.pmod(F.xxhash64(F.coalesce(F.col(column), F.lit(-1))), F.lit(BITS))
    out = np.zeros(BITS // 64, np.uint64)
    rows = ids.select(bit.alias("bit")).groupBy((F.col("bit") / 64).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int"))).alias("bits")).toArrow()
    out[np.asarray(rows.column("word"))] = np.asarray(rows.column("bits")).view(np.uint64)
    return out


def confirmed(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    x, y = full.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), full.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))

    def run(batches):
        for batch in batches:
            keep = []
            for p, q in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True):
                p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= PERCENT * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(y, "b").join(x, "a").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, exact: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text).  exact: lose no link, at the price of a join
    over the rarest shingles of all sets."""
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark)
    signed = scratch.table(signatures(docs), "signed")
    nodes = signed.where("n > 0").groupBy("set_id").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id"))["doc_id"].alias("doc_id"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.count("*").alias("copies"))
    nodes = scratch.table(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    posted = scratch.table(coordinates(nodes), "posted")
    frequent = posted.groupBy(F.col("key").alias("_key")).agg(F.count("*").alias("freq")).where("freq > 1")
    shared = posted.join(frequent, F.col("key") == F.col("_key")).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("freq", "key"))).alias("shared"))
    # at most K entries a node; the postings of one node come first in the prefix and lead nowhere
    prefix = F.slice("shared", 1, F.size("shared") - F.lit(MATCH - 1))
    central = F.aggregate("shared", F.lit(0).cast("long"), lambda s, x: s + x["freq"])
    lists = shared.where(F.size("shared") >= MATCH).select("node", central.alias("central"), F.explode(prefix["key"]).alias("key"))
    lists = lists.withColumn("label", F.col("node")).join(nodes.select("node", "n", F.col("n").alias("common")), "node")
    lists = scratch.table(lists, "lists")
    chosen = (nodes if exact else lists.select("node").distinct().join(nodes, "node")).select("node", "doc_id", "set_id", "n", "sig")
    chosen = scratch.table(chosen, "chosen")
    full = scratch.table(_full_sets(docs, chosen), "full")
    scratch.drop("posted")
    small = full.select("node", "n", "sig", "spread")
    labels = chosen.select("node", F.col("node").alias("label"))
    for turn in range(ROUNDS + 1):
        last = turn == ROUNDS or lists is None
        if not last:
            rows = lists.alias("l")
            # the most central node first, then any: each list draws its own
            order = F.struct("central", F.negative("node").alias("order"), *LISTED) if not turn else F.struct(F.xxhash64("node", "key", F.lit(turn)).alias("order"), *LISTED)
            hubs = lists.groupBy(F.col("key").alias("_key")).agg(F.max(order).alias("r"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
            found = rows.join(hubs, (F.col("l.key") == F.col("_key")) & (F.col("l.label") != F.col("r.label")) & _able())
        else:
            found = _by_position(scratch, chosen if exact else lists, labels, full)
        found = found.select(F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b"))
        pairs = scratch.table(_matching(found.distinct(), small, 0 if last else MATCH), "pairs")
        linked = scratch.table(confirmed(pairs, full), "linked")
        if not linked.isEmpty():
            of = labels.select(F.col("node").alias("_node"), "label")
            edges = linked.join(of, F.col("a") == F.col("_node")).select(F.col("label").alias("a"), "b").join(of, F.col("b") == F.col("_node")).select("a", F.col("label").alias("b")).where("a <> b")
            moved = components(scratch, edges).select(F.col("node").alias("_old"), F.col("label").alias("_new"))
            labels = scratch.table(labels.join(moved, F.col("label") == F.col("_old"), "left").select("node", F.coalesce("_new", "label").alias("label")), "of")
        if last:
            break
        # without the hubs, whose pairs are done, and the lists that are one component now
        gone = hubs.select("_key", F.col("r.node").alias("_hub"))
        rest = lists.drop("label").join(gone, F.col("key") == F.col("_key")).where("node <> _hub").drop("_key", "_hub").join(labels, "node")
        mixed = rest.groupBy(F.col("key").alias("_key")).agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("_key")
        lists = scratch.table(rest.join(mixed, F.col("key") == F.col("_key")).drop("_key"), "lists")
        if lists.isEmpty():
            if not exact:
                break
            lists = None
        elif not turn:
            lists = scratch.table(_held_in_common(lists, full), "bounded")
    scratch.drop("lists", "bounded", "full", "pairs", "linked", "both", "labels", "held", "early")
    placed = nodes.join(labels.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").withColumn("label", F.coalesce("label", "node"))
    least = placed.groupBy(F.col("label").alias("_label")).agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id"))["doc_id"].alias("component_id"))
    classes = placed.join(least, F.col("label") == F.col("_label")).where(~F.col("doc_id").eqNullSafe(F.col("component_id")) | (F.col("copies") > 1)).select(F.col("set_id").alias("_set"), "component_id", F.lit(True).alias("_in"))
    out = signed.join(classes, (F.col("set_id") == F.col("_set")) & (F.col("n") > 0), "left")
    component = F.when(F.col("_in"), F.col("component_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _matching(pairs: DataFrame, small: DataFrame, match: int) -> DataFrame:
    """The pairs with at least `match` colliding coordinates, and set sizes and spreads that allow the similarity."""
    x, y = (small.select(F.col("node").alias(c), *(F.col(k).alias(k + c) for k in ("n", "sig", "spread"))) for c in "ab")

    def run(batches):
        for batch in batches:
            rows = lambda c, width: np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, width)  # noqa: B023, E731
            hits = (rows("siga", K) == rows("sigb", K)).sum(axis=1)
            most = np.minimum(rows("spreada", BUCKETS), rows("spreadb", BUCKETS)).sum(axis=1, dtype=np.int64)
            able = 100 * most >= PERCENT * (np.asarray(batch.column("na")) + np.asarray(batch.column("nb")) - most)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array((hits >= match) & able, pa.bool_()))

    near = (100 * F.least("na", "nb")) >= (PERCENT * F.greatest("na", "nb"))
    return pairs.join(x, "a").join(y, "b").where(near).select("a", "b", "na", "nb", "siga", "sigb", "spreada", "spreadb").mapInArrow(run, "a long, b long")


LISTED = ("node", "label", "n", "common")


def _able():
    """Whether nodes l and r can be similar enough, by their set sizes and what they hold in common with any other."""
    most = F.least("l.common", "r.common")
    return (100 * most) >= (PERCENT * (F.col("l.n") + F.col("r.n") - most))


def _held(lists: DataFrame, full: DataFrame) -> DataFrame:
    """node, shingle for the nodes of the lists."""

    def run(batches):
        for batch in batches:
            for node, raw in zip(batch.column("node").to_pylist(), batch.column("shingles").to_pylist(), strict=True):
                found = np.frombuffer(raw, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), node)), pa.array(found)], ["node", "shingle"])

    return full.join(lists.select("node").distinct(), "node").select("node", "shingles").mapInArrow(run, "node long, shingle long")


def _held_in_common(lists: DataFrame, full: DataFrame) -> DataFrame:
    """lists with common, how many of a node's n shingles another node of the lists has too: an intersection cannot be
    larger, which rules out nodes and pairs."""
    alone = _held(lists, full).groupBy("shingle").agg(F.count("*").alias("holders"), F.min("node").alias("node")).where("holders = 1").groupBy("node").agg(F.count("*").alias("own"))
    return lists.drop("common").join(alone, "node", "left").withColumn("common", F.col("n") - F.coalesce("own", F.lit(0))).drop("own").where(100 * F.col("common") >= PERCENT * F.col("n"))


def _by_position(scratch: Scratch, lists: DataFrame, labels: DataFrame, full: DataFrame) -> DataFrame:
    """Pairs l, r of nodes of the lists, in different components, that share a shingle so early in both sets, rarest first,
    that they can be similar enough."""
    held = scratch.table(_held(lists, full), "held")
    holders = held.groupBy(F.col("shingle").alias("_shingle")).agg(F.count("*").alias("holders"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("holders", "shingle"))
    placed = held.join(holders, F.col("shingle") == F.col("_shingle")).withColumn("place", place).join(full.select(F.col("node").alias("_node"), "n"), F.col("node") == F.col("_node"))
    # the first shingle in common stands at place n - 0.85 n + 1 at the latest
    early = placed.where((F.col("holders") > 1) & (100 * (F.col("n") - F.col("place") + 1) >= PERCENT * F.col("n"))).select("node", "shingle", "place", "n").join(labels, "node")
    rows = scratch.table(early, "early")
    mixed = rows.groupBy(F.col("shingle").alias("_shingle")).agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("_shingle")
    rows = scratch.table(rows.join(mixed, F.col("shingle") == F.col("_shingle")).drop("_shingle"), "early")
    most = F.least(F.col("l.n") - F.col("l.place"), F.col("r.n") - F.col("r.place")) + 1
    able = (100 * most) >= (PERCENT * (F.col("l.n") + F.col("r.n") - most))
    apart = (F.col("l.node") < F.col("r.node")) & (F.col("l.label") != F.col("r.label"))
    found = rows.alias("l").join(rows.alias("r"), (F.col("l.shingle") == F.col("r.shingle")) & apart & able)
    return found.select(F.struct(F.col("l.node")).alias("l"), F.struct(F.col("r.node")).alias("r"))


def _full_sets(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """node, n, sig, spread, shingles for the chosen nodes (node, doc_id, set_id, n, sig), from a second look at their texts."""
    sent = docs.sparkSession.sparkContext.broadcast(marked(chosen, "doc_id"))

    def run(batches):
        hashed, bits = hasher(), sent.value
        for batch in batches:
            bit = np.asarray(batch.column("bit")).astype(np.uint64)
            keep = (bits[bit >> U64(6)] >> (bit & U64(63)) & U64(1)).astype(bool)
            batch = batch.filter(pa.array(keep))
            for i in range(0, batch.num_rows, 200):
                found = sets(batch.slice(i, 200), hashed)
                yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in found], pa.binary()), pa.array([spread(s) for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())], ["_set", "spread", "shingles"])

    bit = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long"))), F.lit(BITS))
    seen = docs.select("text", bit.alias("bit")).mapInArrow(run, "_set binary, spread binary, shingles binary")
    return seen.join(chosen, F.col("_set") == F.col("set_id")).groupBy("node").agg(*(F.first(c).alias(c) for c in ("n", "sig", "spread", "shingles")))


def distinct(docs: DataFrame) -> DataFrame:
    """docs with one document of each group; the columns stay.  Of rows that repeat an id, one of each set of shingles stays,
    the one with the least hash of its text (texts without words count by that hash)."""
    found = near_duplicates(docs)
    gone = found.where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    out = docs.join(gone, docs["doc_id"].eqNullSafe(gone["_gone"]), "left_anti")
    again = docs.groupBy(F.col("doc_id").alias("_again")).count().where("count > 1").select("_again")
    if again.isEmpty():
        return out
    mark, m, kind, first = fresh(docs, "_mark", "_m", "_set", "_first")
    repeated = out.join(again, out["doc_id"].eqNullSafe(again["_again"]), "left_semi")
    single = out.join(again, out["doc_id"].eqNullSafe(again["_again"]), "left_anti")
    rows = Scratch(docs.sparkSession).table(repeated.withColumn(mark, F.xxhash64("text")), "repeated")
    # these rows' sets are told once more, by the hash of the text
    told = signatures(rows.select(F.col(mark).alias("doc_id"), "text").distinct())
    told = told.select(F.col("doc_id").alias(m), F.when(F.col("n") > 0, F.col("set_id")).otherwise(F.col("doc_id").cast("string").cast("binary")).alias(kind)).distinct()
    rows = rows.join(told, F.col(mark) == F.col(m)).withColumn(first, F.row_number().over(Window.partitionBy("doc_id", kind).orderBy(mark)))
    return single.unionByName(rows.where(F.col(first) == 1).select(*(F.col(f"`{c}`") for c in docs.columns)))
