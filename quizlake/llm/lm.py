"""Language-model scoring by deleted interpolation of word n-grams.

P(w | v) = l2 * c(v w)/c(v) + l1 * c(w)/N + l0 / (V + 1), where the weights depend on the bucket of c(v), the octave of the
context's count.  v is the word before, or the end of a text before its first word.  The weights are learned by
expectation-maximisation on deleted counts: each training token is held out from its own counts in turn, c - 1
instead of c, so every training document is also held-out data and no document is spent on it.

Counting: texts are gathered in chunks of about CHUNK tokens, each with its own small vocabulary, and written once.  A chunk
sends each distinct word and pair once, as a hash with its count, to one of P parts; a part sums the counts of all chunks and
sends each chunk its sums.  So a frequent word costs a row per chunk and no part can grow hot, and every chunk ends with the
exact counts of what it holds.  Only the bucketed statistics of EM, whose size is fixed, reach the driver.

Null and empty texts consist of the end alone.  Repeated rows count and are scored as often as they occur.  Without training
documents all counts are 0 and only the last term is left.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import U64, Memo, Scratch, id_crc, mix, prepare, space_words

CHUNK, PART_KEYS = 2_000_000, 2_000_000
END = b"\n"  # no word holds white space
BUCKETS, STEP, FLOOR = 32, 4, 48  # octaves of a context's count; parts of an octave and octaves for the ratios
CHUNKS = "chunk string, docs binary, held binary, lengths binary, tokens binary, words binary, counts binary, n_trained long, n_pairs long"


def pressed(a: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def opened(b: bytes, kind) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def chunks(docs: DataFrame, size: int = CHUNK) -> DataFrame:
    """Rows of CHUNKS: the ids, held-out flags and token counts of documents, their tokens as places in the chunk's word list."""

    def run(batches):
        import xxhash
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0
        ids, held, lengths, tokens, n = [], [], [], [], 0
        place = Memo(lambda w: len(place), 1 << 62)
        place[END]

        def closed():
            words = np.fromiter(map(xxhash.xxh64_intdigest, place), U64, len(place))
            of, out = np.array(lengths, np.int64), np.concatenate(tokens)
            train = np.repeat(~np.array(held, bool), of)
            before = np.concatenate([[0], out[:-1]]) if len(out) else out
            return pa.RecordBatch.from_pydict({
                "chunk": [f"{part}-{k}"], "docs": [pressed(np.array(ids, np.int64))], "held": [pressed(np.array(held, bool))], "lengths": [pressed(of)], "tokens": [pressed(out.astype(np.uint32))], "words": [words.tobytes()],
                "counts": [pressed(np.bincount(out[train], minlength=len(place)).astype(np.uint32))], "n_trained": [int(train.sum())], "n_pairs": [len(np.unique(before.astype(np.int64) * len(place) + out))],
            }, schema=ARROW)

        for batch in batches:
            for doc_id, out, text in zip(batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                own = space_words(text)
                own.append(END)
                tokens.append(np.fromiter(map(place.__getitem__, own), np.int64, len(own)))
                ids.append(NONE if doc_id is None else doc_id)
                held.append(out)
                lengths.append(len(own))
                n += len(own)
                if n >= size:
                    yield closed()
                    k, n = k + 1, 0
                    ids, held, lengths, tokens = [], [], [], []
                    place.clear()
                    place[END]
        if ids:
            yield closed()

    return docs.select("doc_id", "text", (id_crc() % 5 == 1).alias("held_out")).mapInArrow(run, CHUNKS)


ARROW = pa.schema([("chunk", pa.string()), *((c, pa.binary()) for c in ("docs", "held", "lengths", "tokens", "words", "counts")), ("n_trained", pa.int64()), ("n_pairs", pa.int64())])
NONE = -(2**63)


class Chunk:
    """A chunk's arrays; pairs: its distinct (word before, word) by hash, and for each token the place of its pair."""

    def __init__(self, row: dict):
        self.words, self.tokens, self.lengths = np.frombuffer(row["words"], U64), opened(row["tokens"], np.uint32).astype(np.int64), opened(row["lengths"], np.int64)
        self.before = np.concatenate([[0], self.tokens[:-1]])  # the end of the text before, place 0
        code, self.pair = np.unique(self.before * len(self.words) + self.tokens, return_inverse=True)
        first, second = code // len(self.words), code % len(self.words)
        self.hashes = mix(self.words[first] * U64(0x9E3779B97F4A7C15) + self.words[second])
        self.held = opened(row["held"], bool)
        self.trained = np.repeat(~self.held, self.lengths)


def parted(hashes: np.ndarray, parts: int):
    """For each part the places of its hashes, in order."""
    to = (hashes >> U64(20)) % U64(parts)
    order = np.argsort(to, kind="stable")
    cuts = np.searchsorted(to[order], np.arange(parts + 1))
    return [order[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def sums(rows: DataFrame, hashed, parts: int) -> DataFrame:
    """chunk, part, sums: for the hashes of each chunk their counts over all chunks; hashed: row -> hashes, counts."""

    def send(batches):
        for batch in batches:
            for row in batch.to_pylist():
                hashes, counts = hashed(row)
                for part, at in enumerate(parted(hashes, parts)):
                    yield pa.RecordBatch.from_pydict({"part": [part], "chunk": [row["chunk"]], "keys": [hashes[at].tobytes()], "counts": [pressed(counts[at])]})

    def add(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x, U64) for x in table.column("keys").to_pylist()]
        every, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, np.concatenate([opened(x, np.uint32) for x in table.column("counts").to_pylist()]), len(every)).astype(np.int64)
        cuts = np.cumsum([0] + [len(x) for x in keys])
        known = int((total > 0).sum())
        return pa.table({"chunk": table.column("chunk"), "part": table.column("part"), "sums": pa.array([pressed(total[at[a:b]].astype(np.uint32)) for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()), "known": pa.array([known if i == 0 else 0 for i in range(len(keys))], pa.int64())})

    sent = rows.mapInArrow(send, "part long, chunk string, keys binary, counts binary")
    return sent.groupBy("part").applyInArrow(add, "chunk string, part long, sums binary, known long")


def _words(row):
    return np.frombuffer(row["words"], U64), opened(row["counts"], np.uint32)


def _pairs(row):
    c = Chunk(row)
    return c.hashes, np.bincount(c.pair[c.trained], minlength=len(c.hashes)).astype(np.uint32)


def bins(ratio: np.ndarray) -> np.ndarray:
    """0 for 0, else the number of the quarter octave below 1."""
    with np.errstate(divide="ignore"):
        return np.where(ratio > 0, 1 + np.clip((-np.log2(ratio) * STEP).round(), 0, FLOOR * STEP - 1), 0).astype(np.int64)


def value(b: np.ndarray) -> np.ndarray:
    return np.where(b > 0, 2.0 ** -((b - 1) / STEP), 0.0)


def ratios(c2, context, c1, total, deleted):
    """Maximum-likelihood estimates of pair and word; deleted: 1 for tokens taken out of their own counts."""
    rest = context - deleted
    r2 = np.where(rest > 0, (c2 - deleted) / np.maximum(rest, 1), 0.0)
    r1 = (c1 - deleted) / max(total - 1, 1) if np.any(deleted) else c1 / max(total, 1)
    return np.bitwise_and(np.log2(np.maximum(rest, 1)).astype(np.int64) + (rest > 0), BUCKETS - 1), r2, r1


def learn(stats: np.ndarray, distinct: int, steps: int = 60) -> np.ndarray:
    """Weights (bucket, 3) for pair, word and constant, by EM over rows (bucket, bin of pair, bin of word, count)."""
    weights = np.tile([0.4, 0.5, 0.1], (BUCKETS, 1))
    weights[0] = [0, 0.9, 0.1]
    if not len(stats):
        return np.tile([0.0, 0.0, 1.0], (BUCKETS, 1))
    bucket, n = stats[:, 0], stats[:, 3].astype(float)
    p = np.stack([value(stats[:, 1]), value(stats[:, 2]), np.full(len(n), 1 / (distinct + 1))], 1)
    for _ in range(steps):
        share = weights[bucket] * p
        share *= (n / share.sum(1))[:, None]
        got = np.stack([np.bincount(bucket, share[:, i], BUCKETS) for i in range(3)], 1)
        seen = got.sum(1) > 0
        weights[seen] = (got[seen] + [0.0, 0.0, 1e-6]) / (got[seen].sum(1) + 1e-6)[:, None]
    weights[:, 2] = np.maximum(weights[:, 2], 1e-7)
    return weights / weights.sum(1)[:, None]


def scores(docs: DataFrame, chunk_tokens: int = CHUNK) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark)
    table = scratch.table(chunks(docs, chunk_tokens), "chunks")
    size = table.agg(F.sum("n_trained"), F.sum(F.octet_length("words") / 8), F.sum("n_pairs")).first()
    total, n_words, n_pairs = (int(x or 0) for x in size)
    parts = [max(1, math.ceil(n / PART_KEYS)) for n in (n_words, n_pairs)]
    words = scratch.table(sums(table.select("chunk", "words", "counts"), _words, parts[0]), "words")
    pairs = scratch.table(sums(table.select("chunk", "words", "tokens", "lengths", "held"), _pairs, parts[1]), "pairs")
    distinct = int(words.agg(F.sum("known")).first()[0] or 0)
    empty = F.lit(None).cast("binary")
    own = table.select("chunk", F.lit(0).cast("long").alias("kind"), F.lit(0).cast("long").alias("part"), *(c for c in ("docs", "held", "lengths", "tokens", "words")), empty.alias("sums"))
    told = [t.select("chunk", F.lit(k).cast("long").alias("kind"), "part", *(empty.alias(c) for c in ("docs", "held", "lengths", "tokens", "words")), "sums") for k, t in ((1, words), (2, pairs))]
    whole = own.unionAll(told[0]).unionAll(told[1])

    def together(rows: pa.Table):
        """The chunk with the counts of its words and pairs."""
        rows = rows.to_pylist()
        row = next(r for r in rows if not r["kind"])
        chunk, counts = Chunk(row), []
        for kind, hashes in ((1, chunk.words), (2, chunk.hashes)):
            out = np.zeros(len(hashes), np.int64)
            got = {r["part"]: r["sums"] for r in rows if r["kind"] == kind}
            for part, at in enumerate(parted(hashes, parts[kind - 1])):
                out[at] = opened(got[part], np.uint32)
            counts.append(out)
        return row, chunk, counts[0], counts[1]

    def gather(rows: pa.Table) -> pa.Table:
        _, chunk, c1, c2 = together(rows)
        at = chunk.trained
        bucket, r2, r1 = ratios(c2[chunk.pair[at]], c1[chunk.before[at]], c1[chunk.tokens[at]], total, 1)
        side = FLOOR * STEP + 1
        code, n = np.unique((bucket * side + bins(r2)) * side + bins(r1), return_counts=True)
        return pa.table({"bucket": code // side**2, "pair": code // side % side, "word": code % side, "n": n.astype(np.int64)})

    stats = whole.groupBy("chunk").applyInArrow(gather, "bucket long, pair long, word long, n long").groupBy("bucket", "pair", "word").agg(F.sum("n").alias("n")).toArrow()
    weights = learn(np.column_stack([np.asarray(stats.column(c)) for c in ("bucket", "pair", "word", "n")]).reshape(-1, 4), distinct)

    def judge(rows: pa.Table) -> pa.Table:
        row, chunk, c1, c2 = together(rows)
        c = c1[chunk.tokens]
        bucket, r2, r1 = ratios(c2[chunk.pair], c1[chunk.before], c, total, 0)
        w = weights[bucket]
        p = np.log10(w[:, 0] * r2 + w[:, 1] * r1 + w[:, 2] / (distinct + 1))
        base = np.log10((c + 0.5) / (total + 0.5 * (distinct + 1)))
        starts = np.concatenate([[0], np.cumsum(chunk.lengths)[:-1]])
        add = lambda x: np.add.reduceat(x, starts)
        ids = opened(row["docs"], np.int64)
        return pa.table({"doc_id": pa.array(ids, mask=ids == NONE), "held_out": pa.array(chunk.held), "n_tokens": chunk.lengths, "n_known": add((c > 0).astype(np.int64)), "train_tokens": pa.array(np.full(len(ids), total)), "base_score": add(base), "score": add(p)})

    return whole.groupBy("chunk").applyInArrow(judge, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
