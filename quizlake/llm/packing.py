"""Packing of token sequences by non-negative least squares.

A document's tokens, with the end id 0, are cut into whole windows of 1024, each a sequence of its own, and a tail of
less.  Of the tails only the histogram of lengths (1023 numbers) reaches the driver.  There all pairs and triples of lengths
that fill a window exactly are enumerated, non-negative least squares finds how often to use each, the counts are
rounded down, and what is left is packed greedily, longest first, each tail cut where a window is full.  Only the last
window is padded.

A tail finds its place without a global sort: its rank among tails of its length is a rank inside its partition, made
while tokenising, plus the count of such tails in earlier partitions.
Tokens that the texts make are those of the tokenizer file, whose path is a parameter.  A text is encoded whole, in one
call; no words are remembered, since their number grows with the input.  Null and empty texts are the end id alone.
Repeated rows are packed as often as they occur.
"""

from __future__ import annotations

import functools
import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import Scratch, prepare

WINDOW = 1024
#: Fixed value: how this vocabulary's texts are cut before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PROBES = ["", "a", " a", "It's 12 o'clock\n\n and  more\t", "naïve Straße — 東京 🙂 x_y z...", "  \r\n tail "]
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@functools.cache
def encoder(path: str):
    """text -> bytes of little-endian 32-bit ids, equal to those of tokenizers with add_special_tokens=False; built once a Python worker."""
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    by_library = lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    fast = None
    try:
        import tiktoken

        # The printable stand-ins of byte-level BPE.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        whole = lambda text: own.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
        if all(whole(x) == by_library(x) for x in PROBES):
            fast = whole
    except (ImportError, KeyError, ValueError):
        pass  # a vocabulary of another kind: the library itself encodes

    def encode(text: str) -> bytes:
        if fast and not any(s in text for s in special):
            try:
                return fast(text)
            except ValueError:
                pass  # white space of a million characters in a row overflows the stack of its pattern matcher
        return by_library(text)

    return encode


def tokenised(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """For each row: its partition, the whole windows before it there, the number of ids, the CRCs of its whole windows, and its tail."""

    def run(batches):
        from pyspark import TaskContext

        encode, part, full, rows, seen = encoder(path), TaskContext.get().partitionId(), 0, 0, [0] * window
        for batch in batches:
            cols: dict[str, list] = {k: [] for k in ARROW.names}
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = encode(text or "") + b"\0\0\0\0"
                n = len(ids) // 4
                tail = n % window
                cut = (n - tail) * 4
                for k, v in zip(ARROW.names, (part, full, doc_id, n, [zlib.crc32(ids[i : i + 4 * window]) for i in range(0, cut, 4 * window)], tail, seen[tail], np.frombuffer(ids[cut:], "<u4").astype("<u2" if max_id < 65536 else "<u4").tobytes()), strict=True):
                    cols[k].append(v)
                rows, full = rows + 1, full + n // window
                seen[tail] += 1
                if rows % 500 == 0:
                    yield pa.RecordBatch.from_pydict(cols, schema=ARROW)
                    cols = {k: [] for k in ARROW.names}
            yield pa.RecordBatch.from_pydict(cols, schema=ARROW)

    with open(path, encoding="utf-8") as f:
        max_id = max(json.load(f)["model"]["vocab"].values())
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "part int, full long, doc_id long, n long, crcs array<long>, tail int, rank long, ids binary"), 2 if max_id < 65536 else 4


ARROW = pa.schema([("part", pa.int32()), ("full", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("crcs", pa.list_(pa.int64())), ("tail", pa.int32()), ("rank", pa.int64()), ("ids", pa.binary())])


def combinations(lengths: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Rows (a, b, c) of occurring lengths, a >= b >= c, c or b and c 0, that sum to the window."""
    has = np.zeros(window + 1, bool)
    has[lengths] = True
    a, b = np.meshgrid(np.arange(1, window), np.arange(0, window), indexing="ij")
    c = window - a - b
    ok = has[a] & (b <= a) & (c <= b) & (c >= 0) & (b > 0) & has[np.clip(b, 0, window)] & ((c == 0) | has[np.clip(c, 0, window)])
    return np.column_stack([a[ok], b[ok], c[ok]])


def nnls(combos: np.ndarray, counts: np.ndarray, steps: int = 250) -> np.ndarray:
    """x >= 0 that makes the lengths used by the combinations least squares near to counts: accelerated projected gradient."""
    if not len(combos):
        return np.zeros(0)
    n, real = len(counts), combos > 0

    def use(x):
        return np.bincount(combos.ravel(), np.repeat(x, 3), n) * np.arange(n).astype(bool)

    def back(r):
        return (r[combos] * real).sum(axis=1)

    v = np.ones(len(combos))
    for _ in range(12):
        v = back(use(v))
        norm = np.linalg.norm(v)
        v /= norm
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(steps):
        nxt = np.maximum(0, y - back(use(y) - counts) / (norm * 1.02))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        x, y, t = nxt, nxt + (t - 1) / t2 * (nxt - x), t2
    return x


def plan(counts: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, int]:
    """Segments (length, first rank, first sequence, offset, how many), sorted; for each length the rank from which tails are
    residual and where these begin in the residual stream; the number of sequences of the combinations."""
    left, at, sequence, segments = counts.astype(np.int64).copy(), np.zeros(len(counts), np.int64), 0, []
    combos = combinations(np.flatnonzero(counts), window)
    times = nnls(combos, counts.astype(float))
    for i in np.argsort(-times, kind="stable"):
        if times[i] < 1:
            break
        parts, need = np.unique(combos[i][combos[i] > 0], return_counts=True)
        m = int(min(np.floor(times[i]), (left[parts] // need).min()))
        if m > 0:
            offset = 0
            for length in combos[i][combos[i] > 0]:
                segments.append((length, at[length], sequence, offset, m))
                at[length] += m
                offset += length
            left[parts] -= need * m
            sequence += m
    order = np.arange(len(counts) - 1, 0, -1)
    start = np.zeros(len(counts), np.int64)
    start[order] = np.concatenate([[0], np.cumsum(left[order] * order)[:-1]])
    return np.array(sorted(segments), np.int64).reshape(-1, 5), np.stack([at, start]), sequence


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW) -> DataFrame:
    """One row for each piece of docs (doc_id, text)."""
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark)
    made, width = tokenised(docs, tokenizer_path, window)
    tokens = scratch.table(made, "tokens")
    per_part = tokens.where("tail > 0").groupBy("part", "tail").agg(F.count("*").alias("n"))
    counts = np.zeros(window, np.int64)
    for row in per_part.groupBy("tail").agg(F.sum("n").alias("n")).collect():
        counts[row["tail"]] = row["n"]
    sent = spark.sparkContext.broadcast(plan(counts, window))
    before = per_part.select(F.col("part").alias("_part"), F.col("tail").alias("_tail"), (F.sum("n").over(Window.partitionBy("tail").orderBy("part")) - F.col("n")).alias("before"))
    # whole windows are numbered through all partitions, a row for each of which is sent
    ends = tokens.groupBy("part").agg(F.sum(F.size("crcs")).alias("n"))
    bases = ends.select(F.col("part").alias("_own"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("_base"))
    tokens = tokens.join(F.broadcast(bases), F.col("part") == F.col("_own")).withColumn("full", F.col("full") + F.col("_base"))
    placed = tokens.join(before, (F.col("part") == F.col("_part")) & (F.col("tail") == F.col("_tail")), "left").select("full", "doc_id", "n", "crcs", "tail", (F.col("rank") + F.coalesce("before", F.lit(0))).alias("rank"), "ids")

    def run(batches):
        segments, residual, planned = sent.value
        keys = segments[:, 0] * (1 << 40) + segments[:, 1]
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                doc_id, n, tail = r["doc_id"], r["n"], r["tail"]
                for i, crc in enumerate(r["crcs"]):
                    out.append((doc_id, i * window, window, crc, n, 1 << 62 | r["full"] + i, 0))
                if not tail:
                    continue
                ids = np.frombuffer(r["ids"], f"<u{width}").astype("<u4").tobytes()
                if r["rank"] < residual[0][tail]:
                    s = segments[np.searchsorted(keys, tail * (1 << 40) + r["rank"], "right") - 1]
                    out.append((doc_id, n - tail, tail, zlib.crc32(ids), n, int(s[2] + r["rank"] - s[1]), int(s[3])))
                else:
                    begin = int(residual[1][tail]) + (r["rank"] - int(residual[0][tail])) * tail
                    done = 0
                    while done < tail:
                        step = min(tail - done, window - (begin + done) % window)
                        out.append((doc_id, n - tail + done, step, zlib.crc32(ids[4 * done : 4 * (done + step)]), n, planned + (begin + done) // window, (begin + done) % window))
                        done += step
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 7, [x.split()[0] for x in PIECE.split(", ")])

    return placed.mapInArrow(run, PIECE)
