"""Source divergence, language identification and centroid clustering against brute-force versions."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quizlake.llm import centroids, divergence, language
from quizlake.llm.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def rows():
    made = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    long = " ".join(f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}" for i in range(30_000))
    edges = [(None, None, None), ("", "en", ""), ("!!! 123", "zz", "only"), ("alone here", "yy", "s1"), ("alone here", "yy", "s2"), (long, "en", "src1"), ("É é ÉÉ x-y Z", None, "src1"), ("É é ÉÉ x-y Z", None, None), ("É é ÉÉ x-y Z", "", "src2"), ("die und der", None, "src0"), (" \n\t", "de", "src1")]
    return made + [(90_000 + i, *e) for i, e in enumerate(edges)] + [(90_001, *edges[1]), (None, "one two three", "en", "src1")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "q") for r in rows], "doc_id long, text string, lang string, source string, n long, term int, item string").repartition(3).persist()


def audited(rows, min_docs, top):
    count, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        g = (lang or "", source or "")
        groups.add(g)
        found = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER)))
        count[g].update(found)
        df[g[0]].update(found.keys())
    out = []
    for lang in {x for x, _ in groups}:
        kept, own = [t for t, n in df[lang].items() if n >= min_docs], sorted(s for x, s in groups if x == lang)
        v = len(kept)

        def values(c, kept=kept, v=v):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + v) for t in kept}

        p = {s: values(count[lang, s]) for s in own}
        q = values(sum((count[lang, s] for s in own), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in own:
            pair = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in own if o != s)
            word = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if count[lang, s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, item.decode(), -value, k) for part, found in (("pair", pair), ("term", word)) for k, (value, item) in enumerate(found, 1)]
    return Counter(out)


@pytest.mark.parametrize("min_docs, top", [(3, 200), (1, 5), (10**6, 200)])
def test_divergence(docs, rows, min_docs, top):
    got = divergence.audit(docs, min_docs, top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert Counter(tuple(r) for r in got.collect()) == audited(rows, min_docs, top)


def test_divergence_small_buffers_and_no_broadcast(docs, rows, monkeypatch):
    monkeypatch.setattr(divergence, "BROADCAST", 0)
    assert Counter(tuple(r) for r in divergence.audit(docs).collect()) == audited(rows, 3, 200)


def test_divergence_counts_beyond_longs(spark):
    df = spark.createDataFrame([(4 * 10**17, 10**18, 5), (0, 0, 1), (0, 0, 0)], "n long, total long, kept long")
    got = [r[0] for r in df.select(divergence.probability("n", "total", "kept")).collect()]
    assert got == [1 + 10**9 * (4 * 10**17 + 1) // (10**18 + 5), 1 + 10**9, None]


def plain_model(rows, order, m):
    """context -> successor -> count, per language, without what is rarer than m."""
    out = {}
    for lang, text in rows:
        tree = out.setdefault(lang, defaultdict(Counter))
        for i in range(len(text)):
            for k in range(min(i, order) + 1):
                tree[text[i - k : i]][text[i]] += 1
    return {lang: {c: {b: n for b, n in s.items() if n >= m} for c, s in tree.items()} for lang, tree in out.items()}


def plain_length(tree, text, order):
    bits = 0.0
    for i in range(len(text)):
        for k in range(min(i, order), -1, -1):
            own = tree.get(text[i - k : i])
            if not own:
                continue
            total, kinds = sum(own.values()), len(own)
            if text[i] in own:
                bits -= math.log2(own[text[i]] / (total + kinds))
                break
            bits -= math.log2(kinds / (total + kinds))
        else:
            bits += 8
    return bits


@pytest.mark.parametrize("order, m", [(4, 1), (2, 3), (0, 2)])
def test_code_lengths(order, m):
    table = pq.read_table(f"{SF}/documents.parquet").slice(0, 60)
    texts = [x[:400] for x in language.plain(table.column("text").combine_chunks())]
    tree = plain_model(zip(table.column("lang").to_pylist(), texts, strict=True), order, m)
    langs = sorted(tree)
    kept = [(langs.index(x), (len(c) + 1) << 40 | int.from_bytes(c + bytes([b]), "big"), n) for x in langs for c, s in tree[x].items() for b, n in s.items()]
    model = language.tables(langs, *(np.array(x, k) for x, k in zip(zip(*kept, strict=True), (int, np.uint64, int), strict=True)), order)
    probes = [*texts[:20], b"", b"x", b"\xf0\x9f\x98\x80 zqzq", b"de", b"unknown words here " * 40]
    for size in (1 << 19, 7):
        got = language.lengths(model, probes, size) / language.BITS
        want = np.array([[plain_length(tree[x], p, order) for x in langs] for p in probes])
        assert np.abs(got - want).max() < 0.02


def test_language_counts(spark):
    rows = [("a", "abab ab"), ("a", "ab"), ("b", "zz\nzz 12 x@y"), ("b", "")]
    got = spark.createDataFrame(rows, "lang string, text string").mapInArrow(language._counted(2), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect()
    want = Counter()
    for lang, text in rows:
        text = b" ".join(x.encode() for x in text.split() if not re.search("[0-9@]", x))
        want.update((lang, (k << 40) | int.from_bytes(text[i + 1 - k : i + 1], "big")) for i in range(len(text)) for k in (1, 2, 3) if i + 1 >= k)
    assert {(r.lang, r.gram): r.n for r in got} == dict(want)


def test_language_of_rows(spark, docs, rows):
    got = language.identify(docs).collect()
    key = lambda i: hash(i) if i is None else i
    crc = lambda i: __import__("zlib").crc32(b"" if i is None else str(i).encode())
    assert sorted(map(str, ((r.doc_id, r.held_out) for r in got))) == sorted(map(str, ((i, crc(i) % 4 == 2) for i, *_ in rows)))
    empty = {key(i) for i, t, *_ in rows if not any(c.isalpha() for c in t or "")}
    assert {key(r.doc_id) for r in got if r.lang_pred == "und"} == empty and all(r.score == 0 for r in got if r.lang_pred == "und")
    assert all(0 <= r.score <= 1 for r in got)
    true = {i: (x, t) for i, t, x, _ in rows if i is not None and i < 90_000}
    judged = [r.lang_pred == true[r.doc_id][0] for r in got if r.held_out and r.doc_id in true and len(true[r.doc_id][1]) > 60]
    assert sum(judged) >= 0.95 * len(judged)
    assert {r.lang_pred for r in language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_ignores_labels_of_the_fold(docs):
    one = language.identify(docs).orderBy("doc_id").collect()
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    other = language.identify(docs.withColumn("lang", F.when(crc % 4 == 2, F.lit("qq")).otherwise(F.col("lang")))).orderBy("doc_id").collect()
    assert Counter(one) == Counter(other)


def clustered(rows, k, rounds, dim):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, [max(-centroids.LIMIT, min(centroids.LIMIT, x)) for x in v]) for i, v in kept]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), centroids.packed(np.array([r[1]]))[0]))
    c = [v for _, v in first[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        c = [[sum(col) // len(own) for col in zip(*own, strict=True)] if (own := [v for (_, v), a in zip(kept, at, strict=True) if a == j]) else m for j, m in enumerate(c)]
    last = [near(v) for _, v in kept]
    own = Counter()
    for d, j in last:
        own[j] += d
    return Counter((i, j, d, own[j], sum(own.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, last, strict=True))


def embedded():
    made = [(r["vec_id"], r["embedding"]) for r in pq.read_table(f"{SF}/embeddings.parquet").to_pylist()]
    hot = made[3][1]
    made += [(50_000 + i, hot) for i in range(len(made))]
    return made + [(60_000, None), (60_001, []), (60_002, [0.5] * 63), (60_003, [0.5] * 65), (60_004, [None] + [0.1] * 63), (60_005, [math.nan] + [0.1] * 63), (60_006, [0.1] * 63 + [-math.inf]), (None, [0.25] * 64), (60_007, [-0.001] * 64), (60_007, [-0.001] * 64), (60_007, [1e30] + [-3.0] * 63), (60_008, [70.0, -2.0] * 32), (60_009, [700.0, -1e4] * 32)]


VECTORS = "vec_id long, embedding array<double>, label int, q string, cluster int"


def test_clustering(spark):
    rows = embedded()
    df = spark.createDataFrame([(*r, 1, "q", 2) for r in rows], VECTORS)
    for k, rounds in ((16, 3), (3, 1), (10_000, 0)):
        got = centroids.cluster(df, k, rounds)
        assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
        assert Counter(tuple(r) for r in got.collect()) == clustered(rows, k, rounds, 64)
    assert centroids.cluster(df.limit(0)).collect() == [] == centroids.cluster(df.where("vec_id < 0")).collect()


def test_clustering_without_hot_vectors(spark, monkeypatch):
    monkeypatch.setattr(centroids, "HOT", 1)
    rows = embedded()
    assert Counter(tuple(r) for r in centroids.cluster(spark.createDataFrame([(*r, 1, "q", 2) for r in rows], VECTORS)).collect()) == clustered(rows, 16, 3, 64)


def test_vectors_are_packed_and_distances_exact():
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.integers(-s, s, (40, 8)) for s in (100, 128, 129, 40_000, 1 << 27)] + [np.zeros((1, 8), int), np.full((1, 8), -128), np.full((1, 8), 128)])
    assert (centroids.unpacked(centroids.packed(v), 8) == v).all()
    for c in (v[:5], v[-30:]):
        at, d = centroids.nearest(v, c)
        want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(x, m, strict=True)), j) for j, m in enumerate(c)) for x in v]
        assert [(int(x), int(j)) for x, j in zip(d, at, strict=True)] == want


def test_empty_documents(docs):
    none = docs.limit(0)
    assert divergence.audit(none).count() == 0 == language.identify(none).count()


@pytest.mark.parametrize("name", ["op11_source_divergence", "op13_centroid_clustering"])
def test_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.sql(ORACLE_SQL[name])
    order = want.columns
    assert Counter(tuple(r) for r in QUERIES[name](spark, SF).select(order).collect()) == Counter(want.fetchall())


def test_arrow_views_of_vectors(spark):
    """A batch that is a slice keeps its rows."""
    table = pa.table({"vec_id": pa.array(range(50), pa.int64()), "embedding": pa.array([[float(i)] * 64 for i in range(50)], pa.list_(pa.float32()))})
    df = spark.createDataFrame(table).where("vec_id >= 13")
    assert sorted((r.vec_id, centroids.unpacked([bytes(r.q)], 64)[0, 0]) for r in centroids.vectors(df).collect()) == [(i, 64 * i) for i in range(13, 50)]
