"""The fitted methods against plain versions of them, and the pipeline's stages on rows with gaps."""

import itertools
import math
import random

import numpy as np
import pytest

import corpus_pipeline
from quizlake.llm import neardup, packing, quality, toxicity
from quizlake.llm.registry import tokenizer_path

SF = "/root/testdata/sf0.001"


def plain_determinant(x: np.ndarray, h: int, tries: int, seed: int = 3) -> float:
    """The least log determinant over concentration steps from random starts, without any floor."""
    rng, best = np.random.default_rng(seed), math.inf
    for _ in range(tries):
        sub = x[rng.choice(len(x), 12, replace=False)]
        for _ in range(40):
            d = np.einsum("ij,jk,ik->i", x - sub.mean(0), np.linalg.pinv(np.cov(sub.T, bias=True)), x - sub.mean(0))
            sub = x[np.argsort(d)[:h]]
        best = min(best, np.linalg.slogdet(np.cov(sub.T, bias=True))[1])
    return best


def test_minimum_determinant(spark):
    rng = np.random.default_rng(7)
    good = rng.normal(size=(160, 4)) @ np.array([[0.5, 0.2, 0, 0], [0, 0.4, 0.1, 0], [0, 0, 0.3, 0], [0, 0, 0, 0.6]])
    bad = rng.normal(size=(40, 4)) * 0.05 + 9.0  # a cluster that draws the classical moments to it
    x = np.vstack([good, bad])
    rows = spark.createDataFrame([("p", *map(float, r)) for r in x], ["pool", *quality.NAMES])
    model = quality.model_of(rows, quality.Scratch(spark))
    assert model.first()["logdet"] <= plain_determinant(x, 150, 40) + 0.15
    far = quality.distances(rows, model).toPandas()
    assert ((far.d2 / quality.CONSISTENCY > quality.CUTOFF).to_numpy() == (far.x_length > 4.5).to_numpy()).all()
    assert abs(quality.chi2_cdf(quality.chi2_quantile(0.95, 4), 4) - 0.95) < 1e-9 and abs(quality.chi2_quantile(0.95, 4) - 9.4877) < 1e-3


def test_minimum_determinant_of_real_texts(spark):
    """The statistics of the table's texts: they vary in every pool, so no floor is met, and no random start does better."""
    scratch = quality.Scratch(spark)
    rows = quality.pooled(quality.transformed(quality.statistics(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")))).where("NOT base_failed").select("pool", *quality.NAMES)
    rows = scratch.table(rows, "rows")
    models, held = {r.pool: r for r in quality.model_of(rows, scratch).collect()}, rows.toPandas()
    assert len(models) >= 4
    for pool, m in models.items():
        own = held[[p == pool for p in held.pool.tolist()]]  # pandas groups strings only up to a zero byte
        if len(own) < quality.MIN_GROUP:
            continue
        x = own[list(quality.NAMES)].to_numpy()
        assert m.n_in >= quality.SHARE * len(x) and all(m[f"l{i}{i}"] > 1.01 * quality.FLOORS[i] for i in range(4))
        least = plain_determinant(x, math.ceil(quality.SHARE * len(x)), 20)
        assert m.logdet <= least + 0.25, (pool, m.logdet, least)
        l = np.array([[m[f"l{i}{j}"] if j <= i else 0.0 for j in range(4)] for i in range(4)])
        z = np.linalg.solve(l, (x - [m[f"m{i}"] for i in range(4)]).T)
        got = quality.distances(spark.createDataFrame(own), spark.createDataFrame([m])).toPandas().d2
        assert np.allclose(sorted(got), sorted((z**2).sum(0)))


def test_a_pool_without_variance(spark):
    rows = spark.createDataFrame([("p", 1.0, 2.0, 3.0, 4.0)] * 80 + [("p", 1.0, 2.0, 3.0, 5.0)], ["pool", *quality.NAMES])
    far = quality.distances(rows, quality.model_of(rows, quality.Scratch(spark))).collect()
    assert [r.d2 / quality.CONSISTENCY > quality.CUTOFF for r in sorted(far, key=lambda r: r.x_distinct)] == [False] * 80 + [True]


def naive_hits(lexicon, exceptions, text):
    """Each place of each term, word by word and substring by substring."""
    edge = lambda i: not (0 <= i < len(text)) or not text[i].isalnum()
    out = []
    for b in range(len(text)):
        if not edge(b - 1):
            continue
        best = None
        for term, weight in lexicon.items():
            plain = term.rstrip("*")
            e = b + len(plain)
            if text.startswith(plain, b) and edge(e) != term.endswith("*") and (best is None or weight > best[2]):
                best = (b, e, weight)
        if best and not any(text.startswith(x, a) and edge(a - 1) and edge(a + len(x)) and a <= b and best[1] <= a + len(x) for x in exceptions for a in range(max(0, b - 40), b + 1)):
            out.append(best)
    return out


def test_automaton_against_naive_matching(spark):
    rng = random.Random(2)
    texts = [toxicity.fold(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    words = sorted({w for t in texts for w in toxicity.WORD.findall(t)})
    for _ in range(8):
        picked = rng.sample(words, 30)
        lexicon = {w: 1.0 + i / 7 for i, w in enumerate(picked[:15])} | {f"{w[:4]}*": 2.0 + i / 5 for i, w in enumerate(picked[15:]) if len(w) > 4}
        pairs = [f"{a} {b}" for t in texts[:10] for a, b in itertools.pairwise(t.split(" ")) if a in lexicon or b in lexicon]
        exceptions = set(rng.sample(pairs, min(3, len(pairs))))
        machine = toxicity.automaton(lexicon, exceptions)
        for text in texts:
            assert toxicity.hits(machine, text[:1500]) == naive_hits(lexicon, exceptions, text[:1500])


def test_term_counts_against_plain_ones(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(50).collect()
    rows = [(0, r.lang, r.doc_id % 2, toxicity.fold(r.text)) for r in docs]
    got = spark.createDataFrame(rows, "half int, lang string, toxic int, text string").mapInArrow(toxicity._counts, "half int, lang string, term string, t long, c long, o long").toPandas().groupby(["lang", "term"])[["t", "c", "o"]].sum()
    want = {}
    for _, lang, toxic, text in rows:
        own = {}
        for w in toxicity.WORD.findall(text):
            for term in [w] + [f"{w[:k]}*" for k in toxicity.PREFIXES if len(w) > k]:
                own[term] = own.get(term, 0) + 1
        for term, n in own.items():
            x = want.setdefault((lang, term), [0, 0, 0])
            x[0] += toxic
            x[1] += 1 - toxic
            x[2] += 0 if toxic else n
    assert {k: list(v) for k, v in zip(got.index, got.values.tolist(), strict=True)} == want


WORDS = ["harrow", "linden", "copper", "meadow", "basket", "lantern", "velvet", "orchard", "saddle", "thimble", "walnut", "cinder"]


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(n))


def test_toxic_terms_planted_in_clean_texts(spark):
    """One to three labelled terms in clean texts of 50 to 5,000 words, some disguised: caught; clean texts left alone."""
    rng = random.Random(11)
    own = ["grobnik", "vulpert"]
    docs, labels = [], []
    for i in range(400):
        text = prose(rng, rng.randint(40, 300)).split()
        toxic = i % 7 == 0
        if toxic:
            for _ in range(rng.randint(2, 5)):
                text.insert(rng.randrange(len(text)), rng.choice(own))
        docs.append((i, " ".join(text), "en"))
        labels.append((i, int(toxic)))
    docs += [(1000 + k, docs[7][1] + f" copy {k}", "en") for k in range(150)]  # copies of a toxic text make none of its words telling
    labels += [(1000 + k, 1) for k in range(150)]
    model = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert set(model["lexicon"]) == set(own)
    new, want = [], []
    for i in range(240):
        text = prose(rng, [50, 300, 1500, 5000][i % 4]).split()
        for _ in range(i % 3 and 1 + i % 3 - (i % 3 == 2)):
            w = rng.choice(own)
            text.insert(rng.randrange(len(text)), w.replace("o", "0").replace("e", "е") if i % 2 else w)
        new.append((i, " ".join(text)))
        want.append(bool(i % 3))
    got = {r.doc_id: r.score >= toxicity.THRESHOLD for r in toxicity.score(spark.createDataFrame(new, "doc_id long, text string"), model).collect()}
    caught = [got[i] for i, w in enumerate(want) if w]
    alone = [not got[i] for i, w in enumerate(want) if not w]
    assert sum(caught) >= 0.9 * len(caught) and sum(alone) >= 0.95 * len(alone)
    assert all(r.score < toxicity.THRESHOLD and r.n_hits == 0 for r in toxicity.score(spark.createDataFrame([(1, None), (2, ""), (3, " \n")], "doc_id long, text string"), model).collect())


@pytest.mark.parametrize("exact", [False, True])
def test_near_duplicates_against_all_pairs(spark, exact):
    """A dense group whose pairs lie around the bound, and exact copies: the components of all pairs."""
    rng = random.Random(5)
    base = [rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(160)]
    texts = []
    for i in range(220):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 5, 7])):
            words[rng.randrange(len(words))] = f"own{i}x{rng.randrange(9)}"
        texts.append(" ".join(words))
    texts += texts[:5] + [None, "", "one two", "one two", "One TWO"]
    rows = list(enumerate(texts))
    sets = {}
    for i, text in rows:
        w = (text or "").lower().split()
        sets[i] = {tuple(w[j : j + 3]) for j in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set()
    label = {i: i for i, _ in rows}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in itertools.combinations(sets, 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((root(i), root(j)))
            label[b] = a
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), exact=exact).collect()}
    assert [i for i in sets if got[i] != root(i)] == []


def test_distinct_keeps_unlike_rows_of_one_id(spark):
    text = lambda k: " ".join(f"{w}{k}" for w in WORDS)
    rows = [(None, text(1), 1), (None, text(2), 2), (7, text(3), 3), (7, text(4), 4), (7, text(3), 5), (8, text(3), 6), (9, None, 7)]
    got = neardup.distinct(spark.createDataFrame(rows, "doc_id long, text string, _mark int")).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == sorted([(0, text(1)), (0, text(2)), (7, text(3)), (7, text(4)), (9, "")])


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_rows_with_gaps(spark, name, stage):
    """Nulls in each column, empty texts, repeats, a long text, clashing names, and no rows at all."""
    kind = "doc_id long, text string, lang string, source string, n_chars long, _bad string, _base string, label string"
    long = " ".join(f"{WORDS[i % 12]}{i % 977}" for i in range(30_000))
    rows = [(1, "plain words here and there", "en", "s", 5, "b", "x", "l"), (2, None, None, None, None, None, None, None), (None, "no id at all in this row", "en", "s", 5, "b", "x", "l"), (3, "", "en", None, 0, "", "", ""), (4, long, "en", "s", 9, "b", "x", "l"), (5, "plain words here", None, "s", 5, "b", "x", "l"), (5, "plain words here", None, "s", 5, "b", "x", "l")]
    docs = spark.createDataFrame(rows, kind)
    out = stage(spark, docs, SF)
    found = out.collect()
    if name == "packing":
        assert {r.doc_id for r in found} == {1, 2, 3, 4, 5, None}
    else:
        assert out.columns == docs.columns and {r.doc_id for r in found} == {1, 2, 3, 4, 5, None}
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_packing_encodes_each_text_in_one_call(monkeypatch):
    """A call for every new word took most of the operator's time."""
    import tiktoken

    encode, calls = packing.encoder(tokenizer_path()), []
    for name in ("encode", "encode_ordinary", "encode_to_numpy"):
        real = getattr(tiktoken.Encoding, name)
        monkeypatch.setattr(tiktoken.Encoding, name, lambda *a, _real=real, **k: calls.append(1) or _real(*a, **k))
    encode(" ".join(f"{WORDS[i % 12]}{i}" for i in range(500)))
    assert len(calls) == 1


def test_packing_ids_are_those_of_the_library():
    """Random texts of blanks of all kinds, marks and scripts; a special token; white space too long for the pattern matcher."""
    from tokenizers import Tokenizer

    encode, library, rng = packing.encoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path()), random.Random(5)
    signs = "ab Z9.'\n\t \r\u00a0\u3000\x1c\x85\u200b\u00e9\u0301\u6771\U0001f642_stdmlverS"
    texts = ["", "<|endoftext|>", "x <|endoftext|> y", "z" * 5000, " " * 2_000_000 + "x", *("".join(rng.choice(signs) for _ in range(rng.randrange(80))) for _ in range(3000))]
    for text in texts:
        assert encode(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
