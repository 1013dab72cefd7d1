"""Components against brute force over all pairs."""

import random

import numpy as np
import pytest

from lamella.llm import minhash, queries

VOCAB = [f"w{i}" for i in range(300)]


def brute(rows, size, percent):
    """(doc_id, n_shingles, component) for rows of distinct ids."""
    sets = {i: minhash.shingles_of(minhash.words_of((t or "").encode()), size) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), root(i)) for i in sets}


def corpus(seed):
    rng = random.Random(seed)
    out = []
    for _ in range(12):
        base = [rng.choice(VOCAB) for _ in range(rng.choice([3, 8, 40, 120]))]
        out.append(base)
        for _ in range(rng.randint(0, 9)):
            copy = list(out[-1] if rng.random() < 0.5 else base)
            for _ in range(rng.randint(0, max(1, len(copy) // 12))):
                copy[rng.randrange(len(copy))] = rng.choice(VOCAB)
            out.append(copy)
    texts = [" ".join(w) for w in out] + ["", None, "one", "ONE", "é É", " \t\n"]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("seed", "size", "percent"), [(1, 2, 80), (2, 5, 80), (3, 2, 80)])
def test_against_all_pairs(spark, seed, size, percent):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.classes(df, size=size, percent=percent).collect()}
    assert got == brute(rows, size, percent)


def test_chain_and_large_group(spark):
    """A chain of small edits stays one component although its ends differ; a large group too."""
    rng = random.Random(4)
    words = [rng.choice(VOCAB) for _ in range(200)]
    rows = []
    for i in range(60):
        words = list(words)
        words[i * 3] = f"new{i}"
        rows.append((i, " ".join(words)))
    base = [rng.choice(VOCAB) for _ in range(100)]
    for i in range(60, 200):
        copy = list(base)
        copy[rng.randrange(100)] = f"z{i}"
        rows.append((i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.classes(df).collect()}
    assert got == {i: c for i, (_, c) in brute(rows, 2, 80).items()}


def test_hub_misses_are_found(spark, monkeypatch):
    """Buckets whose hub is unlike their members still give all links."""
    monkeypatch.setattr(minhash, "HUB_TURNS", 1)
    rng = random.Random(9)
    shared = [rng.choice(VOCAB) for _ in range(60)]
    rows = []
    for g in range(6):
        own = [rng.choice(VOCAB) for _ in range(40)]
        for _ in range(5):
            copy = shared + list(own)
            copy[60 + rng.randrange(40)] = rng.choice(VOCAB)
            rows.append((len(rows), " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.classes(df).collect()}
    assert got == {i: c for i, (_, c) in brute(rows, 2, 80).items()}


@pytest.mark.parametrize("switch", [{"LOCAL_LINKS": 0}, {"BROADCAST_IDS": 0}, {"HUB_WORTH": 0}, {"HUB_TURNS": 0}, {"HUB_WORTH": 10**9, "LOCAL_LINKS": 0, "BROADCAST_IDS": 0}])
def test_every_way_gives_the_same(spark, monkeypatch, switch):
    for k, v in switch.items():
        monkeypatch.setattr(minhash, k, v)
    rows = corpus(11)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.classes(df).collect()}
    assert got == brute(rows, 2, 80)


def test_ids_with_several_texts(spark):
    """Each row goes by its own text, whichever classes share their smallest id."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    near = b.replace("b7 ", "zz ")
    rows = [(5, a), (5, b), (9, b), (7, near), (6, c), (6, a), (5, ""), (5, a), (8, a + " more"), (4, c), (4, "other words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as t", "1 as label")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in minhash.classes(df).collect())
    want = brute(list(enumerate(t for _, t in rows)), 2, 80)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[want[k][1]] = min(i, least.get(want[k][1], i))
    assert got == sorted((i, want[k][0], least[want[k][1]] if want[k][0] else i) for k, (i, _) in enumerate(rows))
    kept = minhash.keep(df, size=2)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(5, a), (5, b), (5, ""), (4, c), (4, "other words")])


def test_very_long_texts(spark):
    rng = random.Random(2)
    long = [rng.choice(VOCAB) + str(rng.randrange(50)) for _ in range(60_000)]
    other = list(long)
    for k in range(0, 60_000, 30):
        other[k] = "edit"
    rows = [(1, " ".join(long)), (2, " ".join(other)), (3, " ".join(long[:40_000])), (4, "x" * 500_000)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows, 2, 80)


def test_values_agree_as_often_as_sets(spark):
    """Both minima and maxima estimate the similarity without bias."""
    rng = np.random.default_rng(0)
    h = minhash.Hasher(2)
    close = []
    for _ in range(40):
        x = rng.integers(0, 1 << 63, 500, np.uint64) * np.uint64(2)
        y = np.concatenate([x[:400], rng.integers(0, 1 << 63, 100, np.uint64)])
        keys = [h.bands(np.unique(v))[1] for v in (x, y)]
        nibbles = [k.view(np.uint8) for k in keys]
        same = [(a & m) == (b & m) for a, b in (nibbles,) for m in (15, 240)]
        close.append(np.mean(same))
    assert abs(np.mean(close) - (400 / 600 + 200 / 600 / 16)) < 0.03


def test_edge_cases(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (None, "a b c", "x"), (2, "A  B\tc", "y"), (3, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in minhash.classes(df).collect())
    assert got == [(0, 2, 0, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True)]
    kept = minhash.keep(df, size=2)
    assert kept.columns == df.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3]
    assert minhash.classes(df.where("1 = 0")).collect() == []


def test_query_against_sql(spark, duck, data):
    got = queries.op9_minhash_dedup(spark, data).toPandas().sort_values("doc_id").reset_index(drop=True)
    want = duck.sql(queries.ORACLES["op9_minhash_dedup"]).df().sort_values("doc_id").reset_index(drop=True)
    assert got[want.columns].astype(str).equals(want.astype(str))
