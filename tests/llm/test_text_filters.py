"""Quality classifier, quality rules, toxicity and language ID: held-out accuracy and exact counts."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lamella.llm import langid, quality, rules, toxicity
from lamella.llm.common import read

BIG = "/root/testdata/sf0.01"


def auc(y, s):
    y, s = np.array(y), np.array(s)
    pos, neg = s[y == 1], s[y == 0]
    return (np.sign(pos[:, None] - neg[None, :]).mean() + 1) / 2


def edge(spark):
    rows = [(1, "", "en"), (2, None, None), (None, "x", "en"), (3, "a b " * 200_000, None), (3, "a b " * 200_000, None), (4, "123 !!", "en")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as score", "'k' as y")


@pytest.fixture(scope="module")
def tables(spark):
    return read(spark, BIG, "documents"), read(spark, BIG, "labels")


def test_quality(spark, tables):
    docs, labels = tables
    model = quality.fit(docs, labels)
    got = quality.apply(docs, model).join(labels, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert auc([r.quality for r in held], [r.score for r in held]) > 0.95
    out = quality.apply(edge(spark), model).collect()
    assert len(out) == 6 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    kept = quality.keep(docs, model)
    assert kept.columns == docs.columns and kept.count() == quality.apply(docs, model).where("score >= 0.5").count()


def test_quality_without_labels(spark, tables):
    docs, labels = tables
    model = quality.fit(docs, labels.where("1 = 0"))
    assert {r.score for r in quality.apply(docs.limit(5), model).collect()} == {0.5}
    assert quality.apply(docs.where("1 = 0"), model).collect() == []


def brute_isotonic(y, w):
    """The rising fit by its min-max formula: max over starts of min over ends of weighted means."""
    mean = lambda a, b: sum(y[a:b]) / sum(w[a:b])
    return [max(min(mean(a, b) for b in range(i + 1, len(y) + 1)) for a in range(i + 1)) for i in range(len(y))]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(1, 20)), min_size=1, max_size=20))
def test_isotonic(cells):
    n = np.array([c[1] for c in cells], float)
    t = np.array([min(c) for c in cells], float)
    x, level = quality.isotonic(np.arange(len(n)) / 10, t, n)
    assert (np.diff(x) > 0).all()
    want = brute_isotonic(t.tolist(), n.tolist())
    # blocks are the runs of equal fitted values; their smoothed means come back
    runs, at = [], 0
    for k in range(1, len(n) + 1):
        if k == len(n) or abs(want[k] - want[k - 1]) > 1e-12:
            runs.append((at, k))
            at = k
    assert len(x) == len(runs)
    for (a, b), centre, value in zip(runs, x, level, strict=True):
        assert np.isclose(centre, np.average(np.arange(a, b) / 10, weights=n[a:b])) and np.isclose(value, (t[a:b].sum() + 0.5) / (n[a:b].sum() + 1))


def test_ridge_fit_is_exact(spark, tables):
    """Weights from partition sums equal those from the whole matrix in one piece."""
    docs, labels = tables
    model = quality.fit(docs, labels)
    y = {r.doc_id: r.quality for r in labels.collect()}
    import pyspark.sql.functions as F

    rows = docs.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(5))).collect()
    rows = [r for r in rows if r.doc_id in y and zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    x = np.array([quality.doc_vector((r.text or "").encode()) for r in rows])
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, x.std(0) + 1e-6)
    fit = [r.fold != 0 for r in rows]
    z, t = model.features(x[fit]), np.array([y[r.doc_id] for r in rows], float)[fit]
    assert np.allclose(model.weight, np.linalg.solve(z.T @ z + 1e-2 * np.eye(z.shape[1]), z.T @ t), atol=1e-6)


@pytest.mark.parametrize("one", [0, 1])
def test_one_class_only(spark, tables, one):
    docs, labels = tables
    some = labels.where("doc_id < 200")
    model = quality.fit(docs, some.withColumn("quality", some.quality * 0 + one))
    assert all((r.score >= 0.5) == bool(one) for r in quality.apply(docs.limit(20), model).collect())
    mil = toxicity.fit(docs, some.withColumn("toxic", some.toxic * 0 + one))
    assert {r.score for r in toxicity.apply(docs.limit(20), mil).collect()} == {float(one)}
    assert rules.fit(docs, some.withColumn("quality", some.quality * 0 + one)) == []


def test_noisy_or_by_hand():
    """A document's score is one minus the product over sentences, each a logistic of its evidence."""
    model = toxicity.Model({"bad": 2.0, "^wors": 1.5, "good": -1.0}, -1.0, 0.1)
    sig = lambda v: 1 / (1 + np.exp(-v))
    score, n, a, b, worst = model.document("Bad words. nothing here! worse bad good\nBAD bad")
    parts = [sig(-1 + 2), sig(-1 + 1.5 + 2 - 1), sig(-1 + 4)]
    assert np.isclose(score, 1 - 0.9 * np.prod([1 - p for p in parts])) and n == sum(p > 0.5 for p in parts)
    assert np.isclose(worst, parts[2]) and (a, b) == (40, 47)
    assert model.document("") == (0.1, 0, -1, -1, 0.0)


def test_gradient_of_the_bags():
    """One Adam step from the start moves each weight against the numeric gradient of the noisy-or loss."""
    rng = np.random.default_rng(3)
    label = rng.integers(0, 2, 30)
    sent_doc = np.sort(rng.integers(0, 30, 60))
    pair_sent, pair_feat = rng.integers(0, 60, 150), rng.integers(0, 5, 150)

    def loss(theta):
        p = 1 / (1 + np.exp(-(np.bincount(pair_sent, theta[pair_feat], 60) + theta[5])))
        clean = np.bincount(sent_doc, np.log1p(-p), 30) + np.log1p(-1 / (1 + np.exp(-theta[6])))
        return np.where(label == 1, -np.log(1 - np.exp(clean)), -clean).mean()

    start = np.append(np.ones(5), [-1.0, np.log(0.05 / 0.95)])
    numeric = np.array([(loss(start + e) - loss(start - e)) / 2e-6 for e in np.eye(7) * 1e-6])
    w, bias, leak = toxicity._descend(label, sent_doc, pair_sent, pair_feat, 5, steps=1, rate=0.05, decay=0.0)
    moved = np.append(w, [bias, np.log(leak / (1 - leak))]) - start
    assert np.allclose(np.sign(moved), -np.sign(numeric)) and np.allclose(np.abs(moved), 0.05, atol=1e-4)
    w, bias, leak = toxicity._descend(label, sent_doc, pair_sent, pair_feat, 5, steps=400, rate=0.05, decay=0.0)
    assert loss(np.append(w, [bias, np.log(leak / (1 - leak))])) < loss(start)


def brute_repeats(words, w=8):
    seen = {}
    for i in range(len(words) - w + 1):
        seen.setdefault(tuple(words[i : i + w]), []).append(i)
    return len({k for v in seen.values() if len(v) > 1 for i in v for k in range(i, i + w)})


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=60), st.integers(0, 3))
def test_repeat_words(words, copies):
    words = words + words[:12] * copies
    assert rules.text_stats(" ".join(words).encode())[4] == brute_repeats(words)


def test_rule_counts():
    t = "é b\tc\x0bd\n\n x#$|\na b\n x#$|\n\x1ca"
    s = dict(zip(rules.STATS, rules.text_stats(t.encode()), strict=True))
    assert (s["n_words"], s["word_chars"], s["n_symbols"], s["n_dup_lines"], s["n_lines"]) == (9, 4 + 4 + 2 + 4 + 2, 6, 1, 5)
    assert rules.text_stats(b"")[:5] == (0, 0, 0, 0, 0)


def test_rules(spark, tables):
    docs, labels = tables
    learned = rules.fit(docs, labels)
    got = rules.apply(docs, learned).join(labels, "doc_id").collect()
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) for r in got)
    rest = [r for r in got if not r.base_failed]
    assert np.mean([r.kept == bool(r.quality) for r in rest]) > 0.97
    assert rules.fit(docs, labels.where("1 = 0")) == []
    out = {(r.doc_id, r.n_words, r.kept) for r in rules.apply(edge(spark), learned).collect()}
    assert (1, 0, False) in out and (2, 0, False) in out and (3, 400_000, False) in out


def test_rule_learner():
    rng = np.random.default_rng(0)
    x = {k: rng.random(900) for k in rules.FEATURES}
    bad = (x["n_words"] > 0.6) & (x["repeat_share"] <= 0.5) | (x["stops_per_word"] > 0.9)
    found = rules.learn(x, bad)
    assert ((~rules.decide(found, x)[0]) == bad).mean() > 0.97 and any("reject if" in str(r) for r in found)
    for one in (np.ones(900, bool), np.zeros(900, bool), np.zeros(0, bool)):
        assert rules.learn({k: v[: len(one)] for k, v in x.items()}, one) == []
    # an exception inside a region of bad rows needs a rule of the other class in front
    bad = (x["n_words"] > 0.3) & ~((x["n_words"] > 0.6) & (x["n_words"] <= 0.8))
    found = rules.learn(x, bad)
    assert {r.kept for r in found} == {True, False} and ((~rules.decide(found, x)[0]) == bad).mean() > 0.95


def brute_counts(text):
    """The five counts of the contract, by definition."""
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), brute_repeats(words)


def test_rules_row_by_row(spark, tables):
    """Every column of the query on a whole table: counts by definition, the verdict rule by rule."""
    from lamella.llm import queries

    small = "/root/testdata/sf0.001"
    learned = rules.fit(read(spark, small, "documents"), read(spark, small, "labels"))
    texts = {r.doc_id: r.text for r in read(spark, small, "documents").collect()}
    got = queries.op5_quality_rules(spark, small).collect()
    assert len(got) == len(texts)
    names = list(rules.FEATURES)
    for r in got:
        t = texts[r.doc_id]
        n, *rest = brute_counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, *rest)
        failed = n < 20 or 100 * rest[3] > 30 * n
        words = (t or "").split()
        lines = [x for x in (t or "").split("\n") if x.strip()]
        values = [float(n), rest[0] / max(n, 1), rest[1] / max(n, 1), rest[2] / max(len(lines), 1), rest[3] / max(n, 1), n / max(len(lines), 1), sum((t or "").count(c) for c in ".!?") / max(n, 1), sum((t or "").count(c) for c in "0123456789") / max(n, 1), len(set(words)) / max(n, 1)]
        row = dict(zip(names, values, strict=True))
        keep, which = True, 0
        for i, rule in enumerate(learned, 1):
            if all(row[c.feature] > c.threshold if c.above else row[c.feature] <= c.threshold for c in rule.conditions):
                keep, which = rule.kept, i
                break
        assert (r.base_failed, r.kept, r.rule) == (failed, not failed and keep, which)
    assert rules.apply(read(spark, small, "documents").where("1 = 0"), learned).collect() == []


def test_toxicity(spark, tables):
    docs, labels = tables
    big = read(spark, "/root/testdata/sf0.1", "documents"), read(spark, "/root/testdata/sf0.1", "labels")
    model = toxicity.fit(*big)
    got = toxicity.apply(big[0], model).join(big[1], "doc_id").where("held_out").collect()
    assert auc([r.toxic for r in got], [r.score for r in got]) > 0.93
    bad = "Fine words here. You are a stupid worthless idiot. More words."
    score, n, a, b, worst = model.document(bad)
    assert score > 0.9 and n == 1 and bad[a:b].strip() == "You are a stupid worthless idiot" and worst > 0.9
    out = toxicity.apply(edge(spark), model).collect()
    assert len(out) == 6 and all(r.score == model.leak and r.worst_start == -1 for r in out)
    none = toxicity.fit(docs, labels.where("1 = 0"))
    assert {r.score for r in toxicity.apply(docs.limit(3), none).collect()} == {0.0}


def test_toxicity_offsets_survive_lower_casing():
    model = toxicity.Model({"scum": 9.0}, -2.0, 0.0)
    t = "İİ fine. İ such scum! x"
    _, _, a, b, _ = model.document(t)
    assert t[a:b] == " İ such scum"


def brute_bits(counts, text, kept):
    """Code length by walking contexts for one language's gram counts; of the longest ones only those ``kept``."""
    tables = [{} for _ in range(langid.ORDER + 1)]
    for g, n in counts.items():
        bs = g.to_bytes(4, "big")
        for o in range(langid.ORDER + (g >> 8 in kept)):
            c = tables[o].setdefault(bs[langid.ORDER - o : langid.ORDER], {})
            c[bs[-1]] = c.get(bs[-1], 0) + n
    whole, total = b"\n" * langid.ORDER + text, 0.0
    for i in range(langid.ORDER, len(whole)):
        for o in range(langid.ORDER, -1, -1):
            c = tables[o].get(whole[i - o : i])
            if c is None:
                continue
            n, q = sum(c.values()), len(c)
            if whole[i] in c:
                total -= np.log2(c[whole[i]] / (n + q))
                break
            total -= np.log2(q / (n + q))
        else:
            total += 8
    return total


def pruned(counts, most):
    """Of all languages' grams those whose three-byte context is among the ``most`` most frequent."""
    weight = {}
    for c in counts.values():
        for g, n in c.items():
            weight[g >> 8] = weight.get(g >> 8, 0) + n
    return set(sorted(weight, key=lambda c: (-weight[c], c))[:most])


@pytest.mark.parametrize("most", [60_000, 20, 1])
def test_code_lengths_are_exact(most):
    train = {"aa": b"the cat sat on the mat, the end" * 3, "bb": "der Hund läuft über die Straße".encode() * 2}
    counts = {}
    for k, t in train.items():
        g, n = np.unique(langid.grams(langid.padded(t)), return_counts=True)
        counts[k] = (g, n.astype(float))
    model = langid.build(counts, most_nodes=most)
    plain = {k: dict(zip(g.tolist(), n.tolist(), strict=True)) for k, (g, n) in counts.items()}
    kept = pruned(plain, most)
    for text in (b"the dog", "über the ende".encode(), b"\xff\xfe zz", b"", b"the cat " * 4000):
        want = [brute_bits(plain[k], text, kept) for k in model.langs]
        assert np.allclose(model.bits(text), want, rtol=1e-5, atol=1e-4)


def test_language(spark, tables):
    docs, _ = tables
    model = langid.fit(docs)
    got = langid.apply(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    out = sorted((r.doc_id or 0, r.lang_pred, r.score) for r in langid.apply(edge(spark), model).collect())
    assert [x[1] for x in out if x[0] in (1, 2, 4)] == ["und"] * 3 and out[0][1] in model.langs
    assert all(0 <= x[2] <= 1 for x in out)
    none = langid.fit(docs.selectExpr("doc_id", "text", "cast(null as string) lang"))
    assert {r.lang_pred for r in langid.apply(docs.limit(3), none).collect()} == {"und"}


def test_numerals_are_no_letters():
    model = langid.build({"aa": (np.array([0x61626364], np.uint32), np.ones(1))})
    assert [model.document(t)[0] for t in ("½ ² 123", "①②③", "_ - ٣", "x", "①é")] == ["und"] * 3 + ["aa"] * 2


def test_many_languages_stay_small():
    """A hundred languages over all bytes: memory follows the pairs seen."""
    rng = np.random.default_rng(1)
    counts = {}
    for k in range(100):
        g, n = np.unique(langid.grams(rng.integers(0, 256, 3000).astype(np.uint8)), return_counts=True)
        counts[f"x{k:02}"] = (g, n.astype(float))
    model = langid.build(counts, most_nodes=20_000)
    assert sum(x.cost.nbytes + x.escape.nbytes for x in model.levels) < 200e6
    text = bytes(rng.integers(0, 256, 500).astype(np.uint8))
    plain = {k: dict(zip(g.tolist(), n.tolist(), strict=True)) for k, (g, n) in counts.items()}
    kept = pruned(plain, 20_000)
    assert np.allclose(model.bits(text)[:5], [brute_bits(plain[f"x{k:02}"], text, kept) for k in range(5)], rtol=1e-5)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=300, unique=True), st.lists(st.integers(0, 2**32 - 1), max_size=30))
def test_index(keys, others):
    index = langid.Index(np.array(keys, np.uint32))
    wanted = np.array(keys + others, np.uint32)
    assert index.find(wanted).tolist() == [keys.index(k) if k in keys else -1 for k in wanted.tolist()]


def test_no_language_is_missing(spark):
    """A sample smaller than any text still has one text of each language."""
    rows = [(i, x, t) for i, (x, t) in enumerate([("aa", "abab cdcd " * 50), ("bb", "xyxy zwzw " * 50), ("cc", "mnmn opop " * 50)] * 8)] + [(100 + i, "aa", "") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = langid.fit(docs, chars=1)
    assert {(r.lang, r.lang_pred) for r in langid.apply(docs, model).join(docs.where("text <> ''"), "doc_id").select("lang", "lang_pred").collect()} == {("aa", "aa"), ("bb", "bb"), ("cc", "cc")}
