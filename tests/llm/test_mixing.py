import collections

import pytest
from pyspark.sql import functions as F

from lamella.llm import mixing, queries


def water(children, budget):
    """[(weight, capacity)] -> shares, by filling the fullest child first, step by step."""
    share = [0.0] * len(children)
    left, open_ = float(budget), set(range(len(children)))
    while open_:
        total = sum(children[k][0] for k in open_)
        full = {k for k in open_ if children[k][1] <= children[k][0] * left / total}
        if not full:
            for k in open_:
                share[k] = children[k][0] * left / total
            break
        for k in full:
            share[k] = children[k][1]
        left -= sum(children[k][1] for k in full)
        open_ -= full
    return share


def brute_budgets(leaves, total, epochs, weights):
    def go(prefix, budget):
        depth = len(prefix)
        if depth == 3:
            return {prefix: budget}
        kids = sorted({p[: depth + 1] for p in leaves if p[:depth] == prefix})
        caps = [sum(t for p, t in leaves.items() if p[: depth + 1] == k) * epochs for k in kids]
        w = [weights.get(mixing.LEVELS[depth], {}).get(k[-1], 1) for k in kids]
        out = {}
        for k, b in zip(kids, water(list(zip(w, caps, strict=True)), budget), strict=True):
            out |= go(k, int(b + 1e-6))
        return out

    return go((), total)


ROWS = [(i, "w " * (1 + i * 7 % 50), ["en", "de", None][i % 3], f"s{i % 5}" if i % 11 else None) for i in range(400)]


@pytest.mark.parametrize(("share", "epochs"), [(0.5, 2), (1.6, 2), (0.01, 1), (5.0, 2)])
def test_budgets_and_prefixes(spark, share, epochs):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    got = mixing.select(df, budget_share=share, max_epochs=epochs, slice_rows=10).collect()
    leaves = collections.Counter()
    for i, t, lang, s in ROWS:
        s = s or "unknown"
        leaves[s[-1], lang or "unknown", s] += len(t.split())
    total = sum(leaves.values())
    want = brute_budgets(leaves, int(total * share), epochs, mixing.WEIGHTS)
    taken = collections.Counter()
    for r in got:
        taken[r.domain, r.lang, r.source] += r.tokens_taken
        assert 0 < r.tokens_taken <= r.n_tokens and 0 <= r.epoch < epochs
    assert len({(r.doc_id, r.epoch) for r in got}) == len(got)
    for leaf, budget in want.items():
        assert abs(taken[leaf] - budget) <= 3  # the brute force floors at each level
    # not a token of the budget is lost
    assert sum(taken.values()) == min(int(total * share), total * epochs)
    # of each leaf at most one document is taken in part
    assert max(collections.Counter((r.domain, r.lang, r.source) for r in got if r.tokens_taken < r.n_tokens).values(), default=0) <= 1


def test_shortage_stays_among_siblings(spark):
    rows = [(k, "w " * n, lang, s) for k, (n, lang, s) in enumerate([(10, "en", "a1"), (1000, "de", "b1"), (1000, "en", "a2"), (1000, "de", "b2")])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.source: r.tokens_taken for r in mixing.select(df, budget_share=0.1, max_epochs=1, weights={"lang": {"en": 3, "de": 1}}).collect()}
    # domain 1 holds 150 of 301: English can use only 10 of its share, its sibling takes the rest
    assert got == {"a1": 10, "b1": 140, "a2": 113, "b2": 38}
    by_parity = {r.domain: 0 for r in mixing.select(df, domain=F.col("doc_id") % 2).collect()}
    assert sorted(by_parity) == ["0", "1"]


def test_edge_cases(spark):
    schema = "doc_id long, text string, lang string, source string, epoch_ int"
    rows = [(1, "a b", "en", "s1", 0), (1, "a b", "en", "s1", 0), (2, None, None, None, 1), (None, "c d e", None, "", 1)]
    df = spark.createDataFrame(rows, schema)
    got = mixing.select(df, budget_share=1.0, max_epochs=1).collect()
    assert sorted((r.doc_id or 0) for r in got) == [0, 1, 1] and sum(r.tokens_taken for r in got) == 7
    out = mixing.mixed(df, budget_share=1.0, max_epochs=1)
    assert out.columns == [*df.columns, "epoch", "tokens_taken"] and out.count() == 3
    assert mixing.select(df.where("1 = 0")).collect() == []
    assert sorted((r.doc_id or 0, r.text, r.epoch_) for r in out.collect()) == [(0, "c d e", 1), (1, "a b", 0), (1, "a b", 0)]
    clash = df.withColumnRenamed("epoch_", "epoch").selectExpr("*", "1 as tokens_taken", "2 as mix_key", "3 as domain")
    assert mixing.mixed(clash, budget_share=1.0, max_epochs=1).count() == 3
    two = spark.createDataFrame([(1, "a b", "en", "s1"), (1, "c d", "en", "s1")], "doc_id long, text string, lang string, source string")
    assert sorted(r.text for r in mixing.mixed(two, budget_share=1.0, max_epochs=1).collect()) == ["a b", "c d"]


def test_query_against_sql(spark, duck, data):
    cols = sorted(queries.op10_mixing(spark, data).columns)
    got = queries.op10_mixing(spark, data).toPandas()[cols].astype(str).sort_values(cols).reset_index(drop=True)
    want = duck.sql(queries.ORACLES["op10_mixing"]).df()[cols].astype(str).sort_values(cols).reset_index(drop=True)
    assert got.equals(want)
