import pytest

import corpus_pipeline
from lamella.llm import decontaminate, linededup, minhash, mixing, quality
from lamella.llm.common import read


def test_stages(spark, data):
    docs = read(spark, data, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "source_mixing"]
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, data).cache()
        assert after.columns == docs.columns, name
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in before.select("doc_id").collect()} and ids
        before = after
    last = corpus_pipeline.STAGES[-1][1](spark, before, data)
    assert last.columns == [*docs.columns, "epoch", "tokens_taken"]
    assert {r.doc_id for r in last.collect()} <= ids


def brute_pipeline(spark, docs, folder):
    """The pipeline row by row in plain Python; only the fitted quality model is shared."""
    from tests.llm.test_minhash import brute
    from tests.llm.test_passages import brute_clean

    model = quality.fit(docs, read(spark, folder, "labels"))
    rows = {r.doc_id: r.asDict() for r in docs.collect()}
    # rejected by the classifier
    rows = {i: r for i, r in rows.items() if model.score(quality.np.array([quality.doc_vector((r["text"] or "").encode())]))[0] >= 0.5}
    # repeated passages
    cleaned = brute_clean([(i, r["text"]) for i, r in rows.items()])
    kept = {}
    for i, r in rows.items():
        _, removed, text = cleaned[i]
        if removed == 0 or len(text.encode().split()) >= 0.5 * max(1, len(r["text"].encode().split())):
            kept[i] = r | {"text": text, "n_chars": None if text is None else len(text)}
    # one of each group of near copies
    groups = brute([(i, r["text"]) for i, r in kept.items()], 5, 80)
    kept = {i: r for i, r in kept.items() if groups[i][1] == i}
    # test items: every item against every text
    items = [(k, r.text) for k, r in enumerate(read(spark, folder, "benchmark").collect())]
    block = decontaminate.make_block(items)
    for i, r in list(kept.items()):
        ids = decontaminate.numbers(block, r["text"] or "")
        for w in block.items.values():
            if decontaminate.np.isin(w, ids).sum() >= 0.35 * len(w) and decontaminate.align(w, ids)[0] >= 0.35 * decontaminate.MATCH * len(w):
                kept.pop(i)
                break
    return kept


def test_against_brute_force(spark, data):
    """The whole pipeline on the small table: the same documents with the same texts, epochs and tokens."""
    docs = read(spark, data, "documents").where("length(text) < 4000")
    folder = data
    before = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = stage(spark, before, folder).cache()
    want = brute_pipeline(spark, docs, folder)
    assert {r.doc_id: r.asDict() for r in before.collect()} == want
    got = sorted((r.doc_id, r.epoch, r.tokens_taken) for r in corpus_pipeline.STAGES[-1][1](spark, before, folder).collect())
    chosen = spark.createDataFrame([tuple(r.values()) for r in want.values()], docs.schema)
    assert got == sorted((r.doc_id, r.epoch, r.tokens_taken) for r in mixing.select(chosen).collect()) and got


ODD = "doc_id long, text string, lang string, source string, n_chars long, score double, epoch string"
LONG = " ".join(f"word{i} goes on." for i in range(30_000))


@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_rows(spark, data, stage):
    """Nulls in every column, empty and very long texts, repeated rows and ids, clashing names."""
    f = dict(corpus_pipeline.STAGES)[stage]
    plain = read(spark, data, "documents").where("doc_id < 30").selectExpr("doc_id", "text", "lang", "source", "n_chars", "0.5D as score", "'e' as epoch")
    rows = [(None, None, None, None, None, None, None), (1001, "", "en", "s1", 0, 1.0, "x"), (1002, LONG, "en", "s1", len(LONG), 1.0, "x"), (1003, None, "en", "s1", None, 1.0, "x"), (1004, "one two three", None, "s2", 13, 0.0, "y"), (1004, "one two three", None, "s2", 13, 0.0, "y"), (1004, "other words here", None, "s2", 13, 0.0, "y"), (None, "no id at all", "en", None, 12, None, None)]
    docs = plain.unionByName(spark.createDataFrame(rows, ODD))
    out = f(spark, docs, data)
    if stage != "source_mixing":
        assert out.columns == docs.columns
    else:
        assert out.columns == [c for c in docs.columns if c != "epoch"] + ["epoch", "tokens_taken"]
    ids = {r.doc_id for r in out.collect()}
    assert ids <= {r.doc_id for r in docs.collect()}
    if stage in ("line_dedup", "minhash_near_dedup", "benchmark_decontamination"):
        assert {None, 1001, 1002, 1003, 1004} <= ids
    empty = f(spark, docs.where("1 = 0"), data)
    assert empty.columns == out.columns and empty.collect() == []


def test_empty_tables(spark, data, tmp_path):
    """The pipeline and each query on tables without rows."""
    from lamella.llm import queries

    for t in ("documents", "labels", "benchmark", "pages"):
        read(spark, data, t).where("1 = 0").write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    for f in queries.QUERIES.values():
        assert f(spark, str(tmp_path)).collect() == []
    assert linededup.keep(read(spark, str(tmp_path), "documents")).count() == minhash.keep(read(spark, str(tmp_path), "documents")).count() == 0
