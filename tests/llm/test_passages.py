"""Line dedup and decontamination."""

import random

import numpy as np
import pytest

from lamella.llm import decontaminate as D
from lamella.llm import linededup as L

WORDS = [f"w{i}" for i in range(800)]


def sentence(rng, n=7):
    return " ".join(rng.choice(WORDS) for _ in range(n)) + "."


def test_lines_join_to_the_text():
    rng = random.Random(0)
    for t in ("", "\n\n", "a\n\nb", "x", " ".join(sentence(rng) for _ in range(9)) + "\n\nend", "a,b;c.d! " * 40):
        assert b"".join(L.lines_of(t.encode())) == t.encode()


def test_boundaries_resist_shifts():
    """Lines put in front move no chunk that doesn't touch them."""
    rng = random.Random(1)
    lines = [sentence(rng).encode() + b"\n" for _ in range(60)]
    a = {(h, n) for h, p, n in L.chunks(lines) if p >= 4}
    b = {(h, n) for h, _, n in L.chunks([b"new line one.\n", b"other.\n", *lines])}
    assert a <= b


def brute_units(rows):
    """How often each line occurs in other texts."""
    seen = {}
    for i, t in rows:
        for x in {x.strip() for x in L.lines_of(t.encode())}:
            seen.setdefault(x, set()).add(i)
    return seen


def test_repeated_passages_go(spark):
    rng = random.Random(2)
    passage = " ".join(sentence(rng) for _ in range(10))
    block = "\n".join(sentence(rng, 9) for _ in range(8))
    rows = []
    for i in range(40):
        parts = [sentence(rng, 12) for _ in range(6)]
        if i % 2 == 0:
            parts.insert(3, passage)
        if i % 3 == 0:
            parts.insert(1, block)
        rows.append((i, "\n".join(parts)))
    got = {r.doc_id: r for r in L.clean(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    seen = brute_units(rows)
    for i, t in rows:
        left = {x.strip() for x in L.lines_of((got[i].text or "").encode())}
        own = {x.strip() for x in L.lines_of(t.encode()) if len(seen[x.strip()]) == 1}
        assert own <= left  # what occurs once stays
        kept = [x for x in L.lines_of(t.encode())]
        assert got[i].lamella_lines == len(kept)
        assert len(left) + got[i].lamella_removed >= len(set(kept))
    assert sum(passage in r.text for r in got.values()) == sum(block in r.text for r in got.values()) == 1
    removed = sum(r.lamella_removed for r in got.values())
    want = 19 * len(L.lines_of(passage.encode())) + 13 * 8
    assert removed >= 0.9 * want


def test_repeats_within_one_text(spark):
    rng = random.Random(3)
    block = "\n".join(sentence(rng, 9) for _ in range(8)) + "\n"
    text = "start here now.\n" + block + "between these two.\n" + block + "end."
    r = L.clean(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.text.count(block) == 1 and r.text.startswith("start here now.\n") and r.text.endswith("end.")


def copies_kept(spark, passages, copies, rng):
    """How many of the copies of each passage, each in a text of its own lines, keep any line."""
    rows, marks = [], {}
    for k, lines in enumerate(passages):
        for _ in range(copies):
            around = [sentence(rng, 12) + f" u{rng.random()}" for _ in range(6)]
            marks[len(rows)] = k
            rows.append((len(rows), "\n".join(around[:3] + lines + around[3:])))
    kept = [0] * len(passages)
    for r in L.clean(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect():
        left = set(r.text.split("\n"))
        kept[marks[r.doc_id]] += bool(left & set(passages[marks[r.doc_id]]))
        assert r.lamella_lines - r.lamella_removed >= 6
    return kept


@pytest.mark.parametrize("units", [2, 3, 4, 5, 6])
def test_short_passages_go(spark, units):
    rng = random.Random(10 + units)
    passages = [[sentence(rng, 60 // units).rstrip(".") for _ in range(units)] for _ in range(40)]
    assert copies_kept(spark, passages, 2, rng) == [1] * 40
    assert copies_kept(spark, passages[:5], 20, rng) == [1] * 5


def test_long_passages_of_short_lines_go(spark):
    rng = random.Random(20)
    passages = [[sentence(rng, 2).rstrip(".") + f"p{k}" for _ in range(60)] for k in range(20)]
    assert copies_kept(spark, passages, 2, rng) == [1] * 20


def test_middle_copies_lose_their_edges(spark):
    """Of three copies in different surroundings the second and third lose every line."""
    rng = random.Random(21)
    passages = [[sentence(rng, 9).rstrip(".") for _ in range(8)] for _ in range(60)]
    assert copies_kept(spark, passages, 3, rng) == [1] * 60


def test_line_edge_cases(spark):
    rng = random.Random(4)
    body = "\n".join(sentence(rng, 9) for _ in range(8))
    rows = [(1, body, "a"), (1, body, "a"), (2, body, "b"), (None, "x", "c"), (3, None, "d"), (4, "", "e"), (5, "one line only", "f"), (6, "one line only", "g"), (5, "other text of five", "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, pos string").selectExpr("*", "'k' as lang", "1L as n")
    got = {(r.pos, r.text) for r in L.clean(df).collect()}
    assert {("c", "x"), ("d", None), ("e", ""), ("f", "one line only"), ("g", "one line only"), ("h", "other text of five")} <= got
    assert L.keep(df).columns == df.columns
    left = {r.pos for r in L.keep(df).collect() if r.text == body}
    assert left in ({"a"}, {"b"})
    assert L.clean(df.where("1 = 0")).collect() == []


def test_scraps_go(spark):
    """A near copy of which a few words are left is no document; one that keeps most of its words is."""
    rng = random.Random(30)
    base = [sentence(rng, 9) for _ in range(20)]
    edited = [x if k % 7 else sentence(rng, 9) for k, x in enumerate(base)]
    own = [sentence(rng, 9) for _ in range(20)] + base[3:8]
    rows = [(1, "\n".join(base)), (2, "\n".join(edited)), (3, "\n".join(own)), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in L.keep(df).collect() if r.doc_id < 4) == [(1, "\n".join(base)), (3, "\n".join(own[:20]) + "\n")]
    assert sorted(r.doc_id for r in L.keep(df).collect()) == [1, 3, 4, 5]
    assert sorted(r.doc_id for r in L.keep(df, least_left=0.0).collect()) == [1, 2, 3, 4, 5]


def brute_clean(rows):
    """(lines, removed lines, text) of rows with distinct ids, by comparing every chunk with all before it."""
    seen, gone = {}, {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        lines = [x.rstrip(b" \t\r\n") for x in L.lines_of((t or "").encode())]
        words = [len(x.lstrip().split(b" ")) if x else 0 for x in lines]
        found = set()
        for a in range(len(lines)):
            e = next((e for e in range(a + L.LEAST_LINES, len(lines) + 1) if sum(words[a:e]) >= L.LEAST_WORDS), None)
            found |= {(a, e)} if e else set()
        for e in set(range(len(lines) + 1)) - {e for _, e in found}:
            a = next((a for a in range(e - L.LEAST_LINES, -1, -1) if sum(words[a:e]) >= L.LEAST_WORDS), None)
            found |= {(a, e)} if a is not None else set()
        for a, e in sorted(found):
            d, s = seen.setdefault(tuple(lines[a:e]), (i, a))
            if (d, s) != (i, a):
                gone.setdefault(i, set()).update(range(max(a, s + e - a) if d == i else a, e))
    out = {}
    for i, t in rows:
        lines = L.lines_of((t or "").encode())
        drop = gone.get(i, set())
        out[i] = (len(lines), len(drop), None if t is None else b"".join(x for k, x in enumerate(lines) if k not in drop).decode())
    return out


@pytest.mark.parametrize("seed", range(2))
def test_against_every_pair(spark, seed):
    """Short, blank, indented, repeated and clause-cut lines; both ways to reach the texts."""
    rng = random.Random(100 + seed)
    pool = [sentence(rng, rng.choice([1, 1, 2, 4, 9])) for _ in range(25)] + ["", "", " ", "a", "\tb", "  indented here", "indented here"]
    pool += [" ".join(sentence(rng, 6) for _ in range(5))]
    rows = [(None, "\n".join(rng.choice(pool) for _ in range(12)))] + [(k, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 14))) + rng.choice(["", "\n", "\r\n"])) for k in range(60)]
    rows += [(60, None), (61, rows[3][1]), (62, "same two\n" * 30), (63, "é" * 5 + " word" * 3000 + "\nx y z")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_clean(rows)
    for bounds in ({}, {"broadcast_rows": 0}, {"broadcast_spans": 0}) if seed == 0 else ({},):
        got = {r.doc_id: (r.lamella_lines, r.lamella_removed, r.text) for r in L.clean(df, **bounds).collect()}
        assert got == want


def test_line_query_against_sql(spark, duck, data):
    from lamella.llm import queries

    got = queries.op2_line_dedup(spark, data).toPandas().sort_values("doc_id").reset_index(drop=True)
    want = duck.sql(queries.ORACLES["op2_line_dedup"]).df().sort_values("doc_id").reset_index(drop=True)
    assert got[want.columns].astype(str).equals(want.astype(str)) and got.n_removed.sum() > 0


def brute_align(a, b):
    best, h = 0, np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (D.MATCH if a[i - 1] == b[j - 1] else D.MISMATCH), h[i - 1, j] + D.GAP, h[i, j - 1] + D.GAP)
            best = max(best, h[i, j])
    return best


def test_alignment_against_full_table():
    rng = np.random.default_rng(0)
    for _ in range(60):
        a, b = rng.integers(1, 6, rng.integers(1, 15)), rng.integers(0, 6, rng.integers(1, 20))
        score, s, e = D.align(a, b)
        assert score == brute_align(a, b)
        assert 0 <= s <= e <= len(b) and (not score or brute_align(a, b[s:e]) == score)


def contaminated(rng, items, rate):
    out = []
    for k in range(60):
        i, text = items[k % len(items)]
        w = [x if rng.random() > rate else rng.choice(WORDS) for x in text.split()]
        around = [rng.choice(WORDS) for _ in range(80)]
        out.append((k, i, " ".join(around[:40] + w + around[40:])))
    return out


@pytest.mark.parametrize(("rate", "least"), [(0.0, 1.0), (0.15, 0.98), (0.3, 0.9)])
def test_edited_copies_are_found(spark, rate, least):
    rng = random.Random(5)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(15, 50)))) for i in range(20)]
    rows = contaminated(rng, items, rate)
    clean = [(1000 + k, -1, " ".join(rng.choice(WORDS) for _ in range(150))) for k in range(60)]
    docs = spark.createDataFrame(rows + clean, "doc_id long, item long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.hits(docs, bench).collect()}
    want = {(k, i) for k, i, _ in rows}
    assert got <= want and len(got) >= least * len(want)
    # blocks of any size give the same hits when every n-gram seeds
    small = {(r.doc_id, r.item_id) for r in D.hits(docs, bench, most=100, seed_share=1.0).collect()}
    assert small >= got and small <= want


def test_hits_against_brute_force(spark, data):
    """On the small table: aligning every item with every whole text finds nothing more."""
    from lamella.llm.common import read

    docs, bench = read(spark, data, "documents").where("length(text) < 1500"), read(spark, data, "benchmark")
    got = {(r.doc_id, r.item_id) for r in D.hits(docs, bench).collect()}
    items = [(r.item_id, r.text) for r in bench.collect()]
    block = D.make_block(items)
    want = set()
    for r in docs.collect():
        ids = D.numbers(block, r.text or "")
        for i, w in block.items.items():
            if np.isin(w, ids).sum() >= 0.35 * len(w) and D.align(w, ids)[0] >= 0.35 * D.MATCH * len(w):
                want.add((r.doc_id, i))
    assert got == want and got


def test_decontamination_edge_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b c d e f g"), (3, "a b c d e f g"), (None, "a b c d e f g")], "doc_id long, text string").selectExpr("*", "0 as score")
    bench = spark.createDataFrame([(9, "A b, c d e f g!"), (8, None), (None, "x"), (7, "a"), (9, "z")], "item_id long, text string")
    assert sorted((r.doc_id or 0, r.item_id) for r in D.hits(docs, bench).collect()) == [(0, 9), (3, 9), (3, 9)]
    assert D.hits(docs, bench.where("1 = 0")).collect() == []
    # a row goes by its own text: one without an id goes too, an innocent one of the same id stays
    more = docs.unionByName(spark.createDataFrame([(3, "nothing of the kind"), (None, "nor here")], "doc_id long, text string").selectExpr("*", "1 as score"))
    kept = D.keep(more, bench)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0, r.text) for r in kept.where("text is not null").collect()) == [(0, "nor here"), (2, ""), (3, "nothing of the kind")]
    assert kept.where("text is null").count() == 1 and D.keep(docs, bench.where("1 = 0")).count() == docs.count()
    assert D.hits(docs.where("1 = 0"), bench).collect() == []


def test_every_test_text_is_searched(spark):
    """Texts without an id, several texts of one id, and texts of two words."""
    docs = spark.createDataFrame([(1, "x alpha beta gamma delta epsilon y"), (2, "one two three four five"), (3, "six seven eight nine ten"), (4, "in New York, now"), (5, "new in york")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "alpha beta gamma delta epsilon"), (7, "one two three four five"), (7, "six seven eight nine ten"), (7, "six seven eight nine ten"), (8, "New York"), (9, "now")], "item_id long, text string")
    for most in (D.BLOCK_GRAMS, 4):
        assert sorted((r.doc_id, r.item_id or 0) for r in D.hits(docs, bench, most=most).collect()) == [(1, 0), (2, 7), (3, 7), (4, 8)]
    assert [r.doc_id for r in D.keep(docs, bench).collect()] == [5]


@pytest.mark.parametrize("rate", [0.0, 0.15])
def test_bounded_seeds_in_long_texts(spark, rate):
    """Items of hundreds of words inside texts of tens of thousands: 32 seeds an item find them."""
    rng = random.Random(8)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(100, 400)))) for i in range(6)]
    rows = []
    for k in range(24):
        w = [x if rng.random() > rate else rng.choice(WORDS) for x in items[k % 6][1].split()]
        around = [rng.choice(WORDS) for _ in range(20_000)]
        rows.append((k, " ".join(around[:9000] + w + around[9000:])))
    rows += [(100 + k, " ".join(rng.choice(WORDS) for _ in range(20_000))) for k in range(6)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.word_start, r.word_end) for r in D.hits(docs, bench).collect()}
    assert set(got) == {(k, k % 6) for k in range(24)}
    assert all(abs(a - 9000) < 5 and abs(b - 9000 - len(items[k[1]][1].split())) < 5 for k, (a, b) in got.items())
    assert sorted(r.doc_id for r in D.keep(docs, bench).collect()) == [100 + k for k in range(6)]


def test_blocks_count_what_they_store(spark):
    """Items whose words aren't parted by blanks fill blocks like any others."""
    bench = spark.createDataFrame([(i, ".".join(f"x{i}y{j}" for j in range(50))) for i in range(20)], "item_id long, text string")
    sizes = [len(D.make_block([(k, t) for k, (_, t) in enumerate(b)]).grams) for b in D.blocks_of(bench, 200)]
    assert len(sizes) == 5 and max(sizes) < 700
