import base64
import gzip
import hashlib
import html
import re

import pytest

from lamella.llm import html_model, queries, warc
from lamella.llm.common import read, scratch_path


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_arc_versions():
    pages = ([1, 2], ["http://a/ b", "é"], [b"x\n\nWARC/1.1\r\n\r\n", b""])
    for version in (1, 2):
        data = warc.pages_to_arc(*pages, version)
        got = [warc.split_http(r.content)[1] for r in warc.parse_arc(data)]
        assert got == pages[2]
        record = next(iter(warc.parse_arc(data)))
        assert record.fields["URL"] == "http://a/%20b" and warc.convert(record) == warc.convert(record)
        assert ("Result-code" in record.fields) == (version == 2)
    assert list(warc.parse_arc(b"")) == []
    for bad in (b"http://x 1 2 3 4\nabcd", data[:-9], data.replace(b"2 0 lamella", b"7 0 lamella"), b"filedesc://a"):
        with pytest.raises(warc.ArchiveError):
            list(warc.parse_arc(bad))


def test_dates():
    assert warc.iso_date("20010203040506") == "2001-02-03T04:05:06Z"
    assert warc.iso_date("2001") == "2001-01-01T00:00:00Z"
    assert warc.iso_date("x") == "1970-01-01T00:00:00Z"


def test_round_trip(spark):
    rows = [(3, "u v", "a\nWARC/1.1\r\n\r\n"), (1, "w", "a\nWARC/1.1\r\n\r\n"), (2, None, None), (5, "é", ""), (None, "q", "a\nWARC/1.1\r\n\r\n"), (7, "z", "HTTP/1.1 200 OK\r\nX-Page-Id: 9\r\n\r\nfoo é"), (8, "l", "é" * 300_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as first", "2 as payload")
    got = {r.page_id: r for r in warc.archive(df, scratch_path(spark, "w")).collect()}
    assert len(got) == len(rows)
    for i, _, t in rows:
        data = (t or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), digest(data))
    assert [(i, got[i].record_type, got[i].refers_to) for i in (3, 1, 2, 5, None, 7)] == [(3, "revisit", 1), (1, "response", None), (2, "response", None), (5, "revisit", 2), (None, "response", None), (7, "response", None)]
    long_only = {r.page_id: r.record_type for r in warc.archive(df, scratch_path(spark, "w"), least_bytes=5).collect()}
    assert long_only[5] == "response" and long_only[3] == "revisit"
    assert warc.archive(df.where("1 = 0"), scratch_path(spark, "w")).collect() == []


def test_files_are_valid(spark, data, tmp_path):
    path = str(tmp_path / "warc")
    pages = read(spark, data, "pages")
    warc.write(warc.convert_pages(pages), path, file_bytes=6000)
    n, files = 0, sorted((tmp_path / "warc").glob("part-*"))
    assert len(files) > 5 and all(f.name.endswith(".warc.gz") for f in files)
    for f in files:
        found = [list(warc.parse_warc(m)) for m in warc.members(f.read_bytes())]
        assert all(len(m) == 1 for m in found) and found[0][0][0]["WARC-Type"] == "warcinfo"
        assert gzip.decompress(f.read_bytes()) == b"".join(warc.members(f.read_bytes()))
        for head, block in (m[0] for m in found):
            n += head["WARC-Type"] != "warcinfo"
            assert head["WARC-Block-Digest"] == "sha1:" + digest(block)
            assert re.fullmatch(r"<urn:uuid:[0-9a-f-]{36}>", head["WARC-Record-ID"]) and head["WARC-Date"].endswith("Z")
    assert n == pages.count() == warc.read_back(spark, path).where("error is null").count()


def test_large_records_end_in_a_zero():
    for size in (0, 5, (1 << 24) - 1, 1 << 24, (1 << 24) + 9):
        packed = warc.gzip_member(b"x" * size)
        assert packed[-1] == 0 and gzip.decompress(packed) == b"x" * size and b"".join(warc.members(packed)) == b"x" * size


def test_arc_files(spark, tmp_path):
    """Stored files, plain and gzip; a broken one gives its records up to the break and a row that says so."""
    ok = warc.pages_to_arc([1, 2], ["u", "v"], [b"one", "zwei é".encode()], 1)
    two = warc.pages_to_arc([3], ["w"], [b"x\n\n"], 2)
    (tmp_path / "a.arc").write_bytes(ok)
    (tmp_path / "b.arc.gz").write_bytes(gzip.compress(two[:20]) + gzip.compress(two[20:]))
    (tmp_path / "c.arc").write_bytes(ok[:-5])
    (tmp_path / "d.arc").write_bytes(b"")
    (tmp_path / "e.arc.gz").write_bytes(gzip.compress(ok)[:-9])
    rows = warc.read_arc(spark, str(tmp_path / "*.arc*")).collect()
    by = {}
    for r in rows:
        by.setdefault(r.path[-8:].lstrip("/").split("/")[-1], []).append(r)
    assert [(r.page_id, bytes(r.payload)) for r in by["a.arc"]] == [(1, b"one"), (2, "zwei é".encode())]
    assert [(r.page_id, bytes(r.payload), r.payload_digest) for r in by["b.arc.gz"]] == [(3, b"x\n\n", digest(b"x\n\n"))]
    assert [(r.page_id, r.error is None) for r in by["c.arc"]] == [(1, True), (None, False)]
    assert "d.arc" not in by and [r.error is None for r in by["e.arc.gz"]] == [False]
    path = str(tmp_path / "out")
    warc.write(warc.read_arc(spark, str(tmp_path / "*.arc*")).where("error is null").drop("path", "error"), path)
    assert warc.read_back(spark, path).count() == 4


def test_malformed_warc(spark, tmp_path):
    row = {"record_id": "<urn:uuid:1>", "url": "u", "warc_date": "2000-01-01T00:00:00Z", "content_type": "text/html", "http": "HTTP/1.1 200 OK\r\nX-Page-Id: 4\r\n\r\n", "payload": b"abc", "payload_digest": digest(b"abc"), "block_digest": "x", "page_id": 4}
    good = warc.warc_record("response", row, None)
    bad = warc.warc_record("response", row | {"payload_digest": digest(b"abd")}, None)
    (tmp_path / "x.warc.gz").write_bytes(b"".join(map(warc.gzip_member, [good, good[:-9], bad, b"junk", good])) + b"\x1f\x8bcut")
    got = warc.read_back(spark, str(tmp_path)).collect()
    assert [(r.page_id, r.error is None) for r in got] == [(4, True), (None, False), (4, False), (None, False), (4, True), (None, False)]


def test_repeated_page_ids(spark):
    rows = [(1, "u", "same"), (1, "u", "same"), (2, "v", "same"), (2, "v", "other"), (2, "v", "other")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive(df, scratch_path(spark, "w")).collect())
    assert got == [(1, 4, "response", None), (1, 4, "response", None), (2, 4, "revisit", 1), (2, 5, "response", None), (2, 5, "response", None)]


def test_warc_query_against_sql(spark):
    """On a table with repeated payloads."""
    import duckdb

    con = duckdb.connect()
    con.sql("CREATE VIEW pages AS SELECT * FROM read_parquet('/root/testdata/sf0.01/pages.parquet') UNION ALL SELECT page_id + 10000, url, html FROM read_parquet('/root/testdata/sf0.01/pages.parquet') WHERE page_id % 7 = 0 UNION ALL SELECT 20000 + page_id, url, NULL FROM read_parquet('/root/testdata/sf0.01/pages.parquet') WHERE page_id < 3")
    df = read(spark, "/root/testdata/sf0.01", "pages")
    df = df.unionByName(df.where("page_id % 7 = 0").withColumn("page_id", df.page_id + 10000)).unionByName(df.where("page_id < 3").selectExpr("page_id + 20000 as page_id", "url", "cast(null as string) as html"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    got = sorted(tuple(r) for r in warc.archive(df, scratch_path(spark, "w")).select(*columns).collect())
    want = sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES['op4_warc']})").fetchall())
    assert got == want and any(r[4] is not None for r in got)


def test_warc_query(spark, data):
    pages = {r.page_id: (r.html or "").encode() for r in read(spark, data, "pages").collect()}
    first = {}
    for i in sorted(pages):
        first.setdefault(pages[i], i)
    got = queries.op4_warc(spark, data).collect()
    assert len(got) == len(pages)
    for r in got:
        p = pages[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(p), digest(p))
        assert (r.record_type, r.refers_to) == (("response", None) if first[p] == r.page_id else ("revisit", first[p]))


@pytest.fixture(scope="module")
def model():
    return html_model.default_model()


def test_pages_of_the_table(spark, data, model):
    for r in read(spark, data, "pages").collect():
        inside = r.html.split("<article>")[1].split("</article>")[0] if "<article>" in r.html else ""
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " ")))).strip() for b in re.split(r"</?(?:p|h1)>", inside)]
        assert model.extract(r.html) == "\n".join(b for b in blocks if b)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("plain &lt;text&gt;", "plain <text>"),
        ("<p>a\n b</p><p>c", "a b\nc"),
        ("<!-- <p>x</p> --><article><p>one<script>var a='</p>';</script> two</p></article", "one two"),
        ('<div id="content"><p>Hello &amp; bye</p><div class="comments"><p>me too, a reader</p></div></div>', "Hello & bye"),
        ('<html><body><nav><ul><li><a href="/">Home</a><li><a>About</a></ul></nav><main><h1>T</h1><p>Some text here, quite long.</p></main><footer>&copy; me</footer></body></html>', "T\nSome text here, quite long."),
        ("</div></p><article><h1>x</h1></b><p>y<br>z", "x\ny z"),
        ("<<>><p>1 < 2", "<<>>\n1 < 2"),
    ],
)
def test_small_pages(model, page, text):
    assert model.extract(page) == text


@pytest.mark.parametrize("tag", ["button", "option", "select", "canvas", "audio", "video", "svg"])
def test_unclosed_elements_hide_nothing(model, tag):
    article = "<article><h1>T</h1><p>Some text here, quite long.</p></article>"
    want = "T\nSome text here, quite long."
    assert model.extract(f"<{tag}>{article}") == want
    assert model.extract(f"<{tag} class='a'>{article}<{tag}>x</{tag}>") == want
    assert model.extract(f"<{tag}>x</{tag}>{article}<{tag}>") == want
    assert len(html_model.parse(f"<{tag}><p>" * 20_000)) == 20_001


@pytest.mark.parametrize("tag", ["object", "map", "math"])
def test_nothing_else_is_dropped(model, tag):
    """Formulas and the insides of objects and maps belong to the text around them, closed or not."""
    article = "<article><h1>T</h1><p>Some text {}here, quite long.</p></article>"
    assert model.extract(article.format(f"<{tag}>x</{tag}> ")) == "T\nSome text x here, quite long."
    assert model.extract(article.format(f"<{tag} data=x />")) == "T\nSome text here, quite long."
    assert model.extract(f"<{tag}>" + article.format("")) == "T\nSome text here, quite long."
    assert len(html_model.parse(f"<{tag}><p>" * 20_000)) == 20_001


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<datalist><option>A<option>B</datalist><article><p>Some text here.</p></article>", "Some text here."),
        ('<article><p title="abc>He said "hello" and left.</p><p>Second one.</p></article>', 'He said "hello" and left.\nSecond one.'),
        ('<article><p title="abc>first words</p><p>Second one.</p></article>', "first words\nSecond one."),
        ("<article><p title=it's>first words</p><p>it's second</p></article>", "first words\nit's second"),
        ('<article><p title="a > b">x <i data-x=\'</p>\'>y</i></p></article>', "x y"),
        ("<article><p>one<button>x</button> two</p></article>", "one two"),
        ("<article><p>a<!--> b <!-- c --!> d<!x> e</ f> g</p></article>", "a b d e g"),
    ],
)
def test_odd_markup(model, page, text):
    assert model.extract(page) == text


PIECES = ["<a href=\"x", '<p title="abc>', "<p title=it's>", '<x a=" > " ', "<div>", "</p>", "<button ", "<!-- ", "<!x", "<", "</", "<title>", "<p a=", "<p a=\" b='", "<option>x", "word ", "&amp;", ">", "\"", "'"]


@pytest.mark.parametrize("piece", PIECES)
def test_time_is_linear(model, piece):
    """A megabyte of one odd piece, ended by a closing mark or not."""
    import time

    for end in ("", ">", '">'):
        began = time.perf_counter()
        html_model.tokens(piece * (1_000_000 // len(piece)) + end)
        assert time.perf_counter() - began < 3


def test_any_mix_of_pieces_parses(model):
    import random

    rng = random.Random(1)
    for _ in range(300):
        page = "".join(rng.choice(PIECES + ["</div>", "<li>", "<ul>", "</ul>", "</script>", "<script>", "<svg/>", "<br>"]) for _ in range(rng.randint(0, 60)))
        assert isinstance(model.extract(page), str)


def test_fit_on_pages(spark, data, model):
    """Fitted on the table, the model learns a name that it has never seen and keeps the rest."""
    rng_pages = [(k, f"u{k}", f"<html><body><div class='zzmenu'><a href='/'>Home</a> <a href='/b'>News {k % 3}</a></div><div class='zzfoot'>All rights are kept, always.</div><div class='zzbody'><p>{('text %d of many words ' % k) * 12}</p><p>short {k}</p></div></body></html>") for k in range(80)]
    pages = spark.createDataFrame(rng_pages, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_model.extract(pages).collect()}
    want = {k: f"{('text %d of many words ' % k) * 12}".strip() + f"\nshort {k}" for k, _, _ in rng_pages}
    assert got == want
    fitted = html_model.fit(pages)
    assert fitted.own["n:zzmenu"] < 0 and fitted.own["n:zzfoot"] < 0 < fitted.own["n:zzbody"] and "n:zzmenu" not in model.own
    empty = html_model.fit(pages.where("1 = 0"))
    assert empty.own == model.own and html_model.extract(pages.where("1 = 0")).collect() == []
    fitted = html_model.fit(read(spark, data, "pages"), bound=50)
    # what the sample adds takes nothing from other pages
    import random

    rng, right = random.Random(99), []
    for _ in range(200):
        nodes = html_model.labelled_page(rng)
        right += [(p > 0.5) == bool(x.label) for x, p in zip(nodes, fitted.marginals(nodes), strict=True)]
    assert sum(right) / len(right) > 0.98
    for r in read(spark, data, "pages").collect():
        assert fitted.extract(r.html) == model.extract(r.html)


def many_pages(n):
    """Pages with a class name and a custom tag of their own; blocks on two, three and all pages; copies of one page."""
    letters = lambda k: "".join(chr(97 + k // 26**i % 26) for i in range(3))
    out = [(k, f"u{k}", f"<html><body><div class='zz{letters(k)}'><a href='/'>Home</a> all</div><x-{letters(k)}>pair {k // 2}</x-{letters(k)}><div class='qq{letters(k // 3)}'>three {k // 3}</div><p>{f'text {k} of many words ' * (k % 9)}</p></body></html>") for k in range(n)]
    return out + [(n + k, None, "<div class='copied'>the same</div>") for k in range(5)] + [(None, None, None), (n, "v", "")]


def test_fit_counts_every_page(spark):
    """More pages than a sample had: the model against plain counting, whatever the partitions."""
    import numpy as np

    rows = many_pages(2400)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    fitted = html_model.fit(pages)
    assert sum(k.startswith("n:zz") for k in fitted.own) == 2400
    htmls = [h for _, _, h in rows if h is not None]
    on = {}
    for h in set(htmls):
        for x in {*html_model.block_hashes(html_model.parse(h))} - {0}:
            on[x] = on.get(x, 0) + 1
    repeated = {x for x, n in on.items() if n >= 3}
    assert len(repeated) == 1 + 800  # copies of a page are one page
    base, sample, want = html_model.default_model(), html_model.Counts(), html_model.Counts()
    for h in htmls:
        nodes = html_model.parse(h)
        sample.add(nodes, base.marginals(nodes, html_model.signs(nodes, html_model.block_hashes(nodes), repeated)))
    want.merge(html_model.generated())
    want.merge(sample, 0.1 * html_model.generated().count.sum() / sample.count.sum())
    want = want.model()
    assert fitted.own.keys() == want.own.keys() and fitted.edge.keys() == want.edge.keys()
    assert all(abs(fitted.own[k] - v) < 1e-6 for k, v in want.own.items())
    assert all(np.allclose(fitted.edge[k], v, atol=1e-6) for k, v in want.edge.items())
    again = html_model.fit(pages.repartition(7))
    assert again.own == fitted.own and again.edge == fitted.edge


def test_numbers_by_join(spark):
    """Blocks, features and tags beyond what is broadcast reach pages by joins: same numbers, same texts."""
    pages = spark.createDataFrame(many_pages(300), "page_id long, url string, html string")
    fitted = html_model.fit(pages)
    for bounds in ({"most_blocks": 0}, {"most_blocks": 0, "most_keys": 0}):
        joined = html_model.fit(pages.repartition(5), **bounds)
        assert (joined.rest is not None) == ("most_keys" in bounds)
        if joined.rest is not None:
            assert "n:zzaaa" not in joined.own and "x-aaa" not in joined.edge
            joined_all = joined.joined({r["key"]: r["w"] for r in joined.rest.collect()})
            assert dict(joined_all.own) == fitted.own and dict(joined_all.edge) == fitted.edge
        else:
            assert joined.own == fitted.own and joined.edge == fitted.edge
        key = lambda r: (r.page_id or 0, r.url or "", r.text)
        assert sorted(html_model.extract(pages, joined).collect(), key=key) == sorted(html_model.extract(pages, fitted).collect(), key=key)


def test_marginals_are_exact(model):
    """Sum-product against the sum over all labelings of a small tree."""
    import itertools

    import numpy as np

    nodes = html_model.parse('<div class="x"><p>aa bb</p><ul><li><a>c</a></li></ul></div><p>dd</p>')
    n, whole = len(nodes), html_model.totals(nodes)
    odds = [sum(model.own.get(f, 0.0) for f in html_model.features(x, w)) for x, w in zip(nodes, whole, strict=True)]
    odds[0] += model.prior
    own = [(1 - 1 / (1 + np.exp(-o)), 1 / (1 + np.exp(-o))) for o in odds]
    total = np.zeros((n, 2))
    for labels in itertools.product((0, 1), repeat=n):
        p = np.prod([own[i][labels[i]] for i in range(n)])
        for i in range(1, n):
            p *= model.edge.get(nodes[i].tag, model.edge["*"])[labels[nodes[i].parent]][labels[i]]
        for i in range(n):
            total[i, labels[i]] += p
    assert np.allclose(model.marginals(nodes), total[:, 1] / total.sum(1), atol=1e-6)


def test_held_out_pages(model):
    """Generated pages that training didn't see: nearly every node gets its label."""
    import random

    rng = random.Random(99)
    right = []
    for _ in range(200):
        nodes = html_model.labelled_page(rng)
        right += [(p > 0.5) == bool(x.label) for x, p in zip(nodes, model.marginals(nodes), strict=True)]
    assert sum(right) / len(right) > 0.95


def test_deep_and_long_pages(model):
    assert model.extract("<div>" * 5000 + "x") in ("", "x")
    assert model.extract("<article><p>" + "word " * 200_000 + "</p></article>") == ("word " * 200_000).strip()


def test_extract_frame(spark, model):
    df = spark.createDataFrame([(1, "u", "<p>é</p>"), (1, "u", "<p>é</p>"), (None, None, None)], "page_id long, url string, html string").selectExpr("*", "'t' as text")
    got = sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in html_model.extract(df, model).collect())
    assert got == [(0, "", "", 0), (1, "u", "é", 1), (1, "u", "é", 1)]
