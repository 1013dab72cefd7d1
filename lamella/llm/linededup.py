"""Removal of multi-line passages that repeat anywhere in the corpus.

A text is cut into lines, and a line of LONG_LINE spaces or more further after
.!?,; marks, for a passage may start and end inside a paragraph.  A chunk is
the shortest run of lines from a boundary on that has LEAST_LINES lines and
LEAST_WORDS words, or the shortest that ends at one; a rolling hash over line
hashes names it.  Every line edge is a boundary: boundaries that a hash thins
out lose most repeated passages of a few lines.  So any passage that two texts
share is a union of chunks they share, whatever surrounds it.

Chunks that occur before are joined to runs along the same first text and
compared with it byte for byte.  All occurrences but the first are removed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, StructField, StructType

from .common import ROWS_PER_BATCH, map_arrow, small_batches, stored, text_bytes

LONG_LINE = 20
LEAST_LINES = 2
#: Runs of fewer words are too common to be a passage.
LEAST_WORDS = 8
#: Base of the rolling hash, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of runs that a worker holds before it passes them on.
BODY_BYTES = 1 << 20
#: Rows, and spans in them, that are broadcast at most (some 40 MB); larger tables are joined by a shuffle.
BROADCAST_ROWS, BROADCAST_SPANS = 400_000, 1_000_000
LINE = re.compile(rb"[^\n]*\n|[^\n]+")
CLAUSE = re.compile(rb"[^.!?,;]*[.!?,;]+[ \t\r]*\n?|[^.!?,;]+")
#: What may follow a line without being part of it.
END = b" \t\r\n"


def lines_of(text: bytes) -> list[bytes]:
    """Lines with their ends; joined they are the text."""
    out: list[bytes] = []
    for line in LINE.findall(text):
        if line.count(b" ") >= LONG_LINE:
            out.extend(CLAUSE.findall(line))
        else:
            out.append(line)
    return out


class Chunker:
    """Chunks of whole batches of texts; keeps the powers of BASE between batches."""

    def __init__(self) -> None:
        import xxhash

        self.hash = xxhash.xxh3_64_intdigest
        self.power = np.ones(0, np.uint64)
        self.back = self.power

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.power) < n:
            size = max(n, 1 << 16)
            power, back = np.full(size, BASE, np.uint64), np.full(size, INVERSE, np.uint64)
            power[0] = back[0] = 1
            self.power, self.back = np.multiply.accumulate(power), np.multiply.accumulate(back)
        return self.power[:n], self.back[:n]

    def __call__(self, texts: list[list[bytes]]) -> tuple[np.ndarray, ...]:
        """Of the texts, given as lines: (text number, hash, first line, lines) of every
        chunk where its text has it first, and (text number, first line, lines) of the
        ranges that repeat lines of the same text.
        """
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        bare = [x.rstrip(END) for lines in texts for x in lines]
        n = len(bare)
        if not n:
            none = np.zeros(0, np.int64)
            return none, none.view(np.uint64), none, none, none, none, none
        words = np.zeros(n + 1, np.int64)
        np.cumsum(np.fromiter((x.lstrip().count(b" ") + 1 if x else 0 for x in bare), np.int64, n), out=words[1:])
        bound = np.concatenate([[0], np.cumsum(sizes)])
        text = np.repeat(np.arange(len(texts)), sizes)
        start = np.arange(n)
        end = np.maximum(np.searchsorted(words, words[:n] + LEAST_WORDS), start + LEAST_LINES)
        ok = end <= bound[text + 1]
        start, end = start[ok], end[ok]
        # an end that no start leads to has a chunk of its own
        alone = np.ones(n + 1, bool)
        alone[0] = False
        alone[end] = False
        last = np.flatnonzero(alone)
        first = np.minimum(np.searchsorted(words, words[last] - LEAST_WORDS, "right") - 1, last - LEAST_LINES)
        ok = first >= bound[text[last - 1]]
        start, end = np.concatenate([start, first[ok]]), np.concatenate([end, last[ok]])
        power, back = self.powers(n)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(np.fromiter(map(self.hash, bare), np.uint64, n) * power, out=sums[1:])
            hashes = (sums[end] - sums[start]) * back[start]
        own = text[start]

        order = np.lexsort((start, hashes, own))
        own, hashes, start, end = own[order], hashes[order], start[order], end[order]
        fresh = np.ones(len(own), bool)
        fresh[1:] = (own[1:] != own[:-1]) | (hashes[1:] != hashes[:-1])
        head = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        edge = np.zeros(n + 1, np.int32)
        for k in np.flatnonzero(~fresh).tolist():
            a, b, e, size = start[head[k]], start[k], end[k], end[head[k]] - start[head[k]]
            if size == e - b and bare[a : a + size] == bare[b:e]:
                edge[max(b, a + size)] += 1  # the lines that both share stay
                edge[e] -= 1
        gone = np.concatenate([[0], np.cumsum(edge[:n]) > 0, [0]]).astype(np.int8)
        # ranges end with their text
        cut = np.diff(gone)
        inner = bound[1:-1][(bound[1:-1] > 0) & (bound[1:-1] < n)]
        through = np.unique(inner[(gone[inner] & gone[inner + 1]) > 0])
        opens = np.sort(np.concatenate([np.flatnonzero(cut[:n] > 0), through]))
        closes = np.sort(np.concatenate([np.flatnonzero(cut < 0), through]))
        whose = text[opens]
        own, hashes, start, end = own[fresh], hashes[fresh], start[fresh], end[fresh]
        return own, hashes, start - bound[own], end - start, whose, opens - bound[whose], closes - opens


def chunks(lines: list[bytes]) -> Iterator[tuple[int, int, int]]:
    """(hash, first line, lines) of every different chunk of one text."""
    return zip(*(x.tolist() for x in Chunker()([lines])[1:4]), strict=True)


#: A row's name: its id, and a hash of its text that also tells a null id from the one that stands for it.
KEY = ("k0", "k1")


def _key() -> list[Column]:
    null = F.col("doc_id").isNull()
    return [F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k0"), F.xxhash64("text", null).alias("k1")]


def _packed(docs: DataFrame, *keep: str) -> DataFrame:
    """``lamella_k0``, ``lamella_k1``, the text compressed as ``lamella_text``, and the ``keep`` columns.

    What crosses the network is packed: it takes about half of what Spark's own
    shuffle compression leaves.
    """
    kept = [f for f in docs.schema.fields if f.name in keep]
    names = ["lamella_k0", "lamella_k1", "lamella_text", *(f.name for f in kept)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            packed = [None if t is None else pack(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("lamella_k0"), batch.column("lamella_k1"), pa.array(packed, pa.binary()), *(batch.column(f.name) for f in kept)], names=names)

    schema = StructType([*StructType.fromDDL("lamella_k0 long, lamella_k1 long"), StructField("lamella_text", BinaryType()), *kept])
    k0, k1 = _key()
    return docs.select(k0.alias("lamella_k0"), k1.alias("lamella_k1"), "text", *(f.name for f in kept)).mapInArrow(run, schema)


def _unpack(packed: list) -> list[bytes]:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    return [b"" if z is None else unpack(z) for z in packed]


#: A chunk's place is its first line times this plus its number of lines.
PLACE = 1 << 24


def removals(docs: DataFrame, *, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(k0, k1, spans): the line ranges [a, b) to remove from each row with any.

    Rows that are the same in id and text lose the same lines; equal ids with
    different texts are different rows.  Of several occurrences the one with the
    smallest id stays (null first), and within a text the first.  A passage that
    overlaps its own first occurrence leaves the lines they share.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select("doc_id", "text").where("text is not null").select(*_key(), "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunker = Chunker()
        for batch in batches:
            text, hashes, first, n, own, a, size = chunker([lines_of(t) for t in text_bytes(batch.column("text"))])
            whose = np.concatenate([text, own])
            keys = [pa.array(batch.column(k).to_numpy()[whose]) for k in KEY]
            names = pa.concat_arrays([pa.array(hashes.view(np.int64)), pa.nulls(len(own), pa.int64())])
            yield pa.RecordBatch.from_arrays([names, *keys, pa.array(np.concatenate([first * PLACE + n, a * PLACE + size]))], names=["hash", *KEY, "place"])

    # written once: the count below reads its first column alone; ranges that repeat lines of their own text have no hash
    found = stored(rows.mapInArrow(cut, "hash long, k0 long, k1 long, place long"), "chunks")
    pos, size = F.expr(f"cast(place div {PLACE} as int)"), F.expr(f"cast(place % {PLACE} as int)")
    often = found.where("hash is not null").groupBy("hash").agg(F.count("*").alias("c")).where("c > 1").select("hash")
    again = stored(found.where("hash is not null").join(often, "hash", "left_semi"), "again")
    # the first of each is a partial minimum, and a hot chunk's rows meet it in a join that can be split
    heads = again.groupBy("hash").agg(F.min(F.struct(*KEY, "place")).alias("h")).selectExpr("hash", "h.k0 as f0", "h.k1 as f1", "h.place as first_place")
    again = again.join(heads, "hash").where("k0 <> f0 or k1 <> f1")

    # chunks with the same first text at the same distance, end to end, are one run
    again = again.select(*KEY, "f0", "f1", (pos - F.expr(f"cast(first_place div {PLACE} as int)")).alias("shift"), pos.alias("pos"), (pos + size).alias("end"))
    group = (*KEY, "f0", "f1", "shift")
    line = Window.partitionBy(*group).orderBy("pos", "end")
    reached = F.max("end").over(line.rowsBetween(Window.unboundedPreceding, -1))
    opens = again.withColumn("opens", F.when(F.col("pos") <= reached, 0).otherwise(1))
    numbered = opens.withColumn("run", F.sum("opens").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = numbered.groupBy(*group, "run").agg(F.min("pos").alias("pos"), F.max("end").alias("end"))
    runs = stored(runs.select(*KEY, "f0", "f1", (F.col("pos") - F.col("shift")).alias("first_pos"), (F.col("end") - F.col("pos")).alias("n"), "pos"), "runs")

    # the texts of runs and of their first occurrences
    firsts = runs.select(F.col("f0").alias("k0"), F.col("f1").alias("k1"), "f0", "f1", "first_pos", "n").distinct().withColumn("pos", F.lit(None).cast("int"))
    wanted = stored(runs.unionByName(firsts).groupBy(*KEY).agg(F.collect_list(F.struct("f0", "f1", "first_pos", "n", "pos")).alias("runs")), "wanted")
    only = wanted.select(*KEY)
    rows = rows.join(F.broadcast(only) if only.count() <= broadcast_rows else only, [*KEY], "left_semi")
    texts = _packed_rows(rows).dropDuplicates([*KEY]).join(wanted, [*KEY])
    kinds = {"k0": pa.int64(), "k1": pa.int64(), "f0": pa.int64(), "f1": pa.int64(), "first_pos": pa.int32(), "n": pa.int32(), "pos": pa.int32(), "body": pa.binary()}

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            cols = list(zip(*got, strict=True)) if got else [()] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds.values(), strict=True)], names=list(kinds))

        for batch in batches:
            for k0, k1, text, found in zip(*(batch.column(k).to_pylist() for k in KEY), _unpack(batch.column("packed").to_pylist()), batch.column("runs").to_pylist(), strict=True):
                lines = [x.rstrip(END) for x in lines_of(text)]
                for r in found:
                    a = r["first_pos"] if r["pos"] is None else r["pos"]
                    body = b"\n".join(lines[a : a + r["n"]])
                    got.append((k0, k1, r["f0"], r["f1"], r["first_pos"], r["n"], r["pos"], body))
                    size += len(body)
                    if size > BODY_BYTES or len(got) >= ROWS_PER_BATCH:
                        yield flush()
                        got, size = [], 0
        yield flush()

    shown = stored(texts.select(*KEY, "packed", "runs").mapInArrow(show, "k0 long, k1 long, f0 long, f1 long, first_pos int, n int, pos int, body binary"), "shown")
    first = ["f0", "f1", "first_pos", "n"]
    heads = shown.where("pos is null").select(*first, F.col("body").alias("head"))
    same = shown.where("pos is not null").join(heads, first).where("body = head").select(*KEY, "pos", "n")
    spans = same.unionByName(found.where("hash is null").select(*KEY, pos.alias("pos"), size.alias("n")).distinct())
    return spans.groupBy(*KEY).agg(F.collect_list(F.struct(F.col("pos").alias("a"), (F.col("pos") + F.col("n")).alias("b"))).alias("spans"))


def _packed_rows(rows: DataFrame) -> DataFrame:
    """KEY and ``packed``, the text compressed."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        return pa.RecordBatch.from_arrays([*(batch.column(k) for k in KEY), pa.array([pack(t) for t in text_bytes(batch.column("text"))], pa.binary())], names=[*KEY, "packed"])

    return map_arrow(rows.select(*KEY, "text"), run, "k0 long, k1 long, packed binary")


def clean(docs: DataFrame, *, broadcast_rows: int = BROADCAST_ROWS, broadcast_spans: int = BROADCAST_SPANS) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``, and
    ``lamella_lines``, ``lamella_removed`` (int): lines before, lines removed,
    and ``lamella_left`` (double): the share of words left, 1 without words.

    A null text stays null with 0 lines; a text of one line (LONG_LINE spaces
    or more make it several) is never changed.  Ranges of lines reach the texts
    by a broadcast up to the bounds given; beyond, packed texts are shuffled.
    """
    spans = stored(removals(docs, broadcast_rows=broadcast_rows), "spans")
    size = spans.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("spans")), F.lit(0)).alias("spans")).first()
    spans = spans.select(F.col("k0").alias("lamella_k0"), F.col("k1").alias("lamella_k1"), F.col("spans").alias("lamella_spans"))
    columns = docs.columns
    keys = ["lamella_k0", "lamella_k1"]
    packed = size["rows"] > broadcast_rows or size["spans"] > broadcast_spans
    if packed:
        others = [c for c in columns if c != "text"]
        rows = _packed(docs, *others).join(spans, keys, "left").select("lamella_text", "lamella_spans", *others)
    else:
        k0, k1 = _key()
        rows = docs.select("*", k0.alias("lamella_k0"), k1.alias("lamella_k1")).join(F.broadcast(spans), keys, "left").select("lamella_spans", *columns)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out, total, gone, left = [], [], [], []
        raw = batch.column("lamella_text").to_pylist() if packed else batch.column("text").cast(pa.binary()).to_pylist()
        found = _unpack(raw) if packed else [t or b"" for t in raw]
        for z, text, spans in zip(raw, found, batch.column("lamella_spans").to_pylist(), strict=True):
            lines = lines_of(text)
            drop = {k for s in spans or () for k in range(s["a"], s["b"])}
            new = b"".join(x for k, x in enumerate(lines) if k not in drop) if drop else text
            out.append(None if z is None else new)
            total.append(len(lines))
            gone.append(len(drop))
            left.append(len(new.split()) / max(1, len(text.split())) if drop else 1.0)
        arrays = [pa.array(out, pa.binary()).cast(pa.string()) if c == "text" else batch.column(c) for c in columns]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(total, pa.int32()), pa.array(gone, pa.int32()), pa.array(left, pa.float64())], names=[*columns, "lamella_lines", "lamella_removed", "lamella_left"])

    schema = StructType([*docs.schema.fields, StructField("lamella_lines", IntegerType()), StructField("lamella_removed", IntegerType()), StructField("lamella_left", DoubleType())])
    return map_arrow(rows, run, schema)


def keep(docs: DataFrame, *, least_left: float = 0.5) -> DataFrame:
    """Columns of ``docs`` with cleaned texts.

    A text that loses more than ``1 - least_left`` of its words is a copy of
    what stands elsewhere and goes as a whole: its scraps are no document.
    """
    return clean(docs).where((F.col("lamella_removed") == 0) | (F.col("lamella_left") >= least_left)).select(*docs.columns)


def _sql(table: str = "documents") -> str:
    words = "length(ltrim(b, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ')) - length(replace(ltrim(b, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), ' ', '')) + 1"
    return rf"""
WITH l AS (SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS ls FROM {table}),
u AS (SELECT doc_id, text, flatten(list_transform(ls, lambda x: CASE WHEN length(x) - length(replace(x, ' ', '')) >= {LONG_LINE} THEN regexp_extract_all(x, '[^.!?,;]*[.!?,;]+[ \t\r]*\n?|[^.!?,;]+') ELSE [x] END)) AS us FROM l),
e AS (SELECT doc_id, unnest(us) AS x, generate_subscripts(us, 1) - 1 AS k FROM u),
b AS (SELECT doc_id, k, x, rtrim(x, chr(9) || chr(10) || chr(13) || ' ') AS b FROM e),
c AS (SELECT *, CASE WHEN b = '' THEN 0 ELSE {words} END AS w FROM b),
p AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY k) AS upto, sum(w) OVER (PARTITION BY doc_id ORDER BY k) - w AS before, count(*) OVER (PARTITION BY doc_id) AS n FROM c),
-- the shortest chunk from each line on, then the shortest up to each line that none of these reaches
ends AS (SELECT doc_id, upto, min(k) + 1 AS e FROM p GROUP BY ALL),
starts AS (SELECT doc_id, before, max(k) AS s FROM p GROUP BY ALL),
f AS (SELECT p.doc_id, k AS s, greatest(e, k + {LEAST_LINES}) AS e, n FROM p ASOF JOIN ends ON p.doc_id = ends.doc_id AND p.before + {LEAST_WORDS} <= ends.upto),
f1 AS (SELECT doc_id, s, e FROM f WHERE e <= n),
g AS (SELECT p.doc_id, least(s, k + 1 - {LEAST_LINES}) AS s, k + 1 AS e FROM p ASOF JOIN starts ON p.doc_id = starts.doc_id AND p.upto - {LEAST_WORDS} >= starts.before),
ch AS (SELECT * FROM f1 UNION ALL SELECT * FROM g WHERE s >= 0 AND (doc_id, e) NOT IN (SELECT (doc_id, e) FROM f1)),
t AS (SELECT ch.doc_id, s, e, string_agg(b, chr(10) ORDER BY k) AS body FROM ch JOIN p ON p.doc_id = ch.doc_id AND k >= s AND k < e GROUP BY ALL),
h AS (SELECT doc_id, s, e, first_value(doc_id) OVER o AS d1, first_value(s) OVER o AS s1 FROM t WINDOW o AS (PARTITION BY body, e - s ORDER BY doc_id, s)),
r AS (SELECT doc_id, CASE WHEN doc_id = d1 THEN greatest(s, s1 + e - s) ELSE s END AS s, e FROM h WHERE doc_id <> d1 OR s <> s1),
gone AS (SELECT DISTINCT p.doc_id, k FROM p JOIN r ON r.doc_id = p.doc_id AND k >= s AND k < e),
kept AS (SELECT p.doc_id, count(gone.k)::INT AS n_removed, coalesce(string_agg(x, '' ORDER BY p.k) FILTER (gone.k IS NULL), '') AS left_ FROM p LEFT JOIN gone ON gone.doc_id = p.doc_id AND gone.k = p.k GROUP BY p.doc_id)
SELECT u.doc_id, coalesce(len(us), 0)::INT AS n_lines, coalesce(n_removed, 0)::INT AS n_removed, length(coalesce(left_, text))::INT AS n_chars, md5(coalesce(left_, text)) AS text_md5
FROM u LEFT JOIN kept USING (doc_id)"""


#: Chunks as texts instead of hashes, every pair of equal ones; for small tables of distinct ids.
ORACLE = _sql()
