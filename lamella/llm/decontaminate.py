"""Benchmark decontamination: rare n-gram seeds, then local alignment.

1. Every n-gram of the test items is counted over the whole corpus.
2. Of each item's n-grams that occur, the rarest are its seeds.
3. Where a text has a seed, Smith-Waterman aligns the item with the words
   around it, so edited and paraphrased copies are found as well.

Items of two words have no n-gram and are found word for word; a single word
is no passage and is never found.

The test items are a stated query set: they go through the corpus in blocks of
at most BLOCK_GRAMS n-grams, so what is broadcast has a fixed bound and no
document is ever shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, texts

N = 3
#: n-grams of test items that go through the corpus at once.
BLOCK_GRAMS = 1_000_000
#: Seeds of an item: its rarest n-grams that occur.
SEEDS = 32
MATCH, MISMATCH, GAP = 2, -1, -1
WORD = re.compile(r"\w+")
HITS = "doc_id long, item_id long, score double, word_start int, word_end int"


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def align(item: np.ndarray, part: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of two word sequences: (score, start, end) in ``part``.

    Rows run along ``part``; within a row gaps in the item are a running
    maximum, so each row is a few vector operations.
    """
    m = len(item)
    step = np.arange(m + 1) * GAP
    prev, best = np.zeros(m + 1, np.int64), (0, 0, 0)
    origin = np.zeros(m + 1, np.int64)
    for j, w in enumerate(part.tolist()):
        diagonal = prev[:-1] + np.where(item == w, MATCH, MISMATCH)
        up = prev[1:] + GAP
        take = diagonal >= up
        score = np.where(take, diagonal, up)
        source = np.where(take, np.where(prev[:-1] > 0, origin[:-1], j), origin[1:])
        row = np.concatenate([[0], np.maximum(score, 0)])
        start = np.concatenate([[j], source])
        # gaps: best of row[k] + (i - k) * GAP over k <= i
        lifted = row - step
        run = np.maximum.accumulate(lifted)
        where = np.maximum.accumulate(np.where(lifted == run, np.arange(m + 1), 0))
        row, origin = run + step, start[where]
        k = int(row.argmax())
        if row[k] > best[0]:
            best = (int(row[k]), int(origin[k]), j + 1)
        prev = np.maximum(row, 0)
    return best


@dataclass
class Block:
    """Items as word numbers, and their n-grams as one number each (exact, not hashed)."""

    vocab: dict[str, int]
    items: dict[int, np.ndarray]
    grams: np.ndarray
    owners: list[list[tuple[int, int]]]
    size: int
    #: Items too short for an n-gram, by length and words.
    short: dict[int, dict[tuple[int, ...], list[int]]] = field(default_factory=dict)

    def positions(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where ``ids`` (0: not a word of any item) has an n-gram of the block, and which."""
        n = len(ids) - self.size + 1
        if n <= 0 or not len(self.grams):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        known = ids[:n] > 0
        for k in range(1, self.size):
            known &= ids[k : n + k] > 0
        at = np.flatnonzero(known)
        if not len(at):
            return at, at
        code = pack(ids, at, self.size, len(self.vocab))
        which = np.searchsorted(self.grams, code)
        which[which == len(self.grams)] = 0
        hit = self.grams[which] == code
        return at[hit], which[hit]


def pack(ids: np.ndarray, at: np.ndarray, size: int, vocab: int) -> np.ndarray:
    code = np.zeros(len(at), np.int64)
    for k in range(size):
        code = code * (vocab + 1) + ids[at + k]
    return code


def make_block(items: list[tuple[int, str]], size: int = N) -> Block:
    """Items of two words up to ``size`` - 1 have no n-gram and are kept whole."""
    vocab: dict[str, int] = {}
    split = {}
    for i, text in items:
        w = words_of(text or "")
        split[i] = np.array([vocab.setdefault(x, len(vocab) + 1) for x in w], np.int64)
    if (len(vocab) + 1) ** size >= 1 << 63:
        raise ValueError("too many different words in one block")
    owner: dict[int, list[tuple[int, int]]] = {}
    for i, w in split.items():
        for at, code in enumerate(pack(w, np.arange(max(0, len(w) - size + 1)), size, len(vocab)).tolist()):
            owner.setdefault(code, []).append((i, at))
    grams = np.array(sorted(owner), np.int64)
    short: dict[int, dict[tuple[int, ...], list[int]]] = {}
    for i, w in split.items():
        if 2 <= len(w) < size:
            short.setdefault(len(w), {}).setdefault(tuple(w.tolist()), []).append(i)
    return Block(vocab, split, grams, [owner[g] for g in grams.tolist()], size, short)


def numbers(block: Block, text: str) -> np.ndarray:
    get = block.vocab.get
    return np.array([get(w, 0) for w in words_of(text)], np.int64)


def find(block: Block, seeds: dict[int, list[tuple[int, int]]], text: str, least: float) -> list[tuple[int, float, int, int]]:
    """(item_id, score, first word, end word) of each item found in ``text``.

    The score is the best alignment's, over that of the item with itself.
    """
    ids = numbers(block, text)
    at, which = block.positions(ids)
    spots: dict[int, list[int]] = {}
    for p, g in zip(at.tolist(), which.tolist(), strict=True):
        for item, offset in seeds.get(g, ()):
            spots.setdefault(item, []).append(p - offset)
    out = []
    for item, starts in spots.items():
        words = block.items[item]
        m, slack = len(words), max(4, len(words) // 3)
        best, end = (0, 0, 0), -1
        for s in sorted(starts):
            if s + m <= end:  # inside the part that is aligned already
                continue
            lo, hi = max(0, s - slack), min(len(ids), s + m + slack)
            end = hi
            # each match needs a word of the item that the part has: no alignment can beat that
            if np.isin(words, ids[lo:hi]).sum() < least * m:
                continue
            score, a, b = align(words, ids[lo:hi])
            if score > best[0]:
                best = (score, lo + a, lo + b)
        if best[0] >= least * MATCH * m:
            out.append((item, best[0] / (MATCH * m), best[1], best[2]))
    for m, table in block.short.items():
        seen = set()
        for p in np.flatnonzero(ids[: max(0, len(ids) - m + 1)] > 0).tolist():
            for item in table.get(tuple(ids[p : p + m].tolist()), ()):
                if item not in seen:
                    seen.add(item)
                    out.append((item, 1.0, p, p + m))
    return out


def blocks_of(benchmark: DataFrame, most: int = BLOCK_GRAMS) -> Iterator[list[tuple[int | None, str]]]:
    """Items in blocks of about ``most`` words, read one block at a time.

    An item is a distinct pair of id, which may be null, and text; null texts
    are left out.
    """
    items = benchmark.select("item_id", "text").where("text is not null").distinct()
    size = items.agg(F.coalesce(F.sum(F.regexp_count("text", F.lit(r"(?U)\w+"))), F.lit(0)).alias("w")).first()["w"]
    parts = max(1, -(-int(size) // most))
    for k in range(parts):
        block = [(r["item_id"], r["text"]) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect()]
        yield sorted(block, key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def _seeded(rows: DataFrame, benchmark: DataFrame, seeds: int, seed_share: float, most: int) -> Iterator[tuple]:
    """For each block of items: the broadcast block, its seeds, and the items' ids.

    The n-grams of a block are counted over all texts of ``rows``, one scan.
    """
    spark = rows.sparkSession
    small_batches(spark)
    for items in blocks_of(benchmark, most):
        block = make_block([(k, text) for k, (_, text) in enumerate(items)])
        names = spark.sparkContext.broadcast([i for i, _ in items])
        frozen = spark.sparkContext.broadcast(block)  # about ``most`` n-grams

        def count(batches: Iterator[pa.RecordBatch], frozen=frozen) -> Iterator[pa.RecordBatch]:
            b = frozen.value
            total = np.zeros(len(b.grams), np.int64)
            for batch in batches:
                for t in texts(batch.column("text")):
                    total[np.unique(b.positions(numbers(b, t))[1])] += 1
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["g", "n"])

        seen = rows.select("text").where("text is not null").mapInArrow(count, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).collect()
        frequency = np.zeros(len(block.grams), np.int64)
        for r in seen:
            frequency[r["g"]] = r["n"]
        by_item: dict[int, list[tuple[int, int, int]]] = {}
        for g, owners in enumerate(block.owners):
            for item, offset in owners if frequency[g] else ():
                by_item.setdefault(item, []).append((int(frequency[g]), offset, g))
        chosen: dict[int, list[tuple[int, int]]] = {}
        for item, found in by_item.items():
            for _, offset, g in sorted(found)[: max(8, min(seeds, round(seed_share * len(found))))]:
                chosen.setdefault(g, []).append((item, offset))
        yield frozen, spark.sparkContext.broadcast(chosen), names


def hits(docs: DataFrame, benchmark: DataFrame, *, least: float = 0.35, seeds: int = SEEDS, seed_share: float = 0.8, most: int = BLOCK_GRAMS) -> DataFrame:
    """doc_id, item_id, score, word_start, word_end: every item that a text holds.

    Of an item's n-grams that occur at all the rarest seed an alignment: the
    part ``seed_share``, ``seeds`` at most and eight at least.  Null texts hold
    nothing; repeated rows repeat their hits; an id with several texts has a row
    for each that is held; an empty benchmark gives no rows.
    """
    rows = docs.select("doc_id", "text").where("text is not null")
    out = None
    for frozen, chosen, names in _seeded(rows, benchmark, seeds, seed_share, most):

        def search(batches: Iterator[pa.RecordBatch], frozen=frozen, chosen=chosen, names=names) -> Iterator[pa.RecordBatch]:
            b, s, item_ids = frozen.value, chosen.value, names.value
            for batch in batches:
                got = [(i, item_ids[h[0]], *h[1:]) for i, t in zip(batch.column("doc_id").to_pylist(), texts(batch.column("text")), strict=True) for h in find(b, s, t, least)]
                cols = list(zip(*got, strict=True)) if got else [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "score", "word_start", "word_end"])

        part = rows.mapInArrow(search, HITS)
        out = part if out is None else out.unionByName(part)
    return out


def keep(docs: DataFrame, benchmark: DataFrame, *, least: float = 0.35, seeds: int = SEEDS, seed_share: float = 0.8, most: int = BLOCK_GRAMS) -> DataFrame:
    """Rows of ``docs``, all columns, without those whose text holds a test item.

    Each row goes by its own text, whatever its id: one pass for each block of
    items, nothing is joined or shuffled.
    """
    out = docs
    for frozen, chosen, _ in _seeded(docs.select("text"), benchmark, seeds, seed_share, most):

        def clean(batches: Iterator[pa.RecordBatch], frozen=frozen, chosen=chosen) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not find(frozen.value, chosen.value, t, least) for t in texts(batch.column("text"))], pa.bool_()))

        out = out.mapInArrow(clean, docs.schema)
    return out
