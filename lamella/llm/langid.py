"""Language identification by prediction by partial matching (PPM).

One variable-order byte context tree for each language, with the counts frozen
after training.  A byte seen in its context costs -log2(c / (n + q)) bits, n
being the context's bytes and q its distinct ones; else the escape
-log2(q / (n + q)) is paid and the next shorter context asked, down to 8 bits
for any byte.  Escapes don't exclude bytes of the longer context, so each cost
depends on (context, byte) alone and whole texts are scored by table look-up.
Only (context, byte) pairs that some language has seen are stored, with their
costs in all languages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, id_remainder, map_arrow, small_batches, texts

ORDER = 3
LETTER = re.compile(r"[^\W\d_]")
#: Bytes that are looked up at once; longer texts go in pieces that overlap by ORDER.
PIECE = 1 << 20
UNKNOWN = "und"


def padded(text: bytes) -> np.ndarray:
    return np.frombuffer(b"\n" * ORDER + text, np.uint8)


def grams(text: np.ndarray) -> np.ndarray:
    """(ORDER + 1)-grams as numbers, the first byte highest."""
    t = text.astype(np.uint32)
    out = t[: len(t) - ORDER]
    for k in range(1, ORDER + 1):
        out = (out << 8) | t[k : len(t) - ORDER + k]
    return out


def has_letter(text: str) -> bool:
    """Numerals such as one half or a circled one are no letters, though they are word characters."""
    return any(m[0].isalpha() for m in LETTER.finditer(text))


class Index:
    """Places of 32-bit keys: a hash table with linear probing, a quarter full at most."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = np.asarray(keys, np.uint32)
        self.shift = np.uint32(32 - max(2, (4 * len(self.keys)).bit_length()))
        self.slots = np.full(1 << (32 - int(self.shift)), -1, np.int32)
        self.mask = len(self.slots) - 1
        left = np.arange(len(self.keys))
        at = self.start(self.keys)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + 1) & self.mask

    def start(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(2654435761)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 if it has none."""
        out = np.full(len(keys), -1, np.int32)
        if not len(self.keys):
            return out
        open_, at, wanted = None, self.start(keys), keys
        while True:
            found = self.slots[at]
            hit = (found >= 0) & (self.keys[found] == wanted)
            if open_ is None:
                out[hit] = found[hit]
                open_ = np.flatnonzero((found >= 0) & ~hit)
                at, wanted = (at[open_] + 1) & self.mask, keys[open_]
            else:
                out[open_[hit]] = found[hit]
                more = (found >= 0) & ~hit
                open_, at = open_[more], (at[more] + 1) & self.mask
                wanted = keys[open_]
            if not len(open_):
                return out


@dataclass
class Level:
    """Pairs of one order: bits of each pair, and of the escape from each context, by language."""

    pairs: Index
    cost: np.ndarray
    contexts: Index
    escape: np.ndarray


@dataclass
class Model:
    """Frozen costs, ``levels`` by order from 0 up."""

    langs: list[str]
    levels: list[Level]

    def bits(self, text: bytes) -> np.ndarray:
        """Code length of ``text`` under each language."""
        total = np.zeros(len(self.langs))
        whole = padded(text)
        piece = max(1 << 12, PIECE // max(1, len(self.langs)))
        for at in range(0, len(whole) - ORDER, piece):
            g = grams(whole[at : at + piece + ORDER])
            for order in range(ORDER, -1, -1):
                level = self.levels[order]
                g = g & np.uint32((1 << 8 * (order + 1)) - 1)
                place = level.pairs.find(g)
                seen = place >= 0
                total += level.cost[place[seen]].sum(0, dtype=np.float64)
                g = g[~seen]
                if not len(g):
                    break
                context = level.contexts.find(g >> np.uint32(8))
                total += level.escape[context[context >= 0]].sum(0, dtype=np.float64)
            total += 8.0 * len(g)
        return total

    def document(self, text: str) -> tuple[str, float]:
        if not self.langs or not has_letter(text):
            return UNKNOWN, 0.0
        bits = self.bits(text.encode("utf-8", "surrogatepass"))
        best = int(bits.argmin())
        return self.langs[best], float(1 / np.exp2(np.maximum(bits.min() - bits, -1000)).sum())


def build(counts: dict[str, tuple[np.ndarray, np.ndarray]], *, most_nodes: int = 60_000) -> Model:
    """The model of ``counts``: by language, grams and how often each occurred.

    ``most_nodes`` bounds the tree's longest contexts, the most frequent first;
    bytes after a pruned context are scored by its shorter suffix.  Memory grows
    with the pairs seen times the languages, whatever the alphabet.
    """
    langs = sorted(counts)
    levels: list[Level] = []
    for order in range(ORDER + 1):
        seen = []
        for x in langs:
            g, n = counts[x]
            keys, inverse = np.unique(g & np.uint32((1 << 8 * (order + 1)) - 1), return_inverse=True)
            seen.append((keys, np.bincount(inverse, n, len(keys))))
        pairs = np.unique(np.concatenate([k for k, _ in seen])) if seen else np.zeros(0, np.uint32)
        contexts, at = np.unique(pairs >> np.uint32(8), return_inverse=True)
        if order == ORDER and len(contexts) > most_nodes:
            weight = np.zeros(len(contexts))
            for k, n in seen:
                np.add.at(weight, np.searchsorted(contexts, k >> np.uint32(8)), n)
            kept = np.zeros(len(contexts), bool)
            kept[np.argsort(-weight, kind="stable")[:most_nodes]] = True
            pairs = pairs[kept[at]]
            contexts, at = np.unique(pairs >> np.uint32(8), return_inverse=True)
        escape = np.zeros((len(contexts), len(langs)), np.float32)
        own = np.full((len(pairs), len(langs)), np.nan, np.float32)
        for j, (k, n) in enumerate(seen):
            place = np.searchsorted(pairs, k)
            ok = place < len(pairs)
            ok[ok] = pairs[place[ok]] == k[ok]
            place, n = place[ok], n[ok]
            size, kinds = np.bincount(at[place], n, len(contexts)), np.bincount(at[place], minlength=len(contexts))
            has = size > 0
            escape[has, j] = -np.log2(kinds[has] / (size[has] + kinds[has]))
            own[place, j] = -np.log2(n / (size + kinds)[at[place]])
        if order:
            shorter = levels[-1]
            rest = shorter.cost[shorter.pairs.find(pairs & np.uint32((1 << 8 * order) - 1))]
        else:
            rest = np.float32(8.0)
        levels.append(Level(Index(pairs), np.where(np.isnan(own), escape[at] + rest, own) if len(pairs) else own, Index(contexts), escape))
    return Model(langs, levels)


def fit(docs: DataFrame, *, modulus: int = 4, remainder: int = 2, chars: int = 600_000, most_nodes: int = 60_000, seed: int = 5) -> Model:
    """Learn from rows outside the held-out fold whose lang isn't null.

    For each language about ``chars`` code points of whole texts at most,
    sampled by id hash, but always the text of the smallest hash that isn't
    empty, so no language is missing.  Without such rows the model answers ``und`` always.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.coalesce(id_remainder(F.col("doc_id"), modulus) != remainder, F.lit(False)))
    place = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30))
    least = F.min(F.when(F.length("text") > 0, place)).alias("least")
    sizes = {r["lang"]: (r["n"], r["least"]) for r in rows.groupBy("lang").agg(F.sum(F.length("text")).alias("n"), least).collect()}
    if not sizes:
        return build({})
    below = [(lang, max(int(min(1.0, chars / max(n, 1)) * (1 << 30)), -1 if first is None else first + 1)) for lang, (n, first) in sorted(sizes.items())]
    # a row for each language
    share = F.broadcast(spark.createDataFrame(below, "lang string, below long"))
    sample = rows.join(share, "lang").where(place < F.col("below")).select("lang", "text")
    small_batches(spark)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(b.column("lang").to_pylist(), texts(b.column("text")), strict=True):
                by.setdefault(lang, []).append(grams(padded(text.encode())))
            for lang, parts in by.items():
                g, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "g", "n"])

    got = sample.mapInArrow(count, "lang string, g long, n long").groupBy("lang", "g").agg(F.sum("n").alias("n")).toArrow()
    names = np.array(got.column("lang").to_pylist(), object)
    g, n = got.column("g").to_numpy().astype(np.uint32), got.column("n").to_numpy().astype(np.float64)
    return build({x: (g[names == x], n[names == x]) for x in sorted(set(names.tolist()))}, most_nodes=most_nodes)


def apply(docs: DataFrame, model: Model, *, modulus: int = 4, remainder: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred and score for each row.

    Null texts and texts without a letter are ``und`` with score 0.
    """
    spark = docs.sparkSession
    frozen = spark.sparkContext.broadcast(model)  # at most most_nodes contexts: bounded

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = frozen.value
        rows = [m.document(t) for t in texts(batch.column("text"))]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())], names=["doc_id", "lang_pred", "score"])

    scored = map_arrow(docs.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double")
    return scored.select("doc_id", held_out(F.col("doc_id"), modulus, remainder).alias("held_out"), "lang_pred", "score")
