"""Toxicity by multiple-instance learning.

A document is a bag of sentences and only the bag is labelled.  Each sentence
with evidence gets a logistic score, noisy-or combines them into the document's
probability, and the weights are fitted through that combination.  The same
sentence scores then locate the offending sentences.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_arrow, texts, training_labels, with_labels

WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"[^.!?\n]+")
PREFIXES = (4, 5, 6)
#: Words that a worker remembers the weight of; the memory is emptied when full.
REMEMBERED = 200_000


def features_of(word: str) -> list[str]:
    """A lower-cased word and its longer prefixes, marked by a leading ``^``."""
    return [word, *("^" + word[:k] for k in PREFIXES if len(word) > k)]


@dataclass
class Model:
    """``weights`` by feature; ``bias`` of a sentence with evidence; ``leak`` of any document."""

    weights: dict[str, float]
    bias: float
    leak: float
    _seen: dict[str, float] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "bias": self.bias, "leak": self.leak, "_seen": {}}

    def word(self, w: str) -> float:
        got = self._seen.get(w)
        if got is None:
            get = self.weights.get
            got = sum(get(f, 0.0) for f in features_of(w))
            if len(self._seen) >= REMEMBERED:
                self._seen.clear()
            self._seen[w] = got
        return got

    def document(self, text: str) -> tuple[float, int, int, int, float]:
        """(score, sentences over one half, start and end of the worst in code points, its score).

        Without evidence: the leak alone, no sentence, -1 and -1, 0.
        """
        low = text.lower()
        if len(low) != len(text):  # some code points grow when lower-cased: keep offsets true
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        if not any(self.word(w) for w in set(WORD.findall(low))):
            return self.leak, 0, -1, -1, 0.0
        clean, n, worst = 1.0 - self.leak, 0, (-1, -1, 0.0)
        for m in SENTENCE.finditer(low):
            values = [v for w in WORD.findall(m[0]) if (v := self.word(w))]
            if values:
                p = 1 / (1 + np.exp(-np.clip(self.bias + sum(values), -30, 30)))
                clean *= 1 - p
                n += p > 0.5
                if p > worst[2]:
                    worst = (m.start(), m.end(), float(p))
        return float(min(max(1 - clean, 0.0), 1.0)), n, *worst


def _select(rows: DataFrame, most: int, least_docs: int) -> list[str]:
    """Features whose document frequency leans to label 1, the strongest ``most``.

    Counts cover every sampled document; only the model's width is bounded.
    """

    def counts(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for t, y in zip(texts(batch.column("text")), batch.column("y").to_pylist(), strict=True):
            seen[y].update({f for w in set(WORD.findall(t.lower())) for f in features_of(w)})
        keys = list({*seen[0], *seen[1]})
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([seen[1][k] for k in keys], pa.int64()), pa.array([seen[0][k] for k in keys], pa.int64())], names=["f", "pos", "neg"])

    size = rows.groupBy("y").count().collect()
    n = {r["y"]: r["count"] for r in size}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return []
    df = map_arrow(rows.select("text", "y"), counts, "f string, pos long, neg long").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    lean = F.log((F.col("pos") + 0.5) / (n1 + 1) / ((F.col("neg") + 0.5) / (n0 + 1)))
    error = F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
    best = df.where(F.col("pos") >= least_docs).withColumn("z", lean / error).where((F.col("z") > 2.5) & (lean > 1.0)).orderBy(F.col("z").desc(), "f").limit(most)
    return [r["f"] for r in best.collect()]


def _descend(label: np.ndarray, sent_doc: np.ndarray, pair_sent: np.ndarray, pair_feat: np.ndarray, width: int, *, steps: int, rate: float, decay: float) -> tuple[np.ndarray, float, float]:
    """Adam on the noisy-or likelihood; sums run over (sentence, feature) pairs."""
    theta = np.zeros(width + 2)
    theta[:width], theta[width], theta[width + 1] = 1.0, -1.0, np.log(0.05 / 0.95)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    docs, sents = len(label), len(sent_doc)
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    for step in range(1, steps + 1):
        p = sig(np.bincount(pair_sent, theta[pair_feat], sents) + theta[width])
        leak = sig(theta[width + 1])
        log_clean = np.bincount(sent_doc, np.log1p(-np.minimum(p, 1 - 1e-9)), docs) + np.log1p(-leak)
        clean = np.exp(log_clean)
        # d loss / d log_clean: 1 for label 0 turned round, clean / (1 - clean) for label 1
        d = np.where(label == 1, clean / np.maximum(1 - clean, 1e-6), -1.0)
        grad_s = d[sent_doc] * -p
        grad = np.append(np.bincount(pair_feat, grad_s[pair_sent], width), [grad_s.sum(), (d * -leak).sum()]) / docs
        grad[:width] += decay * theta[:width]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:width], float(theta[width]), float(sig(theta[width + 1]))


def fit(docs: DataFrame, labels: DataFrame, *, modulus: int = 4, remainder: int = 2, bound: int = 20_000, width: int = 512, least_docs: int = 5, steps: int = 300) -> Model:
    """Fit on about ``bound`` labelled rows at most, sampled by id hash.

    No rows, or one class only, give a model without evidence and a leak of the base rate.
    """
    train = training_labels(labels, "toxic", modulus, remainder, bound)
    rows = with_labels(docs, train)
    chosen = _select(rows, width, least_docs)
    number = {f: i for i, f in enumerate(chosen)}

    def bags(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for t in texts(batch.column("text")):
            bag = []
            for s in SENTENCE.findall(t.lower()):
                found = [number[f] for w in WORD.findall(s) for f in features_of(w) if f in number]
                if found:
                    bag.append(found)
            out.append(bag)
        return pa.RecordBatch.from_arrays([batch.column("y"), pa.array(out, pa.list_(pa.list_(pa.int32())))], names=["y", "bag"])

    # bounded: the sample's rows, with ids of the chosen features only
    got = map_arrow(rows.select("text", "y"), bags, "y int, bag array<array<int>>").toArrow()
    label = np.array(got.column("y").to_pylist(), np.int64)
    if not chosen or not len(label):
        return Model({}, 0.0, float(label.mean()) if len(label) else 0.0)
    sent_doc, pair_sent, pair_feat = [], [], []
    for i, bag in enumerate(got.column("bag").to_pylist()):
        for s in bag:
            pair_sent.extend([len(sent_doc)] * len(s))
            pair_feat.extend(s)
            sent_doc.append(i)
    w, bias, leak = _descend(label, np.array(sent_doc, np.int64), np.array(pair_sent, np.int64), np.array(pair_feat, np.int64), len(chosen), steps=steps, rate=0.05, decay=1e-4)
    return Model({f: float(x) for f, x in zip(chosen, w, strict=True) if x}, bias, leak)


def apply(docs: DataFrame, model: Model, *, modulus: int = 4, remainder: int = 2, threshold: float = 0.3) -> DataFrame:
    """Score of each row, with the worst sentence's place in the text (code points).

    A null text scores as an empty one, the leak; repeated rows repeat.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [model.document(t) for t in texts(batch.column("text"))]
        cols = list(zip(*rows, strict=True)) if rows else [()] * 5
        kinds = (pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "score", "n_offending", "worst_start", "worst_end", "worst_score"])

    scored = map_arrow(docs.select("doc_id", "text"), run, "doc_id long, score double, n_offending int, worst_start int, worst_end int, worst_score double")
    return scored.select("doc_id", held_out(F.col("doc_id"), modulus, remainder).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_offending", "worst_start", "worst_end", "worst_score")
