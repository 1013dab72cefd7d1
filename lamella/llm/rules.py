"""Quality rules: a learned, ordered decision list over document statistics.

Sequential covering grows one conjunction of thresholds for each class at a
time on labelled statistics, prunes both on rows they were not grown on, takes
the better one, removes what it covers and goes on.  The first rule that holds
decides.  The finished list becomes one ordered ``CASE WHEN`` expression, so
applying it is a plain Spark projection.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CONTINUATION, SPACE, map_arrow, text_bytes, training_labels, with_labels

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stops", "n_digits", "n_distinct")
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in STATS)


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Positions inside some window that occurs twice or more in ``ids``.

    Windows get exact numbers by doubling: pairs, then pairs of pairs, ...
    """
    n = len(ids)
    if n <= window:
        return 0
    span = 1
    while span < window:
        step = min(span, window - span)
        left, right = ids[:-step], ids[step:]
        key = left.astype(np.int64) * (int(ids.max()) + 1) + right
        ids = np.unique(key, return_inverse=True)[1]
        span += step
    count = np.bincount(ids)
    starts = np.flatnonzero(count[ids] > 1)
    if not len(starts):
        return 0
    edge = np.zeros(n + 1, np.int32)
    edge[starts] += 1
    edge[starts + window] -= 1
    return int((np.cumsum(edge[:n]) > 0).sum())


def text_stats(text: bytes) -> tuple[int, ...]:
    """The counts of STATS for one whole text, b"" for null."""
    words = text.split()
    n = len(words)
    distinct = set(words)
    number = {w: i for i, w in enumerate(distinct)}
    repeats = 0
    if n > WINDOW and n - len(distinct) >= WINDOW - 1:
        repeats = repeated_words(np.fromiter(map(number.__getitem__, words), np.int64, n))
    lines = [x for x in text.split(b"\n") if not x.isspace() and x]
    return (
        n,
        len(text.translate(None, CONTINUATION + SPACE)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeats,
        len(lines),
        len(text) - len(text.translate(None, b".!?")),
        len(text) - len(text.translate(None, b"0123456789")),
        len(distinct),
    )


def document_stats(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, STATS and the ``keep`` columns (int) for each row of ``docs``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = np.array([text_stats(t) for t in text_bytes(batch.column("text"))], np.int64).reshape(-1, len(STATS))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(rows[:, i]) for i in range(len(STATS))), *(batch.column(k) for k in keep)],
            names=["doc_id", *STATS, *keep],
        )

    return map_arrow(docs.select("doc_id", "text", *keep), run, SCHEMA + "".join(f", {k} int" for k in keep))


def base_failed() -> Column:
    """Fixed rules that come before the learned list."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


#: Statistics that conditions may test, as expressions over the counts; none divides by zero.
FEATURES = {
    "n_words": "cast(n_words as double)",
    "chars_per_word": "word_chars / cast(greatest(n_words, 1) as double)",
    "symbols_per_word": "n_symbols / cast(greatest(n_words, 1) as double)",
    "dup_line_share": "n_dup_lines / cast(greatest(n_lines, 1) as double)",
    "repeat_share": "n_repeat_words / cast(greatest(n_words, 1) as double)",
    "words_per_line": "n_words / cast(greatest(n_lines, 1) as double)",
    "stops_per_word": "n_stops / cast(greatest(n_words, 1) as double)",
    "digits_per_word": "n_digits / cast(greatest(n_words, 1) as double)",
    "distinct_share": "n_distinct / cast(greatest(n_words, 1) as double)",
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        v = table[self.feature]
        return v > self.threshold if self.above else v <= self.threshold

    def column(self) -> Column:
        v = F.expr(FEATURES[self.feature])
        return v > F.lit(self.threshold) if self.above else v <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    """Rows that meet all conditions are rejected, or kept; without conditions, all rows."""

    conditions: tuple[Condition, ...]
    kept: bool = False

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        hit = np.ones(len(next(iter(table.values()))), bool)
        for c in self.conditions:
            hit &= c.holds(table)
        return hit

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column()
        return out

    def __str__(self) -> str:
        return ("keep" if self.kept else "reject") + " if " + (" and ".join(map(str, self.conditions)) or "true")


def _gain(pos: np.ndarray, neg: np.ndarray, pos0: float, neg0: float) -> np.ndarray:
    """FOIL's information gain of narrowing (pos0, neg0) to (pos, neg)."""
    with np.errstate(divide="ignore", invalid="ignore"):
        g = pos * (np.log2(pos / (pos + neg)) - np.log2(pos0 / (pos0 + neg0)))
    return np.where(pos > 0, g, -np.inf)


def _grow(table: dict[str, np.ndarray], bad: np.ndarray, most: int) -> list[Condition]:
    inside = np.ones(len(bad), bool)
    found: list[Condition] = []
    while len(found) < most and (~bad[inside]).any():
        pos0, neg0 = float(bad[inside].sum()), float((~bad[inside]).sum())
        best: tuple[float, Condition | None] = (1e-9, None)
        for name, values in table.items():
            v, b = values[inside], bad[inside]
            order = np.argsort(v, kind="stable")
            v, b = v[order], b[order]
            cut = np.flatnonzero(v[1:] > v[:-1])
            if not len(cut):
                continue
            pos, neg = np.cumsum(b)[cut].astype(float), np.cumsum(~b)[cut].astype(float)
            middle = (v[cut] + v[cut + 1]) / 2
            for above, p, q in ((False, pos, neg), (True, pos0 - pos, neg0 - neg)):
                g = _gain(p, q, pos0, neg0)
                k = int(np.argmax(g))
                if g[k] > best[0]:
                    best = (float(g[k]), Condition(name, above, float(middle[k])))
        if best[1] is None:
            break
        found.append(best[1])
        inside &= best[1].holds(table)
    return found


def _worth(conditions: list[Condition], table: dict[str, np.ndarray], bad: np.ndarray) -> float:
    hit = Rule(tuple(conditions)).holds(table)
    p, n = float(bad[hit].sum()), float((~bad[hit]).sum())
    return (p - n) / (p + n) if p + n else -1.0


#: Splits of the rows that are tried before the list ends.
TRIES = 3


def learn(table: dict[str, np.ndarray], bad: np.ndarray, *, most_rules: int = 12, most_conditions: int = 4, least_precision: float = 0.8, least_cover: int = 5, seed: int = 7) -> list[Rule]:
    """Sequential covering: grow on two thirds, prune on one third, until no rule is worth it.

    A rule has to be right ``least_precision`` of the time and to halve the error
    of its class's share in the rows left.  Of a rule for each class the purer one
    on the rows it was pruned on goes first, a rejection if both are alike.  What no
    rule decides is kept, or rejected by a last rule without conditions where
    nearly all that is left is bad.  No rows, or rows of one class only, give
    an empty list.
    """
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    rng = np.random.default_rng(seed)
    tries = 0
    if bad.all():
        return rules
    while len(rules) < most_rules and tries < TRIES and bad[left].any() and not bad[left].all():
        grow = rng.random(len(bad)) < 2 / 3
        g, p = left & grow, left & ~grow
        part = {k: v[g] for k, v in table.items()}
        rest = {k: v[p] for k, v in table.items()}
        best: tuple[float, Rule | None] = (-1.0, None)
        for kept, target in ((False, bad), (True, ~bad)):
            conditions = _grow(part, target[g], most_conditions) if target[g].any() else []
            while len(conditions) > 1 and _worth(conditions[:-1], rest, target[p]) >= _worth(conditions, rest, target[p]):
                conditions.pop()
            rule = Rule(tuple(conditions), kept)
            hit = rule.holds(table) & left
            enough = max(least_precision, 1 - (1 - target[left].mean()) / 2)
            if conditions and hit.sum() >= least_cover and target[hit].mean() >= enough and (worth := _worth(conditions, rest, target[p])) > best[0]:
                best = (worth, rule)
        if best[1] is None:
            tries += 1
            continue
        tries = 0
        rules.append(best[1])
        left &= ~best[1].holds(table)
    if left.sum() >= least_cover and bad[left].mean() >= least_precision:
        rules.append(Rule(()))
    return rules


def decide(rules: list[Rule], table: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(kept, number of the rule that decides, 0 if none) for rows of statistics."""
    n = len(next(iter(table.values())))
    kept, which = np.ones(n, bool), np.zeros(n, int)
    for i, rule in enumerate(rules, 1):
        hit = rule.holds(table) & (which == 0)
        kept[hit], which[hit] = rule.kept, i
    return kept, which


def fit(docs: DataFrame, labels: DataFrame, *, modulus: int = 3, remainder: int = 1, bound: int = 20_000) -> list[Rule]:
    """A list learned from about ``bound`` labelled rows at most (sampled by id hash).

    Rows that the base rules reject anyway take no part.  No labels: an empty list.
    """
    train = training_labels(labels, "quality", modulus, remainder, bound)
    stats = document_stats(with_labels(docs, train), "y").where(~base_failed())
    rows = stats.select(*(F.expr(e).alias(k) for k, e in FEATURES.items()), (F.col("y") == 0).alias("bad")).toArrow()
    table = {k: rows.column(k).to_numpy(zero_copy_only=False).astype(float) for k in FEATURES}
    return learn(table, rows.column("bad").to_numpy(zero_copy_only=False).astype(bool))


def verdict(rules: list[Rule]) -> tuple[Column, Column]:
    """(kept, number of the rule that decides, from 1; 0 if none) as ordered conditions."""
    which, kept = F.lit(0), F.lit(True)
    for i in range(len(rules), 0, -1):
        which = F.when(rules[i - 1].column(), F.lit(i)).otherwise(which)
        kept = F.when(rules[i - 1].column(), F.lit(rules[i - 1].kept)).otherwise(kept)
    return kept, which


def apply(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Counts and verdict for each row of ``docs``.

    A null or blank text has no words and fails the base rules; repeated rows
    give repeated results; a null doc_id passes through.
    """
    kept, which = verdict(rules)
    return document_stats(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"),
        (~base_failed() & kept).alias("kept"),
        which.alias("rule"),
    )
