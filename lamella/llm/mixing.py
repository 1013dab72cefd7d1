"""Mixing sources to target weights over a domain, language and source tree.

The budget flows down the tree in proportion to weights.  No child gets more
than its capacity, its tokens times the number of epochs allowed; what a child
can't use goes to its siblings, and what a whole subtree can't use goes to the
siblings of its root.  Each leaf then gives its full epochs and, of one more
epoch in seeded order, the prefix that its budget still allows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Tree levels from the top; "domain" is a parameter, the last character of source if not given.
LEVELS = ("domain", "lang", "source")
#: Integer weights by level and value; others weigh 1.
WEIGHTS = {"lang": {"en": 4, "de": 2, "fr": 2, "es": 1}}
#: Rows of a leaf in one slice of its order, about; only one slice is sorted.
SLICE_ROWS = 500
#: Leaves up to which the table of leaves is broadcast.
BROADCAST_LEAVES = 50_000


def tree_columns(domain: Column | None = None) -> dict[str, Column]:
    """A null domain, language or source counts as the value ``unknown``."""
    source = F.coalesce("source", F.lit("unknown"))
    return {"domain": F.right(source, F.lit(1)) if domain is None else F.coalesce(domain.cast("string"), F.lit("unknown")), "lang": F.coalesce("lang", F.lit("unknown")), "source": source}


def n_tokens() -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _id() -> Column:
    """The id, or a number for a null one; :func:`_key` tells it from an id of that number."""
    return F.coalesce("doc_id", F.lit(-(1 << 63)))


def _key() -> Column:
    return F.xxhash64("text", F.col("doc_id").isNull())


def order(seed: int, epoch: Column) -> Column:
    """The place of a row in its leaf's order of one epoch: 60 bits of a digest."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(str(seed)), epoch.cast("string"))), 1, 15), 16, 10).cast("long")


def weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    out = F.lit(1)
    for value, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == value, F.lit(w)).otherwise(out)
    return out.cast("double")


def share_out(children: DataFrame, parent: list[str]) -> DataFrame:
    """``budget`` of each child (w, capacity, parent_budget) of every parent.

    Water filling in one sorted pass: children fill up in the order of
    capacity / w, and the first that doesn't ends it.  The window holds the
    children of one parent, never documents.
    """
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    ordered = by.orderBy(F.col("capacity") / F.col("w"), *[c for c in children.columns if c in LEVELS])
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    rows = children.withColumns({"used": F.coalesce(F.sum("capacity").over(before), F.lit(0)).cast("double"), "gone": F.coalesce(F.sum("w").over(before), F.lit(0.0)), "all_w": F.sum("w").over(by)})
    level = (F.col("parent_budget") - F.col("used")) / (F.col("all_w") - F.col("gone"))
    rows = rows.withColumn("full", F.col("capacity") <= F.col("w") * level)
    # what the full ones leave goes to the others by weight; floors of running shares lose no token
    rest = F.min(F.when(~F.col("full"), F.struct("gone", "used"))).over(by)
    rows = rows.withColumn("left", F.col("parent_budget") - rest["used"]).withColumn("of", F.col("all_w") - rest["gone"]).withColumn("low", F.col("gone") - rest["gone"])
    upto = lambda c: F.when(c >= F.col("of"), F.col("left")).otherwise(F.floor(F.col("left") * c / F.col("of")))
    share = upto(F.col("low") + F.col("w")) - upto(F.col("low"))
    return rows.withColumn("budget", F.when(F.col("full"), F.col("capacity")).otherwise(share).cast("long")).drop("used", "gone", "all_w", "full", "left", "of", "low")


def budgets(leaves: DataFrame, total: int, max_epochs: int, weights: dict[str, dict[str, int]]) -> DataFrame:
    """LEVELS, tokens and budget of each leaf (LEVELS, tokens)."""
    above = None
    for depth in range(1, len(LEVELS) + 1):
        path = list(LEVELS[:depth])
        nodes = leaves.groupBy(*path).agg((F.sum("tokens") * max_epochs).alias("capacity")).withColumn("w", weight(path[-1], weights))
        if above is None:
            nodes = nodes.withColumn("parent_budget", F.lit(float(total)))
        else:
            nodes = nodes.join(above, path[:-1])
        above = share_out(nodes, path[:-1]).select(*path, F.col("budget").cast("double").alias("parent_budget"))
    return leaves.join(above.select(*LEVELS, F.col("parent_budget").cast("long").alias("budget")), list(LEVELS))


def select(docs: DataFrame, *, budget_share: float = 0.5, max_epochs: int = 2, weights: dict[str, dict[str, int]] | None = None, seed: int = 13, slice_rows: int = SLICE_ROWS, domain: Column | None = None) -> DataFrame:
    """doc_id, mix_key, LEVELS, epoch, n_tokens and tokens_taken, a row for each document and epoch.

    The budget is ``budget_share`` of all tokens.  The last document of a leaf
    may be taken in part: tokens_taken is the prefix that counts.  Documents
    without words are never taken; repeated rows are separate documents.
    ``mix_key`` hashes the text and, with the id, finds the row again.  Leaf
    budgets add up to the whole, or to all that the epochs allow.
    """
    weights = WEIGHTS if weights is None else weights
    rows = stored(docs.select("doc_id", _key().alias("mix_key"), *(c.alias(k) for k, c in tree_columns(domain).items()), n_tokens().alias("n_tokens")).where("n_tokens > 0"), "mix")
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    leaves = stored(leaves, "leaves")
    totals = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t"), F.count("*").alias("n"), F.coalesce(F.max("docs"), F.lit(0)).alias("m")).first()
    plan = stored(
        budgets(leaves, int(totals["t"] * budget_share), max_epochs, weights)
        .withColumn("full", F.floor(F.col("budget") / F.col("tokens")).cast("int"))
        .withColumn("rest", F.col("budget") - F.col("full") * F.col("tokens"))
        .select(*LEVELS, "full", "rest"),
        "budgets",
    )
    small = F.broadcast if totals["n"] <= BROADCAST_LEAVES else (lambda x: x)
    slices = max(1, 1 << max(0, int(totals["m"]) // slice_rows).bit_length())
    placed = rows.join(small(plan), list(LEVELS)).withColumn("place", order(seed, F.col("full"))).withColumn("slice", F.shiftright("place", 60 - slices.bit_length() + 1).cast("int"))
    # the slice of each leaf in which its rest ends, and the tokens before it
    by_slice = placed.where("rest > 0").groupBy(*LEVELS, "slice", "rest").agg(F.sum("n_tokens").alias("t"))
    run = Window.partitionBy(*LEVELS).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    last = by_slice.withColumn("before", F.coalesce(F.sum("t").over(run), F.lit(0))).where("before < rest and before + t >= rest").select(*LEVELS, F.col("slice").alias("last_slice"), "before")
    placed = placed.join(small(last), list(LEVELS), "left")
    out = ["doc_id", "mix_key", *LEVELS, "epoch", "n_tokens", "tokens_taken"]
    whole = placed.where("full > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("full") - 1))).withColumn("tokens_taken", F.col("n_tokens"))
    ahead = placed.where("rest > 0 and slice < last_slice").withColumn("epoch", F.col("full")).withColumn("tokens_taken", F.col("n_tokens"))
    edge = Window.partitionBy(*LEVELS, "slice").orderBy("place", "doc_id", "mix_key").rowsBetween(Window.unboundedPreceding, -1)
    partly = (
        placed.where("rest > 0 and slice = last_slice")
        .withColumn("start", F.col("before") + F.coalesce(F.sum("n_tokens").over(edge), F.lit(0)))
        .where("start < rest")
        .withColumn("epoch", F.col("full"))
        .withColumn("tokens_taken", F.least(F.col("n_tokens"), F.col("rest") - F.col("start")))
    )
    return reduce(DataFrame.unionByName, [x.select(*out) for x in (whole, ahead, partly)])


def mixed(docs: DataFrame, **options) -> DataFrame:  # noqa: ANN003
    """Columns of ``docs`` with ``epoch`` and ``tokens_taken``, for each document and epoch taken.

    Columns of these names that ``docs`` has are replaced.  Of rows with equal
    id and text the other columns of one stand for all.
    """
    new = ("epoch", "tokens_taken")
    keys = ["lamella_id", "lamella_key"]
    taken = select(docs, **options).select(_id().alias(keys[0]), F.col("mix_key").alias(keys[1]), *(F.col(c).alias(f"lamella_{c}") for c in new))
    rows = docs.drop(*new).withColumns({keys[0]: _id(), keys[1]: _key()}).dropDuplicates(keys)
    return rows.join(taken, keys).select(*(c for c in docs.columns if c not in new), *(F.col(f"lamella_{c}").alias(c) for c in new))


def _weight_sql(level: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS.get(level, {}).items())
    return f"(CASE {level} {cases} ELSE 1 END)::DOUBLE" if cases else "1::DOUBLE"


def _level_sql(depth: int, total: str) -> str:
    path, parent = LEVELS[:depth], LEVELS[: depth - 1]
    by = f"PARTITION BY {', '.join(parent)}" if parent else ""
    above = f"JOIN b{depth - 1} USING ({', '.join(parent)})" if parent else f"CROSS JOIN (SELECT {total} AS parent_budget)"
    ordered = f"{by} ORDER BY capacity / w, {', '.join(path)}"
    return f"""
n{depth} AS (SELECT {', '.join(path)}, sum(tokens) * 2 AS capacity, {_weight_sql(path[-1])} AS w FROM leaves GROUP BY {', '.join(path)}),
u{depth} AS (SELECT *, coalesce(sum(capacity) OVER ({ordered} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS used,
  coalesce(sum(w) OVER ({ordered} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone, sum(w) OVER ({by}) AS all_w FROM n{depth} {above}),
f{depth} AS (SELECT *, capacity <= w * ((parent_budget - used) / (all_w - gone)) AS isfull FROM u{depth}),
r{depth} AS (SELECT *, first_value(CASE WHEN NOT isfull THEN gone END IGNORE NULLS) OVER x AS g0, first_value(CASE WHEN NOT isfull THEN used END IGNORE NULLS) OVER x AS u0 FROM f{depth} WINDOW x AS ({by} ORDER BY gone ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
b{depth} AS (SELECT {', '.join(path)}, (CASE WHEN isfull THEN capacity ELSE
  (CASE WHEN gone + w - g0 >= all_w - g0 THEN parent_budget - u0 ELSE floor((parent_budget - u0) * (gone + w - g0) / (all_w - g0)) END)
  - (CASE WHEN gone - g0 >= all_w - g0 THEN parent_budget - u0 ELSE floor((parent_budget - u0) * (gone - g0) / (all_w - g0)) END) END)::DOUBLE AS parent_budget FROM r{depth})"""


ORACLE = f"""
WITH d AS (SELECT doc_id, right(coalesce(source, 'unknown'), 1) AS domain, coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM documents),
rows_ AS (SELECT * FROM d WHERE n_tokens > 0),
leaves AS (SELECT domain, lang, source, sum(n_tokens) AS tokens FROM rows_ GROUP BY ALL),
{','.join(_level_sql(k, '(SELECT floor(sum(tokens) * 0.5)::DOUBLE FROM leaves)') for k in (1, 2, 3))},
plan AS (SELECT domain, lang, source, floor(parent_budget / tokens)::INT AS full_, (parent_budget - floor(parent_budget / tokens) * tokens)::BIGINT AS rest FROM leaves JOIN b3 USING (domain, lang, source)),
placed AS (SELECT *, ('0x' || substr(md5(doc_id || ':13:' || full_), 1, 15))::BIGINT AS place FROM rows_ JOIN plan USING (domain, lang, source)),
ended AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM placed)
SELECT doc_id, domain, lang, source, unnest(range(0, full_))::INT AS epoch, n_tokens, n_tokens AS tokens_taken FROM placed WHERE full_ > 0
UNION ALL SELECT doc_id, domain, lang, source, full_, n_tokens, least(n_tokens, rest - start)::BIGINT FROM ended WHERE rest > 0 AND start < rest
"""
