"""Near-duplicate documents by min-max hashing.

Each of P permutations of a document's shingles gives two values, its minimum
and its maximum, so 2 P signature values cost P hash evaluations.  Both kinds
agree between two sets with probability equal to their Jaccard similarity.
Bands of R values are looked up for candidates, and every link is confirmed on
the full shingle sets.

The work is spread so that no group of copies meets in one task as pairs:

1. Documents with equal shingle sets become one class (a min and a count).
2. Within a band's bucket each class is compared with the bucket's hub alone,
   a class that meets many others: rows, not pairs, grow with a group.
3. Confirmed links join classes into components.  A bucket whose other members
   lie in one component is finished.  The others take a new hub while
   that finds links; then what still differs is compared across components,
   by a prefix filter over shingles in order of frequency.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .common import map_arrow, remove_path, scratch_path, small_batches, text_bytes

#: 50 bands of 6 values: sets with similarity 0.8 share no band 2.5 times in 1e7,
#: unrelated ones with similarity 0.1 share one 5 times in 1e5.
BANDS, ROWS = 50, 6
PERMUTATIONS = BANDS * ROWS // 2
#: Shingles that are hashed at once for a document.
PIECE = 1 << 11
#: Values whose lowest four bits make up the sketch, packed in longs.
SKETCHED, LONGS = 128, 8
HUB_TURNS = 4
#: Ids that are broadcast at most, 8 MB.
BROADCAST_IDS = 1_000_000
#: A turn that gives a link for fewer than one in so many documents is the last.
HUB_WORTH = 1000


def words_of(text: bytes) -> list[bytes]:
    """Words with A-Z lower-cased; bytes.lower() touches no other letters."""
    return text.lower().split()


def shingles_of(words: list[bytes], size: int) -> set:
    """Distinct ``size``-word shingles; the whole sequence as one if it is shorter; none without words."""
    if not words:
        return set()
    if len(words) < size:
        return {tuple(words)}
    return set(zip(*(words[k:] for k in range(size)), strict=False))


def _fmix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (the finaliser of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Hasher:
    """Signatures; one for each worker, with the word hashes of the current batch."""

    def __init__(self, size: int, seed: int = 1) -> None:
        import xxhash

        self.word = xxhash.xxh3_64_intdigest
        self.size = size
        rng = np.random.default_rng(seed)
        self.mul = (rng.integers(0, 1 << 31, (PERMUTATIONS, 1), np.uint32) * np.uint32(2)) | np.uint32(1)
        self.add = rng.integers(0, 1 << 32, (PERMUTATIONS, 1), np.uint32)
        self.salt = _fmix(np.arange(1, BANDS + 1, dtype=np.uint64) << np.uint64(20))

    def sets(self, text: bytes, known: dict[bytes, int]) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the text's shingles."""
        words = words_of(text)
        n = len(words)
        if not n:
            return np.zeros(0, np.uint64)
        h = self.word
        for w in set(words):
            if w not in known:
                known[w] = h(w)
        v = np.fromiter(map(known.__getitem__, words), np.uint64, n)
        k = min(self.size, n)
        out = np.full(n - k + 1, np.uint64(k))
        with np.errstate(over="ignore"):
            for j in range(k):
                out = _fmix(out * np.uint64(0x9E3779B97F4A7C15) + v[j : n - k + 1 + j])
        return np.unique(out)

    def bands(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(band keys, sketch) of the minima and maxima under every permutation.

        A permutation is an odd multiplication and a shift of the hashes' high
        halves, a bijection of 32-bit numbers; a rare clash of two shingles
        there costs nothing but a candidate, for links are confirmed exactly.
        """
        x = (hashes >> np.uint64(32)).astype(np.uint32)
        low = high = None
        for at in range(0, len(x), PIECE):
            h = x[at : at + PIECE] * self.mul
            h += self.add
            a, b = h.min(1), h.max(1)
            low, high = (a, b) if low is None else (np.minimum(low, a), np.maximum(high, b))
        values = np.stack([low, high], 1).reshape(-1)
        with np.errstate(over="ignore"):
            keys = self.salt.copy()
            for column in values.reshape(BANDS, ROWS).T:
                keys = _fmix(keys * np.uint64(0x9E3779B97F4A7C15) + column)
            nibbles = (_fmix(values[:SKETCHED].astype(np.uint64)) & np.uint64(15)).astype(np.uint8)
        return keys.view(np.int64), (nibbles[::2] | nibbles[1::2] << 4).view(np.int64)


#: Nodes of classes whose smallest id stands for another class already lie above all ids.
EXTRA = 1 << 62
SIGNED = "doc_id long, t long, n_shingles long, set_hash binary, bands array<long>, " + ", ".join(f"s{i} long" for i in range(LONGS))


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, t (a hash of the text, which tells rows of one id apart), n_shingles,
    set_hash (equal sets, equal hash), band keys and sketch.
    """
    import xxhash

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(size)
        empty = (np.zeros(0, np.int64), np.zeros(LONGS, np.int64))
        for batch in batches:
            known: dict[bytes, int] = {}
            n, ids, keys, sketches = [], [], [], []
            for text in text_bytes(batch.column("text")):
                s = hasher.sets(text, known)
                n.append(len(s))
                ids.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                k, sketch = hasher.bands(s) if len(s) else empty
                keys.append(k)
                sketches.append(sketch)
            cut = np.array(sketches, np.int64).reshape(-1, LONGS)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("t"), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(keys, pa.list_(pa.int64())), *(pa.array(cut[:, i]) for i in range(LONGS))],
                names=[c.split()[0] for c in SIGNED.split(", ")],
            )

    return docs.select("doc_id", F.xxhash64("text").alias("t"), "text").mapInArrow(run, SIGNED)


def _differing(a: str, b: str) -> Column:
    """Sketched values that differ: the four bits of each fold into one, and those are counted."""
    total = F.lit(0)
    for i in range(LONGS):
        x = F.col(f"{a}s{i}").bitwiseXOR(F.col(f"{b}s{i}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(0x1111111111111111))
        total = total + F.bit_count(x)
    return total


def _fits(a: str, b: str, percent: int) -> Column:
    """Sizes and sketches allow two sets to link.

    Of SKETCHED values those that differ have mean 15/16 (1 - J); the bound is
    six standard deviations above the mean at the threshold.
    """
    mean = SKETCHED * (1 - percent / 100) * 15 / 16
    most = int(mean + 6 * (mean * (1 - mean / SKETCHED)) ** 0.5) + 1
    n, m = F.col(f"{a}n"), F.col(f"{b}n")
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (_differing(a, b) <= most)


def _side(heads: DataFrame, x: str) -> DataFrame:
    return heads.select(F.col("rep").alias(x), F.col("n").alias(f"{x}n"), *(F.col(f"s{i}").alias(f"{x}s{i}") for i in range(LONGS)))


def plausible(pairs: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that may link."""
    return pairs.join(_side(heads, "b"), "b").join(_side(heads, "a"), "a").where(_fits("a", "b", percent)).select("a", "b")


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Rows (a, b) of ``pairs`` whose full sets are similar enough.

    The texts (node, text) reach their pairs by equi-joins; a hub's text is
    one row of its side, and where a hub is hot adaptive execution splits the
    other side.
    """
    left = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    right = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    both = pairs.select("a", "b").join(left, "b").join(right, "a")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        last, hub, good = None, set(), []
        for a, x, y in zip(batch.column("a").to_pylist(), text_bytes(batch.column("text_a")), text_bytes(batch.column("text_b")), strict=True):
            if a != last:
                last, hub = a, shingles_of(words_of(x), size)
            other = shingles_of(words_of(y), size)
            shared = len(hub & other)
            good.append(100 * shared >= percent * (len(hub) + len(other) - shared) > 0)
        return batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return map_arrow(both.select("a", "b", "text_a", "text_b"), run, "a long, b long")


class _Tables:
    """Parquet tables in the shared folder that go when they are superseded."""

    def __init__(self, spark) -> None:  # noqa: ANN001
        self.spark, self.paths = spark, {}

    def put(self, name: str, df: DataFrame) -> tuple[DataFrame, int]:
        """The stored table and its number of rows, counted while it is written."""
        path, seen = scratch_path(self.spark, name), Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
        old, self.paths[name] = self.paths.get(name), path
        if old:
            remove_path(self.spark, old)
        return self.spark.read.schema(df.schema).parquet(path), seen.get["n"]


#: Links that one task may join with a union-find, some 200 MB; more go by stars.
LOCAL_LINKS = 1_000_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            p, q = root(a), root(b)
            if p != q:
                parent[max(p, q)] = min(p, q)
    nodes = list(parent)
    for at in range(0, len(nodes), 10_000):
        part = nodes[at : at + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], names=["node", "label"])


def components(links: DataFrame, tables: _Tables, n_links: int, name: str = "labels") -> DataFrame:
    """(node, label): the smallest node reachable over (a, b) links, each linked node once.

    Up to LOCAL_LINKS links one task holds them.  Beyond, alternating
    large-star and small-star steps (Kiveris et al. 2014) on stored tables:
    each is a minimum per node, and their number grows with the logarithm of
    the largest component.
    """
    if n_links <= LOCAL_LINKS:
        return tables.put(name, links.select("a", "b").coalesce(1).mapInArrow(_forest, "node long, label long"))[0]
    mark = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    edges, n = tables.put(f"{name}-edges", links.select("a", "b").where("a <> b").distinct())
    now = (n, edges.agg(mark).first()[0])
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large-star: neighbours above the node move to the node's minimum
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small-star: the node and its neighbours below move to the minimum of these
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        edges, n = tables.put(f"{name}-edges", small)
        before, now = now, (n, edges.agg(mark).first()[0])
        if before == now:
            break
    out = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return tables.put(name, out.unionByName(roots))[0]


def classes(docs: DataFrame, *, size: int = 2, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs``.

    Documents without words have n_shingles 0, are linked with nothing and are
    their own component; a null doc_id passes through with a null component and
    is kept.  Repeated rows repeat in the result.  Rows of one id with different
    texts are different documents: each has the component of its own text.
    """
    return _classes(docs, size, percent).select("doc_id", "n_shingles", "component_id", "kept")


def _nodes(usable: DataFrame, tables: _Tables) -> tuple[DataFrame, bool]:
    """(set_hash, rep, t, node): of each class the smallest document, the hash of its
    text, and a number: the document's id, or one above all ids where two
    classes have the same smallest id; and whether there are such.
    """
    first = usable.groupBy("set_hash").agg(F.min(F.struct("doc_id", "t")).alias("r"))
    reps, _ = tables.put("reps", first.select("set_hash", F.col("r.doc_id").alias("rep"), F.col("r.t").alias("t")))
    twice, n = tables.put("twice", reps.groupBy("rep").agg(F.count("*").alias("n"), F.min("set_hash").alias("own")).where("n > 1").select("rep", "own"))
    if not n:
        return reps.withColumn("node", F.col("rep")), False
    other = F.lit(EXTRA).bitwiseOR(F.xxhash64("set_hash").bitwiseAND(F.lit(EXTRA - 1)))
    node = F.when(F.col("own").isNotNull() & (F.col("own") != F.col("set_hash")), other).otherwise(F.col("rep"))
    return tables.put("nodes", reps.join(twice, "rep", "left").select("set_hash", "rep", "t", node.alias("node")))[0], True


def _classes(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The result of :func:`classes` with ``t``, and ``label``, the number of a row's component (null without words or id)."""
    tables = _Tables(docs.sparkSession)
    signed, n_docs = tables.put("signed", signatures(docs, size))
    usable = signed.where("set_hash is not null and doc_id is not null")
    reps, clash = _nodes(usable.select("set_hash", "doc_id", "t"), tables)
    # one row for each class: that of its smallest document
    first = usable.join(reps.select("set_hash", F.col("rep").alias("doc_id"), "t", "node"), ["set_hash", "doc_id", "t"]).dropDuplicates(["set_hash"])
    heads, _ = tables.put("heads", first.select(F.col("node").alias("rep"), F.col("n_shingles").alias("n"), "bands", *(f"s{i}" for i in range(LONGS))))
    keyed = heads.select("rep", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    met, _ = tables.put("met", keyed.join(shared, "key"))
    # how many others a class meets over all bands: the original of a group meets most, so it makes the best hub
    central = met.groupBy("rep").agg(F.sum("members").alias("meets"))
    buckets, left = tables.put("ranked", met.join(central, "rep").select("key", "rep", "meets"))
    buckets = _with_hub(buckets)

    texts = _Texts(docs, reps, clash)
    links = labels = tried = None
    n_links, across = 0, False
    for turn in range(HUB_TURNS + 1):
        if across:
            pairs = _across(buckets, heads, texts, tables, size, percent)
        else:
            pairs = buckets.where("rep <> hub")
            if turn:
                pairs = pairs.where("label <> hub_label")
            pairs = plausible(pairs.select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct(), heads, percent)
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs, n = tables.put(f"pairs{turn}", pairs)
        more = 0
        tried = pairs if tried is None else tried.unionByName(pairs)
        if n:
            need = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
            held, _ = tables.put("texts", texts.of(*tables.put("need", need)))
            found, more = tables.put(f"links{turn}", confirmed(pairs, held, size, percent))
            if more:
                links, n_links = (found if links is None else links.unionByName(found)), n_links + more
                labels = components(links, tables, n_links)
        if across:
            break
        # members that were not compared with all others yet, in buckets where they differ
        rest = buckets.where("rep <> hub").select("key", "rep", "meets")
        if labels is not None:
            rest = rest.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "meets", F.coalesce("label", "rep").alias("label"))
        else:
            rest = rest.withColumn("label", F.col("rep"))
        open_ = rest.groupBy("key").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.count("*").alias("members")).where("l0 <> l1").select("key", "members")
        buckets, left = tables.put("buckets", rest.join(open_, "key"))
        if not left:
            break
        across = turn + 1 == HUB_TURNS or more * HUB_WORTH < n_docs
        if not across:
            buckets = _with_hub(buckets)

    out = signed.select("doc_id", "t", "n_shingles", "set_hash").join(reps.select("set_hash", "node", "rep"), "set_hash", "left")
    if labels is not None:
        out = out.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    else:
        out = out.withColumn("label", F.col("node"))
    component = F.coalesce("label", "doc_id")
    if clash:  # a label may be a number above all ids: the smallest id of its component counts
        named = reps if labels is None else reps.join(labels, "node", "left").withColumn("node", F.coalesce("label", "node"))
        out = out.join(named.groupBy(F.col("node").alias("label")).agg(F.min("rep").alias("least")), "label", "left")
        component = F.coalesce("least", "doc_id")
    known = F.col("doc_id").isNotNull()
    out = out.select("doc_id", "t", "n_shingles", F.when(known, F.col("label")).alias("label"), F.when(known, component).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


class _Texts:
    """The texts of nodes."""

    def __init__(self, docs: DataFrame, reps: DataFrame, clash: bool) -> None:
        self.rows = docs.select("doc_id", F.xxhash64("text").alias("t"), "text").where("doc_id is not null")
        self.reps, self.clash = reps.select("node", F.col("rep").alias("doc_id"), "t"), clash

    def of(self, nodes: DataFrame, n: int) -> DataFrame:
        """(node, text) for each of ``n`` nodes: they are broadcast up to BROADCAST_IDS, else all texts are shuffled."""
        wanted = nodes.join(self.reps, "node")
        return self.rows.join(F.broadcast(wanted) if n <= BROADCAST_IDS else wanted, ["doc_id", "t"]).dropDuplicates(["node"]).select("node", "text")


def _with_hub(buckets: DataFrame) -> DataFrame:
    """``hub`` of each bucket, the member that meets most others, and its label if there are labels."""
    labelled = ["label"] if "label" in buckets.columns else []
    top = buckets.groupBy("key").agg(F.max(F.struct("meets", (-F.col("rep")).alias("minus"), *labelled)).alias("h"))
    return buckets.join(top.select("key", (-F.col("h.minus")).alias("hub"), *(F.col("h.label").alias("hub_label") for _ in labelled)), "key")


def _across(buckets: DataFrame, heads: DataFrame, texts: _Texts, tables: _Tables, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that may link, from buckets that hold several.

    First the classes that have any likely partner in a bucket, by semi-joins,
    which give a class once however many partners it has.  Then a prefix
    filter among them: shingles are ordered by how many of these classes have
    them, and sets with similarity t share one of their first n - t n + 1.
    The sizes of two sets bound the place of their first shared shingle further.
    Texts that share but a common passage have it last, so they don't meet.
    """
    ratio = F.log(F.lit(100 / percent))
    rows = buckets.select("key", "rep", "label").join(heads.drop("bands"), "rep").withColumn("c", F.floor(F.log("n") / ratio).cast("int"))
    rows, _ = tables.put("open", rows)

    def side(df: DataFrame, x: str, *keys: Column | str) -> DataFrame:
        return df.select(*keys, F.col("rep").alias(x), F.col("label").alias(f"l{x}"), F.col("n").alias(f"{x}n"), *(F.col(f"s{i}").alias(f"{x}s{i}") for i in range(LONGS)))

    # sizes that fit lie in one class of ratio 100 / percent or in neighbours
    fits = (F.col("lx") != F.col("ly")) & _fits("x", "y", percent)
    likely = None
    for shift in (-1, 0, 1):
        x, y = side(rows, "x", "key", "c"), side(rows, "y", F.col("key").alias("k"), (F.col("c") + shift).alias("d"))
        found = x.join(y, (F.col("key") == F.col("k")) & (F.col("c") == F.col("d")) & fits, "left_semi").select(F.col("x").alias("rep"))
        likely = found if likely is None else likely.unionByName(found)
    chosen, n = tables.put("likely", likely.distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(size)
        for batch in batches:
            sets = [hasher.sets(t, {}).view(np.int64) for t in text_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.list_(pa.int64()))], names=["rep", "h"])

    held = texts.of(chosen.withColumnRenamed("rep", "node"), n)
    grams, _ = tables.put("grams", held.mapInArrow(run, "rep long, h array<long>").select("rep", F.size("h").alias("n"), F.explode("h").alias("h")))
    often = grams.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    # a shingle that one class alone has comes first in its order and meets nothing: only its place counts
    ranked = grams.join(often, "h", "left").withColumn("at", F.row_number().over(Window.partitionBy("rep").orderBy(F.coalesce("df", F.lit(1)), "h")))
    prefix = ranked.where(F.col("df").isNotNull() & (F.col("at") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)).select("rep", "h", "at")
    info = rows.select("rep", "label", "n", *(f"s{i}" for i in range(LONGS))).dropDuplicates(["rep"])
    prefix, _ = tables.put("prefix", prefix.join(info, "rep"))
    x, y = side(prefix, "x", "h", F.col("at").alias("i")), side(prefix, "y", "h", F.col("at").alias("j"))
    # the first shared shingle leaves room for the overlap that the sizes ask for
    overlap = F.ceil((F.col("xn") + F.col("yn")) * percent / (100 + percent))
    room = F.least(F.col("xn") - F.col("i"), F.col("yn") - F.col("j")) + 1 >= overlap
    return x.join(y, "h").where((F.col("x") < F.col("y")) & room & fits).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def keep(docs: DataFrame, *, size: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``docs``, all columns: of each component the row with the smallest doc_id stays.

    Of several such rows the one whose text has the smallest hash stays, and of
    repeated rows one; rows without words keep a row for each id and text; rows
    with a null id stay.
    """
    found = _classes(docs, size, percent).where("kept and doc_id is not null")
    one = found.where("label is not null").groupBy("label").agg(F.min(F.struct("doc_id", "t")).alias("r")).select("r.doc_id", F.col("r.t").alias("lamella_t"))
    blank = found.where("label is null").select("doc_id", F.col("t").alias("lamella_t")).distinct()
    rows = docs.withColumn("lamella_t", F.xxhash64("text")).join(one.unionByName(blank), ["doc_id", "lamella_t"], "left_semi").dropDuplicates(["doc_id", "lamella_t"])
    return rows.select(*docs.columns).unionByName(docs.where("doc_id is null"))


#: All pairs that share a shingle, and a recursive closure: for small tables.
ORACLE = r"""
WITH RECURSIVE
w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS g FROM w),
n AS (SELECT doc_id, len(g) AS n_shingles, md5(array_to_string(list_sort(g), chr(10))) AS h, g FROM s),
r AS (SELECT h, min(doc_id) AS rep, any_value(n_shingles) AS n, any_value(g) AS g FROM n WHERE n_shingles > 0 GROUP BY h),
e AS (SELECT rep, n, unnest(g) AS x FROM r),
p AS (SELECT a.rep AS a, b.rep AS b, a.n AS an, b.n AS bn, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * k >= 80 * (an + bn - k)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT a AS node, a AS seen FROM u UNION SELECT c.node, u.b FROM c JOIN u ON u.a = c.seen),
m AS (SELECT node, min(seen) AS label FROM c GROUP BY node)
SELECT n.doc_id, n.n_shingles::BIGINT AS n_shingles, coalesce(m.label, r.rep, n.doc_id) AS component_id, n.doc_id = coalesce(m.label, r.rep, n.doc_id) AS kept
FROM n LEFT JOIN r ON r.h = n.h AND n.n_shingles > 0 LEFT JOIN m ON m.node = r.rep
"""
