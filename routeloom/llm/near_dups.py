"""Near-duplicate documents by minhash with tensored banding, links confirmed on full sets.

A document's set is its distinct word shingles; equal sets become one node first, so
copies cost nothing further. Two collections of m groups of k minhashes give m * m
table keys, one for each pair of groups: 2 * m * k minhashes do the work of
m * m * 2 * k. m is the least for which a pair at the threshold is missed with
probability below ``miss``.

Candidates become links in rounds. In each, every table bucket that still holds
nodes of more than one component names one pivot, and its other members are held
against it: pairs grow with the members, never with their square. Confirmed links
merge components. Buckets that then still hold several components are gathered by
pivot into canopies (members of a bucket share its pivot, hence a canopy), dealt in
blocks of bounded size, and compared inside tasks on their full sets; what leaves a
task is one link for each two components that have any. So no partner is dropped and
no bucket is capped.

Words are maximal runs of non-white-space characters, A-Z lower-cased. Null, empty
and blank texts have empty sets and link with nothing. Nodes are distinct sets, so rows
that share an id but differ in text each link by their own; a component is named by its
smallest id, and of that id's rows those with one set are kept. A null id takes no part:
its component is null and it is kept. Ids must be whole numbers: others are refused.
A very long text is one set in one task. Empty table: no rows. Other columns, whatever
their names, play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from routeloom.llm.common import Scratch, small_batches, with_text
from routeloom.llm.components import components

KEEP_WORDS = 400_000
_words: dict[bytes, int] = {}
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str, size: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles of ``size`` words."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if new := set(words).difference(_words):
        if len(_words) > KEEP_WORDS:
            _words.clear()
            new = set(words)
        for w in new:
            _words[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    size = min(size, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for i in range(size):
        out = _mix(out * ODD[i % len(ODD)] + h[i : len(h) - size + 1 + i])
    return np.unique(out)


def groups_for(threshold: float, k: int, miss: float) -> int:
    m = 1
    while 1 - (1 - (1 - threshold**k) ** m) ** 2 > miss:
        m += 1
    return m


class MinHasher:
    def __init__(self, n: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(1, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, n, np.uint64)

    def sign(self, s: np.ndarray) -> np.ndarray:
        """One 32-bit minimum for each hash function."""
        out = np.empty(len(self.a), np.uint64)
        for i, (a, b) in enumerate(zip(self.a, self.b, strict=True)):
            x = s * a + b
            x ^= x >> np.uint64(31)
            x *= a
            out[i] = x.min() >> np.uint64(32)
        return out.astype(np.uint32).view(np.int32)


def _digest(s: np.ndarray) -> tuple[int, int]:
    import xxhash

    d = xxhash.xxh3_128_intdigest(s.tobytes())
    return (d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63)


def _sketches(docs: DataFrame, id_col: str, text_col: str, size: int, n_hashes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = MinHasher(n_hashes)
        for b in batches:
            n, hi, lo, sig = [], [], [], []
            for text in b.column(1).to_pylist():
                s = shingle_set(text, size)
                n.append(len(s))
                for side, x in zip((hi, lo), _digest(s), strict=True):
                    side.append(x)
                sig.append(hasher.sign(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(sig, pa.list_(pa.int32()))], names=["doc", "n", "hi", "lo", "sig"])

    return with_text(docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))).mapInArrow(run, "doc long, n long, hi long, lo long, sig array<int>")


def with_digests(docs: DataFrame, size: int, text_col: str = "text") -> DataFrame:
    """docs with n_shingles and the digest (hi, lo) of each row's set."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t or "", size) for t in b.column(at).to_pylist()]
            more = [(len(s), *_digest(s)) for s in sets]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([x[i] for x in more], pa.int64()) for i in range(3))], names=[*b.schema.names, "n_shingles", "hi", "lo"])

    return docs.mapInArrow(run, docs.select("*", *(F.lit(0).cast("long").alias(c) for c in ("n_shingles", "hi", "lo"))).schema)


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """docs (node, n, hi, lo, text): the full shingle sets of the texts whose digest is the node's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t, size) for t in b.column(4).to_pylist()]
            own = [r for r, (s, hi, lo) in enumerate(zip(sets, b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)) if _digest(s) == (hi, lo)]
            at = pa.array(own, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array([sets[r].view(np.int64) for r in own], pa.list_(pa.int64()))], names=["node", "n", "items"])

    return docs.mapInArrow(run, "node long, n long, items array<long>")


def _overlaps(left: list[np.ndarray], right: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all left with all right sets of small numbers."""
    out = np.zeros((len(left), len(right)))
    if not left or not right:
        return out
    side = []
    for sets in (left, right):
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        item = np.concatenate(sets)
        order = np.argsort(item, kind="stable")
        side.append((owner[order], item[order], len(sets)))
    for start in range(0, int(max(side[0][1][-1:].max(initial=0), side[1][1][-1:].max(initial=0))) + 1, width):
        dense = []
        for owner, item, n in side:
            lo, hi = np.searchsorted(item, [start, start + width])
            m = np.zeros((n, width), np.float32)
            m[owner[lo:hi], item[lo:hi] - start] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return out


def _leftover_links(members: DataFrame, pct: int, block: int, salts: int = 16) -> DataFrame:
    """members (canopy, node, comp, n, items): links between a canopy's members that lie in different
    components, judged on full sets. For each pair of components a block gives its closest link:
    one joins them."""
    chunks = F.ceil(F.count("*") / F.lit(block)).cast("int")
    # only canopies of several blocks need their count; it meets their members by salt
    large = members.groupBy("canopy").agg(chunks.alias("chunks")).where("chunks > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = members.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(salts)).cast("int")).join(large, ["canopy", "salt"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    dealt = dealt.withColumn("c", F.pmod(F.xxhash64("node", F.lit(1)), F.col("chunks")).cast("int"))
    # a member of chunk c meets every chunk once: cell (lesser, greater)
    cells = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumns({"x": F.least("c", "o"), "y": F.greatest("c", "o")})

    def compare(key, t):
        node, comp, n, c = (t.column(v).to_numpy() for v in ("node", "comp", "n", "c"))
        found: dict[tuple[int, int], tuple[float, int, int]] = {}
        kinds, counts = np.unique(comp, return_counts=True)
        if len(kinds) > 1:
            raw = t.column("items").combine_chunks()
            _, number, often = np.unique(raw.flatten().to_numpy(zero_copy_only=False), return_inverse=True, return_counts=True)
            shared = often > 1  # an item of one member adds to no intersection
            number = np.where(shared, np.cumsum(shared) - 1, -1)[number]
            sets = [x[x >= 0] for x in np.split(number, np.cumsum(raw.value_lengths().to_numpy())[:-1])]
            small = comp != kinds[counts.argmax()]
            x, y = key[1].as_py(), key[2].as_py()
            left, right = np.flatnonzero(c == x), np.flatnonzero(c == y)
            for rows, cols in ((left[small[left]], right), (left[~small[left]], right[small[right]])):
                i = _overlaps([sets[r] for r in rows], [sets[r] for r in cols])
                spare = 100 * i - pct * (n[rows][:, None] + n[cols][None] - i)
                for r, k in zip(*np.nonzero((spare >= 0) & (comp[rows][:, None] != comp[cols][None])), strict=True):
                    u, v = rows[r], cols[k]
                    pair = (int(min(comp[u], comp[v])), int(max(comp[u], comp[v])))
                    found[pair] = min(found.get(pair, (math.inf, 0, 0)), (float(-spare[r, k]), int(node[u]), int(node[v])))
        out = list(found.values())
        return pa.table({"u": pa.array([x[1] for x in out], pa.int64()), "v": pa.array([x[2] for x in out], pa.int64())})

    return cells.groupBy("canopy", "x", "y").applyInArrow(compare, "u long, v long").distinct()


def near_duplicates(
    docs: DataFrame, *, size: int = 5, pct: int = 80, k: int = 2, miss: float = 1e-4, rounds: int = 2, block: int = 512, digests: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept; with ``digests`` also its set's hi, lo.

    Documents link where 100 * shared shingles >= pct * all shingles of the two.
    """
    spark = docs.sparkSession
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must be of a whole-number type, not {docs.schema[id_col].dataType.simpleString()}")
    small_batches(spark)
    scratch = Scratch(spark, "neardups")
    m = groups_for(pct / 100, k, miss)
    hashes = 2 * m * k
    t = pct / 100
    agree = max(2 * k, math.floor(hashes * t - 5 * math.sqrt(hashes * t * (1 - t))))

    sketched = scratch.save(_sketches(docs, id_col, text_col, size, hashes), "sketches")
    nodes = scratch.save(
        sketched.where("n > 0 and doc is not null").groupBy("hi", "lo").agg(F.min("doc").alias("least"), F.first("n").alias("n"), F.first("sig").alias("sig")).withColumn("node", F.monotonically_increasing_id()),
        "nodes",
    )

    # a key pairs a group of each side, so only groups that several nodes share can make a shared key:
    # the 2 * m groups of a node are looked at first, and pairs are formed of those that are left
    # the last bit of a group's value is its side
    value = lambda at: F.xxhash64(F.lit(at), *[F.col("sig")[at * k + x] for x in range(k)]).bitwiseAND(F.lit(-2)) + F.lit(at // m)
    # both the counts and the join read this one shuffle, whatever the table's size
    groups = nodes.select("node", F.explode(F.array(*[value(at) for at in range(2 * m)])).alias("g")).repartition("g")
    several = groups.groupBy("g").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("g")
    of_side = lambda s: F.collect_list(F.when(F.col("g").bitwiseAND(F.lit(1)) == s, F.col("g")))
    left = groups.join(several, "g").groupBy("node").agg(of_side(0).alias("a"), of_side(1).alias("b"))
    keys = left.select("node", "b", F.explode("a").alias("a")).select("node", "a", F.explode("b").alias("b")).select(F.xxhash64("a", "b").alias("key"), "node").repartition("key")
    shared = keys.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("key")
    buckets = scratch.save(keys.join(shared, "key").select("key", "node"), "buckets")
    # written first: the planner then knows its size, and texts travel only where it is too large to send out
    met = scratch.save(buckets.select("node").distinct().join(nodes.select("node", "least", "n", "hi", "lo"), "node"), "met")
    texts = docs.select(F.col(id_col).cast("long").alias("least"), F.col(text_col).cast("string").alias("text")).where("text is not null").join(met, "least")
    # an id may have other texts: the set must be the node's own
    sets = scratch.save(_sets(texts.select("least", "node", "n", "hi", "lo", "text").distinct().select("node", "n", "hi", "lo", "text"), size), "sets")
    sigs = nodes.select("node", "n", "sig")

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs (u, v) whose full sets are alike."""
        a = sets.select(F.col("node").alias("u"), F.col("n").alias("nu"), F.col("items").alias("iu"))
        b = sets.select(F.col("node").alias("v"), F.col("n").alias("nv"), F.col("items").alias("iv"))
        both = F.size(F.array_intersect("iu", "iv"))
        return pairs.join(a, "u").join(b, "v").where(both * 100 >= (F.col("nu") + F.col("nv") - both) * pct).select("u", "v").distinct()

    def near(pairs: DataFrame) -> DataFrame:
        """The pairs whose sizes allow a link and whose minhashes agree enough."""
        a = sigs.select(F.col("node").alias("u"), F.col("n").alias("nu"), F.col("sig").alias("su"))
        b = sigs.select(F.col("node").alias("v"), F.col("n").alias("nv"), F.col("sig").alias("sv"))
        same = sum((F.col("su")[i] == F.col("sv")[i]).cast("int") for i in range(hashes))
        fits = (F.col("nu") * 100 >= F.col("nv") * pct) & (F.col("nv") * 100 >= F.col("nu") * pct)
        return pairs.join(a, "u").join(b, "v").where(fits & (same >= agree)).select("u", "v")

    labels: DataFrame | None = None
    last = -1
    merged: DataFrame | None = None
    for r in range(rounds + 1):
        if labels is None:
            at = buckets.withColumn("comp", F.col("node"))
        else:
            at = buckets.join(labels, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
        mixed = at.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.min(F.struct((F.xxhash64("node", F.lit(r)) if r else F.col("node")).alias("order"), "node", "comp")).alias("pivot")).where("c0 < c1")
        if r < rounds:
            star = at.join(mixed, "key").where(F.col("comp") != F.col("pivot.comp")).select(F.col("node").alias("u"), F.col("pivot.node").alias("v")).distinct()
            found = near(star)
        else:
            canopies = at.join(mixed.select("key", F.col("pivot.node").alias("canopy")), "key").select("canopy", "node", "comp").distinct()
            found = _leftover_links(canopies.join(sets, "node"), pct, block)
        edges = scratch.save(linked(found) if r < rounds else found, f"links-{r}")
        if not edges.limit(1).count():
            if r < rounds:
                continue
            break
        if labels is not None:
            lab = labels.select(F.col("node").alias("x"), "component")
            edges = edges.join(lab.withColumnsRenamed({"x": "u", "component": "cu"}), "u", "left").join(lab.withColumnsRenamed({"x": "v", "component": "cv"}), "v", "left").select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v"))
        step = components(edges, scratch, f"components-{r}")
        if labels is None:
            merged = step
        else:
            up = step.select(F.col("node").alias("component"), F.col("component").alias("top"))
            old = labels.join(up, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
            merged = old.unionByName(step.join(labels.select("node"), "node", "left_anti"))
        labels, last = scratch.save(merged, f"labels-{r}"), r

    for used in ("buckets", "met", "sets", *(f"{x}-{r}" for r in range(rounds + 1) for x in ("links", "components"))):
        scratch.drop(used)
    for r in range(last):
        scratch.drop(f"labels-{r}")

    members = nodes.select("hi", "lo", "node", F.struct(F.col("least").alias("doc"), "node").alias("top"))
    if labels is not None:
        tops = labels.join(members.select("node", "top"), "node").groupBy("component").agg(F.min("top").alias("first"))
        named = labels.join(tops, "component").select("node", "first")
        members = members.join(named, "node", "left").withColumn("top", F.coalesce("first", "top"))
    members = members.select("hi", "lo", F.col("top.doc").alias("component"), (F.col("node") == F.col("top.node")).alias("own"))
    out = sketched.select("doc", "n", "hi", "lo").join(members, ["hi", "lo"], "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "doc")).otherwise(F.col("doc"))
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce((F.col("doc") == component) & F.coalesce("own", F.lit(True)), F.lit(True)).alias("kept"), *(["hi", "lo"] if digests else []))
