"""SimHash near-duplicates: exact Hamming pairs by vantage-point trees, then components.

1. Every whole text gets a 64-bit fingerprint; equal fingerprints collapse to one node, so a group
   of copies of any size is a single row from then on.
2. Vantage-point trees over bounded samples cut Hamming space into shards, and large shards again, in rounds,
   until none holds more rows than SHARD_NODES (or can't be cut further). A node lives in one
   shard; if its distance to a vantage point is within the radius of a boundary, a copy visits the
   other side too (triangle bounds), so every pair within the radius meets in exactly one shard.
3. Each shard continues the tree in memory down to small leaves, compares there, and returns a
   spanning forest of the pairs it finds: as many rows as nodes at most, however dense a group is.
4. The forests are joined into components by minimum labels with pointer jumping; all steps are
   joins and pre-aggregated minima over linked nodes only.

Defined results: null and empty texts have no words and fingerprint zero; texts shorter than a
shingle are one shingle; repeated rows link to each other; a null id never is a component's name
unless all ids in it are null; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.llm.common import spill

SEED = 42
#: Sampled fingerprints from which a round's trees are built (the bound on what the driver holds and broadcasts),
#: and those that a cut needs at least.
TREE_SAMPLE, CUT_SAMPLE = 1 << 18, 16
#: Rows, visitors included, that a shard holds at most.
SHARD_NODES = 400_000
#: Nodes of a leaf, compared with one another directly.
LEAF = 96
#: Pairs held before they are folded into the labels.
PAIR_BLOCK = 1 << 20


# --- fingerprints -------------------------------------------------------------------------------


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of every shingle of ``width`` lower-cased words, repeats included; a shorter text is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - width + 1].tolist()
    pieces = map(joined.__getitem__, map(slice, starts, ends[width - 1 :].tolist()))
    return np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), np.uint64, len(starts))


def simhash(hashes: np.ndarray) -> int:
    """Bit b is set if it is in over half of the hashes; no hashes give zero."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        block = hashes[k : k + (1 << 16)].astype(">u8")
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes)).view(">u8")[0])


def fingerprint(text: str | None, width: int) -> int:
    return simhash(shingle_hashes(text, width))


def fingerprint_udf(width: int):
    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        found = np.fromiter((fingerprint(t.as_py(), width) for t in texts), np.uint64, len(texts))
        return pa.array(found.view(np.int64))

    return of


# --- vantage-point tree -------------------------------------------------------------------------


def distance(points: np.ndarray, pivot: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ pivot).astype(np.int16)


def choose_split(points: np.ndarray, radius: int) -> tuple[np.uint64, int] | None:
    """A vantage point and a boundary that separate ``points`` with a thin band around it.

    None if no tried vantage point separates them.
    """
    best = None
    ms = np.arange(64)
    for pivot in points[:: max(1, len(points) // 12)][:12]:
        inside = np.cumsum(np.bincount(distance(points, pivot), minlength=65))
        left, right = inside[ms], inside[64] - inside[ms]
        below = np.where(ms > radius, inside[np.maximum(ms - radius - 1, 0)], 0)
        band = inside[np.minimum(ms + radius, 64)] - below
        cost = np.where((left > 0) & (right > 0), np.maximum(left, right) + band / 2, np.inf)
        m = int(cost.argmin())
        if np.isfinite(cost[m]) and (best is None or cost[m] < best[0]):
            best = (cost[m], pivot, m)
    return None if best is None else (best[1], best[2])


def build_tree(sample: np.ndarray, depth: int, radius: int, shards: Iterator[int]):
    """Nested (pivot, boundary, left, right) down to numbers taken from ``shards``."""

    def grow(points: np.ndarray, level: int):
        some = points if len(points) <= 4096 else points[:: len(points) // 4096]
        split = choose_split(some, radius) if level and len(points) >= CUT_SAMPLE else None
        if split is None:
            return next(shards)
        pivot, m = split
        near = distance(points, pivot) <= m
        return (int(pivot), m, grow(points[near], level - 1), grow(points[~near], level - 1))

    return grow(sample, depth)


def leaves(tree) -> list[int]:
    """The shard numbers of a tree."""
    found, stack = [], [tree]
    while stack:
        node = stack.pop()
        if isinstance(node, int):
            found.append(node)
        else:
            stack += node[2:]
    return found


def divide(homes: np.ndarray, visitors: np.ndarray, pivot: np.uint64, m: int, radius: int):
    """Homes and visitors of the near and of the far side.

    A near home within ``radius`` of the boundary visits the far side; that one direction suffices
    for pairs of homes. Visitors go wherever a partner can be.
    """
    d, v = distance(homes, pivot), distance(visitors, pivot)
    near = (homes[d <= m], visitors[v <= m + radius])
    far = (homes[d > m], np.concatenate([visitors[v > m - radius], homes[(d <= m) & (d > m - radius)]]))
    return near, far


def route(tree, homes: np.ndarray, visitors: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, homes, visitors) of the shards of a tree that any of the given ones reach."""
    stack = [(tree, homes, visitors)]
    while stack:
        node, homes, visitors = stack.pop()
        if not len(homes) and not len(visitors):
            continue
        if isinstance(node, int):
            yield node, homes, visitors
            continue
        pivot, m, near_node, far_node = node
        near, far = divide(homes, visitors, np.uint64(pivot), m, radius)
        stack += [(near_node, *near), (far_node, *far)]


class Forest:
    """Minimum-label union-find over sorted fingerprints, fed with blocks of pairs."""

    def __init__(self, fps: np.ndarray):
        self.fps = np.unique(fps)
        self.parent = np.arange(len(self.fps))
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_held = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.held.append((a, b))
        self.n_held += len(a)
        if self.n_held >= PAIR_BLOCK:
            self.fold()

    def fold(self) -> None:
        if not self.n_held:
            return
        a = np.searchsorted(self.fps, np.concatenate([x for x, _ in self.held]))
        b = np.searchsorted(self.fps, np.concatenate([y for _, y in self.held]))
        self.held, self.n_held = [], 0
        while True:
            ra, rb = self.parent[a], self.parent[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.parent, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = self.parent[self.parent]
                if np.array_equal(up, self.parent):
                    break
                self.parent = up

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        self.fold()
        moved = self.parent != np.arange(len(self.fps))
        return self.fps[moved], self.fps[self.parent[moved]]


def compare(forest: Forest, a: np.ndarray, b: np.ndarray, radius: int) -> None:
    """All pairs of ``a`` and ``b`` within the radius, in blocks."""
    step = max(1, (1 << 21) // max(1, len(b)))
    for k in range(0, len(a), step):
        i, j = np.nonzero(np.bitwise_count(a[k : k + step, None] ^ b[None, :]) <= radius)
        if len(i):
            forest.add(a[k + i], b[j])


def search(homes: np.ndarray, visitors: np.ndarray, radius: int) -> Forest:
    """Link every pair home-home and visitor-home within ``radius``."""
    forest = Forest(np.concatenate([homes, visitors]))
    stack = [(homes, visitors)]
    while stack:
        h, v = stack.pop()
        if not len(h) or len(h) + len(v) < 2:
            continue
        split = choose_split(h if len(h) <= 2048 else h[:: len(h) // 2048], radius) if len(h) > LEAF else None
        sides = divide(h, v, *split, radius) if split else None
        if sides and max(len(s[0]) for s in sides) < len(h):
            stack += sides
        else:
            compare(forest, h, h, radius)
            compare(forest, v, h, radius)
    return forest


# --- distributed join ---------------------------------------------------------------------------


def deal(rows: DataFrame, trees: dict, radius: int) -> DataFrame:
    """``rows`` (shard, fp, home) with those of the shards in ``trees`` routed to the shards below."""
    shared = rows.sparkSession.sparkContext.broadcast(trees)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        cut = np.array(sorted(trees))
        for batch in batches:
            shards, fps, home = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            fps = fps.view(np.uint64)
            split = np.isin(shards, cut)
            rest = [c.filter(pa.array(~split)) for c in batch.columns]
            yield pa.RecordBatch.from_arrays(rest, names=["shard", "fp", "home"])
            for shard in np.unique(shards[split]).tolist():
                mine = shards == shard
                for below, homes, visitors in route(trees[shard], fps[mine & home], fps[mine & ~home], radius):
                    both = np.concatenate([homes, visitors]).view(np.int64)
                    at_home = np.arange(len(both)) < len(homes)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(both), below, np.int64)), pa.array(both), pa.array(at_home)], names=["shard", "fp", "home"]
                    )

    return rows.select("shard", "fp", "home").mapInArrow(of, "shard long, fp long, home boolean")


def sharded(nodes: DataFrame, radius: int, sample: int = TREE_SAMPLE, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """Rows (shard, fp, home): the distinct ``fp`` of ``nodes`` in shards where all pairs within ``radius`` meet once."""
    rows = nodes.select(F.lit(0).cast("long").alias("shard"), "fp", F.lit(True).alias("home"))
    numbers, above, final = itertools.count(1), {}, set()
    sizes = {0: nodes.count()}
    while True:
        # at most sample / 32 shards are cut in a round
        large = {k: n for k, n in sizes.items() if n > shard_nodes and k not in final}
        large = dict(sorted(large.items(), key=lambda x: -x[1])[: max(1, sample // (2 * CUT_SAMPLE))])
        if not large:
            return rows
        each = max(2 * CUT_SAMPLE, sample // len(large))
        quota = rows.sparkSession.createDataFrame([(k, each / n) for k, n in large.items()], "shard long, share double")
        drawn = F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < F.col("share") * (1 << 30)
        found = rows.join(F.broadcast(quota), "shard").filter(F.col("home") & drawn).select("shard", "fp").toArrow()
        shard, fps = found.column("shard").to_numpy(), found.column("fp").to_numpy().view(np.uint64)
        ranks = np.lexsort((fps, shard))
        shard, fps = shard[ranks], fps[ranks]
        trees = {}
        for k, n in large.items():
            mine = fps[np.searchsorted(shard, k) : np.searchsorted(shard, k, "right")]
            # a level more than halving needs, as visitors are copied
            depth = max(1, math.ceil(math.log2(n / shard_nodes)) + 1)
            tree = build_tree(mine, depth, radius, numbers)
            if isinstance(tree, int):
                final.add(k)  # nothing to cut it by
            else:
                trees[k] = tree
                above |= dict.fromkeys(leaves(tree), n)
        if trees:
            rows = spill(deal(rows, trees, radius), "shards")
            counted = rows.groupBy("shard").count().filter(F.col("count") > shard_nodes)
            sizes = {r["shard"]: r["count"] for r in counted.collect()}
            # a cut that leaves nearly all on one side is not worth repeating
            final |= {k for k, n in sizes.items() if n > 0.9 * above.get(k, n + 1)}


def hamming_links(nodes: DataFrame, radius: int, sample: int = TREE_SAMPLE, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """(a, b) edges that connect exactly the distinct ``fp`` of ``nodes`` within ``radius`` bits."""

    def join(shard: pa.Table) -> pa.Table:
        fps = shard.column("fp").to_numpy().view(np.uint64)
        home = shard.column("home").to_numpy()
        a, b = search(fps[home], fps[~home], radius).links()
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return sharded(nodes, radius, sample, shard_nodes).groupBy("shard").applyInArrow(join, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node on an edge; a component's nodes share one label.

    Each round hooks every node to its least neighbour, flattens the pointers by jumping, and
    contracts the edges; rounds go on until no edge joins two labels.
    """
    edges = spill(edges.distinct(), "edges")
    labels = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
        up = spill(up.select("node", F.least("node", "least").alias("label")), "hooked")
        while True:
            top = up.select(F.col("node").alias("label"), F.col("label").alias("top"))
            jumped = up.join(top, "label").select("node", F.col("top").alias("label"), (F.col("top") != F.col("label")).alias("moved"))
            jumped = spill(jumped, "jumped")
            up = jumped.select("node", "label")
            if jumped.filter("moved").isEmpty():
                break
        if labels is None:
            labels = up
        else:
            newer = up.select(F.col("node").alias("label"), F.col("label").alias("newer"))
            labels = labels.join(newer, "label", "left").select("node", F.coalesce("newer", "label").alias("label"))
            labels = spill(labels, "labels")
        a, b = up.select(F.col("node").alias("a"), F.col("label").alias("la")), up.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        edges = edges.join(a, "a").join(b, "b").filter("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b"))
        edges = spill(edges.distinct(), "edges")
        if edges.isEmpty():
            return labels


def groups(rows: DataFrame, radius: int = 2) -> DataFrame:
    """(fp, component_id) for the distinct ``fp`` of ``rows`` (id, fp); named by the smallest id."""
    nodes = spill(rows.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    links = spill(hamming_links(nodes, radius), "links")
    if links.isEmpty():
        return nodes.select("fp", F.col("least").alias("component_id"))
    labels = components(links).withColumnRenamed("node", "fp")
    named = nodes.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    names = named.groupBy("label").agg(F.min("least").alias("component_id"))
    return spill(named.select("fp", "label").join(names, "label").select("fp", "component_id"), "components")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2
) -> DataFrame:
    """(id, fp, component_id) for each row of ``docs``."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), fingerprint_udf(width)(F.col(f"`{text_col}`")).alias("fp"))
    rows = spill(rows, "fingerprints")
    return rows.join(groups(rows, radius), "fp")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op8(docs: DataFrame) -> DataFrame:
    """Contract digest."""
    return near_duplicates(docs).select(
        F.col("id").alias("doc_id"), hex_digits(F.col("fp")).alias("fingerprint"), "component_id"
    )


# --- links by similarity ------------------------------------------------------------------------

#: Min-hash bands and the values in each: two texts of similarity 0.8 miss all bands once in 20,000.
BANDS, BAND_ROWS = 25, 5
#: Nodes of a bucket's block, two of which are compared in one task, and sets from which on an element is a column.
BLOCK_NODES, OFTEN = 256, 8
_RNG = np.random.default_rng(20_240_101)
_FACTORS = _RNG.integers(1, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RNG.integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64)


def band_keys(distinct: np.ndarray) -> list[int]:
    """One signed 64-bit key per band over the distinct shingle hashes of a text."""
    if not len(distinct):
        return []
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(distinct), 4096):
        mixed = distinct[k : k + 4096, None] * _FACTORS + _SHIFTS
        np.minimum(least, (mixed >> np.uint64(20)).min(0), out=least)
    rows = least.reshape(BANDS, BAND_ROWS)
    found = np.array([xxhash.xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(rows)], np.uint64)
    return found.view(np.int64).tolist()


def signature_udf(width: int):
    """text -> fingerprint, node (a hash of the set of shingles) and band keys."""
    kind = T.StructType(
        [T.StructField("fp", T.LongType()), T.StructField("node", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))]
    )
    arrow = pa.struct([("fp", pa.int64()), ("node", pa.int64()), ("bands", pa.list_(pa.int64()))])

    @F.arrow_udf(kind)
    def of(texts: pa.Array) -> pa.Array:
        rows = []
        for text in texts:
            hashes = shingle_hashes(text.as_py(), width)
            distinct = np.unique(hashes)
            both = np.array([simhash(hashes), xxhash.xxh64_intdigest(distinct.tobytes(), SEED)], np.uint64).view(np.int64)
            rows.append({"fp": int(both[0]), "node": int(both[1]), "bands": band_keys(distinct)})
        return pa.array(rows, arrow)

    return of


def shingle_set_udf(width: int):
    """text -> its distinct shingle hashes."""

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def of(texts: pa.Array) -> pa.Array:
        sets = [np.unique(shingle_hashes(t.as_py(), width)).view(np.int64) for t in texts]
        return pa.array(sets, pa.list_(pa.int64()))

    return of


def shingle_sets(keyed: DataFrame, prints: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(node, grams) for each ``node`` of ``wanted``; one row stands for all copies of a node."""
    rows = prints.groupBy("node").agg(F.min(F.struct("r1", "r2")).alias("first")).join(wanted, "node", "left_semi")
    rows = spill(rows.select("node", "first.r1", "first.r2"), "involved")
    texts = keyed.select("r1", "r2", "body").join(rows, ["r1", "r2"]).dropDuplicates(["node"])
    return spill(texts.select("node", shingle_set_udf(width)(F.col("body")).alias("grams")), "shingle-sets")


def similar_links(keyed: DataFrame, prints: DataFrame, width: int, similarity: float) -> DataFrame:
    """(a, b) node edges between texts whose shingle sets have a Jaccard similarity of ``similarity`` or more.

    Nodes that share a band's key are candidates: each is compared with the least and the greatest node
    of the bucket, so a bucket of any size gives two pairs per node. Every candidate is verified on its
    whole set. :func:`remaining_links` compares what these leave apart.
    """
    places = prints.select("node", F.explode("bands").alias("key")).distinct()
    ends = places.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high")
    ends = spill(ends, "band-buckets")
    joined = places.join(ends, "key")
    pairs = joined.select("node", F.explode(F.array("low", "high")).alias("other")).filter("node <> other")
    pairs = spill(pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct(), "candidates")
    involved = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = shingle_sets(keyed, prints, involved, width)
    side = lambda c: sets.select(F.col("node").alias(c), F.col("grams").alias(f"{c}_grams"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("a_grams", "b_grams"))
    union = F.size("a_grams") + F.size("b_grams") - common
    return both.filter(common >= F.lit(similarity) * union).select("a", "b")


def common_counts(owners: np.ndarray, grams: np.ndarray, n: int) -> np.ndarray:
    """How many elements each two of ``n`` sets share; ``grams[i]`` is an element of set ``owners[i]``."""
    ranks = np.argsort(grams, kind="stable")
    owners, grams = owners[ranks], grams[ranks]
    start = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]]) if len(grams) else np.zeros(0, np.int64)
    times = np.diff(np.append(start, len(grams)))
    counts = np.zeros(n * n, np.float32)
    # elements of few sets as pairs, those of many as columns of 0/1 matrices
    for t in range(2, OFTEN):
        at = start[times == t]
        for i in range(t):
            for j in range(t):
                counts += np.bincount(owners[at + i] * n + owners[at + j], minlength=n * n) if len(at) else 0
    counts = counts.reshape(n, n)
    often = np.flatnonzero(times >= OFTEN)
    for k in range(0, len(often), 4096):
        part = often[k : k + 4096]
        columns = np.repeat(np.arange(len(part)), times[part])
        inside = np.arange(len(columns)) - np.repeat(np.cumsum(times[part]) - times[part], times[part])
        matrix = np.zeros((n, len(part)), np.float32)
        matrix[owners[np.repeat(start[part], times[part]) + inside], columns] = 1
        counts += matrix @ matrix.T
    return counts


def remaining_links(
    keyed: DataFrame, prints: DataFrame, labels: DataFrame, width: int, similarity: float, block: int = BLOCK_NODES
) -> DataFrame:
    """(a, b) edges of labels that all similar pairs in the buckets add to ``labels`` (node, label).

    A bucket of one label has nothing to add, and up to three nodes are compared with both ends already.
    All pairs of the other buckets are verified: buckets are cut into blocks, each two blocks meet in one
    task, and a task returns a spanning forest, so a bucket of any size gives as many rows as it has labels.
    """
    places = prints.select("node", F.explode("bands").alias("key")).distinct().join(labels, "node", "left")
    places = places.withColumn("label", F.coalesce("label", "node"))
    # buckets of the same nodes are one
    mark = F.struct(F.count("*"), F.sum(F.xxhash64("node").cast("decimal(20)")), F.bit_xor("node"))
    buckets = places.groupBy("key").agg(
        F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high"), mark.alias("mark")
    )
    buckets = buckets.filter("n > 3 AND low <> high").groupBy("mark").agg(F.min("key").alias("key"), F.first("n").alias("n"))
    buckets = spill(buckets.select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "open-buckets")
    members = spill(places.join(buckets, "key"), "open-members")
    sets = shingle_sets(keyed, prints, members.select("node").distinct(), width)
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("mine")
    dealt = members.select("key", "node", "label", "blocks", mine)
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = dealt.select("key", "node", "label", "mine", others)
    dealt = dealt.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "node", "label")

    def compare_sets(group: pa.Table) -> pa.Table:
        labels = group.column("label").to_numpy().view(np.uint64)
        lists = group.column("grams").combine_chunks()
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        n = len(sizes)
        owners = np.repeat(np.arange(n), sizes)
        common = common_counts(owners, lists.flatten().to_numpy(zero_copy_only=False), n)
        similar = common >= similarity * (sizes[:, None] + sizes[None, :] - common)
        a, b = np.nonzero(similar & (labels[:, None] < labels[None, :]))
        forest = Forest(labels)
        forest.add(labels[a], labels[b])
        a, b = forest.links()
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return dealt.join(sets, "node").groupBy("key", "i", "j").applyInArrow(compare_sets, "a long, b long")


def one_of_each_group(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, radius: int = 2, similarity: float = 0.8
) -> DataFrame:
    """The documents with one row of each group of near-duplicates: that of the smallest id.

    Links are equal sets of shingles, fingerprints within ``radius`` bits, and sets of a similarity of
    ``similarity`` or more. Keeps the input columns. Null ids come last; of rows equal in id and text, that with the least
    hash over all columns stays, and rows equal in every column are one row.
    """
    row_id, body = F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    others = F.to_json(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)]))
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.xxhash64(row_id, body, others).alias("r1"),
        F.xxhash64(F.lit("row"), row_id, body, others).alias("r2"),
        row_id.alias("id"),
        body.alias("body"),
    )
    prints = keyed.select("id", "r1", "r2", signature_udf(width)(F.col("body")).alias("s")).select("id", "r1", "r2", "s.*")
    prints = spill(prints, "signatures")
    nodes = spill(prints.groupBy("fp").agg(F.min("node").alias("node")), "nodes")
    near = hamming_links(nodes, radius)
    name = lambda c: nodes.select(F.col("fp").alias(c), F.col("node").alias(f"{c}_node"))
    near = near.join(name("a"), "a").join(name("b"), "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    same = prints.select("fp", F.col("node").alias("a")).distinct().join(nodes.withColumnRenamed("node", "b"), "fp").filter("a <> b")
    links = spill(near.union(same.select("a", "b")).union(similar_links(keyed, prints, width, similarity)).distinct(), "links")
    if links.isEmpty():
        labels = prints.select("node", F.col("node").alias("label")).limit(0)
    else:
        labels = components(links)
    more = spill(remaining_links(keyed, prints, labels, width, similarity).distinct(), "remaining")
    if not more.isEmpty():
        newer = components(more).select(F.col("node").alias("label"), F.col("label").alias("newer"))
        known = prints.select("node").distinct().join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        labels = spill(known.join(newer, "label", "left").select("node", F.coalesce("newer", "label").alias("label")), "labels")
    named = prints.select("id", "r1", "r2", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    first = named.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "r1", "r2")).alias("first"))
    kept = spill(first.select("first.r1", "first.r2"), "first-of-group")
    return keyed.join(kept, ["r1", "r2"], "left_semi").dropDuplicates(["r1", "r2"]).select("row.*")
