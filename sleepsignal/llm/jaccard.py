"""Similarity join on sets of five-word shingles with banded MinHash and exact verification.

1. Each text becomes its set of shingles, each set 120 minima of hash functions, dealt to 20 trees of depth 6.
   Texts with equal sets form one node; only nodes take part from here on.
2. In place of an LSH forest's sorted tries, bands: of each tree the first values, as many as the parameters
   allow if a pair at the threshold is to be missed by all trees with at most 1 - target (``depth_for``), are
   hashed and nodes with an equal hash meet. Nothing is shortened by what the data holds. The other values
   of a tree serve the comparison of signatures only. A node alone with its prefix in all trees has no partner.
3. Members of small prefixes are compared by their whole signatures; members of large ones are tied to the
   smallest. Either way a true pair that meets in some tree ends up in one component of candidates.
4. Sets of a component meet, once, in blocks of bounded size, and all pairs of a block pair are counted
   exactly through the shingles they share. No pair is ever a row: a node gets its number of links, and the
   links found in a block a spanning forest.

Work in step 4 is quadratic in the distinct texts of one component, in vectorised counting, not in rows.

Nulls and edge cases: words are lower-case runs of non-space; a text of one to four words has one shingle, all
of it; null, empty and blank texts have none, link to nothing and are classes of their own (class_id is their
doc_id); a null doc_id takes part and never names a class unless all its members are null; repeated rows are
copies of each other; an empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sleepsignal.llm.common import MIX_A, WordHashes, free_names, may_be_in, mix, release, runs, slices, small_batches, text_key, trimmed, word_hashes
from sleepsignal.llm.components import connected_components
from sleepsignal.session import cut

SHINGLE = 5
TREES, DEPTH = 20, 6
THRESHOLD = (4, 5)  # at least 4/5
TARGET = 0.9999
SMALL = 64  # members of a prefix that are compared one by one
BLOCK_NODES, BLOCK_SHINGLES = 1024, 2_000_000
SALTS = 16
NO_ID = -(1 << 63)


def shingles(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in ascending order, and how many each text has."""
    n = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    ends = np.cumsum(counts)
    first = runs(np.arange(len(words)), ends - counts, n)
    doc = np.repeat(np.arange(len(counts)), n)
    h = np.zeros(len(first), np.uint64)
    for k in range(SHINGLE):
        inside = k < counts[doc]
        h = mix(h * MIX_A + np.where(inside, words[np.minimum(first + k, max(0, len(words) - 1))], np.uint64(0)) + np.uint64(k))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.bincount(doc[new], minlength=len(counts))


def signatures(h: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """MinHash values [texts, size] as 32-bit numbers; all ones for an empty set."""
    rng = np.random.default_rng(5)
    factor = rng.integers(0, 1 << 32, size, np.uint32) | np.uint32(1)
    flip = rng.integers(0, 1 << 32, size, np.uint32)
    out = np.full((len(counts), size), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(counts)
    starts = (np.cumsum(counts) - counts)[full]
    x = (h >> np.uint64(32)).astype(np.uint32)
    group = (starts // 65_536) if len(starts) else starts
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(full)]])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a == b:
            continue
        lo, hi = starts[a], starts[b - 1] + counts[full[b - 1]]
        part, at = x[lo:hi], starts[a:b] - lo
        for k in range(size):
            out[full[a:b], k] = np.minimum.reduceat((part ^ flip[k]) * factor[k], at)
    return out


def depth_for(target: float, threshold: float, trees: int, depth: int) -> int:
    """Shorten the prefix from ``depth`` until a pair at the threshold meets in some tree with ``target``."""
    for k in range(depth, 0, -1):
        if 1 - (1 - threshold**k) ** trees >= target:
            return k
    raise ValueError("no prefix length reaches the target recall; use more trees")


def sketch(docs: DataFrame, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """doc_id, text key, node (128-bit hash of the set; null without words), n (shingles), signature of each row."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes(150_000)
        for whole in batches:
            for batch in slices(whole, "text", 2_000_000):
                h, n = shingles(*word_hashes(batch.column("text"), known))
                sig = signatures(h, n, trees * depth)
                ends = np.cumsum(n)
                node = [xxhash.xxh3_128_digest(h[a:b].tobytes()) if b > a else None for a, b in zip(ends - n, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("_k1"), batch.column("_k2"), pa.array(node, pa.binary()), pa.array(n.astype(np.int32)), pa.array([s.tobytes() for s in sig], pa.binary())],
                    ["doc_id", "_k1", "_k2", "node", "n", "signature"],
                )

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), *text_key(), F.col("text").cast("string"))
    return rows.mapInArrow(trimmed(make), "doc_id long, _k1 long, _k2 long, node binary, n int, signature binary")


def prefixes(nodes: DataFrame, k: int, trees: int, depth: int) -> DataFrame:
    """(prefix, node): the first ``k`` values of each tree, hashed together with the tree's number."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(-1, trees, depth)
            h = np.broadcast_to(np.arange(1, trees + 1, dtype=np.uint64), sig.shape[:2])
            for j in range(k):
                h = mix(h * MIX_A + sig[:, :, j])
            at = np.repeat(np.arange(batch.num_rows), trees)
            yield pa.RecordBatch.from_arrays([pa.array(h.reshape(-1).view(np.int64)), batch.column("node").take(pa.array(at))], ["prefix", "node"])

    return nodes.select("node", "signature").mapInArrow(make, "prefix long, node binary")


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest member of each one's component under the pairs (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def near_signatures(members: DataFrame, least: float, trees: int, depth: int) -> DataFrame:
    """Edges (a, b) that connect members of one prefix whose signatures agree in at least the share ``least``.

    Of all such pairs a spanning forest is enough, so there are fewer edges than members.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            prefix = table.column("prefix").to_numpy()
            if not len(prefix):
                continue
            sig = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint32).reshape(len(prefix), -1)
            a, b = [], []
            for d in range(1, min(SMALL, len(prefix))):
                at = np.flatnonzero(prefix[:-d] == prefix[d:])
                if not len(at):
                    break
                for part in np.array_split(at, 1 + len(at) // 20_000):
                    near = part[(sig[part] == sig[part + d]).mean(axis=1) >= least]
                    a.append(near)
                    b.append(near + d)
            if a:
                node = pa.array(table.column("node").to_pylist(), pa.binary())
                root = forest(np.concatenate(a), np.concatenate(b), len(prefix))
                child = np.flatnonzero(root != np.arange(len(prefix)))
                yield pa.RecordBatch.from_arrays([node.take(pa.array(root[child])), node.take(pa.array(child))], ["a", "b"])
            last = np.flatnonzero(prefix != prefix[-1])
            held = table.slice(int(last[-1]) + 1 if len(last) else 0)  # the open prefix, SMALL rows at most

    by = members.repartition("prefix").sortWithinPartitions("prefix", "node")
    return by.mapInArrow(make, "a binary, b binary")


def candidates(nodes: DataFrame, target: float, trees: int, depth: int) -> DataFrame:
    """Edges whose components hold every pair that meets in some tree and may reach the threshold."""
    threshold = THRESHOLD[0] / THRESHOLD[1]
    k = depth_for(target, threshold, trees, depth)
    least = threshold - 5 * math.sqrt(threshold * (1 - threshold) / (trees * depth))
    rows = cut(prefixes(nodes, k, trees, depth))
    shared = rows.groupBy("prefix").agg(F.count(F.lit(1)).alias("members"), F.min("node").alias("first")).filter("members > 1")
    shared = cut(shared).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    members = cut(salted.join(shared, ["prefix", "salt"]).drop("salt"))
    star = members.filter((F.col("members") > SMALL) & (F.col("node") != F.col("first"))).select(F.col("first").alias("a"), F.col("node").alias("b"))
    few = members.filter(F.col("members") <= SMALL).select("prefix", "node")
    near = near_signatures(few.join(nodes.select("node", "signature"), "node"), least, trees, depth)
    return star.unionByName(near).distinct()


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (node, doc_id, ...) with the set of each node, taken from that document."""
    extra = [c for c in wanted.columns if c != "doc_id"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in wanted.select(*extra).schema)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes(150_000)
        for whole in batches:
            for batch in slices(whole, "text", 2_000_000):
                h, n = shingles(*word_hashes(batch.column("text"), known))
                ends = np.cumsum(n)
                sets = [h[a:b].tobytes() for a, b in zip(ends - n, ends, strict=True)]
                keep = [i for i, node in enumerate(batch.column("node").to_pylist()) if xxhash.xxh3_128_digest(sets[i]) == node]
                columns = [batch.column(c).take(pa.array(keep, pa.int64())) for c in extra]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([sets[i] for i in keep], pa.binary())], [*extra, "set"])

    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    texts = docs.select(key.alias("_key"), F.col("text").cast("string"))
    texts = may_be_in(texts, F.xxhash64("_key"), wanted.select(F.xxhash64(key).alias("_h")), "_h")[0]  # else all texts are shuffled
    joined = texts.join(wanted.withColumn("_key", key).drop("doc_id"), "_key").select(*extra, "text")
    return joined.mapInArrow(trimmed(make), f"{kinds}, set binary")


def count_links(sets: list[np.ndarray], sizes: np.ndarray, left: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links of each set, weighted by ``sizes``, and for each a root of its cluster among these sets.

    ``same``: all pairs; else only pairs of the first ``left`` sets with the others. Shingles of one set alone
    can't be shared and are left out; the others make 0/1 matrices whose product counts what is shared.
    """
    m = len(sets)
    n = np.fromiter(map(len, sets), np.int64, m)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), n)
    use = times[column] > 1
    number = np.cumsum(times > 1) - 1
    row, column = row[use], number[column[use]]
    width = int(number[-1]) + 1 if len(number) else 0
    links, root = np.zeros(m, np.int64), np.arange(m)
    shared = np.zeros((m, m), np.float32)
    step = max(1, 8_000_000 // max(1, m))
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for a in range(0, width, step):
        lo, hi = np.searchsorted(column, [a, a + step])
        part = np.zeros((m, min(step, width - a)), np.float32)
        part[row[lo:hi], column[lo:hi] - a] = 1
        shared += part @ part.T
    near = THRESHOLD[1] * shared >= THRESHOLD[0] * (n[:, None] + n[None, :] - shared)
    np.fill_diagonal(near, False)
    if not same:
        near[:left, :left] = False
        near[left:, left:] = False
    links += near @ sizes
    while True:  # smallest root among neighbours, then the root's root
        low = np.where(near, root[None, :], m).min(axis=1, initial=m)
        new = np.minimum(root, low)
        new = np.minimum(new, new[new])
        if (new == root).all():
            return links, root
        root = new


def verify(rows: DataFrame) -> DataFrame:
    """(node, links, root, blocks): exact links of each node inside its block pair, and its cluster's root there.

    ``rows``: component, x and y (the block pair), block (the node's own), blocks, node, size, set.
    """

    def group(t: pa.Table) -> pa.RecordBatch:
        block, x = t.column("block").to_numpy(), t.column("x")[0].as_py()
        order = np.argsort(block != x, kind="stable")
        sets = [np.frombuffer(s, np.uint64) for s in t.column("set").to_pylist()]
        same = x == t.column("y")[0].as_py()
        links, root = count_links([sets[i] for i in order], t.column("size").to_numpy()[order], int((block == x).sum()), same)
        node = t.column("node").to_pylist()
        node = [node[i] for i in order]
        return pa.RecordBatch.from_arrays(
            [pa.array(node, pa.binary()), pa.array(links), pa.array([node[i] for i in root], pa.binary()), pa.array(t.column("blocks").to_numpy())],
            ["node", "links", "root", "blocks"],
        )

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, table]) if held is not None else table
            if not held.num_rows:
                continue
            key = np.stack([held.column("pair").to_numpy(), held.column("x").to_numpy(), held.column("y").to_numpy()])
            cuts = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield group(held.slice(a, b - a))
            held = held.slice(cuts[-1])
        if held is not None and held.num_rows:
            yield group(held)

    keyed = rows.withColumn("pair", F.xxhash64("component", F.lit("pair"))).drop("component")
    by = keyed.repartition("pair", "x", "y").sortWithinPartitions("pair", "x", "y", "node")
    return by.mapInArrow(trimmed(make), "node binary, links long, root binary, blocks int")


def link(docs: DataFrame, target: float = TARGET, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """Per row of ``docs``: doc_id, text key and, where it has links, root, class_id, n_links and copy_id."""
    sketches = cut(sketch(docs, trees, depth))
    nodes = sketches.filter(F.col("node").isNotNull()).groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("size"), F.max("n").alias("n"), F.max("signature").alias("signature"))
    nodes = cut(nodes)
    parts = connected_components(candidates(nodes, target, trees, depth)).withColumnRenamed("root", "component")
    members = cut(parts.join(nodes.select("node", "doc_id", "size", "n"), "node"))
    weight = members.groupBy("component").agg(F.count(F.lit(1)).alias("_nodes"), F.sum("n").alias("_n"))
    blocks = F.greatest(F.ceil(F.col("_nodes") / BLOCK_NODES), F.ceil(F.col("_n") / BLOCK_SHINGLES)).cast("int")
    placed = members.join(weight.select("component", blocks.alias("blocks")), "component")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).drop("n")
    sets = cut(sets_of(docs, placed).dropDuplicates(["node"]))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = sets.withColumn("_o", other).withColumn("x", F.least("block", "_o")).withColumn("y", F.greatest("block", "_o")).drop("_o")
    found = cut(verify(pairs))
    release(docs.sparkSession)
    links = found.groupBy("node").agg(F.sum("links").alias("links"), F.min("root").alias("root"), F.max("blocks").alias("blocks"))
    whole = links.filter("blocks = 1").select("node", "root")
    split = found.filter("blocks > 1 and node <> root").select("node", "root")
    joined = connected_components(split, "node", "root") if not split.isEmpty() else split
    roots = links.join(whole.unionByName(joined).withColumnRenamed("root", "_root"), "node", "left")
    roots = roots.select("node", "links", F.coalesce("_root", "node").alias("root"))
    known = nodes.select("node", "doc_id", "size").join(roots, "node", "left").filter("size > 1 or links > 0")
    known = known.withColumn("root", F.coalesce("root", "node"))
    named = known.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    info = known.join(named, "root").select("node", "root", F.col("doc_id").alias("copy_id"), "class_id", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    info = info.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = sketches.select("doc_id", "_k1", "_k2", "node", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    return rows.join(info, ["node", "salt"], "left").drop("salt")


def similarity_join(docs: DataFrame, target: float = TARGET, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """Per row of ``docs``: doc_id, class_id (smallest doc_id linked to it by a chain of links), n_links, copy_id.

    ``n_links`` counts the other rows with a Jaccard similarity of 0.8 or more, exact copies included;
    ``copy_id`` is the smallest doc_id with the same set of shingles.
    """
    out = link(docs, target, trees, depth)
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("copy_id", "doc_id").alias("copy_id"))


def keep_one(docs: DataFrame, target: float = TARGET, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """One row of each class of linked rows, all columns kept: smallest doc_id (null last), then smallest text key.

    Rows without links stay. Of rows with equal doc_id and text that are the first of their class, one stays.
    """
    rows = cut(link(docs, target, trees, depth).filter(F.col("root").isNotNull()).groupBy("root", "doc_id", "_k1", "_k2").agg(F.count(F.lit(1)).alias("n")))
    order = F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "_k1", "_k2")
    first = rows.groupBy("root").agg(F.min(order).alias("f")).select("root", F.col("f.doc_id").alias("f_id"), F.col("f._k1").alias("f1"), F.col("f._k2").alias("f2"))
    judged = rows.join(first, "root").withColumn("first", F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("_k1") == F.col("f1")) & (F.col("_k2") == F.col("f2")))
    j, j1, j2 = free_names(docs, "_j", "_j1", "_j2")
    judged = cut(judged.select(F.col("doc_id").alias(j), F.col("_k1").alias(j1), F.col("_k2").alias(j2), "n", "first"))
    k1, k2 = text_key()
    match = F.col("doc_id").cast("long").eqNullSafe(F.col(j)) & (k1 == F.col(j1)) & (k2 == F.col(j2))
    out = judged.filter("not first or n > 1").select(j, j1, j2)
    # rows that can't be meant pass by the join, else all texts would be shuffled
    doubted, clear = may_be_in(docs, F.xxhash64(F.col("doc_id").cast("long"), k1, k2), out.select(F.xxhash64(j, j1, j2).alias("_h")), "_h")
    out = clear.unionByName(doubted.join(out, match, "left_anti"))
    again = judged.filter("first and n > 1").select(j, j1, j2)
    if again.isEmpty():
        return out
    return out.unionByName(docs.join(again, match, "left_semi").dropDuplicates(["doc_id", "text"]))
