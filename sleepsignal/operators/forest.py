"""Deep random forests of many rows: a tree's large nodes are split by histograms, small ones are grown whole in one task.

1. Features become numbers of bins (at most ``BINS``, cut at quantiles); rows travel in blocks, a byte per feature.
2. While a node of a tree has more than ``most`` rows, its histograms are added up over the blocks and the best split of each node,
   not the histogram, goes to the driver. Below that, nothing depends on the number of nodes: a tree can have one per row.
3. A block's rows are dealt to the cells (subtrees) they fall into, and each cell is grown to the end in memory.
4. Rows are scored the same way: dealt to cells, or to a few whole trees at once where those are small, and votes are added up per block.

As in pyspark.ml: Poisson counts of rows per tree, the root of the number of features per node, Gini impurity with class weights,
a node is a leaf when no split lowers it, a tree votes with its leaf's shares. Draws follow from the seed, tree, node and block.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sleepsignal.session import cut

BINS = 32
#: Rows of a cell, which one task holds.
CELL_ROWS = 1 << 19
#: Nodes whose histograms are held at a time, and rows counted at a time.
NODES, ROWS = 1024, 1 << 17
#: Large nodes that are split in one pass; a task holds the histograms of all.
LARGE = 1 << 13
#: Relative error of the quantiles that bins are cut at.
QUANTILE_ERROR = 0.001
#: Tasks of a pass, where there are so many trees.
TASKS = 96


@dataclass
class Tree:
    """Nodes in the order they were made; ``feature`` -1 marks a leaf. Children are ``left`` and the one after it."""

    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    shares: np.ndarray  # (nodes, classes): class shares, of leaves
    importance: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """Number of the node in which each row of bins ends."""
        at, live = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(live):
            here = at[live]
            f = self.feature[here]
            live, here, f = live[f >= 0], here[f >= 0], f[f >= 0]
            at[live] = self.left[here] + (x[live, f] > self.bin[here])
        return at


def candidates(features: int, seed: int, *where: int) -> np.random.Generator:
    return np.random.default_rng([seed, features, *where])


def drawn_features(rng: np.random.Generator, nodes: int, features: int) -> np.ndarray:
    """Distinct features for each node: as many as the root of their number, rounded up."""
    tried = math.ceil(math.sqrt(features))
    return np.argsort(rng.random((nodes, features)), axis=1)[:, :tried]


def best_splits(hist: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gain times weight, place among the tried features, last bin of the left side) of each node from (nodes, tried, bins, classes) counts."""
    left = np.cumsum(hist, axis=2)
    total = left[:, :, -1:, :]
    left, right = left[:, :, :-1, :] * weight, (total - left[:, :, :-1, :]) * weight
    total = total * weight
    pure = lambda c: np.divide((c**2).sum(-1), s := c.sum(-1), out=np.zeros(c.shape[:-1]), where=s > 0)
    gain = pure(left) + pure(right) - pure(total)
    gain[(left.sum(-1) <= 0) | (right.sum(-1) <= 0)] = -1.0
    flat = gain.reshape(len(hist), -1)
    best = flat.argmax(axis=1)
    gain = flat[np.arange(len(hist)), best]
    gain[gain <= 1e-12 * total[:, 0, 0, :].sum(-1)] = 0.0
    return gain, best // left.shape[2], best % left.shape[2]


def histograms(x: np.ndarray, y: np.ndarray, count: np.ndarray, node: np.ndarray, tried: np.ndarray, classes: int, rows: int = ROWS) -> np.ndarray:
    """(nodes, tried, bins, classes) counts of the rows of each node by the bins of the features it tries."""
    m, k = tried.shape
    out = np.zeros(m * k * BINS * classes)
    for a in range(0, len(x), rows):
        part = slice(a, a + rows)
        own = node[part]
        bins = x[part][np.arange(len(own))[:, None], tried[own]]
        at = ((own[:, None] * k + np.arange(k)) * BINS + bins) * classes + y[part][:, None]
        out += np.bincount(at.ravel(), np.repeat(count[part], k), len(out))
    return out.reshape(m, k, BINS, classes)


def grow_cell(x: np.ndarray, y: np.ndarray, count: np.ndarray, weight: np.ndarray, depth: int, seed: int, tree: int, node: int) -> Tree:
    """A subtree of at most ``depth`` levels below its root, level by level; ``count`` says how often a row was drawn."""
    classes, features = len(weight), x.shape[1]
    made, importance, n_nodes = [], np.zeros(features), 0
    at, rows = np.zeros(len(x), np.int64), np.arange(len(x))  # rows in the order of their nodes, numbered within the level
    m = 1
    for level in range(depth + 1):
        stats = np.bincount(at * classes + y[rows], count[rows], m * classes).reshape(m, classes) * weight
        feature, cut_at, left = np.full(m, -1, np.int32), np.zeros(m, np.uint8), np.zeros(m, np.int32)
        mixed = np.flatnonzero((stats > 0).sum(axis=1) > 1) if level < depth else np.zeros(0, np.int64)
        ends = np.searchsorted(at, np.arange(m + 1))
        rng = candidates(features, seed, tree, node, level)
        for a in range(0, len(mixed), NODES):
            some = mixed[a: a + NODES]
            where = np.full(some[-1] - some[0] + 1, -1)
            where[some - some[0]] = np.arange(len(some))
            lo, hi = ends[some[0]], ends[some[-1] + 1]
            own = where[at[lo:hi] - some[0]]
            mine = rows[lo:hi][own >= 0]
            tried = drawn_features(rng, len(some), features)
            gain, place, last = best_splits(histograms(x[mine], y[mine], count[mine], own[own >= 0], tried, classes), weight)
            split = gain > 0
            f = tried[np.arange(len(some)), place]
            feature[some[split]], cut_at[some[split]] = f[split], last[split]
            np.add.at(importance, f[split], gain[split])
        split = np.flatnonzero(feature >= 0)
        left[split] = n_nodes + m + 2 * np.arange(len(split))
        made.append((feature, cut_at, left, stats / np.maximum(stats.sum(axis=1, keepdims=True), 1e-300)))
        n_nodes += m
        if not len(split):
            break
        new = np.full(m, -1)
        new[split] = 2 * np.arange(len(split))
        live = new[at] >= 0
        at, rows = at[live], rows[live]
        at = new[at] + (x[rows, feature[at]] > cut_at[at])
        order = np.argsort(at, kind="stable")
        at, rows, m = at[order], rows[order], 2 * len(split)
    return Tree(*[np.concatenate([level[i] for level in made]) for i in range(4)], importance)


def drawn_counts(seed: int, tree: int, block: int, n: int) -> np.ndarray:
    """How often a tree draws each row of a block."""
    return np.random.default_rng([seed, tree, block]).poisson(1.0, n).astype(np.uint8)


# -- blocks ----------------------------------------------------------------------------------------


def cuts_of(rows: DataFrame, cols: Sequence[str]) -> list[np.ndarray]:
    """For each feature the values up to which rows lie left of a cut: its quantiles, without those nothing lies beyond."""
    found = rows.approxQuantile(list(cols), [k / BINS for k in range(1, BINS)] + [1.0], QUANTILE_ERROR)
    return [np.unique(q[:-1])[np.unique(q[:-1]) < q[-1]] if q else np.zeros(0) for q in found]


def blocks_of(rows: DataFrame, assemble, cuts: Sequence[np.ndarray], row: str | None = None) -> DataFrame:
    """Rows as blocks: (block, n, x, y, row) with a byte per feature and class, and the number of each row where it has one."""
    own = F.lit(0).cast("long") if row is None else F.col(row)
    y = F.col("y").cast("double") if row is None else F.lit(0.0)
    flat = assemble.transform(rows).select(vector_to_array("features").alias("x"), y.alias("y"), own.alias("row"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n:
                values = batch.column("x").flatten().to_numpy().reshape(n, len(cuts))
                bins = np.stack([np.searchsorted(c, values[:, j], side="left") for j, c in enumerate(cuts)], axis=1).astype(np.uint8)
                y = batch.column("y").to_numpy()
                if not ((y == np.floor(y)) & (y >= 0) & (y < 256)).all():
                    raise ValueError("classes must be whole numbers from 0 to 255")
                cells = [bins.tobytes(), y.astype(np.uint8).tobytes(), batch.column("row").to_numpy().tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), *[pa.array([c], pa.binary()) for c in cells]], ["n", "x", "y", "row"])

    made = flat.mapInArrow(make, "n int, x binary, y binary, row binary")
    return cut(made.select(F.monotonically_increasing_id().alias("block"), "*"))


def _in_blocks(batches: Iterator[pa.RecordBatch], features: int) -> Iterator[tuple]:
    for batch in batches:
        for block, n, x, y, row in zip(*[batch.column(c) for c in ("block", "n", "x", "y", "row")], strict=True):
            x, y, row = (v.as_buffer() for v in (x, y, row))
            yield block.as_py(), n.as_py(), np.frombuffer(x, np.uint8).reshape(-1, features), np.frombuffer(y, np.uint8), np.frombuffer(row, np.int64)


# -- growing ---------------------------------------------------------------------------------------


def _split_large(blocks: DataFrame, tops: list[Tree], sizes: dict, weight: np.ndarray, depth: int, seed: int, features: int, most: int) -> dict:
    """Split the nodes of ``sizes`` (tree, node) -> (rows, level) that have more than ``most`` rows until none has; gives those that are left to grow."""
    classes, tried = len(weight), math.ceil(math.sqrt(features))
    while large := sorted(key for key, (n, level) in sizes.items() if n > most and level < depth):
        open_nodes = defaultdict(list)
        for t, node in large[:LARGE]:
            open_nodes[t].append(node)
        plan = [(t, tops[t], np.array(nodes)) for t, nodes in open_nodes.items()]
        draw = lambda t, node: drawn_features(candidates(features, seed, t, node, 1 << 20), 1, features)[0]

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = {}
            pick = {t: np.stack([draw(t, node) for node in nodes]) for t, _, nodes in plan}
            for block, n, x, y, _ in _in_blocks(batches, features):
                for t, top, nodes in plan:
                    times = drawn_counts(seed, t, block, n)
                    ends = top.leaf_of(x)
                    mine = np.flatnonzero((times > 0) & np.isin(ends, nodes))
                    own = np.searchsorted(nodes, ends[mine])
                    # Counts of draws by class, and of rows as one class more.
                    drawn = histograms(x[mine], y[mine], times[mine].astype(float), own, pick[t], classes)
                    seen = histograms(x[mine], np.zeros(len(mine), np.uint8), np.ones(len(mine)), own, pick[t], 1)
                    both = np.concatenate([drawn, seen], axis=3)
                    sums[t] = sums.get(t, 0) + both
            for t, _, nodes in plan:
                if t in sums:
                    cells = [pa.array([h.tobytes() for h in sums[t]], pa.binary())]
                    yield pa.RecordBatch.from_arrays([pa.array([t] * len(nodes), pa.int32()), pa.array(nodes, pa.int64()), *cells], ["tree", "node", "hist"])

        def best(rows: pa.Table) -> pa.Table:
            t, node = rows.column("tree")[0].as_py(), rows.column("node")[0].as_py()
            hist = sum(np.frombuffer(h.as_buffer()) for h in rows.column("hist")).reshape(1, tried, BINS, classes + 1)
            gain, place, last = best_splits(hist[..., :classes], weight)
            left = hist[0, place[0], : last[0] + 1].sum(axis=0)
            right = hist[0, place[0]].sum(axis=0) - left
            row = (t, node, int(draw(t, node)[place[0]]), int(last[0]), float(gain[0]), int(left[-1]), int(right[-1]), (left + right)[:-1].tolist(), left[:-1].tolist(), right[:-1].tolist())
            return pa.Table.from_pylist([dict(zip(names, row, strict=True))], schema)

        names = ["tree", "node", "feature", "bin", "gain", "left", "right", "own", "lefts", "rights"]
        schema = pa.schema(list(zip(names, (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), *[pa.list_(pa.float64())] * 3), strict=True)))
        sql = "tree int, node long, feature int, bin int, gain double, left long, right long, own array<double>, lefts array<double>, rights array<double>"
        partial = blocks.mapInArrow(count, "tree int, node long, hist binary")
        for r in sorted(partial.groupBy("tree", "node").applyInArrow(best, sql).collect()):
            top, (_, level) = tops[r["tree"]], sizes.pop((r["tree"], r["node"]))
            own = np.array(r["own"]) * weight
            top.shares[r["node"]] = own / own.sum()
            if r["gain"] > 0:
                first = len(top.feature)
                top.feature[r["node"]], top.bin[r["node"]], top.left[r["node"]] = r["feature"], r["bin"], first
                top.importance[r["feature"]] += r["gain"]
                kids = [np.array(c) * weight for c in (r["lefts"], r["rights"])]
                tops[r["tree"]] = Tree(
                    np.append(top.feature, np.full(2, -1, np.int32)), np.append(top.bin, np.zeros(2, np.uint8)), np.append(top.left, np.zeros(2, np.int32)),
                    np.append(top.shares, [k / k.sum() for k in kids], axis=0), top.importance)
                for i, (side, k) in enumerate(zip(("left", "right"), kids, strict=True)):
                    if (k > 0).sum() > 1 and level + 1 < depth:
                        sizes[r["tree"], first + i] = (r[side], level + 1)
    return sizes


def _dealt(blocks: DataFrame, tops: list[Tree], cells: dict[tuple[int, int], int], features: int, seed: int | None, tasks: int) -> DataFrame:
    """(cell, block, n, x, y, row, times) of the rows of each block that fall into each cell; all rows without ``seed``, else those that the tree draws."""
    of_tree = defaultdict(dict)
    for (t, node), cell in cells.items():
        of_tree[t][node] = cell
    plan = [(t, tops[t] if set(nodes) != {0} else None, nodes) for t, nodes in sorted(of_tree.items())]
    names = ["cell", "block", "n", "x", "y", "row", "times"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, n, x, y, row in _in_blocks(batches, features):
            sent = set()
            for t, top, nodes in plan:
                times = np.ones(n, np.uint8) if seed is None else drawn_counts(seed, t, block, n)
                ends = np.zeros(n, np.int64) if top is None else top.leaf_of(x)
                for node, cell in nodes.items():
                    mine = np.flatnonzero((times > 0) & (ends == node))
                    if not len(mine) or cell in sent:
                        continue
                    if seed is None:
                        sent.add(cell)  # trees that are scored together share their rows
                    blobs = [v[mine].tobytes() for v in (x, y, row, times)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([cell], pa.int64()), pa.array([block], pa.int64()), pa.array([len(mine)], pa.int32()), *[pa.array([b], pa.binary()) for b in blobs]], names)

    sent = blocks.mapInArrow(deal, "cell long, block long, n int, x binary, y binary, row binary, times binary")
    return sent.repartition(tasks, "cell")


def _joined(rows: pa.Table, name: str, dtype=np.uint8) -> np.ndarray:
    return np.concatenate([np.frombuffer(b.as_buffer(), dtype) for b in rows.column(name)])


PARTS = {"feature": np.int32, "bin": np.uint8, "left": np.int32, "shares": np.float64, "importance": np.float64}
CELL = "cell long, feature binary, bin binary, left binary, shares binary, importance binary"


def _row(cell: int, tree: Tree) -> pa.Table:
    return pa.table({"cell": pa.array([cell], pa.int64()), **{c: pa.array([getattr(tree, c).astype(t).tobytes()], pa.binary()) for c, t in PARTS.items()}})


def _tree(row: dict, classes: int) -> Tree:
    read = {c: np.frombuffer(row[c], t) for c, t in PARTS.items()}
    return Tree(**{**read, "shares": read["shares"].reshape(-1, classes)})


@dataclass(frozen=True)
class Grown:
    """A forest whose trees are a table of cells: their upper nodes here, their subtrees in the shared folder."""

    assemble: object
    cuts: list[np.ndarray]
    tops: list[Tree]
    cells: dict[tuple[int, int], int]
    table: DataFrame
    classes: int
    n_rows: int

    def transform(self, df: DataFrame) -> DataFrame:
        """The rows with ``probability`` and ``prediction`` from the votes of all trees."""
        rows = cut(df.withColumn("_row", F.monotonically_increasing_id()))
        features, classes, trees = len(self.cuts), self.classes, len(self.tops)
        blocks = blocks_of(rows, self.assemble, self.cuts, "_row")
        whole = all(node == 0 for _, node in self.cells)
        # Small trees are scored a few at a time, so that rows are sent less often; a group has at most the nodes of one large cell.
        together = max(1, min(CELL_ROWS // max(1, self.n_rows), -(-trees // TASKS * 4))) if whole else 1
        group = {cell: cell // together for cell in self.cells.values()}
        dealt = _dealt(blocks, self.tops, {key: group[cell] for key, cell in self.cells.items()}, features, None, TASKS)
        cells = self.table.withColumn("_group", F.floor(F.col("cell") / together).cast("long")).repartition(TASKS, "_group")

        made = pa.schema([("cell", pa.int64()), ("block", pa.int64()), ("row", pa.binary()), ("votes", pa.binary())])

        def score(rows: pa.Table, cells: pa.Table) -> pa.Table:
            found = [_tree(r, classes) for r in sorted(cells.to_pylist(), key=lambda r: r["cell"])]
            out = []
            for block, n, x, row in zip(*[rows.column(c) for c in ("block", "n", "x", "row")], strict=True):
                bins = np.frombuffer(x.as_buffer(), np.uint8).reshape(n.as_py(), features)
                votes = sum((t.shares[t.leaf_of(bins)] for t in found), np.zeros((len(bins), classes)))
                out.append({"cell": rows.column("cell")[0].as_py(), "block": block.as_py(), "row": row.as_py(), "votes": votes.tobytes()})
            return pa.Table.from_pylist(out, made)

        ended = [(t, top) for t, top in enumerate(self.tops) if not whole or (t, 0) not in self.cells]  # trees with leaves among their upper nodes
        left_out = {t: np.array(sorted(node for u, node in self.cells if u == t), np.int64) for t, _ in ended}

        def early(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block, n, x, _, row in _in_blocks(batches, features):
                votes = np.zeros((n, classes))
                for t, top in ended:
                    ends = top.leaf_of(x)
                    here = ~np.isin(ends, left_out[t])
                    votes[here] += top.shares[ends[here]]
                yield pa.RecordBatch.from_pylist([{"cell": -1, "block": block, "row": row.tobytes(), "votes": votes.tobytes()}], made)

        kind = "cell long, block long, row binary, votes binary"
        votes = dealt.groupBy("cell").cogroup(cells.groupBy("_group")).applyInArrow(score, kind)
        votes = votes.unionByName(blocks.mapInArrow(early, kind)) if ended else votes

        def add_up(found: pa.Table) -> pa.Table:
            parts = sorted(found.to_pylist(), key=lambda r: r["cell"])
            ids = [np.frombuffer(r["row"], np.int64) for r in parts]
            own = np.unique(np.concatenate(ids))
            total = np.zeros((len(own), classes))
            for at, r in zip(ids, parts, strict=True):
                total[np.searchsorted(own, at)] += np.frombuffer(r["votes"]).reshape(-1, classes)
            share = total / total.sum(axis=1, keepdims=True)
            shares = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * classes, pa.int32()), pa.array(share.ravel()))
            return pa.table({"_row": pa.array(own), "probability": shares, "prediction": pa.array(total.argmax(axis=1).astype(float))})

        p = votes.groupBy("block").applyInArrow(add_up, "_row long, probability array<double>, prediction double")
        return rows.join(p, "_row").drop("_row")

    def importances(self) -> np.ndarray:
        """Mean over the trees of their scaled impurity importances."""
        total = np.stack([t.importance for t in self.tops])
        of_cell = {cell: t for (t, _), cell in self.cells.items()}
        for r in self.table.select("cell", "importance").orderBy("cell").toLocalIterator():
            total[of_cell[r["cell"]]] += np.frombuffer(r["importance"])
        scaled = np.divide(total, s := total.sum(axis=1, keepdims=True), out=np.zeros_like(total), where=s > 0).sum(axis=0)
        return scaled / scaled.sum() if scaled.sum() > 0 else scaled


def grow(w: DataFrame, assemble, trees: int, depth: int, seed: int, most: int | None = None) -> Grown:
    """A forest on rows with the assembler's columns, ``y`` and ``weight``, which is one per class."""
    most = CELL_ROWS if most is None else most
    cols, n_rows = assemble.getInputCols(), w.count()
    per = {int(r["y"]): r["w"] for r in w.groupBy("y").agg(F.max("weight").alias("w")).collect()}
    weight = np.array([per.get(c, 0.0) for c in range(max(per) + 1)])
    cuts = cuts_of(w, cols)
    blocks = blocks_of(w, assemble, cuts)
    features, classes = len(cols), len(weight)
    # The table's shares stand for a tree that drew no row at all.
    start = lambda: Tree(np.full(1, -1, np.int32), np.zeros(1, np.uint8), np.zeros(1, np.int32), np.full((1, classes), 1.0 / classes), np.zeros(features))
    tops = [start() for _ in range(trees)]
    left = _split_large(blocks, tops, {(t, 0): (n_rows, 0) for t in range(trees)}, weight, depth, seed, features, most)
    cells = {key: i for i, key in enumerate(sorted(left))}
    own = {i: (*key, left[key][1]) for key, i in cells.items()}

    def finish(rows: pa.Table) -> pa.Table:
        cell = rows.column("cell")[0].as_py()
        order = np.argsort(rows.column("block").to_numpy(), kind="stable")
        rows = rows.take(pa.array(order))
        t, node, level = own[cell]
        x = _joined(rows, "x").reshape(-1, features)
        return _row(cell, grow_cell(x, _joined(rows, "y"), _joined(rows, "times").astype(float), weight, depth - level, seed, t, node))

    table = cut(_dealt(blocks, tops, cells, features, seed, max(TASKS, 2 * len(cells))).groupBy("cell").applyInArrow(finish, CELL))
    return Grown(assemble, cuts, tops, cells, table, classes, n_rows)
