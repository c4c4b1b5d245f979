"""Approximate nearest neighbours by largest inner product: NN-descent builds a graph, queries walk it greedily.

Vectors get one more component, sqrt(M^2 - |x|^2) with M the largest length, so that the nearest of these is
the one with the largest inner product. Equal vectors are one node.

Building: nodes meet in several random groups first and keep their ``degree`` nearest. Then, in rounds, each node
joins its neighbours and a bounded number of those it is a neighbour of; members of such a group that have not
met before are compared, and each keeps its nearest. Rounds end when few neighbours change.

Searching: the graph, its reversed edges and a few random ones lead from ``entries`` nodes, a fixed number, to
nearer ones: a query keeps the best ``beam`` nodes and opens the neighbours of its best unopened ones until
none is left. What it holds is then scored again in double precision on the original vectors.

Each round's tables are written, so a lost executor costs one round at most.

Nulls and edge cases: vectors that are null, empty, all zero, of another than the most frequent dimension (the
smaller of equally frequent ones), or that hold a null or non-finite component take no part, nor does a null
vec_id; exact repeats of a row count once; ties go to the smaller vec_id; fewer candidates than asked for are
all returned; an empty table or no query gives no rows. Only vec_id and embedding are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sleepsignal.llm.common import release, trimmed
from sleepsignal.session import cut

DEGREE, REVERSE = 40, 32
GROUP, STARTS = 64, 4
OFFERS = 10  # neighbours a group offers to each member
ROUNDS, SETTLED = 10, 0.02
ENTRIES, BEAM, OPEN = 512, 128, 16
RANDOM_LINKS = 2


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and x (array of double) of the vectors that take part."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("x")).filter("vec_id is not null and x is not null")
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = rows.filter(~F.coalesce(bad, F.lit(True)) & F.exists("x", lambda v: v != 0))
    size = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    return rows.filter(F.size("x") == (size["d"] if size else 0))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, v: t + v)


def sample_hash(seed: int, *columns: str) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def nodes_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct vectors (node: smallest vec_id, x, vec: 32-bit with the added component), and (node, vec_id)."""
    keyed = rows.withColumn("h1", F.xxhash64(F.lit(1), "x")).withColumn("h2", F.xxhash64(F.lit(2), "x"))
    first = keyed.groupBy("h1", "h2").agg(F.min("vec_id").alias("node"))
    members = cut(keyed.select("h1", "h2", "vec_id").distinct().join(first, ["h1", "h2"]).select("node", "vec_id"))
    top = rows.agg(F.max(dot("x", "x"))).first()[0] or 1.0
    extra = F.sqrt(F.greatest(F.lit(0.0), F.lit(float(top)) - dot("x", "x")))
    plain = rows.join(members.filter("node = vec_id").select("node"), F.col("vec_id") == F.col("node"), "left_semi").dropDuplicates(["vec_id"])
    full = plain.select(F.col("vec_id").alias("node"), "x", F.concat("x", F.array(extra)).alias("y"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vec = [np.asarray(y, np.float32).tobytes() for y in b.column("y").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("x"), pa.array(vec, pa.binary())], ["node", "x", "vec"])

    return cut(full.mapInArrow(trimmed(pack), "node long, x array<double>, vec binary")), members


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that hold whole groups of rows that are sorted by ``key``."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = pa.concat_tables([held, table]) if held is not None else table
        k = held.column(key).to_numpy()
        other = np.flatnonzero(k != k[-1]) if len(k) else k
        if len(other):
            cut_at = int(other[-1]) + 1
            yield held.slice(0, cut_at)
            held = held.slice(cut_at)
    if held is not None and held.num_rows:
        yield held


def local_join(members: DataFrame) -> DataFrame:
    """Offers (u, c, s): of each group g, pairs of which one is fresh and that beat u's worst neighbour."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "g"):
            g, u = table.column("g").to_numpy(), table.column("u").to_numpy()
            x = np.frombuffer(b"".join(table.column("vec").to_pylist()), np.float16).reshape(len(g), -1)
            worst, fresh = table.column("worst").to_numpy(), table.column("fresh").to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.flatnonzero(np.diff(g)) + 1])
            sizes = np.diff(np.concatenate([starts, [len(g)]]))
            order = np.argsort(sizes, kind="stable")  # groups of like size are padded together
            for a in range(0, len(order), 256):
                some = order[a: a + 256]
                some = some[sizes[some] > 1]
                if not len(some):
                    continue
                m = int(sizes[some].max())
                at = starts[some, None] + np.arange(m)
                real = np.arange(m) < sizes[some, None]
                at = np.where(real, at, 0)
                v = x[at].astype(np.float32)
                s = v @ v.transpose(0, 2, 1)
                ids, new = u[at], fresh[at] & real
                good = real[:, :, None] & real[:, None, :] & (ids[:, :, None] != ids[:, None, :]) & (new[:, :, None] | new[:, None, :])
                good &= s > worst[at][:, :, None]
                s = np.where(good, s, -np.inf)
                take = min(OFFERS, m - 1)
                best = np.argpartition(-s, take - 1, axis=2)[:, :, :take]
                value = np.take_along_axis(s, best, 2)
                ok = np.isfinite(value)
                who = np.broadcast_to(ids[:, :, None], best.shape)[ok]
                other = np.take_along_axis(np.broadcast_to(ids[:, None, :], s.shape), best, 2)[ok]
                yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(other), pa.array(value[ok])], ["u", "c", "s"])

    by = members.repartition("g").sortWithinPartitions("g")
    return by.mapInArrow(trimmed(make), "u long, c long, s float")


def keep_nearest(rows: DataFrame, degree: int) -> DataFrame:
    """Of ``rows`` (u, c, s, old) the ``degree`` nearest c of each u, with ``fresh`` and u's ``worst``."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "u"):
            u, c, s, old = (t.column(k).to_numpy(zero_copy_only=False) for k in ("u", "c", "s", "old"))
            order = np.lexsort((~old, c, u))
            u, c, s, old = u[order], c[order], s[order], old[order]
            first = np.ones(len(u), bool)
            first[1:] = (u[1:] != u[:-1]) | (c[1:] != c[:-1])
            u, c, s, old = u[first], c[first], s[first], old[first]
            order = np.lexsort((c, -s, u))
            u, c, s, old = u[order], c[order], s[order], old[order]
            start = np.searchsorted(u, u)
            keep = np.arange(len(u)) - start < degree
            u, c, s, old = u[keep], c[keep], s[keep], old[keep]
            end = np.searchsorted(u, u, side="right")
            full = end - np.searchsorted(u, u) >= degree
            worst = np.where(full, s[end - 1], -np.inf).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(c), pa.array(s), pa.array(~old), pa.array(worst)], ["u", "c", "s", "fresh", "worst"])

    by = rows.repartition("u").sortWithinPartitions("u")
    return by.mapInArrow(trimmed(make), "u long, c long, s float, fresh boolean, worst float")


def half_precision(nodes: DataFrame) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vec = [np.frombuffer(v, np.float32).astype(np.float16).tobytes() for v in b.column("vec").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(vec, pa.binary())], ["node", "vec"])

    return nodes.select("node", "vec").mapInArrow(trimmed(make), "node long, vec binary")


def build_graph(nodes: DataFrame, degree: int = DEGREE, reverse: int = REVERSE, rounds: int = ROUNDS) -> DataFrame:
    """Directed edges (u, c, s) from each node to its nearest found."""
    half = cut(half_precision(nodes))
    n = half.count()
    groups = max(1, -(-n // GROUP))
    lowest = F.lit(float("-inf")).cast("float")
    # several groupings, so that neighbours of neighbours lead out of a group
    dealt = F.explode(F.array(*[F.pmod(sample_hash(100 + k, "node"), F.lit(groups)) * STARTS + k for k in range(STARTS)]))
    start = half.select(dealt.alias("g"), F.col("node").alias("u"), "vec", lowest.alias("worst"), F.lit(True).alias("fresh"))
    edges = cut(keep_nearest(local_join(start).withColumn("old", F.lit(False)), degree))
    few = Window.partitionBy("g").orderBy(sample_hash(5, "g", "u"), "u")
    for _ in range(rounds):
        forward = edges.select(F.col("u").alias("g"), F.col("c").alias("u"), "fresh")
        back = edges.select(F.col("c").alias("g"), "u", "fresh").withColumn("_r", F.row_number().over(few)).filter(F.col("_r") <= reverse).drop("_r")
        both = forward.unionByName(back).groupBy("g", "u").agg(F.max("fresh").alias("fresh"))
        worst = edges.groupBy("u").agg(F.max("worst").alias("worst"))
        info = half.join(worst, half["node"] == worst["u"], "left").select("node", "vec", F.coalesce("worst", lowest).alias("worst"))
        members = both.join(info, both["u"] == info["node"]).select("g", "u", "vec", "worst", "fresh")
        offers = local_join(members).withColumn("old", F.lit(False))
        release(half.sparkSession)
        edges = cut(keep_nearest(edges.select("u", "c", "s", F.lit(True).alias("old")).unionByName(offers), degree))
        if edges.filter("fresh").count() <= SETTLED * n * degree:
            break
    return edges.select("u", "c", "s")


def walks(edges: DataFrame, nodes: DataFrame, reverse: int = REVERSE) -> DataFrame:
    """Undirected links (a, b) for the search: edges, a bounded number of reversed ones, a few random ones."""
    few = Window.partitionBy("a").orderBy(F.desc("s"), "b")
    back = edges.select(F.col("c").alias("a"), F.col("u").alias("b"), "s").withColumn("_r", F.row_number().over(few)).filter(F.col("_r") <= reverse)
    n = max(1, nodes.count() // 8)
    near = edges.select(F.col("u").alias("a"), F.col("c").alias("b")).unionByName(back.select("a", "b"))
    for k in range(RANDOM_LINKS):
        in_group = Window.partitionBy("_g").orderBy("node")
        ring = nodes.select("node", F.pmod(sample_hash(40 + k, "node"), F.lit(n)).alias("_g")).withColumn("b", F.lead("node").over(in_group)).filter("b is not null")
        near = near.unionByName(ring.select(F.col("node").alias("a"), "b")).unionByName(ring.select(F.col("b").alias("a"), F.col("node").alias("b")))
    return near.distinct()


STATE = "q long, query binary, ids binary, scores binary, opened binary, todo array<long>"


def best_of(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, opened: np.ndarray, beam: int, width: int) -> dict:
    """A query's state after its best ``beam`` nodes were picked and the next ``width`` to open were marked."""
    order = np.lexsort((ids, -scores))[:beam]
    ids, scores, opened = ids[order], scores[order], opened[order].copy()
    todo = np.flatnonzero(~opened)[:width]
    opened[todo] = True
    return {"query": query.tobytes(), "ids": ids.tobytes(), "scores": scores.tobytes(), "opened": opened.tobytes(), "todo": ids[todo].tolist()}


STATE_SCHEMA = pa.schema([("q", pa.int64()), ("query", pa.binary()), ("ids", pa.binary()), ("scores", pa.binary()), ("opened", pa.binary()), ("todo", pa.list_(pa.int64()))])


def begin(queries: DataFrame, nodes: DataFrame, entries: int, beam: int, width: int) -> DataFrame:
    """States of the queries (q, query) at the entry nodes, ``entries`` at most by smallest hash."""
    got = nodes.select("node", "vec").orderBy(sample_hash(9, "node"), "node").limit(entries).toArrow()
    ids = got.column("node").to_numpy()
    x = np.frombuffer(b"".join(got.column("vec").to_pylist()), np.float32)
    x = x.reshape(len(ids), len(x) // max(1, len(ids)))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for q, v in zip(b.column("q").to_pylist(), b.column("query").to_pylist(), strict=True):
                query = np.frombuffer(v, np.float32)
                rows.append({"q": q, **best_of(query, ids, x @ query, np.zeros(len(ids), bool), beam, width)})
            yield pa.RecordBatch.from_pylist(rows, STATE_SCHEMA)

    return queries.mapInArrow(trimmed(make), STATE)


def advance(states: DataFrame, found: DataFrame, beam: int, width: int) -> DataFrame:
    """States after the nodes ``found`` (q, node, vec) were scored."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "q"):
            q, node = t.column("q").to_numpy(), t.column("node").to_numpy()
            vec = t.column("vec").to_pylist()
            state = {k: t.column(k).to_pylist() for k in ("ids", "scores", "opened")}
            rows = []
            starts = np.concatenate([[0], np.flatnonzero(np.diff(q)) + 1, [len(q)]])
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                query = np.frombuffer(vec[a], np.float32)  # the state's row is first
                ids, scores, opened = np.frombuffer(state["ids"][a], np.int64), np.frombuffer(state["scores"][a], np.float32), np.frombuffer(state["opened"][a], bool)
                new = ~np.isin(node[a + 1: b], ids)
                if new.any():
                    x = np.frombuffer(b"".join(v for v, k in zip(vec[a + 1: b], new, strict=True) if k), np.float32).reshape(int(new.sum()), -1)
                    ids = np.concatenate([ids, node[a + 1: b][new]])
                    scores = np.concatenate([scores, x @ query])
                    opened = np.concatenate([opened, np.zeros(len(x), bool)])
                rows.append({"q": int(q[a]), **best_of(query, ids, scores, opened, beam, width)})
            yield pa.RecordBatch.from_pylist(rows, STATE_SCHEMA)

    none = F.lit(None).cast("binary")
    heads = states.select("q", F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("node"), F.col("query").alias("vec"), "ids", "scores", "opened")
    rows = heads.unionByName(found.select("q", F.lit(1).alias("kind"), "node", "vec", none.alias("ids"), none.alias("scores"), none.alias("opened")))
    return rows.repartition("q").sortWithinPartitions("q", "kind", "node").mapInArrow(trimmed(make), STATE)


def greedy_search(queries: DataFrame, nodes: DataFrame, links: DataFrame, entries: int = ENTRIES, beam: int = BEAM, width: int = OPEN) -> DataFrame:
    """(q, node) of the best ``beam`` nodes found for each of the queries (q, query)."""
    vectors = nodes.select("node", "vec")
    states = cut(begin(queries, nodes, entries, beam, width))
    done = states.limit(0)
    finished = []
    while not states.filter(F.size("todo") > 0).isEmpty():
        asked = states.select("q", F.explode("todo").alias("a"))
        near = asked.join(links, "a").select("q", F.col("b").alias("node")).distinct()
        after = cut(advance(states, near.join(vectors, "node").select("q", "node", "vec"), beam, width))
        finished.append(after.filter(F.size("todo") == 0))
        states = after.filter(F.size("todo") > 0)
        release(nodes.sparkSession)
    finished.append(states)
    for part in finished:
        done = done.unionByName(part)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for q, ids in zip(b.column("q").to_pylist(), b.column("ids").to_pylist(), strict=True):
                node = np.frombuffer(ids, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), q)), pa.array(node)], ["q", "node"])

    return done.select("q", "ids").mapInArrow(trimmed(unpack), "q long, node long")


def nearest(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """The ``k`` nearest found of each row with ``is_query``: query_id, rank, vec_id, score."""
    rows = cut(usable(vectors))
    nodes, members = nodes_of(rows)
    links = cut(walks(build_graph(nodes), nodes))
    asked = members.filter(is_query)
    # one search for each distinct vector asked for; its own added component does not count
    vec = nodes.join(asked.select("node").distinct(), "node", "left_semi").select(F.col("node").alias("q"), "vec", F.size("x").alias("d"))
    queries = vec.select("q", F.expr("concat(substring(vec, 1, 4 * d), X'00000000')").alias("query"))
    found = cut(greedy_search(queries, nodes, links))
    x = nodes.select("node", "x")
    scored = found.join(x, "node").join(x.select(F.col("node").alias("q"), F.col("x").alias("_x")), "q")
    scored = scored.select("q", "node", dot("x", "_x").alias("score"))
    # of equal vectors the k + 1 smallest ids can be among the k nearest of a query
    some = Window.partitionBy("node").orderBy("vec_id")
    held = members.withColumn("_r", F.row_number().over(some)).filter(F.col("_r") <= k + 1).drop("_r")
    pairs = scored.join(held, "node").join(asked.select(F.col("node").alias("q"), F.col("vec_id").alias("query_id")), "q")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = pairs.filter("query_id <> vec_id").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
