"""Prefix trie of conversations by the recursion of van Emde Boas: halves of the depth, then grafting.

A node is a distinct sequence of first turns; its name is 128 bits that follow from the turns alone, so equal
prefixes get equal names wherever they are met, and no prefix is compared as text.

1. Turns become (hash, words); a turn's place in its conversation comes from places inside blocks of 1 024 turn
   numbers plus sums over the blocks before. Heads of other conversations are put in front.
2. Names. A sequence is cut at half its depth, both halves are cut again, down to blocks of ``HEIGHT`` turns, which one row
   holds. Contents of blocks are named upward, pair by pair; the names of prefixes at the cuts go downward: the upper
   half passes the name of its top to the lower, joined with its content. All blocks of a round go in parallel.
3. Nodes are the rows of equal name, partially aggregated: smallest member, members, words. The table of nodes has
   upper tries and lower forests of every size in it, side by side, as the blocks of depth.
4. Totals. A node first gets the sums over its subtree inside its block of ``HEIGHT``. Then blocks of 2, 4, 8, ...
   times that height are made of two: the totals at the cut, the tops of the lower forests, are summed per parent and grafted on all
   ancestors in the upper trie. So a trie of depth D takes log2(D / HEIGHT) rounds, whatever its shape.
5. The ids that end at a node are joined to texts per 8 192 ids in parallel; a task then hashes these texts in
   order, one at a time.

A node never gathers its members or children: sums and minima are partially aggregated, the parent's number is
joined over shares. The sha256 of a node's ids is by its nature made in one go; the task that makes it holds one text of 8 192 ids.

Nulls and edge cases: rows with a null conv_id take no part; a null turn comes first; null role or text is empty;
rows of equal conv_id and turn stand in the order of the hash of role and text, and each counts; texts of any length are read whole; a conversation whose
turns all fall away stays a member of the root; an empty table has no nodes. Only conv_id, turn, role and text are
read, so further columns of any name do no harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sleepsignal.session import cut

HEIGHT = 16  # turns of a block that one row holds
GROUP = 20
HEADS = 4
SHARES = 8
IDS = 13  # ids of 2^13 neighbours are joined to one text
WORD = "[^\\x20\\x09-\\x0D]+"
ROOT = (0, 0)


def named(*parts: Column) -> Column:
    return F.struct(F.xxhash64(F.lit(1), *parts).alias("a"), F.xxhash64(F.lit(2), *parts).alias("b"))


def after(name: Column, what: Column) -> Column:
    """The name of a prefix lengthened by a turn or a block."""
    return named(name["a"], name["b"], what["a"], what["b"])


def root() -> Column:
    return F.struct(F.lit(ROOT[0]).cast("long").alias("a"), F.lit(ROOT[1]).cast("long").alias("b"))


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, has_turn, turn, key, words, chunk): texts are read once and only hashed and counted."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turn = F.col("turn").cast("long")
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), turn.isNotNull().alias("has_turn"), F.coalesce(turn, F.lit(-(1 << 63))).alias("turn"),
        named(F.octet_length(role), role, text).alias("key"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    return rows.withColumn("chunk", F.shiftright("turn", 10))


ORDER = ["has_turn", "turn", "key"]


def rebuilt(conversations: DataFrame, group: int = GROUP, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns (conv_id, depth from 1, key, words, m), and conversations (conv_id, m turns).

    The first h turns are those of conversation c - c % group, with h = crc32(c) % heads; c's own follow after its first h.
    """
    turns = cut(turns_of(conversations))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("long")
    base = F.col("conv_id") - F.col("conv_id") % group
    first = F.row_number().over(Window.partitionBy("conv_id").orderBy(*ORDER))  # limited before the shuffle
    top = turns.filter(F.col("conv_id") % group == 0).withColumn("_k", first).filter(F.col("_k") < heads)
    top = top.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("_k", "key", "words"))).alias("_head")).withColumnRenamed("conv_id", "_base")
    chunks = cut(turns.groupBy("conv_id", "chunk").agg(F.count(F.lit(1)).alias("_n")))
    convs = chunks.groupBy("conv_id").agg(F.sum("_n").alias("_own")).withColumn("_h", h).withColumn("_base", base)
    # at most ``group`` conversations share a base
    convs = convs.join(top, "_base", "left").withColumn("_head", F.slice(F.coalesce("_head", F.array()), F.lit(1), F.col("_h").cast("int")))
    convs = cut(convs.select("conv_id", "_h", "_head", F.size("_head").cast("long").alias("_k"), (F.size("_head") + F.greatest(F.lit(0), F.col("_own") - F.col("_h"))).cast("long").alias("m")))
    by_chunk = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    spots = chunks.withColumn("_before", F.coalesce(F.sum("_n").over(by_chunk), F.lit(0))).join(convs.select("conv_id", "_h", "_k", "m"), "conv_id")
    place = F.row_number().over(Window.partitionBy("conv_id", "chunk").orderBy(*ORDER))
    own = turns.withColumn("_at", place).join(spots, ["conv_id", "chunk"])
    own = own.withColumn("_at", F.col("_at") + F.col("_before")).filter("_at > _h")
    own = own.select("conv_id", (F.col("_at") - F.col("_h") + F.col("_k")).alias("depth"), "key", "words", "m")
    front = convs.select("conv_id", "m", F.explode("_head").alias("_t")).select("conv_id", F.col("_t._k").cast("long").alias("depth"), "_t.key", "_t.words", "m")
    return own.unionByName(front), convs.select("conv_id", "m")


# -- names -----------------------------------------------------------------------------------------


def cut_names(blocks: DataFrame, height: int) -> DataFrame:
    """(conv_id, block, top): the name of the prefix above ``block``, wherever the block before it is full.

    Upward: contents of 1, 2, 4, ... blocks; downward: at each cut the prefix above the upper half, joined with the upper half's content.
    """
    content = F.aggregate("turns", root(), lambda acc, t: after(acc, t["key"]))
    level = cut(blocks.filter(F.size("turns") == height).select("conv_id", "block", content.alias("content")))
    tops = level.filter("block = 0").select("conv_id", "block", root().alias("top"))
    full = level.agg(F.max("block") + 1).first()[0] or 0
    contents = []
    for _ in range(int(full).bit_length()):
        contents.append(level)
        two = F.sort_array(F.collect_list(F.struct("block", "content")))
        pairs = level.groupBy("conv_id", F.shiftright("block", 1).alias("_up")).agg(two.alias("_two")).filter(F.size("_two") == 2)
        level = cut(pairs.select("conv_id", F.col("_up").alias("block"), after(F.col("_two")[0]["content"], F.col("_two")[1]["content"]).alias("content")))
    for j in reversed(range(len(contents))):
        upper = contents[j].withColumn("block", F.shiftleft("block", j))
        lower = tops.join(upper, ["conv_id", "block"]).filter(F.shiftright("block", j) % 2 == 0)
        tops = cut(tops.unionByName(lower.select("conv_id", (F.col("block") + (1 << j)).alias("block"), after(F.col("top"), F.col("content")).alias("top"))))
    return tops.filter("block > 0")


def paths_of(turns: DataFrame, height: int) -> DataFrame:
    """Blocks of each conversation: (conv_id, block, m, names, words); ``names`` starts with the prefix above the block.

    Inside a block each turn lengthens the name before it; the last name of a full block is that of the cut behind it.
    """
    blocks = turns.groupBy("conv_id", F.floor((F.col("depth") - 1) / height).alias("block"))
    blocks = cut(blocks.agg(F.sort_array(F.collect_list(F.struct("depth", "key", "words"))).alias("turns"), F.max("m").alias("m")))
    tops = cut_names(blocks, height)
    none = F.lit(None).cast("struct<a: bigint, b: bigint>")
    ends = tops.withColumn("end", none).unionByName(tops.select("conv_id", (F.col("block") - 1).alias("block"), none.alias("top"), F.col("top").alias("end")))
    ends = ends.groupBy("conv_id", "block").agg(F.max("top").alias("top"), F.max("end").alias("end"))
    blocks = blocks.join(ends, ["conv_id", "block"], "left")
    start = F.array(F.coalesce("top", root()))
    names = F.aggregate("turns", start, lambda acc, t: F.concat(acc, F.array(after(F.element_at(acc, -1), t["key"]))))
    names = F.when(F.size("turns") < height, names).otherwise(F.concat(F.slice(names, 1, height), F.array("end")))
    return cut(blocks.select("conv_id", "block", "m", names.alias("names"), F.transform("turns", lambda t: t["words"]).alias("words")))


# -- nodes and totals ------------------------------------------------------------------------------


def nodes_of(paths: DataFrame, convs: DataFrame, height: int) -> DataFrame:
    """(a, b, pa, pb, depth, conv_id, n_convs, words, n_children, parent_conv_id) per node."""
    each = F.explode(F.transform("words", lambda w, i: F.struct(
        F.element_at("names", (i + 2).cast("int")).alias("name"), F.element_at("names", (i + 1).cast("int")).alias("up"), w.alias("words"), (F.col("block") * height + i + 1).alias("depth"))))
    rows = paths.select("conv_id", each.alias("_n"))
    rows = rows.select("conv_id", F.col("_n.name.a").alias("a"), F.col("_n.name.b").alias("b"), F.col("_n.up.a").alias("pa"), F.col("_n.up.b").alias("pb"), "_n.words", "_n.depth")
    top = convs.select("conv_id", F.lit(ROOT[0]).cast("long").alias("a"), F.lit(ROOT[1]).cast("long").alias("b"), *[F.lit(None).cast("long").alias(c) for c in ("pa", "pb")],
                       F.lit(0).cast("long").alias("words"), F.lit(0).cast("long").alias("depth"))
    rows = rows.unionByName(top)
    nodes = cut(rows.groupBy("a", "b").agg(F.min("conv_id").alias("conv_id"), F.max("pa").alias("pa"), F.max("pb").alias("pb"), F.max("words").alias("words"),
                                           F.max("depth").alias("depth"), F.count(F.lit(1)).alias("n_convs")))
    under = nodes.filter("depth > 0").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = cut(nodes.join(under, ["a", "b"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")))
    # a parent may have a third of all nodes as children: they look it up in one of its shares
    inner = nodes.filter("n_children > 0").select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"), F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("_s"))
    share = F.pmod(F.col("a"), F.lit(SHARES)).cast("int")
    return cut(nodes.withColumn("_s", share).join(inner, ["pa", "pb", "_s"], "left").drop("_s"))


def in_blocks(nodes: DataFrame, paths: DataFrame, height: int) -> DataFrame:
    """(a, b, saved, leaves): sums over each node's subtree inside its block.

    A conversation's own nodes, those it is the smallest member of, are the lower end of its path; inside a
    block their sums go to every name above or at them.
    """
    saved = (F.col("n_convs") - 1) * F.col("words")
    leaf = (F.col("n_children") == 0).cast("long")
    own = nodes.filter("depth > 0").groupBy("conv_id", F.floor((F.col("depth") - 1) / height).alias("block"))
    own = own.agg(F.collect_list(F.struct(((F.col("depth") - 1) % height).alias("at"), saved.alias("saved"), leaf.alias("leaf"))).alias("own"))
    both = own.join(paths.select("conv_id", "block", "names"), ["conv_id", "block"])
    none = F.lit(0).cast("long")

    def below(i: Column, what: str) -> Column:
        return F.aggregate("own", none, lambda acc, x: acc + F.when(x["at"] >= i, x[what]).otherwise(0))

    low = F.array_max(F.transform("own", lambda x: x["at"]))
    each = F.transform(F.sequence(F.lit(0).cast("long"), low), lambda i: F.struct(F.element_at("names", (i + 2).cast("int")).alias("name"), below(i, "saved").alias("saved"), below(i, "leaf").alias("leaves")))
    return both.select(F.explode(each).alias("_e")).groupBy(F.col("_e.name.a").alias("a"), F.col("_e.name.b").alias("b")).agg(F.sum("_e.saved").alias("saved"), F.sum("_e.leaves").alias("leaves"))


def grafted(nodes: DataFrame, paths: DataFrame, height: int) -> DataFrame:
    """(a, b, saved, leaves): sums over each node's whole subtree, the root left out."""
    sums = cut(in_blocks(nodes, paths, height))
    blocks = int(nodes.agg(F.max("depth")).first()[0] or 0)
    blocks = max(0, blocks - 1) // height
    for j in range(blocks.bit_length()):
        block = F.floor((F.col("depth") - 1) / height)
        at_cut = nodes.filter(f"depth > {height} AND (depth - 1) % {height} = 0").withColumn("block", block).filter((F.shiftright("block", j) % 2 == 1) & (F.col("block") % (1 << j) == 0))
        tops = at_cut.select("a", "b", "parent_conv_id", "block").join(sums, ["a", "b"]).groupBy(F.col("parent_conv_id").alias("conv_id"), "block").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
        upper = tops.withColumn("block", F.explode(F.sequence(F.col("block") - (1 << j), F.col("block") - 1)))
        above = upper.join(paths.select("conv_id", "block", F.slice("names", 2, height).alias("names")), ["conv_id", "block"])
        above = above.select(F.explode("names").alias("_n"), "saved", "leaves").select(F.col("_n.a").alias("a"), F.col("_n.b").alias("b"), "saved", "leaves")
        sums = cut(sums.unionByName(above).groupBy("a", "b").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves")))
    return sums


# -- ends ------------------------------------------------------------------------------------------


def ends_hashes(paths: DataFrame, convs: DataFrame, height: int) -> DataFrame:
    """(a, b, ends_sha256) of the nodes where conversations end: sha256 of their ids, ascending, comma-joined."""
    last = paths.filter(F.col("block") * height + F.size("words") == F.col("m")).select("conv_id", F.element_at("names", -1).alias("n"))
    last = last.unionByName(convs.filter("m = 0").select("conv_id", root().alias("n")))
    part = F.shiftright("conv_id", IDS).alias("part")
    texts = last.groupBy(F.col("n.a").alias("a"), F.col("n.b").alias("b"), part).agg(
        F.concat_ws(",", F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string"))).alias("ids"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            out = []
            for a, b, ids in zip(*[batch.column(c).to_pylist() for c in ("a", "b", "ids")], strict=True):
                if at != (a, b):
                    if at is not None:
                        out.append((*at, state.hexdigest()))
                    at, state = (a, b), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["a", "b", "ends_sha256"])
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*at, state.hexdigest())], ["a", "b", "ends_sha256"])

    dealt = texts.repartition("a", "b").sortWithinPartitions("a", "b", "part")
    return dealt.select("a", "b", "ids").mapInArrow(make, "a long, b long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, group: int = GROUP, heads: int = HEADS, height: int = HEIGHT) -> DataFrame:
    """One row per node of the trie of rebuilt conversations."""
    turns, convs = rebuilt(conversations, group, heads)
    paths = paths_of(turns, height)
    nodes = nodes_of(paths, convs, height)
    sums = grafted(nodes, paths, height)
    under_root = nodes.filter("depth = 1").join(sums, ["a", "b"]).agg(F.coalesce(F.sum("saved"), F.lit(0)).alias("saved"), F.coalesce(F.sum("leaves"), F.lit(1)).alias("leaves"))
    under_root = under_root.select(*[F.lit(r).cast("long").alias(c) for c, r in zip("ab", ROOT, strict=True)], "saved", "leaves")
    out = nodes.join(sums.unionByName(under_root), ["a", "b"]).join(ends_hashes(paths, convs, height), ["a", "b"], "left")
    nobody = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
                      F.coalesce("ends_sha256", F.lit(nobody)).alias("ends_sha256"))
