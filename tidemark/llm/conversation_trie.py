"""The prefix tree of conversations: who owns which depth by binary search, chains of owned turns, totals bottom-up."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import materialise, ship_by_value

WORD = r"[^\\x20\\x09-\\x0D]+"
#: Ids that are joined into one text before the texts of a node meet.
JOINED = 4096


def ranged(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """df written in ranges of (key, order), with _range: a key of any size lies in as many ranges as its rows need."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, key, *order).withColumn("_range", F.spark_partition_id())
    return materialise(dealt, "trie-ranged")


def running(df: DataFrame, key: str, order: list[str], sums: dict[str, tuple]) -> DataFrame:
    """Add, for each name of sums -> (aggregate, value), the aggregate over the rows of the key before this one.

    df comes from ranged(). Within a range it is a window; what a key has in the ranges before is added from a table of
    the keys that go on over a range's edge, which has at most two rows a range.
    """
    first = df.groupBy("_range").agg(F.min(key).alias(key)).select(key).distinct()
    parts = df.join(F.broadcast(first), key).groupBy(key, "_range").agg(*[f(v).alias(f"_c_{n}") for n, (f, v) in sums.items()])
    ahead = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(key, "_range", *[f(f"_c_{n}").over(ahead).alias(f"_b_{n}") for n, (f, _) in sums.items()])
    within = Window.partitionBy("_range", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumns({n: F.coalesce(f(v).over(within), F.lit(0)) for n, (f, v) in sums.items()}).join(F.broadcast(carried), [key, "_range"], "left")
    add = {n: F.col(n).bitwiseXOR(F.coalesce(f"_b_{n}", F.lit(0))) if f is F.bit_xor else F.col(n) + F.coalesce(f"_b_{n}", F.lit(0)) for n, (f, _) in sums.items()}
    return out.withColumns(add).drop(*[f"_b_{n}" for n in sums])


def digested(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, words) of the turns that have a conversation: a null role or text becomes empty, digest
    is md5 of role and text kept apart by the role's length, words counts runs other than blanks and U+0009 to U+000D."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), role.alias("r"), text.alias("t"))
    return rows.select("conv_id", "turn", F.md5(F.concat(F.length("r").cast("string"), F.lit(":"), "r", "t")).alias("digest"), F.expr(f"cast(regexp_count(t, '{WORD}') as long)").alias("words"))


def placed(turns: DataFrame) -> DataFrame:
    """Add place: 0, 1, ... by turn (null first; rows of one turn by digest) within the conversation."""
    marked = turns.withColumns({"known": F.col("turn").isNotNull(), "at": F.coalesce("turn", F.lit(0))})
    order = ["known", "at", "digest"]
    return running(ranged(marked, "conv_id", order), "conv_id", order, {"place": (F.sum, F.lit(1))}).select("conv_id", "place", "digest", "words")


def spliced(turns: DataFrame, block: int = 20, variants: int = 4) -> DataFrame:
    """Conversations rebuilt: the first h turns of conversation c - c % block, then c's own from its h-th on, where h is
    crc32(c) % variants. turns: placed(); the result has the same columns. At most block * variants rows come of one."""
    h = F.crc32(F.col("conv_id").cast("string")) % variants
    own = turns.where(F.col("place") >= h).select("conv_id", F.lit(1).alias("part"), "place", "digest", "words")
    heads = turns.where(F.col("place") < variants - 1).where(F.col("conv_id") % block == 0).withColumnRenamed("conv_id", "head")
    ids = turns.select("conv_id").distinct().withColumns({"head": F.col("conv_id") - F.col("conv_id") % block, "h": h})
    begun = ids.where("h > 0").join(heads, "head").where("place < h").select("conv_id", F.lit(0).alias("part"), "place", "digest", "words")
    both, order = begun.unionByName(own), ["part", "place"]
    again = running(ranged(both, "conv_id", order), "conv_id", order, {"no": (F.sum, F.lit(1))})
    return again.select("conv_id", F.col("no").alias("place"), "digest", "words")


def _prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, words): a prefix's digest is the XOR of 128 hash bits of each turn with its depth, so
    digests of long conversations are summed in ranges as well. Unlike prefixes of one depth share it once in 2^128."""
    depth = F.col("place") + 1
    rows = turns.select("conv_id", depth.cast("long").alias("depth"), "words", F.xxhash64(F.lit(1), depth, "digest").alias("h1"), F.xxhash64(F.lit(2), "digest", depth).alias("h2"))
    rows = running(ranged(rows, "conv_id", ["depth"]), "conv_id", ["depth"], {"p1": (F.bit_xor, F.col("h1")), "p2": (F.bit_xor, F.col("h2"))})
    return materialise(rows.select("conv_id", "depth", F.col("p1").bitwiseXOR(F.col("h1")).alias("k1"), F.col("p2").bitwiseXOR(F.col("h2")).alias("k2"), "words"), "trie-prefixes")


def _chains(ids: DataFrame, prefixes: DataFrame, minima: DataFrame, top: int) -> DataFrame:
    """(conv_id, length, first, up): the least depth whose node the conversation owns (length + 1: none), and the owner
    of the node before it. Owners never get smaller on the way down, so depths are halved: each round joins the middle
    depths of all open conversations to the prefixes' least ids."""
    lengths = prefixes.groupBy("conv_id").agg(F.max("depth").alias("length"))
    state = ids.join(lengths, "conv_id", "left").select("conv_id", F.coalesce("length", F.lit(0)).alias("length"))
    state = materialise(state.select("conv_id", "length", F.lit(1).cast("long").alias("lo"), (F.col("length") + 1).alias("hi")), "trie-search")

    def owner(asked: DataFrame) -> DataFrame:
        """asked: (conv_id, depth) -> with owner, by the digest of the prefix."""
        return asked.join(prefixes.drop("words"), ["conv_id", "depth"]).join(minima.select("depth", "k1", "k2", "owner"), ["depth", "k1", "k2"]).select("conv_id", "owner")

    while not state.where("lo < hi").isEmpty():
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("long")
        found = owner(state.where("lo < hi").select("conv_id", middle.alias("depth")))
        owns = F.col("owner") == F.col("conv_id")
        # no answer: the conversation is done, and the middle is its first depth
        moved = state.withColumn("middle", middle).join(found, "conv_id", "left")
        moved = moved.select("conv_id", "length", F.when(~owns, F.col("middle") + 1).otherwise(F.col("lo")).alias("lo"), F.when(owns, F.col("middle")).otherwise(F.col("hi")).alias("hi"))
        state = materialise(moved.select("conv_id", "length", F.coalesce("lo", F.lit(1)).alias("lo"), "hi"), "trie-search")
    found = owner(state.where("lo > 1").select("conv_id", (F.col("lo") - 1).alias("depth")))
    first = F.when(F.col("conv_id") == top, 0).otherwise(F.col("lo"))  # the least id owns the root as well
    up = F.when(F.col("conv_id") != top, F.coalesce("owner", F.lit(top)))
    return materialise(state.join(found, "conv_id", "left").select("conv_id", "length", first.alias("first"), up.alias("up")), "trie-chains")


def _totals(chains: DataFrame) -> DataFrame:
    """(conv_id, up, leaves, saved) of each chain alone -> (conv_id, leaves, saved) with all chains below it.

    Bottom-up in rounds that double: a round adds what the chains exactly as many steps below have summed so far, so the
    rounds are the logarithm of the longest line of chains."""
    state = materialise(chains.select("conv_id", F.col("up").alias("above"), "leaves", "saved"), "trie-totals")
    while not state.where("above is not null").isEmpty():
        sums = state.where("above is not null").groupBy(F.col("above").alias("conv_id")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        jump = state.select(F.col("conv_id").alias("above"), F.col("above").alias("next"))
        state = state.join(sums, "conv_id", "left").join(jump, "above", "left")
        state = materialise(state.select("conv_id", F.col("next").alias("above"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved")), "trie-totals")
    return state.drop("above")


def _joined(batches):
    """Rows (owner, depth, conv_id) in order -> (owner, depth, least, ids): ids joined by commas, JOINED at most."""
    node, ids, out = None, [], []

    def close():
        if ids:
            out.append((*node, ids[0], ",".join(map(str, ids))))
            ids.clear()

    def batch():
        made = pa.RecordBatch.from_pylist([dict(zip(("owner", "depth", "least", "ids"), r)) for r in out], schema=pa.schema([("owner", pa.int64()), ("depth", pa.int64()), ("least", pa.int64()), ("ids", pa.string())]))
        out.clear()
        return made

    for b in batches:
        for owner, depth, conv_id in zip(*(c.to_pylist() for c in b.columns)):
            if (owner, depth) != node or len(ids) >= JOINED:
                close()
                node = (owner, depth)
            ids.append(conv_id)
        yield batch()
    close()
    yield batch()


def _hashed(batches):
    """Rows (owner, depth, least, ids) in order -> (owner, depth, ends_sha256). Only the hash of the node at hand is held."""
    node, sha, out = None, None, []

    def batch():
        made = pa.RecordBatch.from_pylist([dict(zip(("owner", "depth", "ends_sha256"), r)) for r in out], schema=pa.schema([("owner", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())]))
        out.clear()
        return made

    for b in batches:
        for owner, depth, ids in zip(*(b.column(i).to_pylist() for i in (0, 1, 3))):
            if (owner, depth) != node:
                if node:
                    out.append((*node, sha.hexdigest()))
                node, sha = (owner, depth), hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        yield batch()
    if node:
        out.append((*node, sha.hexdigest()))
        yield batch()


def _ends(chains: DataFrame) -> DataFrame:
    """(owner, depth, ends_sha256): the ids of the conversations that end at a node, ascending. A hash takes its bytes in
    order, so a node's ids pass one task, as joined texts of JOINED ids and never held together."""
    parts = int(chains.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = chains.select(F.when(F.col("first") <= F.col("length"), F.col("conv_id")).otherwise(F.col("up")).alias("owner"), F.col("length").alias("depth"), "conv_id")
    joined = ends.repartitionByRange(parts, "owner", "depth", "conv_id").sortWithinPartitions("owner", "depth", "conv_id").mapInArrow(_joined, "owner long, depth long, least long, ids string")
    return joined.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "least").mapInArrow(_hashed, "owner long, depth long, ends_sha256 string")


def prefix_tree(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row for each distinct sequence of first turns, from the empty one at depth 0.

    turns: (conv_id, place from 0 without gaps, digest, words). ids: (conv_id) of all conversations, those without turns
    included. Returns conv_id (the least member, which owns the node), depth, parent_conv_id (null at the root), n_convs,
    n_children, n_leaves, saved_tokens (over the subtree, each node's words times its members but one), ends_sha256 (of
    the ids that end there). Nodes that one conversation owns form a chain from its first owned depth to its end; chains hang on nodes of
    chains. No conversation at all gives no row.
    """
    ids = materialise((turns if ids is None else ids).select("conv_id").distinct(), "trie-ids")
    top, every = ids.agg(F.min("conv_id"), F.count("*")).first()
    if not every:
        top = 0
    prefixes = _prefixes(turns)
    minima = prefixes.groupBy("depth", "k1", "k2").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.min("words").alias("words"))
    minima = materialise(minima, "trie-minima")
    chains = _chains(ids, prefixes, minima, top)
    alive = chains.where("first <= length or up is null")
    root = ids.agg(F.min("conv_id").alias("owner")).where("owner is not null").select("owner", F.lit(0).cast("long").alias("depth"), F.lit(every).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("words"))
    hung = alive.where("up is not null").groupBy(F.col("up").alias("owner"), (F.col("first") - 1).alias("depth")).agg(F.count("*").alias("hung"))
    nodes = minima.select("owner", "depth", "n_convs", "words").unionByName(root)
    shape = alive.select(F.col("conv_id").alias("owner"), "length", "first", "up")
    nodes = nodes.join(shape, "owner").join(hung, ["owner", "depth"], "left")
    children = (F.col("depth") < F.col("length")).cast("long") + F.coalesce("hung", F.lit(0))
    nodes = nodes.select("owner", "depth", "n_convs", children.alias("n_children"), F.when(F.col("depth") > F.col("first"), F.col("owner")).otherwise(F.col("up")).alias("parent"), F.col("up"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), (children == 0).cast("long").alias("leaf"), (F.col("depth") == F.col("first")).alias("begins"))
    nodes = ranged(nodes, "owner", ["depth"])
    alone = nodes.groupBy(F.col("owner").alias("conv_id")).agg(F.max(F.when(F.col("begins"), F.col("up"))).alias("up"), F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved"))
    totals = _totals(alone)
    # a node's subtree is its chain's total less what the chain and the chains hung on it hold above the node
    below = totals.join(alive.where("up is not null").select("conv_id", "up", (F.col("first") - 1).alias("depth")), "conv_id")
    below = below.groupBy(F.col("up").alias("owner"), "depth").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    held = nodes.join(below, ["owner", "depth"], "left").withColumns({"l": F.col("leaf") + F.coalesce("l", F.lit(0)), "s": F.col("saved") + F.coalesce("s", F.lit(0))})
    summed = running(held, "owner", ["depth"], {"l0": (F.sum, F.col("l")), "s0": (F.sum, F.col("s"))})
    out = summed.drop("saved").join(totals.select(F.col("conv_id").alias("owner"), "leaves", "saved"), "owner").join(_ends(chains), ["owner", "depth"], "left")
    return out.select(
        F.col("owner").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children",
        (F.col("leaves") - F.col("l0")).alias("n_leaves"), (F.col("saved") - F.col("s0")).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def conversation_tree(conversations: DataFrame, splice: int = 0, variants: int = 4) -> DataFrame:
    """The prefix tree of (conv_id, turn, role, text), of spliced() conversations if splice is set.

    Turns are ordered by turn, null first, rows of the same turn by a digest of role and text; repeated rows are turns
    of their own. Null roles and texts are empty. Rows without conv_id belong to no conversation and are left out. Other columns are not read.
    """
    turns = materialise(placed(digested(conversations)), "trie-turns")
    ids = turns.select("conv_id")
    return prefix_tree(spliced(turns, splice, variants) if splice else turns, ids)


ship_by_value(__name__)
