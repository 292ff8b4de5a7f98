"""Prefix trie of conversations by whole-sequence collapse: equal conversations are one weighted sequence before any prefix is made.

A sequence or prefix is named by its number of turns and sums, over its turns, of hashes of place and content, so names of all
prefixes are running sums and names of whole sequences plain aggregates.  Each distinct sequence walks its path once; those
that are proper prefixes of others are found by an anti-join, the rest are leaves.  The node with the smallest member owns a
path from some depth on, so what a node saves is given to its owner and added along each path from the end.  Running sums go by
blocks of places with a small table of blocks, so a very long conversation is no single task's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

c = F.col
#: Places, or numbers of turns, of a block.
BLOCK = 4096
#: Bits of a conv_id within which ends are joined to one piece of text.
ENDS = 12


def _running(rows: DataFrame, key: str, place: str, sums: dict[str, Column], block: int) -> DataFrame:
    """Adds the running sums of ``sums`` along ``place`` (from 0, unique within a ``key``), the row's own value included."""
    cut = rows.select("*", F.floor(c(place) / block).cast("long").alias("__block"), *[v.alias(f"__{k}") for k, v in sums.items()])
    inside = Window.partitionBy(key, "__block").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.select("*", *[F.sum(f"__{k}").over(inside).alias(f"__in_{k}") for k in sums])
    upto = Window.partitionBy("__key").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(c(key).alias("__key"), c("__block").alias("__b")).agg(*[F.sum(f"__{k}").alias(f"__all_{k}") for k in sums])
    carry = totals.select("__key", "__b", *[F.sum(f"__all_{k}").over(upto).alias(f"__c_{k}") for k in sums]).filter("__b > 0")
    joined = local.join(carry, (c(key) == c("__key")) & (c("__block") == c("__b")), "left")
    return joined.select(*rows.columns, *[(c(f"__in_{k}") + F.coalesce(f"__c_{k}", F.lit(0))).alias(k) for k in sums])


def ordered(conversations: DataFrame, *, block: int = BLOCK, texts: bool = False) -> DataFrame:
    """(conv_id, place, digest, bytes) of every turn with a conv_id, place from 1 in the order of turn; with ``texts`` role and text.

    A null turn comes first; turns of one number come in the order of their digests.  A null role or text is empty.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    content = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.filter("conv_id is not null").select(
        c("conv_id").cast("long").alias("conv_id"), "turn", F.unhex(F.sha2(content, 256)).alias("digest"), F.octet_length(text).cast("long").alias("bytes"),
        *([role.alias("role"), text.alias("text")] if texts else []), F.floor(c("turn") / block).alias("__part"),
    )
    inside = Window.partitionBy("conv_id", "__part").orderBy(F.asc_nulls_first("turn"), "digest")
    local = turns.withColumn("__n", F.row_number().over(inside))
    upto = Window.partitionBy("__key").orderBy(F.asc_nulls_first("__p")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = turns.groupBy(c("conv_id").alias("__key"), c("__part").alias("__p")).agg(F.count(F.lit(1)).alias("__size"))
    carry = sizes.select("__key", "__p", F.sum("__size").over(upto).alias("__before")).filter("__before > 0")
    placed = local.join(carry, (c("conv_id") == c("__key")) & c("__part").eqNullSafe(c("__p")), "left")
    return placed.select("conv_id", (c("__n") + F.coalesce("__before", F.lit(0))).alias("place"), "digest", "bytes", *(["role", "text"] if texts else []))


#: Conversations that share an opening, and one more than the turns that an opening has at most.
FAMILY, HEADS = 5, 9


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations, and all conv_ids (some may have no turn left), of ``ordered`` turns.

    Conversation c begins with the first h turns of conversation c - c % FAMILY, h = crc32(c) % HEADS, and goes on with its own
    turns after its first h.
    """
    sizes = turns.groupBy("conv_id").agg(F.max("place").alias("__n"))
    h = F.crc32(c("conv_id").cast("string").cast("binary")) % HEADS
    convs = sizes.select("conv_id", (c("conv_id") - c("conv_id") % FAMILY).alias("__base"), h.alias("__h"))
    opening = sizes.select(c("conv_id").alias("__of"), c("__n").alias("__there"))
    convs = convs.join(opening, c("__base") == c("__of"), "left").select(
        "conv_id", "__base", "__h", F.least("__h", F.coalesce("__there", F.lit(0))).alias("__taken")
    )
    convs = shared.written(convs, "conversations")
    rest = [x for x in turns.columns if x not in ("conv_id", "place")]
    heads = turns.filter(c("place") < HEADS).withColumnRenamed("conv_id", "__from")
    taken = heads.join(convs, (c("__from") == c("__base")) & (c("place") <= c("__h"))).select("conv_id", "place", *rest)
    own = turns.join(convs, "conv_id").filter("place > __h").select("conv_id", (c("place") - c("__h") + c("__taken")).alias("place"), *rest)
    return taken.unionByName(own), convs.select("conv_id")


def _hashes(place: Column, digest: Column) -> dict[str, Column]:
    """Four numbers of 32 bits for a turn at its place; sums over 2**31 turns fit a long."""
    pair = [F.xxhash64(F.lit(k), place.cast("long"), digest) for k in (1, 2)]
    return {f"s{2 * k + j}": F.shiftrightunsigned(x, 32) if j else x.bitwiseAND((1 << 32) - 1) for k, x in enumerate(pair) for j in range(2)}


SUMS = ("s0", "s1", "s2", "s3")


def _name(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", depth.cast("string"), *[s.cast("string") for s in sums]).cast("binary")))


def _ends(whole: DataFrame) -> DataFrame:
    """(node, ends_sha256) of ``whole`` (conv_id, node): the hash of all its conv_ids, rising, joined by commas.

    Ids are joined in pieces of neighbouring ids, in parallel; a node's pieces then stream through one hash in order.
    """
    pieces = whole.groupBy("node", F.shiftright("conv_id", ENDS).alias("piece")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    pieces = pieces.select("node", "piece", F.array_join(c("ids").cast("array<string>"), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for batch in batches:
            nodes, found = [], []
            for node, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if node == now:
                    sha.update(b",")
                else:
                    if now is not None:
                        nodes.append(now), found.append(sha.hexdigest())
                    now, sha = node, hashlib.sha256()
                sha.update(ids.encode())
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(found)], names=["node", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([sha.hexdigest()])], names=["node", "ends_sha256"])

    return pieces.repartition("node").sortWithinPartitions("node", "piece").mapInArrow(run, "node binary, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """A row for each distinct prefix of the conversations, the empty one included.

    ``turns`` (conv_id, place from 1 without gaps, digest of the content, bytes); ``convs`` names all conversations, those
    without a turn too.  Columns: conv_id (smallest member), depth, parent_conv_id (root: null), n_convs, n_children, n_leaves,
    saved_tokens (over the subtree, bytes of a node's last turn times its members but one) and ends_sha256.  No conversation,
    no row.
    """
    rows = turns.select("conv_id", "place", "digest", "bytes")
    hashed = rows.select("conv_id", *[v.alias(k) for k, v in _hashes(c("place"), c("digest")).items()])
    sums = hashed.groupBy(c("conv_id").alias("__of")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(k).alias(k) for k in SUMS])
    filled = [F.coalesce(k, F.lit(0)) for k in ("n", *SUMS)]
    whole = convs.join(sums, c("conv_id") == c("__of"), "left").select("conv_id", filled[0].alias("n"), _name(filled[0], filled[1:]).alias("node"))
    whole = shared.written(whole, "trie-whole")
    sequences = shared.written(whole.groupBy("node").agg(F.min("conv_id").alias("first"), F.count(F.lit(1)).alias("weight"), F.max("n").alias("n")), "trie-sequences")

    walk = rows.join(sequences.select("first", "weight", "n"), c("conv_id") == c("first")).select(
        "first", "weight", "n", c("place").alias("depth"), "bytes", *[v.alias(f"own_{k}") for k, v in _hashes(c("place"), c("digest")).items()]
    )
    walk = _running(walk, "first", "depth", {k: c(f"own_{k}") for k in SUMS}, block)
    before = [c(k) - c(f"own_{k}") for k in SUMS]
    path = walk.select(
        "first", "weight", "n", "depth", "bytes", _name(c("depth"), [c(k) for k in SUMS]).alias("node"), _name(c("depth") - 1, before).alias("parent")
    )
    top = sequences.select("first", "weight", "n", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("bytes"), _name(F.lit(0), [F.lit(0)] * 4).alias("node"), F.lit(None).cast("binary").alias("parent"))
    path = shared.written(path.unionByName(top), "trie-path")
    proper = path.filter("depth < n").select("node").distinct()
    leaves = sequences.join(proper, "node", "left_anti").select("first", F.lit(1).alias("leaf"))

    nodes = path.join(leaves, "first", "left").groupBy("node").agg(
        F.min("first").alias("conv_id"), F.sum("weight").alias("n_convs"), F.count("leaf").alias("n_leaves"),
        F.max("depth").cast("long").alias("depth"), F.max("parent").alias("parent"), F.max("bytes").alias("bytes"),
    )
    nodes = shared.written(nodes, "trie-nodes")

    # A node's conv_id and depth name one row of all paths, so this joins one to one, however many paths meet in a node.
    owned = nodes.select(c("conv_id").alias("first"), "depth", ((c("n_convs") - 1) * c("bytes")).alias("own"))
    along = path.join(owned, ["first", "depth"], "left").select("first", "node", (c("n") - c("depth")).alias("left"), F.coalesce("own", F.lit(0)).alias("own"))
    saved = _running(along, "first", "left", {"below": c("own")}, block).groupBy("node").agg(F.sum("below").alias("saved_tokens"))

    children = nodes.filter("parent is not null").groupBy(c("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select(c("node").alias("parent"), c("conv_id").alias("parent_conv_id"))
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    joined = nodes.join(saved, "node").join(children, "node", "left").join(_ends(whole), "node", "left").join(parents, "parent", "left")
    return joined.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", empty).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame, *, block: int = BLOCK, texts: bool = False) -> DataFrame:
    """``trie`` of the rebuilt conversations; with ``texts`` each node also has the role and text of its last turn (root: null).

    Rows without a conv_id belong to no conversation.  Null turns come first, ties and repeated rows count each, in the order
    of their contents' digests; null roles and texts are empty; texts may be of any length.  An empty table gives no row.
    Other columns of ``conversations`` may have any name.
    """
    turns = shared.written(ordered(conversations, block=block, texts=texts), "turns")
    again, convs = rebuilt(turns)
    found = trie(again, convs, block=block)
    if texts:
        last = again.select("conv_id", c("place").alias("depth"), "role", "text")
        found = found.join(last, ["conv_id", "depth"], "left")
    return found
