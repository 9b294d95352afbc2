"""The trie of the prefixes that conversations share, found block by block.

A turn's digest is a 128-bit hash of its place, role and text; a prefix's digest is
the XOR of its turns' digests. XOR is associative, so a long conversation's prefixes come
from block sums, no task goes through it turn by turn, and prefixes of equal depth
differ in their digest as their turns do (a false match has a chance of 2**-128).

Conversations are grouped by blocks of ``BLOCK`` turns first: those with the same prefix
before a block and the same digest of it (or of what their end leaves of it) are one
block group, known by its smallest member. Where a block follows its prefix alone, its
turns are nodes as they are, with the group's members. Only where several groups follow
the same prefix are their turn boundaries refined: prefixes within the block are grouped
again, over one conversation for each group.

Subtree figures need no walk down the tree. The nodes whose smallest member is ``c`` are
one path that ends where ``c`` ends, so each node has one owner, and over a node's
members a sum of what they own is a sum over its subtree. The same two groupings, by
block and by turn, add these up.

Defined results: null roles and texts are empty; turns go by number, null first, ties by
role and text, and repeated rows are turns of their own. Rows of a null conversation id
belong to none and make none. A conversation without turns is a member of the root alone.
No conversations, no nodes. Only the four named columns are read. Turns are numbered
over a distributed sort and digests in two levels of sums, so that one conversation may
hold any share of the rows. Member lists are packed by range before they meet, and their
hash is taken as they stream by.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.llm.common import SPACES, parts, staged

#: Turns of a block; blocks of a larger one, over which digests are summed first.
BLOCK, BLOCKS = 4, 1024
#: Ids in one packed row.
PACKED = 4096
#: Conversations take up to ``GRAFT - 1`` first turns of the one whose id is the next lower multiple of ``FAMILY``.
FAMILY, GRAFT = 20, 4

KEY = ["depth", "p1", "p2"]


def numbered(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(c, i, role, text)``: the turns numbered from 1 in each conversation, over one distributed sort; staged."""
    empty = F.lit("")
    rows = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("c"), F.col(turn_col).alias("t"), F.coalesce(F.col(role_col), empty).alias("role"),
        F.coalesce(F.col(text_col), empty).alias("text"), F.monotonically_increasing_id().alias("row"))
    order = ["c", F.col("t").asc_nulls_first(), "role", "text", "row"]
    spread = rows.repartitionByRange(parts(conversations.sparkSession), *order).sortWithinPartitions(*order)
    placed = staged(spread.select("c", "role", "text", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "turns-sorted")
    runs = placed.groupBy("c", "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = W.partitionBy("c").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select(F.col("c").alias("rc"), F.col("part").alias("rp"), (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("shift"))
    return staged(placed.join(runs, (F.col("c") == F.col("rc")) & (F.col("part") == F.col("rp"))).select("c", (F.col("at") + F.col("shift")).alias("i"), "role", "text"), "turns-numbered")


def graft(turns: DataFrame, family: int = FAMILY, most: int = GRAFT) -> tuple[DataFrame, DataFrame]:
    """``(turns, members)`` of the conversations rebuilt on their family's first one.

    Conversation ``c`` gets the first ``h`` turns of conversation ``c - c % family`` in place of its own
    first ``h``, where ``h`` is the crc32 of its decimal id modulo ``most``.
    """
    h = F.pmod(F.crc32(F.col("c").cast("string").cast("binary")), F.lit(most))
    lengths = turns.groupBy("c").agg(F.max("i").alias("length"))
    members = lengths.select("c", h.alias("h"), (F.col("c") - F.col("c") % family).alias("base"))
    first = lengths.select(F.col("c").alias("base"), F.col("length").alias("base_length"))
    members = staged(members.join(first, "base", "left").select(
        "c", "h", "base", F.least("h", F.coalesce("base_length", F.lit(0))).cast("long").alias("taken")), "members")
    # a family's first conversation gives a few turns to a few others
    given = (turns.where(F.col("i") < most).select(F.col("c").alias("base"), "i", "role", "text")
             .join(members.where("taken > 0"), "base").where(F.col("i") <= F.col("taken")).select("c", F.col("i").alias("d"), "role", "text"))
    own = turns.where(F.col("i") > h).join(members.select("c", "taken"), "c").select("c", (F.col("i") - h + F.col("taken")).alias("d"), "role", "text")
    return given.unionAll(own), members.select("c")


def _before(name: str, kind: Column, window) -> Column:
    return F.coalesce(kind.over(window), F.lit(0).cast("long")).alias(name)


def _chained(blocks: DataFrame) -> DataFrame:
    """Block rows ``(c, j, m, z1, z2, words)`` with ``a1, a2, pre``: digest and words of all turns before; two levels of sums."""
    sums = [F.bit_xor("z1").alias("z1"), F.bit_xor("z2").alias("z2"), F.sum("words").alias("words")]
    rows = blocks.withColumn("s", F.floor(F.col("j") / BLOCKS))
    earlier = W.partitionBy("c").orderBy("s").rowsBetween(W.unboundedPreceding, -1)
    large = rows.groupBy("c", "s").agg(*sums).select(
        F.col("c").alias("lc"), F.col("s").alias("ls"), _before("l1", F.bit_xor("z1"), earlier), _before("l2", F.bit_xor("z2"), earlier), _before("lw", F.sum("words"), earlier))
    inside = W.partitionBy("c", "s").orderBy("j").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.select("*", _before("i1", F.bit_xor("z1"), inside), _before("i2", F.bit_xor("z2"), inside), _before("iw", F.sum("words"), inside))
    return rows.join(large, (F.col("c") == F.col("lc")) & (F.col("s") == F.col("ls"))).select(
        "c", "j", "m", "words", F.col("i1").bitwiseXOR(F.col("l1")).alias("a1"), F.col("i2").bitwiseXOR(F.col("l2")).alias("a2"),
        (F.col("iw") + F.col("lw")).alias("pre"), "z1", "z2").select(
        "c", "j", "m", "words", "a1", "a2", "pre", F.col("a1").bitwiseXOR(F.col("z1")).alias("e1"), F.col("a2").bitwiseXOR(F.col("z2")).alias("e2"))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of a key's sorted ids as comma-joined rows."""
    key, ids = None, []

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"depth": pa.array([key[0]], pa.int64()), "p1": pa.array([key[1]], pa.int64()), "p2": pa.array([key[2]], pa.int64()),
                                           "first": pa.array([ids[0]], pa.int64()), "ids": [",".join(map(str, ids))]})

    for batch in batches:
        for *here, c in zip(*(batch.column(x).to_pylist() for x in (*KEY, "c"))):
            if ids and (here != key or len(ids) == PACKED):
                yield row()
                ids = []
            key = here
            ids.append(c)
    if ids:
        yield row()


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's rows, joined by commas, as they come."""
    key, state = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"depth": pa.array([key[0]], pa.int64()), "p1": pa.array([key[1]], pa.int64()), "p2": pa.array([key[2]], pa.int64()), "ends_sha256": [state.hexdigest()]})

    for batch in batches:
        for *here, ids in zip(*(batch.column(x).to_pylist() for x in (*KEY, "ids"))):
            if here == key:
                state.update(b",")
            else:
                if state is not None:
                    yield row()
                key, state = here, hashlib.sha256()
            state.update(ids.encode())
    if state is not None:
        yield row()


def ends(members: DataFrame) -> DataFrame:
    """``(depth, p1, p2, ends_sha256)`` of the ``(depth, p1, p2, c)`` at which conversations end."""
    keys = [*KEY, "c"]
    packed = members.repartitionByRange(parts(members.sparkSession), *keys).sortWithinPartitions(*keys).mapInArrow(_pack, "depth long, p1 long, p2 long, first long, ids string")
    return packed.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(_hash, "depth long, p1 long, p2 long, ends_sha256 string")


def trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """The nodes of the turns ``(c, d, role, text)``, ``d`` from 1 without gaps, of the conversations ``(c)``.

    ``(depth, p1, p2, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)``;
    depth and digest (p1, p2) name a node, and its last turn is turn ``depth`` of conversation ``conv_id``.
    """
    place = [F.col("d"), F.col("role"), F.col("text")]
    rows = staged(turns.select(
        "c", "d", F.floor((F.col("d") - 1) / BLOCK).alias("j"), F.xxhash64(*place).alias("z1"), F.xxhash64(F.lit(1), *place).alias("z2"),
        F.size(F.array_remove(F.split("text", f"[{SPACES}]+"), "")).cast("long").alias("words")), "turns")
    blocks = staged(_chained(rows.groupBy("c", "j").agg(
        F.count(F.lit(1)).alias("m"), F.bit_xor("z1").alias("z1"), F.bit_xor("z2").alias("z2"), F.sum("words").alias("words"))), "blocks")

    same = ["j", "a1", "a2", "m", "e1", "e2"]
    groups = staged(blocks.groupBy(*same).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c"), F.min("pre").alias("pre")), "block-groups")
    several = groups.groupBy("j", "a1", "a2").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("j", "a1", "a2", F.lit(True).alias("diverge"))
    # all first blocks follow the root: they are refined without asking
    later = groups.where("j > 0").join(several.where("j > 0"), ["j", "a1", "a2"], "left").withColumn("diverge", F.coalesce("diverge", F.lit(False)))
    groups = groups.where("j = 0").withColumn("diverge", F.lit(True)).unionByName(later)
    inside = W.partitionBy("c", "j").orderBy("d")
    paths = rows.join(groups.select("c", "j", "a1", "a2", "n", "pre", "diverge"), ["c", "j"])
    paths = staged(paths.select(
        "c", "j", F.col("d").cast("long").alias("depth"), "n", "diverge", "words", "z1", "z2",
        F.bit_xor("z1").over(inside).bitwiseXOR(F.col("a1")).alias("p1"), F.bit_xor("z2").over(inside).bitwiseXOR(F.col("a2")).alias("p2"),
        (F.sum("words").over(inside) - F.col("words") + F.col("pre")).alias("pre")).withColumn(
        "q1", F.col("p1").bitwiseXOR(F.col("z1"))).withColumn("q2", F.col("p2").bitwiseXOR(F.col("z2"))).drop("z1", "z2"), "paths")
    fields = ["q1", "q2", "words", "pre"]
    refined = paths.where("diverge").groupBy(*KEY).agg(F.sum("n").alias("n_convs"), F.min("c").alias("conv_id"), *(F.min(x).alias(x) for x in fields))
    alone = paths.where("NOT diverge").select(*KEY, F.col("n").alias("n_convs"), F.col("c").alias("conv_id"), *fields)
    nodes = refined.unionByName(alone)
    children = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = staged(nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "nodes")

    # what each conversation owns: the path of nodes whose smallest member it is
    own = nodes.groupBy("conv_id").agg(F.min(F.struct("depth", "pre"))["pre"].alias("base"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaf"))
    totals = blocks.groupBy("c").agg(F.sum("words").alias("total"), F.max(F.struct((F.col("j") * BLOCK + F.col("m")).alias("depth"), "e1", "e2")).alias("end"))
    zero = F.lit(0).cast("long")
    owners = staged(members.join(totals, "c", "left").join(own, F.col("c") == F.col("conv_id"), "left").select(
        "c", F.coalesce("total", zero).alias("total"), F.when(F.col("base").isNull(), zero).otherwise(F.col("total") - F.col("base")).alias("own"),
        F.coalesce("base", zero).alias("base"), F.coalesce("leaf", zero).alias("leaf"),
        F.coalesce("end.depth", zero).alias("depth"), F.coalesce("end.e1", zero).alias("p1"), F.coalesce("end.e2", zero).alias("p2")), "owners")
    sums = ["total", "own", "leaf"]
    of_groups = blocks.join(owners.select("c", *sums), "c").groupBy(*same).agg(F.min("c").alias("c"), *(F.sum(x).alias(x) for x in sums)).select("c", "j", *sums)
    told = paths.select(*KEY, "c", "j", "diverge").join(of_groups, ["c", "j"])
    told = (told.where("diverge").groupBy(*KEY).agg(*(F.sum(x).alias(x) for x in sums))
            .unionByName(told.where("NOT diverge").select(*KEY, *sums)))
    told = nodes.join(told, KEY).join(owners.select(F.col("c").alias("conv_id"), "base"), "conv_id")
    told = told.withColumn("saved_tokens", F.col("total") - F.col("n_convs") * F.col("pre") - F.col("own") + F.col("pre") - F.col("base"))
    whole = owners.agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c"), (F.sum("total") - F.sum("own")).alias("saved"), F.sum("leaf").alias("leaf")).first()
    below = nodes.where("depth = 1").count()
    root = members.sparkSession.createDataFrame(
        [(0, 0, 0, whole["c"], None, whole["n"], below, whole["leaf"] if below else 1, whole["saved"])] if whole["n"] else [],
        "depth long, p1 long, p2 long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long")
    # a parent's smallest member; the root's is the smallest of all
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    deeper = told.where("depth > 1").join(parents, ["depth", "q1", "q2"])
    first = told.where("depth = 1").withColumn("parent_conv_id", F.lit(whole["c"]).cast("long"))
    columns = [*KEY, "conv_id", "parent_conv_id", "n_convs", "n_children", F.col("leaf").alias("n_leaves"), "saved_tokens"]
    found = first.select(*columns).unionByName(deeper.select(*columns)).unionByName(root)
    none = hashlib.sha256(b"").hexdigest()
    return found.join(ends(owners.select(*KEY, "c")), KEY, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(none)))


def last_turns(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes but the root with ``role`` and ``text`` of their last turn."""
    mine = turns.select(F.col("c").alias("conv_id"), F.col("d").alias("depth"), "role", "text")
    return nodes.join(mine, ["conv_id", "depth"])
