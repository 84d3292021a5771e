"""The trie of conversations' common beginnings, by range partitions and a skeleton of their splitters.

A conversation is a path of turns. Equal paths are one row with a count, so copies cost nothing. The paths are dealt to
shards by splitter paths, which come from a bounded sample; a shard has its paths in order and closes every node whose
members all lie in it. Only a node on a splitter's path, the skeleton, may have members in several shards: each shard gives
its part of it, and the parts are added up. The skeleton is bounded by the number and length of the splitters.

A long conversation is cut into pieces of ``span`` turns: the pieces after the first form tries of their own below the node
where they hang, worked on from the deepest level up, so that no row holds more than a piece.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import Steps

#: Characters of a turn's name in a path: 128 bits of a SHA-256.
NAME = 32
#: Turns of a piece of a conversation.
SPAN = 256
#: Turns of a shard, about; most shards; turns of a splitter. The skeleton has MOST_SHARDS x (SPLITTER + 1) nodes at most.
SHARD_TURNS, MOST_SHARDS, SPLITTER = 1 << 14, 1 << 14, 16
#: Rows sampled per splitter.
SAMPLED = 4
#: Conversation ids are joined by aligned ranges of so many.
ID_RANGE = 1 << 16
NO_ENDS = hashlib.sha256(b"").hexdigest()
LOCAL = "kind int, conv long, depth long, parent long, parent_key string, n long, children long, leaves long, saved long, ends string, key string, size long, ancestors array<string>"


def paths_of(conversations: DataFrame, steps: Steps, heads: int = 9, kin: int = 5, rebuild: bool = True) -> DataFrame:
    """conv, depth, name, size, turns: each turn of each rebuilt conversation, and a row of depth 0 and no name per conversation."""
    conv, text = F.col("conv_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    name = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, NAME)
    turns = conversations.where(conv.isNotNull()).select(conv.alias("conv"), "turn", name.alias("name"), F.octet_length(text).cast("long").alias("size"))
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "name")
    turns = steps.table(turns.select("conv", "name", "size", F.row_number().over(order).cast("long").alias("at")), "turns")
    convs = turns.where("at = 1").select("conv")
    if rebuild:
        borrowed = F.crc32(F.col("conv").cast("string")) % heads
        asked = convs.select(F.col("conv").alias("to"), (F.col("conv") - F.col("conv") % kin).alias("conv"), borrowed.alias("first"))
        head = turns.where(F.col("at") < heads).join(asked, "conv").where("at <= first").select(F.col("to").alias("conv"), "name", "size", "at")
        turns = turns.where(F.col("at") > borrowed).unionByName(head)
    marks = convs.select("conv", F.lit(None).cast("string").alias("name"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("at"))
    whole = Window.partitionBy("conv")
    depth = F.row_number().over(whole.orderBy("at")).cast("long") - 1
    return turns.unionByName(marks).select("conv", depth.alias("depth"), "name", "size", (F.count("*").over(whole) - 1).alias("turns"))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by node and range of ids; SHA-256 of each node's ids."""
    node, digest = None, None
    for batch in batches:
        done = []
        for own, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if own != node:
                if node is not None:
                    done.append((node, digest.hexdigest()))
                node, digest = own, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], ["node", "ends"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([digest.hexdigest()])], ["node", "ends"])


def common_turns(a: str, b: str) -> int:
    most = min(len(a), len(b)) // NAME
    if a[: most * NAME] == b[: most * NAME]:
        return most
    low, high = 0, most  # the first low turns are equal, the first high ones are not
    while high - low > 1:
        middle = (low + high) // 2
        if a[low * NAME : middle * NAME] == b[low * NAME : middle * NAME]:
            low = middle
        else:
            high = middle
    return low


class Node:
    __slots__ = ("ancestors", "children", "conv", "ends", "leaves", "n", "pending", "saved", "size")

    def __init__(self, size: int, ancestors: list[str] | None):
        self.size, self.ancestors = size, ancestors  # ancestors: keys down to this node, of skeleton nodes only
        self.n = self.children = self.leaves = self.saved = 0
        self.conv, self.ends, self.pending = None, None, []


class Shard:
    """Nodes of one shard's paths, in their order: finished ones, and this shard's part of skeleton nodes."""

    def __init__(self, lower: str | None, upper: str | None, first_depth: int):
        self.bounds = [b for b in (lower, upper) if b is not None]
        self.first_depth, self.open, self.path, self.up, self.rows = first_depth, [], "", None, []

    def add(self, path: str, sizes: list[int], n: int, conv: int, ends: str | None, children: int, leaves: int, saved: int, up: int | None) -> None:
        keep = common_turns(path, self.path)
        self.close(keep)
        skeleton = max((common_turns(path, b) for b in self.bounds), default=0)
        for depth in range(keep + 1, len(path) // NAME + 1):
            above = self.open[-1].ancestors if self.open else []
            own = [*above, hashlib.md5(path[: depth * NAME].encode()).hexdigest()] if depth <= skeleton else None
            self.open.append(Node(sizes[depth - 2] if depth > 1 else 0, own))
        self.path, self.up = path, up
        top = self.open[-1]
        top.n, top.conv, top.ends = top.n + n, conv if top.conv is None else min(top.conv, conv), ends
        top.children, top.leaves, top.saved = top.children + children, top.leaves + leaves, top.saved + saved

    def close(self, keep: int = 0) -> None:
        while len(self.open) > keep:
            node, depth = self.open.pop(), self.first_depth + len(self.open)
            above = self.open[-1] if self.open else None
            if above:
                above.n, above.conv = above.n + node.n, node.conv if above.conv is None else min(above.conv, node.conv)
            if not above and self.up is not None:
                node.conv = self.up
            if node.ancestors:
                self.rows.append((1, node.conv, depth, None, None, node.n, node.children, node.leaves, node.saved, node.ends, node.ancestors[-1], node.size, node.ancestors))
                continue
            for row in node.pending:
                self.rows.append((*row[:3], node.conv, *row[4:]))
            if not above and self.up is not None:  # the node where pieces hang belongs to the level above
                self.rows.append((2, None, depth, None, None, node.n, node.children, node.leaves, node.saved, None, self.path[:NAME], 0, None))
                continue
            leaves, saved = node.leaves if node.children else 1, node.saved + (node.n - 1) * node.size
            key = above.ancestors[-1] if above and above.ancestors else None
            row = (0, node.conv, depth, None, key, node.n, node.children, leaves, saved, node.ends, None, node.size, None)
            if above:
                above.children, above.leaves, above.saved = above.children + 1, above.leaves + leaves, above.saved + saved
            (above.pending if above and not above.ancestors else self.rows).append(row)


def _local(splitters: list[str], first_depth: int):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(LOCAL))

    def given(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = None, None
        for batch in batches:
            for s, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if s != number:
                    if shard:
                        shard.close()
                        if shard.rows:
                            yield given(shard.rows)
                    number, shard = s, Shard(splitters[s - 1] if s else None, splitters[s] if s < len(splitters) else None, first_depth)
                shard.add(*row)
                if len(shard.rows) > 10_000:
                    yield given(shard.rows)
                    shard.rows = []
        if shard:
            shard.close()
            if shard.rows:
                yield given(shard.rows)

    return run


def _splitters(paths: DataFrame, shard_turns: int) -> list[str]:
    """Paths that cut the rows of paths (node, path) into ranges of about so many turns."""
    size = paths.agg(F.count("*").alias("rows"), F.sum(F.length("path")).alias("chars")).first()
    shards = min(MOST_SHARDS, -(-(size["chars"] or 0) // (NAME * shard_turns)))
    if shards < 2:
        return []
    share = min(1.0, SAMPLED * shards / size["rows"])
    chosen = F.conv(F.substring("node", 1, 8), 16, 10).cast("long") < int(share * (1 << 32))
    sample = sorted(r[0] for r in paths.where(chosen).select(F.substring("path", 1, NAME * (SPLITTER + 1))).collect())
    return sorted({sample[len(sample) * k // shards] for k in range(1, shards)}) if sample else []


def _node(where: Column | str, path: Column | str) -> Column:
    return F.substring(F.sha2(F.concat(where, path), 256), 1, NAME)


def _distinct_paths(rows: DataFrame, above: DataFrame | None) -> DataFrame:
    """node, path, sizes, n, conv, ends, up: a row per path of a level, from its rows (conv, hangs, path, sizes, more, node)."""
    paths = rows.groupBy("node").agg(
        F.first("hangs").alias("hangs"), F.concat(F.first("hangs"), F.first("path")).alias("path"), F.first("sizes").alias("sizes"),
        F.count("*").alias("n"), F.min("conv").alias("conv"))
    ids = rows.where("not more").groupBy("node", F.floor(F.col("conv") / ID_RANGE).alias("range")).agg(F.sort_array(F.collect_list("conv")).alias("ids"))
    ids = ids.select("node", "range", F.array_join(F.transform("ids", lambda c: c.cast("string")), ",").alias("ids"))
    ends = ids.repartition("node").sortWithinPartitions("node", "range").select("node", "ids").mapInArrow(_ends, "node string, ends string")
    paths = paths.join(ends, "node", "left")
    if above is None:
        return paths.withColumn("up", F.lit(None).cast("long"))
    return paths.join(above.select(F.col("node").alias("hangs"), F.col("conv").alias("up")), "hangs")


def _level(steps: Steps, paths: DataFrame, below: DataFrame | None, level: int, span: int, shard_turns: int) -> tuple[DataFrame, DataFrame]:
    """Nodes of a level, and what hangs below each of its top nodes: (node, children, leaves, saved)."""
    carried = ["children", "leaves", "saved"]
    if below is None:
        full = paths.withColumns({c: F.lit(0).cast("long") for c in carried})
    else:
        full = paths.join(below, "node", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in carried})
    splitters = _splitters(paths, shard_turns)

    def shard_of(path: pa.Array) -> pa.Array:
        return pa.array([bisect_right(splitters, p) for p in path.to_pylist()], pa.int32())

    full = full.select(F.arrow_udf(shard_of, "int")("path").alias("shard"), "path", "sizes", "n", "conv", "ends", *carried, "up")
    dealt = full.repartition("shard").sortWithinPartitions("shard", "path")
    local = steps.table(dealt.mapInArrow(_local(splitters, level * span), LOCAL), f"local-{level}")

    parts = local.where("kind = 1").groupBy("key").agg(
        *[F.sum(c).alias(c) for c in ("n", *carried)], F.min("conv").alias("conv"), F.max("ends").alias("ends"),
        F.first("depth").alias("depth"), F.first("size").alias("size"), F.first("ancestors").alias("ancestors"))
    parts = parts.withColumn("above", F.try_element_at("ancestors", F.lit(-2)))
    kin = parts.where("above IS NOT NULL").groupBy(F.col("above").alias("key")).agg(F.count("*").alias("kin"))
    parts = steps.table(parts.join(kin, "key", "left").withColumn("children", F.col("children") + F.coalesce("kin", F.lit(0))), f"parts-{level}")
    own = parts.select(F.explode("ancestors").alias("key"), (F.col("leaves") + (F.col("children") == 0).cast("long")).alias("leaves"), (F.col("saved") + (F.col("n") - 1) * F.col("size")).alias("saved"))
    sums = own.groupBy("key").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    skeleton = steps.table(parts.drop("leaves", "saved").join(sums, "key"), f"skeleton-{level}")
    # at most MOST_SHARDS x (SPLITTER + 1) rows of some 40 bytes
    parents = F.broadcast(skeleton.select(F.col("key").alias("parent_key"), F.col("conv").alias("parent_")))

    hanging = (F.col("depth") == level * span) if level else F.lit(False)
    shown = ["conv", "depth", "parent", "n", *carried, "ends"]
    nodes = local.where("kind = 0").join(parents, "parent_key", "left").withColumn("parent", F.coalesce("parent", "parent_"))
    others = skeleton.where(~hanging).withColumnRenamed("above", "parent_key").join(parents, "parent_key", "left").withColumn("parent", F.col("parent_"))
    top = local.where("kind = 2").select(F.col("key").alias("node"), *carried)
    if level and splitters:
        keys = paths.select(F.substring("path", 1, NAME).alias("node")).distinct().withColumn("key", F.md5("node"))
        top = top.union(skeleton.where(hanging).join(keys, "key").select("node", *carried))
    return nodes.select(*shown).union(others.select(*shown)), top


def prefix_trie(conversations: DataFrame, rebuild: bool = True, span: int = SPAN, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: one row per node.

    A node is a distinct beginning (role, text) of a conversation, the root the empty one; conv_id is its least member.
    With ``rebuild`` a conversation c begins with the first h turns of conversation c - c % 5 (all if it has fewer, none
    if there is no such), then has its own after its first h; h is the CRC-32 of its decimal id modulo 9. Turns stand by
    number, null first, turns of one number by their digest; repeated rows are turns of their own. Null role or text is
    empty. Rows without conv_id belong to no conversation and are left out. A conversation that is left without turns is
    a member of the root. A long conversation is worked on in pieces of ``span`` turns; only its numbering streams through
    one task, as do the ids of a node's ends, joined by ranges, through their digest. Other columns are not read. An empty table gives none.
    """
    steps = Steps(conversations.sparkSession, "trie")
    turns = paths_of(conversations, steps, rebuild=rebuild)
    piece = F.when(F.col("depth") > 0, F.floor((F.col("depth") - 1) / span)).otherwise(0)
    pieces = turns.groupBy("conv", piece.alias("piece")).agg(F.first("turns").alias("turns"), F.sort_array(F.collect_list(F.when(F.col("depth") > 0, F.struct("depth", "name", "size")))).alias("t"))
    pieces = pieces.select("conv", "piece", (F.col("turns") > (F.col("piece") + 1) * span).alias("more"), F.array_join("t.name", "").alias("path"), F.col("t.size").alias("sizes"))
    pieces = steps.table(pieces, "pieces")
    last = pieces.agg(F.max("piece")).first()[0] or 0
    levels, rows = [], None
    for level in range(last + 1):
        own = pieces.where(F.col("piece") == level)
        if rows is None:
            own = own.withColumn("hangs", F.lit("0" * NAME))
        else:
            own = own.join(rows.where("more").select("conv", F.col("node").alias("hangs")), "conv")
        rows = steps.table(own.select("conv", "hangs", "path", "sizes", "more", _node("hangs", "path").alias("node")), f"rows-{level}")
        levels.append(steps.table(_distinct_paths(rows, levels[-1] if levels else None), f"paths-{level}"))
    found, below = None, None
    for level in reversed(range(last + 1)):
        nodes, below = _level(steps, levels[level], below, level, span, shard_turns)
        found = nodes if found is None else found.union(nodes)
    return found.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"))
