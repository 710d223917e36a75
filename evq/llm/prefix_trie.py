"""The trie of conversation prefixes: who shares which first turns, and what sharing them would save.

Conversations are rebuilt first (``rebuild``: the head of another conversation, then the own turns). A node is a
distinct sequence of first turns, known by a 128-bit digest that is chained from its parent's. Its smallest member
``c`` owns it; as members only get fewer downwards, all nodes that ``c`` owns are one stretch of its path, down to its
end. So each node's own numbers are counted once, on its owner's path, and passed up along that path.

Shards are any sets of paths: a task takes blocks of paths, enumerates their distinct digests, gives them slots by a
minimal perfect hash (verified against the stored digest), scatters counts into flat arrays and accumulates them from
the deepest slots upwards through the array of parent slots. What a shard finds for a node is a partial sum, and
Spark adds the partial sums of a digest; so a first turn that a third of all conversations share is one row a shard.
Long paths are cut into bands of ``Sizes.band`` turns at fixed depths; what the bands below bring is carried to the end of
the band above by a running sum over bands, so no task holds a whole long conversation.

Defined results. Turns are in order of ``turn`` (null first), ties by the digest of role and text; repeated rows are
turns of their own; a null role or text is empty. Rows with a null ``conv_id`` belong to no conversation and are left
out. An empty table gives no rows. Other columns are not read. Two sequences with one digest raise an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evq.llm.perfect_hash import PerfectHash
from evq.llm.tasks import small_batches, written
from evq.llm.words import join_hashes
from evq.plans.positions import with_position

#: Digest of the root, which no chain gives in practice (a clash raises an error).
ROOT = (0, 0)
#: Parts of a node's children in the join that tells them their parent's owner.
PARTS = 64
DIGEST = ["high", "low"]


class Sizes(NamedTuple):
    """Turns of a path in one row, turns of a block of paths, ids joined to one string before the last sort of a node's ends."""

    band: int = 256
    block: int = 1 << 18
    chunk: int = 1 << 14


def turn_rows(conversations: DataFrame) -> DataFrame:
    """``conv_id, position, digest, chars`` of all turns, in order from 0; texts are left behind in the scan."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", F.unhex(F.md5(said)).alias("digest"), F.length(text).cast("long").alias("chars"))
    return with_position(rows, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("digest").asc()], "position", F.col("turn")).drop("turn")


def rebuild(turns: DataFrame, most: int = 6, family: int = 100) -> tuple[DataFrame, DataFrame]:
    """Conversation c as the first h turns of c - c % family, then its own turns after its first h; h = crc32(c) % most.

    Returns all conversations with their number of rebuilt ``turns``, and the rebuilt turns with their ``depth`` from 1.
    """
    head = turns.where((F.col("position") < most - 1) & (F.col("conv_id") % family == 0))
    heads = head.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("position", "digest", "chars"))).alias("head"))
    counted = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int"))
    nothing = F.array().cast("array<struct<position:int,digest:binary,chars:bigint>>")
    conversations = (
        counted.withColumn("of", F.col("conv_id") - F.col("conv_id") % family)
        .join(heads.withColumnRenamed("conv_id", "of"), "of", "left")
        .withColumn("head", F.slice(F.coalesce("head", nothing), F.lit(1), F.col("h")))
        .withColumn("turns", F.size("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
        .select("conv_id", "h", "head", "turns")
    )
    conversations = written(conversations, "trie-conversations")
    own = turns.join(conversations.select("conv_id", "h", F.size("head").alias("m"), "turns"), "conv_id").where("position >= h")
    own = own.select("conv_id", (F.col("position") - F.col("h") + F.col("m") + 1).cast("long").alias("depth"), "digest", "chars", "turns")
    shared = conversations.select("conv_id", "turns", F.posexplode("head").alias("at", "turn"))
    shared = shared.select("conv_id", (F.col("at") + 1).cast("long").alias("depth"), "turn.digest", "turn.chars", "turns")
    return conversations.select("conv_id", "turns"), own.unionByName(shared)


def _chained(high: np.ndarray, low: np.ndarray, next_high: np.ndarray, next_low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b = join_hashes(high, next_high), join_hashes(low, next_low)
    return join_hashes(a, b ^ np.uint64(0x9FB21C651E98DF25)), join_hashes(b, a ^ np.uint64(0xD1B54A32D192ED03))


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _lists(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), _longs(np.ascontiguousarray(values)))


def _blocks(batches: Iterator[pa.RecordBatch], column: str, sizes: Sizes) -> Iterator[pa.RecordBatch]:
    """Batches of about ``sizes.block`` turns in a list column."""
    kept, turns = [], 0
    for batch in batches:
        rows = max(1, sizes.block // sizes.band)
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            n = len(part.column(column).flatten())
            if kept and turns + n > sizes.block:
                yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
                kept, turns = [], 0
            kept.append(part)
            turns += n
    if turns:
        yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]


def _flat(column: pa.Array, dtype: type = np.uint64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).view(dtype)


def _starts(column: pa.Array) -> np.ndarray:
    offsets = column.offsets.to_numpy()
    return (offsets - offsets[0]).astype(np.int64)


def _number(batch: pa.RecordBatch, name: str, dtype: type = np.int64) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).view(dtype)


def _local_chains(batches: Iterator[pa.RecordBatch], sizes: Sizes) -> Iterator[pa.RecordBatch]:
    """Per band of a path: the digests of its turns, and those chained from the band's start."""
    for batch in _blocks(batches, "path", sizes):
        path = batch.column("path")
        items, starts = path.flatten(), _starts(path)
        digests = np.frombuffer(b"".join(items.field("digest").to_pylist()), np.uint64).reshape(-1, 2)
        high, low, lengths = digests[:, 0].copy(), digests[:, 1].copy(), np.diff(starts)
        for step in range(1, int(lengths.max(initial=0))):  # all paths at once
            at = starts[:-1][lengths > step] + step
            high[at], low[at] = _chained(high[at - 1], low[at - 1], digests[at, 0], digests[at, 1])
        columns = [batch.column("conv_id"), batch.column("band"), batch.column("turns"), _lists(high, starts), _lists(low, starts), _lists(digests[:, 0], starts)]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), items.field("chars"))],
            ["conv_id", "band", "turns", "high", "low", "said", "chars"],
        )


def _band_tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted full bands of whole conversations: the digest above each next band. State is one digest."""
    conversation, above = None, None
    for batch in batches:
        found = []
        for conv, band, high, low in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "band", "high", "low")), strict=True):
            if conv != conversation:
                conversation, above = conv, np.zeros((2, 1), np.uint64)
            end = np.array([[high], [low]], np.int64).view(np.uint64)
            above = np.array(_chained(above[0], above[1], end[0], end[1]))
            found.append((conv, band + 1, *above.view(np.int64)[:, 0].tolist()))
        columns = list(zip(*found, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["conv_id", "band", "up_high", "up_low"])


def _joined_bands(batches: Iterator[pa.RecordBatch], sizes: Sizes) -> Iterator[pa.RecordBatch]:
    """Chain each band to the digest above it: now a digest stands for the whole sequence from the first turn."""
    for batch in _blocks(batches, "high", sizes):
        starts = _starts(batch.column("high"))
        lengths = np.diff(starts)
        up = [np.repeat(_number(batch, name, np.uint64), lengths) for name in ("up_high", "up_low")]
        high, low = _chained(*up, _flat(batch.column("high")), _flat(batch.column("low")))
        names = ["conv_id", "band", "turns", "up_high", "up_low", "said", "chars"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), _lists(high, starts), _lists(low, starts)], [*names, *DIGEST])


_CHAINS = "conv_id long, band long, turns long, high array<long>, low array<long>, said array<long>, chars array<long>"


def paths(rebuilt: DataFrame, sizes: Sizes) -> DataFrame:
    """Rows of at most ``sizes.band`` turns: the nodes that a conversation passes, from depth ``band * sizes.band + 1``."""
    band = F.floor((F.col("depth") - 1) / sizes.band).cast("long").alias("band")
    bands = rebuilt.groupBy("conv_id", band).agg(F.max("turns").alias("turns"), F.sort_array(F.collect_list(F.struct("depth", "digest", "chars"))).alias("path"))
    chains = written(bands.mapInArrow(partial(_local_chains, sizes=sizes), _CHAINS), "trie-chains")
    full = chains.where(F.size("high") == sizes.band).select("conv_id", "band", F.element_at("high", -1).alias("high"), F.element_at("low", -1).alias("low"))
    tops = full.repartition("conv_id").sortWithinPartitions("conv_id", "band").mapInArrow(_band_tops, "conv_id long, band long, up_high long, up_low long")
    root = [F.coalesce(f"up_{half}", F.lit(value)).alias(f"up_{half}") for half, value in zip(DIGEST, ROOT, strict=True)]
    above = chains.join(tops, ["conv_id", "band"], "left").select(*chains.columns, *root)
    schema = "conv_id long, band long, turns long, up_high long, up_low long, said array<long>, chars array<long>, high array<long>, low array<long>"
    return written(above.mapInArrow(partial(_joined_bands, sizes=sizes), schema), "trie-paths")


class _Shard:
    """The nodes on a block of paths: their slots, depths and parent slots (-1: above the block)."""

    def __init__(self, batch: pa.RecordBatch, band: int) -> None:
        self.high, self.low = _flat(batch.column("high")), _flat(batch.column("low"))
        self.starts = _starts(batch.column("high"))
        lengths = np.diff(self.starts)
        self.path = np.repeat(np.arange(len(lengths)), lengths)
        first = self.starts[:-1][lengths > 0]
        self.up_high, self.up_low = np.roll(self.high, 1), np.roll(self.low, 1)
        for up, name in ((self.up_high, "up_high"), (self.up_low, "up_low")):
            up[first] = _number(batch, name, np.uint64)[lengths > 0]
        self.depth = _number(batch, "band")[self.path] * band + np.arange(len(self.high)) - self.starts[self.path] + 1
        # Enumerate the distinct digests, with the root.
        high, low = np.append(self.high, np.uint64(ROOT[0])), np.append(self.low, np.uint64(ROOT[1]))
        order = np.lexsort((low, high))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(high[order]) != 0) | (np.diff(low[order]) != 0)
        self.table = PerfectHash(high[order[new]], low[order[new]])
        self.slot = self.table.slots(self.high, self.low)
        self.root = int(self.table.slots(np.array([ROOT[0]], np.uint64), np.array([ROOT[1]], np.uint64))[0])
        # Any turn of a node describes it; that all of them agree is checked on the merged table.
        self.turn = np.full(len(self.table), -1, np.int64)
        self.turn[self.slot] = np.arange(len(self.slot))
        self.nodes = np.flatnonzero(self.turn >= 0)
        turn = self.turn[self.nodes]
        self.parent = np.full(len(self.table), -1, np.int64)
        # What goes from a band to the one above is carried outside, also when both are in this block.
        inside = ((self.depth[turn] - 1) % band != 0) | (self.depth[turn] == 1)
        self.parent[self.nodes] = np.where(inside, self.table.slots(self.up_high[turn], self.up_low[turn]), -1)

    def upwards(self, *arrays: np.ndarray) -> None:
        """Add each slot's values to its parent's, the deepest slots first."""
        depth = self.depth[self.turn[self.nodes]]
        order = self.nodes[np.argsort(-depth, kind="stable")]
        edges = np.flatnonzero(np.diff(-np.sort(-depth))) + 1
        for level in np.split(order, edges):
            inside = level[self.parent[level] >= 0]
            for values in arrays:
                np.add.at(values, self.parent[inside], values[inside])


def _counted(batches: Iterator[pa.RecordBatch], sizes: Sizes) -> Iterator[pa.RecordBatch]:
    """Members and smallest member of the nodes of a shard."""
    for batch in _blocks(batches, "high", sizes):
        shard = _Shard(batch, sizes.band)
        members, smallest = np.zeros(len(shard.table), np.int64), np.full(len(shard.table), np.iinfo(np.int64).max)
        np.add.at(members, shard.slot, 1)
        np.minimum.at(smallest, shard.slot, _number(batch, "conv_id")[shard.path])
        at, turn = shard.nodes, shard.turn[shard.nodes]
        columns = [shard.table.high[at], shard.table.low[at], shard.up_high[turn], shard.up_low[turn], shard.depth[turn]]
        columns += [_flat(batch.column(name), np.int64)[turn] for name in ("chars", "said")]
        yield pa.RecordBatch.from_arrays([*(_longs(c) for c in columns), pa.array(members[at]), pa.array(smallest[at])], ["high", "low", "up_high", "up_low", "depth", "chars", "said", "n_convs", "conv_id"])


_COUNTED = "high long, low long, up_high long, up_low long, depth long, chars long, said long, n_convs long, conv_id long"


def nodes(all_paths: DataFrame, sizes: Sizes) -> DataFrame:
    """One row per node below the root, merged from all shards."""
    facts = F.struct("up_high", "up_low", "depth", "chars", "said")
    merged = small_batches(all_paths).mapInArrow(partial(_counted, sizes=sizes), _COUNTED).groupBy(*DIGEST).agg(
        F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min(facts).alias("facts"), F.max(facts).alias("others")
    )
    is_root = (F.col("high") == ROOT[0]) & (F.col("low") == ROOT[1])
    same = F.when((F.col("facts") == F.col("others")) & ~is_root, F.col("facts")).otherwise(F.raise_error(F.lit("two sequences of turns have one digest")).cast("struct<up_high:bigint,up_low:bigint,depth:bigint,chars:bigint,said:bigint>"))
    return merged.withColumn("facts", same).select(*DIGEST, "n_convs", "conv_id", "facts.up_high", "facts.up_low", "facts.depth", "facts.chars")


def _accumulated(batches: Iterator[pa.RecordBatch], sizes: Sizes) -> Iterator[pa.RecordBatch]:
    """Partial sums over the subtrees of a shard's nodes, of what the paths' conversations own."""
    for batch in _blocks(batches, "high", sizes):
        shard = _Shard(batch, sizes.band)
        leaves, saved = np.zeros(len(shard.table), np.int64), np.zeros(len(shard.table), np.int64)
        own = batch.column("own")
        items, row = own.flatten(), np.repeat(np.arange(batch.num_rows), np.diff(_starts(own)))
        slot = shard.slot[shard.starts[row] + items.field("at").to_numpy(zero_copy_only=False)]
        last = shard.slot[shard.starts[1:] - 1]
        for values, name in ((leaves, "leaf"), (saved, "saved")):
            np.add.at(values, slot, items.field(name).to_numpy(zero_copy_only=False))
            np.add.at(values, last, _number(batch, f"below_{name}"))
        shard.upwards(leaves, saved)
        at = np.append(shard.nodes, shard.root)
        some = at[(leaves[at] != 0) | (saved[at] != 0)]
        yield pa.RecordBatch.from_arrays([_longs(shard.table.high[some]), _longs(shard.table.low[some]), pa.array(leaves[some]), pa.array(saved[some])], [*DIGEST, "n_leaves", "saved_tokens"])


def subtree_sums(all_nodes: DataFrame, all_paths: DataFrame, sizes: Sizes) -> DataFrame:
    """``n_leaves`` and ``saved_tokens`` of every node and of the root; nodes need ``n_children``."""
    band = F.floor((F.col("depth") - 1) / sizes.band).cast("long").alias("band")
    item = F.struct(
        ((F.col("depth") - 1) % sizes.band).alias("at"),
        F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"),
    )
    own = all_nodes.select("conv_id", band, item.alias("item")).groupBy("conv_id", "band").agg(
        F.collect_list("item").alias("own"), F.sum("item.leaf").alias("leaf"), F.sum("item.saved").alias("saved")
    )
    deeper = Window.partitionBy("conv_id").orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id").orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy("conv_id").orderBy("band")
    carried = own.select(
        "conv_id", "band", "own", (F.row_number().over(up) == 1).alias("top"),
        *[F.coalesce(F.sum(name).over(deeper), F.lit(0)).alias(f"below_{name}") for name in ("leaf", "saved")],
        *[F.sum(name).over(whole).alias(f"all_{name}") for name in ("leaf", "saved")],
    )
    nothing = F.array().cast("array<struct<at:bigint,leaf:bigint,saved:bigint>>")
    above = carried.where("top AND band > 0").select(
        "conv_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("band") - 1)).alias("band"), nothing.alias("own"), F.col("all_leaf").alias("below_leaf"), F.col("all_saved").alias("below_saved")
    )
    work = all_paths.join(carried.select(*above.columns).unionByName(above), ["conv_id", "band"])
    sums = work.mapInArrow(partial(_accumulated, sizes=sizes), "high long, low long, n_leaves long, saved_tokens long")
    return sums.groupBy(*DIGEST).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))


def _id_chunks(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    """Sorted (digest, conv_id) rows: the ids of a digest joined, at most ``chunk`` in a row."""
    for batch in batches:
        high, low, ids = (_number(batch, name) for name in (*DIGEST, "conv_id"))
        new = np.ones(len(ids), bool)
        new[1:] = (np.diff(high) != 0) | (np.diff(low) != 0)
        starts = np.flatnonzero(new)
        starts = np.unique(np.concatenate([starts, *(np.arange(a, b, chunk) for a, b in zip(starts, np.append(starts[1:], len(ids)), strict=True) if b - a > chunk)]))
        texts = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(ids)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(high[starts]), pa.array(low[starts]), pa.array(ids[starts]), pa.array(texts)], [*DIGEST, "first", "ids"])


def _hashed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted chunks: SHA-256 of each digest's ids. A hash state is all that is kept between chunks."""
    key, state, found = None, None, []

    def flush() -> pa.RecordBatch:
        rows, found[:] = list(found), []
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], [*DIGEST, "ends_sha256"])

    for batch in batches:
        for high, low, ids in zip(*(batch.column(n).to_pylist() for n in (*DIGEST, "ids")), strict=True):
            if (high, low) == key:
                state.update(b"," + ids.encode())
                continue
            if key is not None:
                found.append((*key, state.hexdigest()))
            key, state = (high, low), hashlib.sha256(ids.encode())
        yield flush()
    if key is not None:
        found.append((*key, state.hexdigest()))
        yield flush()


def end_digests(conversations: DataFrame, all_paths: DataFrame, sizes: Sizes) -> DataFrame:
    """Per node at which conversations end: SHA-256 of their ids in order. Ids of one node are sorted in many tasks."""
    last = F.col("band") * sizes.band + F.size("high") == F.col("turns")
    ends = all_paths.where(last).select("conv_id", F.element_at("high", -1).alias("high"), F.element_at("low", -1).alias("low"))
    empty = conversations.where("turns = 0").select("conv_id", F.lit(ROOT[0]).cast("long").alias("high"), F.lit(ROOT[1]).cast("long").alias("low"))
    order = [*DIGEST, "conv_id"]
    chunks = ends.unionByName(empty).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(partial(_id_chunks, chunk=sizes.chunk), "high long, low long, first long, ids string")
    return chunks.repartition(*DIGEST).sortWithinPartitions(*DIGEST, "first").mapInArrow(_hashed_ids, "high long, low long, ends_sha256 string")


def _parents(below: DataFrame, root: DataFrame) -> DataFrame:
    """``high, low, parent_conv_id`` of all nodes. A node's children are dealt to ``PARTS`` parts, so a parent of very
    many meets no more than their share in a task."""
    part = F.pmod(F.col("low"), F.lit(PARTS)).alias("part")
    children = below.select(*DIGEST, "up_high", "up_low", part)
    owners = below.select(F.col("high").alias("up_high"), F.col("low").alias("up_low"), F.col("conv_id").alias("parent_conv_id")).unionByName(
        root.select(F.lit(ROOT[0]).cast("long").alias("up_high"), F.lit(ROOT[1]).cast("long").alias("up_low"), F.col("conv_id").alias("parent_conv_id"))
    )
    wanted = children.select("up_high", "up_low", "part").distinct().join(owners, ["up_high", "up_low"])
    return children.join(wanted, ["up_high", "up_low", "part"]).select(*DIGEST, "parent_conv_id")


def prefix_trie(conversations: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """One row per node of the trie of rebuilt conversations."""
    everyone, rebuilt = rebuild(turn_rows(conversations))
    all_paths = paths(rebuilt, sizes)
    below = written(nodes(all_paths, sizes), "trie-nodes")
    root = everyone.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    children = below.groupBy(F.col("up_high").alias("high"), F.col("up_low").alias("low")).agg(F.count(F.lit(1)).alias("n_children"))
    none: Column = F.lit(0).cast("long")
    top = root.select(F.lit(ROOT[0]).cast("long").alias("high"), F.lit(ROOT[1]).cast("long").alias("low"), "n_convs", "conv_id", none.alias("depth"), none.alias("chars"))
    known = below.select(*top.columns).unionByName(top).join(children, DIGEST, "left").withColumn("n_children", F.coalesce("n_children", none))
    known = written(known, "trie-known")
    sums = subtree_sums(known.where("depth > 0"), all_paths, sizes)
    return (
        known.join(sums, DIGEST, "left")
        .join(end_digests(everyone, all_paths, sizes), DIGEST, "left")
        .join(_parents(below, root), DIGEST, "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
            # A root without children is its own only leaf.
            F.greatest(F.coalesce("n_leaves", none), F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")).alias("n_leaves"),
            F.coalesce("saved_tokens", none).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        )
    )
