"""The prefix trie of conversations, encoded as balanced parentheses shard by shard.

Conversations are sorted by their turns' codes and dealt out in ranges, so that a
shard's trie is a stretch of the whole one, and neighbouring shards share no more
than the paths on which both lie: these spines merge.  Within a shard the trie is a
sequence of parentheses in preorder.  The close of a parenthesis, found by a tree
of the least excess of each block, delimits a subtree; the rank of pairs ``()``
counts its leaves, and sums over preorder give what it saves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelgraph.llm.shared import drop, parts, written

#: Conversations of a family begin with the first turns of its first one: ids of one family have one multiple of FAMILY below them.
FAMILY, MOST_SHARED = 100, 6
#: Turns of a shard; its arrays take some 200 bytes for each.
SHARD_TURNS = 400_000
#: Ids of a row on their way to a digest.
IDS_A_ROW = 1000
#: Parentheses of a block.
BLOCK = 64
CODE_BYTES = 16
NO_ENDS = hashlib.sha256(b"").hexdigest()

_SCHEMA = "kind string, shard int, conv_id long, depth long, parent_conv_id long, key binary, parent_key binary, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, chunk long, ids array<long>"


def close_of(bits: np.ndarray) -> np.ndarray:
    """The place of the closing parenthesis of each opening one (True), in order.

    A close is the first later place whose excess is below its open's.  It is
    sought in the open's block, then up and down a tree of the least excess of
    blocks, then in the block found: all opens a step at a time.
    """
    excess = np.cumsum(np.where(bits, 1, -1).astype(np.int64))
    n_blocks = 1 << max(0, (-(-len(bits) // BLOCK) - 1).bit_length())
    padded = np.full(n_blocks * BLOCK, -1, np.int64)
    padded[: len(bits)] = excess
    tree = [padded.reshape(n_blocks, BLOCK).min(axis=1)]
    while len(tree[-1]) > 1:
        tree.append(np.minimum(tree[-1][::2], tree[-1][1::2]))
    opens = np.flatnonzero(bits)
    below, found = excess[opens] - 1, np.full(len(opens), -1, np.int64)

    def scan(which: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Looks from ``at`` to the ends of blocks; gives those not found and the block behind theirs."""
        left, behind = [], []
        while len(which):
            hit = (at % BLOCK != 0) | (at == start[which])
            left.append(which[~hit])
            behind.append(at[~hit] // BLOCK)
            which, at = which[hit], at[hit]
            good = padded[at] <= below[which]
            found[which[good]] = at[good]
            which, at = which[~good], at[~good] + 1
        return np.concatenate([*left, which]), np.concatenate([*behind, at // BLOCK])

    start = opens + 1
    at_block_end = start % BLOCK == 0  # the next place is in the next block
    everything = np.arange(len(opens))
    start[at_block_end] = -1
    which, block = scan(everything, opens + 1)
    level, where = np.zeros(len(which), np.int64), block
    done = np.zeros(len(which), bool)
    for k, least in enumerate(tree):  # up: the blocks before ``where`` are out
        odd = ~done & (where % 2 == 1)
        here = ~done & (where < len(least))
        hit = here & (least[np.minimum(where, len(least) - 1)] <= below[which]) & (odd | (len(least) == 1))
        done |= hit
        level[hit] = k
        where = np.where(done, where, (where + 1) // 2)
    for k in range(len(tree) - 1, 0, -1):  # down: to the left wherever it is low enough
        now = level == k
        child = where[now] * 2
        where[now] = np.where(tree[k - 1][child] <= below[which[now]], child, child + 1)
        level[now] = k - 1
    start[which] = where * BLOCK
    scan(which, where * BLOCK)
    return found


def _shared_turns(a: bytes, b: bytes) -> int:
    """With how many equal turns two paths begin."""
    low, high = 0, min(len(a), len(b)) // CODE_BYTES
    while low < high:
        middle = (low + high + 1) // 2
        if a[low * CODE_BYTES : middle * CODE_BYTES] == b[low * CODE_BYTES : middle * CODE_BYTES]:
            low = middle
        else:
            high = middle - 1
    return low


def _keys(path: bytes, depth: int) -> list[bytes]:
    """A name for each prefix of a path, from the root to ``depth``."""
    h, out = hashlib.sha256(), []
    for d in range(depth + 1):
        out.append(h.copy().digest()[:CODE_BYTES])
        h.update(path[d * CODE_BYTES : (d + 1) * CODE_BYTES])
    return out


def _digest(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def shard_nodes(shard: int, ids: list[int], paths: list[bytes], chars: list[list[int]], before: bytes | None, after: bytes | None) -> pa.Table:
    """The nodes of a shard's conversations; ``before`` and ``after`` are the last path of the shard before and the first of the one behind, null at the ends.

    Nodes that other shards have too come as parts (kind ``shared``, with a key),
    which add up: what a node counts once is counted where it first occurs, and an
    end is a leaf where its last copy stands.
    """
    order = sorted(range(len(ids)), key=lambda k: (paths[k], ids[k]))
    ids, paths, chars = [ids[k] for k in order], [paths[k] for k in order], [chars[k] for k in order]
    n = len(ids)
    depth, parent, weight, first_conv, runs, stack, ends, previous = [0], [-1], [0], [0], [1], [0], [], b""
    left_spine: list[int] = []
    for i, path in enumerate(paths):
        size, same = len(path) // CODE_BYTES, _shared_turns(previous, path)
        runs += [len(stack) - 1 - same, size - same]
        del stack[same + 1 :]
        for d in range(same, size):
            parent.append(stack[-1])
            stack.append(len(depth))
            depth.append(d + 1)
            weight.append(chars[i][d])
            first_conv.append(i)
        ends.append(stack[-1])
        previous = path
        left_spine = left_spine or list(stack)
    runs.append(len(stack))
    right_spine = stack

    bits = np.repeat(np.tile([True, False], n + 1), runs)
    opens = np.flatnonzero(bits)
    stop = np.searchsorted(opens, close_of(bits))  # the first node behind each subtree
    nodes = np.arange(len(opens))
    begin = np.array([*first_conv, n])
    n_convs = begin[stop] - begin[nodes]
    once = np.ones(len(opens), np.int64)  # 0 for what an earlier shard counts
    shared_left = left_spine[: _shared_turns(before, paths[0]) + 1] if before is not None else []
    shared_right = right_spine[: _shared_turns(after, paths[-1]) + 1] if after is not None else []
    once[shared_left] = 0
    leaf = (~bits[opens + 1]).astype(np.int64)
    if after is not None and after[: len(paths[-1])] == paths[-1]:
        leaf[ends[-1]] = 0
    total = lambda x: np.concatenate([[0], np.cumsum(x)])
    leaves, saved = total(leaf), total((n_convs - once) * np.array(weight))
    children = np.bincount(np.array(parent[1:], np.int64), weights=once[1:], minlength=len(opens)).astype(np.int64)
    of = np.array([*ids, np.iinfo(np.int64).max])
    least = np.minimum.reduceat(of, np.stack([begin[nodes], begin[stop]], axis=1).ravel())[::2]

    at, from_, counts = np.unique(np.array(ends), return_index=True, return_counts=True)
    ends_of = {int(a): ids[f : f + c] for a, f, c in zip(at, from_, counts, strict=True)}
    key = dict(zip(shared_left, _keys(paths[0], len(shared_left) - 1), strict=True)) | dict(zip(shared_right, _keys(paths[-1], len(shared_right) - 1), strict=True))
    local = np.array([k not in key for k in range(len(opens))])
    up = np.maximum(np.array(parent), 0)
    rows = {
        "kind": np.where(local, "node", "shared"), "shard": np.full(len(opens), shard), "conv_id": least, "depth": depth,
        "parent_conv_id": pa.array(least[up], mask=(np.array(parent) < 0) | ~local[up]), "key": pa.array([key.get(k) for k in range(len(opens))], pa.binary()),
        "parent_key": pa.array([key.get(k) for k in parent], pa.binary()), "n_convs": n_convs, "n_children": children, "n_leaves": leaves[stop] - leaves[nodes], "saved_tokens": saved[stop] - saved[nodes],
        "ends_sha256": [_digest(ends_of[k]) if k in ends_of else NO_ENDS for k in range(len(opens))], "chunk": pa.nulls(len(opens), pa.int64()), "ids": pa.nulls(len(opens), pa.list_(pa.int64())),
    }
    chunks = [(key[k], c, ends_of[k][c : c + IDS_A_ROW]) for k in sorted(key) if k in ends_of for c in range(0, len(ends_of[k]), IDS_A_ROW)]
    table = pa.table(rows).cast(_arrow())
    more = pa.table({"kind": ["ends"] * len(chunks), "shard": [shard] * len(chunks), "key": pa.array([c[0] for c in chunks], pa.binary()), "chunk": [c[1] for c in chunks], "ids": pa.array([c[2] for c in chunks], pa.list_(pa.int64()))})
    empty = {f.name: pa.nulls(len(chunks), f.type) for f in _arrow()}
    return pa.concat_tables([table, pa.table(empty | {c: more[c].cast(_arrow().field(c).type) for c in more.column_names}, schema=_arrow())])


def _arrow() -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split(" ") for field in _SCHEMA.split(", "))])


def rebuilt_conversations(conversations: DataFrame, family: int = FAMILY, most_shared: int = MOST_SHARED) -> DataFrame:
    """conv_id, codes array<binary>, chars array<int>: each conversation as the first h turns of its family's first one, then its own without its first h; h is crc32 of its id by ``most_shared``.

    Codes are 128-bit hashes of role and text, chars the text's code points.  Turns
    stand in order of turn, nulls first, those of one turn by their codes; null
    roles and texts are empty.  Rows without a conv_id are left out.  A conversation
    is a row of 20 bytes a turn.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    code = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * CODE_BYTES))
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", code.alias("code"), F.length(text).alias("chars"))
    rows = rows.withColumn("family", F.col("conv_id") - F.col("conv_id") % family)
    listed = F.sort_array(F.collect_list(F.struct("turn", "code", "chars")))
    turns = rows.groupBy("family", "conv_id").agg(listed.alias("turns"))
    heads = turns.filter("conv_id = family").select("family", F.slice("turns", 1, most_shared - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % most_shared).cast("int")
    none = F.expr("slice(turns, 1, 0)")
    own = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    all_ = turns.join(heads, "family", "left").select("conv_id", F.concat(F.slice(F.coalesce("head", none), F.lit(1), h), own).alias("turns"))
    return all_.select("conv_id", F.col("turns.code").alias("codes"), F.col("turns.chars").alias("chars"))


def _merged_digests(ends: DataFrame) -> DataFrame:
    """key, ends_sha256 of rows (key, shard, chunk, ids): the ids of a key pass one task in order, a batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, hashlib.sha256()
        done = lambda: pa.RecordBatch.from_pydict({"key": pa.array([key], pa.binary()), "ends_sha256": [state.hexdigest()]})
        for b in batches:
            for k, ids in zip(b.column("key").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if k != key and key is not None:
                    yield done()
                state = state if k == key else hashlib.sha256()
                state.update((("," if k == key else "") + ",".join(map(str, ids))).encode())
                key = k
        if key is not None:
            yield done()

    rows = ends.select("key", "shard", "chunk", "ids").repartition("key").sortWithinPartitions("key", "shard", "chunk")
    return rows.mapInArrow(run, "key binary, ends_sha256 string")


def trie_nodes(rebuilt: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """A row per node of the trie of (conv_id, codes, chars), each id there once: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Equal sequences are one path, with all their ids at its end.  No conversations
    give no nodes; one without turns ends at the root.  However many conversations
    share a path, they are dealt to as many shards as their turns need.
    """
    spark = rebuilt.sparkSession
    rebuilt = written(rebuilt)
    turns = rebuilt.agg(F.sum(F.size("codes") + 1)).first()[0] or 0
    ranges = rebuilt.repartitionByRange(parts(spark, turns, shard_turns), "codes", "conv_id")
    shards = written(ranges.select(F.spark_partition_id().alias("shard"), "conv_id", "codes", "chars"))
    ends = written(shards.groupBy("shard").agg(F.min("codes").alias("first"), F.max("codes").alias("last")))
    beside = ends.select("shard", F.lag("shard").over(Window.orderBy("shard")).alias("left"), F.lead("shard").over(Window.orderBy("shard")).alias("right"))  # numbers of shards
    last, first = ends.select(F.col("shard").alias("left"), F.col("last").alias("before")), ends.select(F.col("shard").alias("right"), F.col("first").alias("after"))
    neighbours = beside.join(last, "left", "left").join(first, "right", "left").select("shard", "before", "after")

    def run(rows: pa.Table, near: pa.Table) -> pa.Table:
        codes = [b"".join(c) for c in rows["codes"].to_pylist()]
        before, after = (None if c is None else b"".join(c) for c in (near["before"][0].as_py(), near["after"][0].as_py()))
        return shard_nodes(rows["shard"][0].as_py(), rows["conv_id"].to_pylist(), codes, rows["chars"].to_pylist(), before, after)

    found = written(shards.groupBy("shard").cogroup(neighbours.groupBy("shard")).applyInArrow(run, _SCHEMA))
    counted = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    shared = found.filter("kind = 'shared'")
    merged = shared.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent_key").alias("parent_key"), *(F.sum(c).alias(c) for c in counted))
    digests = _merged_digests(found.filter("kind = 'ends'"))
    merged = written(merged.join(digests, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS))))
    id_of = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    columns = ["conv_id", "depth", "parent_conv_id", *counted, "ends_sha256"]
    spine = merged.join(id_of, "parent_key", "left").select(columns)
    below = found.filter("kind = 'node' AND parent_key IS NOT NULL").drop("parent_conv_id")
    near_spine = shared.select("shard", F.col("key").alias("parent_key")).join(id_of, "parent_key")  # by shard, so that no node's children are one group
    local = found.filter("kind = 'node' AND parent_key IS NULL").select(columns)
    drop(rebuilt, shards, ends)
    return local.unionByName(below.join(near_spine, ["shard", "parent_key"]).select(columns)).unionByName(spine)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of all rebuilt conversations of ``conversations`` (conv_id, turn, role, text; other columns are not read)."""
    return trie_nodes(rebuilt_conversations(conversations))
