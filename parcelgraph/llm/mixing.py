"""Mixing sources to target weights.

Every source's documents form a stream in hashed order, repeated once.  The
stream is cut into blocks of about ``block_words`` words, and the mix takes the
blocks in front of each source's target.  A splitting tree deals them to the
output shards: its root has each source's number of taken blocks as quotas, and at
each node the left child draws its share of the node's blocks without
replacement, so its quotas by source are a multivariate hypergeometric draw and
the right child has the rest.  The leaves' quotas cut each source's permuted
blocks into disjoint runs, one for each shard, and a shard's documents are then
shuffled locally.

All of it is DataFrame operations.  A draw takes the least of random keys, one for
each block that a node still has, so no node's quotas are ever gathered.
Positions come from prefix sums in two levels (chunks of a source, then rows of a
chunk; parts of a node, then blocks of a part), so that no task holds a whole
source or node.  The tree's tables have about ``BLOCKS`` rows, at most two more
for each source, whatever the corpus.  Everything is planned on keys; a block is a
range of hashes, by which a document finds its shards, so that texts are shuffled
once, to their shards.

Documents are taken whole.  Rows equal in doc_id, source and text stay together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelgraph.llm.shared import WORD, n_words, small, written

#: Weights by the rank of a source, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: Words of the mix over words of the input.
SHARE = 1.5
#: Most times that a document may be taken.
EPOCHS = 2
#: Output shards.
SHARDS = 16
#: Least number of chunks of a source's stream for the two-level prefix sums, and rows of a chunk where that gives more.
CHUNKS, CHUNK_ROWS = 4096, 20_000
#: Blocks of the whole mix, as far as sizes of documents allow.
BLOCKS = 1 << 16
#: Parts of a node or of a source's blocks for ranks in two levels.
PARTS = 256
#: Bytes of text in a task that shuffles a part of a shard.
PART_BYTES = 16_000_000
#: Rows up to which tables of blocks and of their ranges of hashes (60 bytes each) are broadcast.
BROADCAST_ROWS = 400_000


def _key_of(source: Column) -> Column:
    """A source as text that is never null."""
    return F.when(source.isNull(), "-").otherwise(F.concat(F.lit("="), source.cast("string")))


def _order() -> Column:
    return F.xxhash64(F.lit("mix"), "doc_id", "source", F.xxhash64("text"))


def _chunk(n: int) -> Column:
    return F.pmod(F.shiftrightunsigned("order", 24), F.lit(n)).cast("int")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, source_key (never null), size in words, bytes, and a hashed order that reruns share."""
    size_of = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", _key_of(F.col("source")).alias("source_key"), n_words(F.col("text")).alias("size"), size_of.alias("bytes"), _order().alias("order"))


def targets(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """One row per source: source, source_size, weight, target.

    A target is ``min(EPOCHS * source_size, level * weight)`` where the one
    ``level`` makes the targets sum to ``share`` of all words: with sources in
    the order of capacity per weight, it is the first at which the next source
    isn't capped.  Sources without words have target 0.
    """
    sources = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(rank) - 1) % len(weights) + 1).cast("int"))
    capacity = F.col("source_size") * float(EPOCHS)
    by = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    after = by.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("capacity").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    return (
        sources.withColumn("weight", w)
        .withColumn("capacity", capacity)
        .withColumn("ratio", F.col("capacity") / F.col("weight"))
        .withColumn("own", level)
        .withColumn("level", F.max(F.when(F.col("own") <= F.col("ratio"), F.col("own"))).over(everything))
        .select("source", "source_size", "weight", F.coalesce(F.least("capacity", F.col("level") * F.col("weight")), F.col("capacity")).alias("target"))
    )


def plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """Per document: the columns of ``sized``, source_size, target, chunk, start (words of its source's stream before it), and words taken in each epoch.

    The document across a target is taken or left out by whichever total is nearer,
    so the taken words differ from the target by half of it at most.
    """
    keys = written(sized(docs))
    n = max(CHUNKS, keys.count() // CHUNK_ROWS)
    keys = keys.withColumn("chunk", _chunk(n))
    sums = keys.groupBy("source_key", "chunk").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source_key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source_key", "chunk", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("chunk_start"))
    goal = targets(keys, weights, share).select(_key_of(F.col("source")).alias("source_key"), "source_size", "target")
    by_order = Window.partitionBy("source_key", "chunk").orderBy("order")
    first = F.coalesce(F.sum("size").over(by_order.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    upto = F.sum("size").over(by_order.rangeBetween(Window.unboundedPreceding, 0))  # with all rows of the same order
    rows = keys.withColumns({"first": first, "together": upto - first}).join(starts.join(goal, "source_key"), ["source_key", "chunk"])
    rows = rows.withColumn("start", F.col("chunk_start") + F.col("first"))
    in_epoch = lambda e: F.when(2 * (F.round("target").cast("long") - F.col("start") - F.col("source_size") * e) >= F.col("together"), F.col("size")).otherwise(F.lit(0))
    return rows.withColumn("taken", F.array(*map(in_epoch, range(EPOCHS)))).drop("first", "together", "chunk_start")


def draws(planned: DataFrame, block_count: int = BLOCKS) -> DataFrame:
    """A row per document and epoch in which the mix takes it, with its block; a document belongs to the block in which it starts."""
    total = planned.agg(F.sum(F.aggregate("taken", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    block_words = max(1, total // block_count)
    one = planned.select("*", F.posexplode("taken").alias("epoch", "words")).filter("words > 0")
    return one.withColumn("block", F.floor(F.col("start") / block_words)).drop("taken")


def _ranked(rows: DataFrame, group: str, key: Column, *ties: str) -> DataFrame:
    """Adds ``rank``, from 0 by ``key`` and then ``ties`` among the rows of one ``group``, and ``total``, how many those are."""
    rows = rows.withColumn("draw", key).withColumn("part", F.pmod(F.shiftrightunsigned("draw", 40), F.lit(PARTS)).cast("int"))
    sums = rows.groupBy(group, "part").agg(F.count("*").alias("n"))
    all_parts = Window.partitionBy(group)
    sums = sums.select(group, "part", F.coalesce(F.sum("n").over(all_parts.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(all_parts).alias("total"))
    inner = F.row_number().over(Window.partitionBy(group, "part").orderBy("draw", *ties)) - 1
    return rows.withColumn("inner", inner).join(sums, [group, "part"]).withColumn("rank", F.col("before") + F.col("inner")).drop("draw", "part", "inner", "before")


def splitting_tree(quotas: DataFrame, shards: int = SHARDS) -> list[tuple[dict[int, int], DataFrame]]:
    """The levels of the tree from ``quotas`` (source_key, quota), root first: how many shards each node has, and node, source_key, quota.

    Node ``n`` has the children ``2n`` and ``2n + 1``.  A node with ``k`` shards
    gives its left child ``k // 2`` of them and that part of its blocks, rounded down: as many
    blocks as have the least random keys.  Children's quotas add up to their parent's.
    """
    width = {1: shards}
    levels = [(width, written(quotas.select(F.lit(1).alias("node"), "source_key", "quota")))]
    while max(width.values()) > 1:
        split = {n: k for n, k in width.items() if k > 1}
        table = levels[-1][1]
        blocks = table.filter(F.col("node").isin(*split)).select("node", "source_key", F.explode(F.sequence(F.lit(1).cast("long"), "quota")).alias("nth"))
        drawn = _ranked(blocks, "node", F.xxhash64(F.lit("draw"), "node", "source_key", "nth"), "source_key", "nth")
        own = lambda f: F.coalesce(*(F.when(F.col("node") == n, F.lit(f(k))) for n, k in split.items()))  # noqa: E731, B023
        left = F.col("rank") < F.floor(F.col("total") * own(lambda k: k // 2) / own(lambda k: k))
        child = drawn.select((2 * F.col("node") + F.when(left, 0).otherwise(1)).alias("node"), "source_key").groupBy("node", "source_key").agg(F.count("*").alias("quota"))
        width = {n: k for n, k in width.items() if k == 1} | {2 * n + side: (k - k // 2 if side else k // 2) for n, k in split.items() for side in (0, 1)}
        levels.append((width, written(child.unionByName(table.filter(~F.col("node").isin(*split))))))
    return levels


def blocks(draws: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The taken blocks: source_key, epoch, block, rank in the source's permutation, and the shard whose quota has that rank."""
    found = draws.groupBy("source_key", "epoch", "block").agg(F.sum("words").alias("words"))
    found = written(_ranked(found, "source_key", F.xxhash64(F.lit("block"), "source_key", "epoch", "block"), "epoch", "block"))
    width, leaves = splitting_tree(found.groupBy("source_key").agg(F.count("*").alias("quota")), shards)[-1]
    number = {n: i for i, n in enumerate(sorted(width, key=lambda n: f"{n:b}"))}
    leaves = leaves.withColumn("shard", F.coalesce(*(F.when(F.col("node") == n, F.lit(i)) for n, i in number.items())))
    upto = F.sum("quota").over(Window.partitionBy("source_key").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
    runs = leaves.withColumn("upto", upto).select("source_key", "shard", F.explode(F.sequence(F.col("upto") - F.col("quota"), F.col("upto") - 1)).alias("rank"))
    return written(found.join(runs, ["source_key", "rank"]).select("source_key", "epoch", "block", "words", "rank", "shard"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """(plan, draws with their shard).

    Rows of ``docs`` with null or empty text have size 0 and are never drawn;
    null is a source like any other; repeated rows are documents of their own.  An
    empty table gives empty tables.  Only doc_id, source and text are read.
    """
    planned = written(plan(docs, weights, share))
    drawn = draws(planned)
    leaf = blocks(drawn, shards).select("source_key", "epoch", "block", "shard")
    return planned, drawn.join(small(leaf, BROADCAST_ROWS), ["source_key", "epoch", "block"])


def shuffled_shards(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, shards: int = SHARDS) -> DataFrame:
    """The mix by shard: shard, local_order, and the document as the struct ``row``, a row for each time that it is taken.

    A shard's documents stand in the order of ``local_order``, a hash, in each of the
    partitions that hold a part of the shard.
    """
    planned, drawn = mix(docs, weights, share, shards)
    key = ["source_key", "chunk", "epoch", "block", "shard"]
    ranges = written(drawn.groupBy(*key).agg(F.min("order").alias("low"), F.max("order").alias("high")).drop("block"))
    n = max(CHUNKS, planned.count() // CHUNK_ROWS)
    rows = docs.filter(F.col("text").rlike(WORD)).select(_key_of(F.col("source")).alias("source_key"), _order().alias("order"), F.struct("*").alias("row")).withColumn("chunk", _chunk(n))
    rows = rows.join(small(ranges, BROADCAST_ROWS), ["source_key", "chunk"]).filter(F.col("order").between(F.col("low"), F.col("high")))
    size = planned.agg(F.sum(F.col("bytes") * F.size(F.filter("taken", lambda x: x > 0)))).first()[0] or 0
    each = max(1, -(-size // (shards * PART_BYTES)))
    rows = rows.select("shard", F.xxhash64(F.lit("local"), "shard", "epoch", "order").alias("local_order"), "row")
    part = F.col("shard") * each + F.pmod(F.shiftrightunsigned("local_order", 40), F.lit(each)).cast("int")
    return rows.repartitionById(shards * each, part).sortWithinPartitions("shard", "local_order")


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, shards: int = SHARDS) -> DataFrame:
    """The mix itself: the columns of ``docs``, a row for each time that a document is taken, shard by shard in their local order."""
    return shuffled_shards(docs, weights, share, shards).select("row.*")


def per_document(planned: DataFrame, drawn: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken and the shards that hold the document; a row per document of the plan."""
    key = ["source_key", "chunk", "order"]
    some = drawn.groupBy(*key, "epoch").agg(F.max("words").alias("words"), F.max("shard").alias("shard"))  # rows of one order share their shards
    some = some.groupBy(*key).agg(F.sum("words").alias("words"), F.sort_array(F.collect_list("shard")).alias("shards"))  # EPOCHS shards at most
    return planned.join(some, key, "left").select("doc_id", "size", "source_size", "target", F.coalesce("words", F.lit(0)).alias("taken"), F.concat_ws(",", "shards").alias("shards"))
