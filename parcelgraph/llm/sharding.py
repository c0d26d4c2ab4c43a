"""Sharding by a k-d tree over metadata.

Each node of the tree is split along its widest dimension at a weighted median,
the weight being a row's bytes, until a leaf is one shard.  All nodes of a level
are split together.  A median is found by two histograms: one over the node's
range of the dimension, one over a hash of the rows in the bin where the median
lies, so ties (a source with a third of all rows) are divided too.  Histograms
are aggregated before they are shuffled and hold at most ``FINE_BINS`` rows a node;
only a level's cuts, fewer than there are shards, come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelgraph.llm.shared import written

SHARDS = 24
#: Bins of a histogram over a dimension, and of one over the hash of the rows in one of those bins.
BINS, FINE_BINS = 4096, 1 << 16
#: Parts of a shard for numbering its rows in two levels.
SLOT_PARTS = 256
DIMENSIONS = ("by_id", "by_source", "by_lang")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, dimensions scaled to 0..1, and a hash that breaks ties.

    Null texts count as empty.  Ids are scaled by their range, sources and
    languages by a hash of their names (equal names meet in one point); nulls lie at 0.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    named = lambda c: F.coalesce(F.pmod(F.xxhash64(c), F.lit(1 << 20)) / float(1 << 20), F.lit(0.0))
    tie = F.shiftrightunsigned(F.xxhash64(F.lit("tie"), "doc_id", F.xxhash64(text)), 1)
    base = written(docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), tie.alias("tie"), named("source").alias("by_source"), named("lang").alias("by_lang")))
    low, high = base.agg(F.min("doc_id"), F.max("doc_id")).first()
    spread = float((high or 0) - (low or 0)) or 1.0
    scaled = F.coalesce((F.col("doc_id") - F.lit(low or 0)) / spread, F.lit(0.0))
    return base.withColumn("by_id", scaled)


def _nodes(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    """A local table of a row per open node, of which there are fewer than shards; broadcast for that reason."""
    number = lambda x: f"{x!r}D" if isinstance(x, float) else str(int(x))
    values = ", ".join("(" + ", ".join(map(number, r)) + ")" for r in rows)
    return F.broadcast(spark.sql(f"SELECT * FROM VALUES {values} AS nodes({columns})"))


def _with_bins(rows: DataFrame, splits: list[tuple], how: str = "inner") -> DataFrame:
    """Joins each row with the split of its node, (node, dimension, low, high, goal), and bins it coarsely and, by its hash, finely."""
    value = F.element_at(F.array(*DIMENSIONS), F.col("dimension") + 1)
    width = F.when(F.col("high") > F.col("low"), F.col("high") - F.col("low")).otherwise(1.0)
    coarse = F.least(F.lit(BINS - 1), F.floor((value - F.col("low")) / width * BINS)).cast("int")
    fine = F.floor(F.col("tie") / float(1 << 63) * FINE_BINS).cast("int")
    return rows.join(_nodes(rows.sparkSession, "node, dimension, low, high, goal", splits), "node", how).withColumns({"coarse": coarse, "fine": fine})


def _cuts(binned: DataFrame, by: str) -> dict[int, tuple]:
    """For each node the first bin at which the weight reaches the node's goal: (bin, weight below it, its weight, goal)."""
    hist = binned.groupBy("node", by).agg(F.sum("size").alias("weight"), F.first("goal").alias("goal"))
    upto = Window.partitionBy("node").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    found = hist.withColumn("upto", F.sum("weight").over(upto)).filter("upto >= goal")
    rows = found.groupBy("node").agg(F.min_by(F.struct(by, F.expr("upto - weight"), "weight", "goal"), by).alias("cut")).collect()
    return {r["node"]: tuple(r["cut"]) for r in rows}


def kd_tree(rows: DataFrame, shards: int = SHARDS) -> tuple[DataFrame, dict[int, int]]:
    """The rows of ``measured`` with the ``node`` that is their leaf, and each leaf's shard, 0 to ``shards - 1``.

    A node with ``k`` shards gives ``k // 2`` of them, and that part of its bytes,
    to its left child.  A fine bin is about ``1 / FINE_BINS`` of a coarse one.
    """
    leaves = {1: shards}
    rows = rows.withColumn("node", F.lit(1))
    while open_nodes := {n: k for n, k in leaves.items() if k > 1}:
        extremes = [f(d).alias(f"{name}_{d}") for d in DIMENSIONS for name, f in (("low", F.min), ("high", F.max))]
        splits = []
        for r in rows.filter(F.col("node").isin(*open_nodes)).groupBy("node").agg(F.sum("size").alias("weight"), *extremes).collect():
            k = open_nodes[r["node"]]
            at = max(range(len(DIMENSIONS)), key=lambda i, r=r: r[f"high_{DIMENSIONS[i]}"] - r[f"low_{DIMENSIONS[i]}"])
            splits.append((r["node"], at, float(r[f"low_{DIMENSIONS[at]}"]), float(r[f"high_{DIMENSIONS[at]}"]), r["weight"] * (k // 2) / k))
        if splits:
            spark = rows.sparkSession
            coarse = _cuts(_with_bins(rows, splits), "coarse")
            inner = [(*s[:4], s[4] - float(coarse[s[0]][1])) for s in splits]
            fine = _cuts(_with_bins(rows, inner).join(_nodes(spark, "node, cut", [(n, c[0]) for n, c in coarse.items()]), "node").filter("coarse = cut"), "fine")
            # The cut goes before or after its last bin, whichever is nearer to the goal.
            cuts = [(n, c[0], fine[n][0] + (fine[n][3] - fine[n][1] > fine[n][2] / 2)) for n, c in coarse.items()]
            right = (F.col("coarse") > F.col("cut")) | ((F.col("coarse") == F.col("cut")) & (F.col("fine") >= F.col("fine_cut")))
            moved = _with_bins(rows, splits, "left").join(_nodes(spark, "node, cut, fine_cut", cuts), "node", "left")
            # A table per level keeps plans short; lost tasks are done again from it.
            rows = written(moved.withColumn("node", F.coalesce(2 * F.col("node") + right.cast("int"), F.col("node"))).select(*rows.columns))
        leaves = {n: k for n, k in leaves.items() if k == 1} | {2 * n + side: (k - k // 2 if side else k // 2) for n, k in open_nodes.items() for side in (0, 1)}
    return rows, {n: i for i, n in enumerate(sorted(leaves, key=lambda n: f"{n:b}"))}


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: this law has none), a row per row of ``docs``.

    The law is ``bytes``: shards hold nearly equal bytes.  Copies of a text are
    rows like others, so a text with a third of all rows is spread.  Slots number
    a shard's rows from 0 without gaps.  An empty table gives no rows.
    """
    rows, numbers = kd_tree(measured(docs), shards)
    placed = rows.withColumn("shard", F.coalesce(*(F.when(F.col("node") == n, F.lit(i)) for n, i in numbers.items())))
    placed = placed.withColumn("part", F.pmod(F.col("tie"), F.lit(SLOT_PARTS)).cast("int"))
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = F.broadcast(counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")))  # at most shards * SLOT_PARTS rows
    inner = F.row_number().over(Window.partitionBy("shard", "part").orderBy("tie", "doc_id", "text_crc32")) - 1
    return (
        placed.withColumn("inner", inner)
        .join(counts, ["shard", "part"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("inner")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
