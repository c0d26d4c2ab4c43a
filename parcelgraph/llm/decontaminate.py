"""Benchmark decontamination.

A document leaks an item if one of its item-sized windows has a weighted shingle
similarity of at least ``PERCENT``: the sum of the lesser over the sum of the
greater counts of each shingle of ``SHINGLE`` words.  All steps are DataFrame
operations:

1. Windows.  A similar window shares a shingle with the item, even one of the few
   with the least hashes whose counts make up just over ``100 - PERCENT`` percent
   of the item; those few are looked up in all documents, and every item-sized
   window that holds a meeting place is a candidate, wherever the item has the
   shingle.  Overlapping ranges of starts are merged before windows are made.
2. Each window gets a 64-bit SimHash.  Windows and items of one length are
   compared by multi-index hashing: fingerprints within ``RADIUS`` bits agree, in
   one of eight blocks of eight bits, but for ``RADIUS // 8`` bits, so the index
   holds each item's blocks with all changes of up to that many bits, and finds
   every fingerprint within the radius.
3. What is left is verified on exact counts.

Two texts at similarity 0.75 differ in 11 of 64 bits on average (deviation 3);
``RADIUS`` 23 is four deviations above.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from parcelgraph.llm.shared import GAP, drop, written

SHINGLE = 5
PERCENT = 75
RADIUS = 23
BLOCKS, BLOCK_BITS = 8, 8
#: Rows up to which a table made from the benchmark, or a list of texts, is broadcast; 64 bytes each at most.
BROADCAST_ROWS = 500_000
#: Windows that are cut from one piece of a text.
PIECE = 128
_SPACE = " \t\n\x0b\x0c\r"


def _small(df: DataFrame) -> DataFrame:
    """Broadcast if it has few rows; a shuffled join otherwise."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _words(text: Column) -> Column:
    """Hashes of the lower-cased words; empty for null."""
    plain = F.btrim(F.coalesce(F.lower(text), F.lit("")), F.lit(_SPACE))
    return F.when(plain == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(plain, GAP), lambda w: F.xxhash64(w)))


def _shingles(words: Column, k: int) -> Column:
    """Hashes of the runs of ``k`` words, or of the whole where there are fewer."""
    n = F.size(words)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, k)))
    return F.when(n > 0, runs).otherwise(F.array().cast("array<bigint>"))


def _text_key(text: Column) -> Column:
    return F.struct(F.xxhash64(text).alias("hash"), F.crc32(text).alias("crc"))


def _simhash(counted: DataFrame, key: list[str]) -> DataFrame:
    """A 64-bit fingerprint of each group of (h, c), and the sum of its counts."""
    sums = [F.sum(F.when(F.shiftright("h", b).bitwiseAND(F.lit(1)) == 1, F.col("c")).otherwise(-F.col("c"))).alias(f"b{b}") for b in range(64)]
    bits = [F.when(F.col(f"b{b}") > 0, F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(F.lit(0)) for b in range(64)]
    total = bits[0].cast("bigint")
    for x in bits[1:]:
        total = total.bitwiseOR(x.cast("bigint"))
    return counted.groupBy(*key).agg(*sums, F.sum("c").alias("total")).select(*key, "total", total.alias("print"))


def _block(value: Column, b: int) -> Column:
    return F.shiftright(value, BLOCK_BITS * b).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")


def _blocks(df: DataFrame, masks: list[int]) -> DataFrame:
    """A row per block and mask, with the block's bits changed by the mask."""
    own = F.array(*(F.struct(F.lit(b).alias("block"), _block(F.col("print"), b).alias("bits")) for b in range(BLOCKS)))
    return df.withColumn("own", F.explode(own)).withColumn("mask", F.explode(F.array(*map(F.lit, masks)))).select("*", F.col("own.block").alias("block"), F.col("own.bits").bitwiseXOR(F.col("mask")).alias("bits")).drop("own", "mask")


def _merged(ranges: DataFrame, key: list[str]) -> DataFrame:
    """Ranges ``low`` to ``high`` of each key, those that overlap or touch made one."""
    order = Window.partitionBy(*key).orderBy("low", "high")
    apart = F.col("low") > F.coalesce(F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-2)) + 1
    run = F.sum(F.col("apart").cast("int")).over(order)
    return ranges.withColumn("apart", apart).withColumn("run", run).groupBy(*key, "run").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("run")


def leaks_by_text(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """text_key, item_id, start, n_words, similarity, hamming: each text's best window for each item (an id with a text) that it leaks."""
    named = benchmark.select("item_id", _words(F.col("text")).alias("w")).filter(F.size("w") > 0).distinct()
    named = written(named.select("item_id", "w", F.size("w").alias("m"), F.least(F.size("w"), F.lit(SHINGLE)).alias("k"), F.struct(F.xxhash64("w").alias("hash"), F.size("w").alias("m")).alias("item")))
    items = named.select("item", "w", "m", "k").dropDuplicates(["item"])  # a text is one item, whatever its ids
    sizes = [r["k"] for r in items.select("k").distinct().collect()]  # five at most
    shingled = F.coalesce(*(F.when(F.col("k") == k, _shingles(F.col("w"), k)) for k in range(1, SHINGLE + 1)))
    counted = written(items.select("item", "m", "k", F.explode(shingled).alias("h")).groupBy("item", "m", "k", "h").agg(F.count("*").alias("c")))
    before = F.sum("c").over(Window.partitionBy("item").orderBy("h").rowsBetween(Window.unboundedPreceding, -1))
    whole = F.sum("c").over(Window.partitionBy("item"))
    few = counted.withColumns({"before": F.coalesce(before, F.lit(0)), "whole": whole}).filter(100 * F.col("before") <= (100 - PERCENT) * F.col("whole"))
    few = few.select("m", "k", "h").distinct()
    prints = written(_simhash(counted, ["item", "m", "k"]))

    texts = docs.filter("text IS NOT NULL").select(_text_key(F.col("text")).alias("text_key"), _words(F.col("text")).alias("w"))
    met = None
    for k in sizes:
        places = texts.select("text_key", F.size("w").alias("n"), F.posexplode(_shingles(F.col("w"), k)).alias("p", "h"))
        own = places.join(_small(few.filter(F.col("k") == k).drop("k")), "h")
        low, high = F.greatest(F.lit(0), F.col("p") - F.col("m") + k), F.least(F.col("p"), F.greatest(F.lit(0), F.col("n") - F.col("m")))
        own = own.select("text_key", F.lit(k).alias("k"), "m", low.alias("low"), high.alias("high"))
        met = own if met is None else met.unionByName(own)
    if met is None:
        met = docs.sparkSession.createDataFrame([], "text_key struct<hash:bigint,crc:bigint>, k int, m int, low int, high int")
    met = written(_merged(met.distinct(), ["text_key", "k", "m"]))

    keys = _small(met.select(F.col("text_key").alias("met_key")).distinct())
    chosen = docs.filter("text IS NOT NULL").select(_text_key(F.col("text")).alias("text_key"), "text").join(keys, F.col("text_key") == F.col("met_key"), "left_semi").dropDuplicates(["text_key"])
    chosen = chosen.select("text_key", _words(F.col("text")).alias("w"))
    piece = ["text_key", "k", "m", "at"]
    pieces = chosen.join(met.select("text_key", "k", "m", "high", F.explode(F.sequence("low", "high", F.lit(PIECE))).alias("at")), "text_key")
    pieces = pieces.withColumn("more", F.least(F.col("high") - F.col("at"), F.lit(PIECE - 1))).select(*piece, "more", F.expr("slice(w, at + 1, more + m)").alias("w"))
    pieces = written(pieces.select(*piece, "more", shingled.alias("s")).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *piece))
    window = [*piece, "start"]
    own = F.explode(F.expr("slice(s, start - at + 1, m - k + 1)")).alias("h")
    parts = pieces.withColumn("start", F.explode(F.expr("sequence(at, at + more)"))).select(*window, own)
    marked = written(_simhash(parts.withColumn("c", F.lit(1)), window))

    masks = [sum(1 << b for b in chosen_bits) for n in range(RADIUS // BLOCKS + 1) for chosen_bits in combinations(range(BLOCK_BITS), n)]
    index = _blocks(prints.withColumnRenamed("total", "item_total"), masks).withColumnRenamed("print", "item_print")
    found = _blocks(marked, [0]).join(_small(index), ["m", "k", "block", "bits"])
    hamming = F.bit_count(F.col("print").bitwiseXOR(F.col("item_print")))
    found = found.withColumn("hamming", hamming).filter(F.col("hamming") <= RADIUS).select(*window, "item", "total", "item_total", "hamming").distinct()
    pair = [*window, "item", "total", "item_total", "hamming"]
    both = found.join(pieces, piece).select(*pair, own).join(_small(counted.select("item", "h", F.col("c").alias("item_c"))), ["item", "h"])
    both = both.groupBy(*pair, "h", "item_c").agg(F.count("*").alias("c")).groupBy(*pair).agg(F.sum(F.least("c", "item_c")).alias("inter"))
    union = F.col("total") + F.col("item_total") - F.col("inter")
    both = both.filter(100 * F.col("inter") >= PERCENT * union).withColumn("similarity", F.col("inter") / union)
    best = F.max_by(F.struct("start", F.col("m").alias("n_words"), "similarity", "hamming"), F.struct("similarity", -F.col("start")))
    both = both.groupBy("text_key", "item").agg(best.alias("best"))
    out = written(both.join(_small(named.select("item_id", "item")), "item").select("text_key", "item_id", "best.*"))
    drop(named, counted, prints, met, pieces, marked)
    return out


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start, n_words, similarity, hamming: a row for each row of ``docs`` and each item that it leaks, with its best window.

    Words are split at ASCII white space and lower-cased.  Null, empty and wordless
    texts and items match nothing; an item of fewer than five words is its only
    shingle; a document shorter than an item is one window.  Copies of a text are
    worked on once, and each gets its rows.  An item is an id with a text: items with
    one text are told apart by their ids, different texts under one id are items of
    their own with a row each, and a null id is an id like any other.
    """
    found = leaks_by_text(docs, benchmark)
    named = docs.filter("text IS NOT NULL").select("doc_id", _text_key(F.col("text")).alias("text_key"))
    return named.join(found, "text_key").drop("text_key")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that leak no item; its other columns may have any names."""
    found = leaks_by_text(docs, benchmark).select("text_key").distinct()
    rows = docs.select(F.struct("*").alias("row"), _text_key(F.coalesce(F.col("text"), F.lit(""))).alias("text_key"))
    return rows.join(_small(found), "text_key", "left_anti").select("row.*")
