"""Near-duplicate documents by MinHash.

Sketches come from fast similarity sketching: round ``i`` throws every shingle
into a hashed bin and keeps each bin's least ``(i, hash)``; rounds go on until a
document has filled every bin, and from round ``COORDINATES`` on all shingles go
into one bin a round, so that no bin stays empty.  Two sketches agree in a bin
with the probability of their sets' similarity.

``BANDS`` bands of ``ROWS`` bins make the candidates: a pair at similarity 0.75
meets in none of them with probability 4e-6, and a pair at 0.3 meets in one with
0.05.  Documents with equal sets are one node from the start.  The members of a
band's bucket are compared with the one that meets most others, links are confirmed on the full
sets, and what remains in other components of a bucket is then compared with the
bucket's members unless that can't give a link: by the triangle inequality, by
traces (the bins of ``TRACE_BITS`` that a set's shingles fall in; each bin of one set
alone is a shingle of it alone, so similarity has an exact upper bound), or, for
two sets of at least ``TRACE_BITS`` shingles, which fill their traces so that these
say nothing, by an estimate below ``LEAST_ESTIMATE``, six deviations below a link.
Such a pair at similarity 0.75 falls short of that with probability 4e-9, a thousand
times more rarely than it meets in no band; smaller sets are left out by exact
bounds alone.  Copies are never expanded into pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelgraph.llm.components import connected_components
from parcelgraph.llm.shared import drop, written
from parcelgraph.llm.word_arrays import mix, shingle_sets, slices, split_words, text_buffers

SHINGLE = 5
#: A link: 100 * intersection >= PERCENT * union.
PERCENT = 75
ROWS = 6
BANDS = 64
COORDINATES = ROWS * BANDS
#: Bits of each bin that estimate a similarity, and the least estimate at which a pair of large sets beside the heads is
#: compared: at similarity 0.75 the estimate's deviation is 0.026.
BITS = 4
LEAST_ESTIMATE = 0.59
#: Bits of a set's trace.
TRACE_BITS = 1536
#: Most candidates whose keys are broadcast to find their texts; 24 bytes each.
BROADCAST_ROWS = 1_000_000

_U = np.uint64
_EMPTY = _U(0xFFFFFFFFFFFFFFFF)
_LOW = _U((1 << 40) - 1)
_SEEDS = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 63, 2 * COORDINATES, dtype=np.uint64)


def sketches(sets: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """One row of COORDINATES values per set; rows of empty sets stay all ones."""
    t = COORDINATES
    out = np.full((len(sets), t), _EMPTY, dtype=np.uint64)
    if not sizes.sum():
        return out
    flat = out.reshape(-1)
    values = np.concatenate(sets)
    base = np.repeat(np.arange(len(sets), dtype=np.int64) * t, sizes)
    for i in range(2 * t):
        h = mix(values ^ _SEEDS[i])
        at = base + (((h >> _U(40)) % _U(t)).astype(np.int64) if i < t else i - t)
        np.minimum.at(flat, at, (_U(i) << _U(40)) | (h & _LOW))
        open_rows = (out == _EMPTY).any(axis=1)
        open_rows &= sizes > 0
        if not open_rows.any():
            break
        keep = open_rows[base // t]
        values, base = values[keep], base[keep]
    return out


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """A 64-bit key per band; it holds the band's number."""
    rows = sketch.reshape(len(sketch), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), rows.shape[:2]).copy()
    for j in range(ROWS):
        key = mix(key * _U(31) + rows[:, :, j])
    return key.view(np.int64)


def estimate_bits(sketch: np.ndarray) -> np.ndarray:
    """BITS low bits of every bin, packed to 64-bit numbers: equal bins agree in all, others in half of them."""
    per = 64 // BITS
    low = (sketch & _U((1 << BITS) - 1)).reshape(len(sketch), COORDINATES // per, per)
    return np.bitwise_or.reduce(low << (np.arange(per, dtype=np.uint64) * _U(BITS)), axis=2).view(np.int64)


def traces(sets: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """A row of TRACE_BITS bits per set, packed to 64-bit numbers: the bins in which it has a shingle."""
    bits = np.zeros((len(sets), TRACE_BITS), dtype=bool)
    if sizes.sum():
        bits[np.repeat(np.arange(len(sets)), sizes), ((np.concatenate(sets) >> _U(24)) % _U(TRACE_BITS)).astype(np.int64)] = True
    return np.packbits(bits, axis=1, bitorder="little").view(np.int64)


def may_link(n: tuple[Column, Column], trace: tuple[Column, Column]) -> Column:
    """False only if two sets' sizes and traces rule a link out."""
    alone = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda t, b: t + b)
    most = F.least(n[0] - alone(*trace), n[1] - alone(*trace[::-1]))
    return 100 * most >= PERCENT * (n[0] + n[1] - most)


def _lists(values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32), values.reshape(-1))


def _sets_of(column: pa.Array) -> Iterator[tuple[int, int, list[np.ndarray], np.ndarray]]:
    data, offsets = text_buffers(column)
    for a, b in slices(offsets):
        yield a, b, *shingle_sets(split_words(data, offsets[a : b + 1], lower=True), SHINGLE)


def _print(values: np.ndarray) -> bytes | None:
    """128 bits that stand for a set."""
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest() if len(values) else None


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_shingles, set_key (null: empty set), band keys, estimate bits and trace of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, sets, sizes in _sets_of(batch.column("text")):
                sketch = sketches(sets, sizes)
                lists = [_lists(band_keys(sketch)), _lists(estimate_bits(sketch)), _lists(traces(sets, sizes))]
                columns = [batch.column("doc_id").slice(a, b - a), batch.column("text_key").slice(a, b - a), pa.array(sizes), pa.array([_print(x) for x in sets], pa.binary()), *lists]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "n_shingles", "set_key", "bands", "bits", "trace"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return rows.mapInArrow(run, "doc_id long, text_key long, n_shingles long, set_key binary, bands array<long>, bits array<long>, trace array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """set_key and its shingles' hashes for the documents of ``wanted`` (doc_id, text_key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, sets, _ in _sets_of(batch.column("text")):
                yield pa.RecordBatch.from_arrays([pa.array([_print(x) for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], ["set_key", "shingles"])

    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    wanted = wanted.select(F.col("doc_id").alias("w_id"), F.col("text_key").alias("w_key"))
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    texts = texts.join(wanted, (F.col("text_key") == F.col("w_key")) & F.col("doc_id").eqNullSafe(F.col("w_id")), "left_semi")
    return texts.select("text").mapInArrow(run, "set_key binary, shingles binary").dropDuplicates(["set_key"])


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a, b`` of set keys with the similarity of their full sets, and whether that makes a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                both = np.sort(np.concatenate([p, q]))
                inter = int((both[1:] == both[:-1]).sum())
                union = len(p) + len(q) - inter
                found.append((inter / union, 100 * inter >= PERCENT * union))
            columns = [batch.column("a"), batch.column("b"), *map(pa.array, zip(*found, strict=True))] if found else [batch.column("a"), batch.column("b"), pa.array([], pa.float64()), pa.array([], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "similarity", "linked"])

    one = sets.select(F.col("set_key").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("set_key").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary, similarity double, linked boolean")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_key (xxhash64 of the text): a row per row of ``docs``.

    Null and wordless texts have empty sets and stand alone.  Rows that share a
    doc_id are linked by their texts like any others.  ``component_id`` passes over
    null ids; a component of null ids alone has none, and its rows are kept.
    """
    signed = written(signatures(docs))
    nodes = signed.filter("set_key IS NOT NULL").groupBy("set_key").agg(F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("bits").alias("bits"), F.first("trace").alias("trace"), F.min("doc_id").alias("least_id"), F.min(F.struct("doc_id", "text_key")).alias("example"))
    nodes = written(nodes)
    keyed = nodes.select("set_key", F.explode("bands").alias("band")).repartition("band")
    crowded = keyed.groupBy("band").agg(F.min("set_key").alias("low"), F.max("set_key").alias("high"), F.count("set_key").alias("crowd")).filter("low != high")
    shared = written(keyed.join(crowded.select("band", "crowd"), "band"))
    # The head of a bucket is the member that meets most others in all its buckets: the text that copies were made from, if it is there.
    degrees = shared.groupBy("set_key").agg(F.sum("crowd").alias("degree")).join(nodes.select("set_key", "n"), "set_key")
    members = shared.select("band", "set_key").join(degrees, "set_key")
    heads = members.groupBy("band").agg(F.max(F.struct("degree", "set_key", "n")).alias("head")).select("band", F.col("head.set_key").alias("head"), F.col("head.n").alias("head_n"))
    members = written(members.select("band", "set_key", "n").join(heads, "band"))
    similar = lambda x, y: f"100 * least({x}, {y}) >= {PERCENT} * greatest({x}, {y})"
    stars = members.filter("set_key != head").filter(similar("n", "head_n")).select(F.col("set_key").alias("a"), F.col("head").alias("b")).distinct()
    wanted = members.select("set_key").distinct().join(nodes, "set_key").select("example.doc_id", "example.text_key")
    sets = written(full_sets(docs, wanted))
    stars = written(compared(stars, sets))
    links = stars.filter("linked").select("a", "b")
    roots = connected_components(links)

    # Members of other components than their bucket's head may still be linked to one another.  1 - similarity is a metric,
    # so distances to the head (bounds, where sizes differ too much to compare) rule most of them out.
    def rooted(df: DataFrame, key: str, name: str) -> DataFrame:
        return df.join(roots.select(F.col("node").alias(key), F.col("root").alias(name)), key, "left").withColumn(name, F.coalesce(name, key))

    placed = rooted(rooted(members, "set_key", "root"), "head", "head_root")
    placed = placed.join(stars.select(F.col("a").alias("set_key"), F.col("b").alias("head"), "similarity"), ["set_key", "head"], "left")
    exact = F.when(F.col("set_key") == F.col("head"), 0.0).otherwise(1 - F.col("similarity"))
    bound = 1 - F.least("n", "head_n") / F.greatest("n", "head_n")
    placed = written(placed.select("band", "set_key", "n", "head", "root", "head_root", F.coalesce(exact, bound).alias("low"), F.coalesce(exact, F.lit(1.0)).alias("high")))
    others = placed.filter("set_key != head")
    crowds = others.groupBy("band").agg(F.count("*").alias("others"), F.count_if(F.col("root") != F.col("head_root")).alias("minors")).filter("others > 1 AND minors > 0")
    others = others.withColumn("minor", F.col("root") != F.col("head_root")).join(crowds.select("band"), "band").join(nodes.select("set_key", "bands", "bits", "trace"), "set_key")
    side = lambda df, x: df.select("band", *(F.col(c).alias(f"{x}_{c}") for c in ("set_key", "n", "root", "low", "high", "bands", "bits", "trace", "minor")))
    apart = F.greatest(F.col("a_low") - F.col("b_high"), F.col("b_low") - F.col("a_high"))
    unequal = F.aggregate(F.zip_with("a_bits", "b_bits", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    estimate = 1 - 2 * unequal / (BITS * COORDINATES)
    is_near = (F.least("a_n", "b_n") < TRACE_BITS) | (estimate >= LEAST_ESTIMATE)
    first_band = F.try_element_at(F.filter("a_bands", lambda x, i: x == F.element_at("b_bands", i + 1)), F.lit(1))  # a pair counts in the first bucket that it shares
    rest = (
        side(others.filter("minor"), "a").join(side(others, "b"), "band").filter("a_root != b_root AND (NOT b_minor OR a_set_key < b_set_key)").filter(similar("a_n", "b_n"))
        .filter(apart <= 1 - PERCENT / 100 + 1e-9).filter(may_link((F.col("a_n"), F.col("b_n")), (F.col("a_trace"), F.col("b_trace")))).filter(is_near).filter(first_band == F.col("band"))
    )
    pairs = rest.select(F.least("a_set_key", "b_set_key").alias("a"), F.greatest("a_set_key", "b_set_key").alias("b")).distinct()
    more = written(compared(pairs, sets).filter("linked").select("a", "b"))
    if not more.isEmpty():
        roots = connected_components(links.unionByName(more))

    owned = nodes.select("set_key", "least_id").join(roots.select(F.col("node").alias("set_key"), "root"), "set_key", "left").withColumn("root", F.coalesce("root", "set_key"))
    ids = owned.groupBy("root").agg(F.min("least_id").alias("component_id"))
    ids = written(owned.join(ids, "root").select("set_key", "component_id"))
    slim = written(signed.select("doc_id", "text_key", "n_shingles", "set_key"))
    drop(signed, nodes, shared, members, sets, stars, placed, more)
    out = slim.join(ids, "set_key", "left")
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"), "text_key")


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, one of those that share a doc_id; of rows without one, one of each text.

    The choice is made on keys alone; texts are shuffled once, to meet the keys
    that stay.  Other columns may have any names.
    """
    keys = lambda doc_id, text_key: [F.coalesce(doc_id, F.lit(0)).alias("id"), doc_id.isNull().alias("no_id"), text_key.alias("text_key")]
    kept = near_duplicates(docs).filter("kept").select(*keys(F.col("doc_id"), F.col("text_key")))
    kept = kept.groupBy("id", "no_id", F.when(F.col("no_id"), F.col("text_key")).alias("own")).agg(F.min("text_key").alias("text_key")).drop("own")
    rows = docs.select(F.struct("*").alias("row"), *keys(F.col("doc_id"), F.xxhash64("text")))
    return rows.join(kept, ["id", "no_id", "text_key"]).dropDuplicates(["id", "no_id", "text_key"]).select("row.*")
