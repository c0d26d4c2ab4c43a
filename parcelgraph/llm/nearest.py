"""Approximate nearest neighbours by collision counting (maximum inner product).

Vectors get one more component that makes their norms equal, so the largest inner
product is the smallest distance.  Rows are dealt to blocks of about
``BLOCK_ROWS``; a block's index has, for each of ``PROJECTIONS`` random
directions, its rows sorted by their projection, with the set of rows before each
of some places, so that a window is the difference of two sets.  A query opens a window around
its own projection in every sorted array; a row that lies in at least
``THRESHOLD`` of the windows is a candidate.  While a block has too few, windows
widen by ``GROWTH`` (virtual rehashing: the same arrays serve every radius).
Candidates are verified on the original vectors in double precision.

Every query meets every block, in groups of a block of rows and a block of
queries, both bounded; only each group's best rows are shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelgraph.llm.shared import small

TOP = 20
PROJECTIONS = 160
#: Share of the windows in which a candidate lies.
THRESHOLD = 0.6
#: First half-width of a window, in standard deviations of the projections, and how it grows.
WIDTH, GROWTH = 0.8, 1.08
#: A block is done when it has this many candidates for each row wanted, plus a share of its rows.
PER_WANTED = 8
CANDIDATES = 0.1
BLOCK_ROWS = 12_000
#: Cells of equal numbers of rows into which a sorted array is divided; windows consist of cells.
CELLS = 128
#: Queries that are counted together.
BATCH = 8
BLOCK_QUERIES = 2_000
#: Most different dimensions whose numbers of blocks are broadcast; 16 bytes each.
BROADCAST_DIMENSIONS = 100_000
SEED = 11


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _index(projected: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each direction the projections in order, and for each of CELLS + 1 places in that order the set of rows before it, as bits."""
    m, n = projected.shape
    order = np.argsort(projected, axis=1)
    ends = np.arange(CELLS + 1) * n // CELLS
    before = np.zeros((m, CELLS + 1, -(-n // 64)), dtype=np.uint64)
    rank = np.empty(n, dtype=np.int64)
    for j in range(m):
        rank[order[j]] = np.arange(n)
        bits = np.packbits(rank < ends[:, None], axis=1, bitorder="little")
        before[j].view(np.uint8)[:, : bits.shape[1]] = bits
    return np.take_along_axis(projected, order, axis=1), before


def _at_least(sets: np.ndarray, need: int) -> np.ndarray:
    """The rows in at least ``need`` of the sets of bits along the first axis, counted in all bits at once by full adders."""
    planes, x = [], sets
    while len(x):
        carries = []
        while len(x) > 1:
            t = max(1, len(x) // 3)
            if len(x) == 2:
                one, other = x[:1], x[1:]
                x, carry = one ^ other, one & other
            else:
                one, other, third = x[:t], x[t : 2 * t], x[2 * t : 3 * t]
                either = one ^ other
                carry = (one & other) | (third & either)
                x = np.concatenate([either ^ third, x[3 * t :]])
            carries.append(carry)
        planes.append(x[0])
        x = np.concatenate(carries) if carries else x[:0]
    more, same = np.zeros_like(planes[0]), np.full_like(planes[0], ~np.uint64(0))
    for b in range(max(len(planes), need.bit_length()) - 1, -1, -1):
        plane = planes[b] if b < len(planes) else np.zeros_like(more)
        if need >> b & 1:
            same = same & plane
        else:
            more |= same & plane
            same &= ~plane
    return more | same


def candidates(rows: np.ndarray, queries: np.ndarray, wanted: int) -> list[np.ndarray]:
    """For each query the numbers of the rows that collide often enough; norms are already equal."""
    n, dim = rows.shape
    directions = np.random.Generator(np.random.PCG64(SEED)).standard_normal((dim, PROJECTIONS))
    projected, asked = np.ascontiguousarray((rows @ directions).T), queries @ directions
    sorted_arrays, before = _index(projected)
    unit = float(projected.std()) or 1.0
    need, wanted = int(np.ceil(THRESHOLD * PROJECTIONS)), min(wanted, n)
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(queries)
    open_queries, width, every = np.arange(len(queries)), WIDTH * unit, np.arange(PROJECTIONS)
    while len(open_queries):
        # A window is widened to whole cells.
        low = np.stack([np.searchsorted(s, asked[open_queries, j] - width, "left") for j, s in enumerate(sorted_arrays)], axis=1) * CELLS // n
        high = -(-np.stack([np.searchsorted(s, asked[open_queries, j] + width, "right") for j, s in enumerate(sorted_arrays)], axis=1) * CELLS // n)
        still = []
        for a in range(0, len(open_queries), BATCH):
            lo, hi = low[a : a + BATCH], high[a : a + BATCH]
            windows = (before[every, hi] ^ before[every, lo]).transpose(1, 0, 2)
            found = _at_least(windows.reshape(PROJECTIONS, -1), need).reshape(len(lo), -1)
            sizes = np.bitwise_count(found).sum(axis=1)
            for i, q in enumerate(open_queries[a : a + BATCH]):
                if sizes[i] >= wanted:
                    out[q] = np.flatnonzero(np.unpackbits(found[i].view(np.uint8), bitorder="little")[:n])
                else:
                    still.append(q)
        open_queries, width = np.array(still, dtype=np.int64), width * GROWTH
    return out


def nearest(vectors: DataFrame, is_query, top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score for the rows for which ``is_query`` holds.

    Vectors that are null, empty, zero, or hold null or non-finite components take
    no part; nor do rows without a vec_id.  Only vectors of one dimension have an
    inner product, so a query's candidates are the rows of its own dimension.
    Rows that share a vec_id count once (the least vector).  Ties go to the
    smaller vec_id; a query with fewer candidates than ``top`` gets them all.  An
    empty table gives no rows; other columns are not read.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = vectors.filter("vec_id IS NOT NULL AND embedding IS NOT NULL").filter(finite & F.exists("embedding", lambda x: x != 0))
    usable = usable.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    usable = usable.withColumns({"dim": F.size("embedding"), "asks": F.coalesce(is_query, F.lit(False))})
    parts = lambda n, each: F.greatest(F.lit(1), F.ceil(n / each)).cast("int")
    grids = usable.groupBy("dim").agg(parts(F.count("*"), BLOCK_ROWS).alias("blocks"), parts(F.count_if("asks"), BLOCK_QUERIES).alias("chunks"))
    usable = usable.join(small(grids, BROADCAST_DIMENSIONS), "dim")
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def search(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if rows.num_rows and queries.num_rows:
            dim = rows.column("dim")[0].as_py()
            ids, asked_ids = rows.column("vec_id").to_numpy(), queries.column("vec_id").to_numpy()
            own, q = _matrix(rows.column("embedding"), dim), _matrix(queries.column("embedding"), dim)
            # Scaled, so that no square overflows; a row or query may be scaled without changing which rows are nearest.
            scaled, asked = own / np.abs(own).max(), q / np.abs(q).max(axis=1, keepdims=True)
            squares = (scaled * scaled).sum(axis=1)
            scaled = np.column_stack([scaled, np.sqrt(np.maximum(squares.max() - squares, 0.0))])
            asked = np.column_stack([asked * (np.sqrt(squares.max()) / np.linalg.norm(asked, axis=1))[:, None], np.zeros(len(q))])
            wanted = PER_WANTED * top + int(CANDIDATES * len(own))
            for i, found in enumerate(candidates(scaled, asked, wanted)):
                found = found[ids[found] != asked_ids[i]]
                score = (own[found] * q[i]).sum(axis=1)
                best = np.lexsort((ids[found], -score))[:top]
                out.append((np.full(len(best), asked_ids[i]), ids[found][best], score[best]))
        return pa.Table.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    place = lambda n, *of: F.pmod(F.xxhash64(*of), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = usable.select("vec_id", "embedding", "dim", place("blocks", "vec_id").alias("block"), every("chunks").alias("chunk"))
    again = [F.col(c).alias(c) for c in ("vec_id", "embedding", "dim")]  # columns of their own, since both sides come from one table
    queries = usable.filter("asks").select(*again, place("chunks", F.lit("query"), "vec_id").alias("chunk"), every("blocks").alias("block"))
    key = ["dim", "block", "chunk"]
    found = rows.groupBy(*key).cogroup(queries.groupBy(*key)).applyInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
