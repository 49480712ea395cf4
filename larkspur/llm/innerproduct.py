"""Exact top-k search by inner product: long vectors first, rotated partial sums, Cauchy-Schwarz bounds.

1. Components become integers, floor(``scale`` * x). A vector that is null or holds a null or a number that is not finite
   takes no part.
2. Vectors are put in order of descending length (range partitioning) and written as blocks, each a matrix in a row; the
   queries are written as blocks as well.
3. A rotation is fitted by singular value decomposition of ``sample`` vectors (chosen by hash): most of a product is then
   in the first components. It decides how early a bound is tight, never a result.
4. Each query is compared with the ``head`` longest vectors first. Its k-th best score there is a floor from which
   everything else is pruned.
5. Cells: groups of queries meet groups of blocks. In a cell blocks come in descending length. A block, and all
   after it, is passed over where the lengths' product is below every query's floor; within a block the sums over the first
   quarter, half and three quarters of the rotated components, plus the product of the lengths of what is left, are upper
   bounds, and what falls below the floor is dropped. The others get their exact integer score; floors rise as a query fills up.
6. The k best of each cell meet by query.

Copies of a vector travel once for each group of queries, queries once for each group of blocks. Nothing but head, sample
and rotation passes through the driver; their sizes do not depend on the table.

Scores are integers and exact: as doubles while the product of the lengths is below 2**53, as 64-bit integers beyond.

Defined results: of rows with the same id and the same integers one takes part; rows of one id with different vectors each
take part, and a query is not compared with rows of its own id. A null id asks nothing and is found like others, behind all ids
in a tie. Vectors of different lengths are filled up with zeros, an empty one is all zeros. A zero vector scores 0 with everything.
Fewer than k others: all are returned. Without queries, or in an empty table, there are no rows. A vector whose integers
have a squared length of 2**62 or more can have scores beyond 64 bits and is an error. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.llm.common import materialize

#: Rows of a block, bytes of the vectors of a group of blocks and of a group of queries (4 bytes a component), about.
BLOCK_ROWS, GROUP_BYTES, QUERY_BYTES = 2048, 16 << 20, 4 << 20
#: Bytes of the longest vectors that give the first floors, and of the vectors that the rotation is fitted on.
HEAD_BYTES, SAMPLE_BYTES = 1 << 20, 1 << 20
#: Queries whose products with a block are held at once.
SLICE = 256
NO_FLOOR = np.iinfo(np.int64).min


def integers(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(id, v, size) with v as array<long> and its squared length, one row for each (id, v)."""
    x = F.transform(F.col(vector), lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    raw = F.transform(F.col(vector), lambda c: c.cast("double"))
    finite = F.col(vector).isNotNull() & F.forall(raw, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    # As doubles: the sum is only compared with a limit here.
    far = F.aggregate(raw, F.lit(0.0), lambda s, c: s + F.pow(F.floor(F.lit(float(scale)) * c).cast("double"), F.lit(2.0))) >= float(2**62)
    checked = F.when(far, F.raise_error(F.lit("a vector is too long: its scores can pass 64 bits")).cast("array<bigint>")).otherwise(x)
    rows = vectors.where(finite).select(F.col(key).cast("long").alias("id"), checked.alias("v"))
    return rows.withColumn("size", F.aggregate("v", F.lit(0).cast("long"), lambda s, c: s + c * c))


def matrix(rows: list, dims: int) -> np.ndarray:
    out = np.zeros((len(rows), dims), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _lists(column: pa.Array, dims: int) -> np.ndarray:
    """A matrix from an Arrow column of lists."""
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    out = np.zeros((len(column), dims), np.int64)
    row = np.repeat(np.arange(len(column)), lengths)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values[offsets[0] : offsets[-1]]
    return out


BLOCK = "number long, rows int, ids binary, unnamed binary, matrix binary"


def blocks(rows: DataFrame, dims: int, block_rows: int) -> DataFrame:
    """BLOCK rows of (id, v) rows, in the order that these have in their partitions; equal rows, which stand together, become one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, last = 0, 0, None
        for b in batches:
            if not b.num_rows:
                continue
            part = b.column(2)[0].as_py()
            x, ids = _lists(b.column(1), dims), b.column(0)
            unnamed = ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy()
            fresh = np.ones(len(ids), bool)
            fresh[1:] = (ids[1:] != ids[:-1]) | (unnamed[1:] != unnamed[:-1]) | (x[1:] != x[:-1]).any(axis=1)
            if last is not None:
                fresh[0] = (ids[0], unnamed[0]) != last[:2] or (x[0] != last[2]).any()
            last = (ids[-1], unnamed[-1], x[-1].copy())
            keep = np.flatnonzero(fresh)
            for i in range(0, len(keep), block_rows):
                some = keep[i : i + block_rows]
                yield pa.record_batch([pa.array([part << 32 | number]), pa.array([len(some)], pa.int32()), *[pa.array([a.tobytes()], pa.binary()) for a in (ids[some], unnamed[some], narrow(x[some]))]], names=[f.split()[0] for f in BLOCK.split(", ")])
                number += 1

    return rows.select("id", "v", F.spark_partition_id().cast("long").alias("p")).mapInArrow(run, BLOCK)


def narrow(x: np.ndarray) -> np.ndarray:
    """In 16 bits where all values fit, else in 64."""
    return x.astype(np.int16) if not x.size or (np.abs(x) < 2**15).all() else x


class Block:
    """A matrix with the ids of its rows, rotated, with the lengths of what follows the first components."""

    def __init__(self, row: dict, rotation: np.ndarray, stages: tuple[int, ...]):
        n, dims = row["rows"], len(rotation)
        kind = np.int16 if len(row["matrix"]) == 2 * n * dims else np.int64
        self.ids, self.unnamed = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["unnamed"], bool)
        self.x = np.frombuffer(row["matrix"], kind).reshape(n, dims)
        self.f = self.x.astype(np.float64)
        turned = self.f @ rotation
        self.length = np.sqrt((self.f**2).sum(axis=1))
        # Sums over all components are the lengths, so the rest is taken from behind.
        square = np.cumsum(turned[:, ::-1] ** 2, axis=1)[:, ::-1]
        self.rest = [np.sqrt(square[:, s]).astype(np.float32) if s < dims else np.zeros(n, np.float32) for s in stages]
        self.turned = turned.astype(np.float32)


def cuts(dims: int) -> tuple[int, ...]:
    """After how many components a bound is taken."""
    return tuple(sorted({max(1, dims * i // 4) for i in (1, 2, 3)} - {dims})) or (dims,)


def candidates(q: Block, at: slice, b: Block, floors: np.ndarray, stages: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) places, the queries counted from the slice's start, of the pairs whose bounds reach the query's floor."""
    rows, cols = np.flatnonzero(q.length[at] * b.length.max(initial=0) * (1 + 1e-9) >= floors), np.arange(len(b.ids))
    if not len(rows):
        return rows, rows
    # Rounding of 32-bit sums, at most: a part of the product of the lengths.
    low = floors[rows].astype(np.float64)
    slack = (q.length[at][rows] * (q.f.shape[1] + 16) * 2.0**-23)[:, None]
    total, begin = np.zeros((len(rows), len(cols)), np.float32), 0
    alive = np.ones(total.shape, bool)
    for stage, qr, br in zip(stages, q.rest, b.rest, strict=True):
        total += q.turned[at][rows, begin:stage] @ b.turned[cols, begin:stage].T
        begin = stage
        bound = total + qr[at][rows][:, None] * br[cols]
        alive = bound >= (low[:, None] - slack * b.length[cols]).astype(np.float32) - np.float32(1e-3)
        some_rows, some_cols = alive.any(axis=1), alive.any(axis=0)
        if not some_rows.any():
            return rows[:0], rows[:0]
        if some_cols.mean() < 0.8 or some_rows.mean() < 0.8:
            rows, cols, low, slack = rows[some_rows], cols[some_cols], low[some_rows], slack[some_rows]
            total, alive = total[some_rows][:, some_cols], alive[some_rows][:, some_cols]
    i, j = np.nonzero(alive)
    return rows[i], cols[j]


def exact(q: Block, at: slice, b: Block, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Integer scores of the pairs."""
    most = q.length[at].max(initial=0) * b.length.max(initial=0)
    if most < 2**52:
        left, right = q.f[at], b.f
        if 8 * len(i) > left.shape[0] * right.shape[0]:
            return (left @ right.T)[i, j].astype(np.int64)
    else:
        left, right = q.x[at].astype(np.int64), b.x.astype(np.int64)
    out = np.empty(len(i), np.int64)
    for k in range(0, len(i), 1 << 16):
        out[k : k + (1 << 16)] = np.einsum("ij,ij->i", left[i[k : k + (1 << 16)]], right[j[k : k + (1 << 16)]])
    return out


class Best:
    """The k best of each query of a slice: score, then smaller id, ids before none."""

    def __init__(self, k: int, floors: np.ndarray):
        self.k, self.floors = k, floors.copy()
        self.query = self.score = self.id = np.empty(0, np.int64)
        self.unnamed = np.empty(0, bool)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, unnamed: np.ndarray) -> None:
        hit = score >= self.floors[query]
        query, score, ids, unnamed = (np.concatenate([a, b[hit]]) for a, b in zip((self.query, self.score, self.id, self.unnamed), (query, score, ids, unnamed), strict=True))
        order = np.lexsort((ids, unnamed, -score, query))
        query = query[order]
        rank = np.arange(len(order)) - np.searchsorted(query, query)
        kept = rank < self.k
        order = order[kept]
        self.query, self.score, self.id, self.unnamed = query[kept], score[order], ids[order], unnamed[order]
        full = rank[kept] == self.k - 1
        self.floors[self.query[full]] = np.maximum(self.floors[self.query[full]], self.score[full])


def search(q: Block, ordered: list[Block], k: int, floors: np.ndarray, stages: tuple[int, ...]) -> Iterator[tuple[int, Best]]:
    """Blocks in descending length against the queries of a block, a slice after the other: (where it begins, what was found)."""
    for start in range(0, len(q.ids), SLICE):
        at = slice(start, start + SLICE)
        best = Best(k, floors[at])
        for b in ordered:
            if (q.length[at] * b.length.max(initial=0) * (1 + 1e-9) < best.floors).all():
                break  # shorter ones follow
            i, j = candidates(q, at, b, best.floors, stages)
            other = (b.ids[j] != q.ids[at][i]) | b.unnamed[j]
            i, j = i[other], j[other]
            if len(i):
                best.add(i, exact(q, at, b, i, j), b.ids[j], b.unnamed[j])
        yield start, best


FOUND = "number long, place int, query_id long, vec_id long, score long"


def top_k(vectors: DataFrame, asks: Column, k: int = 20, scale: int = 64, key: str = "vec_id", vector: str = "embedding", block_rows: int = BLOCK_ROWS, group_bytes: int = GROUP_BYTES, query_bytes: int = QUERY_BYTES, head_bytes: int = HEAD_BYTES, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row for which ``asks`` (a condition on ``id``) holds its k best others."""
    rows = materialize(integers(vectors, key, vector, scale), "integers")
    asks = F.col("id").isNotNull() & asks
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("dims"), F.count_if(asks).alias("queries")).first()
    dims = max(1, size["dims"])
    stages = cuts(dims)
    sample = [r["v"] for r in rows.orderBy(F.xxhash64("id", "v")).limit(max(dims, sample_bytes // (4 * dims))).select("v").collect()]
    rotation = np.linalg.svd(matrix(sample, dims).astype(np.float64), full_matrices=True)[2].T if sample else np.eye(dims)
    longest = rows.orderBy(F.desc("size"), "id").limit(max(k + 1, head_bytes // (4 * dims))).select("id", "v").collect()
    # A repeated row must not count twice for a floor.
    head_rows = list({(r["id"], tuple(matrix([r["v"]], dims)[0].tolist())): None for r in longest})

    # Small tables are cut finer, so that there is work for all cores.
    spark = vectors.sparkSession
    parts = max(1, -(-size["n"] * dims * 4 // group_bytes), min(-(-size["n"] // block_rows), 4 * spark.sparkContext.defaultParallelism))
    query_parts = max(1, -(-size["queries"] * dims * 4 // query_bytes))
    by_length = [F.desc("size"), F.col("id").asc_nulls_last()]
    ranged = rows.repartitionByRange(parts, *by_length, F.when(F.col("id").isNull(), F.xxhash64("v"))).sortWithinPartitions(*by_length, "v")
    laid = materialize(blocks(ranged, dims, block_rows), "blocks")
    asking = blocks(rows.where(asks).repartition(query_parts, "id").sortWithinPartitions("id", "size", "v"), dims, block_rows)

    def with_floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = matrix([v for _, v in head_rows], dims)
        ids, unnamed = np.array([i or 0 for i, _ in head_rows], np.int64), np.array([i is None for i, _ in head_rows], bool)
        first = [Block({"rows": len(x), "ids": ids.tobytes(), "unnamed": unnamed.tobytes(), "matrix": narrow(x).tobytes()}, rotation, stages)]
        for b in batches:
            found = []
            for r in b.to_pylist():
                q = Block(r, rotation, stages)
                found.append(np.concatenate([best.floors for _, best in search(q, first, k, np.full(len(q.ids), NO_FLOOR), stages)]).tobytes())
            yield pa.record_batch([*b.columns, pa.array(found, pa.binary())], names=[*b.schema.names, "floors"])

    seeded = materialize(asking.mapInArrow(with_floors, BLOCK + ", floors binary"), "queries")

    def grouped(df: DataFrame, groups: int, name: str, other: str, others: int) -> DataFrame:
        """Neighbouring partitions are a group; each row goes to all groups of the other side: a stated query set against all rows."""
        number = F.shiftright("number", 32)
        made = (df.agg(F.max(number)).first()[0] or 0) + 1
        return df.withColumn(name, F.call_function("div", number * groups, F.lit(max(made, groups)).cast("long")).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    left, right = grouped(seeded, query_parts, "qg", "bg", parts), grouped(laid, parts, "bg", "qg", query_parts)
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * parts * query_parts)

    def meet(queries: pa.Table, data: pa.Table) -> pa.Table:
        ordered = [Block(r, rotation, stages) for r in sorted(data.to_pylist(), key=lambda r: r["number"])]
        out = []
        for r in queries.to_pylist():
            q = Block(r, rotation, stages)
            for start, best in search(q, ordered, k, np.frombuffer(r["floors"], np.int64), stages):
                place = best.query + start
                out.append(pa.record_batch([pa.array(np.full(len(place), r["number"], np.int64)), pa.array(place.astype(np.int32)), pa.array(q.ids[place]), pa.array(best.id, mask=best.unnamed), pa.array(best.score)], names=_FOUND.names))
        return pa.Table.from_batches(out, _FOUND)

    # Dealt to a stated number of partitions, cells are not put together again for their few bytes.
    deal = lambda df: df.repartition(n_parts, "qg", "bg").groupBy("qg", "bg")
    found = deal(left).cogroup(deal(right)).applyInArrow(meet, FOUND)
    best = W.partitionBy("number", "place").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


_FOUND = pa.schema([("number", pa.int64()), ("place", pa.int32()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
